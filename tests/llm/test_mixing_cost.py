import numpy as np

from lumagrid.llm import mixing


def _mixer(text: bytes) -> tuple[mixing.Mixer, np.ndarray]:
    keys = mixing.runs(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    sizes = mixing.table_sizes(len(text))
    tables = [np.zeros(1 << n, np.uint16) for n in sizes]
    for table, (at, zeros, ones) in zip(tables, mixing.bit_counts(*mixing._merge([keys], [np.ones(len(keys))]), sizes)):
        table[at] = mixing.packed(zeros, ones)
    m = mixing.Mixer(tables)
    m.learn(keys)
    m.freeze(m.weights())
    return m, np.unique(keys)


def test_shared_bits_are_worked_out_once(monkeypatch):
    """Runs with the same context and the same first bits share that work, and cost what each costs alone, in any order."""
    rng = np.random.default_rng(3)
    m, keys = _mixer(b" ".join(rng.choice([b"stone", b"stove", b"store", b"stare"], 400).tolist()))
    keys = np.sort(np.concatenate([keys, np.arange(256, dtype=np.uint64) | np.uint64(0x73746F << 8)]))
    alone = np.concatenate([m.cost(keys[k : k + 1]) for k in range(len(keys))])
    rows, inputs = [], mixing.Mixer.inputs
    monkeypatch.setattr(mixing.Mixer, "inputs", lambda self, own, *a: rows.append(len(own)) or inputs(self, own, *a))
    assert np.array_equal(m.cost(keys), alone)
    assert sum(rows) < 8 * len(keys) / 2
    order = rng.permutation(len(keys))
    assert np.array_equal(m.cost(keys[order]), alone[order])


def test_runs_that_come_again_are_remembered(monkeypatch):
    """What the last slice has is not worked out again when the memory is full, nor are known runs counted twice for it."""
    m, _ = _mixer(b"one two three four five six seven eight nine ten " * 20)
    slices = [np.frombuffer(t, np.uint8) for t in (b"one two three four five", b"six seven eight nine ten", b"six seven eight nine ten")]
    want = [m.cost(mixing.runs(b, np.array([0, len(b)]))) for b in slices]
    monkeypatch.setattr(mixing, "REMEMBERED", 30)
    done, cost = [], mixing.Mixer.cost
    monkeypatch.setattr(mixing.Mixer, "cost", lambda self, keys: done.append(len(keys)) or cost(self, keys))
    assert all(np.array_equal(m.place_bits(b, np.array([0, len(b)])), w) for b, w in zip(slices, want))
    assert done[:2] == [len(set(mixing.runs(b, np.array([0, len(b)])).tolist())) for b in slices[:2]] and sum(done[2:]) == 0
    assert not len(m.place_bits(np.zeros(0, np.uint8), np.array([0, 0])))
