import tracemalloc

import numpy as np

from lumagrid.llm import ngram_join as J
from lumagrid.llm import shared
from lumagrid.llm import text as T


def test_tables_follow_the_slice_and_go_with_the_batch():
    """A worker on small slices holds small tables, and an idle one none: idle workers count for their executor too."""
    T.give_back()
    data = np.frombuffer(b"some words of a small slice", np.uint8)
    first = T.hashes(data, np.array([0, 5]), np.array([4, 10]))
    assert sum(t.nbytes for t in T._powers.values()) <= 2 << 20
    T.hashes(np.zeros(200_000, np.uint8), np.array([0]), np.array([200_000]))
    assert np.array_equal(T.hashes(data, np.array([0, 5]), np.array([4, 10])), first)
    T.give_back()
    assert not T._powers
    assert np.array_equal(T.hashes(data, np.array([0, 5]), np.array([4, 10])), first)


def test_batches_and_slices_are_small():
    assert shared.BATCH_BYTES <= 4 << 20 and T.SLICE_BYTES <= 1 << 20


def test_hashing_a_slice_keeps_few_arrays():
    """Hashing holds the running sums of a slice and little else, whatever its length, and hashes do not depend on the place."""
    data = np.frombuffer(b"one two three " * 80_000, np.uint8)
    starts = np.flatnonzero(np.concatenate([[True], data[:-1] == 32]))
    ends = np.flatnonzero(data == 32)
    T.give_back()
    tracemalloc.start()
    h = T.hashes(data, starts[:100_000], ends[:100_000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak <= 16 * len(data)
    assert np.array_equal(h[:3], T.hashes(data[:14], starts[:3], ends[:3])) and np.array_equal(h[:99_999].reshape(-1, 3), np.tile(h[:3], (33_333, 1)))


def test_sessions_read_without_vectored_io(spark):
    shared.bounded_batches(spark)
    assert spark.conf.get("parquet.hadoop.vectored.io.enabled") == "false"


def test_lists_are_dealt_out_and_counted_in_pieces(spark, monkeypatch):
    """Classes are the same when shingles and pairs come in many small pieces, and no task gathers millions of either."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i // 4) * 50 + k}" for k in range(40 + i % 4))) for i in range(120)], "doc_id long, text string")
    whole = sorted(map(tuple, J.classes(docs).collect()))
    assert len({c for _, _, c in whole}) == 30 and J.HELD <= 250_000 and J.COUNTED <= 250_000
    for name in ("HELD", "COUNTED", "SEEN"):
        monkeypatch.setattr(J, name, 7)
    assert sorted(map(tuple, J.classes(docs).collect())) == whole
