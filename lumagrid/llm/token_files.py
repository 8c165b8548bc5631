"""Token ids in files: static range asymmetric numeral coding of independent blocks.

The file format is a Parquet folder pair. `frequencies` holds the shared table (token, frequency; they add up to 2^20,
every token of the vocabulary has at least 1). `blocks` holds one row per block of whole documents in ascending order
of id: part and block (their order), docs and counts (ids and token counts, little-endian 64-bit), n_tokens, lanes,
every (steps between checkpoints), states (64-bit lane states at every checkpoint and at the start), words_at (words
read before each checkpoint), words (32-bit words) and crc (of the block's tokens, little-endian unsigned 32-bit).
Token i of a block is coded by lane i mod lanes in step i div lanes; lanes are independent coders that share one
stream of words, so decoding runs over all lanes at once and can begin at any checkpoint.

Defined results: null text is an empty document, which still has its end id; null document ids come first; rows of one
id follow one another; a very long text is one block; an empty table writes empty files and reads back as no rows; other
columns are never looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumagrid.llm import text as T
from lumagrid.llm.bpe import byte_bpe
from lumagrid.llm.shared import partitions, saved

BITS = 20
LANES = 2048
EVERY = 64
#: Tokens from which on a block ends.
BLOCK = 1 << 20
_LOW = np.uint64(1 << 31)


def frequencies(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Counts scaled to add up to 2^bits, each at least 1."""
    room = (1 << bits) - len(counts)
    assert room >= 0, "the vocabulary is larger than the table"
    total = max(1, int(counts.sum()))
    out = 1 + (counts.astype(np.float64) * (room / total)).astype(np.int64)
    out[int(np.argmax(counts))] += (1 << bits) - int(out.sum())
    return out


def encode_block(ids: np.ndarray, freq: np.ndarray, lanes: int = LANES, every: int = EVERY, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States at each checkpoint (the first is where decoding starts), words read before each, words."""
    f_all, c_all = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
    steps = -(-len(ids) // lanes)
    x, out, marks, n = np.full(lanes, _LOW), [], [], 0
    for step in range(steps - 1, -1, -1):
        sym = ids[step * lanes : (step + 1) * lanes]
        own, f, c = x[: len(sym)], f_all[sym], c_all[sym]
        full = own >= f << np.uint64(63 - bits)
        words = (own[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        out.append(words)
        n += len(words)
        own = np.where(full, own >> np.uint64(32), own)
        x[: len(sym)] = (own // f << np.uint64(bits)) + own % f + c
        if step % every == 0:
            marks.append((x.copy(), n))
    marks = marks[::-1] or [(x, 0)]
    return np.concatenate([m[0] for m in marks]), np.array([n - m[1] for m in marks], np.int64), np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)


def decode_block(n_tokens: int, states: np.ndarray, words_at: np.ndarray, words: np.ndarray, freq: np.ndarray, symbol: np.ndarray, lanes: int = LANES, every: int = EVERY, bits: int = BITS, checkpoint: int = 0, until: int | None = None) -> np.ndarray:
    """Tokens from a checkpoint on, up to a later one or the end."""
    f_all, c_all = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
    x, at = states[checkpoint * lanes : (checkpoint + 1) * lanes].copy(), int(words_at[checkpoint])
    last = -(-n_tokens // lanes) if until is None else until * every
    out, mask = [], np.uint64((1 << bits) - 1)
    for step in range(checkpoint * every, last):
        k = min(lanes, n_tokens - step * lanes)
        slot = x[:k] & mask
        sym = symbol[slot]
        own = f_all[sym] * (x[:k] >> np.uint64(bits)) + slot - c_all[sym]
        low = np.flatnonzero(own < _LOW)
        own[low] = own[low] << np.uint64(32) | words[at : at + len(low)]
        at += len(low)
        x[:k] = own
        out.append(sym)
    return np.concatenate(out).astype(np.uint32) if out else np.zeros(0, np.uint32)


def symbols(freq: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(freq), dtype=np.int32), freq)


def _table(rows) -> np.ndarray:
    freq = np.zeros(len(rows), np.int64)
    for r in rows:
        freq[r.token] = r.frequency
    return freq


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int = 0, doc: str = "doc_id", text: str = "text", lanes: int = LANES, every: int = EVERY, block: int = BLOCK) -> None:
    """Encode every document, append end_id, and write the ids to folder in ascending order of document ids."""
    slim = docs.select(F.col(doc).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt = slim.repartitionByRange(partitions(docs), "doc_id").sortWithinPartitions("doc_id").withColumn("part", F.spark_partition_id().cast("long"))

    def gather(batches):
        bpe, n, ids, own, part = byte_bpe(path), 0, [], [[], []], 0

        def done():
            tokens = np.concatenate([np.zeros(0, np.uint32), *ids])
            values = [part, n, own[0], T.blob(np.concatenate([np.zeros(0, "<i8"), *own[1]])), T.blob(tokens.astype(np.uint16 if len(bpe.length) <= 1 << 16 else np.uint32)), len(tokens)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64()))], ["part", "block", "docs", "counts", "tokens", "n_tokens"])

        for batch in batches:
            part = batch.column(2)[0].as_py() if batch.num_rows else part
            for rows, buf, off in T.slices(batch, "text"):
                got, n_own = bpe.encode(buf, off)
                ends = np.cumsum(n_own)
                ids.append(np.insert(got, ends, end_id))
                own[0] += rows.column(0).to_pylist()
                own[1].append((n_own + 1).astype("<i8"))
                if sum(map(len, ids)) >= block:
                    yield done()
                    n, ids, own = n + 1, [], [[], []]
        if ids:
            yield done()

    plain = saved(dealt.mapInArrow(gather, "part long, block long, docs array<long>, counts binary, tokens binary, n_tokens long"))
    size = byte_bpe(path).length.size
    kind = np.uint16 if size <= 1 << 16 else np.uint32

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(x, kind), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["token", "n"])

    # one row per token of the vocabulary at most, so the table may pass through the driver
    counts = np.zeros(size, np.int64)
    for r in plain.select("tokens").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():
        counts[r.token] = r.n
    freq = frequencies(counts)
    spark = docs.sparkSession
    spark.createDataFrame(pa.table({"token": np.arange(size), "frequency": freq})).write.mode("overwrite").parquet(f"{folder}/frequencies")

    def code(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                ids = np.frombuffer(batch.column(4)[r].as_py(), kind).astype(np.int64)
                states, words_at, words = encode_block(ids, freq, lanes, every)
                more = [lanes, every, T.blob(states.astype("<u8")), T.blob(words_at.astype("<i8")), T.blob(words.astype("<u4")), zlib.crc32(T.blob(ids.astype("<u4")))]
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(r, 1) for k in (0, 1, 2, 3, 5)] + [pa.array([v], t) for v, t in zip(more, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64()))], ["part", "block", "docs", "counts", "n_tokens", "lanes", "every", "states", "words_at", "words", "crc"])

    plain.mapInArrow(code, "part long, block long, docs array<long>, counts binary, n_tokens long, lanes int, every int, states binary, words_at binary, words binary, crc long").write.mode("overwrite").parquet(f"{folder}/blocks")


def _before(spark: SparkSession, folder: str) -> DataFrame:
    """part, block, before: tokens before each block, a running sum within its part and one over parts."""
    sizes = spark.read.parquet(f"{folder}/blocks").select("part", "block", "n_tokens")
    inner = W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("parts_before"))
    return sizes.select("part", "block", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)).alias("blocks_before")).join(sums, "part").select("part", "block", (F.col("parts_before") + F.col("blocks_before")).alias("before"))


def read_tokens(spark: SparkSession, folder: str, tokens: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 and, unless told otherwise, ids; raises where a checksum fails."""
    freq = _table(spark.read.parquet(f"{folder}/frequencies").collect())  # bounded by the vocabulary
    blocks = spark.read.parquet(f"{folder}/blocks")
    before = _before(spark, folder)

    def decode(batches):
        by_slot = symbols(freq)
        for batch in batches:
            for r in batch.to_pylist():
                ids = decode_block(r["n_tokens"], *(np.frombuffer(r[k], t) for k, t in (("states", "<u8"), ("words_at", "<i8"), ("words", "<u4"))), freq, by_slot, r["lanes"], r["every"])
                if zlib.crc32(T.blob(ids.astype("<u4"))) != r["crc"]:
                    raise ValueError(f"block {r['block']} of part {r['part']} fails its checksum")
                n = np.frombuffer(r["counts"], "<i8")
                ends = np.cumsum(n)
                own = [T.blob(x.astype("<u4")) for x in np.split(ids, ends[:-1])]
                out = {"part": pa.array([r["part"]] * len(n), pa.int64()), "block": pa.array([r["block"]] * len(n), pa.int64()), "doc_id": pa.array(r["docs"], pa.int64()), "at": pa.array(ends - n, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_crc32": pa.array([zlib.crc32(x) for x in own], pa.int64())}
                yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(own, pa.binary())} if tokens else {}))

    rows = blocks.mapInArrow(decode, "part long, block long, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids binary" * tokens)
    return rows.join(before, ["part", "block"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * tokens)


def read_range(spark: SparkSession, folder: str, first: int, last: int) -> DataFrame:
    """start, ids: the tokens from place first to before last of the whole stream, in pieces between two checkpoints.

    Only blocks that hold some of them are decoded, and of these only from the last checkpoint before the range on; each
    stretch between checkpoints is a row of its own before it is decoded, so that one block is decoded in parallel.
    """
    freq = _table(spark.read.parquet(f"{folder}/frequencies").collect())  # bounded by the vocabulary
    blocks = spark.read.parquet(f"{folder}/blocks").join(_before(spark, folder), ["part", "block"]).where((F.col("before") < last) & (F.col("before") + F.col("n_tokens") > first))
    size = F.col("lanes") * F.col("every")
    span = F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.lit(first) - F.col("before")) / size)).cast("int"), F.least(F.ceil(F.col("n_tokens") / size) - 1, F.floor((F.lit(last - 1) - F.col("before")) / size)).cast("int")))
    rows = blocks.select("before", "n_tokens", "lanes", "every", "states", "words_at", "words", span.alias("mark")).repartition(partitions(blocks), "before", "mark")

    def decode(batches):
        by_slot = symbols(freq)
        for batch in batches:
            for r in batch.to_pylist():
                size = r["lanes"] * r["every"]
                end = min((r["mark"] + 1) * size, r["n_tokens"])
                ids = decode_block(r["n_tokens"], *(np.frombuffer(r[k], t) for k, t in (("states", "<u8"), ("words_at", "<i8"), ("words", "<u4"))), freq, by_slot, r["lanes"], r["every"], checkpoint=r["mark"], until=None if end == r["n_tokens"] else r["mark"] + 1)
                at = r["before"] + r["mark"] * size
                lo, hi = max(first - at, 0), min(last - at, len(ids))
                yield pa.RecordBatch.from_pydict({"start": pa.array([at + lo], pa.int64()), "ids": pa.array([T.blob(ids[lo:hi].astype("<u4"))], pa.binary())})

    return rows.mapInArrow(decode, "start long, ids binary")
