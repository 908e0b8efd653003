"""Token-id files: one zstandard frame a document under a shared dictionary, with an offset index.

File format (a Parquet table in a shared folder, one row a block of consecutive documents):
shard, block: the place of the block; doc_ids: the ids, null last; index: for each document the end offset
of its frame in ``payload`` and its number of ids, as little-endian uint64 pairs; payload: the frames; dict_crc:
crc32 of the shared dictionary, which lies beside it as a one-row table. A reader gets one document by one
index entry and one frame; blocks hold about ``BLOCK_BYTES`` so that no task holds more than one.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from confluo.llm.bpe import WordEncoder, once, rest
from confluo.llm.common import BATCH, BATCH_BYTES, ID, KEY, TEXT, checkpoint_root, cyclic_parts, narrow, release, row_key, settings, shared_table, slices

#: Bytes of a block's frames, and of the texts of a shard.
BLOCK_BYTES, SHARD_BYTES = 1 << 20, 64 << 20
#: The dictionary is fitted on so many documents at most (smallest hash of the id), on so many letters and bytes of ids of
#: each at most, and is so large at most. A document is compressed whole, whatever the dictionary.
DICT_DOCS, DICT_LETTERS, DICT_IDS, DICT_BYTES, LEVEL = 1024, 1 << 16, 1 << 15, 64 << 10, 3


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int) -> bytes:
    """A dictionary from the id arrays of at most DICT_DOCS documents; empty where there is too little to learn."""
    chosen = docs.select(F.col(ID).alias("__pick")).distinct().orderBy(F.xxhash64("__pick"), "__pick").limit(DICT_DOCS)
    rows = docs.join(F.broadcast(chosen), F.col(ID) == F.col("__pick"), "left_semi").select(F.substring(TEXT, 1, DICT_LETTERS).alias(TEXT)).limit(2 * DICT_DOCS).collect()
    encoder = WordEncoder(tokenizer)
    samples = [encoder.encode((r[0] or "").encode())[:DICT_IDS] + end_id.to_bytes(4, "little") for r in rows]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def _compressor(d: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d) if d else None)


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` to ``path`` in the format above, in ascending order of id (null last, then by hash of the text)."""
    spark, d = docs.sparkSession, narrow(docs, id_col, text_col)
    shared = train_dictionary(d, tokenizer, end_id)
    crc = zlib.crc32(shared)
    size = F.coalesce(F.octet_length(TEXT).cast("long"), F.lit(0))
    total, without = d.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(F.when(F.col(ID).isNull(), size)), F.lit(0))).first()
    parts, nulls = cyclic_parts(spark, total - without, SHARD_BYTES), without // SHARD_BYTES + 1
    # Bounds of the shards from the ids alone: the encoding isn't run for a range sample. Rows without an id follow by the
    # hash of their text.
    bounds = sorted(set(d.select(F.col(ID).cast("double").alias(ID)).na.drop().approxQuantile(ID, [i / parts for i in range(1, parts)], 1 / (4 * parts)))) if parts > 1 else []
    after = len(bounds) + 1

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, comp, end = once(WordEncoder, tokenizer), _compressor(shared), end_id.to_bytes(4, "little")
        for b in slices(batches):
            ids, frames, n = b.column(0).to_pylist(), [], []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                raw = encoder.encode(t or b"") + end
                n.append(len(raw) // 4)
                frames.append(comp.compress(raw))
            keys = b.column(2).to_pylist()
            shard = [after + ((k + (1 << 63)) * nulls >> 64) if i is None else bisect_left(bounds, i) for i, k in zip(ids, keys)]
            cols = [pa.array(shard, pa.int64()), b.column(0).cast(pa.int64()), b.column(2), pa.array(n, pa.int64()), pa.array(frames, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["shard", ID, KEY, "n", "frame"])
        encoder = None
        rest()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # the encoder
        shard, block, ids, frames, ends, size = None, 0, [], [], [], 0

        def flush():
            index = np.array(ends, "<u8").tobytes()
            row = {"shard": shard, "block": block, "doc_ids": ids, "n_ids": sum(n for _, n in ends), "index": index, "payload": b"".join(frames), "dict_crc": crc}
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row.values(), kinds)], names=list(row))

        for b in slices(batches):
            for s, i, n, frame in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                if ids and (s != shard or size >= BLOCK_BYTES):
                    yield flush()
                    block, ids, frames, ends, size = block + 1, [], [], [], 0
                shard, size = s, size + len(frame)
                ids.append(i)
                frames.append(frame)
                ends.append((size, n))
        if ids:
            yield flush()

    coded = d.withColumn(KEY, row_key(F.col(ID), F.col(TEXT))).mapInArrow(encode, f"shard long, {ID} long, {KEY} long, n long, frame binary")
    dealt = coded.repartitionById(after + nulls, F.col("shard").cast("int")).sortWithinPartitions("shard", F.asc_nulls_last(ID), KEY)
    packed = dealt.mapInArrow(pack, "shard long, block long, doc_ids array<long>, n_ids long, index binary, payload binary, dict_crc long")
    with settings(spark, {BATCH: str(BATCH_BYTES)}):
        packed.write.mode("overwrite").parquet(f"{path}/blocks")
    # Literals: rows from the driver would start a second set of Python processes on the executors.
    one = spark.range(0, 1, 1, 1).select(F.lit(bytearray(shared)).alias("dict"), F.lit(crc).cast("long").alias("dict_crc"))
    one.write.mode("overwrite").parquet(f"{path}/dictionary")


def read_tokens(spark, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document, decoded from the files at ``path``."""
    shared, crc = spark.read.parquet(f"{path}/dictionary").first()
    shared = bytes(shared or b"")
    if zlib.crc32(shared) != crc:
        raise ValueError("the dictionary is not the one that was written")
    blocks = spark.read.parquet(f"{path}/blocks")
    sums = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # One row a shard, of SHARD_BYTES of text or more.
    shards = sums.select("shard", (F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")).alias("shard_start"))
    inner = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, W.currentRow)
    held = blocks.select("shard", "block", (F.sum("n_ids").over(inner) - F.col("n_ids")).alias("in_shard"))
    starts = held.join(shards, "shard").select("shard", "block", (F.col("shard_start") + F.col("in_shard")).alias("start"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(shared) if shared else None)
        for b in slices(batches, 1):
            for ids, index, payload, got, start in zip(*(b.column(i).to_pylist() for i in range(5))):
                if got != crc:
                    raise ValueError("a block was written with another dictionary")
                ends, out, at = np.frombuffer(index, "<u8").reshape(-1, 2).tolist(), [], 0
                for e, n in ends:
                    raw = dec.decompress(payload[at:e])
                    if len(raw) != 4 * n:
                        raise ValueError("a frame doesn't hold what the index says")
                    out.append((start, n, zlib.crc32(raw)))
                    start, at = start + n, e
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in cols)], names=[id_col, "start", "n_tokens", "ids_crc32"])

    placed = blocks.join(starts, ["shard", "block"]).select("doc_ids", "index", "payload", "dict_crc", "start")
    return placed.mapInArrow(decode, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Write the token files of ``docs`` and return what reading them back gives: (id, start, n_tokens, ids_crc32).

    Null texts are empty documents that hold only the end id; null ids come last with null as id; rows with one id
    follow each other by a hash of their text, repeated rows are kept; an empty table gives no rows; other columns
    are ignored. The id is an integer. Rows of one id are in one shard, which is sorted on disk and packed a block at a time.
    """
    spark = docs.sparkSession
    checkpoint_root(spark)
    path = path or shared_table(spark, "tokens")
    write_tokens(docs, tokenizer, path, end_id, id_col, text_col)
    return read_tokens(spark, path, id_col)
