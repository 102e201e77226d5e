"""Token ids as files of compressed planes.

A shard holds whole documents in order. Its ids are cut into blocks of a fixed number of ids (the last may be shorter);
each block is transposed into planes, one for each bit or each byte of an id, and each plane is compressed with
zstandard by itself; a plane of zeros takes no bytes. The shard begins with its chunk index, so that a reader can
decode any block alone.

    magic "CGP1" | plane kind u1 (1 bit, 8 byte) | block length u4 | ids u8 | blocks u4
    for each block: ids u4, stored bytes of each plane u4 x planes
    the planes' bytes, in the same order

Shards are stored as cells of a Parquet table (part, shard, first_in_part, n_ids, doc_id[], n_tokens[], content): any
store that Spark reaches can hold them and Spark's commit protocol keeps half-written ones of lost executors out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegrain.llm.common import small_batches
from codegrain.llm.tokens import encoder
from codegrain.sources.shared import scratch

MAGIC = b"CGP1"
BIT, BYTE = 1, 8
_HEAD = struct.Struct("<4sBIQI")

SHARDS = "part int, shard int, first_in_part long, n_ids long, doc_id array<bigint>, n_tokens array<bigint>, content binary"


def to_planes(ids: np.ndarray, kind: int) -> np.ndarray:
    """A row for each plane, lowest first."""
    octets = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if kind == BYTE:
        return np.ascontiguousarray(octets.T)
    return np.packbits(np.unpackbits(octets, axis=1, bitorder="little").T, axis=1, bitorder="little")


def from_planes(planes: np.ndarray, n: int, kind: int) -> np.ndarray:
    if kind == BYTE:
        return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)
    bits = np.unpackbits(planes, axis=1, count=n, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").reshape(-1).view("<u4")


def encode_shard(ids: np.ndarray, block: int = 65_536, kind: int = BYTE, level: int = 3) -> bytes:
    press = zstandard.ZstdCompressor(level=level).compress
    n_planes = 32 // kind
    index, data = [], []
    for at in range(0, len(ids), block):
        part = ids[at : at + block]
        stored = [press(p.tobytes()) if p.any() else b"" for p in to_planes(part, kind)]
        index.append(struct.pack(f"<{1 + n_planes}I", len(part), *map(len, stored)))
        data += stored
    return b"".join([_HEAD.pack(MAGIC, kind, block, len(ids), len(index)), *index, *data])


def decode_shard(content: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of blocks first to last (all by default), found by the chunk index."""
    magic, kind, _, n_ids, n_blocks = _HEAD.unpack_from(content)
    if magic != MAGIC:
        raise ValueError("not a shard of token planes")
    n_planes = 32 // kind
    index = np.frombuffer(content, "<u4", n_blocks * (1 + n_planes), _HEAD.size).reshape(n_blocks, 1 + n_planes)
    ends = _HEAD.size + index.nbytes + np.cumsum(index[:, 1:].reshape(-1), dtype=np.int64).reshape(n_blocks, n_planes)
    open_ = zstandard.ZstdDecompressor().decompress
    out = []
    for b in range(first, n_blocks if last is None else min(last, n_blocks)):
        n = int(index[b, 0])
        width = (n * kind + 7) // 8
        planes = np.zeros((n_planes, width), np.uint8)
        for p in range(n_planes):
            if size := int(index[b, 1 + p]):
                planes[p] = np.frombuffer(open_(content[ends[b, p] - size : ends[b, p]], max_output_size=width), np.uint8)
        out.append(from_planes(planes, n, kind))
    ids = np.concatenate(out) if out else np.zeros(0, "<u4")
    if first == 0 and last is None and len(ids) != n_ids:
        raise ValueError("shard is cut short")
    return ids


def write_shards(docs: DataFrame, path: str, tokenizer: str, joined: bool = True, end_id: int = 0, shard_ids: int = 262_144, block: int = 65_536, kind: int = BYTE, level: int = 3, literal: bool = False) -> DataFrame:
    """Encodes documents (doc_id, text) in ascending doc_id order into shards under path; returns the stored table.

    A null text is empty and yields the end id alone; a null doc_id comes first; rows with the same doc_id stand side
    by side, in an order fixed by a hash of their texts; other columns are ignored; no rows, no shards. A shard ends with
    the document that reaches shard_ids, so one document is never cut. With literal, control strings of the vocabulary in
    a text are ordinary text; else they become their ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer, joined, literal), np.array([end_id], "<u4").tobytes()
        part, shard, first = TaskContext.get().partitionId(), 0, 0
        names, sizes, kept, total = [], [], [], 0

        def close() -> pa.RecordBatch:
            content = encode_shard(np.frombuffer(b"".join(kept), "<u4"), block, kind, level)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([first], pa.int64()), pa.array([total], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([content], pa.binary())],
                names=["part", "shard", "first_in_part", "n_ids", "doc_id", "n_tokens", "content"],
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                names.append(doc_id)
                sizes.append(len(ids) // 4)
                kept.append(ids)
                total += sizes[-1]
                if total >= shard_ids:
                    yield close()
                    shard, first = shard + 1, first + total
                    names, sizes, kept, total = [], [], [], 0
        if names:
            yield close()

    tie = F.xxhash64("text")
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    with small_batches(docs.sparkSession):
        ordered.mapInArrow(run, SHARDS).write.parquet(path)
    return docs.sparkSession.read.schema(SHARDS).parquet(path)


def read_documents(shards: DataFrame) -> DataFrame:
    """Per document, from the stored shards: doc_id, start (ids of all documents before it), n_tokens, ids (binary, u4)."""
    return _per_document(shards, "doc_id long, start long, n_tokens long, ids binary", lambda ids: ids.tobytes(), pa.binary())


def digest(shards: DataFrame) -> DataFrame:
    """Per document, from the stored shards: doc_id, start, n_tokens, ids_crc32 (unsigned, of the ids as u4)."""
    return _per_document(shards, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda ids: zlib.crc32(ids.tobytes()), pa.int64())


def _per_document(shards: DataFrame, schema: str, of, kind: pa.DataType) -> DataFrame:
    spark = shards.sparkSession
    # one number for each task that wrote, so their sums fit the driver
    totals = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    starts, at = [], 0
    for part, n in totals:
        starts.append((part, at))
        at += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, sizes = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                ids = decode_shard(batch.column(2)[i].as_py())
                ends = np.cumsum(sizes)
                begin = batch.column(3)[i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(begin + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array([of(ids[e - n : e]) for e, n in zip(ends, sizes, strict=True)], kind)],
                    names=names,
                )

    base = spark.createDataFrame(starts, "part int, base long")
    return shards.join(F.broadcast(base), "part").select("doc_id", "n_tokens", "content", (F.col("base") + F.col("first_in_part")).alias("begin")).mapInArrow(run, schema)


def token_output(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes the shards into the shared work folder and returns digest() of what is read back."""
    return digest(write_shards(docs, scratch(docs.sparkSession), tokenizer, **options))
