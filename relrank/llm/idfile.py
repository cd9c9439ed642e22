"""Token-id files: frequency-ranked ids in a byte-aligned code with separate control bytes.

A file row is a block of neighbouring documents. Its ids are ranked by how often they occur in the block, ranks below
256 take one byte, below 65,536 two, and so on; the byte counts of four values share one control byte, which stands
apart from the data bytes. A block carries the ids in rank order, so that it can be read by itself. numpy decodes it by
table: each control byte gives the four sizes at once. Blocks are the rows of a Parquet table (part, block, doc_ids,
n_tokens, total, ids_by_rank, control, data; numbers little-endian), parts ascend with doc_id, and rows with a null
doc_id come first.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from relrank.llm import words as W
from relrank.llm.tokens import worker_encoder

END_ID = 0
VOCABULARY = "byte_bpe_50k.json"
PART_BYTES = 8 << 20  # text bytes per part, on average
BLOCK_TOKENS = 1 << 20
FIELDS = "part long, block long, doc_ids binary, n_tokens binary, total long, ids_by_rank binary, control binary, data binary"

# Sizes of the four values that a control byte stands for.
SIZES = np.stack([(np.arange(256) >> shift & 3) + 1 for shift in (0, 2, 4, 6)], 1).astype(np.int64)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    size = 1 + (ranks > 0xFF).astype(np.int64) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.concatenate([size - 1, np.zeros(-len(size) % 4, np.int64)]).reshape(-1, 4)
    control = (padded << np.array([0, 2, 4, 6])).sum(1).astype(np.uint8)
    at = np.cumsum(size) - size
    data = np.zeros(int(size.sum()), np.uint8)
    for i in range(4):
        more = size > i
        data[at[more] + i] = (ranks[more] >> np.uint32(8 * i)) & np.uint32(0xFF)
    return control.tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = SIZES[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(size) - size
    held = np.frombuffer(data, np.uint8)
    out = held[at].astype(np.uint32)
    for i in range(1, 4):
        more = np.flatnonzero(size > i)
        if len(more):
            out[more] |= held[at[more] + i].astype(np.uint32) << np.uint32(8 * i)
    return out


def encode_block(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """ids_by_rank, control and data of a block's ids."""
    counts = np.bincount(ids)
    by_rank = np.argsort(-counts, kind="stable")[: int((counts > 0).sum())]
    rank = np.zeros(len(counts), np.uint32)
    rank[by_rank] = np.arange(len(by_rank))
    return by_rank.astype("<u4").tobytes(), *encode_ranks(rank[ids])


def decode_block(by_rank: bytes, control: bytes, data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(by_rank, "<u4")[decode_ranks(control, data, n)]


def _encoded_rows(vocabulary: str, bounds: list[int]):
    """Documents as ids with the end id, under the part that their doc_id falls into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary)
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for part in W.slices(batch.column("text")):
                ids, starts = encoder.encode(part)
                kind = "<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4"
                held = [np.append(ids[a:b], np.uint32(END_ID)).astype(kind).tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
                own = doc_ids[part.first : part.first + part.rows]
                yield pa.record_batch({
                    "part": pa.array([-1 if x is None else bisect_right(bounds, x) for x in own], pa.int64()),
                    "doc_id": pa.array(own, pa.int64()), "wide": pa.array([kind == "<u4"] * part.rows),
                    "ids": pa.array(held, pa.binary()),
                })

    return run


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the rows of each part, which come in order of part and doc_id."""
    part, block, doc_ids, held, size = None, 0, [], [], 0

    def finished() -> pa.RecordBatch:
        ids = np.concatenate(held)
        by_rank, control, data = encode_block(ids)
        known = np.array([-(1 << 63) if x is None else x for x in doc_ids], "<i8")
        row = [part, block, known.tobytes(), np.array([len(x) for x in held], "<i8").tobytes(), len(ids), by_rank, control, data]
        names = [x.split()[0] for x in FIELDS.split(", ")]
        return pa.record_batch([pa.array([x], pa.binary() if isinstance(x, bytes) else pa.int64()) for x in row], names=names)

    for batch in batches:
        for own, doc_id, wide, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "wide", "ids")), strict=True):
            if held and (own != part or size >= BLOCK_TOKENS):
                yield finished()
                block = block + 1 if own == part else 0
                doc_ids, held, size = [], [], 0
            part = own
            doc_ids.append(doc_id)
            held.append(np.frombuffer(ids, "<u4" if wide else "<u2").astype(np.uint32))
            size += len(held[-1])
    if held:
        yield finished()


def write_ids(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, part_bytes: int = PART_BYTES) -> None:
    """Writes the ids of every row's text, each with the end id, in ascending doc_id order. A null text is empty.

    Rows that share a doc_id stand side by side. The table is written even if `docs` is empty.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    cuts = [i / parts for i in range(1, parts)]
    bounds = sorted({int(x) for x in texts.approxQuantile("doc_id", cuts, 0.1 / parts)}) if cuts else []
    encoded = texts.mapInArrow(_encoded_rows(vocabulary, bounds), "part long, doc_id long, wide boolean, ids binary")
    ordered = encoded.repartition(parts, "part").sortWithinPartitions("part", "doc_id")
    ordered.mapInArrow(_block_rows, FIELDS).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(part, block, number, doc_id, n_tokens, local_start, ids, ids_crc32) of every document in a token-id table.

    ids: unsigned 32-bit little-endian; local_start: ids of the documents before it in its block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                values = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                doc_ids = np.frombuffer(values["doc_ids"], "<i8")
                sizes = np.frombuffer(values["n_tokens"], "<i8")
                ids = decode_block(values["ids_by_rank"], values["control"], values["data"], values["total"])
                ends = np.cumsum(sizes)
                held = [ids[a:b].astype("<u4").tobytes() for a, b in zip(ends - sizes, ends, strict=True)]
                n = len(doc_ids)
                yield pa.record_batch({
                    "part": np.full(n, values["part"]), "block": np.full(n, values["block"]), "number": np.arange(n),
                    "doc_id": pa.array(doc_ids, mask=doc_ids == -(1 << 63)), "n_tokens": sizes, "local_start": ends - sizes,
                    "ids": pa.array(held, pa.binary()), "ids_crc32": pa.array([zlib.crc32(x) for x in held], pa.int64()),
                })

    table = spark.read.schema(FIELDS).parquet(path)
    return table.mapInArrow(
        run,
        "part long, block long, number long, doc_id long, n_tokens long, local_start long, ids binary, ids_crc32 long",
    )


def block_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, block, block_start): ids before each block. Parts are few: only their totals are summed in one task."""
    sizes = spark.read.schema(FIELDS).parquet(path).select("part", "block", "total")
    per_part = sizes.groupBy("part").agg(F.sum("total").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_part = per_part.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = sizes.withColumn("inside", F.coalesce(F.sum("total").over(within), F.lit(0)))
    return inside.join(per_part, "part").select("part", "block", (F.col("part_start") + F.col("inside")).alias("block_start"))


def document_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files."""
    docs = read_ids(spark, path).select("part", "block", "doc_id", "n_tokens", "local_start", "ids_crc32")
    placed = docs.join(block_starts(spark, path), ["part", "block"])
    return placed.select("doc_id", (F.col("block_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
