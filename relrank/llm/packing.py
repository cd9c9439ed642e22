"""Packing of tokenised documents into sequences by length patterns.

Documents become token ids and an end id. Longer ones than a sequence are cut into full pieces, the rest of them comes
first. What remains is a histogram of lengths, at most one number per length up to the capacity, and only that goes to
the driver: patterns of two to four lengths that fill a sequence are enumerated, repeat counts are fitted to the
histogram by non-negative least squares and rounded down, and lengths left over are packed largest first, each time
with the best-fitting others and as often as the counts allow. A pattern's repeats take consecutive sequence numbers, so
the n-th piece of a length finds its place by arithmetic.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from relrank.llm import words as W
from relrank.llm.tokens import worker_encoder
from relrank.session import materialize

CAPACITY = 2048
END_ID = 0
VOCABULARY = "byte_bpe_50k.json"
FIT_ROUNDS = 400
SMALLEST_PART = 16  # shortest length that the enumerated patterns of three and four use
STEP = 37  # lengths tried for the third and fourth place of a pattern are this far apart
LANE_PIECES = 200_000  # pieces per task that numbers the pieces of one length


@dataclass
class Segment:
    """Where the pieces of a length go, from number `first` on: `times` to each of `repeats` sequences from `sequence`
    on, one after the other from `offset`."""

    length: int
    first: int
    repeats: int
    times: int
    sequence: int
    offset: int


def _piece_rows(vocabulary: str, capacity: int, carried: list[str]):
    """One row per piece of each document, with the checksum and the ids of the piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary)
        for batch in batches:
            for part in W.slices(batch.column("text")):
                ids, starts = encoder.encode(part)
                out = {k: [] for k in ("row", "piece", "start", "length", "crc")}
                held = []
                for i in range(part.rows):
                    data = np.append(ids[starts[i] : starts[i + 1]], np.uint32(END_ID)).astype("<u4")
                    n = len(data)
                    rest = n % capacity or capacity
                    for piece, end in enumerate(range(rest, n + 1, capacity)):
                        start = end - (rest if piece == 0 else capacity)
                        blob = data[start:end].tobytes()
                        out["row"].append(part.first + i)
                        out["piece"].append(piece)
                        out["start"].append(start)
                        out["length"].append(end - start)
                        out["crc"].append(zlib.crc32(blob))
                        held.append(blob)
                columns = [batch.column(c).take(pa.array(out["row"], pa.int64())) for c in carried if c != "ids"]
                columns += [pa.array(out["piece"], pa.int32())] + [pa.array(out[k], pa.int64()) for k in ("start", "length", "crc")]
                if "ids" in carried:
                    columns.append(pa.array(held, pa.binary()))
                names = [c for c in carried if c != "ids"] + ["piece", "start", "length", "ids_crc32"] + ["ids"] * ("ids" in carried)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the pieces of every row of `docs`; a null text is empty."""
    texts = docs.select("doc_id", "text")
    fields = [texts.schema["doc_id"], T.StructField("piece", T.IntegerType())]
    fields += [T.StructField(k, T.LongType()) for k in ("start", "length", "ids_crc32")]
    fields += [T.StructField("ids", T.BinaryType())] * with_ids
    carried = ["doc_id", "ids"] if with_ids else ["doc_id"]
    return texts.mapInArrow(_piece_rows(vocabulary, capacity, carried), T.StructType(fields))


# On the histogram ----------------------------------------------------------------------------------------------------


def enumerate_patterns(counts: np.ndarray) -> np.ndarray:
    """Rows of up to four lengths, padded with 0, that fill a sequence or come as close as present lengths allow.

    counts[length] says how often a length occurs.
    """
    capacity = len(counts) - 1
    present = np.flatnonzero(counts)
    present = present[(present > 0) & (present < capacity)]
    if not len(present):
        return np.zeros((0, 4), np.int64)

    def closest(space: np.ndarray) -> np.ndarray:
        """The largest present length within each space, 0 where there is none."""
        at = np.searchsorted(present, space, "right") - 1
        return np.where(at >= 0, present[np.maximum(at, 0)], 0)

    found = [np.stack([present, closest(capacity - present)], 1)]
    parts = np.unique(closest(np.arange(SMALLEST_PART, capacity, STEP)))
    parts = parts[parts > 0]
    if len(parts):
        first, second = (x.ravel() for x in np.meshgrid(present, parts, indexing="ij"))
        fits = (first + second < capacity) & (first >= second)
        first, second = first[fits], second[fits]
        found.append(np.stack([first, second, closest(capacity - first - second)], 1))
        few = parts[:: max(1, len(parts) // 12)]
        first, second, third = (x.ravel() for x in np.meshgrid(present, few, few, indexing="ij"))
        fits = (first + second + third < capacity) & (first >= second) & (second >= third)
        first, second, third = first[fits], second[fits], third[fits]
        found.append(np.stack([first, second, third, closest(capacity - first - second - third)], 1))
    rows = np.concatenate([np.pad(x, ((0, 0), (0, 4 - x.shape[1]))) for x in found])
    rows = np.unique(np.sort(rows, 1)[:, ::-1], axis=0)
    # Nothing but patterns that leave next to no space.
    return rows[rows.sum(1) >= capacity - capacity // 256]


def fit_repeats(patterns: np.ndarray, counts: np.ndarray, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Non-negative least squares of the repeats against the histogram, by multiplicative updates."""
    flat = patterns.ravel()
    column = np.repeat(np.arange(len(patterns)), patterns.shape[1])
    column, flat = column[flat > 0], flat[flat > 0]
    wanted = np.bincount(column, counts[flat].astype(float), len(patterns))
    x = np.full(len(patterns), counts.sum() / max(1, len(patterns)))
    for _ in range(rounds):
        made = np.bincount(flat, x[column], len(counts))
        x = x * wanted / np.maximum(np.bincount(column, made[flat], len(patterns)), 1e-12)
    return x


def plan(counts: np.ndarray) -> list[Segment]:
    """Segments that place every piece: counts[length] pieces of each length from 1 to the capacity."""
    left = counts.astype(np.int64).copy()
    capacity = len(counts) - 1
    used = np.zeros(len(counts), np.int64)
    segments: list[Segment] = []
    sequence = 0

    def place(pattern: list[tuple[int, int]], repeats: int) -> None:
        """Repeats of a pattern of (length, times)."""
        nonlocal sequence
        offset = 0
        for length, times in pattern:
            segments.append(Segment(length, int(used[length]), repeats, times, sequence, offset))
            used[length] += repeats * times
            offset += length * times
            left[length] -= times * repeats
        sequence += repeats

    if left[capacity]:
        place([(capacity, 1)], int(left[capacity]))
    patterns = enumerate_patterns(left)
    if len(patterns):
        fitted = np.floor(fit_repeats(patterns, left)).astype(np.int64)
        for i in np.argsort(-fitted, kind="stable"):
            if fitted[i] < 1:
                break
            lengths, times = np.unique(patterns[i][patterns[i] > 0], return_counts=True)
            repeats = int(min(fitted[i], (left[lengths] // times).min()))
            if repeats > 0:
                place(list(zip(lengths[::-1].tolist(), times[::-1].tolist(), strict=True)), repeats)
    # The rest, largest first. Each round uses up a length or comes down to single sequences.
    while left.any():
        largest = int(np.flatnonzero(left)[-1])
        pattern, space = [(largest, 1)], capacity - largest
        rest = left.copy()
        rest[largest] -= 1
        while space > 0:
            fitting = np.flatnonzero(rest[: space + 1])
            if not len(fitting):
                break
            best = int(fitting[-1])
            times = int(min(rest[best], space // best))
            rest[best] -= times
            space -= times * best
            if best == pattern[-1][0]:
                pattern[-1] = (best, pattern[-1][1] + times)
            else:
                pattern.append((best, times))
        repeats = min(int(left[length]) // times for length, times in pattern)
        place(pattern, repeats)
    return segments


# In Spark ------------------------------------------------------------------------------------------------------------


def _numbered(found: DataFrame, key: str, order: list) -> DataFrame:
    """`found` with a column number from 0 within each key, without bringing a key's rows into one task."""
    lanes = max(1, found.count() // LANE_PIECES)
    laned = found.withColumn("lane", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(lanes)))
    sizes = laned.groupBy(key, "lane").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(key).orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy(key, "lane").orderBy(*order)) - 1
    numbered = laned.withColumn("within", within).join(base, [key, "lane"])
    return numbered.withColumn("number", F.col("within") + F.col("base")).drop("lane", "within", "base")


def pack(
    docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, with_ids: bool = False
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) for every piece of every row.

    Rows with null or empty text are one piece of the end id. Rows that repeat, or have a null doc_id, are packed each
    for itself. An empty table gives no rows.
    """
    found = materialize(pieces(docs, capacity, vocabulary, with_ids), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in found.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most `capacity` rows
        counts[row["length"]] = row["n"]
    numbered = _numbered(found, "length", ["doc_id", "piece", "ids_crc32"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    fields = [numbered.schema[n] for n in names] + [T.StructField(n, T.LongType()) for n in ("sequence_id", "offset")]
    return numbered.select(*names, "number").mapInArrow(_placed(plan(counts), names), T.StructType(fields))


def _placed(segments: list[Segment], names: list[str]):
    """Looks pieces up in the plan, which has some ten thousand segments at most, as the patterns do."""
    rows = sorted((s.length, s.first, s.repeats, s.times, s.sequence, s.offset) for s in segments)
    length, first, _, times, sequence, offset = np.array(rows, np.int64).reshape(-1, 6).T
    starts = (length << 44) + first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            at = np.searchsorted(starts, (own << 44) + number, "right") - 1
            place = number - first[at]
            columns = [batch.column(n) for n in names]
            columns.append(pa.array(sequence[at] + place // times[at]))
            columns.append(pa.array(offset[at] + place % times[at] * own))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    return run


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token ids of each sequence as little-endian unsigned 32-bit numbers."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        number = table.column("sequence_id").to_numpy()
        starts, ends = W.runs_of(number)
        blobs = table.column("ids").to_pylist()
        held = [b"".join(blobs[a:b]) for a, b in zip(starts, ends, strict=True)]
        return pa.table({"sequence_id": number[starts], "ids": pa.array(held, pa.binary())})

    groups = packed.select("sequence_id", "offset", "ids", F.expr("sequence_id div 256").alias("g"))
    return groups.groupBy("g").applyInArrow(run, "sequence_id long, ids binary")
