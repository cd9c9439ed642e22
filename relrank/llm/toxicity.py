"""Toxicity of texts: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A feature is the presence of a character n-gram (A-Z lower-cased), hashed into BUCKETS. Its value is the log ratio of
the shares that it has among the n-gram occurrences of toxic and of other texts; a logistic regression with an L2
penalty weights these values. The model is fitted on a bounded sample of labelled rows (MAX_TRAIN, drawn by hash);
every whole text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relrank.llm import words as W
from relrank.session import materialize

SIZES = (3, 4, 5, 6)
BITS = 20
BUCKETS = 1 << BITS
BLOCK = 1 << 14  # buckets per row of counts
MAX_TRAIN = 20_000  # labelled rows that the model is fitted on
MAX_FEATURES = 1 << 11  # n-grams with a weight, those that tell the classes apart best
MIN_DOCS = 8
PENALTY, ROUNDS, POWER_ROUNDS = 1e-4, 300, 20
THRESHOLD = 0.3
SLICE_BYTES = 1 << 18  # every character makes an n-gram of each size


def grams(part: W.Slice) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size the rows and buckets of all n-grams in the slice, repeated ones too."""
    data = W.LOWER[part.data]
    codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum(~W.IS_CONTINUATION[data])])
    row = np.repeat(np.arange(part.rows), np.diff(heads[part.offsets]))
    n = len(codes)
    state = codes * np.uint32(0x9E3779B1)
    for size in range(2, max(SIZES) + 1):
        if n < size:
            return
        state = (state[: n - size + 1] ^ (state[: n - size + 1] >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        state += codes[size - 1 :] * np.uint32(0xC2B2AE35)
        if size in SIZES:
            inside = row[size - 1 :] == row[: n - size + 1]
            spread = (state ^ (state >> np.uint32(16))) * np.uint32(0x27D4EB2F)
            yield row[: n - size + 1][inside], (spread >> np.uint32(32 - BITS))[inside]


def present(part: W.Slice, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each row's buckets once, as rows and buckets in ascending order; only `chosen` ones if a mask is given."""
    found = []
    for row, bucket in grams(part):
        if chosen is not None:
            keep = chosen[bucket]
            row, bucket = row[keep], bucket[keep]
        found.append((row << BITS) | bucket)
    keys = W.sorted_unique(np.concatenate([*found, np.zeros(0, np.int64)]))
    return keys >> BITS, keys & (BUCKETS - 1)


@dataclass
class Model:
    """Weights of some buckets; a text's log odds are the bias and the weights of the buckets present."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def log_odds(self, column: pa.Array) -> np.ndarray:
        chosen = np.zeros(BUCKETS, bool)
        chosen[self.buckets] = True
        weight = np.zeros(BUCKETS)
        weight[self.buckets] = self.weights
        out = np.full(len(column), self.bias)
        for part in W.slices(column, SLICE_BYTES):
            row, bucket = present(part, chosen)
            out[part.first : part.first + part.rows] += np.bincount(row, weight[bucket], part.rows)
        return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of each class hold a bucket: one row per block of buckets that occurs."""
    total = np.zeros((2, BUCKETS), np.int32)
    for batch in batches:
        toxic = batch.column("toxic").to_numpy().astype(bool)
        for part in W.slices(batch.column("text"), SLICE_BYTES):
            row, bucket = present(part)
            is_toxic = toxic[part.first + row]
            total[1] += np.bincount(bucket[is_toxic], minlength=BUCKETS).astype(np.int32)
            total[0] += np.bincount(bucket[~is_toxic], minlength=BUCKETS).astype(np.int32)
    used = [b for b in range(0, BUCKETS, BLOCK) if total[:, b : b + BLOCK].any()]
    columns = {
        "block": pa.array(used, pa.int64()),
        "other": pa.array([total[0, b : b + BLOCK].tobytes() for b in used], pa.binary()),
        "toxic": pa.array([total[1, b : b + BLOCK].tobytes() for b in used], pa.binary()),
    }
    yield pa.record_batch(columns)


def _sum_block(table: pa.Table) -> pa.Table:
    other, toxic = (
        sum(np.frombuffer(x.as_buffer(), np.int32).astype(np.int64) for x in table.column(k)) for k in ("other", "toxic")
    )
    kept = np.flatnonzero(other + toxic)
    return pa.table({"bucket": kept + table.column("block")[0].as_py(), "other": other[kept], "toxic": toxic[kept]})


def _project(buckets: np.ndarray):
    """The chosen buckets present in each training text, by their place among the chosen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = np.zeros(BUCKETS, bool)
        chosen[buckets] = True
        for batch in batches:
            for part in W.slices(batch.column("text"), SLICE_BYTES):
                row, bucket = present(part, chosen)
                place = np.searchsorted(buckets, bucket).astype(np.int32)
                cuts = np.searchsorted(row, np.arange(part.rows + 1))
                held = [place[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                toxic = batch.column("toxic").slice(part.first, part.rows)
                ids = batch.column("doc_id").slice(part.first, part.rows)
                yield pa.record_batch({"doc_id": ids, "toxic": toxic, "held": pa.array(held, pa.binary())})

    return run


def _fit(ratios: np.ndarray):
    """Logistic regression on the bounded sample by accelerated gradient steps (Nesterov).

    The step is one over the slope's greatest rate of change, which a power iteration finds, so weights grow with what
    a feature tells and rare features stay small.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        y = table.column("toxic").to_numpy().astype(float)
        held = [np.frombuffer(x.as_buffer(), np.int32) for x in table.column("held")]
        column = np.concatenate([*held, np.zeros(0, np.int32)])
        row = np.repeat(np.arange(len(held)), [len(x) for x in held])
        value = ratios[column]
        size = len(ratios)

        def forward(w: np.ndarray) -> np.ndarray:
            return np.bincount(row, value * w[column], len(y)) + w[-1]

        def backward(z: np.ndarray) -> np.ndarray:
            return np.append(np.bincount(column, value * z[row], size), z.sum()) / len(y)

        top, direction = 1.0, np.ones(size + 1)
        for _ in range(POWER_ROUNDS):
            direction = backward(forward(direction / np.sqrt(direction @ direction)))
            top = np.sqrt(direction @ direction)
        step = 1 / (1.1 * top / 4 + PENALTY)
        w = np.zeros(size + 1)
        w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        before = w
        for number in range(ROUNDS):
            ahead = w + number / (number + 3) * (w - before)
            slope = backward(1 / (1 + np.exp(-np.clip(forward(ahead), -30, 30))) - y)
            slope[:-1] += PENALTY * ahead[:-1]
            before, w = w, ahead - step * slope
        return pa.table({"place": np.arange(size + 1), "weight": w * np.append(ratios, 1)})

    return run


def held_out(doc_id: str = "doc_id"):
    """Whether a row never teaches the model."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """A model from the labelled texts outside the held-out part; of several labels of an id the highest counts.

    Without labels of both classes the model is a constant: the smoothed share of toxic labels, or log odds -10 where
    there are no labels at all.
    """
    labelled = labels.where("doc_id is not null and toxic is not null").where(~held_out())
    known = labelled.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        (F.max("toxic") > 0).cast("int").alias("toxic")
    )
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    train = materialize(texts.join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]), "toxicity_train")
    of_class = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n, n_toxic = sum(of_class.values()), of_class.get(1, 0)
    none = np.zeros(0, np.int64)
    if not n:
        return Model(none, np.zeros(0), -10.0)
    if not 0 < n_toxic < n:
        return Model(none, np.zeros(0), float(np.log((n_toxic + 0.5) / (n - n_toxic + 0.5))))
    counts = train.select("toxic", "text").mapInArrow(_counts, "block long, other binary, toxic binary")
    counts = materialize(
        counts.groupBy("block").applyInArrow(_sum_block, "bucket long, other long, toxic long"), "gram_counts"
    )
    all_other, all_toxic = counts.agg(F.sum("other"), F.sum("toxic")).first()
    ratio = F.log((F.col("toxic") + 1) / (all_toxic + BUCKETS)) - F.log((F.col("other") + 1) / (all_other + BUCKETS))
    off = F.col("toxic") / n_toxic - F.col("other") / (n - n_toxic)
    held = (F.col("toxic") + F.col("other")) / n
    apart = off * off / (held * (1 - held) + 1e-9)
    best = counts.where(F.col("toxic") + F.col("other") >= min(MIN_DOCS, n_toxic)).select(
        "bucket", ratio.alias("ratio"), F.round(apart, 12).alias("apart")
    )
    rows = best.orderBy(F.desc("apart"), "bucket").limit(MAX_FEATURES).collect()
    chosen = np.array(sorted((r["bucket"], r["ratio"]) for r in rows)).reshape(-1, 2)
    buckets, ratios = chosen[:, 0].astype(np.int64), chosen[:, 1]
    projected = train.mapInArrow(_project(buckets), "doc_id long, toxic int, held binary")
    # At most max_train rows of MAX_FEATURES places: the model is fitted in one task.
    fitted = projected.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_fit(ratios), "place long, weight double")
    weights = np.array([r["weight"] for r in fitted.orderBy("place").collect()])
    return Model(buckets, weights[:-1], float(weights[-1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with a column toxicity from 0 to 1; a null text scores as an empty one. Other columns are kept."""
    names = [n for n in docs.columns if n != "toxicity"]
    kept = docs.select(*[F.col(f"`{n}`") for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = model.log_odds(batch.column(batch.schema.get_field_index("text")))
            values = pa.array(1 / (1 + np.exp(-np.clip(odds, -500, 500))))
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*names, "toxicity"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("toxicity", T.DoubleType())]))
