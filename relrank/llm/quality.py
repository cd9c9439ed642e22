"""Quality of documents: fixed rules first, then gradient-boosted trees over document statistics.

Trees split on binned statistics; the statistics named in FALLING may only lower the score as they grow. The fitted
trees are flattened into node arrays, and a batch of documents walks down all of them at once. They learn from a
bounded sample of labelled rows (MAX_TRAIN, drawn by hash); statistics and scores are of every whole text.
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
from relrank.llm.toxicity import held_out
from relrank.session import materialize

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share",
    "digit_share", "mark_share", "other_byte_share", "words_per_line", "longest_word", "one_char_share",
)
FALLING = ("symbol_share", "dup_line_share", "repeat_share")
MIN_WORDS = 50
MAX_TRAIN = 20_000
TREES, DEPTH, BINS, RATE, MIN_LEAF, PENALTY = 80, 4, 48, 0.15, 10, 1.0
KEEP_FROM = 0.5


def _of(codes: bytes) -> np.ndarray:
    return np.isin(W._BYTES, np.frombuffer(codes, np.uint8))


_SYMBOL = _of(b"#*$%&|<>")
_UPPER, _DIGIT = (W._BYTES >= 65) & (W._BYTES <= 90), (W._BYTES >= 48) & (W._BYTES <= 57)
_MARK = _of(b".,;:!?\"'()-")
_OTHER = W._BYTES >= 128


def statistics(part: W.Slice) -> tuple[np.ndarray, np.ndarray]:
    """The counts (COUNTS, one column each) and the features (FEATURES) of each text."""
    data, rows = part.data, part.rows
    found = W.words(part, lower=False)
    n_words = np.diff(found.row_starts)
    row_of_word = np.repeat(np.arange(rows), n_words)
    inside = ~W.IS_SPACE[data]

    def per_row(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[part.offsets])

    heads = inside & ~W.IS_CONTINUATION[data]
    word_chars = per_row(heads)
    # Lines that hold a word, by the hash of the whole line.
    ends = np.union1d(np.flatnonzero(data == 10), part.offsets[1:])
    starts = np.concatenate([[0], np.minimum(ends[:-1] + (data[np.minimum(ends[:-1], len(data) - 1)] == 10), len(data))]) if len(data) else np.zeros(0, np.int64)
    if len(data):
        # A line that starts at a text's end belongs to the next text.
        filled = np.concatenate([[0], np.cumsum(inside)])
        has_word = filled[ends] > filled[starts]
        starts, ends = starts[has_word], ends[has_word]
        line_hash = W.hash_ranges(data, starts, ends)
        row_of_line = np.searchsorted(part.offsets, starts, "right") - 1
    else:
        line_hash, row_of_line = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n_lines = np.bincount(row_of_line, minlength=rows)
    n_dup_lines = n_lines - _distinct(row_of_line, line_hash, rows)
    # Words in 3-word windows that occur twice or more.
    n = len(found.hashes)
    covered = np.zeros(n + 2, bool)
    if n >= 3:
        windows = W.mix(found.hashes[:-2] * W._LANES[0] + found.hashes[1:-1] * W._LANES[1] + found.hashes[2:] * W._LANES[2])
        at = np.flatnonzero(row_of_word[:-2] == row_of_word[2:])
        order = at[np.lexsort((windows[at], row_of_word[at]))]
        same = (windows[order][1:] == windows[order][:-1]) & (row_of_word[order][1:] == row_of_word[order][:-1])
        again = order[np.append(same, False) | np.append(False, same)] if len(order) else order
        for i in range(3):
            covered[again + i] = True
    n_repeat = np.bincount(row_of_word[covered[:n]], minlength=rows)
    n_symbols = per_row(_SYMBOL[data])
    counts = np.stack([n_words, word_chars, n_symbols, n_dup_lines, n_repeat], 1).astype(np.int64)

    chars = np.concatenate([[0], np.cumsum(heads)])
    word_size = (chars[found.ends] - chars[found.starts]).astype(float)
    longest = np.zeros(rows)
    np.maximum.at(longest, row_of_word, word_size)
    one = np.maximum(1, n_words)
    letters = np.maximum(1, word_chars)
    features = np.stack(
        [
            np.log1p(n_words), word_chars / one, n_symbols / letters, n_dup_lines / np.maximum(1, n_lines), n_repeat / one,
            _distinct(row_of_word, found.hashes, rows) / one, per_row(_UPPER[data]) / letters, per_row(_DIGIT[data]) / letters,
            per_row(_MARK[data]) / letters, per_row(_OTHER[data]) / letters, n_words / np.maximum(1, n_lines), longest,
            np.bincount(row_of_word[word_size == 1], minlength=rows) / one,
        ],
        1,
    )
    return counts, features


def _distinct(row: np.ndarray, hashes: np.ndarray, rows: int) -> np.ndarray:
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])) if len(row) else np.zeros(0, bool)
    return np.bincount(row[new], minlength=rows)


# Trees ---------------------------------------------------------------------------------------------------------------


@dataclass
class Trees:
    """Flattened trees: a node with feature -1 is a leaf and leads to itself; roots lists the trees' first nodes."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, features: np.ndarray) -> np.ndarray:
        """Probability of good quality for each row of features."""
        total = np.full(len(features), self.base)
        row = np.arange(len(features))
        for root in self.roots:
            node = np.full(len(features), root)
            for _ in range(self.depth):
                goes_left = features[row, np.maximum(self.feature[node], 0)] <= self.threshold[node]
                node = np.where(goes_left, self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def constant(share: float) -> Trees:
    none = np.zeros(0, np.int64)
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Trees(none, np.zeros(0), none, none, np.zeros(0), none, float(np.log(share / (1 - share))), 0)


def fit_trees(x: np.ndarray, y: np.ndarray, directions: np.ndarray) -> Trees:
    """Boosted trees for 0/1 labels. directions: -1 where a feature may only lower the score, 1 raise, 0 either.

    A split along such a feature needs leaf values in that order, and passes the middle of them on as a bound to both
    sides, so the whole model is monotonic in it.
    """
    if not len(y) or y.min() == y.max():
        return constant(float((y.sum() + 0.5) / (len(y) + 1)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots = []
    share = y.mean()
    base = float(np.log(share / (1 - share)))
    score = np.full(len(y), base)

    def leaf(value: float) -> int:
        at = len(nodes["value"])
        for k, v in (("feature", -1), ("threshold", 0.0), ("left", at), ("right", at), ("value", value * RATE)):
            nodes[k].append(v)
        return at

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        slope, bend = y - p, np.maximum(p * (1 - p), 1e-6)
        roots.append(leaf(0.0))
        open_nodes = [(roots[-1], np.arange(len(y)), -np.inf, np.inf, 0)]
        while open_nodes:
            node, rows, low, high, depth = open_nodes.pop()
            g, h = slope[rows].sum(), bend[rows].sum()
            value = float(np.clip(g / (h + PENALTY), low, high))
            nodes["value"][node] = value * RATE
            best = (1e-9, None)
            for j in range(x.shape[1]) if depth < DEPTH and len(rows) >= 2 * MIN_LEAF else ():
                size = len(edges[j]) + 1
                if size < 2:
                    continue
                own = binned[rows, j]
                gl = np.cumsum(np.bincount(own, slope[rows], size))[:-1]
                hl = np.cumsum(np.bincount(own, bend[rows], size))[:-1]
                nl = np.cumsum(np.bincount(own, minlength=size))[:-1]
                vl = np.clip(gl / (hl + PENALTY), low, high)
                vr = np.clip((g - gl) / (h - hl + PENALTY), low, high)
                gain = vl * gl - vl**2 * (hl + PENALTY) / 2 + vr * (g - gl) - vr**2 * (h - hl + PENALTY) / 2
                gain = gain - (value * g - value**2 * (h + PENALTY) / 2)
                allowed = (nl >= MIN_LEAF) & (len(rows) - nl >= MIN_LEAF) & (directions[j] * (vr - vl) >= 0)
                gain = np.where(allowed, gain, -1)
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (gain[at], (j, at, float(vl[at]), float(vr[at])))
            if best[1] is None:
                score[rows] += nodes["value"][node]
                continue
            j, at, vl, vr = best[1]
            goes_left = binned[rows, j] <= at
            middle = (vl + vr) / 2
            bounds = {-1: ((middle, high), (low, middle)), 1: ((low, middle), (middle, high))}.get(
                int(directions[j]), ((low, high), (low, high))
            )
            left, right = leaf(0.0), leaf(0.0)
            nodes["feature"][node], nodes["threshold"][node] = j, float(edges[j][at])
            nodes["left"][node], nodes["right"][node] = left, right
            open_nodes.append((left, rows[goes_left], *bounds[0], depth + 1))
            open_nodes.append((right, rows[~goes_left], *bounds[1], depth + 1))
    arrays = {k: np.array(v) for k, v in nodes.items()}
    return Trees(**arrays, roots=np.array(roots), base=base, depth=DEPTH)


# In Spark ------------------------------------------------------------------------------------------------------------


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.slices(batch.column("text")):
            _, features = statistics(part)
            ids = batch.column("doc_id").slice(part.first, part.rows)
            good = batch.column("good").slice(part.first, part.rows)
            blobs = pa.array([x.tobytes() for x in features], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, good, blobs], names=["doc_id", "good", "features"])


def _fit_task(table: pa.Table) -> pa.Table:
    table = table.sort_by("doc_id")
    x = np.array([np.frombuffer(b.as_buffer()) for b in table.column("features")]).reshape(-1, len(FEATURES))
    directions = np.array([-1 if f in FALLING else 0 for f in FEATURES])
    trees = fit_trees(x, table.column("good").to_numpy().astype(float), directions)
    names = ("feature", "threshold", "left", "right", "value", "roots")
    held = [np.asarray(getattr(trees, n), np.float64).tobytes() for n in names]
    held.append(np.array([trees.base, trees.depth]).tobytes())
    return pa.table({"name": [*names, "base"], "held": pa.array(held, pa.binary())})


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Trees:
    """Trees from the labelled texts outside the held-out part; of several labels of an id the highest counts.

    Without labels of both classes the score is a constant, and one that keeps where there are no labels at all.
    """
    labelled = labels.where("doc_id is not null and quality is not null").where(~held_out())
    known = labelled.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        (F.max("quality") > 0).cast("int").alias("good")
    )
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    train = texts.join(F.broadcast(sample), "doc_id").mapInArrow(_feature_rows, "doc_id long, good int, features binary")
    train = materialize(train.dropDuplicates(["doc_id"]), "quality_train")
    # At most max_train rows of a few numbers: the trees grow in one task.
    rows = train.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_fit_task, "name string, held binary").collect()
    if not rows:
        return constant(1.0)
    held = {r["name"]: np.frombuffer(r["held"]) for r in rows}
    whole = {n: held[n].astype(np.int64) for n in ("feature", "left", "right", "roots")}
    base, depth = held["base"]
    return Trees(**whole, threshold=held["threshold"], value=held["value"], base=float(base), depth=int(depth))


def judge(docs: DataFrame, trees: Trees) -> DataFrame:
    """`docs` with the counts, base_failed, quality (the trees' score) and kept; other columns stay.

    base_failed: fewer than MIN_WORDS words, or more than half of them in repeated 3-word windows. kept: not so, and a
    score of KEEP_FROM at least. Null and empty texts have no words and fail. Columns with these names are replaced.
    """
    added = [*COUNTS, "base_failed", "quality", "kept"]
    names = [n for n in docs.columns if n not in added]
    rows = docs.select(*[F.col(f"`{n}`") for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            found = [statistics(part) for part in W.slices(column)]
            counts = np.concatenate([np.zeros((0, len(COUNTS)), np.int64), *[c for c, _ in found]])
            score = trees.score(np.concatenate([np.zeros((0, len(FEATURES))), *[f for _, f in found]]))
            n_words, n_repeat = counts[:, 0], counts[:, 4]
            failed = (n_words < MIN_WORDS) | (100 * n_repeat > 50 * n_words)
            new = [counts[:, i] for i in range(len(COUNTS))] + [failed, score, ~failed & (score >= KEEP_FROM)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, new)], names=[*names, *added])

    kinds = [T.LongType()] * len(COUNTS) + [T.BooleanType(), T.DoubleType(), T.BooleanType()]
    fields = [T.StructField(n, k) for n, k in zip(added, kinds, strict=True)]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *fields]))
