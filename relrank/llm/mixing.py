"""Temperature mixing of sources: weights, and the documents that realise them within a token budget.

A source with share s of all tokens gets a weight proportional to s ** exponent: 1 keeps the natural mixture, 0 makes
all sources equal. The exponent is bisected for a target entropy of the weights, or for the most even mixture that
repeats no source more often than a limit. A source's part of the budget is filled with blocks: whole passes over its
documents, each in an order of its own, and one last block that stops before the budget would be exceeded. Tokens are
words. Texts are never shuffled: only sums per source and hash range are, and the documents of one range per source.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from relrank.session import materialize

WORD = r"[^ \t-\r]+"
RANGE_BITS = 12  # hash ranges per source in which tokens are summed
TESTS = 15  # exponents that a job tests at once: four bisection steps
STEPS = 10
SEED = 42


@dataclass
class Target:
    """What the exponent has to meet, and how many tokens to draw.

    entropy: of the weights, in nats; or max_repeats: the most passes over any source. budget: tokens in all; None
    draws as many as it takes to use every document at least once.
    """

    entropy: float | None = None
    max_repeats: float | None = None
    budget: int | None = None

    def __post_init__(self) -> None:
        if (self.entropy is None) == (self.max_repeats is None):
            raise ValueError("give either a target entropy or a repetition limit")
        if self.max_repeats is not None and self.max_repeats < 1:
            raise ValueError("a repetition limit below 1 can't be met")
        if self.budget is not None and self.budget < 0:
            raise ValueError("the budget can't be negative")


def n_tokens(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source: str) -> Column:
    """The source as a join key; a null source is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))


def _order(block: Column) -> Column:
    return F.xxhash64(F.col("doc_id"), block, F.lit(SEED))


def _range_of(order: Column) -> Column:
    """The hash range of an order number, ascending with it."""
    return F.shiftrightunsigned(order.bitwiseXOR(F.lit(-(1 << 63))), 64 - RANGE_BITS)


def source_tokens(docs: DataFrame) -> DataFrame:
    """(source_key, range, tokens, rows): tokens of each source in each hash range of its last block."""
    return (
        docs.select(_source_key("source").alias("source_key"), _range_of(_order(F.lit(-1))).alias("range"), n_tokens().alias("n"))
        .groupBy("source_key", "range")
        .agg(F.sum("n").alias("tokens"), F.count("*").alias("rows"))
    )


def _measures(shares: DataFrame, exponents: list[float], total: int, budget: int | None) -> list[tuple[float, float]]:
    """Entropy of the weights and the most repeated source's number of passes for each exponent, in one job."""
    tried = shares.select("log_share", F.explode(F.array(*map(F.lit, range(len(exponents))))).alias("i"))
    tried = tried.withColumn("a", F.element_at(F.array(*[F.lit(float(x)) for x in exponents]), F.col("i") + 1))
    power = F.exp(F.col("a") * F.col("log_share"))
    each = F.exp((F.col("a") - 1) * F.col("log_share"))  # passes over the source, times a constant
    rows = tried.groupBy("i").agg(
        F.sum(power).alias("z"), F.sum(power * F.col("a") * F.col("log_share")).alias("s"),
        F.max(each).alias("most"), F.min(each).alias("least"),
    ).orderBy("i").collect()
    out = []
    for r in rows:
        passes = r["most"] / r["least"] if budget is None else r["most"] / r["z"] * budget / total
        out.append((math.log(r["z"]) - r["s"] / r["z"], passes))
    return out


def find_exponent(shares: DataFrame, target: Target, total: int) -> float:
    """The exponent in [0, 1] that meets the target; the nearest end where none does.

    `shares` has log_share, the logarithm of each source's share of the `total` tokens. Entropy and repetition both
    fall as the exponent grows.
    """

    def too_even(entropy: float, passes: float) -> bool:
        return passes > target.max_repeats if target.entropy is None else entropy > target.entropy

    low, high = 0.0, 1.0
    ends = _measures(shares, [low, high], total, target.budget)
    if not too_even(*ends[0]):
        return low
    if too_even(*ends[1]):
        return high
    for _ in range(STEPS):
        tests = [low + (high - low) * i / (TESTS + 1) for i in range(1, TESTS + 1)]
        found = [too_even(*x) for x in _measures(shares, tests, total, target.budget)]
        first_met = next((i for i, even in enumerate(found) if not even), TESTS)
        low, high = ([low, *tests][first_met], [*tests, high][first_met])
    return high


def mixture(docs: DataFrame, target: Target) -> DataFrame:
    """(source_key, tokens, weight, drawn, passes, cut): how each source is used.

    passes: whole passes over the source; cut: the last (order, doc_id, text hash) of the block after them, null if
    that block is empty. Sources without tokens get the passes of the most repeated source, as they cost nothing.
    """
    ranges = materialize(source_tokens(docs), "source_ranges")
    sources = materialize(ranges.groupBy("source_key").agg(F.sum("tokens").alias("tokens")), "source_tokens")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    shares = sources.where("tokens > 0").withColumn("log_share", F.log(F.col("tokens") / float(max(total, 1))))
    if total:
        exponent = find_exponent(shares, target, total)
        scale = shares.agg(
            F.sum(F.exp(exponent * F.col("log_share"))).alias("z"),
            F.max(F.exp((1 - exponent) * F.col("log_share"))).alias("largest"),
        ).first()
        z = scale["z"]
        budget = float(target.budget) if target.budget is not None else total * z * scale["largest"]
    else:
        exponent, z, budget = 1.0, 1.0, 0.0
    weight = F.exp(exponent * F.log(F.col("tokens") / float(max(total, 1)))) / z
    weights = sources.withColumn("weight", F.when(F.col("tokens") > 0, weight).otherwise(0.0))
    # Rounding up by a hair keeps a source whose part is a whole number of passes from losing its last document.
    weights = weights.withColumn("drawn", F.floor(F.col("weight") * budget * (1 + 1e-12) + 1e-6))
    passes = F.when(F.col("tokens") > 0, F.floor(F.col("drawn") / F.col("tokens"))).otherwise(F.lit(1))
    weights = weights.withColumn("passes", passes.cast("long"))
    weights = materialize(weights.withColumn("rest", F.col("drawn") - F.col("passes") * F.col("tokens")), "mixture")
    # The hash range in which the last block ends, and what is left of the budget there.
    before = Window.partitionBy("source_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    filled = ranges.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    ends = filled.join(weights.where("tokens > 0").select("source_key", "rest"), "source_key")
    ends = ends.where("before <= rest and before + tokens > rest").select("source_key", "range", "before", "rest")
    ends = materialize(ends, "mixture_ends")  # one row per source: where they are few, texts are not shuffled
    last = docs.select(
        _source_key("source").alias("source_key"), _order(F.lit(-1)).alias("h"), "doc_id", "text"
    ).withColumn("range", _range_of(F.col("h"))).join(ends, ["source_key", "range"])
    last = last.select("source_key", "rest", "before", "h", "doc_id", F.xxhash64("text").alias("t"), n_tokens().alias("n"))
    upto = Window.partitionBy("source_key").orderBy("h", "doc_id", "t").rowsBetween(Window.unboundedPreceding, 0)
    inside = last.withColumn("upto", F.col("before") + F.sum("n").over(upto)).where("upto <= rest")
    cuts = inside.groupBy("source_key").agg(F.max(F.struct("h", "doc_id", "t")).alias("cut"))
    weights = weights.join(ends.select("source_key", F.col("range").alias("last_range")), "source_key", "left")
    return weights.join(cuts, "source_key", "left").drop("rest")


def mix(docs: DataFrame, target: Target) -> DataFrame:
    """Rows of `docs` as often as the mixture draws them, with mix_block (from 0) and mix_order within the block.

    Blocks follow each other; within a block a source's rows follow mix_order. Rows with null or empty text cost
    nothing and belong to the first block; a null source is a source; a null doc_id is an id like any other. A column
    of `docs` named mix_block or mix_order is replaced.
    """
    names = [n for n in docs.columns if n not in ("mix_block", "mix_order")]
    used = mixture(docs.select("doc_id", "source", "text"), target)
    used = used.select(
        F.col("source_key").alias("_key"), F.col("passes").alias("_passes"), F.col("cut").alias("_cut"),
        F.col("last_range").alias("_last"),
    )
    # One row per source, written out: where there are few sources Spark knows it, and texts are not shuffled.
    used = materialize(used, "mixture_cuts")
    rows = docs.select(*[F.col(f"`{n}`") for n in names]).withColumn("_h", _order(F.lit(-1)))
    rows = rows.join(used, _source_key("source") == F.col("_key"))
    mine = F.struct(F.col("_h").alias("h"), F.col("doc_id"), F.xxhash64("text").alias("t"))
    at = _range_of(F.col("_h"))
    in_last = F.coalesce((at < F.col("_last")) | (at == F.col("_last")) & F.coalesce(mine <= F.col("_cut"), F.lit(False)), F.lit(False))
    whole = F.when(F.col("_passes") > 0, F.sequence(F.lit(0).cast("long"), F.col("_passes") - 1)).otherwise(F.array().cast(T.ArrayType(T.LongType())))
    blocks = F.concat(whole, F.when(in_last, F.array(F.col("_passes"))).otherwise(F.array().cast(T.ArrayType(T.LongType()))))
    rows = rows.withColumn("mix_block", F.explode(blocks))
    order = F.when(F.col("mix_block") == F.col("_passes"), F.col("_h")).otherwise(_order(F.col("mix_block")))
    return rows.withColumn("mix_order", order).select(*names, "mix_block", "mix_order")
