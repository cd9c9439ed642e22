"""Exact duplicates by a tree merge of sorted digest runs, in DataFrame functions only.

Every input partition is a run: the digests of its texts in order, each once, with the row that would stay and how many
rows it stands for. In a round the runs of `FAN` neighbours meet: the members of a group exchange slices of the digest
range, so that each of them merges one slice of all of them, and a group's merged run is spread over as many tasks as
it has members. After log_FAN(runs) rounds one run is left, and the decisions go back down the same tree: a row of a
run is looked for in the run above it, never in one table of all rows. At no level does a key hold more than `FAN` rows
of digests, or one partition's rows of documents, whatever the size of a group of copies.

A digest is verified at every merge: rows are one only if a 64-bit hash that orders the run, the SHA-256 and the length
all agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relrank.session import materialize

FAN = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DIGEST = ["place", "sha", "size"]


def normalised(text: Column) -> Column:
    """A-Z in lower case, nothing else; null is the empty text. Plain ASCII takes the faster function."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _leaves(docs: DataFrame) -> DataFrame:
    """One narrow row per document: where it came from and its digest. Texts are read here and nowhere else."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("plain"))
    return rows.select(
        "doc_id", F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("run"),
        F.xxhash64("plain").alias("place"), F.unhex(F.sha2("plain", 256)).alias("sha"),
        F.octet_length("plain").cast("long").alias("size"),
    )


def _preferred(keep: str) -> Column:
    """Orders the rows of a group: rows with an id first, then by id, then the earlier row. The greatest one stays."""
    known = F.col("doc_id").isNotNull()
    ranked = F.col("doc_id") if keep == "largest" else F.bitwise_not("doc_id")
    return F.struct(known.alias("known"), ranked.alias("ranked"), (-F.col("row")).alias("earlier"), F.col("doc_id"))


def _merged(runs: DataFrame, fan: int, level: int) -> DataFrame:
    """Runs of one level above: neighbours in groups of `fan`, each group in fan ** level slices of the digests."""
    slices = min(fan**level, 1 << 20)
    met = runs.withColumns({"run": F.floor(F.col("run") / fan).cast("int"), "slice": F.pmod("place", F.lit(slices))})
    met = met.repartition("run", "slice").sortWithinPartitions("run", "slice", *DIGEST)
    return met.groupBy("run", "slice", *DIGEST).agg(F.max("stays").alias("stays"), F.sum("copies").alias("copies")).drop("slice")


def exact_duplicates(docs: DataFrame, keep: str = "largest", fan: int = FAN) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of `docs`, from its doc_id and text.

    Texts are equal when they are after lower-casing A-Z; a null text is empty, and empty texts are equal. Of equal
    texts the row with the largest doc_id stays (`keep="smallest"`: the smallest). Exactly one row of each group stays:
    among rows with that same doc_id the first one read, and a row without doc_id only where no row of its group has
    one; keep_id is null there. Other columns are ignored, an empty table gives an empty one.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'.")
    if fan < 2:
        raise ValueError("fan is 2 or more.")
    leaves = materialize(_leaves(docs), "digest_rows")
    first = leaves.groupBy("run", *DIGEST).agg(F.max(_preferred(keep)).alias("stays"), F.count("*").alias("copies"))
    levels = [materialize(first.sortWithinPartitions("run", *DIGEST), "digest_run")]
    last = levels[0].agg(F.max("run")).first()[0] or 0
    while last:
        levels.append(materialize(_merged(levels[-1], fan, len(levels)), "digest_run"))
        last //= fan
    # Down again: each run takes over what the run above it decided.
    decided = levels[-1]
    for below in reversed(levels[:-1]):
        wider = below.select("run", *DIGEST).withColumn("up", F.floor(F.col("run") / fan).cast("int"))
        decided = wider.join(decided.withColumnRenamed("run", "up"), ["up", *DIGEST]).drop("up")
    verdicts = decided.select(
        "run", *DIGEST, F.col("stays.doc_id").alias("keep_id"), (-F.col("stays.earlier")).alias("keep_row"),
        F.col("copies").alias("group_size"),
    )
    return leaves.join(verdicts, ["run", *DIGEST]).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
