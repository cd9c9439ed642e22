"""Three readings of a category path. The delimiter orders differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from relrank.functions import text as tx

# --- fixed values -----------------------------------------------------------------
DEPTH_DELIMITERS = [" > ", ">", " / ", "/", "|"]
TOP_LEVEL_DELIMITERS = [" > ", " / ", "/", ">", "|"]
PRIMARY_DELIMITER = "/"
PRIMARY_STRIP = r"^[\[\]'\" ]+|[\[\]'\" ]+$"
UNKNOWN = "Unknown"
# ----------------------------------------------------------------------------------


def _first_delimiter(path: Column, delimiters: list[str], then, otherwise: Column) -> Column:
    """`then(delimiter)` for the first delimiter the path contains."""
    chosen = None
    for d in delimiters:
        hit = path.contains(d)
        chosen = F.when(hit, then(d)) if chosen is None else chosen.when(hit, then(d))
    return chosen.otherwise(otherwise)


def depth(c: Column) -> Column:
    def levels(path: Column) -> Column:
        def parts(d: str) -> Column:
            return F.size(F.filter(tx.split_on(path, d), lambda p: ~tx.is_blank(p))).cast("double")

        counted = _first_delimiter(path, DEPTH_DELIMITERS, parts, F.lit(1.0))
        return F.when(path == "", F.lit(0.0)).otherwise(counted)

    return tx.bind(tx.strip(tx.text(c)), levels)


def top_level(c: Column) -> Column:
    def head_of(path: Column) -> Column:
        def head(d: str) -> Column:
            return tx.strip(F.element_at(tx.split_on(path, d), 1))

        return _first_delimiter(path, TOP_LEVEL_DELIMITERS, head, path)

    name = tx.bind(tx.strip(tx.text(c)), head_of)
    return F.coalesce(F.nullif(name, F.lit("")), F.lit(UNKNOWN))


def primary(c: Column) -> Column:
    """The part before the first slash, without list brackets and quotes."""
    head = F.element_at(tx.split_on(F.coalesce(c, F.lit(UNKNOWN)), PRIMARY_DELIMITER), 1)
    return tx.strip(F.regexp_replace(head, PRIMARY_STRIP, ""))
