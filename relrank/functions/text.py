"""Column expressions over text. Character classes are spelled out, as \\s and \\w are ASCII in Java."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: white space and words of the three text views --------------------
_SPACE = r"\t-\r\x1c-\x20\x{85}\p{Z}"
_WORD = r"[\p{L}\p{N}_]"
SPACE_RUN = f"[{_SPACE}]+"
OUTER_SPACE = f"^[{_SPACE}]+|[{_SPACE}]+$"
NON_SPACE = f"[^{_SPACE}]"
NON_SPACE_RUN = f"[^{_SPACE}]+"
WORD = f"{_WORD}+"
WORD_OF_TWO = f"{_WORD}{{2,}}"
LINE_BREAK = r"\r\n|[\n\x0B\f\r\x1C\x1D\x1E\x85\u2028\u2029]"
# ----------------------------------------------------------------------------------


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, OUTER_SPACE, "")


def collapse(c: Column) -> Column:
    """Null becomes empty, whitespace runs become one space, ends are stripped; case stays."""
    return F.trim(F.regexp_replace(text(c), SPACE_RUN, " "))


def fold(c: Column) -> Column:
    """Lower-cased `collapse`: the form in which query and title are compared."""
    return F.lower(collapse(c))


def is_blank(c: Column) -> Column:
    return ~F.coalesce(c.cast("string").rlike(NON_SPACE), F.lit(False))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(text(c)), F.lit(WORD), F.lit(0))


def word_set(c: Column) -> Column:
    return F.array_distinct(words(c))


def space_tokens(c: Column) -> Column:
    """Lower-cased whitespace split; punctuation stays part of the token."""
    return F.filter(F.split(F.lower(text(c)), SPACE_RUN), lambda t: t != "")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value evaluated once per row, however often the body uses it.

    A lambda re-evaluates every expression it closes over for each element; its own variable it does not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_grams(c: Column) -> Column:
    """Words of two or more characters, then their bigrams joined by one space."""

    def with_pairs(w: Column) -> Column:
        pairs = F.greatest(F.size(w) - 1, F.lit(0))
        bigrams = F.zip_with(
            F.slice(w, 1, pairs), F.slice(w, 2, pairs), lambda a, b: F.concat(a, F.lit(" "), b)
        )
        return F.concat(w, bigrams)

    return bind(F.regexp_extract_all(F.lower(text(c)), F.lit(WORD_OF_TWO), F.lit(0)), with_pairs)


def trigram_set(c: Column) -> Column:
    """Distinct character trigrams, each packed into one long: three code points of 21 bits.

    Sets of longs compare several times faster than sets of strings, and the packing loses nothing.
    """
    codes = F.transform(F.split(c, ""), lambda x: F.ascii(x).cast("long"))

    def pack(v: Column) -> Column:
        n = F.size(v) - 2
        packed = F.zip_with(
            F.zip_with(F.slice(v, 1, n), F.slice(v, 2, n), lambda x, y: x * (1 << 21) + y),
            F.slice(v, 3, n),
            lambda x, y: x * (1 << 21) + y,
        )
        return F.array_distinct(packed)

    return F.when(F.length(c) >= 3, bind(codes, pack)).otherwise(F.array().cast("array<long>"))


def counts(terms: Column) -> Column:
    """Distinct terms of one text with their counts, as `array<struct<term, weight>>`.

    Quadratic in the number of distinct terms, hence meant for titles and queries.
    """
    return bind(
        terms,
        lambda ts: F.transform(
            F.array_distinct(ts),
            lambda t: F.struct(
                t.alias("term"), F.size(F.filter(ts, lambda x: x == t)).cast("double").alias("weight")
            ),
        ),
    )


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column, in_both: Column) -> Column:
    """Overlap of two sets given the size of their intersection; zero if one of them is empty."""
    union = F.size(a) + F.size(b) - in_both
    return F.when((F.size(a) > 0) & (F.size(b) > 0), in_both / union).otherwise(F.lit(0.0))


def word_count(c: Column) -> Column:
    return F.size(F.regexp_extract_all(text(c), F.lit(NON_SPACE_RUN), F.lit(0)))


def char_count(c: Column) -> Column:
    return F.length(strip(text(c)))


def split_on(c: Column, delimiter: str) -> Column:
    return F.split(c, "\\Q" + delimiter + "\\E")


def line_items(c: Column) -> Column:
    """Non-blank lines of a text that may hold several."""
    lines = F.transform(F.split(text(c), LINE_BREAK), strip)
    return F.filter(lines, lambda t: t != "")
