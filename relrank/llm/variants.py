"""Spelling variants: words one edit apart, found through a reduced alphabet.

Letters are hashed to a few symbols. Two words one edit apart have reduced words at most one edit apart, so each
distinct reduced word generates its whole one-edit neighbourhood (itself, every symbol put in at every place, and every
symbol in place of every other), that meets the reduced vocabulary, and the few pairs found are verified on the words
themselves. The neighbours one symbol shorter are those that reach this word by an insertion: they find the pair.

A neighbour is a 64-bit polynomial hash of the reduced word, which an edit changes in constant time; equal hashes only
make candidates. The number of symbols follows the vocabulary, so that a reduced word stands for few words at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relrank.llm import words as W
from relrank.session import materialize

# --- fixed values: the contract's runs of letters ---
LETTERS = [chr(c) for c in (*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0xC0, 0x100))]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# ---
SHORTEST, OCCURRENCES, RATIO, DROP_EVERY = 7, 2, 10, 31
SYMBOLS = "abcdefghijklmnop"
LEAST_SYMBOLS = 3
SALTS = 256
BLOCK = 1 << 16  # places of a word that are edited at a time
CELLS = 1 << 20  # neighbours that are made at a time

_VALUES = np.random.default_rng(20250311).integers(1 << 62, 1 << 63, len(SYMBOLS), dtype=np.uint64) | np.uint64(1)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the runs of letters of at least `SHORTEST` code points after the stated deletion, and how often they
    occur. A null text has none; a null doc_id counts as empty."""
    # A shorter run stays short, so only runs of the least length are looked for.
    found = F.regexp_extract_all("text", F.lit(f"[A-Za-zÀ-ÿ]{{{SHORTEST},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(found).alias("run"))
    runs = runs.select("doc", F.translate("run", UPPER, LOWER).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.pmod("h", F.char_length("run").cast("long")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(F.col("h") % DROP_EVERY == 0, shorter).otherwise(F.col("run"))
    counted = runs.select(word.alias("word")).where(F.char_length("word") >= SHORTEST)
    return counted.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= OCCURRENCES)


def symbols_for(words: int) -> int:
    """The eighth root of the number of words: reduced words of eight symbols are then about as many as the words."""
    return int(min(max(LEAST_SYMBOLS, int(words ** (1 / 8) + 1e-9)), len(SYMBOLS)))


def alphabet(shares: dict[str, int], n_symbols: int) -> dict[str, str]:
    """The symbol of each letter: a hash, under the salt that deals letters out most evenly by how often they occur."""
    codes = np.array([ord(x) for x in LETTERS], np.uint64)
    often = np.array([shares.get(x, 0) for x in LETTERS], float)
    best, least = None, None
    for salt in range(SALTS):
        symbol = (W.mix(codes + np.uint64(salt * 1_000_003 + 77)) % np.uint64(n_symbols)).astype(int)
        together = float((np.bincount(symbol, often, n_symbols) ** 2).sum())
        if least is None or together < least:
            best, least = symbol, together
    return {x: SYMBOLS[s] for x, s in zip(LETTERS, best)}


def _codes(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and symbol codes (one row each) of words of equal length."""
    data, offsets = W.column_bytes(column)
    sizes = np.diff(offsets)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        step = max(1, CELLS // (int(size) + 1))
        for i in range(0, len(rows), step):
            part = rows[i : i + step]
            yield part, data[offsets[part][:, None] + np.arange(size)].astype(np.int64) - ord(SYMBOLS[0])


def _prefix(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the first i symbols for every i, and the powers that place a symbol."""
    power = W.powers(codes.shape[1] + 2)[: codes.shape[1] + 2]
    sums = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
    np.cumsum(_VALUES[codes] * power[: codes.shape[1]], axis=1, dtype=np.uint64, out=sums[:, 1:])
    return sums, power


def _named(hashes: np.ndarray, length: int) -> np.ndarray:
    return W.mix(hashes ^ np.uint64(length * 0x9E37)).view(np.int64)


def _own_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key = np.zeros(len(batch), np.int64)
        for rows, codes in _codes(batch.column("reduced")):
            key[rows] = _named(_prefix(codes)[0][:, -1], codes.shape[1])
        yield pa.record_batch({**{c: batch.column(c) for c in batch.schema.names}, "key": pa.array(key)})


def edited(codes: np.ndarray, n_symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and keys of the neighbourhoods of words of one length, each neighbour once."""
    sums, power = _prefix(codes)
    whole, length = sums[:, -1], codes.shape[1]
    rows = np.arange(len(codes))
    yield rows, _named(whole, length)
    step = power[1]
    for start in range(0, length + 1, BLOCK):
        places = np.arange(start, min(start + BLOCK, length + 1))
        inner = places[places < length]
        head, here = sums[:, places], codes[:, inner]
        # What stands behind an inserted symbol moves up by one place.
        shifted = head + (whole[:, None] - head) * step
        before = codes[:, np.maximum(places - 1, 0)]
        for symbol in range(n_symbols):
            # A symbol after its equal is the same word as before it. Replacements go upwards, the other word goes down.
            fresh = (before != symbol) | (places == 0)
            keys = shifted + _VALUES[symbol] * power[places]
            at = np.nonzero(fresh)
            yield at[0], _named(keys[at], length + 1)
            if len(inner):
                keys = whole[:, None] + (_VALUES[symbol] - _VALUES[here]) * power[inner]
                at = np.nonzero(here < symbol)
                yield at[0], _named(keys[at], length)


def _neighbourhoods(n_symbols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("key").to_numpy()
            for part, codes in _codes(batch.column("reduced")):
                for rows, keys in edited(codes, n_symbols):
                    if len(rows):
                        yield pa.record_batch({"mine": pa.array(own[part[rows]]), "near": pa.array(keys)})

    return run


def _reduced(word: Column, symbol: dict[str, str]) -> Column:
    return F.translate(word, "".join(symbol), "".join(symbol.values()))


def near_words(counted: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every pair of words of `counted` (word, n) one edit apart, in both directions.

    Words are distinct and made of LETTERS; the pairs are exact. Nothing but one count per letter goes to the driver.
    """
    shares = counted.select(F.explode(F.split("word", "")).alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    shares = {r["x"]: r["n"] for r in shares.where(F.col("x").isin(LETTERS)).collect()}
    n_symbols = symbols_for(counted.count())
    symbol = alphabet(shares, n_symbols)
    reduced = counted.withColumn("reduced", _reduced(F.col("word"), symbol))
    keyed = reduced.mapInArrow(_own_keys, "word string, n long, reduced string, key long")
    keyed = materialize(keyed, "reduced_words")
    distinct = keyed.select("key", "reduced").distinct()
    around = distinct.mapInArrow(_neighbourhoods(n_symbols), "mine long, near long")
    met = around.join(keyed.select(F.col("key").alias("near")).distinct(), "near")
    met = materialize(met.distinct(), "reduced_pairs")
    one = keyed.select(F.col("key").alias("mine"), F.col("word").alias("u"), F.col("n").alias("u_n"))
    two = keyed.select(F.col("key").alias("near"), F.col("word").alias("v"), F.col("n").alias("v_n"))
    # Within one reduced word both orders come up: one is enough.
    verified = (F.levenshtein("u", "v", 1) == 1) & ((F.col("mine") != F.col("near")) | (F.col("u") < F.col("v")))
    pairs = met.join(one, "mine").join(two, "near").where(verified).select("u", "u_n", "v", "v_n")
    sides = F.array(
        F.struct(F.col("u").alias("word"), F.col("u_n").alias("n"), F.col("v").alias("near"), F.col("v_n").alias("near_n")),
        F.struct(F.col("v").alias("word"), F.col("v_n").alias("n"), F.col("u").alias("near"), F.col("u_n").alias("near_n")),
    )
    return pairs.select(F.explode(sides).alias("s")).select("s.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where following word -> form ends. Each round doubles the steps taken; a form occurs more often
    than its word, so there are no circles and few rounds."""
    current = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = current.join(ahead, "root", "left")
        moved = moved.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        moved = materialize(moved, "forms")
        current = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return current


def variant_groups(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of the `docs` texts.

    A word's form is its near word that occurs most often (ties: the first in code-point order), if that is at least
    `RATIO` times as often as the word; its root is where the forms end, or itself. Null and empty texts have no words,
    a repeated row counts again, other columns are ignored and an empty table gives an empty one.
    """
    counted = materialize(vocabulary(docs), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    around = near_words(counted).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    rows = counted.join(around, "word", "left")
    often = -F.col("best.less") >= F.col("n") * RATIO
    rows = rows.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(often, F.col("best.near")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n"),
    )
    rows = materialize(rows, "word_forms")
    ended = roots(rows.where("form is not null"))
    return rows.join(ended, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
