"""Token counts under a unigram vocabulary, by dynamic programming shared along a trie of pre-tokens.

A text's pre-tokens are its words, each after a word-start mark. Its count is the sum over pre-tokens of the number of
pieces in the best segmentation: the highest sum of piece scores, of equal ones the fewest pieces. A character that no
piece covers is a piece of its own with a score below all others. The distinct pre-tokens of a batch of texts go
into a trie; the forward score at a trie node depends on its prefix only, so it is computed once for all words that
share the prefix, and the node at a word's end holds its count. All nodes of a depth are computed together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from relrank.llm import words as W

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
KNOWN = 1 << 20  # pre-tokens whose counts a worker remembers
_CODES = np.random.default_rng(4091).integers(1, 1 << 62, 2, dtype=np.uint64) | np.uint64(1)


@dataclass
class Pieces:
    """Pieces by hash: scores[i] belongs to hashes[i], sorted; longest is their greatest number of characters."""

    hashes: np.ndarray
    scores: np.ndarray
    longest: int
    unknown: float

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are pieces, and their scores."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.hashes[at] == hashes, self.scores[at]


def _extend(hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hash of strings with one more character each."""
    return W.mix(hashes * _CODES[0] + (codes.astype(np.uint64) + np.uint64(1)) * _CODES[1])


def piece_table(scored: dict[str, float]) -> Pieces:
    """A table of non-empty pieces with their scores."""
    hashes, scores, longest = [], [], 0
    for piece, score in scored.items():
        own = np.zeros(1, np.uint64)
        for char in piece:
            own = _extend(own, np.array([ord(char)]))
        hashes.append(own[0])
        scores.append(score)
        longest = max(longest, len(piece))
    order = np.argsort(np.array(hashes, np.uint64))
    values = np.array(scores, np.float64)
    return Pieces(np.array(hashes, np.uint64)[order], values[order], longest, float(values.min()) - 10.0)


@cache
def vocabulary_pieces(name: str = VOCABULARY) -> Pieces:
    """Normal pieces of a sentencepiece file. A file of merges has ranks for scores; logarithms of them are used,
    as frequencies of pieces fall about with their rank."""
    import public_tokenizers
    import sentencepiece

    held = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    special = (held.is_unknown, held.is_control, held.is_unused, held.is_byte)
    ids = [i for i in range(held.get_piece_size()) if not any(f(i) for f in special)]
    return piece_table({held.id_to_piece(i): -float(np.log(rank + 2)) for rank, i in enumerate(ids)})


def trie_counts(chars: np.ndarray, starts: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Pieces in the best segmentation of each pre-token; pre-token i is chars[starts[i]:starts[i + 1]], not empty."""
    n = len(starts) - 1
    size = np.diff(starts)
    counts = np.zeros(n, np.int64)
    active = np.arange(n)  # pre-tokens longer than the depth
    node = np.zeros(n, np.int64)  # node of each active pre-token at the depth
    # For the last `longest` depths: best score and count of each node, and its ancestors' row in that depth.
    scores, numbers = [np.zeros(1)], [np.zeros(1, np.int64)]
    suffixes: list[np.ndarray] = []  # suffixes[k]: hash of the last k + 1 characters before a node of this depth
    ancestors: list[np.ndarray] = [np.zeros(1, np.int64)]  # ancestors[k]: node's ancestor k depths above, itself first
    depth = 0
    while len(active):
        codes = chars[starts[active] + depth].astype(np.int64)
        keys, child = np.unique((node << 21) | codes, return_inverse=True)
        parent, code = keys >> 21, keys & ((1 << 21) - 1)
        # Characters before the node: one-character suffix, then each longer one from the parent's.
        suffixes = [_extend(np.zeros(len(keys), np.uint64), code)] + [_extend(s[parent], code) for s in suffixes]
        suffixes = suffixes[: pieces.longest]
        above = [a[parent] for a in ancestors][: pieces.longest]
        best, number = np.full(len(keys), -np.inf), np.zeros(len(keys), np.int64)
        for k, hashes in enumerate(suffixes):
            found, score = pieces.find(hashes)
            if k == 0:
                score = np.where(found, score, pieces.unknown)
                found = np.ones(len(keys), bool)
            total = scores[-1 - k][above[k]] + score
            steps = numbers[-1 - k][above[k]] + 1
            better = found & ((total > best + 1e-9) | (np.abs(total - best) <= 1e-9) & (steps < number))
            best[better], number[better] = total[better], steps[better]
        scores, numbers = [*scores, best][-pieces.longest :], [*numbers, number][-pieces.longest :]
        ancestors = [np.arange(len(keys)), *above]
        depth += 1
        ended = size[active] == depth
        counts[active[ended]] = number[child[ended]]
        active, node = active[~ended], child[~ended]
    return counts


class Counter:
    """Counts tokens of slices; remembers pre-tokens met so far, up to KNOWN of them."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def count(self, part: W.Slice) -> np.ndarray:
        found = W.words(part, lower=False)
        keys, first, inverse = np.unique(found.hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, keys), max(0, len(self.hashes) - 1))
        met = self.hashes[at] == keys if len(self.hashes) else np.zeros(len(keys), bool)
        per_key = np.zeros(len(keys), np.int64)
        per_key[met] = self.counts[at[met]] if met.any() else 0
        new = first[~met]
        if len(new):
            # The new words after one another, a mark before each.
            data = part.data
            lengths = found.ends[new] - found.starts[new]
            ends = np.cumsum(lengths)
            flat = data[np.arange(int(ends[-1])) + np.repeat(found.starts[new] - (ends - lengths), lengths)]
            codes = np.frombuffer(flat.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
            chars = np.add.reduceat(~W.IS_CONTINUATION[flat], ends - lengths).astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(chars)])
            marked = np.insert(codes, starts[:-1], ord(MARK))
            per_key[~met] = trie_counts(marked, starts + np.arange(len(starts)), self.pieces)
            if len(self.hashes) + len(new) > KNOWN:
                self._forget()
            merged = np.concatenate([self.hashes, keys[~met]])
            order = np.argsort(merged, kind="stable")
            self.hashes = merged[order]
            self.counts = np.concatenate([self.counts, per_key[~met]])[order]
        total = np.concatenate([[0], np.cumsum(per_key[inverse])])
        return total[found.row_starts[1:]] - total[found.row_starts[:-1]]


_WORKER: dict[str, Counter] = {}


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """`docs` with a column n_tokens (long); null and empty texts, and texts without words, have 0.

    Other columns stay, a column n_tokens is replaced.
    """
    names = [n for n in docs.columns if n != "n_tokens"]
    rows = docs.select(*[f"`{n}`" for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _WORKER:
            _WORKER[vocabulary] = Counter(vocabulary_pieces(vocabulary))
        counter = _WORKER[vocabulary]
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            found = [np.zeros(0, np.int64), *[counter.count(part) for part in W.slices(column)]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found))], names=[*names, "n_tokens"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("n_tokens", T.LongType())]))
