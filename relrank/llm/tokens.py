"""Token ids of texts from a byte-level BPE file of the tokenizers library.

The file's pattern never lets a token cross from one word to the next that follows a single space, nor from a letter
or digit to a punctuation mark other than an apostrophe. Texts are cut there, and each distinct piece of a slice is
encoded once; a worker remembers pieces it has met, up to CACHE of them. Where a byte does not tell for sure what it
belongs to there is no cut, which only makes a piece longer.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

from relrank.llm import words as W

CACHE = 1 << 19
_SPACE = 0x20
_AFTER_SPACE = (W._BYTES > 0x20) & ~np.isin(W._BYTES, [0xC2, 0xE1, 0xE2, 0xE3])
_ALNUM = np.isin(W._BYTES, np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8))
_MARK = np.isin(W._BYTES, np.frombuffer(b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~", np.uint8))
_LATIN = ((W._BYTES & 0xC0) == 0x80) & ~np.isin(W._BYTES, [0x97, 0xB7])  # second bytes of U+00C0..U+00FF that are letters


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public tokenizer file on this machine; each worker looks it up for itself."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes slices of texts; one per task, with the ids of pieces met so far."""

    def __init__(self, name: str = "byte_bpe_50k.json", cache: int = CACHE) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(name))
        self.limit = cache
        self._forget()

    def _forget(self) -> None:
        # Two sorted tables of known pieces: the newer one is merged into the older one when it has grown.
        self.known = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(2)]
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        keys = np.concatenate([a[0], b[0]])
        order = np.argsort(keys, kind="stable")
        return keys[order], np.concatenate([a[1], b[1]])[order], np.concatenate([a[2], b[2]])[order]

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        sizes = np.array([len(x) for x in found], np.int64)
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(flat)), np.uint32)])
        self.ids[self.used : self.used + len(flat)] = flat
        new = (keys, self.used + np.cumsum(sizes) - sizes, sizes)
        self.used += len(flat)
        old, recent = self.known
        recent = self._merged(recent, new)
        if len(recent[0]) > 4096 + len(old[0]) // 4:
            old, recent = self._merged(old, recent), tuple(x[:0] for x in recent)
        self.known = [old, recent]

    def _look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start, size = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        met = np.zeros(len(keys), bool)
        for known, starts, sizes in self.known:
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                start[hit], size[hit] = starts[at[hit]], sizes[at[hit]]
                met |= hit
        return met, start, size

    def encode(self, part: W.Slice) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the slice's texts, and where each text's ids start (one more than texts)."""
        data, n = part.data, len(part.data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(part.rows + 1, np.int64)
        cut = np.zeros(n, bool)
        cut[:-1] = (data[:-1] == _SPACE) & _AFTER_SPACE[data[1:]]
        after = _ALNUM[data[:-1]]
        after[1:] |= (data[:-2] == 0xC3) & _LATIN[data[1:-1]]
        cut[1:] |= _MARK[data[1:]] & after
        # A text's last byte may be a space before the next text: no cut, unless the text starts there.
        heads = part.offsets[:-1][part.offsets[:-1] < n]
        cut[heads[heads > 0] - 1] &= data[heads[heads > 0] - 1] != _SPACE
        cut[heads] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        keys, first, inverse = np.unique(W.hash_ranges(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.known[0][0]) + len(self.known[1][0]) + len(keys) > self.limit:
            self._forget()
        met, start, size = self._look_up(keys)
        if not met.all():
            unknown = first[~met]
            whole = data.tobytes()
            pieces = [whole[a:b].decode("utf-8") for a, b in zip(starts[unknown].tolist(), ends[unknown].tolist(), strict=True)]
            self._learn(keys[~met], pieces)
            _, start, size = self._look_up(keys)
        start, size = start[inverse], size[inverse]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.arange(total[-1]) + np.repeat(start - total[:-1], size)]
        return ids, total[np.searchsorted(starts, part.offsets, "left")]


_WORKER: dict[str, Encoder] = {}


def worker_encoder(name: str) -> Encoder:
    """The encoder of this worker process, which keeps what it has met from task to task."""
    if name not in _WORKER:
        _WORKER[name] = Encoder(name)
    return _WORKER[name]
