"""Token ids of whole texts, each different piece of text encoded once per task."""

from __future__ import annotations

import gc
import os
import re
from itertools import chain, repeat

import numpy as np

#: Unicode white space, and the letters of Latin-1.
SPACE = "\t-\r \x85\xa0  -     　"
LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
#: Pieces that are encoded alike alone and inside a text. A tokenizer never joins a word with the white space
#: after it, nor a letter with a following stop or comma.
WITH_SPACE = re.compile(f"[{SPACE}]*[{LETTER}]+(?=[.,])|[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
WITHOUT_SPACE = re.compile(f"[{LETTER}]+(?=[.,])|[^{SPACE}]+")
#: Pieces remembered by a worker process (about 100 MB); then it keeps those used most. Results don't depend on it.
REMEMBER = 400_000

_ENCODERS: dict[tuple[str, str], PieceEncoder] = {}


class PieceEncoder:
    """Ids of texts by a tokenizer file of the `tokenizers` library, without special tokens."""

    def __init__(self, path: str, pieces: re.Pattern):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = pieces
        self.codes: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.ends = np.zeros(1, np.int32)
        self.uses = np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keeps at most half of the pieces, the ones used most, and no piece used once."""
        uses, ends = self.uses[:len(self.codes)], self.ends[:len(self.codes) + 1]
        keep = np.argsort(-uses, kind="stable")[:REMEMBER // 2]
        keep = np.sort(keep[uses[keep] > 1])
        names, begin = list(self.codes), ends[keep]
        length = ends[keep + 1] - begin
        self.ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
        self.ids = self.ids[np.arange(self.ends[-1]) + np.repeat(begin - self.ends[:-1], length)]
        self.codes = {names[k]: n for n, k in enumerate(keep.tolist())}
        self.uses = uses[keep] // 2

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts one after the other, and the number of each text's."""
        if len(self.codes) > REMEMBER:
            self._forget()
        # Millions of small lists without cycles: the collector would go through them again and again.
        on = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if on:
                gc.enable()

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.pieces.findall(t) for t in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = list(chain.from_iterable(found))
        codes = np.fromiter(map(self.codes.get, flat, repeat(-1)), np.int32, len(flat))
        unknown = np.flatnonzero(codes < 0).tolist()
        if unknown:
            new = list({flat[k] for k in unknown})
            self._add(new, [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)])
            codes[unknown] = [self.codes[flat[k]] for k in unknown]
        self.uses[:len(self.codes)] += np.bincount(codes, minlength=len(self.codes))
        begin = self.ends[codes]
        length = self.ends[codes + 1] - begin
        upto = np.zeros(len(codes) + 1, np.int32)
        np.cumsum(length, out=upto[1:])
        where = np.repeat(begin - upto[:-1], length)
        where += np.arange(upto[-1], dtype=np.int32)
        bounds = upto[np.concatenate([[0], np.cumsum(sizes)])]
        return self.ids[where], np.diff(bounds)

    def _add(self, new: list[str], coded: list[list[int]]) -> None:
        """Remembers pieces with their ids; the arrays grow in place, by half at a time."""
        have, lengths = len(self.codes), np.fromiter(map(len, coded), np.int32, len(coded))
        first = int(self.ends[have])
        last = first + int(lengths.sum())
        self.ids = _room(self.ids, last)
        self.ends, self.uses = _room(self.ends, have + len(new) + 1), _room(self.uses, have + len(new))
        self.ids[first:last] = np.fromiter(chain.from_iterable(coded), np.uint32, last - first)
        self.ends[have + 1:have + len(new) + 1] = first + np.cumsum(lengths)
        self.uses[have:have + len(new)] = 0
        self.codes.update(zip(new, range(have, have + len(new)), strict=True))


def _room(array: np.ndarray, size: int) -> np.ndarray:
    """The array, or a larger copy that has room for `size` values."""
    if size <= len(array):
        return array
    out = np.zeros(size + size // 2, array.dtype)
    out[:len(array)] = array
    return out


def encoder(path: str, keep_space: bool) -> PieceEncoder:
    """This process's encoder for a file; `keep_space` for tokenizers to which white space matters."""
    pieces = WITH_SPACE if keep_space else WITHOUT_SPACE
    key = (path, pieces.pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(path, pieces)
    return _ENCODERS[key]


def groups(texts: list[str], most_chars: int = 4_000_000):
    """Slices of a list whose texts have about so many characters together."""
    start, chars = 0, 0
    for k, text in enumerate(texts):
        chars += len(text)
        if chars >= most_chars:
            yield slice(start, k + 1)
            start, chars = k + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))
