"""Whole-text token ids from the tokenizers library, with a memo of pieces.

Both vocabularies split a text at white space before any merge, so the ids of a text are the ids of
its pieces "word" or " word" put together; both also split between a letter or digit and a full stop
or comma. Each distinct piece goes through the library once per worker. That holds for texts of the characters in
PLAIN, which the tests prove one by one; any other text, or one with a special string, goes through the library whole.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np

from siltstone.llm.common import keeps

#: Line ends, printable ASCII, Latin-1 without control characters and soft hyphens, and common Western marks.
PLAIN = "\n\x20-\x7e\u00a1-\u00ac\u00ae-\u00ff\u0152\u0153\u2013\u2014\u2018-\u201e\u2026\u20ac"
_WHOLE = re.compile(rf"[^{PLAIN}]|<\|")
#: Flags of a piece: not to be used alone, starts with a stop or comma, ends with a letter or digit.
_BAD, _SIGN, _WORD_END = 1, 2, 4
_SPECIAL = "<|endoftext|>"


class _Seen(dict):
    """Piece -> number; new pieces queue for encoding."""

    def __init__(self):
        self.fresh: list[str] = []
        self.chars = 0

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.fresh.append(piece)
        self.chars += len(piece)
        return n


class MemoEncoder:
    """encode(texts) gives (ids of all texts in a row, number of ids of each text)."""

    def __init__(self, path: str, max_pieces: int = 600_000, max_chars: int = 12_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.sep = self.lib.token_to_id(_SPECIAL)
        self.folds = "Lowercase" in str(self.lib.normalizer)
        self.max_pieces, self.max_chars = max_pieces, max_chars
        self._clear()

    def _clear(self) -> None:
        self.seen = _Seen()
        self.ids = np.zeros(1 << 20, np.int32)
        self.start = np.zeros(1 << 18, np.int64)
        self.length = np.zeros(1 << 18, np.int32)
        self.flags = np.zeros(1 << 18, np.uint8)
        self.used = 0

    @staticmethod
    def _surface(piece: str) -> str:
        if piece[:1] == "\x00":
            return piece[1:]
        return piece if piece[:1] in ("\n", ".", ",") else " " + piece

    def _library(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each piece. Pieces are put in one text, parted by the special token, which ends any match."""
        if self.sep is None:
            each = [np.array(e.ids, np.int32) for e in self.lib.encode_batch_fast(pieces, add_special_tokens=False)]
            return np.concatenate(each), np.array([len(e) for e in each], np.int64)
        out, lengths = [], []
        for i in range(0, len(pieces), 4000):
            block = pieces[i : i + 4000]
            ids = np.array(self.lib.encode_batch_fast([_SPECIAL.join(block)], add_special_tokens=False)[0].ids, np.int32)
            cut = np.flatnonzero(ids == self.sep)
            lengths.append(np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1)
            out.append(np.delete(ids, cut))
        return np.concatenate(out), np.concatenate(lengths)

    def _learn(self) -> None:
        fresh, self.seen.fresh = self.seen.fresh, []
        if not fresh:
            return
        known = len(self.seen) - len(fresh)
        while len(self.seen) > len(self.start):
            self.start, self.length, self.flags = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.flags))
        flags = np.array([_WORD_END * p[-1:].isalnum() + _SIGN * (p[:1] in (".", ",")) for p in fresh], np.uint8)
        flags |= np.array([_BAD * (p in ("", "\n", "\x00\n")) for p in fresh], np.uint8)
        self.flags[known : len(self.seen)] = flags
        ids, lengths = self._library([self._surface(p) for p in fresh])
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        ends = np.cumsum(lengths)
        self.start[known : len(self.seen)] = self.used + ends - lengths
        self.length[known : len(self.seen)] = lengths
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _keys(self, text: str, fine: bool) -> list[str]:
        if self.folds:
            text = text.lower()
        text = text.replace("\n", " \n")
        if fine:
            pieces = text.replace(".", " .").replace(",", " ,").split(" ")
        else:
            pieces = [p if p[:1] not in (".", ",") else "\x00 " + p for p in text.split(" ")]
        pieces[0] = "\x00" + pieces[0].removeprefix("\x00 ") if pieces[0] else ""
        return pieces

    def _numbers(self, texts: list[str]) -> tuple[list[np.ndarray], list[int]]:
        """Numbers of each text's pieces; the texts that only the library can take, whole."""
        if len(self.seen) > self.max_pieces or self.seen.chars > self.max_chars:
            self._clear()
        look = self.seen.__getitem__
        numbers: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
        whole = [i for i, text in enumerate(texts) if _WHOLE.search(text)]
        skip = set(whole)
        left = [i for i, text in enumerate(texts) if text and i not in skip]
        for fine in (True, False):
            for i in left:
                keys = self._keys(texts[i], fine)
                numbers[i] = np.fromiter(map(look, keys), np.int64, len(keys))
            self._learn()
            again = []
            for i in left:
                flags = self.flags[numbers[i]]
                if (flags & _BAD).any() or fine and np.any(((flags[1:] & _SIGN) > 0) & ((flags[:-1] & _WORD_END) == 0)):
                    again.append(i)
            left = again
        for i in left:
            numbers[i] = np.zeros(0, np.int64)
        return numbers, whole + left

    def count(self, texts: list[str]) -> np.ndarray:
        """Number of ids of each text."""
        numbers, whole = self._numbers(texts)
        out = np.array([self.length[n].sum() if len(n) else 0 for n in numbers], np.int64)
        for i in whole:
            out[i] = len(self.lib.encode(texts[i], add_special_tokens=False))
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        numbers, whole = self._numbers(texts)
        out = []
        for n in numbers:
            lengths = self.length[n].astype(np.int64)
            ends = np.cumsum(lengths)
            total = int(ends[-1]) if len(n) else 0
            out.append(self.ids[np.repeat(self.start[n] - ends + lengths, lengths) + np.arange(total)])
        for i in whole:
            out[i] = np.array(self.lib.encode(texts[i], add_special_tokens=False).ids, np.int32)
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> MemoEncoder:
    """One encoder per worker process and vocabulary."""
    return MemoEncoder(path)


keeps("tokens", encoder.cache_clear)
