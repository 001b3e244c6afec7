r"""Encoding with the ``tokenizers`` library, each distinct piece of text once.

A text is cut where its tokens cannot cross: before a white-space character that follows a
character which is not one. Pieces recur, so each is encoded once and kept in a memo that is bounded in
pieces and in their characters. A text's first piece has no space before it: its key is a tuple, all others' are strings.
Plain pieces (Latin letters, then ASCII punctuation) go straight to the vocabulary's BPE model,
all others through ``encode_batch``; both give what encoding the whole text gives.
"""

from __future__ import annotations

import os
import re

import numpy as np

from graphloom.llm import common

_SPACE_AFTER_SPACE = re.compile(r"\s[ ]")
_CUT = re.compile(r"(?<=\S)(?=[ ])")
_LETTER_DIGIT = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
_MARKS = ".,!?;:$%&#*"
_PLAIN = re.compile(rf"([A-Za-zÀ-ÖØ-öø-ÿ]*)([{_MARKS}]*)")
#: Longer pieces are left to the library.
LONG_PIECE = 64
#: The memo is emptied before a batch when its pieces have so many characters; long pieces without spaces fill it early.
MEMO_CHARS = 8_000_000


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out


class PieceEncoder:
    """Ids of texts under one vocabulary file.

    spaced: a piece's leading space belongs to its first token (byte-level vocabularies); otherwise
    white space is dropped and letters are lower-cased (word vocabularies).
    """

    def __init__(self, path: str, spaced: bool, most: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.spaced, self.most = spaced, most
        self.letters = _byte_letters()
        self.clear()

    def clear(self) -> None:
        self.known: dict[str | tuple[str], int] = {}
        self.chars = 0
        self.marks: dict[str, list[int]] = {}
        self.pool = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 12, np.int64)
        self.lens = np.zeros(1 << 12, np.int64)
        self.used = self.rows = 0

    def _model_ids(self, text: str) -> list[int]:
        mapped = text if text.isascii() else "".join(map(self.letters.__getitem__, text.encode()))
        return [t.id for t in self.model.tokenize(mapped)]

    def _mark_ids(self, marks: str) -> list[int]:
        if (ids := self.marks.get(marks)) is None:
            ids = self.marks[marks] = self._model_ids(marks) if marks else []
        return ids

    def _plain_ids(self, piece: str) -> list[int] | None:
        if not (match := _PLAIN.fullmatch(piece)):
            return None
        word, marks = match.groups()
        if not self.spaced:
            return (self._model_ids(word.lower()) if word else []) + self._mark_ids(marks)
        if not piece:
            return None
        if not word:
            return [t.id for t in self.model.tokenize(self.letters[32] + marks)]
        mapped = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
        return [t.id for t in self.model.tokenize(self.letters[32] + mapped)] + self._mark_ids(marks)

    def _add(self, keys: list, lens: list[int], ids: list[int]) -> None:
        """Keep the ids of these pieces, one piece's after another's."""
        end, rows = self.used + len(ids), self.rows + len(keys)
        if end > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(end, len(self.pool)), np.uint32)])
        if rows > len(self.starts):
            more = np.zeros(max(rows, len(self.starts)), np.int64)
            self.starts, self.lens = np.concatenate([self.starts, more]), np.concatenate([self.lens, more])
        self.pool[self.used : end] = ids
        self.lens[self.rows : rows] = lens
        self.starts[self.rows : rows] = self.used + np.cumsum(lens) - lens
        self.known.update(zip(keys, range(self.rows, rows), strict=True))
        self.rows, self.used = rows, end

    def _learn(self, new: list) -> None:
        """Encode the pieces of ``new``."""
        odd, keys, lens, flat = [], [], [], []
        words, tokenize, mark_ids = not self.spaced, self.model.tokenize, self._mark_ids
        for key in new:
            if type(key) is tuple:
                ids = None
                self.chars += len(key[0])
            elif len(key) > LONG_PIECE:
                ids = None
                self.chars += len(key)
            elif words and key.isascii() and (word := key.rstrip(_MARKS)).isalpha():
                ids = [t.id for t in tokenize(word.lower())]
                if len(word) < len(key):
                    ids += mark_ids(key[len(word) :])
            else:
                ids = self._plain_ids(key)
            if ids is None:
                odd.append(key)
            else:
                keys.append(key)
                lens.append(len(ids))
                flat += ids
        if odd:
            texts = [k[0] if type(k) is tuple else " " + k if self.spaced else k for k in odd]
            texts = [_LETTER_DIGIT.split(t) if self.spaced and len(t) > 4096 else [t] for t in texts]
            done = iter(self.tokenizer.encode_batch([p for t in texts for p in t], add_special_tokens=False))
            for key, parts in zip(odd, texts, strict=True):
                before = len(flat)
                for _ in parts:
                    flat += next(done).ids
                keys.append(key)
                lens.append(len(flat) - before)
        self._add(keys, lens, flat)

    def pieces(self, text: str) -> list:
        """Keys of the text's pieces, in order; together they are the whole text."""
        if not self.spaced:
            return [p for p in text.replace("\n", " ").split(" ") if p]
        if not text:
            return []
        parts = text.split(" ")
        if not parts[0] or _SPACE_AFTER_SPACE.search(text):
            cut = _CUT.split(text)
            parts = [cut[0]] + [p[1:] for p in cut[1:]]
        return [(parts[0],), *parts[1:]]

    def rows_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The memo's row of each piece of the texts, and each text's number of pieces."""
        if self.rows >= self.most or self.chars >= MEMO_CHARS:
            self.clear()
        flat: list = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            before = len(flat)
            flat += self.pieces(text)
            counts[i] = len(flat) - before
        if new := set(flat).difference(self.known):
            self._learn(list(new))
        rows = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        return rows, counts

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        rows, counts = self.rows_of(texts)
        total = np.concatenate([[0], np.cumsum(self.lens[rows])])
        ends = np.cumsum(counts)
        return total[ends] - total[ends - counts]

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and each text's number of ids."""
        rows, counts = self.rows_of(texts)
        lens = self.lens[rows]
        total = np.concatenate([[0], np.cumsum(lens)])
        at = np.repeat(self.starts[rows] - total[:-1], lens) + np.arange(total[-1])
        ends = np.cumsum(counts)
        return self.pool[at], total[ends] - total[ends - counts]


def worker_encoder(path: str, spaced: bool) -> PieceEncoder:
    """This Python worker's encoder for the vocabulary; its tasks share it and its bounded memo."""
    key = ("pieces", path, spaced)
    common.trim(keep=key)
    return common.held(key, lambda: PieceEncoder(path, spaced))
