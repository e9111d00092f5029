"""Cutting texts into chunks that byte-level BPE encodes apart, each distinct one once per worker.

The pre-tokenizer's pattern always cuts before a space that a visible character follows,
and around a lone newline between visible characters. In texts whose white space is only
of these two kinds, the chunks between such cuts are found by str.split alone; all other
texts are cut by the pattern itself. No merge crosses a cut, so a text's ids are those of
its chunks in order. A worker keeps the ids of the chunks it has met in flat arrays; a text
is then encoded by one dictionary lookup per chunk and one vectorised gather.
"""

from __future__ import annotations

import gc
import os
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain, islice

import numpy as np
import regex

from sievelake.storage import worker_memory

#: Characters of texts encoded together, and pieces held at once of one very long text.
CHUNK_CHARS, CHUNK_PIECES = 1_000_000, 250_000
#: Distinct chunks a worker remembers; beyond it the memory starts anew, which costs time but changes nothing.
REMEMBERED = 1_000_000


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions start .. start + size - 1 of each run, in one array."""
    ends = np.cumsum(sizes, dtype=np.int64)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class _Slots(dict):
    """chunk, as split leaves it -> slot; a new one gets the next slot and is noted."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = slot = len(self)
        self.new.append(piece)
        return slot


class PieceCache:
    """Encodes texts by a function from distinct matches of the pattern to the ids of each.

    A key is a chunk without its leading space if it is split's, or a piece of the pattern
    after a mark that no split text can hold.
    """

    MARK = "\n\n"

    def __init__(self, pattern: str, encode: Callable[[list[str]], list[Sequence[int]]], remembered: int = REMEMBERED):
        self.find = regex.compile(pattern)
        self.encode_pieces, self.remembered = encode, remembered
        self._clear()

    def _clear(self) -> None:
        self.slots = _Slots()
        self.flat = np.empty(1 << 20, np.uint32)
        self.used, self.known = 0, 0
        self.start, self.size = np.empty(1 << 17, np.int32), np.empty(1 << 17, np.int32)

    def _cut(self, text: str) -> list[str]:
        if not text:
            return []
        if " ".join(text.split()) != text.replace("\n", " "):  # white space that is not one space or newline between visible characters
            return [self.MARK + piece for piece in self.find.findall(text)]
        chunks = text.replace("\n", " \n").split(" ")
        chunks[0] = self.MARK + chunks[0]
        return chunks

    def _pieces(self, key: str) -> list[str]:
        """The pattern's matches in a chunk; most are letters, or letters and one sign."""
        if key.isalpha():
            return [" " + key]
        if key[:-1].isalpha() and key[-1] in ".,;:!?":
            return [" " + key[:-1], key[-1]]
        return self.find.findall(key[2:] if key.startswith(self.MARK) else key if key.startswith("\n") else " " + key)

    def _learn(self) -> None:
        new = self.slots.new
        pieces = [self._pieces(key) for key in new]
        seen: dict[str, int] = {}
        order = np.array([seen.setdefault(p, len(seen)) for p in chain.from_iterable(pieces)], np.int64)
        found = self.encode_pieces(list(seen))
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))
        ids = flat[_ragged((np.cumsum(lengths) - lengths)[order], lengths[order])]
        ends = np.concatenate(([0], np.cumsum(lengths[order])))
        sizes = np.diff(ends[np.concatenate(([0], np.cumsum([len(p) for p in pieces], dtype=np.int64)))])
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
        while self.known + len(new) > len(self.start):
            self.start, self.size = (np.concatenate((x, np.empty_like(x))) for x in (self.start, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        self.size[self.known : self.known + len(new)] = sizes
        self.start[self.known : self.known + len(new)] = self.used + np.cumsum(sizes) - sizes
        self.used, self.known = self.used + len(ids), self.known + len(new)
        new.clear()

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, and how many ids lie before each piece's end."""
        if self.known > self.remembered:
            self._clear()
        slots = np.fromiter(map(self.slots.__getitem__, pieces), np.int32, len(pieces))
        if self.slots.new:
            collecting = gc.isenabled()
            gc.disable()  # the many short lists made here have no cycles to look for
            try:
                self._learn()
            finally:
                if collecting:
                    gc.enable()
        sizes = self.size[slots]
        return self.flat[_ragged(self.start[slots], sizes)], np.cumsum(sizes, dtype=np.int64)

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text in turn, as uint32; a null text has none."""
        waiting: list[list[str]] = []
        chars = 0
        for text in texts:
            text = text or ""
            if len(text) > CHUNK_CHARS:
                yield from self._flush(waiting)
                waiting, chars = [], 0
                found = (self.MARK + m.group() for m in self.find.finditer(text))
                parts = []
                while block := list(islice(found, CHUNK_PIECES)):
                    parts.append(self._ids(block)[0])
                yield np.concatenate(parts)
                continue
            waiting.append(self._cut(text))
            chars += len(text)
            if chars > CHUNK_CHARS:
                yield from self._flush(waiting)
                waiting, chars = [], 0
        yield from self._flush(waiting)

    def _flush(self, waiting: list[list[str]]) -> Iterator[np.ndarray]:
        if not waiting:
            return
        ids, ends = self._ids([piece for pieces in waiting for piece in pieces])
        upto = np.cumsum([len(pieces) for pieces in waiting])
        stops = np.concatenate(([0], ends))[upto]
        first = 0
        for stop in stops.tolist():
            yield ids[first:stop]
            first = stop


#: Scripts whose letters and digits have long been settled in Unicode; only in texts within them is the pattern matched here.
_SETTLED = regex.compile("[\\x00-\\u052f\\u2000-\\u206f\\u20ac\\u3040-\\u30ff\\u4e00-\\u9fa5\\uac00-\\ud7a3]*")


class LibraryEncoder:
    """Ids by a file of the tokenizers library that has a byte-level pre-tokenizer and no normalizer.

    The library's model encodes every distinct piece; texts with characters outside
    long-settled scripts, whose classes may differ between Unicode versions, go to the
    library whole, as do texts that hold the string of a token added to the vocabulary.
    """

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [token.content for token in self.library.get_added_tokens_decoder().values()]
        self.model = self.library.model
        # The byte-level alphabet: visible Latin-1 bytes stand for themselves, the others for characters from 256 on.
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        self.alphabet = {b: 256 + i for i, b in enumerate(hidden)}
        self.cache = PieceCache(pattern, self._encode_pieces)

    def _encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        tokenize = self.model.tokenize
        return [[token.id for token in tokenize(self._in_alphabet(p))] for p in pieces]

    def _in_alphabet(self, piece: str) -> str:
        if piece.isascii() and piece.isprintable():  # of these only the space is hidden
            return piece.replace(" ", "\u0120")
        return piece.encode().decode("latin-1").translate(self.alphabet)

    def _plain(self, text: str | None) -> bool:
        return not text or ((text.isascii() or _SETTLED.fullmatch(text) is not None) and not any(token in text for token in self.added))

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        settled = [self._plain(t) for t in texts]
        cut = self.cache.encode(t for t, plain in zip(texts, settled, strict=True) if plain)
        for text, plain in zip(texts, settled, strict=True):
            yield next(cut) if plain else np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


def library_encoder(path: str, pattern: str) -> LibraryEncoder:
    """The worker's encoder for a tokenizer file, kept from task to task."""
    return worker_memory(f"pieces of {path}", lambda: LibraryEncoder(path, pattern))
