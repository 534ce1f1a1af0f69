"""Word-wise tables of a word-end BPE tokenizer (tokenizers library), shared by token output and token counts.

The tokenizer lower-cases, drops white space and never joins across it, so what stands between two blanks or line
feeds is encoded on its own. A worker therefore keeps a bounded table of the words it has met and their results in flat
arrays, and a batch of texts is a gather from these. Words that hold a special token's string, or characters for which
Python's and the library's normal forms might differ, go through the library's full encode.
"""

from __future__ import annotations

import unicodedata
from itertools import chain

import numpy as np
import regex
from tokenizers import Tokenizer

#: Words kept by a worker, and characters in them; when full, the table starts anew.
MAX_WORDS, MAX_CHARS = 600_000, 16_000_000
#: Short pieces kept besides.
SHORT_PIECES = 50_000
#: The pre-tokenizer's pattern.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_PLAIN = regex.compile(r"[\x21-ɏ]*")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes stand for
    themselves, the others follow from U+0100 in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


_SYMBOLS = byte_symbols()


def symbols(piece: str) -> str:
    """A piece in byte-level characters."""
    return piece if piece.isascii() and piece.isprintable() else "".join(_SYMBOLS[b] for b in piece.encode())


def blanks(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ")


class _Ids(dict):
    """The index of each known word; a missing word is made and gets the next index."""

    def __init__(self, owner: WordTable):
        self.owner = owner

    def __missing__(self, word: str) -> int:
        self.owner.new.append(self.owner.make(word))
        self.owner.held += len(word)
        self[word] = at = len(self)
        return at


class WordTable:
    """Maps words to runs of numbers in flat arrays. ``make(word)`` gives a word's run."""

    def __init__(self, make, dtype, max_words: int = MAX_WORDS):
        self.make, self.dtype, self.max_words = make, dtype, max_words
        self.clear()

    def clear(self) -> None:
        self.ids, self.new, self.held = _Ids(self), [], 0
        self.starts, self.lens = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, self.dtype)

    def look_up(self, words: list[str]) -> np.ndarray:
        """The index of each word; what is missing is made."""
        if len(self.ids) > self.max_words or self.held > MAX_CHARS:
            self.clear()
        at = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        if self.new:
            lens = np.fromiter(map(len, self.new), np.int64, len(self.new))
            run = np.fromiter(chain.from_iterable(self.new), self.dtype, int(lens.sum()))
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(lens) - lens])
            self.lens, self.pool, self.new = np.concatenate([self.lens, lens]), np.concatenate([self.pool, run]), []
        return at

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs of these words one after another, and each run's length."""
        lens = self.lens[at]
        ends = np.cumsum(lens)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[at] - (ends - lens), lens)
        return self.pool[place], lens


class Encoder:
    """ids of a word, as the library gives them."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces: dict[str, tuple[int, ...]] = {}

    def plain(self, word: str) -> bool:
        """Whether lower() and PIECE split the word as the library does."""
        return (word.isascii() and word.isprintable() and "<|" not in word) or bool(_PLAIN.fullmatch(word) and unicodedata.is_normalized("NFC", word) and not any(s in word for s in self.special))

    def split(self, word: str) -> list[str] | None:
        """The word's pieces as the pre-tokenizer cuts them; None if only the library can tell."""
        if word.isascii():
            if word.isalpha():
                return [word.lower()]
            if word[:-1].isalpha() and word[-1] in ".,":
                return [word[:-1].lower(), word[-1]]
        return PIECE.findall(word.lower()) if self.plain(word) else None

    def ids(self, word: str) -> tuple[int, ...]:
        pieces = self.split(word)
        if pieces is None:
            return tuple(self.tokenizer.encode(word, add_special_tokens=False).ids)
        got = [self.piece(p) for p in pieces]
        return got[0] if len(got) == 1 else tuple(chain.from_iterable(got))

    def piece(self, piece: str) -> tuple[int, ...]:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = tuple([t.id for t in self.model.tokenize(symbols(piece))])
            if len(piece) < 5 and len(self.pieces) < SHORT_PIECES:  # longer ones seldom come again in another word
                self.pieces[piece] = ids
        return ids
