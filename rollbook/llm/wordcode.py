"""Word-end BPE layout shared by the BPE and the token-file operators.

The layout: NFC, white space to one space, lower case; words split by one
pattern; bytes spelt in a printable alphabet; the last symbol of each word
carries ``</w>``. No word crosses white space, so a text's ids are the ids of
its white-space-free pieces put together, and pieces can be remembered.
"""

from __future__ import annotations

import json
import re
from array import array
from codecs import charmap_decode
from collections.abc import Callable
from unicodedata import is_normalized, normalize

import regex

# Fixed values of the tokenizer file's format: its word pattern and Unicode's white space.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
WORD_END = "</w>"
ENTRY = 190  # bytes that an entry of a dictionary takes besides its letters and ids
# The same word pattern where all letters are ASCII and lower-case.
ASCII_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+"
_CONTROL = re.compile(r"[\x00-\x20]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def read_vocabulary(path: str) -> str:
    """The tokenizer file as text, a few MB whatever the corpus; it is shipped to the tasks as a broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from 256."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


class Vocabulary:
    def __init__(self, text: str):
        spec = json.loads(text)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.merges: list[tuple[str, str]] = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [""] * (max([*self.ids.values(), *self.special.values()]) + 1)
        for s, i in [*self.ids.items(), *self.special.items()]:
            self.strings[i] = s


class PieceCoder:
    """Ids of whole texts from a function that codes one word, given in the byte alphabet.

    Remembers pieces, and words as pieces, as they have the same ids wherever
    they stand, in two generations of about ``room`` bytes each: when the
    young one is full it becomes the old one, and what is met again moves to
    the young. Words that might look like a special token are kept apart, in an
    eighth of that. Frequent words stay, and memory is bounded whatever the
    vocabulary of the corpus.
    """

    def __init__(self, vocabulary: Vocabulary, code_word: Callable[[str], list[int]], room: int = 64 << 20):
        self.special = vocabulary.special
        self.code_word, self.room = code_word, room
        self.words_left, self.pieces_left = room // 8, room
        self.letters = "".join(byte_alphabet())
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}
        self.word_pattern = regex.compile(WORDS)
        self.ascii_words = re.compile(ASCII_WORDS)
        self.space = regex.compile(SPACE)
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _coded(self, word: str) -> bytes:
        if not (word.isascii() and word.isalnum()):
            word = charmap_decode(word.encode("utf-8", "replace"), "strict", self.letters)[0]
        return array("I", self.code_word(word)).tobytes()

    def _word(self, word: str) -> bytes:
        if "<" in word:
            return self._apart(word)
        got = self.pieces.get(word)
        if got is None:
            got = self.old_pieces.get(word)
            if got is None:
                got = self._coded(word)
            if len(word) < 64:
                self.pieces_left -= ENTRY + len(word) + len(got)
                if self.pieces_left < 0:
                    self.old_pieces, self.pieces, self.pieces_left = self.pieces, {}, self.room
                self.pieces[word] = got
        return got

    def _apart(self, word: str) -> bytes:
        got = self.words.get(word)
        if got is None:
            got = self.old_words.get(word)
            if got is None:
                got = self._coded(word)
            if len(word) < 64:
                self.words_left -= ENTRY + len(word) + len(got)
                if self.words_left < 0:
                    self.old_words, self.words, self.words_left = self.words, {}, self.room // 8
                self.words[word] = got
        return got

    def _plain(self, piece: str) -> bytes:
        if piece.isascii():
            low = piece.lower()
            if not low.isalpha():
                return b"".join(map(self._word, (self.word_pattern if _CONTROL.search(low) else self.ascii_words).findall(low)))
            if low == piece:
                return array("I", self.code_word(piece)).tobytes()
            return self._word(low)
        if not is_normalized("NFC", piece):
            piece = normalize("NFC", piece)
        # each letter is lower-cased on its own: no final sigma
        low = piece.replace("Σ", "σ").lower()
        if low.isalpha():
            return self._coded(low) if low == piece else self._word(low)
        return b"".join(map(self._word, self.word_pattern.findall(low)))

    def _piece(self, piece: str) -> bytes:
        got = self.old_pieces.get(piece)
        if got is None:
            if self.cut_special and "<" in piece:
                got = b"".join(array("I", [self.special[x]]).tobytes() if x in self.special else self._plain(x) for x in self.cut_special.split(piece) if x)
            else:
                got = self._plain(piece)
        if len(piece) < 64:
            self.pieces_left -= ENTRY + len(piece) + len(got)
            if self.pieces_left < 0:
                self.old_pieces, self.pieces, self.pieces_left = self.pieces, {}, self.room
            self.pieces[piece] = got
        return got

    def encode(self, text: str | None) -> bytes:
        """The ids as native unsigned 32-bit integers; null and empty texts have none."""
        if not text:
            return b""
        # str.split also splits at four control characters that are not white space here
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            pieces = [p for p in self.space.split(text) if p]
        else:
            pieces = text.split()
        known = self.pieces.get
        return b"".join([known(p) or self._piece(p) for p in pieces])
