"""What a word-end byte-pair vocabulary file says about cutting text into pieces."""

from __future__ import annotations

import json
import unicodedata

import regex

#: Values remembered by word, and by piece, in a Python worker; beyond it a memory starts anew.
REMEMBERED = 200_000
#: Longer words are worked out each time.
LONG_WORD = 40
_MARKS = ",.;:!?%&*$#"
_MARKS_BYTES = _MARKS.encode()


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself, or the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Merges, special strings and splitting rule of a tokenizer file.

    The rule lowers case, normalises to NFC and drops white space, so no piece and no
    special string crosses ASCII white space: words between it can be cut alone.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.end = spec["model"].get("end_of_word_suffix") or ""
        self.merges = spec["model"]["merges"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = regex.compile("|".join(map(regex.escape, self.specials)))
        self._split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self._letters = byte_letters()

    def symbols(self, piece: str) -> list[str]:
        """The initial symbols of a piece, the last one marked as the end of the word."""
        symbols = list(self.spelled(piece))
        symbols[-1] += self.end
        return symbols

    def spelled(self, piece: str) -> str:
        """The letters that stand for the bytes of a piece."""
        if piece.isascii() and piece.isprintable():  # such bytes stand for themselves
            return piece
        return "".join([self._letters[b] for b in piece.encode()])

    def _plain(self, text: str) -> list[str]:
        # Letter by letter: lower case does not depend on the neighbours here.
        lowered = "".join(map(str.lower, unicodedata.normalize("NFC", text)))
        return self._split.findall(lowered)

    def pieces(self, word: bytes) -> list[str]:
        """Pieces and special strings of a word without ASCII white space, in order."""
        if word.isalpha():  # ASCII letters
            return [word.lower().decode()]
        stem = word.rstrip(_MARKS_BYTES)
        if stem.isalpha():
            return [stem.lower().decode(), word[len(stem) :].decode()]
        text = word.decode()
        if text.isascii() or ("Σ" not in text and unicodedata.is_normalized("NFC", text)):
            lowered = text.lower()
            if lowered.isalpha():
                return [lowered]
            stem = lowered.rstrip(_MARKS)
            if stem.isalpha():
                return [stem, lowered[len(stem) :]]
        if "<" not in text or not self.specials:
            return self._plain(text)
        found, at = [], 0
        for match in self._special.finditer(text):
            found += [*self._plain(text[at : match.start()]), match[0]]
            at = match.end()
        return found + self._plain(text[at:])
