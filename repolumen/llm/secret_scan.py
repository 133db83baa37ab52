"""Secrets in text: keyword prefilter, anchored patterns near hits, embedded checksums.

One Aho-Corasick pass over a text finds the keywords of all kinds. A pattern is then
tried at the places of its keyword only. Token formats that carry a checksum, a
header or a length of their own must also pass it.
"""

from __future__ import annotations

import base64
import binascii
import functools
import json
import re
import zlib
from collections.abc import Callable, Sequence

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolumen.llm.texts import with_text_columns

#: Kinds in the order in which spans of one start are listed. The first three are the base kinds.
KINDS = ("assign", "access", "hex", "hosting", "registry", "webtoken", "keyblock")
BASE = 3

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_HOSTING = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_REGISTRY = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_WEB = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)")
_WEB_RUN = re.compile(r"[A-Za-z0-9_-]*")
_BLOCK = re.compile(
    r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----", re.ASCII
)
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

#: Keyword in lower case, and the kinds whose pattern begins there.
KEYWORDS = {
    "password": "assign",
    "passwd": "assign",
    "secret": "assign",
    "token": "assign",
    "apikey": "assign",
    "api_key": "assign",
    "akia": "access",
    "ghp_": "hosting",
    "gho_": "hosting",
    "ghu_": "hosting",
    "ghs_": "hosting",
    "ghr_": "hosting",
    "npm_": "registry",
    "eyj": "webtoken",
    "-----begin": "keyblock",
}


def base62(value: int, width: int = 6) -> str:
    digits = ""
    while value:
        value, rest = divmod(value, 62)
        digits = _DIGITS[rest] + digits
    return digits.rjust(width, "0")


def _checksum_fits(match: re.Match) -> bool:
    """The last six characters are the CRC-32 of the thirty before, in base 62."""
    return base62(zlib.crc32(match[1].encode())) == match[2]


def _header_fits(match: re.Match) -> bool:
    """The first part is a JSON object that names an algorithm."""
    try:
        head = json.loads(base64.urlsafe_b64decode(match[1] + "=" * (-len(match[1]) % 4)))
    except (ValueError, binascii.Error):
        return False
    return isinstance(head, dict) and "alg" in head


def _length_fits(match: re.Match) -> bool:
    """The block decodes to a sequence whose stated length is its own."""
    try:
        data = base64.b64decode("".join(match[2].split()), validate=True)
    except (ValueError, binascii.Error):
        return False
    if data.startswith(b"openssh-key-v1\0"):
        return True
    if len(data) < 4 or data[0] != 0x30:
        return False
    if data[1] < 0x80:
        return len(data) == 2 + data[1]
    width = data[1] & 0x7F
    return len(data) == 2 + width + int.from_bytes(data[2 : 2 + width], "big")


#: Pattern and test of a kind. A match that fails the test still ends where it ends.
RULES: dict[str, tuple[re.Pattern, Callable[[re.Match], bool]]] = {
    "assign": (_ASSIGN, lambda m: len(m[2]) >= 12),
    "access": (_ACCESS, lambda m: len(m[0]) >= 18),
    "hosting": (_HOSTING, _checksum_fits),
    "registry": (_REGISTRY, _checksum_fits),
    "webtoken": (_WEB, _header_fits),
    "keyblock": (_BLOCK, _length_fits),
}


@functools.cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def find_secrets(text: str | None) -> list[tuple[int, int, int]]:
    """``(start, end, kind)`` in code points, by start, then kind; the end is exclusive."""
    if not text:
        return []
    lowered = text.encode().lower().decode()  # A-Z only, so places stay
    hits: dict[str, list[int]] = {}
    for last, (size, kind) in _automaton().iter(lowered):
        hits.setdefault(kind, []).append(last + 1 - size)
    spans = [(m.start(), m.end(), KINDS.index("hex")) for m in _HEX.finditer(text)]
    for kind, starts in hits.items():
        pattern, fits = RULES[kind]
        done = 0
        for start in sorted(starts):
            match = pattern.match(text, start) if start >= done else None
            if not match and kind == "webtoken" and start >= done:
                # What begins inside the same run of letters ends where it ends, and fails as well.
                done = _WEB_RUN.match(text, start).end()
            if match:
                done = match.end()
                if fits(match):
                    spans.append((start, done, KINDS.index(kind)))
    return sorted(spans, key=lambda s: (s[0], s[2], s[1]))


def masked(text: str | None, spans: Sequence[tuple[int, int, int]], mark: str = "[secret]") -> str | None:
    """The text with every stretch that spans cover replaced by ``mark``."""
    if not spans or text is None:
        return text
    out, at = [], 0
    for start, end, _ in spans:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


SPANS = "array<struct<start:int,end:int,kind:int>>"


def with_secrets(docs: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` with ``secrets``: the spans of all kinds, in order.

    Null and empty texts have none. Rows stay as many, repeated ones too; an empty
    table gives none; a column of that name is replaced.
    """

    def compute(texts):
        return [[[{"start": a, "end": b, "kind": k} for a, b, k in find_secrets(t)] for t in texts]]

    return with_text_columns(docs, "text", compute, f"secrets {SPANS}", keep)


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``[secret]``.

    All rows stay, repeated ones too, and so do all other columns, whatever their names.
    """

    def compute(texts):
        return [[masked(t, find_secrets(t)) for t in texts]]

    columns = docs.columns
    return with_text_columns(docs, "text", compute, "text string").select(*[F.col(f"`{c}`") for c in columns])


def span_list(secrets, base_only: bool = False):
    """``kind:start:end`` of the spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    chosen = F.filter(secrets, lambda s: s["kind"] < BASE) if base_only else secrets
    return F.array_join(
        F.transform(chosen, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ","
    )
