"""Character tables shared by the text operators, built from Unicode properties."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

#: Letters of other scripts that look like a Latin letter, and that letter.
LOOKALIKES = {
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "α": "a", "γ": "y", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "а": "a", "в": "b", "г": "r", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "м": "m",
    "н": "h", "о": "o", "п": "n", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѵ": "v", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    # Armenian and Cherokee
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "Օ": "O", "Տ": "S", "Ꭺ": "A", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮖ": "I", "Ꮪ": "S", "Ꮯ": "C", "Ꭲ": "T",
}

#: Of these, the ones that also count where a word of one or two letters, or a part of an abbreviation, holds no other letter; small Greek letters are read as symbols there.
SOLO = "".join(c for c in LOOKALIKES if not "α" <= c <= "ω" or c == "ο")


@cache
def compatible() -> dict[str, str]:
    """Wide, narrow, styled, circled, small and ligature forms with the plain text they stand for; by decomposition, not by list."""
    out = {}
    for point in range(0x80, sys.maxunicode + 1):
        kind, _, rest = unicodedata.decomposition(chr(point)).partition("> ")
        if kind[1:] in ("wide", "narrow", "font", "circle", "small", "square", "vertical", "initial", "medial", "final", "isolated") or (kind == "<compat" and _ligature(chr(point))):
            if plain := unicodedata.normalize("NFKC", chr(point)):
                out[chr(point)] = plain
    return out


def _ligature(c: str) -> bool:
    return "LIGATURE" in unicodedata.name(c, "") or "DIGRAPH" in unicodedata.name(c, "") or 0x1C4 <= ord(c) <= 0x1F3


@cache
def invisible() -> str:
    """Format characters, fillers and variation selectors."""
    extra = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
    return "".join(chr(p) for p in range(0x80, sys.maxunicode + 1) if p in extra or unicodedata.category(chr(p)) == "Cf")


@cache
def spaces() -> str:
    """Every space and line separator other than U+0020."""
    return "".join(chr(p) for p in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(p)) in ("Zs", "Zl", "Zp"))


@cache
def _plain_table() -> dict[int, str | None]:
    table: dict[int, str | None] = {ord(k): v for k, v in compatible().items()}
    table |= {ord(c): None for c in invisible()} | {ord(c): " " for c in spaces()}
    return table


@cache
def _special() -> frozenset[str]:
    return frozenset([*compatible(), *invisible(), *spaces()])


_ALIKE = frozenset(LOOKALIKES)
_MIXED = re.compile(r"[^\W\d_]+")
_SHORT = re.compile(f"[{SOLO}]{{1,2}}")


def consistent(text: str) -> str:
    """The one form of a text, in Python, for operators that compare texts."""
    if text.isascii():
        return text
    text = unicodedata.normalize("NFC", text)
    used = set(text)  # few different characters: tables are asked for these alone
    if not _special().isdisjoint(used):
        text = unicodedata.normalize("NFC", text.translate(_plain_table()))
        used = set(text)
    if _ALIKE.isdisjoint(used):
        return text

    def latin(match: re.Match) -> str:
        word = match.group()
        if not any(c in LOOKALIKES for c in word) or not (_SHORT.fullmatch(word) or any("a" <= c.lower() <= "z" or "À" <= c <= "ɏ" for c in word)):
            return word
        return "".join(LOOKALIKES.get(c, c) for c in word)

    return unicodedata.normalize("NFC", _MIXED.sub(latin, text))


@cache
def _accents() -> dict[int, str]:
    """Every letter whose decomposition begins with another letter, by that letter; lone accents go."""
    table = {}
    for point in range(0xC0, 0x2000):
        c = chr(point)
        if unicodedata.combining(c):
            table[point] = ""
        elif (d := unicodedata.normalize("NFD", c)) != c:
            table[point] = "".join(x for x in d if not unicodedata.combining(x))
    return table


def bare(text: str) -> str:
    """Consistent form without case and accents."""
    if text.isascii():
        return text.lower()
    text, table = consistent(text).casefold(), _accents()
    for c in set(text):
        if c > "\x7f" and (plain := table.get(ord(c))) is not None:
            text = text.replace(c, plain)
    return text


_WORD = re.compile(r"[^\W_]+")
_BLANK = {p: " " for p in range(128) if not chr(p).isalnum()}


def words(text: str) -> list[str]:
    """Runs of letters and digits of the bare form."""
    text = bare(text)
    if not text.isascii():
        for c in set(text):
            if c > "\x7f" and not c.isalnum():
                text = text.replace(c, " ")
        if not text.isascii():
            return _WORD.findall(text)
    return text.translate(_BLANK).split()
