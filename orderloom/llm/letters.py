"""Letters and numbers as the tokenizer libraries know them.

Their Unicode tables are older than those of the regex module and, for case, newer
than Python's. The differences were found once, by comparing every code point with
both libraries, which agree with each other; tests compare them again.
"""

from __future__ import annotations

import re

import regex

#: Letters and numbers of the regex module that the libraries' \p{L} and \p{N} do not hold.
NEWER_LETTERS = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE "
    "11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 "
    "1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 "
    "1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
NEWER_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"
#: Code points that the libraries lower and Python does not, or to others: (first, last, lower form of the first).
NEWER_LOWER = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)


def _set(ranges: str) -> str:
    return "".join("-".join(rf"\U{int(x, 16):08X}" for x in r.split("-")) for r in ranges.split())


def pinned(pattern: str) -> str:
    """The pattern with \\p{L} and \\p{N} as the libraries know them, for regex.V1."""
    return pattern.replace(r"\p{L}", rf"[\p{{L}}--[{_set(NEWER_LETTERS)}]]").replace(r"\p{N}", rf"[\p{{N}}--[{_set(NEWER_NUMBERS)}]]")


#: Lower forms for str.translate; sigma is lowered without regard to its place.
LOWER = {ord("Σ"): "σ"} | {c: to + c - first for first, last, to in NEWER_LOWER for c in range(first, last + 1)}
#: What any text with a newer letter or number, or with such a capital, holds: one of few characters of the basic plane, tested by a table, or any beyond it.
_BASIC = re.compile("[" + _set(" ".join(r for r in NEWER_LETTERS.split() if len(r.split("-")[0]) == 4)) + "".join(chr(c) for c in LOWER if c < 0x10000) + "]")
_BEYOND = re.compile("[\U00010000-\U0010FFFF]")


def exotic(text: str) -> bool:
    """Whether the text may hold what the tables above are about."""
    return not text.isascii() and (_BASIC.search(text) is not None or _BEYOND.search(text) is not None)


class Splitter:
    """findall of a pattern of \\p{L} and \\p{N}; the plain pattern serves texts without the newer ones."""

    def __init__(self, pattern: str):
        self.plain = regex.compile(pattern).findall
        self.exact = regex.compile(pinned(pattern), regex.V1).findall

    def __call__(self, text: str) -> list[str]:
        return self.exact(text) if exotic(text) else self.plain(text)


def lowered(text: str) -> str:
    return (text.translate(LOWER) if exotic(text) else text).lower()
