"""Query strings on the driver: the same token rules as for pages."""

from __future__ import annotations

import re
from dataclasses import dataclass

from paginal.functions import text as T

_MARKS = re.compile(T.MARKS.replace(r"\x{00}", r"\x00").replace(r"\x{064B}", "ً").replace(r"\x{065F}", "ٟ").replace(r"\x{06D6}", "ۖ").replace(r"\x{06ED}", "ۭ"))
_FOLD = str.maketrans(T.FOLD_FROM, T.FOLD_TO)
_PARTS = re.compile(rf"[^\x01-\x20{T.DELIMITERS}]+")

AND, OR = "and", "or"


@dataclass(frozen=True)
class Query:
    """Terms in order and how they combine; words: all tokens, the keyword too."""

    terms: tuple[str, ...]
    mode: str
    words: tuple[str, ...]
    line: str


def terms_of(line: str) -> list[str]:
    """Normalised tokens of a query line."""
    return _PARTS.findall(_MARKS.sub("", line).translate(_FOLD))


def parse(line: str) -> Query:
    """A token ``OR`` anywhere makes the whole query a disjunction; else all terms are needed."""
    words = terms_of(line)
    terms = tuple(w for w in words if w != "OR")
    return Query(terms, OR if len(terms) < len(words) else AND, tuple(words), line)


_BROWSER_SPACE = re.compile("[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), T.BROWSER_SPACE) + "]+")
#: Bytes of a query line that are read.
LINE_BYTES = 4095
# What is said instead of results.
NO_TOKENS, NO_RESULTS, TWO_NEEDED = "no tokens", "no results", "need at least two tokens"


def browser_terms(line: str) -> list[str]:
    """The words of a line as a browser takes them, as they are."""
    return [w for w in _BROWSER_SPACE.split(line) if w]


def read_line(raw: bytes) -> str:
    """The query in the first line of raw input: at most LINE_BYTES, without its line end."""
    line, end, _ = raw[:LINE_BYTES].partition(b"\n")
    return (line[:-1] if end and line.endswith(b"\r") else line).decode("utf-8", "replace")
