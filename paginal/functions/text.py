"""Text functions: normalisation, tokens, light stemming, term hashes.

All but the hash are built-in expressions, so scans stay inside generated code.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# Fixed values of the text model: dropped marks, letter folding, delimiters, affixes.
MARKS = r"[\x{00}\x{064B}-\x{065F}\x{06D6}-\x{06ED}]"
FOLD_FROM, FOLD_TO = "آأإٱىة", "اااايه"
DELIMITERS = r""",.;:!?"'()\[\]{}\-_/\\+=*&%$#@<>"""
PREFIXES = ("وال", "فال", "بال", "كال", "لل", "ال", "و", "ف", "ب", "ك", "ل", "س")
SUFFIXES = ("هما", "كما", "كم", "هم", "هن", "كن", "ها", "نا", "ات", "ون", "ين", "ان", "ة", "ه", "ي")
STEM_BYTES = 4


def normalize(text: Column | str) -> Column:
    """Drops vowel marks and NUL, folds letter variants; nothing else changes.

    A text with none of them, found by one scan, stays as it is.
    """
    raw = _col(text)
    changed = F.translate(F.regexp_replace(raw, MARKS, ""), FOLD_FROM, FOLD_TO)
    return F.when(raw.rlike(MARKS[:-1] + FOLD_FROM + "]"), changed).otherwise(raw)


def tokens(text: Column | str) -> Column:
    """The terms of normalised text in order; positions are array indexes from 0."""
    return F.array_remove(F.split(normalize(text), rf"[\x{{01}}-\x{{20}}{DELIMITERS}]+"), "")


def raw_tokens(text: Column | str) -> Column:
    """The terms of text as it is; NUL parts terms here."""
    return F.array_remove(F.split(_col(text), rf"[\x{{00}}-\x{{20}}{DELIMITERS}]+"), "")


# The white space that parts words in a browser.
BROWSER_SPACE = r"\x{09}-\x{0D}\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def browser_words(text: Column | str) -> Column:
    """Words between white space as a browser has it: nothing is folded, marks part nothing."""
    return F.array_remove(F.split(_col(text), rf"[{BROWSER_SPACE}]+"), "")


def light_stem(term: Column | str) -> Column:
    """Takes off the first prefix, then the first suffix, that leave at least four bytes.

    Terms of four bytes and fewer stay as they are.
    """
    word = _col(term)
    # The first step's result passes through an array, so that it is worked out once.
    bare = F.array(_without(word, PREFIXES, at_start=True))
    both = F.transform(bare, lambda b: _without(b, SUFFIXES, at_start=False))
    return F.when(F.octet_length(word) <= STEM_BYTES, word).otherwise(F.element_at(both, 1))


def _without(word: Column, affixes: tuple[str, ...], at_start: bool) -> Column:
    out = word
    for affix in reversed(affixes):
        there = word.startswith(affix) if at_start else word.endswith(affix)
        fits = there & (F.octet_length(word) >= len(affix.encode()) + STEM_BYTES)
        rest = F.substr(word, F.lit(len(affix) + 1)) if at_start else F.left(word, F.length(word) - len(affix))
        out = F.when(fits, rest).otherwise(out)
    return out


# Fixed values of the term hash: 64-bit FNV-1a, then the 64-bit finalizer of murmur3.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
FINAL_1, FINAL_2, FINAL_SHIFT = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 33


#: Bytes of terms that are hashed at once; a longer term goes alone.
HASHED = 1 << 22


def hash64_values(terms: list[str], seed: int = 0) -> np.ndarray:
    """Unsigned hashes of terms, byte by byte over terms of like length at once."""
    raw = [t.encode() for t in terms]
    out = np.empty(len(raw), dtype=np.uint64)
    order = sorted(range(len(raw)), key=lambda k: -len(raw[k]))
    at = 0
    while at < len(order):
        # The longest term comes first, so a grid's width bounds the rows that fit.
        part = order[at : at + max(1, HASHED // max(1, len(raw[order[at]])))]
        out[part] = _hashed([raw[k] for k in part], seed)
        at += len(part)
    return out


def _hashed(raw: list[bytes], seed: int) -> np.ndarray:
    """Hashes of terms in descending order of length."""
    size = np.array([len(r) for r in raw], dtype=np.int64)
    width = int(size[0])
    grid = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raw), dtype=np.uint8).reshape(len(raw), width)
    h = np.full(len(raw), FNV_OFFSET ^ seed, dtype=np.uint64)
    live = np.searchsorted(-size, -np.arange(1, width + 1), side="right")
    for column, n in enumerate(live):
        h[:n] = (h[:n] ^ grid[:n, column].astype(np.uint64)) * np.uint64(FNV_PRIME)
    for factor in (FINAL_1, FINAL_2):
        h = (h ^ (h >> np.uint64(FINAL_SHIFT))) * np.uint64(factor)
    return h ^ (h >> np.uint64(FINAL_SHIFT))


def hash64_bits(term: Column | str, seed: int = 0) -> Column:
    """The bits of the 64-bit hash as a long; meant for distinct terms."""

    @F.pandas_udf(LongType())
    def run(terms: pd.Series) -> pd.Series:
        known = terms.notna().to_numpy()
        out = pd.Series(np.zeros(len(terms), dtype=np.int64), index=terms.index, dtype="Int64")
        out[known] = hash64_values(terms[known].tolist(), seed).view(np.int64)
        out[~known] = pd.NA
        return out

    return run(_col(term))


def unsigned(bits: Column | str) -> Column:
    """The unsigned number of a long's bits, as decimal(20,0)."""
    signed = _col(bits).cast("decimal(20,0)")
    return F.when(signed < 0, signed + F.lit(Decimal(1 << 64))).otherwise(signed).cast("decimal(20,0)")


def hash64(term: Column | str, seed: int = 0) -> Column:
    """The unsigned 64-bit hash as decimal(20,0); meant for distinct terms."""
    return unsigned(hash64_bits(term, seed))


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x
