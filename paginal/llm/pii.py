"""Personal data: fixed patterns, and a linear-chain conditional random field.

The patterns find e-mail addresses, IP addresses, payment cards and phone
numbers in international form.  The field adds what they miss: phone numbers
in local form, national ids, numbers of documents and bank accounts, dates of
birth, secrets, names and addresses that are introduced as such.  Its features
are word shapes, character classes, neighbouring words and the kind of the
last word that announces personal data; it is trained on the small labelled
table of ``pii_table`` (log likelihood, L2 penalty, AdaGrad, forward-backward
in numpy batches) once on the driver, sent to the workers, and decoded by
Viterbi in numpy batches.

Every token of every line is labelled, a line as one chain; pattern spans stand
in it as tokens that have no label.  A token's score is a sum of rows of small
tables, one for each of its roles (itself, neighbours, last cue).  Where no
label can win whatever the neighbours are labelled, which is proved from the
moves' weights, the token has none; Viterbi runs over all the others, between
these, with the same result as over the whole line.

Defined results
---------------
* A null text counts as empty and has no spans.
* Patterns match leftmost and without overlap within a kind; kinds may overlap
  each other.  Spans of the field never overlap pattern spans.
* Positions are code points, ends exclusive; spans sort by kind in the order
  of ``KINDS``, then start.
* Texts are read whole and labelled whole, lines of any length too, in time in proportion to
  the text; a shape tells words apart by 64 characters.
* Spans of the field hold a digit, but for names and secrets, which hold a letter or a digit.
* Repeated rows have equal spans; an empty table gives an empty result.
* ``find`` replaces columns named spans; ``redact`` keeps every row and all columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paginal.llm import pii_table
from paginal.llm.common import small_batches, spare_name

Span = tuple[str, int, int]

BASE = ("email", "ip", "card", "phone")
ADDED = ("phone_local", "national_id", "document_id", "birth_date", "iban", "secret", "person", "address")
KINDS = (*BASE, *ADDED)

_DIGIT = re.compile("[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# A failed or finished match always covers a run of digits to its end, so none starts inside one.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")


def _emails(text: str) -> list[Span]:
    out: list[Span] = []
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        got = _DOMAIN.match(text, at + 1) if start < at else None
        if got:
            last = got.end()
            out.append(("email", start, last))
        at = text.find("@", max(at + 1, last))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str | None) -> list[Span]:
    """The pattern spans of a text, by kind, then start."""
    if not text:
        return []
    out = _emails(text)
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0]) if m.end() - m.start() <= 40 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


#: Tokens in a list of ``chains`` at most; tokens over which a cue reaches.
LONGEST, REACH = 1024, 6
#: Tokens scored at a time; characters cut into tokens at a time; distinct tokens kept, and rows.
SLICE, STRETCH, HELD, ROWS = 1 << 16, 1 << 18, 1 << 18, 1 << 15
#: Words that announce personal data, by kind.
CUES = {
    "phone": "call tel phone telephone telefon mobile cell fax reach number text dial nummer handynummer handy ruf rufen anrufen appelez téléphone portable joignable numéro llámame teléfono móvil número contact line",
    "id": "ssn social security id identity dni nif steuer-id steuer-identifikationsnummer steueridentifikationsnummer sozialversicherungsnummer nir sécurité sociale identidad identité",
    "document": "passport license licence permit reisepass ausweisnummer ausweis führerschein passeport carte permis pasaporte carné licencia",
    "birth": "born birth dob birthday birthdate geboren geburtsdatum geburtstag née né naissance nacido nacida nacimiento",
    "bank": "iban account konto kontonummer überweisen compte virement cuenta pay transfer transferir",
    "secret": "password passwort kennwort pin key api_key apikey token secret client_secret secret_key access_key bearer auth passe contraseña clave clé pass passwd pwd passphrase credential schlüssel",
    "person": "name named mr mrs ms miss dr dear signed heiße heisse herr herrn frau appelle madame monsieur nom llamo llama señor señora nombre surname vorname nachname prénom apellido",
    "address": "lives living address adresse anschrift wohnt wohnhaft habite dirección vive domicilio residing resides",
}
_KIND_OF = {word: kind for kind, words in CUES.items() for word in words.split()}
_STREET = tuple("street road avenue lane st straße strasse weg gasse platz allee rue place calle avenida plaza boulevard drive".split())
_MONTH = re.compile(r"(?:jan|feb|mar|mär|apr|avr|abr|may|mai|jun|jui|jul|aug|aoû|ago|sep|oct|okt|nov|dec|dez|déc|dic|ene|fév)[a-zûä]*\Z")
#: A token; the end of a line counts as one.
_PART = re.compile(r"[^\s,;:=\"'<>|()\[\]{}!?`*&$#%]+|[:=()\n]")
_BETWEEN = re.compile(r"[\s,;:=\"'<>|()\[\]{}!?`*&$#%]")


@dataclass
class Token:
    start: int
    end: int
    core: str


def windows(text: str) -> Iterator[tuple[int, int]]:
    """The lines that are not blank."""
    at = 0
    for line in text.split("\n"):
        if line and not line.isspace():
            yield at, at + len(line)
        at += len(line) + 1


def blocks(taken: list[Span]) -> list[tuple[int, int, str]]:
    """Taken spans as (start, end, token); overlapping ones are one, of the first kind."""
    out: list[tuple[int, int, str]] = []
    for s, e, kind in sorted((s, e, k) for k, s, e in taken):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]), out[-1][2])
        else:
            out.append((s, e, f"<{kind}>"))
    return out


def chains(text: str, taken: list[Span]) -> Iterator[list[Token]]:
    """The tokens of each line, cut at taken spans, which stand as one token each; at most ``LONGEST`` in a list."""
    blocked = blocks(taken)
    b = 0
    for first, stop in windows(text):
        while b < len(blocked) and blocked[b][1] <= first:
            b += 1
        run: list[Token] = []
        at, k = first, b
        while at < stop:
            inside = k < len(blocked) and blocked[k][0] < stop
            edge = max(blocked[k][0], at) if inside else stop
            for m in _PART.finditer(text, at, edge):
                core = m[0].rstrip(".") or m[0]
                run.append(Token(m.start(), m.start() + len(core), core))
            if inside:
                run.append(Token(edge, edge, blocked[k][2]))
                edge = blocked[k][1]
                k += 1
            at = edge
        for k in range(0, len(run), LONGEST):
            yield run[k : k + LONGEST]


def stretches(text: str, taken: list[Span]) -> Iterator[tuple[int, int, str]]:
    """The whole text outside taken spans, in order, as (start, end, token of the span that follows, if one does)."""
    at = 0
    for s, e, token in [*blocks(taken), (len(text), len(text), "")]:
        while s - at > STRETCH and (m := _BETWEEN.search(text, at + STRETCH, s)):
            yield at, m.start(), ""
            at = m.start()
        yield at, s, token
        at = e


class _Classes(dict):
    """From code points to d for digits, x or X for letters, others as they are."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = out = "d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c
        return out


_CLASS = _Classes()
_RUN = re.compile(r"(.)\1{5,}", re.DOTALL)


@lru_cache(maxsize=1 << 14)
def _short(marks: str) -> str:
    return _RUN.sub(r"\1\1\1\1\1", marks)


def shape(word: str) -> str:
    """Digits as d, letters as x or X, others as they are; runs of over four are cut to five."""
    return _short(word[:64].translate(_CLASS))


_HEX = re.compile(r"[0-9a-fA-F]+\Z")
_KEYED = re.compile(r"[A-Za-z0-9_+/=.-]+\Z")
_ACCOUNT = re.compile(r"[A-Z]{2}[0-9]{2}(?:[0-9A-Z]{4,30})?\Z")


def _own(core: str) -> tuple[str, str, str, list[str]]:
    """(shape, word, mix of characters, further features) of a token by itself."""
    n, low = len(core), core.lower()
    letters = n if core.isalpha() else sum(c.isalpha() for c in core)
    digits = 0 if letters == n else sum(c.isdigit() for c in core)
    size = "0" if n < 3 else "3" if n < 5 else "5" if n < 8 else "8" if n < 16 else "16" if n < 24 else "24"
    mix = "digits" if digits == n else "none" if not digits else "letters" if letters else "marks"
    if mix == "none":
        mix = "mark" if not letters else "capital" if core[0].isupper() else "word"
    word = low if letters == n and n <= 16 else "#"
    out = [f"size={size},mix={mix}"]
    if n >= 20 and _HEX.match(core) and letters and digits:
        out.append("hex")
    elif n >= 16 and letters and digits >= 3 and _KEYED.match(core):
        out.append("key")
    elif letters and digits and any(c.isupper() for c in core) and any(c.islower() for c in core):
        out.append("motley")
    if _ACCOUNT.match(core):
        out.append("account")
    if letters and low.endswith(_STREET):
        out.append("street")
    if letters and _MONTH.match(low):
        out.append("month")
    if letters == n and n > 3:
        out.append(f"tail={low[-3:]}")
    return shape(core), word, mix, out


def features(run: list[Token]) -> list[list[str]]:
    """The names of what holds for each token of a chain."""
    own = [_own(t.core) for t in run]
    out = []
    cue, since = "none", REACH + 1
    none = ("none", "none", "none", [])
    for k, (form, word, mix, more) in enumerate(own):
        since += 1
        told = cue if since <= REACH else "none"
        before, after = own[k - 1] if k else none, own[k + 1] if k + 1 < len(own) else none
        before2, after2 = own[k - 2] if k > 1 else none, own[k + 2] if k + 2 < len(own) else none
        out.append([
            "bias", f"shape={form}", f"word={word}", f"mix={mix}", f"cue={told}", f"cue={told},mix={mix}", f"cue={told},shape={form}",
            f"cue={told},near={since <= 2}", f"prev={before[0]}", f"prevword={before[1]}", f"next={after[0]}", f"nextword={after[1]}",
            f"prev2={before2[0]}", f"next2={after2[2]}", f"mixes={before[2]},{mix},{after[2]}", *more, *(f"cue={told},{m}" for m in more[1:] if "=" not in m),
        ])
        found = _KIND_OF.get(run[k].core.lower())
        if found:
            cue, since = found, 0
    return out


LABELS = ("", *ADDED)
EPOCHS, STEP, PENALTY = 60, 0.5, 0.02


MIXES = ("none", "digits", "letters", "marks", "mark", "capital", "word")
TOLD = ("none", *CUES)


class Lexicon(dict):
    """From tokens to rows of tables that hold their scores in each of their roles.

    Tokens which the field cannot tell apart share a row.  Row 0 is what lies
    beyond the ends of a line.
    """

    def __init__(self, index: dict[str, int], weights: np.ndarray) -> None:
        super().__init__({"\n": 0})
        self.index, self.weights = index, weights
        split = [f.partition("=") for f in index]
        self.forms = {v for name, _, v in split if name in ("shape", "prev", "next", "prev2")} | {f.partition(",shape=")[2] for f in index if f.startswith("cue=")}
        self.words = {v for name, _, v in split if name in ("word", "prevword", "nextword")}
        self.keys_seen: dict[tuple, int] = {}
        #: By row: itself after each cue, before and after its neighbours, two before and two after; its mix and cue.
        self.parts: tuple[list, ...] = ([], [], [], [], [], [], [])
        self._add("none", "none", "none", (), "none")
        self.stacked: tuple[np.ndarray, ...] = ()
        self.cue = np.array([self._sum(f"cue={c}", f"cue={c},near={near}") for c in TOLD for near in (False, True)])
        self.mixes = np.array([self._sum(f"mixes={a},{b},{c}") for a in MIXES for b in MIXES for c in MIXES])

    def _sum(self, *names: str) -> np.ndarray:
        return self.weights[[i for f in names if (i := self.index.get(f)) is not None]].sum(axis=0)

    def _add(self, form: str, word: str, mix: str, more: tuple[str, ...], kind: str) -> None:
        own = self._sum("bias", f"shape={form}", f"word={word}", f"mix={mix}", *more)
        marks = [m for m in more if "=" not in m]
        told = np.array([own + self._sum(f"cue={c},mix={mix}", f"cue={c},shape={form}", *(f"cue={c},{m}" for m in marks)) for c in TOLD])
        sums = (self._sum(f"prev={form}", f"prevword={word}"), self._sum(f"next={form}", f"nextword={word}"), self._sum(f"prev2={form}"), self._sum(f"next2={mix}"))
        for part, new in zip(self.parts, (told, *sums, MIXES.index(mix), TOLD.index(kind))):
            part.append(new)

    def __missing__(self, token: str) -> int:
        core = token.rstrip(".") or token
        form, word, mix, more = _own(core)
        known = tuple([m for m in more if "=" not in m or m in self.index])
        key = (form if form in self.forms else "", word if word in self.words else "", mix, known, _KIND_OF.get(core.lower(), "none"))
        row = self.keys_seen.get(key)
        if row is None:
            self._add(*key)
            row = self.keys_seen[key] = len(self.parts[0]) - 1
        if len(self) >= HELD:
            self.clear()
            self["\n"] = 0
        if len(token) <= 64:
            self[token] = row
        return row

    def rows(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.int32, len(tokens))

    def tables(self) -> tuple[np.ndarray, ...]:
        if not self.stacked or len(self.stacked[0]) != len(self.parts[0]):
            self.stacked = tuple(map(np.array, self.parts))
        return self.stacked

    def told(self, rows: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Twice the cue that reaches each of a range of tokens, and one more if it is near."""
        a = max(lo - REACH, 0)
        cue = self.tables()[6][rows[a:hi]]
        at = np.arange(hi - a)
        last = np.maximum.accumulate(np.where((cue > 0) | (rows[a:hi] == 0), at, 0))[lo - a - 1 : -1]
        since = at[lo - a :] - last
        got = np.where(since <= REACH, cue[last], 0)
        return 2 * got + ((since <= 2) & (got > 0))

    def scores(self, rows: np.ndarray, told: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The scores of the tokens at some places (places x labels)."""
        itself, before, after, before2, after2, mix, _ = self.tables()
        here, left, right, cue = rows[at], rows[at - 1], rows[at + 1], told[at].astype(np.int64)
        # Beyond the end of a line lies nothing of the next.
        left2, right2 = np.where(left, rows[at - 2], 0), np.where(right, rows[at + 2], 0)
        out = itself.reshape(-1, itself.shape[2]).take(here * np.int64(len(TOLD)) + cue // 2, axis=0)
        out += self.cue.take(cue, axis=0)
        for table, role in ((before, left), (after, right), (before2, left2), (after2, right2)):
            out += table.take(role, axis=0)
        out += self.mixes.take((mix[left] * len(MIXES) + mix[here]) * len(MIXES) + mix[right], axis=0)
        return out


@dataclass
class Field:
    """Feature index, weights (features x labels), transitions, and those from and to the ends."""

    index: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def emissions(self, run: list[Token]) -> np.ndarray:
        get = self.index.get
        known = [[i for f in names if (i := get(f)) is not None] for names in features(run)]
        size = np.fromiter(map(len, known), dtype=np.int64, count=len(known))
        flat = np.fromiter((i for names in known for i in names), dtype=np.int64, count=int(size.sum()))
        # Every token has at least its bias.
        return np.add.reduceat(self.weights[flat], np.cumsum(size) - size, axis=0)

    def lexicon(self) -> Lexicon:
        """The field's lexicon, kept between calls while it is small."""
        held = self.__dict__.get("_lexicon")
        if held is None or len(held.keys_seen) > ROWS:
            held = self.__dict__["_lexicon"] = Lexicon(self.index, self.weights)
        return held

    def __getstate__(self) -> dict:
        return {name: value for name, value in self.__dict__.items() if name != "_lexicon"}

    def decode(self, chains: list[list[Token]]) -> list[np.ndarray]:
        """The best labels of each run."""
        lexicon = self.lexicon()
        rows = [lexicon.rows(["\n", *(t.core for t in run)]) for run in chains]
        labels = self.labels(lexicon, np.concatenate([np.zeros(1, np.int32), *rows, np.zeros(2, np.int32)]))
        ends = 1 + np.cumsum([len(r) for r in rows], dtype=np.int64)
        return [labels[end - len(run) : end] for run, end in zip(chains, ends)]

    def needed(self) -> np.ndarray:
        """By how much having no label must beat each label at a token to win whatever lies beside it."""
        to = np.vstack([self.moves, self.first])
        onward = np.column_stack([self.moves, self.last])
        return ((to - to[:, :1]).max(axis=0) + (onward - onward[0]).max(axis=1))[1:] + 1e-6

    def labels(self, lexicon: Lexicon, rows: np.ndarray) -> np.ndarray:
        """The best labels of lines of tokens; a row 0 lies between two lines, two at both ends of all."""
        told = np.zeros(len(rows), np.int8)
        open_ = np.zeros(len(rows), bool)
        needed = self.needed()
        for lo in range(2, len(rows) - 2, SLICE):
            hi = min(lo + SLICE, len(rows) - 2)
            told[lo:hi] = lexicon.told(rows, lo, hi)
            score = lexicon.scores(rows, told, np.arange(lo, hi))
            open_[lo:hi] = (score[:, :1] - score[:, 1:] <= needed).any(axis=1) & (rows[lo:hi] != 0)
        out = np.zeros(len(rows), np.int8)
        start, stop = np.flatnonzero(open_[1:] & ~open_[:-1]) + 1, np.flatnonzero(open_[:-1] & ~open_[1:]) + 1
        order = np.argsort(stop - start, kind="stable")
        start, size = start[order], (stop - start)[order]
        at = 0
        while at < len(size):
            # Runs of similar length share padded batches of at most about 64k cells.
            end = at + 1
            while end < len(size) and (end + 1 - at) * size[end] <= SLICE:
                end += 1
            self._viterbi(lexicon, rows, told, start[at:end], size[at:end], out)
            at = end
        return out

    def _viterbi(self, lexicon: Lexicon, rows: np.ndarray, told: np.ndarray, start: np.ndarray, size: np.ndarray, out: np.ndarray) -> None:
        """Labels runs of tokens between ends of lines and tokens without a label."""
        n, width, k = len(start), int(size.max()), len(LABELS)
        after = np.where(rows[start + size][:, None] == 0, self.last, self.moves[:, 0])
        best = np.where(rows[start - 1][:, None] == 0, self.first, self.moves[0])
        back = np.zeros((width, n, k), dtype=np.int8)
        step = max(SLICE // n, 1)
        for t in range(width):
            if t % step == 0:
                places = np.minimum(start[:, None] + np.arange(t, min(t + step, width)), (start + size - 1)[:, None])
                score = lexicon.scores(rows, told, places.ravel()).reshape(n, -1, k)
            if t == 0:
                best = best + score[:, 0]
                continue
            paths = best[:, :, None] + self.moves[None]
            back[t] = paths.argmax(axis=1)
            best = np.where((t < size)[:, None], paths.max(axis=1) + score[:, t % step], best)
        label = (best + after).argmax(axis=1)
        for t in range(width - 1, -1, -1):
            live = t < size
            out[start[live] + t] = label[live]
            label = np.where(live & (t > 0), back[t, np.arange(n), label], label)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def expectations(e: np.ndarray, size: np.ndarray, f: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over padded chains: P(label) of each cell, summed P(move), log of each chain's total."""
    n, width, k = e.shape
    ahead, behind = np.zeros((n, width, k)), np.zeros((n, width, k))
    ahead[:, 0] = e[:, 0] + f.first
    for t in range(1, width):
        ahead[:, t] = _log_sum(ahead[:, t - 1, :, None] + f.moves, 1) + e[:, t]
    for t in range(width - 1, -1, -1):
        last = (t == size - 1)[:, None]
        going = _log_sum(f.moves[None] + (e[:, t + 1] + behind[:, t + 1])[:, None, :], 2) if t + 1 < width else 0.0
        behind[:, t] = np.where(last, f.last, going)
    z = _log_sum(ahead[np.arange(n), size - 1] + f.last, 1)
    live = np.arange(width) < size[:, None]
    cells = np.where(live[:, :, None], np.exp(np.minimum(ahead + behind - z[:, None, None], 0)), 0)
    moves = np.zeros((k, k))
    for t in range(1, width):
        on = t < size
        joint = ahead[on, t - 1, :, None] + f.moves + (e[on, t] + behind[on, t])[:, None, :] - z[on, None, None]
        moves += np.exp(np.minimum(joint, 0)).sum(axis=0)
    return cells, moves, z


def labelled_chains(table: list[tuple[str, list[Span]]]) -> list[tuple[list[Token], np.ndarray]]:
    """The chains of labelled texts, and each token's label."""
    out = []
    for text, marked in table:
        for run in chains(text, base_spans(text)):
            out.append((run, np.array([next((LABELS.index(k) for k, s, e in marked if s <= t.start and t.end <= e and t.end > t.start), 0) for t in run])))
    return out


@lru_cache(maxsize=1)
def trained() -> Field:
    """The field, trained on the labelled table; the same in every process."""
    rows = labelled_chains(pii_table.labelled())
    named = [features(run) for run, _ in rows]
    index = {f: i for i, f in enumerate(sorted({f for run in named for names in run for f in names}))}
    n, k = len(rows), len(LABELS)
    size = np.array([len(run) for run, _ in rows])
    width = int(size.max())
    field = Field(index, np.zeros((len(index), k)), np.zeros((k, k)), np.zeros(k), np.zeros(k))
    cell = np.repeat(np.arange(n) * width, size) + np.concatenate([np.arange(s) for s in size])
    per = np.array([len(names) for run in named for names in run])
    where, what = np.repeat(cell, per), np.array([index[f] for run in named for names in run for f in names])
    truth = np.zeros((n, width, k))
    truth.reshape(-1, k)[cell, np.concatenate([y for _, y in rows])] = 1
    true_moves = sum((a[:-1].T @ a[1:] for a in (truth[r, :s] for r, s in enumerate(size))), np.zeros((k, k)))
    params = [field.weights, field.moves, field.first, field.last]
    past = [np.full_like(p, 1e-8) for p in params]
    order = np.argsort(what, kind="stable")
    where_sorted, edges = where[order], np.searchsorted(what[order], np.arange(len(index)))
    for _ in range(EPOCHS):
        e = np.zeros((n * width, k))
        np.add.at(e, where, field.weights[what])
        cells, moves, _ = expectations(e.reshape(n, width, k), size, field)
        off = (truth - cells).reshape(-1, k)
        grads = [np.add.reduceat(off[where_sorted], edges, axis=0), true_moves - moves, (truth - cells)[:, 0].sum(axis=0), (truth - cells)[np.arange(n), size - 1].sum(axis=0)]
        for p, g, h in zip(params, grads, past):
            g -= PENALTY * p
            h += g * g
            p += STEP * g / np.sqrt(h)
    return field


#: Characters that may lie between two tokens of one span, a mark in some kinds too; kinds that may lack a digit.
_JOINED, _LISTED, LISTED = re.compile(r"[ '’]{0,2}\Z"), re.compile(r"[.,]? ?\Z"), ("address", "birth_date")
WORDY = ("secret", "person")


def placed(text: str, taken: list[Span], labels: list[int]) -> list[Span]:
    """The field's spans, from the labels of a text's tokens."""
    held: list[Span] = []
    last = k = 0
    for first, edge, token in stretches(text, taken):
        for m in _PART.finditer(text, first, edge):
            label = labels[k]
            k += 1
            if label:
                kind, start, end = LABELS[label], m.start(), m.start() + len(m[0].rstrip(".") or m[0])
                # Neighbours of one kind make one span.
                gap = text[held[-1][2] : start] if label == last else ""
                if label == last and (_JOINED.match(gap) or (kind in LISTED and _LISTED.match(gap))):
                    held[-1] = (kind, held[-1][1], end)
                else:
                    held.append((kind, start, end))
            last = label
        if token:
            k += 1
            last = 0
    return [s for s in held if any(c.isdigit() or (c.isalpha() and s[0] in WORDY) for c in text[s[1] : s[2]])]


def all_spans(texts: list[str | None], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """For each whole text: the pattern spans, and the field's."""
    base = [base_spans(t) for t in texts]
    lexicon = field.lexicon()
    rows = [np.zeros(2, np.int32)]
    ends, at = [], 2
    for text, taken in zip(texts, base):
        for first, edge, token in stretches(text or "", taken):
            tokens = _PART.findall(text or "", first, edge)
            rows.append(lexicon.rows([*tokens, token] if token else tokens))
            at += len(rows[-1])
        ends.append(at)
        rows.append(np.zeros(1, np.int32))
        at += 1
    labels = field.labels(lexicon, np.concatenate([*rows, np.zeros(1, np.int32)]))
    rank = {kind: i for i, kind in enumerate(KINDS)}
    out = []
    first = 2
    for text, taken, end in zip(texts, base, ends):
        own = labels[first:end]
        first = end + 1
        added = placed(text, taken, own.tolist()) if own.any() else []
        out.append((taken, sorted(added, key=lambda s: (rank[s[0]], s[1]))))
    return out


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds spans: kind, start, end, and whether a pattern found it."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(trained())
    kept = [c for c in docs.columns if c.lower() != "spans"]
    schema = docs.select(*kept, F.lit(None).cast(SPANS).alias("spans")).schema
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        for batch in batches:
            rows = [
                [{"kind": k, "start": s, "end": e, "base": is_base} for is_base, part in ((True, base), (False, added)) for k, s, e in part]
                for base, added in all_spans(batch.column(len(kept)).to_pylist(), field)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(rows, kind)], names=[*kept, "spans"])

    return docs.select(*kept, F.col(text_col).cast("string").alias(spare_name([*kept, "spans"]))).mapInArrow(search, schema)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; overlapping spans merge under the first kind."""
    out: list[str] = []
    at = 0
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with personal data replaced in the text; a null text stays null."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(trained())
    place = docs.columns.index(text_col)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        for batch in batches:
            texts = batch.column(place).to_pylist()
            new = [t if t is None else redacted(t, base + added) if base or added else t for t, (base, added) in zip(texts, all_spans(texts, field))]
            columns = batch.columns
            columns[place] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(replace, docs.schema)
