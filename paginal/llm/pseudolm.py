"""Masked pseudo-likelihood scoring by a bidirectional window network.

Every word is predicted from the words on both sides of it, without itself;
the log-probabilities of all words of a document sum to its score.

Network: embeddings for each place of the window, their sum through tanh, and
a softmax in two steps (class of the word, word in its class), all in numpy.
The vocabulary holds the most frequent words of the whole corpus, counted by
their 64-bit hashes.  The network predicts other words, and sees them as
neighbours, by their length; which word of that length it is, a model of
spelling says: every byte by the two before it, from the counts of all those words.

Training: every round, each task starts from the same weights and runs AdaGrad
over windows of all its documents (every ``stride``-th place of a document,
another one each round); the tasks' weights are averaged, weighted by their
windows, in a shuffle.  With as many rounds as the stride, the default, every
window of the corpus is trained on exactly once.  What is gathered so grows
with the corpus; the driver sees one set of weights only.

Defined results
---------------
* A text that is null or has no word has n_tokens 0, log_prob 0 and a null mean.
* Whole texts count, very long ones in slices that see their neighbours; repeated rows score alike.
* Without any word in the corpus, the network and the spelling are those they start from; an empty table gives an empty result.
* log_prob and its mean are the network's; spelling_log_prob is of the words outside the vocabulary, each
  given its length.  Their sum is the log-probability of the whole text, word for word.
* Columns named n_tokens, log_prob, mean_log_prob and spelling_log_prob are replaced.
* Averages are sums of floats: scores agree between runs to about 1e-6.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paginal.llm.common import small_batches, spare_name, written
from paginal.llm.words import Lookup, Words, summed, utf8, words

#: Classes, words in a class, size of the hidden layer, words on either side.
CLASSES, MEMBERS, HIDDEN, SIDE = 32, 64, 24, 2
WORDS = CLASSES * MEMBERS
#: Lengths that tell unknown words apart.
LENGTHS = 16
#: Windows in a training step, step size, rounds.
STEP_ROWS, RATE, ROUNDS = 4096, 0.15, 2
#: Places of which one is trained on in a round: all rounds together take every place.
STRIDE = ROUNDS
#: Windows that are scored together; rows in each of their products.
SCORE_ROWS, BLOCK = 1 << 13, 64
#: Distinct words beyond which a task passes its counts on.
HELD = 200_000
#: Byte before the first of a word; classes of the second byte before; weight of the shorter context.
START, SORTS, SHORTER = 256, 16, 4.0
CODES = (START + 1) * SORTS * 256
_SORT_OF_START = (START * 7 + (START >> 4)) % SORTS
PAD = WORDS


class Vocabulary:
    """Ids of words: lengths first, then the most frequent words."""

    def __init__(self, hashes: np.ndarray):
        self.known = Lookup(np.asarray(hashes, dtype=np.uint64)[: WORDS - LENGTHS])

    def ids(self, found: Words) -> np.ndarray:
        place = self.known.find(found.hash)
        return np.where(place >= 0, place + LENGTHS, np.minimum(found.size, LENGTHS) - 1).astype(np.uint16)


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, size, n) over the whole corpus: hash, characters (LENGTHS at most), occurrences; tasks add up within bounded memory."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return summed(*(np.concatenate(x) for x in zip(*held)))

        def sent(h: np.ndarray, n: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(size.astype(np.int32)), pa.array(n)], names=["word", "size", "n"])

        for batch in batches:
            for found in words(batch.column(0).to_pylist()):
                held.append(summed(found.hash, np.ones(len(found.hash), np.int64), np.minimum(found.size, LENGTHS)))
                rows += len(held[-1][0])
                if rows >= 2 * HELD:
                    held = [merged()]
                    rows = len(held[0][0])
                    if rows >= HELD:
                        yield sent(*held[0])
                        held, rows = [], 0
        if held:
            yield sent(*merged())

    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "word long, size int, n long")
    return counted.groupBy("word", "size").agg(F.sum("n").alias("n"))


def spelled(found: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of every byte after the two before it, first code of each word) of the words at ``which``."""
    raw, at = utf8(found.code)
    first, size = at[found.start[which]], at[found.end[which]] - at[found.start[which]]
    begin = np.cumsum(size) - size
    place = np.repeat((first - begin).astype(np.int32), size)
    place += np.arange(len(place), dtype=np.int32)
    # The code of a byte by its neighbours, then those at the starts of words.
    two = raw[place - 2].astype(np.int16)
    two = (two * 7 + (two >> 4)) % SORTS
    one = raw[place - 1].astype(np.int32)
    one[begin], two[begin], two[begin[size > 1] + 1] = START, _SORT_OF_START, _SORT_OF_START
    one *= SORTS
    one += two
    one <<= 8
    one |= raw[place]
    return one, begin


@dataclass
class Spelling:
    """log P of every byte by context, and the chance that a word of LENGTHS characters and more ends after each."""

    table: np.ndarray
    ends: float

    @staticmethod
    def of(counts: np.ndarray, long_words: float, further: float) -> Spelling:
        n = counts.reshape(START + 1, SORTS, 256).astype(np.float64)
        pairs = n.sum(axis=1)
        p = (pairs.sum(axis=0) + 1) / (pairs.sum() + 256)
        p = (pairs + SHORTER * p) / (pairs.sum(axis=1, keepdims=True) + SHORTER)
        p = (n + SHORTER * p[:, None]) / (n.sum(axis=2, keepdims=True) + SHORTER)
        return Spelling(np.log(p).astype(np.float32).reshape(-1), (long_words + 1) / (long_words + further + 2))

    def log_prob(self, found: Words, which: np.ndarray) -> np.ndarray:
        """log P(word | its length, or that it has LENGTHS characters and more) of the words at ``which``."""
        if not len(which):
            return np.zeros(0)
        codes, begin = spelled(found, which)
        total = np.add.reduceat(self.table[codes].astype(np.float64), begin)
        further = found.size[which] - LENGTHS
        return total + np.where(further < 0, 0.0, further * np.log1p(-self.ends) + np.log(self.ends))


class SpellingCounts:
    """Occurrences of every code, then of long words and of their further characters."""

    def __init__(self) -> None:
        self.n = np.zeros(CODES + 2, dtype=np.int64)

    def add(self, found: Words, which: np.ndarray) -> None:
        if len(which):
            self.n[:CODES] += np.bincount(spelled(found, which)[0], minlength=CODES)
            further = found.size[which] - LENGTHS
            self.n[CODES:] += [int((further >= 0).sum()), int(np.maximum(further, 0).sum())]

    def rows(self) -> Iterator[tuple[list[int], list[int]]]:
        some = np.flatnonzero(self.n)
        for at in range(0, len(some), 4096):
            yield some[at : at + 4096].tolist(), self.n[some[at : at + 4096]].tolist()


def learn_spelling(coded: DataFrame) -> Spelling:
    """Spelling from the counts among the rows of ``_coded``; what is collected is bounded by the contexts."""
    counts = np.zeros(CODES + 2, dtype=np.int64)
    pairs = coded.where(F.col("ids").isNull()).select(F.explode(F.arrays_zip("codes", "counts")).alias("p")).select("p.codes", "p.counts")
    found = pairs.groupBy("codes").agg(F.sum("counts").alias("n")).toArrow()
    counts[found.column("codes").to_numpy()] = found.column("n").to_numpy()
    return Spelling.of(counts[:CODES], float(counts[CODES]), float(counts[CODES + 1]))


@dataclass
class Network:
    """Window embeddings (places x words + pad, hidden), hidden bias, class and word outputs with biases."""

    embed: np.ndarray
    bias: np.ndarray
    cls: np.ndarray
    cls_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def fresh(counts: np.ndarray) -> Network:
        r = np.random.default_rng(0)
        size = lambda *s: (r.standard_normal(s) * 0.05).astype(np.float32)
        prior = np.log(counts + 1.0).reshape(CLASSES, MEMBERS)
        top = np.log(np.exp(prior).sum(axis=1))
        return Network(
            size(2 * SIDE * (WORDS + 1), HIDDEN), np.zeros(HIDDEN, np.float32), size(CLASSES, HIDDEN),
            (top - top.mean()).astype(np.float32), size(WORDS, HIDDEN), (prior - top[:, None]).reshape(-1).astype(np.float32),
        )

    def rows(self) -> np.ndarray:
        """All weights as rows of the hidden size."""
        flat = np.concatenate([p.reshape(-1) for p in vars(self).values()])
        return np.pad(flat, (0, -len(flat) % HIDDEN)).reshape(-1, HIDDEN)

    def with_rows(self, rows: np.ndarray) -> Network:
        flat, parts, at = rows.reshape(-1), [], 0
        for p in vars(self).values():
            parts.append(flat[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return Network(*parts)

    def copy(self) -> Network:
        return Network(*(p.copy() for p in vars(self).values()))

    def hidden(self, context: np.ndarray) -> np.ndarray:
        """context: windows x places, with each place's rows apart."""
        total = self.embed[context[:, 0]]
        for k in range(1, context.shape[1]):
            total += self.embed[context[:, k]]
        return np.tanh(total + self.bias)

    def log_prob(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log P(target | both sides) of each window, to the bit the same whatever windows stand beside it.

        How a product of matrices rounds a row depends on its shape, so all are of ``BLOCK`` rows.
        """
        h = self.hidden(context)
        cls = target // MEMBERS
        order = np.argsort(cls.astype(np.uint8), kind="stable")
        n = np.bincount(cls, minlength=CLASSES)
        blocks = -(-n // BLOCK)
        ends = np.cumsum(blocks)
        # The windows by class, each class filled up to whole blocks.
        at = np.arange(len(cls)) + np.repeat((ends - blocks) * BLOCK - (np.cumsum(n) - n), n)
        padded = np.zeros((int(ends[-1]), BLOCK, HIDDEN), h.dtype)
        padded.reshape(-1, HIDDEN)[at] = h[order]
        wanted = np.zeros(int(ends[-1]) * BLOCK, np.int64)
        wanted[at] = target[order]
        z = np.matmul(padded, np.ascontiguousarray(self.cls.T)).reshape(-1, CLASSES)
        z += self.cls_bias
        got = z[np.arange(len(z)), wanted // MEMBERS] - _log_sum(z)
        z = np.empty((len(padded), BLOCK, MEMBERS), h.dtype)
        for c in np.flatnonzero(n):
            part, own = slice(ends[c] - blocks[c], ends[c]), slice(c * MEMBERS, (c + 1) * MEMBERS)
            np.matmul(padded[part], np.ascontiguousarray(self.out[own].T), out=z[part])
            z[part] += self.out_bias[own]
        z = z.reshape(-1, MEMBERS)
        got += z[np.arange(len(z)), wanted % MEMBERS] - _log_sum(z)
        out = np.empty(len(cls), dtype=np.float64)
        out[order] = got[at]
        return out


def _softmax(z: np.ndarray) -> np.ndarray:
    """Each row's shares, in the place of ``z``."""
    if not (-60 < float(z.min(initial=0)) and float(z.max(initial=0)) < 60):
        z -= z.max(axis=1)[:, None]
    np.exp(z, out=z)
    z *= (1 / (z @ np.ones(z.shape[1], dtype=z.dtype)))[:, None]
    return z


def _log_sum(z: np.ndarray) -> np.ndarray:
    """log of the sum of exponentials of each row."""
    if -60 < float(z.min(initial=0)) and float(z.max(initial=0)) < 60:
        return np.log(np.exp(z).sum(axis=1))
    far = (np.abs(z) >= 60).any(axis=1)
    out = np.empty(len(z), z.dtype)
    out[~far] = np.log(np.exp(z[~far]).sum(axis=1))
    top = z[far].max(axis=1)
    out[far] = np.log(np.exp(z[far] - top[:, None]).sum(axis=1)) + top
    return out


def _even(share: np.ndarray) -> np.ndarray:
    """Rounded to 2 ** -28, so that sums are the same in any order."""
    return np.rint(share * 2.0**28) * 2.0**-28


class Trainer:
    """AdaGrad on a network, a step of windows at a time."""

    def __init__(self, net: Network):
        self.net = net
        self.past = [np.full_like(p, 0.1) for p in vars(net).values()]
        self.windows = 0

    def step(self, context: np.ndarray, target: np.ndarray) -> None:
        net = self.net
        order = np.argsort((target // MEMBERS).astype(np.uint8), kind="stable")
        context, target = context[order], target[order]
        h = net.hidden(context)
        cls = target // MEMBERS
        z = h @ net.cls.T + net.cls_bias
        p = _softmax(z)
        p[np.arange(len(p)), cls] -= 1
        grad = p @ net.cls
        cls_grad, cls_bias_grad = p.T @ h, p.sum(axis=0)
        out_grad, out_bias_grad = np.zeros_like(net.out), np.zeros_like(net.out_bias)
        bounds = np.searchsorted(cls, np.arange(CLASSES + 1)).tolist()
        at = np.arange(len(target)) * MEMBERS + target % MEMBERS
        for c, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            if a < b:
                part = slice(c * MEMBERS, (c + 1) * MEMBERS)
                z = h[a:b] @ net.out[part].T
                z += net.out_bias[part]
                p = _softmax(z)
                p.reshape(-1)[at[a:b] - a * MEMBERS] -= 1
                grad[a:b] += p @ net.out[part]
                out_grad[part], out_bias_grad[part] = p.T @ h[a:b], np.ones(b - a, p.dtype) @ p
        grad *= 1 - h * h
        # Rows of the embeddings that several windows share are summed first.
        flat = context.reshape(-1)
        at = np.argsort(flat.astype(np.uint16), kind="stable")
        ordered = flat[at]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        rows = ordered[first]
        summed = np.add.reduceat(grad[at // context.shape[1]], first, axis=0)
        for k, g in enumerate((None, grad.sum(axis=0), cls_grad, cls_bias_grad, out_grad, out_bias_grad)):
            weight, past = list(vars(net).values())[k], self.past[k]
            if g is None:
                past[rows] += summed * summed
                weight[rows] -= RATE * summed / np.sqrt(past[rows])
            else:
                past += g * g
                weight -= RATE * g / np.sqrt(past)
        self.windows += len(target)


def places(ids: np.ndarray, counts: np.ndarray, size: int, number: int = 0, stride: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, context, target) of the places of texts that round ``number`` takes, up to ``size`` at a time or a few more.

    The texts' ids follow each other in ``ids``; a context never leaves its text.
    """
    ends = np.cumsum(counts)
    first = ends - counts
    padded = np.full(len(ids) + SIDE * (len(counts) + 1), PAD, dtype=np.uint16)
    row = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    at = np.arange(len(ids), dtype=np.int32 if len(padded) < 2**31 else np.int64)
    padded[at + SIDE * (row + 1)] = ids
    shifts = [*range(-SIDE, 0), *range(1, SIDE + 1)]
    for a in range(0, len(ids), size * stride):
        part = slice(a, a + size * stride)
        place, owner = at[part].astype(np.int64), row[part]
        if stride > 1:
            taken = (place - first[owner]) % stride == number % stride
            place, owner = place[taken], owner[taken]
        middle = place + SIDE * (owner.astype(np.int64) + 1)
        context = np.empty((len(place), 2 * SIDE), dtype=np.int64)
        for k, s in enumerate(shifts):
            context[:, k] = padded[middle + s]
            context[:, k] += k * (WORDS + 1)
        yield owner, context, padded[middle].astype(np.int64)


@dataclass
class Model:
    vocabulary: Vocabulary
    network: Network
    spelling: Spelling


def fit(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS, stride: int = STRIDE) -> Model:
    """Vocabulary, network and spelling of a corpus."""
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(text_col).cast("string").alias("text"))
    counted = written(count_words(source), "words")
    top = counted.orderBy(F.desc("n"), "word", "size").limit(WORDS - LENGTHS).collect()
    known = np.zeros(WORDS)
    known[LENGTHS : LENGTHS + len(top)] = [r["n"] for r in top]
    for r in counted.groupBy("size").agg(F.sum("n").alias("n")).collect():
        known[r["size"] - 1] = r["n"] - sum(t["n"] for t in top if t["size"] == r["size"])
    vocabulary = Vocabulary(np.array([r["word"] for r in top], dtype=np.int64).view(np.uint64))
    network = Network.fresh(known)
    coded = written(_coded(source, vocabulary), "ids")
    for number in range(rounds):
        network = _round(coded, network, number, stride)
    return Model(vocabulary, network, learn_spelling(coded))


def _coded(source: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """ids of every text, two bytes a word, so that rounds find no words again; and rows of spelling counts, without ids."""
    sent = source.sparkSession.sparkContext.broadcast(vocabulary)
    kinds = pa.schema([("ids", pa.binary()), ("codes", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling = SpellingCounts()
        for batch in batches:
            ids, counts = coded_words(batch.column(0).to_pylist(), sent.value, spelling.add)
            ends = np.concatenate([[0], np.cumsum(counts)]) * 2
            column = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids)])
            nothing = [pa.nulls(len(counts), kinds.field(k).type) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([column, *nothing], schema=kinds)
        for codes, counts in spelling.rows():
            yield pa.RecordBatch.from_pydict({"ids": [None], "codes": [codes], "counts": [counts]}, schema=kinds)

    return source.mapInArrow(code, "ids binary, codes array<int>, counts array<long>")


def coded_words(texts: list[str | None], vocabulary: Vocabulary, rare: Callable[[Words, np.ndarray], None]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words, number of each text); ``rare`` gets each chunk's words outside the vocabulary."""
    out, counts = [np.zeros(0, np.uint16)], np.zeros(len(texts), dtype=np.int64)
    for found in words(texts):
        ids = vocabulary.ids(found)
        rare(found, np.flatnonzero(ids < LENGTHS))
        counts += np.bincount(found.row, minlength=len(texts))
        out.append(ids)
    return np.concatenate(out), counts


def _round(coded: DataFrame, network: Network, number: int, stride: int) -> Network:
    sent = coded.sparkSession.sparkContext.broadcast(network)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(sent.value.copy())
        for batch in batches:
            counts = pc.binary_length(batch.column(0)).to_numpy().astype(np.int64) // 2
            ids = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.uint16)
            for _, context, target in places(ids, counts, STEP_ROWS, number, stride):
                if len(target):
                    trainer.step(context, target)
        if trainer.windows:
            rows = trainer.net.rows()
            flat = pa.FixedSizeListArray.from_arrays(pa.array(rows.reshape(-1)), HIDDEN).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(rows), dtype=np.int32)), pa.array(np.full(len(rows), float(trainer.windows))), flat], names=["row", "n", "v"]
            )

    parts = coded.where(F.col("ids").isNotNull()).select("ids").mapInArrow(train, "row int, n double, v array<float>")
    means = parts.groupBy("row").agg(F.sum("n").alias("n"), *(F.sum(F.col("v")[k] * F.col("n")).alias(f"v{k}") for k in range(HIDDEN)))
    rows = network.rows().astype(np.float64)
    for r in means.collect():
        rows[r["row"]] = np.array(r[2:]) / r["n"]
    return network.with_rows(rows)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds n_tokens, log_prob (natural), mean_log_prob and spelling_log_prob of every whole text."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    added = ("n_tokens", "log_prob", "mean_log_prob", "spelling_log_prob")
    kept = [c for c in docs.columns if c.lower() not in added]
    read_name = spare_name([*kept, *added])
    number, share = F.lit(0).cast("long"), F.lit(0.0)
    schema = docs.select(*kept, number.alias(added[0]), share.alias(added[1]), F.lit(None).cast("double").alias(added[2]), share.alias(added[3])).schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = batch.column(len(kept)).to_pylist()
            total, spelling = np.zeros(len(texts)), np.zeros(len(texts))

            def rare(found: Words, which: np.ndarray, out: np.ndarray = spelling) -> None:
                out += np.bincount(found.row[which], weights=_even(model.spelling.log_prob(found, which)), minlength=len(out))

            ids, n = coded_words(texts, model.vocabulary, rare)
            for row, context, target in places(ids, n, SCORE_ROWS):
                total += np.bincount(row, weights=_even(model.network.log_prob(context, target)), minlength=len(texts))
            mean = pa.array(np.where(n > 0, total / np.maximum(n, 1), 0.0), mask=n == 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(n), pa.array(total), mean, pa.array(spelling)], names=[*kept, *added])

    return docs.select(*kept, F.col(text_col).cast("string").alias(read_name)).mapInArrow(read, schema)
