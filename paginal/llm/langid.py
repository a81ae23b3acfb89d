"""Language identification: sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character 1- to 3-grams of letters
(other characters count as blanks): the share of each n-gram in the text times
its inverse document frequency, scaled to a constant sum.  The weights are
trained by follow-the-regularised-leader with elastic-net penalties, and the
probabilities are calibrated by one temperature, fitted on labelled rows that
the training did not see.

Document frequencies and label counts cover all labelled rows.  Training takes
a bounded sample: ``train_rows`` and ``calibration_rows`` for each label, the
rows of least hash of id and text, and fewer of each label where their features
would exceed ``SAMPLE_BYTES``.  With many labels there are fewer buckets, so
that the weights stay within ``MOST_WEIGHTS``.  What is sent to the driver or
broadcast is bounded so.

Defined results
---------------
* A text that is null or has no letter is ``und`` with score 0.
* Any length is read whole, in chunks of bounded size.
* Repeated rows and equal texts get equal answers; ties between labels go to
  the label that sorts first.
* Without any labelled row there is nothing to learn: all rows are ``und``.
* ``detect`` replaces columns named lang_pred and score and keeps the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paginal.llm.common import small_batches, spare_name, written

#: Hash buckets of n-grams; n-gram orders.
BUCKETS, ORDERS = 1 << 15, (1, 2, 3)
#: Weights of a model (buckets times labels), for which buckets are halved down to the least; bytes of the sampled features.
MOST_WEIGHTS, LEAST_BUCKETS, SAMPLE_BYTES = 1 << 23, 1 << 10, 256 << 20
#: Labelled rows per label that training and calibration take at most.
TRAIN_ROWS, CALIBRATION_ROWS = 300, 150
#: Follow-the-regularised-leader: step, smoothing, elastic-net penalties, epochs, sum of a row's features.
ALPHA, BETA, L1, L2, EPOCHS, SCALE = 0.5, 1.0, 0.02, 0.5, 4, 30.0
#: Characters hashed together.
CHUNK = 1 << 18
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else 0."""
    points = np.arange(0x110000, dtype=np.uint32)
    mask = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return np.where(mask, points, 0).astype(np.uint32)


def pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Runs of (row, lower-cased piece) of at most about CHUNK characters.

    A text starts with a blank; a piece carries two characters of context behind it.
    """
    rows: list[int] = []
    held: list[str] = []
    size = 0
    for row, text in enumerate(texts):
        low = (text or "").lower()
        for at in range(0, len(low), CHUNK):
            behind = low[at + CHUNK : at + CHUNK + 2].ljust(2)
            piece = ("" if at else " ") + low[at : at + CHUNK] + behind
            rows.append(row)
            held.append(piece)
            size += len(piece)
            if size >= CHUNK:
                yield rows, held
                rows, held, size = [], [], 0
    if rows:
        yield rows, held


def ngrams(held: list[str], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: bucket and validity at every position, and the pieces' first positions.

    The n-grams at a piece's two last positions start in its context and are
    marked invalid, as are those without a letter.
    """
    sizes = np.fromiter(map(len, held), dtype=np.int64, count=len(held))
    raw = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    code = _letters()[raw]
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    inside = np.ones(len(code), dtype=bool)
    ends = first + sizes
    inside[ends - 1] = False
    inside[ends - 2] = False
    letter = code != 0
    mixed = code * np.uint32(0x9E3779B1)
    rolled = np.zeros(len(code), dtype=np.uint32)
    valid = np.zeros(len(code), dtype=bool)
    shift = 32 - int(buckets).bit_length() + 1
    for order in range(1, max(ORDERS) + 1):
        at = order - 1
        rolled = rolled * np.uint32(0x01000193)
        rolled[: len(code) - at] += mixed[at:] if at else mixed
        valid[: len(code) - at] |= letter[at:] if at else letter
        if order in ORDERS:
            h = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(order * 0x27D4EB2F)
            h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
            yield (h >> np.uint32(shift)).astype(np.int64), valid & inside, first


def counts(text: str | None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted buckets of a whole text and how often each occurs."""
    total = np.zeros(buckets, dtype=np.int64)
    for _, held in pieces([text]):
        for bucket, valid, _ in ngrams(held, buckets):
            total += np.bincount(bucket[valid], minlength=buckets)
    found = np.flatnonzero(total)
    return found, total[found]


@dataclass
class Model:
    """Labels in order, idf per bucket, weights (buckets x labels), bias, temperature."""

    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def features(self, bucket: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = n * self.idf[bucket]
        return x * (SCALE / x.sum()) if len(x) else x

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The label and calibrated probability of each whole text."""
        n = len(texts)
        table = np.concatenate([self.weights * self.idf[:, None], self.idf[:, None]], axis=1).T.copy()
        sums = np.zeros((len(table), n))
        for rows, held in pieces(texts):
            at = np.asarray(rows)
            for bucket, valid, first in ngrams(held, len(self.idf)):
                for k, column in enumerate(table):
                    got = column[bucket]
                    got *= valid
                    np.add.at(sums[k], at, np.add.reduceat(got, first))
        if not self.labels:
            return [UNKNOWN] * n, np.zeros(n)
        known = sums[-1] > 0
        z = (sums[:-1] * (SCALE / np.where(known, sums[-1], 1)) + self.bias[:, None]).T
        p = softmax(z / self.temperature)
        best = p.argmax(axis=1)
        score = np.where(known, p[np.arange(n), best], 0.0)
        return [self.labels[b] if k else UNKNOWN for b, k in zip(best, known)], score


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray]], truth: list[int], labels: list[str], idf: np.ndarray) -> Model:
    """Follow-the-regularised-leader over the rows, each with its own coordinates."""
    buckets, n_labels = len(idf), len(labels)
    model = Model(labels, idf, np.zeros((buckets, n_labels)), np.zeros(n_labels), 1.0)
    z, n = np.zeros((buckets + 1, n_labels)), np.zeros((buckets + 1, n_labels))

    def leader(at: np.ndarray) -> np.ndarray:
        held = z[at]
        shrunk = np.sign(held) * np.maximum(np.abs(held) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    inputs = [(np.append(b, buckets), np.append(model.features(b, c), 1.0)) for b, c in rows]
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for k in order.permutation(len(inputs)):
            at, x = inputs[k]
            w = leader(at)
            error = softmax(x @ w)
            error[truth[k]] -= 1
            g = np.outer(x, error)
            old = n[at]
            new = old + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(old)) / ALPHA * w
            n[at] = new
    w = leader(np.arange(buckets + 1))
    model.weights, model.bias = w[:-1], w[-1]
    return model


def temperature(model: Model, rows: list[tuple[np.ndarray, np.ndarray]], truth: list[int]) -> float:
    """The temperature of least log loss on the rows, by golden section over its logarithm."""
    if not rows:
        return 1.0
    z = np.array([model.features(b, c) @ model.weights[b] + model.bias for b, c in rows])
    y = np.asarray(truth)

    def loss(log_t: float) -> float:
        p = softmax(z / np.exp(log_t))
        return -float(np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean())

    low, high, ratio = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        if loss(a) <= loss(b):
            high = b
        else:
            low = a
    return float(np.exp((low + high) / 2))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from all learning: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def document_frequencies(labelled: DataFrame, text_col: str, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, df) over all rows; each task sends one row per bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for at in range(0, len(texts), 64):
                part = texts[at : at + 64]
                seen = np.zeros((len(part), buckets), dtype=bool)
                flat = seen.reshape(-1)
                for rows, held in pieces(part):
                    for bucket, valid, first in ngrams(held, buckets):
                        sizes = np.diff(np.append(first, len(bucket)))
                        base = np.repeat(np.asarray(rows, dtype=np.int64) * buckets, sizes)
                        flat[(base + bucket)[valid]] = True
                total += seen.sum(axis=0)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": found.astype(np.int32), "df": total[found]})

    return labelled.select(text_col).mapInArrow(count, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df"))


def _sampled(labelled: DataFrame, labels: dict[str, int], rows: int, buckets: int, sample_bytes: int) -> list:
    """(label, rank, buckets, counts) of the rows of least hash of each label; labelled: id, text, lang."""
    # Rows that share an id, or have none, are told apart by their texts; equal rows are equal samples.
    h = F.pmod(F.xxhash64(F.lit("sample"), "id", "text"), F.lit(1 << 30))
    # Twice the rows wanted by expectation, of which the least hashes are taken.
    rate = F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.lit(min(1.0, 2 * rows / v + 20 / v)))])
    near = labelled.withColumn("h", h).where(F.col("h") < rate[F.col("lang")] * (1 << 30))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id", "text")))
    chosen = ranked.where(F.col("rank") <= rows).select(F.col("lang").alias("label"), "rank", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [counts(x, buckets) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {"label": batch.column("label"), "rank": batch.column("rank"), "buckets": pa.array([b.astype("<u4").tobytes() for b, _ in got], pa.binary()), "counts": pa.array([c.astype("<u4").tobytes() for _, c in got], pa.binary())}
            )

    found = written(chosen.mapInArrow(features, "label string, rank int, buckets binary, counts binary"), "sample")
    taken, held = 0, 0
    for r in sorted(found.groupBy("rank").agg(F.sum(F.octet_length("buckets") + F.octet_length("counts")).alias("n")).collect()):
        held += r["n"]
        if held > sample_bytes and taken:
            break
        taken = r["rank"]
    return sorted(found.where(F.col("rank") <= taken).collect(), key=lambda r: (r["rank"], r["label"]))


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    train_rows: int = TRAIN_ROWS,
    calibration_rows: int = CALIBRATION_ROWS,
    buckets: int = BUCKETS,
    sample_bytes: int = SAMPLE_BYTES,
) -> Model:
    """Learns from the labelled rows that are not held out."""
    small_batches(docs.sparkSession)
    labelled = docs.where(F.col(lang_col).isNotNull() & ~held_out(id_col)).select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    label_counts = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    total = sum(label_counts.values())
    while buckets > LEAST_BUCKETS and buckets * len(label_counts) > MOST_WEIGHTS:
        buckets //= 2
    df = np.zeros(buckets)
    if total:
        for r in document_frequencies(labelled, "text", buckets).collect():
            df[r["bucket"]] = r["df"]
    idf = np.log((1 + total) / (1 + df)) + 1
    labels = sorted(label_counts)
    if not labels:
        return Model([], idf, np.zeros((buckets, 0)), np.zeros(0), 1.0)
    sample = _sampled(labelled, label_counts, train_rows + calibration_rows, buckets, sample_bytes)
    parts: tuple[list, list, list, list] = ([], [], [], [])
    for r in sample:
        features = (np.frombuffer(r["buckets"], "<u4").astype(np.int64), np.frombuffer(r["counts"], "<u4").astype(np.float64))
        # Every third row of a label serves calibration, whatever the label's size.
        calibrating = r["rank"] % 3 == 0
        parts[2 * calibrating].append(features)
        parts[2 * calibrating + 1].append(labels.index(r["label"]))
    model = train(parts[0], parts[1], labels, idf)
    model.temperature = temperature(model, parts[2], parts[3])
    return model


def detect(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds lang_pred and score, from the text alone."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    schema = docs.select(*kept, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, scores = sent.value.predict(batch.column(len(kept)).to_pylist())
            columns = [*batch.columns[: len(kept)], pa.array(labels, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "lang_pred", "score"])

    return docs.select(*kept, F.col(text_col).cast("string").alias(spare_name([*kept, "lang_pred", "score"]))).mapInArrow(predict, schema)
