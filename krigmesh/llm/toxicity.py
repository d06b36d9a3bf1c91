"""Operator 10, toxicity: a character n-gram linear classifier on features scaled by naive Bayes log-count ratios.

A text's features are the distinct character n-grams (3 to 5 characters, lower case, a blank at either end), hashed
to 2**20 places. Over all labelled training rows, each place gets its log-count ratio
r = log((toxic rows with it + 1) / (toxic rows + 2)) - log((other rows with it + 1) / (other rows + 2)). The places
whose ratio is at least ``least_z`` standard errors from 0 carry the model (the furthest ``features`` of them, so that
its size is bounded); a row's feature value is the ratio, and a logistic regression with weight decay learns a weight
for each. Presence, not frequency, is the feature, so a few telling words weigh the same in a long text.

The log-count ratios cover every labelled training row. The regression is fitted on at most ``max_train`` of them,
those whose labels have the smallest hash of the key (a documented bound; the driver sees their selected features only).
At any size the fit runs until the norm of the mean loss's gradient is at most ``tolerance`` (0.01), or for ``rounds``
(1,000) and then warns. Weight decay is slight, so the tolerance keeps the weights small as well: far below it the fit
follows single training rows. Nothing but the text enters a score.

Defined results: null and empty texts score by the intercept; several labels of one key count as their largest;
without rows of both labels every score is the share of toxic labels (0 without any); repeated rows each get a row.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, columns_or_null, hash_sample, small
from .tokens import chunks, forget

BITS = 20
ORDERS = (3, 4, 5)
#: Bytes of text that are hashed at a time; the arrays of hashes take about 20 times as much.
SLICE = 1 << 19


def held_out(key: str = "doc_id"):
    """crc32 of the key as text, mod 5, is 0 (a null key is never held out)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def hashed_ngrams(texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the hashed n-gram at every place of the joined texts; where each text begins (and the end)."""
    padded = [f" {(t or '').lower()} " for t in texts]
    ends = np.cumsum([len(p) for p in padded], dtype=np.int64)
    code = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4")
    out, h = [], code * np.uint32(0x9E3779B1)
    for n in range(2, max(ORDERS) + 1):
        h = h[:-1] * np.uint32(0x85EBCA6B) + code[n - 1 :] * np.uint32(0xC2B2AE35) + np.uint32(n)
        if n in ORDERS:
            mixed = h ^ (h >> np.uint32(15))
            mixed *= np.uint32(0x2C1B3C6D)
            mixed ^= mixed >> np.uint32(12)
            out.append(mixed >> np.uint32(32 - BITS))
    return out, np.concatenate([[0], ends])


def spans_of(hashes: list[np.ndarray], begin: int, end: int) -> list[np.ndarray]:
    return [h[begin : max(begin, end - n + 1)] for n, h in zip(ORDERS, hashes)]


class Marker:
    """The distinct values of some arrays of places, by a bitmap that is wiped after use."""

    def __init__(self):
        self.seen = np.zeros(1 << BITS, bool)

    def distinct(self, parts: list[np.ndarray]) -> np.ndarray:
        for p in parts:
            self.seen[p] = True
        out = np.flatnonzero(self.seen)
        self.seen[out] = False
        return out


def _counts(batches):
    """Rows with each place, by label, over all rows of a task: one row for each place that it has seen."""
    forget()
    n, mark = np.zeros((2, 1 << BITS), np.int64), Marker()
    for b in chunks(batches, SLICE):
        hashes, at = hashed_ngrams(b.column("text").to_pylist())
        for i, y in enumerate(b.column("toxic").to_pylist()):
            n[y, mark.distinct(spans_of(hashes, int(at[i]), int(at[i + 1])))] += 1
    place = np.flatnonzero(n.sum(0))
    for lo in range(0, len(place), 1 << 16):
        p = place[lo : lo + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(n[1, p]), pa.array(n[0, p])], ["place", "pos", "neg"])


def _selected(place: np.ndarray):
    """Rows -> the numbers of the selected features that a text has, as packed 16-bit integers."""

    def run(batches):
        table = np.zeros(1 << BITS, np.int32)
        table[place] = np.arange(1, len(place) + 1)
        for b in chunks(batches, SLICE):
            hashes, at = hashed_ngrams(b.column("text").to_pylist())
            mapped, out = [table[h] for h in hashes], []
            for i in range(b.num_rows):
                own = np.concatenate(spans_of(mapped, int(at[i]), int(at[i + 1])))
                out.append((np.unique(own[own > 0]) - 1).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(out, pa.binary())], ["toxic", "ids"])

    return run


def packed(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows' features, joined, and how many each row has."""
    return np.concatenate([np.zeros(0, "<u2"), *rows]).astype("<u2"), np.array([len(r) for r in rows], np.int64)


def objective(rows: tuple[np.ndarray, np.ndarray], y: np.ndarray, scale: np.ndarray, decay: float):
    """rows: packed. Weights and intercept in one array -> mean loss with weight decay, and its gradient.

    Rows of label 1 weigh the square root of the labels' odds, as the rarer label would else be missed too often.
    """
    idx, size = rows
    m, n = len(scale), len(size)
    heavy = np.where(y > 0, max(1.0, ((n - y.sum()) / max(1.0, y.sum())) ** 0.5), 1.0)
    at = np.concatenate([[0], np.cumsum(size)])
    cuts = np.unique(np.concatenate([[0], np.searchsorted(at[:-1], np.arange(1 << 20, max(at[-1], 1), 1 << 20)), [n]]))  # bounded slices

    def f(v: np.ndarray) -> tuple[float, np.ndarray]:
        ws, loss, g = v[:m] * scale, 0.0, np.zeros(m + 1)
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            i, row = idx[at[lo] : at[hi]].astype(np.intp), np.repeat(np.arange(hi - lo), size[lo:hi])
            s = np.bincount(row, ws[i], hi - lo) + v[m]
            loss += float(heavy[lo:hi] @ (np.logaddexp(0, s) - y[lo:hi] * s))
            d = heavy[lo:hi] * (1 / (1 + np.exp(-np.clip(s, -40, 40))) - y[lo:hi])
            g[:m] += np.bincount(i, d[row], m)
            g[m] += d.sum()
        g[:m] = g[:m] * scale / n + decay * v[:m]
        g[m] /= n
        return loss / n + decay / 2 * float(v[:m] @ v[:m]), g

    return f


def fit_logistic(rows: tuple[np.ndarray, np.ndarray], y: np.ndarray, scale: np.ndarray, decay: float, tolerance: float = 0.01, rounds: int = 1000) -> tuple[np.ndarray, float]:
    """L-BFGS until the gradient's norm is at most tolerance; the weight of feature f is learned on the value scale[f].

    The test and the limit of rounds are the same for any number of rows; a fit that ends otherwise warns.
    """
    m, f = len(scale), objective(rows, y, scale, decay)
    v = np.append(np.zeros(m), np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    loss, g = f(v)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []  # steps, changes of the gradient, 1 / their product
    for _ in range(rounds):
        if g @ g <= tolerance**2:
            break
        d, shares = -g, []
        for s, t, r in reversed(past):
            shares.append(r * (s @ d))
            d = d - shares[-1] * t
        d = d * (past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, float(g @ g) ** 0.5))
        for (s, t, r), a in zip(past, reversed(shares)):
            d = d + s * (a - r * (t @ d))
        step = 1.0
        while (new := f(v + step * d))[0] > loss + 1e-4 * step * float(g @ d) and step > 1e-10:
            step /= 2
        if new[0] > loss:
            break
        s, t = step * d, new[1] - g
        if s @ t > 1e-12 * float((s @ s) * (t @ t)) ** 0.5:
            past = [*past, (s, t, 1 / float(s @ t))][-20:]
        v, (loss, g) = v + s, new
    if g @ g > tolerance**2:
        warnings.warn(f"toxicity: gradient norm {float(g @ g) ** 0.5:.2g} after the last round, not {tolerance:g}", RuntimeWarning, stacklevel=2)
    return v[:m], float(v[m])


class Model:
    """Selected places, the weight of each (ratio times learned weight), intercept."""

    def __init__(self, place: np.ndarray, weight: np.ndarray, bias: float):
        self.place, self.weight, self.bias = place, weight, bias

    def score(self, texts: list[str | None], table: np.ndarray) -> np.ndarray:
        hashes, at = hashed_ngrams(texts)
        mapped = [table[h] for h in hashes]
        out = np.full(len(texts), self.bias)
        for i in range(len(texts)):
            own = np.concatenate(spans_of(mapped, int(at[i]), int(at[i + 1])))
            own = own[own > 0]
            if len(own):
                out[i] += self.weight[np.unique(own) - 1].sum()
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def train(spark: SparkSession, rows: DataFrame, own: DataFrame, features: int = 65_535, least_z: float = 3.0, max_train: int = 20_000, decay: float = 1e-6, tolerance: float = 0.01, rounds: int = 1000) -> Model:
    """rows: doc_id, text; own: one label (doc_id, toxic) of each training key."""
    labelled = rows.join(small(own, 16), "doc_id").select("doc_id", "text", "toxic")
    empty = np.zeros(0, np.int64)
    counts = {r.toxic: r.n for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    if not n1 or not n0:
        share = min(max(n1 / max(1, n1 + n0), 1e-9), 1 - 1e-9)
        return Model(empty, np.zeros(0), float(np.log(share / (1 - share))))
    by = labelled.select("text", "toxic").mapInArrow(_counts, "place int, pos bigint, neg bigint").groupBy("place").agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    ratio = F.log((F.col("p") + 1.0) / (n1 + 2.0)) - F.log((F.col("q") + 1.0) / (n0 + 2.0))
    best = by.withColumn("r", ratio).withColumn("z", F.abs("r") / F.sqrt(1 / (F.col("p") + 1.0) + 1 / (F.col("q") + 1.0))).where(F.col("z") >= least_z)
    best = best.orderBy(F.desc("z"), "place").limit(min(features, 65_535)).select("place", "r").toPandas()  # bounded by features
    place, scale = best["place"].to_numpy(np.int64), best["r"].to_numpy(float)
    # the sample is picked among keys alone, so no text is sorted; its bound is that of a broadcast
    picked = F.broadcast(hash_sample(own, "doc_id", max_train, n1 + n0)) if n1 + n0 > max_train else small(own, 16)
    scratch = Scratch(spark, "toxicity-rows")
    got = scratch.save(rows.join(picked, "doc_id").select("toxic", "text").mapInArrow(_selected(place), "toxic int, ids binary"), "rows")
    ids, size, y = bytearray(), [], []
    for r in got.toLocalIterator():  # at most max_train rows, one part of them at a time, packed without a copy
        ids += r.ids
        size.append(len(r.ids) // 2)
        y.append(float(r.toxic))
    scratch.drop(got)
    w, bias = fit_logistic((np.frombuffer(ids, "<u2"), np.array(size, np.int64)), np.array(y), scale, decay, tolerance, rounds)
    return Model(place, w * scale, bias)


def fitted(spark: SparkSession, docs: DataFrame, labels: DataFrame, **how) -> Model:
    """The model of the labelled rows of docs that are not held out."""
    scratch = Scratch(spark, "toxicity")
    rows = columns_or_null(docs, {"doc_id": "bigint", "text": "string"})
    own = columns_or_null(labels, {"doc_id": "bigint", "toxic": "int"}).where("toxic in (0, 1) and doc_id is not null").where(~held_out())
    own = scratch.save(own.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "labels")
    model = train(spark, rows, own, **how)
    scratch.drop(own)
    return model


def _scores(model: Model, batches):
    """Each bounded slice of a task's rows and the scores of its texts."""
    forget()
    table = np.zeros(1 << BITS, np.int32)
    table[model.place] = np.arange(1, len(model.place) + 1)
    for b in chunks(batches, SLICE):
        yield b, model.score(b.column("text").to_pylist(), table)


def score_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text); labels: doc_id, toxic."""
    model = fitted(spark, docs, labels, **how)

    def run(batches):
        for b, s in _scores(model, batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s)], ["doc_id", "held_out", "score"])

    rows = columns_or_null(docs, {"doc_id": "bigint", "text": "string"}).withColumn("held_out", held_out())
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """docs without the rows that score 0.5 or more; all columns stay, and no join is made on the key."""
    model = fitted(spark, docs, labels, **how)

    def run(batches):
        for b, s in _scores(model, batches):
            yield b.filter(pa.array(s < 0.5))

    return docs.mapInArrow(run, docs.schema)
