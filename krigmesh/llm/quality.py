"""Operator 7, quality classifier: co-training of a text-content view and a metadata view.

Content view: how often one kind of character follows another (kinds such as capitals, digits, blanks, line ends,
marks), how often a word repeats the one before it, the share of distinct words and the words' mean length.
Metadata view: source, language and the two with the order of magnitude of the declared length, each as its smoothed
mean label, and how far that length is from its source's usual one; it never looks at the text.

Each view is a logistic regression. In each of ``rounds``, each marks those of all unlabelled rows that it is surest of, in the
proportion of the labels, and hands them to the other view as pseudo-labels. They weigh what the view is worth: twice
the probability by which it ranks a good calibration row above a bad one better than chance (nothing for a view that
can't tell them apart). Then each view's score is calibrated (Platt) on rows
that no view was trained on, and a logistic combination of both, fitted on the same rows, scores all documents.
``fit_quality`` also reports, for each round and view, the ranking quality, the weight and the labels handed over.

Features are written once, without texts; all rounds and the final scores read them. Calibration rows are a third of
the labelled ones by a hash of the key; the means of sources and languages cover all others. The regressions are fitted on
at most ``max_labelled`` labelled rows, those with the smallest hash of the key (a documented bound), and on the
pseudo-labels; the unlabelled rows to choose from are all there are.
Rows whose crc32(key as text) mod 5 is 0 are held out of everything.

Defined results: null and empty texts and null metadata have features of their own; several labels of one key count
as their least; without rows of both labels every score is the share of good labels (1 without any); repeated rows
each get a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, columns_or_null, hash_sample, small
from .tokens import chunks
from .toxicity import held_out

KINDS = 12


def kinds_of_bytes() -> np.ndarray:
    """Kind of each UTF-8 byte: letters, digits, blanks, line ends and some marks; 0 is anything else."""
    k = np.zeros(256, np.int64)
    k[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = 1
    k[ord("A") : ord("Z") + 1] = 2
    k[ord("0") : ord("9") + 1] = 3
    for i, chars in enumerate((" \t", "\n\r", ".", ",;:", "!?", "|", "$#&*%@^~", "\"'()-"), 4):
        k[[ord(c) for c in chars]] = i
    return k


def content_features(texts: list[str | None]) -> np.ndarray:
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    size = np.array([len(r) for r in raw], np.int64)
    k = kinds_of_bytes()[np.frombuffer(b"".join(raw), np.uint8)]
    row = np.repeat(np.arange(len(raw)), size)
    same = row[1:] == row[:-1]
    code = row[1:][same] * KINDS * KINDS + k[:-1][same] * KINDS + k[1:][same]
    pairs = np.bincount(code, minlength=len(raw) * KINDS * KINDS).reshape(len(raw), -1) / np.maximum(size - 1, 1)[:, None]
    words = np.zeros((len(raw), 4))
    for i, r in enumerate(raw):
        w = r.split()
        if w:
            n = len(w)
            words[i] = sum(map(bytes.__eq__, w, w[1:])) / n, (len(set(w)) / n) ** 0.5, sum(map(len, w)) / n / 10, np.log1p(n) / 10
    return np.concatenate([np.sqrt(pairs), words], 1)


def _with_content(batches):
    """The text's features in its place."""
    for b in chunks(batches, 1 << 20):
        f = content_features(b.column("text").to_pylist()).astype(np.float32)
        names = [c for c in b.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array([x.tobytes() for x in f], pa.binary())], [*names, "f"])


def views_of(b: pa.RecordBatch) -> list[np.ndarray]:
    f = np.frombuffer(b"".join(b.column("f").to_pylist()), np.float32).reshape(b.num_rows, -1).astype(float)
    return [f, np.array(b.column("m").to_pylist(), float).reshape(b.num_rows, -1)]


class Logistic:
    """Standardised, weight-decayed logistic regression with row weights (Newton steps)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, decay: float = 1e-3):
        w8 = np.ones(len(y)) if weight is None else weight
        self.mean, self.sd = x.mean(0), x.std(0)
        self.sd[self.sd < 1e-9] = 1.0
        z = np.column_stack([(x - self.mean) / self.sd, np.ones(len(x))])
        b = np.zeros(z.shape[1])
        ridge = np.full(z.shape[1], decay * w8.sum())
        ridge[-1] = 1e-6 * w8.sum()
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
            g = z.T @ (w8 * (p - y)) + ridge * b
            s = np.linalg.solve((z * (w8 * p * (1 - p))[:, None]).T @ z + np.diag(ridge), g)
            b -= s * min(1.0, 5.0 / max(1e-9, np.abs(s).max()))
            if np.abs(s).max() < 1e-6:
                break
        self.b = b

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.sd, -20, 20) @ self.b[:-1] + self.b[-1]


def ranking_quality(score: np.ndarray, y: np.ndarray) -> float:
    """Probability that a row of label 1 scores above one of label 0."""
    n1, n0 = int(y.sum()), int((1 - y).sum())
    if not n1 or not n0:
        return 0.5
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    values, inv, cnt = np.unique(score[order], return_inverse=True, return_counts=True)
    rank[order] = (np.cumsum(cnt) - (cnt - 1) / 2)[inv]
    return float((rank[y > 0].sum() - n1 * (n1 + 1) / 2) / (n1 * n0))


class CoTraining:
    """Two views of the labelled rows, what they hand each other, and the models; rows of `keep` only calibrate."""

    def __init__(self, views: list[np.ndarray], y: np.ndarray, keep: np.ndarray):
        self.views, self.y, self.keep, self.report = views, y, keep, []
        self.given: list[list[tuple[np.ndarray, int, float]]] = [[], []]  # features, pseudo-label, weight
        self.rate = float(y[~keep].mean())

    def balance(self, y: np.ndarray) -> np.ndarray:
        return np.where(y > 0, 0.5 / max(self.rate, 1e-9), 0.5 / max(1 - self.rate, 1e-9))

    def fit(self, v: int) -> Logistic:
        own, y = self.views[v][~self.keep], self.y[~self.keep]
        if not self.given[v]:
            return Logistic(own, y, self.balance(y))
        x, lab, w = (np.array(c) for c in zip(*self.given[v]))
        return Logistic(np.concatenate([own, x]), np.concatenate([y, lab]), np.concatenate([self.balance(y), w * self.balance(lab)]))

    def worth(self, v: int, model: Logistic) -> float:
        return max(0.0, 2 * ranking_quality(model.logit(self.views[v][self.keep]), self.y[self.keep]) - 1)

    def share(self, size: float) -> tuple[int, int]:
        """How many good and bad pseudo-labels a view hands over in a round."""
        n = max(2, int(size * (~self.keep).sum()))
        return max(1, round(n * self.rate)), max(1, round(n * (1 - self.rate)))

    def finish(self):
        models = [self.fit(v) for v in (0, 1)]
        on = self.keep if self.keep.any() else ~self.keep
        raw = [m.logit(self.views[v][on]) for v, m in enumerate(models)]
        platt = [Logistic(r[:, None], self.y[on]) for r in raw]
        return models, platt, Logistic(np.column_stack([p.logit(r[:, None]) for p, r in zip(platt, raw)]), self.y[on])


def surest(models: list[Logistic], most: tuple[int, int]):
    """Rows of a task -> kind (2 * view + label), rank, h, f, m of those that each view is surest of; ties by h."""

    def run(batches):
        best: list[list[tuple]] = [[], [], [], []]
        for b in chunks(batches, 4 << 20):
            x, h = views_of(b), b.column("h").to_numpy()
            f, m = b.column("f"), b.column("m")
            for v in (0, 1):
                s = models[v].logit(x[v])
                for label in (0, 1):
                    rank, n = (-s if label else s), most[0] if label else most[1]
                    some = np.flatnonzero(rank < 0)  # only rows on its side of even odds
                    some = some[np.lexsort((h[some], rank[some]))[:n]]
                    kind = best[2 * v + label]
                    kind += [(float(rank[i]), int(h[i]), f[int(i)].as_py(), m[int(i)].as_py()) for i in some]
                    kind.sort(key=lambda r: r[:2])
                    del kind[n:]
        rows = [(k, *r) for k, kind in enumerate(best) for r in kind]
        if rows:
            kinds = (pa.int32(), pa.float64(), pa.int64(), pa.binary(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["kind", "rank", "h", "f", "m"])

    return run


def metadata(rows: DataFrame, known: DataFrame, rate: float, scratch: Scratch) -> DataFrame:
    """rows with the metadata view m; known: the rows with labels that may be learned from."""
    size = F.log1p(F.greatest(F.coalesce("n_chars", F.lit(0)), F.lit(0)).cast("double"))

    def keyed(df: DataFrame) -> DataFrame:
        df = df.withColumns({"_source": F.coalesce("source", F.lit("")), "_lang": F.coalesce("lang", F.lit("")), "_size": size})
        return df.withColumn("_bin", F.floor(F.col("_size")).cast("int"))

    rows, known = keyed(rows), keyed(known)
    usual = known.groupBy("_source").agg(F.avg("_size").alias("_usual"))
    rows = rows.join(small(scratch.save(usual, "usual"), 80), "_source", "left")
    names = []
    for by in (["_source"], ["_lang"], ["_bin"], ["_source", "_lang", "_bin"]):
        name = "mean" + "".join(by)
        m = known.groupBy(*by).agg(((F.sum("quality") + 20 * rate) / (F.count("*") + 20)).alias(name))
        rows = rows.join(small(scratch.save(m, name), 160), by, "left")
        names.append(F.coalesce(name, F.lit(rate)))
    off = F.coalesce(F.col("_size") - F.col("_usual"), F.lit(0.0))
    view = F.array(*names, "_size", F.col("_size") * F.col("_size"), off, F.abs(off), F.col("n_chars").isNull().cast("double"))
    return rows.withColumn("m", view)


def calibrates(key: str = "doc_id"):
    """The third of the labelled rows that only calibrate."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(3)), F.lit(3)) == 0


def fit_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, rounds: int = 5, share: float = 0.05, max_labelled: int = 20_000):
    """The features of all rows (doc_id, held_out, m, f) and the fitted models; a share of good labels where there is nothing to fit."""
    scratch = Scratch(spark, "quality")
    rows = columns_or_null(docs, {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}).withColumn("held_out", held_out())
    own = columns_or_null(labels, {"doc_id": "bigint", "quality": "int"}).where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    own = scratch.save(own.where(~held_out()), "labels")
    known = rows.select("doc_id", "lang", "source", "n_chars").join(small(own, 64), "doc_id").withColumn("calibrates", calibrates())
    counts = {(r.calibrates, r.quality): r.n for r in known.groupBy("calibrates", "quality").agg(F.count("*").alias("n")).collect()}
    n, good = sum(counts.values()), sum(v for (_, q), v in counts.items() if q)
    if not 0 < good < n:
        return rows, good / n if n else 1.0
    split = all(counts.get((c, q)) for c in (True, False) for q in (0, 1))  # else everything is fitted and calibrated on all rows
    known = known.where("not calibrates") if split else known
    rate = sum(v for (c, q), v in counts.items() if q and not (split and c)) / sum(v for (c, _), v in counts.items() if not (split and c))
    feats = metadata(rows, known, rate, scratch).select("doc_id", "held_out", F.xxhash64("doc_id").alias("h"), "m", "text")
    feats = scratch.save(feats.mapInArrow(_with_content, "doc_id bigint, held_out boolean, h bigint, m array<double>, f binary"), "features")
    picked = F.broadcast(hash_sample(own, "doc_id", max_labelled, n)) if n > max_labelled else small(own, 64)
    got = feats.join(picked, "doc_id").select("doc_id", "h", "quality", "m", "f", calibrates().alias("c")).toPandas()  # bounded by max_labelled
    got = got.sort_values(["h", "quality"], kind="stable").reset_index(drop=True)
    y = got["quality"].to_numpy(float)
    keep = got["c"].to_numpy(bool) if split else np.zeros(len(y), bool)
    if len({*y[keep]}) < 2 or len({*y[~keep]}) < 2:
        keep = np.zeros(len(y), bool)
    co = CoTraining([np.stack([np.frombuffer(x, np.float32) for x in got["f"]]).astype(float), np.stack(list(got["m"])).astype(float)], y, keep)
    pool = feats.where("not held_out and doc_id is not null").join(small(own.select("doc_id"), 64), "doc_id", "left_anti").select("h", "m", "f")
    taken: list[set[int]] = [set(), set()]  # h of the rows that a view was handed
    for r in range(rounds if keep.any() else 0):
        models, most = [co.fit(v) for v in (0, 1)], co.share(share)
        need = tuple(m + len(taken[0] | taken[1]) for m in most)  # so that enough are left without those taken
        tops = scratch.save(pool.mapInArrow(surest(models, need), "kind int, rank double, h bigint, f binary, m array<double>"), "tops")
        for v, model in enumerate(models):
            worth, handed = co.worth(v, model), {}
            for label in (0, 1):
                rows_ = tops.where(F.col("kind") == 2 * v + label).orderBy("rank", "h").limit(need[1 - label]).collect()  # bounded
                new: dict[int, object] = {}
                for x in rows_:
                    if x.h not in taken[1 - v] and x.h not in new and len(new) < most[1 - label]:
                        new[x.h] = x
                if worth:
                    taken[1 - v] |= new.keys()
                    other = [np.frombuffer(x.f, np.float32).astype(float) if v == 1 else np.array(x.m) for x in new.values()]
                    co.given[1 - v] += [(x, label, 0.5 * worth) for x in other]
                handed[label] = len(new) if worth else 0
            co.report.append({"round": r, "view": ("content", "metadata")[v], "ranking": (worth + 1) / 2, "weight": 0.5 * worth, "good": handed[1], "bad": handed[0]})
        scratch.drop(tops)
    scratch.keep_only(feats)
    return feats, co


def score_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, text_score, meta_score, score, predicted, keep for every row of docs.

    docs: doc_id, text, lang, source, n_chars; labels: doc_id, quality. Scores are calibrated probabilities of label 1;
    predicted is 1 and keep true where score >= 0.5.
    """
    feats, co = fit_quality(spark, docs, labels, **how)
    if isinstance(co, float):
        out = feats.select("doc_id", "held_out", *[F.lit(co).alias(c) for c in ("text_score", "meta_score", "score")])
        return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumn("keep", F.col("score") >= 0.5)
    models, platt, top = co.finish()

    def run(batches):
        for b in chunks(batches):
            x = views_of(b)
            part = [platt[v].logit(models[v].logit(x[v])[:, None]) for v in (0, 1)]
            s = [1 / (1 + np.exp(-np.clip(z, -40, 40))) for z in (*part, top.logit(np.column_stack(part)))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), *map(pa.array, s)], ["doc_id", "held_out", "text_score", "meta_score", "score"])

    out = feats.select("doc_id", "held_out", "m", "f").mapInArrow(run, "doc_id bigint, held_out boolean, text_score double, meta_score double, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumn("keep", F.col("score") >= 0.5)
