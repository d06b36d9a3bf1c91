"""Operator 1, n-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document's set holds the 64-bit hashes of its distinct word n-grams. Two sets link when
``num/den`` of their union is shared. In an order of the n-grams from rare to frequent, two sets that link share one
of the first n - ceil(num/den * n) + 1 of each; so only these prefixes are indexed and joined.

* Exact copies (equal sets, by a 128-bit hash) are one node, whatever their number.
* The order needs no exact counts to be right, only to be the same everywhere: each task counts the n-grams of all
  its documents and reports those that it saw in several; their summed counts come last in the order, all others
  first, by hash. At most ``order_entries`` counts are sent out
  (16 bytes each), those from some power of two on.
* A prefix entry carries the set's size and how much of the set follows it. Length filter: sizes within num/den.
  Positional filter: what follows in both must suffice for the overlap. Suffix filter: the sets' counts over 64
  cells of the hash range (up to 255 each) bound their difference from below.
* An n-gram's list of a group of near copies would give all their pairs. So first one centre of each list of more
  than ``few`` entries is verified against the others, one centre a document; found links join components, and pairs
  inside one component need no further look. A round makes no more pairs than documents; another one, with other
  centres, follows while half of the pairs link (``star_rounds`` at most).
* Then the lists are dealt in tiles of ``tile`` by ``tile`` entries; entries of
  a long list's largest component meet only the others. The three filters run inside the tile, and only pairs that
  pass all of them leave it. Nothing is left out.
* Each distinct pair is verified once, on the full sets, which are made only for documents in such pairs. The end
  with more pairs is the centre, sent once to each block of at most about ``block`` of its partners, so no document's set is
  copied for each of its pairs and no task holds all pairs of one.

Defined results: null, empty and blank texts have no n-grams and link with nothing; shorter texts have one n-gram,
all their words; rows that share a key are one node, linked by any of their texts; a null key has its own null component; extra columns go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, columns_or_null, components, partitions, small
from .tokens import chunks, worker_cached

ORDER_ENTRIES = 500_000
CELLS = 64
BITS = 6


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word n-grams."""

    def __init__(self, n: int, cache_words: int = 120_000):
        import xxhash

        digest = xxhash.xxh3_64_intdigest

        class Words(dict):
            def __missing__(self, word: bytes) -> int:
                h = self[word] = digest(word)
                return h

        self.n, self.words, self.limit = n, Words(), cache_words
        self.key = xxhash.xxh3_128_digest

    def hashes(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint64)
        # bytes.lower() changes A-Z alone; bytes.split() parts at 09-0D and 20 alone
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.words) > self.limit:
            self.words.clear()
        w = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        k = min(self.n, len(w))
        h = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):
            h = (h ^ w[i : len(w) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h = np.sort(h)
        return h[np.concatenate([[True], h[1:] != h[:-1]])]

    def keys(self, h: np.ndarray) -> tuple[int, int]:
        d = self.key(h.tobytes())
        return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def shingler(n: int) -> Shingler:
    return worker_cached(("shingler", n), lambda: Shingler(n))


META = "kind int, doc_id bigint, k1 bigint, k2 bigint, n int, cells binary, shingle bigint, seen bigint"
META_NAMES = [x.split(" ")[0] for x in META.split(", ")]


def cells_of(h: np.ndarray) -> bytes:
    """How many hashes fall in each cell of the hash range, up to 255."""
    return np.minimum(np.bincount((h >> np.uint64(64 - BITS)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8).tobytes()


def _profiles(n: int, window: int = 1 << 20):
    """Kind 0: a row for each document; kind 1: n-grams that several documents of a window of the task hold."""

    def frequent(held):
        if not held:
            return
        h, c = np.unique(np.concatenate(held), return_counts=True)
        h, c = h[c >= 3].view(np.int64), c[c >= 3]
        m = len(h)
        null = lambda t: pa.nulls(m, t)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ones(m, np.int32)), null(pa.int64()), null(pa.int64()), null(pa.int64()), null(pa.int32()), null(pa.binary()), pa.array(h), pa.array(c.astype(np.int64))],
            META_NAMES,
        )

    def run(batches):
        s, held, size = shingler(n), [], 0
        for b in chunks(batches, 1 << 20):
            sets = [s.hashes(t) for t in b.column("text").to_pylist()]
            keys = [s.keys(h) if len(h) else (None, None) for h in sets]
            m = len(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.zeros(m, np.int32)), b.column("doc_id"), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                    pa.array([len(h) for h in sets], pa.int32()), pa.array([cells_of(h) for h in sets], pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()),
                ],
                META_NAMES,
            )
            held += sets
            size += sum(map(len, sets))
            if size >= window:
                yield from frequent(held)
                held, size = [], 0
        yield from frequent(held)

    return run


def _prefixes(n: int, num: int, den: int, hot, kept: int = 50_000):
    """The index entries of each distinct set of a task: n-gram, set key, size, how many n-grams from here on."""

    def run(batches):
        s, known = shingler(n), set()
        order = np.frombuffer(hot.value, np.uint64).reshape(2, -1)
        for b in chunks(batches, 1 << 20):
            cols: tuple[list, ...] = ([], [], [], [], [])
            for text in b.column("text").to_pylist():
                h = s.hashes(text)
                if not len(h):
                    continue
                key = s.keys(h)
                if key in known:
                    continue
                if len(known) >= kept:
                    known.clear()
                known.add(key)
                p = len(h) - -(-num * len(h) // den) + 1
                if order.shape[1]:
                    at = np.searchsorted(order[0], h)
                    at[at == order.shape[1]] = 0
                    count = np.where(order[0][at] == h, order[1][at], np.uint64(0))
                    rare = np.flatnonzero(count == 0)
                    first = h[rare[:p]] if len(rare) >= p else h[np.lexsort((h, count))[:p]]
                else:
                    first = h[:p]
                m = len(first)
                for col, v in zip(cols, (first.view(np.int64), np.full(m, key[0]), np.full(m, key[1]), np.full(m, len(h), np.int32), np.arange(len(h), len(h) - m, -1, dtype=np.int32))):
                    col.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["shingle", "k1", "k2", "n", "rest"])

    return run


def _sets(n: int):
    """The sorted hashes of each text as bytes."""

    def run(batches):
        s = shingler(n)
        for b in chunks(batches, 1 << 20):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([s.hashes(t).tobytes() for t in b.column("text").to_pylist()], pa.binary())], ["rep", "hashes"])

    return run


def near_in_tiles(group: np.ndarray, side: np.ndarray, rep: np.ndarray, comp: np.ndarray, n: np.ndarray, rest: np.ndarray, cells: np.ndarray, num: int, den: int, slice_pairs: int = 1 << 16):
    """Pairs of places (i, j) of one group, of different components, that pass the length, positional and suffix filter.

    Rows of a group lie together. Rows of side 0 meet those of side 1 only; rows of side 2 meet each other.
    """
    last = np.searchsorted(group, group, "right")  # where each row's group ends
    here = np.arange(len(group))
    step = 1
    while True:
        here = here[here + step < last[here]]
        if not len(here):
            return
        for at in range(0, len(here), slice_pairs):
            i = here[at : at + slice_pairs]
            j = i + step
            total = n[i] + n[j]
            least = -(-num * total // (num + den))  # what two sets of these sizes must share
            ok = (rep[i] != rep[j]) & (comp[i] != comp[j]) & ((side[i] != side[j]) | (side[i] == 2)) & (n[i] * den >= n[j] * num) & (n[j] * den >= n[i] * num) & (np.minimum(rest[i], rest[j]) >= least)
            if not ok.any():
                continue
            i, j, most = i[ok], j[ok], (total - 2 * least)[ok]
            apart = np.abs(cells[i].astype(np.int16) - cells[j]).sum(1, dtype=np.int64)
            ok = apart <= most
            if ok.any():
                yield i[ok], j[ok]
        step += 1


def _tile_pairs(num: int, den: int, rows: int = 1 << 15):
    """Rows sorted by tile (shingle, x, y) -> a, b: the distinct pairs of representatives that pass the filters."""
    names = ("shingle", "x", "y", "side", "rep", "comp", "n", "rest")

    def solve(cols, cells):
        same = (cols["shingle"][1:] == cols["shingle"][:-1]) & (cols["x"][1:] == cols["x"][:-1]) & (cols["y"][1:] == cols["y"][:-1])
        group = np.concatenate([[0], np.cumsum(~same)])
        found = list(near_in_tiles(group, cols["side"], cols["rep"], cols["comp"], cols["n"].astype(np.int64), cols["rest"], cells, num, den))
        if found:
            i, j = (np.concatenate(x) for x in zip(*found))
            pair = np.unique(np.stack([np.minimum(cols["rep"][i], cols["rep"][j]), np.maximum(cols["rep"][i], cols["rep"][j])]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["a", "b"])

    def run(batches):
        held, size = [], 0

        def joined():
            cols = {c: np.concatenate([h[c] for h in held]) for c in names}
            return cols, np.concatenate([h["cells"] for h in held])

        for b in chunks(batches, 2 << 20):
            part = {c: b.column(c).to_numpy() for c in names}
            part["cells"] = np.frombuffer(b"".join(b.column("cells").to_pylist()), np.uint8).reshape(-1, CELLS)
            held.append(part)
            size += b.num_rows
            if size >= rows:
                cols, cells = joined()
                tail = (cols["shingle"] == cols["shingle"][-1]) & (cols["x"] == cols["x"][-1]) & (cols["y"] == cols["y"][-1])
                cut = int(np.argmax(tail))  # the last tile may go on
                if cut:
                    yield from solve({c: v[:cut] for c, v in cols.items()}, cells[:cut])
                held, size = [{**{c: v[cut:] for c, v in cols.items()}, "cells": cells[cut:]}], len(tail) - cut
        if size:
            yield from solve(*joined())

    return run


def _shared_enough(num: int, den: int):
    """Rows sorted by block of a centre, the centre's sets first -> a, b: the pairs that link."""

    def run(batches):
        centre, sets = None, []
        for b in chunks(batches, 2 << 20):
            out: tuple[list, list] = ([], [])
            for l, block, kind, r, h in zip(*(b.column(c).to_pylist() for c in ("l", "block", "kind", "r", "hashes"))):
                h = np.frombuffer(h, np.uint64)
                if (l, block) != centre:
                    centre, sets = (l, block), []
                if not kind:
                    sets.append(h)
                    continue
                for s in sets:
                    if not len(s) or not len(h):
                        continue
                    at = np.searchsorted(s, h)
                    at[at == len(s)] = 0
                    shared = int((s[at] == h).sum())
                    if shared * den >= num * (len(s) + len(h) - shared):
                        out[0].append(min(l, r))
                        out[1].append(max(l, r))
                        break
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], ["a", "b"])

    return run


class Join:
    """One join; links() gives the components of the documents."""

    def __init__(self, spark: SparkSession, docs: DataFrame, n: int, num: int, den: int, order_entries: int = ORDER_ENTRIES, star_rounds: int = 6, few: int = 8, tile: int = 512, block: int = 256):
        self.spark, self.n, self.num, self.den = spark, n, num, den
        self.scratch = Scratch(spark, "ngram-join")
        self.docs = columns_or_null(docs, {"doc_id": "bigint", "text": "string"})
        self.order_entries, self.star_rounds, self.few, self.tile, self.block = order_entries, star_rounds, few, tile, block

    def feasible(self, n: str, rest: str, m: str, left: str):
        """Length and positional filter for two entries by their sizes and what follows."""
        length = (F.col(n) * self.den >= F.col(m) * self.num) & (F.col(m) * self.den >= F.col(n) * self.num)
        least = F.expr(f"((bigint({n}) + {m}) * {self.num}L + {self.num + self.den - 1}L) div {self.num + self.den}L")
        return length & (F.least(rest, left) >= least)

    def prepare(self) -> None:
        rows = self.profiles = self.scratch.save(self.docs.mapInArrow(_profiles(self.n), META), "profiles")
        self.meta = rows.where("kind = 0").select("doc_id", "k1", "k2", "n")
        seen = self.scratch.save(rows.where("kind = 1").groupBy("shingle").agg(F.sum("seen").alias("seen")), "seen")
        # the counts from a power of two on, as many as fit: a histogram of the powers tells which, without a sort
        powers = {r.p: r.n for r in seen.groupBy(F.floor(F.log2("seen")).alias("p")).agg(F.count("*").alias("n")).collect()}
        least, total = max(powers, default=0) + 1, 0
        while least - 1 in range(0, 64) and total + powers.get(least - 1, 0) <= self.order_entries:
            least -= 1
            total += powers.get(least, 0)
        hot = seen.where(F.col("seen") >= 2**least).toPandas()  # bounded by order_entries
        self.scratch.drop(seen)
        h, c = hot["shingle"].to_numpy(np.int64).view(np.uint64), hot["seen"].to_numpy(np.int64).view(np.uint64)
        by = np.argsort(h)
        self.hot = self.spark.sparkContext.broadcast(np.stack([h[by], c[by]]).tobytes())
        of = rows.where("kind = 0 and n > 0 and doc_id is not null")
        self.reps = self.scratch.save(of.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("cells").alias("cells")), "reps")

    def active_entries(self) -> DataFrame:
        """shingle, rep, n, rest, cells of the prefix entries whose n-gram is in the prefix of another set too."""
        entries = self.scratch.save(self.docs.select("text").mapInArrow(_prefixes(self.n, self.num, self.den, self.hot), "shingle bigint, k1 bigint, k2 bigint, n int, rest int"), "entries")
        shared = entries.groupBy("shingle").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).where("lo < hi").select("shingle")
        shared = self.scratch.save(shared, "often")  # written first: a join right above an aggregate could not split a hot n-gram
        active = entries.join(shared, "shingle").join(self.reps, ["k1", "k2"]).dropDuplicates(["k1", "k2", "shingle"])
        active = self.scratch.save(active.select("shingle", "rep", "n", "rest", "cells"), "active")
        self.scratch.drop(entries, shared)
        return active

    def verified(self, pairs: DataFrame, n_pairs: int) -> DataFrame:
        """Of the distinct pairs (a, b) of representatives, those that link."""
        ends = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep")))
        degree = ends.groupBy("rep").agg(F.count("*").alias("d"))
        turned = pairs.join(degree.select(F.col("rep").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("rep").alias("b"), F.col("d").alias("db")), "b")
        up = (F.col("da") > F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
        turned = turned.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("l"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("r"), F.greatest("da", "db").alias("d"))
        block = F.pmod(F.xxhash64("r"), F.ceil(F.col("d") / self.block)).cast("int")
        turned = self.scratch.save(turned.select("l", "r", block.alias("block")), "turned")
        wanted = ends.select(F.col("rep").alias("doc_id")).distinct()
        sets = self.docs.join(small(wanted, 64, 2 * n_pairs), "doc_id", "left_semi").mapInArrow(_sets(self.n), "rep bigint, hashes binary")
        sets = self.scratch.save(sets.distinct() if self.repeats else sets, "sets")
        members = turned.join(sets.withColumnRenamed("rep", "r"), "r").select("l", "block", F.lit(1).alias("kind"), "r", "hashes")
        centres = turned.select("l", "block").distinct().join(sets.withColumnRenamed("rep", "l"), "l").select("l", "block", F.lit(0).alias("kind"), F.col("l").alias("r"), "hashes")
        both = members.unionByName(centres).repartition(partitions(self.spark), "l", "block").sortWithinPartitions("l", "block", "kind")
        out = self.scratch.save(both.mapInArrow(_shared_enough(self.num, self.den), "a bigint, b bigint"), "links")
        self.scratch.drop(sets, turned)
        return out

    def with_comp(self, rows: DataFrame, comp: DataFrame | None) -> DataFrame:
        if comp is None:
            return rows.withColumn("comp", F.col("rep"))
        return rows.join(small(comp.select(F.col("node").alias("rep"), F.col("comp").alias("_c")), 64), "rep", "left").withColumn("comp", F.coalesce("_c", "rep")).drop("_c")

    def star_pairs(self, active: DataFrame, comp: DataFrame | None, r: int) -> DataFrame | None:
        """a, b: each document of a long open list with one centre of such a list; None without such lists."""
        rank = F.expr("(bigint(rest) << 32) | (xxhash64(rep) & 4294967295L)") if r == 0 else F.xxhash64("rep", F.lit(r))
        open_ = self.with_comp(active.select("shingle", "rep", "n", "rest"), comp)
        lists = open_.groupBy("shingle").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.struct(rank.alias("k"), "rep", "n", "rest", "comp")).alias("top"))
        lists = lists.where((F.col("m") > self.few) & (F.col("lo") < F.col("hi"))).select("shingle", F.col("top.rep").alias("l"), F.col("top.n").alias("m"), F.col("top.rest").alias("left"), F.col("top.comp").alias("cl"))
        lists = self.scratch.save(lists, "lists")
        n = lists.count()
        if not n:
            return None
        met = open_.join(small(lists, 128, n), "shingle").where((F.col("cl") != F.col("comp")) & self.feasible("n", "rest", "m", "left"))
        best = met.groupBy("rep", "l").agg(F.count("*").alias("c")).groupBy("rep").agg(F.max_by("l", F.struct("c", "l")).alias("l"))
        return best.select(F.least("rep", "l").alias("a"), F.greatest("rep", "l").alias("b")).distinct()

    def tile_pairs(self, active: DataFrame, comp: DataFrame | None) -> DataFrame:
        """a, b: the distinct pairs of different components that pass the filters, from tiles of all lists.

        Only lists longer than a tile need to be told apart: those of one component go, the others are split.
        """
        own = self.with_comp(active.select("shingle", "rep"), comp).groupBy("shingle", "comp").agg(F.count("*").alias("c"))
        lists = own.groupBy("shingle").agg(F.sum("c").alias("m"), F.count("*").alias("k"), F.max_by("comp", F.struct("c", "comp")).alias("major"), F.max("c").alias("c")).where(F.col("m") > self.tile)
        blocks = lambda x: F.ceil(x / self.tile).cast("int")
        lists = self.scratch.save(lists.select("shingle", "k", "major", blocks(F.col("m") - F.col("c")).alias("others"), blocks(F.col("c")).alias("majors")), "long")
        rows = self.with_comp(active, comp).join(small(lists, 96), "shingle", "left").where("k is null or k > 1")
        rows = rows.withColumns({"others": F.coalesce("others", F.lit(1)), "majors": F.coalesce("majors", F.lit(0))})
        rows = rows.withColumn("own", F.coalesce(F.col("comp") == F.col("major"), F.lit(False)))
        block = F.pmod(F.xxhash64("rep"), F.when(F.col("own"), F.col("majors")).otherwise(F.col("others"))).cast("int")
        # blocks of the largest component follow those of the others; a block of the others meets all blocks
        rows = rows.withColumn("block", F.when(F.col("own"), F.col("others")).otherwise(0) + block)
        meets = F.when(F.col("own"), F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("others") + F.col("majors") - 1))
        rows = rows.select("shingle", "rep", "comp", "n", "rest", "cells", "block", F.explode(meets).alias("other"))
        # inside a tile of two blocks only pairs across count: each block is a side there, and has its own tile too
        x, y = F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y")
        rows = rows.select("shingle", x, y, F.when(F.col("block") == F.col("other"), 2).otherwise((F.col("block") > F.col("other")).cast("int")).alias("side"), "rep", "comp", "n", "rest", "cells")
        rows = rows.repartition(partitions(self.spark), "shingle", "x", "y").sortWithinPartitions("shingle", "x", "y")
        return rows.mapInArrow(_tile_pairs(self.num, self.den), "a bigint, b bigint").distinct()

    def key_edges(self) -> DataFrame | None:
        """doc_id, rep of the rows whose key has rows of different sets; None where there are none."""
        rows = self.meta.where("doc_id is not null").join(self.reps.select("k1", "k2", "rep"), ["k1", "k2"], "left").select("doc_id", "rep")
        many = self.meta.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c"), F.count_distinct("k1").alias("k")).where("c > 1")
        many = self.scratch.save(many, "repeats")
        self.repeats = not many.isEmpty()
        return rows.join(small(many.select("doc_id"), 16), "doc_id", "left_semi").where("rep is not null").distinct() if self.repeats else None

    def links(self) -> DataFrame | None:
        """node, comp of the keys and representatives that are linked with another."""
        self.prepare()
        tied = self.key_edges()
        found = [] if tied is None else [self.scratch.save(tied.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "tied")]
        active, tried, comp = self.active_entries(), None, None

        def verify(pairs: DataFrame) -> float:
            """The share of pairs that link."""
            nonlocal tried, comp
            pairs = self.scratch.save(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
            n = pairs.count()
            if not n:
                return 0.0
            tried = pairs if tried is None else tried.unionByName(pairs)
            found.append(self.verified(pairs, n))
            comp = self.joined(found)
            return found[-1].count() / n

        for r in range(self.star_rounds):
            pairs = self.star_pairs(active, comp, r)
            if pairs is None or verify(pairs) < 0.5:
                break
        verify(self.tile_pairs(active, comp))
        comp = self.joined(found) if comp is None and found else comp
        self.scratch.keep_only(self.profiles, self.reps, *([] if comp is None else [comp]))
        return comp

    def joined(self, found: list[DataFrame]) -> DataFrame:
        edges = found[0]
        for f in found[1:]:
            edges = edges.unionByName(f)
        return components(self.scratch, edges)


def ngram_components(spark: SparkSession, docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, **how) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text); links: share of union >= num / den."""
    join = Join(spark, docs, n, num, den, **how)
    comp = join.links()
    rows = join.meta.join(join.reps.select("k1", "k2", "rep"), ["k1", "k2"], "left").withColumn("node", F.coalesce("rep", "doc_id"))
    if comp is not None:
        rows = rows.join(comp.select("node", "comp"), "node", "left").withColumn("node", F.coalesce("comp", "node"))
    own = F.when(F.col("doc_id").isNotNull(), F.col("node"))
    return rows.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), own.alias("component_id"))


def keep_one(spark: SparkSession, docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, **how) -> DataFrame:
    """docs without all but the smallest key of each component; rows that share a key stay or go together."""
    scratch = Scratch(spark, "keep-one")
    gone = ngram_components(spark, docs, n, num, den, **how).where("doc_id <> component_id").select("doc_id").distinct()
    gone = scratch.save(gone, "gone")
    return docs.join(small(gone, 16), "doc_id", "left_anti").select(*docs.columns)
