"""Operator 2, suffix-array dedup: difference-cover blockwise sorting of suffixes, distributed by content.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same or another text.
Such strings are windows; two equal windows are two suffixes whose common prefix reaches ``length``, neighbours in
the suffix array. The array of a whole corpus fits no machine, so it is built where suffixes can meet at all:

1. Every window owns an anchor, the place inside it whose 2**j-byte gram has the least hash (for 200 bytes, grams of
   64; the first of equals). Equal windows own equal grams at the same offset. The windows of one anchor follow one
   another; with the bytes that they cover they are a context, about 270 bytes, one for about every 70. Longer grams
   make fewer chance meetings, shorter ones fewer contexts.
2. Anchors whose gram occurs once own no repeated window. Where all contexts of a gram are equal, every window is
   repeated. Both are settled by counts that are pre-aggregated in every task. Only the different contexts of the
   other grams, each once however often it occurs, go on.
3. A task lays such contexts out as one block of text, each anchor on a multiple of the period of a difference
   cover, and ranks the cover's sample suffixes by prefix doubling. It then sorts one bucket of suffixes at a time:
   by gram and offset, the first 8 bytes, and long ties by the precomputed ranks of the two sample suffixes that
   cover the window; the few bytes before and behind these settle what remains. A block holds ``block_bytes`` and a
   bucket ``bucket_suffixes`` at most, or one gram's contexts.
4. A gram with more than ``hot_contexts`` different contexts would make one task's block too large. Its contexts are
   cut into narrower ones by the distance of their windows to the anchor and by what all windows of such a step
   share; equal ones are pre-aggregated, and the parts are sorted like any other gram's.

A second, longer length can be judged in the same sort: a context then reaches as far as the longer windows that
begin like its own, and windows tied at the shorter length are compared again where the longer ones end.

Texts are keyed by two hashes and their length, so copies share one result, whatever their number.

Defined results: null text is empty; texts shorter than ``length`` keep all bytes; repeated rows and copies of at
least that length lose all; null and repeated keys each keep their rows; extra columns stay in drop_repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, partitions, small
from .tokens import chunks, forget

KEY = ["t", "c", "len"]
#: A difference cover of the residues modulo 31: every difference is one of two members (a perfect difference set).
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)


class Anchors:
    """Content-chosen anchors of windows of `length` bytes."""

    def __init__(self, length: int):
        self.length = length
        self.gram = 1 << max(2, (length // 3).bit_length() - 1)
        self.span = length - self.gram + 1
        seed = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        seed ^= seed >> np.uint64(31)
        seed *= np.uint64(0xBF58476D1CE4E5B9)
        self.byte = seed ^ (seed >> np.uint64(29))

    def gram_hashes(self, text: np.ndarray) -> np.ndarray:
        h, m, mult = self.byte[text], 1, 0x94D049BB133111EB
        while m < self.gram:
            h = h[:-m] * np.uint64(mult) + h[m:]
            mult = (mult * mult * 5 + 2) & 0xFFFFFFFFFFFFFFFF | 1
            m *= 2
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return h

    def runs(self, text: np.ndarray, ends: np.ndarray, piece: int = 1 << 19):
        """first window, last window, anchor, gram hash of each run of windows of one text with one anchor.

        The windows are taken in pieces of `piece`, so a very long text takes no more memory than others and the
        order of anchors (38 bits of hash, then the place) is the same for all.
        """
        n, L, w = len(text), self.length, self.span
        if n < L:
            return None
        starts = np.concatenate([[0], ends[:-1]])
        ok = ends - starts >= L
        opens, shuts = starts[ok], ends[ok] - L + 1
        low, out = np.uint64((1 << 26) - 1), []
        for a in range(0, n - L + 1, piece):
            z = min(a + piece, n - L + 1)
            edge = np.zeros(z - a + 1, np.int32)
            i, j = np.searchsorted(shuts, a, "right"), np.searchsorted(opens, z, "left")
            np.add.at(edge, np.clip(opens[i:j], a, z) - a, 1)
            np.add.at(edge, np.clip(shuts[i:j], a, z) - a, -1)
            at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            if not len(at):
                continue
            h = self.gram_hashes(text[a : z + L - 1])
            key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
            padded = np.full(-(-len(key) // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
            padded[: len(key)] = key
            grid = padded.reshape(-1, w)
            ahead = np.minimum.accumulate(grid, axis=1).ravel()
            behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
            own = (np.minimum(behind[: z - a], ahead[w - 1 : w - 1 + z - a]) & low).astype(np.int64)[at]
            new = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(own) != 0)])
            first = np.flatnonzero(new)
            last = np.concatenate([first[1:], [len(at)]]) - 1
            out.append((at[first] + a, at[last] + a, own[first] + a, h[own[first]]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else None


def binary_slices(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, joined, and where each value ends."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def _anchor_rows(length: int, longest: int, kept: int = 100_000):
    """The contexts of a task's texts; a context reaches as far as the longest windows that begin like its own."""

    def run(batches):
        import xxhash

        forget()
        anchors, seen = Anchors(length), {}
        for b in chunks(batches, 1 << 19):
            text, ends = binary_slices(b.column("text"))
            found = anchors.runs(text, ends)
            if found is None:
                continue
            first, last, at, gram = found
            t, c = b.column("t").to_numpy(), b.column("c").to_numpy()
            row = np.searchsorted(ends, first, "right")
            begins = np.concatenate([[0], ends[:-1]])
            often = np.zeros(len(ends), bool)  # a third copy in a task adds nothing
            for i in np.unique(row).tolist():
                k = (int(t[i]), int(c[i]))
                seen[k] = n = seen.get(k, 0) + 1
                often[i] = n > 2
            if len(seen) > kept:
                seen.clear()
            keep = ~often[row]
            first, last, at, row, gram = first[keep], last[keep], at[keep], row[keep], gram[keep]
            view, digest = memoryview(text), xxhash.xxh3_64_intdigest
            stop = np.minimum(last + longest, ends[row])
            seeds = (at - first) | (last - first) << 20
            ctx = np.fromiter((digest(view[a:z], seed=s) for a, z, s in zip(first.tolist(), stop.tolist(), seeds.tolist())), np.uint64, len(first))
            size = ends - begins
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(t[row]), pa.array(c[row]), pa.array(size[row].astype(np.int32)), pa.array(gram.view(np.int64)), pa.array(ctx.view(np.int64)),
                    pa.array((first - begins[row]).astype(np.int32)), pa.array((last - begins[row]).astype(np.int32)), pa.array((at - first).astype(np.int32)),
                ],
                [*KEY, "gram", "ctx", "first", "last", "off"],
            )

    return run


ANCHOR_SCHEMA = "t bigint, c bigint, len int, gram bigint, ctx bigint, first int, last int, off int"
BODIES = "gram bigint, ctx bigint, off int, wins int, n bigint, body binary"
BODY_NAMES = [x.split(" ")[0] for x in BODIES.split(", ")]


def _body_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 6, kinds)], BODY_NAMES)


def _cut_contexts(longest: int, most: int = 4 << 20):
    """Rows of texts with the list of wanted contexts -> a row for each, with its bytes."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                text, rows, size = b.column("text")[i].as_py(), [], 0
                for w in b.column("want")[i].as_py():
                    body = text[w["first"] : w["last"] + longest]
                    rows.append((w["gram"], w["ctx"], w["off"], w["last"] - w["first"] + 1, w["n"], body))
                    size += len(body)
                    if size >= most:
                        yield _body_rows(rows)
                        rows, size = [], 0
                yield _body_rows(rows)

    return run


#: Windows of a split context: those whose distance to the anchor falls in one such step.
SPLIT = 8


def split_contexts(rows, length: int, longest: int):
    """Contexts of a gram with too many -> narrower ones: gram, ctx, off, wins, n, body and the old gram, ctx and place.

    The windows whose anchor lies SPLIT * g to SPLIT * (g + 1) - 1 bytes on share all but SPLIT - 1 bytes at either
    end; equal windows agree in what is shared. So its hash joins g in the new gram.
    """
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    for gram, ctx, off, wins, n, body in rows:
        for g in range((off - wins + 1) // SPLIT, off // SPLIT + 1):
            lo, hi = max(0, off - SPLIT * g - SPLIT + 1), min(wins, off - SPLIT * g + 1)  # windows [lo, hi)
            begin = off - SPLIT * g  # what all windows of the step hold
            shared = body[begin : begin + length - SPLIT + 1]
            new = digest(shared, seed=(gram ^ (g << 7)) & 0xFFFFFFFFFFFFFFFF)
            part = body[lo : hi - 1 + longest]
            own = digest(part, seed=(off - lo) | (hi - lo) << 20)
            signed = lambda x: x - (1 << 64) if x >> 63 else x
            yield signed(new), signed(own), off - lo, hi - lo, n, part, gram, ctx, lo


def _split_rows(length: int, longest: int):
    def run(batches):
        for b in chunks(batches, 1 << 18):
            rows = list(split_contexts(zip(*(b.column(x).to_pylist() for x in BODY_NAMES)), length, longest))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [*BODY_NAMES, "of_gram", "of_ctx", "place"])

    return run


def big_endian(text: np.ndarray) -> np.ndarray:
    """At each place the 8 bytes from there (nought behind the end) as one integer that sorts like them."""
    out = np.zeros(len(text), np.uint64)
    for i in range(8):
        out <<= np.uint64(8)
        out[: len(text) - i] |= text[i:]
    return out


def dense(keys: list[np.ndarray]) -> np.ndarray:
    """Ranks of rows under a lexicographic order of the key columns; equal rows share one."""
    by = np.lexsort(keys[::-1])
    new = np.zeros(len(by), bool)
    for k in keys:
        s = k[by]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(by), np.int64)
    out[by] = np.cumsum(new)
    return out


class SampleRanks:
    """Ranks of the cover's sample suffixes of a text by their first `reach` bytes (prefix doubling over the period).

    words: the text's big_endian, with room behind its n bytes; reach is `need` or little more, as a rank must not look past the window that it stands for.
    """

    def __init__(self, words: np.ndarray, n: int, need: int):
        place = (np.arange(0, n, PERIOD)[:, None] + np.array(COVER)).ravel()
        self.place = place[place < n]
        m, width = len(self.place), len(COVER)
        self.reach = need if need < 2 * PERIOD else 32
        rank = dense([words[self.place + x] for x in [*range(0, self.reach - 8, 8), self.reach - 8]])
        while self.reach < need:
            step = min(self.reach // PERIOD, -(-(need - self.reach) // PERIOD))  # periods
            behind = np.zeros(m, np.int64)  # the sample suffix `step` periods on is `step * width` rows on
            behind[: max(0, m - step * width)] = rank[step * width :] + 1
            key = rank * (m + 2) + behind
            rank = np.unique(key, return_inverse=True)[1]
            self.reach += step * PERIOD
        self.rank = rank
        index = np.full(PERIOD, -1)
        index[list(COVER)] = np.arange(width)
        self.index, self.width = index, width

    def of(self, at: np.ndarray) -> np.ndarray:
        return self.rank[at // PERIOD * self.width + self.index[at % PERIOD]]


def repeated_windows(bodies: list[bytes], offs: list[int], wins: list[int], gram: np.ndarray, length: int, longer: int = 0, bucket_suffixes: int = 1 << 19) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each context, which of its windows another context of its gram also has at the same offset.

    bodies: contexts, those of one gram together; offs: each one's anchor behind its first byte; wins: its windows.
    The second list tells the same of the windows of `longer` bytes (at most 2 * length) that begin at these places.
    """
    if length < 64 or longer and not length < longer <= 2 * length:
        raise ValueError("windows of at least 64 bytes are asked for, longer ones at most twice as long")
    sizes = np.array([len(b) for b in bodies])
    starts, at = np.empty(len(bodies), np.int64), 0
    parts = []
    for i, (b, o) in enumerate(zip(bodies, offs)):
        gap = -(at + o) % PERIOD  # the anchor falls on a multiple of the period
        parts += [bytes(gap), b]
        starts[i] = at + gap
        at += gap + len(b)
    words = big_endian(np.frombuffer(b"".join([*parts, bytes(2 * PERIOD + 64)]), np.uint8))
    ranks = SampleRanks(words, at, -(-length // 2))  # two of them, the second ending near the window's end, leave no gap
    ahead = np.array([min((d - r) % PERIOD for d in COVER) for r in range(PERIOD)])  # to the next place of the cover
    last = length - ranks.reach  # the second sample suffix starts here at the latest

    def ranks_at(place):
        """The two sample suffixes that cover windows, but for a few bytes before the first and behind the second."""
        d2 = last - (PERIOD - 1) + ahead[(place + last - (PERIOD - 1)) % PERIOD]
        return ranks.of(place + ahead[place % PERIOD]), ranks.of(place + d2)

    def edges_at(place):
        """Those bytes, and the first ones."""
        return [words[place + x] for x in (0, 8, 16, 24, length - 32, length - 24, length - 16, length - 8)]

    wins = np.asarray(wins, np.int64)
    total, offs = np.cumsum(wins), np.asarray(offs, np.int64)
    out, out_longer = [np.zeros(w, bool) for w in wins], [np.zeros(min(w, max(0, n - longer + 1)) if longer else 0, bool) for w, n in zip(wins, sizes)]
    lo = 0
    while lo < len(bodies):  # a bucket: whole grams
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + bucket_suffixes, "right")))
        while hi < len(bodies) and gram[hi] == gram[hi - 1]:
            hi += 1
        own = np.repeat(np.arange(lo, hi), wins[lo:hi])
        base = np.concatenate([[0], np.cumsum(wins[lo:hi])])
        k = np.arange(len(own)) - base[own - lo]
        place = starts[own] + k
        back = offs[own] - k  # bytes from the window to its anchor; may be that of the gram's start
        new_gram = np.concatenate([[False], gram[lo + 1 : hi] != gram[lo : hi - 1]])
        bucket = np.cumsum(new_gram)[own - lo] * (2 * length) + back
        # by gram, offset and first bytes; then ties alone by their ranks
        bits = np.uint64(int(bucket.max(initial=0)).bit_length())
        rows, group = tied_rows(bucket.astype(np.uint64) << np.uint64(64 - bits) | words[place] >> bits if bits else words[place])
        if len(rows):
            rows, group = tied_again(rows, group, *ranks_at(place[rows]))
            group = split_ties(group, edges_at(place[rows]))
            hit = np.zeros(len(own), bool)
            hit[rows[(np.bincount(group) > 1)[group]] if len(rows) else rows] = True
            for i in np.unique(own[hit] - lo).tolist():
                out[lo + i] = hit[base[i] : base[i + 1]]
            if longer:
                fits = hit[rows] & (k[rows] + longer <= sizes[own[rows]])
                rows, group = rows[fits], group[fits]
                tail = place[rows] + longer - length  # equal here and from here on: equal throughout
                rows, group = tied_again(rows, group, *ranks_at(tail))
                group = split_ties(group, edges_at(place[rows] + longer - length))
                hit = np.zeros(len(own), bool)
                hit[rows[(np.bincount(group) > 1)[group]] if len(rows) else rows] = True
                for i in np.unique(own[hit] - lo).tolist():
                    out_longer[lo + i] = hit[base[i] : base[i + 1]][: len(out_longer[lo + i])]
        lo = hi
    return out, out_longer


def tied_rows(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of values that occur again, equal ones together, and the number of each one's group."""
    by = np.argsort(key)
    s = key[by]
    same = np.concatenate([[False], s[1:] == s[:-1]])
    tied = same.copy()
    tied[:-1] |= same[1:]
    return by[tied], np.cumsum(~same[tied]) - 1


def tied_again(rows: np.ndarray, group: np.ndarray, r1: np.ndarray, r2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose group and both ranks some other row has too, and the new groups."""
    if not len(rows):
        return rows, group
    wide = int(max(r1.max(), r2.max())).bit_length()
    if int(group.max()).bit_length() + 2 * wide > 63:
        group, wide = dense([group, r1]), int(r2.max()).bit_length()
        key = group << wide | r2
    else:
        key = (group << wide | r1) << wide | r2
    again, group = tied_rows(key)
    return rows[again], group


def split_ties(group: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """Groups of rows (equal numbers must lie together) by further keys; only groups that differ inside are ranked anew."""
    if not len(group):
        return group
    group = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]).astype(np.int64)]))
    differ = np.zeros(len(group), bool)
    for e in keys:
        differ[1:] |= (e[1:] != e[:-1]) & (group[1:] == group[:-1])
    mixed = np.zeros(group[-1] + 1, bool)
    mixed[group[differ]] = True
    bad = mixed[group]
    if bad.any():
        group = group.copy()
        group[bad] = len(mixed) + dense([group[bad], *[e[bad] for e in keys]])
        group = np.unique(group, return_inverse=True)[1]
    return group


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1) - 1


FOUND = "gram bigint, ctx bigint, longer boolean, lo int, hi int"


def _sorted_blocks(length: int, longer: int, block_bytes: int, bucket_suffixes: int):
    """Bodies, sorted by gram -> gram, ctx, longer, lo, hi: runs of repeated windows of either length."""

    def solve(held):
        gram = np.array([r[0] for r in held])
        short, long_ = repeated_windows([r[5] for r in held], [r[2] for r in held], [r[3] for r in held], gram, length, longer, bucket_suffixes)
        cols: tuple[list, ...] = ([], [], [], [], [])
        for (g, ctx, _, _, n, _), *flags in zip(held, short, long_):
            for longer_too, f in enumerate(flags):
                if not len(f) or n == 1 and not f.any():
                    continue
                lo, hi = ([0], [len(f) - 1]) if n > 1 or f.all() else map(np.ndarray.tolist, _spans(f))
                for col, v in zip(cols, ([g] * len(lo), [ctx] * len(lo), [bool(longer_too)] * len(lo), lo, hi)):
                    col += v
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["gram", "ctx", "longer", "lo", "hi"])

    def run(batches):
        forget()
        held, size = [], 0
        for b in chunks(batches, 1 << 20):
            for row in zip(*(b.column(x).to_pylist() for x in BODY_NAMES)):
                if size >= block_bytes and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield solve(held)
        forget()

    return run


def _merged(batches):
    """Lists of [lo, hi) -> the maximal runs, packed as little-endian 32-bit pairs."""
    for b in batches:
        out: tuple[list, list] = ([], [])
        for spans in b.column("spans").to_pylist():
            for k in (0, 1):
                runs: list[list[int]] = []
                for s in sorted((x["lo"], x["hi"]) for x in spans if x["longer"] == bool(k)):
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s[1])
                    else:
                        runs.append(list(s))
                out[k].append(np.array(runs, "<i4").tobytes())
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in KEY), *(pa.array(o, pa.binary()) for o in out)], [*KEY, "runs", "longer_runs"])


def keyed(docs: DataFrame) -> DataFrame:
    """docs with the text's bytes (column _body) and its key."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({"_body": text.cast("binary"), "t": F.xxhash64(text), "c": F.crc32(text.cast("binary")), "len": F.octet_length(text).cast("int")})


def repeated_runs(spark: SparkSession, docs: DataFrame, length: int = 400, longer: int = 0, block_bytes: int = 4 << 20, bucket_suffixes: int = 1 << 19, hot_contexts: int = 8_000) -> DataFrame:
    """t, c, len, runs, longer_runs: the maximal removed runs of each text that has any. docs: a column text.

    longer: a second length, at most twice the first, whose windows are judged in the same sort (0: none).
    """
    scratch, longest = Scratch(spark, "suffix-dedup"), longer or length
    texts = keyed(docs.select("text")).where(F.col("len") >= length).select(F.col("_body").alias("text"), *KEY)
    rows = scratch.save(texts.mapInArrow(_anchor_rows(length, longest), ANCHOR_SCHEMA), "anchors")
    shared = rows.groupBy("gram").agg(F.count("*").alias("n"), F.min("ctx").alias("a"), F.max("ctx").alias("b")).where("n > 1").select("gram", (F.col("a") < F.col("b")).alias("mixed"))
    shared = scratch.save(shared, "shared")  # written first: a join right above an aggregate could not split a hot gram
    met = scratch.save(rows.join(shared, "gram"), "met")
    scratch.drop(rows, shared)

    equal = met.where("not mixed")
    plain = equal.select(*KEY, F.lit(False).alias("longer"), F.col("first").alias("lo"), (F.col("last") + length).alias("hi"))
    if longer:
        plain = plain.unionByName(equal.where(F.col("first") + longer <= F.col("len")).select(*KEY, F.lit(True).alias("longer"), F.col("first").alias("lo"), F.least(F.col("last") + longer, F.col("len")).alias("hi")))

    mixed = met.where("mixed")
    one = mixed.groupBy("gram", "ctx").agg(F.count("*").alias("n"), *[F.first(x).alias(x) for x in [*KEY, "first", "last", "off"]])
    one = scratch.save(one, "contexts")
    want = one.groupBy(*KEY).agg(F.collect_list(F.struct("gram", "ctx", "off", "n", "first", "last")).alias("want"))
    bodies = texts.join(want.hint("merge"), KEY)  # shuffled at every size, so that small runs tell how large ones grow
    bodies = scratch.save(bodies.mapInArrow(_cut_contexts(longest), BODIES), "bodies")
    hot = scratch.save(one.groupBy("gram").agg(F.count("*").alias("g")).where(F.col("g") > hot_contexts).select("gram"), "hot")
    scratch.drop(one)
    found, split, keep = None, None, []
    if not hot.isEmpty():
        hot_side = small(hot, 16)
        split = bodies.join(hot_side, "gram", "left_semi").dropDuplicates(["gram", "ctx"]).mapInArrow(_split_rows(length, longest), f"{BODIES}, of_gram bigint, of_ctx bigint, place int")
        split = scratch.save(split, "split")
        narrow = split.groupBy("gram", "ctx").agg(F.sum("n").alias("n"), *[F.first(x).alias(x) for x in ("off", "wins", "body")]).select(*BODY_NAMES)
        found = _sorted(spark, narrow, length, longer, block_bytes, bucket_suffixes)
        found = split.select("gram", "ctx", "of_gram", "of_ctx", "place").join(found, ["gram", "ctx"])
        found = found.select(F.col("of_gram").alias("gram"), F.col("of_ctx").alias("ctx"), "longer", (F.col("lo") + F.col("place")).alias("lo"), (F.col("hi") + F.col("place")).alias("hi"))
        keep = [split]
        bodies_cold = bodies.join(hot_side, "gram", "left_anti")
    else:
        bodies_cold = bodies
    cold = _sorted(spark, bodies_cold.dropDuplicates(["gram", "ctx"]), length, longer, block_bytes, bucket_suffixes)
    found = scratch.save(cold if found is None else cold.unionByName(found), "found")
    size = F.when(F.col("longer"), longest).otherwise(length)
    some = mixed.join(found, ["gram", "ctx"]).select(*KEY, "longer", (F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi") + size).alias("hi"))
    spans = plain.unionByName(some).distinct().groupBy(*KEY).agg(F.collect_list(F.struct("longer", "lo", "hi")).alias("spans"))
    runs = scratch.save(spans.mapInArrow(_merged, "t bigint, c bigint, len int, runs binary, longer_runs binary"), "runs")
    scratch.drop(met, bodies, hot, found, *keep)
    return runs


def _sorted(spark: SparkSession, bodies: DataFrame, length: int, longer: int, block_bytes: int, bucket_suffixes: int) -> DataFrame:
    """Runs of repeated windows of distinct contexts (BODIES), dealt by gram."""
    dealt = bodies.repartition(partitions(spark), "gram").sortWithinPartitions("gram", "ctx")
    return dealt.mapInArrow(_sorted_blocks(length, longer, block_bytes, bucket_suffixes), FOUND)


def with_runs(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """docs with _body, runs and longer_runs (null where nothing goes)."""
    runs = repeated_runs(spark, docs, **how)
    return keyed(docs).join(runs.hint("merge"), KEY, "left").drop(*KEY)


def kept_bytes(body: bytes, runs: bytes | None) -> tuple[bytes, int, int]:
    """Remaining bytes, removed bytes, removed runs."""
    if not runs:
        return body, 0, 0
    out, at, gone = [], 0, 0
    pairs = np.frombuffer(runs, "<i4").reshape(-1, 2).tolist()
    for lo, hi in pairs:
        out.append(body[at:lo])
        gone += hi - lo
        at = hi
    out.append(body[at:])
    return b"".join(out), gone, len(pairs)


def repeat_digests(spark: SparkSession, docs: DataFrame, length: int = 400, passage: int = 0, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs (doc_id, text).

    passage: a shorter length (at least half of `length`); adds passage_bytes, the bytes that strings of this length
    with another start cover, passage_spans, their maximal runs, and repeats_passage, whether there are any.
    """
    main, other = ("longer_runs", "runs") if passage else ("runs", "longer_runs")
    fields = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, passage_bytes bigint, passage_spans bigint"
    names = [x.split(" ")[0] for x in fields.split(", ")]

    def run(batches):
        for b in chunks(batches):
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            for body, runs, more in zip(*(b.column(x).to_pylist() for x in ("_body", main, other))):
                kept, gone, n = kept_bytes(body, runs)
                spans = np.frombuffer(more or b"", "<i4").reshape(-1, 2)
                for col, v in zip(cols, (len(body), gone, n, hashlib.sha256(kept).hexdigest(), int((spans[:, 1] - spans[:, 0]).sum()), len(spans))):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.string() if i == 3 else pa.int64()) for i, c in enumerate(cols))], names)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = with_runs(spark, rows, length=passage or length, longer=length if passage else 0, **how)
    out = rows.select("doc_id", "_body", "runs", "longer_runs").mapInArrow(run, fields)
    return out.withColumn("repeats_passage", F.col("passage_bytes") > 0) if passage else out.drop("passage_bytes", "passage_spans")


def drop_repeats(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """docs with the repeated bytes cut out of text; a character that was cut in two goes whole. All rows stay."""
    names = docs.columns

    def run(batches):
        for b in chunks(batches):
            own = dict(zip(names, b.column("row").flatten()))
            own["text"] = pa.array([t if not r else kept_bytes(t.encode(), r)[0].decode("utf-8", "ignore") for t, r in zip(own["text"].to_pylist(), b.column("runs").to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays([own[x] for x in names], names)

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text"))
    return with_runs(spark, packed, **how).select("row", "runs").mapInArrow(run, docs.schema)
