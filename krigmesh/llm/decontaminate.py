"""Operator 4, benchmark decontamination: pigeonhole edit matching with Myers' bit-parallel distance.

Texts and items are compared after case folding, with every run of characters that are not letters, digits or marks
made one blank. An item of n characters has an error budget k = floor(rate * n). Cut into k + 1 pieces, an item
within k edits of some passage leaves at least one piece untouched, so one automaton over all pieces finds every
candidate place; the window of the item's length, k wider on both sides, is then verified with Myers' bit-parallel
algorithm, whose column is one integer of n bits. Nothing within the budget is missed.

The benchmark is a stated query set: its pieces go to every task only after their size was checked (``item_bytes``);
a larger set is run in blocks of items. Documents are never shuffled, whatever copies they hold.

Items shorter than ``min_chars`` after folding, in which a few edits make another sentence, match exactly and as whole
words; they are in the same automaton, as one piece with budget 0.

Defined results: null, empty and blank texts and items match nothing; equal items each report; repeated documents each report; extra columns are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_or_null
from .tokens import chunks

RATE, MIN_CHARS = 0.06, 40
#: Benchmark text that one pass over the documents takes.
ITEM_BYTES = 16 << 20
WORDS = re.compile(r"\w+")


def fold(text: str | None) -> str:
    return " ".join(WORDS.findall(text.casefold())) if text else ""


def cut(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces with their offsets, of nearly equal length."""
    n, m = len(item), k + 1
    edge = [n * i // m for i in range(m + 1)]
    return [(a, item[a:b]) for a, b in zip(edge, edge[1:])]


class Myers:
    """Best semi-global edit distance of a pattern inside a text (any start, any end)."""

    def __init__(self, pattern: str):
        self.n = len(pattern)
        self.peq: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.peq[c] = self.peq.get(c, 0) | 1 << i

    def best(self, text: str, k: int) -> tuple[int, int] | None:
        """(distance, end) of the best end with distance <= k, the first of equals."""
        n = self.n
        mask, top = (1 << n) - 1, 1 << (n - 1)
        pv, mv, score, best, at = mask, 0, n, min(n, k + 1), 0
        get = self.peq.get
        for j, c in enumerate(text):
            eq = get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv) & mask
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph = (ph << 1) & mask
            mh = (mh << 1) & mask
            pv = mh | ~(xv | ph) & mask
            mv = ph & xv
            if score < best:
                best, at = score, j + 1
                if best == 0:
                    break
        return (best, at) if best <= k else None


class Matcher:
    """All items of a block: one automaton of pieces, one pattern for each item."""

    def __init__(self, items: list[tuple[int, str]], rate: float, min_chars: int = MIN_CHARS):
        import ahocorasick

        self.items, owners, self.min_chars = {}, {}, min_chars
        for item_id, text in items:
            k = int(rate * len(text)) if len(text) >= min_chars else 0
            self.items.setdefault(text, (k, Myers(text), []))[2].append(item_id)
        for text, (k, _, _) in self.items.items():
            for off, piece in cut(text, k):
                owners.setdefault(piece, []).append((text, off))
        self.found = ahocorasick.Automaton()
        for piece, own in owners.items():
            self.found.add_word(piece, (len(piece), own))
        if owners:
            self.found.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start bound, end) for each item that lies in text; the best place, the first of equals."""
        if not self.items or not text:
            return []
        best: dict[str, tuple[int, int, int]] = {}
        tried: dict[str, set[int]] = {}
        for end, (length, own) in self.found.iter(text):
            for item, off in own:
                k, myers, _ = self.items[item]
                if item in best and best[item][0] == 0:
                    continue
                start = end - length + 1 - off
                if len(item) < self.min_chars:  # whole words only
                    if (start == 0 or text[start - 1] == " ") and (end + 1 == len(text) or text[end + 1] == " "):
                        best[item] = (0, start, end + 1)
                    continue
                if start in (t := tried.setdefault(item, set())):
                    continue
                t.add(start)
                lo = max(0, start - k)
                if text.startswith(item, max(0, start)) and start >= 0:
                    hit = (0, start + len(item))
                else:
                    hit = myers.best(text[lo : start + len(item) + k], k)
                    hit = hit and (hit[0], lo + hit[1])
                if hit and (item not in best or hit[0] < best[item][0]):
                    best[item] = (hit[0], lo, hit[1])
        return [(i, d, lo, end) for item, (d, lo, end) in best.items() for i in self.items[item][2]]


def blocks(benchmark: DataFrame, item_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The folded items, in blocks of bounded size (one at least), read one partition at a time."""
    block, size = [], 0
    rows = columns_or_null(benchmark, {"item_id": "bigint", "text": "string"}).where("item_id is not null and text is not null").orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        t = fold(r.text)
        if not t:
            continue
        if size + len(t) > item_bytes and block:
            yield block
            block, size = [], 0
        block.append((r.item_id, t))
        size += len(t)
    yield block


def _pass(docs: DataFrame, items: list[tuple[int, str]], rate: float, min_chars: int) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(items)  # at most ITEM_BYTES

    def run(batches):
        matcher = Matcher(held.value, rate, min_chars)
        for b in chunks(batches):
            rows = []
            for key, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                rows += [(key, *m) for m in matcher.matches(fold(text))]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "distance", "start_bound", "end"])

    return docs.mapInArrow(run, "doc_id bigint, item_id bigint, distance bigint, start_bound bigint, end bigint")


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """A row for each document and benchmark item that it holds within the budget.

    doc_id, item_id, distance (edits), start_bound and end: the passage lies in [start_bound, end) of the folded text.
    """
    rows = columns_or_null(docs, {"doc_id": "bigint", "text": "string"})
    out = None
    for items in blocks(benchmark, item_bytes):
        part = _pass(rows, items, rate, min_chars)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """docs without the rows whose text holds an item; row by row, so null and repeated keys need no join."""
    out = docs
    for items in blocks(benchmark, item_bytes):
        held = spark.sparkContext.broadcast(items)

        def run(batches, held=held):
            matcher = Matcher(held.value, rate, min_chars)
            for b in chunks(batches):
                keep = [not matcher.matches(fold(t)) for t in b.column("text").to_pylist()]
                yield b.filter(pa.array(keep, pa.bool_()))

        out = out.mapInArrow(run, out.schema)
    return out
