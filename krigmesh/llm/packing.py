"""Operator 9, best-fit packing: bounded-space online best fit over a bitset of free spaces.

A document's ids, with its end id, are cut into pieces of at most ``capacity`` ids; the first piece takes what does
not fill a whole one, so that all later pieces are full. Full pieces are sequences of their own. The others come
online to the packer, which keeps at most ``open_bins`` bins open. Bit f of one integer tells whether a bin with f
free places is open: shifting the piece's length out and taking the lowest set bit gives the fullest bin that still
takes the piece. When a further bin is needed and all are in use, the fullest closes first.

Pieces, not texts, are dealt to the packing tasks by a hash of the document's key: a task gets about
``pieces_per_task`` pieces whatever the input's files look like, so the few bins that each task leaves part-filled
stay a vanishing share. Inside a task the short pieces come in waves of about ``wave``, dealt by another hash, each
wave longest first: short pieces fill what the long ones of their wave, and of earlier waves, leave. So lengths are
mixed all along and a bound suffices that is far below the number of pieces; it does bind, and the bins that it closes
are nearly full. Ties go by key, so a rerun gives the same sequences.

Defined results: null and empty texts make one piece that holds the end id; repeated rows each get pieces of their
own; a null key stays null; sequence ids are unique but have gaps; extra columns are dropped.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, columns_or_null
from .tokens import chunks, encoder, tokenizer_path

FIELDS = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class BestFit:
    """Bounded-space best fit; add() gives (bin, offset)."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most = capacity, open_bins
        self.bits, self.by_free, self.open, self.made = 0, [[] for _ in range(capacity + 1)], 0, 0

    def _take(self, free: int) -> int:
        own = self.by_free[free]
        b = own.pop()
        if not own:
            self.bits &= ~(1 << free)
        self.open -= 1
        return b

    def add(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            b = self._take(free)
        else:
            if self.open >= self.most:
                low = self.bits & -self.bits
                self._take(low.bit_length() - 1)  # the fullest closes
            b, free = self.made, self.capacity
            self.made += 1
        left = free - length
        if left:
            self.by_free[left].append(b)
            self.bits |= 1 << left
            self.open += 1
        return b, self.capacity - free


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: the first may be shorter, the others are full."""
    head = n % capacity
    out = [(0, head)] if head else []
    return out + [(at, capacity) for at in range(head, n, capacity)]


def pieces(docs: DataFrame, capacity: int = 1024, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of docs (doc_id, text). No shuffle."""
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        enc = encoder(path)
        for b in chunks(batches):
            out: tuple[list, ...] = ([], [], [], [], [])
            for key, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = enc.payload(text) + end
                for k, (at, n) in enumerate(cut(len(ids) // 4, capacity)):
                    for col, v in zip(out, (key, k, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]))):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(out)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return columns_or_null(docs, {"doc_id": "bigint", "text": "string"}).mapInArrow(run, FIELDS)


#: The smallest bound that packs waves of 2,048 pieces as well as any larger one (measured on two tables).
OPEN_BINS, WAVE = 896, 2048


def pack(spark: SparkSession, rows: DataFrame, capacity: int = 1024, open_bins: int = OPEN_BINS, wave: int = WAVE, pieces_per_task: int = 100_000) -> DataFrame:
    """Adds sequence_id and offset to pieces; rows should be a written table, as it is read twice."""
    total, short = rows.agg(F.count("*"), F.count_if(F.col("length") < capacity)).first()
    n = max(1, -(-total // pieces_per_task))
    waves = max(1, round(short / n / wave))

    def run(batches):
        from pyspark import TaskContext

        first, fit = TaskContext.get().partitionId() << 40, BestFit(capacity, open_bins)
        whole = 1 << 39  # full pieces are numbered from here
        for b in batches:
            lengths = b.column("length").to_numpy()
            seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for i, x in enumerate(lengths.tolist()):
                if x == capacity:
                    seq[i] = first + whole
                    whole += 1
                else:
                    s, off[i] = fit.add(x)
                    seq[i] = first + s
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seq), pa.array(off)], [*b.schema.names, "sequence_id", "offset"])

    turn = F.pmod(F.xxhash64("ids_crc32", "start", "doc_id"), F.lit(waves))
    dealt = rows.repartition(n, F.xxhash64("doc_id", "start", "ids_crc32")).sortWithinPartitions(turn, F.desc("length"), "doc_id", "piece", "ids_crc32")
    return dealt.mapInArrow(run, f"{FIELDS}, sequence_id bigint, offset bigint")


def pack_documents(spark: SparkSession, docs: DataFrame, capacity: int = 1024, tokenizer: str | None = None, end_id: int = 2, open_bins: int = OPEN_BINS, wave: int = WAVE, pieces_per_task: int = 100_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs (doc_id, text)."""
    scratch = Scratch(spark, "packing")
    return pack(spark, scratch.save(pieces(docs, capacity, tokenizer, end_id), "pieces"), capacity, open_bins, wave, pieces_per_task)
