"""Operator 3, token-id output: shards of raw ids with a minimal perfect hash index.

Layout of a store, one pair of files for each shard (a range of document keys, rows in ascending key order):

``shard-NNNNN.bin``  the ids of all its documents, little-endian unsigned, nothing else: 16 bits wide where the
                     vocabulary fits, else 32.
``shard-NNNNN.idx``  header ``KMTS``, then (all little-endian) u32 bytes of an id, u64 rows, u64 keys, u64 buckets;
                     i32 displacement of each bucket; u32 fingerprint, u32 first row, u32 rows of each slot;
                     u64 place of each row in ids, and one more for the end.

A key's bucket gives a displacement, the displacement its slot; the slot's fingerprint tells strangers apart
(one stranger in 2**32 is taken for a member), and the row table gives the place of its payload. So an access is two
hashes and two reads, whatever the shard's size. Keys themselves are not stored.

Files are written beside their final name and then renamed, and their content depends on the shard's rows only: a
task that runs again, also beside its first attempt, leaves the same files. File systems: what pyarrow opens.

Defined results: null text is empty (one end id); a null key is kept under the lowest 64-bit integer and read back
as null; rows that share a key are all stored (in the order of their text) and read back together; an
empty table makes an empty store.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, columns_or_null, partitions
from .tokens import chunks, encoder, tokenizer_path

MAGIC, NULL_KEY, MASK = b"KMTS", -(1 << 63), (1 << 64) - 1


def mix(key: int, seed: int) -> int:
    """A 64-bit finaliser (Stafford's mix 13) of key and seed."""
    x = (key + (seed + 1) * 0x9E3779B97F4A7C15) & MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def fingerprint(key: int) -> int:
    return mix(key, 0x5EED) >> 32


def perfect_hash(keys: list[int], per_bucket: int = 2) -> tuple[list[int], list[int]]:
    """Displacement of each bucket, slot of each key: a bijection of the distinct keys to 0..n-1.

    Buckets are placed largest first; each takes the first displacement that sends all its keys to free slots.
    A bucket of one key takes a free slot outright, written as a negative displacement.
    """
    n = len(keys)
    buckets: list[list[int]] = [[] for _ in range(max(1, -(-n // per_bucket)))]
    for i, k in enumerate(keys):
        buckets[mix(k, 0) % len(buckets)].append(i)
    taken, slot, shift = bytearray(n), [0] * n, [0] * len(buckets)
    order = sorted((b for b in range(len(buckets)) if buckets[b]), key=lambda b: (-len(buckets[b]), b))
    free = 0
    for b in order:
        own = buckets[b]
        if len(own) == 1:
            while taken[free]:
                free += 1
            taken[free], slot[own[0]], shift[b] = 1, free, -free - 1
            continue
        d = 0
        while True:
            d += 1
            at = [mix(keys[i], d) % n for i in own]
            if len(set(at)) == len(at) and not any(taken[s] for s in at):
                break
        for i, s in zip(own, at):
            taken[s], slot[i] = 1, s
        shift[b] = d
    return shift, slot


def build_index(keys: list[int], ends: list[int], width: int) -> bytes:
    """The index file of rows with ascending keys; ends: place behind each row's ids."""
    first = [i for i, k in enumerate(keys) if i == 0 or k != keys[i - 1]]
    own = [keys[i] for i in first]
    shift, slot = perfect_hash(own)
    table = np.zeros((len(own), 3), "<u4")
    for k, (i, s) in enumerate(zip(first, slot)):
        table[s] = fingerprint(own[k]), i, (first[k + 1] if k + 1 < len(first) else len(keys)) - i
    head = MAGIC + struct.pack("<IQQQ", width, len(keys), len(own), len(shift))
    return head + np.array(shift, "<i4").tobytes() + table.tobytes() + np.array([0, *ends], "<u8").tobytes()


class Shard:
    """Keyed access to one shard."""

    def __init__(self, root: str, shard: int):
        self.fs, base = file_system(root)
        with self.fs.open_input_stream(f"{base}/{name(shard)}.idx") as f:
            raw = f.read()
        if raw[:4] != MAGIC:
            raise ValueError("not a token store index")
        self.width, self.rows, self.keys, buckets = struct.unpack_from("<IQQQ", raw, 4)
        at = 4 + struct.calcsize("<IQQQ")
        # plain lists: single look-ups in them are several times faster than in arrays
        self.shift = np.frombuffer(raw, "<i4", buckets, at).tolist()
        at += 4 * buckets
        self.table = np.frombuffer(raw, "<u4", 3 * self.keys, at).reshape(-1, 3).tolist()
        self.place = np.frombuffer(raw, "<u8", self.rows + 1, at + 12 * self.keys).tolist()
        self.data = self.fs.open_input_file(f"{base}/{name(shard)}.bin")

    def find(self, key: int) -> tuple[int, int] | None:
        """First row and number of rows of a key, or None."""
        if not self.keys:
            return None
        d = self.shift[mix(key, 0) % len(self.shift)]
        s = -d - 1 if d < 0 else mix(key, d) % self.keys
        mark, row, n = self.table[s]
        return (row, n) if mark == fingerprint(key) else None

    def read(self, key: int) -> list[tuple[int, bytes]]:
        """(place in the shard, ids as 32-bit little-endian bytes) of each row of a key."""
        found = self.find(key)
        if not found:
            return []
        out = []
        for row in range(found[0], found[0] + found[1]):
            a, b = self.place[row], self.place[row + 1]
            raw = self.data.read_at(self.width * (b - a), self.width * a)
            out.append((a, raw if self.width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()))
        return out

    def close(self) -> None:
        self.data.close()


def name(shard: int) -> str:
    return f"shard-{shard:05d}"


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def put(fs, path: str, write) -> None:
    """Write beside, then rename: readers never see half a file, and any attempt may win."""
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(beside) as f:
        write(f)
    fs.move(beside, path)


class TokenStore:
    """A written store: where it is, its shards' lower bounds, and the ids before each shard."""

    def __init__(self, spark: SparkSession, root: str, bounds: list[int], base: dict[int, int]):
        self.spark, self.root, self.bounds, self.base = spark, root, bounds, base

    def shard_of(self, column: str = "doc_id"):
        return shard_column(column, self.bounds)

    def digests(self, keys: DataFrame) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 of every stored row under the distinct keys (column doc_id)."""
        root, base = self.root, self.base

        def look(batches):
            shards: dict[int, Shard] = {}
            for b in chunks(batches):
                rows = []
                for key, s in zip(b.column("doc_id").to_pylist(), b.column("shard").to_pylist()):
                    if s not in shards:
                        for old in shards.values():
                            old.close()
                        shards = {s: Shard(root, s)}
                    for at, ids in shards[s].read(NULL_KEY if key is None else key):
                        rows.append((key, base[s] + at, len(ids) // 4, zlib.crc32(ids)))
                cols = list(zip(*rows)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])

        n = len(self.bounds) + 1
        keyed = keys.select(F.col("doc_id").cast("bigint").alias("doc_id")).withColumn("shard", self.shard_of())
        keyed = keyed.repartitionById(n, F.col("shard")).dropDuplicates(["shard", "doc_id"]).sortWithinPartitions("shard", "doc_id")
        return keyed.mapInArrow(look, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def shard_column(column: str, bounds: list[int]):
    """Number of bounds at or below the key; null keys go first."""
    if not bounds:
        return F.lit(0)
    above = F.expr(f"aggregate(array({', '.join(f'{b}L' for b in bounds)}), 0, (n, b) -> n + int(b <= `{column}`))") if len(bounds) < 16 else None
    if above is None:  # a search tree of comparisons: as deep as the logarithm of the shards
        def tree(lo: int, hi: int) -> str:
            if lo == hi:
                return str(lo)
            mid = (lo + hi) // 2
            return f"if(`{column}` < {bounds[mid]}L, {tree(lo, mid)}, {tree(mid + 1, hi)})"

        above = F.expr(tree(0, len(bounds)))
    return F.when(F.col(column).isNull(), F.lit(0)).otherwise(above).cast("int")


def write_store(spark: SparkSession, docs: DataFrame, root: str | None = None, tokenizer: str | None = None, end_id: int = 0, shards: int | None = None) -> TokenStore:
    """Encode docs (doc_id, text), append end_id to each, and write the store. root: a folder that all share."""
    scratch = Scratch(spark, "token-store")
    root = root or scratch.path("store")
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    n = shards or partitions(spark)
    rows = columns_or_null(docs, {"doc_id": "bigint", "text": "string"})
    probs = [i / n for i in range(1, n)]
    bounds = sorted({int(math.floor(b)) for b in rows.select("doc_id").approxQuantile("doc_id", probs, 0.25 / n)}) if n > 1 else []
    n = len(bounds) + 1
    fs, base = file_system(root)
    fs.create_dir(base)
    end = int(end_id).to_bytes(4, "little")

    def write(batches):
        from pyspark import TaskContext

        own = TaskContext.get().partitionId()
        fs, base = file_system(root)
        fs.create_dir(base)
        enc, keys, ends, at = encoder(path), [], [], 0
        width = 2 if max(enc.tok.get_vocab_size(), end_id + 1) <= 1 << 16 else 4

        def body(f):
            nonlocal at
            for b in chunks(batches):
                for key, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                    ids = enc.payload(text) + end
                    f.write(ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes())
                    at += len(ids) // 4
                    keys.append(NULL_KEY if key is None else key)
                    ends.append(at)

        put(fs, f"{base}/{name(own)}.bin", body)
        put(fs, f"{base}/{name(own)}.idx", lambda f: f.write(build_index(keys, ends, width)))
        yield pa.RecordBatch.from_arrays([pa.array([own], pa.int64()), pa.array([len(keys)], pa.int64()), pa.array([at], pa.int64())], ["shard", "n_docs", "n_ids"])

    dealt = rows.withColumn("shard", shard_column("doc_id", bounds)).repartitionById(n, F.col("shard")).drop("shard").sortWithinPartitions("doc_id", "text")
    manifest = scratch.save(dealt.mapInArrow(write, "shard bigint, n_docs bigint, n_ids bigint"), "manifest")
    before, total = {}, 0
    for r in sorted(manifest.collect()):  # one short row for each shard
        before[r.shard] = total
        total += r.n_ids
    return TokenStore(spark, root, bounds, before)


def token_store_digests(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    store = write_store(spark, docs, tokenizer=tokenizer, end_id=end_id)
    return store.digests(docs)
