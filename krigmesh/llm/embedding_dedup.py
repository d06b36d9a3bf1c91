"""Operator 6, embedding near-dedup: Euclidean p-stable hashing and exact cosine checks.

Vectors are normalised in double precision. Table t of ``tables`` maps a vector to the integer parts of
``projections`` random Gaussian projections, shifted and divided by ``width``; vectors of cosine 0.95 or more are at
most 0.316 apart and share a bucket of a table with the probability that ``expected_recall`` computes. Both numbers
follow from the number of vectors (``plan``): as many projections as keep the orthogonal vectors that share a bucket
with one to ``FAR`` on the average, and as many tables as find ``RECALL`` (0.995) of the pairs at the very limit (far more of
closer ones). So tables grow with about the fifth root of the vectors, and candidates hardly faster than they. Every
vector is indexed. Pairs that share a bucket are checked by the exact cosine in double precision; none below the limit links.

Equal vectors are one node with a count. A bucket is met in tiles of ``tile`` by ``tile`` members, so a hot bucket
spreads over many tasks; a tile emits no pairs, but one row for each member with its number of new links and the
least node of its component inside the tile. A pair counts in the first table whose bucket it shares, so each link
counts once.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do
vectors of another length; rows that share an id are one node (the least of their vectors in hash order speaks);
a null id has no component of its own and links with nothing; other columns are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, columns_or_null, components, partitions
from .tokens import chunks

WIDTH, SEED, TILE = 2.0, 7, 512
RECALL, FAR = 0.995, 200.0


def collision(distance: float, width: float) -> float:
    """Probability that one quantised Gaussian projection agrees for two points so far apart."""
    r = width / distance
    phi = 0.5 * (1 + math.erf(-r / math.sqrt(2)))
    return 1 - 2 * phi - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def expected_recall(cosine: float, tables: int, projections: int, width: float = WIDTH) -> float:
    return 1 - (1 - collision(math.sqrt(2 - 2 * cosine), width) ** projections) ** tables


def plan(vectors: int, cosine: float, width: float = WIDTH, recall: float = RECALL, far: float = FAR) -> tuple[int, int]:
    """Tables and projections for so many vectors."""
    near, apart = collision(math.sqrt(2 - 2 * cosine), width), collision(math.sqrt(2), width)
    projections = 0
    while True:
        projections += 1
        tables = math.ceil(math.log(1 - recall) / math.log(1 - near**projections))
        if vectors * tables * apart**projections <= far or tables > 1000:
            return tables, projections


def _family(dim: int, tables: int, projections: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((dim, tables * projections)), rng.uniform(0, width, tables * projections)


def bucket_keys(unit: np.ndarray, tables: int, projections: int, width: float, seed: int) -> np.ndarray:
    """int64 bucket of each vector in each table."""
    a, b = _family(unit.shape[1], tables, projections, width, seed)
    q = np.floor((unit @ a + b) / width).astype(np.int64).view(np.uint64).reshape(len(unit), tables, projections)
    h = np.full((len(unit), tables), np.uint64(unit.shape[1]))
    for i in range(projections):
        h = (h ^ q[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _raw(v: list | None) -> bytes:
    """A usable vector as bytes of 64-bit floats, else nothing."""
    if not v or None in v:
        return b""
    a = np.asarray(v, np.float64)
    n = float(a @ a)
    return a.tobytes() if np.isfinite(n) and n > 0 else b""


def units(raw: list[bytes], narrow: bool) -> np.ndarray:
    v = np.frombuffer(b"".join(raw), np.float32 if narrow else np.float64).reshape(len(raw), -1).astype(np.float64)
    return v / np.sqrt((v * v).sum(1))[:, None]


def _hash_rows(tables: int, projections: int, width: float, seed: int, narrow: bool):
    """Usable vectors as bytes (32-bit where the column is of that type) with a 64-bit key for each table."""

    def run(batches):
        for b in chunks(batches):
            ids, raw = b.column("vec_id").to_pylist(), [_raw(v) for v in b.column("embedding").to_pylist()]
            by_size: dict[int, list[int]] = {}
            for i, v in enumerate(raw):
                if v and ids[i] is not None:
                    by_size.setdefault(len(v), []).append(i)
            for rows in by_size.values():
                own = [raw[i] for i in rows]
                keys = bucket_keys(units(own, False), tables, projections, width, seed)
                kept = [np.frombuffer(v).astype(np.float32).tobytes() for v in own] if narrow else own
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i] for i in rows], pa.int64()), pa.array(kept, pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables, dtype=np.int32)), pa.array(keys.ravel()))],
                    ["vec_id", "raw", "keys"],
                )

    return run


def tile_links(t: int, side: np.ndarray, node: np.ndarray, m: np.ndarray, unit: np.ndarray, keys: np.ndarray, cosine: float):
    """New links of the members of one tile of table t and the least node of each one's component inside the tile."""
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    within = len(two) == 0
    if within:
        two = one
    near = unit[one] @ unit[two].T >= cosine
    if within:
        np.fill_diagonal(near, False)
    if t and near.any():
        i, j = np.nonzero(near)
        near[i, j] = ~(keys[one[i], :t] == keys[two[j], :t]).any(1)
    links, label = np.zeros(len(node), np.int64), node.copy()
    if not near.any():
        return links, label
    links[one] += near @ m[two]
    if not within:
        links[two] += near.T @ m[one]
    i, j = np.nonzero(near)
    i, j = one[i], two[j]
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == label).all():
            return links, label
        label = new


def _tiles(cosine: float, narrow: bool):
    """Rows sorted by tile (table, key, x, y) -> node, links, least for the members with new links."""

    def solve(rows):
        node, m = np.array([r[5] for r in rows]), np.array([r[6] for r in rows])
        keys = np.array([r[8] for r in rows])
        links, least = tile_links(rows[0][0], np.array([r[4] for r in rows]), node, m, units([r[7] for r in rows], narrow), keys, cosine)
        on = links > 0
        return node[on], links[on], least[on]

    def run(batches):
        names = ("table", "key", "x", "y", "side", "node", "m", "raw", "keys")
        held, tile, out = [], None, []

        def packed():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out])) for i in range(3)], ["node", "links", "least"])

        for b in chunks(batches):
            for r in zip(*(b.column(c).to_pylist() for c in names)):
                if r[:4] != tile:
                    if len(held) > 1:
                        out.append(solve(held))
                    held, tile = [], r[:4]
                held.append(r)
            if out:
                yield packed()
                out = []
        if len(held) > 1:
            out.append(solve(held))
            yield packed()

    return run


def link_counts(spark: SparkSession, vectors: DataFrame, cosine: float = 0.95, tables: int | None = None, projections: int | None = None, width: float = WIDTH, seed: int = SEED, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding)."""
    scratch = Scratch(spark, "embedding-dedup")
    narrow = "embedding" in vectors.columns and dict(vectors.dtypes)["embedding"] == "array<float>"
    rows = columns_or_null(vectors, {"vec_id": "bigint", "embedding": "array<double>"})
    if tables is None or projections is None:
        tables, projections = plan(rows.count(), cosine, width)
    hashed = scratch.save(rows.mapInArrow(_hash_rows(tables, projections, width, seed, narrow), "vec_id bigint, raw binary, keys array<bigint>"), "hashed")
    speaks = hashed.groupBy("vec_id").agg(F.min("raw").alias("raw"))
    # equal vectors are one node, named by the least id
    ids = scratch.save(speaks.select("vec_id", "raw"), "ids")
    nodes = ids.groupBy("raw").agg(F.min("vec_id").alias("node"), F.count("*").alias("m"))
    nodes = scratch.save(nodes.join(hashed.select("raw", "keys").dropDuplicates(["raw"]), "raw"), "nodes")
    members = nodes.select("node", F.posexplode("keys").alias("table", "key"))
    buckets = members.groupBy("table", "key").agg(F.count("*").alias("size")).where("size > 1")
    # a member's block inside its bucket: a hash deals the members evenly without sorting or numbering them
    met = members.join(buckets, ["table", "key"]).withColumn("blocks", F.ceil(F.col("size") / tile).cast("int"))
    met = met.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tiles = met.select("table", "key", "node", "block", other).select("table", "key", "node", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"))
    tiles = scratch.save(tiles, "tiles")
    tiles = tiles.join(nodes.select("node", "m", "raw", "keys"), "node").repartition(partitions(spark), "table", "key", "x", "y").sortWithinPartitions("table", "key", "x", "y")
    got = tiles.mapInArrow(_tiles(cosine, narrow), "node bigint, links bigint, least bigint")
    got = scratch.save(got, "links")
    links = got.groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(scratch, got.select(F.col("node").alias("a"), F.col("least").alias("b")).distinct())
    scratch.keep_only(ids, nodes, got, comp)
    of = ids.join(nodes.select("raw", "node", "m"), "raw").join(links, "node", "left").join(comp, "node", "left")
    of = of.select("vec_id", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("comp", "node").alias("component_id"))
    out = rows.select("vec_id").join(of, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
