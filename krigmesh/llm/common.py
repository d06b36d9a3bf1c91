"""Shared plumbing: reading tables, shared-folder tables, size-checked joins, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only after its rows were counted and found to be at most so many bytes.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where all tasks run on this machine an own temporary folder stands in for it; elsewhere executors would each
    write to their own disk, and parts would be missing without a word.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = getattr(spark.sparkContext, "_krigmesh_shared", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="krigmesh-")
        spark.sparkContext._krigmesh_shared = own
    return own


#: Rows and bytes of an Arrow batch for the Python workers, where the session has not set its own.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": (None, str(8 << 20))}


def bounded_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches than Spark's default of 10,000 rows, which for long texts are a worker's largest object.

    Only defaults are replaced; they stay so for the session, as results are computed after the operator has returned.
    """
    for key, (default, own) in BATCH.items():
        found = spark.conf.get(key, default)
        if found == default or (key.endswith("BytesPerBatch") and found in ("67108864", "64MB", "2147483647", "-1")):
            spark.conf.set(key, own)


class Scratch:
    """Intermediate tables of one operator call, written to the shared folder.

    A written table cuts the lineage: a lost executor never makes earlier stages run again.
    drop() deletes a table once nothing reads it any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        bounded_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        if not _ROOTS:
            atexit.register(_clean_at_exit)
        _ROOTS.append(self.root)
        self.n, self.paths = 0, []

    def path(self, label: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:02d}-{label}"

    def save(self, df: DataFrame, label: str = "t") -> DataFrame:
        path = self.path(label)
        self.paths.append(path)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            _delete(self.spark, df._scratch_path)

    def keep_only(self, *frames: DataFrame) -> None:
        """Delete all tables but those that the operator's result reads."""
        kept = {getattr(df, "_scratch_path", None) for df in frames}
        for path in [p for p in self.paths if p not in kept]:
            _delete(self.spark, path)
            self.paths.remove(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_ROOTS: list[str] = []


def _clean_at_exit() -> None:
    """The tables of a driver that ends go, if its session still runs; a session that was stopped leaves them behind."""
    from pyspark import SparkContext

    if SparkContext._active_spark_context is not None:
        clean_scratch(SparkSession.getActiveSession() or SparkSession.builder.getOrCreate())


def clean_scratch(spark: SparkSession) -> None:
    """Delete all that operators of this driver have written to the shared folder; their results can't be read any more."""
    while _ROOTS:
        _delete(spark, _ROOTS.pop())


def small(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if its counted rows stay under BROADCAST_BYTES, else df as it is (shuffle join)."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def hash_sample(df: DataFrame, key: str, most: int, rows: int) -> DataFrame:
    """At most `most` rows of df, those with the smallest hash of key. rows: how many df has.

    A cut on the hash that keeps about twice as many comes first, so the sort that picks them meets few rows,
    however many tasks read df.
    """
    h = F.xxhash64(key)
    if rows > 4 * most:
        cut = int(2.0 * most / rows * (1 << 64)) - (1 << 63)
        df = df.where(h < F.lit(cut))
    return df.orderBy(h, key).limit(most)


def columns_or_null(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Only the named columns, cast; a column that is absent becomes null. Extra columns are left out."""
    bounded_batches(df.sparkSession)
    return df.select(*[(F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in wanted.items()])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Edges (two 64-bit nodes each) that one task takes into memory.
FOREST_EDGES = 2_000_000


def _forest(batches):
    """Edges -> node, comp by union-find with the smallest node as root."""
    import numpy as np
    import pyarrow as pa

    a, b = [], []
    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
    if not a:
        return
    nodes, flat = np.unique(np.concatenate(a + b), return_inverse=True)
    x, y = flat[: len(flat) // 2], flat[len(flat) // 2 :]
    label = np.arange(len(nodes))
    while True:  # hook the larger root to the smaller, then flatten
        lx, ly = label[x], label[y]
        low, high = np.minimum(lx, ly), np.maximum(lx, ly)
        if (low == high).all():
            break
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "comp"])


def components(scratch: Scratch, edges: DataFrame, max_rounds: int = 64, forest_edges: int = FOREST_EDGES) -> DataFrame:
    """Connected components of undirected edges (a, b) of 64-bit nodes: rows (node, comp), comp the smallest node reachable.

    Every task first contracts its own edges to a forest, which leaves at most one edge a node and task. If the edges
    that remain were counted and are few (forest_edges), one task joins the forests. Else rounds on written tables
    do: each hooks the parent of every node to the smallest parent over its edges, then halves the depth of the
    parent forest; rounds grow with the logarithm of the longest path. Nothing is collected to the driver but
    counts. Grouping by node pre-aggregates, so a hub of any degree costs one row a task. Both ways give the same.
    """
    forests = edges.where("a <> b").select("a", "b").mapInArrow(_forest, "node bigint, comp bigint").where("node <> comp")
    forests = scratch.save(forests, "forests")
    n = forests.count()
    if n <= forest_edges:
        return scratch.save(forests.coalesce(1).mapInArrow(_forest, "node bigint, comp bigint"), "comp")
    both = forests.select(F.col("node").alias("x"), F.col("comp").alias("y"))
    both = both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    both = scratch.save(both, "edges")
    parent = scratch.save(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("comp")), "parent")
    for _ in range(max_rounds):
        p = parent.select(F.col("node").alias("y"), F.col("comp").alias("py"))
        near = both.join(p, "y").groupBy("x").agg(F.min("py").alias("near"))
        hooked = parent.join(near.withColumnRenamed("x", "node"), "node", "left").select("node", "comp", F.least("comp", F.coalesce("near", "comp")).alias("new"))
        hooked = scratch.save(hooked, "hooked")
        # the root that a node hangs on learns of the smallest root near it
        of_root = hooked.groupBy(F.col("comp").alias("root")).agg(F.min("new").alias("best"))
        step = hooked.join(of_root, hooked["comp"] == of_root["root"], "left").select("node", F.col("comp").alias("old"), F.least("new", F.coalesce("best", "new")).alias("mid"))
        step = scratch.save(step, "step")
        up = step.select(F.col("node").alias("mid"), F.col("mid").alias("top"))
        nxt = step.join(up, "mid", "left").select("node", "old", F.least("mid", F.coalesce("top", "mid")).alias("comp"))
        nxt = scratch.save(nxt, "parent")
        changed = not nxt.where("old <> comp").isEmpty()
        scratch.drop(parent, hooked, step)
        parent = nxt
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    scratch.drop(both, forests)
    out = parent.select("node", "comp")
    out._scratch_path = parent._scratch_path
    return out
