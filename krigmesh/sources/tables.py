"""Tables in and out: point CSV, JSON records, JSON lines, text libraries, long grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean_names(names: list[str]) -> list[str]:
    """Without byte-order mark and outer blanks."""
    return [n.lstrip("﻿").strip() for n in names]


def read_points(spark: SparkSession, path: str, code: str = "code") -> DataFrame:
    """A CSV of samples, all columns text, names kept. A missing code column is made up as P001, P002 ... in file order.

    The file order is that of Spark's row ids; numbers inside partitions are offset by counts, so no task sees all rows.
    """
    df = spark.read.csv(path, header=True, inferSchema=False)
    df = df.toDF(*clean_names(df.columns))
    if code in df.columns:
        return df
    rows = df.withColumn("_i", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_i", 33))
    n = rows.groupBy("_p").agg(F.count("*").alias("_n"))  # a row a partition
    n = n.withColumn("_o", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    k = F.col("_o") + F.col("_i") - F.shiftleft(F.col("_p"), 33) + 1
    return rows.join(F.broadcast(n.select("_p", "_o")), "_p").withColumn(code, F.format_string("P%03d", k)).drop("_i", "_p", "_o").select(code, *df.columns)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_csv_if_exists(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or an empty one of the schema where there is none."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.csv(path, header=True, schema=schema, nullValue="NA")


def read_records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.json(path, schema=schema, multiLine=True)


CHUNK = "chunk_id string, doc_id string, local_relative_path string, chunk_index bigint, text string"


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of chunks; blank lines are skipped."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    return lines.select(F.from_json("value", CHUNK).alias("r")).select("r.*")


def library(spark: SparkSession, path: str, pattern: str = "*.{txt,md,html,htm,pdf,docx}") -> DataFrame:
    """Every document of a folder tree: path, length, time, SHA-256, extension and status of its text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    out = files.select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256"), ext.alias("extension"))
    return out.withColumn("status", F.when(F.col("extension").isin("txt", "md", "html", "htm"), "readable").when(F.col("extension") == "pdf", "needs_pdf_reader").otherwise("skipped"))


def read_texts(spark: SparkSession, path: str, pattern: str = "*.{txt,md,html,htm}") -> DataFrame:
    """path, text of every text file; markup stays."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def discover_layers(names: list[str], pattern: str = r"^PC[0-9]+.*\.tiff?$") -> list[tuple[str, str]]:
    """(file, column) of covariate layers, by the first number in the name and the name; columns are unique and plain."""
    import re

    own = [n for n in names if re.search(pattern, n, re.I)]
    number = lambda n: int(m[0]) if (m := re.search(r"\d+", n)) else float("inf")
    out, seen = [], set()
    for n in sorted(own, key=lambda n: (number(n), n)):
        col = re.sub(r"[^A-Za-z0-9_.]", ".", n.rsplit(".", 1)[0])
        col = col if re.match(r"[A-Za-z.]", col) else f"X{col}"
        base, k = col, 0
        while col in seen:
            k += 1
            col = f"{base}.{k}"
        seen.add(col)
        out.append((n, col))
    return out


def long_grid(layers: dict[str, DataFrame]) -> DataFrame:
    """One grid (cell, x, y, a column for each layer) of long layers (cell, x, y, value): one aggregate, no join."""
    parts = None
    for name, df in layers.items():
        own = df.select("cell", "x", "y", F.lit(name).alias("layer"), F.col("value").cast("double").alias("value"))
        parts = own if parts is None else parts.unionByName(own)
    return parts.groupBy("cell").agg(F.first("x").alias("x"), F.first("y").alias("y"), *[F.max(F.when(F.col("layer") == n, F.col("value"))).alias(n) for n in layers])


def write_csv(df: DataFrame, path: str) -> None:
    """A report-size table as CSV parts with a header; nulls are empty."""
    df.write.mode("overwrite").csv(path, header=True, nullValue="")


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines that keep nulls."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_grid(grid: DataFrame, path: str) -> None:
    grid.write.mode("overwrite").parquet(path)


def manifest(chunks: DataFrame, skipped: DataFrame) -> DataFrame:
    """Counts and status of a chunked library (one row)."""
    a = chunks.agg(F.count("*").alias("n_chunks"), F.count_distinct("doc_id").alias("n_documents"))
    b = skipped.agg(F.count("*").alias("n_errors"))
    return a.crossJoin(F.broadcast(b)).withColumn("status", F.when(F.col("n_errors") == 0, "ok").when(F.col("n_documents") > 0, "partial").otherwise("failed"))  # one row each


FOLDERS = ("01_input", "02_regression", "03_variogram", "04_kriging", "05_validation", "06_report")


def run_paths(root: str, run_id: str) -> dict[str, str]:
    return {f[3:]: f"{root.rstrip('/')}/{run_id}/{f}" for f in FOLDERS}
