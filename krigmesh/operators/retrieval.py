"""Local document retrieval: ids, chunks, lexical scores and snippets."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize, snippet


def _taken(base: str, first: str):
    """For the bases of one stem: at which of a base's rows its count skips one more number (column at).

    Rows: a base, and where an id base_k is itself a base (child): k and how many rows of the base come before the child's first.
    """

    def run(t: pa.Table) -> pa.Table:
        by_base: dict[str, list] = {}
        for b, child, k, before in zip(*(t.column(c).to_pylist() for c in (base, "_child", "_number", first))):
            by_base.setdefault(b, []).append((k, before, child))
        lost, out = set(), []
        for b in sorted(by_base, key=len):  # who may take a base's own id is shorter than it
            skipped = int(b in lost)
            for k, before, child in sorted(by_base[b]):
                row = k - skipped
                if row <= before:
                    lost.add(child)
                else:
                    out.append((b, row))
                    skipped += 1
        out += [(b, 1) for b in lost]
        return pa.table([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64())], names=[base, "_at"])

    return run


def unique_ids(df: DataFrame, base: str, order: str) -> DataFrame:
    """doc_id: rows take ids by `order`; each the base if it is free, else the first free of base_2, base_3 ...

    An id can be claimed from two sides only, as a base and as a number of the base before its last `_k`. Such bases are
    few; who comes first there follows from counts of rows, and all other rows are numbered by their place in their base.
    A null base stays null. order has no ties.
    """
    child = df.where(F.col(base).isNotNull()).groupBy(base).agg(F.min(order).alias("_o"))
    digits = F.regexp_extract(base, "(?s)^.*_([1-9][0-9]{0,17})$", 1)
    claims = child.withColumn("_number", F.when(digits != "", digits).cast("bigint")).where("_number >= 2")
    claims = claims.select(F.col(base).alias("_child"), "_number", "_o", F.regexp_replace(base, "(?s)_[0-9]+$", "").alias(base))
    claims = claims.join(child.select(base), base)
    rows = df.join(claims.select(base).distinct(), base, "left_semi").select(base, F.lit(None).cast("string").alias("_child"), F.lit(None).cast("bigint").alias("_number"), F.col(order).alias("_o"))
    so_far = Window.partitionBy(base).orderBy("_o", F.col("_child").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    claims = claims.select(base, "_child", "_number", "_o").unionByName(rows).withColumn("_before", F.count_if(F.col("_child").isNull()).over(so_far)).where("_child is not null")
    claims = claims.select(F.regexp_replace(base, "(?s)(_[0-9]+)+$", "").alias("_stem"), F.col(base).cast("string").alias(base), "_child", "_number", "_before")
    skips = claims.groupBy("_stem").applyInArrow(_taken(base, "_before"), f"`{base}` string, _at bigint")
    placed = df.withColumn("_at", F.row_number().over(Window.partitionBy(base).orderBy(order)).cast("bigint")).withColumn("_skip", F.lit(0))
    both = placed.unionByName(skips.withColumn("_skip", F.lit(1)), allowMissingColumns=True)
    skipped = F.sum("_skip").over(Window.partitionBy(base).orderBy("_at", F.col("_skip").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    number = F.col("_at") + F.col("_skipped")
    out = both.withColumn("_skipped", skipped).where("_skip = 0")
    return out.withColumn("doc_id", F.when(number == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("_"), number.cast("string")))).select(*df.columns, "doc_id")


def content_hash(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def chunks(docs: DataFrame, key: str, text: str, size: int = 2500, overlap: int = 250) -> DataFrame:
    """key, chunk_index (from 1), chunk_id, text of overlapping windows; blank ones go before numbering."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[\r\t]+", " "), "\n{3,}", "\n\n")
    step = max(1, size - overlap)
    rows = docs.select(F.col(key), t.alias("_t")).where(F.length("_t") > 0)
    rows = rows.select(key, F.posexplode(F.transform(F.sequence(F.lit(1), F.length("_t"), F.lit(step)), lambda s: F.substring(F.col("_t"), s, F.lit(size)))).alias("_p", "text"))
    rows = rows.where(F.length(F.trim(F.regexp_replace("text", r"\s", " "))) > 0)
    rows = rows.withColumn("chunk_index", F.row_number().over(Window.partitionBy(key).orderBy("_p")).cast("bigint"))
    return rows.select(key, "chunk_index", F.format_string("%s_%04d", F.col(key).cast("string"), F.col("chunk_index")).alias("chunk_id"), "text")


def query_terms(query: str, least: int = 3) -> list[str]:
    return list(dict.fromkeys(t for t in re.sub(r"[^\w]+", " ", query.lower()).split() if len(t) >= least))


def lexical_scores(chunked: DataFrame, terms: list[str], keys: list[str], text: str = "text") -> DataFrame:
    """How often the terms occur as whole words, summed, for the rows with any."""
    hits = F.size(F.filter(F.split(normalize(F.col(text)), " "), lambda w: w.isin(*terms))) if terms else F.lit(0)
    return chunked.select(*keys, text, hits.cast("bigint").alias("score")).where("score > 0")


def search(chunked: DataFrame, query: str, keys: list[str], order: list[str], top: int = 8, text: str = "text") -> DataFrame:
    """The top chunks by score, ties in file order, with a snippet. A top-k report."""
    terms = query_terms(query)
    k = top if top and top > 0 else 8
    best = lexical_scores(chunked, terms, keys, text).orderBy(F.desc("score"), *order).limit(k)
    return best.select(*keys, "score", snippet(F.col(text), terms).alias("snippet"))


def search_many(chunked: DataFrame, queries: DataFrame, keys: list[str], top: int = 8, text: str = "text", least: int = 3) -> DataFrame:
    """Scores of many queries (query_id, query) over all chunks; the top of each.

    Words are counted in every chunk and met with the queries' distinct terms by an equi-join; counts are added up
    before the ranking, and a chunk's words are pre-aggregated before the shuffle.
    """
    words = chunked.select(*keys, F.explode(F.split(normalize(F.col(text)), " ")).alias("term")).where(F.length("term") >= least).groupBy(*keys, "term").agg(F.count("*").alias("n"))
    terms = queries.select("query_id", F.explode(F.array_distinct(F.split(normalize(F.col("query")), " "))).alias("term")).where(F.length("term") >= least)
    score = words.join(terms, "term").groupBy("query_id", *keys).agg(F.sum("n").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), *keys)
    return score.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
