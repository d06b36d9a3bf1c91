"""Checks of point tables, grids, metadata and evidence cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite, flags, to_number


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def resolve_target(columns: list[str], reserved: list[str], target: str = "auto") -> str:
    """The analysis column: the only one under auto, or the named one."""
    own = [c for c in columns if c not in reserved]
    if target == "auto":
        if len(own) != 1:
            raise ValueError(f"auto needs exactly one analysis column, found {len(own)}")
        return own[0]
    if target not in own:
        raise ValueError(f"no column {target}")
    return target


def numeric_rows(df: DataFrame, cols: list[str], least: int = 5) -> DataFrame:
    """Rows whose named columns are all numbers, cast; too few rows are an error."""
    out = df.withColumns({c: to_number(c) for c in cols}).na.drop(subset=cols)
    if out.limit(least).count() < least:
        raise ValueError(f"fewer than {least} valid rows")
    return out


def unpivot(df: DataFrame, keys: list[str], values: list[str], name: str = "column", value: str = "value") -> DataFrame:
    """One row for each key and value column, as text."""
    return df.select(*keys, *[F.col(v).cast("string").alias(v) for v in values]).unpivot(keys, values, name, value)


def column_profile(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Filled and numeric cells of each column, and whether all filled cells are numbers."""
    long = unpivot(df, keys, values)
    filled = F.coalesce(F.length(F.trim("value")) > 0, F.lit(False))
    number = F.coalesce(finite(to_number("value")), F.lit(False))
    g = long.groupBy("column").agg(F.count_if(filled).alias("n_filled"), F.count_if(filled & number).alias("n_numeric"))
    return g.withColumn("all_numeric", F.col("n_filled") == F.col("n_numeric"))


def column_warnings(profile: DataFrame, matched: Column, least: int = 30) -> DataFrame:
    """Codes of what is doubtful about each column: few_values, generic_profile, non_numeric."""
    return profile.withColumn("warnings", flags(("few_values", F.col("n_numeric") < least), ("generic_profile", matched == "generic_continuous"), ("non_numeric", ~F.col("all_numeric"))))


def duplicate_codes(df: DataFrame, code: str = "code") -> DataFrame:
    return df.groupBy(F.trim(F.col(code).cast("string")).alias("code")).agg(F.count("*").alias("n")).where("n > 1")


def coordinate_range(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Places out of range, and whether most rows look as if longitude and latitude were swapped."""
    swapped = F.avg(((F.abs(lat) > 90) & (F.abs(lon) <= 90)).cast("int"))
    out = F.count_if((F.abs(lat) > 90) | (F.abs(lon) > 180))
    return df.agg(F.count("*").alias("n"), out.alias("n_out_of_range"), F.coalesce(swapped > 0.5, F.lit(False)).alias("looks_swapped"))


def duplicate_locations(df: DataFrame, lon: str = "lon", lat: str = "lat", digits: int = 7) -> DataFrame:
    return df.groupBy(F.bround(lon, digits).alias("lon"), F.bround(lat, digits).alias("lat")).agg(F.count("*").alias("n")).where("n > 1")


def conflicting_locations(df: DataFrame, values: list[str], lon: str = "lon", lat: str = "lat", digits: int = 7) -> DataFrame:
    """Places and columns with more than one distinct value."""
    placed = df.select(F.bround(lon, digits).alias("lon"), F.bround(lat, digits).alias("lat"), *values)
    return unpivot(placed, ["lon", "lat"], values).groupBy("lon", "lat", "column").agg(F.count_distinct("value").alias("n_values")).where("n_values > 1")


def grid_schema(grid: DataFrame, layers: list[str]) -> DataFrame:
    """Extent, resolution, cells and filled cells of each layer of a long grid (cell, x, y, layers)."""
    long = grid.select("x", "y", *[F.col(c).cast("double").alias(c) for c in layers]).unpivot(["x", "y"], layers, "layer", "value")
    box = long.groupBy("layer").agg(F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"), F.count("*").alias("n_cells"), F.count("value").alias("n_valid"), F.count_distinct("x").alias("_nx"), F.count_distinct("y").alias("_ny"))
    res = lambda lo, hi, n: F.when(F.col(n) > 1, (F.col(hi) - F.col(lo)) / (F.col(n) - 1))
    return box.withColumn("res_x", res("xmin", "xmax", "_nx")).withColumn("res_y", res("ymin", "ymax", "_ny")).withColumn("status", F.when(F.col("n_valid") > 0, "ok").otherwise("no_valid_cells")).drop("_nx", "_ny")


def grid_consistency(schema: DataFrame) -> DataFrame:
    """Whether all layers share resolution and extent and have valid cells."""
    g = schema.agg(
        F.count_distinct(F.struct(F.bround("res_x", 8), F.bround("res_y", 8))).alias("n_resolutions"),
        F.count_distinct(F.struct(*[F.bround(c, 4) for c in ("xmin", "xmax", "ymin", "ymax")])).alias("n_extents"),
        F.count_if(F.col("n_valid") == 0).alias("n_empty"),
    )
    return g.withColumn("valid", (F.col("n_resolutions") <= 1) & (F.col("n_extents") <= 1) & (F.col("n_empty") == 0))


# Columns, required fields and allowed words of library metadata and evidence cards.
SOURCE_COLUMNS = (
    "doc_id", "title", "authors", "year", "source_type", "journal_or_publisher", "doi", "url", "access_date",
    "language", "topic_tags", "soil_indicators", "geography", "method_tags", "quality_level",
    "license_or_access_note", "notes",
)
SOURCE_ENUMS = {"source_type": ["book", "peer_reviewed_paper", "guideline", "report", "thesis", "documentation"], "quality_level": ["core", "supporting", "weak", "exclude"]}
CARD_FIELDS = (
    "claim_id", "claim", "applies_to", "evidence_sources", "strength", "conditions", "limitations",
    "recommended_action", "not_allowed_action",
)
STRENGTHS = ["strong", "moderate", "weak"]


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")) == "", F.lit(True))


def enum_violations(df: DataFrame, key: str, field: str, allowed: DataFrame, multi: bool = False) -> DataFrame:
    """Rows whose field (or any of its ';'-separated values) is not in allowed (column value)."""
    v = F.explode(F.split(F.coalesce(F.col(field), F.lit("")), ";")) if multi else F.col(field)
    return df.select(key, v.alias("value")).withColumn("value", F.trim("value")).where("value <> ''").join(allowed, "value", "left_anti").select(key, "value")


def source_violations(sources: DataFrame) -> DataFrame:
    """doc_id and what is wrong with library metadata: blank or repeated ids, words that are not allowed, missing columns."""
    spark = sources.sparkSession
    out = spark.createDataFrame([(None, f"missing_column:{c}") for c in missing_columns(sources, SOURCE_COLUMNS)], "doc_id string, problem string")
    if "doc_id" in sources.columns:
        ids = sources.select(F.col("doc_id").cast("string").alias("doc_id"))
        out = out.unionByName(ids.where(_blank(F.col("doc_id"))).withColumn("problem", F.lit("blank_id")))
        out = out.unionByName(ids.where(~_blank(F.col("doc_id"))).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit("duplicate_id").alias("problem")))
        for field, words in SOURCE_ENUMS.items():
            if field in sources.columns:
                bad = sources.where(~_blank(F.col(field)) & ~F.trim(field).isin(*words))
                out = out.unionByName(bad.select(F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit(f"{field}:"), field).alias("problem")))
    return out


def card_violations(cards: DataFrame, sources: DataFrame, key: str = "claim_id", required: list[str] | None = None) -> DataFrame:
    """key and what is wrong with a card: a missing field, a strength that is not allowed, a source that does not exist."""
    required = CARD_FIELDS if required is None else required
    absent = [F.when(F.col(c).isNull() if c in cards.columns and dict(cards.dtypes)[c].startswith("array") else _blank(F.col(c)) if c in cards.columns else F.lit(True), F.lit(f"missing:{c}")) for c in required]
    strength = [F.when(~_blank(F.col("strength")) & ~F.col("strength").isin(*STRENGTHS), F.concat(F.lit("strength:"), "strength"))] if "strength" in cards.columns else []
    out = cards.select(key, F.explode(F.array_compact(F.array(*absent, *strength, F.lit(None).cast("string")))).alias("problem"))
    if "evidence_sources" not in cards.columns:
        return out
    unknown = cards.select(key, F.explode("evidence_sources").alias("source_id")).join(sources.select("source_id"), "source_id", "left_anti")
    return out.unionByName(unknown.select(key, F.concat(F.lit("unknown_source:"), F.col("source_id").cast("string")).alias("problem")))
