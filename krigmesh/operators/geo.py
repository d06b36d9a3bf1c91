"""Coordinates, grid cells, range joins and nearest neighbours.

Distances within a radius are found by an equi-join on square buckets of that size: one side goes to the nine buckets
around it, so each pair meets in exactly one bucket. Where one bucket holds many points, the side that stays is dealt
to ``salt`` parts and the other is copied to each, so a dense place spreads over tasks.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from .foldnear import spacing


def utm_epsg(lon: Column, lat: Column) -> Column:
    zone = F.least(F.greatest(F.floor((lon + 180) / 6) + 1, F.lit(1)), F.lit(60))
    return (F.when(lat >= 0, F.lit(32600)).otherwise(F.lit(32700)) + zone).cast("int")


def resolve_utm(df: DataFrame, lon: str = "lon", lat: str = "lat", configured: str = "auto") -> DataFrame:
    """Zone of the median place; a configured zone is used but compared."""
    m = exact_quantiles(df, lon, {"lon": 0.5}).select("lon").join(exact_quantiles(df, lat, {"lat": 0.5}).select("lat"), F.lit(True), "full")  # one row each
    m = m.withColumn("suggested", utm_epsg(F.col("lon"), F.col("lat")))
    used = F.col("suggested") if configured == "auto" else F.lit(int(configured))
    return m.withColumn("used", used).withColumn("mismatch", F.col("used") != F.col("suggested"))


A_WGS84, F_WGS84, K0 = 6378137.0, 1 / 298.257223563, 0.9996


def _series() -> tuple[float, list[float], list[float]]:
    """Rectifying radius and Krueger's coefficients to the third order in n."""
    n = F_WGS84 / (2 - F_WGS84)
    radius = A_WGS84 / (1 + n) * (1 + n * n / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n * n / 3 + 5 * n**3 / 16, 13 * n * n / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    beta = [n / 2 - 2 * n * n / 3 + 37 * n**3 / 96, n * n / 48 + n**3 / 15, 17 * n**3 / 480]
    return radius, alpha, beta


def to_utm(lon: Column, lat: Column, epsg: int) -> tuple[Column, Column]:
    """Easting and northing by the transverse Mercator series; within a zone exact to under a millimetre."""
    radius, alpha, _ = _series()
    e = math.sqrt(F_WGS84 * (2 - F_WGS84))
    phi, lam = F.radians(lat), F.radians(lon - ((epsg % 100) * 6 - 183))
    s = F.sin(phi)
    tau = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(tau, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + tau * tau))
    x = eta + sum(a * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, a in enumerate(alpha))
    y = xi + sum(a * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, a in enumerate(alpha))
    return 500000.0 + K0 * radius * x, (10000000.0 if epsg // 100 == 327 else 0.0) + K0 * radius * y


def from_utm(x: Column, y: Column, epsg: int) -> tuple[Column, Column]:
    """Longitude and latitude of a UTM place."""
    radius, _, beta = _series()
    n = F_WGS84 / (2 - F_WGS84)
    xi0 = (y - (10000000.0 if epsg // 100 == 327 else 0.0)) / (K0 * radius)
    eta0 = (x - 500000.0) / (K0 * radius)
    xi = xi0 - sum(b * F.sin(2 * (j + 1) * xi0) * F.cosh(2 * (j + 1) * eta0) for j, b in enumerate(beta))
    eta = eta0 - sum(b * F.cos(2 * (j + 1) * xi0) * F.sinh(2 * (j + 1) * eta0) for j, b in enumerate(beta))
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    delta = [2 * n - 2 * n * n / 3 - 2 * n**3, 7 * n * n / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    lat = chi + sum(d * F.sin(2 * (j + 1) * chi) for j, d in enumerate(delta))
    return F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + ((epsg % 100) * 6 - 183), F.degrees(lat)


def cell_id(x: Column, y: Column, x0: float, y0: float, res: float, ncol: int) -> Column:
    """Number of the grid cell of a place, row by row from the upper left corner (x0, y0)."""
    return (F.floor((F.lit(y0) - y) / res) * ncol + F.floor((x - x0) / res)).cast("bigint")


def extract_cells(points: DataFrame, grid: DataFrame, x0: float, y0: float, res: float, ncol: int) -> DataFrame:
    """points with the layers of their cell; a place off the grid gets nulls."""
    return points.withColumn("cell", cell_id(F.col("x"), F.col("y"), x0, y0, res, ncol)).join(grid.drop("x", "y"), "cell", "left")


def complete_mask(grid: DataFrame, layers: list[str], first_only: bool = False) -> DataFrame:
    """Cells where every layer (or the first) has a value."""
    return grid.where(F.col(layers[0]).isNotNull()) if first_only else grid.where(sum(F.col(c).isNotNull().cast("int") for c in layers) == len(layers))


def bilinear(source: DataFrame, target: DataFrame, x0: float, y0: float, res: float, value: str = "value") -> DataFrame:
    """source cells (row, col, value) at the places of target (cell, x, y), from the four centres around each.

    A place whose four centres are not all there becomes null.
    """
    fx, fy = (F.col("x") - x0) / res - 0.5, (F.lit(y0) - F.col("y")) / res - 0.5
    t = target.withColumn("_c", F.floor(fx)).withColumn("_r", F.floor(fy)).withColumn("_wx", fx - F.col("_c")).withColumn("_wy", fy - F.col("_r"))
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])).alias("k")
    t = t.select("*", corner).withColumn("row", (F.col("_r") + F.col("k.i")).cast("bigint")).withColumn("col", (F.col("_c") + F.col("k.j")).cast("bigint"))
    w = F.when(F.col("k.i") == 1, F.col("_wy")).otherwise(1 - F.col("_wy")) * F.when(F.col("k.j") == 1, F.col("_wx")).otherwise(1 - F.col("_wx"))
    got = t.withColumn("_w", w).join(source.select(F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), F.col(value).alias("_v")), ["row", "col"], "left")
    return got.groupBy("cell", "x", "y").agg(F.when(F.count("_v") == 4, F.sum(F.col("_v") * F.col("_w"))).alias(value))


def _near(df: DataFrame, radius: float) -> DataFrame:
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("_d")
    df = df.select("*", around)
    return df.withColumn("_bx", F.floor(F.col("x") / radius) + F.col("_d.i")).withColumn("_by", F.floor(F.col("y") / radius) + F.col("_d.j")).drop("_d")


def _own(df: DataFrame, radius: float) -> DataFrame:
    return df.withColumn("_bx", F.floor(F.col("x") / radius)).withColumn("_by", F.floor(F.col("y") / radius))


def range_join(left: DataFrame, right: DataFrame, radius: float, on: list[str] | None = None, where: Column | None = None, salt: int = 1) -> DataFrame:
    """Pairs of left (columns l_*) and right (r_*) at most radius apart, with their distance h.

    Both need x and y; `on` are further equal columns; `where` filters pairs (columns l_* and r_*).
    """
    on = on or []
    name = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    a, b = name(_own(left, radius), "l"), name(_near(right, radius), "r")
    keys = [*on, "_bx", "_by"]
    if salt > 1:
        a = a.withColumn("l__s", F.pmod(F.xxhash64(*[c for c in a.columns if not c.startswith("l__")]), F.lit(salt)).cast("int"))
        b = b.withColumn("r__s", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        keys.append("_s")
    dx, dy = F.col("l_x") - F.col("r_x"), F.col("l_y") - F.col("r_y")
    cond = [F.col(f"l_{k}") == F.col(f"r_{k}") for k in keys] + ([where] if where is not None else [])
    both = a.join(b.hint("shuffle_hash"), cond).withColumn("h", F.sqrt(dx * dx + dy * dy)).where(F.col("h") <= radius)
    return both.drop(*[f"{p}_{k}" for p in "lr" for k in ("_bx", "_by", "_s")])


def pairs(points: DataFrame, radius: float, key: str = "code", salt: int = 1) -> DataFrame:
    """Each unordered pair of points at most radius apart, once."""
    return range_join(points, points, radius, where=F.col(f"l_{key}") < F.col(f"r_{key}"), salt=salt)


def mean_radius(points: DataFrame, expected: float) -> float:
    """Radius of the circle that holds so many points by the mean density; 0 where that tells nothing."""
    n, width, height = points.agg(F.count("*"), F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    area = (width or 0.0) * (height or 0.0)
    return math.sqrt(expected * area / (math.pi * n)) if n and 0 < area < math.inf else 0.0


def neighbours(queries: DataFrame, samples: DataFrame, radius: float, nmax: int, on: list[str] | None = None, where: Column | None = None, query_key: str = "code", sample_key: str = "code") -> DataFrame:
    """The nmax nearest samples of each query within radius, numbered rn by distance and key.

    The first radius holds some twice nmax samples by the mean density, the next 32 times nmax; only queries with fewer
    than nmax there look as far as `radius`, so pairs grow with the points and not with the radius allowed.
    """
    keys = [*(on or []), query_key]
    first, parts, todo = mean_radius(samples, 2 * nmax), [], queries
    ids = [f"l_{c}" for c in keys]
    w = Window.partitionBy(*ids)
    for r in [r for r in (first, 4 * first) if 0 < r < radius] + [radius]:
        met = range_join(todo, samples, r, on, where)
        near = met.withColumn("rn", F.row_number().over(w.orderBy("h", f"r_{sample_key}"))).where(F.col("rn") <= nmax)
        if r < radius:
            near = near.withColumn("_most", F.max("rn").over(w)).where(F.col("_most") == nmax).drop("_most")
            full = met.groupBy(*ids).agg(F.count("*").alias("_n")).where(F.col("_n") >= nmax).select(*[F.col(c).alias(f"_f{i}") for i, c in enumerate(ids)])
            todo = todo.join(full, [F.col(c).eqNullSafe(F.col(f"_f{i}")) for i, c in enumerate(keys)], "left_anti")
        parts.append(near)
    return reduce(DataFrame.unionByName, parts)


def nearest_spacing(points: DataFrame, radius: float, key: str = "code") -> DataFrame:
    """Distance to the nearest other point: minimum, median, mean and maximum over all points (n) of at least two.

    The search goes leaf by leaf within a radius that suffices for nearly all points by the mean density, at most the one
    given. The few whose surroundings may be empty look again within twice as much, and so on, so sparse ones stay in.
    """
    own = points.select(F.col(key).alias("code"), "x", "y")
    found, todo, radius = spacing(own, radius)
    if todo is not None and own.limit(2).count() == 2:
        for _ in range(64):
            radius *= 2
            met = range_join(own, todo, radius, where=F.col("l_code") != F.col("r_code")).groupBy(F.col("r_code").alias("code")).agg(F.min("h").alias("d"))
            found = found.unionByName(met)
            todo = todo.join(met.select("code"), "code", "left_anti")
            if todo.isEmpty():
                break
    found = found.groupBy("code").agg(F.min("d").alias("d"))
    g = found.agg(F.count("*").alias("n"), F.min("d").alias("min_nn"), F.avg("d").alias("mean_nn"), F.max("d").alias("max_nn"))
    median = exact_quantiles(found, "d", {"median_nn": 0.5}).select("median_nn")
    return g.join(median, F.lit(True), "left").select("n", "min_nn", "median_nn", "mean_nn", "max_nn")


def extent(points: DataFrame, digits: int = 4) -> DataFrame:
    """Extent, density and repeated places."""
    places = F.count_distinct(F.struct(F.bround("x", digits), F.bround("y", digits)))
    g = points.agg(F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("width"), (F.max("y") - F.min("y")).alias("height"), (F.count("*") - places).alias("n_duplicate"))
    area = F.col("width") * F.col("height")
    return g.withColumn("extent_major_axis", F.greatest("width", "height")).withColumn("density_per_km2", F.when(area > 0, F.col("n") / (area / 1e6)))
