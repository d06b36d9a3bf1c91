"""Nearest points leaf by leaf, no row for a pair: of other folds where they are far, and of samples for kriging.

A tile's points meet all points within the radius of the tile in one task. Leaves of one fold look at leaves of other
folds from the nearest box on, and stop where no box can hold a nearer point than the nmax found.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE, LEAF = 8192, 128
FEW = 20000  # cells or tiles that are broadcast


def cut(x: np.ndarray, y: np.ndarray, groups: list[np.ndarray], size: int) -> list[np.ndarray]:
    """Row numbers in leaves of at most size near points, each within one of the groups."""
    out, todo = [], [g for g in groups if len(g)]
    while todo:
        i = todo.pop()
        if len(i) <= size:
            out.append(i)
            continue
        by = x[i] if np.ptp(x[i]) >= np.ptp(y[i]) else y[i]
        i = i[np.argpartition(by, len(i) // 2)]
        todo += [i[: len(i) // 2], i[len(i) // 2 :]]
    return out


def nearest(q: tuple, s: tuple, radius: float, nmax: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query and sample row and distance of the nmax nearest samples of another fold; q, s: x, y, fold (0: none), order of codes (s)."""
    (qx, qy, qf), (sx, sy, sf, rank) = q, s
    rank = np.append(rank, np.iinfo(np.int64).max)  # of no sample, row -1
    leaves = cut(sx, sy, [np.flatnonzero(sf == f) for f in np.unique(sf) if f], LEAF)
    box = lambda f: np.array([(f(sx[i]), f(sy[i])) for i in leaves]).reshape(-1, 2)
    low, high, fold, out = box(np.min), box(np.max), np.array([sf[i[0]] for i in leaves]), []
    for i in cut(qx, qy, [np.flatnonzero(qf == f) for f in np.unique(qf) if f], LEAF):
        x, y = qx[i], qy[i]
        gap = np.maximum(0.0, np.maximum(low - [x.max(), y.max()], [x.min(), y.min()] - high))
        gap = np.where(fold == qf[i[0]], np.inf, np.hypot(gap[:, 0], gap[:, 1]) * (1 - 1e-9))
        h, at = np.full((len(i), nmax), np.inf), np.full((len(i), nmax), -1)
        for j in np.argsort(gap):
            if gap[j] > min(radius, h[:, -1].max()):
                break
            k = leaves[j]
            dx, dy = x[:, None] - sx[k], y[:, None] - sy[k]
            d = np.sqrt(dx * dx + dy * dy)
            fits = (d <= radius) & (d <= h[:, -1:])
            cols, rows = np.flatnonzero(fits.any(0)), np.flatnonzero(fits.any(1))
            if not len(cols):
                continue
            d, near = np.where(fits, d, np.inf)[np.ix_(rows, cols)], np.where(fits, k, -1)[np.ix_(rows, cols)]
            both, who = np.concatenate([h[rows], d], 1), np.concatenate([at[rows], near], 1)
            first = np.lexsort((rank[who], both), axis=-1)[:, :nmax]
            h[rows], at[rows] = np.take_along_axis(both, first, 1), np.take_along_axis(who, first, 1)
        out.append((np.repeat(i, nmax), at.ravel(), h.ravel(), np.tile(np.arange(1, nmax + 1), len(i))))
    if not out:
        return tuple(np.zeros(0, t) for t in (int, int, float, int))
    found = [np.concatenate(c) for c in zip(*out)]
    return tuple(c[found[1] >= 0] for c in found)


def _unit(methods: int, carried: list[str], radius: float, nmax: int, names: list[str]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        col = lambda t, c: t.column(c).to_numpy(zero_copy_only=False)
        rank = np.unique(col(right, "code"), return_inverse=True)[1].astype(np.int64) if right.num_rows else np.zeros(0, np.int64)
        parts = []
        for m in range(methods):
            s = (col(right, "x"), col(right, "y"), col(right, f"f{m}"), rank)
            q, r, h, rn = nearest((col(left, "x"), col(left, "y"), col(left, f"f{m}") * col(left, f"o{m}")), s, radius, nmax)
            first, b = np.flatnonzero(rn == 1), right.take(pa.array(r, pa.int64()))
            lists = pa.StructArray.from_arrays([pa.array(rn, pa.int32()), pa.array(h, pa.float64()), *(b.column(c).combine_chunks().cast(pa.float64()) for c in carried)], ["rn", "h", *carried])
            a = left.take(pa.array(q[first], pa.int64()))
            parts.append(pa.table([pa.array(np.full(len(first), m), pa.int32()), *(a.column(c) for c in (f"f{m}", "code", "x", "y")), pa.ListArray.from_arrays(pa.array(np.append(first, len(rn)), pa.int32()), lists)], names=names))
        return pa.concat_tables(parts)

    return run


def _fold_tiles(wide: DataFrame, methods: int, carried: list[str], r: float, nmax: int, tile: float) -> DataFrame:
    """The nearest samples of other folds within r for rows that search (o0 ...): a sample goes to tiles that search from another fold."""
    side, ms = max(tile, r / 8), range(methods)
    left = wide.where(reduce(lambda a, b: a | b, [F.col(f"o{m}") for m in ms])).select(_tile("x", side).alias("_tx"), _tile("y", side).alias("_ty"), "code", "x", "y", *[F.col(f"f{m}") for m in ms], *[F.col(f"o{m}").cast("int").alias(f"o{m}") for m in ms])
    ends = [e(F.when((F.col(f"o{m}") == 1) & (F.col(f"f{m}") > 0), F.col(f"f{m}"))).alias(f"_{n}{m}") for m in ms for e, n in ((F.min, "a"), (F.max, "b"))]
    tiles = left.groupBy("_tx", "_ty").agg(*ends)
    tiles = F.broadcast(tiles) if tiles.limit(FEW + 1).count() <= FEW else tiles
    wanted = reduce(lambda a, b: a | b, [F.coalesce((F.col(f"_a{m}") != F.col(f"f{m}")) | (F.col(f"_b{m}") != F.col(f"f{m}")), F.lit(False)) for m in ms])
    right = _copies(wide.drop(*[f"o{m}" for m in ms]), side, r).join(tiles, ["_tx", "_ty"]).where(wanted).select("_tx", "_ty", "code", *carried, *[f"f{m}" for m in ms])
    right = right.toDF(*right.columns)  # columns of its own
    code = dict(wide.dtypes)["code"]
    schema = f"m int, for_fold int, code {code}, qx double, qy double, near array<struct<rn: int, h: double, {', '.join(f'{c}: double' for c in carried)}>>"
    return left.groupBy("_tx", "_ty").cogroup(right.groupBy("_tx", "_ty")).applyInArrow(_unit(methods, carried, r, nmax, ["m", "for_fold", "code", "qx", "qy", "near"]), schema)


def fold_sets(wide: DataFrame, methods: int, carried: list[str], radius: float | None, nmax: int) -> DataFrame:
    """m (number of the method), for_fold, code, qx, qy, near: the list (rn, h, carried) of the nmax nearest of other folds, by distance and code.

    wide: code, x, y, its fold f0 ... under each method, and carried (x and y among them). Rows without a neighbour have no list. A first radius
    suffices where counts of cells say so; without a largest radius the search widens until it covers the extent.
    """
    ms = range(methods)
    wide = wide.where(place("x") & place("y")).select("code", *[F.col(c).cast("double").alias(c) for c in carried], *[F.coalesce(F.col(f"f{m}"), F.lit(0)).cast("int").alias(f"f{m}") for m in ms])
    n, width, height, tile, x0, y0 = _extent(wide)
    first = _first_radius(n, width, height, 2 * nmax)
    radii = [r for r in (first * 4**k for k in range(16)) if 0 < r < radius][:1] + [radius] if radius is not None else [r for r in (first * 4**k for k in range(16)) if 0 < r < math.hypot(width, height)] + [1.0 + math.hypot(width, height)]
    open_, parts = wide.withColumns({f"d{m}": F.lit(False) for m in ms}), []
    for r in radii:
        flags = {f"o{m}": ~F.col(f"d{m}") for m in ms}
        if r < radii[-1]:
            cell = r / math.sqrt(2) * (1 - 1e-9)
            open_ = open_.withColumns({"_cx": _cell("x", x0, width, cell), "_cy": _cell("y", y0, height, cell)})
            for m in ms:
                each = open_.where(f"f{m} > 0").groupBy("_cx", "_cy", f"f{m}").agg(F.count("*").alias("_n"))
                others = each.groupBy("_cx", "_cy").agg(F.sum("_n").alias("_all"))
                full = each.join(others, ["_cx", "_cy"]).where(F.col("_all") - F.col("_n") >= nmax).select("_cx", "_cy", f"f{m}", F.lit(True).alias(f"e{m}"))
                open_ = open_.join(full, ["_cx", "_cy", f"f{m}"], "left").withColumn(f"e{m}", F.coalesce(f"e{m}", F.lit(False)))
            flags = {f"o{m}": ~F.col(f"d{m}") & F.col(f"e{m}") for m in ms}
        parts.append(_fold_tiles(open_.withColumns(flags), methods, carried, r, nmax, tile))
        if r < radii[-1]:
            open_ = open_.withColumns({f"d{m}": F.col(f"d{m}") | F.col(f"e{m}") for m in ms}).drop("_cx", "_cy", *[f"e{m}" for m in ms])
    return reduce(DataFrame.unionByName, parts)


def _tile(c: str, side: float) -> Column:
    return F.floor(F.col(c) / side)


def _copies(df: DataFrame, side: float, reach: float) -> DataFrame:
    """df once for each tile (_tx, _ty) that lies within reach of the row's place."""
    far = math.ceil(reach / side) + 1
    gap = lambda k: max(abs(k) - 1, 0) * side
    around = [(i, j) for i in range(-far, far + 1) for j in range(-far, far + 1) if math.hypot(gap(i), gap(j)) <= reach * (1 + 1e-9)]
    each = df.select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in around])).alias("_d"))
    each = each.withColumns({"_tx": _tile("x", side) + F.col("_d.i"), "_ty": _tile("y", side) + F.col("_d.j")}).drop("_d")
    apart = lambda c, t: F.greatest(F.col(t) * side - F.col(c), F.col(c) - (F.col(t) + 1) * side, F.lit(0.0))
    dx, dy = apart("x", "_tx"), apart("y", "_ty")
    return each.where(dx * dx + dy * dy <= (reach * (1 + 1e-6)) ** 2)


def _sets(radius: float, nmax: int, names: list[str]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        col = lambda t, c: t.column(c).to_numpy(zero_copy_only=False)
        ones = lambda t: np.ones(t.num_rows, np.int64)
        rank = np.asarray(pc.rank(right.column("code").combine_chunks(), sort_keys="ascending", null_placement="at_start", tiebreaker="dense"), np.int64) if right.num_rows else ones(right)
        q, s, _, rn = nearest((col(left, "x"), col(left, "y"), ones(left)), (col(right, "x"), col(right, "y"), 2 * ones(right), rank), radius, nmax)
        first, found = np.flatnonzero(rn == 1), right.take(pa.array(s, pa.int64()))
        lists = pa.StructArray.from_arrays([pa.array(rn, pa.int32()), *(found.column(c).combine_chunks().cast(pa.float64()) for c in ("x", "y", "z"))], ["rn", "x", "y", "z"])
        own = left.take(pa.array(q[first], pa.int64()))
        return pa.table([*(own.column(c) for c in ("code", "x", "y")), pa.ListArray.from_arrays(pa.array(np.append(first, len(rn)), pa.int32()), lists)], names=names)

    return run


def place(c: str) -> Column:
    return F.col(c).isNotNull() & (F.abs(F.col(c)) < float("inf"))  # NaN is above infinity


def _first_radius(n: int, width: float, height: float, wanted: int) -> float:
    """Radius whose inscribed square holds by the mean density (on a line by its length) so many points that few squares lack `wanted`."""
    area, many = width * height, wanted + 6 * math.sqrt(wanted) + 16
    if n and 0 < area < math.inf:
        return math.sqrt(2 * many * area / n)
    return many * max(width, height) / n if n and max(width, height) < math.inf else 0.0


def _cell(c: str, low: float, length: float, most: float) -> Column:
    """Number of a place's cell; cells of at most that length fill the samples' extent without one cut by its edge."""
    n = max(1, math.ceil(length / most))
    return F.when(F.col(c) == low + length, F.lit(n - 1).cast("bigint")).otherwise(F.floor((F.col(c) - low) / (length / n or most)))


def _levels(todo: DataFrame, s: DataFrame, radii: list[float], enough: Column, box: tuple):
    """(radius, queries that it suffices for), the last radius with all that is left.

    A query whose cell of the grid inscribed in a circle holds enough samples has all it needs within that circle's radius.
    Only cells are counted, and what they tell comes to the driver: no search, and no copy of the samples, is planned for nobody.
    """
    _, width, height, _, x0, y0 = box
    for r in radii:
        here = todo
        if r < radii[-1]:
            cell = r / math.sqrt(2) * (1 - 1e-9)
            key = [_cell("x", x0, width, cell).alias("_cx"), _cell("y", y0, height, cell).alias("_cy")]
            full = s.groupBy(*key).agg(enough.alias("_e")).where("_e").drop("_e")
            missing = todo.select(*key).distinct().join(full, ["_cx", "_cy"], "left_anti")
            n = missing.limit(FEW + 1).count()
            if n:
                missing = F.broadcast(missing) if n <= FEW else missing
                keyed, own = todo.select("*", *key), todo.columns
                here, todo = (keyed.join(missing, ["_cx", "_cy"], how).select(*own) for how in ("left_anti", "left_semi"))
        yield r, here
        if here is todo:
            return


def _meet(left: DataFrame, s: DataFrame, side: float, r: float, later: bool) -> DataFrame:
    """The samples once for each tile within r; where few queries are left only for the tiles of queries (left)."""
    right = _copies(s, side, r)
    if later:
        tiles = left.select("_tx", "_ty").distinct()
        right = right.join(F.broadcast(tiles) if tiles.limit(FEW + 1).count() <= FEW else tiles, ["_tx", "_ty"], "left_semi")
    right = right.select("_tx", "_ty", *s.columns)
    return right.toDF(*right.columns)  # columns of its own


def _extent(s: DataFrame) -> tuple[int, float, float, float, float, float]:
    """Rows, width, height, the side of the square that holds a tile's points by the mean density (0 where that tells nothing), least x and y."""
    n, width, height, x0, y0 = s.agg(F.count("*"), F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.min("x"), F.min("y")).first()
    area = float(width or 0.0) * float(height or 0.0)
    tile = min(2 * TILE, max(TILE // 4, n // 64))
    return n, float(width or 0.0), float(height or 0.0), math.sqrt(tile * area / n) if n and 0 < area < math.inf else 0.0, float(x0 or 0.0), float(y0 or 0.0)


def nearest_sets(queries: DataFrame, samples: DataFrame, radius: float, nmax: int) -> DataFrame:
    """code, qx, qy, near: the list (rn, x, y, z) of the nmax nearest samples of each query within radius, by distance and code.

    queries: code, x, y; samples: code, x, y, z. Queries without a sample within radius have no row. The first radius
    suffices for nearly all queries where samples lie evenly; the rest take four times the radius and so on up to `radius`.
    """
    todo, s = queries.select("code", "x", "y").where(place("x") & place("y")), samples.select("code", "x", "y", "z").where(place("x") & place("y"))
    names = ["code", "qx", "qy", "near"]
    schema = f"code {dict(todo.dtypes)['code']}, qx double, qy double, near array<struct<rn: int, x: double, y: double, z: double>>"
    n, width, height, tile, *_ = box = _extent(s)
    first, parts = _first_radius(n, width, height, nmax), []
    for r, here in _levels(todo, s, [r for r in (first * 4**k for k in range(16)) if 0 < r < radius] + [radius], F.count("*") >= nmax, box):
        side = max(tile, r / 8)
        left = here.select(_tile("x", side).alias("_tx"), _tile("y", side).alias("_ty"), F.col("code"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
        right = _meet(left, s, side, r, bool(parts))
        parts.append(left.groupBy("_tx", "_ty").cogroup(right.groupBy("_tx", "_ty")).applyInArrow(_sets(r, nmax, names), schema))
    return reduce(DataFrame.unionByName, parts)


def nearest_other(q: tuple, s: tuple, radius: float) -> np.ndarray:
    """Distance of each query to the nearest sample of another code within radius, else infinity; q, s: x, y, code (a number)."""
    (qx, qy, qc), (sx, sy, sc) = q, s
    out, leaves = np.full(len(qx), np.inf), cut(sx, sy, [np.arange(len(sx))], LEAF)
    box = lambda f: np.array([(f(sx[i]), f(sy[i])) for i in leaves]).reshape(-1, 2)
    low, high = box(np.min), box(np.max)
    of = [(sx[i], sy[i], sc[i]) for i in leaves]
    for i in cut(qx, qy, [np.arange(len(qx))], LEAF):
        x, y, c = qx[i][:, None], qy[i][:, None], qc[i][:, None]
        gap = np.maximum(0.0, np.maximum(low - [x.max(), y.max()], [x.min(), y.min()] - high))
        gap, least = (gap * gap).sum(1) * (1 - 1e-9), np.full(len(i), np.inf)
        for j in np.argsort(gap, kind="stable"):
            if gap[j] > least.max():
                break
            dx, dy = x - of[j][0], y - of[j][1]
            d = dx * dx + dy * dy
            d[c == of[j][2]] = np.inf
            np.minimum(least, d.min(1), out=least)
        out[i] = np.sqrt(least)
    out[out > radius] = np.inf
    return out


def _spacing(radius: float):
    def run(t: pa.Table) -> pa.Table:
        col = lambda c: t.column(c).to_numpy(zero_copy_only=False)
        code = np.asarray(pc.rank(t.column("code").combine_chunks(), sort_keys="ascending", tiebreaker="dense"), np.int64)
        own = np.flatnonzero(col("own").astype(bool))
        x, y = col("x"), col("y")
        d = nearest_other((x[own], y[own], code[own]), (x, y, code), radius)
        found = np.isfinite(d)
        return pa.table([t.column("code").take(pa.array(own[found], pa.int64())), pa.array(d[found], pa.float64())], names=["code", "d"])

    return run


def spacing(points: DataFrame, radius: float) -> tuple[DataFrame, DataFrame | None, float]:
    """code, d: distance to the nearest point of another code within a radius; those that may have none there (None: nobody); that radius.

    points: code, x, y; the radius is one that suffices for nearly all where points lie evenly, at most the one given.
    """
    s = points.where(F.col("code").isNotNull() & place("x") & place("y")).select("code", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    n, width, height, tile, *_ = box = _extent(s)
    r = min(_first_radius(n, width, height, 2) or radius, radius)
    _, *rest = _levels(s, s, [r, math.inf], F.min("code") < F.max("code"), box)
    side = max(tile, r / 8)
    own = (_tile("x", side) == F.col("_tx")) & (_tile("y", side) == F.col("_ty"))
    rows = _copies(s, side, r).select("_tx", "_ty", "code", "x", "y", own.alias("own"))
    found = rows.groupBy("_tx", "_ty").applyInArrow(_spacing(r), f"code {dict(s.dtypes)['code']}, d double")
    return found, rest[0][1] if rest else None, r
