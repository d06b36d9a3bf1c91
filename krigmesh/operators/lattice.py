"""Sums over all pairs by distance class where places are whole numbers, from spectra instead of pairs.

Points on a lattice have as many pairs at each lag as the autocorrelation of their counts says, and sums of squared
differences follow from those of values and squares. A class is a ring of lags, so its sum is one of the spectrum times
that of the ring. The spectrum is taken in slices: frequencies of one remainder in y come from the points' residues
alone, so a task holds one slice at a time, and slices add up. The work grows with the lattice's cells, not with the pairs.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pairsums import class_edges

LINE = 128  # frequencies in y of a slice
HELD = 64_000_000  # numbers of all points that a task may hold
CELLS = 1 << 23  # and cells of a slice
PAIR_NS, CELL_NS, PUT_NS = 8.0, 60.0, 60.0  # measured: a pair by matrices; a cell of a transform; a point put into a slice

System = tuple[tuple[str, float] | None, list[dict[str, float]]]


def _smooth(n: int) -> int:
    """The least product of twos, threes and fives that is at least n."""
    odd = [3**i * 5**j for i in range(21) for j in range(14) if 3**i * 5**j < 2 * n]
    return min(o << max(0, (-(-n // o) - 1).bit_length()) for o in odd)


def _shape(width: float, height: float, cutoff: float) -> tuple[int, int, int]:
    """Length in x, slices and length in y: no lag within the cutoff meets another one."""
    slices = -(-(int(height) + math.floor(cutoff) + 1) // LINE)
    return _smooth(int(width) + math.floor(cutoff) + 1), slices, slices * LINE


def worth(n: int, width: float, height: float, cutoff: float, systems: list[System], columns: int) -> bool:
    """Whether slices fit a task and are less work than the pairs, by the mean density."""
    if not 0 < cutoff < 2**20 or max(width, height) > 2**40 or n * (columns + 1) > HELD:
        return False
    lx, slices, ly = _shape(width, height, cutoff)
    if lx * LINE > CELLS:
        return False
    fields, sums = sum(1 + 2 * len(v) for _, v in systems), sum(1 + len(v) for _, v in systems)
    pairs = n * n / 2 * min(1.0, math.pi * cutoff * cutoff / max(1.0, width * height))
    work = lx * ly / 2 * CELL_NS * (fields + sums / 2) + n * fields * slices / 2 * PUT_NS
    return work < pairs * PAIR_NS * (1 + sum(len(v) for _, v in systems) / 10)


class _Rings:
    """Weights of each class at each lag in x and frequency in y: as many as lags, and by their length."""

    def __init__(self, edges: np.ndarray, ly: int):
        self.c, self.ly = math.isqrt(math.floor(edges[-1])), ly
        self.last = np.floor(edges).astype(np.int64)  # squares are whole
        side = np.arange(self.c + 1, dtype=np.int64)
        self.upto = np.stack([np.searchsorted(side * side, e - side * side, "right") - 1 for e in self.last])  # largest lag in y, -1: none

    def of(self, r: int, slices: int) -> np.ndarray:
        """(2 * classes, lag in x, frequency) for the frequencies slices * j + r."""
        c, n = self.c, len(self.last) - 1
        dy = np.arange(c + 1)
        both = np.where(dy == 0, 1.0, 2.0)
        table = np.cumsum(both[:, None] * np.cos(2 * np.pi * (dy[:, None] * (slices * np.arange(LINE) + r) % self.ly) / self.ly), 0)
        table = np.concatenate([np.zeros((1, LINE)), table])  # row of the largest lag + 1
        out = np.empty((2 * n, c + 1, LINE))
        for k in range(n):
            out[k] = table[self.upto[k + 1] + 1] - table[self.upto[k] + 1]
        turn = both * np.exp(-2j * np.pi * (r * dy % self.ly) / self.ly)
        step = max(1, 400_000 // (c + 1))
        for a in range(0, c + 1, step):
            dx = np.arange(a, min(a + step, c + 1), dtype=np.int64)
            d = dx[:, None] ** 2 + dy.astype(np.int64) ** 2
            k = np.searchsorted(self.last, d)  # 0: no distance, n + 1: beyond
            i, j = np.nonzero((k > 0) & (k <= n))
            at = ((k[i, j] - 1) * len(dx) + i) * LINE + j % LINE
            v = np.sqrt(d[i, j].astype(float)) * turn[j]
            fold = np.bincount(at, v.real, n * len(dx) * LINE) + 1j * np.bincount(at, v.imag, n * len(dx) * LINE)
            out[n:, a : a + len(dx)] = np.fft.fft(fold.reshape(n, len(dx), LINE), axis=2).real
        out[:, 1:] *= 2.0  # lags in x of either sign
        return out


def _slice(x: np.ndarray, y: np.ndarray, systems: list, rings: _Rings, lx: int, slices: int, r: int) -> list[np.ndarray]:
    """Of each system (a function for its rows, None: all, and their values) (1 + values, 2 * classes): this slice's share in pairs and their lengths, and in squared differences."""
    nx = int(x.max()) + 1
    at, turn = x * LINE + y % LINE, np.exp(-2j * np.pi * (y * r % rings.ly) / rings.ly)

    def spectrum(t: np.ndarray, i: np.ndarray) -> np.ndarray:
        grid = (np.bincount(i, t.real, nx * LINE) + 1j * np.bincount(i, t.imag, nx * LINE)).reshape(nx, LINE)
        return np.fft.fft(np.ascontiguousarray(np.fft.fft(grid, axis=1).T), lx, axis=1)

    weights = rings.of(r, slices)
    weights = weights.reshape(len(weights), -1)
    share = 0.5 * (1.0 if 2 * r % slices == 0 else 2.0) / rings.ly  # a pair has a lag and its opposite, a slice its mirror
    c, wait, found, sizes = rings.c, [], [], []

    def add(power: np.ndarray, last: bool = False) -> None:
        """Two real spectra in one transform."""
        wait.append(power)
        if len(wait) < 2 and not last:
            return
        z = np.fft.ifft(wait[0] + 1j * wait[1] if len(wait) > 1 else wait[0], axis=1)
        near = z[:, : c + 1].copy()
        near[:, 1:] = 0.5 * (near[:, 1:] + z[:, : lx - c - 1 : -1])
        found.extend(weights @ np.ascontiguousarray(p.T).ravel() * share for p in (near.real, near.imag)[: len(wait)])
        wait.clear()

    for s, system in enumerate(systems):
        w, vs = system()
        sizes.append(1 + len(vs))
        i, t = (at, turn) if w is None else (at[w], turn[w])
        one = spectrum(t, i)
        add(one.real**2 + one.imag**2, s == len(systems) - 1 and not vs)
        for j, v in enumerate(vs):
            tv = t * v
            f, q = spectrum(tv, i), spectrum(tv * v, i)
            add(2.0 * (one.real * q.real + one.imag * q.imag - f.real**2 - f.imag**2), s == len(systems) - 1 and j == len(vs) - 1)
    out = []
    for size in sizes:
        out.append(np.stack(found[:size]))
        del found[:size]
    return out


def _scale(v: np.ndarray) -> float:
    """A power of two near the values' size: dividing by it loses nothing."""
    size = float(np.sqrt(np.mean(v * v))) if len(v) else 0.0
    return 2.0 ** round(math.log2(size)) if 0 < size < math.inf else 1.0


def _packed(columns: list[str], x0: float, y0: float):
    """A batch as one row of packed bytes: places from the corner, then the columns."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                col = lambda c: b.column(c).to_numpy(zero_copy_only=False)
                raw = b"".join([np.rint(col("x") - x0).astype(np.int32).tobytes(), np.rint(col("y") - y0).astype(np.int32).tobytes(), *(col(c).astype(float).tobytes() for c in columns)])
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([len(raw)]), pa.array([pa.compress(raw, "zstd", asbytes=True)], pa.binary())], ["rows", "size", "raw"])

    return run


def _task(columns: list[str], systems: list[System], edges: np.ndarray, shape: tuple[int, int, int], tasks: list[int]):
    lx, slices, ly = shape

    def run(batches):
        own: dict[int, list[list[np.ndarray]]] = {}
        for b in batches:
            for task, rows, size, raw in zip(*(b.column(c).to_pylist() for c in ("task", "rows", "size", "raw"))):
                data = pa.decompress(raw, size, "zstd", asbytes=True)
                places = np.frombuffer(data, np.int32, 2 * rows)
                own.setdefault(task, []).append([places[:rows], places[rows:], *np.frombuffer(data, np.float64, offset=8 * rows).reshape(-1, rows)])
        rings = _Rings(edges, ly) if own else None
        for task in sorted(own):
            x, y, *rest = (np.concatenate(c) for c in zip(*own.pop(task)))
            of = dict(zip(columns, rest))
            order = np.argsort(x, kind="stable")  # near in memory
            x, y, of = x[order].astype(np.int64), y[order].astype(np.int64), {c: v[order] for c, v in of.items()}
            scale: dict[tuple[int, int], float] = {}

            def system(s, of=of, scale=scale):
                w, vs = systems[s]
                kept, out = None if w is None else np.flatnonzero(of[w[0]] != w[1]), []
                for j, v in enumerate(vs):
                    v = sum(k * (of[c] if kept is None else of[c][kept]) for c, k in v.items())
                    v = v - (v.mean() if len(v) else 0.0)  # differences stay
                    scale[s, j] = _scale(v)  # spectra that share a transform are of one size
                    out.append(v / scale[s, j])
                return kept, out

            each = [functools.partial(system, s) for s in range(len(systems))]
            total = None
            for r in range(tasks.index(task), slices // 2 + 1, len(tasks)):
                got = _slice(x, y, each, rings, lx, slices, r)
                total = got if total is None else [a + b for a, b in zip(total, got)]
            n = len(edges) - 1
            rows = [(i, j, k + 1, m[j, k] * (scale[i, j - 1] ** 2 if j else 1.0), m[j, n + k]) for i, m in enumerate(total or []) for j in range(len(m)) for k in range(n)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()))], ["system", "value", "bin", "sum", "h"])

    return run


def _labels(df: DataFrame, n: int) -> list[int]:
    """Numbers that a shuffle into n partitions puts into one each."""
    found = df.sparkSession.range(0, 64 * n, 1, 1).groupBy(F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p")).agg(F.min("id").alias("id")).collect()
    return [int(r.id) for r in found]


def whole(*columns: str) -> Column:
    """Whether squares of these places' differences are exact."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & (F.col(c) == F.rint(c)) & (F.abs(F.col(c)) < 2.0**30)
    return ok


def lattice_sums(rows: DataFrame, columns: list[str], systems: list[System], cutoff: float, width: float) -> list[dict[int, tuple]] | None:
    """Of each system a dict from class to (np, h, sum of squared differences of each value); None where pairs are to be met instead.

    rows: code, x, y and columns of double, none null. A system is the rows but for those with a number in a
    column (None: all), and values that are sums of columns by factors. Counts are exact: they are whole numbers, and where a
    sum is not near one the answer is None.
    """
    n, odd, x0, x1, y0, y1, *means = rows.agg(F.count("*"), F.count_if(~whole("x", "y")), F.min("x"), F.max("x"), F.min("y"), F.max("y"), *[F.avg(c) for c in columns]).first()
    if not n or odd or not all(map(math.isfinite, means)) or not worth(n, x1 - x0, y1 - y0, cutoff, systems, len(columns)):
        return None
    if not rows.groupBy("code").count().where("count > 1").isEmpty():  # rows that share a key make no pair
        return None
    edges, shape = class_edges(width, cutoff), _shape(x1 - x0, y1 - y0, cutoff)
    labels = _labels(rows, max(1, min(shape[1] // 2 + 1, rows.sparkSession.sparkContext.defaultParallelism)))
    packed = rows.select("x", "y", *columns).mapInArrow(_packed(columns, x0, y0), "rows bigint, size bigint, raw binary")
    dealt = packed.withColumn("task", F.explode(F.array(*[F.lit(i) for i in labels]))).repartition(len(labels), "task")
    got = dealt.mapInArrow(_task(columns, systems, edges, shape, labels), "system int, value int, bin int, sum double, h double")
    sums = {(r.system, r.value, r.bin): (r.sum, r.h) for r in got.groupBy("system", "value", "bin").agg(F.sum("sum").alias("sum"), F.sum("h").alias("h")).collect()}  # a row for each system, value and class
    out: list[dict[int, tuple]] = []
    for i, (_, values) in enumerate(systems):
        out.append({})
        for k in range(1, len(edges)):
            pairs, h = sums[i, 0, k]
            if abs(pairs - round(pairs)) > 0.05:
                return None
            if round(pairs):
                out[i][k] = (round(pairs), h, *(max(0.0, sums[i, j + 1, k][0]) for j in range(len(values))))
    return out
