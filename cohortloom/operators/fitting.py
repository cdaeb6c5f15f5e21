"""Many linear models of binary features at once.

A design is kept packed: a row for each distinct set of held features (`bits`, the first feature in the lowest bit), with the number of its cases and of the positive ones. All models of
a search take their steps together: tasks add up losses and slopes of every model by one product of matrices, and each model's sums are solved in a task of its own. The driver sees
coefficients and, once for each design, the products of its features, whose number is bounded by the features.

Steps use the products of all cases at even odds, which bound the curvature; a model that comes on too slowly gets products of its own, as in Newton's method. Steps that raise the
penalised loss are halved, so that every fit descends.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .mining import cut

#: Steps of a fit at most, models that get products of their own in one step, and patterns that one task ranks.
ROUNDS, OWN, RANKED = 200, 8, 50_000


def tasks(spark: SparkSession, rows: int, least: int = 2_000, most: int = 200_000) -> int:
    """Into how many tasks heavy work on so many rows is dealt; small tables would else stay in one."""
    return max(1, -(-rows // most), min(2 * spark.sparkContext.defaultParallelism, -(-rows // least)))


def bytes_of(batch: pa.RecordBatch, width: int, column: str) -> np.ndarray:
    """A binary column of `width` bytes a row as a matrix."""
    x = batch.column(column)
    raw = np.frombuffer(x.buffers()[2], np.uint8)[x.offset * width : (x.offset + len(x)) * width] if width and len(x) else np.zeros(0, np.uint8)
    return raw.reshape(len(x), width)


def bytes_rows(matrix: np.ndarray) -> pa.Array:
    """A matrix of bytes as a binary column."""
    raw = np.ascontiguousarray(matrix)
    ends = np.arange(len(raw) + 1, dtype=np.int32) * np.int32(raw.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(ends), pa.py_buffer(raw)])


def bits_of(batch: pa.RecordBatch, size: int) -> np.ndarray:
    """The 0/1 matrix of packed features."""
    return np.unpackbits(bytes_of(batch, -(-size // 8), "bits"), axis=1, count=size, bitorder="little")


def packed_rows(matrix: np.ndarray) -> pa.Array:
    """A row of packed features for each row of a 0/1 matrix."""
    return bytes_rows(np.packbits(matrix, axis=1, bitorder="little"))


def pack(size: int):
    """Batches with packed features instead of held ones."""

    def run(batches):
        for batch in batches:
            held, others = batch.column("held"), [c for c in batch.schema.names if c != "held"]
            at, flat = np.asarray(held.offsets).astype(np.int64), np.asarray(held.flatten())
            row, keep = np.repeat(np.arange(batch.num_rows), np.diff(at)), flat < size
            out = np.zeros((batch.num_rows, size), np.uint8)
            out[row[keep], flat[keep]] = 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), packed_rows(out)], [*others, "bits"])

    return run


@dataclass
class Patterns:
    """(fold, bits, n, pos) of a design of `size` features; fold is -1 where a case has none."""

    table: DataFrame
    size: int
    known: dict = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.table.sparkSession

    @property
    def folds(self) -> dict[int, tuple[int, int]]:
        """{fold: (cases, positive ones)}."""
        if "folds" not in self.known:
            self.known["folds"] = {r["fold"]: (r["n"], r["pos"]) for r in self.table.groupBy("fold").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).collect()}  # a row for each fold
        return self.known["folds"]

    @property
    def rows(self) -> int:
        if "rows" not in self.known:
            self.known["rows"] = self.table.count()
        return self.known["rows"]

    def classes(self, without: int | None = None) -> tuple[int, int]:
        """(negative, positive) cases of the other folds."""
        some = [v for k, v in self.folds.items() if k != without]
        return sum(n - p for n, p in some), sum(p for _, p in some)

    def counts(self) -> np.ndarray:
        """Cases of either class that hold each feature: two rows."""
        size = self.size

        def run(batches):
            out = np.zeros((2, size))
            for batch in batches:
                n, pos = (np.asarray(batch.column(c), float) for c in ("n", "pos"))
                out += np.stack([n - pos, pos]) @ bits_of(batch, size)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()])], ["x"])

        if "counts" not in self.known:
            parts = self.table.select("bits", "n", "pos").mapInArrow(run, "x binary").collect()  # a row for each task
            self.known["counts"] = sum((np.frombuffer(r["x"]) for r in parts), np.zeros(2 * size)).reshape(2, size)
        return self.known["counts"]

    def products(self) -> np.ndarray:
        """Products of features and intercept (the last) over all cases, balanced by class, at even odds."""
        if "products" not in self.known:
            n0, n1 = self.classes()
            self.known["products"] = gram(self.table, self.size, (n0 + n1) / max(1, 8 * n0), (n0 + n1) / max(1, 8 * n1))
        return self.known["products"]


def packed(table: DataFrame, size: int, cases: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, bits, n, pos), cut, of rows (by, y, bits): cases that hold the same features add up."""
    dealt = table.repartition(tasks(table.sparkSession, cases), "bits")
    return cut(dealt.groupBy(*by, "bits").agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("pos")))


def patterns(rows: DataFrame, size: int, fold: str | None = None) -> Patterns:
    """A design (y, held, fold) packed."""
    kept = rows.select(F.col("y").cast("int").alias("y"), (F.lit(-1) if fold is None else F.col(fold).cast("int")).alias("fold"), "held")
    return Patterns(packed(kept.mapInArrow(pack(size), "y int, fold int, bits binary"), size, rows.count(), ("fold",)), size)


def gram(table: DataFrame, size: int, negative: float, positive: float) -> np.ndarray:
    """Sums of the products of features and intercept over the cases of (bits, n, pos), with a weight for each class."""
    k = size + 1
    step = max(1, -(-k // 16))

    def run(batches):
        out = np.zeros((k, k))
        for batch in batches:
            n, pos = (np.asarray(batch.column(c), float) for c in ("n", "pos"))
            root = np.sqrt(negative * (n - pos) + positive * pos)
            x = np.ones((batch.num_rows, k))
            x[:, :size] = bits_of(batch, size)
            x *= root[:, None]
            out += x.T @ x
        for i in range(0, k, step):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([out[i : i + step].tobytes()])], ["i", "x"])

    def added(parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": parts["i"].iloc[:1], "x": [sum(np.frombuffer(x) for x in parts["x"]).tobytes()]})

    got = table.select("bits", "n", "pos").mapInArrow(run, "i int, x binary").groupBy("i").applyInPandas(added, "i int, x binary").collect()
    return np.concatenate([np.frombuffer(r["x"]).reshape(-1, k) for r in sorted(got, key=lambda r: r["i"])]) if got else np.zeros((k, k))


@dataclass(frozen=True)
class Cell:
    """A model to fit: its features, inverse penalty and kind, and the fold that it doesn't see."""

    keep: tuple[int, ...]
    c: float
    l1: bool
    without: int | None = None


@dataclass(frozen=True)
class _State:
    """Where a fit stands: its next point (coefficients, then the intercept), and the last point that lowered the loss, with loss, slope and by how much it misses the optimum."""

    at: np.ndarray
    good: np.ndarray | None = None
    loss: float = np.inf
    slope: np.ndarray | None = None
    off: float = np.inf
    own: bool = False
    done: bool = False


def _off(b: np.ndarray, slope: np.ndarray, lam: float, l1: bool) -> float:
    """By how much the conditions of the optimum are missed at most."""
    if l1:
        x = np.where(b[:-1] != 0, np.abs(slope[:-1] + lam * np.sign(b[:-1])), np.maximum(np.abs(slope[:-1]) - lam, 0))
    else:
        x = np.abs(slope[:-1] + lam * b[:-1])
    return float(max(x.max(initial=0), abs(slope[-1])))


def quadratic(h: np.ndarray, slope: np.ndarray, b: np.ndarray, lam: float, l1: bool, tolerance: float, sweeps: int = 3) -> np.ndarray:
    """The minimum over x of slope (x - b) + (x - b) h (x - b) / 2 + penalty(x), the last coordinate without penalty. For L1, sweeps over the coordinates choose which are zero, and the
    others are then solved as a whole, up to where the first of them changes its sign."""
    k = len(b)
    jitter = 1e-10 * max(np.diag(h).mean(), 1e-300)
    if not l1:
        p = np.full(k, lam)
        p[-1] = 0
        return b - np.linalg.solve(h + np.diag(p + jitter), slope + p * b)
    b, r, scale = b.copy(), slope.copy(), (np.diag(h) + jitter).tolist()
    for _ in range(200):
        for _ in range(sweeps):
            for j in range(k):
                x = b[j]
                u = x * scale[j] - r[j]
                new = u / scale[j] if j == k - 1 else (u - lam) / scale[j] if u > lam else (u + lam) / scale[j] if u < -lam else 0.0
                if new != x:
                    r += h[j] * (new - x)
                    b[j] = new
        for _ in range(k):
            act = np.append(np.flatnonzero(b[:-1]), k - 1)
            sign = np.append(np.sign(b[act[:-1]]), 0)
            step = -np.linalg.solve(h[np.ix_(act, act)] + jitter * np.eye(len(act)), r[act] + lam * sign)
            crossing = sign * (b[act] + step) < 0
            reach = np.where(crossing, -b[act] / np.where(crossing, step, 1), np.inf)
            far = min(1.0, reach.min(initial=np.inf))
            new = b[act] + far * step
            new[reach <= far] = 0.0
            r += h[:, act] @ (new - b[act])
            b[act] = new
            if far == 1:
                break
        if _off(b, r, lam, True) <= tolerance:
            break
    return b


def _sums(points: np.ndarray, size: int, weigh: Callable, own: dict[int, list[int]], names: list[int]):
    """Tasks of (cell, sums, gram): the loss and slope of each point (a column each), and for the cells of `own` the products of these features at its odds. `weigh` gives the weights of a
    batch as (positive, negative), a column for each cell."""

    def run(batches):
        m, seen = points.shape[1], False
        out, grams = np.zeros((m, size + 2)), {i: np.zeros((len(c), len(c))) for i, c in own.items()}
        for batch in batches:
            seen = True
            x = np.ones((batch.num_rows, size + 1))
            x[:, :size] = bits_of(batch, size)
            up, down = weigh(batch)
            every = up + down
            z = x @ points
            e = np.exp(-np.abs(z))
            p = np.where(z >= 0, 1.0, e) / (1 + e)
            out[:, 0] += (every * (np.maximum(z, 0) + np.log1p(e)) - up * z).sum(0)
            out[:, 1:] += ((every * p - up).T @ x)
            for i, c in own.items():
                some = x[:, c]
                grams[i] += (some * (every * p * (1 - p))[:, i : i + 1]).T @ some
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([x.tobytes() for x in out]), pa.array([grams[i].tobytes() if i in own else None for i in range(m)], pa.binary())], ["cell", "sums", "gram"])

    return run


def _added(column) -> np.ndarray:
    return sum(np.frombuffer(x) for x in column)


def _solver(now: dict[int, _State], cells: list[Cell], places: list[list[int]], share: list[float], tolerance: list[float], curve):
    """The next state of a cell from the sums of all tasks."""

    def solved(parts: pd.DataFrame) -> pd.DataFrame:
        i = int(parts["cell"].iloc[0])
        s, c, place = now[i], cells[i], places[i]
        got, lam = _added(parts["sums"]), 1 / c.c
        slope = got[1:][place]
        loss = got[0] + lam * (np.abs(s.at[:-1]).sum() if c.l1 else 0.5 * (s.at[:-1] @ s.at[:-1]))
        if s.good is not None and loss > s.loss + 1e-12 * abs(s.loss):
            at, good, loss, slope, off, own = (s.good + s.at) / 2, s.good, s.loss, s.slope, s.off, s.own
            done = np.abs(at - good).max() < 1e-13
        else:
            good, off = s.at, _off(s.at, slope, lam, c.l1)
            done, own = off <= tolerance[i], s.own or off > 0.2 * s.off
            h = share[i] * curve.value[np.ix_(place, place)] if parts["gram"].isna().any() else _added(parts["gram"]).reshape(len(place), -1)
            at = good if done else quadratic(h, slope, good, lam, c.l1, max(0.05 * off, 0.3 * tolerance[i]))
        return pd.DataFrame({"cell": [i], "at": [at.tobytes()], "good": [good.tobytes()], "loss": [loss], "slope": [slope.tobytes()], "off": [off], "own": [bool(own)], "done": [bool(done)]})

    return solved


def descend(table: DataFrame, size: int, cells: list[Cell], weigh: Callable, products: np.ndarray, share: list[float], tolerance: list[float], start: np.ndarray | None = None) -> list[np.ndarray]:
    """The optimum of each cell: coefficients of all features, then the intercept. `weigh(cells)` gives the weights of a batch for these cells (see _sums), share[i] of the products is the
    curvature of cell i, tolerance[i] by how much it may miss the optimum."""
    spark = table.sparkSession
    curve = spark.sparkContext.broadcast(products)
    places = [[*c.keep, size] for c in cells]
    state = {i: _State(np.zeros(len(p)) if start is None else start[p]) for i, p in enumerate(places)}
    width = tasks(spark, 1 << 30, most=1 << 30)
    for _ in range(ROUNDS):
        names = [i for i, s in state.items() if not s.done]
        if not names:
            break
        points = np.zeros((size + 1, len(names)))
        for j, i in enumerate(names):
            points[places[i], j] = state[i].at
        slow = sorted((i for i in names if state[i].own), key=lambda i: -state[i].off)[:OWN]
        run = _sums(points, size, weigh(names), {names.index(i): places[i] for i in slow}, names)
        solved = _solver({i: state[i] for i in names}, cells, places, share, tolerance, curve)
        parts = table.mapInArrow(run, "cell int, sums binary, gram binary").repartition(min(width, len(names)), "cell")
        for r in parts.groupBy("cell").applyInPandas(solved, "cell int, at binary, good binary, loss double, slope binary, off double, own boolean, done boolean").collect():  # a row for each cell
            at, good, slope = (np.frombuffer(r[x]) for x in ("at", "good", "slope"))
            state[r["cell"]] = _State(at, good, r["loss"], slope, r["off"], r["own"], r["done"])
    curve.unpersist()
    out = []
    for i, place in enumerate(places):
        b = np.zeros(size + 1)
        b[place] = state[i].at if state[i].good is None else state[i].good
        out.append(b)
    return out


def curvature(table: DataFrame, size: int, weigh: Callable, point: np.ndarray) -> np.ndarray:
    """The products of all features and the intercept at the odds of a model of all features."""
    run = _sums(point[:, None], size, weigh([0]), {0: list(range(size + 1))}, [0])
    add = lambda parts: pd.DataFrame({"gram": [_added(parts["gram"]).tobytes()]})
    got = table.mapInArrow(run, "cell int, sums binary, gram binary").groupBy("cell").applyInPandas(add, "gram binary").first()
    return np.frombuffer(got["gram"]).reshape(size + 1, size + 1) if got else np.zeros((size + 1, size + 1))


def fitted(p: Patterns, cells: list[Cell]) -> list[np.ndarray]:
    """The coefficients of all features, then the intercept, of each cell, with balanced weights and penalty |b| / c or b b / 2c; the intercept isn't penalised. Without cases of both classes or
    features a model is the base rate."""
    out: list[np.ndarray | None] = [None] * len(cells)
    sizes = [p.classes(c.without) for c in cells]
    for i, (n0, n1) in enumerate(sizes):
        if not (n0 and n1 and cells[i].keep):
            out[i] = np.zeros(p.size + 1)
            rate = (n1 + 1) / (n0 + n1 + 2)
            out[i][-1] = np.log(rate / (1 - rate))
    left = [i for i, x in enumerate(out) if x is None]
    if not left:
        return out
    half = np.array([[(n0 + n1) / (2 * n1), (n0 + n1) / (2 * n0)] for n0, n1 in (sizes[i] for i in left)])
    without = np.array([-2 if cells[i].without is None else cells[i].without for i in left])

    def weigh(names: list[int]):
        up, down, out_of = half[names, 0], half[names, 1], without[names]

        def run(batch):
            n, pos, fold = (np.asarray(batch.column(c)) for c in ("n", "pos", "fold"))
            on = fold[:, None] != out_of
            return on * (pos[:, None] * up), on * ((n - pos)[:, None] * down)

        return run

    total, size = [sum(sizes[i]) for i in left], sum(p.classes())
    # An L1 fit tells coefficients from zero to a hundredth of its penalty; otherwise points are within 1e-6 of their standard error.
    tolerance = [max(1e-10 * n, min(1e-4 * n**0.5, 0.01 / cells[i].c)) if cells[i].l1 else max(1e-10 * n, 1e-6 * n**0.5) for n, i in zip(total, left, strict=True)]
    got = descend(p.table, p.size, [cells[i] for i in left], weigh, p.products(), [n / size for n in total], tolerance)
    for i, b in zip(left, got, strict=True):
        out[i] = b
    return out


def ranking(p: Patterns, models: list[np.ndarray], within: list[int | None]) -> list[tuple[float, float]]:
    """(average precision, AUC) of each model (coefficients of all features, then the intercept) on the cases of one fold, or of all. Margins that agree on ten digits tie.

    Margins are dealt to ranges; counts of the ranges come first, so that each can be ranked in a task of its own."""
    size, m, ranges = p.size, len(models), max(1, -(-p.rows // RANKED))
    points, only = np.stack(models, 1), np.array([-2 if w is None else w for w in within])
    table = p.table.select("fold", "bits", "n", "pos")

    def scored(batch):
        x = np.ones((batch.num_rows, size + 1))
        x[:, :size] = bits_of(batch, size)
        fold, n, pos = (np.asarray(batch.column(c)) for c in ("fold", "n", "pos"))
        return np.round(x @ points, 10), fold[:, None] == np.where(only == -2, fold[:, None], only), n, pos

    def edged(batches):
        """The mean of each batch's quantiles: bounds need to be fair only."""
        total, seen = np.zeros((m, ranges - 1)), np.zeros((m, 1))
        for batch in batches:
            z, on, _, _ = scored(batch)
            for j in range(m):
                some = np.sort(z[on[:, j], j])
                if len(some):
                    total[j] += some[(np.arange(1, ranges) * len(some)) // ranges]
                    seen[j] += 1
        yield pa.RecordBatch.from_arrays([pa.array([np.hstack([total, seen]).tobytes()])], ["x"])

    edges = np.zeros((m, 0))
    if ranges > 1:
        got = sum(np.frombuffer(r["x"]) for r in table.mapInArrow(edged, "x binary").collect()).reshape(m, ranges)  # a row for each task
        edges = np.sort(got[:, :-1] / np.maximum(got[:, -1:], 1), axis=1)

    def counted(batches):
        out = np.zeros((m, ranges, 2), np.int64)
        for batch in batches:
            z, on, n, pos = scored(batch)
            for j in range(m):
                at = np.searchsorted(edges[j], z[:, j], "left")[on[:, j]]
                out[j, :, 0] += np.bincount(at, n[on[:, j]], ranges).astype(np.int64)
                out[j, :, 1] += np.bincount(at, pos[on[:, j]], ranges).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()])], ["x"])

    sums = sum((np.frombuffer(r["x"], np.int64) for r in table.mapInArrow(counted, "x binary").collect()), np.zeros(m * ranges * 2, np.int64)).reshape(m, ranges, 2)
    below = np.cumsum(sums, 1) - sums
    above = sums.sum(1, keepdims=True) - below - sums

    def dealt(batches):
        for batch in batches:
            z, on, n, pos = scored(batch)
            names, blobs = [], []
            for j in range(m):
                some = np.flatnonzero(on[:, j])
                some = some[np.argsort(z[some, j])]
                if len(some):
                    own = z[some, j]
                    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                    rows = np.rec.fromarrays([own[first], np.add.reduceat(n[some], first), np.add.reduceat(pos[some], first)], dtype=_RANKED)
                    ends = [0, *np.searchsorted(rows["z"], edges[j], "right"), len(rows)]
                    for i in range(ranges):
                        if ends[i] < ends[i + 1]:
                            names.append((j, i))
                            blobs.append(rows[ends[i] : ends[i + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in names], pa.int32()), pa.array([x for _, x in names], pa.int32()), pa.array(blobs, pa.binary())], ["model", "range", "x"])

    def ranked(parts: pd.DataFrame) -> pd.DataFrame:
        j, i = int(parts["model"].iloc[0]), int(parts["range"].iloc[0])
        rows = np.concatenate([np.frombuffer(x, _RANKED) for x in parts["x"]])
        rows = rows[np.argsort(rows["z"], kind="stable")]
        first = np.flatnonzero(np.append(True, rows["z"][1:] != rows["z"][:-1]))
        n, pos = (np.add.reduceat(rows[c], first) for c in ("n", "pos"))
        under = below[j, i, 0] + np.cumsum(n) - n
        seen, hit = (above[j, i, c] + x[::-1].cumsum()[::-1] for c, x in ((0, n), (1, pos)))
        return pd.DataFrame({"model": [j], "precision": [float((pos * (hit / seen)).sum())], "rank": [float((pos * (under + (n + 1) / 2)).sum())]})

    rows = table.mapInArrow(dealt, "model int, range int, x binary").repartition(tasks(p.spark, p.rows * m), "model", "range").groupBy("model", "range").applyInPandas(ranked, "model int, precision double, rank double")
    got = {r["model"]: (r["p"], r["r"]) for r in rows.groupBy("model").agg(F.sum("precision").alias("p"), F.sum("rank").alias("r")).collect()}
    out = []
    for j in range(m):
        n, pos = (int(x) for x in sums[j].sum(0))
        precision, rank = got.get(j, (0.0, 0.0))
        out.append((precision / pos if pos else 0.0, (rank - pos * (pos + 1) / 2) / (pos * (n - pos)) if pos and n > pos else 0.0))
    return out


_RANKED = np.dtype([("z", "<f8"), ("n", "<i8"), ("pos", "<i8")])
