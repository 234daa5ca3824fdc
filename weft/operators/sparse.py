"""Sparse graph algebra: matrices are (i, j, v), edges (src, dst), features (node, dim, val)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.sources.storage import columns_of, settle

#: Entries of a matrix that may be sent to every task (16 bytes each), and numbers that a task works on at a time.
MOST_HELD, AT_ONCE = 3_000_000, 4_000_000
#: Numbers of a product that are summed up at a time.
IN_CACHE = 16_384
#: How many times as many rows are taken where full powers are made: a row's place is looked up for all of them.
POWERS_ROWS = 4


#: Entries of personalised PageRank under it are left out.
PPR_FLOOR = 1e-4


class Matrix:
    """A square sparse matrix in memory: columns by falling number of entries, the first entries of all columns, the second ones, and so on; columns of many entries on their own."""

    def __init__(self, ids: np.ndarray, i: np.ndarray, j: np.ndarray, v: np.ndarray, many: int = 64) -> None:
        order = np.argsort(j, kind="stable")
        i, j, v = i[order], j[order], v[order]
        columns, starts, counts = np.unique(j, return_index=True, return_counts=True)
        self.ids, self.entries = ids, len(v)
        self.wide = [(c, i[s : s + n], v[s : s + n]) for c, s, n in zip(columns, starts, counts, strict=True) if n > many]
        rest = counts <= many
        columns, starts, counts = columns[rest], starts[rest], counts[rest]
        order = np.argsort(-counts, kind="stable")
        self.columns, starts, counts = columns[order], starts[order], counts[order]
        nth = [starts[: np.searchsorted(-counts, -k, side="left")] + k for k in range(int(counts.max(initial=0)))]
        self.layers = [(i[at], v[at][:, None]) for at in nth]
        self._sides: list[_Lists] = []

    def entries_of(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places and values of all entries, by column and row."""
        i, j, v = zip(*[(i, self.columns[: len(i)], v[:, 0]) for i, v in self.layers], *[(i, np.full(len(i), c), v) for c, i, v in self.wide], strict=True)
        i, j, v = np.concatenate(i), np.concatenate(j), np.concatenate(v)
        order = np.lexsort((i, j))
        return i[order], j[order], v[order]

    def returns(self, rows: np.ndarray, k: int) -> np.ndarray:
        """Diagonals of the first k powers at the given rows [rows, k]. Rows of a power meet columns of the same power or the one before in the entries that both have; where these fill up, rows of all powers are made in full."""
        if not self._sides:  # made where it is needed, not sent
            i, j, v = self.entries_of()
            self._sides = [_Lists(i, j, v, len(self.ids)), _Lists(j, i, v, len(self.ids))]
        n, out = len(self.ids), np.zeros((len(rows), k))
        own = np.arange(len(rows)) * n + rows
        ends = [(own, np.ones(len(rows)))] * 2
        for t in range(k):
            if (grown := self._sides[t % 2].step(*ends[t % 2], len(rows) * n)) is None:
                return np.stack([x[rows, np.arange(len(rows))] for _, x in zip(range(k), self.powers(rows))], 1)
            ends[t % 2] = grown
            (a, va), (b, vb) = ends
            at = np.minimum(np.searchsorted(a, b), len(a) - 1) if len(a) else np.zeros(0, int)
            both = a[at] == b if len(a) else np.zeros(len(b), bool)
            out[:, t] = np.bincount(b[both] // n, vb[both] * va[at[both]], len(rows))
        return out

    def powers(self, rows: np.ndarray) -> Iterator[np.ndarray]:
        """The first power, the second, ...: their given rows, transposed [n, rows]. Each one holds until the next but one is asked for."""
        x, out = np.zeros((2, len(self.ids), len(rows)))
        x[rows, np.arange(len(rows))] = 1.0
        self.times(x, out)
        x[rows] = 0.0  # what has no column is never written
        while True:
            yield out
            x, out = out, x
            self.times(x, out)

    def times(self, x: np.ndarray, out: np.ndarray) -> None:
        """The transposed matrix times x into out, whose rows without a column stay. A few columns' sums at a time, so that they, and what is added to them, stay in the cache."""
        size = max(1, IN_CACHE // max(1, x.shape[1]))
        sums, part = np.empty((2, size, x.shape[1]))
        for start in range(0, len(self.columns), size):
            width = min(size, len(self.columns) - start)
            for n, (i, v) in enumerate(self.layers):
                if (m := min(len(i) - start, width)) <= 0:
                    break
                to = part[:m] if n else sums[:m]
                np.take(x, i[start : start + m], axis=0, out=to, mode="clip")
                to *= v[start : start + m]
                if n:
                    sums[:m] += to
            out[self.columns[start : start + width]] = sums[:width]
        for c, i, v in self.wide:
            out[c] = v @ x[i]


class _Lists:
    """The entries of each row, end to end."""

    def __init__(self, i: np.ndarray, j: np.ndarray, v: np.ndarray, n: int) -> None:
        order = np.lexsort((j, i))
        self.n, self.j, self.v = n, j[order], v[order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(i, minlength=n))])

    def step(self, key: np.ndarray, value: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray] | None:
        """A few sparse rows times the matrix, row * n + column and value by rising key; None if that takes more than `most` products."""
        row, column = np.divmod(key, self.n)
        counts = self.starts[column + 1] - self.starts[column]
        ends = np.cumsum(counts)
        if not len(ends) or not ends[-1]:
            return key[:0], value[:0]
        if ends[-1] > most:
            return None
        at = np.repeat(self.starts[column] - ends + counts, counts) + np.arange(ends[-1])
        found, place = np.unique(np.repeat(row * self.n, counts) + self.j[at], return_inverse=True)
        return found, np.bincount(place, np.repeat(value, counts) * self.v[at], len(found))


class Held:
    """A matrix that every task holds, and work on it by rows."""

    def __init__(self, p: DataFrame, matrix: Matrix) -> None:
        self.spark, self.n, self.matrix = p.sparkSession, len(matrix.ids), matrix
        self.shared = self.spark.sparkContext.broadcast(matrix)
        self.rows = max(1, AT_ONCE // max(1, 4 * self.n))

    def by_rows(self, f: Callable[[Matrix, np.ndarray], pd.DataFrame], schema: str, times: int = 1) -> DataFrame:
        """f of the matrix and a few of its rows (or times as many) at a time, over all rows."""
        shared, n, size = self.shared, self.n, times * self.rows

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for start in batch["id"]:
                    yield f(shared.value, np.arange(start, min(n, start + size)))

        tasks = 4 * int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return self.spark.range(0, n, size, max(1, min(tasks, -(-n // size)))).mapInPandas(run, schema)


def held_matrix(p: DataFrame) -> Held | None:
    """p for every task, None without entries or beyond MOST_HELD of them."""
    if not 0 < p.count() <= MOST_HELD:
        return None
    found = p.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v")).toPandas().sort_values(["i", "j"])
    ids, at = np.unique(np.concatenate([found["i"], found["j"]]), return_inverse=True)
    return Held(p, Matrix(ids, at[: len(found)], at[len(found) :], found["v"].to_numpy()))


def transition(edges: DataFrame) -> DataFrame:
    """Row-stochastic matrix; repeated edges add up."""
    w = edges.groupBy("src", "dst").agg(F.count("*").alias("w"))
    out = w.groupBy("src").agg(F.sum("w").alias("d"))
    return w.join(out, "src").select(F.col("src").alias("i"), F.col("dst").alias("j"), (F.col("w") / F.col("d")).alias("v"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    right = b.select(F.col("i").alias("k"), F.col("j").alias("l"), F.col("v").alias("w"))
    return a.join(right, a["j"] == right["k"]).groupBy("i", F.col("l").alias("j")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def scaled(m: DataFrame, c: float) -> DataFrame:
    return m.select("i", "j", (F.col("v") * c).alias("v"))


def added(parts: list[DataFrame]) -> DataFrame:
    both = parts[0]
    for p in parts[1:]:
        both = both.unionAll(p)
    return both.groupBy("i", "j").agg(F.sum("v").alias("v"))


def diffusion(p: DataFrame, k: int = 4, r: float = 0.5) -> DataFrame:
    """Sum of r^n P^n for n = 1..k, without the diagonal. Each power is written before the next."""
    power, parts = p, [scaled(p, r)]
    for n in range(2, k + 1):
        power = settle(matmul(power, p), "power")
        parts.append(scaled(power, r**n))
    return added(parts).where("i <> j")


def ppr(p: DataFrame, alpha: float = 0.15, most: int = 30, tolerance: float = 1e-5, floor: float = PPR_FLOOR) -> DataFrame:
    """alpha times the sum of (1 - alpha)^n P^n; ends after a term whose entries are all below tolerance; no diagonal, and no entry under floor."""
    p = settle(p, "transition")
    if (held := held_matrix(p)) is not None:
        return _ppr_by_rows(held, alpha, most, tolerance, floor)
    first = alpha * (1 - alpha)  # the term n = 0 lies on the diagonal
    now = settle(p.select("i", "j", F.col("v").alias("power"), (F.col("v") * first).alias("total")), "ppr")
    right = p.select(F.col("i").alias("k"), F.col("j").alias("l"), "v")
    for n in range(2, most):
        # one shuffle and one write a term: the next power's products meet the sums so far
        c = alpha * (1 - alpha) ** n
        step = now.join(right, now["j"] == right["k"]).select("i", F.col("l").alias("j"), (F.col("power") * F.col("v")).alias("power"), F.lit(0.0).alias("total"))
        both = step.unionAll(now.select("i", "j", F.lit(0.0).alias("power"), "total")).groupBy("i", "j")
        now = settle(both.agg(F.sum("power").alias("power"), (F.sum("total") + F.sum("power") * c).alias("total")), "ppr")
        top = now.agg(F.max("power")).first()[0]
        if top is None or top * c < tolerance:
            break
    return now.where((F.col("i") != F.col("j")) & (F.col("total") >= floor) & (F.col("total") > 0)).select("i", "j", F.col("total").alias("v"))


def ppr_weights(held: Held, alpha: float = 0.15, most: int = 30, tolerance: float = 1e-5) -> list[float]:
    """Weights of the first power, the second, ... of personalised PageRank; the last term is found first."""
    weight = [alpha * (1 - alpha) ** n for n in range(most)]

    def largest(m: Matrix, rows: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"n": np.arange(1, most), "top": [x.max() for _, x in zip(range(1, most), m.powers(rows))]})

    last = max(1, most - 1)
    # the largest entry of a power is no larger than the last power's, so a few rows may show that no term is below tolerance
    if most > 3 and not (largest(held.matrix, np.arange(min(held.n, held.rows)))["top"].to_numpy()[: most - 2] * weight[1 : most - 1] >= tolerance)[-1]:
        tops = held.by_rows(largest, "n int, top double", POWERS_ROWS).groupBy("n").agg(F.max("top").alias("top")).where("n > 1").orderBy("n").collect()  # a row a term
        last = next((r["n"] for r in tops if r["top"] * weight[r["n"]] < tolerance), last)
    return weight[1 : last + 1]


def _sums(m: Matrix, rows: np.ndarray, weights: list[float]) -> np.ndarray:
    """Rows of the weighted sum of powers, transposed, without the diagonal."""
    total, part = np.zeros((2, len(m.ids), len(rows)))
    for w, x in zip(weights, m.powers(rows), strict=False):
        np.multiply(x, w, out=part)
        total += part
    total[rows, np.arange(len(rows))] = 0.0
    return total


def _ppr_by_rows(held: Held, alpha: float, most: int, tolerance: float, floor: float) -> DataFrame:
    """The same, a few rows of all powers at a time: neither powers nor sums are tables."""
    weights = ppr_weights(held, alpha, most, tolerance)

    def run(m: Matrix, rows: np.ndarray) -> pd.DataFrame:
        total = _sums(m, rows, weights)
        j, i = np.nonzero((total >= floor) & (total > 0))
        return pd.DataFrame({"i": m.ids[rows[i]], "j": m.ids[j], "v": total[j, i]})

    return held.by_rows(run, "i long, j long, v double", POWERS_ROWS)


def ppr_terms(p: DataFrame, terms: int, alpha: float = 0.15) -> DataFrame:
    return ppr(p, alpha, terms + 1, 0.0, 0.0)


def spmm(m: DataFrame, x: DataFrame) -> DataFrame:
    """M X for features x."""
    return m.join(x, m["j"] == x["node"]).groupBy(F.col("i").alias("node"), "dim").agg(F.sum(F.col("v") * F.col("val")).alias("val"))


def plus_diffused(x: DataFrame, m: DataFrame) -> DataFrame:
    """X + M X."""
    return x.select("node", "dim", "val").unionAll(spmm(m, x)).groupBy("node", "dim").agg(F.sum("val").alias("val"))


def plus_powers(x: DataFrame, p: DataFrame, weights: Callable[[Held], list[float]], floor: float | None = None) -> DataFrame | None:
    """X + M X for the weighted sum M of p's powers, without its diagonal and entries under floor, neither M nor its products being tables.

    With a floor a few rows of M at a time meet X in a task; without one X is multiplied by p again and again, a dim in a task, and the powers' diagonals are taken off.
    None where p (with a floor also x) is too large to be held by every task, or x hasn't all dims of all nodes.
    """
    if not 0 < x.count() <= (MOST_HELD if floor is not None else float("inf")) or (held := held_matrix(p)) is None:
        return None
    return _without_floor(x, held, weights(held)) if floor is None else _with_floor(x, held, weights(held), floor)


def _without_floor(x: DataFrame, held: Held, terms: list[float]) -> DataFrame | None:
    size = x.groupBy("dim").agg(F.count("*").alias("n")).agg(F.min("n").alias("low"), F.max("n").alias("high")).first()
    if size["low"] != size["high"] or size["high"] > MOST_HELD:
        return None
    nodes = np.sort(columns_of(x.select(F.col("node").cast("long").alias("node")).distinct(), "node")[0])
    if len(nodes) != size["high"] or not np.isin(held.matrix.ids, nodes).all():
        return None

    def taken(m: Matrix, rows: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"at": rows, "v": [[v] for v in m.returns(rows, len(terms)) @ np.array(terms)]})

    at, v = columns_of(held.by_rows(taken, "at long, v array<double>"), "at", "v")
    own, diagonal = np.searchsorted(nodes, held.matrix.ids), np.zeros(len(nodes))
    diagonal[own[at]] = v
    i, j, values = held.matrix.entries_of()
    order = np.lexsort((j, i))
    shared = held.spark.sparkContext.broadcast((nodes, own[i[order]], own[j[order]], values[order], diagonal))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        nodes, i, j, values, diagonal = shared.value
        column = np.zeros(len(nodes))
        column[np.searchsorted(nodes, part["node"].to_numpy())] = part["val"].to_numpy()
        total = np.zeros(len(nodes))
        for w in reversed(terms):
            total = np.bincount(i, values * (w * column + total)[j], len(nodes))
        return pd.DataFrame({"node": nodes, "dim": int(part["dim"].iloc[0]), "val": column + (total - diagonal * column)})

    return x.select(F.col("node").cast("long").alias("node"), F.col("dim").cast("long").alias("dim"), "val").groupBy("dim").applyInPandas(run, "node long, dim long, val double")


def _with_floor(x: DataFrame, held: Held, terms: list[float], floor: float) -> DataFrame | None:
    node, dim, val = columns_of(x.select(F.col("node").cast("long").alias("node"), F.col("dim").cast("long").alias("dim"), F.array("val").alias("val")), "node", "dim", "val")
    nodes, dims = np.unique(node), np.unique(dim)
    if len(node) != len(nodes) * len(dims) or not np.isin(held.matrix.ids, nodes).all():
        return None
    wide = np.zeros((len(nodes), len(dims)))
    wide[np.searchsorted(nodes, node), np.searchsorted(dims, dim)] = val
    own = np.searchsorted(nodes, held.matrix.ids)
    shared = x.sparkSession.sparkContext.broadcast(wide[own])

    def run(m: Matrix, rows: np.ndarray) -> pd.DataFrame:
        total = _sums(m, rows, terms)
        total[~((total >= floor) & (total > 0))] = 0.0
        out = shared.value[rows] + total.T @ shared.value
        return pd.DataFrame({"node": np.repeat(m.ids[rows], len(dims)), "dim": np.tile(dims, len(rows)), "val": out.ravel()})

    met = held.by_rows(run, "node long, dim long, val double", POWERS_ROWS)
    alone = np.setdiff1d(nodes, held.matrix.ids)
    if not len(alone):
        return met
    rest = x.sparkSession.createDataFrame([(int(n),) for n in alone], "node long")  # nodes without edges
    return met.unionAll(x.join(F.broadcast(rest), "node", "left_semi").select("node", F.col("dim").cast("long"), "val"))


def neighbour_sums(edges: DataFrame, x: DataFrame, own: float = 1.0) -> DataFrame:
    """node, dim, val: own times each node's features plus the sum of its neighbours'. The aggregate of a sum-pooling layer."""
    met = edges.join(x, edges["dst"] == x["node"]).select(F.col("src").alias("node"), "dim", "val")
    return met.unionAll(x.select("node", "dim", (F.col("val") * own).alias("val"))).groupBy("node", "dim").agg(F.sum("val").alias("val"))


def neighbour_means(edges: DataFrame, x: DataFrame) -> DataFrame:
    """node, dim, val: the mean of the neighbours' features, none without neighbours. The aggregate of a mean-pooling layer."""
    return edges.join(x, edges["dst"] == x["node"]).groupBy(F.col("src").alias("node"), "dim").agg(F.avg("val").alias("val"))


def symmetric_pairs(edges: DataFrame) -> DataFrame:
    """src, dst: both directions, each once."""
    return edges.select("src", "dst").unionAll(edges.select("dst", "src")).distinct()


def normalised_adjacency(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """D^-1/2 (A + I) D^-1/2 of the symmetric 0/1 adjacency; nodes: node."""
    loops = nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"))
    a = symmetric_pairs(edges).unionAll(loops).groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    d = a.groupBy("src").agg(F.sum("w").alias("d"))
    ds = d.select("src", F.col("d").alias("di"))
    dd = d.select(F.col("src").alias("dst"), F.col("d").alias("dj"))
    return a.join(ds, "src").join(dd, "dst").select(F.col("src").alias("i"), F.col("dst").alias("j"), (F.col("w") / F.sqrt(F.col("di") * F.col("dj"))).alias("v"))


def laplacian(edges: DataFrame) -> DataFrame:
    """D - (A + A') / 2, diagonal included."""
    half = edges.select("src", "dst").unionAll(edges.select("dst", "src")).groupBy("src", "dst").agg((F.count("*") / 2).alias("w"))
    degree = half.groupBy("src").agg(F.sum("w").alias("v")).select(F.col("src").alias("i"), F.col("src").alias("j"), "v")
    return added([degree, half.select(F.col("src").alias("i"), F.col("dst").alias("j"), (-F.col("w")).alias("v"))])


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def homophily(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: the share of edges between training nodes whose labels agree, 0.5 without such edges."""
    train = nodes.where("split = 'train'").select("node", "y")
    a, b = train.toDF("src", "ya"), train.toDF("dst", "yb")
    return edges.join(a, "src").join(b, "dst").agg(F.coalesce(F.avg((F.col("ya") == F.col("yb")).cast("double")), F.lit(0.5)).alias("homophily"))


def _across(edges: DataFrame, phi: DataFrame) -> DataFrame:
    """src, dst, dim, difference of features over edges."""
    a, b = phi.toDF("src", "dim", "va"), phi.toDF("dst", "dim", "vb")
    return edges.join(a, "src").join(b, ["dst", "dim"]).select("src", "dst", "dim", (F.col("va") - F.col("vb")).alias("diff"))


def smoothness(phi: DataFrame, edges: DataFrame) -> DataFrame:
    """dim, smoothness: phi' L phi / phi' phi over the largest diagonal entry of L, within 0 and 1; 0 for a tiny phi."""
    half = edges.select("src", "dst").unionAll(edges.select("dst", "src")).groupBy("src", "dst").agg((F.count("*") / 2).alias("w"))
    top = half.groupBy("src").agg(F.sum("w").alias("d")).agg(F.greatest(F.max("d"), F.lit(1e-12)).alias("top"))
    form = _across(half, phi).join(half, ["src", "dst"]).groupBy("dim").agg((F.sum(F.col("w") * F.col("diff") * F.col("diff")) / 2).alias("form"))
    norm = phi.groupBy("dim").agg(F.sum(F.col("val") * F.col("val")).alias("norm"))
    ratio = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("form", F.lit(0.0)) / F.nullif(F.col("norm"), F.lit(0.0)) / F.col("top")))
    return norm.join(form, "dim", "left").crossJoin(F.broadcast(top)).select("dim", F.when(F.col("norm") < 1e-10, 0.0).otherwise(F.coalesce(ratio, F.lit(0.0))).alias("smoothness"))


def neighbour_consistency(phi: DataFrame, edges: DataFrame) -> DataFrame:
    """dim, consistency: half the mean absolute difference over edges; 0.5 without edges."""
    found = _across(edges, phi).groupBy("dim").agg((F.avg(F.abs("diff")) / 2).alias("c"))
    return phi.select("dim").distinct().join(found, "dim", "left").select("dim", F.coalesce("c", F.lit(0.5)).alias("consistency"))


def guided(acc, smooth, consistency, h: float, gamma: float, weight: float):
    """Accuracy, less roughness on homophilous graphs (more on others), plus consistency as the homophily h asks for it."""
    return acc - gamma * (2 * h - 1) * smooth + weight * (h * (1 - consistency) + (1 - h) * consistency)
