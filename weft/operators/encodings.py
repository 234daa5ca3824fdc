"""Structural encodings of nodes and of labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.scaling import angular, minmax, robust_tanh
from weft.sources.storage import settle, shuffled

from .sparse import Held, Matrix, held_matrix, laplacian, matmul, normalised_adjacency, plus_diffused, spmm, symmetric_pairs

#: Nodes up to which all eigenpairs are computed at once, and entries up to which a matrix may come to the driver.
MOST_DENSE = 2000
MOST_ENTRIES = 10_000_000
#: Growth of the least eigenvector in a filter, and products in a filter.
MOST_GROWN, MOST_FILTER = 1e6, 200


def random_walk(p: DataFrame, nodes: DataFrame, k: int = 8) -> DataFrame:
    """node, dim, val: 2 s - 1 for the return probabilities s after 1..k steps."""
    p = settle(p, "transition")
    if (held := held_matrix(p)) is not None:
        diagonal = _returns(held, k)
    else:
        power, parts = p, []
        for n in range(1, k + 1):
            if n > 1:
                power = settle(matmul(power, p), "power")
            parts.append(power.where("i = j").select(F.col("i").alias("node"), F.lit(n - 1).alias("dim"), "v"))
        diagonal = parts[0]
        for part in parts[1:]:
            diagonal = diagonal.unionAll(part)
    every = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("dim"))
    return every.join(diagonal, ["node", "dim"], "left").select("node", "dim", (2 * F.coalesce("v", F.lit(0.0)) - 1).alias("val"))


def _returns(held: Held, k: int) -> DataFrame:
    """node, dim, v: the diagonals of the first k powers, a few rows at a time; powers are never tables."""

    def run(m: Matrix, rows: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"node": np.repeat(m.ids[rows], k), "dim": np.tile(np.arange(k, dtype="int32"), len(rows)), "v": m.returns(rows, k).ravel()})

    return held.by_rows(run, "node long, dim int, v double")


def _entries(matrix: DataFrame, nodes: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids of the nodes, and the places and values of the symmetric part of the matrix: 24 bytes an entry."""
    if matrix.count() > MOST_ENTRIES:
        raise ValueError(f"more than {MOST_ENTRIES} entries: use iterated()")
    ids = np.sort(nodes.select(F.col("node").cast("long").alias("node")).toPandas()["node"].to_numpy())
    found = matrix.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v")).toPandas()
    i, j, v = np.searchsorted(ids, found["i"].to_numpy()), np.searchsorted(ids, found["j"].to_numpy()), found["v"].to_numpy()
    return ids, np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([v, v]) / 2


def least_eigenpairs(n: int, i: np.ndarray, j: np.ndarray, v: np.ndarray, k: int, tolerance: float = 1e-10, most_rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """The k least eigenvalues and their vectors of a sparse symmetric matrix, by subspace iteration with Chebyshev filters; repeated values are kept, as the subspace is a block.

    Ends when every residual is below tolerance times the bound of the spectrum, and raises if it doesn't get there.
    """
    place, at = np.unique(i * n + j, return_inverse=True)  # both directions of an entry are one
    (i, j), v = np.divmod(place, n), np.bincount(at, v, len(place))
    top = float(np.bincount(i, np.abs(v), n).max(initial=0.0))  # no eigenvalue lies beyond it
    matrix = Matrix(np.arange(n), i, j, v)

    def times(x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        matrix.times(x, out)
        return out

    x = np.linalg.qr(np.random.default_rng(42).normal(size=(n, min(n, 2 * k + 8))))[0]
    for _ in range(most_rounds):
        y = times(x)
        values, turn = np.linalg.eigh((x.T @ y + y.T @ x) / 2)
        x, y = x @ turn, y @ turn
        if top == 0 or np.linalg.norm(y[:, :k] - x[:, :k] * values[:k], axis=0).max() <= tolerance * top:
            return values[:k], x[:, :k]
        # damp what lies between the largest value held and the top
        low = max(values[-1], 1e-6 * top)
        middle, half = (top + low) / 2, (top - low) / 2
        if half <= 0:
            raise ValueError("no gap to filter")
        before, now = x, (times(x) - middle * x) / half
        # as long a filter as the vectors stay apart with: the least one grows by MOST_GROWN
        for _ in range(int(np.clip(np.arccosh(MOST_GROWN) / np.arccosh(1 + (low - min(values[0], 0.0)) / half), 20, MOST_FILTER)) - 1):
            next_ = times(now)
            next_ -= middle * now
            next_ *= 2 / half
            next_ -= before
            before, now = now, next_
        x = np.linalg.qr(now)[0]
    raise ValueError(f"eigenpairs did not settle in {most_rounds} rounds")


def eigenpairs(edges: DataFrame, nodes: DataFrame, k: int, *, normalised: bool = False) -> tuple[DataFrame, np.ndarray]:
    """(node, dim, val) of the eigenvectors 1..k of the Laplacian, the constant one left out, and their eigenvalues. Bounded by MOST_ENTRIES of the matrix, beyond MOST_DENSE nodes by iteration."""
    if normalised:
        pairs = symmetric_pairs(edges)
        d = pairs.groupBy("src").agg(F.count("*").alias("d"))
        off = pairs.join(d, "src").join(d.toDF("dst", "e"), "dst").select(F.col("src").alias("i"), F.col("dst").alias("j"), (-1 / F.sqrt(F.col("d") * F.col("e"))).alias("v"))
        matrix = off.unionAll(nodes.select(F.col("node").alias("i"), F.col("node").alias("j"), F.lit(1.0).alias("v")))
    else:
        matrix = laplacian(edges)
    ids, i, j, v = _entries(settle(matrix, "laplacian"), nodes)
    k = min(k, len(ids) - 1)
    if len(ids) <= MOST_DENSE:
        m = np.zeros((len(ids), len(ids)))
        np.add.at(m, (i, j), v)
        values, vectors = np.linalg.eigh(m)
    else:
        values, vectors = least_eigenpairs(len(ids), i, j, v, k + 1)
    out = pd.DataFrame({"node": np.repeat(ids, k), "dim": np.tile(np.arange(k), len(ids)), "val": vectors[:, 1 : k + 1].ravel()})
    return nodes.sparkSession.createDataFrame(out, "node long, dim int, val double"), values[1 : k + 1]


def iterated(edges: DataFrame, nodes: DataFrame, k: int, rounds: int = 30) -> DataFrame:
    """The same of any number of nodes: subspace iteration on (I + normalised adjacency), with only k x k sums on the driver.

    The self-loops of the adjacency shift its spectrum; the subspace is that of the smoothest k vectors after the first.
    """
    a = settle(normalised_adjacency(edges, nodes), "adjacency")
    q = k + 1
    x = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(q - 1))).alias("dim")).withColumn("val", F.pmod(F.xxhash64("node", "dim"), F.lit(1 << 20)) / float(1 << 20) - 0.5)
    for n in range(rounds):
        x = x.unionAll(spmm(a, x)).groupBy("node", "dim").agg(F.sum("val").alias("val"))
        if n % 3 == 2 or n == rounds - 1:
            x = settle(x, "subspace")
            other = x.toDF("node", "e", "w")
            gram = np.zeros((q, q))
            for r in x.join(other, "node").groupBy("dim", "e").agg(F.sum(F.col("val") * F.col("w")).alias("g")).collect():  # q x q
                gram[r["dim"], r["e"]] = r["g"]
            values, basis = np.linalg.eigh(gram)
            turn = basis[:, ::-1] / np.sqrt(np.maximum(values[::-1], 1e-300))
            mix = x.sparkSession.createDataFrame([(int(i), int(j), float(turn[i, j])) for i in range(q) for j in range(q)], "dim int, e int, t double")
            x = settle(x.join(F.broadcast(mix), "dim").groupBy("node", F.col("e").alias("dim")).agg(F.sum(F.col("val") * F.col("t")).alias("val")), "subspace")
    return x.where("dim > 0").select("node", (F.col("dim") - 1).alias("dim"), "val")


def laplacian_encoding(edges: DataFrame, nodes: DataFrame, k: int = 8, *, normalised: bool = True) -> DataFrame:
    """2 phi^2 - 1 of the eigenvectors 1..k."""
    return eigenpairs(edges, nodes, k, normalised=normalised)[0].withColumn("val", 2 * F.col("val") * F.col("val") - 1)


def heat_kernel(vectors: DataFrame, values: np.ndarray, times: int = 6) -> DataFrame:
    """Heat kernel signatures at log-spaced times between 4 / the largest and 4 / the least positive eigenvalue, on -1..1 by column."""
    spark, positive = vectors.sparkSession, values[values > 1e-10]
    if not len(positive):
        raise ValueError("no positive eigenvalue")
    grid = np.exp(np.linspace(np.log(4 / positive.max()), np.log(4 / positive.min()), times))
    weights = spark.createDataFrame([(int(d), t, float(np.exp(-v * x))) for d, v in enumerate(values) for t, x in enumerate(grid)], "dim int, t int, w double")
    hks = vectors.join(F.broadcast(weights), "dim").groupBy("node", F.col("t").alias("dim")).agg(F.sum(F.col("w") * F.col("val") * F.col("val")).alias("val"))
    return minmax(hks)


def triangles(edges: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys), a < b < c of canonical edges (keys, u < v)."""
    ab = edges.select(*keys, F.col("u").alias("a"), F.col("v").alias("b"))
    bc = edges.select(*keys, F.col("u").alias("b"), F.col("v").alias("c"))
    ac = edges.select(*keys, F.col("u").alias("a"), F.col("v").alias("c"))
    return ab.join(shuffled(bc), [*keys, "b"]).join(shuffled(ac), [*keys, "a", "c"]).select(*keys, "a", "b", "c")


def degree_clustering(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, degree, compat, clustering on -1..1: degree over the largest; 1 / (degree - 1), as the diagonal of A^2 gives; and the share of closed pairs of neighbours."""
    pairs = symmetric_pairs(edges).where("src <> dst")
    d = pairs.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d"))
    top = d.agg(F.max("d").alias("top"))
    corners = triangles(pairs.where("src < dst").toDF("u", "v")).select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count("*").alias("t"))
    joined = nodes.select("node").join(d, "node", "left").join(corners, "node", "left").na.fill(0, ["d", "t"]).crossJoin(F.broadcast(top))
    scaled = lambda x: 2 * x - 1
    return joined.select(
        "node",
        scaled(F.coalesce(F.col("d") / F.col("top"), F.lit(0.0))).alias("degree"),
        scaled(F.when(F.col("d") > 1, 1 / (F.col("d") - 1)).otherwise(0.0)).alias("compat"),
        scaled(F.when(F.col("d") > 1, 2 * F.col("t") / (F.col("d") * (F.col("d") - 1))).otherwise(0.0)).alias("clustering"),
    )


def layered_angles(x: DataFrame, m: DataFrame, train: DataFrame, layers: int = 2, residual: float = 0.5) -> list[DataFrame]:
    """Angles of x, then layer by layer: the diffused angles blended with the first ones, scaled and made angles again."""
    first = settle(angular(robust_tanh(x, train)), "angles")
    out = [first]
    for _ in range(layers):
        part = lambda d, c: d.select("node", "dim", (F.col("val") * c).alias("val"))
        blend = part(spmm(m, out[-1]), residual).unionAll(part(first, 1 - residual)).groupBy("node", "dim").agg(F.sum("val").alias("val"))
        out.append(settle(angular(robust_tanh(blend, train)), "angles"))
    return out


def diffused_angles(x: DataFrame, m: DataFrame, train: DataFrame) -> DataFrame:
    """Angles plus their diffusion."""
    return plus_diffused(angular(robust_tanh(x, train)), m)


def label_frequencies(nodes: DataFrame) -> DataFrame:
    """label, n, share."""
    n = nodes.where("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).select("label", "n", (F.col("n") / F.col("total")).alias("share"))


def label_cooccurrence(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """la, lb, n: how often labels meet over edges, in both directions; an edge within a label counts twice."""
    a, b = nodes.select("graph_id", F.col("node_id").alias("u"), F.col("label").alias("la")), nodes.select("graph_id", F.col("node_id").alias("v"), F.col("label").alias("lb"))
    met = edges.join(a, ["graph_id", "u"]).join(b, ["graph_id", "v"])
    return met.select("la", "lb").unionAll(met.select("lb", "la")).groupBy("la", "lb").agg(F.count("*").alias("n"))


def label_embedding(cooccurrence: DataFrame, dims: int = 2) -> np.ndarray:
    """[labels, dims]: eigenvectors 1..dims of the normalised Laplacian of the labels' meetings, filled with zeros. One row a label."""
    rows = cooccurrence.collect()  # a row a pair of labels
    if not rows:
        return np.zeros((1, dims))
    n = 1 + max(max(r["la"], r["lb"]) for r in rows)
    w = np.zeros((n, n))
    for r in rows:
        w[r["la"], r["lb"]] = r["n"]
    d = w.sum(1)
    root = 1 / np.sqrt(np.where(d < 1e-10, 1.0, d))
    vectors = np.linalg.eigh(np.eye(n) - root[:, None] * w * root)[1][:, 1 : dims + 1]
    return np.pad(vectors, ((0, 0), (0, dims - vectors.shape[1])))


#: Electronegativities by the elements' symbols; others count 2.55.
ELECTRONEGATIVITY = {"H": 2.20, "C": 2.55, "N": 3.04, "O": 3.44, "F": 3.98, "P": 2.19, "S": 2.58, "Cl": 3.16, "Br": 2.96, "I": 2.66}


def node_weights(nodes: DataFrame, mode: str, elements: dict[int, str] | None = None) -> DataFrame:
    """graph_id, node_id, weight by mode: rarity, feat_norm, label_index or electronegativity."""
    if mode == "rarity":
        weighted = nodes.join(F.broadcast(label_frequencies(nodes)), "label", "left").withColumn("weight", F.coalesce(F.log(1 / F.col("share")) + 1, F.lit(1.0)))
    elif mode == "feat_norm":
        weighted = nodes.withColumn("weight", F.sqrt(F.aggregate("feat", F.lit(0.0), lambda s, v: s + v * v)) + 1e-6)
    elif mode == "label_index":
        weighted = nodes.withColumn("weight", F.coalesce(F.col("label"), F.lit(0)) + F.lit(1.0))
    elif mode == "electronegativity":
        value = F.lit(2.55)
        for label, symbol in (elements or {}).items():
            value = F.when(F.col("label") == label, ELECTRONEGATIVITY.get(symbol, 2.55)).otherwise(value)
        weighted = nodes.withColumn("weight", value)
    else:
        raise ValueError(f"unknown weighting: {mode}")
    return weighted.select("graph_id", "node_id", "weight")


def edge_weights(nodes: DataFrame, edges: DataFrame, embedding: np.ndarray) -> DataFrame:
    """graph_id, u, v, weight: 1 + the distance of the ends' labels in the embedding. Missing labels count as 0, high ones as the last."""
    n = len(embedding)
    table = nodes.sparkSession.createDataFrame([(i, j, float(1 + np.linalg.norm(embedding[i] - embedding[j]))) for i in range(n) for j in range(n)], "la long, lb long, weight double")
    label = F.least(F.coalesce(F.col("label"), F.lit(0)), F.lit(n - 1)).cast("long")
    a, b = nodes.select("graph_id", F.col("node_id").alias("u"), label.alias("la")), nodes.select("graph_id", F.col("node_id").alias("v"), label.alias("lb"))
    return edges.join(a, ["graph_id", "u"]).join(b, ["graph_id", "v"]).join(F.broadcast(table), ["la", "lb"]).select("graph_id", "u", "v", "weight")
