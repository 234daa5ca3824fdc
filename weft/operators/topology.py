"""Topology of graph collections: edges (graph_id, u < v), values on edges, filtrations, Hodge Laplacians, curvature."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.sources.storage import shuffled

from .components import components
from .encodings import triangles

# --- relational parts


def lazy_walk(nodes: DataFrame, edges: DataFrame, alpha: float = 0.5) -> DataFrame:
    """graph_id, node_id, at, mass: alpha stays, the rest goes to the neighbours in equal parts; without neighbours all stays."""
    both = edges.select("graph_id", F.col("u").alias("node_id"), F.col("v").alias("at")).unionAll(edges.select("graph_id", F.col("v").alias("node_id"), F.col("u").alias("at")))
    degree = both.groupBy("graph_id", "node_id").agg(F.count("*").alias("d"))
    moved = both.join(degree, ["graph_id", "node_id"]).select("graph_id", "node_id", "at", ((1 - alpha) / F.col("d")).alias("mass"))
    stays = nodes.join(degree, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.col("node_id").alias("at"), F.when(F.col("d").isNull(), 1.0).otherwise(F.lit(float(alpha))).alias("mass"))
    return moved.unionAll(stays)


def hops(nodes: DataFrame, edges: DataFrame, most: int = 3) -> DataFrame:
    """graph_id, a, b, d: pairs at most `most` steps apart, with their distance."""
    step = edges.select("graph_id", F.col("u").alias("b"), F.col("v").alias("c")).unionAll(edges.select("graph_id", F.col("v").alias("b"), F.col("u").alias("c")))
    found = nodes.select("graph_id", F.col("node_id").alias("a"), F.col("node_id").alias("b"), F.lit(0).alias("d"))
    for n in range(1, most + 1):
        further = found.where(F.col("d") == n - 1).join(step, ["graph_id", "b"]).select("graph_id", "a", F.col("c").alias("b"), F.lit(n).alias("d"))
        found = found.unionAll(further).groupBy("graph_id", "a", "b").agg(F.min("d").alias("d"))
    return found


def with_values(edges: DataFrame, values: DataFrame) -> DataFrame:
    """Edges with their value (graph_id, u, v, value), null where none is known."""
    return edges.join(values, ["graph_id", "u", "v"], "left")


def degree_values(edges: DataFrame) -> DataFrame:
    """graph_id, u, v, value: the mean of the ends' degrees."""
    d = shuffled(edges.select("graph_id", F.explode(F.array("u", "v")).alias("n")).groupBy("graph_id", "n").agg(F.count("*").alias("d")))
    return edges.join(d.toDF("graph_id", "u", "du"), ["graph_id", "u"]).join(d.toDF("graph_id", "v", "dv"), ["graph_id", "v"]).select("graph_id", "u", "v", ((F.col("du") + F.col("dv")) / 2).alias("value"))


def label_values(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """graph_id, u, v, value: the mean of the ends' labels."""
    n = nodes.select("graph_id", "node_id", F.col("label").cast("double").alias("l"))
    return edges.join(n.toDF("graph_id", "u", "lu"), ["graph_id", "u"]).join(n.toDF("graph_id", "v", "lv"), ["graph_id", "v"]).select("graph_id", "u", "v", ((F.col("lu") + F.col("lv")) / 2).alias("value"))


def thresholds(valued: DataFrame, steps: int = 10, pad: float = 0.01) -> DataFrame:
    """graph_id, step, tau: equal steps from the least to the largest value; a range under 1e-10 is padded."""
    r = valued.groupBy("graph_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    flat = F.col("hi") - F.col("lo") < 1e-10
    r = r.select("graph_id", F.when(flat, F.col("lo") - pad).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + pad).otherwise(F.col("hi")).alias("hi"))
    each = r.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    tau = F.when(F.col("step") == steps - 1, F.col("hi")).otherwise(F.col("lo") + F.col("step") * ((F.col("hi") - F.col("lo")) / max(1, steps - 1)))
    return each.select("graph_id", "step", tau.alias("tau"))


def sublevel(valued: DataFrame, steps: DataFrame) -> DataFrame:
    """graph_id, step, u, v: the edges up to each threshold."""
    return steps.join(valued, "graph_id").where(F.col("value") <= F.col("tau")).select("graph_id", "step", "u", "v")


def component_counts(nodes: DataFrame, subgraphs: DataFrame) -> DataFrame:
    """graph_id, step, betti0 of subgraphs (graph_id, step, u, v) on all nodes of their graphs: each edge of a forest joins two components. Steps without edges are missing."""
    key = lambda n: F.struct("graph_id", "step", F.col(n).alias("node"))
    roots = components(subgraphs.select(key("u").alias("a"), key("v").alias("b")))
    joined = roots.where("node <> root").groupBy("node.graph_id", "node.step").agg(F.count("*").alias("joined"))
    sizes = nodes.groupBy("graph_id").agg(F.count("*").alias("n"))
    return joined.join(sizes, "graph_id").select("graph_id", "step", (F.col("n") - F.col("joined")).alias("betti0"))


def norm_values(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """graph_id, u, v, value: the mean of the norms of the ends' features (feat); none is 0."""
    norm = F.coalesce(F.sqrt(F.aggregate("feat", F.lit(0.0), lambda s, x: s + x * x)), F.lit(0.0))
    n = nodes.select("graph_id", "node_id", norm.alias("l"))
    return edges.join(n.toDF("graph_id", "u", "lu"), ["graph_id", "u"]).join(n.toDF("graph_id", "v", "lv"), ["graph_id", "v"]).select("graph_id", "u", "v", ((F.col("lu") + F.col("lv")) / 2).alias("value"))


def boundary_1(edges: DataFrame) -> DataFrame:
    """graph_id, node, u, v, sign: + at the smaller end."""
    return edges.select("graph_id", F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("sign")), F.struct(F.col("v").alias("node"), F.lit(-1).alias("sign")))).alias("e"), "u", "v").select("graph_id", "e.node", "u", "v", "e.sign")


def boundary_2(edges: DataFrame) -> DataFrame:
    """graph_id, u, v, a, b, c, sign: +ab, -ac, +bc of each triangle."""
    side = lambda u, v, s: F.struct(F.col(u).alias("u"), F.col(v).alias("v"), F.lit(s).alias("sign"))
    t = triangles(edges, ("graph_id",))
    return t.select("graph_id", "a", "b", "c", F.explode(F.array(side("a", "b", 1), side("a", "c", -1), side("b", "c", 1))).alias("e")).select("graph_id", "e.u", "e.v", "a", "b", "c", "e.sign")


def weighted_boundaries(edges: DataFrame, node_w: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both boundaries with val: rows of the first times the node's weight, columns of the second times the cube root of the corners' product."""
    w = shuffled(node_w.select("graph_id", "node_id", "weight"))
    b1 = boundary_1(edges).join(w.withColumnRenamed("node_id", "node"), ["graph_id", "node"], "left").withColumn("val", F.col("sign") * F.coalesce("weight", F.lit(1.0))).drop("weight")
    b2 = boundary_2(edges)
    for x in "abc":
        b2 = b2.join(w.toDF("graph_id", x, f"w{x}"), ["graph_id", x], "left")
    root = F.pow(F.coalesce("wa", F.lit(1.0)) * F.coalesce("wb", F.lit(1.0)) * F.coalesce("wc", F.lit(1.0)), F.lit(1 / 3))
    return b1, b2.withColumn("val", F.col("sign") * root).drop("wa", "wb", "wc")


def edge_weighted_boundaries(edges: DataFrame, edge_w: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same by edges' weights: columns of the first, and of the second by the geometric mean of the sides."""
    w = edge_w.select("graph_id", "u", "v", "weight")
    b1 = boundary_1(edges).join(w, ["graph_id", "u", "v"], "left").withColumn("val", F.col("sign") * F.coalesce("weight", F.lit(1.0))).drop("weight")
    b2 = boundary_2(edges).join(w, ["graph_id", "u", "v"], "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    mean = F.exp(F.avg(F.log("weight")).over(Window.partitionBy("graph_id", "a", "b", "c")))
    return b1, b2.withColumn("val", F.col("sign") * mean).drop("weight")


def laplacian_0(edges: DataFrame) -> DataFrame:
    """graph_id, i, j, v of degree minus adjacency."""
    both = edges.select("graph_id", F.col("u").alias("i"), F.col("v").alias("j")).unionAll(edges.select("graph_id", F.col("v").alias("i"), F.col("u").alias("j")))
    return both.withColumn("v", F.lit(-1)).unionAll(both.groupBy("graph_id", "i").agg(F.count("*").cast("int").alias("v")).select("graph_id", "i", F.col("i").alias("j"), "v"))


def laplacian_1(edges: DataFrame) -> DataFrame:
    """graph_id, u, v, u2, v2, val of B1' B1 + B2 B2': edges that share a node, or a triangle."""
    down, up = boundary_1(edges), boundary_2(edges)
    b = down.toDF("graph_id", "node", "u2", "v2", "sign2")
    low = down.join(b, ["graph_id", "node"]).select("graph_id", "u", "v", "u2", "v2", (F.col("sign") * F.col("sign2")).alias("val"))
    c = up.select("graph_id", F.col("u").alias("u2"), F.col("v").alias("v2"), "a", "b", "c", F.col("sign").alias("sign2"))
    high = up.join(c, ["graph_id", "a", "b", "c"]).select("graph_id", "u", "v", "u2", "v2", (F.col("sign") * F.col("sign2")).alias("val"))
    return low.unionAll(high).groupBy("graph_id", "u", "v", "u2", "v2").agg(F.sum("val").alias("val")).where("val <> 0")


def euler_by_step(nodes: DataFrame, valued: DataFrame, steps: DataFrame) -> DataFrame:
    """graph_id, step, n_edges, n_triangles, euler: nodes minus edges plus triangles of each sublevel graph.

    An edge, or a triangle at its largest edge, enters at one threshold, so counts by step come from cumulated entries.
    """
    n = nodes.groupBy("graph_id").agg(F.count("*").alias("n"))
    t = triangles(valued.select("graph_id", "u", "v"), ("graph_id",))
    for x, y in ("ab", "ac", "bc"):
        t = t.join(shuffled(valued.toDF("graph_id", x, y, f"v{x}{y}")), ["graph_id", x, y])
    entry = valued.select("graph_id", "value", F.lit(1).alias("e"), F.lit(0).alias("t")).unionAll(t.select("graph_id", F.greatest("vab", "vac", "vbc"), F.lit(0), F.lit(1)))
    held = steps.join(shuffled(entry), "graph_id").groupBy("graph_id", "step").agg(F.sum(F.when(F.col("value") <= F.col("tau"), F.col("e")).otherwise(0)).alias("n_edges"), F.sum(F.when(F.col("value") <= F.col("tau"), F.col("t")).otherwise(0)).alias("n_triangles"))
    return held.join(shuffled(n), "graph_id").select("graph_id", "step", "n_edges", "n_triangles", (F.col("n") - F.col("n_edges") + F.col("n_triangles")).alias("euler"))


# --- dense parts, a graph at a time


def w1(mass_a: np.ndarray, mass_b: np.ndarray, cost: np.ndarray) -> float:
    """Optimal transport cost by shortest augmenting paths with potentials; costs are at least 0."""
    n, m = cost.shape
    supply, demand = mass_a / mass_a.sum(), mass_b / mass_b.sum()
    supply, demand = supply.copy(), demand.copy()
    flow, pa, pb = np.zeros((n, m)), np.zeros(n), np.zeros(m)
    while supply.sum() > 1e-12:
        da, db = np.where(supply > 1e-13, 0.0, np.inf), np.full(m, np.inf)
        from_a, from_b = np.full(m, -1), np.full(n, -1)
        done_a, done_b = np.zeros(n, bool), np.zeros(m, bool)
        while True:  # Dijkstra over both sides; the reduced costs are at least 0
            ia, ib = np.where(done_a, np.inf, da).argmin(), np.where(done_b, np.inf, db).argmin()
            va, vb = (np.inf if done_a[ia] else da[ia]), (np.inf if done_b[ib] else db[ib])
            if not np.isfinite(min(va, vb)):
                break
            if va <= vb:
                done_a[ia] = True
                new = va + np.maximum(cost[ia] + pa[ia] - pb, 0)
                better = (new < db - 1e-15) & ~done_b
                db[better], from_a[better] = new[better], ia
            else:
                done_b[ib] = True
                new = np.where(flow[:, ib] > 1e-13, vb + np.maximum(-(cost[:, ib] + pa - pb[ib]), 0), np.inf)
                better = (new < da - 1e-15) & ~done_a
                da[better], from_b[better] = new[better], ib
        open_b = np.where(demand > 1e-13, db, np.inf)
        end = int(open_b.argmin())
        if not np.isfinite(open_b[end]):
            return float("inf")
        pa, pb = pa + np.minimum(da, open_b[end]), pb + np.minimum(db, open_b[end])
        path, b = [], end
        while True:
            a = int(from_a[b])
            path.append((a, b, 1))
            if from_b[a] < 0:
                break
            b = int(from_b[a])
            path.append((a, b, -1))
        amount = min(supply[path[-1][0]], demand[end], *(flow[x, y] for x, y, s in path if s < 0)) if any(s < 0 for *_, s in path) else min(supply[path[-1][0]], demand[end])
        for x, y, s in path:
            flow[x, y] += s * amount
        supply[path[-1][0]] -= amount
        demand[end] -= amount
    return float((flow * cost).sum())


def distances(n: int, edges: np.ndarray) -> np.ndarray:
    """Steps between all nodes of a graph; inf where there is no path."""
    a = np.zeros((n, n), bool)
    if len(edges):
        a[edges[:, 0], edges[:, 1]] = a[edges[:, 1], edges[:, 0]] = True
    d, reach, step = np.where(np.eye(n, dtype=bool), 0.0, np.inf), np.eye(n, dtype=bool), 0
    while True:
        step += 1
        wider = reach | ((reach.astype(float) @ a.astype(float)) > 0)
        if (wider == reach).all():
            return d
        d[wider & ~reach] = step
        reach = wider


def ricci(n: int, edges: np.ndarray, alpha: float = 0.5) -> np.ndarray:
    """Ollivier-Ricci curvature 1 - W1 of each edge's lazy walks; neighbours are 1 apart."""
    if not len(edges):
        return np.zeros(0)
    d = distances(n, edges)
    near = [np.flatnonzero(row == 1) for row in d]

    def walk(x: int) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(([x], near[x])), np.concatenate(([alpha], np.full(len(near[x]), (1 - alpha) / len(near[x]))))

    out = []
    for u, v in edges:
        (sa, ma), (sb, mb) = walk(u), walk(v)
        out.append(1 - w1(ma, mb, d[np.ix_(sa, sb)]))
    return np.array(out)


def boundaries(n: int, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Dense B1 [n, edges], B2 [edges, triangles] and the triangles; edges sorted, u < v."""
    at = {(int(u), int(v)): i for i, (u, v) in enumerate(edges)}
    above: dict[int, list[int]] = {}
    for u, v in at:
        above.setdefault(u, []).append(v)
    found = [(a, b, c) for (a, b) in at for c in above.get(b, []) if (a, c) in at]
    b1, b2 = np.zeros((n, len(edges))), np.zeros((len(edges), len(found)))
    for (u, v), i in at.items():
        b1[u, i], b1[v, i] = 1, -1
    for t, (a, b, c) in enumerate(found):
        b2[at[a, b], t], b2[at[a, c], t], b2[at[b, c], t] = 1, -1, 1
    return b1, b2, found


def spectrum(m: np.ndarray, k: int, tolerance: float = 1e-8) -> tuple[np.ndarray, int]:
    """The k least eigenvalues, at least 0 and filled with 0, and the nullity."""
    if not m.shape[0]:
        return np.zeros(k), 0
    values = np.clip(np.linalg.eigvalsh(m), 0, None)
    return np.pad(values[:k], (0, max(0, k - len(values)))), int((values < tolerance).sum())


def hodge(n: int, edges: np.ndarray, k0: int = 5, k1: int = 5, node_w: np.ndarray | None = None, edge_w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Least eigenvalues of L0 and L1, and both Betti numbers. Weights bear on L1 only; edge weights win."""
    b1, b2, found = boundaries(n, edges)
    l0 = b1 @ b1.T
    if edge_w is not None:
        at = {(int(u), int(v)): i for i, (u, v) in enumerate(edges)}
        mean = np.array([np.cbrt(edge_w[at[a, b]] * edge_w[at[a, c]] * edge_w[at[b, c]]) for a, b, c in found])
        b1, b2 = b1 * edge_w, b2 * mean if len(found) else b2
    elif node_w is not None:
        mean = np.array([np.cbrt(node_w[a] * node_w[b] * node_w[c]) for a, b, c in found])
        b1, b2 = b1 * node_w[:, None], b2 * mean if len(found) else b2
    s0, betti0 = spectrum(l0, k0)
    s1, betti1 = spectrum(b1.T @ b1 + b2 @ b2.T, k1)
    return s0, s1, betti0, betti1


def levels(values: np.ndarray, steps: int, pad: float) -> np.ndarray:
    lo, hi = values.min(), values.max()
    return np.linspace(lo, hi, steps) if hi - lo > 1e-10 else np.linspace(lo - pad, hi + pad, steps)


def phs(n: int, edges: np.ndarray, values: np.ndarray, steps: int, k0: int, k1: int, pad: float = 0.01, betti: bool = True, betti_only: bool = False, node_w: np.ndarray | None = None, edge_w: np.ndarray | None = None) -> np.ndarray:
    """[steps, features]: spectra and Betti numbers of the sublevel graphs of values; zeros without nodes or edges."""
    width = 2 if betti_only else k0 + k1 + 2 * betti
    if not n or not len(edges):
        return np.zeros((steps, width))
    made: dict = {}  # by the number of edges held, as levels that hold equally many hold the same
    rows = []
    for tau in levels(values, steps, pad):
        held = values <= tau
        if (size := int(held.sum())) not in made:
            s0, s1, b0, b1 = hodge(n, edges[held], k0, k1, node_w, None if edge_w is None else edge_w[held])
            made[size] = [b0, b1] if betti_only else np.concatenate([s0, s1, [b0, b1] if betti else []])
        rows.append(made[size])
    return np.array(rows, float)


def persistence(n: int, edges: np.ndarray, values: np.ndarray) -> list[tuple[int, float, float | None]]:
    """(dimension, death or birth value, None if it lasts) in order of the values: an edge that joins two components ends one, another begins a cycle."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out: list[tuple[int, float, float | None]] = []
    for i in np.argsort(values, kind="stable"):
        a, b = root(int(edges[i][0])), root(int(edges[i][1]))
        if a == b:
            out.append((1, float(values[i]), None))
        else:
            parent[max(a, b)] = min(a, b)
            out.append((0, float(values[i]), float(values[i])))
    return out


# --- the dense parts over a collection


def gathered(nodes: DataFrame, edges: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """graph_id, ids, labels, us, vs, vals: a row a graph; a graph's own size bounds the row.

    The work on a row is far more than its bytes tell, so graphs are dealt to a fixed number of tasks, which adaptive execution doesn't merge.
    """
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    valued = edges.withColumn("value", F.lit(None).cast("double")) if values is None else edges.join(values, ["graph_id", "u", "v"])
    n = nodes.repartition(tasks, "graph_id").groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("node_id", "label"))).alias("ns"))
    e = valued.repartition(tasks, "graph_id").groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("u", "v", "value"))).alias("es"))
    joined = n.join(e, "graph_id", "left")
    return joined.select("graph_id", F.col("ns.node_id").alias("ids"), F.col("ns.label").alias("labels"), F.coalesce(F.col("es.u"), F.array().cast("array<long>")).alias("us"), F.coalesce(F.col("es.v"), F.array().cast("array<long>")).alias("vs"), F.coalesce(F.col("es.value"), F.array().cast("array<double>")).alias("vals"))


def alike(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, own: the least id of the graphs with the same nodes, labels and edges."""
    key = F.sha2(F.to_json(F.struct("ids", "labels", "us", "vs")), 256)
    groups = gathered(nodes, edges).select("graph_id", key.alias("key")).groupBy("key").agg(F.min("graph_id").alias("own"), F.collect_list("graph_id").alias("every"))
    return groups.select(F.explode("every").alias("graph_id"), "own")


def _graph(row) -> tuple[int, np.ndarray]:
    at = {x: i for i, x in enumerate(row.ids)}
    return len(at), np.array([[at[u], at[v]] for u, v in zip(row.us, row.vs, strict=True)], int).reshape(-1, 2)


def curvature(nodes: DataFrame, edges: DataFrame, alpha: float = 0.5) -> DataFrame:
    """graph_id, u, v, value."""

    def run(batches):
        for batch in batches:
            parts = [pd.DataFrame({"graph_id": r.graph_id, "u": r.us, "v": r.vs, "value": ricci(*_graph(r), alpha)}) for r in batch.itertuples()]
            yield pd.concat(parts) if parts else pd.DataFrame(columns=["graph_id", "u", "v", "value"])

    return gathered(nodes, edges).mapInPandas(run, "graph_id long, u long, v long, value double")


def filtration_values(g: np.ndarray, n: int, labels: list, mode: str, alpha: float = 0.5) -> np.ndarray:
    """Values of edges by mode: ricci, degree or label."""
    if mode == "ricci":
        return ricci(n, g, alpha)
    per_node = np.bincount(g.ravel(), minlength=n).astype(float) if mode == "degree" else np.array([float(x or 0) for x in labels])
    if mode not in ("degree", "label"):
        raise ValueError(f"unknown filtration: {mode}")
    return per_node[g].mean(1)


def phs_vectors(nodes: DataFrame, edges: DataFrame, *, modes: tuple[str, ...] = ("ricci",), steps: int = 10, k0: int = 5, k1: int = 5, betti: bool = True, betti_only: bool = False, weighting: str = "none", embedding: np.ndarray | None = None, alpha: float = 0.5, pad: float = 0.01) -> DataFrame:
    """graph_id, vector: one filtration after another, step by step: spectra of L0, of L1, Betti numbers.

    weighting: none, label_index, or cooccurrence with an embedding of the labels. pad: of a degenerate range of curvature.
    """

    def weights(g: np.ndarray, labels: list) -> tuple[np.ndarray | None, np.ndarray | None]:
        clean = np.array([int(x or 0) for x in labels], int)
        if weighting == "label_index":
            return clean + 1.0, None
        if weighting == "cooccurrence":
            own = embedding[np.minimum(clean, len(embedding) - 1)]
            return None, 1 + np.linalg.norm(own[g[:, 0]] - own[g[:, 1]], axis=1)
        if weighting != "none":
            raise ValueError(f"unknown weighting: {weighting}")
        return None, None

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                n, g = _graph(r)
                parts = []
                for mode in modes:
                    node_w, edge_w = weights(g, r.labels) if mode == "ricci" else (None, None)
                    values = filtration_values(g, n, r.labels, mode, alpha) if len(g) else np.zeros(0)
                    parts.append(phs(n, g, values, steps, k0, k1, pad if mode == "ricci" else 0.1, betti, betti_only, node_w, edge_w).ravel())
                rows.append((r.graph_id, np.concatenate(parts)))
            yield pd.DataFrame(rows, columns=["graph_id", "vector"])

    return gathered(nodes, edges).mapInPandas(run, "graph_id long, vector array<double>")


def betti_numbers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, betti0, betti1, first_positive: of the whole graph; the least eigenvalue of L1 above 1e-8, null if none."""

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                n, g = _graph(r)
                _, s1, b0, b1 = hodge(n, g, 1, len(g))
                positive = s1[s1 > 1e-8]
                rows.append((r.graph_id, b0, b1, float(positive[0]) if len(positive) else None))
            yield pd.DataFrame(rows, columns=["graph_id", "betti0", "betti1", "first_positive"])

    return gathered(nodes, edges).mapInPandas(run, "graph_id long, betti0 long, betti1 long, first_positive double")


def trajectories(nodes: DataFrame, edges: DataFrame, steps: int = 10, k1: int = 5) -> DataFrame:
    """graph_id, step, tau, betti1, first_positive, enough: by threshold of curvature; enough says that k1 eigenvalues reach beyond the kernel."""

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                n, g = _graph(r)
                values = ricci(n, g)
                made: dict = {}
                for step, tau in enumerate(levels(values, steps, 0.01) if len(g) else []):
                    held = g[values <= tau]
                    if len(held) not in made:
                        _, s1, _, b1 = hodge(n, held, 1, len(held))
                        positive = s1[s1 > 1e-8]
                        made[len(held)] = (b1, float(positive[0]) if len(positive) else None, k1 > b1)
                    rows.append((r.graph_id, step, float(tau), *made[len(held)]))
            yield pd.DataFrame(rows, columns=["graph_id", "step", "tau", "betti1", "first_positive", "enough"])

    return gathered(nodes, edges).mapInPandas(run, "graph_id long, step int, tau double, betti1 long, first_positive double, enough boolean")


def persistence_pairs(nodes: DataFrame, valued: DataFrame, compat: bool = False) -> DataFrame:
    """graph_id, dim, birth, death: components are there from the start (birth null, or the death itself with compat), cycles last (death null)."""

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                n, g = _graph(r)
                for dim, at, _ in persistence(n, g, np.array(r.vals, float)):
                    rows.append((r.graph_id, dim, (at if compat else None) if dim == 0 else at, at if dim == 0 else None))
            yield pd.DataFrame(rows, columns=["graph_id", "dim", "birth", "death"])

    edges = valued.select("graph_id", "u", "v")
    return gathered(nodes, edges, valued).mapInPandas(run, "graph_id long, dim int, birth double, death double")


def contrast_pair(betti: DataFrame, sizes: DataFrame, least: int = 12, most: int = 28) -> DataFrame:
    """The graphs of the most and fewest rings among those of least..most nodes, or among all if there are none: graph_id, n, betti1."""
    joined = betti.join(sizes, "graph_id")
    inside = joined.where(F.col("n").between(least, most))
    pool = inside if not inside.isEmpty() else joined
    return pool.orderBy(F.desc("betti1"), "graph_id").limit(1).unionAll(pool.orderBy("betti1", "graph_id").limit(1)).select("graph_id", "n", "betti1")


def ring_means(betti: DataFrame, labels: DataFrame) -> DataFrame:
    """label, mean_betti1, mean_first_positive; undefined eigenvalues don't count."""
    return betti.join(labels, "graph_id").groupBy("label").agg(F.avg("betti1").alias("mean_betti1"), F.avg("first_positive").alias("mean_first_positive"))
