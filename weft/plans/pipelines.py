"""Fixed compositions: feature matrices, kernels, and the runs that score them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.scaling import angular, l1_rows, prescreen, robust_tanh, soft_angles
from weft.operators import encodings as enc
from weft.operators import kernels, selection, solvers, spreading, topology
from weft.operators.sparse import PPR_FLOOR, degrees, diffusion, plus_diffused, plus_powers, ppr, ppr_weights, transition
from weft.sources.storage import columns_of, settle


class Graph:
    """A node graph: nodes (node, x, y, split) and edges (src, dst), with the parts that several pipelines share."""

    def __init__(self, nodes: DataFrame, edges: DataFrame) -> None:
        self.nodes, self.edges = settle(nodes, "nodes"), settle(edges, "edges")
        self.x = self.nodes.select("node", F.posexplode("x").alias("dim", "val"))
        self.train = self.nodes.where("split = 'train'").select("node")
        self.classes = self.nodes.select(F.col("y").alias("class")).distinct()
        self.made: dict = {}

    def once(self, key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
        """What key names, made and written at the first call."""
        if key not in self.made:
            self.made[key] = settle(make(), str(key[0]))
        return self.made[key]

    @property
    def p(self) -> DataFrame:
        return self.once(("transition",), lambda: transition(self.edges))

    def operator(self, kind: str, **options) -> DataFrame:
        make = {"poly": lambda: diffusion(self.p, options.get("k", 4), options.get("r", 0.5)), "ppr": lambda: ppr(self.p, options.get("alpha", 0.15))}
        return self.once((kind, *sorted(options.items())), make[kind])

    def diffused(self, kind: str, **options) -> DataFrame:
        """Angles plus their diffusion by an operator, which is no table where every task can hold its powers' matrix."""

        def make() -> DataFrame:
            by_ppr = kind == "ppr"
            r = options.get("r", 0.5)
            weights = (lambda held: ppr_weights(held, options.get("alpha", 0.15))) if by_ppr else lambda held: [r**n for n in range(1, options.get("k", 4) + 1)]
            own = settle(angular(robust_tanh(self.x, self.train)), "own")
            found = plus_powers(own, self.p, weights, PPR_FLOOR if by_ppr else None)
            return plus_diffused(own, self.operator(kind, **options)) if found is None else found

        return self.once(("diffused", kind, *sorted(options.items())), make)


def _stacked(parts: list[DataFrame]) -> DataFrame:
    """Blocks side by side: dims of the second come after those of the first, and so on. The blocks' widths are known by their largest dims."""
    out, start = None, 0
    for part in parts:
        moved = part.select("node", (F.col("dim") + start).alias("dim"), "val")
        out = moved if out is None else out.unionAll(moved)
        start += 1 + (part.agg(F.max("dim")).first()[0] or 0)
    return out


#: Diffusion and structural blocks of each mode.
MODES = {
    "baseline": ("poly", ()),
    "lappe": ("poly", ("lappe",)),
    "rwpe": ("poly", ("rwpe8",)),
    "combined": ("poly", ("lappe", "rwpe4")),
    "hks": ("poly", ("lappe_plain", "hks")),
    "hks_rwpe": ("poly", ("hks", "rwpe12")),
    "degcc": ("poly", ("degcc",)),
    "ppr": ("ppr", ()),
    "ppr_lappe": ("ppr", ("lappe",)),
    "ppr_rwpe": ("ppr", ("rwpe12",)),
    "ppr_combined": ("ppr", ("lappe", "rwpe12")),
    "multilayer2": ("layers2", ()),
    "multilayer": ("layers2", ()),
    "multilayer3": ("layers3", ()),
}


def structure(g: Graph, block: str, lap_k: int = 8, hks_t: int = 6) -> DataFrame:
    """Angles of a structural block (node, dim, val)."""
    if block.startswith("rwpe"):
        raw = enc.random_walk(g.p, g.nodes, int(block[4:]))
    elif block == "lappe":
        raw = enc.laplacian_encoding(g.edges, g.nodes, lap_k)
    elif block == "lappe_plain":
        raw = enc.laplacian_encoding(g.edges, g.nodes, lap_k, normalised=False)
    elif block == "hks":
        raw = enc.heat_kernel(*enc.eigenpairs(g.edges, g.nodes, lap_k), hks_t)
    elif block == "degcc":
        dc = enc.degree_clustering(g.edges, g.nodes)
        raw = dc.select("node", F.posexplode(F.array("degree", "compat")).alias("dim", "val"))
    else:
        raise ValueError(f"unknown block: {block}")
    return angular(raw)


def angles(g: Graph, mode: str = "baseline", *, top: int = 20, alpha: float = 0.15, k: int = 4, r: float = 0.5, layers_by_ppr: bool = True, layers_lappe: bool = False, lap_k: int = 8) -> tuple[DataFrame, int | None]:
    """Prescreened diffused angles of a mode with its structural blocks after them, and the first structural dim. Unknown modes are the baseline.

    Layers diffuse by personalised PageRank or by the polynomial, and may have the Laplacian encoding after them.
    """
    kind, blocks = MODES.get(mode, MODES["baseline"])
    if kind.startswith("layers"):
        n = int(kind[-1])
        layers = enc.layered_angles(g.x, g.operator("ppr", alpha=alpha) if layers_by_ppr else g.operator("poly", k=k, r=r), g.train, n)
        each = max(20, top // (n + 1))
        stacked = settle(_stacked([_dense_dims(prescreen(layer, g.nodes, each)) for layer in layers]), "angles")
        if not layers_lappe:
            return stacked, None
        return settle(_stacked([stacked, structure(g, "lappe", lap_k)]), "angles"), stacked.agg(F.max("dim")).first()[0] + 1
    features = g.diffused("ppr", alpha=alpha) if kind == "ppr" else g.diffused("poly", k=k, r=r)
    chosen = settle(_dense_dims(prescreen(features, g.nodes, top)), "chosen")
    start = chosen.agg(F.max("dim")).first()[0] + 1
    return settle(_stacked([chosen, *[structure(g, b) for b in blocks]]), "angles"), start if blocks else None


def _dense_dims(x: DataFrame) -> DataFrame:
    """The dims that are left as 0, 1, 2, ..."""
    from pyspark.sql import Window

    ranks = x.select("dim").distinct().withColumn("new", (F.row_number().over(Window.orderBy("dim")) - 1))  # a row a dim
    return x.join(F.broadcast(ranks), "dim").select("node", F.col("new").alias("dim"), "val")


def rows(x: DataFrame) -> DataFrame:
    """node, x: features as arrays in order of dim."""
    return x.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("dim", "val"))).alias("r")).select("node", F.col("r.val").alias("x"))


def kernel_rows(g: Graph, *, alpha: float = 0.15, lappe: bool = False, lap_k: int = 8, extra: DataFrame | None = None) -> DataFrame:
    """node, x: the diffused angles, with the Laplacian encoding or further features if asked for."""
    theta = g.diffused("ppr", alpha=alpha)
    parts = [theta, *([structure(g, "lappe", lap_k)] if lappe else []), *([extra] if extra is not None else [])]
    return rows(_stacked(parts) if len(parts) > 1 else theta)


def ppr_kernel(g: Graph, *, degree: int = 1, **options) -> DataFrame:
    """Arc-cosine kernel of kernel_rows()."""
    return settle(kernels.arc_cosine(kernels.dots(kernel_rows(g, **options)), degree), "kernel")


def label_features(g: Graph, alpha: float = 0.1, steps: int = 50, scale: float = 1.0) -> DataFrame:
    """Propagated training labels as angles."""
    return settle(soft_angles(spreading.propagate(g.edges, g.nodes, g.classes, alpha, steps), scale), "labels")


def _tests(g: Graph) -> DataFrame:
    return g.nodes.where("split = 'test'").select("node", "y")


def _test_accuracy(g: Graph, scores: DataFrame) -> float:
    return selection.accuracy(scores, _tests(g)).first()["accuracy"]


def run_paths(g: Graph, mode: str = "ppr", search: str = "beam", top: int = 8, **options) -> dict:
    x, start = angles(g, mode, top=top)
    models = settle(solvers.path_models(x, g.nodes, g.edges, selection=search, struct_start=start, **options), "models")
    return {"method": f"paths_{mode}_{search}", "accuracy": _test_accuracy(g, solvers.path_scores(x, g.nodes, models))}


def _fitted(g: Graph, kernel: DataFrame, method: str, gamma: float = 0.0) -> dict:
    """method, val, accuracy and scores of kernel ridge."""
    model = solvers.KernelRidge(gamma=gamma).fit(kernel, g.nodes, degrees(g.edges) if gamma else None)
    scores = settle(model.scores(kernel), "scores")
    return {"method": method, "val": model.val_accuracy, "accuracy": _test_accuracy(g, scores), "scores": scores}


def _fitted_rows(g: Graph, x: DataFrame, method: str, gamma: float = 0.0) -> dict:
    """The same of the arc-cosine kernel between rows x (node, x), whose pairs are no table: a lambda is a task."""
    part = F.when(F.col("split") == "train", 1).when(F.col("split") == "val", 2).otherwise(3)
    known = x.join(g.nodes.select("node", "y", "split"), "node").join(degrees(g.edges), "node", "left")
    ids, y, parts, degree, wide = columns_of(known.select(F.col("node").cast("long").alias("node"), F.col("y").cast("long").alias("y"), part.cast("long").alias("part"), F.coalesce("degree", F.lit(0)).cast("long").alias("degree"), "x"), "node", "y", "part", "degree", "x")
    order = np.argsort(ids)
    ids, y, parts, degree, wide = ids[order], y[order], parts[order], degree[order], wide.reshape(len(ids), -1)[order]
    weights = np.where(degree > 0, np.maximum(degree, 1.0) ** -float(gamma), 1.0)
    weights /= weights[parts == 1].mean()
    classes = np.unique(y[parts == 1])
    runs = settle(solvers.ridge_runs(g.nodes.sparkSession, solvers.ArcCosine(wide), y, parts[None, :], weights=weights, scores=True), "runs")
    vals = {r["n"]: r["val"] for r in runs.select("n", "val").collect()}  # a row a lambda
    chosen = max(vals, key=lambda n: (-1.0 if vals[n] is None else vals[n], -n))

    def each(batches):
        for batch in batches:
            for found in batch["scores"]:
                yield pd.DataFrame({"node": np.repeat(ids, len(classes)), "class": np.tile(classes, len(ids)), "val": np.frombuffer(found)})

    scores = settle(runs.where(F.col("n") == chosen).select("scores").mapInPandas(each, "node long, class int, val double"), "scores")
    return {"method": method, "val": vals[chosen], "accuracy": _test_accuracy(g, scores), "scores": scores}


def _reported(g: Graph, runs: list[dict], smooth: bool) -> list[dict]:
    """The runs without their scores and, if asked for, the first of the best validation accuracy once more, corrected and smoothed."""
    out = [{k: v for k, v in r.items() if k != "scores"} for r in runs]
    if smooth:
        best = max(runs, key=lambda r: r["val"])
        scores, val = spreading.smoothed(best["scores"], g.edges, g.nodes)
        out.append({**{k: v for k, v in best.items() if k != "scores"}, "method": best["method"] + "_cs", "val": val, "accuracy": _test_accuracy(g, scores)})
    return out


def run_kernel(g: Graph, *, smooth: bool = False, gamma: float = 0.0, steps: tuple[int, ...] = (10, 50, 100), **options) -> dict:
    """Kernel ridge on diffused angles; corrected and smoothed over a grid of settings and steps if asked for."""
    name = "kernel" + f"_g{gamma:g}" * bool(gamma)
    if options.pop("degree", 1) != 1:
        raise ValueError("run_kernel is of degree 1")
    run = _fitted_rows(g, kernel_rows(g, **options), name, gamma)
    scores = run.pop("scores")
    if smooth:
        scores, val = spreading.smoothed(scores, g.edges, g.nodes, steps=steps)
        run |= {"method": run["method"] + "_cs", "val": val, "accuracy": _test_accuracy(g, scores)}
    return run


def run_rbf(g: Graph, alphas: tuple[float, ...] = (0.1, 0.15, 0.2), sigmas: tuple[float | None, ...] = (0.5, 1.0, 2.0, 5.0, None), lappe: bool = True, smooth: bool = False) -> list[dict]:
    """A run for each alpha and sigma."""
    runs = []
    for alpha in alphas:
        theta = g.diffused("ppr", alpha=alpha)
        pairs = g.once(("dots", alpha, lappe), lambda t=theta: kernels.dots(rows(_stacked([t, structure(g, "lappe")]) if lappe else t)))
        for sigma in sigmas:
            kernel, used = kernels.rbf(pairs, sigma, 500)
            runs.append(_fitted(g, settle(kernel, "kernel"), "rbf") | {"alpha": alpha, "sigma": used})
    return _reported(g, runs, smooth)


def run_layers(g: Graph, layers: int = 2, stops: bool = False, lappe: bool = True, alpha: float = 0.15, **grid) -> dict:
    """A kernel, corrected and smoothed, on its predecessor's scores as angles beside the features, with as much weight as these; if it stops, as soon as validation doesn't gain."""
    theta = g.diffused("ppr", alpha=alpha)
    features = g.once(("features", alpha, lappe), lambda: _stacked([theta, structure(g, "lappe")]) if lappe else theta)
    width, n_classes = 1 + features.agg(F.max("dim")).first()[0], g.classes.count()
    best: dict = {"val": -1.0}
    own = features
    for n in range(layers):
        kernel = settle(kernels.arc_cosine(kernels.dots(rows(own)), 1), "kernel")
        scores, val = spreading.smoothed(_fitted(g, kernel, "layer")["scores"], g.edges, g.nodes, **grid)
        if stops and val <= best["val"]:
            break
        best = {"method": f"layers{n + 1}", "val": val, "accuracy": _test_accuracy(g, scores)}
        own = settle(_stacked([features, soft_angles(scores, (width / n_classes) ** 0.5)]), "layer")
    return best


def run_alpha_sweep(g: Graph, alphas: tuple[float, ...] = (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6), lappe: bool = True, smooth: bool = False) -> list[dict]:
    return _reported(g, [_fitted(g, ppr_kernel(g, alpha=a, lappe=lappe), "alpha") | {"alpha": a} for a in alphas], smooth)


def run_adaptive(g: Graph, gammas: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0), lappe: bool = True, smooth: bool = False) -> list[dict]:
    kernel = ppr_kernel(g, lappe=lappe)
    return _reported(g, [_fitted(g, kernel, "adaptive", v) | {"gamma": v} for v in gammas], smooth)


def run_combined(g: Graph, weights: tuple[float, ...] = (0.0, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0), lappe: bool = True, smooth: bool = False) -> list[dict]:
    """Feature kernel plus weight times the label kernel; both are made once."""
    own = ppr_kernel(g, lappe=lappe)
    labels = settle(kernels.arc_cosine(kernels.dots(rows(label_features(g)))), "kernel")
    return _reported(g, [_fitted(g, settle(kernels.combined(own, labels, w), "kernel"), "combined") | {"weight": w} for w in weights], smooth)


def run_label_kernel(g: Graph, scales: tuple[float, ...] = (0.5, 1.0, 2.0), lappe: bool = True, smooth: bool = False) -> list[dict]:
    return _reported(g, [_fitted(g, ppr_kernel(g, lappe=lappe, extra=label_features(g, scale=s)), "labels") | {"scale": s} for s in scales], smooth)


def run_sgc(g: Graph, hops: int = 2) -> dict:
    """Features propagated over the normalised adjacency, then a logistic regression."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    from weft.operators.sparse import normalised_adjacency, spmm

    a, x = g.once(("adjacency",), lambda: normalised_adjacency(g.edges, g.nodes)), g.x
    for _ in range(hops):
        x = settle(spmm(a, x), "hop")
    data = rows(x).join(g.nodes.select("node", "y", "split"), "node").select("node", "y", "split", array_to_vector("x").alias("features"))
    model = LogisticRegression(labelCol="y", maxIter=100, regParam=1e-3).fit(data.where("split = 'train'"))
    hit = model.transform(data.where("split = 'test'")).agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]
    return {"method": "sgc", "accuracy": hit}


def run_mlp(g: Graph, hidden: int = 64, smooth: bool = False, **grid) -> dict:
    """A network of one hidden layer (sigmoid, no dropout) on the features with rows of absolute sum 1; corrected and smoothed if asked for."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = rows(l1_rows(g.x)).join(g.nodes.select("node", "y", "split"), "node").select("node", "y", "split", array_to_vector("x").alias("features"))
    width, n = data.first()["features"].size, g.classes.agg(F.max("class")).first()[0] + 1
    model = MultilayerPerceptronClassifier(labelCol="y", layers=[width, hidden, n], maxIter=100, seed=42).fit(data.where("split = 'train'"))
    # logarithms, as a softmax of them gives the probabilities back
    scores = settle(model.transform(data).select("node", F.posexplode(vector_to_array("probability")).alias("class", "p")).select("node", "class", F.log(F.col("p") + 1e-12).alias("val")), "scores")
    val = selection.accuracy(scores, g.nodes.where("split = 'val'").select("node", "y")).first()["accuracy"]
    if smooth:
        scores, val = spreading.smoothed(scores, g.edges, g.nodes, **grid)
    return {"method": "mlp" + "_cs" * smooth, "val": val, "accuracy": _test_accuracy(g, scores)}


#: The modes' names.
KERNEL_MODES: dict[str, Callable[[Graph], dict | list[dict]]] = {
    "kernel_ppr": lambda g: run_kernel(g),
    "kernel_ppr_lappe": lambda g: run_kernel(g, lappe=True),
    "cs_kernel": lambda g: run_kernel(g, smooth=True),
    "cs_kernel_lappe": lambda g: run_kernel(g, smooth=True, lappe=True),
    "cs_mlp": lambda g: run_mlp(g, smooth=True),
    "lp_kernel": run_label_kernel,
    "lp_kernel_cs": lambda g: run_label_kernel(g, smooth=True),
    "combined_kernel": run_combined,
    "combined_kernel_cs": lambda g: run_combined(g, smooth=True),
    "adaptive_kernel": run_adaptive,
    "adaptive_kernel_cs": lambda g: run_adaptive(g, smooth=True),
    "alpha_sweep": run_alpha_sweep,
    "alpha_sweep_cs": lambda g: run_alpha_sweep(g, smooth=True),
    "two_layer_kernel": lambda g: run_layers(g, 2),
    "multilayer_kernel": lambda g: run_layers(g, 5, stops=True),
    "rbf_kernel": run_rbf,
    "rbf_kernel_cs": lambda g: run_rbf(g, smooth=True),
}


def run(g: Graph, mode: str, search: str = "beam") -> dict | list[dict]:
    """A mode by name: a kernel run, or a path search on that mode's angles."""
    if mode in KERNEL_MODES:
        return KERNEL_MODES[mode](g)
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    return run_paths(g, mode, search)


# --- graph collections

#: Filtrations, steps and eigenvalues of each data set in the whole comparison; feat: the labels.
COLLECTIONS = {
    "MUTAG": {"modes": ("ricci",), "steps": 8, "k": 5},
    "PTC_MR": {"modes": ("ricci", "degree"), "steps": 10, "k": 5},
    "DHFR": {"modes": ("ricci", "degree", "label"), "steps": 10, "k": 5},
    "NCI1": {"modes": ("ricci", "degree", "label"), "steps": 10, "k": 5},
    "PROTEINS": {"modes": ("ricci", "degree"), "steps": 12, "k": 5},
}
#: The filtrations of the ablation; they differ for one data set.
ABLATION = {
    "MUTAG": ("ricci",),
    "PTC_MR": ("ricci", "degree"),
    "DHFR": ("ricci", "degree", "label"),
    "NCI1": ("ricci", "degree", "label"),
    "PROTEINS": ("degree", "label"),
}


def run_collection(nodes: DataFrame, edges: DataFrame, labels: DataFrame, dataset: str, folds: int = 10) -> DataFrame:
    """dataset, method, mean, std of a data set by its configuration: topological vectors and the subtree kernel over the same folds."""
    from weft.sources.results import fold_summary

    c = COLLECTIONS[dataset]
    own = phs_folds(nodes, edges, labels, c["modes"], c["steps"], c["k"], folds).unionAll(wl_folds(nodes, edges, labels, folds=folds))
    return fold_summary(own.withColumn("dataset", F.lit(dataset)))


def _folds(labels: DataFrame, ids: np.ndarray, folds: int) -> tuple[np.ndarray, np.ndarray]:
    """The labels of ids, and their parts in each fold: 1 train, 2 val, 3 test; 0 for ids without a label."""
    part = F.when(F.col("part") == "train", 1).when(F.col("part") == "val", 2).otherwise(3)
    own = selection.inner_validation(selection.stratified_folds(labels, folds), folds)
    fold, graph, label, code = columns_of(own.select(F.col("fold").cast("long").alias("fold"), F.col("graph_id").cast("long").alias("graph_id"), F.col("label").cast("long").alias("label"), part.cast("long").alias("part")), "fold", "graph_id", "label", "part")
    at = np.minimum(np.searchsorted(ids, graph), max(0, len(ids) - 1))
    known = ids[at] == graph if len(ids) else np.zeros(len(graph), bool)
    y, parts = np.zeros(len(ids), "int64"), np.zeros((folds, len(ids)), "int8")
    y[at[known]], parts[fold[known], at[known]] = label[known], code[known]
    return y, parts


def _fold_scores(runs: DataFrame, dataset: str, method: str) -> DataFrame:
    """dataset, method, fold, acc of the first lambda of the best validation accuracy, 0 without any validation."""
    best = F.max_by("test", F.when(F.col("val").isNotNull(), F.struct("val", -F.col("n"))))
    acc = F.when(F.count("val") == 0, 0.0).otherwise(best)
    return runs.groupBy("fold").agg(acc.alias("acc")).select(F.lit(dataset).alias("dataset"), F.lit(method).alias("method"), "fold", "acc")


def cross_validated(vectors: DataFrame, labels: DataFrame, folds: int = 10, dataset: str = "events", method: str = "phs", alike: DataFrame | None = None) -> DataFrame:
    """dataset, method, fold, acc of kernel ridge on scaled vectors (graph_id, vector), the folds dealt by class. A fold and lambda is a task; a collection's vectors are sent to all of them. alike: graph_id, own, where graphs have the vector of another one."""
    ids, x = columns_of(vectors.select(F.col("graph_id").cast("long").alias("graph_id"), "vector"), "graph_id", "vector")
    order = np.argsort(ids)
    ids, x = ids[order], x.reshape(len(ids), -1)[order] if len(ids) else np.zeros((0, 0))
    every, same = (ids, None) if alike is None else _places(alike, ids)
    y, parts = _folds(labels, every, folds)
    return _fold_scores(settle(solvers.ridge_runs(vectors.sparkSession, solvers.ScaledArcCosine(x), y, parts, same=same), "runs"), dataset, method)


def _places(alike: DataFrame, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All graphs in order, and the place of the graph like each one among ids."""
    graph, own = columns_of(alike.select(F.col("graph_id").cast("long").alias("graph_id"), F.col("own").cast("long").alias("own")), "graph_id", "own")
    order = np.argsort(graph)
    return graph[order], np.searchsorted(ids, own[order])


def _unlike(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges of one graph of each kind, and graph_id, own of all."""
    alike = settle(topology.alike(nodes, edges), "alike")
    first = alike.where("graph_id = own").select("graph_id")
    return nodes.join(first, "graph_id", "left_semi"), edges.join(first, "graph_id", "left_semi"), alike


def phs_folds(nodes: DataFrame, edges: DataFrame, labels: DataFrame, modes: tuple[str, ...] = ("ricci", "label"), steps: int = 10, k: int = 5, folds: int = 10, **options) -> DataFrame:
    some, ends, alike = _unlike(nodes, edges)
    vectors = settle(topology.phs_vectors(some, ends, modes=modes, steps=steps, k0=k, k1=k, **options), "vectors")
    return cross_validated(vectors, labels, folds, alike=alike)


def wl_folds(nodes: DataFrame, edges: DataFrame, labels: DataFrame, rounds: int = 4, folds: int = 10, use_labels: bool = True) -> DataFrame:
    """The subtree kernel with the same folds, and kernel ridge in the place of a support vector machine."""
    some, ends, alike = _unlike(nodes, edges)
    ids, gram = kernels.wl_matrix(some, ends, rounds, use_labels)
    every, same = _places(alike, ids)
    y, parts = _folds(labels, every, folds)
    return _fold_scores(settle(solvers.ridge_runs(nodes.sparkSession, gram, y, parts, same=same), "runs"), "events", "wl")


def betti_ablation(nodes: DataFrame, edges: DataFrame, labels: DataFrame, modes: tuple[str, ...] = ("degree", "label"), steps: int = 10) -> DataFrame:
    """Folds of the whole vectors against Betti numbers alone."""
    whole = phs_folds(nodes, edges, labels, modes, steps)
    return whole.unionAll(phs_folds(nodes, edges, labels, modes, steps, betti_only=True).withColumn("method", F.lit("betti")))


def step_sensitivity(nodes: DataFrame, edges: DataFrame, labels: DataFrame, steps: tuple[int, ...] = (5, 8, 10, 12, 15, 20), modes: tuple[str, ...] = ("ricci",)) -> DataFrame:
    """steps, mean, std of the folds."""
    out = None
    for n in steps:
        row = phs_folds(nodes, edges, labels, modes, n).agg(F.lit(n).alias("steps"), F.avg("acc").alias("mean"), F.stddev_pop("acc").alias("std"))
        out = row if out is None else out.unionAll(row)
    return out


def compared(nodes: DataFrame, edges: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """dataset, n, p, result: topological vectors (a) against the subtree kernel (b) over the same folds."""
    from weft.operators.statistics import wilcoxon

    a = phs_folds(nodes, edges, labels, **options).select("dataset", "fold", F.col("acc").alias("a"))
    return wilcoxon(a.join(wl_folds(nodes, edges, labels).select("dataset", "fold", F.col("acc").alias("b")), ["dataset", "fold"]))


def principal_axes(vectors: DataFrame, k: int = 2) -> DataFrame:
    """node, axes: vectors (node, x) on their k main axes, the signs as the solver gives them made positive at the largest entry of an axis."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = vectors.select("node", array_to_vector("x").alias("features"))
    model = PCA(k=k, inputCol="features", outputCol="axes").fit(data)
    axes = model.pc.toArray()
    signs = F.array(*[F.lit(1.0 if axes[abs(axes[:, i]).argmax(), i] >= 0 else -1.0) for i in range(k)])
    return model.transform(data).select("node", F.zip_with(vector_to_array("axes"), signs, lambda a, b: F.round(a * b, 6)).alias("axes"))
