"""Known values and invariants on small graphs."""

import tracemalloc
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weft.operators import encodings as enc
from weft.operators import kernels, selection, solvers, sparse, spreading, statistics, topology
from weft.plans import catalog, pipelines
from weft.sources import results, tu

CYCLE = lambda n: [(i, i + 1) for i in range(n - 1)] + [(0, n - 1)]
COMPLETE = lambda n: list(combinations(range(n), 2))
OCTAHEDRON = [e for e in COMPLETE(6) if e not in ((0, 1), (2, 3), (4, 5))]


def edges(pairs):
    return np.array(sorted(pairs), int).reshape(-1, 2)


@pytest.mark.parametrize(("n", "pairs", "betti"), [(4, [(0, 1), (1, 2), (2, 3)], (1, 0)), (5, CYCLE(5), (1, 1)), (3, CYCLE(3), (1, 0)), (4, COMPLETE(4), (1, 0)), (4, [(0, 1), (2, 3)], (2, 0)), (3, [], (3, 0)), (5, [(0, i) for i in range(1, 5)], (1, 0))])
def test_betti(n, pairs, betti):
    assert topology.hodge(n, edges(pairs))[2:] == betti


def test_ranks():
    assert np.linalg.matrix_rank(topology.boundaries(4, edges(COMPLETE(4)))[1]) == 3
    assert np.linalg.matrix_rank(topology.boundaries(6, edges(OCTAHEDRON))[1]) == 7


def test_curvature_closed_forms():
    for n in (3, 4, 5):  # complete graphs: the lazy walks differ at two nodes only
        assert np.allclose(topology.ricci(n, edges(COMPLETE(n))), 1 - abs(0.5 - 0.5 / (n - 1)))
    assert np.allclose(topology.ricci(6, edges(CYCLE(6))), 0.0)
    assert np.allclose(topology.ricci(2, edges([(0, 1)])), 1.0)


GRAPHS = st.integers(2, 8).flatmap(lambda n: st.tuples(st.just(n), st.sets(st.sampled_from(COMPLETE(n)))))


@settings(max_examples=60, deadline=None)
@given(GRAPHS, st.integers(0, 1000))
def test_hodge_invariants(graph, seed):
    n, e = graph[0], edges(graph[1])
    b1, b2, found = topology.boundaries(n, e)
    assert not len(found) or not (b1 @ b2).any()
    s0, s1, betti0, betti1 = topology.hodge(n, e)
    rank = np.linalg.matrix_rank(b2) if b2.size else 0
    assert betti1 == len(e) - n + betti0 - rank
    rng = np.random.default_rng(seed)
    assert topology.hodge(n, e, node_w=rng.uniform(0.5, 2, n))[2:] == (betti0, betti1)
    assert topology.hodge(n, e, edge_w=rng.uniform(0.5, 2, len(e)))[2:] == (betti0, betti1)
    pairs = topology.persistence(n, e, rng.normal(size=len(e)))
    assert sum(d == 0 for d, *_ in pairs) == n - betti0


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 4), st.integers(1, 4), st.integers(0, 10_000))
def test_w1_against_brute_force(n, m, seed):
    """Equal masses in units: the best assignment of units is the optimum."""
    from itertools import permutations

    rng = np.random.default_rng(seed)
    a, b = rng.integers(1, 3, n), rng.integers(1, 3, m)
    a, b = a * b.sum(), b * a.sum()
    k = np.gcd.reduce(np.concatenate([a, b]))
    left, right = np.repeat(np.arange(n), a // k), np.repeat(np.arange(m), b // k)
    if len(left) > 7:
        return
    cost = rng.integers(0, 4, (n, m)).astype(float)
    best = min(sum(cost[x, y] for x, y in zip(left, p, strict=True)) for p in permutations(right)) / len(left)
    assert topology.w1(a.astype(float), b.astype(float), cost) == pytest.approx(best)


def test_levels_that_hold_the_same_edges():
    edges, values = np.array([[0, 1], [1, 2], [0, 2], [2, 3], [3, 4]]), np.array([1.0, 1.0, 2.0, 4.0, 4.0])
    got = topology.phs(5, edges, values, 7, 3, 3)
    for row, tau in zip(got, topology.levels(values, 7, 0.01), strict=True):
        s0, s1, b0, b1 = topology.hodge(5, edges[values <= tau], 3, 3)
        assert np.allclose(row, [*s0, *s1, b0, b1])
    assert len({tuple(row) for row in got}) == 3


def test_phs_shapes():
    assert topology.phs(0, edges([]), np.zeros(0), 4, 2, 2).shape == (4, 6)
    out = topology.phs(5, edges(CYCLE(5)), np.arange(5.0), 5, 2, 2)
    assert out[-1, -2:].tolist() == [1, 1] and out[0, -2] == 4


def _nodes(spark, n):
    return spark.range(n).selectExpr("id AS node", "cast(id % 2 AS int) AS y", "CASE WHEN id < 3 THEN 'train' WHEN id < 5 THEN 'val' ELSE 'test' END AS split")


def _edges(spark, pairs):
    return spark.createDataFrame([*pairs, *[(b, a) for a, b in pairs]], "src long, dst long")


def test_sparse_against_numpy(spark):
    pairs = [*CYCLE(6), (0, 3)]
    p, dense = sparse.transition(_edges(spark, pairs)), np.zeros((6, 6))
    for a, b in pairs:
        dense[a, b] = dense[b, a] = 1
    dense /= dense.sum(1, keepdims=True)
    assert all(abs(r["s"] - 1) < 1e-12 for r in p.groupBy("i").agg({"v": "sum"}).withColumnRenamed("sum(v)", "s").collect())
    want = sum(0.15 * 0.85**k * np.linalg.matrix_power(dense, k) for k in range(30))
    want[np.diag_indices(6)] = 0
    got = np.zeros((6, 6))
    for r in sparse.ppr(p).collect():
        got[r["i"], r["j"]] = r["v"]
    assert np.allclose(got, want, atol=1e-4)
    want = sum(0.5**k * np.linalg.matrix_power(dense, k) for k in range(1, 4))
    want[np.diag_indices(6)] = 0
    got = np.zeros((6, 6))
    for r in sparse.diffusion(p, 3).collect():
        got[r["i"], r["j"]] = r["v"]
    assert np.allclose(got, want)


def test_spreading_keeps_start_at_alpha_one(spark):
    nodes, e = _nodes(spark, 6), _edges(spark, CYCLE(6))
    start = nodes.selectExpr("node", "0 AS class", "cast(node AS double) AS val")
    out = {r["node"]: r["val"] for r in spreading.spread(start, sparse.normalised_adjacency(e, nodes), 1.0, 2).collect()}
    assert out == {i: float(i) for i in range(6)}


def test_eigenpairs_and_iteration_span_the_same_space(spark):
    nodes, e = _nodes(spark, 12), _edges(spark, [(i, i + 1) for i in range(11)])
    vectors, values = enc.eigenpairs(e, nodes, 3)
    assert np.allclose(values, [2 - 2 * np.cos(np.pi * k / 12) for k in (1, 2, 3)])
    assert enc.heat_kernel(vectors, values, 3).count() == 36
    dense = np.zeros((12, 12))
    for r in sparse.normalised_adjacency(e, nodes).collect():
        dense[r["i"], r["j"]] = r["v"]
    want = np.linalg.eigh(dense)[1][:, ::-1][:, 1:3]
    got = np.zeros((12, 2))
    for r in enc.iterated(e, nodes, 2, 90).collect():
        got[r["node"], r["dim"]] = r["val"]
    assert np.allclose(np.abs(np.linalg.det(want.T @ got)), 1, atol=1e-2)


def test_eigenpairs_of_more_nodes_than_are_dense(spark, monkeypatch):
    rng = np.random.default_rng(7)
    nodes, e = _nodes(spark, 60), _edges(spark, [(int(rng.integers(0 if n < 40 else 40, n)), n) for n in range(1, 60) if n != 40])
    for normalised in (False, True):
        monkeypatch.setattr(enc, "MOST_DENSE", 60)
        dense, values = enc.eigenpairs(e, nodes, 5, normalised=normalised)
        monkeypatch.setattr(enc, "MOST_DENSE", 10)
        sparse_, found = enc.eigenpairs(e, nodes, 5, normalised=normalised)
        assert np.allclose(values, found, atol=1e-8)  # the second 0, of the other component, too
        a, b = (np.array([r["val"] for r in x.orderBy("node", "dim").collect()]).reshape(60, 5) for x in (dense, sparse_))
        assert np.allclose(np.abs(a[:, 1:]), np.abs(b[:, 1:]), atol=1e-6)
    monkeypatch.setattr(enc, "MOST_ENTRIES", 20)
    with pytest.raises(ValueError):
        enc.eigenpairs(e, nodes, 5)


def test_powers_by_rows_and_by_joins_agree(spark, monkeypatch):
    nodes, p = _nodes(spark, 14), sparse.transition(_edges(spark, [*CYCLE(9), (0, 4), (9, 10), (10, 11), (11, 12), (3, 12)]))
    read = lambda df, c: {(r["i"], r["j"]): r["v"] for r in df.toDF("i", "j", "v").collect()} if c else {(r["node"], r["dim"]): r["val"] for r in df.collect()}
    monkeypatch.setattr(sparse, "AT_ONCE", 60)  # a few rows at a time
    forms = []
    for most in (10**6, 0):
        monkeypatch.setattr(sparse, "MOST_HELD", most)
        forms.append([read(enc.random_walk(p, nodes, 5), 0), *(read(sparse.ppr(p, alpha, n, tolerance, floor), 1) for alpha, n, tolerance, floor in ((0.15, 30, 1e-5, 1e-4), (0.5, 30, 1e-3, 1e-4), (0.15, 4, 0.0, 0.0), (0.15, 2, 0.0, 0.0)))])
    for rows, joins in zip(*forms, strict=True):
        assert rows.keys() == joins.keys() and all(rows[k] == pytest.approx(joins[k], abs=1e-12) for k in rows)
    monkeypatch.setattr(sparse, "MOST_HELD", 10**6)
    monkeypatch.setattr(sparse, "matmul", None)  # powers are no tables
    assert enc.random_walk(p, nodes, 5).count() == 70


def test_gram_matrices(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(9, 3))
    rows = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "node long, x array<double>")
    for degree in (0, 1, 2):
        k = np.zeros((9, 9))
        for r in kernels.arc_cosine(kernels.dots(rows, 3), degree).collect():
            k[r["i"], r["j"]] = r["k"]
        assert np.allclose(k, k.T) and np.linalg.eigvalsh(k).min() > -1e-3 and (k != 0).all()


def test_pairs_of_blocks_without_shuffled_copies(spark):
    """Shuffled rows don't grow with the number of blocks, and sums of kernels need no join of the pairs."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(23, 4))
    rows = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "node long, x array<double>")
    pairs = kernels.dots(rows, 7)
    assert "Generate" not in (plan := kernels.arc_cosines(pairs, {1: 1.0, 2: 0.5})._jdf.queryExecution().toString()) and "SortMergeJoin" not in plan and "FlatMapCoGroups" not in plan
    got = {(r["i"], r["j"]): r for r in pairs.collect()}
    assert len(got) == 23 * 23 and all(abs(r["dot"] - x[i] @ x[j]) < 1e-9 for (i, j), r in got.items())
    one, two, both = ({(r["i"], r["j"]): r["k"] for r in k.collect()} for k in (kernels.arc_cosine(pairs, 1), kernels.arc_cosine(pairs, 2), kernels.arc_cosines(pairs, {1: 1.0, 2: 0.5})))
    assert all(both[p] == pytest.approx(one[p] + 0.5 * two[p]) for p in got)


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [3.0, 1.0, 2.0], [5.0] * 9 + [1.0], [1.0, 1.0, 7.0, 7.0]])
def test_exact_median(spark, values):
    assert kernels.exact_median(spark.createDataFrame([(v,) for v in values], "d double"), 4, 1) == np.median(values)


def test_exact_median_divides_cells(spark):
    values = np.random.default_rng(5).gamma(2.0, 3.0, 5000)
    d = spark.createDataFrame([(float(v),) for v in values], "d double")
    assert kernels.exact_median(d, 16, 3) == np.median(values) == kernels.exact_median(d)
    assert kernels.exact_median(d.where("d < 0")) is None


def test_wl_ignores_node_order(spark):
    def gram(shift):
        pairs = [(g, (a * shift) % 5, (b * shift) % 5) for g in (1, 2) for a, b in (CYCLE(5) if g == 1 else [*CYCLE(5), (0, 2)])]
        e = spark.createDataFrame([(g, min(a, b), max(a, b)) for g, a, b in pairs], "graph_id long, u long, v long")
        n = spark.createDataFrame([(g, i, 0) for g in (1, 2) for i in range(5)], "graph_id long, node_id long, label long")
        return {(r["i"], r["j"]): r["k"] for r in kernels.wl_gram(n, e, 2).collect()}

    assert gram(1) == gram(2)


def test_kernel_ridge_learns_blocks(spark):
    nodes = spark.range(12).selectExpr("id AS node", "cast(id % 2 AS int) AS y", "CASE WHEN id < 6 THEN 'train' WHEN id < 9 THEN 'val' ELSE 'test' END AS split")
    k = spark.range(12).selectExpr("id AS i").crossJoin(spark.range(12).selectExpr("id AS j")).selectExpr("i", "j", "CASE WHEN i % 2 = j % 2 THEN 1.0D ELSE 0.1D END AS k")
    model = solvers.KernelRidge(gamma=0.5).fit(k, nodes, nodes.selectExpr("node", "node + 1 AS degree"))
    assert model.val_accuracy == 1.0 and selection.accuracy(model.scores(k), nodes).first()[0] == 1.0


def test_wl_gram_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    n = spark.createDataFrame([(g, i, int(rng.integers(0, 3))) for g in range(9) for i in range(1, 2 + g)] + [(20, 1, 77)], "graph_id long, node_id long, label long")
    e = spark.createDataFrame([(g, i, i + 1) for g in range(9) for i in range(1, 1 + g)], "graph_id long, u long, v long")
    held: dict = {}
    for r in kernels.wl_counts(kernels.wl_rounds(n, e, 3)).collect():
        held.setdefault(r["graph_id"], {})[r["round"], r["label"]] = r["n"]
    want = {(i, j): k for i, a in held.items() for j, b in held.items() if (k := float(sum(x * b.get(f, 0) for f, x in a.items())))}
    monkeypatch.setattr(kernels, "WL_ROWS", 2)
    monkeypatch.setattr(kernels, "WL_LABELS", 3)
    gram = kernels.wl_gram(n, e, 3)
    assert "SortAggregate" not in (plan := gram._jdf.queryExecution().optimizedPlan().toString()) and "Aggregate" not in plan  # no sums over pairs
    assert {(r["i"], r["j"]): r["k"] for r in gram.collect()} == want and (20, 1) not in want


@pytest.mark.parametrize("selection", ["greedy", "beam"])
def test_path_search_of_more_nodes_than_a_gram_matrix_may_have(spark, monkeypatch, selection):
    monkeypatch.setattr(solvers, "MOST_TRAIN", 10)
    rng = np.random.default_rng(4)
    theta = rng.uniform(0, np.pi, (40, 3))
    nodes = spark.createDataFrame([(100 + i, int(np.cos(t[1]) > 0), ("train", "val", "test")[i % 3]) for i, t in enumerate(theta)], "node long, y int, split string")
    x = spark.createDataFrame([(100 + i, d, float(v)) for i, t in enumerate(theta) for d, v in enumerate(t)], "node long, dim int, val double")
    e = _edges(spark, [(100 + i, 101 + i) for i in range(39)] + [(100, 999)])  # 999 is no node
    models = {r["class"]: r for r in solvers.path_models(x, nodes, e, selection=selection, most=2).collect()}
    assert models.keys() == {0, 1} and all(r["paths"] for r in models.values())
    if selection == "greedy":
        part = np.arange(40) % 3
        paths, lam, history = solvers.greedy_paths(solvers._Scorer(theta, np.cos(theta[:, 1]) > 0, part == 0, part == 1), solvers.candidates(3), 2)
        assert [tuple(p) for p in models[1]["paths"]] == paths and models[1]["lam"] == lam and models[1]["history"] == history
    monkeypatch.setattr(solvers, "MOST_NODES", 39)
    with pytest.raises(ValueError):
        solvers.path_models(x, nodes, e)


def test_candidates_and_searches():
    assert len(solvers.candidates(5, 1, 2)) == 10
    assert len(solvers.candidates(3, 2, 1)) == 3 + 3 * 2
    rng = np.random.default_rng(3)
    theta = rng.uniform(0, np.pi, (60, 3))
    y = (np.cos(theta[:, 1]) > 0).astype(int)
    train, val = np.arange(60) < 30, np.arange(60) >= 30
    scorer = solvers._Scorer(theta, y, train, val)
    paths, _, history = solvers.greedy_paths(scorer, solvers.candidates(3), 3)
    assert paths[0] == (0, 1, 0) and history[0] > 0.8
    graph = solvers.GraphTerms(np.array([(i, i + 1) for i in range(59)]), y, train)
    paths, _, _ = solvers.beam_paths(scorer, graph, solvers.candidates(3), 2, width=2, most=3, cross_every=1)
    assert (0, 1, 0) in paths and solvers.path_summary([(1, 0, 0), (0, 0, 1), (1, 0, 1)], 2) == {"feature": 1, "structural": 1, "CROSS": 1}


def test_folds_cover_all(spark):
    labels = spark.range(47).selectExpr("id AS graph_id", "cast(id % 3 AS int) AS label")
    sizes = [r["count"] for r in selection.stratified_folds(labels).groupBy("fold").count().collect()]
    assert sum(sizes) == 47 and max(sizes) - min(sizes) <= 3
    parts = selection.inner_validation(selection.stratified_folds(labels))
    assert parts.count() == 470 and parts.where("part = 'val'").groupBy("fold").count().agg({"count": "min"}).first()[0] >= 1


def test_wilcoxon(spark):
    assert statistics.exact_p([float(i) for i in range(1, 11)], 0.0) == pytest.approx(2 / 1024)
    pairs = spark.createDataFrame([("x", i, 1.0 + i, 0.5) for i in range(10)] + [("y", i, 1.0, 1.0) for i in range(10)], "dataset string, fold int, a double, b double")
    out = {r["dataset"]: r for r in statistics.wilcoxon(pairs).collect()}
    assert out["x"]["result"] == "a" and out["y"]["p"] == 1.0
    sums = {r["dataset"]: r for r in statistics.signed_rank_sums(pairs).collect()}
    assert sums["x"]["w_plus"] == 55 and sums["y"]["n"] == 0


def test_text_reader_and_results(spark, tmp_path):
    (tmp_path / "T_A.txt").write_text("1, 2\n2, 1\n2, 3\n4, 5\n5, 5\n")
    (tmp_path / "T_graph_indicator.txt").write_text("1\n1\n1\n2\n2\n")
    (tmp_path / "T_graph_labels.txt").write_text("1\n-1\n")
    (tmp_path / "T_node_labels.txt").write_text("0\n3\n0\n1\n1\n")
    graphs, nodes, e = tu.load(spark, str(tmp_path), "T")
    assert sorted(map(tuple, graphs.collect())) == [(1, 1), (2, 0)]
    assert sorted(map(tuple, e.collect())) == [(1, 1, 2), (1, 2, 3), (2, 4, 5)]
    s = tu.statistics(graphs, nodes, e).first()
    assert (s["n_graphs"], s["avg_nodes"], s["avg_edges"], s["has_features"]) == (2, 2.5, 1.5, True)
    assert sorted(r[0] for r in nodes.select(tu.node_label(nodes["feat"])).collect()) == [0, 0, 1, 1, 3]
    scores = spark.createDataFrame([("a", "m", 0, 0.5), ("a", "m", 1, 0.7)], "dataset string, method string, fold int, acc double")
    results.save_folds(scores, str(tmp_path / "folds"))
    loaded = results.load_folds(spark, str(tmp_path / "folds"))
    assert results.fold_summary(loaded).first()["mean"] == pytest.approx(0.6)
    assert results.results_table(loaded, ["m"]).first()["m"] == pytest.approx(0.6)
    results.save_csv(loaded, str(tmp_path / "csv"))
    assert results.load_csv(spark, str(tmp_path / "csv"), "dataset string, method string, fold int, acc double").count() == 2


@pytest.fixture(scope="module")
def small_graph(spark):
    """Two classes of nodes, joined within, with features that tell them apart."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(1.0 if i % 2 else -1.0, 0.7, 4)], i % 2, ("train", "train", "val", "test")[i // 2 % 4]) for i in range(32)]
    pairs = {(i, (i + d) % 32) for i in range(32) for d in (2, 4)}
    nodes = spark.createDataFrame(rows, "node long, x array<double>, y int, split string")
    return pipelines.Graph(nodes, spark.createDataFrame(sorted(pairs | {(b, a) for a, b in pairs}), "src long, dst long"))


def test_grid_and_configurations(small_graph):
    import inspect

    grid = inspect.signature(spreading.select_settings).parameters
    assert (grid["alphas"].default, grid["steps"].default) == ((0.2, 0.5, 0.8), (10, 50))
    assert inspect.signature(pipelines.run_kernel).parameters["steps"].default == (10, 50, 100)
    assert len(pipelines.KERNEL_MODES) == 17 and pipelines.COLLECTIONS["MUTAG"]["steps"] == 8
    with pytest.raises(ValueError, match="unknown mode"):
        pipelines.run(small_graph, "no_such_mode")


@pytest.mark.parametrize(
    "run",
    [
        lambda g: pipelines.run_kernel(g, smooth=True, steps=(2,)),
        lambda g: pipelines.run_mlp(g, smooth=True),
        lambda g: pipelines.run_rbf(g, alphas=(0.15,), sigmas=(1.0, None), lappe=False, smooth=True),
        lambda g: pipelines.run_layers(g, 2, lappe=False),
        lambda g: pipelines.run_layers(g, 3, stops=True, lappe=False),
        lambda g: pipelines.run_alpha_sweep(g, (0.15, 0.4), lappe=False, smooth=True),
        lambda g: pipelines.run_adaptive(g, (0.0, 0.5), lappe=False, smooth=True),
        lambda g: pipelines.run_combined(g, (0.0, 1.0), lappe=True, smooth=True),
        lambda g: pipelines.run_label_kernel(g, (1.0,), lappe=False, smooth=True),
    ],
)
def test_modes(small_graph, monkeypatch, run):
    """The best of the runs scores the classes well; what is corrected and smoothed comes last."""
    monkeypatch.setattr(spreading, "select_settings", lambda scores, edges, nodes, **grid: ({"alpha_correct": 0.2, "alpha_smooth": 0.2, "steps": 2}, 0.5))
    found = run(small_graph)
    every = found if isinstance(found, list) else [found]
    assert max(r["accuracy"] for r in every) >= 0.75 and not any("scores" in r for r in every)
    if isinstance(found, list):
        assert [r["method"].endswith("_cs") for r in found] == [False] * (len(found) - 1) + [True]


def test_angles_of_layers(small_graph):
    """The polynomial and the Laplacian encoding are options of the layered angles."""
    x, start = pipelines.angles(small_graph, "multilayer", layers_by_ppr=False, layers_lappe=True, lap_k=2)
    assert start == 12 and x.agg({"dim": "max"}).first()[0] == 13


def test_component_counts(spark):
    nodes = spark.createDataFrame([(g, n) for g in (1, 2) for n in range(6)], "graph_id long, node_id long")
    subgraphs = spark.createDataFrame([(1, 0, 0, 1), (1, 0, 1, 2), (1, 1, 0, 5), (1, 1, 1, 2), (1, 1, 2, 5), (1, 1, 3, 4), (2, 0, 0, 1)], "graph_id long, step int, u long, v long")
    assert {tuple(r) for r in topology.component_counts(nodes, subgraphs).collect()} == {(1, 0, 4), (1, 1, 2), (2, 0, 5)}


def test_rows_that_grow_are_never_broadcast(spark):
    """Numbered events take few bytes as files, and many as a hash table on the driver."""
    from weft.sources.storage import settle

    pairs = [(g, a, b) for g in (1, 2) for a, b in COMPLETE(4)]
    nodes = settle(spark.createDataFrame([(g, i, i % 2) for g in (1, 2) for i in range(4)], "graph_id long, node_id long, label long"))
    e = settle(spark.createDataFrame(pairs, "graph_id long, u long, v long"))
    _, b2 = topology.weighted_boundaries(e, enc.node_weights(nodes, "label_index"))
    valued = topology.degree_values(e)
    euler = topology.euler_by_step(nodes, settle(valued), topology.thresholds(settle(valued), 3, 0.1))
    for df in (b2, valued, euler):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert b2.count() == 24 and {(r["n_edges"], r["n_triangles"], r["euler"]) for r in euler.where("step = 2").collect()} == {(6, 4, 2)}


def test_ridge_by_strips(monkeypatch):
    """Half a matrix is held, and what it solves is as of the whole one, if it isn't positive, too."""
    import tracemalloc

    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 5))
    k = x @ x.T
    diagonal, right = np.where(np.arange(700) % 50, 0.3, -0.2), rng.normal(size=(700, 2))
    monkeypatch.setattr(solvers, "STRIP_ROWS", 64)
    tracemalloc.start()
    matrix = solvers.Factored(lambda start, end: x[start:end] @ x[:end].T, diagonal)
    held, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 0.62 * k.nbytes and most < 0.8 * k.nbytes
    assert np.allclose(matrix.solve(right), np.linalg.solve(k + np.diag(diagonal), right))


def test_folds_of_vectors_are_tasks_by_lambda(spark):
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(60, 3)), np.arange(60) % 2
    x[:, 0] += y
    vectors = spark.createDataFrame([(10 + i, [float(v) for v in row]) for i, row in enumerate(x)], "graph_id long, vector array<double>")
    labels = spark.createDataFrame([(10 + i, int(v)) for i, v in enumerate(y)], "graph_id long, label int")
    found = pipelines.cross_validated(vectors, labels, 5)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()
    parts = selection.inner_validation(selection.stratified_folds(labels, 5), 5).toPandas()
    for r in found.collect():
        own = parts[parts["fold"] == r["fold"]].sort_values("graph_id")["part"].to_numpy()
        train, val, test = own == "train", own == "val", own == "test"
        theta = np.arccos(np.tanh(np.clip((x - x[train].mean(0)) / x[train].std(0), -10, 10)))
        unit = theta / np.linalg.norm(theta, axis=1, keepdims=True)
        c = np.clip(unit @ unit[train].T, -1 + 1e-7, 1 - 1e-7)
        k = (np.sin(np.arccos(c)) + (np.pi - np.arccos(c)) * c) / np.pi
        hits = [(k @ np.linalg.solve(k[train] + lam * np.eye(train.sum()), np.stack([1 - y, y], 1)[train])).argmax(1) == y for lam in solvers.LAMBDAS]
        best = max(range(len(hits)), key=lambda n: (hits[n][val].mean(), -n))
        assert r["acc"] == hits[best][test].mean()


def test_subtree_folds_without_rows_of_pairs(spark, monkeypatch):
    rng = np.random.default_rng(10)
    n = spark.createDataFrame([(3 * g, i, int(rng.integers(0, 2 + g % 2))) for g in range(30) for i in range(1, 6)], "graph_id long, node_id long, label long")
    e = spark.createDataFrame([(3 * g, i, i + 1) for g in range(30) for i in range(1, 5)], "graph_id long, u long, v long")
    monkeypatch.setattr(kernels, "WL_ROWS", 7)
    want = {(r["i"], r["j"]): r["k"] for r in kernels.wl_gram(n, e, 2).collect()}
    ids, packed = kernels.wl_matrix(n, e, 2)
    k, every = packed.between(np.arange(30), np.arange(30)), np.arange(30)
    assert ids.tolist() == [3 * g for g in range(30)] and {(ids[i], ids[j]): k[i, j] for i in every for j in every if k[i, j]} == want
    monkeypatch.setattr(kernels, "wl_gram", None)
    labels = spark.createDataFrame([(3 * g, g % 2) for g in range(30)], "graph_id long, label int")
    found = {r["fold"]: r["acc"] for r in pipelines.wl_folds(n, e, labels, 2, 3).collect()}
    parts = selection.inner_validation(selection.stratified_folds(labels, 3), 3).toPandas()
    for fold, acc in found.items():
        own = parts[parts["fold"] == fold].sort_values("graph_id")["part"].to_numpy()
        train, target = own == "train", np.stack([1 - every % 2, every % 2], 1)
        hits = [(k[:, train] @ np.linalg.solve(k[np.ix_(train, train)] + lam * np.eye(train.sum()), target[train])).argmax(1) == every % 2 for lam in solvers.LAMBDAS]
        best = max(range(len(hits)), key=lambda n: (hits[n][own == "val"].mean(), -n))
        assert acc == pytest.approx(hits[best][own == "test"].mean())
    assert len(found) == 3


def test_diffusion_by_rows_and_by_tables(spark, monkeypatch):
    nodes = spark.range(12).selectExpr("id AS node")
    p = sparse.transition(_edges(spark, [*CYCLE(7), (0, 3), (7, 8), (8, 9)]))  # 10 and 11 have no edges
    rng = np.random.default_rng(12)
    x = spark.createDataFrame([(n, d, float(rng.normal())) for n in range(12) for d in range(3)], "node long, dim int, val double")
    read = lambda df: {(r["node"], r["dim"]): r["val"] for r in df.collect()}
    monkeypatch.setattr(sparse, "AT_ONCE", 100)
    cases = [(lambda held: [0.5, 0.25, 0.125], None, sparse.diffusion(p, 3)), (lambda held: sparse.ppr_weights(held, 0.3, 30, 1e-4), 0.04, sparse.ppr(p, 0.3, 30, 1e-4, 0.04))]
    for weights, floor, m in cases:
        got, want = read(sparse.plus_powers(x, p, weights, floor)), read(sparse.plus_diffused(x, m))
        assert got.keys() == want.keys() and len(got) == 36 and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in got)
    assert sparse.plus_powers(x.where("node <> 3 OR dim <> 1"), p, cases[0][0]) is None
    assert nodes.count() == 12


def test_kernel_run_without_rows_of_pairs(small_graph, monkeypatch):
    from weft.plans.pipelines import ppr_kernel

    model = solvers.KernelRidge(gamma=0.5).fit(kernel := ppr_kernel(small_graph), small_graph.nodes, sparse.degrees(small_graph.edges))
    accuracy = selection.accuracy(model.scores(kernel), small_graph.nodes.where("split = 'test'").select("node", "y")).first()["accuracy"]
    monkeypatch.setattr(kernels, "dots", None)
    monkeypatch.setattr(sparse, "spmm", None)
    monkeypatch.setattr(sparse, "matmul", None)
    g = pipelines.Graph(small_graph.nodes, small_graph.edges)
    run = pipelines.run_kernel(g, gamma=0.5)
    assert (run["val"], run["accuracy"]) == (model.val_accuracy, accuracy) and run["method"] == "kernel_g0.5"
    x, start = pipelines.angles(g, "rwpe", top=3)
    assert start == 3 and x.count() == 32 * 11


def test_returns_and_diffusion_without_floor(spark, monkeypatch):
    rng = np.random.default_rng(21)
    dense = np.where(rng.random((40, 40)) < 0.06, rng.random((40, 40)), 0.0)  # directed, with empty rows
    dense[7, :30] = rng.random(30)
    i, j = np.nonzero(dense)
    m, most = sparse.Matrix(np.arange(40), i, j, dense[i, j], many=5), sparse._Lists.step
    want = np.stack([np.diag(np.linalg.matrix_power(dense, k)) for k in range(1, 8)], 1)
    for form in (most, lambda self, key, value, n: most(self, key, value, 10**9), lambda self, key, value, n: None):
        monkeypatch.setattr(sparse._Lists, "step", form)
        assert np.allclose(np.concatenate([m.returns(np.arange(s, s + 10), 7) for s in range(0, 40, 10)]), want, atol=1e-12, rtol=0)
    monkeypatch.undo()
    p = sparse.transition(_edges(spark, [*CYCLE(7), (0, 3), (7, 8), (8, 9)]))
    x = spark.createDataFrame([(n, d, float(rng.normal())) for n in range(12) for d in range(5)], "node long, dim int, val double")
    table = sparse.plus_diffused(x, sparse.diffusion(p, 3))
    monkeypatch.setattr(sparse, "MOST_HELD", 30)  # p's entries are held, the 60 numbers of x aren't
    got, want = ({(r["node"], r["dim"]): r["val"] for r in df.collect()} for df in (sparse.plus_powers(x, p, lambda held: [0.5, 0.25, 0.125]), table))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in got)


def test_candidates_of_a_step_together(monkeypatch):
    rng = np.random.default_rng(4)
    theta, part = rng.uniform(0, np.pi, (90, 4)), np.arange(90) % 3
    y, pool = (np.cos(theta[:, 1]) + np.cos(theta[:, 3]) > 0).astype(float), solvers.candidates(4, 2, 1)
    scorer = solvers._Scorer(theta, y, part == 0, part == 1)
    for paths in ([], [pool[1], pool[5]]):
        got = scorer.gains(paths, pool, (1e-2, 1.0))
        for at, m in enumerate(pool):
            x = np.column_stack([np.ones(90), *[np.cos(theta @ np.array(q)) for q in [*paths, m]]])
            plain = []
            for lam in (1e-2, 1.0):
                guess = x[part == 1] @ np.linalg.solve(x[part == 0].T @ x[part == 0] + lam * np.eye(x.shape[1]), x[part == 0].T @ y[part == 0])
                hit, truth = guess > np.median(guess), y[part == 1]
                plain.append((hit[truth == 1].mean() + (~hit[truth == 0]).mean()) / 2)
            assert got[0][at] == pytest.approx(max(plain)) and got[1][at] == (1e-2, 1.0)[int(np.argmax(plain))]
    whole = solvers.greedy_paths(scorer, pool, 4)
    monkeypatch.setattr(solvers, "WAVES_HELD", 100)
    monkeypatch.setattr(solvers, "WAVES_AT_ONCE", 130)
    assert solvers.greedy_paths(solvers._Scorer(theta, y, part == 0, part == 1), pool, 4) == whole
    monkeypatch.undo()
    made, wave = [], solvers._Scorer.wave
    monkeypatch.setattr(solvers._Scorer, "wave", lambda self, m: made.append(m) or wave(self, m))
    edges = np.array([(i, i + 1) for i in range(89)])
    solvers.beam_paths(solvers._Scorer(theta, y, part == 0, part == 1), solvers.GraphTerms(edges, y, part == 0), pool, 2, most=5)
    assert len(made) <= 2 * len(pool)  # not once for each beam and step


def test_nearest_in_blocks_takes_ties_by_id():
    import pandas as pd

    from weft.operators import neighbours

    rng = np.random.default_rng(6)
    x = np.concatenate([rng.integers(0, 3, (30, 2)) / 2, [[1.0, 1.0 + 1e-8], [np.nan, 0.0]]])
    ids = rng.permutation(32)
    left, right = pd.DataFrame({"node": ids, "x": list(x)}), pd.DataFrame({"other": ids, "y": list(x)})
    for k in (1, 4, 40):
        got = neighbours._block(k)(left, right)
        for at, node in enumerate(ids):
            score = np.round(x @ x[at], 6)
            want = sorted((-s, o) for s, o in zip(score, ids, strict=True) if o != node and np.isfinite(s))[:k]
            assert [(-r.score, r.neighbour) for r in got[got["node"] == node].itertuples()] == want


@pytest.mark.parametrize(("query", "degrees"), [("arccos_kernel_deg0", {0: 1.0}), ("combined_kernel", {1: 1.0, 2: 0.5}), ("arccos_kernel_deg1", {1: 1.0}), ("arccos_kernel_deg2", {2: 1.0})])
def test_kernels_leave_their_tasks_rounded(spark, monkeypatch, query, degrees):
    """Dot products and norms are no rows, and neither angles nor decimals are worked a row a pair."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(17, 3))
    rows = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "node long, x array<double>")
    want = {(r["i"], r["j"]): r["k"] for r in kernels.arc_cosines(kernels.dots(rows), degrees).collect()}
    monkeypatch.setattr(kernels, "dots", None)
    monkeypatch.setattr(kernels, "AT_ONCE", 13)
    monkeypatch.setattr(catalog.fx, "gnodes", lambda s, d: rows)
    found = catalog.QUERIES[query](spark, "")
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "acos" not in plan and "round" not in plan
    digits = 5 if 0 in degrees else 6
    got = {(r["i"], r["j"]): r["k"] for r in found.collect()}
    assert got.keys() == want.keys() and len(got) == 17 * 17 and all(abs(got[p] - want[p]) < 0.51 * 10.0**-digits and got[p] == round(got[p], digits) for p in got)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 41])
def test_median_distance_without_rows_of_pairs(spark, monkeypatch, n):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(n, 3))
    x[n // 2 + 1 :] = x[: n - n // 2 - 1]  # copies, whose distance doesn't count
    rows = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "node long, x array<double>")
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    d[d < 1e-9] = 0.0
    middle = np.median(d[d > 0]) if (d > 0).any() else None
    packed = kernels.pack(rows, 3)
    for few, first, bits in ((100_000, 44, 16), (2, 58, 3), (0, 50, 10)):
        found = kernels.middle_distance(packed, 3, few, first, bits)
        assert found == (middle if middle is None else pytest.approx(middle, rel=1e-9))
    monkeypatch.setattr(kernels, "dots", None)
    monkeypatch.setattr(catalog.fx, "gnodes", lambda s, d: rows)
    found = {(r["i"], r["j"]): r["k"] for r in catalog.rbf_kernel_median(spark, "").collect()}
    assert len(found) == n * n and all(k == pytest.approx(np.exp(-d[p] / 2 / (middle or 1.0)), abs=6e-7) for p, k in found.items())


def test_factored_in_files(monkeypatch):
    monkeypatch.setattr(solvers, "MOST_TRAIN", 50)
    monkeypatch.setattr(solvers, "STRIP_ROWS", 16)
    rng = np.random.default_rng(14)
    x, right = rng.normal(size=(70, 5)), rng.normal(size=(70, 2))
    matrix = solvers.Factored(lambda start, end: x[start:end] @ x[:end].T, np.full(70, 0.3))
    folder = Path(matrix.low.folder.name)
    assert len(list(folder.iterdir())) == 5 and np.allclose(matrix.solve(right), np.linalg.solve(x @ x.T + 0.3 * np.eye(70), right))
    del matrix
    assert not folder.exists()


def test_equal_rows_are_solved_as_one(spark):
    rng = np.random.default_rng(15)
    x, same, y = rng.normal(size=(12, 3)), rng.integers(0, 12, 40), rng.integers(0, 3, 40)
    parts, weights = rng.integers(1, 4, (2, 40)), rng.uniform(0.5, 2.0, 40)
    got, want = ({(r["fold"], r["n"]): (r["val"], r["test"], np.frombuffer(r["scores"])) for r in solvers.ridge_runs(spark, solvers.ScaledArcCosine(rows), y, parts, (1e-3, 1.0), weights, True, s).collect()} for rows, s in ((x, same), (x[same], None)))
    assert got.keys() == want.keys() and len(got) == 4
    for k in got:
        assert got[k][:2] == want[k][:2] and np.allclose(got[k][2], want[k][2], atol=1e-6)


def test_folds_of_more_graphs_than_a_gram_matrix_may_have(spark, monkeypatch):
    """These raised; graphs that are alike are worked once."""
    rng = np.random.default_rng(16)
    kinds = [[int(rng.integers(0, 2 + g % 2)) for _ in range(5)] for g in range(8)]
    n = spark.createDataFrame([(3 * g, i, kinds[g % 8][i - 1]) for g in range(40) for i in range(1, 6)], "graph_id long, node_id long, label long")
    e = spark.createDataFrame([(3 * g, i, j) for g in range(40) for i in range(1, 5) for j in ((i + 1,) if i > 1 + g % 2 else (i + 1, i + 2)) if j < 6], "graph_id long, u long, v long")
    labels = spark.createDataFrame([(3 * g, g % 2) for g in range(40)], "graph_id long, label int")
    monkeypatch.setattr(solvers, "MOST_TRAIN", 10)
    alike = {r["graph_id"]: r["own"] for r in topology.alike(n, e).collect()}
    shapes = {g: (tuple(kinds[g % 8]), g % 2) for g in range(40)}
    assert alike == {3 * g: 3 * min(h for h in range(40) if shapes[h] == shapes[g]) for g in range(40)}
    read = lambda df: {r["fold"]: r["acc"] for r in df.collect()}
    vectors = topology.phs_vectors(n, e, modes=("degree", "label"), steps=3, k0=2, k1=2)
    assert read(pipelines.phs_folds(n, e, labels, ("degree", "label"), 3, 2, 4)) == read(pipelines.cross_validated(vectors, labels, 4))
    ids, gram = kernels.wl_matrix(n, e, 2)
    y, parts = pipelines._folds(labels, ids, 4)
    assert read(pipelines.wl_folds(n, e, labels, 2, 4)) == read(pipelines._fold_scores(solvers.ridge_runs(spark, gram, y, parts), "events", "wl"))


def test_powers_hold_few_arrays(monkeypatch):
    monkeypatch.setattr(sparse, "IN_CACHE", 900)
    rng = np.random.default_rng(17)
    n, rows = 3000, np.arange(40)
    i, j = rng.integers(0, n, (2, 9 * n))
    j[:500] = 7  # a wide column
    i, j = np.divmod(np.unique((i * n + j)[j != 5]), n)  # and an empty one
    v = 1.0 / np.bincount(i, minlength=n)[i]
    m = sparse.Matrix(np.arange(n), i, j, v)
    tracemalloc.start()
    found = sparse._sums(m, rows, [0.5, 0.3, 0.2])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4.6 * found.nbytes
    dense = np.zeros((n, n))
    dense[i, j] = v
    one = dense[rows]
    two = one @ dense
    want = 0.5 * one + 0.3 * two + 0.2 * two @ dense
    want[rows, rows] = 0.0
    assert np.allclose(found.T, want, atol=1e-14)


def test_eigenpairs_take_few_products(monkeypatch):
    """Products with all vectors at once, an entry's two directions as one, and filters as long as the spectrum asks for: a long path has tiny eigenvalues."""
    n, calls = 1200, []
    i = np.arange(n - 1)
    d = np.full(n, 2.0)
    d[[0, -1]] = 1.0
    a, b, v = np.concatenate([i, i + 1, np.arange(n)]), np.concatenate([i + 1, i, np.arange(n)]), np.concatenate([-np.ones(2 * n - 2), d])
    times = sparse.Matrix.times
    monkeypatch.setattr(sparse.Matrix, "times", lambda self, x, out: (calls.append((self.entries, x.shape[1])), times(self, x, out))[1])
    values, vectors = enc.least_eigenpairs(n, np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([v, v]) / 2, 4)
    assert np.allclose(values, 2 - 2 * np.cos(np.pi * np.arange(4) / n), atol=1e-9) and np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-8)
    assert set(calls) == {(3 * n - 2, 16)} and len(calls) < 4000


def test_kernel_run_of_more_nodes_than_a_gram_matrix_may_have(small_graph, monkeypatch):
    monkeypatch.setattr(solvers, "MOST_TRAIN", 3)  # raised before
    run = pipelines.run_kernel(small_graph)
    assert 0 <= run["val"] <= 1 and 0 <= run["accuracy"] <= 1
