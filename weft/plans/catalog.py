"""Queries over the test tables, with the SQL that each must agree with.

Doubles are rounded to six digits on both sides, as sums may be taken in any order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import scaling as sc
from weft.operators import encodings as enc
from weft.operators import kernels, neighbours, selection, solvers, sparse, spreading, statistics, topology
from weft.sources import fixtures as fx
from weft.sources.storage import settle, table

from . import pipelines as pl

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

NODE_CTE = """
emb AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS e, label FROM embeddings),
pairs AS (SELECT a.vec_id u, b.vec_id v, round(list_dot_product(a.e, b.e), 6) s FROM emb a JOIN emb b ON a.vec_id <> b.vec_id),
knn AS (SELECT u, v, s FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY s DESC, v) r FROM pairs) WHERE r <= 5),
ge AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT u src, v dst FROM knn UNION ALL SELECT v, u FROM knn)),
gn AS (SELECT vec_id node, e, label y, CASE WHEN vec_id % 10 < 4 THEN 'train' WHEN vec_id % 10 < 6 THEN 'val' ELSE 'test' END split FROM emb),
f AS (SELECT node, unnest(range(0, len(e))) AS dim, unnest(e) AS val FROM gn),
deg AS (SELECT src, count(*) d FROM ge GROUP BY src),
p AS MATERIALIZED (SELECT ge.src i, ge.dst j, 1.0::DOUBLE / d v FROM ge JOIN deg USING (src)),
p2 AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) v FROM p a JOIN p b ON a.j = b.i GROUP BY a.i, b.j),
med AS (SELECT dim, median(val) m FROM f JOIN gn USING (node) WHERE split = 'train' GROUP BY dim),
mad AS (SELECT dim, any_value(m) m, median(abs(val - m)) a FROM f JOIN gn USING (node) JOIN med USING (dim) WHERE split = 'train' GROUP BY dim),
rt AS (SELECT node, dim, tanh((val - m) / (a + 1e-8)) val FROM f JOIN mad USING (dim)),
ang AS MATERIALIZED (SELECT node, dim, acos(greatest(-1 + 1e-7, least(1 - 1e-7, val))) val FROM rt),
ohot AS (SELECT node, c AS class, (y = c)::INT::DOUBLE val FROM gn CROSS JOIN (SELECT DISTINCT y c FROM gn) WHERE split = 'train'),
loops AS (SELECT src, dst FROM ge UNION ALL SELECT node, node FROM gn),
ld AS (SELECT src, count(*)::DOUBLE d FROM loops GROUP BY src),
adj AS MATERIALIZED (SELECT l.src i, l.dst j, 1 / sqrt(a.d * b.d) v FROM loops l JOIN ld a ON l.src = a.src JOIN ld b ON l.dst = b.src)"""

EVENT_CTE = """
kinds AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS label FROM (SELECT DISTINCT event_type FROM events)),
en AS MATERIALIZED (SELECT user_id AS graph_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS node_id, label FROM events JOIN kinds USING (event_type)),
ee AS MATERIALIZED (SELECT DISTINCT graph_id, u, v FROM (
  SELECT graph_id, node_id u, lead(node_id) OVER (PARTITION BY graph_id ORDER BY node_id) v FROM en
  UNION ALL SELECT graph_id, node_id, lead(node_id) OVER (PARTITION BY graph_id, label ORDER BY node_id) FROM en) WHERE v IS NOT NULL),
both_ends AS (SELECT graph_id, u a, v b FROM ee UNION ALL SELECT graph_id, v, u FROM ee),
edeg AS (SELECT graph_id, a node_id, count(*) d FROM both_ends GROUP BY graph_id, a),
tri AS MATERIALIZED (SELECT x.graph_id, x.u a, x.v b, y.v c FROM ee x JOIN ee y ON x.graph_id = y.graph_id AND x.v = y.u JOIN ee z ON z.graph_id = x.graph_id AND z.u = x.u AND z.v = y.v),
dv AS MATERIALIZED (SELECT e.graph_id, e.u, e.v, (a.d + b.d) / 2.0::DOUBLE AS value FROM ee e JOIN edeg a ON a.graph_id = e.graph_id AND a.node_id = e.u JOIN edeg b ON b.graph_id = e.graph_id AND b.node_id = e.v),
rng AS (SELECT graph_id, CASE WHEN max(value) - min(value) < 1e-10 THEN min(value) - 0.1 ELSE min(value) END lo, CASE WHEN max(value) - min(value) < 1e-10 THEN max(value) + 0.1 ELSE max(value) END hi FROM dv GROUP BY graph_id),
steps AS MATERIALIZED (SELECT graph_id, step, CASE WHEN step = 9 THEN hi ELSE lo + step * ((hi - lo) / 9) END tau FROM rng CROSS JOIN (SELECT unnest(range(0, 10)) AS step)),
np AS (SELECT graph_id, count(*) FILTER (label = 2) n FROM en GROUP BY graph_id),
gl AS (SELECT graph_id, (n > (SELECT median(n) FROM np))::INT AS label FROM np)"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


#: Added before rounding where values are short decimals that end in 5: else the order of a sum decides.
NUDGE = 1.3e-10


def _nudged(df: DataFrame, c: str = "v") -> DataFrame:
    return df.withColumn(c, F.col(c) + NUDGE)


def query(sql: str | None = None, cte: str = "", rounded: bool = False):
    """rounded: the query rounds by itself, as decimals a row are slow where there is a row a pair."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f if rounded else lambda spark, sf_dir: _rounded(f(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {cte.strip()}\n{sql}" if cte else sql
        return f

    return keep


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(fx.gedges(spark, sf_dir), "edges")


def _f(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.features(fx.gnodes(spark, sf_dir))


def _classes(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("y").alias("class")).distinct()


def _train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.gnodes(spark, sf_dir).where("split = 'train'").select("node")


# --- sources and splits


@query("SELECT u AS node, v AS neighbour, s AS score FROM knn", NODE_CTE)
def topk_knn(s, d):
    return neighbours.nearest(fx.gnodes(s, d).select("node", "x"), 5)


@query("SELECT graph_id, node_id, label FROM en", EVENT_CTE)
def event_nodes(s, d):
    return fx.event_nodes(s, d)


@query("SELECT graph_id, u, v FROM ee", EVENT_CTE)
def event_edges(s, d):
    return fx.event_edges(fx.event_nodes(s, d))


@query("SELECT count(*) AS n_graphs, count(DISTINCT l.label) AS n_classes, round(avg(n.n), 6) AS avg_nodes, round(avg(e.e), 6) AS avg_edges, false AS has_features FROM gl l JOIN (SELECT graph_id, count(*) n FROM en GROUP BY 1) n USING (graph_id) JOIN (SELECT graph_id, count(*) e FROM ee GROUP BY 1) e USING (graph_id)", EVENT_CTE)
def dataset_statistics(s, d):
    from weft.sources.tu import statistics as stats

    n = settle(fx.event_nodes(s, d), "nodes")
    return stats(fx.graph_labels(n), n.withColumn("feat", F.lit(None).cast("array<double>")), fx.event_edges(n))


@query("SELECT label, fold, count(*) AS n FROM (SELECT label, (row_number() OVER (PARTITION BY label ORDER BY graph_id) - 1) % 10 AS fold FROM gl) GROUP BY label, fold", EVENT_CTE)
def kfold_sizes(s, d):
    return selection.stratified_folds(fx.graph_labels(fx.event_nodes(s, d))).groupBy("label", F.col("fold").cast("long").alias("fold")).agg(F.count("*").alias("n"))


@query("SELECT split, count(*) AS n FROM (SELECT CASE WHEN r <= 20 THEN 'train' WHEN row_number() OVER (PARTITION BY r <= 20 ORDER BY vec_id) <= 100 THEN 'val' ELSE 'test' END split FROM (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) r FROM embeddings)) GROUP BY split")
def class_split_sizes(s, d):
    return selection.class_split(fx.gnodes(s, d), 20, 100).groupBy("split").agg(F.count("*").alias("n"))


@query(
    "SELECT * FROM (SELECT fold::INT AS fold, 'test' AS part, n FROM fs UNION ALL SELECT fold::INT, 'val', v FROM iv UNION ALL SELECT fold::INT, 'train', rest - v FROM iv) WHERE n > 0",
    EVENT_CTE
    + """, fs AS (SELECT fold, count(r) n FROM (SELECT unnest(range(0, 10)) AS fold) LEFT JOIN (SELECT row_number() OVER (PARTITION BY label ORDER BY graph_id) - 1 AS r FROM gl) ON r % 10 = fold GROUP BY fold),
iv AS (SELECT fold, (SELECT count(*) FROM gl) - n AS rest, greatest(1, floor(((SELECT count(*) FROM gl) - n) / 10))::BIGINT AS v FROM fs)""",
)
def inner_validation_sizes(s, d):
    return selection.inner_validation(selection.stratified_folds(fx.graph_labels(fx.event_nodes(s, d)))).groupBy("fold", "part").agg(F.count("*").alias("n"))


# --- sparse algebra


@query("SELECT i, j, round(v, 6) AS v FROM p", NODE_CTE)
def transition_matrix(s, d):
    return sparse.transition(_edges(s, d))


@query("SELECT i, j, round(sum(v) + 1.3e-10, 6) AS v FROM (SELECT i, j, 0.5 * v v FROM p UNION ALL SELECT i, j, 0.25 * v FROM p2) WHERE i <> j GROUP BY i, j", NODE_CTE)
def poly_diffusion_k2(s, d):
    return _nudged(sparse.diffusion(sparse.transition(_edges(s, d)), 2, 0.5))


@query(
    "SELECT i, j, round(0.15 * sum(v) + 1.3e-10, 6) AS v FROM (SELECT i, j, 0.85 * v v FROM p UNION ALL SELECT i, j, 0.85 ** 2 * v FROM p2 UNION ALL SELECT i, j, 0.85 ** 3 * v FROM p3) WHERE i <> j GROUP BY i, j",
    NODE_CTE + ", p3 AS (SELECT a.i, b.j, sum(a.v * b.v) v FROM p2 a JOIN p b ON a.j = b.i GROUP BY a.i, b.j)",
)
def ppr_3_terms(s, d):
    return _nudged(sparse.ppr_terms(sparse.transition(_edges(s, d)), 3))


PPR_CTE = NODE_CTE + "".join(f", q{n} AS MATERIALIZED (" + ("SELECT * FROM p" if n == 1 else f"SELECT a.i, b.j, sum(a.v * b.v) v FROM q{n - 1} a JOIN p b ON a.j = b.i GROUP BY a.i, b.j") + ")" for n in range(1, 30))
PPR_CTE += ", last AS (SELECT coalesce(min(n), 29) m FROM (" + " UNION ALL ".join(f"SELECT {n} n, max(v) * {0.15 * 0.85**n!r} t FROM q{n}" for n in range(2, 30)) + ") WHERE t < 1e-5)"
PPR_CTE += ", terms AS (" + " UNION ALL ".join(f"SELECT {n} n, i, j, {0.15 * 0.85**n!r} * v v FROM q{n}" for n in range(1, 30)) + ")"


@query("SELECT i, j, round(sum(v), 6) AS v FROM terms, last WHERE n <= m AND i <> j GROUP BY i, j HAVING sum(v) >= 1e-4", PPR_CTE)
def ppr_full(s, d):
    return sparse.ppr(sparse.transition(_edges(s, d)))


@query("SELECT node, dim, round(val, 6) AS val FROM ang", NODE_CTE)
def angular(s, d):
    return sc.angular(sc.robust_tanh(_f(s, d), _train(s, d)))


@query("SELECT node, dim, round(val, 6) AS val FROM rt", NODE_CTE)
def robust_tanh(s, d):
    return sc.robust_tanh(_f(s, d), _train(s, d))


@query(
    "SELECT node, dim, round(sum(val), 6) AS val FROM (SELECT node, dim, val FROM ang UNION ALL SELECT i, dim, v * val FROM dif JOIN ang ON j = node) GROUP BY node, dim",
    NODE_CTE + ", dif AS MATERIALIZED (SELECT i, j, sum(v) v FROM (SELECT i, j, 0.5 * v v FROM p UNION ALL SELECT i, j, 0.25 * v FROM p2) WHERE i <> j GROUP BY i, j)",
)
def diffused_angular(s, d):
    return enc.diffused_angles(_f(s, d), settle(sparse.diffusion(sparse.transition(_edges(s, d)), 2, 0.5), "diffusion"), _train(s, d))


@query("SELECT i, j, round(v, 6) AS v FROM adj", NODE_CTE)
def norm_adj(s, d):
    return sparse.normalised_adjacency(_edges(s, d), fx.gnodes(s, d))


SPREAD_CTE = NODE_CTE + "".join(
    f", s{n} AS MATERIALIZED (SELECT node, class, sum(val) val FROM (SELECT i node, class, 0.9 * sum(v * val) val FROM adj JOIN {'ohot' if n == 1 else f's{n - 1}'} ON j = node GROUP BY i, class UNION ALL SELECT node, class, 0.1 * val FROM ohot) GROUP BY node, class)" for n in (1, 2, 3)
)


@query("SELECT node, class, round(val, 6) AS val FROM s3", SPREAD_CTE)
def label_spread_3(s, d):
    n = fx.gnodes(s, d)
    return spreading.spread(sc.one_hot(n, _classes(n)), settle(sparse.normalised_adjacency(_edges(s, d), n), "adjacency"), 0.1, 3)


@query("SELECT node, class, round(CASE WHEN t > 0 THEN val / t ELSE val END, 6) AS val FROM (SELECT *, sum(val) OVER (PARTITION BY node) t FROM s3)", SPREAD_CTE)
def label_prop_3(s, d):
    n = fx.gnodes(s, d)
    return spreading.propagate(_edges(s, d), n, _classes(n), 0.1, 3)


def _spread_sql(name: str, start: str, steps: int, alpha: float) -> str:
    return "".join(
        f", {name}{n} AS MATERIALIZED (SELECT node, class, sum(val) val FROM (SELECT i node, class, {1 - alpha} * sum(v * val) val FROM adj JOIN {start if n == 1 else f'{name}{n - 1}'} ON j = node GROUP BY i, class UNION ALL SELECT node, class, {alpha} * val FROM {start}) GROUP BY node, class)" for n in range(1, steps + 1)
    )


@query("SELECT node, class AS dim, round(acos(greatest(-1 + 1e-7, least(1 - 1e-7, 2 * CASE WHEN t > 0 THEN val / t ELSE val END - 1))), 6) AS val FROM (SELECT *, sum(val) OVER (PARTITION BY node) t FROM s3)", SPREAD_CTE)
def label_angles(s, d):
    n = fx.gnodes(s, d)
    return sc.soft_angles(spreading.propagate(_edges(s, d), n, _classes(n), 0.1, 3))


CS_CTE = (
    NODE_CTE
    + """, sc AS (SELECT node, dim AS class, val FROM f WHERE dim < 10),
sx AS (SELECT node, class, exp(val - max(val) OVER (PARTITION BY node)) e FROM sc),
sm AS MATERIALIZED (SELECT node, class, e / sum(e) OVER (PARTITION BY node) val FROM sx),
tr AS (SELECT node, class, val, (class = y)::INT::DOUBLE t FROM sm JOIN gn USING (node) WHERE split = 'train'),
fac AS (SELECT least(sum(abs(val)) / sum(abs(t - val)), 1000) k FROM tr),
er AS MATERIALIZED (SELECT node, class, (t - val) * k val FROM tr CROSS JOIN fac)"""
    + _spread_sql("c", "er", 2, 0.1)
    + """, co AS (SELECT node, class, greatest(0, sm.val + coalesce(c2.val, 0)) val FROM sm LEFT JOIN c2 USING (node, class)),
nm AS (SELECT node, class, val, sum(val) OVER (PARTITION BY node) t FROM co),
kn AS MATERIALIZED (SELECT node, class, CASE WHEN split = 'train' THEN (class = y)::INT::DOUBLE WHEN t > 0 THEN val / t ELSE val END val FROM nm JOIN gn USING (node))"""
    + _spread_sql("m", "kn", 2, 0.1)
)


@query("SELECT node, class, round(val, 6) AS val FROM m2", CS_CTE)
def correct_smooth_2(s, d):
    scores = _f(s, d).where("dim < 10").select("node", F.col("dim").alias("class"), "val")
    return spreading.correct_and_smooth(scores, _edges(s, d), fx.gnodes(s, d), steps=2)


@query("SELECT i, j, round(sum(v), 6) AS v FROM (SELECT src i, dst j, -1.0::DOUBLE v FROM ge UNION ALL SELECT src, src, d FROM deg) GROUP BY i, j", NODE_CTE)
def graph_laplacian(s, d):
    return sparse.laplacian(_edges(s, d))


@query("SELECT round(coalesce(avg((a.y = b.y)::INT::DOUBLE), 0.5), 6) AS homophily FROM ge JOIN gn a ON a.node = src JOIN gn b ON b.node = dst WHERE a.split = 'train' AND b.split = 'train'", NODE_CTE)
def homophily(s, d):
    return sparse.homophily(_edges(s, d), fx.gnodes(s, d))


WAVE_CTE = NODE_CTE + ", phi AS MATERIALIZED (SELECT node, dim, cos(val) val FROM f), df AS (SELECT a.dim, a.val - b.val x FROM ge JOIN phi a ON a.node = src JOIN phi b ON b.node = dst AND b.dim = a.dim)"


@query("SELECT dim, round(greatest(0, least(1, (SELECT sum(x * x) / 2 FROM df WHERE df.dim = q.dim) / sum(val * val) / (SELECT max(d) FROM deg))), 6) AS smoothness FROM phi q GROUP BY dim", WAVE_CTE)
def smoothness(s, d):
    return sparse.smoothness(_f(s, d).withColumn("val", F.cos("val")), _edges(s, d))


@query("SELECT dim, round(avg(abs(x)) / 2, 6) AS consistency FROM df GROUP BY dim", WAVE_CTE)
def neighbour_consistency(s, d):
    return sparse.neighbour_consistency(_f(s, d).withColumn("val", F.cos("val")), _edges(s, d))


@query(
    """SELECT dim, round(0.5 - 0.1 * (2 * h - 1) * s + 0.2 * (h * (1 - c) + (1 - h) * c), 6) AS score FROM
    (SELECT dim, greatest(0, least(1, (SELECT sum(x * x) / 2 FROM df WHERE df.dim = q.dim) / sum(val * val) / (SELECT max(d) FROM deg))) s FROM phi q GROUP BY dim) JOIN (SELECT dim, avg(abs(x)) / 2 c FROM df GROUP BY dim) USING (dim)
    CROSS JOIN (SELECT coalesce(avg((a.y = b.y)::INT::DOUBLE), 0.5) h FROM ge JOIN gn a ON a.node = src JOIN gn b ON b.node = dst WHERE a.split = 'train' AND b.split = 'train')""",
    WAVE_CTE,
)
def guided_scores(s, d):
    e, n, phi = _edges(s, d), fx.gnodes(s, d), _f(s, d).withColumn("val", F.cos("val"))
    h = sparse.homophily(e, n).first()[0]
    both = sparse.smoothness(phi, e).join(sparse.neighbour_consistency(phi, e), "dim")
    return both.select("dim", sparse.guided(F.lit(0.5), F.col("smoothness"), F.col("consistency"), h, 0.1, 0.2).alias("score"))


@query("SELECT node, dim, round(sum(val), 6) AS val FROM (SELECT node, dim, val FROM f UNION ALL SELECT src, dim, val FROM ge JOIN f ON dst = node) GROUP BY node, dim", NODE_CTE)
def neighbour_sums(s, d):
    return sparse.neighbour_sums(_edges(s, d), _f(s, d))


@query("SELECT src AS node, dim, round(avg(val), 6) AS val FROM ge JOIN f ON dst = node GROUP BY src, dim", NODE_CTE)
def neighbour_means(s, d):
    return sparse.neighbour_means(_edges(s, d), _f(s, d))


@query("SELECT src AS node, d AS degree FROM deg", NODE_CTE)
def node_degree(s, d):
    return sparse.degrees(_edges(s, d))


# --- encodings


@query("SELECT node, k AS dim, round(2 * coalesce(v, 0) - 1, 6) AS val FROM gn CROSS JOIN (SELECT unnest(range(0, 2)) AS k) LEFT JOIN (SELECT i, 0 AS kk, v FROM p WHERE i = j UNION ALL SELECT i, 1, v FROM p2 WHERE i = j) ON i = node AND kk = k", NODE_CTE)
def rwpe_k2(s, d):
    return enc.random_walk(sparse.transition(_edges(s, d)), fx.gnodes(s, d), 2).withColumn("dim", F.col("dim").cast("long"))


@query()
def lappe(s, d):
    return enc.laplacian_encoding(_edges(s, d), fx.gnodes(s, d), 4)


@query()
def lappe_iterated(s, d):
    """As lappe, whatever the vectors' signs."""
    return enc.iterated(_edges(s, d), fx.gnodes(s, d), 3).withColumn("val", 2 * F.col("val") * F.col("val") - 1)


@query()
def hks(s, d):
    return enc.heat_kernel(*enc.eigenpairs(_edges(s, d), fx.gnodes(s, d), 6), 4)


@query(
    """SELECT node, round(2 * coalesce(d, 0) / (SELECT max(d) FROM deg) - 1, 6) AS degree, round(CASE WHEN d > 1 THEN 2.0 / (d - 1) ELSE 0 END - 1, 6) AS compat,
    round(CASE WHEN d > 1 THEN 4.0 * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END - 1, 6) AS clustering FROM gn LEFT JOIN deg ON src = node LEFT JOIN ct USING (node)""",
    NODE_CTE + ", t3 AS (SELECT x.src a, x.dst b, y.dst c FROM ge x JOIN ge y ON x.dst = y.src JOIN ge z ON z.src = x.src AND z.dst = y.dst WHERE x.src < x.dst AND y.src < y.dst), ct AS (SELECT node, count(*) t FROM (SELECT a node FROM t3 UNION ALL SELECT b FROM t3 UNION ALL SELECT c FROM t3) GROUP BY node)",
)
def degree_clustering(s, d):
    return enc.degree_clustering(_edges(s, d), fx.gnodes(s, d))


def _layer_sql(n: int) -> str:
    """One more layer on the angles l<n - 1>."""
    return f""", b{n} AS MATERIALIZED (SELECT node, dim, sum(val) val FROM (SELECT i node, dim, 0.5 * sum(v * val) val FROM dif JOIN l{n - 1} ON j = node GROUP BY i, dim UNION ALL SELECT node, dim, 0.5 * val FROM l0) GROUP BY node, dim),
m{n} AS (SELECT dim, median(val) m FROM b{n} JOIN gn USING (node) WHERE split = 'train' GROUP BY dim),
d{n} AS (SELECT dim, any_value(m) m, median(abs(val - m)) a FROM b{n} JOIN gn USING (node) JOIN m{n} USING (dim) WHERE split = 'train' GROUP BY dim),
l{n} AS MATERIALIZED (SELECT node, dim, acos(greatest(-1 + 1e-7, least(1 - 1e-7, tanh((val - m) / (a + 1e-8))))) val FROM b{n} JOIN d{n} USING (dim))"""


@query(
    "SELECT node, dim, round(val, 6) AS val FROM l2",
    NODE_CTE + ", dif AS MATERIALIZED (SELECT i, j, sum(v) v FROM (SELECT i, j, 0.5 * v v FROM p UNION ALL SELECT i, j, 0.25 * v FROM p2) WHERE i <> j GROUP BY i, j), l0 AS (SELECT * FROM ang)" + _layer_sql(1) + _layer_sql(2),
)
def layered_angular(s, d):
    e = _edges(s, d)
    return enc.layered_angles(_f(s, d), settle(sparse.diffusion(sparse.transition(e), 2), "diffusion"), _train(s, d), 2)[-1]


@query("SELECT label, count(*) AS n, round(count(*) / (SELECT count(*) FROM en), 6) AS share FROM en GROUP BY label", EVENT_CTE)
def label_freq(s, d):
    return enc.label_frequencies(fx.event_nodes(s, d))


@query("SELECT graph_id, node_id, round(ln((SELECT count(*) FROM en) / n) + 1, 6) AS weight FROM en JOIN (SELECT label, count(*)::DOUBLE n FROM en GROUP BY label) USING (label)", EVENT_CTE)
def rarity_weights(s, d):
    return enc.node_weights(fx.event_nodes(s, d), "rarity")


@query("SELECT graph_id, node_id, round(sqrt((label + 1) ** 2 + node_id ** 2) + 1e-6, 6) AS weight FROM en", EVENT_CTE)
def norm_weights(s, d):
    return enc.node_weights(fx.with_features(fx.event_nodes(s, d)), "feat_norm")


@query("SELECT graph_id, node_id, CASE label WHEN 0 THEN 2.55 WHEN 1 THEN 3.04 WHEN 2 THEN 3.44 WHEN 3 THEN 3.98 ELSE 2.55 END::DOUBLE AS weight FROM en", EVENT_CTE)
def electronegativity_weights(s, d):
    return enc.node_weights(fx.event_nodes(s, d), "electronegativity", {0: "C", 1: "N", 2: "O", 3: "F"})


@query("SELECT la, lb, count(*) AS n FROM (SELECT a.label la, b.label lb FROM both_ends e JOIN en a ON a.graph_id = e.graph_id AND a.node_id = e.a JOIN en b ON b.graph_id = e.graph_id AND b.node_id = e.b) GROUP BY la, lb", EVENT_CTE)
def label_cooccurrence(s, d):
    n = fx.event_nodes(s, d)
    return enc.label_cooccurrence(n, fx.event_edges(n)).select(F.col("la").cast("long").alias("la"), F.col("lb").cast("long").alias("lb"), "n")


@query()
def label_edge_weights(s, d):
    n = settle(fx.event_nodes(s, d), "nodes")
    e = settle(fx.event_edges(n), "edges")
    return enc.edge_weights(n, e, enc.label_embedding(enc.label_cooccurrence(n, e), 2))


# --- scaling


@query("SELECT node, dim, round(greatest(-3, least(3, (val - m) / CASE WHEN sd < 1e-8 THEN 1 ELSE sd END)), 6) AS val FROM f JOIN (SELECT dim, avg(val) m, stddev_pop(val) sd FROM f JOIN gn USING (node) WHERE split = 'train' GROUP BY dim) USING (dim)", NODE_CTE)
def zscore(s, d):
    return sc.zscore(_f(s, d), _train(s, d))


@query("SELECT node, dim, round(acos(tanh(greatest(-10, least(10, val)))), 6) AS val FROM f", NODE_CTE)
def angular_graph(s, d):
    return sc.angular_tanh(_f(s, d))


@query("SELECT dim, round(max(coalesce(r, 0)), 6) AS score FROM (SELECT dim, c, abs(corr(val, (y = c)::INT)) r FROM f JOIN gn USING (node) CROSS JOIN (SELECT DISTINCT y c FROM gn WHERE split = 'train') WHERE split = 'train' GROUP BY dim, c) GROUP BY dim", NODE_CTE)
def ovr_corr(s, d):
    return sc.correlations(_f(s, d), fx.gnodes(s, d))


@query(
    "SELECT node, dim, round(val, 6) AS val FROM f JOIN (SELECT dim FROM sco ORDER BY score DESC, dim DESC LIMIT 10) USING (dim)",
    NODE_CTE + ", sco AS (SELECT dim, max(coalesce(r, 0)) score FROM (SELECT dim, c, abs(corr(val, (y = c)::INT)) r FROM f JOIN gn USING (node) CROSS JOIN (SELECT DISTINCT y c FROM gn WHERE split = 'train') WHERE split = 'train' GROUP BY dim, c) GROUP BY dim)",
)
def prescreen_top(s, d):
    return sc.prescreen(_f(s, d), fx.gnodes(s, d), 10)


@query("SELECT node, class, val FROM ohot", NODE_CTE)
def one_hot(s, d):
    n = fx.gnodes(s, d)
    return sc.one_hot(n, _classes(n))


@query("SELECT round(avg((dim = y)::INT::DOUBLE), 6) AS accuracy FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY val DESC, dim) r FROM f) JOIN gn USING (node) WHERE r = 1", NODE_CTE)
def argmax_accuracy(s, d):
    return selection.accuracy(_f(s, d).withColumnRenamed("dim", "class"), fx.gnodes(s, d))


@query("SELECT node, split FROM gn WHERE NOT EXISTS (SELECT 1 FROM gn t WHERE t.node = gn.node AND t.split = 'train')", NODE_CTE)
def remaining_nodes(s, d):
    return fx.gnodes(s, d).join(_train(s, d), "node", "left_anti").select("node", "split")


@query("SELECT dim AS setting, round(acc, 6) AS val FROM (SELECT dim, avg(((val > 0) = (y = 0))::INT::DOUBLE) acc FROM f JOIN gn USING (node) WHERE split = 'val' GROUP BY dim) ORDER BY acc DESC, dim LIMIT 1", NODE_CTE)
def best_setting(s, d):
    """The first dimension whose sign tells class 0 best."""
    hits = _f(s, d).join(fx.gnodes(s, d).where("split = 'val'").select("node", "y"), "node")
    return selection.first_best(hits.groupBy(F.col("dim").alias("setting")).agg(F.avg(((F.col("val") > 0) == (F.col("y") == 0)).cast("double")).alias("val")))


@query("SELECT node, dim, round(2 * (val - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END - 1, 6) AS val FROM f JOIN (SELECT dim, min(val) lo, max(val) hi FROM f GROUP BY dim) USING (dim)", NODE_CTE)
def minmax(s, d):
    return sc.minmax(_f(s, d))


@query("SELECT node, dim AS class, round(e / sum(e) OVER (PARTITION BY node), 6) AS val FROM (SELECT node, dim, exp(val - max(val) OVER (PARTITION BY node)) e FROM f)", NODE_CTE)
def softmax(s, d):
    return sc.softmax(_f(s, d).withColumnRenamed("dim", "class"))


@query("SELECT node, dim AS class FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY val DESC, dim) r FROM f) WHERE r = 1", NODE_CTE)
def argmax_class(s, d):
    return sc.argmax(_f(s, d).withColumnRenamed("dim", "class"))


@query("SELECT node, dim, round(CASE WHEN t > 0 THEN val / t ELSE val END, 6) AS val FROM (SELECT *, sum(abs(val)) OVER (PARTITION BY node) t FROM f)", NODE_CTE)
def l1_rows(s, d):
    return sc.l1_rows(_f(s, d))


@query("SELECT round((avg((s > m)::INT) FILTER (y = 1) + avg((s <= m)::INT) FILTER (y = 0)) / 2, 6) AS balanced_accuracy FROM (SELECT e[1] s, (label = 0)::INT y, median(e[1]) OVER () m FROM emb)", NODE_CTE)
def balanced_accuracy(s, d):
    return selection.balanced_accuracy(fx.gnodes(s, d).select(F.col("x")[0].alias("score"), (F.col("y") == 0).cast("int").alias("truth")))


@query("SELECT round(1 - sum((y - s) ** 2) / (var_pop(y) * count(*) + 1e-10), 6) AS r2 FROM (SELECT e[1] s, label::DOUBLE y FROM emb)", NODE_CTE)
def r_squared(s, d):
    return selection.r_squared(fx.gnodes(s, d).select(F.col("x")[0].alias("score"), F.col("y").cast("double").alias("truth")))


# --- topology


@query("SELECT b.graph_id, b.a AS node_id, b.b AS at, round(0.5::DOUBLE / d, 6) AS mass FROM both_ends b JOIN edeg ON edeg.graph_id = b.graph_id AND edeg.node_id = b.a UNION ALL SELECT en.graph_id, en.node_id, en.node_id, CASE WHEN d IS NULL THEN 1.0 ELSE 0.5 END FROM en LEFT JOIN edeg USING (graph_id, node_id)", EVENT_CTE)
def lazy_walk(s, d):
    n = fx.event_nodes(s, d)
    return topology.lazy_walk(n, fx.event_edges(n))


@query(
    "SELECT graph_id, a, b, min(d) AS d FROM (SELECT graph_id, node_id a, node_id b, 0 d FROM en UNION ALL SELECT graph_id, a, b, 1 FROM both_ends UNION ALL SELECT x.graph_id, x.a, y.b, 2 FROM both_ends x JOIN both_ends y ON x.graph_id = y.graph_id AND x.b = y.a) GROUP BY graph_id, a, b",
    EVENT_CTE,
)
def hops_2(s, d):
    n = settle(fx.event_nodes(s, d), "nodes")
    return topology.hops(n, settle(fx.event_edges(n), "edges"), 2).withColumn("d", F.col("d").cast("int"))


@query("SELECT graph_id, a, b, c FROM tri", EVENT_CTE)
def triangles(s, d):
    return enc.triangles(fx.event_edges(fx.event_nodes(s, d)), ("graph_id",))


@query("SELECT graph_id, u AS node, u, v, 1 AS sign FROM ee UNION ALL SELECT graph_id, v, u, v, -1 FROM ee", EVENT_CTE)
def incidence_b1(s, d):
    return topology.boundary_1(fx.event_edges(fx.event_nodes(s, d)))


@query("SELECT graph_id, a AS u, b AS v, a, b, c, 1 AS sign FROM tri UNION ALL SELECT graph_id, a, c, a, b, c, -1 FROM tri UNION ALL SELECT graph_id, b, c, a, b, c, 1 FROM tri", EVENT_CTE)
def incidence_b2(s, d):
    return topology.boundary_2(fx.event_edges(fx.event_nodes(s, d)))


@query("SELECT graph_id, a AS i, b AS j, -1 AS v FROM both_ends UNION ALL SELECT graph_id, node_id, node_id, d::INT FROM edeg", EVENT_CTE)
def l0_laplacian(s, d):
    return topology.laplacian_0(fx.event_edges(fx.event_nodes(s, d)))


B_CTE = EVENT_CTE + ", b1 AS (SELECT graph_id, u n, u, v, 1 s FROM ee UNION ALL SELECT graph_id, v, u, v, -1 FROM ee), b2 AS (SELECT graph_id, a u, b v, a, b, c, 1 s FROM tri UNION ALL SELECT graph_id, a, c, a, b, c, -1 FROM tri UNION ALL SELECT graph_id, b, c, a, b, c, 1 FROM tri)"
L1_SQL = """SELECT graph_id, u, v, u2, v2, sum(val)::BIGINT AS val FROM (
SELECT x.graph_id, x.u, x.v, y.u u2, y.v v2, x.s * y.s val FROM b1 x JOIN b1 y ON x.graph_id = y.graph_id AND x.n = y.n
UNION ALL SELECT x.graph_id, x.u, x.v, y.u, y.v, x.s * y.s FROM b2 x JOIN b2 y ON x.graph_id = y.graph_id AND x.a = y.a AND x.b = y.b AND x.c = y.c) GROUP BY ALL HAVING sum(val) <> 0"""


@query(L1_SQL, B_CTE)
def l1_laplacian(s, d):
    n = settle(fx.event_nodes(s, d), "nodes")
    return topology.laplacian_1(settle(fx.event_edges(n), "edges"))


@query("SELECT graph_id, n AS node, u, v, s AS sign, round(s * (label + 1.0::DOUBLE), 6) AS val FROM b1 JOIN en USING (graph_id) WHERE node_id = n", B_CTE)
def weighted_b1(s, d):
    n = settle(fx.event_nodes(s, d), "nodes")
    return topology.weighted_boundaries(fx.event_edges(n), enc.node_weights(n, "label_index"))[0].select("graph_id", "node", "u", "v", "sign", "val")


@query("SELECT x.graph_id, x.u, x.v, x.a, x.b, x.c, x.s AS sign, round(x.s * pow((p.label + 1.0::DOUBLE) * (q.label + 1) * (r.label + 1), 1.0::DOUBLE / 3), 6) AS val FROM b2 x JOIN en p ON p.graph_id = x.graph_id AND p.node_id = x.a JOIN en q ON q.graph_id = x.graph_id AND q.node_id = x.b JOIN en r ON r.graph_id = x.graph_id AND r.node_id = x.c", B_CTE)
def weighted_b2(s, d):
    n = settle(fx.event_nodes(s, d), "nodes")
    return topology.weighted_boundaries(fx.event_edges(n), enc.node_weights(n, "label_index"))[1].select("graph_id", "u", "v", "a", "b", "c", "sign", "val")


@query("SELECT graph_id, u, v, value FROM dv", EVENT_CTE)
def degree_values(s, d):
    return topology.degree_values(fx.event_edges(fx.event_nodes(s, d)))


@query("SELECT e.graph_id, e.u, e.v, (a.label + b.label) / 2.0::DOUBLE AS value FROM ee e JOIN en a ON a.graph_id = e.graph_id AND a.node_id = e.u JOIN en b ON b.graph_id = e.graph_id AND b.node_id = e.v", EVENT_CTE)
def label_values(s, d):
    n = fx.event_nodes(s, d)
    return topology.label_values(fx.event_edges(n), n)


@query("SELECT graph_id, u, v, a, b, c, s AS sign, round(s * pow(p.value * q.value * r.value, 1.0::DOUBLE / 3), 6) AS val FROM b2 JOIN dv p USING (graph_id) JOIN dv q USING (graph_id) JOIN dv r USING (graph_id) WHERE p.u = a AND p.v = b AND q.u = a AND q.v = c AND r.u = b AND r.v = c".replace("SELECT graph_id, u, v,", "SELECT graph_id, b2.u, b2.v,"), B_CTE)
def edge_weighted_b2(s, d):
    e = settle(fx.event_edges(fx.event_nodes(s, d)), "edges")
    return topology.edge_weighted_boundaries(e, topology.degree_values(e).withColumnRenamed("value", "weight"))[1].select("graph_id", "u", "v", "a", "b", "c", "sign", "val")


@query("SELECT graph_id, step::INT AS step, round(tau, 6) AS tau FROM steps", EVENT_CTE)
def degree_filtration_steps(s, d):
    return topology.thresholds(topology.degree_values(fx.event_edges(fx.event_nodes(s, d))), 10, 0.1)


@query("SELECT graph_id, step::INT AS step, count(*) AS n FROM steps JOIN dv USING (graph_id) WHERE value <= tau GROUP BY graph_id, step", EVENT_CTE)
def sublevel_counts(s, d):
    v = settle(topology.degree_values(fx.event_edges(fx.event_nodes(s, d))), "values")
    return topology.sublevel(v, topology.thresholds(v, 10, 0.1)).groupBy("graph_id", "step").agg(F.count("*").alias("n"))


@query(
    """SELECT graph_id, step::INT AS step, coalesce(e, 0)::BIGINT AS n_edges, coalesce(t, 0)::BIGINT AS n_triangles, n - coalesce(e, 0) + coalesce(t, 0) AS euler FROM steps JOIN (SELECT graph_id, count(*) n FROM en GROUP BY 1) USING (graph_id)
    LEFT JOIN (SELECT graph_id, step, count(*) e FROM steps JOIN dv USING (graph_id) WHERE value <= tau GROUP BY 1, 2) USING (graph_id, step)
    LEFT JOIN (SELECT graph_id, step, count(*) t FROM steps JOIN (SELECT t.graph_id, greatest(x.value, y.value, z.value) w FROM tri t JOIN dv x ON x.graph_id = t.graph_id AND x.u = a AND x.v = b JOIN dv y ON y.graph_id = t.graph_id AND y.u = a AND y.v = c JOIN dv z ON z.graph_id = t.graph_id AND z.u = b AND z.v = c) USING (graph_id) WHERE w <= tau GROUP BY 1, 2) USING (graph_id, step)""",
    EVENT_CTE,
)
def euler_char_by_step(s, d):
    n = settle(fx.event_nodes(s, d), "nodes")
    v = settle(topology.degree_values(fx.event_edges(n)), "values")
    return topology.euler_by_step(n, v, topology.thresholds(v, 10, 0.1))


def _collection(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = settle(fx.event_nodes(s, d), "nodes")
    return n, settle(fx.event_edges(n), "edges")


@query()
def ricci(s, d):
    return topology.curvature(*_collection(s, d))


@query()
def betti(s, d):
    return topology.betti_numbers(*_collection(s, d))


@query()
def phs_vectors(s, d):
    return topology.phs_vectors(*_collection(s, d), modes=("degree", "label"), steps=10)


@query()
def phs_trajectories(s, d):
    return topology.trajectories(*_collection(s, d))


@query("SELECT graph_id, n AS n_pairs, m AS n_edges FROM (SELECT graph_id, count(*) n, count(*) m FROM ee GROUP BY 1)", EVENT_CTE)
def persistence_counts(s, d):
    n, e = _collection(s, d)
    pairs = topology.persistence_pairs(n, topology.degree_values(e)).groupBy("graph_id").agg(F.count("*").alias("n_pairs"))
    return pairs.join(e.groupBy("graph_id").agg(F.count("*").alias("n_edges")), "graph_id")


@query("SELECT graph_id, count(*) AS joined FROM (SELECT graph_id, node_id FROM en QUALIFY row_number() OVER (PARTITION BY graph_id ORDER BY node_id) > 1) GROUP BY graph_id", EVENT_CTE)
def persistence_joins(s, d):
    """The chain of events joins all nodes of a graph, so one pair fewer than nodes ends a component."""
    n, e = _collection(s, d)
    return topology.persistence_pairs(n, topology.degree_values(e)).where("dim = 0").groupBy("graph_id").agg(F.count("*").alias("joined"))


@query()
def ring_means(s, d):
    n, e = _collection(s, d)
    return topology.ring_means(topology.betti_numbers(n, e), fx.graph_labels(n))


@query("SELECT e.graph_id, e.u, e.v, round((sqrt((a.label + 1) ** 2 + a.node_id ** 2) + sqrt((b.label + 1) ** 2 + b.node_id ** 2)) / 2, 6) AS value FROM ee e JOIN en a ON a.graph_id = e.graph_id AND a.node_id = e.u JOIN en b ON b.graph_id = e.graph_id AND b.node_id = e.v", EVENT_CTE)
def norm_values(s, d):
    n, e = _collection(s, d)
    return topology.norm_values(e, fx.with_features(n))


@query(
    """SELECT graph_id, step::INT AS step, n - count(*) FILTER (low < b) AS betti0 FROM (SELECT graph_id, step, b, min(a) low FROM reach GROUP BY ALL) JOIN (SELECT graph_id, count(*) n FROM en GROUP BY 1) USING (graph_id) GROUP BY graph_id, step, n""",
    EVENT_CTE.replace("\nkinds AS", "RECURSIVE\nkinds AS", 1)
    + """, sub AS MATERIALIZED (SELECT graph_id, step, u, v FROM steps JOIN dv USING (graph_id) WHERE value <= tau),
two AS MATERIALIZED (SELECT graph_id, step, u a, v b FROM sub UNION ALL SELECT graph_id, step, v, u FROM sub),
reach AS (SELECT graph_id, step, a, b FROM two UNION SELECT r.graph_id, r.step, r.a, t.b FROM reach r JOIN two t ON t.graph_id = r.graph_id AND t.step = r.step AND t.a = r.b)""",
)
def betti0_by_step(s, d):
    n, e = _collection(s, d)
    v = settle(topology.degree_values(e), "values")
    return topology.component_counts(n, topology.sublevel(v, topology.thresholds(v, 10, 0.1)))


# --- kernels and solvers

PAIR_CTE = NODE_CTE + ", kp AS (SELECT a.vec_id i, b.vec_id j, greatest(-1 + 1e-7, least(1 - 1e-7, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))))) c FROM emb a CROSS JOIN emb b)"


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return fx.gnodes(s, d).select("node", "x")


@query("SELECT i, j, round((pi() - acos(c)) / pi(), 5) AS k FROM kp", PAIR_CTE, rounded=True)
def arccos_kernel_deg0(s, d):
    return kernels.arc_cosine_gram(_vectors(s, d), {0: 1.0}, 5)


@query("SELECT i, j, round((sin(acos(c)) + (pi() - acos(c)) * c) / pi(), 6) AS k FROM kp", PAIR_CTE, rounded=True)
def arccos_kernel_deg1(s, d):
    return kernels.arc_cosine_gram(_vectors(s, d), {1: 1.0}, 6)


@query("SELECT i, j, round((3 * sin(acos(c)) * c + (pi() - acos(c)) * (1 + 2 * c * c)) / pi(), 6) AS k FROM kp", PAIR_CTE, rounded=True)
def arccos_kernel_deg2(s, d):
    return kernels.arc_cosine_gram(_vectors(s, d), {2: 1.0}, 6)


@query("SELECT i, j, round((sin(acos(c)) + (pi() - acos(c)) * c) / pi() + 0.5 * (3 * sin(acos(c)) * c + (pi() - acos(c)) * (1 + 2 * c * c)) / pi(), 6) AS k FROM kp", PAIR_CTE, rounded=True)
def combined_kernel(s, d):
    return kernels.arc_cosine_gram(_vectors(s, d), {1: 1.0, 2: 0.5}, 6)


@query("SELECT i, j, round(exp(-q / (2 * (SELECT median(q) FROM sq WHERE q > 1e-12))), 6) AS k FROM sq", NODE_CTE + ", sq AS MATERIALIZED (SELECT a.vec_id i, b.vec_id j, greatest(0, list_dot_product(a.e, a.e) + list_dot_product(b.e, b.e) - 2 * list_dot_product(a.e, b.e)) q FROM emb a CROSS JOIN emb b)", rounded=True)
def rbf_kernel_median(s, d):
    return kernels.rbf_gram(_vectors(s, d), 6)


WL_CTE = EVENT_CTE + """, w0 AS MATERIALIZED (SELECT graph_id, node_id, label::VARCHAR label FROM en),
w1 AS MATERIALIZED (SELECT w.graph_id, w.node_id, md5(w.label || '|' || coalesce(a, '')) label FROM w0 w LEFT JOIN (SELECT e.graph_id, e.a node_id, string_agg(x.label, ',' ORDER BY x.label) a FROM both_ends e JOIN w0 x ON x.graph_id = e.graph_id AND x.node_id = e.b GROUP BY 1, 2) USING (graph_id, node_id)),
w2 AS MATERIALIZED (SELECT w.graph_id, w.node_id, md5(w.label || '|' || coalesce(a, '')) label FROM w1 w LEFT JOIN (SELECT e.graph_id, e.a node_id, string_agg(x.label, ',' ORDER BY x.label) a FROM both_ends e JOIN w1 x ON x.graph_id = e.graph_id AND x.node_id = e.b GROUP BY 1, 2) USING (graph_id, node_id)),
wc AS MATERIALIZED (SELECT graph_id, 0 AS h, label, count(*) n FROM w0 GROUP BY ALL UNION ALL SELECT graph_id, 1, label, count(*) FROM w1 GROUP BY ALL UNION ALL SELECT graph_id, 2, label, count(*) FROM w2 GROUP BY ALL)"""


@query("SELECT graph_id, node_id, label FROM w1", WL_CTE)
def wl_round1(s, d):
    return kernels.wl_rounds(*_collection(s, d), 1)[1]


@query("SELECT graph_id, node_id, label FROM w2", WL_CTE)
def wl_round2(s, d):
    return kernels.wl_rounds(*_collection(s, d), 2)[2]


@query("SELECT a.graph_id AS i, b.graph_id AS j, sum(a.n * b.n)::DOUBLE AS k FROM wc a JOIN wc b ON a.h = b.h AND a.label = b.label GROUP BY 1, 2", WL_CTE)
def wl_gram(s, d):
    return kernels.wl_gram(*_collection(s, d), 2)


@query("SELECT a.dim AS a, b.dim AS b, round(sum(cos(a.val) * cos(b.val)), 6) AS v FROM f a JOIN f b USING (node) JOIN gn USING (node) WHERE split = 'train' GROUP BY 1, 2", NODE_CTE)
def ridge_normal_eq(s, d):
    design = _f(s, d).select("node", F.col("dim").alias("col"), F.cos("val").alias("val"))
    return solvers.normal_equations(design, fx.gnodes(s, d).where("split = 'train'").select("node", "y"))[0]


@query("SELECT node, dim + 1 AS col, round(cos(2 * val), 6) AS val FROM f UNION ALL SELECT node, 0, 1.0 FROM gn", NODE_CTE)
def cosine_design(s, d):
    paths = [tuple(2 * (i == j) for j in range(64)) for i in range(64)]
    return solvers.cosine_columns(_f(s, d), paths)


#: Dimensions after the prescreen and steps of a path search.
TOP, MOST = 60, 20


def _graph(s: SparkSession, d: str) -> pl.Graph:
    return pl.Graph(fx.gnodes(s, d), fx.gedges(s, d))


@query()
def krr_accuracy(s, d):
    r = pl.run_kernel(_graph(s, d))
    return s.createDataFrame([(r["method"], r["val"], r["accuracy"])], "method string, val double, accuracy double")


@query()
def beam_paths(s, d):
    g = _graph(s, d)
    x, start = pl.angles(g, "rwpe", top=TOP)
    return solvers.path_models(x, g.nodes, g.edges, struct_start=start, most=MOST).drop("history")


@query()
def greedy_paths(s, d):
    g = _graph(s, d)
    return solvers.path_models(pl.angles(g, "baseline", top=TOP)[0], g.nodes, g.edges, selection="greedy", most=MOST).drop("history")


@query()
def phs_fold_scores(s, d):
    n, e = _collection(s, d)
    return pl.phs_folds(n, e, fx.graph_labels(n), ("degree", "label"))


WILCOXON = [(f"d{k}", fold, 0.5 + ((fold * 7 + k * 3) % 10) / 20, 0.5 + ((fold * 3 + k) % 10) / 20) for k in range(3) for fold in range(10)]


@query(
    f"""WITH x AS (SELECT *, round(a - b, 9) df FROM (VALUES {", ".join(f"('{k}', {n}, {a}::DOUBLE, {b}::DOUBLE)" for k, n, a, b in WILCOXON)}) t(dataset, fold, a, b)),
r AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY abs(df)) + (count(*) OVER (PARTITION BY dataset, abs(df)) - 1) / 2 rk FROM x WHERE df <> 0)
SELECT dataset, any_value(n) AS n, any_value(p) AS w_plus, any_value(q) AS w_minus, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b FROM x JOIN (SELECT dataset, count(*) n, coalesce(sum(rk) FILTER (df > 0), 0)::DOUBLE p, coalesce(sum(rk) FILTER (df < 0), 0)::DOUBLE q FROM r GROUP BY dataset) USING (dataset) GROUP BY dataset"""
)
def rank_wilcoxon(s, d):
    return statistics.signed_rank_sums(s.createDataFrame(WILCOXON, "dataset string, fold int, a double, b double"))


@query(f"""SELECT dataset, 'm' AS method, round(avg(a), 6) AS mean, round(stddev_pop(a), 6) AS std FROM (VALUES {", ".join(f"('{k}', {a}::DOUBLE)" for k, n, a, b in WILCOXON)}) t(dataset, a) GROUP BY dataset""")
def fold_summary(s, d):
    from weft.sources.results import fold_summary as summary

    return summary(s.createDataFrame([(k, "m", n, a) for k, n, a, _ in WILCOXON], "dataset string, method string, fold int, acc double"))


@query(f"""SELECT dataset, round(avg(a), 6) AS a, round(avg(b), 6) AS b FROM (VALUES {", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE)" for k, n, a, b in WILCOXON)}) t(dataset, a, b) GROUP BY dataset""")
def results_pivot(s, d):
    from weft.sources.results import results_table

    return results_table(s.createDataFrame([(k, m, x) for k, _, a, b in WILCOXON for m, x in (("a", a), ("b", b))], "dataset string, method string, acc double"), ["a", "b"])


@query(
    f"""WITH x AS (SELECT *, round(a - b, 9) df FROM (VALUES {", ".join(f"('{k}', {n}, {a}::DOUBLE, {b}::DOUBLE)" for k, n, a, b in WILCOXON)}) t(dataset, fold, a, b)),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY fold) - 1 AS bit, count(*) OVER (PARTITION BY dataset) AS n, rank() OVER (PARTITION BY dataset ORDER BY abs(df)) + (count(*) OVER (PARTITION BY dataset, abs(df)) - 1) / 2 rk FROM x WHERE df <> 0),
w AS (SELECT dataset, any_value(n) n, least(coalesce(sum(rk) FILTER (df > 0), 0), coalesce(sum(rk) FILTER (df < 0), 0)) low FROM r GROUP BY dataset),
signs AS (SELECT r.dataset, s, sum(CASE WHEN (s >> bit) & 1 = 1 THEN rk ELSE 0 END) t FROM r, (SELECT unnest(range(0, 1024)) s) WHERE s < (1 << n) GROUP BY r.dataset, s),
p AS (SELECT dataset, any_value(w.n) n, least(1, 2 * count(*) FILTER (t <= low + 1e-9) / (1 << any_value(w.n))) p FROM signs JOIN w USING (dataset) GROUP BY dataset)
SELECT dataset, p.n::BIGINT AS n, round(p.p, 6) AS p, CASE WHEN p.p >= 0.05 THEN 'n.s.' WHEN avg(a) > avg(b) THEN 'a' ELSE 'b' END AS result FROM x JOIN p USING (dataset) GROUP BY dataset, p.n, p.p"""
)
def wilcoxon(s, d):
    return statistics.wilcoxon(s.createDataFrame(WILCOXON, "dataset string, fold int, a double, b double"))


@query(
    """SELECT graph_id, 0 AS dim, NULL::DOUBLE AS birth, round(tau, 6) AS death FROM (SELECT graph_id, tau, unnest(range(0, ends)) FROM ended)
    UNION ALL SELECT graph_id, 1, round(tau, 6), NULL FROM (SELECT graph_id, tau, unnest(range(0, own - ends)) FROM ended)""",
    EVENT_CTE.replace("\nkinds AS", "RECURSIVE\nkinds AS", 1)
    + """, levels AS (SELECT graph_id, value tau, count(*) own FROM dv GROUP BY 1, 2),
sub AS MATERIALIZED (SELECT graph_id, tau, u, v FROM levels JOIN dv USING (graph_id) WHERE value <= tau),
two AS MATERIALIZED (SELECT graph_id, tau, u a, v b FROM sub UNION ALL SELECT graph_id, tau, v, u FROM sub),
reach AS (SELECT graph_id, tau, a, b FROM two UNION SELECT r.graph_id, r.tau, r.a, t.b FROM reach r JOIN two t ON t.graph_id = r.graph_id AND t.tau = r.tau AND t.a = r.b),
joined AS (SELECT graph_id, tau, count(*) FILTER (low < b) n FROM (SELECT graph_id, tau, b, min(a) low FROM reach GROUP BY ALL) GROUP BY 1, 2),
ended AS MATERIALIZED (SELECT graph_id, tau, own, n - lag(n, 1, 0) OVER (PARTITION BY graph_id ORDER BY tau) ends FROM levels JOIN joined USING (graph_id, tau))""",
)
def persistence_pairs(s, d):
    n, e = _collection(s, d)
    return topology.persistence_pairs(n, topology.degree_values(e))


@query()
def contrast_pair(s, d):
    n, e = _collection(s, d)
    return topology.contrast_pair(settle(topology.betti_numbers(n, e), "betti"), n.groupBy("graph_id").agg(F.count("*").alias("n")))


@query()
def wl_fold_scores(s, d):
    n, e = _collection(s, d)
    return pl.wl_folds(n, e, fx.graph_labels(n))


def _results(s: SparkSession, found: list[dict]) -> DataFrame:
    return s.createDataFrame([(r["method"], float(r["accuracy"])) for r in found], "method string, accuracy double")


@query()
def sgc(s, d):
    return _results(s, [pl.run_sgc(_graph(s, d))])


@query()
def mlp(s, d):
    return _results(s, [pl.run_mlp(_graph(s, d))])


@query()
def path_model_accuracy(s, d):
    return _results(s, [pl.run_paths(_graph(s, d), "baseline", "greedy", top=TOP, most=MOST)])


@query()
def principal_axes(s, d):
    return pl.principal_axes(fx.gnodes(s, d).select("node", "x"))
