"""Near-duplicate classes by DartMinHash.

A document is the weighted set of its runs of five words, weighted by how often they stand. Darts are
thrown by hash alone at regions of weight and time: an element's weight is covered by the regions [0, 1), [1, 2), [2, 4), [4, 8), ...,
each with slabs of time that double in length. A region receives a Poisson number of darts, each with a weight, a time and a coordinate;
those at a weight below the element's own count. The earliest dart of each coordinate is the signature's entry; two sets agree on
it with the probability of their weighted Jaccard similarity, for any weights, and the work grows with the logarithm of a weight. Bands of entries are joined.
A pair is near if its weights or its plain sets are similar enough, so a text with repeated runs has a second signature, of its plain set.

Equal texts are one node. In a band's bucket every member is first compared with its hub, the member that meets
most others in all its buckets; classes follow from the links that hold. Buckets whose members then lie in several classes have these members
compared across classes, so no link between classes is lost, while a large group of copies costs a
comparison a member. A pair is dropped by its sketches, four bits of each entry, if fewer agree than
a similar pair shows but once in 10^7 pairs; all others are compared on whole texts. Across classes that happens
inside the join, on sets of hashes, so that dissimilar pairs are never rows. Joins that may meet a hot key have a table
on either side, with no step between, so that adaptive execution can split them.

Defined cases: null text is empty; texts without words are one class each by text; fewer than five words
are one run; a text of any length is worked on whole; repeated rows and equal texts share a class; null doc_ids belong to classes, whose id is the least doc_id that
isn't null, else null; of rows with a class's least doc_id one is the first, by text, then any; among hubs that meet equally many the greatest text key counts;
empty tables give empty results. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.components import components

from .common import discard, map_pandas, pick, settle, table

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
K = BANDS * ROWS
#: Longs of a sketch, 16 entries each. A similar pair agrees on 101.6 of 125 entries' four bits, with a deviation of 4.4.
SKETCH = -(-K // 16)
LEAST_AGREEING = 78
FIRST_SLAB = 2.0**-4
#: Set elements and darts worked on at a time, and the darts that a set gets at most, about, however small it is.
AT_ONCE, DARTS = 100_000, 12 * K

U = np.uint64
GOLDEN = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of five lower-cased words, with their counts."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, U), np.zeros(0, np.int64)
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    n = min(SHINGLE, len(h))
    runs = np.zeros(len(h) - n + 1, U)
    with np.errstate(over="ignore"):
        for i in range(n):
            runs = mixed(runs + h[i : len(h) - n + 1 + i] + U(i))
    return np.unique(runs, return_counts=True)


@lru_cache(maxsize=512)
def _poisson(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2, ... darts."""
    k = np.arange(int(mean + 12 * mean**0.5 + 40))
    logs = np.concatenate(([0.0], np.cumsum(np.log(k[1:]))))
    return np.cumsum(np.exp(k * np.log(mean) - mean - logs))


def signatures(elements: np.ndarray, weights: np.ndarray | None, docs: np.ndarray, n_docs: int, k: int = K) -> np.ndarray:
    """[n_docs, k] ids of the earliest darts. elements: hashes, with their weights above 0 (all 1 if None); docs: ascending, every document has one."""
    out = np.zeros((n_docs, k), U)
    filled = np.zeros((n_docs, k), bool)
    region = part = None
    if weights is not None:
        n = 1 + np.ceil(np.log2(np.maximum(weights, 1.0))).astype(np.int64)  # regions that the weight reaches into
        which = np.repeat(np.arange(len(elements)), n)
        region = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        low = np.where(region > 0, 2.0 ** (region - 1), 0.0)
        part = (weights[which] - low) / np.maximum(low, 1.0)  # the share of the region's weights that count
        elements, docs = elements[which], docs[which]
    with np.errstate(over="ignore"):
        if region is not None:
            elements = np.where(region > 0, mixed(elements + region.astype(U) * U(0x94D049BB133111EB)), elements)
        start, slab, number = 0.0, FIRST_SLAB, 0
        while len(elements):
            number += 1
            cell = mixed(elements ^ U(number * GOLDEN % 2**64))
            chance = (cell >> U(11)).astype(float) * 2.0**-53
            if region is None:
                darts = np.searchsorted(_poisson(slab), chance, side="right")
            else:
                darts = np.zeros(len(cell), np.int64)
                for r in np.unique(region):
                    at = np.flatnonzero(region == r)
                    darts[at] = np.searchsorted(_poisson(slab * 2.0 ** max(0, r - 1)), chance[at], side="right")
            some = np.flatnonzero(darts)
            times = darts[some]
            which = np.repeat(some, times)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
            ids = mixed(cell[which] + (nth + 1).astype(U) * U(GOLDEN))
            if part is not None:
                counts = (mixed(ids ^ U(0xBF58476D1CE4E5B9)) >> U(11)).astype(float) * 2.0**-53 < part[which]
                which, ids = which[counts], ids[counts]
            slot = docs[which] * k + (mixed(ids ^ U(0xD6E8FEB86659FD93)) % U(k)).astype(np.int64)
            free = ~filled.ravel()[slot]  # earlier slabs fill their slots first
            slot, ids = slot[free], ids[free]
            when = mixed(ids + U(0xA0761D6478BD642F))  # in the slab
            order = np.lexsort((when, slot))
            slot, ids = slot[order], ids[order]
            first = np.ones(len(slot), bool)
            first[1:] = slot[1:] != slot[:-1]
            slot = slot[first]
            out.ravel()[slot] = ids[first]
            filled.ravel()[slot] = True
            start, slab = start + slab, max(slab, start + slab)
            on = ~filled.all(1)[docs]
            elements, docs = elements[on], docs[on]
            if region is not None:
                region, part = region[on], part[on]
    return out


def _bands(signature: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.zeros((len(signature), BANDS), U)
        for i in range(ROWS):
            out = mixed(out + signature.reshape(-1, BANDS, ROWS)[:, :, i] + U(i + 1))
        return mixed(out + np.arange(BANDS, dtype=U)).view(np.int64)


def _sketch(signature: np.ndarray) -> np.ndarray:
    """[n, SKETCH]: the top four bits of the entries; filled up with zeros."""
    bits = np.zeros((len(signature), SKETCH * 16), U)
    bits[:, : signature.shape[1]] = signature >> U(60)
    return (bits.reshape(-1, SKETCH, 16) << (np.arange(16, dtype=U) * U(4))).sum(2, dtype=U).view(np.int64)


def agreeing(a: Column, b: Column, plain: bool = False) -> Column:
    """Entries whose four bits agree in two sketches; of the plain sets: the last longs, the only ones without repeats."""
    n = F.lit(K - 16 * SKETCH)
    for i in range(SKETCH):
        at = lambda c, i=i: F.get(c, F.size(c) - SKETCH + i if plain else F.lit(i))
        x = at(a).bitwiseXOR(at(b))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        n = n + 16 - F.bit_count(x)
    return n


def sketches_agree(a: Column, b: Column) -> Column:
    return (agreeing(a, b) >= LEAST_AGREEING) | (((F.size(a) > SKETCH) | (F.size(b) > SKETCH)) & (agreeing(a, b, True) >= LEAST_AGREEING))


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """bands and sketch of each text: those of the weights, and after them those of the plain set where runs repeat."""
    for batch in batches:
        bands: list = [None] * len(batch)
        sketches: list = [None] * len(batch)
        plain: list[tuple[int, np.ndarray]] = []
        weighted: list[tuple[int, np.ndarray, np.ndarray]] = []

        def flush(plain=plain, weighted=weighted, bands=bands, sketches=sketches) -> None:
            for group, weights in ((weighted, np.concatenate([x[2] for x in weighted]).astype(float) if weighted else None), (plain, None)):
                if group:
                    found = signatures(np.concatenate([x[1] for x in group]), weights, np.repeat(np.arange(len(group)), [len(x[1]) for x in group]), len(group))
                    for (i, *_), b, k in zip(group, _bands(found), _sketch(found), strict=True):
                        bands[i] = b if bands[i] is None else np.concatenate((bands[i], b))
                        sketches[i] = k if sketches[i] is None else np.concatenate((sketches[i], k))
                group.clear()

        size = 0
        for i, text in enumerate(batch.pop("text")):
            runs, n = shingles(text)
            if len(runs):
                plain.append((i, runs))
                size += len(runs) + DARTS
                if n.max() > 1:
                    weighted.append((i, runs, n))
                    size += len(runs) + DARTS
            if size >= AT_ONCE:
                flush()
                size = 0
        flush()
        yield batch.assign(bands=pd.Series(bands, index=batch.index, dtype=object), sketch=pd.Series(sketches, index=batch.index, dtype=object))


def _similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keep, last = [], (None, None)
        for a, text_a, text_b in zip(batch["a"], batch["text_a"], batch["text_b"], strict=True):
            if last[0] != a:
                last = (a, shingles(text_a))
            keep.append(similarity(last[1], shingles(text_b)) >= SIMILARITY)
        yield batch.loc[keep, ["a", "b"]]


def _units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """32-bit hashes of each unit of weight; the first unit of a run is even, others odd."""
    for batch in batches:
        out = []
        for text in batch.pop("text"):
            with np.errstate(over="ignore"):
                runs, n = shingles(text)
                nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                unit = (mixed(np.repeat(runs, n) + nth.astype(U) * U(GOLDEN)) >> U(32)).astype(np.uint32)
                out.append(((unit & np.uint32(0xFFFFFFFE)) | (nth > 0).astype(np.uint32)).view(np.int32))
        yield batch.assign(units=pd.Series(out, index=batch.index, dtype=object), plain=[int((u & 1 == 0).sum()) for u in out])


def maybe_similar(x: str, y: str) -> Column:
    """Whether two rows (units, plain) can have the similarity, by their hashes: weights, or plain sets if there are repeats. Hashes may meet by chance, so a little less will do."""
    least = SIMILARITY - 0.005
    share = least / (1 + least)  # of the sum of both sizes, that the common part must reach
    met = f"array_intersect({x}.units, {y}.units)"
    weighted = f"size({met}) >= {share} * (size({x}.units) + size({y}.units))"
    plain = f"{x}.plain + {y}.plain < size({x}.units) + size({y}.units) AND size(filter({met}, u -> u % 2 = 0)) >= {share} * ({x}.plain + {y}.plain)"
    return F.expr(f"({weighted}) OR ({plain})")


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Jaccard, of the weights or of the plain sets, whichever is higher."""
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    both = np.minimum(x[1][i], y[1][j]).sum()
    return max(both / max(1, x[1].sum() + y[1].sum() - both), len(i) / max(1, len(x[0]) + len(y[0]) - len(i)))


def _texts(keys: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """key, text of nodes, fetched by the least document of each."""
    wanted = keys.distinct().join(nodes, "key").select("key", "doc")
    keyed = docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("k"))
    return keyed.join(wanted, (F.col("k") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("doc"))).select("key", "text").dropDuplicates(["key"])


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of text keys that are similar; texts: key, text of all of them."""
    ends = settle(pairs.distinct(), "pairs")
    full = ends.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    return settle(full.select("a", "b", "text_a", "text_b").mapInPandas(_similar, "a string, b string"), "links")


def near_classes(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, text_key (MD5), class_id (least doc_id of the class), is_first (true in one row of each class)."""
    docs = pick(docs, "doc_id", "text")
    signed = map_pandas(docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("key"), "text"), _sign, "doc_id long, key string, bands array<long>, sketch array<long>", "doc_id")
    signed = settle(signed.withColumn("row", F.monotonically_increasing_id()), "signatures")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    nodes = settle(signed.groupBy("key").agg(F.min("doc_id").alias("doc"), F.min_by("row", order).alias("row"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch")), "nodes")
    sketches = nodes.select("key", "sketch")
    bucket = ["band", "value"]
    entries = F.array_distinct(F.transform("bands", lambda v, i: F.struct((i % BANDS).alias("band"), v.alias("value"))))
    banded = nodes.select("key", F.explode(entries).alias("e")).select("key", "e.*")
    several = settle(banded.groupBy(bucket).agg(F.count("*").alias("n")).where("n > 1"), "several")
    shared = settle(banded.join(several, bucket), "shared")  # of buckets with several nodes
    meets = shared.groupBy("key").agg(F.sum("n").alias("meets"))
    hubs = settle(shared.join(meets, "key").groupBy(bucket).agg(F.max_by("key", F.struct("meets", "key")).alias("a")), "hubs")
    members = settle(shared.join(hubs, bucket).select("key", *bucket, "a"), "members")
    texts = settle(_texts(shared.select("key"), docs, nodes), "texts")  # of all that may be compared
    spokes = members.where("a <> key").select("a", F.col("key").alias("b")).distinct()
    spokes = spokes.join(sketches.toDF("a", "sa"), "a").join(sketches.toDF("b", "sb"), "b").where(sketches_agree(F.col("sa"), F.col("sb"))).select("a", "b")
    stars = _linked(spokes, texts)
    roots = settle(components(stars), "roots")
    # buckets that hold several classes: their members are compared, those of the largest class with the others only
    placed = members.drop("a").join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    sums = placed.groupBy(*bucket, "root").agg(F.count("*").alias("n"))
    split = settle(sums.groupBy(bucket).agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("classes")).where("classes > 1").drop("classes"), "split")
    opened = settle(placed.join(split, bucket), "open")
    sets = settle(texts.join(opened.select("key").distinct(), "key", "left_semi").mapInPandas(_units, "key string, units array<int>, plain int"), "sets")
    open_rows = opened.join(nodes.select("key", "sketch", "bands"), "key").join(sets, "key")
    first = F.expr("x.band = 0 OR forall(sequence(0, x.band - 1), i -> x.bands[i] <> y.bands[i])")  # most pairs in one band only
    x, y = open_rows.where("root <> main").alias("x"), open_rows.alias("y")
    across = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.value") == F.col("y.value")) & (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.main")) | (F.col("x.key") < F.col("y.key"))) & sketches_agree(F.col("x.sketch"), F.col("y.sketch")) & first & maybe_similar("x", "y"))
    more = _linked(across.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).join(stars, ["a", "b"], "left_anti"), texts)
    discard(texts, sets, opened, split, members, hubs, shared, several)  # all links are written
    if not more.isEmpty():
        lifted = more.join(roots.withColumnsRenamed({"node": "a", "root": "ra"}), "a", "left").join(roots.withColumnsRenamed({"node": "b", "root": "rb"}), "b", "left")
        joined = settle(components(lifted.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))), "joined").toDF("root", "top")
        singles = lifted.select(F.explode(F.array(F.when(F.col("ra").isNull(), F.col("a")), F.when(F.col("rb").isNull(), F.col("b")))).alias("node")).where("node is not null").distinct().withColumn("root", F.col("node"))
        roots = settle(roots.unionAll(singles).join(joined, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")
    grouped = settle(nodes.select("key", "doc", "row").join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key")), "grouped")
    classes = settle(grouped.groupBy("root").agg(F.min("doc").alias("class_id"), F.min_by("row", F.struct(F.col("doc").isNull(), "doc", "key")).alias("first_row")), "classes")
    named = settle(grouped.join(classes, "root").select("key", "class_id", "first_row"), "named")
    return signed.select("doc_id", "key", "row").join(named, "key").select("doc_id", F.col("key").alias("text_key"), "class_id", (F.col("row") == F.col("first_row")).alias("is_first"))


def op10_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "is_first")


#: All pairs of texts with a run in common, compared exactly, and what they reach.
ORACLE_SQL = rf"""
WITH RECURSIVE docs AS MATERIALIZED (SELECT doc_id, md5(coalesce(text, '')) AS key, [w FOR w IN regexp_split_to_array(lower(coalesce(text, '')), '[\t-\r\x1c-\x1f\x{{85}}\p{{Z}}]+') IF w <> ''] AS words FROM documents),
texts AS MATERIALIZED (SELECT key, any_value(words) AS words FROM docs GROUP BY key),
placed AS (SELECT key, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM texts),
followed AS (SELECT key, i, word, {", ".join(f"lead(word, {i}) OVER following AS w{i}" for i in range(1, SHINGLE))} FROM placed WINDOW following AS (PARTITION BY key ORDER BY i)),
runs AS MATERIALIZED (SELECT key, concat_ws(' ', word, {", ".join(f"w{i}" for i in range(1, SHINGLE))}) AS run, count(*) AS n FROM followed WHERE w{SHINGLE - 1} IS NOT NULL OR i = 1 GROUP BY ALL),
sizes AS (SELECT key, sum(n) AS weight, count(*) AS plain FROM runs GROUP BY key),
met AS (SELECT x.key AS a, y.key AS b, sum(least(x.n, y.n)) AS weight, count(*) AS plain FROM runs x JOIN runs y ON x.run = y.run AND x.key < y.key GROUP BY ALL),
near AS MATERIALIZED (SELECT a, b FROM met JOIN sizes x ON x.key = a JOIN sizes y ON y.key = b WHERE met.weight / (x.weight + y.weight - met.weight) >= {SIMILARITY} OR met.plain / (x.plain + y.plain - met.plain) >= {SIMILARITY}),
links AS MATERIALIZED (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT key, key AS other FROM texts UNION SELECT r.key, l.b FROM reach r JOIN links l ON l.a = r.other),
roots AS (SELECT key, min(other) AS root FROM reach GROUP BY key)
SELECT doc_id, min(doc_id) OVER (PARTITION BY root) AS class_id, row_number() OVER (PARTITION BY root ORDER BY doc_id NULLS LAST, key) = 1 AS is_first FROM docs JOIN roots USING (key)
"""


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each class, the least doc_id; of rows with that doc_id and text one. The columns of documents."""
    docs = pick(docs, "doc_id", "text", "lang", "source", "n_chars")
    kept = near_classes(docs).where("is_first").select(F.col("doc_id").alias("id"), "text_key")
    found = docs.withColumn("k", F.md5(F.coalesce("text", F.lit(""))))
    joined = found.join(kept, (F.col("k") == F.col("text_key")) & F.col("doc_id").eqNullSafe(F.col("id")))
    return joined.dropDuplicates(["doc_id", "k"]).select(*docs.columns)
