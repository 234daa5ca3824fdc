"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source's target is a number of words. Complete epochs come first; the rest of the target is
filled by sampling without replacement: a document's exponential key is -ln(u) / quality, and the
documents are taken in the order of the keys until the target's words are reached; the last one
gives only the words that are missing. The keys' order is cut into buckets: sums of buckets, prefixed
by source, tell which bucket holds the end, and only that bucket's rows are ordered one by one. Rows meet
the plan by source and bucket, so a source of any size is spread over the tasks. Over all sources at once goes a row a source only.

Defined cases: null or empty texts have size 0 and nothing is taken; a text of any length is worked on whole; a null source is a source of its own, the
last; repeated rows are documents of their own, taken one after another; equal keys go by doc_id, then size; empty tables give
empty results. Extra columns, whatever their names, are ignored. Reruns agree, as u is a hash of doc_id and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pick, settle, table

#: Buckets of a source's key order in each doubling of the key: by its scale no bucket holds over 0.1 % of exponential keys, whatever the weights.
PER_OCTAVE = 512
WORD = r"[^\x20\x09-\x0D]+"
OTHER = r"[^\p{L}\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """The share of letters and white space, at least 0.05."""
    rest = F.length(F.regexp_replace(text, OTHER, ""))
    return F.greatest(F.lit(0.05), F.coalesce(rest / F.nullif(F.length(text), F.lit(0)), F.lit(0.05)))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """source, source_size, target of sources (source, source_size): share x all sizes by weight, none above epochs x its own.

    The level at which weights are served is found where sources ordered by cap / weight stop being full.
    """
    everything, by_name = Window.partitionBy(), Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    upto, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    levels = (
        ranked.withColumn("cap", F.col("source_size") * F.lit(epochs))
        .withColumn("level", (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("w").over(after))
        # a source is full if its cap is below the level at its place; the first that isn't sets the level for all after it
        .withColumn("level", F.min_by("level", F.when(F.col("cap") / F.col("w") >= F.col("level"), F.row_number().over(order))).over(everything))
    )
    return levels.select("source", "source_size", F.least("cap", F.coalesce(F.col("w") * F.col("level"), F.col("cap"))).alias("target"))


def draw() -> Column:
    """52 bits of a hash of doc_id and text."""
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def exponential_key(weight: Column) -> Column:
    """-ln(u) / weight, u the draw between 0 and 1."""
    return -F.log((draw() + 0.5) / float(1 << 52)) / weight


def mix(docs: DataFrame, *, weight: Column | None = None, share: float = 1.5, epochs: float = 2.0, per_octave: int = PER_OCTAVE) -> DataFrame:
    """One row a document: doc_id, source, size, key, draw, source_size, target, taken. weight: a quality above 0, of the text unless given."""
    docs = pick(docs, "doc_id", "source", "text") if weight is None else docs
    key = exponential_key(quality(F.col("text")) if weight is None else weight)
    sized = settle(docs.select("doc_id", "source", words(F.col("text")).alias("size"), key.alias("key"), draw().alias("draw")).withColumn("bucket", F.floor(F.log2("key") * per_octave).cast("int")), "sized")
    parts = settle(sized.groupBy("source", "bucket").agg(F.sum("size").alias("n")), "buckets")
    goal = targets(parts.groupBy("source").agg(F.sum("n").alias("source_size")), share=share, epochs=epochs)
    goal = goal.withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).withColumn("budget", F.round(F.col("target") - F.col("full") * F.col("source_size")).cast("long"))
    # of each bucket what its rows may take in all: the whole of it, some of it where the budget ends, or nothing
    line = parts.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n"))
    a, b = goal.alias("a"), line.alias("b")
    plan = settle(b.join(a, F.col("a.source").eqNullSafe(F.col("b.source"))).select(F.col("b.source").alias("s"), F.col("b.bucket").alias("at"), "n", "source_size", "target", "full", (F.col("budget") - F.col("before")).alias("room")), "plan")
    joined = sized.join(plan, sized["source"].eqNullSafe(plan["s"]) & (F.col("bucket") == F.col("at")))
    ends = (F.col("room") > 0) & (F.col("room") < F.col("n"))
    upto = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = joined.where(ends).withColumn("room", F.col("room") - F.coalesce(F.sum("size").over(upto), F.lit(0))).withColumn("part", F.greatest(F.lit(0), F.least("room", "size")))
    whole = joined.where(~ends).withColumn("part", F.when(F.col("room") > 0, F.col("size")).otherwise(F.lit(0)))
    columns = ["doc_id", "source", "size", "key", "draw", "source_size", "target", (F.col("full") * F.col("size") + F.col("part")).cast("long").alias("taken")]
    return whole.select(*columns).unionAll(edge.select(*columns))


def op8_efraimidis_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
    -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / {float(1 << 52)!r}::DOUBLE)
    / greatest(0.05::DOUBLE, coalesce(length(regexp_replace(text, '{OTHER}', '', 'g')) / nullif(length(text), 0)::DOUBLE, 0.05::DOUBLE)) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS w, source_size * 2.0::DOUBLE AS cap FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY cap / w, source IS NULL, source) AS r FROM w),
v AS (SELECT *, ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, least(cap, coalesce(w * (SELECT arg_min(level, r) FROM v WHERE cap / w >= level), cap)) AS target FROM v),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
b AS (SELECT *, round(target - epochs * source_size)::BIGINT AS budget FROM g),
c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT doc_id, size::BIGINT AS size, source_size, target, (epochs * size + greatest(0, least(budget - before, size)))::BIGINT AS taken FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source"""


def mixed(docs: DataFrame) -> DataFrame:
    """docs (the columns of documents), each as often as the mix takes it: once a complete epoch, and its sampled words. What isn't taken goes; n_chars follows a text that is cut."""
    docs = pick(docs, "doc_id", "text", "lang", "source", "n_chars")
    plan = mix(docs).where("taken > 0").groupBy(F.col("doc_id").alias("id"), F.col("source").alias("s"), F.col("draw").alias("k")).agg(F.max("size").alias("size"), F.sum("taken").alias("taken"), F.count("*").alias("rows"))
    plan = settle(plan, "plan")
    keyed = docs.withColumn("draw", draw())
    taken = keyed.join(plan, keyed["doc_id"].eqNullSafe(plan["id"]) & keyed["source"].eqNullSafe(plan["s"]) & (F.col("draw") == F.col("k")))
    if not plan.where("rows > 1").isEmpty():  # repeated rows share what they take
        place = F.row_number().over(Window.partitionBy("id", "s", "k").orderBy("lang", "n_chars"))
        shared = taken.where("rows > 1").withColumn("taken", F.floor(F.col("taken") / F.col("rows")) + (place <= F.col("taken") % F.col("rows")).cast("long"))
        taken = taken.where("rows = 1").unionAll(shared).where("taken > 0")
    copies = taken.withColumn("words", F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.col("taken") - 1) / F.col("size"))), lambda i: F.least(F.col("size"), F.col("taken") - i * F.col("size")))))
    # the words that the target still lacks, as they stand
    begun = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("words").cast("int")), "")
    cut = F.col("words") < F.col("size")
    text = F.when(cut, begun).otherwise(F.col("text"))
    return copies.select("doc_id", text.alias("text"), "lang", "source", F.when(cut, F.length(begun).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))
