"""SimHash fingerprints, all with DataFrame functions.

The terms are runs of five words; a term's weight is how often it stands in the text. Each of 126 bits of a
term's hash votes with that weight for or against the fingerprint's bit. The votes of seven bits share a long
while a chunk of terms is summed, so a row adds 18 longs and no array is built.

Near fingerprints: texts with a similarity of 0.8 lie 19 of 126 bits apart on average, with a deviation of 4, so a
link goes up to NEAR bits. Up to RADIUS bits the links are complete: 126 bits fall into blocks; two fingerprints within the radius r agree on all but r
of the blocks, so for each choice of blocks - r blocks a permuted table keyed by those holds both in one bucket. Equal fingerprints are one
row there, and a pair is kept by the first of its tables only. Tables that are complete at NEAR would have keys of a few bits
and hold most pairs, so from there on texts meet by bands of min-hashes of their terms, drawn by weight: the
earliest of exponential times, the faster the heavier the term. What meets is still judged by its fingerprints' distance. A
bucket's fingerprints are compared in arrays of at most MEMBERS and only counted, so a large group of near copies makes no row a pair.

Defined cases: null text is empty; a text of fewer than five words is one term, a text without
words has the fingerprint 0; a bit whose votes tie is 0; a text of any length is worked on whole, its terms in chunks; null doc_ids come first; rows of one doc_id follow each other by text,
equal ones in any order, as their results are equal; a lone row is its own next document; empty tables give empty results. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pick, settle, table

SHINGLE = 5
#: Two longs of seven lanes of nine bits: a lane counts to 511 without touching the next one or the sign.
LANES, LANE = 7, 9
HALF = LANES * LANE
BITS = 2 * HALF
CHUNK = (1 << LANE) - 1
MASK = sum(1 << (LANE * i) for i in range(LANES))
RADIUS, BLOCKS = 3, 5
#: Bits of a link, 2.3 deviations above the mean distance at a similarity of 0.8, and the bands of min-hashes by which texts meet.
NEAR, BANDS, ROWS = 28, 16, 3
#: The low bits of a min-hash tell which term it is.
TERM = (1 << 24) - 1
#: Fingerprints of a bucket in one array.
MEMBERS = 512
#: The label of repeated terms among those of the texts.
REPEATED = -1
#: Documents in a range of ids, about, as long as there are no more than MOST_RANGES; beyond, ranges grow (1.5 GB of text each at 100 TB, sorted with spill).
RANGE_ROWS, MOST_RANGES, SAMPLED = 500, 1 << 16, 16


def terms(text: Column) -> Column:
    """Hashes of the runs of five words, in order; of all words if fewer; none without words."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        run = lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(SHINGLE)])
        return F.when(F.size(h) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE), run)).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    # an array of one: so the words are split once
    return F.transform(F.array(hashes), shingles)[0]


def _range_bounds(ids: DataFrame) -> list[int]:
    """The least id of each range: the least of all, then every SAMPLED-th of a sample by hash of the ids, which holds about SAMPLED * MOST_RANGES of them at most."""
    n, least = ids.agg(F.count("*"), F.min("doc_id")).first()
    ranges = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    if least is None:
        return []
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("range")), F.lit(1 << 30)) < F.lit(int(min(1.0, SAMPLED * ranges / max(1, n)) * (1 << 30)))
    sample = ids.where(drawn).agg(F.sort_array(F.collect_set("doc_id")).alias("ids")).first()["ids"]
    return sorted({least, *(sample[SAMPLED::SAMPLED] if ranges > 1 else [])})


def _numbers(values: list[int]) -> Column:
    """An array of constants, made at once."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _range_of(bounds: list[int], doc_id: Column) -> Column:
    """Index of the last bound that isn't above doc_id, by bisection; 0 for null."""
    if len(bounds) < 2:
        return F.lit(0)
    array = _numbers(bounds)
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    return F.coalesce(F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(array, at + step) <= doc_id, at + step).otherwise(at)), F.lit(0))


def with_next(docs: DataFrame) -> DataFrame:
    """range, place, ghost, doc_id, text, next_text: the next document's text in order of doc_id, after the last the first's.

    The documents are dealt to ranges of ids once. The first of a range also goes, as a ghost, to the end of the range before.
    """
    docs = pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    bounds = _range_bounds(docs.select("doc_id"))
    n, at = max(1, len(bounds)), _range_of(bounds, F.col("doc_id"))
    here = F.struct(F.col("r").alias("range"), F.lit(False).alias("ghost"))
    before = F.struct(F.pmod(F.col("r") - 1, F.lit(n)).alias("range"), F.lit(True).alias("ghost"))
    # null ids, if any, come first of all, so that the first range may begin with them or with its bound
    first = F.get(_numbers(bounds), F.col("r")) == F.col("doc_id") if bounds else F.lit(True)
    dealt = docs.withColumn("r", at).withColumn("to", F.explode(F.when(F.coalesce(first, F.lit(True)), F.array(here, before)).otherwise(F.array(here))))
    order = Window.partitionBy("range").orderBy("ghost", F.asc_nulls_first("doc_id"), "text")
    return dealt.select("to.range", "to.ghost", "doc_id", "text").withColumn("next_text", F.lead("text").over(order)).withColumn("place", F.row_number().over(order))


def edited(text: Column, following: Column) -> Column:
    """The last half of the code points replaced by the first as many of the next document."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def _votes(h: str) -> list[Column]:
    """18 longs: bits k, k + 9, ... k + 54 of two hashes of the term, each in a lane."""
    out = []
    for word in (F.col(h), F.xxhash64(F.col(h), F.lit(1))):
        out += [F.shiftrightunsigned(word, k).bitwiseAND(F.lit(MASK)) for k in range(LANE)]
    return out


def _repeats(hashes: Column) -> Column:
    """(h, c) of the terms that stand c > 1 times."""

    def runs(s: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(s) - 1)
        same = lambda i, j: F.get(s, i).eqNullSafe(F.get(s, j))
        first = F.filter(at, lambda i: same(i, i + 1) & ~same(i, i - 1))
        last = F.filter(at, lambda i: same(i, i - 1) & ~same(i, i + 1))
        return F.zip_with(first, last, lambda a, b: F.struct(F.get(s, a).alias("h"), (b - a + 1).alias("c")))

    none = F.array().cast("array<struct<h:bigint,c:int>>")
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.transform(F.array(F.sort_array(hashes)), runs)[0]).otherwise(none)


def _draw(i: int) -> Column:
    """The i-th time of a term h that stands c times, with the term's low bits; the least of a text is its min-hash."""
    time = F.shiftrightunsigned(F.xxhash64("h", F.lit(100 + i)), 2)
    of_many = (-F.expm1(F.log1p(-(time.cast("double") * 2.0**-62)) / F.col("c")) * 2.0**62).cast("long")
    return F.when(F.col("c") == 1, time).otherwise(of_many).bitwiseAND(F.lit(~TERM)).bitwiseOR(F.col("h").bitwiseAND(F.lit(TERM)))


def _bands(mins: list[Column]) -> Column:
    """An array of a hash for each band of min-hashes, null for a text without terms."""
    ids = [m.bitwiseAND(F.lit(TERM)) for m in mins]
    return F.when(mins[0].isNotNull(), F.array(*[F.xxhash64(F.lit(b), *ids[ROWS * b : ROWS * (b + 1)]) for b in range(BANDS)]))


def fingerprints(rows: DataFrame, keys: list[str], text_columns: dict[str, str], banded: str | None = None) -> DataFrame:
    """keys, n_<name> (terms), and <name>_hi, <name>_lo for each text column: name -> column; bands of the one named `banded`. keys are unique."""

    def labelled(k: int, column: str) -> list[Column]:
        row = lambda which, i, h, c: F.struct(F.lit(which).alias("which"), F.floor(i / CHUNK).cast("int").alias("chunk"), h.alias("h"), c.alias("c"))
        all_terms = F.transform(terms(F.col(column)), lambda h, i: row(k, i, h, F.lit(1)))
        return [all_terms, F.transform(_repeats(terms(F.col(column))), lambda t, i: row(REPEATED, i, t["h"], t["c"]))] if k == which_banded else [all_terms]

    which_banded = list(text_columns).index(banded) if banded else None
    parts = [x for k, c in enumerate(text_columns.values()) for x in labelled(k, c)]
    votes = rows.select(*keys, F.explode_outer(F.concat(*parts)).alias("t")).select(*keys, "t.*")
    draws = [F.min(F.when(F.col("which").isin(which_banded, REPEATED), _draw(i))).alias(f"m{i}") for i in range(BANDS * ROWS)] if banded else []
    chunks = votes.groupBy(*keys, "which", "chunk").agg(F.count("h").alias("n"), *[F.sum(v).alias(f"v{i}") for i, v in enumerate(_votes("h"))], *draws)

    # a row for each chunk of the two texts: as many as the texts are long
    lists = chunks.groupBy(*keys).agg(F.collect_list(F.struct("which", "n", F.array(*[f"v{i}" for i in range(2 * LANE)]).alias("v"))).alias("parts"), *[F.min(f"m{i}").alias(f"m{i}") for i in range(len(draws))])
    if banded:
        lists = lists.withColumn("bands", _bands([F.col(f"m{i}") for i in range(len(draws))])).drop(*[f"m{i}" for i in range(len(draws))])
    for k, name in enumerate(text_columns):
        lists = lists.withColumn("own", F.expr(f"filter(parts, p -> p.which = {k})"))
        lists = lists.withColumn(f"n_{name}", F.expr("aggregate(own, 0L, (a, p) -> a + p.n)"))
        for half, first in (("hi", 0), ("lo", LANE)):
            votes_for = f"aggregate(own, 0L, (a, p) -> a + (shiftrightunsigned(p.v[{first} + b % {LANE}], cast({LANE} * (b div {LANE}) as int)) & {CHUNK}L))"
            lists = lists.withColumn(f"{name}_{half}", F.expr(f"aggregate(sequence({HALF - 1}, 0, -1), 0L, (acc, b) -> shiftleft(acc, 1) | (CASE WHEN 2 * {votes_for} > n_{name} THEN 1L ELSE 0L END))"))
    return lists.drop("own", "parts")


def hexed(name: str) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(f"{name}_{half}"), 16, "0") for half in ("hi", "lo")]))


def distance(hi_a: Column, lo_a: Column, hi_b: Column, lo_b: Column) -> Column:
    return F.bit_count(hi_a.bitwiseXOR(hi_b)) + F.bit_count(lo_a.bitwiseXOR(lo_b))


def blocks(n: int) -> list[tuple[str, int, int]]:
    """(half, shift, mask) of n blocks that cover the bits, none over both halves."""
    out = []
    for half, parts in (("hi", n - n // 2), ("lo", n // 2)):
        ends = [HALF * i // parts for i in range(parts + 1)]
        out += [(half, a, (1 << (b - a)) - 1) for a, b in zip(ends, ends[1:], strict=False)]
    return out


def near_links(prints: DataFrame, radius: int = RADIUS, n_blocks: int = BLOCKS) -> DataFrame:
    """Pairs (a_hi, a_lo, b_hi, b_lo), each once, of distinct fingerprints (hi, lo) at most radius bits apart.

    n_blocks sets the keys' bits: more bits for more rows, so that a bucket holds near fingerprints only.
    """
    cut = blocks(n_blocks)
    tables = list(combinations(range(n_blocks), n_blocks - radius))

    def part(side: str, k: int) -> Column:
        half, shift, mask = cut[k]
        return F.shiftrightunsigned(F.col(f"{side}{half}"), shift).bitwiseAND(F.lit(mask))

    keyed = lambda side: F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.xxhash64(*[part("", k) for k in ks]).alias("key")) for t, ks in enumerate(tables)])).alias(f"{side}k")
    sides = [prints.select("hi", "lo", keyed(x)).select(F.col("hi").alias(f"{x}_hi"), F.col("lo").alias(f"{x}_lo"), F.col(f"{x}k.t").alias(f"{x}_t"), F.col(f"{x}k.key").alias(f"{x}_key")) for x in "ab"]
    same = [part("a_", k) == part("b_", k) for k in range(n_blocks)]
    first = F.lit(len(tables))
    for t in reversed(range(len(tables))):
        hit = same[tables[t][0]]
        for k in tables[t][1:]:
            hit = hit & same[k]
        first = F.when(hit, F.lit(t)).otherwise(first)
    less = (F.col("a_hi") < F.col("b_hi")) | ((F.col("a_hi") == F.col("b_hi")) & (F.col("a_lo") < F.col("b_lo")))
    near = distance(F.col("a_hi"), F.col("a_lo"), F.col("b_hi"), F.col("b_lo")) <= radius
    a, b = sides
    return a.join(b, (F.col("a_t") == F.col("b_t")) & (F.col("a_key") == F.col("b_key")) & less & near & (first == F.col("a_t"))).select("a_hi", "a_lo", "b_hi", "b_lo")


def band_links(prints: DataFrame, nearer_than: int = RADIUS, radius: int = NEAR) -> DataFrame:
    """hi, lo, n_links, more (sum of their n): of prints (hi, lo, n, bands), those that share a band and lie more than nearer_than and at most radius bits apart."""
    banded = prints.select("hi", "lo", "n", "bands", F.posexplode("bands").alias("band", "value"))
    bucket = ["band", "value"]
    several = prints.select(F.posexplode("bands").alias("band", "value")).groupBy(bucket).agg(F.count("*").alias("size")).where("size > 1")
    dealt = banded.join(several, bucket).withColumn("parts", F.ceil(F.col("size") / MEMBERS).cast("int"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("hi", "lo"), F.col("parts")).cast("int"))
    arrays = settle(dealt.groupBy(*bucket, "parts", "part").agg(F.collect_list(F.struct("hi", "lo", "n", "bands")).alias("members")), "buckets")
    small = arrays.where("parts = 1").select("band", F.col("members").alias("own"), F.col("members").alias("others"))
    # every array of a large bucket meets all of it, each pair of arrays in a task of its own
    large = arrays.where("parts > 1")
    own = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*bucket, "other", F.col("members").alias("own"))
    met = own.join(large.select(*bucket, F.col("part").alias("other"), F.col("members").alias("others")), [*bucket, "other"])
    both = small.unionAll(met.select("band", "own", "others"))
    # a pair counts in the first of its bands only
    apart = "bit_count(a.hi ^ b.hi) + bit_count(a.lo ^ b.lo)"
    near = f"filter(others, b -> {apart} BETWEEN {nearer_than + 1} AND {radius} AND (band = 0 OR forall(sequence(0, band - 1), t -> a.bands[t] <> b.bands[t])))"
    counted = both.select(F.explode(F.expr(f"transform(own, a -> struct(a.hi AS hi, a.lo AS lo, transform({near}, b -> b.n) AS found))")).alias("x")).where("size(x.found) > 0")
    return counted.select("x.hi", "x.lo", F.size("x.found").cast("long").alias("n"), F.expr("aggregate(x.found, 0L, (s, n) -> s + n)").alias("m")).groupBy("hi", "lo").agg(F.sum("n").alias("n_links"), F.sum("m").alias("more"))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_chars, edited_sha256, the fingerprints of text, edited text and next document (fp_, ed_, next_ hi and lo), and bands."""
    rows = with_next(docs).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    # the digest travels as four longs, as keys of a fixed width are what sums are fast with
    sha = F.sha2("edited", 256)
    digest = {f"sha{i}": F.conv(F.substring(sha, 16 * i + 1, 16), 16, -10).cast("long") for i in range(4)}
    rows = rows.select("range", "place", "ghost", "doc_id", F.length("text").cast("long").alias("n_chars"), *[c.alias(k) for k, c in digest.items()], "text", "edited")
    found = fingerprints(rows, ["range", "place", "ghost", "doc_id", "n_chars", *digest], {"fp": "text", "ed": "edited"}, "fp")
    found = found.withColumn("edited_sha256", F.lower(F.concat(*[F.lpad(F.hex(k), 16, "0") for k in digest]))).drop(*digest)
    order = Window.partitionBy("range").orderBy("place")
    return found.withColumns({f"next_{h}": F.lead(f"fp_{h}").over(order) for h in ("hi", "lo")}).where("not ghost").drop("range", "place", "ghost")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """class_id: the least doc_id of the documents with the same fingerprint; n_links: fingerprints near it; n_near: other documents with it or a near one."""
    found = settle(fingerprinted(table(spark, sf_dir, "documents")), "prints")
    prints = found.groupBy(F.col("fp_hi").alias("hi"), F.col("fp_lo").alias("lo")).agg(F.count("*").alias("n"), F.min("doc_id").alias("class_id"), F.min("bands").alias("bands"))
    prints = settle(prints, "classes")
    links = near_links(prints.select("hi", "lo"))
    both = links.unionAll(links.select("b_hi", "b_lo", "a_hi", "a_lo"))
    p = prints.select(F.col("hi").alias("b_hi"), F.col("lo").alias("b_lo"), F.col("n").alias("b_n"))
    degree = both.join(p, ["b_hi", "b_lo"]).groupBy(F.col("a_hi").alias("hi"), F.col("a_lo").alias("lo")).agg(F.count("*").alias("n_links"), F.sum("b_n").alias("more"))
    degree = degree.unionAll(band_links(prints)).groupBy("hi", "lo").agg(F.sum("n_links").alias("n_links"), F.sum("more").alias("more"))
    classes = prints.join(degree, ["hi", "lo"], "left").select(F.col("hi").alias("fp_hi"), F.col("lo").alias("fp_lo"), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_near"))
    classes = settle(classes, "degrees")  # a table on either side of the join, so that it can split a hot fingerprint
    like = lambda other: 1 - distance(F.col("fp_hi"), F.col("fp_lo"), F.col(f"{other}_hi"), F.col(f"{other}_lo")) / float(BITS)
    return found.join(classes, ["fp_hi", "fp_lo"]).select(
        "doc_id", "n_chars", "edited_sha256", hexed("fp").alias("fingerprint"), hexed("ed").alias("edited_fingerprint"), like("ed").alias("near_edited"), like("next").alias("near_next"), "class_id", "n_links", "n_near"
    )
