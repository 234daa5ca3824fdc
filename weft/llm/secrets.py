"""Secret scans with corpus-wide ownership frequency.

Every candidate credential gets a hash of its value. The hashes are aggregated by distinct
repositories and owners: a value that many owners hold is a copied example, a value that
stays with few owners and looks random is taken as live. Base spans are always reported; the
method's own kinds are reported only where they look live.

Defined cases: null text is empty and has no candidates; empty tables give empty results;
repeated rows give one result row each, and count once as a repository; null owners count as
one owner. A private key's value is its body without white space, and its span the whole block. Extra
columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_pandas, pick, settle, table

BASE_KINDS = ("assign", "access", "hex")
#: Kinds that the method adds to the base ones.
ADDED_KINDS = ("private_key", "forge", "chat", "jwt", "bearer")
KINDS = (*BASE_KINDS, *ADDED_KINDS)

#: The patterns of credentials.
ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
WHOLE = {
    # a maximal run that is too short has no long enough part, so the least length can stand in the pattern
    "access": re.compile(r"AKIA[A-Z0-9]{16,}"),
    "hex": re.compile(r"[0-9a-f]{24,}"),
    # the block up to its END line, to the next key or to the text's end, if it is cut short
    "private_key": re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(.*?)(?:-----END [A-Z ]{0,40}PRIVATE KEY-----|(?=-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----)|\Z)", re.DOTALL),
    "forge": re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"),
    "chat": re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    # only where a run begins, so that a run is read once
    "jwt": re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "bearer": re.compile(r"[Bb]earer\x20([A-Za-z0-9._~+/=-]{20,})"),
}
MUST_HOLD = {"access": "AKIA", "private_key": "PRIVATE KEY", "forge": "gh", "chat": "xox", "jwt": "eyJ", "bearer": "earer"}
PLACEHOLDER = re.compile(r"(?i)example|placeholder|changeme|your[_-]|xxxx|dummy|(.)\1{7}")
#: Keys hold runs of one character (OpenSSH's have many A), and four x by chance.
KEY_PLACEHOLDER = re.compile(r"(?i)example|placeholder|changeme|your[_-]|x{8}|dummy")
#: White space of a key's body, also as escapes in a string.
BLANK = re.compile(r"(?:\s|\\[nrt])+")

CANDIDATE = "array<struct<kind:string,rank:int,start:int,end:int,hash:string,entropy:double,placeholder:boolean>>"


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def candidates(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of a text, by start, then kind."""
    found = []
    if ":" in text or "=" in text:
        found += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    for kind, pattern in WHOLE.items():
        if MUST_HOLD.get(kind, "") in text:
            found += [(kind, m.start(), m.end(), BLANK.sub("", m[1]) if kind == "private_key" else m[m.re.groups]) for m in pattern.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text in batch.pop("text"):
            found = candidates(text or "")
            base = [x for x in found if x[0] in BASE_KINDS]
            kinds = Counter(x[0] for x in base)
            digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e, _ in base).encode()).hexdigest()
            cands = [
                {"kind": k, "rank": KINDS.index(k), "start": s, "end": e, "hash": hashlib.sha256(v.encode()).hexdigest()[:32], "entropy": entropy(v), "placeholder": (KEY_PLACEHOLDER if k == "private_key" else PLACEHOLDER).search(v) is not None}
                for k, s, e, v in found
            ]
            rows.append((*(kinds[k] for k in BASE_KINDS), digest, cands))
        yield batch.assign(**dict(zip(("n_assign", "n_access", "n_hex", "base_sha256", "candidates"), map(list, zip(*rows, strict=True)), strict=False))) if rows else batch.assign(n_assign=[], n_access=[], n_hex=[], base_sha256=[], candidates=[])


def scan(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """One row a document with its candidates; written once, as it is read three times."""
    spans = map_pandas(
        docs.select("doc_id", repository.cast("string").alias("repository"), owner.cast("string").alias("owner"), "text"),
        _scan,
        f"doc_id long, repository string, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, candidates {CANDIDATE}",
        "doc_id",
    )
    return settle(spans.withColumn("row", F.monotonically_increasing_id()), "secrets")


def ownership(scanned: DataFrame) -> DataFrame:
    """hash, n_repositories, n_owners: each level is summed before the next shuffle, so a hot hash moves a few rows a task."""
    held = scanned.select(F.explode("candidates.hash").alias("hash"), "owner", "repository").groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
    by_owner = held.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"))


def ownership_scan(docs: DataFrame, *, repository: Column | None = None, owner: Column | None = None, max_owners: int = 2, least_entropy: float = 2.5) -> DataFrame:
    """One row a document: base counts and digest, and spans (array of kind, rank, start, end, n_owners, n_repositories, live), by start then kind.

    live: held by at most max_owners owners, no placeholder, and at least least_entropy bits a character.
    """
    docs = docs.select("doc_id", "source", "text")
    scanned = scan(docs, F.col("doc_id") if repository is None else repository, F.col("source") if owner is None else owner)
    one = scanned.select("row", F.explode("candidates").alias("c")).select("row", "c.*")
    judged = one.join(ownership(scanned), "hash").withColumn("live", (F.col("n_owners") <= max_owners) & ~F.col("placeholder") & (F.col("entropy") >= least_entropy))
    spans = judged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "end", "kind", "hash", "n_owners", "n_repositories", "live"))).alias("spans"))
    return scanned.drop("candidates").join(spans, "row", "left")


def spans_text(spans: Column) -> Column:
    kept = F.filter(F.coalesce(spans, F.array()), lambda s: (s["rank"] < len(BASE_KINDS)) | s["live"])
    return F.concat_ws(",", F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op1_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a repository of its own, its source the owner."""
    found = ownership_scan(pick(table(spark, sf_dir, "documents"), "doc_id", "source", "text"))
    count = lambda test: F.coalesce(F.size(F.filter("spans", test)), F.lit(0)).cast("long")
    return found.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        "base_sha256",
        F.when(F.col("spans").isNull(), "").otherwise(spans_text(F.col("spans"))).alias("spans"),
        F.when(F.col("spans").isNull(), 0).otherwise(count(lambda s: s["live"])).cast("long").alias("n_live"),
        F.when(F.col("spans").isNull(), 0).otherwise(count(lambda s: ~s["live"])).cast("long").alias("n_shared"),
        F.coalesce(F.array_max(F.col("spans.n_owners")), F.lit(0)).cast("long").alias("most_owners"),
    )


def _oracle(max_owners: int = 2, least_entropy: float = 2.5) -> str:
    """The same in SQL. A match's start is the length of the pieces and matches before it; jwt takes a character before it, and a key is cut out between headers."""
    header = "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
    patterns = {"assign": (ASSIGN.pattern, 2)} | {k: (x.pattern, x.groups) for k, x in WHOLE.items() if k != "private_key"}
    patterns["jwt"] = (patterns["jwt"][0].replace("(?<![A-Za-z0-9_-])", "(?:^|[^A-Za-z0-9_-])(") + ")", 1)
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    found = lambda x: f"SELECT id, text, unnest(regexp_extract_all(text, {quoted(x)}, 0)) AS m, unnest(regexp_split_to_array(text, {quoted(x)})) AS piece, generate_subscripts(regexp_split_to_array(text, {quoted(x)}), 1) AS i FROM docs"
    placed = lambda x: f"SELECT id, text, m, sum(length(piece) + length(m)) OVER (PARTITION BY id ORDER BY i) - length(m) AS s FROM ({found(x)}) WHERE m IS NOT NULL"
    parts = []
    for k, (x, group) in patterns.items():
        value = f"regexp_extract(m, {quoted(x)}, {group})"
        parts.append(f"SELECT id, {KINDS.index(k)} AS rank, '{k}' AS kind, s{' + length(m) - length(v)' if k == 'jwt' else ''} AS s, s + length(m) AS e, v FROM (SELECT id, m, s, {value} AS v FROM ({placed(x)}))" + " WHERE length(v) >= 6" * (k == "assign"))
    runs = "|".join(re.escape(c) + "{8}" for c in "abcdefghijklmnopqrstuvwxyz0123456789+/_.=~-")
    words = PLACEHOLDER.pattern.removeprefix("(?i)").removesuffix("|(.)\\1{7}")
    return rf"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, source, coalesce(text, '') AS text FROM documents),
keys AS (SELECT id, s, substring(text, (s + 1)::BIGINT, (coalesce(lead(s) OVER (PARTITION BY id ORDER BY s), length(text)) - s)::BIGINT) AS block FROM ({placed(header)})),
whole AS (SELECT id, s, regexp_extract(block, '^[\s\S]*?(?:-----END [A-Z ]{{0,40}}PRIVATE KEY-----|\z)') AS m FROM keys),
spans AS MATERIALIZED ({" UNION ALL ".join(parts)}
  UNION ALL SELECT id, {KINDS.index("private_key")}, 'private_key', s, s + length(m), regexp_replace(regexp_replace(regexp_replace(m, '^{header}', ''), '-----END [A-Z ]{{0,40}}PRIVATE KEY-----$', ''), '(?:[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]|\\[nrt])+', '', 'g') FROM whole),
held AS (SELECT v, count(DISTINCT source) + max((source IS NULL)::INT) AS owners FROM spans JOIN docs USING (id) GROUP BY v),
letters AS (SELECT v, c, count(*) AS n FROM (SELECT v, unnest(string_split(v, '')) AS c FROM held WHERE v <> '') GROUP BY v, c),
entropies AS (SELECT v, -sum(n / t * log2(n / t)) AS bits FROM (SELECT v, n, sum(n) OVER (PARTITION BY v) AS t FROM letters) GROUP BY v),
judged AS (SELECT id, rank, kind, s, e, owners, owners <= {max_owners} AND coalesce(bits, 0) >= {least_entropy}
  AND NOT (CASE WHEN kind = 'private_key' THEN regexp_matches(v, '{KEY_PLACEHOLDER.pattern}') ELSE regexp_matches(v, '(?i){words}|{runs}') END) AS live FROM spans JOIN held USING (v) LEFT JOIN entropies USING (v)),
named AS (SELECT *, concat_ws(':', kind, s::BIGINT, e::BIGINT) AS span, rank < {len(BASE_KINDS)} AS base FROM judged),
sums AS (SELECT id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE_KINDS)}, string_agg(span, ',' ORDER BY s, rank) FILTER (base) AS base_spans,
  string_agg(span, ',' ORDER BY s, rank) FILTER (base OR live) AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_shared, max(owners) AS most_owners FROM named GROUP BY id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE_KINDS)}, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_shared, 0) AS n_shared, coalesce(most_owners, 0) AS most_owners FROM docs LEFT JOIN sums USING (id)
"""


ORACLE_SQL = _oracle()


def _redact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for text, hidden in zip(batch["text"], batch.pop("hidden"), strict=True):
            if hidden is not None and text is not None:
                hidden, parts, at = set(hidden), [], 0
                for _, start, end, value in candidates(text):
                    if end > at and hashlib.sha256(value.encode()).hexdigest()[:32] in hidden:
                        parts += [text[at:start], "<secret>"] if start >= at else []
                        at = end
                text = "".join([*parts, text[at:]])
            out.append(text)
        yield batch.assign(text=pd.Series(out, dtype=object))


def _holding(wanted: bool):
    """The documents that hold candidates, or those that don't."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.loc[[bool(candidates(text or "")) == wanted for text in batch["text"]]]

    return run


def redacted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, source, n_chars) with every value that looks live replaced; all rows stay, widely copied examples too. n_chars follows the text.

    Only texts with candidates meet the live values; all others are scanned twice and never shuffled.
    """
    docs, schema = pick(docs, "doc_id", "text", "lang", "source", "n_chars").drop("n_chars"), "doc_id long, text string, lang string, source string"
    some = settle(map_pandas(docs, _holding(True), schema, "doc_id"), "candidates")
    live = ownership_scan(some).select(F.col("doc_id").alias("id"), F.explode("spans").alias("s")).where("s.live").groupBy("id").agg(F.collect_set("s.hash").alias("hidden"))
    both = some.join(live, some["doc_id"].eqNullSafe(live["id"]), "left").drop("id")
    out = map_pandas(both, _redact, schema, "doc_id").unionAll(map_pandas(docs, _holding(False), schema, "doc_id"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
