"""Language identification by multilingual mixture inference.

A model holds the log-probability of each hashed character trigram in each language. A document is a
mixture: expectation-maximisation estimates the languages' proportions from its trigram counts, first
of each language alone, then with one more language at a time for as long as the likelihood, penalised
by half the log of the trigram count for each language, rises. Each further language is judged at its best of some shares, so that a small part
of a long text is seen too. The largest proportion is the prediction and the score.

Defined cases: null text, or text without a letter, is "und" with score 0, as are all documents if nothing
could be learned; a text of any length is worked on whole; equal proportions go by the language's name; empty tables give empty results;
repeated rows get one row each. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_pandas, pick, table

BUCKETS = 1 << 15
#: The training sample's bound: about so many documents of each language, chosen by hash.
SAMPLE_PER_LANGUAGE = 1500
UNKNOWN = "und"
#: Shares at which a further language is judged.
SHARES = (0.3, 0.1, 0.03, 0.01, 0.003)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def grams(text: str) -> np.ndarray:
    """Buckets of the trigrams of the lower-cased text, all white space and signs as one separator."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) == 0:
        return np.zeros(0, np.int64)
    letters = (points >= 0x80) | ((points >= 97) & (points <= 122))
    points = np.where(letters, points, 32)
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)  # runs of separators are one
    points = np.concatenate(([32], points[keep], [32])).astype(np.uint64)
    mixed = points[:-2] * np.uint64(0x9E3779B1) + points[1:-1] * np.uint64(0x85EBCA77) + points[2:] * np.uint64(0xC2B2AE3D)
    mixed ^= mixed >> np.uint64(15)
    return ((mixed * np.uint64(0x2C1B3C6D)) >> np.uint64(12)).astype(np.int64) % BUCKETS


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch["text"], batch["lang"], strict=True):
            counts[lang] = counts.get(lang, 0) + np.bincount(grams(text), minlength=BUCKETS)
    for lang, n in counts.items():
        at = np.flatnonzero(n)
        yield pd.DataFrame({"lang": lang, "bucket": at, "n": n[at]})


def learn(docs: DataFrame, may_learn: Column, per_language: int = SAMPLE_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities [BUCKETS, languages], from a sample of the documents (doc_id, text, lang) of about per_language each.

    The counts of labelled documents cover all rows. What comes to the driver is bounded by BUCKETS rows a language.
    """
    known = docs.where(may_learn & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    share = {r["lang"]: per_language / r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return [], np.zeros((BUCKETS, 0))
    langs = sorted(share)
    shares = F.create_map(*[F.lit(x) for lang in langs for x in (lang, share[lang])])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) / (1 << 20)
    counted = known.where(draw < shares[F.col("lang")]).select("text", "lang").mapInPandas(_count, "lang string, bucket int, n long")
    sums = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((BUCKETS, len(langs)), 0.1)
    table[sums["bucket"].to_numpy(np.int64), sums["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)] += sums["n"].to_numpy(float)
    return langs, np.log(table / table.sum(0))


def mixture(n: np.ndarray, logp: np.ndarray, start: np.ndarray | None = None, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Proportions and log-likelihood by expectation-maximisation from the proportions `start`; n counts, logp [trigrams, languages]."""
    k = logp.shape[1]
    top = logp.max(1)
    p = np.exp(logp - top[:, None])
    total, share = n.sum(), np.full(k, 1 / k) if start is None else start
    for _ in range(rounds if k > 1 else 0):
        share = share * ((n / (p @ share)) @ p) / total
    return share, float(n @ (np.log(p @ share) + top))


def infer(text: str | None, langs: list[str], logp: np.ndarray) -> list[tuple[str, float]]:
    """The selected languages with their proportions, largest first; none for a text without letters."""
    if not langs or not has_letter(text):
        return []
    buckets, n = np.unique(grams(text), return_counts=True)
    if len(buckets) == 0:
        return []
    rows = logp[buckets]
    alone = n @ rows
    penalty = 0.5 * np.log(n.sum() + 1) + 1
    chosen, share, best = [int(alone.argmax())], np.ones(1), float(alone.max())
    while len(chosen) < len(langs):
        rest = [i for i in range(len(langs)) if i not in chosen]
        top = rows.max(1)
        now = np.exp(rows[:, chosen] - top[:, None]) @ share  # what the chosen explain, against the best of all
        ratio = np.exp(rows[:, rest] - top[:, None]) / np.maximum(now, 1e-30)[:, None] - 1
        gains = np.stack([n @ np.log1p(x * ratio) for x in SHARES])
        taken = False
        for at in np.argsort(-gains.max(0)):
            if gains[:, at].max() <= penalty / 4:
                break
            tried, x = [*chosen, rest[at]], SHARES[int(gains[:, at].argmax())]
            new, value = mixture(n, rows[:, tried], np.append(share * (1 - x), x))
            if value - best > penalty:
                chosen, share, best, taken = tried, new, value, True
                break
        if not taken:
            break
    return sorted(((langs[i], float(x)) for i, x in zip(chosen, share, strict=True)), key=lambda x: (-x[1], x[0]))


def _predictor(langs: list[str], model):
    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [infer(text, langs, model.value) for text in batch["text"]]
            yield batch.assign(
                lang_pred=pd.Series([f[0][0] if f else UNKNOWN for f in found], index=batch.index, dtype=object),
                score=pd.Series([f[0][1] if f else 0.0 for f in found], index=batch.index, dtype=float),
                languages=pd.Series([",".join(f"{x}:{p:.3f}" for x, p in f) for f in found], index=batch.index, dtype=object),
            )

    return predict


def is_held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))


def identify(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """columns of docs, with held_out, lang_pred, score and languages (the mixture)."""
    langs, logp = learn(pick(docs, "doc_id", "text", "lang"), ~is_held_out())
    model = docs.sparkSession.sparkContext.broadcast(logp)  # BUCKETS rows of as many numbers as languages
    kept = pick(docs, *columns)
    schema = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes)
    whole = [c for c, t in kept.dtypes if t == "bigint"]
    return map_pandas(kept, _predictor(langs, model), f"{schema}, lang_pred string, score double, languages string", *whole).withColumn("held_out", is_held_out())


def op6_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "languages")


def in_known_language(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Documents with a letter whose main language has at least the share least; the columns of documents."""
    columns = ("doc_id", "text", "lang", "source", "n_chars")
    return identify(docs, columns).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*columns)
