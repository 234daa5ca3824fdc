"""Personal data by weak supervision, all with DataFrame functions.

Patterns propose spans. Four labelers vote on each (for 1, against -1, none 0): the strict form, a
gazetteer, words of the context, and the span's borders. The spans are counted by kind, votes and features (length and share of
digits, in steps), some thousand patterns at most; expectation-maximisation over these counts estimates without labels
how often each labeler that votes is right, and a logistic classifier of kind, votes and features is trained on its
posteriors. Base spans always stand; spans of the added kinds stand where the classifier gives more than 0.5.

Matches are marked with U+0001 by a regular expression and cut there, so positions are sums of the lengths of the parts (code points),
summed by blocks: the work grows with the text, and hardly faster with its matches.

Defined cases: null text is empty; U+0001 in a text counts as U+0002; a text of any length is worked on whole; matches of a kind are
leftmost and don't overlap, those of several kinds may, and of an added span and a base span that meet the base one stands; repeated rows get one row each, and count as often in
the model; empty tables give empty results. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, settle, table

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("ssn", "iban", "spelled_email", "person")
KINDS = (*BASE_KINDS, *ADDED_KINDS)
LABELERS = ("form", "gazetteer", "context", "borders")
#: Of a span: its length in steps of eight, up to the fifth, and its share of digits in thirds.
FEATURES = ("size", "digits")
#: Matches whose positions are summed at a time.
BLOCK = 256

#: What a cheap test must find first, and the pattern. Possessive, so no text takes more than one pass a match.
#: A leftmost match begins where its run of characters begins, or where the match before it ended.
PATTERNS = {
    "email": ("@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){15}", r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){15,}+"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "ssn": (r"[0-9]-[0-9]{2}-[0-9]", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    "iban": (r"[A-Z]{2}[0-9]{2}", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
    "spelled_email": (r"[\[(] ?at ?[\])]", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[\[(]\x20?dot\x20?[\])])\x20?[A-Za-z0-9-]{1,63}){1,4}"),
    "person": (r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Sra?|Señora?)\b", r"(?<!\p{L})(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Sra|Sr|Señora|Señor)\.?\x20\p{Lu}\p{Ll}{1,30}(?:\x20\p{Lu}\p{Ll}{1,30}){0,2}(?!\p{L})"),
}

#: The gazetteers and the words of the context.
TLDS = "com|org|net|edu|gov|mil|int|info|io|de|fr|es|it|uk|us|ca|eu|ch|at|nl|be|pt|br|mx|jp|cn|in|au"
CALLING_CODES = r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CARD_PREFIXES = "4|5[1-5]|2[2-7]|3[47]|6011|65|35"
CONTEXT_FOR = r"(?i)(?:e-?mail|contact|correo|courriel|reach|write|call|phone|tel|fax|mobile|m[óo]vil|handy|card|visa|credit|pay|ssn|social|iban|account|konto|compte|cuenta|name|nom|nombre|address|adresse|direcci|host|server|login)[^\n]{0,24}$"
CONTEXT_AGAINST = r"(?i)(?:version|isbn|issn|order|section|figure|page|table|chapter|serial|part|build|release|equation|example)[\x20:#.]{0,4}$"

#: Words for a number of the social insurance.
INSURANCE = r"(?i)ssn|social|sozial|steuer|seguridad|sécurité|insurance"

SPAN = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def _found(kind: str) -> str:
    """SQL for the matches in `text`: start, end, value, and what stands before and after."""
    guard, pattern = (x.replace("\\", "\\\\").replace("'", "\\'") for x in PATTERNS[kind])
    parts = f"split(regexp_replace(text, '{pattern}', '\\u0001$0\\u0001'), '\\u0001', -1)"
    upto = "aggregate({0}, named_struct('at', {1}, 'out', cast(array() as array<int>)), (s, p) -> named_struct('at', s.at + {2}, 'out', concat(s.out, array(s.at))), s -> s.out)".format
    blocks = f"transform(sequence(0, (size(x) - 1) div {BLOCK}), k -> slice(x, k * {BLOCK} + 1, {BLOCK}))"
    bases = upto("transform(z, b -> aggregate(b, 0, (n, p) -> n + length(p)))", "0", "p")
    starts = f"transform(transform(array({blocks}), z -> named_struct('z', z, 'at', {bases})), w -> flatten(transform(w.z, (b, k) -> {upto('b', 'w.at[k]', 'length(p)')})))[0]"
    spans = "transform(filter(sequence(0, size(y.p) - 1), i -> i % 2 = 1), i -> named_struct('start', y.s[i], 'end', y.s[i] + length(y.p[i]), 'value', y.p[i], 'before', right(y.p[i - 1], 40), 'after', left(y.p[i + 1], 20)))"
    bound = f"transform(transform(array({parts}), x -> named_struct('p', x, 's', {starts})), y -> {spans})[0]"
    test = f"contains(text, '{guard}')" if guard == "@" else f"text rlike '{guard}'"
    return f"CASE WHEN {test} THEN {bound} ELSE cast(array() as {SPAN}) END"


def _luhn(digits: str) -> str:
    x = f"cast(substr({digits}, -i, 1) as int)"
    return f"aggregate(sequence(1, length({digits})), 0, (a, i) -> a + CASE WHEN i % 2 = 1 THEN {x} WHEN {x} > 4 THEN 2 * {x} - 9 ELSE 2 * {x} END) % 10 = 0"


DIGITS = "regexp_replace(c.value, '[^0-9]', '')"
#: Kinds whose pattern sees to the borders, so that these say nothing.
BORDERED = ("ssn", "iban", "person")
#: The strict form of each kind, of a span c; a kind without one has no vote of it.
FORM = {
    "email": "true",
    "ip": "c.value rlike '^0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})([.]0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$'",
    "card": f"length({DIGITS}) <= 19 AND {_luhn(DIGITS)}",
    "phone": f"length({DIGITS}) BETWEEN 8 AND 15",
    "ssn": "NOT c.value rlike '^(000|666|9)|-00-|-0000$'",
    "iban": "length(replace(c.value, ' ', '')) BETWEEN 15 AND 34",
    "spelled_email": "true",
    "person": "true",
}
GAZETTEER = {
    "email": f"CASE WHEN lower(c.value) rlike '[.]({TLDS})$' THEN 1 ELSE -1 END",
    "ip": "CASE WHEN c.value rlike '^(0|127|255)[.]' THEN -1 ELSE 1 END",
    "card": f"CASE WHEN {DIGITS} rlike '^({CARD_PREFIXES})' THEN 1 ELSE 0 END",
    "phone": f"CASE WHEN c.value rlike '^{CALLING_CODES.replace(chr(92), chr(92) * 2)}' THEN 1 ELSE -1 END",
    "ssn": "CASE WHEN c.before rlike '{insurance}' THEN 1 ELSE -1 END",
    "iban": "CASE WHEN c.value rlike '^(DE|FR|ES|IT|GB|NL|BE|CH|AT|PT|IE|PL|SE|NO|DK|FI|LU)' THEN 1 ELSE -1 END",
    "spelled_email": f"CASE WHEN lower(c.value) rlike '({TLDS})$' THEN 1 ELSE -1 END",
    "person": "1",
}


def _labelled(kind: str, spans: str) -> str:
    """SQL: the spans with their votes and features."""
    quoted = lambda words: words.replace("\\", "\\\\").replace("'", "\\'")
    return f"""transform({spans}, c -> named_struct('kind', '{kind}', 'rank', {KINDS.index(kind)}, 'start', c.start, 'end', c.end,
        'sound', {FORM[kind]}, 'form', {'0' if FORM[kind] == 'true' else f"CASE WHEN {FORM[kind]} THEN 1 ELSE -1 END"}, 'gazetteer', {GAZETTEER[kind].replace("{insurance}", quoted(INSURANCE))},
        'context', CASE WHEN c.before rlike '{quoted(CONTEXT_AGAINST)}' THEN -1 WHEN c.before rlike '{quoted(CONTEXT_FOR)}' THEN 1 ELSE 0 END,
        'borders', {'0' if kind in BORDERED else "CASE WHEN c.before rlike '[0-9A-Za-z]$' OR c.after rlike '^[0-9A-Za-z]' THEN -1 ELSE 1 END"},
        'size', least(5, length(c.value) div 8), 'digits', 3 * length({DIGITS}) div length(c.value)))"""


def _meets(kind: str) -> str:
    """SQL: whether the span m meets one of the kind's sound ones, which are in order and apart: the last that begins before m's end is found by bisection."""
    steps = "transform(sequence(30, 0, -1), e -> shiftleft(1, e))"
    before = f"aggregate({steps}, 0, (at, n) -> IF(at + n <= size({kind}) AND get({kind}, at + n - 1).start < m.end, at + n, at))"
    return f"coalesce(get({kind}, {before} - 1).end > m.start, false)"


def proposed(docs: DataFrame) -> DataFrame:
    """doc_id, spans: array of kind, rank, start, end, the votes and the features, by rank then start. Added kinds that meet a base span go."""
    docs = pick(docs, "doc_id", "text").withColumn("text", F.translate(F.coalesce("text", F.lit("")), "\u0001", "\u0002"))
    found = docs.select("doc_id", *[F.expr(_labelled(k, _found(k))).alias(k) for k in KINDS])
    sound = found.select("doc_id", F.concat(*BASE_KINDS).alias("base"), F.concat(*ADDED_KINDS).alias("more"), *[F.filter(k, lambda b: b["sound"]).alias(k) for k in BASE_KINDS])
    free = f"filter(more, m -> NOT ({' OR '.join(map(_meets, BASE_KINDS))}))"
    return sound.select("doc_id", F.expr(f"concat(base, {free})").alias("spans"))


def reliabilities(counts: list[tuple], rounds: int = 50, trust: float = 8.0) -> tuple[dict, list[float]]:
    """Of (kind, votes, features, n): how likely each labeler that votes casts each vote on true and on false spans, and each row's posterior.

    Kinds share reliabilities and have priors of their own. A labeler that doesn't vote says nothing; before it is seen, it is right in four of five of `trust` votes.
    """
    m = len(LABELERS)
    post = [min(0.95, max(0.05, 0.5 + 0.15 * sum(votes))) for _, votes, _, _ in counts]
    rate: dict = {}
    for _ in range(rounds):
        rate = {}
        for j in range(m):
            for cls in (0, 1):
                right = 1 if cls else -1
                sums = {right: 0.8 * trust, -right: 0.2 * trust}
                for p, (_, votes, _, n) in zip(post, counts, strict=True):
                    if votes[j]:
                        sums[votes[j]] += n * (p if cls else 1 - p)
                total = sum(sums.values())
                rate[j, cls] = {v: x / total for v, x in sums.items()}
        prior = {}
        for kind in {k for k, *_ in counts}:
            rows = [(p, n) for p, (k, _, _, n) in zip(post, counts, strict=True) if k == kind]
            prior[kind] = (1 + sum(p * n for p, n in rows)) / (2 + sum(n for _, n in rows))
        new = []
        for kind, votes, _, _ in counts:
            odds = math.log(prior[kind] / (1 - prior[kind])) + sum(math.log(rate[j, 1][v] / rate[j, 0][v]) for j, v in enumerate(votes) if v)
            new.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        post = new
    return rate, post


def train(counts: list[tuple], post: list[float], rounds: int = 300, step: float = 0.5, ridge: float = 1e-3) -> dict:
    """Weights of a logistic classifier of kind, votes and features, by gradient descent on the posteriors. A pattern weighs by the root of its count, so that rare kinds are fitted too."""
    rows = [[("kind", kind)] + [(name, v) for name, v in zip(LABELERS, votes, strict=True) if v] + [(name, v) for name, v in zip(FEATURES, features, strict=True)] for kind, votes, features, _ in counts]
    weights = {f: 0.0 for row in rows for f in row}
    total = sum(math.sqrt(n) for *_, n in counts) or 1
    for _ in range(rounds):
        slope = {f: ridge * w for f, w in weights.items()}
        for row, p, (*_, n) in zip(rows, post, counts, strict=True):
            z = sum(weights[f] for f in row)
            error = math.sqrt(n) / total * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - p)
            for f in row:
                slope[f] += error
        weights = {f: w - step * slope[f] for f, w in weights.items()}
    return weights


def score(span: str, weights: dict) -> str:
    """SQL for the classifier's probability of a span."""
    terms = [f"CASE WHEN {span}.{name} = {value if isinstance(value, int) else repr(value)} THEN {w:.9f}D ELSE 0D END" for (name, value), w in sorted(weights.items(), key=str)]
    return f"1 / (1 + exp(-({' + '.join(terms) or '0D'})))"


def model_of(found: DataFrame) -> dict:
    """The classifier's weights, of all proposed spans (doc_id, spans). What comes to the driver is a row for each pattern of kind, votes and features."""
    seen = found.select(F.explode("spans").alias("s")).groupBy("s.kind", *[f"s.{x}" for x in (*LABELERS, *FEATURES)]).agg(F.count("*").alias("n"))
    counts = sorted((r["kind"], tuple(r[x] for x in LABELERS), tuple(int(r[x]) for x in FEATURES), r["n"]) for r in seen.collect())
    return train(counts, reliabilities(counts)[1]) if counts else {}


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, base, added: arrays of spans, each with its probability."""
    found = settle(proposed(docs), "pii")
    weights = model_of(found)
    judged = found.select("doc_id", F.expr(f"transform(spans, s -> named_struct('kind', s.kind, 'rank', s.rank, 'start', s.start, 'end', s.end, 'sound', s.sound, 'p', {score('s', weights)}))").alias("spans"))
    n = len(BASE_KINDS)
    return judged.select("doc_id", F.expr(f"filter(spans, s -> s.rank < {n} AND s.sound)").alias("base"), F.expr(f"filter(spans, s -> s.rank >= {n} AND s.sound AND s.p > 0.5)").alias("added"))


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(_text(F.col("base")), 256).alias("base_sha256"),
        _text(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        F.coalesce(F.array_min(F.col("base.p")), F.lit(0.0)).alias("least_p"),
    )
