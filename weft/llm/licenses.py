"""License scans by diagonal voting.

Rolling hashes of k words of every text are joined to the positions of the same k words in the
templates. A match votes for its diagonal, document position minus template position; neighbouring
diagonals are merged, which bridges words put in or left out. Each merged group is verified: among its
matches, the longest chain is sought that ascends in the document and in the template and lies in one and a half
times the template's length; it must hold a share of the template's runs. A chain goes on from the longest before it that
is still open, the latest begun among equals. Base phrases are templates that must match whole, on one diagonal.

Words are split once: a first pass keeps of each text the number of its words and those runs whose hash has its bit set
in a table of the templates' hashes; the join is on whole 64-bit hashes.

Defined cases: null text is empty; texts of fewer than k words have no match; a text of any length is worked on whole, a match at a
time; of equally long chains of a group the first counts; repeated rows get one row each; null doc_ids are kept;
empty tables give empty results. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pick, settle, table

K = 3
#: Diagonals this near count as one group.
NEIGHBOURS = 4
#: The share of a template's runs that a span must hold, and how much longer than its template it may be.
LEAST_SHARE, STRETCH = 0.6, 1.5
#: Bits of the first pass's table: with some hundred runs few others pass.
TABLE_BITS = 14

#: Base phrases with their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Sentences of licenses, found with small changes.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit-text"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd-text"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl-text"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl-text"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2-text"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc-text"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa-text"),
    ("this is free and unencumbered software released into the public domain", "unlicense-text"),
    ("all rights reserved no part of this publication may be reproduced", "all-rights-reserved"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def runs(spark: SparkSession, templates: Sequence[tuple[str, str]]) -> DataFrame:
    """template, label, base, n_runs, t_at, hash of every run of K words: some hundred rows."""
    rows = []
    for t, (text, label) in enumerate((*PHRASES, *templates)):
        own = text.split()
        rows += [(t, label, t < len(PHRASES), len(own) - K + 1, i, *own[i : i + K]) for i in range(len(own) - K + 1)]
    names = [f"w{i}" for i in range(K)]
    given = spark.createDataFrame(rows, "template int, label string, base boolean, n_runs int, t_at int, " + ", ".join(f"{n} string" for n in names))
    return given.withColumn("hash", F.xxhash64(*names)).drop(*names)


def marked(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """row, doc_id, n_words, grams: of every text the runs (at, hash) that may be a template's."""
    slots = {r["hash"] % (1 << TABLE_BITS) for r in templates.select("hash").collect()}
    may_be = F.lit([i in slots for i in range(1 << TABLE_BITS)])

    def scan(w: Column) -> Column:
        run = lambda i: F.struct(i.alias("at"), F.xxhash64(*[F.get(w, i + j) for j in range(K)]).alias("hash"))
        grams = F.filter(F.transform(F.sequence(F.lit(0), F.size(w) - K), run), lambda g: F.get(may_be, g["hash"].bitwiseAND(F.lit((1 << TABLE_BITS) - 1)).cast("int")))
        return F.struct(F.size(w).cast("long").alias("n_words"), F.when(F.size(w) >= K, grams).alias("grams"))

    # an array of one: so the words are split once
    return docs.select("doc_id", F.transform(F.array(words(F.col("text"))), scan)[0].alias("s")).select(F.monotonically_increasing_id().alias("row"), "doc_id", "s.*")


def _chain() -> Column:
    """n, first, last (positions of its first and last run) of the longest chain of hits (at, t_at), which are in order; null without hits."""
    link = "named_struct('n', cast({n} as int), 'first', cast({first} as int), 'last', cast({last} as int))".format
    limit = f"cast({STRETCH} * (n_runs + {K - 1}) as int)"
    before = f"array_max(transform(filter(slice(s.best, 1, h.t_at), b -> b.n > 0 AND b.last < h.at AND h.at + {K} - b.first <= {limit}), b -> named_struct('n', b.n, 'first', b.first)))"
    new = f"transform(array({before}), p -> {link(n='coalesce(p.n, 0) + 1', first='coalesce(p.first, h.at)', last='h.at')})[0]"
    step = f"""transform(array({new}), x -> named_struct(
        'best', transform(s.best, (b, i) -> IF(i = h.t_at AND (x.n >= b.n OR h.at + {K} - b.first > {limit}), x, b)),
        'top', IF(x.n > s.top.n, x, s.top)))[0]"""
    none = link(n="0", first="0", last="-1")
    return F.expr(f"aggregate(hits, named_struct('best', array_repeat({none}, n_runs), 'top', {none}), (s, h) -> {step}, s -> s.top)")


def spans(rows: DataFrame, templates: DataFrame) -> DataFrame:
    """row, template, label, base, first, last (word positions), share: every verified span of marked rows."""
    hits = rows.select("row", F.explode("grams").alias("g")).select("row", "g.*").join(F.broadcast(templates), "hash")
    key = ["row", "template", "label", "base", "n_runs"]
    votes = hits.groupBy(*key, (F.col("at") - F.col("t_at")).alias("diagonal")).agg(F.collect_list(F.struct("at", "t_at")).alias("held"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = ~F.coalesce(~F.col("base") & (F.col("diagonal") - F.lag("diagonal").over(order) <= NEIGHBOURS), F.lit(False))
    groups = votes.withColumn("group", F.sum(apart.cast("int")).over(order)).groupBy(*key, "group").agg(F.sort_array(F.flatten(F.collect_list("held"))).alias("hits"))
    found = groups.where(F.size("hits") >= LEAST_SHARE * F.col("n_runs")).withColumn("chain", _chain()).withColumn("share", F.col("chain.n") / F.col("n_runs"))
    kept = found.where(F.when(F.col("base"), F.col("share") == 1).otherwise(F.col("share") >= LEAST_SHARE))
    return kept.select("row", "template", "label", "base", F.col("chain.first").alias("first"), (F.col("chain.last") + K - 1).alias("last"), "share")


def scanned(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row a document; templates: further ones, (words, label)."""
    docs = pick(docs, "doc_id", "text")
    known = runs(docs.sparkSession, templates)
    rows = settle(marked(docs, known), "grams")
    found = spans(rows, known).groupBy("row").agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("first"))).cast("long").alias("last_word"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label"))))).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.collect_set("label"))).alias("labels"),
        F.max("share").alias("score"),
    )
    zero = lambda c, z: F.coalesce(c, F.lit(z)).alias(c)
    return rows.drop("grams").join(found, "row", "left").select("doc_id", "n_words", zero("n_base", 0), "first_word", "last_word", zero("base_labels", ""), zero("labels", ""), zero("score", 0.0))


def op9_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))
