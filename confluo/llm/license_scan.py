"""License scans by diagonal voting, with DataFrame functions only.

All rolling two-word hashes of a text are joined with those of the templates; a hit at word p of the text and word q of the
template votes for the diagonal p - q. A diagonal is judged with its neighbours within ``DRIFT``, so inserted or lost words
don't part a match: of the template's word pairs those count that stand in the template's order, each once. Of
neighbouring diagonals that are good enough the best is the span. Hits are held against the words as well as their hash, so
a vote is exact, and a phrase stands consecutively exactly where its single diagonal has every vote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from confluo.llm.common import ID, KEY, TEXT, cut, narrow, row_key

#: Phrases of the base scan and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices that the method looks for, and their labels.
TEMPLATES = {
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-2.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under a creative commons attribution 4 0 international license": "cc-by",
    "licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "this work is dedicated to the public domain": "public-domain",
    "copyright all rights reserved": "reserved",
}
#: Words that a match may shift, and the least share of a template's word pairs.
DRIFT, AT = 3, 0.6
#: Everything in ASCII but letters and digits parts words.
PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words after lower-casing A-Z only; lower() does the same but for the two letters whose lower case is in ASCII."""
    odd = text.contains("K") | text.contains("İ")
    low = F.when(odd, F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    return F.filter(F.split(F.coalesce(low, F.lit("")), PARTS), lambda w: w != "")


def template_grams(spark: SparkSession, templates: dict[str, str], base: dict[str, str]) -> DataFrame:
    """(template, label, base, pairs, q, t_first, t_second, hash), one row a pair of neighbouring words of a template."""
    rows = [(t, label, kind, len(w) - 1, q, w[q], w[q + 1]) for kind, many in ((True, base), (False, templates)) for t, label in many.items() for w in (t.split(),) for q in range(len(w) - 1)]
    grams = spark.createDataFrame(rows, "template string, label string, base boolean, pairs int, q int, t_first string, t_second string")
    return grams.withColumn("hash", F.xxhash64("t_first", "t_second"))


def in_order(votes: Column) -> Column:
    """Of (q, p) pairs, those that stand in order: in rising q, each at the first place after the one before."""
    start = F.struct(F.lit(-1).alias("q"), F.lit(-1).alias("p"), F.lit(0).alias("n"), F.lit(-1).alias("from"))
    first = lambda s, x: F.when(s["n"] == 0, x["p"]).otherwise(s["from"])
    onward = lambda s, x: F.struct(x["q"].alias("q"), x["p"].alias("p"), (s["n"] + 1).alias("n"), first(s, x).alias("from"))
    return F.aggregate(F.array_sort(votes), start, lambda s, x: F.when((x["q"] > s["q"]) & (x["p"] > s["p"]), onward(s, x)).otherwise(s))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, base: dict[str, str] | None = None, at: float = AT) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) for each row.

    ``spans``: (start, end, label, score) of each verified place, in words; ``score`` is the best of them. Null texts are
    empty: no words, no labels (empty strings), score 0; null ids and repeated rows each get their row; an empty table gives
    no rows; other columns are ignored. Templates have two words or more.
    """
    spark, templates, base = docs.sparkSession, TEMPLATES if templates is None else templates, BASE if base is None else base
    grams = template_grams(spark, templates, base)
    d = narrow(docs, id_col, text_col).withColumn(KEY, row_key(F.col(ID), F.col(TEXT)))
    w = d.select(ID, KEY, words_of(F.col(TEXT)).alias("words"))
    after = F.slice("words", 2, F.greatest(F.size("words"), F.lit(1)))
    both = F.zip_with("words", after, lambda a, b: F.struct(a.alias("first"), b.alias("second")))
    rolling = w.select(KEY, F.posexplode(both).alias("p", "w")).select(KEY, "p", "w.first", "w.second").where("second is not null")
    rolling = rolling.withColumn("hash", F.xxhash64("first", "second"))
    hits = rolling.join(F.broadcast(grams), "hash").where("first = t_first and second = t_second")  # the templates are a parameter of a few hundred words
    votes = cut(hits.select(KEY, "template", "label", "base", "pairs", "q", "p", (F.col("p") - F.col("q")).alias("d")).distinct())
    group = [KEY, "template", "label", "pairs"]
    exact = votes.where("base").groupBy(*group, "d").agg(F.count("*").alias("votes")).where("votes = pairs")
    exact_base = exact.select(KEY, "label", F.col("d").alias("start"), (F.col("d") + F.col("pairs")).alias("stop"), F.lit(1.0).alias("score"), F.lit(True).alias("base"))
    # A diagonal has each word pair once at most, so a document's template with too few pairs on all of them is none.
    enough = votes.where("not base").groupBy(KEY, "template").agg(F.count_distinct("q").alias("qs"), F.first("pairs").alias("of"))
    some = votes.join(enough.where(F.col("qs") >= at * F.col("of")).select(KEY, "template"), [KEY, "template"])
    diagonals = some.groupBy(*group, "d").agg(F.collect_list(F.struct("q", "p")).alias("votes"))
    line = W.partitionBy(KEY, "template").orderBy("d")
    near = F.flatten(F.collect_list("votes").over(line.rangeBetween(-DRIFT, DRIFT)))
    judged = diagonals.withColumn("m", in_order(near)).withColumn("score", F.col("m.n") / F.col("pairs").cast("double")).where(F.col("score") >= at)
    new = F.coalesce(F.col("d") - F.lag("d").over(line) > DRIFT, F.lit(True)).cast("int")
    runs = judged.withColumn("new", new).withColumn("run", F.sum("new").over(line.rowsBetween(W.unboundedPreceding, W.currentRow)))
    best = F.max(F.struct("score", (-F.col("d")).alias("d"), F.col("m.from").alias("start"), (F.col("m.p") + 1).alias("stop"))).alias("best")
    by_method = runs.groupBy(*group, "run").agg(best).select(KEY, "label", "best.start", "best.stop", "best.score", F.lit(False).alias("base"))
    every = exact_base.unionByName(by_method)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    only = lambda c: F.when(F.col("base"), F.col(c))
    per = every.groupBy(KEY).agg(
        F.count(only("start")).alias("n_base"),
        F.min(only("start")).cast("long").alias("first_word"),
        F.max(only("start")).cast("long").alias("last_word"),
        joined(only("label")).alias("base_labels"),
        joined(F.col("label")).alias("labels"),
        F.max("score").alias("score"),
        F.array_sort(F.collect_list(F.struct("start", F.col("stop").alias("end"), "label", "score"))).alias("spans"),
    )
    out = w.select(ID, KEY, F.size("words").cast("long").alias("n_words")).join(per, KEY, "left")
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    n_base, score = F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.coalesce("score", F.lit(0.0)).alias("score")
    found = ["first_word", "last_word", empty("base_labels"), empty("labels"), score, "spans"]
    return out.select(F.col(ID).alias(id_col), "n_words", n_base, *found)
