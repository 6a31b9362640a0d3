"""License scan: phrase places, and an exact containment join of text blocks with license templates.

A block is a line and the words behind it, over line breaks and blank lines, as many as the longest template has
less one: so every window of so many consecutive words lies in a block, however a notice is wrapped.
Tokens are ordered by their document frequency over all texts, rarest first.  A block can only
contain ``need`` of a template's ``m`` tokens if it holds one of the template's first ``m - need + 1``
(prefix filter), has ``need`` template tokens at all (length filter), and has enough tokens left
behind the place where the two first meet (positional filter).  Survivors are counted exactly.
Every block and template at or above the threshold is found, and each gives its label.  Licenses are worded alike, so
one look-alike is left out: a template all of whose words found in the block are words of another one found there,
of which the block contains more.

Defined results: a null text counts as empty: no words, empty labels, score 0; repeated rows and
null ids are scanned row by row; an empty table gives an empty result.  Only the id and text
columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rttscope.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrase and label.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Label and notice, in words.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "this work is dedicated to the public domain under cc0 1 0 universal"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
CONTAINMENT = 0.8


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def places(words: str, phrase: list[str]) -> Column:
    """Starts of the phrase in the word array; shifted copies are zipped, so one pass sees each place."""
    shifted = ", ".join(f"slice({words}, {k + 1}, size({words}))" for k in range(len(phrase)))
    test = " and ".join(f"z.`{k}` = '{w}'" for k, w in enumerate(phrase))
    names = ", ".join(f"'{k}', x.`{k}`" for k in range(len(phrase)))
    zipped = f"transform(arrays_zip({shifted}), (x, i) -> named_struct('at', cast(i as bigint), {names}))"
    return F.expr(f"transform(filter({zipped}, z -> {test}), z -> z.at)")


def phrase_test(text: Column, phrases) -> Column:
    """Whether the text may hold one of the phrases: a cheap test before words are cut."""
    gap = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return text.rlike("|".join(gap.join(p.split()) for p, _ in phrases))


def template_table(spark, templates=TEMPLATES, threshold: float = CONTAINMENT) -> DataFrame:
    """(template, label, tokens, need, length): distinct tokens, how many of them a block must contain, words in all."""
    rows = spark.createDataFrame([(k, *t) for k, t in enumerate(templates)], "template int, label string, notice string")
    words = words_of(lower_ascii(F.col("notice")))
    tokens = rows.select("template", "label", F.array_distinct(words).alias("tokens"), F.size(words).alias("length")).where("size(tokens) > 0")
    return tokens.withColumn("need", F.greatest(F.lit(1), F.ceil(F.size("tokens") * threshold - 1e-9).cast("int")))


def blocks_of(docs: DataFrame, ordered: list[str], length: int) -> DataFrame:
    """(row, block, tokens): the template tokens of each line with the ``length`` - 1 words behind it, in global order."""
    known = F.array(*map(F.lit, ordered))  # array_intersect keeps the first array's order
    lines = docs.select("row", F.filter(F.transform(F.split("lowered", "\n"), words_of), lambda w: F.size(w) > 0).alias("lines"))
    heads = lines.select("row", "lines", F.transform("lines", lambda w: F.slice(w, 1, max(1, length - 1))).alias("heads"))
    behind = lambda i: F.slice(F.flatten(F.slice("heads", i + 2, F.lit(length - 1))), 1, length - 1)
    tokens = F.transform("lines", lambda w, i: F.array_intersect(known, F.concat(w, behind(i))))
    return heads.select("row", F.posexplode(tokens).alias("block", "tokens"))


def containment(blocks: DataFrame, templates: DataFrame, ordered: list[str]) -> DataFrame:
    """(row, block, label, containment, shared) of every block that contains enough of a template."""
    known = F.array(*map(F.lit, ordered))
    ranked = templates.withColumn("tokens", F.array_intersect(known, F.col("tokens"))).withColumn("m", F.size("tokens"))
    prefix = ranked.select("*", F.posexplode(F.slice("tokens", F.lit(1), F.col("m") - F.col("need") + 1)).alias("i", "token"))
    probe = blocks.select("row", "block", F.col("tokens").alias("own"), F.posexplode("tokens").alias("j", "token"))
    left = F.least(F.col("m") - F.col("i"), F.size("own") - F.col("j"))
    # the templates are given, so they travel to the blocks: a frequent token's blocks stay where they are
    met = probe.join(F.broadcast(prefix), "token").where((F.size("own") >= F.col("need")) & (left + F.least("i", "j") >= F.col("need")))
    shared = F.array_intersect("own", "tokens")
    # a block and a template may meet at several prefix tokens; they count at the first
    exact = met.where((F.col("token") == F.element_at(shared, 1)) & (F.size(shared) >= F.col("need")))
    return exact.select("row", "block", "label", (F.size(shared) / F.col("m")).alias("containment"), shared.alias("shared"))


def told_apart(found: DataFrame) -> DataFrame:
    """(row, label, containment) without look-alikes; a block is met by no more rows than there are templates."""
    blocks = found.groupBy("row", "block").agg(F.collect_list(F.struct("containment", "label", "shared")).alias("met"))
    within = lambda x, y: (y["containment"] > x["containment"]) & (F.size(F.array_except(x["shared"], y["shared"])) == 0)
    own = F.filter("met", lambda x: ~F.exists("met", lambda y: within(x, y)))
    return blocks.select("row", F.explode(own).alias("x")).select("row", "x.label", "x.containment")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES, threshold: float = CONTAINMENT) -> DataFrame:
    """Words, phrase places, labels and score of every row of ``docs``."""
    rules = template_table(docs.sparkSession, templates, threshold)
    needs = rules.select("tokens", "need", "length").collect()  # the templates given
    vocabulary = sorted({t for r in needs for t in r.tokens})
    known = F.array(*map(F.lit, vocabulary)).cast("array<string>")
    lowered = docs.select(F.col(id_col).alias("id"), lower_ascii(F.coalesce(F.col(text_col), F.lit(""))).alias("lowered"))
    words = lowered.select("id", "lowered", words_of(F.col("lowered")).alias("words"))
    counted = words.select("id", "lowered", F.size("words").cast("long").alias("n_words"), F.array_intersect(known, F.col("words")).alias("tokens"),
                           phrase_test(F.col("lowered"), phrases).alias("has_phrase"))
    may = F.lit(False)  # a whole text with too few of a template's tokens has no block with enough
    for r in needs:
        may = may | (F.size(F.array_intersect(F.col("tokens"), F.array(*map(F.lit, r.tokens)))) >= r.need)
    table = materialise(
        counted.withColumn("may_match", may).withColumn("row", F.expr("uuid()")).withColumn("lowered", F.when(F.col("may_match") | F.col("has_phrase"), F.col("lowered"))),
        "license-words")
    counts = {r.token: r.n for r in table.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}  # one row per template token
    ordered = sorted(vocabulary, key=lambda t: (counts.get(t, 0), t))
    found = containment(blocks_of(table.where("may_match"), ordered, max((r.length for r in needs), default=1)), rules, ordered)
    labels = told_apart(found)
    by_row = labels.groupBy("row").agg(F.collect_set("label").alias("method"), F.max("containment").alias("containment"))
    cut = table.where("has_phrase").select("row", words_of(F.col("lowered")).alias("words"))
    base = cut.select("row", *(places("words", p.split()).alias(f"at{k}") for k, (p, _) in enumerate(phrases)))
    everywhere = F.concat(*(F.col(f"at{k}") for k in range(len(phrases))))
    present = F.array(*(F.when(F.size(f"at{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(phrases)))
    base = base.select("row", F.size(everywhere).cast("long").alias("n_base"), F.array_min(everywhere).alias("first_word"), F.array_max(everywhere).alias("last_word"),
                       F.filter(present, lambda x: x.isNotNull()).alias("base"))
    none = F.array().cast("array<string>")
    return table.select("id", "n_words", "row").join(base.join(by_row, "row", "full"), "row", "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.array_join(F.array_sort(F.array_distinct(F.coalesce("base", none))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(F.coalesce("base", none), F.coalesce("method", none))), ",").alias("labels"),
        F.when(F.coalesce("n_base", F.lit(0)) > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )
