"""License scan by diagonal voting (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Tokens: ASCII letters and digits, and everything beyond ASCII.
TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases, each with the label it stands for.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Wording of public licenses and of the usual notices.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)


#: Hash flags, a byte each, that tell which words and grams can be in a template.
FLAGS = 8192


def _rolling(hashes: str, at: str, n: int) -> str:
    """SQL of the hash of the n words from a place on, from the hashes of single words."""
    return "xxhash64(" + ", ".join(f"get({hashes}, {at} + {j})" for j in range(n)) + ")"


def template_grams(spark: SparkSession, phrases=PHRASES, templates=TEMPLATES, k: int = 4) -> DataFrame:
    """A row for each rolling gram of each phrase and template: min(k, its words) words, its position, and its hash."""
    rows = []
    for t, (text, label, base) in enumerate([(p, lab, True) for p, lab in phrases] + [(x, lab, False) for lab, x in templates]):
        words = text.split()
        n = min(k, len(words))
        rows += [(t, label, base, len(words) - n + 1, len(words), n, i, " ".join(words[i : i + n])) for i in range(len(words) - n + 1)]
    table = spark.createDataFrame(rows, "tid int, label string, base boolean, grams int, words int, size int, tpos int, gram string")
    table = table.withColumn("_g", F.expr("transform(split(gram, ' '), x -> xxhash64(x))"))
    sizes = sorted({r[5] for r in rows})
    code = " ".join(f"when {n} then {_rolling('_g', '0', n)}" for n in sizes)
    return table.withColumn("first", F.expr("get(_g, 0)")).withColumn("code", F.expr(f"case size {code} end")).drop("_g")


def _flagged(codes: set[int], x: str) -> str:
    """SQL that is true if x may be one of the codes: a byte of a literal, found by the low bits of x."""
    flags = bytearray(FLAGS)
    for c in codes:
        flags[c & (FLAGS - 1)] = 1
    return f"substring(X'{flags.hex()}', cast({x} & {FLAGS - 1} as int) + 1, 1) = X'01'"


def license_scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, share: float = 0.8, slack: int = 2, k: int = 4) -> DataFrame:
    """Where license phrases and passages stand in each document.

    docs has doc_id and text. Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, one row for each row of docs.

    The hash of every position's rolling gram, all its k words, is joined to the positions of all phrases and
    templates, a list of a few hundred rows that is broadcast; a phrase of fewer words is a gram of its own. Flags of
    the hashes in that list leave out positions that cannot match before they become rows. A match whose words are
    those of the gram, which tells chance matches of hashes, votes for the diagonal (document position less template
    position). A phrase stands where all its grams vote on one diagonal. For templates, diagonals at most `slack`
    apart are merged, so that a word put in or left out does not end a span; a span counts if distinct template
    positions of at least `share` of the template voted, so that their words stand there, and it is at most half as
    long again as the template. score is the largest share of any span, 1 for a phrase.

    Null text is empty: no words, no labels, score 0, first_word and last_word null. Only A-Z are lowered.
    Repeated rows give repeated results; a null doc_id is kept. Votes are combined by document and diagonal
    before the shuffle; one document is the largest group. An empty table gives an empty result. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    grams = template_grams(spark, phrases, templates, k)
    known = grams.select("first", "size", "code").distinct().collect()
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("_x"), F.regexp_extract_all(text, F.lit(TOKEN), 0).alias("_w"))
    # lower() changes more than A-Z, but no word that has only ASCII letters; the words decide.
    rows = rows.withColumn("_h", F.expr("transform(_w, x -> xxhash64(lower(x)))"))
    rows = rows.withColumn("_c", F.expr(f"array_compact(transform(_h, (x, i) -> if({_flagged({r['first'] for r in known}, 'x')}, i, null)))"))
    found = []
    for n in sorted({r["size"] for r in known}):
        whole = f"filter(transform(_c, i -> struct(i as p, {_rolling('_h', 'i', n)} as code)), s -> s.p <= size(_h) - {n} and {_flagged({r['code'] for r in known if r['size'] == n}, 's.code')})"
        found.append(f"transform({whole}, s -> struct(s.p as p, {n} as n, s.code as code, array_join(slice(_w, s.p + 1, {n}), ' ') as gram))")
    # One more element, of no gram, carries the number of words: every document has a row.
    marker = "array(struct(cast(null as int) as p, 0 as n, 0L as code, cast(null as string) as gram))"
    rows = rows.withColumn("_k", F.expr(f"concat({marker}, {', '.join(found)})"))
    # The outer form adds no filter on the array, which would be pushed below and made again of whole texts.
    rows = rows.select("doc_id", "_x", F.size("_w").alias("_n"), F.explode_outer("_k").alias("_k"))
    rows = rows.select("doc_id", "_x", "_n", F.col("_k.p").alias("_p"), F.col("_k.n").alias("_size"), F.col("_k.code").alias("_code"), F.translate("_k.gram", UPPER, LOWER).alias("_g"))
    same = (F.col("_code") == F.col("code")) & (F.col("_size") == F.col("size")) & (F.col("_g") == F.col("gram"))
    votes = rows.join(F.broadcast(grams.drop("first")), same, "left").where(F.col("tid").isNotNull() | F.col("_g").isNull())
    by_doc = ["doc_id", "_x"]
    per = votes.groupBy(*by_doc, "_n", "tid", "label", "base", "grams", "words", (F.col("_p") - F.col("tpos")).alias("_diag")).agg(
        F.collect_set("tpos").alias("_hit"), F.min("_p").alias("_from"), F.max("_p").alias("_to"), F.count("*").alias("_rows")
    )
    # Neighbouring diagonals of a template become one span; phrases stay on one diagonal.
    along = Window.partitionBy(*by_doc, "tid").orderBy("_diag")
    fresh = F.coalesce(F.col("base") | (F.col("_diag") - F.lag("_diag").over(along) > slack), F.lit(True))
    per = per.withColumn("_fresh", fresh.cast("int"))
    per = per.withColumn("_span", F.sum("_fresh").over(along))
    spans = per.groupBy(*by_doc, "_n", "tid", "label", "base", "grams", "words", "_span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("_hit")))).alias("_votes"), F.min("_from").alias("_from"), F.max("_to").alias("_to"), F.max("_rows").alias("_rows")
    )
    covered = F.col("_votes") / F.col("grams")
    fits = (F.col("_to") - F.col("_from") + 1) <= 1.5 * F.col("grams")
    ok = F.when(F.col("base"), covered >= 1).otherwise((covered >= share) & fits)
    place = F.when(F.col("base") & ok, F.col("_from")).cast("long")
    # Repeated rows of one document voted together: the row count of the marker says how many there were.
    out = spans.groupBy(*by_doc, "_n").agg(
        F.count(place).alias("n_base"), F.min(place).alias("first_word"), F.max(place).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base") & ok, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(ok, F.col("label")))), ",").alias("labels"),
        F.max(F.when(F.col("base"), F.when(ok, 1.0)).when(fits | ok, F.least(covered, F.lit(1.0)))).alias("_score"),
        F.max(F.when(F.col("tid").isNull(), F.col("_rows"))).alias("_copies"),
    )
    out = out.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return out.select("doc_id", F.col("_n").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", F.coalesce("_score", F.lit(0.0)).alias("score"))
