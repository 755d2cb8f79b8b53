"""Licence scan by a positional rare-token index. DataFrame functions only.

1. Corpus document frequencies of the template vocabulary give every licence word its IDF.
2. A file is looked up if it has the rarest key-phrase word of some template (a template can't match without its
   mandatory phrase, so nothing is missed). Every template has postings (word -> template, position) of the ``VOTES``
   words of its phrase with the highest IDF; all of a file's words are looked up in them.
3. Postings are intersected by relative position: file position minus template position must agree for all of the
   template's posted words. They do wherever its phrase stands, whatever else the file holds.
4. At that alignment the template's mandatory key phrase must stand word for word. The score is the share of the
   template's words found in place.

Only the vocabulary's IDF table (as long as the templates) reaches the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_FROM, LOWER_TO, stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
VOTES = 2                   # posted words per template

# Phrases and labels of the base rule.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Opening notices of well-known licences: label, text, mandatory key phrase.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in "
                   "compliance with the license", "apache license version 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction",
     "permission is hereby granted free of charge"),
    ("mit", "released under the mit license", "the mit license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation", "gnu general public license"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3",
     "gnu general public license version 3"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2",
     "gnu general public license version 2"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation",
     "gnu lesser general public license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license",
     "creative commons attribution 4 0 international"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted", "for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0",
     "mozilla public license v 2 0"),
)


def _strings(values) -> Column:
    return F.array(*map(F.lit, values))


def words_of(text: Column) -> Column:
    """Array of the words of a text, A-Z lower-cased; null counts as empty."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), LOWER_FROM, LOWER_TO)
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def document_frequencies(docs: DataFrame, vocabulary) -> tuple[int, dict[str, int]]:
    """(documents, {word: documents with it}) over all documents; one row per vocabulary word comes back."""
    found = docs.select(F.explode(F.array_append(F.array_intersect(words_of(F.col("text")), _strings(vocabulary)), F.lit("")))
                        .alias("word"))
    df = {r.word: r.n for r in found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return df.pop("", 0), df


def phrase_places(words: Column, phrase: str) -> Column:
    """Word positions where the phrase stands."""
    parts = phrase.split()
    def stands(i):
        return reduce(lambda a, b: a & b, [F.get(words, i + k) == p for k, p in enumerate(parts)])
    last = F.size(words) - len(parts)
    return F.filter(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")), stands)


def posted_words(df: dict[str, int], templates=TEMPLATES) -> list[tuple[str, int, int]]:
    """(word, template, position in the template) of the ``VOTES`` rarest different words of every key phrase."""
    out = []
    for t, (_, text, phrase) in enumerate(templates):
        parts = phrase.split()
        start = _place(text.split(), parts)
        rarest = sorted(set(parts), key=lambda w: (df.get(w, 0), w))[:VOTES]
        out += [(w, t, start + parts.index(w)) for w in rarest]
    return out


def alignments(files: DataFrame, df: dict[str, int], templates=TEMPLATES) -> DataFrame:
    """(doc_id, fp, found: [(template, offset)]) where all posted words of a template agree. ``files``: doc_id, fp, words."""
    posted = posted_words(df, templates)
    postings = files.sparkSession.createDataFrame(posted, "word string, template int, at int")
    needed = [len({w for w, k, _ in posted if k == t}) for t in range(len(templates))]
    rare = _strings(sorted({w for w, _, _ in posted}))
    hits = (files.select("doc_id", "fp", F.explode(F.filter(
                F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("place"))),
                lambda x: F.array_contains(rare, x["word"]))).alias("hit"))
            .select("doc_id", "fp", "hit.word", "hit.place"))
    votes = (hits.join(F.broadcast(postings), "word")            # as many rows as the templates have posted words
             .select("doc_id", "fp", "word", "template", (F.col("place") - F.col("at")).alias("offset")).distinct()
             .groupBy("doc_id", "fp", "template", "offset").agg(F.count(F.lit(1)).alias("n"))
             .where(F.col("n") >= F.get(F.array(*map(F.lit, needed)), F.col("template"))))
    return votes.groupBy("doc_id", "fp").agg(F.collect_list(F.struct("template", "offset")).alias("found"))


def _verified(words: Column, found: Column, templates) -> Column:
    """[(label, score)] of the alignments at which the key phrase stands."""
    texts = F.array(*(_strings(t.split()) for _, t, _ in templates))
    starts = F.array(*(F.lit(_place(t.split(), p.split())) for _, t, p in templates))
    sizes = F.array(*(F.lit(len(p.split())) for _, _, p in templates))
    labels = _strings(x for x, _, _ in templates)

    def judge(a):
        k = a["template"]
        right = F.transform(F.get(texts, k), lambda w, q: F.coalesce(F.get(words, a["offset"] + q) == w, F.lit(False)))
        phrase = F.forall(F.slice(right, F.get(starts, k) + 1, F.get(sizes, k)), lambda x: x)
        share = F.size(F.filter(right, lambda x: x)) / F.size(right)
        return F.struct(F.get(labels, k).alias("label"), F.when(phrase, share).otherwise(F.lit(0.0)).alias("score"))
    return F.filter(F.transform(found, judge), lambda x: x["score"] > 0)


def _place(words: list[str], phrase: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i:i + len(phrase)] == phrase)


def scan_licences(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, one row per document.

    Null or empty text: no words, no labels, score 0. Score is that of the best verified template, 0 without one (also
    where only base phrases were found). Repeated rows: equal results. No rows: no rows.
    """
    vocabulary = sorted({w for _, text, _ in templates for w in text.split()})
    _, df = document_frequencies(docs, vocabulary)
    keys = {min(p.split(), key=lambda w: (df.get(w, 0), w)) for _, _, p in templates}
    keys |= {min(p.split(), key=lambda w: (df.get(w, 0), w)) for p, _ in BASE}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("fp"),
                       words_of(F.col("text")).alias("words"))
    files = stored(rows.select("doc_id", "fp", F.size("words").cast("long").alias("n_words"),
                               F.when(F.arrays_overlap("words", _strings(sorted(keys))), F.col("words")).alias("words")),
                   "licence-files")
    looked = files.where(F.col("words").isNotNull()).dropDuplicates(["doc_id", "fp"])
    found = alignments(looked, df, templates).select(
        F.col("doc_id").alias("f_id"), F.col("fp").alias("f_fp"), "found")
    on = looked["doc_id"].eqNullSafe(found["f_id"]) & (looked["fp"] == found["f_fp"])
    places = [phrase_places(F.col("words"), p).alias(f"p{i}") for i, (p, _) in enumerate(BASE)]
    none = F.array().cast("array<struct<label:string,score:double>>")
    judged = (looked.join(found, on, "left")
              .select("doc_id", "fp", *places, F.coalesce(_verified(F.col("words"), F.col("found"), templates), none).alias("hits")))
    every = F.concat(*(F.col(f"p{i}") for i in range(len(BASE))))
    base = F.array_sort(F.array_distinct(F.array_compact(F.array(
        *(F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(BASE))))))
    more = F.array_sort(F.array_union(base, F.transform("hits", lambda x: x["label"])))
    verdict = judged.select(
        F.col("doc_id").alias("v_id"), F.col("fp").alias("v_fp"), F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(more, ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("hits", lambda x: x["score"])), F.lit(0.0)).alias("score"))
    same = files["doc_id"].eqNullSafe(verdict["v_id"]) & (files["fp"] == verdict["v_fp"])
    return files.drop("words").join(verdict, same, "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
