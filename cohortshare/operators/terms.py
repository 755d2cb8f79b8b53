"""Terminology mapping: raw term -> best vocabulary code by hybrid string similarity.

score(term, name) = 0.4 * edit_similarity + 0.6 * char-bag cosine; the best name
wins, ties keep the earliest vocabulary entry, and a score below 0.85 is sent
to manual review.

Plan shape: the rows are reduced to distinct terms first (partial aggregate).
Exact names are resolved by an equi-join; only the rest are scored, through an
inverted index of characters with score upper bounds:

1. A term's characters are ordered by rarity in the vocabulary.  A few names per
   term are scored exactly, the best of them is a lower bound of the term's best
   score: names whose sorted characters equal the term's but for one on either side,
   and names with a rare character of the term and a like length (``SEEDS`` a key).
2. A name that shares none of the term's first p characters shares at most the
   rest.  With c characters left of l, and norm r left of n, its score is at most
   ``0.4 c / l + 0.6 r / n`` (the edit distance is at least the unshared length, the
   cosine falls under Cauchy-Schwarz).  Postings of characters from the place on
   where this falls below the lower bound are skipped.
3. A pair that meets at a posting is met once, at its first common character, and
   is dropped by the same bound for what can still be shared from there, and for the
   two lengths; the shared counts then bound the edit part before Levenshtein runs.

A vocabulary that fits a matrix (names times characters within ``MATRIX_CELLS``) needs no
index: blocks of terms are scored against all its names by products of character counts
(:mod:`functions.term_blocks`), so that terms unlike any name cost no more than others.

No pair that could win, or tie, is skipped: bounds are compared with a margin above
rounding.  The vocabulary's side is broadcast only after a check of its postings;
otherwise the joins shuffle on the character, and AQE splits hot characters.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import term_blocks
from ..functions.text import chars, col_of
from ..sources.vocab import clean_vocab

# Fixed values of the method.
EDIT_WEIGHT = 0.4
COSINE_WEIGHT = 0.6
THRESHOLD = 0.85

BROADCAST_VOCAB_ROWS = 200_000     # postings (name, character) of a vocabulary that is broadcast
SEEDS = 4                          # names per key that may set a term's lower bound
SEED_CHARS = 2                     # rare characters of a term that seeds are looked up by
MATRIX_CELLS = 1 << 21             # names times characters of a vocabulary that terms are scored against by matrix products
_MARGIN = 1e-9


def edit_similarity(a, b) -> Column:
    """1 - lev(a, b) / max(len a, len b, 1)."""
    a, b = col_of(a), col_of(b)
    return F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def char_cosine(a, b) -> Column:
    """B6/B7/F3/G1 inside one row: cosine of the two character bags (0 if either is empty)."""
    a, b = col_of(a), col_of(b)
    ca, cb = chars(a), chars(b)
    vocab = F.array_sort(F.array_union(F.array_distinct(ca), F.array_distinct(cb)))

    def cnt(arr):
        return lambda ch: F.size(F.filter(arr, lambda x: x == ch)).cast("double")

    va = F.transform(vocab, cnt(ca))
    vb = F.transform(vocab, cnt(cb))
    dot = F.aggregate(F.zip_with(va, vb, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    na = F.sqrt(F.aggregate(va, F.lit(0.0), lambda acc, x: acc + x * x))
    nb = F.sqrt(F.aggregate(vb, F.lit(0.0), lambda acc, x: acc + x * x))
    den = na * nb
    return dot / F.when(den == 0, F.lit(1.0)).otherwise(den)


def hybrid_score(a, b) -> Column:
    """B8 inside one row (for spot checks; the mapper uses the join form)."""
    return F.lit(EDIT_WEIGHT) * edit_similarity(a, b) + F.lit(COSINE_WEIGHT) * char_cosine(a, b)


def classify(best: Column, threshold: float = THRESHOLD) -> Column:
    """On the unrounded score."""
    return F.when(best >= F.lit(threshold), F.lit("matched")).otherwise(F.lit("needs_manual_review"))


def char_bag(df: DataFrame, s: str) -> DataFrame:
    """(s, ch, c) rows, the character counts of each distinct string (empty string: no rows)."""
    return (df.select(s, F.explode(chars(s)).alias("ch"))
            .groupBy(s, "ch").agg(F.count(F.lit(1)).cast("double").alias("c")))


def _bag(s: str) -> Column:
    """The character counts of a string as a map, in its row."""
    ch = chars(s)
    return F.map_from_entries(F.transform(F.array_distinct(ch), lambda c: F.struct(
        c, F.size(F.filter(ch, lambda x: x == c)).cast("double"))))


def _norm(bag: Column) -> Column:
    return F.sqrt(F.aggregate(F.map_values(bag), F.lit(0.0), lambda acc, x: acc + x * x))


def _common(a: Column, b: Column, use) -> Column:
    """Sum of ``use(count in a, count in b)`` over the characters of ``a``."""
    return F.aggregate(F.map_entries(a), F.lit(0.0), lambda acc, e: acc + use(e["value"], F.coalesce(F.element_at(b, e["key"]), F.lit(0.0))))


def _near_keys(s: str) -> Column:
    """Hashes of a string's sorted characters, whole and with each one left out."""
    ch = F.array_sort(chars(s))
    less = F.transform(F.sequence(F.lit(1), F.greatest(F.size(ch), F.lit(1))), lambda i: F.concat(F.slice(ch, 1, i - 1), F.slice(ch, i + 1, F.size(ch))))
    return F.array_distinct(F.transform(F.array_append(less, ch), lambda x: F.xxhash64(x)))


class VocabIndex:
    """The vocabulary's names with their character bags, postings, and characters by rarity."""

    def __init__(self, vocab: DataFrame, broadcast_rows: int = BROADCAST_VOCAB_ROWS):
        self.entries = clean_vocab(vocab)
        names = (self.entries.withColumn("bag_n", _bag("std_name")).withColumn("norm_n", _norm(F.col("bag_n")))
                 .withColumn("len_n", F.length("std_name")))
        postings = names.select(F.explode(F.map_keys("bag_n")).alias("ch"), "std_name", "ord", "code", "bag_n", "norm_n", "len_n")
        rarity = postings.groupBy("ch").agg(F.count(F.lit(1)).alias("df"))
        self.small = (rarity.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]) <= broadcast_rows
        rows = ("std_name", "bag_n", "norm_n", "len_n")
        like = postings.select(F.xxhash64("ch", "len_n").alias("key"), *rows, "ord")
        near = names.select(F.explode(_near_keys("std_name")).alias("key"), *rows, "ord")
        by_ord = Window.partitionBy("key").orderBy("ord")
        seeds = (like.unionByName(near).withColumn("i", F.row_number().over(by_ord)).where(F.col("i") <= SEEDS).select("key", *rows))
        self.rarity, self.postings, self.seeds = (F.broadcast(x) if self.small else x for x in (rarity, postings, seeds))


    def as_matrix(self) -> term_blocks.Names | None:
        """A small vocabulary of names within a machine word, if names times characters is within ``MATRIX_CELLS``; else None."""
        if not self.small:
            return None
        rows = self.entries.select("ord", "std_name", "code").collect()      # at most as many as the postings counted
        rows.sort(key=lambda r: (r["ord"] is None, r["ord"] or 0))
        chars_of = {c for r in rows for c in r["std_name"]}
        if len(rows) * len(chars_of) > MATRIX_CELLS or any(len(r["std_name"]) > term_blocks.MAX_NAME for r in rows):
            return None
        return term_blocks.Names([(r["std_name"], r["code"]) for r in rows])


def _ranked_chars(terms: DataFrame, index: VocabIndex) -> DataFrame:
    """term, bag_t, norm_t, len_t, and ``ranked``: its characters that the vocabulary has, rarest first, as (df, ch, bound).

    ``bound`` is the most that a name can score that shares no character before this one.
    """
    t = (terms.withColumn("bag_t", _bag("term")).withColumn("norm_t", _norm(F.col("bag_t"))).withColumn("len_t", F.length("term"))
         .where(F.size("bag_t") > 0))
    held = (t.select("term", "bag_t", "norm_t", "len_t", F.explode("bag_t").alias("ch", "c")).join(index.rarity, "ch")
            .groupBy("term").agg(*(F.first(x).alias(x) for x in ("bag_t", "norm_t", "len_t")),
                                 F.array_sort(F.collect_list(F.struct("df", "ch", "c"))).alias("held")))

    def bound(i):
        rest = F.slice("held", i + 1, F.size("held"))
        c = F.aggregate(rest, F.lit(0.0), lambda acc, x: acc + x["c"])
        r = F.sqrt(F.aggregate(rest, F.lit(0.0), lambda acc, x: acc + x["c"] * x["c"]))
        return EDIT_WEIGHT * c / F.col("len_t") + COSINE_WEIGHT * r / F.col("norm_t")
    ranked = F.transform("held", lambda x, i: F.struct(x["df"].alias("df"), x["ch"].alias("ch"), bound(i).alias("bound")))
    return held.select("term", "bag_t", "norm_t", "len_t", ranked.alias("ranked"))


def _cosine() -> Column:
    return _common(F.col("bag_t"), F.col("bag_n"), lambda x, y: x * y) / (F.col("norm_t") * F.col("norm_n"))


def _edit_bound() -> Column:
    """The most the edit part can be: all shared characters in place."""
    return _common(F.col("bag_t"), F.col("bag_n"), F.least) / F.greatest("len_t", "len_n")


def _pair_score() -> Column:
    return F.lit(EDIT_WEIGHT) * edit_similarity("term", "std_name") + F.lit(COSINE_WEIGHT) * F.col("cosine")


def met_candidates(terms: DataFrame, index: VocabIndex) -> DataFrame:
    """The (term, name) pairs that some posting brings together and no bound of characters or lengths rules out.

    Columns: term, std_name, ord, code, bags, norms, lengths, ``least`` (the term's lower bound).
    """
    ranked = _ranked_chars(terms, index)
    like = F.flatten(F.transform(F.slice("ranked", 1, SEED_CHARS)["ch"], lambda c: F.array(*(F.xxhash64(c, F.col("len_t") + d) for d in (-1, 0, 1)))))
    tried = (ranked.select("term", "bag_t", "norm_t", "len_t", F.explode(F.concat(like, _near_keys("term"))).alias("key"))
             .join(index.seeds, "key").withColumn("cosine", _cosine()))
    seeded = tried.groupBy("term").agg(F.max(_pair_score()).alias("least"))
    at = ranked.join(seeded, "term", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    open_ = at.select("*", F.posexplode(F.filter("ranked", lambda x: x["bound"] >= F.col("least") - _MARGIN)).alias("i", "x"))
    met = (open_.select("term", "bag_t", "norm_t", "len_t", "least", F.col("x.ch").alias("ch"), F.slice("ranked", 1, F.col("i"))["ch"].alias("earlier"))
           .join(index.postings, "ch"))
    shorter, longer = F.least("len_t", "len_n"), F.greatest("len_t", "len_n")
    return (met.where(EDIT_WEIGHT * shorter / longer + COSINE_WEIGHT >= F.col("least") - _MARGIN)
            .where(~F.arrays_overlap("earlier", F.map_keys("bag_n"))).drop("ch", "earlier"))


def score_candidates(terms: DataFrame, vocab: DataFrame, broadcast_rows: int = BROADCAST_VOCAB_ROWS) -> DataFrame:
    """(term, ord, code, score) of every pair that may be a term's best, or tie with it.

    ``terms`` has one column ``term`` with distinct values.
    """
    return _score(terms, VocabIndex(vocab, broadcast_rows))


def _score(terms: DataFrame, index: VocabIndex) -> DataFrame:
    met = met_candidates(terms, index).withColumn("cosine", _cosine())
    can_win = met.where(EDIT_WEIGHT * _edit_bound() + COSINE_WEIGHT * F.col("cosine") >= F.col("least") - _MARGIN)
    return can_win.select("term", "ord", "code", _pair_score().alias("score"))


def best_candidate(scored: DataFrame) -> DataFrame:
    """F1: highest score per term; ties keep the earliest vocabulary entry."""
    return (scored.groupBy("term")
            .agg(F.max_by(F.struct("code", "score"), F.struct(F.col("score"), -F.col("ord"))).alias("b"))
            .select("term", F.col("b.code").alias("code"), F.col("b.score").alias("best")))


def map_distinct_terms(terms: DataFrame, vocab: DataFrame, *, threshold: float = THRESHOLD,
                       min_score: float | None = None, exact_only: bool = False,
                       broadcast_rows: int = BROADCAST_VOCAB_ROWS) -> DataFrame:
    """X3 core over distinct terms -> (term, code, score, status, match_type).

    ``min_score`` gives the class contract: code NULL below it.  ``match_type``
    is ``exact`` / ``approximate`` / NULL.  ``exact_only`` skips scoring (C2).
    """
    index = VocabIndex(vocab, broadcast_rows)
    small = index.small
    names = index.entries.select(F.col("std_name").alias("term"), "code")
    exact = terms.join(F.broadcast(names) if small else names, "term")
    exact = exact.select("term", "code", F.lit(1.0).alias("best"), F.lit("exact").alias("match_type"))
    rest = terms.join(F.broadcast(names.select("term")) if small else names.select("term"), "term", "left_anti")
    if exact_only:
        approx = rest.select("term", F.lit(None).cast("string").alias("code"), F.lit(0.0).alias("best"),
                             F.lit(None).cast("string").alias("match_type"))
    else:
        few = index.as_matrix()
        if few is not None:
            sc = terms.sparkSession.sparkContext
            approx = (rest.repartition(4 * sc.defaultParallelism, "term")
                      .mapInArrow(term_blocks.best_names(sc.broadcast(few), EDIT_WEIGHT, COSINE_WEIGHT), "term string, code string, best double"))
        else:
            approx = rest.join(best_candidate(_score(rest, index)), "term", "left")
        approx = (approx
                  .select("term", "code", F.coalesce("best", F.lit(0.0)).alias("best"),
                          F.when(F.col("code").isNotNull(), F.lit("approximate")).alias("match_type")))
    res = exact.unionByName(approx)
    code = F.col("code")
    mtype = F.col("match_type")
    if min_score is not None:
        low = F.col("best") < F.lit(min_score)
        code = F.when(low, F.lit(None).cast("string")).otherwise(code)
        mtype = F.when(low, F.lit(None).cast("string")).otherwise(mtype)
    return res.select("term", code.alias("code"), F.round("best", 3).alias("score"),
                      classify(F.col("best"), threshold).alias("status"), mtype.alias("match_type"))


def map_terms(df: DataFrame, vocab: DataFrame, term_col: str = "term", **kw) -> DataFrame:
    """Map a column of raw terms; each distinct term is scored once, then joined back.

    The join back is an equi-join on the term; AQE broadcasts the result table
    when small and splits hot terms otherwise.
    """
    terms = df.select(F.col(term_col).alias("term")).where(F.col("term").isNotNull()).distinct()
    mapped = map_distinct_terms(terms, vocab, **kw).withColumnRenamed("term", term_col)
    return df.join(mapped, term_col, "left")


def match_rate(mapped: DataFrame) -> DataFrame:
    """Share of rows matched exactly, and matched by the hybrid score."""
    return mapped.agg(
        F.avg(F.col("match_type").eqNullSafe("exact").cast("double")).alias("exact_rate"),
        F.avg(F.col("status").eqNullSafe("matched").cast("double")).alias("hybrid_rate"))


# --- H5: matching by embedding vectors -----------------------------------------------------

TERM_ROWS = 65_536           # terms of a block
VOCAB_ROWS = 16_384          # vocabulary entries of a block
_PRODUCT_ROWS = 512          # terms multiplied at a time


def _unit_rows(vectors: pd.Series, width: int) -> np.ndarray:
    """A matrix of the vectors scaled to norm 1; null and zero vectors become zero rows."""
    m = np.stack([np.zeros(width) if v is None else np.asarray(v, np.float64) for v in vectors])
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms == 0, 1.0, norms)


def _best_in_block(key: str):
    def run(terms: pd.DataFrame, vocab: pd.DataFrame) -> pd.DataFrame:
        if terms.empty or vocab.empty:
            return pd.DataFrame({key: pd.Series(dtype=object), "code": pd.Series(dtype=object),
                                 "score": pd.Series(dtype=float), "ord": pd.Series(dtype="int64")})
        vocab = vocab.sort_values("ord", kind="stable")
        width = next((len(v) for v in [*vocab["vec"], *terms["vec"]] if v is not None), 0)
        m, x = _unit_rows(vocab["vec"], width).T, _unit_rows(terms["vec"], width)
        at, top = np.empty(len(x), np.int64), np.empty(len(x))
        for a in range(0, len(x), _PRODUCT_ROWS):
            sims = np.round(x[a:a + _PRODUCT_ROWS] @ m, 12)          # equal vectors tie whatever the order of additions
            at[a:a + _PRODUCT_ROWS] = sims.argmax(axis=1)            # first maximum: smallest ord
            top[a:a + _PRODUCT_ROWS] = sims.max(axis=1)
        return pd.DataFrame({key: terms[key].astype(object), "code": vocab["code"].astype(object).to_numpy()[at], "score": top,
                             "ord": vocab["ord"].to_numpy()[at]})
    return run


def match_by_embedding(terms: DataFrame, vocab: DataFrame, *, key: str = "term", vec: str = "vec",
                       term_rows: int = TERM_ROWS, vocab_rows: int = VOCAB_ROWS) -> DataFrame:
    """H5: best vocabulary entry by vector cosine -> (key, code, score), one row per distinct ``key``.

    ``vocab`` has (ord, code, vec).  Both sides are dealt to blocks by hashes, of half the given rows on average; a term
    goes to every vocabulary block and an entry to every term block, and each pair of blocks meets in one task, as one
    matrix product.  Across the blocks the best is kept by (score, -ord) with partial maxima.  Neither side goes through
    the driver, and no task holds more than two blocks.  Only scores above 0 win; a null or zero vector, and an empty
    vocabulary, match nothing.
    """
    kind = terms.schema[key].dataType.simpleString()
    t = terms.select(key, F.col(vec).cast("array<double>").alias("vec")).distinct()
    v = vocab.select(F.col("ord").cast("long").alias("ord"), "code", F.col(vec).cast("array<double>").alias("vec"))
    n_t, n_v = (max(1, -(-2 * df.count() // rows)) for df, rows in ((t, term_rows), (v, vocab_rows)))

    def dealt(df, own, n_own, other, n_other):
        return (df.withColumn(own, F.pmod(F.xxhash64(*df.columns), F.lit(n_own)))
                .withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_other - 1).cast("long")))))
    t, v = dealt(t, "_t", n_t, "_v", n_v), dealt(v, "_v", n_v, "_t", n_t)
    met = (t.groupBy("_t", "_v").cogroup(v.groupBy("_t", "_v"))
           .applyInPandas(_best_in_block(key), f"`{key}` {kind}, code string, score double, ord long"))
    wins = met.where("score > 0").groupBy(key).agg(F.max_by(F.struct("code", "score"), F.struct(F.col("score"), -F.col("ord"))).alias("b"))
    every = terms.select(key).distinct()
    return every.join(wins, every[key].eqNullSafe(wins[key]), "left").select(
        every[key], F.col("b.code").alias("code"), F.coalesce("b.score", F.lit(0.0)).alias("score"))
