"""Registered terminology-mapping queries.

Vocabulary: the distinct part names (ord = smallest part key, code = the last
word upper-cased, so several names share a code).  Raw terms: one per part,
perturbed by a rule on the key (exact, one character dropped, reversed,
plural, brand text, digits only).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import terms as tm
from ..sources.tables import table


def part_vocab(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return (p.groupBy("p_name")
            .agg(F.min("p_partkey").cast("int").alias("ord"))
            .select("ord", F.col("p_name").alias("std_name"),
                    F.upper(F.regexp_extract("p_name", r"(\S+)$", 1)).alias("code")))


def part_terms(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    n = F.col("p_name")
    # drop the character at 1-based position pos = 1 + (k div 5) mod len
    dropped = F.expr("concat(substring(p_name, 1, floor(p_partkey / 5) % length(p_name)), "
                     "substring(p_name, 2 + floor(p_partkey / 5) % length(p_name)))")
    term = (F.when(k % 5 == 0, n)
            .when(k % 5 == 1, dropped)
            .when(k % 5 == 2, F.reverse(n))
            .when(k % 5 == 3, F.concat(n, F.lit("s")))
            .when(k % 10 == 4, F.col("p_brand"))
            .otherwise(k.cast("string")))
    return p.select("p_partkey", term.alias("term"))


def q_term_exact(spark, sf_dir):
    m = tm.map_terms(part_terms(spark, sf_dir), part_vocab(spark, sf_dir), exact_only=True)
    return m.select("p_partkey", "term", "code", "match_type")


def q_term_hybrid(spark, sf_dir):
    m = tm.map_terms(part_terms(spark, sf_dir), part_vocab(spark, sf_dir))
    return m.select("p_partkey", "term", "code", "score", "status", "match_type")


def q_term_min_score(spark, sf_dir):
    m = tm.map_terms(part_terms(spark, sf_dir), part_vocab(spark, sf_dir), min_score=0.5)
    return m.select("p_partkey", "term", "code", "score", "status", "match_type")


def q_term_match_rate(spark, sf_dir):
    m = tm.map_terms(part_terms(spark, sf_dir), part_vocab(spark, sf_dir))
    r = tm.match_rate(m)
    return r.select(F.round("exact_rate", 6).alias("exact_rate"), F.round("hybrid_rate", 6).alias("hybrid_rate"))


def _long_words(spark, sf_dir, name):
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = table(spark, sf_dir, name).select(F.explode(F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0))).alias("w"))
    return words.where(F.length("w") >= 4).groupBy("w").agg(F.count(F.lit(1)).alias("uses"))


def q_term_large_vocab(spark, sf_dir):
    """X3 with a vocabulary of all longer words of the benchmark, over all longer words of the documents."""
    vocab = _long_words(spark, sf_dir, "benchmark").select(
        F.conv(F.substring(F.md5("w"), 1, 7), 16, 10).cast("int").alias("ord"), F.col("w").alias("std_name"), F.upper("w").alias("code"))
    words = _long_words(spark, sf_dir, "documents").select(F.col("w").alias("term"), "uses")
    return tm.map_terms(words, vocab).select("term", "uses", "code", "score", "status", "match_type")


def q_term_embedding(spark, sf_dir):
    """H5: every vector against the vectors whose id ends in 0 as the vocabulary."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    vocab = e.where(F.col("vec_id") % 10 == 0).select(
        F.col("vec_id").alias("ord"), F.concat(F.lit("V"), F.col("vec_id").cast("string")).alias("code"), "vec")
    res = tm.match_by_embedding(e, vocab, key="vec_id")
    return res.select("vec_id", "code", F.round("score", 6).alias("score"))


QUERIES = {
    "term_exact": q_term_exact,
    "term_hybrid": q_term_hybrid,
    "term_min_score": q_term_min_score,
    "term_match_rate": q_term_match_rate,
    "term_large_vocab": q_term_large_vocab,
    "term_embedding": q_term_embedding,
}

_BASE = r"""
  WITH vocab AS (
    SELECT CAST(min(p_partkey) AS INTEGER) AS ord, p_name AS std_name,
           upper(regexp_extract(p_name, '(\S+)$', 1)) AS code
    FROM part GROUP BY p_name),
  terms AS (
    SELECT p_partkey,
      CASE WHEN p_partkey % 5 = 0 THEN p_name
           WHEN p_partkey % 5 = 1 THEN
             substr(p_name, 1, CAST(floor(p_partkey / 5) % length(p_name) AS INTEGER))
             || substr(p_name, CAST(1 + (floor(p_partkey / 5) % length(p_name)) + 1 AS INTEGER))
           WHEN p_partkey % 5 = 2 THEN reverse(p_name)
           WHEN p_partkey % 5 = 3 THEN p_name || 's'
           WHEN p_partkey % 10 = 4 THEN p_brand
           ELSE CAST(p_partkey AS VARCHAR) END AS term
    FROM part),
  dt AS (SELECT DISTINCT term FROM terms),
  tc AS (SELECT term, ch, count(*) AS c
         FROM (SELECT term, unnest(string_split(term, '')) AS ch FROM dt) x WHERE ch <> '' GROUP BY term, ch),
  tn AS (SELECT term, sum(c * c) AS n FROM tc GROUP BY term),
  vc AS (SELECT std_name, ch, count(*) AS c
         FROM (SELECT std_name, unnest(string_split(std_name, '')) AS ch FROM vocab) x WHERE ch <> ''
         GROUP BY std_name, ch),
  vn AS (SELECT std_name, sum(c * c) AS n FROM vc GROUP BY std_name),
  dots AS (SELECT tc.term, vc.std_name, sum(tc.c * vc.c) AS d FROM tc JOIN vc ON tc.ch = vc.ch GROUP BY 1, 2),
  sc AS (SELECT dots.term, v.ord, v.code,
           0.4 * (1.0 - levenshtein(dots.term, v.std_name) / greatest(length(dots.term), length(v.std_name), 1))
           + 0.6 * (d / (sqrt(tn.n) * sqrt(vn.n))) AS score
         FROM dots JOIN tn ON dots.term = tn.term JOIN vn ON dots.std_name = vn.std_name
              JOIN vocab v ON dots.std_name = v.std_name),
  best AS (SELECT term, code, score FROM (
             SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, ord ASC) AS rn FROM sc) r
           WHERE rn = 1),
  mapped AS (
    SELECT t.p_partkey, t.term,
      CASE WHEN v.code IS NOT NULL THEN v.code ELSE b.code END AS code,
      CASE WHEN v.code IS NOT NULL THEN 1.0 ELSE coalesce(b.score, 0.0) END AS best,
      CASE WHEN v.code IS NOT NULL THEN 'exact' WHEN b.code IS NOT NULL THEN 'approximate' END AS match_type
    FROM terms t LEFT JOIN vocab v ON t.term = v.std_name LEFT JOIN best b ON t.term = b.term)
"""

ORACLE = {
    "term_exact": r"""
  WITH vocab AS (
    SELECT p_name AS std_name, upper(regexp_extract(p_name, '(\S+)$', 1)) AS code FROM part GROUP BY p_name),
  terms AS (""" + _BASE.split("terms AS (", 1)[1].split("dt AS (", 1)[0].rstrip().rstrip(",") + r"""
  SELECT t.p_partkey, t.term, v.code, CASE WHEN v.code IS NOT NULL THEN 'exact' END AS match_type
  FROM terms t LEFT JOIN vocab v ON t.term = v.std_name""",
    "term_hybrid": _BASE + """
  SELECT p_partkey, term, code, round(best, 3) AS score,
         CASE WHEN best >= 0.85 THEN 'matched' ELSE 'needs_manual_review' END AS status, match_type
  FROM mapped""",
    "term_min_score": _BASE + """
  SELECT p_partkey, term, CASE WHEN best < 0.5 THEN NULL ELSE code END AS code, round(best, 3) AS score,
         CASE WHEN best >= 0.85 THEN 'matched' ELSE 'needs_manual_review' END AS status,
         CASE WHEN best < 0.5 THEN NULL ELSE match_type END AS match_type
  FROM mapped""",
    "term_match_rate": _BASE + """
  SELECT round(avg(CASE WHEN match_type = 'exact' THEN 1.0 ELSE 0.0 END), 6) AS exact_rate,
         round(avg(CASE WHEN best >= 0.85 THEN 1.0 ELSE 0.0 END), 6) AS hybrid_rate
  FROM mapped""",
    "term_embedding": """
  WITH u AS (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda y: y * y))) AS n
             FROM (SELECT vec_id, list_transform(embedding, lambda y: CAST(y AS DOUBLE)) AS x FROM embeddings)),
  sc AS (SELECT t.vec_id, v.vec_id AS ord,
                round(list_sum(list_transform(list_zip(t.x, v.x), lambda z: z[1] * z[2]))
                      / (CASE WHEN t.n * v.n = 0 THEN 1.0 ELSE t.n * v.n END), 12) AS s
         FROM u t JOIN u v ON v.vec_id % 10 = 0),
  best AS (SELECT vec_id, ord, s FROM sc WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, ord) = 1)
  SELECT u.vec_id, 'V' || CAST(ord AS VARCHAR) AS code, round(coalesce(s, 0.0), 6) AS score FROM u LEFT JOIN best USING (vec_id)""",
}

_LONG_WORDS = """SELECT w, count(*) AS uses FROM (
        SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]+')) AS w
        FROM {}) WHERE length(w) >= 4 GROUP BY w"""
_SCORED = _BASE[_BASE.index("  dt AS ("):_BASE.index("  mapped AS (")]
ORACLE["term_large_vocab"] = f"""
  WITH vocab AS (SELECT CAST(('0x' || substr(md5(w), 1, 7)) AS INTEGER) AS ord, w AS std_name, upper(w) AS code
                 FROM ({_LONG_WORDS.format('benchmark')}) x),
  terms AS (SELECT w AS term, uses FROM ({_LONG_WORDS.format('documents')}) x),
{_SCORED.rstrip().rstrip(',')}
  SELECT t.term, t.uses, coalesce(v.code, b.code) AS code, round(CASE WHEN v.code IS NOT NULL THEN 1.0 ELSE coalesce(b.score, 0.0) END, 3) AS score,
         CASE WHEN v.code IS NOT NULL OR b.score >= 0.85 THEN 'matched' ELSE 'needs_manual_review' END AS status,
         CASE WHEN v.code IS NOT NULL THEN 'exact' WHEN b.code IS NOT NULL THEN 'approximate' END AS match_type
  FROM terms t LEFT JOIN vocab v ON t.term = v.std_name LEFT JOIN best b ON t.term = b.term"""
