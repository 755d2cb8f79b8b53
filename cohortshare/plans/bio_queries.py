"""Registered BIO queries over the driver tables.

* conversations -> annotated examples: spans derived from (conv_id, turn),
  some overlapping, some of unmapped type, some out of range, some missing.
* documents -> character tags by a fixed rule on the character (gold), and the
  same rule shifted by one position (prediction).
* embeddings -> 10 tokens x 7 logits per vector of 64 components (the last token wraps around), gold ids from the label.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import islands as isl
from ..functions import tags as tg
from ..operators import bio
from ..schemas import SPAN
from ..session import scratch_path
from ..sources import bio_io
from ..sources.tables import table

TYPES3 = ["DIS", "SYM", "DRUG"]


def char_tag(c):
    """Gold rule: non-letter -> O; vowel -> B-T; other letter -> I-T; T by code point mod 3."""
    t = F.element_at(F.array(*[F.lit(x) for x in TYPES3]), (F.ascii(c) % 3 + 1).cast("int"))
    a = F.ascii(c)
    letter = (F.length(c) == 1) & (a.between(65, 90) | a.between(97, 122))
    return (F.when(c.isNull() | ~letter, F.lit("O"))
            .when(F.lower(c).isin("a", "e", "i", "o", "u"), F.concat(F.lit("B-"), t))
            .otherwise(F.concat(F.lit("I-"), t)))


def conversation_examples(spark, sf_dir):
    cv = table(spark, sf_dir, "conversations")
    n = F.length("text")
    cid, turn = F.col("conv_id"), F.col("turn")
    s1 = ((cid * 7 + turn * 3) % F.greatest(n, F.lit(1))).cast("int")
    e1 = (s1 + cid % 5).cast("int")
    t2 = F.when(turn % 3 == 0, F.lit("sym")).when(turn % 3 == 1, F.lit("dis")).otherwise(F.lit("loc"))
    span = lambda s, e, t: F.struct(s.cast("int").alias("start_idx"), e.cast("int").alias("end_idx"),
                                    t.alias("type"))
    ents = F.array(span(s1, e1, F.lit("dis")), span(s1 + 2, s1 + 5, t2),
                   span(n - 2, n - 1 + turn % 2, F.lit("sym")), span(F.lit(5), F.lit(2), F.lit("dis")))
    ents = F.when((cid + turn) % 6 == 0, F.lit(None).cast(T.ArrayType(SPAN))).otherwise(ents)
    return cv.select("conv_id", "turn", "text", ents.alias("entities"))


def _bio_out(df, keys=("conv_id", "turn")):
    return df.select(*keys,
                     F.size("pairs").cast("bigint").alias("n_tokens"),
                     F.array_join(F.transform("pairs", lambda p: F.concat(p["ch"], F.lit(" "), p["tag"])), "\n")
                     .alias("bio"))


def q_bio_from_spans(spark, sf_dir):
    ex = bio.convert_examples(conversation_examples(spark, sf_dir))
    return _bio_out(ex.select("conv_id", "turn", "pairs"))


def q_bio_example_count(spark, sf_dir):
    return bio.count_examples(conversation_examples(spark, sf_dir)).select(
        F.col("n_examples").cast("bigint").alias("n_examples"))


def q_json_examples(spark, sf_dir):
    path = scratch_path(spark, "examples")
    bio_io.write_examples(conversation_examples(spark, sf_dir), path)
    ex = bio.convert_examples(bio_io.read_examples(spark, path, multiline=False))
    return _bio_out(ex, keys=("text",))


def q_json_array_examples(spark, sf_dir):
    path = scratch_path(spark, "examples-array")
    bio_io.write_examples(conversation_examples(spark, sf_dir), path, array=True)
    return _bio_out(bio.convert_examples(bio_io.read_examples(spark, path)), keys=("text",))


def q_bio_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "bio")
    bio_io.write_bio(bio.convert_examples(conversation_examples(spark, sf_dir)), path)
    back = bio_io.read_bio(spark, path, mode="failfast", labels=None)
    return back.select(F.array_join("tokens", "").alias("tokens"), F.array_join("tags", " ").alias("tags"))


RULE_TAGS = ["O", *(f"{p}-{t}" for t in TYPES3 for p in ("B", "I"))]


def _rule_table():
    """First byte of a character -> number of its tag by the rule of :func:`char_tag`."""
    table = np.zeros(256, np.int8)
    for c in map(chr, list(range(65, 91)) + list(range(97, 123))):
        table[ord(c)] = RULE_TAGS.index(("B-" if c.lower() in "aeiou" else "I-") + TYPES3[ord(c) % 3])
    return table


def doc_tags(spark, sf_dir):
    """Gold tags by the rule of :func:`char_tag`, predicted tags = the rule one character ahead.

    A character's tag is looked up by its first byte, for a portion of a batch of texts at a time, in a pass that
    goes on with what reads the tags.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return isl.tagged_texts(d, "text", _rule_table(), RULE_TAGS, gold_tags=False, pred_tags=True)


def q_bio_decode(spark, sf_dir):
    return bio.sentence_entities(doc_tags(spark, sf_dir), "text", "gold_tags", "strict", keys=("doc_id",))


def q_bio_decode_lenient(spark, sf_dir):
    return bio.sentence_entities(doc_tags(spark, sf_dir), "text", "gold_tags", "lenient", keys=("doc_id",))


def _round_prf(df):
    return df.select("n_gold", "n_pred", "tp", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def q_bio_prf(spark, sf_dir):
    return _round_prf(bio.prf_from_tags(doc_tags(spark, sf_dir), "gold_tags", "pred_tags", "lenient"))


def q_bio_prf_strict_join(spark, sf_dir):
    d = doc_tags(spark, sf_dir)
    g = bio.sentence_entities(d, "text", "gold_tags", "strict", keys=("doc_id",))
    p = bio.sentence_entities(d, "text", "pred_tags", "strict", keys=("doc_id",))
    return _round_prf(bio.entity_prf(g, p, keys=("doc_id",)))


def logits_table(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    ring = F.concat("embedding", F.slice("embedding", 1, 6))          # the tenth token's logits go on at the start
    logits = F.array(*[F.slice(ring, 7 * k + 1, 7) for k in range(10)])
    gold = F.transform(F.array(*[F.lit(k) for k in range(10)]), lambda k: F.when(
        (F.col("vec_id") + k) % 5 == 0, F.lit(tg.IGNORE)).otherwise(((F.col("label") + k) % 7).cast("int")))
    return e.select("vec_id", logits.alias("logits"), gold.alias("labels"))


def q_bio_argmax(spark, sf_dir):
    lt = logits_table(spark, sf_dir)
    lab = tg.id2label()
    m = lt.select("vec_id", tg.mask_ignored(tg.argmax_labels("logits"), "labels").alias("m"))
    return m.select("vec_id",
                    F.array_join(F.transform("m", lambda p: F.get(lab, p["pred"])), " ").alias("pred_tags"),
                    F.array_join(F.transform("m", lambda p: F.get(lab, p["gold"])), " ").alias("gold_tags"))


def q_bio_metrics(spark, sf_dir):
    return _round_prf(bio.metrics_from_logits(logits_table(spark, sf_dir)))


def q_bio_align(spark, sf_dir):
    """Words -> 4-character pieces (a stand-in sub-word tokenizer), labels aligned in consecutive
    windows of 510 pieces and two specials, so that whole texts are labelled."""
    d = table(spark, sf_dir, "documents")
    words = F.filter(F.split("text", " "), lambda w: w != "")
    d = d.select("doc_id", words.alias("words"))
    d = d.select("doc_id", F.transform("words", lambda w: (F.ascii(w) % 7).cast("int")).alias("word_tags"),
                 F.flatten(F.transform("words", lambda w, i: F.array_repeat(
                     i, F.ceil(F.length(w) / F.lit(4.0)).cast("int")))).alias("pieces"))
    last = F.greatest(F.ceil(F.size("pieces") / F.lit(510.0)).cast("int") - 1, F.lit(0))
    d = d.select("doc_id", "word_tags", "pieces", F.explode(F.sequence(F.lit(0), last)).alias("window"))
    special = F.array(F.lit(None).cast("int"))
    d = d.select("doc_id", "window", "word_tags",
                 F.concat(special, tg.truncate_tokens(F.slice("pieces", F.col("window") * 510 + 1, F.lit(510)), 512, 2),
                          special).alias("word_ids"))
    out = d.select("doc_id", "window", tg.align_labels("word_ids", "word_tags", 512).alias("labels"),
                   F.size(tg.first_subword("word_ids")).alias("n_first"))
    return out.select("doc_id", "window", F.col("n_first").cast("bigint").alias("n_first"),
                      F.array_join(F.transform("labels", lambda x: x.cast("string")), " ").alias("labels"))


QUERIES = {
    "bio_from_spans": q_bio_from_spans,
    "bio_example_count": q_bio_example_count,
    "json_examples": q_json_examples,
    "json_array_examples": q_json_array_examples,
    "bio_roundtrip": q_bio_roundtrip,
    "bio_decode": q_bio_decode,
    "bio_decode_lenient": q_bio_decode_lenient,
    "bio_prf": q_bio_prf,
    "bio_prf_strict_join": q_bio_prf_strict_join,
    "bio_argmax": q_bio_argmax,
    "bio_metrics": q_bio_metrics,
    "bio_align": q_bio_align,
}

# ----------------------------------------------------------------------------- oracles

_TAG_SQL = """CASE WHEN NOT (length({c}) = 1 AND (ascii({c}) BETWEEN 65 AND 90 OR ascii({c}) BETWEEN 97 AND 122)) THEN 'O'
       WHEN lower({c}) IN ('a', 'e', 'i', 'o', 'u') THEN 'B-' || (['DIS', 'SYM', 'DRUG'])[ascii({c}) % 3 + 1]
       ELSE 'I-' || (['DIS', 'SYM', 'DRUG'])[ascii({c}) % 3 + 1] END"""

_DOC_CHARS = f"""
  dc AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, unnest(range(length(text))) AS pos
         FROM documents WHERE length(text) > 0),
  dn AS (SELECT *, lead(ch) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM dc),
  dt AS (SELECT doc_id, pos, ch, {_TAG_SQL.format(c='ch')} AS gold,
                CASE WHEN nxt IS NULL THEN 'O' ELSE {_TAG_SQL.format(c='nxt')} END AS pred FROM dn)"""


def islands(tag: str, keep: str, name: str) -> str:
    return f"""
  {name}_l AS (SELECT doc_id, pos, ch, {tag} AS tag,
                 lag({tag}) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM dt),
  {name}_b AS (SELECT *, CASE WHEN tag LIKE 'I-%' AND prev IS NOT NULL
                             AND (prev = 'B-' || substr(tag, 3) OR prev = 'I-' || substr(tag, 3))
                          THEN 0 ELSE 1 END AS brk FROM {name}_l),
  {name}_i AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS isl
               FROM {name}_b),
  {name} AS (SELECT doc_id, CAST(min(pos) AS INTEGER) AS "start", CAST(max(pos) AS INTEGER) AS "end",
                    substr(arg_min(tag, pos), 3) AS type, string_agg(ch, '' ORDER BY pos) AS text
             FROM {name}_i GROUP BY doc_id, isl HAVING {keep.format(t='arg_min(tag, pos)')})"""


STRICT = "{t} LIKE 'B-%'"
_LENIENT = "({t} LIKE 'B-%' OR {t} LIKE 'I-%')"

_CONV_EX = """
  ex AS (SELECT conv_id, turn, text, length(text) AS n,
                CAST((conv_id * 7 + turn * 3) % greatest(length(text), 1) AS INTEGER) AS s1
         FROM conversations),
  sp AS (
    SELECT conv_id, turn, 1 AS k, s1 AS s, s1 + CAST(conv_id % 5 AS INTEGER) AS e, 'dis' AS t FROM ex
    UNION ALL SELECT conv_id, turn, 2, s1 + 2, s1 + 5,
                     CASE WHEN turn % 3 = 0 THEN 'sym' WHEN turn % 3 = 1 THEN 'dis' ELSE 'loc' END FROM ex
    UNION ALL SELECT conv_id, turn, 3, n - 2, n - 1 + CAST(turn % 2 AS INTEGER), 'sym' FROM ex
    UNION ALL SELECT conv_id, turn, 4, 5, 2, 'dis' FROM ex),
  vs AS (SELECT sp.conv_id, sp.turn, k, s, e,
                CASE t WHEN 'dis' THEN 'DISEASE' WHEN 'sym' THEN 'SYMPTOM' END AS t
         FROM sp JOIN ex USING (conv_id, turn)
         WHERE (ex.conv_id + ex.turn) % 6 <> 0 AND t IN ('dis', 'sym') AND s >= 0 AND e < ex.n AND s <= e),
  cc AS (SELECT conv_id, turn, unnest(string_split(text, '')) AS ch, unnest(range(length(text))) AS pos
         FROM ex WHERE n > 0),
  cov AS (SELECT cc.conv_id, cc.turn, cc.pos, arg_max(vs.s, vs.k) AS s, arg_max(vs.t, vs.k) AS t
          FROM cc JOIN vs ON cc.conv_id = vs.conv_id AND cc.turn = vs.turn AND cc.pos BETWEEN vs.s AND vs.e
          GROUP BY 1, 2, 3),
  tg AS (SELECT cc.conv_id, cc.turn, cc.pos, cc.ch,
                CASE WHEN cov.s IS NULL THEN 'O' WHEN cov.s = cc.pos THEN 'B-' || cov.t ELSE 'I-' || cov.t END AS tag
         FROM cc LEFT JOIN cov USING (conv_id, turn, pos)
         WHERE NOT regexp_matches(cc.ch, '^\\s*$')),
  agg AS (SELECT conv_id, turn, count(*) AS n_tokens, string_agg(ch || ' ' || tag, chr(10) ORDER BY pos) AS bio,
                 string_agg(ch, '' ORDER BY pos) AS tokens, string_agg(tag, ' ' ORDER BY pos) AS tags
          FROM tg GROUP BY conv_id, turn)"""

_ARGMAX = """
  lk AS (SELECT vec_id, label, k, list_concat(embedding, embedding[1:6])[7 * k + 1 : 7 * k + 7] AS l
         FROM embeddings, range(10) r(k)),
  pk AS (SELECT vec_id, k,
                CAST(list_position(l, list_max(l)) - 1 AS INTEGER) AS pred,
                CASE WHEN (vec_id + k) % 5 = 0 THEN -100 ELSE CAST((label + k) % 7 AS INTEGER) END AS gold
         FROM lk),
  mk AS (SELECT vec_id, k,
                (['O', 'B-DIS', 'I-DIS', 'B-SYM', 'I-SYM', 'B-DRUG', 'I-DRUG'])[pred + 1] AS ptag,
                (['O', 'B-DIS', 'I-DIS', 'B-SYM', 'I-SYM', 'B-DRUG', 'I-DRUG'])[gold + 1] AS gtag
         FROM pk WHERE gold <> -100)"""


def _prf_sql(g: str, p: str) -> str:
    return f"""
  SELECT CAST(ng AS BIGINT) AS n_gold, CAST(np AS BIGINT) AS n_pred, CAST(tp AS BIGINT) AS tp,
         round(CASE WHEN np = 0 THEN 0.0 ELSE tp / np END, 6) AS precision,
         round(CASE WHEN ng = 0 THEN 0.0 ELSE tp / ng END, 6) AS recall,
         round(CASE WHEN tp = 0 THEN 0.0 ELSE 2.0 * (tp / np) * (tp / ng) / ((tp / np) + (tp / ng)) END, 6) AS f1
  FROM (SELECT (SELECT count(*) FROM {g}) AS ng, (SELECT count(*) FROM {p}) AS np,
               (SELECT count(*) FROM {g} JOIN {p} USING (doc_id, "start", "end", type)) AS tp) c"""


ORACLE = {
    "bio_from_spans": f"""
  WITH {_CONV_EX}
  SELECT ex.conv_id, ex.turn, coalesce(agg.n_tokens, 0) AS n_tokens, coalesce(agg.bio, '') AS bio
  FROM ex LEFT JOIN agg USING (conv_id, turn)""",
    "bio_example_count": "SELECT CAST(count(*) AS BIGINT) AS n_examples FROM conversations",
    "json_examples": f"""
  WITH {_CONV_EX}
  SELECT ex.text, coalesce(agg.n_tokens, 0) AS n_tokens, coalesce(agg.bio, '') AS bio
  FROM ex LEFT JOIN agg USING (conv_id, turn)""",
    "bio_roundtrip": f"""
  WITH {_CONV_EX}
  SELECT tokens, tags FROM agg""",
    "bio_decode": f"WITH {_DOC_CHARS}, {islands('gold', STRICT, 'ents')} SELECT * FROM ents",
    "bio_decode_lenient": f"WITH {_DOC_CHARS}, {islands('gold', _LENIENT, 'ents')} SELECT * FROM ents",
    "bio_prf": f"WITH {_DOC_CHARS}, {islands('gold', _LENIENT, 'g')}, {islands('pred', _LENIENT, 'p')}"
               + _prf_sql("g", "p"),
    "bio_prf_strict_join": f"WITH {_DOC_CHARS}, {islands('gold', STRICT, 'g')}, {islands('pred', STRICT, 'p')}"
                           + _prf_sql("g", "p"),
    "bio_argmax": f"""
  WITH {_ARGMAX}
  SELECT vec_id, string_agg(ptag, ' ' ORDER BY k) AS pred_tags, string_agg(gtag, ' ' ORDER BY k) AS gold_tags
  FROM mk GROUP BY vec_id""",
    "bio_metrics": f"""
  WITH {_ARGMAX},
  sq AS (SELECT vec_id AS doc_id, k, ptag, gtag,
                row_number() OVER (PARTITION BY vec_id ORDER BY k) - 1 AS pos FROM mk),
  dt AS (SELECT doc_id, pos, '' AS ch, gtag AS gold, ptag AS pred FROM sq),
  {islands('gold', _LENIENT, 'g')}, {islands('pred', _LENIENT, 'p')}
  """ + _prf_sql("g", "p"),
    "bio_align": """
  WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS r
             FROM documents),
  wf AS (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY r) - 1 AS wi,
                CAST(ascii(word) % 7 AS INTEGER) AS tag
         FROM w WHERE word <> ''),
  pc AS (SELECT doc_id, wi, tag, p FROM wf, range(CAST(ceil(length(word) / 4.0) AS BIGINT)) r(p)),
  pn AS (SELECT doc_id, wi, tag, p, row_number() OVER (PARTITION BY doc_id ORDER BY wi, p) - 1 AS t FROM pc),
  lab AS (SELECT doc_id, t // 510 AS win, t, p = 0 OR t % 510 = 0 AS starts, tag FROM pn),
  seqs AS (SELECT doc_id, win, count(*) FILTER (WHERE starts) AS n_first,
                  string_agg(CAST(CASE WHEN starts THEN tag ELSE -100 END AS VARCHAR), ' ' ORDER BY t) AS l
           FROM lab GROUP BY doc_id, win)
  SELECT d.doc_id, CAST(coalesce(win, 0) AS INTEGER) AS "window", CAST(coalesce(n_first, 0) AS BIGINT) AS n_first,
         '-100 ' || coalesce(l || ' ', '') || '-100' AS labels
  FROM documents d LEFT JOIN seqs USING (doc_id)""",
}


# --------------------------------------------------------------------------- record CSV round trip

def customer_records(spark, sf_dir):
    from ..sources.tables import table as t
    c = t(spark, sf_dir, "customer")
    n = t(spark, sf_dir, "nation")
    k = F.col("c_custkey")
    raw = (F.when(k % 5 == 0, F.lit("NA")).when(k % 5 == 1, F.lit("N/A")).when(k % 5 == 2, F.lit("NaN"))
           .when(k % 10 == 3, F.lit("")).otherwise(F.col("c_mktsegment")))
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.concat(F.lit("C"), k.cast("string")).alias("patient_id"),
        F.when(k % 7 == 0, F.lit(None).cast("double")).otherwise(F.col("c_acctbal")).alias("age_months"),
        F.concat(F.col("c_name"), F.lit(", "), F.col("n_name")).alias("location"),
        F.concat(F.lit("2024-"), F.lpad((k % 12 + 1).cast("string"), 2, "0"), F.lit("-15")).alias("diagnosis_date"),
        raw.alias("disease_name_raw"),
        F.when(k % 9 == 0, F.lit(None).cast("double")).otherwise(F.col("c_acctbal") / 10).alias("lab_value"),
        F.concat(F.lit('Note "'), F.col("c_mktsegment"), F.lit('", line one\nline two, '), F.col("c_name"))
        .alias("clinical_note"))


def q_csv_roundtrip(spark, sf_dir):
    from ..sources import records
    path = scratch_path(spark, "records")
    records.write_records(customer_records(spark, sf_dir), path)
    return records.read_records(spark, path)


QUERIES["csv_roundtrip"] = q_csv_roundtrip
ORACLE["json_array_examples"] = ORACLE["json_examples"]
ORACLE["csv_roundtrip"] = """
  SELECT 'C' || CAST(c_custkey AS VARCHAR) AS patient_id,
         CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS age_months,
         c_name || ', ' || n_name AS location,
         '2024-' || lpad(CAST(c_custkey % 12 + 1 AS VARCHAR), 2, '0') || '-15' AS diagnosis_date,
         CASE WHEN c_custkey % 5 IN (0, 1, 2) OR c_custkey % 10 = 3 THEN NULL ELSE c_mktsegment END AS disease_name_raw,
         CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal / 10 END AS lab_value,
         'Note "' || c_mktsegment || '", line one' || chr(10) || 'line two, ' || c_name AS clinical_note
  FROM customer JOIN nation ON c_nationkey = n_nationkey"""
