"""Registered queries of the learned operators (tagger, masked-LM rows)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import passes
from ..functions import tags as tg
from ..functions.text import chars
from ..operators import bio, mlm, tagger
from ..session import spread
from ..sources.tables import table
from .bio_queries import STRICT, char_tag, doc_tags, islands

SALT = "cohortshare-mlm"


def doc_sentences(spark, sf_dir):
    """The documents, whose characters are the tokens, and gold tags; the rule of :func:`char_tag` as :func:`doc_tags` applies it."""
    return passes.columns(doc_tags(spark, sf_dir), sent_id="doc_id", tokens="text", tags="gold_tags")


def _benchmark_sentences(spark, sf_dir):
    """Labelled sentences that no document is: the rule tags of the benchmark's texts."""
    d = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("sent_id"), chars("text").alias("tokens"))
    return d.select("sent_id", "tokens", F.transform("tokens", char_tag).alias("tags"))


def q_tagger_fit_tag(spark, sf_dir):
    """H2 + H3: fit on the benchmark's texts, then tag all documents."""
    model = tagger.train_tagger(_benchmark_sentences(spark, sf_dir), max_iter=10)
    return tagger.tag_notes(model, spread(table(spark, sf_dir, "documents").select("doc_id", "text")), key="doc_id", text="text")


def q_tagger_prf(spark, sf_dir):
    """H2 fitted on the benchmark's texts, scored on all documents."""
    model = tagger.train_tagger(_benchmark_sentences(spark, sf_dir), max_iter=10)
    gold = passes.columns(doc_sentences(spark, sf_dir), sent_id="sent_id", tokens="tokens", gold_tags="tags")
    both = tagger.predict_tags(model, gold)
    return bio.prf_from_tags(both, "gold_tags", "pred_tags", "strict")


def fixed_tagger():
    """Coefficients given by a rule, so that SQL can tag as well; ``O`` has the best chances."""
    f, k = np.arange(tagger.FEATURES)[:, None], np.arange(len(tg.LABELS))[None, :]
    return tagger.LinearTagger(f[:, 0], ((f * 7919 + k * 104729) % 1009 + 300 * (k == 0)).astype(float))


def q_tagger_fixed(spark, sf_dir):
    """H3 with given coefficients, over all documents."""
    return tagger.tag_notes(fixed_tagger(), spread(table(spark, sf_dir, "documents").select("doc_id", "text")), key="doc_id", text="text")


def q_mlm_examples(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return mlm.mlm_examples(d, "doc_id", "text", salt=SALT)


def q_mlm_dense(spark, sf_dir):
    """H4 as training rows: a block's inputs and labels, -100 where nothing is to be predicted."""
    rows = mlm.mlm_blocks(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", salt=SALT)
    return rows.select("doc_id", "block", F.array_join("input_tokens", " ").alias("input_tokens"),
                       F.array_join("labels", " ", "-100").alias("labels"))


QUERIES = {
    "tagger_fit_tag": q_tagger_fit_tag,
    "tagger_prf": q_tagger_prf,
    "tagger_fixed": q_tagger_fixed,
    "mlm_examples": q_mlm_examples,
    "mlm_dense": q_mlm_dense,
}

_MLM_DRAWS = f"""
  WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, unnest(range(length(text))) AS i
             FROM documents WHERE length(text) > 0),
  t AS (SELECT doc_id, ch AS token, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ti
        FROM c WHERE NOT regexp_matches(ch, '^\\s$')),
  b AS (SELECT doc_id, token, CAST(ti // 510 AS BIGINT) AS block, CAST(ti % 510 + 1 AS INTEGER) AS pos FROM t),
  v AS (SELECT token AS rtoken, row_number() OVER (ORDER BY token) - 1 AS ridx FROM (SELECT DISTINCT token FROM b) x),
  nv AS (SELECT count(*) AS n FROM v),
  h AS (SELECT b.*, md5(concat_ws('|', '{SALT}', CAST(doc_id AS VARCHAR), CAST(block AS VARCHAR),
                                  CAST(pos AS VARCHAR))) AS m FROM b),
  u AS (SELECT doc_id, block, pos, token,
               (CAST(('0x' || substr(m, 1, 8)) AS BIGINT) + 0.5) / 4294967296.0 AS u_sel,
               (CAST(('0x' || substr(m, 9, 8)) AS BIGINT) + 0.5) / 4294967296.0 AS u_kind,
               CAST(('0x' || substr(m, 17, 8)) AS BIGINT) % (SELECT n FROM nv) AS ridx
        FROM h),
  d AS (SELECT doc_id, block, pos, token, u_sel < 0.15 AS chosen,
               CASE WHEN u_sel >= 0.15 THEN token WHEN u_kind < 0.8 THEN '[MASK]' WHEN u_kind < 0.9 THEN v.rtoken
                    ELSE token END AS input
        FROM u LEFT JOIN v USING (ridx))"""

ORACLE = {
    "mlm_examples": _MLM_DRAWS + " SELECT doc_id, block, pos, token AS label, input FROM d WHERE chosen",
    "mlm_dense": _MLM_DRAWS + """
  SELECT doc_id, block, '[CLS] ' || string_agg(input, ' ' ORDER BY pos) || ' [SEP]' AS input_tokens,
         '-100 ' || string_agg(CASE WHEN chosen THEN token ELSE '-100' END, ' ' ORDER BY pos) || ' -100' AS labels
  FROM d GROUP BY doc_id, block""",
}


_PLACES = [("lag(c, 2)", 0), ("lag(c, 1)", 1), ("c", 2), ("lead(c, 1)", 3), ("lead(c, 2)", 4)]
_NUMBERS = ", ".join(f"(coalesce({x}{' OVER w' if x != 'c' else ''}, {0x110000}) * 5 + {slot}) * 2654435761 % {tagger.FEATURES} AS f{slot}" for x, slot in _PLACES)
_SCORES = ", ".join("+".join(f"(f{slot} * 7919 + {k * 104729}) % 1009" for slot in range(5)) + (" + 1500" if k == 0 else "") for k in range(len(tg.LABELS)))
ORACLE["tagger_fixed"] = f"""
  WITH dc AS (SELECT doc_id, ch, pos, CAST(unicode(ch) AS BIGINT) AS c
              FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch, unnest(range(length(text))) AS pos FROM documents WHERE length(text) > 0)),
  fs AS (SELECT doc_id, ch, pos, {_NUMBERS} FROM dc WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
  sc AS (SELECT doc_id, ch, pos, [{_SCORES}] AS s FROM fs),
  dt AS (SELECT doc_id, ch, pos, ({tg.LABELS})[list_position(s, list_max(s))] AS pred FROM sc),
  {islands('pred', STRICT, 'ents')} SELECT * FROM ents"""


def q_governance_run(spark, sf_dir):
    """Impute -> tag notes -> map terms -> de-identify over one record table.

    Every record comes with the entities of its note and with the report, so all three results are computed.
    """
    from .bio_queries import customer_records
    from .jobs import governance_run
    from .term_queries import part_vocab
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    geo = (c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
           .select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("patient_id"),
                   F.concat(F.col("r_name"), F.lit(", "), F.col("n_name")).alias("geo")))
    recs = (customer_records(spark, sf_dir).join(geo, "patient_id")
            .withColumn("location", F.col("geo")).drop("geo")
            .withColumn("age_months", F.col("age_months") / 100)
            .withColumn("diagnosis_date", F.concat(F.lit("2024-0"),
                        (F.substring("patient_id", -1, 1).cast("int") % 3 + 1).cast("string"), F.lit("-15"))))
    model = tagger.train_tagger(_benchmark_sentences(spark, sf_dir), max_iter=5)
    data, ents, report = governance_run(spark, recs, vocab=part_vocab(spark, sf_dir), tagger=model,
                                        salt="cohortshare-test-salt")
    found = (ents.groupBy("patient_id")
             .agg(F.sort_array(F.collect_list(F.struct(*(c for c in ents.columns if c != "patient_id")))).alias("entities")))
    none = F.array().cast(found.schema["entities"].dataType)
    return (data.join(found, "patient_id", "left").withColumn("entities", F.coalesce("entities", none))
            .crossJoin(F.broadcast(report.select(F.struct(*report.columns).alias("report")))))


QUERIES["governance_run"] = q_governance_run
