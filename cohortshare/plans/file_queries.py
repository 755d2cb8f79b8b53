"""Registered queries of the jobs and sources that go from file to file."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as lg
from ..operators import terms as tm
from ..session import scratch_path
from ..sources import bio_io, records, vocab
from ..sources.tables import table
from . import bio_queries, deid_queries, impute_queries, jobs, ledger_queries, term_queries


def q_impute_job(spark, sf_dir):
    """X1 from CSV to CSV; every row carries the count of missing cells that the job returned."""
    inp, out = scratch_path(spark, "impute-in"), scratch_path(spark, "impute-out")
    c = impute_queries.customer_missing(spark, sf_dir)
    records.write_records(c.select(F.col("c_custkey").alias("patient_id"), F.col("c_acctbal").alias("age_months"),
                                   F.col("c_nationkey").alias("lab_value")), inp)
    n = jobs.impute_job(spark, inp, out, estimator="ols")
    back = records.read_records(spark, out)
    return back.select(F.col("patient_id").cast("bigint").alias("patient_id"), F.round("age_months", 4).alias("age_months"),
                       F.round("lab_value", 4).alias("lab_value"), F.lit(n).cast("bigint").alias("n_missing"))


def q_convert_job(spark, sf_dir):
    """X2 from JSON arrays to BIO text, read back; every sentence carries the count of examples."""
    inp, out = scratch_path(spark, "convert-in"), scratch_path(spark, "convert-out")
    bio_io.write_examples(bio_queries.conversation_examples(spark, sf_dir), inp, array=True)
    n = jobs.convert_job(spark, inp, out)
    back = bio_io.read_bio(spark, out, labels=None)
    return back.select(F.array_join("tokens", "").alias("tokens"), F.array_join("tags", " ").alias("tags"),
                       F.lit(n).cast("bigint").alias("n_examples"))


def q_deidentify_job(spark, sf_dir):
    """X4 from CSV to CSV; every row carries the report."""
    inp, out = scratch_path(spark, "deid-in"), scratch_path(spark, "deid-out")
    records.write_records(deid_queries.lineitem_records(spark, sf_dir), inp)
    report = jobs.deidentify_job(spark, inp, out, key="patient_id", salt=deid_queries.SALT)
    back = records.read_records(spark, out)
    return back.select("patient_id", "age_months_gen", "location", "diagnosis_date", F.round("lab_value", 4).alias("lab_value"),
                       *[F.lit(v).alias(name) for name, v in report.items()])


def q_vocab_file(spark, sf_dir):
    """The vocabulary by way of its CSV form, used for exact matches."""
    path = scratch_path(spark, "vocab")
    vocab.write_vocab(term_queries.part_vocab(spark, sf_dir), path)
    m = tm.map_terms(term_queries.part_terms(spark, sf_dir), vocab.read_vocab(spark, path), exact_only=True)
    return m.select("p_partkey", "term", "code", "match_type")


def q_corpus_lines(spark, sf_dir):
    """The documents as a plain-text corpus, its sentences counted."""
    path = scratch_path(spark, "corpus")
    table(spark, sf_dir, "documents").where("text IS NOT NULL").select("text").write.text(path)
    return bio_io.read_corpus(spark, path).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


def q_term_score_in_row(spark, sf_dir):
    """B5-B8, F3, G1 in the row: each perturbed term against the name it came from."""
    t = term_queries.part_terms(spark, sf_dir).join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey")
    return t.select("p_partkey", F.round(tm.edit_similarity("term", "p_name"), 6).alias("edit"),
                    F.round(tm.char_cosine("term", "p_name"), 6).alias("cosine"),
                    F.round(tm.hybrid_score("term", "p_name"), 6).alias("hybrid"))


def q_ledger_documents(spark, sf_dir):
    """L1 and A8 both ways: the seed goes before all events, the assets' JSON documents are decoded again."""
    log = lg.init_assets(spark, seq=-1, ts=None).unionByName(ledger_queries.event_requests(spark, sf_dir))
    back = lg.assets_from_json(lg.assets_to_json(lg.apply_requests(log).assets))
    return ledger_queries._state_out(back)


QUERIES = {
    "impute_job": q_impute_job,
    "convert_job": q_convert_job,
    "deidentify_job": q_deidentify_job,
    "vocab_file": q_vocab_file,
    "corpus_lines": q_corpus_lines,
    "term_score_in_row": q_term_score_in_row,
    "ledger_documents": q_ledger_documents,
}

_PARTS = """
  WITH t AS (SELECT p_partkey, p_name AS b,
               CASE WHEN p_partkey % 5 = 0 THEN p_name
                    WHEN p_partkey % 5 = 1 THEN substr(p_name, 1, CAST((p_partkey // 5) % length(p_name) AS INTEGER))
                         || substr(p_name, CAST(2 + (p_partkey // 5) % length(p_name) AS INTEGER))
                    WHEN p_partkey % 5 = 2 THEN reverse(p_name)
                    WHEN p_partkey % 5 = 3 THEN p_name || 's'
                    WHEN p_partkey % 10 = 4 THEN p_brand ELSE CAST(p_partkey AS VARCHAR) END AS a
             FROM part),
  ca AS (SELECT p_partkey, ch, count(*) AS n FROM (SELECT p_partkey, unnest(string_split(a, '')) AS ch FROM t) GROUP BY 1, 2),
  cb AS (SELECT p_partkey, ch, count(*) AS n FROM (SELECT p_partkey, unnest(string_split(b, '')) AS ch FROM t) GROUP BY 1, 2),
  na AS (SELECT p_partkey, sqrt(sum(n * n)) AS v FROM ca GROUP BY 1),
  nb AS (SELECT p_partkey, sqrt(sum(n * n)) AS v FROM cb GROUP BY 1),
  dot AS (SELECT p_partkey, sum(ca.n * cb.n) AS v FROM ca JOIN cb USING (p_partkey, ch) GROUP BY 1),
  s AS (SELECT p_partkey, 1 - levenshtein(a, b) / CAST(greatest(length(a), length(b), 1) AS DOUBLE) AS e,
               coalesce(dot.v / (na.v * nb.v), 0) AS c
        FROM t LEFT JOIN dot USING (p_partkey) LEFT JOIN na USING (p_partkey) LEFT JOIN nb USING (p_partkey))"""

ORACLE = {
    "impute_job": "SELECT c_custkey AS patient_id, c_acctbal AS age_months, c_nationkey AS lab_value, n_missing FROM ("
                  + impute_queries.ORACLE["mice_customer"] + ") m, (" + impute_queries.ORACLE["count_missing"] + ") n",
    "convert_job": "SELECT tokens, tags, n_examples FROM (" + bio_queries.ORACLE["bio_roundtrip"] + ") r, ("
                   + bio_queries.ORACLE["bio_example_count"] + ") n",
    "deidentify_job": "SELECT * FROM (" + deid_queries.ORACLE["deid_full"] + ") d, ("
                      + deid_queries.ORACLE["deid_full_report"] + ") r",
    "vocab_file": term_queries.ORACLE["term_exact"],
    "corpus_lines": """
  SELECT text, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS text FROM documents) l GROUP BY text""",
    "term_score_in_row": _PARTS + """
  SELECT p_partkey, round(e, 6) AS edit, round(c, 6) AS cosine, round(0.4 * e + 0.6 * c, 6) AS hybrid FROM s""",
    "ledger_documents": ledger_queries.ORACLE["ledger_state"] + """
  UNION ALL SELECT 'asset1', 'Org1MSP', '0x' || repeat('0', 64), 'Initial rare-disease cohort record', 'Org1MSP', NULL""",
}
