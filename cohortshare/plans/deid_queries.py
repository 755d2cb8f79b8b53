"""Registered de-identification queries over the driver tables.

Each maps table columns onto the record roles (age, location, date, lab value)
and injects missing values by key, with the same rule in the SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import deid
from ..session import spread
from ..sources.tables import table

SALT = "cohortshare-test-salt"   # fixed for reproducible tests; secret in production


def lineitem_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spread(table(spark, sf_dir, "lineitem"))
    return li.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
        .alias("patient_id"),
        F.col("l_quantity").alias("age_months"),
        F.concat(F.col("l_returnflag"), F.lit(", "), F.col("l_linestatus")).alias("location"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("diagnosis_date"),
        F.col("l_extendedprice").alias("lab_value"))


def orders_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spread(table(spark, sf_dir, "orders"))
    k = F.col("o_orderkey")
    return o.select(
        k,
        F.col("o_totalprice").alias("age_months"),
        F.col("o_orderpriority").alias("location"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("diagnosis_date"),
        F.when(k % 9 == 0, F.lit(None).cast("double")).otherwise(F.col("o_totalprice")).alias("lab_value"))


def q_deid_generalise(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    k = F.col("o_orderkey")
    joined = (o.join(c, o.o_custkey == c.c_custkey)
              .join(n, c.c_nationkey == n.n_nationkey)
              .join(r, n.n_regionkey == r.r_regionkey))
    loc = (F.when(k % 11 == 0, F.lit(None).cast("string"))
           .when(k % 11 == 1, F.lit("   "))
           .when(k % 11 == 2, F.concat(F.lit(","), F.col("r_name")))
           .when(k % 11 == 3, F.col("n_name"))
           .otherwise(F.concat(F.lit(" "), F.col("n_name"), F.lit(" , "), F.col("r_name"))))
    dt = (F.when(k % 13 == 0, F.lit(None).cast("string"))
          .when(k % 13 == 1, F.date_format("o_orderdate", "yyyy-M"))
          .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))
    age = (F.when(k % 17 == 0, F.lit(None).cast("double"))
           .when(k % 17 == 1, -F.col("c_acctbal"))
           .otherwise(F.col("o_totalprice") / F.lit(1000.0)))
    recs = joined.select(k, age.alias("age_months"), loc.alias("location"), dt.alias("diagnosis_date"))
    return deid.apply_generalisation(recs)


def q_deid_k_anonymity(spark, sf_dir):
    gen = deid.apply_generalisation(orders_records(spark, sf_dir), width=50000)
    return deid.enforce_k_anonymity(gen, k=5).select("o_orderkey", *deid.QI)


def q_deid_class_size(spark, sf_dir):
    gen = deid.apply_generalisation(orders_records(spark, sf_dir), width=50000)
    return deid.with_class_size(gen).select("o_orderkey", *deid.QI, F.col("class_size").cast("bigint"))


def q_deid_laplace_keyed(spark, sf_dir):
    gen = deid.apply_generalisation(orders_records(spark, sf_dir), width=50000)
    kept = deid.enforce_k_anonymity(gen, k=5)
    noisy = deid.laplace_noise(kept, ["lab_value"], 1.0, key="o_orderkey", salt=SALT)
    return noisy.select("o_orderkey", F.round("lab_value", 4).alias("lab_value"))


def q_deid_report(spark, sf_dir):
    res = deid.deidentify(orders_records(spark, sf_dir), width=50000, key="o_orderkey", salt=SALT)
    return res.report


def q_deid_full(spark, sf_dir):
    res = deid.deidentify(lineitem_records(spark, sf_dir), key="patient_id", salt=SALT)
    return res.data.select("patient_id", "age_months_gen", "location", "diagnosis_date",
                           F.round("lab_value", 4).alias("lab_value"))


def q_deid_full_report(spark, sf_dir):
    return deid.deidentify(lineitem_records(spark, sf_dir), key="patient_id", salt=SALT).report


QUERIES = {
    "deid_generalise": q_deid_generalise,
    "deid_k_anonymity": q_deid_k_anonymity,
    "deid_class_size": q_deid_class_size,
    "deid_laplace_keyed": q_deid_laplace_keyed,
    "deid_report": q_deid_report,
    "deid_full": q_deid_full,
    "deid_full_report": q_deid_full_report,
}

_ORDERS_RECORDS = """
  SELECT o_orderkey, o_totalprice AS age_months, o_orderpriority AS location,
         strftime(o_orderdate, '%Y-%m-%d') AS diagnosis_date,
         CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END AS lab_value
  FROM orders"""

_LINEITEM_RECORDS = """
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS patient_id,
         l_quantity AS age_months, l_returnflag || ', ' || l_linestatus AS location,
         strftime(l_shipdate, '%Y-%m-%d') AS diagnosis_date, l_extendedprice AS lab_value
  FROM lineitem"""


def _gen_sql(src: str, width: int) -> str:
    return f"""
  SELECT *,
    CASE WHEN age_months IS NULL OR isnan(age_months) THEN '*'
         ELSE '[' || CAST(CAST(floor(age_months / {width}.0) AS BIGINT) * {width} AS VARCHAR) || ','
              || CAST(CAST(floor(age_months / {width}.0) AS BIGINT) * {width} + {width} AS VARCHAR) || ')'
    END AS age_months_gen,
    CASE WHEN location IS NULL OR trim(location) = '' THEN '*'
         ELSE trim(split_part(location, ',', 1)) END AS g_location,
    CASE WHEN length(diagnosis_date) >= 7 THEN substr(diagnosis_date, 1, 7) ELSE '*' END AS g_date
  FROM ({src}) s"""


def _kept_sql(src: str, width: int, k: int = 5) -> str:
    return f"""
  SELECT * FROM (
    SELECT *, count(*) OVER (PARTITION BY age_months_gen, g_location, g_date) AS class_size
    FROM ({_gen_sql(src, width)}) g) c
  WHERE class_size >= {k}"""


def _noise_sql(kept: str, key: str) -> str:
    return f"""
  WITH kept AS ({kept}),
  rng AS (SELECT CASE WHEN max(lab_value) - min(lab_value) = 0 THEN 1.0
                      ELSE max(lab_value) - min(lab_value) END AS b FROM kept),
  u AS (SELECT kept.*, rng.b,
          (CAST(('0x' || substr(md5(concat_ws('|', '{SALT}', CAST({key} AS VARCHAR), 'lab_value')), 1, 8))
                AS BIGINT) + 0.5) / 4294967296.0 - 0.5 AS u
        FROM kept, rng)
  SELECT *, CASE WHEN lab_value IS NULL THEN NULL
                 ELSE lab_value + (-b * sign(u) * ln(greatest(1.0 - 2.0 * abs(u), 1e-300))) END AS noisy
  FROM u"""


def _report_sql(src: str, width: int) -> str:
    return f"""
  WITH g AS ({_gen_sql(src, width)}),
  cls AS (SELECT count(*) AS n FROM g GROUP BY age_months_gen, g_location, g_date),
  ages AS (SELECT min(age_months) AS lo, max(age_months) AS hi FROM ({src}) s),
  agg AS (SELECT sum(n) AS records_in, coalesce(sum(CASE WHEN n >= 5 THEN n END), 0) AS records_out,
                 count(CASE WHEN n >= 5 THEN 1 END) AS classes_out FROM cls)
  SELECT CAST(records_in AS BIGINT) AS records_in, CAST(records_out AS BIGINT) AS records_out,
         CAST(classes_out AS BIGINT) AS classes_out,
         CASE WHEN lo IS NULL THEN 0.0
              ELSE round(least({width}.0 / (CASE WHEN hi - lo = 0 THEN 1.0 ELSE hi - lo END), 1.0) * 100.0, 2)
         END AS information_loss,
         CASE WHEN records_out = 0 THEN 0.0 ELSE round(100.0 * classes_out / records_out, 4) END AS reid_risk
  FROM agg, ages"""


ORACLE = {
    "deid_generalise": """
  WITH r AS (
    SELECT o_orderkey,
      CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 17 = 1 THEN -c_acctbal
           ELSE o_totalprice / 1000.0 END AS age_months,
      CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 11 = 1 THEN '   '
           WHEN o_orderkey % 11 = 2 THEN ',' || r_name WHEN o_orderkey % 11 = 3 THEN n_name
           ELSE ' ' || n_name || ' , ' || r_name END AS location,
      CASE WHEN o_orderkey % 13 = 0 THEN NULL
           WHEN o_orderkey % 13 = 1 THEN strftime(o_orderdate, '%Y-') || CAST(month(o_orderdate) AS VARCHAR)
           ELSE strftime(o_orderdate, '%Y-%m-%d') END AS diagnosis_date
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
         JOIN region ON n_regionkey = r_regionkey)
  SELECT o_orderkey, age_months, g_location AS location, g_date AS diagnosis_date, age_months_gen
  FROM (""" + _gen_sql("SELECT * FROM r", 12) + ") x",
    "deid_k_anonymity": f"""
  SELECT o_orderkey, age_months_gen, g_location AS location, g_date AS diagnosis_date
  FROM ({_kept_sql(_ORDERS_RECORDS, 50000)}) k""",
    "deid_class_size": f"""
  SELECT o_orderkey, age_months_gen, g_location AS location, g_date AS diagnosis_date,
         CAST(count(*) OVER (PARTITION BY age_months_gen, g_location, g_date) AS BIGINT) AS class_size
  FROM ({_gen_sql(_ORDERS_RECORDS, 50000)}) g""",
    "deid_laplace_keyed": f"""
  SELECT o_orderkey, round(noisy, 4) AS lab_value
  FROM ({_noise_sql(_kept_sql(_ORDERS_RECORDS, 50000), 'o_orderkey')}) n""",
    "deid_report": _report_sql(_ORDERS_RECORDS, 50000),
    "deid_full": f"""
  SELECT patient_id, age_months_gen, g_location AS location, g_date AS diagnosis_date,
         round(noisy, 4) AS lab_value
  FROM ({_noise_sql(_kept_sql(_LINEITEM_RECORDS, 12), 'patient_id')}) n""",
    "deid_full_report": _report_sql(_LINEITEM_RECORDS, 12),
}
