"""Registered ledger queries: the events table as a request log.

seq = event_id; id = 'asset_' || user_id; signup -> create, purchase -> grant,
error -> exists, click/view -> read; with k from ``props``: caller =
'Org' || k mod 4 || 'MSP', grantee = 'Org' || (k div 10) mod 4 || 'MSP'.
The seeded variant turns signups with k mod 10 = 0 into ``init`` puts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as lg
from ..sources.tables import table


def event_requests(spark, sf_dir, seeded: bool = False):
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    op = (F.when(F.col("event_type") == "signup", F.lit("create"))
          .when(F.col("event_type") == "purchase", F.lit("grant"))
          .when(F.col("event_type") == "error", F.lit("exists"))
          .otherwise(F.lit("read")))
    if seeded:
        op = F.when((F.col("event_type") == "signup") & (k % 10 == 0), F.lit("init")).otherwise(op)
    aid = F.concat(F.lit("asset_"), F.col("user_id").cast("string"))
    return e.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("Org"), (k % 4).cast("string"), F.lit("MSP")).alias("caller"),
        op.alias("op"), aid.alias("id"),
        F.concat(F.lit("0x"), F.lpad(F.lower(F.hex("event_id")), 64, "0")).alias("data_hash"),
        F.concat(F.lit("benchmark asset "), aid).alias("description"),
        F.concat(F.lit("Org"), (F.floor(k / 10) % 4).cast("string"), F.lit("MSP")).alias("grantee"),
        F.col("ts"))


def q_ledger_results(spark, sf_dir):
    return lg.apply_requests(event_requests(spark, sf_dir)).results


def q_ledger_status_counts(spark, sf_dir):
    r = lg.apply_requests(event_requests(spark, sf_dir)).results
    return r.groupBy("op", "status").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def _state_out(assets):
    return assets.select("id", "owner", "data_hash", "description",
                         F.array_join("access_list", ",").alias("access_list"),
                         lg.rfc3339("ts").alias("ts"))


def q_ledger_state(spark, sf_dir):
    return _state_out(lg.apply_requests(event_requests(spark, sf_dir)).assets)


def q_ledger_all_assets(spark, sf_dir):
    a = lg.all_assets(lg.apply_requests(event_requests(spark, sf_dir)).assets)
    return lg.assets_to_json(a)


def q_ledger_seeded(spark, sf_dir):
    return lg.apply_requests(event_requests(spark, sf_dir, seeded=True)).results


def q_ledger_seeded_state(spark, sf_dir):
    return _state_out(lg.apply_requests(event_requests(spark, sf_dir, seeded=True)).assets)


def q_ledger_from_files(spark, sf_dir):
    """The request log staged as Parquet files and read back through the request source."""
    from ..session import scratch_path
    from ..sources import requests
    path = scratch_path(spark, "requests")
    requests.write_requests(event_requests(spark, sf_dir), path)
    return lg.apply_requests(requests.read_requests(spark, path)).results


QUERIES = {
    "ledger_results": q_ledger_results,
    "ledger_from_files": q_ledger_from_files,
    "ledger_status_counts": q_ledger_status_counts,
    "ledger_state": q_ledger_state,
    "ledger_all_assets": q_ledger_all_assets,
    "ledger_seeded": q_ledger_seeded,
    "ledger_seeded_state": q_ledger_seeded_state,
}


def _ledger_sql(seeded: bool) -> str:
    init = "WHEN event_type = 'signup' AND k % 10 = 0 THEN 'init'" if seeded else ""
    return f"""
  WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
  r AS (SELECT event_id AS seq, 'Org' || CAST(k % 4 AS VARCHAR) || 'MSP' AS caller,
               CASE {init} WHEN event_type = 'signup' THEN 'create' WHEN event_type = 'purchase' THEN 'grant'
                    WHEN event_type = 'error' THEN 'exists' ELSE 'read' END AS op,
               'asset_' || CAST(user_id AS VARCHAR) AS id,
               '0x' || lpad(lower(hex(event_id)), 64, '0') AS data_hash,
               'benchmark asset asset_' || CAST(user_id AS VARCHAR) AS description,
               'Org' || CAST((k // 10) % 4 AS VARCHAR) || 'MSP' AS grantee, ts
        FROM e),
  fc AS (SELECT id, min(seq) AS cseq FROM r WHERE op = 'create' GROUP BY id),
  mi AS (SELECT id, min(seq) AS iseq FROM r WHERE op = 'init' GROUP BY id),
  anchors AS (
    SELECT r.id, r.seq AS aseq, r.caller AS owner, r.data_hash, r.description, r.ts
    FROM r JOIN fc ON r.seq = fc.cseq LEFT JOIN mi ON r.id = mi.id
    WHERE mi.iseq IS NULL OR mi.iseq > fc.cseq
    UNION ALL
    SELECT id, seq, caller, data_hash, description, ts FROM r WHERE op = 'init'),
  ra AS (SELECT r.*, a.aseq, a.owner FROM r ASOF LEFT JOIN anchors a ON r.id = a.id AND r.seq >= a.aseq),
  g AS (SELECT id, aseq, grantee, min(seq) AS gseq FROM ra
        WHERE op = 'grant' AND aseq IS NOT NULL AND aseq < seq AND caller = owner GROUP BY id, aseq, grantee),
  res AS (
    SELECT ra.seq, ra.op, ra.id, ra.caller,
      CASE WHEN op = 'init' THEN 'ok'
           WHEN op = 'create' THEN CASE WHEN ra.aseq = ra.seq THEN 'ok' ELSE 'already_exists' END
           WHEN op = 'exists' THEN 'ok'
           WHEN ra.aseq IS NULL THEN 'not_found'
           WHEN op = 'grant' THEN CASE WHEN caller = owner THEN 'ok' ELSE 'not_owner' END
           WHEN op = 'read' THEN CASE WHEN caller = owner OR g.gseq < ra.seq THEN 'ok' ELSE 'access_denied' END
           ELSE 'invalid_op' END AS status,
      ra.owner
    FROM ra LEFT JOIN g ON op = 'read' AND ra.id = g.id AND ra.aseq = g.aseq AND ra.caller = g.grantee),
  results AS (
    SELECT seq, op, id, caller, status,
      CASE WHEN op = 'exists' THEN CASE WHEN owner IS NOT NULL THEN 'true' ELSE 'false' END
           WHEN status = 'already_exists' THEN 'asset ' || id || ' already exists'
           WHEN status = 'not_found' THEN 'asset ' || id || ' does not exist'
           WHEN status = 'access_denied' THEN 'access denied for ' || caller || ' on asset ' || id
           WHEN status = 'not_owner' THEN 'only owner ' || owner || ' may grant access' END AS message
    FROM res),
  lastanc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY aseq DESC) AS rn FROM anchors) x
              WHERE rn = 1),
  lists AS (SELECT l.id, string_agg(g.grantee, ',' ORDER BY g.gseq) AS gl
            FROM lastanc l JOIN g ON l.id = g.id AND l.aseq = g.aseq AND g.grantee <> l.owner GROUP BY l.id),
  state AS (SELECT l.id, l.owner, l.data_hash, l.description,
                   l.owner || coalesce(',' || lists.gl, '') AS access_list,
                   strftime(l.ts, '%Y-%m-%dT%H:%M:%SZ') AS ts, l.ts AS raw_ts
            FROM lastanc l LEFT JOIN lists ON l.id = lists.id)"""


ORACLE = {
    "ledger_results": _ledger_sql(False) + " SELECT * FROM results",
    "ledger_from_files": _ledger_sql(False) + " SELECT * FROM results",
    "ledger_status_counts": _ledger_sql(False) + """
  SELECT op, status, CAST(count(*) AS BIGINT) AS n FROM results GROUP BY 1, 2""",
    "ledger_state": _ledger_sql(False) + " SELECT id, owner, data_hash, description, access_list, ts FROM state",
    "ledger_all_assets": _ledger_sql(False) + """
  SELECT id, json_object('id', id, 'owner', owner, 'dataHash', data_hash, 'description', description,
                         'accessList', string_split(access_list, ','), 'timestamp', ts)::VARCHAR AS json
  FROM state""",
    "ledger_seeded": _ledger_sql(True) + " SELECT * FROM results",
    "ledger_seeded_state": _ledger_sql(True) + " SELECT id, owner, data_hash, description, access_list, ts FROM state",
}
