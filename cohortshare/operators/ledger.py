"""The data-sharing ledger as a batch job over a request log.

Requests (seq, caller, op, id, data_hash, description, grantee, ts) are applied
in ``seq`` order per asset id with the contract's rules:

* ``init``   put unconditionally (seed): owner = caller, access list = [owner].
* ``create`` refused if the asset exists; else owner = caller, list = [owner].
* ``read``   not found / access denied unless the caller is on the list.
* ``grant``  not found / only the owner may grant; appends the grantee once.
* ``exists`` reports ``true``/``false`` (no access check).

Plan shape: no window holds all requests of an asset, so a hot asset never lands
in one task.  An asset's life is cut into segments by its *anchors*: its first
successful create and every ``init`` (plus the carried-in state in streaming).
The anchors come from one partial aggregate per id.  A request finds the only
anchor of its id by a join, the latest of several block by block of sequence
numbers (see ``_with_anchor``, ``_as_of``).  Valid grants are reduced to the earliest one per (id, anchor,
grantee) by another partial aggregate, and reads are resolved by an equi-join
against that small table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import LEDGER_STATE, REQUEST

# The seed asset of the ledger and the zero hash.
SEED_ID = "asset1"
SEED_OWNER = "Org1MSP"
ZERO_HASH = "0x" + "0" * 64
SEED_DESCRIPTION = "Initial rare-disease cohort record"

# The refusal messages of the contract.
MSG_ALREADY_EXISTS = "asset %s already exists"
MSG_NOT_FOUND = "asset %s does not exist"
MSG_ACCESS_DENIED = "access denied for %s on asset %s"
MSG_NOT_OWNER = "only owner %s may grant access"

OK, ALREADY_EXISTS, NOT_FOUND, ACCESS_DENIED, NOT_OWNER, LATE, INVALID = (
    "ok", "already_exists", "not_found", "access_denied", "not_owner", "late", "invalid_op")

REQ_COLS = [f.name for f in REQUEST.fields]
ANCHOR_OPS = ("create", "init")
ASKED = ["seq", "caller", "op", "id", "grantee"]           # what of a request decides its result


def init_assets(spark: SparkSession, seq: int = 0, ts=None) -> DataFrame:
    """L1: the seed as an ``init`` request (it starts the fold like any put)."""
    return spark.createDataFrame(
        [(seq, SEED_OWNER, "init", SEED_ID, ZERO_HASH, SEED_DESCRIPTION, None, ts)], REQUEST)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def has_access(access_list, caller) -> Column:
    """Column names or Columns."""
    return F.array_contains(_c(access_list), _c(caller))


def add_grantee(access_list, grantee) -> Column:
    """Append unless present (order kept)."""
    return F.array_union(_c(access_list), F.array(_c(grantee)))


def is_owner(owner, caller) -> Column:
    """B21."""
    return _c(owner) == _c(caller)


def rfc3339(ts) -> Column:
    """UTC timestamp text at second precision, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(_c(ts), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def assets_to_json(assets: DataFrame) -> DataFrame:
    """Asset documents with the contract's field names."""
    doc = F.struct(F.col("id").alias("id"), F.col("owner").alias("owner"), F.col("data_hash").alias("dataHash"),
                   F.col("description").alias("description"), F.col("access_list").alias("accessList"),
                   rfc3339("ts").alias("timestamp"))
    return assets.select("id", F.to_json(doc).alias("json"))


ASSET_JSON_SCHEMA = ("id string, owner string, dataHash string, description string, "
                     "accessList array<string>, timestamp string")


def assets_from_json(df: DataFrame, col: str = "json") -> DataFrame:
    """A8 inverse: JSON documents -> asset rows; the UTC text is the same instant in any session's time zone."""
    d = F.from_json(col, ASSET_JSON_SCHEMA)
    return df.select(d["id"].alias("id"), d["owner"].alias("owner"), d["dataHash"].alias("data_hash"),
                     d["description"].alias("description"), d["accessList"].alias("access_list"),
                     F.to_timestamp(d["timestamp"], "yyyy-MM-dd'T'HH:mm:ssX").alias("ts"))


def lookup_asset(requests: DataFrame, assets: DataFrame) -> DataFrame:
    """C4: point lookup by id; a missing asset gives ``found = false``."""
    a = assets.select(F.col("id"), F.struct(*[c for c in assets.columns]).alias("asset"))
    return requests.join(a, "id", "left").withColumn("found", F.col("asset").isNotNull())


def asset_exists(requests: DataFrame, assets: DataFrame, negate: bool = False) -> DataFrame:
    """C5 as a filter: requests whose asset exists (semi join) or not (anti join)."""
    return requests.join(assets.select("id"), "id", "left_anti" if negate else "left_semi")


def all_assets(assets: DataFrame) -> DataFrame:
    """every asset in key order."""
    return assets.orderBy("id")


@dataclass
class LedgerResult:
    results: DataFrame   # RESULT rows, one per request
    assets: DataFrame    # ASSET rows: final state of existing assets
    state: DataFrame     # LEDGER_STATE rows: carried to the next micro-batch
    cached: tuple = ()

    def release(self) -> None:
        """Drop the persisted intermediate once the outputs are written."""
        for d in self.cached:
            d.unpersist()


def _anchors(reqs: DataFrame, state: DataFrame | None) -> DataFrame:
    """(id, aseq, kind, owner, data_hash, description, ts) for every segment start."""
    payload = F.struct("seq", "caller", "data_hash", "description", "ts")
    per_id = reqs.where(F.col("op").isin(*ANCHOR_OPS)).groupBy("id").agg(
        F.min_by(payload, F.when(F.col("op") == "create", F.col("seq"))).alias("c"),
        F.min(F.when(F.col("op") == "create", F.col("seq"))).alias("cseq"),
        F.min(F.when(F.col("op") == "init", F.col("seq"))).alias("iseq"))
    if state is not None:
        live = state.where(F.col("owner").isNotNull()).select("id", F.lit(True).alias("_live"))
        per_id = per_id.join(live, "id", "left")
        no_state = F.col("_live").isNull()
    else:
        no_state = F.lit(True)
    creates = (per_id.where(F.col("cseq").isNotNull() & no_state
                            & (F.col("iseq").isNull() | (F.col("iseq") > F.col("cseq"))))
               .select("id", F.col("cseq").alias("aseq"), F.lit("create").alias("kind"),
                       F.col("c.caller").alias("owner"), F.col("c.data_hash").alias("data_hash"),
                       F.col("c.description").alias("description"), F.col("c.ts").alias("ts")))
    inits = reqs.where(F.col("op") == "init").select(
        "id", F.col("seq").alias("aseq"), F.lit("init").alias("kind"), F.col("caller").alias("owner"),
        "data_hash", "description", "ts")
    anchors = creates.unionByName(inits)
    if state is not None:
        anchors = anchors.unionByName(state.where(F.col("owner").isNotNull()).select(
            "id", F.col("last_seq").alias("aseq"), F.lit("state").alias("kind"), "owner", "data_hash",
            "description", "ts"))
    return anchors


SEQ_BLOCK = 1 << 16          # sequence numbers per block of the as-of lookup


def _as_of(reqs: DataFrame, anchors: DataFrame) -> DataFrame:
    """What decides each request's result (``ASKED``), with the latest anchor ``a`` of its id at or before it (NULL without
    one); repeated requests stay. Hashes, descriptions and times stay with the anchors and are not moved here.

    An id's life is cut into blocks of ``SEQ_BLOCK`` sequence numbers. Each block's last anchor comes from a partial
    aggregate and is carried forward over the id's blocks; inside (id, block) a window finds the rest. So a hot id is
    spread over its blocks, and a request meets one row whatever the number of anchors. A request without an id or
    a seq has no anchor; it passes by the lookup.
    """
    a = F.struct("aseq", "owner")
    starts = (anchors.where(F.col("id").isNotNull() & F.col("aseq").isNotNull())
              .select("id", F.col("aseq").alias("at"), a.alias("a")))
    none = F.lit(None).cast(starts.schema["a"].dataType)
    placed = F.col("id").isNotNull() & F.col("seq").isNotNull()
    unplaced = reqs.where(~placed).select(*ASKED, none.alias("a"))
    asked = reqs.where(placed).select("id", F.col("seq").alias("at"), none.alias("a"), F.struct(*ASKED).alias("r"))
    rows = asked.unionByName(starts.withColumn("r", F.lit(None).cast(asked.schema["r"].dataType)))
    rows = rows.withColumn("block", F.floor(F.col("at") / SEQ_BLOCK))
    earlier = Window.partitionBy("id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (rows.groupBy("id", "block").agg(F.max_by("a", F.when(F.col("a").isNotNull(), F.col("at"))).alias("last"))
               .select("id", "block", F.last("last", ignorenulls=True).over(earlier).alias("before")))
    here = F.last("a", ignorenulls=True).over(Window.partitionBy("id", "block").orderBy("at"))
    return (rows.join(carried, ["id", "block"]).withColumn("a", F.coalesce(here, "before"))
            .where(F.col("r").isNotNull()).select("r.*", "a").unionByName(unplaced))


def _with_anchor(reqs: DataFrame, anchors: DataFrame) -> DataFrame:
    """The rows of :func:`_as_of`; of an id with one anchor they come by a join with the anchors' ids alone.

    Only the requests of ids with several anchors are ordered. A hot id is one large key of a left join, which
    adaptive execution splits.
    """
    per_id = (anchors.where(F.col("id").isNotNull() & F.col("aseq").isNotNull()).groupBy("id")
              .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("aseq", "owner")).alias("a")))
    joined = reqs.select(*ASKED).join(per_id, "id", "left")
    one = (joined.where(F.coalesce("n", F.lit(1)) == 1)
           .select(*ASKED, F.when(F.col("a.aseq") <= F.col("seq"), F.col("a")).alias("a")))
    several = per_id.where(F.col("n") > 1).select("id")
    return one.unionByName(_as_of(reqs.select(*ASKED).join(several, "id"), anchors.join(several, "id", "left_semi")))


def apply_requests(requests: DataFrame, state: DataFrame | None = None) -> LedgerResult:
    """L5 (and the per-batch step of L6): one RESULT per request plus the final state.

    ``state`` (LEDGER_STATE) is the ledger before this log; requests with
    ``seq`` at or below an id's ``last_seq`` are answered ``late`` and ignored.
    """
    reqs = requests.select(*REQ_COLS)
    late, cached = None, []
    if state is not None:
        # both are asked several times below: the state is read, and the log joined with it, once;
        # only requests that may anchor keep their payload
        payload = {c: F.when(F.col("op").isin(*ANCHOR_OPS), F.col(c)).alias(c) for c in REQ_COLS if c not in ASKED}
        reqs = reqs.select(*[payload.get(c, F.col(c)) for c in REQ_COLS])
        state = state.persist(StorageLevel.MEMORY_AND_DISK)
        is_late = F.coalesce(F.col("seq") <= F.col("_last"), F.lit(False))
        marked = (reqs.join(state.select("id", F.col("last_seq").alias("_last")), "id", "left")
                  .select(*REQ_COLS, is_late.alias("_late")).persist(StorageLevel.MEMORY_AND_DISK))
        late = marked.where("_late").select(*REQ_COLS)
        reqs = marked.where(~F.col("_late")).select(*REQ_COLS)
        cached = [marked, state]
    anchors = _anchors(reqs, state).persist(StorageLevel.MEMORY_AND_DISK)
    based = _with_anchor(reqs, anchors).persist(StorageLevel.MEMORY_AND_DISK)

    op, caller, owner = F.col("op"), F.col("caller"), F.col("a.owner")
    has = F.col("a").isNotNull()
    own_anchor = has & (F.col("a.aseq") == F.col("seq"))
    grant_ok = (op == "grant") & has & ~own_anchor & (caller == owner)
    grants = (based.where(grant_ok)
              .groupBy("id", F.col("a.aseq").alias("aseq"), F.col("grantee"))
              .agg(F.min("seq").alias("gseq"), F.lit(0).alias("gpos")))
    if state is not None:
        base = state.where(F.col("owner").isNotNull()).select(
            "id", F.col("last_seq").alias("aseq"), F.posexplode("access_list").alias("gpos", "grantee"))
        grants = grants.unionByName(base.select("id", "aseq", "grantee", F.col("aseq").alias("gseq"), "gpos"))
        grants = (grants.groupBy("id", "aseq", "grantee").agg(F.min(F.struct("gseq", "gpos")).alias("m"))
                  .select("id", "aseq", "grantee", F.col("m.gseq").alias("gseq"), F.col("m.gpos").alias("gpos")))
    g = grants.select("id", F.col("aseq").alias("_gaseq"), F.col("grantee").alias("_gcaller"),
                      F.col("gseq"))

    # reads resolve against the earliest valid grant of the caller in the same segment
    is_read = (op == "read") & has & (caller != owner)
    res = based.join(g, is_read & (based.id == g.id) & (F.col("a.aseq") == g._gaseq) & (based.caller == g._gcaller),
                     "left").select(based["*"], F.coalesce(F.col("gseq") < based.seq, F.lit(False)).alias("_granted"))

    idq = F.col("id")
    status = (F.when(op == "init", F.lit(OK))
              .when(op == "create", F.when(own_anchor, F.lit(OK)).otherwise(F.lit(ALREADY_EXISTS)))
              .when(op.isin("read", "grant", "exists") & ~has, F.when(op == "exists", F.lit(OK))
                    .otherwise(F.lit(NOT_FOUND)))
              .when(op == "exists", F.lit(OK))
              .when(op == "grant", F.when(caller == owner, F.lit(OK)).otherwise(F.lit(NOT_OWNER)))
              .when(op == "read", F.when((caller == owner) | F.coalesce(F.col("_granted"), F.lit(False)), F.lit(OK))
                    .otherwise(F.lit(ACCESS_DENIED)))
              .otherwise(F.lit(INVALID)))
    message = (F.when(op == "exists", F.when(has, F.lit("true")).otherwise(F.lit("false")))
               .when(status == ALREADY_EXISTS, F.format_string(MSG_ALREADY_EXISTS, idq))
               .when(status == NOT_FOUND, F.format_string(MSG_NOT_FOUND, idq))
               .when(status == ACCESS_DENIED, F.format_string(MSG_ACCESS_DENIED, caller, idq))
               .when(status == NOT_OWNER, F.format_string(MSG_NOT_OWNER, owner)))
    results = res.select("seq", "op", "id", "caller", status.alias("status"), message.alias("message"))
    if late is not None:
        results = results.unionByName(late.select("seq", "op", "id", "caller", F.lit(LATE).alias("status"),
                                                  F.lit("seq at or below the last applied").alias("message")))

    # final state: the latest anchor per id with its grantees in grant order
    last = anchors.groupBy("id").agg(F.max_by(F.struct("aseq", "owner", "data_hash", "description", "ts"),
                                              F.col("aseq")).alias("l"))
    lg = (grants.join(last.select("id", F.col("l.aseq").alias("aseq")), ["id", "aseq"])
          .groupBy("id").agg(F.array_sort(F.collect_list(F.struct("gseq", "gpos", "grantee"))).alias("gl")))
    assets = (last.join(lg, "id", "left")
              .select("id", F.col("l.owner").alias("owner"), F.col("l.data_hash").alias("data_hash"),
                      F.col("l.description").alias("description"),
                      F.array_distinct(F.concat(F.array(F.col("l.owner")),
                                                F.transform(F.coalesce("gl", F.array()), lambda x: x["grantee"])))
                      .alias("access_list"),
                      F.col("l.ts").alias("ts")))
    seen = reqs.groupBy("id").agg(F.max("seq").alias("last_seq"))
    if state is not None:
        seen = (seen.unionByName(state.select("id", "last_seq"))
                .groupBy("id").agg(F.max("last_seq").alias("last_seq")))
    new_state = seen.join(assets, "id", "left").select(*[f.name for f in LEDGER_STATE.fields])
    return LedgerResult(results, assets, new_state, (based, anchors, *cached))
