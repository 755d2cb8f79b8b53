import datetime as dt

from pyspark.sql import functions as F

from cohortshare.operators import ledger as lg
from cohortshare.schemas import LEDGER_STATE, REQUEST

TS = dt.datetime(2024, 1, 1, 12, 0, 0)


def _reqs(spark, rows):
    return spark.createDataFrame([(s, c, o, i, f"0x{s:064x}", f"d{s}", g, TS + dt.timedelta(seconds=s))
                                  for s, c, o, i, g in rows], REQUEST)


FX8 = [(1, "Org1MSP", "read", "a", None), (2, "Org1MSP", "create", "a", None), (3, "Org2MSP", "create", "a", None),
       (4, "Org2MSP", "read", "a", None), (5, "Org2MSP", "grant", "a", "Org2MSP"),
       (6, "Org1MSP", "grant", "a", "Org2MSP"), (7, "Org1MSP", "grant", "a", "Org2MSP"),
       (8, "Org2MSP", "read", "a", None), (9, "Org3MSP", "exists", "a", None), (10, "Org1MSP", "grant", "b", "Org2MSP")]


def test_fixture_statuses_and_state(spark):
    res = lg.apply_requests(_reqs(spark, FX8))
    got = {r.seq: (r.status, r.message) for r in res.results.collect()}
    assert [got[i][0] for i in range(1, 11)] == ["not_found", "ok", "already_exists", "access_denied", "not_owner",
                                                  "ok", "ok", "ok", "ok", "not_found"]
    assert got[9][1] == "true" and got[3][1] == "asset a already exists"
    assert got[5][1] == "only owner Org1MSP may grant access"
    assert got[4][1] == "access denied for Org2MSP on asset a"
    a = res.assets.collect()
    assert len(a) == 1 and a[0].owner == "Org1MSP" and a[0].access_list == ["Org1MSP", "Org2MSP"]
    assert a[0].data_hash == f"0x{2:064x}"


def test_seed_resets_segment(spark):
    rows = [(1, "Org2MSP", "create", "asset1", None), (2, "Org2MSP", "grant", "asset1", "Org3MSP"),
            (4, "Org3MSP", "read", "asset1", None), (5, "Org2MSP", "create", "asset1", None),
            (6, "Org3MSP", "read", "asset1", None), (7, "Org2MSP", "grant", "asset1", "Org3MSP")]
    reqs = _reqs(spark, rows).unionByName(lg.init_assets(spark, seq=3, ts=TS))
    res = lg.apply_requests(reqs)
    got = {r.seq: r.status for r in res.results.collect()}
    assert got == {1: "ok", 2: "ok", 3: "ok", 4: "access_denied", 5: "already_exists", 6: "access_denied",
                   7: "not_owner"}
    a = res.assets.first()
    assert a.owner == "Org1MSP" and a.access_list == ["Org1MSP"] and a.data_hash == lg.ZERO_HASH


def _written(spark, state):
    """The state as a table of its own, as every epoch of the stream leaves it."""
    return spark.createDataFrame(state.collect(), LEDGER_STATE)


def test_state_carry_equals_single_batch(spark):
    reqs = _reqs(spark, FX8)
    whole = {r.seq: (r.status, r.message) for r in lg.apply_requests(reqs).results.collect()}
    for cut in range(0, 11, 2):
        first = lg.apply_requests(reqs.where(F.col("seq") <= cut))
        second = lg.apply_requests(reqs.where(F.col("seq") > cut), state=_written(spark, first.state))
        parts = {r.seq: (r.status, r.message) for r in first.results.unionByName(second.results).collect()}
        assert parts == whole, cut
    late = lg.apply_requests(reqs.where(F.col("seq") <= 3),
                             state=_written(spark, lg.apply_requests(reqs.where(F.col("seq") > 3)).state))
    assert {r.status for r in late.results.collect()} == {"late"}


def test_json_roundtrip_and_lookups(spark):
    res = lg.apply_requests(_reqs(spark, FX8))
    js = lg.assets_to_json(res.assets)
    doc = js.first().json
    assert doc.startswith('{"id":"a","owner":"Org1MSP","dataHash":"0x') and '"accessList":["Org1MSP","Org2MSP"]' in doc
    assert doc.endswith('"timestamp":"2024-01-01T12:00:02Z"}')
    back = lg.assets_from_json(js).first()
    assert back.access_list == ["Org1MSP", "Org2MSP"] and back.owner == "Org1MSP"
    assert back.ts == dt.datetime(2024, 1, 1, 12, 0, 2)
    q = spark.createDataFrame([("a",), ("zz",)], "id string")
    assert {r.id: r.found for r in lg.lookup_asset(q, res.assets).collect()} == {"a": True, "zz": False}
    assert [r.id for r in lg.asset_exists(q, res.assets).collect()] == ["a"]
    assert [r.id for r in lg.asset_exists(q, res.assets, negate=True).collect()] == ["zz"]


def test_repeated_requests_stay_with_and_without_seeds(spark):
    rows = [(1, "Org1MSP", "create", "a", None), (2, "Org1MSP", "read", "a", None), (2, "Org1MSP", "read", "a", None)]
    assert lg.apply_requests(_reqs(spark, rows)).results.count() == 3
    seeded = _reqs(spark, rows).unionByName(lg.init_assets(spark, seq=3, ts=TS))
    assert lg.apply_requests(seeded).results.count() == 4


def test_requests_without_id_or_seq_are_answered(spark):
    rows = [(1, "Org1MSP", "create", "a", None), (2, "Org1MSP", "read", "a", None), (3, "Org1MSP", "read", None, None),
            (4, "Org1MSP", "grant", None, "Org2MSP"), (5, "Org1MSP", "exists", None, None)]
    reqs = _reqs(spark, rows).unionByName(spark.createDataFrame(
        [(None, "Org1MSP", "read", "a", None, None, None, TS), (None, "Org1MSP", "exists", None, None, None, None, TS)], REQUEST))
    want = [(1, "create", "a", "ok", None), (2, "read", "a", "ok", None), (3, "read", None, "not_found", None),
            (4, "grant", None, "not_found", None), (5, "exists", None, "ok", "false"),
            (None, "read", "a", "not_found", None), (None, "exists", None, "ok", "false")]
    for state in (None, spark.createDataFrame([], LEDGER_STATE)):
        got = [(r.seq, r.op, r.id, r.status, r.message if r.op == "exists" else None)
               for r in lg.apply_requests(reqs, state).results.collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_many_seeds_on_one_hot_id(spark, monkeypatch):
    """The as-of lookup over several blocks against a fold in order."""
    monkeypatch.setattr(lg, "SEQ_BLOCK", 16)
    rows = [(s, f"Org{s % 3}MSP", ["init", "read", "grant", "create", "exists"][(s * 7) % 5 if s % 11 else 1], "hot", f"Org{s % 4}MSP")
            for s in range(1, 400)]
    owner, allowed, want = None, set(), {}
    for s, who, op, _, other in rows:
        if op == "init" or (op == "create" and owner is None):
            owner, allowed, want[s] = who, {who}, "ok"
        elif op == "create":
            want[s] = "already_exists"
        elif op == "exists":
            want[s] = "ok"
        elif owner is None:
            want[s] = "not_found"
        elif op == "read":
            want[s] = "ok" if who in allowed else "access_denied"
        else:
            want[s] = "ok" if who == owner else "not_owner"
            allowed |= {other} if who == owner else set()
    res = lg.apply_requests(_reqs(spark, rows))
    assert {r.seq: r.status for r in res.results.collect()} == want
    assert set(res.assets.first().access_list) == allowed


def test_times_are_utc_in_any_zone(spark):
    df = spark.createDataFrame([(0,)], "s long").select(F.timestamp_seconds("s").alias("ts"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Shanghai")
        assert df.select(lg.rfc3339("ts").alias("t")).first().t == "1970-01-01T00:00:00Z"
        doc = spark.createDataFrame([('{"id":"a","timestamp":"1970-01-01T00:00:00Z"}',)], "json string")
        assert lg.assets_from_json(doc).select(F.unix_timestamp("ts").alias("s")).first().s == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
