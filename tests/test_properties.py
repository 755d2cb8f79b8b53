"""Property tests named in the design: idempotence, round trips, equal forms."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortshare.functions import tags as tg
from cohortshare.operators import bio, deid


def test_k_anonymity_idempotent_and_bounded(spark):
    rnd = random.Random(9)
    rows = [(f"p{i}", float(rnd.randint(0, 60)), rnd.choice(["A, x", "B, y", "C"]), rnd.choice(["2020-01-02", "2020-02"]))
            for i in range(600)]
    df = spark.createDataFrame(rows, "patient_id string, age_months double, location string, diagnosis_date string")
    g = deid.apply_generalisation(df)
    once = deid.enforce_k_anonymity(g, k=5)
    twice = deid.enforce_k_anonymity(once, k=5)
    assert sorted(r.patient_id for r in once.collect()) == sorted(r.patient_id for r in twice.collect())
    sizes = deid.equivalence_classes(once).collect()
    assert sizes and all(r.class_size >= 5 for r in sizes)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(1, 3), st.sampled_from(["dis", "sym"])), max_size=4),
       st.integers(0, 14))
def test_spans_roundtrip_when_disjoint(spark, spans, n_extra):
    text, ents, pos = "", [], 0
    for gap, ln, t in spans:
        pos += gap
        ents.append((pos, pos + ln - 1, t))
        pos += ln
    text = "x" * (pos + n_extra)
    df = spark.createDataFrame([(0, text, ents)], "sent_id long, text string, "
                               "entities array<struct<start_idx:int,end_idx:int,type:string>>")
    conv = bio.convert_examples(df, keep_whitespace=True, type_map=tg.SHORT_TYPE_MAP)
    sent = conv.select("sent_id", F.transform("pairs", lambda p: p["ch"]).alias("tokens"),
                       F.transform("pairs", lambda p: p["tag"]).alias("tags"))
    got = sorted((r.start, r.end, r.type) for r in bio.sentence_entities(sent, mode="strict").collect())
    assert got == sorted((s, e, tg.SHORT_TYPE_MAP[t]) for s, e, t in ents)


def test_window_form_equals_array_form(spark):
    rnd = random.Random(13)
    labels = ["O", "B-DIS", "I-DIS", "B-SYM", "I-SYM"]
    rows = []
    for i in range(300):
        n = rnd.randint(0, 10)
        rows.append((i, [rnd.choice("abc") for _ in range(n)], [rnd.choice(labels) for _ in range(n)]))
    df = spark.createDataFrame(rows, "sent_id long, tokens array<string>, tags array<string>")
    for mode in ("strict", "lenient"):
        a = {tuple(r) for r in bio.sentence_entities(df, mode=mode).collect()}
        b = {tuple(r) for r in bio.decode_bio_rows(bio.token_rows(df), mode=mode).collect()}
        assert a == b, mode
