import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortshare.operators import bio, mlm, tagger
from cohortshare.plans import jobs
from cohortshare.sources import bio_io, records, requests
from cohortshare.functions import tags as tg
from cohortshare.operators.ledger import init_assets

from conftest import SF_SMALL

CSV = ('patient_id,age_months,location,diagnosis_date,disease_name_raw,lab_value,clinical_note\n'
       'P1,36,"Nanjing, Jiangsu",2021-03-14,戈谢病,12.5,"note with ""quotes"", comma\nand a newline"\n'
       'P2,NA,"Nanjing, Jiangsu",2021-03-15,N/A,NaN,plain\n'
       'P3,38,"Nanjing, Jiangsu",2021-03-16,戈谢氏病,11.8,\n'
       'P4,39,"Nanjing, Jiangsu",2021-03-17,病,,x\n'
       'P5,40,"Nanjing, Jiangsu",2021-03-18,abc,12.9,y\n'
       'P6,37,"Nanjing, Jiangsu",2021-03-19,abc,13.0,z\n')


def test_record_io_and_jobs(spark, tmp_path):
    src = tmp_path / "in.csv"
    src.write_text(CSV, encoding="utf-8")
    df = records.read_records(spark, str(src))
    rows = {r.patient_id: r for r in df.collect()}
    assert rows["P1"].clinical_note == 'note with "quotes", comma\nand a newline'
    assert rows["P2"].age_months is None and rows["P2"].lab_value is None and rows["P2"].disease_name_raw is None
    assert rows["P4"].lab_value is None and rows["P3"].clinical_note is None
    n = jobs.impute_job(spark, str(src), str(tmp_path / "imp"), estimator="ols")
    assert n == 3
    imp = records.read_records(spark, str(tmp_path / "imp"))
    assert imp.where(F.col("age_months").isNull() | F.col("lab_value").isNull()).count() == 0
    rep = jobs.deidentify_job(spark, str(tmp_path / "imp"), str(tmp_path / "deid"), key="patient_id", salt="s")
    assert rep["records_in"] == 6 and rep["records_out"] == 6 and rep["reid_risk"] == round(100 / 6, 4)
    out = records.read_records(spark, str(tmp_path / "deid"))
    assert {r.location for r in out.collect()} == {"Nanjing"}


def test_convert_job(spark, tmp_path):
    src = tmp_path / "ex.json"
    src.write_text(json.dumps([{"text": "old gout", "entities": [{"start_idx": 4, "end_idx": 7, "type": "dis"}]},
                               {"text": "Oslo"}]), encoding="utf-8")
    n = jobs.convert_job(spark, str(src), str(tmp_path / "bio"), type_map=tg.SHORT_TYPE_MAP)
    assert n == 2
    back = bio_io.read_bio(spark, str(tmp_path / "bio"), mode="failfast").collect()
    assert sorted("".join(r.tags) for r in back) == ["OOO" "B-DISI-DISI-DISI-DIS", "OOOO"]


def test_relational_span_form_equals_array_form(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(200):
        n = rnd.randint(0, 10)
        text = "".join(rnd.choice("ab c") for _ in range(n))
        ents = [(rnd.randint(-1, n), rnd.randint(-1, n), rnd.choice(["dis", "sym", "x"])) for _ in range(rnd.randint(0, 4))]
        rows.append((i, text, ents))
    df = spark.createDataFrame(rows, "ex_id long, text string, entities array<struct<start_idx:int,end_idx:int,type:string>>")
    arr = {(r.ex_id, i): p.tag for r in bio.convert_examples(df, keep_whitespace=True).collect()
           for i, p in enumerate(r.pairs)}
    rel = {(r.ex_id, r.pos): r.tag for r in bio.spans_to_bio_rows(df).collect()}
    assert arr == rel


def test_mlm_rows(spark):
    docs = spark.read.parquet(os.path.join(SF_SMALL, "documents.parquet")).select("doc_id", "text")
    a = mlm.mlm_examples(docs, salt="k")
    rows = a.collect()
    toks = mlm.corpus_tokens(docs).count()
    assert abs(len(rows) / toks - 0.15) < 0.01
    kinds = [("mask" if r.input == "[MASK]" else "keep" if r.input == r.label else "rand") for r in rows]
    assert abs(kinds.count("mask") / len(rows) - 0.8) < 0.02
    assert all(1 <= r.pos <= 510 for r in rows)
    b = mlm.mlm_examples(docs.repartition(5), salt="k").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, b))     # partitioning does not change draws
    blocks = mlm.mlm_blocks(docs.limit(20), salt="k").collect()
    assert all(len(r.input_tokens) == len(r.labels) <= 512 for r in blocks)


def test_tagger_learns_rule(spark):
    rnd = random.Random(4)
    sents = []
    for i in range(200):
        toks = [rnd.choice("abxyz") for _ in range(rnd.randint(1, 12))]
        tags = ["B-DIS" if t == "a" else "I-DIS" if t == "b" else "O" for t in toks]
        sents.append((i, toks, tags))
    df = spark.createDataFrame(sents, "sent_id long, tokens array<string>, tags array<string>")
    model = tagger.train_tagger(df, max_iter=30)
    both = tagger.predict_tags(model, df.withColumnRenamed("tags", "gold_tags"))
    r = bio.prf_from_tags(both, "gold_tags", "pred_tags", "strict").first()
    assert r.f1 > 0.95
    notes = spark.createDataFrame([("n1", "xaby"), ("n2", "")], "patient_id string, clinical_note string")
    ents = tagger.tag_notes(model, notes).collect()
    assert [(e.patient_id, e.start, e.end, e.text) for e in ents] == [("n1", 1, 2, "ab")]


def _random_sentences(n, seed=4):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        toks = [rnd.choice(["a", "b", "x", "é", "\U0001F600", "long token"]) for _ in range(rnd.randint(0, 12))]
        tags = ["B-DIS" if t == "a" else "I-DIS" if t == "b" and rnd.random() < 0.8 else "O" for t in toks]
        out.append((i, toks, tags))
    return out


def test_distributed_fit_equals_a_plain_fit(spark):
    sents = _random_sentences(150)
    df = spark.createDataFrame(sents, "sent_id long, tokens array<string>, tags array<string>").repartition(5)
    model = tagger.train_tagger(df, max_iter=12)
    feats, labels = [], []
    for _, toks, tags in sents:
        codes = [tagger._PAD] * 2 + [tagger.token_code(t) for t in toks] + [tagger._PAD] * 2
        for i, tag in enumerate(tags):
            feats.append([(codes[i + s] * 5 + s) * 2654435761 % tagger.FEATURES for s in range(5)])
            labels.append(tg.LABELS.index(tag))
    feats, labels = np.array(feats), np.array(labels)
    numbers = np.unique(feats)

    def plain(m):
        w, grad, loss = m.matrix(), np.zeros((tagger.FEATURES, len(tg.LABELS))), 0.0
        for f, y in zip(feats, labels):
            s = sum(w[k] for k in f)
            p = np.exp(s - s.max())
            p /= p.sum()
            loss -= np.log(p[y])
            p[y] -= 1
            for k in f:
                grad[k] += p
        return loss / len(labels), grad[numbers] / len(labels), numbers
    alone = tagger.minimise(plain, 12, 1e-6)
    assert (model.features == alone.features).all() and np.abs(model.weights - alone.weights).max() < 1e-6
    assert np.abs(model.weights).max() > 0.5


def test_tagging_makes_no_shuffle_and_keeps_edges(spark, tmp_path):
    rng = np.random.default_rng(1)
    model = tagger.LinearTagger(np.arange(tagger.FEATURES), rng.normal(size=(tagger.FEATURES, len(tg.LABELS))))
    rnd = random.Random(3)
    texts = [None, "", "a", "ab", "é\U0001F600x", "".join(rnd.choice("abc 病") for _ in range(tagger.CHUNK + 1000))]
    notes = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "patient_id int, clinical_note string")
    ents = tagger.tag_notes(model, notes)
    assert "Exchange" not in ents._jdf.queryExecution().executedPlan().toString()
    w, want = model.matrix(), []
    for i, t in enumerate(texts):
        codes = [tagger._PAD] * 2 + [ord(c) for c in t or ""] + [tagger._PAD] * 2
        tags = [tg.LABELS[int(np.argmax(sum(w[(codes[p + s] * 5 + s) * 2654435761 % tagger.FEATURES] for s in range(5))))] for p in range(len(codes) - 4)]
        at = 0
        while at < len(tags):
            end = at + 1
            if tags[at].startswith("B-"):
                while end < len(tags) and tags[end] == "I-" + tags[at][2:]:
                    end += 1
                want.append((i, at, end - 1, tags[at][2:], t[at:end]))
            at = end
    assert sorted(map(tuple, ents.collect())) == sorted(want)
    model.save(spark, str(tmp_path / "m"))
    again = tagger.LinearTagger.load(spark, str(tmp_path / "m"))
    assert (again.matrix() == w).all()
    none = tagger.train_tagger(spark.createDataFrame([], "tokens array<string>, tags array<string>"))
    assert tagger.tag_notes(none, notes).count() == 0


def test_fit_is_bounded_by_its_parameter(spark):
    df = spark.createDataFrame(_random_sentences(80), "sent_id long, tokens array<string>, tags array<string>")
    n = sum(len(r.labels) for r in tagger.packed(df, 10).collect())
    assert 0 < n < sum(len(r.labels) for r in tagger.packed(df).collect())


def test_sources_corpus_requests(spark, tmp_path):
    (tmp_path / "c.txt").write_text("line one\n\nline three\n", encoding="utf-8")
    assert [r.text for r in bio_io.read_corpus(spark, str(tmp_path / "c.txt")).collect()] == ["line one", "", "line three"]
    requests.write_requests(init_assets(spark), str(tmp_path / "req"))
    got = requests.read_requests(spark, str(tmp_path / "req")).collect()
    assert got[0].id == "asset1" and got[0].op == "init"


def test_user_model_plug(spark):
    def _rule_model():   # nested, so it is shipped to the workers by value
        def predict(batch):
            return [["B-DIS" if c == "a" else "I-DIS" if c == "b" else "O" for c in toks] for toks in batch]
        return predict
    notes = spark.createDataFrame([("n1", "xabby"), ("n2", "ba"), ("n3", "")], "patient_id string, clinical_note string")
    ents = tagger.tag_notes_with_model(notes, _rule_model, "rule-1").collect()
    assert sorted((e.patient_id, e.start, e.end, e.text) for e in ents) == [("n1", 1, 3, "abb"), ("n2", 1, 1, "a")]


def test_access_list_functions(spark):
    from cohortshare.operators import ledger as lg
    df = spark.createDataFrame([(["Org1MSP"], "Org2MSP", "Org1MSP")], "l array<string>, g string, o string")
    r = df.select(lg.add_grantee("l", "g").alias("a"), lg.add_grantee("l", "o").alias("b"),
                  lg.has_access("l", "o").alias("c"), lg.has_access("l", "g").alias("d"),
                  lg.is_owner("o", "o").alias("e")).first()
    assert r.a == ["Org1MSP", "Org2MSP"] and r.b == ["Org1MSP"] and r.c and not r.d and r.e


def test_mlm_corpus_fixture(spark):
    corpus = spark.createDataFrame([(1, ""), (2, "ab " * 700), (3, "短句")], "doc_id long, text string")
    toks = mlm.corpus_tokens(corpus).collect()
    per = {}
    for t in toks:
        per.setdefault(t.doc_id, []).append((t.block, t.pos))
    assert 1 not in per                                   # empty text: no tokens
    assert len(per[2]) == 1400 and max(b for b, _ in per[2]) == 2   # whole text kept, 510-token blocks
    assert all(1 <= p <= 510 for _, p in per[2])
    assert sorted(per[3]) == [(0, 1), (0, 2)]
    rows = mlm.mlm_examples(corpus, salt="z").collect()
    assert all(r.doc_id in (2, 3) for r in rows)


def test_user_model_is_loaded_once(monkeypatch):
    calls = []
    monkeypatch.setattr(tagger, "_LOADED", {})
    load = lambda: calls.append(1) or (lambda batch: batch)
    assert tagger.loaded("m", load) is tagger.loaded("m", load) and len(calls) == 1
    tagger.loaded("n", load)
    assert len(calls) == 2


def test_unknown_training_tag_stops(spark):
    df = spark.createDataFrame([(1, ["a"], ["B-NEW"])], "sent_id long, tokens array<string>, tags array<string>")
    with pytest.raises(Exception):
        tagger.train_tagger(df)


def test_unreadable_numbers_are_not_missing(spark, tmp_path):
    src = tmp_path / "n.csv"
    src.write_text("patient_id,age_months,lab_value\nA,36 months,1\nB,NA,2\nC,30,x\n", encoding="utf-8")
    with pytest.raises(Exception, match="not a number: (age_months=36 months|lab_value=x)"):
        records.read_records(spark, str(src)).collect()
    rows = {r.patient_id: r for r in records.read_records(spark, str(src), bad="report").collect()}
    assert rows["A"].bad_cells == ["age_months=36 months"] and rows["C"].bad_cells == ["lab_value=x"]
    assert rows["B"].bad_cells == [] and rows["B"].age_months is None


def test_read_records_odd_headers(spark, tmp_path):
    src = tmp_path / "odd.csv"
    src.write_text("patient_id,lab.value,age months\nP1,NA,3\nP2,1.5,N/A\n", encoding="utf-8")
    rows = {r["patient_id"]: r for r in records.read_records(spark, str(src), numeric={"lab.value"}).collect()}
    assert rows["P1"]["lab.value"] is None and rows["P2"]["lab.value"] == 1.5
    assert rows["P2"]["age months"] is None and rows["P1"]["age months"] == "3"


def test_governance_run_returns_all_three_results(spark):
    from cohortshare.plans.learn_queries import q_governance_run
    rows = q_governance_run(spark, "/root/testdata/sf0.001").collect()
    assert rows and {"score", "status", "match_type", "entities", "report"} <= set(rows[0].asDict())
    assert all(r.status for r in rows) and any(r.entities for r in rows)
    assert {r.report.records_out for r in rows} == {len(rows)} and len({r.patient_id for r in rows}) == len(rows)
    assert all(e.text and len(e.text) == e.end - e.start + 1 for r in rows for e in r.entities)


def test_mlm_dense_equals_sparse_without_shuffle(spark):
    text = "ab  cd　e\n" * 30 + "𝒳é"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, " \n"), (5, "x")], "doc_id long, text string")
    rows = mlm.mlm_blocks(docs, salt="q", max_len=12)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    sparse = {(r.doc_id, r.block, r.pos): r for r in mlm.mlm_examples(docs, salt="q", max_len=12).collect()}
    texts = {1: "", 5: ""}
    for r in sorted(rows.collect()):
        assert r.input_tokens[0] == "[CLS]" and r.input_tokens[-1] == "[SEP]" and len(r.labels) <= 12
        for pos, (token, label) in enumerate(zip(r.input_tokens, r.labels)):
            got = sparse.pop((r.doc_id, r.block, pos), None)
            assert (got is None) == (label is None) and (got is None or (got.label, got.input) == (label, token))
        texts[r.doc_id] += "".join(b or a for a, b in zip(r.input_tokens[1:-1], r.labels[1:-1]))
    assert not sparse and texts == {1: "".join(text.split()), 5: "x"}
