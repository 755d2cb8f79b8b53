"""What the fourth round's findings were about."""

import inspect
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from conftest import SF_SMALL

from cohortshare.functions import islands, passes, span_sets
from cohortshare.functions import tags as tg
from cohortshare.operators import bio, deid, tagger
from cohortshare.plans import bio_queries
from cohortshare.sources import records, spanning


def test_tagger_is_fitted_on_every_sentence(spark):
    n = 20_500                                              # a fit once took 20,000 sentences at most
    sentences = spark.range(n).selectExpr("array('a', if(id % 7 = 0, 'b', 'c')) AS tokens", "array('O', 'B-DIS') AS tags")
    blocks = tagger.packed(sentences).collect()
    assert sum(len(r.labels) for r in blocks) == 2 * n
    loss, _, features = tagger._distributed(tagger.packed(sentences))(tagger.LinearTagger(np.zeros(0, np.int64), np.zeros((0, len(tg.LABELS)))))
    assert abs(loss - np.log(len(tg.LABELS))) < 1e-9 and len(features)
    assert "max_sentences" not in inspect.signature(tagger.train_tagger).parameters


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tags_of_a_pass_are_compared_where_they_are_made(spark):
    tags = bio_queries.doc_tags(spark, SF_SMALL)
    out = bio.prf_from_tags(tags, "gold_tags", "pred_tags", "lenient")
    assert "ArrowEvalPython" not in _plan(out) and _plan(out).count("MapInArrow") == 1
    rows = spark.createDataFrame(tags.collect(), tags.schema)           # the same tags, written out
    assert out.first() == bio.prf_from_tags(rows, "gold_tags", "pred_tags", "lenient").first()
    assert "gold_tags" in tags.columns and tags.where("doc_id = 0").count() == 1


def test_a_pass_holds_a_portion_of_tags(monkeypatch):
    monkeypatch.setattr(islands, "TOKENS", 100)
    monkeypatch.setattr(islands.portions, "__defaults__", (100,))
    made = {}
    monkeypatch.setattr(islands, "made", lambda schema, make: made.setdefault("make", make))
    source = SimpleNamespace(schema=SimpleNamespace(fields=[]), select=lambda *names: None)
    islands.tagged_texts(source, "text", bio_queries._rule_table(), bio_queries.RULE_TAGS, gold_tags=False, pred_tags=True)
    texts = ["ab é" * 5, None, "", "x" * 250, *(["aZ"] * 300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    parts = list(made["make"](("gold_tags", "doc_id", "pred_tags"))[1](iter([batch.slice(0, 9), batch.slice(9)])))
    assert max(len(p.column(0).values) for p in parts if p.num_rows > 1) <= 100
    assert [i for p in parts for i in p.column(1).to_pylist()] == list(range(len(texts)))
    for at, ahead in ((0, False), (2, True)):
        one = islands.tags_by_first_byte(bio_queries._rule_table(), bio_queries.RULE_TAGS, ahead)(pa.array(texts)).to_pylist()
        assert [t for p in parts for t in passes.plain(p.column(at)).to_pylist()] == one


def test_columns_and_decoding_of_a_pass(spark):
    docs = spark.createDataFrame([(1, "aZ b"), (2, None), (3, ""), (4, "ébu")], "doc_id long, text string")
    tags = islands.tagged_texts(docs, "text", bio_queries._rule_table(), bio_queries.RULE_TAGS, gold=False)
    renamed = passes.columns(tags, key="doc_id", t="gold")
    assert renamed.columns == ["key", "t"] and passes.is_made(renamed)
    got = {r.key: r.t for r in renamed.collect()}
    assert got == {1: ["B-SYM", "I-DIS", "O", "I-DRUG"], 2: None, 3: [], 4: ["O", "I-DRUG", "B-DIS"]}
    coded = pa.ListArray.from_arrays(pa.array([0, 1, None, 3], pa.int32()), pa.array(["a", "b", "a"]).dictionary_encode())
    assert passes.plain(coded).to_pylist() == [["a"], ["b", "a"], None][:1] + coded.to_pylist()[1:]
    assert passes.plain(coded.slice(1)).to_pylist() == coded.slice(1).to_pylist()


def test_spans_are_packed_in_the_pass_that_finds_them(spark, monkeypatch):
    d = bio_queries.doc_tags(spark, SF_SMALL)
    g, p = (bio.sentence_entities(d, "text", c, "strict", keys=("doc_id",)) for c in ("gold_tags", "pred_tags"))
    out = bio.entity_prf(g, p, keys=("doc_id",))
    assert "ArrowEvalPython" not in _plan(out) and _plan(out).count("MapInArrow") == 3      # two sides and their comparison
    rows = (spark.createDataFrame(x.collect(), x.schema) for x in (g, p))
    assert out.first() == bio.entity_prf(*rows, keys=("doc_id",)).first()


def test_packs_of_a_batch_are_opened_in_portions(monkeypatch):
    rows = [(k, s, s + s % 3, "xyz"[s % 3]) for k in range(5) for s in range(0, 9000, 7)]
    packs = []
    for pred, part in ((False, rows), (True, rows[::2])):
        cols = [pa.array([r[i] for r in part]) for i in range(4)]
        packs += span_sets.pack(pred)([pa.RecordBatch.from_arrays(cols, ["k0", "start", "end", "type"])])
    batch = pa.Table.from_batches(packs).sort_by([("k0", "ascending"), ("block", "ascending")]).combine_chunks().to_batches()[0]
    opened, spans = [], span_sets._spans
    monkeypatch.setattr(span_sets, "_spans", lambda x: opened.append(x.num_rows) or spans(x))
    monkeypatch.setattr(span_sets, "BYTES", 9000)
    found = list(span_sets.agreement(1)([batch]))
    assert [sum(b.column(i)[0].as_py() for b in found) for i in range(3)] == [len(rows), len(rows[::2]), len(rows[::2])]
    assert max(opened) < batch.num_rows / 3


def test_predicted_tags_are_scored_in_the_pass_that_makes_them(spark):
    rng = np.random.default_rng(4)
    model = tagger.LinearTagger(np.arange(tagger.FEATURES), rng.normal(size=(tagger.FEATURES, len(tg.LABELS))))
    tags = passes.columns(bio_queries.doc_tags(spark, SF_SMALL), tokens="text", gold_tags="gold_tags")
    both = tagger.predict_tags(model, tags)
    out = bio.prf_from_tags(both, "gold_tags", "pred_tags", "strict")
    assert "ArrowEvalPython" not in _plan(out) and _plan(out).count("MapInArrow") == 1
    rows = spark.createDataFrame(both.collect(), both.schema)
    assert all(len(r.tokens or "") == len(r.pred_tags or []) for r in rows.collect())
    assert out.first() == bio.prf_from_tags(rows, "gold_tags", "pred_tags", "strict").first()


def test_labels_are_the_best_of_sums_in_the_order_of_places():
    rng = np.random.default_rng(6)
    weights = rng.normal(size=(tagger.FEATURES, len(tg.LABELS)))
    weights[:, 3] = weights[:, 1]                            # of equals the first
    codes = rng.integers(32, 40, tagger.CHUNK + 77)
    edges = np.array([0, 0, 1, 3, 3, 70_000 - tagger.CHUNK, tagger.CHUNK - 1, len(codes)])
    score = sum(weights[f] for f in tagger.window_features(codes, edges).T)
    assert (tagger.label_ids(weights, codes, edges) == score.argmax(axis=1)).all()
    assert len(tagger.label_ids(weights, codes[:0], np.array([0]))) == 0


def test_csv_splits_of_whole_lines_do_not_go_through_python_again(spark, tmp_path, monkeypatch):
    (tmp_path / "plain").mkdir()
    for i in range(3):
        rows = "".join(f'{i}-{k},"a, ""{k}""",5" nail\r\n\n' for k in range(200))
        (tmp_path / "plain" / f"{i}.csv").write_text("k,v,w\n" + rows, newline="")
    monkeypatch.setattr(spanning, "_csv_parts", lambda walk, sep: _refuse)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (old, "700"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = sorted(map(tuple, spanning.read_csv(spark, str(tmp_path / "plain")).collect()))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert got == sorted((f"{i}-{k}", f'a, "{k}"', '5" nail') for i in range(3) for k in range(200))


def _refuse(batches):
    for b in batches:
        raise AssertionError(f"{b.num_rows} lines of a plain split")
    yield from ()


def test_csv_with_plain_and_other_splits_equals_the_one_task_reader(spark, tmp_path):
    lines = [f'{k},"line {k}\nnext",x' if k % 97 == 0 else "k,v,w" if k % 150 == 7 else f'{k},"a, b",y"{k}' for k in range(700)]
    (tmp_path / "a.csv").write_text("k,v,w\n" + "\n".join(lines) + "\n")              # its header comes again as a record
    (tmp_path / "b.csv").write_text("k,v,w\n" + "".join(f"b{k},,\n" for k in range(90)))
    (tmp_path / "c.csv").write_text("k,v,w\nk,v,w\n")
    (tmp_path / "d.csv").write_text("k,v,w")
    want = sorted(map(str, spark.read.options(header=True, multiLine=True, escape='"').csv(str(tmp_path)).collect()))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (old, "333"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            assert sorted(map(str, spanning.read_csv(spark, str(tmp_path)).collect())) == want
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(want) == 700 + 90 + 1


def test_deidentified_rows_are_computed_once(spark, tmp_path):
    rows = [(f"p{i}", None if i % 9 == 0 else float(i % 30), [" A , F", None, "NA", ","][i % 4], "2024-01-15", None if i % 5 == 0 else float(i)) for i in range(400)]
    names = ["patient_id", "age_months", "location", "diagnosis_date", "lab_value"]
    records.write_records(spark.createDataFrame(rows, names), str(tmp_path / "in"))
    res = deid.deidentify(records.read_records(spark, str(tmp_path / "in")), key="patient_id", salt="s", k=2)
    plan = res.data._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0]
    assert plan.count("md5(") == 1 and not any("RLIKE" in x for x in plan.splitlines() if "Filter" in x.split("(")[0])
    assert res.data.columns == ["age_months_gen", "location", "diagnosis_date", "patient_id", "age_months", "lab_value"]
    got, report = {r.patient_id: r for r in res.data.collect()}, res.report.first()
    assert report.records_out == len(got) and {r.location for r in got.values()} == {"A", "*", ""}
    for p, age, _, _, lab in rows:
        assert p not in got or (got[p].age_months == age and (got[p].lab_value is None) == (lab is None))
    res.release()
