"""What the third round's findings were about."""

import random
from hashlib import md5

import pyarrow as pa
from pyspark.sql import functions as F

from cohortshare.functions import term_blocks
from cohortshare.operators import bio, deid, mlm
from cohortshare.sources import records, spanning


def test_csv_records_are_parsed_once(spark, tmp_path):
    rows = [(f"p{i}", float(i % 30), "A, F", "2024-01-15", float(i)) for i in range(40)]
    names = ["patient_id", "age_months", "location", "diagnosis_date", "lab_value"]
    records.write_records(spark.createDataFrame(rows, names), str(tmp_path / "in"))
    res = deid.deidentify(records.read_records(spark, str(tmp_path / "in")), key="patient_id", salt="s")
    plan = res.data._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0]
    assert plan.count("from_csv") == 1
    assert res.data.count() == 40
    res.release()


def test_csv_lines_of_a_batch_end_as_walked_one_by_one():
    rnd, walk = random.Random(4), spanning.csv_walk()
    for _ in range(300):
        lines = ["".join(rnd.choice(['"', ",", "a", "é", '""', '","']) for _ in range(rnd.randint(0, 7))) for _ in range(rnd.randint(1, 12))]
        ends = spanning._line_ends(pa.array(["x", *lines]).slice(1), walk, ",")
        for start in (False, True):
            want, quoted = [], start
            for line in lines:
                quoted = walk(line)[quoted][0]
                want.append(quoted)
            assert ends(start).tolist() == want, (lines, start)


def test_islands_are_found_without_lambdas_over_tokens(spark):
    rows = [(1, list("abcdé"), ["B-X", "I-X", "I-Y", "O", "B-"]), (2, [], []), (3, None, None), (4, ["p", None, "q"], ["I-X", "I-X", None]),
            (5, ["a"], ["B-X", "I-X", "B-Y"]), (6, ["a", "b"], ["B-X", "I-X"])]
    df = spark.createDataFrame(rows, "k int, tok array<string>, tag array<string>")
    got = bio.sentence_entities(df, "tok", "tag", "lenient", keys=("k",), joiner="-")
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(1, 0, 1, "X", "a-b"), (1, 2, 2, "Y", "c"), (1, 4, 4, "", "é"), (4, 0, 1, "X", "p"),
                                                 (5, 0, 1, "X", "a"), (5, 2, 2, "Y", ""), (6, 0, 1, "X", "a-b")]
    strict = bio.sentence_entities(df, "tok", "tag", "strict", keys=("k",))
    assert sorted((r.k, r.start) for r in strict.collect()) == [(1, 0), (1, 4), (5, 0), (5, 2), (6, 0)]
    both = df.select("k", F.col("tag").alias("gold_tags"), F.reverse("tag").alias("pred_tags"))
    prf = bio.prf_from_tags(both, mode="lenient")
    assert "lambda" not in prf._jdf.queryExecution().optimizedPlan().toString()
    want = bio.entity_prf(got, bio.sentence_entities(both.join(df, "k"), "tok", "pred_tags", "lenient", keys=("k",)), keys=("k",))
    assert prf.collect() == want.collect()


def test_best_names_by_matrix_products_equal_all_pairs():
    def lev(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    def score(t, n):
        cos = sum(t.count(c) * n.count(c) for c in set(t)) / (
            sum(t.count(c) ** 2 for c in set(t)) ** 0.5 * sum(n.count(c) ** 2 for c in set(n)) ** 0.5)
        return 0.4 * (1.0 - lev(t, n) / max(len(t), len(n))) + 0.6 * cos if cos else 0.0

    rnd = random.Random(2)
    names = list(dict.fromkeys("".join(rnd.choices("abcdé", k=rnd.choice([1, 3, 5, 64]))) for _ in range(120)))
    terms = ["", "zz", *("".join(rnd.choices("abcdéx", k=rnd.randint(1, 9))) for _ in range(80)), "ab" * 40]
    at, top = term_blocks.best_of_block(term_blocks.Names([(n, n) for n in names]), terms, 0.4, 0.6)
    for t, v, s in zip(terms, at, top):
        scores = [score(t, n) if t else 0.0 for n in names]
        assert abs(s - max(scores)) < 1e-12
        assert (v == -1) if max(scores) == 0 else abs(scores[v] - max(scores)) < 1e-12


def test_masked_lm_draws_without_lambdas_over_tokens(spark):
    docs = spark.createDataFrame([(1, "ab é\ncd" * 200), (2, ""), (3, None)], "doc_id long, text string")
    rows = mlm.mlm_examples(docs, salt="k", probability=0.5)
    assert "lambda" not in rows._jdf.queryExecution().optimizedPlan().toString()
    for r in rows.collect():
        draws = md5(f"k|{r.doc_id}|{r.block}|{r.pos}".encode()).digest()
        select, kind, other = (int.from_bytes(draws[i:i + 4], "big") for i in (0, 4, 8))
        assert (select + 0.5) / 2**32 < 0.5
        kind = (kind + 0.5) / 2**32
        assert r.input == ("[MASK]" if kind < 0.8 else sorted("abcdé")[other % 5] if kind < 0.9 else r.label)
