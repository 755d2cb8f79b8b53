"""Files split inside records: JSON arrays and CSV with quoted newlines."""

import csv
import json
import random
from contextlib import contextmanager

import pytest

from cohortshare.schemas import EXAMPLE
from cohortshare.sources import bio_io, records, spanning


@contextmanager
def splits_of(spark, n_bytes):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(n_bytes))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def _examples(n):
    rnd = random.Random(3)
    bits = ["{", "}", '"', "\\", "[", "]", ",", "\n", "a", "戈", '\\"', "}{", " "]
    return [{"text": "".join(rnd.choice(bits) for _ in range(rnd.choice([0, 3, 40, 900 if i % 50 == 0 else 9]))),
             "entities": [{"start_idx": k, "end_idx": k + 1, "type": "dis"} for k in range(rnd.randint(0, 3))]}
            for i in range(n)]


def _key(rows):
    return sorted((r["text"], [(e["start_idx"], e["end_idx"], e["type"]) for e in r["entities"]]) for r in rows)


@pytest.mark.parametrize("indent,size", [(None, 301), (1, 199)])
def test_json_array_read_by_many_tasks(spark, tmp_path, indent, size):
    want = _examples(110)
    for part in (0, 1):
        (tmp_path / f"{part}.json").write_text(json.dumps(want[part * 90:90 + part * 20], indent=indent,
                                                          ensure_ascii=part == 0), encoding="utf-8")
    (tmp_path / "none.json").write_text("[ ]")
    (tmp_path / "empty.json").write_text("")
    with splits_of(spark, size):
        assert spanning._pieces(spark, str(tmp_path), "}").rdd.getNumPartitions() > 15
        got = [r.asDict(recursive=True) for r in bio_io.read_examples(spark, str(tmp_path)).collect()]
    assert _key(got) == _key(want)


@pytest.mark.parametrize("text", ['[{"text": "a"', '[{"text": "a"}', '[{"text": "a}]', '[{"text": "a"}, 5]',
                                  '[{"text": "a"}, 5, {"text": "b"}]', "5"])
def test_json_that_is_no_array_of_objects_fails(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(Exception, match="JSON"):
        spanning.read_json_array(spark, str(tmp_path), EXAMPLE).collect()


def _csv_rows(n):
    rnd = random.Random(8)
    bits = ['"', ",", "\n", "a", "é", " ", '""', '"\n"', "x"]
    cell = lambda: "v" + "".join(rnd.choice(bits) for _ in range(rnd.choice([0, 2, 6, 120])))
    return [[str(i), cell(), cell()] for i in range(n)]


@pytest.mark.parametrize("size,end", [(97, "\n"), (150, "\r\n")])
def test_csv_with_quoted_newlines_read_by_many_tasks(spark, tmp_path, size, end):
    rows = _csv_rows(90)
    for part in (0, 1):
        with open(tmp_path / f"{part}.csv", "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f, lineterminator=end)
            out.writerows([["k", 'a, "b', "note\n2"]] + rows[part * 70:70 + part * 50])
            f.write(end)
    with splits_of(spark, size):
        assert spanning._pieces(spark, str(tmp_path), "\n").rdd.getNumPartitions() > 15
        df = spanning.read_csv(spark, str(tmp_path))
        assert df.columns == ["k", 'a, "b', "note\n2"]
        got = sorted((list(r) for r in df.collect()), key=lambda r: int(r[0]))
    assert got == rows
    if end == "\n":                               # Spark's reader makes a row of an empty CRLF line
        plain = spark.read.options(header=True, multiLine=True, escape='"').csv(str(tmp_path)).collect()
        assert sorted((list(r) for r in plain), key=lambda r: int(r[0])) == got


def test_csv_quote_inside_an_unquoted_field_is_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,5" nail\n2,"x\ny"\n3,z"\n')
    with splits_of(spark, 9):
        assert sorted(map(tuple, spanning.read_csv(spark, str(tmp_path)).collect())) == [
            ("1", '5" nail'), ("2", "x\ny"), ("3", 'z"')]


def test_csv_header_only_and_open_quote(spark, tmp_path):
    (tmp_path / "h.csv").write_text("patient_id,lab_value\n")
    assert records.read_records(spark, str(tmp_path / "h.csv")).collect() == []
    (tmp_path / "o.csv").write_text('patient_id,lab_value\n1,"2\n')
    with pytest.raises(Exception, match="ends inside a record"):
        records.read_records(spark, str(tmp_path / "o.csv")).collect()


def test_text_is_not_shuffled_whole(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,2\n")
    plan = spanning.read_csv(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in plan.replace("array_sort", "") and plan.count("Aggregate") == 1
