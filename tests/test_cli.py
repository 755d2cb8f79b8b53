from cohortshare import cli
from cohortshare.operators.ledger import init_assets
from cohortshare.sources import requests

from test_bio import BIO_TEXT
from test_jobs_learn import CSV


def test_cli_jobs(spark, tmp_path, capsys):
    src = tmp_path / "in.csv"
    src.write_text(CSV, encoding="utf-8")
    assert cli.main(["map-terms", "--term", "戈谢氏病"]) == 0
    assert "code ORPHA:355, score 0.82, needs_manual_review" in capsys.readouterr().out
    assert cli.main(["impute", "--input", str(src), "--output", str(tmp_path / "imp"), "--estimator", "ols"]) == 0
    assert cli.main(["deidentify", "--input", str(tmp_path / "imp"), "--output", str(tmp_path / "d"),
                     "--key", "patient_id", "--salt", "s"]) == 0
    out = capsys.readouterr().out
    assert "3 missing cells filled" in out and "kept 6 of 6 records" in out
    assert cli.main(["map-terms", "--input", str(src), "--output", str(tmp_path / "m")]) == 0
    bio = tmp_path / "t.bio"
    bio.write_text(BIO_TEXT.removeprefix("sO\n"), encoding="utf-8")
    assert cli.main(["train-tagger", "--train", str(bio), "--output", str(tmp_path / "model"), "--max-iter", "5"]) == 0
    assert cli.main(["tag", "--model", str(tmp_path / "model"), "--input", str(src),
                     "--output", str(tmp_path / "ents")]) == 0
    requests.write_requests(init_assets(spark), str(tmp_path / "req"))
    assert cli.main(["ledger", "--input", str(tmp_path / "req"), "--output", str(tmp_path / "led")]) == 0
    assert spark.read.parquet(str(tmp_path / "led" / "assets")).first().owner == "Org1MSP"


def test_cli_mlm(spark, tmp_path):
    (tmp_path / "c.txt").write_text("第一行文本\n\n" + "长" * 600 + "\n", encoding="utf-8")
    assert cli.main(["mlm", "--corpus", str(tmp_path / "c.txt"), "--output", str(tmp_path / "o"), "--salt", "x"]) == 0
    assert cli.main(["mlm", "--corpus", str(tmp_path / "c.txt"), "--output", str(tmp_path / "d"), "--dense"]) == 0
    dense = spark.read.parquet(str(tmp_path / "d")).collect()
    assert sorted(len(r.input_tokens) for r in dense) == [7, 92, 512]
