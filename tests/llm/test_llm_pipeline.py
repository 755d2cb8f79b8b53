"""The pipeline, stage by stage, against plain Python versions."""

import random

import corpus_brute as brute
import corpus_pipeline
import pytest
from test_llm_queries import awkward, expected_pieces, ordered, pairs, sequences

from cohortshare.llm import string_kernel
from cohortshare.llm.common import stored

SF = "/root/testdata/sf0.001"
ODD = ("doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string, spans string, "
       "node string, fp string, label string, sha string, length string, `row` string")


def near_kept(docs):
    size, percent = corpus_pipeline.SHINGLE_WORDS, corpus_pipeline.SIMILARITY_PERCENT
    return len({c if n else i for i, (_, n, c) in enumerate(brute.components(docs, size, percent))})


@pytest.mark.parametrize("which", ["table", "odd"])
def test_stages(spark, which):
    docs = spark.read.parquet(f"{SF}/documents.parquet") if which == "table" else spark.createDataFrame(awkward(), ODD)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, SF), f"test-{name}")
        was = pairs(before)
        if name == "packing":
            rows = docs.collect()
            assert ordered(r[:5] for r in rows) == ordered(expected_pieces(was))
            sequences(rows, 2048)
            break
        assert docs.columns == columns and docs.dtypes == before.dtypes
        now = pairs(docs)
        if name == "language_id":
            model = string_kernel.train(before, ~string_kernel.held_out_fold())
            langs, scores = string_kernel.predict(model, [(t or "").encode() for _, t in was])
            want = [x for x, lang, s in zip(was, langs, scores) if lang != "und" and s >= corpus_pipeline.MIN_LANGUAGE_SCORE]
            assert ordered(now) == ordered(want)
            assert which == "odd" or len(want) == len(was)
        elif name == "exact_dedup":
            best = {}
            for d, t in was:
                key = brute.low(t)
                best[key] = max(best.get(key, -1), -1 if d is None else d)
            assert ordered((brute.low(t), -1 if d is None else d) for d, t in now) == ordered(best.items())
        elif name == "near_dedup":
            assert len(now) == near_kept(was) and set(now) <= set(was)
            assert near_kept(now) == len(now)
        elif name == "personal_data":
            assert len(now) == len(was)
            assert not any(any(x[1:5]) for x in brute.personal(now))
            spared = {d: t for d, t in now}
            assert all(spared[d] == t for (d, t), x in zip(was, brute.personal(was)) if not any(x[1:5]))


@pytest.mark.parametrize("unlearnt", ["de", "en", "es", "fr"])
def test_unlearnt_languages_and_noise_go(spark, unlearnt):
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").collect() if r.text]
    known = [(r.doc_id, r.text, r.lang) for r in rows if r.lang != unlearnt]
    strange = [(100_000 + r.doc_id, r.text, None) for r in rows if r.lang == unlearnt]
    rng = random.Random(5)
    noise = ["x", "Αυτό είναι ένα κείμενο στα ελληνικά", "これは日本語のテキストです"]
    noise += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)) for n in (300, 3000, 30000)]
    long = [(300_000 + i, " ".join(t for _, t, lang in known if lang == name)[:200_000], None)
            for i, name in enumerate(sorted({lang for _, _, lang in known}))]
    docs = spark.createDataFrame(known + strange + long + [(200_000 + i, t, None) for i, t in enumerate(noise)],
                                 "doc_id long, text string, lang string")
    stay = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, SF).collect()}
    assert sum(d in stay for d, _, _ in strange) <= 0.15 * len(strange) and not any(200_000 <= d < 300_000 for d in stay)
    assert all(d in stay for d, _, _ in long)
    assert sum(d in stay for d, _, _ in known) >= 0.99 * len(known)


def test_run_and_empty(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 0
    empty = spark.createDataFrame([], ODD)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, SF)
        assert out.count() == 0
        if name != "packing":
            assert out.columns == empty.columns
