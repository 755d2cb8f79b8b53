import random

import pytest
from pyspark.sql import functions as F

from cohortshare.operators import terms as tm
from cohortshare.sources.vocab import default_vocab, read_vocab, write_vocab


def _map(spark, words, **kw):
    df = spark.createDataFrame([(w,) for w in words], "term string")
    return {r.term: r for r in tm.map_terms(df, default_vocab(spark), **kw).collect()}


def test_fixture_scores(spark):
    words = ["杜氏肌营养不良", "戈谢病", "杜氏肌营养不良症", "戈谢氏病", "法布雷", "病", "完全不相关的词语内容", "abc", ""]
    m = _map(spark, words)
    exp = {"杜氏肌营养不良": ("ORPHA:98896", 1.0, "matched", "exact"),
           "戈谢病": ("ORPHA:355", 1.0, "matched", "exact"),
           "杜氏肌营养不良症": ("ORPHA:98896", 0.911, "matched", "approximate"),
           "戈谢氏病": ("ORPHA:355", 0.82, "needs_manual_review", "approximate"),
           "法布雷": ("ORPHA:324", 0.82, "needs_manual_review", "approximate"),
           "病": ("ORPHA:365", 0.48, "needs_manual_review", "approximate"),
           "完全不相关的词语内容": ("ORPHA:98896", 0.072, "needs_manual_review", "approximate"),
           "abc": (None, 0.0, "needs_manual_review", None),
           "": (None, 0.0, "needs_manual_review", None)}
    for w, e in exp.items():
        r = m[w]
        assert (r.code, r.score, r.status, r.match_type) == e, (w, r)


def test_mapper_contract_with_file_vocab(spark, tmp_path):
    path = str(tmp_path / "vocab")
    write_vocab(default_vocab(spark), path)
    vocab = read_vocab(spark, path)
    df = spark.createDataFrame([("戈谢病",), ("戈谢氏病",), ("完全不相关的词语内容",)], "term string")
    m = {r.term: r for r in tm.map_terms(df, vocab, min_score=0.5).collect()}
    assert m["戈谢病"].match_type == "exact" and m["戈谢病"].code == "ORPHA:355"
    assert m["戈谢氏病"].code == "ORPHA:355"
    assert m["完全不相关的词语内容"].code is None


def test_join_form_equals_brute_force(spark):
    rnd = random.Random(7)
    alpha = "abcde fgh"
    names = sorted({"".join(rnd.choice(alpha) for _ in range(rnd.randint(1, 8))).strip() or "a" for _ in range(25)})
    words = ["".join(rnd.choice(alpha + "xyz") for _ in range(rnd.randint(0, 9))) for _ in range(300)]
    vocab = spark.createDataFrame([(i, n, f"C{i % 7}") for i, n in enumerate(names)], "ord int, std_name string, code string")
    tdf = spark.createDataFrame([(w,) for w in set(words)], "term string")
    got = {r.term: (r.code, r.score) for r in tm.map_distinct_terms(tdf, vocab).collect()}
    # brute force: every pair scored inside one row, first maximum in vocabulary order
    pairs = (tdf.crossJoin(vocab).select("term", "ord", "code", tm.hybrid_score("term", "std_name").alias("s"))
             .collect())
    best = {}
    for r in sorted(pairs, key=lambda r: r.ord):
        b = best.get(r.term, (None, 0.0))
        if r.s > b[1]:
            best[r.term] = (r.code, r.s)
    for w in set(words):
        c, s = best.get(w, (None, 0.0))
        assert got[w] == (c, round(s + 0.0, 3)) or abs(got[w][1] - s) < 1e-9, (w, got[w], c, s)
        assert got[w][0] == c, (w, got[w], c)


def test_match_rate(spark):
    df = spark.createDataFrame([("戈谢病",), ("戈谢氏病",), ("abc",), ("病",)], "term string")
    r = tm.match_rate(tm.map_terms(df, default_vocab(spark))).first()
    assert r.exact_rate == 0.25 and r.hybrid_rate == 0.25


def test_embedding_blocks_equal_single_block(spark):
    rnd = random.Random(3)
    vocab = spark.createDataFrame([(i, f"V{i}", [rnd.uniform(-1, 1) for _ in range(5)]) for i in range(40)],
                                  "ord long, code string, vec array<double>")
    terms = spark.createDataFrame([(j, [rnd.uniform(-1, 1) for _ in range(5)]) for j in range(100)],
                                  "term long, vec array<double>")
    a = {r.term: (r.code, round(r.score, 12)) for r in tm.match_by_embedding(terms, vocab).collect()}
    b = {r.term: (r.code, round(r.score, 12)) for r in tm.match_by_embedding(terms, vocab, term_rows=30, vocab_rows=7).collect()}
    assert a == b and len(a) == 100


def test_char_bag(spark):
    df = spark.createDataFrame([("病病a",), ("",)], "t string")
    got = sorted(tuple(r) for r in tm.char_bag(df, "t").collect())
    assert got == [("病病a", "a", 1.0), ("病病a", "病", 2.0)]


def test_embedding_scores_above_zero_only(spark):
    from cohortshare.operators import terms as tm
    v = spark.createDataFrame([(1, "A", [1.0, 0.0]), (2, "B", [0.0, 1.0])], "ord long, code string, vec array<double>")
    t = spark.createDataFrame([("p", [2.0, 1.0]), ("n", [-1.0, -2.0])], "term string, vec array<double>")
    assert {r.term: (r.code, r.score > 0) for r in tm.match_by_embedding(t, v).collect()} == {"p": ("A", True), "n": (None, False)}
    assert {(r.code, r.score) for r in tm.match_by_embedding(t, v.limit(0)).collect()} == {(None, 0.0)}
    odd = spark.createDataFrame([("z", [0.0, 0.0]), ("n", None), (None, [0.0, 3.0]), ("p", [0.0, 1.0]), ("p", [0.0, 1.0])], "term string, vec array<double>")
    same = v.unionByName(spark.createDataFrame([(0, "C", [0.0, 5.0])], "ord long, code string, vec array<double>"))
    assert {r.term: (r.code, round(r.score, 9)) for r in tm.match_by_embedding(odd, same).collect()} == {
        "z": (None, 0.0), "n": (None, 0.0), None: ("C", 1.0), "p": ("C", 1.0)}
    assert tm.match_by_embedding(odd.limit(0), v).count() == 0


def _large_case(spark, alphabet, weights, n_names=500, n_terms=250):
    rnd = random.Random(11)
    names = sorted({"".join(rnd.choices(alphabet, weights, k=rnd.randint(2, 8))) for _ in range(n_names)})
    words = {"", " ", "é", "7-7", "a", "zzzz", "".join(rnd.choice("kalomi") for _ in range(60))}
    for _ in range(n_terms):
        w = list(rnd.choice(names))
        for _ in range(rnd.randint(1, 2)):
            i = rnd.randrange(len(w))
            w[i:i + 1] = rnd.choice(["", rnd.choice(alphabet), w[i] + rnd.choice(alphabet)])
        words.add("".join(w))
    vocab = spark.createDataFrame([(i, n, f"C{i % 50}") for i, n in enumerate(names)], "ord int, std_name string, code string")
    return spark.createDataFrame([(w,) for w in sorted(words)], "term string"), vocab


SYLLABLES = ["ka", "lo", "mi", "ther", "zu", "quin", "ba", "ro", "vex", "ny", "pho", "sti", "gra", "do", "wu", "jel"]


@pytest.mark.parametrize("alphabet, met_share, scored_share", [
    ([chr(0x4E00 + i) for i in range(300)], 0.1, 0.02), (SYLLABLES, 1, 0.1)], ids=["many characters", "few characters"])
def test_pruned_candidates_equal_all_pairs(spark, alphabet, met_share, scored_share):
    """The same winners as all pairs, for a broadcast and a shuffled vocabulary, from a small part of the pairs."""
    terms, vocab = _large_case(spark, alphabet, [1 / (i + 1) ** 0.8 for i in range(len(alphabet))])
    pairs = terms.crossJoin(vocab).select("term", "ord", "code", tm.hybrid_score("term", "std_name").alias("score")).where("score > 0")
    want = {r.term: (r.code, r.best) for r in tm.best_candidate(pairs.withColumn("score", F.round("score", 12))).collect()}
    for limit in (tm.BROADCAST_VOCAB_ROWS, 0):
        scored = tm.score_candidates(terms, vocab, limit).withColumn("score", F.round("score", 12))
        assert {r.term: (r.code, r.best) for r in tm.best_candidate(scored).collect()} == want
    every = terms.count() * vocab.count()
    met, kept = tm.met_candidates(terms, tm.VocabIndex(vocab)).count(), tm.score_candidates(terms, vocab).count()
    print(f"pairs: all {every}, met {met}, scored {kept}")
    assert met <= met_share * every and kept <= scored_share * every
