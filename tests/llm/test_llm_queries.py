"""Registered queries against plain Python versions on a small table, and on rows chosen to be awkward."""

import random
from collections import defaultdict
from zlib import crc32

import corpus_brute as brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortshare.llm import (disclosure, grouped_packing, induced_suffixes, license_index, line_frequency, multi_order_join, patricia,
                             piece_transducer, queries, string_kernel, window_dedup)

SF = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string, spans string, "
          "node string, fp string, label string, sha string, length string, `row` string")


def awkward():
    """Nulls in every column, empty and long texts, ties, repeated rows, columns named like results."""
    rng = random.Random(5)
    vocab = ["w" + format(i, "x") for i in range(400)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    near = [rng.choice(vocab) for _ in range(200)]
    other = list(near)
    other[100] = "changed"
    texts = [None, "", " \t\n", "Same Text of six words here", "same text OF six words here", "one", passage,
             "before " + passage + " after", "word " * 3000, "x" * 30000, " ".join(near), " ".join(other), " ".join(near).upper(),
             " ".join(rng.choice(vocab) for _ in range(20000)), "mail a.b@c.de. and 1.2.3.4 +49 (89) 123-456 4111 1111 1111 1111",
             "\U0001F600 € café \x00\x01 ▁ İ", "Released under the MIT License.\nline\nline", "0.0.0.256 999.1.1.1 a@b 4111111111111112"]
    rows = [(i, t, ["en", "de", None][i % 3], ["s", None][i % 2], None, "n", "k", "s", "n", "f", "l", "h", "9", "r")
            for i, t in enumerate(texts, 10)]
    return rows + [rows[3], rows[3], rows[13], (None, *rows[4][1:]), (None, "only here", *rows[4][2:]), (None, *rows[10][1:])]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def plain(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def check(df, expected, width):
    assert ordered(r[:width] for r in df.collect()) == ordered(expected)


CASES = [
    ("op1_line_frequency", line_frequency.judge_documents, brute.quality, 7),
    ("op2_suffix_dedup", lambda d: induced_suffixes.remove_earlier_strings(d).drop("kept"), brute.earlier_bytes, 5),
    ("op3_license_scan", license_index.scan_licences, brute.licence_base, 6),
    ("op4_pii_disclosure", disclosure.find_personal_data, brute.personal, 6),
    ("op6_exact_dedup", patricia.exact_dedup, brute.copies, 5),
    ("op8_substring_dedup", lambda d: window_dedup.remove_repeated_windows(d).drop("text"), brute.repeated_words, 4),
    ("op9_jaccard_join", multi_order_join.document_components, brute.components, 3),
]


@pytest.mark.parametrize("name, op, plainly, width", CASES, ids=[c[0] for c in CASES])
def test_matches_brute_force(spark, odd, empty, plain, name, op, plainly, width):
    check(queries.QUERIES[name](spark, SF), plainly(plain), width)
    check(op(odd), plainly(pairs(odd)), width)
    assert op(empty).count() == 0


def test_suffix_dedup_of_hot_minimisers(spark, odd, plain):
    """Minimisers of three occurrences are hot already; a third of the rows share one amid different surroundings."""
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz "
    def noise():
        return "".join(rng.choice(letters) for _ in range(120))
    header = "a header of over fifty bytes that every third text has somewhere "
    core = "the minimiser's twenty-four bytes or so"
    rows = plain[:60] + [(10_000 + i, noise() + (header if i % 3 == 0 else core if i % 3 == 1 else "") + noise()) for i in range(90)]
    for pairs_of, docs in ((rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)), (pairs(odd), odd)):
        for hot in (2, 3, 20):
            check(induced_suffixes.remove_earlier_strings(docs, hot=hot).drop("kept"), brute.earlier_bytes(pairs_of), 5)


def test_packed_strings_round_trip():
    strings, which = [b"x" * 50, b"\0" * 51, bytes(range(60))], np.array([2, 0, 1, 1, 2])
    doc, first = np.array([0, 0, 0, 2, 2]), np.array([0, 70_000, 1 << 25, 3, 4])
    ids, fps = np.array([-5, (1 << 63) - 1, 7]), np.array([-1, 0, 1 << 62])
    for args in ((strings, which, doc, first, ids, fps), ([], *[np.zeros(0, np.int64)] * 5)):
        got = induced_suffixes.unpack_strings(induced_suffixes.pack_strings(*args))
        assert got[0] == args[0] and all(a.tolist() == b.tolist() for a, b in zip(got[1:], args[1:]))


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_boilerplate_lines_and_depletion(spark):
    rows = [(i, f"own text number {i} has its own words and some more of them\ncommon  LINE here", None, "host", None) for i in range(8)]
    rows += [(100 + i, f"short {i}\nCommon line here\ncommon line here\ncommon line here\ncommon line here", None, "host", None) for i in range(3)]
    rows += [(200, "common line here\nbut on another host, where nobody else says it at all", None, "else", None)]
    rows += [(300 + i, "copied line of a page\nthat is held in many copies, which count as one text only", None, "host", None) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in line_frequency.judge_documents(docs, max_docs=5).collect()}
    for d, gone, depleted in brute.line_verdicts([(r[0], r[3], r[1]) for r in rows], 5, line_frequency.MIN_WORDS_LEFT, line_frequency.MIN_SHARE_LEFT):
        assert got[d].n_line_words_removed == gone and got[d].kept == (not got[d].base_failed and not depleted)
    assert not got[100].kept and got[0].kept and got[200].n_line_words_removed == 0 and got[300].n_line_words_removed == 0
    text = {r.doc_id: r.text for r in line_frequency.remove_boilerplate(docs, max_docs=5).collect()}
    assert text[0] == rows[0][1].split("\n")[0] and text[200] == rows[11][1] and len(text) == len(rows)


def test_language_accuracy_and_fold(spark):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = queries.QUERIES["op5_language_id"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(docs[r.doc_id].lang == r.lang_pred for r in held) >= 0.97 * len(held)


def test_language_of_awkward_rows(spark, odd, empty):
    rows = string_kernel.identify_languages(odd).collect()
    assert len(rows) == len(awkward())
    text = dict((r[0], r[1]) for r in awkward() if r[0] is not None)
    for r in rows:
        if r.doc_id is None:
            assert not r.held_out
        elif not any(c.isalpha() for c in text[r.doc_id] or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("en", "de")
    assert string_kernel.identify_languages(empty).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in string_kernel.identify_languages(unlabelled).collect()} == {"und"}
    assert string_kernel.drop_unidentified(unlabelled, 0.25).columns == odd.columns


def sequences(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def expected_pieces(texts, capacity=2048):
    from tokenizers import Tokenizer
    tk = Tokenizer.from_file(grouped_packing.vocabulary_path())
    out = []
    for d, t in texts:
        ids = np.array(tk.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        out += [(d, i // capacity, i, len(ids[i:i + capacity]), crc32(ids[i:i + capacity].tobytes())) for i in range(0, len(ids), capacity)]
    return out


def test_packing(spark, odd, empty, plain):
    rows = queries.QUERIES["op10_best_fit_packing"](spark, SF).collect()
    assert ordered(r[:5] for r in rows) == ordered(expected_pieces(plain))
    total = sum(r.length for r in rows)
    assert sequences(rows, 2048) <= 1.03 * -(-total // 2048) + 1
    rows = grouped_packing.best_fit_pack(odd).collect()
    assert ordered(r[:5] for r in rows) == ordered(expected_pieces(pairs(odd)))
    sequences(rows, 2048)
    assert grouped_packing.best_fit_pack(empty).count() == 0


def test_sentencepiece(spark, odd, empty, plain):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_transducer.model_path())

    def expected(texts):
        return [(d, len(x), crc32(np.array(x, "<u4").tobytes()), True) for d, x in ((d, sp.encode(t or "")) for d, t in texts)]
    assert ordered(queries.QUERIES["op7_sentencepiece"](spark, SF).collect()) == ordered(expected(plain))
    assert ordered(piece_transducer.encode_and_check(odd).collect()) == ordered(expected(pairs(odd)))
    assert piece_transducer.encode_and_check(empty).count() == 0
    coded = piece_transducer.decode_ids(piece_transducer.encode_texts(odd)).collect()
    assert all(r.ids == sp.encode(r.text or "") and r.decoded == (r.text or "").replace("▁", " ") for r in coded)
