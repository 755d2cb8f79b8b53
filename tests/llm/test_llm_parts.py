"""The operators' own parts, by properties and against independent versions."""

import random
import re

import corpus_brute as brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortshare.llm import disclosure, grouped_packing, induced_suffixes, license_index, multi_order_join, patricia, piece_transducer
from cohortshare.llm.super_kmers import Scheme, word_bounds, word_hashes

texts = st.text(st.sampled_from("ab cdeé .,'\n\t▁€\U0001F600<|>123S#\x00"), max_size=60)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_transducer_is_sentencepiece_and_round_trips(text):
    import sentencepiece
    t = piece_transducer.transducer(piece_transducer.model_path())
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_transducer.model_path())
    ids = np.frombuffer(t.encode(text), "<u4").tolist()
    assert ids == sp.encode(text) and t.decode(ids) == text.replace("▁", " ")


@settings(max_examples=150, deadline=None)
@given(texts)
def test_word_ids_join_to_the_texts_ids(text):
    from tokenizers import Tokenizer
    path = grouped_packing.vocabulary_path()
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids if text else []
    assert np.frombuffer(grouped_packing.word_ids(path).text_ids(text.encode()), "<u4").tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120), st.integers(1, 12))
def test_plan_places_every_piece_once(lengths, groups):
    hist = {n: lengths.count(n) for n in set(lengths)}
    runs, bins = grouped_packing.plan(hist, 64, groups)
    space, seen = [0] * bins, set()
    for length, a, z, first, per, offset in sorted(runs, key=lambda r: (r[5])):
        for rank in range(a, z):
            b, k = first + (rank - a) // per, (rank - a) % per
            assert space[b] == offset + k * length and (length, rank) not in seen
            space[b] += length
            seen.add((length, rank))
    assert max(space, default=0) <= 64 and len(seen) == len(lengths) and all(space)


def test_suffix_order_by_sorting():
    rng = random.Random(2)
    for letters in (b"ab", b"abcdef\x00\xff"):
        for _ in range(60):
            strings = list(dict.fromkeys(bytes(rng.choice(letters) for _ in range(rng.randint(8, 40))) for _ in range(rng.randint(1, 10))))
            t = np.concatenate([np.append(np.frombuffer(s, np.uint8).astype(np.int64) + 1, 0) for s in strings])
            ends = np.cumsum(t == 0).tolist()
            flat = t.tolist()

            def suffix(i):
                z = flat.index(0, i)
                return [(c, 0) for c in flat[i:z]] + [(0, ends[z])]
            assert induced_suffixes.suffix_order(t).tolist() == sorted(range(len(t)), key=suffix)


def test_queue_continues_on_disk():
    q = induced_suffixes.CharacterQueue(limit=3)
    for k in range(5):
        q.push(np.array([7, 2, 7]), np.array([3 * k, 3 * k + 1, 3 * k + 2]))
    assert q.files and q.take(7).tolist() == [x for k in range(5) for x in (3 * k, 3 * k + 2)]
    assert q.take(2).tolist() == [1, 4, 7, 10, 13] and not q.files and not len(q.take(7))


def test_runs_cover_every_window_once():
    scheme = Scheme(10, 4, True, 16)
    raw = " ".join(random.Random(1).choice("abc") for _ in range(500)).encode()
    mins, first, count = scheme.runs(word_hashes(raw, *word_bounds(raw)))
    assert first.tolist() == [0, *np.cumsum(count)[:-1].tolist()] and count.sum() == 491 and count.max() <= 7
    words, of = raw.split(), {}
    for m, a, n in zip(mins.tolist(), first.tolist(), count.tolist()):
        for i in range(a, a + n):
            assert of.setdefault(tuple(words[i:i + 10]), m) == m


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=12), st.integers(0, 9)), max_size=30))
def test_patricia_trie_keeps_owners(items):
    trie = patricia.PatriciaTrie()
    for text, doc in items:
        trie.insert(text, patricia._one(doc))
    want = {}
    for text, doc in items:
        want.setdefault(text, []).append(doc)
    assert list(trie.terminals()) == [(t, (min(d), max(d), len(d), d.count(max(d)))) for t, d in sorted(want.items())]


@pytest.mark.parametrize("percent, a, b, yes", [(85, range(100), range(8, 100), True), (85, range(100), range(16, 100), False),
                                                (80, range(10), range(2, 10), True), (100, range(3), range(3), True)])
def test_linked_at_the_threshold(percent, a, b, yes):
    assert multi_order_join.linked(np.array(a, np.uint64), np.array(b, np.uint64), percent) is yes


def test_large_near_copy_group_and_common_passage(spark):
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(3000)]
    base = [rng.choice(vocab) for _ in range(120)]
    line = " ".join(rng.choice(vocab) for _ in range(12))
    rows = []
    for i in range(120):
        w = list(base)
        w[rng.randrange(120)] = f"edit{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, line + " " + " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 40)))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in multi_order_join.document_components(docs).collect())
    assert got == sorted(brute.components(rows))
    kept = multi_order_join.keep_one_of_each(docs, 4, 85)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in got})


def test_long_words_are_told_apart(spark):
    """Words that a polynomial hash modulo 2^64 confuses, and words with letters swapped 65,536 places apart."""
    morse = "".join("ab"[i.bit_count() & 1] for i in range(1024))
    other = morse.translate(str.maketrans("ab", "ba"))
    long = "x" + "a" * 65535 + "y" + "b" * 10
    swapped = "y" + "a" * 65535 + "x" + "b" * 10
    rows = [(1, morse), (2, other), (3, f"{morse} one two three four"), (4, f"{other} one two three four"), (5, long), (6, swapped), (7, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in multi_order_join.document_components(docs).collect())
    assert got == sorted(brute.components(rows)) and [c for _, _, c in got] == [1, 2, 3, 4, 5, 6, 5]
    assert multi_order_join.keep_one_of_each(docs, 5, 80).count() == 6


def test_split_leader_groups_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(multi_order_join, "GROUP_ROWS", 5)
    monkeypatch.setattr(multi_order_join, "LEADERS", 1)
    rng = random.Random(6)
    base = [f"v{rng.randrange(999)}" for _ in range(60)]
    rows = [(i, " ".join(base[:50 + i % 10] + [f"t{i % 7}"])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in multi_order_join.document_components(docs).collect()) == sorted(brute.components(rows))


def test_licence_templates_in_order_only(spark):
    rows = [(i, text) for i, (_, text, _) in enumerate(license_index.TEMPLATES)]
    rows += [(100, "license apache the under licensed of version 0 2"), (101, "permission is granted free of charge hereby"),
             (102, "plain words only")]
    got = {r.doc_id: r for r in license_index.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (label, _, _) in enumerate(license_index.TEMPLATES):
        assert label in got[i].labels.split(",") and got[i].score == 1.0
    assert all(got[i].labels == "" and got[i].score == 0 for i in (100, 101, 102))


def test_licences_of_files_with_several(spark):
    """Every template whose phrase stands in the file gives its label, against brute force over all templates."""
    t = license_index.TEMPLATES
    texts = [f"{a[1]} {b[1]}" for a in t for b in t if a[0] != b[0]]
    texts += [" ".join(x[1] for x in t), " ".join(x[2] for x in t), " filler ".join(x[1] for x in reversed(t))]
    texts += [" ".join(w for y in t if y[0] != x[0] for w in reversed(y[1].split())) + " " + x[2] for x in t]

    def want(text):
        w, labels, best = text.split(), {x for p, x in license_index.BASE if f" {p} " in f" {text} "}, 0.0
        for label, body, phrase in t:
            body, phrase = body.split(), phrase.split()
            start = license_index._place(body, phrase)
            for i in range(len(w)):
                if w[i:i + len(phrase)] == phrase:
                    there = [0 <= i - start + q < len(w) and w[i - start + q] == x for q, x in enumerate(body)]
                    labels.add(label)
                    best = max(best, sum(there) / len(body))
        return ",".join(sorted(labels)), best
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in license_index.scan_licences(docs).collect()}
    assert got == {i: want(x) for i, x in enumerate(texts)}


personal_text = st.text(st.sampled_from("a1.@+ -()0%_25\n4"), max_size=40)


def test_personal_patterns_on_random_strings(spark):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("a1.@+ -()0925x") for _ in range(rng.randint(0, 60)))) for i in range(600)]
    rows += [(1000, "1" * 50000), (1001, "a" * 50000 + "@b" + ".c" * 20000), (1002, "1.1." * 20000), (1003, "1 " * 30000), (1004, "+1" + "(" * 50000)]
    got = sorted(tuple(r[:6]) for r in disclosure.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(brute.personal(rows))


def test_thousands_of_spans_in_one_text(spark):
    """Masking copies every character once: many spans, overlapping ones, and revealing terms in one long text."""
    rng = random.Random(8)
    text = "".join(rng.choice((f"m{i}@x.org ", "1.2.3.4 ", "\U0001F600 ", "+49 (89) 1234567 ", "plain ")) for i in range(20_000))
    rows = [(1, text), (2, "no data here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in disclosure.find_personal_data(docs).collect()}
    assert [tuple(got[d][:6]) for d in (1, 2)] == sorted(brute.personal(rows))
    want, at = [], 0
    for a, z, kind in sorted((int(a), -int(z), k) for k, a, z in (x.split(":") for x in got[1].spans.split(","))):
        if a >= at:
            want.append(text[at:a] + disclosure.MASKS[kind])
        at = max(at, -z)
    clean = {r.doc_id: r.text for r in disclosure.sanitise(docs).collect()}
    assert clean == {1: "".join(want) + text[at:], 2: "no data here"}


def test_terms_that_reveal_an_entity(spark):
    filler = ["the people of this town went home today", "we saw the sea and the old harbour there", "many words stand here without meaning"]
    rows = [(i, f"{filler[i % 3]} doctor Quagmire wrote from q.mire@clinic.org about the visit number{chr(97 + i)}") for i in range(5)]
    rows += [(10 + i, f"{filler[i % 3]} and the letter x{chr(97 + i % 26)}{chr(97 + i // 26)} about the visit wrote doctor from") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in disclosure.find_personal_data(docs).collect()}
    text = dict(rows)
    for d in range(5):
        words = {text[d][int(a):int(b)] for k, a, b in (s.split(":") for s in got[d].spans.split(",")) if k == "term"}
        assert words == {"Quagmire"}
    assert all(got[d].spans == "" for d in range(10, 210))
    clean = {r.doc_id: r.text for r in disclosure.sanitise(docs).collect()}
    assert "[TERM] wrote from [EMAIL] about" in clean[0] and clean[10] == text[10]


def test_revealing_terms_go_wherever_they_stand(spark):
    """Far from the mention, without it, and beside a list of addresses: every place of the word is a span."""
    far = "".join(chr(97 + i % 26) + " " for i in range(200))
    rows = [(i, f"doctor Quagmire wrote from q.mire@clinic.org {far}Signed QUAGMIRE, not Quagmires. {'xyzw' + chr(97 + i)}") for i in range(60)]
    rows += [(100, f"ask quagmire {far}"), (101, "ask quagmires")]
    rows += [(200 + i, f"Zebulon has a@b{i}.org bad 1.2.3.400 5.6.7.800 z@home.org {chr(97 + i)}") for i in range(5)]
    rows += [(300 + i, f"doctor wrote from ask has bad signed not word{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text, got = dict(rows), {r.doc_id: r for r in disclosure.find_personal_data(docs).collect()}
    words = {d: [text[d][int(a):int(b)] for k, a, b in (s.split(":") for s in r.spans.split(",") if s) if k == "term"] for d, r in got.items()}
    assert all(words[d] == ["Quagmire", "QUAGMIRE"] and got[d].n_term == 2 for d in range(60))
    assert words[100] == ["quagmire"] and words[101] == [] and all(words[200 + i] == ["Zebulon"] for i in range(5))
    clean = {r.doc_id: r.text for r in disclosure.sanitise(docs).collect()}
    assert not any(re.search(r"(?i)\bquagmire\b|zebulon", t) for t in clean.values())
    assert clean[100].startswith("ask [TERM] a b ") and clean[101] == text[101] and clean[300] == text[300]


def test_contexts_are_the_text_around_a_mention(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(("abc ", "d@e.fg ", "1.2.3.4 ", "9.9.9.999 ", "longerword ", "x", "+1 23 ")) for _ in range(rng.randint(1, 120))))
            for i in range(80)]
    n = disclosure.CONTEXT
    for r in disclosure.mentions(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        t = dict(rows)[r.doc_id]
        assert (r.left, r.right) == (t[max(0, r.start - n):r.start], t[r.end:r.end + n]) and t[r.start:r.end] == r.match
        assert (r.more_left, r.more_right) == (r.start > n, len(t) - r.end > n)


def test_luhn_and_ranges(spark):
    rows = [("4111111111111111", True), ("4111111111111112", False), ("79927398713", True), ("0", True)]
    df = spark.createDataFrame(rows, "d string, ok boolean")
    assert all(r.ok == r.got for r in df.withColumn("got", disclosure.passes_luhn(F.col("d"))).collect())
    assert re.fullmatch(disclosure._PART, "00255") and not re.fullmatch(disclosure._PART, "256")
