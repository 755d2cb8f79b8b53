"""Ranked search against a plain version; bounds never below scores."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from test_llm_queries import SCHEMA, awkward, ordered, pairs

from cohortshare.llm import bit_slices, queries

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def plain_ranking(docs, items, top=20):
    words = [(d, Counter(terms(t))) for d, t in docs]
    words = [(d, c) for d, c in words if c]
    n, length = len(words), sum(sum(c.values()) for _, c in words)
    df = Counter(t for _, c in words for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in words:
            m = 100 - 25 + (25 * sum(c.values()) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m))
                        for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, d is None, d))
        out += [(item, i, d, -s) for i, (s, _, d) in enumerate(sorted(found)[:top], 1)]
    return out


def test_query_matches_the_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    out = queries.QUERIES["op13_bit_sliced_search"](spark, SF)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert ordered(out.collect()) == ordered(plain_ranking(pairs(docs), items))


@pytest.mark.parametrize("blocks", [1, 3])
def test_awkward_rows(spark, blocks, monkeypatch):
    docs = spark.createDataFrame(awkward(), SCHEMA).repartition(3)
    items = [(1, "w1 w2 W3 w3 word"), (2, None), (3, ""), (3, "same text"), (None, "mail mail MIT"), (5, "nothing-here zzzz"),
             (6, " ".join(f"w{i:x}" for i in range(400))), (7, "café İ € 1 2 4111")]
    table = spark.createDataFrame([(i, t, "r", 1) for i, t in items], "item_id long, text string, `rank` string, score long")
    if blocks > 1:
        monkeypatch.setattr(bit_slices, "QUERY_BYTES", sum(len((t or "").encode()) for _, t in items) // blocks)
    want = ordered(plain_ranking(pairs(docs), items, 4))
    assert ordered(bit_slices.rank_documents(docs, table, top=4, probes=5).collect()) == want
    assert bit_slices.rank_documents(spark.createDataFrame([], SCHEMA), table).count() == 0
    assert bit_slices.rank_documents(docs, table.limit(0)).count() == 0


def test_many_copies_and_a_frequent_term(spark):
    rng = random.Random(2)
    rows = [(i, "the the common copy of one text about lions") for i in range(300)]
    rows += [(1000 + i, "the " + " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(40)))) for i in range(300)]
    items = [(1, "the lions"), (2, "a b c the"), (3, "the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = bit_slices.rank_documents(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert ordered(got.collect()) == ordered(plain_ranking(rows, items))


def test_bounds_are_never_below_scores_and_exclude_most():
    rng = random.Random(4)
    vocab = [f"t{i}" for i in range(2000)]
    docs = [[vocab[int(rng.paretovariate(0.7)) % 2000] for _ in range(rng.choice([3, 60, 700]))] for _ in range(200)]
    q = bit_slices.Queries([(i, " ".join(rng.sample(vocab, 12)).encode()) for i in range(20)])
    raw = [[w.encode() for w in d] for d in docs]
    df = Counter(t for d in raw for t in set(d) if t in q.number)
    q.weigh(len(raw), sum(map(len, raw)), {q.number[t]: n for t, n in df.items()})
    close = total = 0
    for size in (3, 60, 700):
        part = [d for d in raw if len(d) == size]
        entries = [Counter(d) for d in part]
        width = bit_slices.width_of(max(sum(sum(n >= level for n in c.values()) for level in bit_slices.LEVELS) for c in entries))
        rows = []
        for c in entries:
            found = [bit_slices.places(np.array([bit_slices.xxhash.xxh3_64_intdigest(t) for t in c if c[t] >= level], np.uint64), level, width).reshape(-1)
                     for level in bit_slices.LEVELS]
            rows.append((0, 0, size, np.unique(np.concatenate(found))))
        _, _, sizes, _, slices = bit_slices._block_row(width, rows)
        bounds = bit_slices.upper_bounds(q, np.array(sizes, np.int64), width, slices)
        scores = np.array([bit_slices.exact_scores(q, d) for d in part]).T
        assert (bounds >= scores).all()
        close += int((bounds <= 1.5 * scores).sum())
        total += bounds.size
    assert close > 0.7 * total
