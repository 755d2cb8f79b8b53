"""SimHash components against brute force, with and without hot anchors."""

import random

import numpy as np
import pytest
import xxhash
from test_llm_queries import SF, awkward, ordered, pairs
from test_llm_queries import SCHEMA

from cohortshare.llm import anchor_points, queries
from cohortshare.llm.common import NULL_ID


def plain_print(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + size]) for i in range(max(len(words) - size, 0) + 1)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(prints):
    """doc_id -> smallest reachable doc_id, by comparing all pairs of distinct fingerprints."""
    distinct = sorted({p for _, p in prints})
    a = np.array(distinct, np.uint64)
    root = {p: p for p in distinct}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p
    for p in distinct:
        for q in a[np.bitwise_count(a ^ np.uint64(p)) <= 3].tolist():
            root[max(top(p), top(q))] = min(top(p), top(q))
    least = {}
    for d, p in prints:
        least[top(p)] = min(least.get(top(p), NULL_ID), NULL_ID if d is None else d)
    return [None if least[top(p)] == NULL_ID else least[top(p)] for _, p in prints]


def expected(texts):
    prints = [(d, plain_print(t)) for d, t in texts]
    return [(d, f"{p:016x}", c) for (d, p), c in zip(prints, plain_components(prints))]


@pytest.mark.parametrize("most", [anchor_points.MOST, 2])
def test_matches_brute_force(spark, most):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = anchor_points.simhash_components(docs, most=most).collect()
    assert ordered(got) == ordered(expected(pairs(docs)))
    odd = spark.createDataFrame(awkward(), SCHEMA)
    assert ordered(anchor_points.simhash_components(odd, most=most).collect()) == ordered(expected(pairs(odd)))
    assert anchor_points.simhash_components(spark.createDataFrame([], SCHEMA), most=most).count() == 0


def test_query_returns_the_contract_columns(spark):
    out = queries.QUERIES["op11_simhash_anchors"](spark, SF)
    assert out.columns == ["doc_id", "fingerprint", "component_id"] and out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


@pytest.mark.parametrize("most", [anchor_points.MOST, 3])
def test_links_connect_a_dense_cluster(spark, most):
    """Chains and balls of fingerprints, a third of all rows around one centre, also at 3 bits in all splits of the halves."""
    rng = random.Random(most)
    prints = {rng.getrandbits(64) for _ in range(300)}
    centre = rng.getrandbits(64)
    for _ in range(300):
        prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))))
    for p in list(prints)[:200]:
        low = rng.randrange(4)
        flips = rng.sample(range(32), low) + rng.sample(range(32, 64), 3 - low)
        prints.add(p ^ sum(1 << b for b in flips))
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(sorted(prints))]
    df = spark.createDataFrame(rows, "i long, print long")
    links = {(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in anchor_points.fingerprint_links(df, most).collect()}
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    root = {p: p for p in prints}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p
    for a, b in links:
        root[max(top(a), top(b))] = min(top(a), top(b))
    by = {}
    for i, p in enumerate(sorted(prints)):
        by.setdefault(top(p), []).append(i)
    got = {i: min(g) for g in by.values() for i in g}
    assert [got[i] for i in range(len(prints))] == plain_components(list(enumerate(sorted(prints))))


def test_an_anchor_reports_few_links():
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    prints = np.array(sorted({centre ^ sum(1 << b for b in rng.sample(range(64), 2)) for _ in range(500)}), np.uint64)
    found = anchor_points.connecting_links(prints, np.ones(len(prints), bool))
    assert len(found) <= 4 * len(prints)


def test_long_texts_are_counted_in_chunks():
    text = " ".join(str(i % 977) for i in range(140_000))
    assert anchor_points.simhash(text.encode()) == plain_print(text)
