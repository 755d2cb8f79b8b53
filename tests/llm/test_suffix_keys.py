import random

import pytest

from cohortshare.llm import induced_suffixes, super_kmers

ROW = "doc_id long, text string"


def _texts(rng):
    shared = "".join(rng.choice("abcdef ") for _ in range(300))
    return ["".join(rng.choice("abcdef ") for _ in range(60)) + shared[a:a + 120] for a in range(0, 180, 20)] + [None, ""]


def _removed(rows):
    """Bytes covered by a 50-byte string that also starts in a document with a smaller id, by plain sets."""
    low = {}
    for i, t in rows:
        for p in range(len(t or "") - 49):
            low[t[p:p + 50]] = min(i, low.get(t[p:p + 50], i))
    return sorted((i, len({q for p in range(len(t or "") - 49) if low[t[p:p + 50]] < i for q in range(p, p + 50)})) for i, t in rows)


@pytest.mark.parametrize("repeated", [False, True])
def test_fingerprints_travel_only_where_an_id_repeats(spark, monkeypatch, repeated):
    rows = list(enumerate(_texts(random.Random(11))))
    if repeated:
        rows.append((3, rows[5][1]))
    docs = spark.createDataFrame(rows, ROW).repartition(3)
    asked, keyed = [], super_kmers.keyed_texts
    monkeypatch.setattr(induced_suffixes, "keyed_texts", lambda d, by_text=True: asked.append(keyed(d, by_text)) or asked[-1])
    got = induced_suffixes.remove_earlier_strings(docs, filter_bits=20).select("doc_id", "n_removed").collect()
    assert sorted(map(tuple, got)) == _removed(rows)
    prints = {r.fp for r in asked[0].select("fp").collect()}
    assert (prints == {0}) is not repeated
