"""Equal texts: shingles of one row of each, results as if of all."""

import random

import corpus_brute as brute
import numpy as np
import pyarrow as pa
import pytest

from cohortshare.llm import multi_order_join


def _rows():
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60))) for _ in range(60)]
    near = [b + " tail" for b in base[:20]]
    spaced = [b.replace(" ", "  ") for b in base[20:30]]              # other texts, equal sets
    texts = [*base, *base[:40], *base[:40], *near, *spaced, "", "", None, None, " ", " "]
    return list(enumerate(texts)) + [(3, base[3]), (None, base[5]), (None, base[59])]


@pytest.mark.parametrize("bits,more", [(27, 0), (11, 700)])          # with 2,048 places, many copies pass the bitmap
def test_components_of_copies(spark, monkeypatch, bits, more):
    monkeypatch.setattr(multi_order_join, "KEPT_BITS", bits)
    rows = _rows() + [(10_000 + i, f"only {i}") for i in range(more)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = sorted((tuple(r) for r in multi_order_join.document_components(docs).collect()), key=key)
    assert got == sorted(map(tuple, brute.components(rows)), key=key)


def test_shingles_of_a_text_are_stored_once(spark, monkeypatch):
    held, write = {}, multi_order_join.stored

    def stored(df, name):
        out = write(df, name)
        held.setdefault(name, out.count() if "tokens" in df.columns else None)
        return out
    monkeypatch.setattr(multi_order_join, "stored", stored)
    text = " ".join(f"w{i}" for i in range(400))
    docs = spark.createDataFrame([(i, f"{text} {i % 4}") for i in range(240)], "doc_id long, text string")
    got = multi_order_join.document_components(docs).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 240
    assert held["shingle-sets"] == 4
    assert multi_order_join.keep_one_of_each(docs, 4, 85).count() == 1


class _Always:
    """Stands for a broadcast table: every token may be shared, the nodes ``known`` follow a leader."""

    def __init__(self, known=()):
        self.value, self.known = self, known

    def level(self, hashes):
        return np.full(len(hashes), 2, np.uint8)

    def may_repeat(self, hashes):
        return np.isin(hashes, multi_order_join._node_hashes(pa.array(self.known, pa.binary()))) if self.known else np.zeros(len(hashes), bool)


def test_a_set_travels_once_a_round_and_no_more_once_it_follows():
    nodes = [bytes([i]) * 16 for i in range(6)]
    sets = [np.arange(5 + i, dtype="<u8").tobytes() for i in range(6)]
    batch = pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())], ["node", "tokens"])
    seed = multi_order_join.ORDERS[0]
    (first,) = multi_order_join._leader_keys(_Always(), seed, None)([batch])
    assert first.column(1).to_pylist() == nodes
    (later,) = multi_order_join._leader_keys(_Always(), seed, _Always(nodes[1:5]))([batch])
    assert later.column(1).to_pylist() == [nodes[0], nodes[5]]
