"""Exact dedup by Patricia-trie owners.

Every text (A-Z lower-cased, nothing else) travels as its full byte string, once per Arrow batch that holds it,
to the partition of its (length, content hash). A partition reads its strings in key order and inserts them into
a compressed radix trie; a terminal node keeps the owners of one text. The trie of one (length, hash) key is a
subtree of its own: when the order has moved past the key the subtree is final, is written out and freed, so a
partition never holds more than one key's distinct texts. Texts that merely share length and hash end in
different terminals. A group of copies costs one row per batch before the shuffle, however large it is.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from .common import NULL_ID, fingerprint, fresh_name, id_and_text, id_or_null, ids_of, raw_texts, ship, tidy

_LOCAL = "n_bytes long, h long, content binary, min_id long, max_id long, n long, n_top long"
_OWNERS = "sha binary, n_bytes long, min_id long, max_id long, n long, n_top long"


def normalise(raw: bytes) -> bytes:
    """Lower-case A-Z only (``bytes.lower`` leaves every other byte alone)."""
    return raw.lower()


def _join(a, b):
    """Combine (min id, max id, rows, rows that carry the max id); null ids rank last for min and never win max."""
    top = max(a[1], b[1])
    return (min(a[0], b[0]), top, a[2] + b[2], a[3] * (a[1] == top) + b[3] * (b[1] == top))


def _one(doc_id: int):
    return (doc_id, -NULL_ID - 1 if doc_id == NULL_ID else doc_id, 1, 1)


def _common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n                      # a[:lo] == b[:lo] and a[:hi] != b[:hi]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class PatriciaTrie:
    """Compressed radix trie: an edge carries a byte string, a terminal node the owners of the text that ends there."""

    __slots__ = ("edges", "owners")

    def __init__(self):
        self.edges: dict[int, tuple[bytes, PatriciaTrie]] = {}
        self.owners = None

    def insert(self, key: bytes, owners) -> None:
        node, rest = self, key
        while rest:
            edge = node.edges.get(rest[0])
            if edge is None:
                child = PatriciaTrie()
                node.edges[rest[0]] = (rest, child)
                node, rest = child, b""
                break
            label, child = edge
            n = _common_prefix(label, rest)
            if n < len(label):         # split the edge
                middle = PatriciaTrie()
                middle.edges[label[n]] = (label[n:], child)
                node.edges[rest[0]] = (label[:n], middle)
                child = middle
            node, rest = child, rest[n:]
        node.owners = owners if node.owners is None else _join(node.owners, owners)

    def terminals(self):
        """(text, owners) of every text, in byte order."""
        stack = [(b"", self)]
        while stack:
            prefix, node = stack.pop()
            if node.owners is not None:
                yield prefix, node.owners
            for first in sorted(node.edges, reverse=True):
                label, child = node.edges[first]
                stack.append((prefix + label, child))


def _local_copies(batches):
    """One row per distinct text of a batch."""
    for b in batches:
        seen: dict[bytes, tuple] = {}
        for doc_id, raw in zip(ids_of(b.column(0)), raw_texts(b.column(1))):
            text = normalise(raw)
            seen[text] = _join(seen[text], _one(doc_id)) if text in seen else _one(doc_id)
        texts, owners = list(seen), list(zip(*seen.values())) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(map(len, texts), pa.int64()), pa.array(map(fingerprint, texts), pa.int64()),
             pa.array(texts, pa.binary()), *(pa.array(c, pa.int64()) for c in owners)],
            ["n_bytes", "h", "content", "min_id", "max_id", "n", "n_top"])


def _trie_owners(batches):
    key, trie = None, None

    def finished():
        rows = [(hashlib.sha256(t).digest(), len(t), *o) for t, o in trie.terminals()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), [pa.binary()] + [pa.int64()] * 5)],
            ["sha", "n_bytes", "min_id", "max_id", "n", "n_top"])

    done = []
    for b in batches:
        cols = [b.column(i).to_pylist() for i in range(7)]
        for n_bytes, h, content, *owners in zip(*cols):
            if (n_bytes, h) != key:
                if trie is not None:
                    done.append(finished())
                    if len(done) >= 512:
                        yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                        done = []
                key, trie = (n_bytes, h), PatriciaTrie()
            trie.insert(content, tuple(owners))
    if trie is not None:
        done.append(finished())
    if done:
        yield from pa.Table.from_batches(done).combine_chunks().to_batches()


def copy_owners(docs: DataFrame) -> DataFrame:
    """One row per distinct normalised text: sha (binary SHA-256), n_bytes, min_id, max_id, n (rows), n_top
    (rows that carry max_id). Null ids count as rows; max_id is null only if every id is."""
    local = id_and_text(docs).mapInArrow(tidy(_local_copies), _LOCAL)
    keyed = local.repartition("n_bytes", "h").sortWithinPartitions("n_bytes", "h")
    return (keyed.mapInArrow(tidy(_trie_owners), _OWNERS)
            .withColumn("max_id", F.when(F.col("max_id") == -NULL_ID - 1, F.lit(None)).otherwise(F.col("max_id")))
            .withColumn("min_id", id_or_null(F.col("min_id"))))


def _shas(batches):
    for b in batches:
        shas = [hashlib.sha256(normalise(t)).digest() for t in raw_texts(b.column(1))]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shas, pa.binary())], ["doc_id", "sha"])


def classify_copies(docs: DataFrame) -> DataFrame:
    """doc_id, sha, copies (rows with this id and text), keep_id, group_size, first_id, one row per distinct (doc_id, text).

    The text owner's row count never gathers in one task: documents meet their owner by a join on the text's
    digest, with one row on the owner's side, so that a hot text can be split.
    """
    rows = (id_and_text(docs).mapInArrow(tidy(_shas), "doc_id long, sha binary")
            .groupBy("doc_id", "sha").agg(F.count(F.lit(1)).alias("copies")))
    owners = copy_owners(docs).select("sha", F.col("max_id").alias("keep_id"), F.col("min_id").alias("first_id"),
                                      F.col("n").alias("group_size"))
    return rows.join(owners, "sha")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, first_id.

    The row with the largest doc_id of equal texts stays. Of repeated rows (same id, same text) one is kept. If
    all ids of a group are null, keep_id is null and one row stays. A null text is the empty text. No rows: no rows.
    """
    c = classify_copies(docs)
    return (c.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
            .select("doc_id", "keep_id", "group_size",
                    (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)).alias("kept"),
                    F.lower(F.hex("sha")).alias("text_sha256"), "first_id"))


def _append_sha(position: int, name: str):
    def run(batches):
        for b in batches:
            shas = pa.array([hashlib.sha256(normalise(t)).digest() for t in raw_texts(b.column(position))], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, shas], [*b.schema.names, name])
    return run


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts the one with the largest doc_id."""
    ship(docs.sparkSession)
    sha = fresh_name(docs.columns, "cs_sha")
    out = StructType([*docs.schema.fields]).add(sha, BinaryType())
    rows = docs.mapInArrow(tidy(_append_sha(docs.columns.index("text"), sha)), out)
    keep = (classify_copies(docs).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
            .select(F.col("doc_id").alias("k_id"), F.col("sha").alias("k_sha"), "copies"))

    def staying(which):
        k = keep.where(which).select("k_id", "k_sha")
        return rows.join(k, (rows[sha] == k["k_sha"]) & rows["doc_id"].eqNullSafe(k["k_id"]), "left_semi")

    single = staying(F.col("copies") == 1)
    repeated = staying(F.col("copies") > 1).dropDuplicates(["doc_id", sha])
    return single.unionByName(repeated).drop(sha)
