"""H2/H3 (re-aimed): a distributed character tagger over BIO sentences.

The reference fine-tunes a transformer on one GPU.  Here the same input
(BIO sentences), labels and metric feed a multinomial logistic regression over
hashed character-window features.

* A token's features are its own character and its two neighbours on either side,
  each hashed with its place in the window to one of ``FEATURES`` rows of a
  coefficient matrix.
* **Fit**: all labelled sentences are packed once into blocks of feature numbers and
  label ids under the shared folder.  Every step of a limited-memory quasi-Newton search is one job: each task adds up the
  gradient over its blocks, partial sums per feature row are added by Spark, and the
  driver sees one row per feature that occurs.
* **Tagging**: whole notes go through Arrow batches, where a note's scores are sums of
  matrix rows and its labels are decoded; what comes back is the entities.
  There is no row per character and no shuffle.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions import islands, passes
from ..functions import tags as tg
from ..session import scratch_path, spread

WINDOW = 2
SLOTS = 2 * WINDOW + 1
FEATURES = 262_139           # rows of the coefficient matrix, a prime
CHUNK = 1 << 16              # tokens scored at a time
PORTION = 1 << 18            # tokens, or bytes of texts, tagged at a time; a longer row alone
_MULTIPLIER = 2_654_435_761
_PAD = 0x110000              # stands beside the first and last token
_N = len(tg.LABELS)


def token_code(token: str) -> int:
    """A token as a number: its code point, or beyond them a hash of a longer token."""
    return ord(token) if len(token) == 1 else _PAD + 1 + zlib.crc32(token.encode()) % (1 << 20)


def window_features(codes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """[token, place in the window]: feature numbers of tokens that lie in sentences ``edges[i]:edges[i + 1]``."""
    n = len(codes)
    sentence = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    out = np.empty((n, SLOTS), np.int64)
    for slot, d in enumerate(range(-WINDOW, WINDOW + 1)):
        at = np.arange(n) + d
        inside = (at >= 0) & (at < n)
        at = np.where(inside, at, 0)
        inside &= sentence[at] == sentence
        out[:, slot] = (np.where(inside, codes[at], _PAD) * SLOTS + slot) * _MULTIPLIER % FEATURES
    return out


def label_ids(weights: np.ndarray, codes: np.ndarray, edges: np.ndarray | None = None) -> np.ndarray:
    """The best label of each token, the first of equals; tokens lie in sentences ``edges[i]:edges[i + 1]`` (none given: one sentence).

    The weights of the codes that occur are looked up once for each place in a window; a token's scores are sums of
    such rows, added in the order of the places.
    """
    edges = np.array([0, len(codes)]) if edges is None else edges
    known, at = _numbered(np.append(codes, _PAD))
    pad = at[-1]
    rows = [weights[(known * SLOTS + slot) * _MULTIPLIER % FEATURES].T.copy() for slot in range(SLOTS)]     # [label, code]
    sentence = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    place = np.arange(len(codes)) + WINDOW * (sentence + 1)              # sentences stand apart by ``WINDOW`` places of padding
    spaced = np.full(len(codes) + WINDOW * len(edges), pad, np.int64)
    spaced[place] = at[:-1]
    out = np.zeros(len(spaced), np.uint8)
    n = len(spaced) - 2 * WINDOW
    best, score, part = (np.empty(min(CHUNK, max(n, 0))) for _ in range(3))
    for a in range(0, n, CHUNK):
        m = min(CHUNK, n - a)
        label = out[a + WINDOW:a + WINDOW + m]
        for k in range(_N):
            np.take(rows[0][k], spaced[a:a + m], out=score[:m], mode="clip")        # every index is one of the codes that occur
            for slot in range(1, SLOTS):
                np.take(rows[slot][k], spaced[a + slot:a + slot + m], out=part[:m], mode="clip")
                np.add(score[:m], part[:m], out=score[:m])
            if k:
                label[score[:m] > best[:m]] = k
                np.maximum(best[:m], score[:m], out=best[:m])
            else:
                best[:m] = score[:m]
    return out[place]


def _numbered(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the codes that occur, in order; the place of each code among them), without sorting all codes."""
    seen = np.zeros(int(codes.max()) + 1, bool)
    seen[codes] = True
    known = np.flatnonzero(seen)
    place = np.zeros(len(seen), np.int32)
    place[known] = np.arange(len(known), dtype=np.int32)
    return known, place[codes]


class LinearTagger:
    """Coefficients of a fitted tagger: a row of ``len(LABELS)`` weights for each feature that is not all zero."""

    def __init__(self, features: np.ndarray, weights: np.ndarray):
        self.features, self.weights = features, weights

    def matrix(self) -> np.ndarray:
        out = np.zeros((FEATURES, _N))
        out[self.features] = self.weights
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(int(f), w.tolist()) for f, w in zip(self.features, self.weights)]
        spark.createDataFrame(rows, "feature int, weights array<double>").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LinearTagger:
        rows = spark.read.parquet(path).orderBy("feature").collect()       # at most FEATURES rows
        return cls(np.array([r["feature"] for r in rows], np.int64), np.array([r["weights"] for r in rows]).reshape(-1, _N))


# ---------------------------------------------------------------- fit

def _pack(batches):
    """(tokens, label ids) -> blocks of about CHUNK tokens: feature numbers and labels as bytes."""
    seen: dict[str, int] = {}

    def block(codes, labels):
        edges = np.concatenate([[0], np.cumsum([len(c) for c in codes])])
        f = window_features(np.concatenate(codes), edges)
        return pa.RecordBatch.from_arrays([pa.array([f.astype("<i4").tobytes()]), pa.array([np.concatenate(labels).astype(np.uint8).tobytes()])],
                                          ["features", "labels"])
    codes, labels, size = [], [], 0
    for b in batches:
        for tokens, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if not tokens:
                continue
            for t in set(tokens) - seen.keys():
                seen[t] = token_code(t)
            codes.append(np.array([seen[t] for t in tokens], np.int64))
            labels.append(np.array(ids, np.int64))
            size += len(tokens)
            if size >= CHUNK:
                yield block(codes, labels)
                codes, labels, size = [], [], 0
    if codes:
        yield block(codes, labels)


def block_gradient(weights: np.ndarray, features: np.ndarray, labels: np.ndarray):
    """(loss, gradient rows of the features, their numbers) of some tokens: the negative log likelihood, summed."""
    scores = weights[features].sum(axis=1)
    scores -= scores.max(axis=1, keepdims=True)
    p = np.exp(scores)
    total = p.sum(axis=1, keepdims=True)
    every = np.arange(len(labels))
    loss = float(np.log(total[:, 0]).sum() - scores[every, labels].sum())
    p /= total
    p[every, labels] -= 1
    numbers, at = np.unique(features, return_inverse=True)
    at = at.reshape(features.shape)
    rows = np.stack([sum(np.bincount(at[:, s], p[:, k], len(numbers)) for s in range(SLOTS)) for k in range(_N)], axis=1)
    return loss, rows, numbers


def _gradients(shared):
    """Blocks -> per task one row (feature, gradient of each label) a feature; feature -1: loss and number of tokens."""
    def run(batches):
        model, total, loss, n = shared.value, np.zeros((FEATURES, _N)), 0.0, 0
        weights, hit = model.matrix(), np.zeros(FEATURES, bool)
        for b in batches:
            for f, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                features, labels = np.frombuffer(f, "<i4").reshape(-1, SLOTS), np.frombuffer(y, np.uint8)
                part, rows, numbers = block_gradient(weights, features, labels)
                total[numbers] += rows
                hit[numbers] = True
                loss, n = loss + part, n + len(labels)
        numbers = np.flatnonzero(hit)
        cols = [np.append(total[numbers, k], {0: loss, 1: float(n)}.get(k, 0.0)) for k in range(_N)]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(numbers, -1), pa.int32()), *map(pa.array, cols)],
                                         ["feature", *(f"g{k}" for k in range(_N))])
    return run


def _distributed(blocks: DataFrame) -> Callable:
    spark = blocks.sparkSession
    sums = [F.sum(f"g{k}").alias(f"g{k}") for k in range(_N)]
    schema = "feature int, " + ", ".join(f"g{k} double" for k in range(_N))

    def evaluate(model: LinearTagger):
        shared = spark.sparkContext.broadcast(model)
        rows = blocks.mapInArrow(_gradients(shared), schema).groupBy("feature").agg(*sums).orderBy("feature").toPandas().to_numpy()
        shared.unpersist()
        last, rows = rows[0], rows[1:]
        n = max(last[2], 1.0)
        return last[1] / n, rows[:, 1:] / n, rows[:, 0].astype(np.int64)
    return evaluate


def minimise(evaluate: Callable, max_iter: int, reg: float, memory: int = 7, tolerance: float = 1e-6) -> LinearTagger:
    """Limited-memory quasi-Newton search from zero; ``evaluate(model)`` is (mean loss, gradient rows, feature numbers).

    The numbers are the same at every call: the features that occur.
    """
    loss, grad, features = evaluate(LinearTagger(np.zeros(0, np.int64), np.zeros((0, _N))))
    w, steps = np.zeros_like(grad), []
    for _ in range(max_iter):
        if np.abs(grad).max(initial=0.0) <= tolerance:
            break
        direction, kept = -grad, []
        for s, y in reversed(steps):
            a = (s * direction).sum() / (s * y).sum()
            kept.append(a)
            direction = direction - a * y
        if steps:
            s, y = steps[-1]
            direction = direction * ((s * y).sum() / (y * y).sum())
        else:
            direction = direction / max(1.0, np.abs(grad).sum()) * math.sqrt(grad.size)
        for (s, y), a in zip(steps, reversed(kept)):
            direction = direction + (a - (y * direction).sum() / (s * y).sum()) * s
        slope, rate = float((grad * direction).sum()), 1.0
        while True:
            new = w + rate * direction
            value, g, _ = evaluate(LinearTagger(features, new))
            value, g = value + reg / 2 * float((new * new).sum()), g + reg * new
            if value <= loss + 1e-4 * rate * slope or rate < 1e-6:
                break
            rate /= 2
        if value >= loss:
            break
        if ((new - w) * (g - grad)).sum() > 1e-12:
            steps = [*steps, (new - w, g - grad)][-memory:]
        w, loss, grad = new, value, g
    return LinearTagger(features, w)


def packed(sentences: DataFrame, max_sentences: int | None = None) -> DataFrame:
    """All labelled sentences (tokens, tags) as blocks of features and labels, a table under the shared folder.

    Only a caller who asks for it by ``max_sentences`` gets a part: those with the smallest hashes.  No fit does.
    """
    spark = sentences.sparkSession
    rows = spread(sentences.select("tokens", tg.encode_tags("tags").alias("ids")).where(F.size("tokens") > 0))
    if max_sentences is not None:
        rows = rows.orderBy(F.xxhash64("tokens", "ids")).limit(max_sentences).repartition(spark.sparkContext.defaultParallelism)
    path = scratch_path(spark, "tagger-blocks")
    rows.mapInArrow(_pack, "features binary, labels binary").write.parquet(path)
    return spark.read.schema("features binary, labels binary").parquet(path)


def train_tagger(sentences: DataFrame, *, max_iter: int = 20, reg: float = 1e-6) -> LinearTagger:
    """H2: fit on all BIO sentences (tokens, tags); an unknown tag is an error.  No token: every token is tagged ``O``."""
    return minimise(_distributed(packed(sentences)), max_iter, reg)


# ---------------------------------------------------------------- tagging

def _labels_of():
    """Texts, or arrays of tokens -> (label numbers of all tokens, tokens of each row), a portion of a batch at a time."""
    def run(weights: np.ndarray, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if pa.types.is_list(column.type):
            n, coded = islands.lengths(column), column.flatten().dictionary_encode()
            numbers = np.array([*(token_code(t) for t in coded.dictionary.to_pylist()), _PAD], np.int64)
            codes = numbers[pc.fill_null(coded.indices, len(numbers) - 1).to_numpy(zero_copy_only=False)]
        else:
            chs, n = islands.characters(column)
            codes = islands.code_points(chs)
        return label_ids(weights, codes, islands.bounds(n)), n
    return run


def _sizes(column: pa.Array) -> np.ndarray:
    """What :func:`islands.portions` goes by: tokens, or bytes of a text."""
    if pa.types.is_list(column.type):
        return islands.lengths(column)
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _note_entities(shared, mode: str):
    """Batches of (key, text) -> one row per entity of the text's characters."""
    def run(batches):
        weights, labels, tags = shared.value.matrix(), _labels_of(), islands.TagCodes(tg.LABELS)
        for b in batches:
            for part in islands.portions(b, _sizes(b.column(1)), PORTION):
                key, texts = part.columns
                ids, n = labels(weights, texts)
                found = islands.entities(ids, n, tags, mode)
                chs = islands.as_lists(islands.characters(texts)[0], n, texts.is_valid())
                yield islands.entity_rows([key], b.schema.names[:1], found, tags, islands.joined(chs, found, ""))
    return run


def predict_tags(model: LinearTagger, sentences: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Tag every token: ``sentences`` with ``pred_tags`` in token order (null tokens: null)."""
    shared = sentences.sparkSession.sparkContext.broadcast(model)
    given = sentences.columns

    def make(wanted):
        own = [c for c in wanted if c != "pred_tags"]
        own = own if tokens in own else [*own, tokens]
        source, before = passes.taken(sentences, own)

        def run(batches):
            weights, labels, names = shared.value.matrix(), _labels_of(), pa.array(tg.LABELS)
            for b in before(batches):
                for part in islands.portions(b, _sizes(b.column(own.index(tokens))), PORTION):
                    column = part.column(own.index(tokens))
                    ids, n = labels(weights, column)
                    tags = islands.as_lists(pa.DictionaryArray.from_arrays(pa.array(ids), names), n, column.is_valid())
                    yield pa.RecordBatch.from_arrays([tags if c == "pred_tags" else part.column(own.index(c)) for c in wanted], list(wanted))
        return source, run
    if "pred_tags" in given:
        raise ValueError("the sentences have a column pred_tags already")
    return passes.made(StructType([*sentences.schema.fields, StructField("pred_tags", ArrayType(StringType()))]), make)


def tag_notes(model: LinearTagger, df: DataFrame, key: str = "patient_id", text: str = "clinical_note",
              mode: str = "strict") -> DataFrame:
    """H3: notes -> characters -> tags -> entities (key, start, end, type, text); whole notes, no shuffle.

    Null and empty notes have no entity.
    """
    from .bio import ENTITY_FIELDS
    islands.check_mode(mode)
    notes = df.select(F.col(key), F.col(text).cast("string").alias(text)).where(F.length(text) > 0)
    shared = df.sparkSession.sparkContext.broadcast(model)
    out = StructType([*notes.schema.fields[:1], *ENTITY_FIELDS])
    return notes.mapInArrow(_note_entities(shared, mode), out)


_LOADED: dict = {}


def loaded(model_id: str, loader):
    """The model of this Python worker, loaded on first use; module-level, so that tasks share it."""
    if model_id not in _LOADED:
        _LOADED[model_id] = loader()
    return _LOADED[model_id]


def tag_notes_with_model(df: DataFrame, loader, model_id: str, key: str = "patient_id", text: str = "clinical_note",
                         mode: str = "strict", batch_rows: int = 256) -> DataFrame:
    """H3 with a user model: ``loader()`` returns ``predict(list[list[str]]) -> list[list[str]]``
    (character lists in, tag lists out).

    Runs through ``mapInPandas`` on Arrow batches; the model named ``model_id`` is loaded
    once per Python worker and reused across batches and tasks (the reference reloads it
    per call).  Decoding uses the array decoder.
    """
    import pandas as pd

    def run(batches):
        from cohortshare.operators.tagger import loaded
        model = loaded(model_id, loader)
        for b in batches:
            for i in range(0, len(b), batch_rows):
                part = b.iloc[i:i + batch_rows]
                toks = [list(t) if t is not None else [] for t in part[text]]
                yield pd.DataFrame({key: part[key].values, "tokens": toks, "pred_tags": model(toks)})

    kt = df.schema[key].dataType.simpleString()
    tagged = df.select(key, text).mapInPandas(run, f"{key} {kt}, tokens array<string>, pred_tags array<string>")
    from .bio import sentence_entities
    return sentence_entities(tagged.where(F.size("tokens") > 0), "tokens", "pred_tags", mode, keys=(key,))
