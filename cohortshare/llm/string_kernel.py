"""Language identification by a string kernel.

* Kernel: blended spectrum with presence bits. A text is the set of its 1- to 4-grams over lower-cased letters
  (UTF-8 bytes; digits and ASCII punctuation become spaces), hashed to ``BITS`` places; k(x, y) = |x & y| / sqrt(|x| |y|).
* Nystroem: a bounded sample of landmarks L gives the map x -> K(x, L) K(L, L)^(-1/2).
* One-versus-rest kernel ridge regression on that map, with every language's rows weighted alike.
* Scoring: K(X, L) A for a batch of texts X, two matrix products; the model is a fixed-size matrix pair.
* Score: the decision above the model's floor, which is that of a text that shares nothing with any landmark. A score of
  ``STRANGER`` is the level that ``STRANGERS_BELOW`` of the texts of a language stay under when that language is left out
  of the fit, so it means the same for any number of languages.

Only the fit is bounded (``PER_LANGUAGE`` rows a language, drawn by a hash of the id); every text is scored whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import fresh_name, id_and_text, raw_texts, ship, small_or_shuffled, stored, tidy

BITS = 1 << 13              # presence places
GRAMS = 4
PER_LANGUAGE = 300          # rows sampled per language for the fit
LANDMARKS = 160             # of them, texts that the kernel is taken against
RIDGE = 1.0
BATCH = 256                 # texts scored in one matrix product
STRANGER = 0.25             # score at the level of languages that were not learnt
STRANGERS_BELOW = 0.95      # share of their texts under that level
LEAST_MARGIN = 0.05         # that level is so far above the floor at least (random letters come to 0.03)

_LETTER = re.compile(r"[^\W\d_]")
_FOLD = bytes((c | 0x20) if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def has_letter(raw: bytes) -> bool:
    return _LETTER.search(raw.decode()) is not None


def presence(raws: list[bytes]) -> np.ndarray:
    """Presence bits of each text's n-grams, (texts, BITS) float32."""
    out = np.zeros((len(raws), BITS), np.float32)
    for row, raw in zip(out, raws):
        codes = np.frombuffer(b" " + raw.translate(_FOLD) + b" ", np.uint8).astype(np.uint32)
        gram = np.zeros(len(codes), np.uint32)
        for n in range(1, GRAMS + 1):
            gram = gram[:len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1:] + np.uint32(n)
            row[((gram * np.uint32(2654435769)) >> np.uint32(32 - 13)) & np.uint32(BITS - 1)] = 1.0
    return out


def unit(p: np.ndarray) -> np.ndarray:
    """Scale presence rows so that their inner products are the normalised kernel."""
    return p / np.sqrt(np.maximum(p.sum(axis=1, keepdims=True), 1.0))


@dataclass(frozen=True)
class KernelModel:
    languages: tuple[str, ...]
    landmarks: np.ndarray       # (landmarks, BITS), unit rows
    weights: np.ndarray         # (landmarks + 1, languages), the last row is the offset
    strangers: float = LEAST_MARGIN     # height of languages that were not learnt

    def decide(self, raws: list[bytes]) -> np.ndarray:
        k = unit(presence(raws)) @ self.landmarks.T
        return k @ self.weights[:-1] + self.weights[-1]


def height(decisions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How far each text's best decision is from the floor (0) towards a sure one (1)."""
    floor = min(float(offsets.max()), 0.99)         # a single language decides 1 always
    return (decisions.max(axis=1) - floor) / (1 - floor)


def _ridge(k: np.ndarray, among: np.ndarray, by: list[np.ndarray], ridge: float) -> np.ndarray:
    """Weights of the landmarks and the offset, per language. k: rows to landmarks; ``by``: the rows of each language."""
    vals, vecs = np.linalg.eigh(among)
    good = vals > 1e-6 * vals.max()
    half = vecs[:, good] / np.sqrt(vals[good])
    phi = k @ half
    phi1 = np.hstack([phi, np.ones((len(phi), 1))])
    weight, y = np.empty(len(k)), np.full((len(k), len(by)), -1.0)
    for c, rows in enumerate(by):
        weight[rows], y[rows, c] = len(k) / (len(by) * len(rows)), 1.0
    penalty = ridge * np.eye(phi1.shape[1])
    penalty[-1, -1] = 1e-9
    w = np.linalg.solve(phi1.T @ (weight[:, None] * phi1) + penalty, phi1.T @ (weight[:, None] * y))
    return np.vstack([half @ w[:-1], w[-1:]]).astype(np.float32)


def strangers_height(k: np.ndarray, among: np.ndarray, by: list[np.ndarray], marks: list[np.ndarray], ridge: float) -> float:
    """The height that STRANGERS_BELOW of a language's texts stay under in a fit without it, over languages alike.

    Fewer than three languages: LEAST_MARGIN, as a fit needs two that stay.
    """
    heights, weights = [], []
    for out in range(len(by)) if len(by) > 2 else ():
        stay = [c for c in range(len(by)) if c != out]
        cols, rows = np.concatenate([marks[c] for c in stay]), np.concatenate([by[c] for c in stay])
        ends = np.cumsum([len(by[c]) for c in stay])
        w = _ridge(k[np.ix_(rows, cols)], among[np.ix_(cols, cols)], np.split(np.arange(len(rows)), ends[:-1]), ridge)
        heights.append(height(k[np.ix_(by[out], cols)] @ w[:-1] + w[-1], w[-1]))
        weights.append(np.full(len(by[out]), 1 / len(by[out])))
    if not heights:
        return LEAST_MARGIN
    h, w = np.concatenate(heights), np.concatenate(weights)
    order = np.argsort(h, kind="stable")
    at = np.searchsorted(np.cumsum(w[order]), STRANGERS_BELOW * len(by))
    return min(0.9, max(LEAST_MARGIN, float(h[order][min(at, len(h) - 1)])))


def fit(bits: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> KernelModel:
    names = tuple(sorted(set(langs)))
    x = unit(bits)
    by = [np.flatnonzero(np.array(langs) == n) for n in names]
    share = max(1, landmarks // max(1, len(names)))
    chosen = [rows[:share] for rows in by]
    mark = x[np.concatenate(chosen)]
    among, k = (mark @ mark.T).astype(np.float64), (x @ mark.T).astype(np.float64)
    marks = np.split(np.arange(len(mark)), np.cumsum([len(c) for c in chosen])[:-1])
    return KernelModel(names, mark, _ridge(k, among, by, ridge), strangers_height(k, among, by, marks, ridge))


def _bit_rows(batches):
    for b in batches:
        raws = raw_texts(b.column(2))
        packed = [np.packbits(presence([r])[0] > 0).tobytes() if has_letter(r) else None for r in raws]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], ["lang", "draw", "bits"])


def train(docs: DataFrame, may_learn: Column, per_language: int = PER_LANGUAGE) -> KernelModel | None:
    """Fit on at most ``per_language`` texts a language, among rows with ``may_learn`` and a lang; None without any.

    The texts with the smallest hashes are drawn (a partial top-k per task, then one per language). What reaches the
    driver is one packed bit row of BITS / 8 bytes per drawn text.
    """
    ship(docs.sparkSession)
    rows = docs.where(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", "text").alias("draw"),
        F.col("text").cast("string").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    drawn = rows.select("lang", "draw").withColumn("rank", rank).where(F.col("rank") <= per_language)
    drawn = small_or_shuffled(stored(drawn.select("lang", "draw").distinct(), "language-sample"), 200_000)
    texts = rows.join(drawn, ["lang", "draw"]).dropDuplicates(["lang", "draw"]).select("lang", "draw", "text")
    got = texts.mapInArrow(_bit_rows, "lang string, draw long, bits binary").where(F.col("bits").isNotNull()).toArrow()
    if not got.num_rows:
        return None
    got = got.sort_by([("lang", "ascending"), ("draw", "ascending")])
    bits = np.array([np.unpackbits(np.frombuffer(x, np.uint8)) for x in got["bits"].to_pylist()], np.float32)
    return fit(bits, got["lang"].to_pylist())


def predict(model: KernelModel | None, raws: list[bytes]) -> tuple[list[str], list[float]]:
    """Language and score in 0..1 of each text; ``und`` and 0 for a text without a letter, or without a model."""
    langs, scores = ["und"] * len(raws), [0.0] * len(raws)
    at = [i for i, r in enumerate(raws) if model is not None and has_letter(r)]
    for k in range(0, len(at), BATCH):
        part = at[k:k + BATCH]
        d = model.decide([raws[i] for i in part])
        level = np.interp(height(d, model.weights[-1]), [-1.0, model.strangers, 1.0], [0.0, STRANGER, 1.0])
        for i, c, v in zip(part, d.argmax(axis=1), level):
            langs[i], scores[i] = model.languages[c], float(v)
    return langs, scores


def _score(model, text_at: int, names: list[str]):
    def run(batches):
        for b in batches:
            langs, scores = predict(model.value, raw_texts(b.column(text_at)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             [*b.schema.names, *names])
    return run


def with_language(docs: DataFrame, model: KernelModel | None, lang_name: str, score_name: str) -> DataFrame:
    """``docs`` with two more columns, the predicted language and its score; reads ``text`` only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = StructType([*docs.schema.fields]).add(lang_name, "string").add(score_name, "double")
    return docs.mapInArrow(tidy(_score(shared, docs.columns.index("text"), [lang_name, score_name])), out)


def held_out_fold() -> Column:
    """crc32(doc_id as text) mod 3 = 1; a null id is in no fold (neither learnt from nor held out)."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def identify_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; the model learns from rows outside the held-out fold.

    Null text or no letter: ``und``, score 0. No row to learn from: ``und`` for all. Repeated rows: equal results.
    """
    model = train(docs, ~held_out_fold())
    return (with_language(id_and_text(docs), model, "lang_pred", "score")
            .select("doc_id", F.coalesce(held_out_fold(), F.lit(False)).alias("held_out"), "lang_pred", "score"))


def drop_unidentified(docs: DataFrame, min_score: float) -> DataFrame:
    """The rows of ``docs`` whose text has a letter and whose best language scores ``min_score`` or more.

    Nothing can be learnt (no labelled rows): rows with a letter stay.
    """
    lang, score = fresh_name(docs.columns, "cs_lang"), fresh_name(docs.columns, "cs_score")
    model = train(docs, ~held_out_fold())
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    scored = with_language(docs, model, lang, score)
    return scored.where((F.col(lang) != "und") & (F.col(score) >= min_score)).select(*docs.columns)
