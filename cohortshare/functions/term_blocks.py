"""Best names of many terms from a small vocabulary, by matrix products over character counts.

For a block of terms and all names the cosines and the shared characters come from products of count matrices; with
them a pair's score is at most ``edit * shared / longer + cosine part``.  The names with the highest bounds set a term's
lower bound, and every pair whose bound reaches it is scored, by bit-parallel edit distances of all such pairs at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

TERMS = 256                  # terms of a block
FIRST = 8                    # names scored first for each term
MAX_NAME = 64                # bits of a word of the edit distance
_MARGIN = 1e-9


class Names:
    """The vocabulary's (name, code) in the order that breaks ties: counts, norms, and for each character the places that hold it."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.codes = [code for _, code in rows]
        self.alphabet = {c: i for i, c in enumerate(sorted({c for name, _ in rows for c in name}))}
        self.length = np.array([len(name) for name, _ in rows], np.int64)
        self.counts = np.zeros((len(self.alphabet), len(rows)))
        self.places = np.zeros((len(rows), len(self.alphabet) + 1), np.uint64)
        for v, (name, _) in enumerate(rows):
            for i, c in enumerate(name):
                self.counts[self.alphabet[c], v] += 1
                self.places[v, self.alphabet[c]] |= np.uint64(1 << i)
        self.norm = np.sqrt((self.counts * self.counts).sum(axis=0))


def distances(names: Names, name: np.ndarray, text: np.ndarray, n_text: np.ndarray) -> np.ndarray:
    """Levenshtein distances of pairs: numbers of names, rows of character numbers and their lengths."""
    one, m = np.uint64(1), names.length[name]
    top = (m - 1).astype(np.uint64)
    up, down, score = np.full(len(name), ~np.uint64(0)), np.zeros(len(name), np.uint64), m.copy()
    for j in range(int(n_text.max(initial=0))):
        eq = names.places[name, text[:, j]]
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | ~(xh | up), up & xh
        step = ((ph >> top) & one).astype(np.int64) - ((mh >> top) & one).astype(np.int64)
        score += np.where(j < n_text, step, 0)
        ph, mh = (ph << one) | one, mh << one
        up, down = mh | ~(xv | ph), ph & xv
    return score


def best_of_block(names: Names, terms: list[str], edit: float, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(number of the best name or -1, its score) of each term; of equal scores the first name."""
    n = np.array([len(t) for t in terms], np.int64)
    other = len(names.alphabet)
    text = np.full((len(terms), int(n.max(initial=0))), other, np.int32)
    counts, norm = np.zeros((len(terms), other)), np.zeros(len(terms))
    for i, t in enumerate(terms):
        own: dict[str, int] = {}
        for j, c in enumerate(t):
            own[c] = own.get(c, 0) + 1
            text[i, j] = names.alphabet.get(c, other)
        norm[i] = np.sqrt(float(sum(x * x for x in own.values())))
        for c, x in own.items():
            if c in names.alphabet:
                counts[i, names.alphabet[c]] = x
    dot = counts @ names.counts
    cos = dot / (np.where(norm == 0, 1.0, norm)[:, None] * names.norm[None, :])
    levels = int(min(counts.max(initial=0), names.counts.max(initial=0)))
    shared = sum(((counts >= k).astype(np.float32) @ (names.counts >= k).astype(np.float32) for k in range(1, levels + 1)), np.zeros(dot.shape, np.float32)).astype(np.float64)
    longer = np.maximum(n[:, None], names.length[None, :])
    bound = np.where(dot > 0, edit * shared / np.maximum(longer, 1) + cosine * cos, -1.0)

    def score(i, v):
        return edit * (1.0 - distances(names, v, text[i], n[i]) / longer[i, v]) + cosine * cos[i, v]

    first = min(FIRST, bound.shape[1])
    if not first:
        return np.full(len(terms), -1), np.zeros(len(terms))
    tops = np.argpartition(bound, bound.shape[1] - first, axis=1)[:, -first:]
    i, v = np.repeat(np.arange(len(terms)), first), tops.ravel()
    some = bound[i, v] > 0
    least = np.zeros(len(terms))
    np.maximum.at(least, i[some], score(i[some], v[some]))
    i, v = np.nonzero((bound >= least[:, None] - _MARGIN) & (dot > 0))
    at, top = np.full(len(terms), -1), np.zeros(len(terms))
    s = score(i, v)
    order = np.lexsort((v, -s, i))
    rows, where = np.unique(i[order], return_index=True)
    at[rows], top[rows] = v[order][where], s[order][where]
    return at, top


def best_names(shared, edit: float, cosine: float):
    """Batches of terms -> (term, code, best): code null and 0 where no name shares a character."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value
        for batch in batches:
            terms = batch.column(0).to_pylist()
            for a in range(0, len(terms), TERMS):
                block = terms[a:a + TERMS]
                at, top = best_of_block(names, block, edit, cosine)
                codes = [names.codes[v] if v >= 0 else None for v in at]
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.string()), pa.array(codes, pa.string()), pa.array(top, pa.float64())],
                                                 ["term", "code", "best"])
    return run
