"""Substring dedup by super-k-mers: words inside 35-word windows that occur more than once are removed.

Consecutive windows that share a minimiser travel as one packed string to the minimiser's bucket (see
``super_kmers``). A bucket sorts its windows and counts them exactly; equal strings were merged into one with a
count before the shuffle, so copies in a third of all documents cost a row per batch. Documents meet the verdict
on their strings again through a join on the string's 128-bit name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw_texts, stored
from .repeats import repeat_filter
from .super_kmers import (Scheme, covered_ranges, in_buckets, keyed_texts, minimiser_hashes, per_bucket, string_name,
                          string_rows, with_ranges)

WORDS = 35
MINIMISER = 8
FILTER_BITS = 28             # 32 MB


def _once(_):
    return (1,)


def _twice_at_most(a, b):
    return (min(2, a[0] + b[0]),)


def repeated_windows(strings: dict[bytes, tuple], k: int) -> list[np.ndarray]:
    """For each word string, which of its k-word windows occur twice or more among all (a string counts its number)."""
    ids: dict[bytes, int] = {}
    words = [[ids.setdefault(w, len(ids)) for w in s.split()] for s in strings]
    flat = np.array([x for w in words for x in w], np.int64)
    n_windows = np.array([len(w) - k + 1 for w in words])
    begin = np.concatenate([[0], np.cumsum([len(w) for w in words])[:-1]]).astype(np.int64)
    owner = np.repeat(np.arange(len(words)), n_windows)
    at = begin[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    weight = np.array([n[0] for n in strings.values()])[owner]
    group = _equal_groups(flat, at, k)
    total = np.bincount(group, weights=weight)
    return np.split(total[group] > 1, np.cumsum(n_windows)[:-1])


def _equal_groups(flat: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Group number of every window flat[a:a+k]; equal numbers mean equal windows, exactly."""
    key = np.zeros(len(at), np.uint64)
    for i in range(k):
        key = key * np.uint64(0x9E3779B97F4A7C15) + flat[at + i].astype(np.uint64) + np.uint64(1)
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    group = np.empty(len(at), np.int64)
    group[order] = np.cumsum(new) - 1
    first = order[new][group]                       # the first window of the same sum
    other = np.flatnonzero(first != np.arange(len(at)))
    for i in range(k):
        if (flat[at[other] + i] != flat[at[first[other]] + i]).any():
            return np.unique(flat[at[:, None] + np.arange(k)], axis=0, return_inverse=True)[1].ravel()
    return group


def _solve(k: int):
    def run(strings):
        names, masks = [], []
        for s, hit in zip(strings, repeated_windows(strings, k)):
            if hit.any():
                names.append(string_name(s))
                masks.append(sum(1 << int(i) for i in np.flatnonzero(hit)))
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(masks, pa.int64())], ["string", "mask"])
    return run


def repeated_ranges(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """doc_id, fp, cut_from, cut_to (word positions, end exclusive) of the documents with a repeated window."""
    repeats = repeat_filter(docs, minimiser_hashes(scheme), scheme.filter_bits)
    masks = stored(in_buckets(docs, scheme, repeats, _once, _twice_at_most)
                   .mapInArrow(per_bucket(_solve(scheme.k), _twice_at_most), "string binary, mask long"), "repeated-windows")
    rows = keyed_texts(docs).mapInArrow(string_rows(scheme, repeats), "doc_id long, fp long, first long, string binary")
    return stored(covered_ranges(rows.join(masks, "string").select("doc_id", "fp", "first", "mask"), scheme.k), "repeated-ranges")


def _cut_words(batches):
    for b in batches:
        out = []
        for doc_id, raw, a, z in zip(b.column(0).to_pylist(), raw_texts(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist()):
            words, kept, at, gone = raw.split(), [], 0, 0
            for x, y in zip(a or (), z or ()):
                kept += words[at:x]
                at, gone = y, gone + y - x
            text = b" ".join(kept + words[at:])
            out.append((doc_id, text.decode(), len(words), gone, hashlib.sha256(text).hexdigest()))
        cols = list(zip(*out)) or [()] * 5
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                         ["doc_id", "text", "n_words", "n_removed", "kept_sha256"])


def remove_repeated_windows(docs: DataFrame, k: int = WORDS, m: int = MINIMISER, filter_bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, text (the kept words, joined by one space), n_words, n_removed, kept_sha256, one row per document.

    Windows are judged on the input; a repeated row makes all its windows occur elsewhere. Texts of fewer than
    ``k`` words have no window and stay. Null text: no words. No rows: no rows.
    """
    cut = with_ranges(docs, repeated_ranges(docs, Scheme(k, m, True, filter_bits)))
    return cut.mapInArrow(_cut_words, "doc_id long, text string, n_words long, n_removed long, kept_sha256 string")
