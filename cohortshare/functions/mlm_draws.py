"""Draws of masked-LM rows in Arrow batches: one digest per position, everything else for a portion of a batch at a time."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa

from . import islands


def _drawn(part: pa.RecordBatch, vocab: pa.Array, probability: float, mask: str):
    """Blocks (key, block, text, prefix) -> tokens, tokens of each block, places, whether chosen, inputs.

    A digest's first three 32-bit numbers are the draws: chosen or not, which kind of input, which random token.
    """
    tokens, n = islands.characters(part.column(2))
    at = [str(i + 1).encode() for i in range(int(n.max(initial=0)))]
    digests = b"".join(md5(p + i).digest() for p, k in zip(part.column(3).cast(pa.binary()).to_pylist(), n.tolist()) for i in at[:k])
    draws = np.frombuffer(digests, ">u4").reshape(-1, 4)
    chosen = (draws[:, 0] + 0.5) / 4294967296.0 < probability
    kind = (draws[:, 1] + 0.5) / 4294967296.0
    pos = np.arange(len(tokens)) - np.repeat(islands.bounds(n)[:-1], n) + 1
    # inputs are places in (tokens, vocabulary, mask)
    place = np.where(kind < 0.9, len(tokens) + draws[:, 2].astype(np.int64) % max(len(vocab), 1), np.arange(len(tokens)))
    place = np.where(chosen, np.where(kind < 0.8, len(tokens) + len(vocab), place), np.arange(len(tokens)))
    return tokens, n, pos, chosen, pa.concat_arrays([tokens, vocab, pa.array([mask])]), place


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from islands.portions(batch, np.full(len(batch), 512), 1 << 17)


def chosen_rows(vocab: list[str], probability: float, mask: str):
    """-> (key, block, pos, label, input) of the chosen positions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(vocab, pa.string())
        for part in _portions(batches):
            tokens, n, pos, chosen, texts, place = _drawn(part, words, probability, mask)
            at = np.flatnonzero(chosen)
            row = pa.array(np.repeat(np.arange(len(n)), n)[at])
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(row), part.column(1).take(row), pa.array(pos[at], pa.int32()), tokens.take(pa.array(at)), texts.take(pa.array(place[at]))],
                [*part.schema.names[:2], "pos", "label", "input"])
    return run


def dense_rows(vocab: list[str], probability: float, mask: str, first: str, last: str):
    """-> (key, block, input_tokens, labels): all positions between ``first`` and ``last``, labels null where not chosen."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(vocab, pa.string())
        for part in _portions(batches):
            tokens, n, pos, chosen, texts, place = _drawn(part, words, probability, mask)
            ends = islands.bounds(n + 2)
            where = np.arange(len(tokens)) + 2 * np.repeat(np.arange(len(n)), n) + 1
            inputs, labels = np.full(int(ends[-1]), len(texts) + 1), np.full(int(ends[-1]), -1)
            inputs[ends[:-1]] = len(texts)
            inputs[where], labels[where] = place, np.where(chosen, np.arange(len(tokens)), -1)
            inputs = pa.concat_arrays([texts, pa.array([first, last])]).take(pa.array(inputs))
            labels = tokens.take(pa.array(labels, mask=labels < 0))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (inputs, labels))],
                                             [*part.schema.names[:2], "input_tokens", "labels"])
    return run
