"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Compiled from a model file: the normaliser (white space to U+2581, dummy prefix), the lexicon of pieces as a trie whose
paths emit piece ids, and the byte fallback for characters in no piece. A text is composed with it from left to
right; the tropical shortest path (sums of weights, minima of paths) is the encoding.

* Unigram models: an arc weighs minus the piece's score.
* BPE models: merge order is expressed by arc pairs. A segmentation is the one that merging would reach if, and only
  if, merging the text of every two neighbouring pieces gives just these two; such a pair weighs 0, any other
  infinity, and one path of finite weight is left.

Where no piece holds two characters side by side, no arc crosses between them: the text is cut there, and the path
of each part is remembered in a bounded table.
"""

from __future__ import annotations

import re
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .common import id_and_text

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
CACHED_PARTS = 400_000       # parts whose ids a Python worker keeps
CACHED_PAIRS = 400_000
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6
_BPE, _UNIGRAM = 2, 1
_UNKNOWN_WEIGHT = 10.0       # beyond the worst piece, for a character that needs bytes in a unigram model


def model_path(name: str = MODEL) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class PieceTransducer:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only normalisers that keep every character but escape white space are compiled")
        self.dummy_prefix, self.bpe = spec.add_dummy_prefix, model.trainer_spec.model_type == _BPE
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (_NORMAL, _USER)}
        self.score = {p.piece: p.score for p in model.pieces if p.type in (_NORMAL, _USER)}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == _BYTE}
        byte_of = {i: bytes([b]) for b, i in self.bytes.items()}
        self.surface = pa.array([p.piece.encode() if p.type in (_NORMAL, _USER) else byte_of.get(i, b"") for i, p in enumerate(model.pieces)], pa.binary())
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == _UNKNOWN)
        self.trie: dict = {}                         # the lexicon: a character leads to [what follows, the piece that ends here]
        for piece in self.ids:
            node, at = self.trie, None
            for c in piece:
                at = node.setdefault(c, [{}, None])
                node = at[0]
            if at:
                at[1] = piece
        self.beside = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.word_parts = not any(b[1] == SPACE and b[0] != SPACE for b in self.beside)
        self.worst = max(-s for s in self.score.values()) + _UNKNOWN_WEIGHT
        self.pairs: dict = {}
        after_letter = re.escape("".join(c for c in ".,;:!?%&$#*\n" if not any(b[1] == c and b[0].isalpha() for b in self.beside)))
        self.parts_of = re.compile(f"{SPACE}*[^\\W\\d_]+(?=[{after_letter}{SPACE}]|$)|{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
        self.parts = _Parts(self)

    # ---- weights

    def merged(self, text: str) -> list[str]:
        """What merging reaches from the characters: the best-scored neighbours first, the leftmost of equals."""
        out, score = list(text), self.score.get
        gains = [score(a + b, -np.inf) for a, b in zip(out, out[1:])]
        while gains and (best := max(gains)) != -np.inf:
            i = gains.index(best)
            out[i:i + 2] = [out[i] + out[i + 1]]
            del gains[i]
            if i < len(gains):
                gains[i] = score(out[i] + out[i + 1], -np.inf)
            if i:
                gains[i - 1] = score(out[i - 1] + out[i], -np.inf)
        return out

    def weight(self, before: str | None, piece: str) -> float:
        """Weight of an arc for ``piece`` after the piece ``before`` (None: a start or a character in bytes)."""
        if not self.bpe:
            return -self.score[piece]
        found = self.pairs.get((before, piece))
        if found is None:
            if len(self.pairs) > CACHED_PAIRS:
                self.pairs.clear()
            want = [piece] if before is None else [before, piece]
            found = self.pairs[(before, piece)] = 0.0 if self.merged("".join(want)) == want else np.inf
        return found

    # ---- shortest path

    def path(self, part: str) -> bytes:
        """Ids of the shortest path through a part, as little-endian uint32 bytes."""
        n = len(part)
        cost = [np.inf] * (n + 1)
        back: list = [None] * (n + 1)                # (start, piece or None for bytes)
        cost[0] = 0.0
        bpe, known = self.bpe, self.pairs.get
        for i in range(n):
            here = cost[i]
            if here == np.inf:
                continue
            before = back[i][1] if i else None
            node, single = self.trie, False
            for j in range(i, n):
                at = node.get(part[j])
                if at is None:
                    break
                node, piece = at
                if piece is None:
                    continue
                single = single or j == i
                if bpe:                              # weights are 0 or infinite: what is reached stays
                    if cost[j + 1] <= here:
                        continue
                    w = known((before, piece))
                    w = here + (self.weight(before, piece) if w is None else w)
                else:
                    w = here + self.weight(before, piece)
                if w < cost[j + 1]:
                    cost[j + 1], back[j + 1] = w, (i, piece)
            if not single:
                w = here + (0.0 if bpe else self.worst)
                if w < cost[i + 1]:
                    cost[i + 1], back[i + 1] = w, (i, None)
        out, j = [], n
        while j:
            i, piece = back[j]
            out.append([self.ids[piece]] if piece is not None else self._byte_ids(part[i:j]))
            j = i
        return np.array([x for ids in reversed(out) for x in ids], "<u4").tobytes()

    def _byte_ids(self, text: str) -> list[int]:
        return [self.bytes[b] for b in text.encode()] if self.bytes else [self.unknown]

    def cut_path(self, part: str) -> bytes:
        cut = [0, *(i for i in range(1, len(part)) if part[i - 1:i + 1] not in self.beside), len(part)]
        if len(cut) == 2:
            return self.path(part)
        return b"".join(self.parts[part[a:z]] for a, z in zip(cut, cut[1:]))

    # ---- texts

    def normalise(self, text: str) -> str:
        return (SPACE if self.dummy_prefix and text else "") + text.replace(" ", SPACE)

    def encode(self, text: str) -> bytes:
        norm = self.normalise(text)
        parts = self.parts_of(norm) if self.word_parts else [norm] if norm else []
        return b"".join(map(self.parts.__getitem__, parts))

    def decode(self, ids) -> str:
        """Text of ids: pieces' characters, bytes put together (ill-formed ones as U+FFFD), U+2581 as a space."""
        raw = self.surface.take(pa.array(np.asarray(ids, np.int64))).buffers()[2]
        text = (raw.to_pybytes() if raw else b"").decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


class _Parts(dict):
    """Ids of parts, found on first use and kept up to a bound."""

    def __init__(self, owner: PieceTransducer):
        super().__init__()
        self.owner = owner

    def __missing__(self, part: str) -> bytes:
        if len(self) > CACHED_PARTS:
            self.clear()
        found = self.owner.cut_path(part)
        if len(part) <= 64:
            self[part] = found
        return found


@lru_cache(maxsize=2)
def transducer(path: str) -> PieceTransducer:
    return PieceTransducer(path)


def _encode(path: str):
    def run(batches):
        t = transducer(path)
        for b in batches:
            ids = [np.frombuffer(t.encode(x or ""), "<u4").astype(np.int32) for x in b.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int32), *ids])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(offsets, pa.array(flat))],
                                             ["doc_id", "text", "ids"])
    return run


def encode_texts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text, ids (array of int) of every document; null and empty texts have no ids. No rows: no rows."""
    return id_and_text(docs).mapInArrow(_encode(path or model_path()), "doc_id long, text string, ids array<int>")


def _decode(path: str):
    def run(batches):
        t = transducer(path)
        for b in batches:
            ids = b.column(b.schema.get_field_index("ids")).to_pylist()
            texts = pa.array([None if x is None else t.decode(x) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], [*b.schema.names, "decoded"])
    return run


def decode_ids(coded: DataFrame, path: str | None = None) -> DataFrame:
    """``coded`` with one more column ``decoded``, the text of its ``ids``; null ids give null."""
    return coded.mapInArrow(_decode(path or model_path()), StructType([*coded.schema.fields]).add("decoded", "string"))


def _check(path: str):
    def run(batches):
        t = transducer(path)
        for b in batches:
            n, crc, same = [], [], []
            for text in b.column(1).to_pylist():
                ids = t.encode(text or "")
                n.append(len(ids) // 4)
                crc.append(crc32(ids))
                same.append(t.decode(np.frombuffer(ids, "<u4")) == (text or "").replace(SPACE, " "))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())],
                                             ["doc_id", "n_ids", "ids_crc32", "round_trip"])
    return run


def encode_and_check(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian uint32 ids), round_trip (decoding gives the text; U+2581 reads as a space).

    Encodes and decodes in one pass, so that a task needs one Python worker. Null text: empty. No rows: no rows.
    """
    return id_and_text(docs).mapInArrow(_check(path or model_path()), "doc_id long, n_ids long, ids_crc32 long, round_trip boolean")
