"""H4: masked-language-model training rows from a corpus.

Texts are split into characters (white space dropped, as a word-piece
tokenizer does), cut into consecutive blocks of ``max_len - 2`` tokens so the
whole text is used, and 15 % of the tokens are chosen; of those, 80 % become
``[MASK]``, 10 % a random vocabulary token and 10 % stay.  Labels exist only at
chosen positions.  Every draw is a keyed hash of (salt, doc, block, position),
so a re-run or a retried task gives the same rows; the vocabulary is the
corpus's distinct characters in byte order, a constant of the plan after a
size check (there are at most 1,114,112 code points).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions import mlm_draws
from ..functions.text import WHITESPACE_CHARS, chars, is_space_char

MLM_PROBABILITY = 0.15
MASK_TOKEN = "[MASK]"
MAX_LEN = 512
MAX_VOCAB = 2_000_000


def corpus_tokens(corpus: DataFrame, key: str = "doc_id", text: str = "text", max_len: int = MAX_LEN) -> DataFrame:
    """(key, block, pos, token): pos 1.. within a block (0 is the leading special token)."""
    toks = F.filter(chars(text), lambda c: ~is_space_char(c))
    width = max_len - 2
    t = corpus.select(key, F.posexplode(toks).alias("i", "token"))
    return t.select(key, F.floor(F.col("i") / width).cast("long").alias("block"),
                    (F.col("i") % width + 1).cast("int").alias("pos"), "token")


def corpus_vocab(corpus: DataFrame, text: str = "text", limit: int = MAX_VOCAB) -> list[str]:
    """Distinct non-space characters of the corpus in byte order (per-text distinct
    first, so the shuffle carries at most one row per text and character).
    Raises when the vocabulary exceeds ``limit``: it is broadcast."""
    v = (corpus.select(F.explode(F.array_distinct(F.filter(chars(text), lambda c: ~is_space_char(c))))
                       .alias("token")).distinct())
    got = [r.token for r in v.limit(limit + 1).collect()]
    if len(got) > limit:
        raise ValueError(f"vocabulary exceeds {limit} tokens")
    return sorted(got, key=lambda t: t.encode("utf-8"))


def _blocks(corpus: DataFrame, key: str, text: str, salt: str, max_len: int) -> tuple[DataFrame, list[str]]:
    """(key, block, text of the block, what a position's number is put behind for its digest), and the vocabulary.

    A text is cut into block strings first, so a row holds one block; the draws of its positions and the random tokens
    (places in the vocabulary, a constant of the plan) are made in Arrow batches, a digest per position.
    """
    vocab = corpus_vocab(corpus, text)
    solid = F.translate(F.col(text), "".join(WHITESPACE_CHARS), "")
    pieces = F.regexp_extract_all(solid, F.lit(f"(?s).{{1,{max_len - 2}}}"), F.lit(0))
    place = F.concat_ws("|", F.lit(salt), F.col(key).cast("string"), F.col("block").cast("string"), F.lit(""))
    blocks = (corpus.select(key, F.posexplode(pieces).alias("block", "_s"))
              .select(key, F.col("block").cast("long").alias("block"), "_s", place.alias("_p")))
    return blocks.select(key, "block", F.coalesce("_s", F.lit("")).alias("_s"), "_p"), vocab


def mlm_examples(corpus: DataFrame, key: str = "doc_id", text: str = "text", *, salt: str = "",
                 probability: float = MLM_PROBABILITY, max_len: int = MAX_LEN) -> DataFrame:
    """Sparse rows of the chosen positions: (key, block, pos, label, input).  No shuffle, no row per character."""
    blocks, vocab = _blocks(corpus, key, text, salt, max_len)
    out = StructType([*blocks.schema.fields[:2], StructField("pos", IntegerType()), StructField("label", StringType()), StructField("input", StringType())])
    return blocks.mapInArrow(mlm_draws.chosen_rows(vocab, probability, MASK_TOKEN), out)


def mlm_blocks(corpus: DataFrame, key: str = "doc_id", text: str = "text", *, salt: str = "",
               probability: float = MLM_PROBABILITY, max_len: int = MAX_LEN) -> DataFrame:
    """Dense training rows: (key, block, input_tokens, labels) with -100 semantics as NULL labels; no shuffle."""
    blocks, vocab = _blocks(corpus, key, text, salt, max_len)
    out = StructType([*blocks.schema.fields[:2], *(StructField(c, ArrayType(StringType())) for c in ("input_tokens", "labels"))])
    return blocks.mapInArrow(mlm_draws.dense_rows(vocab, probability, MASK_TOKEN, "[CLS]", "[SEP]"), out)
