"""BIO tag expressions over array columns (one sentence per row, no shuffle)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import chars, col_of, is_space_char

# The label set (id = position) and the entity type maps.
LABELS = ["O", "B-DIS", "I-DIS", "B-SYM", "I-SYM", "B-DRUG", "I-DRUG"]
TYPE_MAP = {"dis": "DISEASE", "sym": "SYMPTOM"}
SHORT_TYPE_MAP = {"dis": "DIS", "sym": "SYM"}
IGNORE = -100


def map_lit(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])


def label2id() -> Column:
    return map_lit({t: i for i, t in enumerate(LABELS)})


def id2label() -> Column:
    return F.array(*[F.lit(t) for t in LABELS])


def indices(arr: Column) -> Column:
    """[0, 1, ..., size-1]; empty for an empty array (``sequence`` would count down)."""
    return F.transform(arr, lambda x, i: i)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once (an expression named in a lambda is computed per element)."""
    return F.get(F.transform(F.array(value), use), 0)


_OPEN = "array<struct<k:int,s:int,t:string>>"
_STRETCHES = "array<struct<from:int,size:int,s:int,t:string>>"


def _stretches(ents: Column, n: Column) -> Column:
    """The text cut where a span starts or ends: each stretch with the last span in the list that covers it, or none.

    A sweep over the sorted ends keeps the spans open at a place.
    """
    ends = F.array_sort(F.flatten(F.transform(ents, lambda e, k: F.array(
        F.struct(e["s"].alias("at"), k.alias("k"), F.lit(True).alias("opens"), e["s"].alias("s"), e["t"].alias("t")),
        F.struct((e["e"] + 1).alias("at"), k.alias("k"), F.lit(False).alias("opens"), e["s"].alias("s"),
                 e["t"].alias("t"))))))

    def stretch(start, to, top):
        return F.array(F.struct(start.alias("from"), (to - start).alias("size"), top["s"].alias("s"), top["t"].alias("t")))

    def step(acc, x):
        still = F.when(x["opens"], F.array_append(acc["open"], F.struct(x["k"].alias("k"), x["s"].alias("s"), x["t"].alias("t")))
                       ).otherwise(F.filter(acc["open"], lambda o: o["k"] != x["k"]))
        done = F.when(x["at"] > acc["from"], F.concat(acc["done"], stretch(acc["from"], x["at"], F.array_max(acc["open"]))))
        return F.struct(x["at"].alias("from"), still.alias("open"), done.otherwise(acc["done"]).alias("done"))

    none = F.array().cast(_OPEN)
    start = F.struct(F.lit(0).alias("from"), none.alias("open"), F.array().cast(_STRETCHES).alias("done"))
    return F.aggregate(ends, start, step, lambda acc: F.concat(
        acc["done"], stretch(acc["from"], n, F.array_max(acc["open"]))))


def spans_to_bio(text, entities, type_map: dict | None = None) -> Column:
    """B10-B12 + C3: array<struct<ch, tag>>, one entry per character of ``text``.

    Entities of unmapped/missing type or invalid span (start < 0, end >= len,
    start > end; end inclusive) are ignored; of the others the last one in the
    list decides each character it covers.  No pass over the text is made per
    span; what the sweep carries is copied at each span's end.
    A null text gives null.
    """
    text = col_of(text)
    tm = map_lit(TYPE_MAP if type_map is None else type_map)

    def tagged(n):
        ents = F.transform(F.coalesce(col_of(entities), F.array()),
                           lambda e: F.struct(e["start_idx"].cast("int").alias("s"), e["end_idx"].cast("int").alias("e"),
                                              F.element_at(tm, e["type"]).alias("t")))
        ents = F.filter(ents, lambda e: e["t"].isNotNull() & (e["s"] >= 0) & (e["e"] < n) & (e["s"] <= e["e"]))
        return F.flatten(F.transform(_stretches(ents, n), lambda x: F.when(
            x["t"].isNull(), F.array_repeat(F.lit("O"), x["size"])).otherwise(F.transform(
                F.sequence(x["from"], x["from"] + x["size"] - 1),
                lambda i: F.concat(F.when(i == x["s"], F.lit("B-")).otherwise(F.lit("I-")), x["t"])))))
    return F.zip_with(chars(text), _let(F.length(text), tagged), lambda c, t: F.struct(c.alias("ch"), t.alias("tag")))


def drop_whitespace(pairs) -> Column:
    """Characters that strip to nothing are not emitted."""
    return F.filter(col_of(pairs), lambda p: ~is_space_char(p["ch"]))


def encode_tags(tags, failfast: bool = True) -> Column:
    """Tag -> id; an unknown tag raises (failfast) or becomes NULL."""
    m = label2id()
    if failfast:
        return F.transform(col_of(tags), lambda t: F.coalesce(
            F.element_at(m, t), F.raise_error(F.concat(F.lit("unknown tag: "), F.coalesce(t, F.lit("NULL"))))
            .cast("int")))
    return F.transform(col_of(tags), lambda t: F.element_at(m, t))


def decode_tags(ids) -> Column:
    """Id -> tag."""
    lab = id2label()
    return F.transform(col_of(ids), lambda i: F.get(lab, i))


def argmax_labels(logits) -> Column:
    """Per token the index of the largest logit; first one on ties."""
    return F.transform(col_of(logits), lambda x: (F.array_position(x, F.array_max(x)) - 1).cast("int"))


def mask_ignored(pred, gold) -> Column:
    """array<struct<pred, gold>> without the positions whose gold id is -100."""
    z = F.arrays_zip(col_of(pred).alias("pred"), col_of(gold).alias("gold"))
    return F.filter(z, lambda p: p["gold"] != F.lit(IGNORE))


def shift_right(arr) -> Column:
    """[NULL, a0, ..., a(n-2)]: the previous element at each position.

    Pair it with the array through ``zip_with``: referring to another array
    expression inside a lambda re-evaluates it per element (quadratic).
    """
    arr = col_of(arr)
    return F.slice(F.array_prepend(arr, F.lit(None)), 1, F.size(arr))


def shift_left(arr) -> Column:
    """[a1, ..., a(n-1), NULL]: the next element at each position."""
    arr = col_of(arr)
    return F.slice(F.array_append(arr, F.lit(None)), 2, F.size(arr))


def align_labels(word_ids, tags, max_len: int | None = None) -> Column:
    """Special token (NULL word id) -> -100, first piece of a word -> its tag id,
    later pieces -> -100; cut to ``max_len`` positions.  ``tags`` should be a column."""
    w = col_of(word_ids)
    t = col_of(tags)
    out = F.zip_with(w, shift_right(w), lambda x, prev: F.when(x.isNull(), F.lit(IGNORE))
                     .when(x.eqNullSafe(prev), F.lit(IGNORE))
                     .otherwise(F.get(t, x)))
    return F.slice(out, 1, max_len) if max_len else out


def first_subword(word_ids) -> Column:
    """Positions (token indices) that start a word; specials and repeats skipped."""
    w = col_of(word_ids)
    flagged = F.transform(F.zip_with(w, shift_right(w), lambda x, prev: x.isNotNull() & ~x.eqNullSafe(prev)),
                          lambda f, i: F.when(f, i))
    return F.filter(flagged, lambda i: i.isNotNull())


def truncate_tokens(tokens, max_len: int = 512, specials: int = 2) -> Column:
    """At most ``max_len - specials`` tokens."""
    return F.slice(col_of(tokens), 1, max_len - specials)


def _continues(tags: Column) -> Column:
    """cont[i]: tag i is I-X and tag i-1 is B-X or I-X (same X).

    Built with ``zip_with`` over a shifted copy, so no array is re-evaluated
    inside a lambda (which would make the step quadratic).
    """
    def f(t, prev):
        return F.coalesce(t.startswith("I-") & (prev.startswith("B-") | prev.startswith("I-"))
                          & (F.substring(prev, 3, 1 << 20) == F.substring(t, 3, 1 << 20)), F.lit(False))
    return F.zip_with(tags, shift_right(tags), f)


def island_starts(tags) -> Column:
    """Positions where a new island starts (tag i does not continue tag i-1)."""
    tags = col_of(tags)
    return F.filter(F.transform(_continues(tags), lambda c, i: F.when(~c, i)), lambda i: i.isNotNull())


def entities_from_starts(tokens, tags, starts, mode: str = "strict", joiner: str = "") -> Column:
    """Islands [start_k, start_(k+1) - 1] kept by ``mode``; see :func:`decode_bio`."""
    tokens, tags, starts = col_of(tokens), col_of(tags), col_of(starts)
    nexts = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(tags)))
    islands = F.zip_with(starts, nexts, lambda s, nx: F.struct(
        s.alias("start"), (nx - 1).alias("end"), F.get(tags, s).alias("t0")))
    if mode == "strict":
        keep = lambda e: e["t0"].startswith("B-")
    elif mode == "lenient":
        keep = lambda e: e["t0"].startswith("B-") | e["t0"].startswith("I-")
    else:
        raise ValueError(f"mode must be strict or lenient, not {mode!r}")
    return F.transform(F.filter(islands, keep), lambda e: F.struct(
        e["start"].cast("int").alias("start"), e["end"].cast("int").alias("end"),
        F.substring(e["t0"], 3, 1 << 20).alias("type"),
        F.array_join(F.slice(tokens, e["start"] + 1, e["end"] - e["start"] + 1), joiner).alias("text")))


def decode_bio(tokens, tags, mode: str = "strict", joiner: str = "") -> Column:
    """array<struct<start, end, type, text>> of entities in one sentence.

    Islands: a new one starts wherever tag i does not continue tag i-1
    (I-X after B-X/I-X).  ``strict`` keeps islands opened by ``B-`` (an orphan
    ``I-`` run is dropped, as in the inference decoder); ``lenient`` keeps every
    island opened by ``B-`` or ``I-`` (the default mode of the public scorer).
    O(n) per sentence.  ``tokens`` and ``tags`` should be column references;
    :func:`operators.bio.with_entities` also stages the island starts as a
    column so they are computed once.
    """
    return entities_from_starts(tokens, tags, island_starts(tags), mode, joiner)
