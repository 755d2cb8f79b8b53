"""BIO tagging jobs: spans -> tags (X2), tags -> entities (E2/E3), entity scoring.

Every step works on array columns inside a sentence row: there is no shuffle
until the final global counts, and a long sentence costs O(length).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions import islands, passes, span_sets
from ..functions import tags as tg
from ..functions.text import chars

ENTITY_FIELDS = [StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("type", StringType()),
                 StructField("text", StringType())]


def convert_examples(df: DataFrame, text: str = "text", entities: str = "entities",
                     type_map: dict | None = None, keep_whitespace: bool = False) -> DataFrame:
    """X2 core: add ``pairs`` array<struct<ch, tag>> (white-space characters dropped)."""
    pairs = tg.spans_to_bio(text, entities, type_map)
    return df.withColumn("pairs", pairs if keep_whitespace else tg.drop_whitespace(pairs))


def count_examples(df: DataFrame) -> DataFrame:
    """D9."""
    return df.agg(F.count(F.lit(1)).alias("n_examples"))


def with_entities(df: DataFrame, tokens: str = "tokens", tags: str = "tags", mode: str = "strict",
                  out: str = "entities", joiner: str = "") -> DataFrame:
    """E2/E3 in array form: adds ``out`` array<struct<start, end, type, text>>.

    The island starts are staged as their own column; the next projection
    refers to them several times, so the optimizer keeps them computed once.
    """
    st = f"_starts_{out}"
    staged = df.withColumn(st, tg.island_starts(tags))
    return staged.withColumn(out, tg.entities_from_starts(tokens, tags, st, mode, joiner)).drop(st)


def sentence_entities(df: DataFrame, tokens: str = "tokens", tags: str = "tags", mode: str = "strict",
                      keys=("sent_id",), joiner: str = "") -> DataFrame:
    """E2/E3 as rows: (keys..., start, end, type, text).

    The islands are found in Arrow batches, for all sentences of a batch at a time: no lambda runs per
    token, and no array travels with the rows of its entities.  Where the tags are an Arrow UDF's
    result, or made by a pass (:mod:`..functions.passes`), both run in one pass and the tags stay in the
    worker.  ``tokens`` may be a text, whose characters are its tokens.  Null tags have no entity.
    """
    islands.check_mode(mode)
    if passes.is_made(df):
        fields = [*(df.schema[k] for k in keys), *ENTITY_FIELDS]

        def make(wanted):
            source, before = passes.taken(df, [*keys, tags, *([tokens] if "text" in wanted else [])])
            find = islands.of_tags(mode, len(keys), [keys.index(c) if c in keys else c for c in wanted], joiner)
            return source, passes.then(before, find)
        return passes.made(StructType(fields), make)
    find = F.arrow_udf(islands.find(mode), islands.FOUND)
    df = df.select(*keys, tokens, find(F.col(tags)).alias("_found"))
    out = StructType([*df.schema.fields[:-2], *ENTITY_FIELDS])
    return df.mapInArrow(islands.rows(joiner), out)


def entity_prf(gold: DataFrame, pred: DataFrame, keys=("sent_id",)) -> DataFrame:
    """C7 + D7: micro precision / recall / F1 over entity rows.

    A prediction is correct iff an entity with the same keys, span and type is
    in the gold set.  Each side's rows are packed where they are made, one row per key and block of
    tokens; only packs are shuffled and sorted, and the sets are compared as they pass (no join).
    """
    keyed = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    place = [F.coalesce(F.col(c).cast("long"), F.lit(span_sets.NOWHERE)).alias(c) for c in ("start", "end")]

    def packs(side: DataFrame, pred: bool) -> DataFrame:
        rows = side.select(*keyed, *place, F.col("type").cast("string").alias("type"))
        out = StructType([*rows.schema.fields[:-3], *StructType.fromDDL(span_sets.PACK).fields])
        pack = span_sets.pack(pred, [f"k{i}" for i in range(len(keyed))])
        if not passes.is_made(side):
            return rows.mapInArrow(pack, out)
        source, before = passes.taken(side, [*keys, "start", "end", "type"])       # packed where the entities are found
        return source.mapInArrow(passes.then(before, pack), out)

    both = packs(gold, False).unionByName(packs(pred, True))
    shared = both.columns[:len(keyed) + 1]
    counts = (both.repartition(*shared).sortWithinPartitions(*shared)
              .mapInArrow(span_sets.agreement(len(keyed)), "n_gold long, n_pred long, tp long"))
    counts = counts.agg(*[F.sum(c).alias(c) for c in counts.columns])
    return _prf(counts.na.fill(0))


def _prf(counts: DataFrame) -> DataFrame:
    tp, ng, np_ = F.col("tp").cast("double"), F.col("n_gold").cast("double"), F.col("n_pred").cast("double")
    prec = F.coalesce(F.try_divide(tp, np_), F.lit(0.0))
    rec = F.coalesce(F.try_divide(tp, ng), F.lit(0.0))
    f1 = F.when(prec + rec == 0, F.lit(0.0)).otherwise(F.lit(2.0) * prec * rec / (prec + rec))
    return counts.select(F.col("n_gold").cast("bigint").alias("n_gold"), F.col("n_pred").cast("bigint").alias("n_pred"),
                         F.col("tp").cast("bigint").alias("tp"), prec.alias("precision"), rec.alias("recall"),
                         f1.alias("f1"))


def prf_from_tags(df: DataFrame, gold: str = "gold_tags", pred: str = "pred_tags", mode: str = "lenient") -> DataFrame:
    """D7 when gold and predicted tags sit in the same sentence row.

    Both arrays are decoded and compared in Arrow batches; only three counts per
    batch leave them.  Tags made by a pass are compared in it and never written out.
    """
    islands.check_mode(mode)
    source, before = passes.taken(df, (gold, pred))
    counts = source.mapInArrow(passes.then(before, islands.counts(mode)), "n_gold long, n_pred long, tp long")
    return _prf(counts.agg(*[F.sum(c).alias(c) for c in counts.columns]).na.fill(0))


def metrics_from_logits(df: DataFrame, logits: str = "logits", labels: str = "labels") -> DataFrame:
    """U4: the evaluation callback.  argmax -> drop -100 positions -> tags -> P/R/F1
    (entities decoded in the scorer's default, lenient, mode)."""
    m = df.select(tg.mask_ignored(tg.argmax_labels(logits), labels).alias("m"))
    lab = tg.id2label()
    t = m.select(F.transform("m", lambda p: F.get(lab, p["gold"])).alias("gold_tags"),
                 F.transform("m", lambda p: F.get(lab, p["pred"])).alias("pred_tags"))
    return prf_from_tags(t, "gold_tags", "pred_tags", "lenient")


def char_rows(df: DataFrame, text: str = "text", keys=()) -> DataFrame:
    """One row per character with its position (the relational form of a text)."""
    return df.select(*keys, F.posexplode(chars(text)).alias("pos", "ch"))


def spans_to_bio_rows(examples: DataFrame, key: str = "ex_id", text: str = "text", entities: str = "entities",
                      type_map: dict | None = None) -> DataFrame:
    """C3 relational form of B12: characters range-joined to the valid spans of the
    same example; the last covering span (largest list index) sets the tag.

    Equal to :func:`convert_examples`' array form (tested).  The join is an
    equi-join on the example key plus a range predicate, so it never pairs rows
    of different examples.
    """
    tm = tg.map_lit(tg.TYPE_MAP if type_map is None else type_map)
    ch = examples.select(key, F.posexplode(chars(text)).alias("pos", "ch"))
    sp = (examples.select(key, F.length(text).alias("n"), F.posexplode(F.coalesce(entities, F.array()))
                          .alias("k", "e"))
          .select(key, "k", F.col("e.start_idx").alias("s"), F.col("e.end_idx").alias("en"),
                  F.element_at(tm, F.col("e.type")).alias("t"), "n")
          .where(F.col("t").isNotNull() & (F.col("s") >= 0) & (F.col("en") < F.col("n")) & (F.col("s") <= F.col("en"))))
    j = ch.join(sp, (ch[key] == sp[key]) & (ch.pos >= sp.s) & (ch.pos <= sp.en), "left")
    best = j.groupBy(ch[key].alias(key), "pos", "ch").agg(F.max_by(F.struct("s", "t"), F.col("k")).alias("b"))
    tag = (F.when(F.col("b").isNull(), F.lit("O"))
           .when(F.col("b.s") == F.col("pos"), F.concat(F.lit("B-"), F.col("b.t")))
           .otherwise(F.concat(F.lit("I-"), F.col("b.t"))))
    return best.select(key, "pos", "ch", tag.alias("tag"))


def token_rows(sentences: DataFrame, tokens: str = "tokens", tags: str = "tags", keys=("sent_id",)) -> DataFrame:
    """BIO_SENT -> BIO_TOK: one row per token (keys..., pos, ch, tag)."""
    z = F.arrays_zip(F.col(tokens).alias("ch"), F.col(tags).alias("tag"))
    return sentences.select(*keys, F.posexplode(z).alias("pos", "z")).select(
        *keys, F.col("pos").cast("int").alias("pos"), F.col("z.ch").alias("ch"), F.col("z.tag").alias("tag"))


def decode_bio_rows(tokens_df: DataFrame, mode: str = "strict", keys=("sent_id",), joiner: str = "") -> DataFrame:
    """E2/E3 over one row per token (keys..., pos, ch, tag): gaps and islands.

    A row continues the island of the previous row iff its tag is I-X and the
    previous tag is B-X or I-X; island id = running count of non-continuing
    rows.  The window is partitioned by sentence, a group bounded by one
    sentence's length; for whole sentences in one row, :func:`sentence_entities`
    needs no shuffle at all.
    """
    if mode not in ("strict", "lenient"):
        raise ValueError(f"mode must be strict or lenient, not {mode!r}")
    w = Window.partitionBy(*keys).orderBy("pos")
    prev = F.lag("tag").over(w)
    cont = F.coalesce(F.col("tag").startswith("I-") & (prev.startswith("B-") | prev.startswith("I-"))
                      & (F.substring(prev, 3, 1 << 20) == F.substring("tag", 3, 1 << 20)), F.lit(False))
    marked = tokens_df.withColumn("_brk", (~cont).cast("int"))
    marked = marked.withColumn("_isl", F.sum("_brk").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    g = marked.groupBy(*keys, "_isl").agg(
        F.min("pos").alias("start"), F.max("pos").alias("end"), F.min_by("tag", F.col("pos")).alias("t0"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ch"))), lambda x: x["ch"]), joiner)
        .alias("text"))
    keep = F.col("t0").startswith("B-")
    if mode == "lenient":
        keep = keep | F.col("t0").startswith("I-")
    return g.where(keep).select(*keys, F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"),
                                F.substring("t0", 3, 1 << 20).alias("type"), "text")
