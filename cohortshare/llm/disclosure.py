"""Personal data by patterns, and information-theoretic sanitisation of what reveals it. DataFrame functions only.

Base: email, ip, card and phone spans, leftmost and non-overlapping per kind. The patterns are written so that a
search is linear and needs no deep stack: loops are possessive, and a search can start only where a run of the
pattern's characters starts.

Method: a found value is a protected entity e. Terms t (runs of three or more letters) within ``CONTEXT`` characters
of its mentions are weighed against the whole corpus. With n(.) counting distinct texts of N,

    disclosure(t, e) = log(N n(t, e) / (n(t) n(e))) / log(N / n(e)),

the share of e's information content that t gives away: 1 if every text with t has e beside it. A term at or above the
threshold, seen beside e in at least ``SUPPORT`` distinct texts, is a span of kind ``term`` wherever the word stands,
in all documents: it gives e away without e beside it too.
Contexts are bounded, so pairs (t, e) are as many as mentions times a constant; they are counted by partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, small_or_shuffled, stored

CONTEXT = 120            # characters on each side of a mention
SUPPORT = 3              # distinct texts in which a term stands beside an entity
THRESHOLD = 0.95         # share of the entity's information
BROADCAST_TERMS = 50_000

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
TERM = r"\p{L}{3,}"
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """Luhn check of a non-empty string of digits."""
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(
        i % 2 == 1, 2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: Column, match: Column) -> Column:
    n = F.length(digits_of(match))
    return (F.when(kind == "ip", match.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"))
            .when(kind == "card", n.between(13, 19) & passes_luhn(digits_of(match)))
            .when(kind == "phone", n.between(9, 15)).otherwise(F.lit(True)))


SHORTEST = 4             # characters of the shortest match of any pattern


def _matches(text: Column, kind: str) -> Column:
    """[(kind, place among the matches, match, characters before it since the last match, contexts)] of one pattern.

    A context is text beside the match, neighbour matches included: so many of them as fill it at their shortest.
    """
    n, reach = CONTEXT + 1, (CONTEXT + 1) // SHORTEST + 1
    pieces = F.arrays_zip(F.split(text, PATTERNS[kind], -1).alias("o"), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)).alias("m"))

    def ends(take):
        return lambda x: F.concat(take(x["o"], F.lit(n)), F.coalesce(take(x["m"], F.lit(n)), F.lit("")))

    def near(p):
        """p: the pieces and their ends, held once for all matches."""
        def row(x, i):
            before = F.array_join(F.slice(p["last"], F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach))), "")
            left = F.right(F.concat(before, F.right(x["o"], F.lit(n))), F.lit(n))
            right = F.left(F.array_join(F.slice(p["first"], i + 2, F.lit(reach + 1)), ""), F.lit(n))
            ok = valid(F.lit(kind), x["m"])
            return F.struct(
                F.lit(kind).alias("kind"), i.alias("i"), x["m"].alias("match"), F.length(x["o"]).cast("long").alias("gap"),
                F.when(ok, F.right(left, F.lit(CONTEXT))).alias("left"), F.when(ok, F.left(right, F.lit(CONTEXT))).alias("right"),
                (F.length(left) > CONTEXT).alias("more_left"), (F.length(right) > CONTEXT).alias("more_right"))
        return F.filter(F.transform(p["pieces"], row), lambda x: x["match"].isNotNull())
    def held(z):
        return F.struct(z.alias("pieces"), F.transform(z, ends(F.right)).alias("last"), F.transform(z, ends(F.left)).alias("first"))
    found = F.get(F.transform(F.transform(F.array(pieces), held), near), F.lit(0))
    return F.when(text.rlike(PATTERNS[kind]), found)


def mentions(docs: DataFrame) -> DataFrame:
    """doc_id, fp, kind, match, start, end (code points) and the contexts of every valid base span, as a stored table."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("fp"), text.alias("text"))
    every = F.flatten(F.array_compact(F.array(*(_matches(F.col("text"), k) for k in KINDS))))
    found = stored(rows.select("doc_id", "fp", F.explode_outer(every).alias("x")).where(F.col("x").isNotNull())
                   .select("doc_id", "fp", "x.*"), "pii-matches")
    key = ["doc_id", "fp", "kind"]
    so_far = Window.partitionBy(*key).orderBy("i")
    size = F.length("match").cast("long")
    placed = (found.repartition("doc_id", "fp").dropDuplicates([*key, "i"])
              .withColumn("end", F.sum(F.col("gap") + size).over(so_far)).withColumn("start", F.col("end") - size))
    out = stored(placed.where(valid(F.col("kind"), F.col("match"))), "pii-mentions")
    discard(found)
    return out


def _context_terms(side: str) -> Column:
    """The whole terms in one context."""
    cut = (F.when(F.col("more_left"), F.regexp_replace(side, r"^\p{L}+", "")) if side == "left"
           else F.when(F.col("more_right"), F.regexp_replace(side, r"(?<!\p{L})\p{L}+\z", "")))
    return F.regexp_extract_all(F.coalesce(cut, F.col(side)), F.lit(TERM), F.lit(0))


def with_entity(found: DataFrame) -> DataFrame:
    """Mentions with the protected entity they name: the kind and the value without its formatting."""
    plain = (F.when(F.col("kind") == "email", F.lower("match")).when(F.col("kind") == "ip", F.col("match"))
             .otherwise(digits_of(F.col("match"))))
    return found.withColumn("entity", F.concat(F.col("kind"), F.lit(":"), plain))


def beside(found: DataFrame) -> DataFrame:
    """fp, entity, term of every term in a mention's contexts."""
    terms = F.array_distinct(F.transform(F.concat(_context_terms("left"), _context_terms("right")), F.lower))
    return with_entity(found).select("fp", "entity", F.explode(terms).alias("term"))


def revealing_terms(docs: DataFrame, near: DataFrame, found: DataFrame, threshold: float, support: int) -> DataFrame:
    """(doc_id, fp, term) of every document with a term that is at or above the threshold for some entity.

    Counts are of distinct texts of all documents.
    """
    fp = F.xxhash64(F.col("text").cast("string")).alias("fp")
    n = docs.select(fp).distinct().count()

    def share(n_t):
        """What a term of ``n_t`` texts gives away; less, the more texts have it."""
        return F.log(n * F.col("n_te") / (n_t * F.col("n_e"))) / F.log(n / F.col("n_e"))
    n_te = (near.select("entity", "term", "fp").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_te"))
            .where(F.col("n_te") >= support))
    n_e = (with_entity(found).select("entity", "fp").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
           .where(F.col("n_e") < n))
    # the texts with the term beside some entity are among all its texts: too many of them rule the term out already
    n_near = near.select("term", "fp").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_near"))
    pairs = stored(n_te.join(n_e, "entity").join(n_near, "term").where(share(F.col("n_near")) >= threshold), "pii-pairs")
    wanted = small_or_shuffled(stored(pairs.select("term").distinct(), "pii-terms"), BROADCAST_TERMS)
    words = F.array_distinct(F.transform(F.regexp_extract_all(F.col("text").cast("string"), F.lit(TERM), F.lit(0)), F.lower))
    held = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fp, F.explode(words).alias("term")).join(wanted, "term"),
                  "pii-held")
    n_t = held.select("fp", "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    reveal = stored(pairs.join(n_t, "term").where(share(F.col("n_t")) >= threshold).select("term").distinct(), "pii-revealing")
    return held.join(small_or_shuffled(reveal, BROADCAST_TERMS), "term").select("doc_id", "fp", "term")


def _held(value: Column, use) -> Column:
    """``use`` of a value that is computed once for the row, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _term_places(text: Column, terms: Column) -> Column:
    """[(start, end)] of the words of ``text`` that are among ``terms``; linear in the text."""
    chars = F.split(text, "")

    def places(h):
        letter = F.transform(h["chars"], lambda c: c.rlike(r"^\p{L}"))
        def edges(z):
            at = F.sequence(F.lit(0), F.size(z["letter"]))
            def is_letter(i):
                return F.coalesce(F.get(z["letter"], i), F.lit(False))
            return F.struct(F.filter(at, lambda i: is_letter(i) & ~is_letter(i - 1)).alias("starts"),
                            F.filter(at, lambda i: ~is_letter(i) & is_letter(i - 1)).alias("ends"))
        runs = _held(F.struct(letter.alias("letter")), edges)
        long_runs = _held(runs, lambda r: F.filter(F.arrays_zip(r["starts"].alias("start"), r["ends"].alias("end")),
                                                   lambda x: x["end"] - x["start"] >= 3))
        return F.filter(long_runs, lambda x: F.array_contains(
            h["terms"], F.lower(F.array_join(F.slice(h["chars"], x["start"] + 1, x["end"] - x["start"]), ""))))
    return _held(F.struct(chars.alias("chars"), terms.alias("terms")), places)


def personal_spans(docs: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """(doc_id, fp, spans, stretches) of every document with a base span or a revealing term, as a stored table.

    ``spans``: [(k, start, end, kind)] by kind and start; a term that overlaps a base span is none. ``stretches``: [(start,
    end, kind)] of overlapping spans put together, with the kind of the one that starts first.
    """
    found = mentions(docs)
    near = stored(beside(found), "pii-contexts")
    terms = stored(revealing_terms(docs, near, found, threshold, support).groupBy("doc_id", "fp").agg(F.collect_set("term").alias("terms")),
                   "pii-document-terms")
    named = (_join_documents(docs, terms, F.size("terms"), "inner", []).select("doc_id", "fp", F.explode(_term_places(F.col("text"), F.col("terms"))).alias("x"))
             .select("doc_id", "fp", F.lit("term").alias("kind"), F.col("x.start").cast("long").alias("start"), F.col("x.end").cast("long").alias("end"))
             .distinct())
    rank = sum((F.when(F.col("kind") == k, i).otherwise(0) for i, k in enumerate((*KINDS, "term"))), F.lit(0))
    rows = found.select("doc_id", "fp", "kind", "start", "end").unionByName(named).withColumn("k", rank)
    in_order = Window.partitionBy("doc_id", "fp").orderBy("start", F.desc("end"), "k")
    base = F.col("kind") != "term"
    before = F.max(F.when(base, F.col("end"))).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(in_order.rowsBetween(1, Window.unboundedFollowing))
    clear = (rows.withColumn("before", before).withColumn("after", after)
             .where(base | (F.coalesce(F.col("before") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("after") >= F.col("end"), F.lit(True)))))
    new = F.coalesce(F.col("start") >= F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    stretch = clear.withColumn("new", new.cast("int")).withColumn("stretch", F.sum("new").over(in_order))
    grouped = (stretch.groupBy("doc_id", "fp", "stretch")
               .agg(F.min("start").alias("from"), F.max("end").alias("to"), F.min_by("kind", F.struct(F.col("start"), -F.col("end"), F.col("k"))).alias("mask"),
                    F.collect_list(F.struct("k", "start", "end", "kind")).alias("spans"))
               .groupBy("doc_id", "fp")
               .agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"),
                    F.sort_array(F.collect_list(F.struct(F.col("from").alias("start"), F.col("to").alias("end"), F.col("mask").alias("kind")))).alias("stretches")))
    out = stored(grouped, "pii-spans")
    discard(found, near, terms)
    return out


def _join_documents(docs: DataFrame, found: DataFrame, entries: Column, how: str, columns) -> DataFrame:
    """doc_id, fp, text, ``columns`` of the documents, with the other columns of ``found`` (doc_id, fp, ...; stored)."""
    other = [c for c in found.columns if c not in ("doc_id", "fp")]
    named = small_or_shuffled(found, BROADCAST_TERMS, entries).select(F.col("doc_id").alias("s_id"), F.col("fp").alias("s_fp"), *other)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("fp"),
                       F.col("text").cast("string").alias("text"), *columns)
    return rows.join(named, rows["doc_id"].eqNullSafe(named["s_id"]) & (rows["fp"] == named["s_fp"]), how).drop("s_id", "s_fp")


def _with_spans(docs: DataFrame, spans: DataFrame, columns) -> DataFrame:
    return _join_documents(docs, spans, F.size("spans"), "left", columns)


def find_personal_data(docs: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term, one row per document.

    Spans are ``kind:start:end`` in code points, end exclusive, by kind (email, ip, card, phone, term) and start. Null
    or empty text: none. Repeated rows: equal results. No rows: no rows.
    """
    rows = _with_spans(docs, personal_spans(docs, threshold, support), [])
    def written(spans):
        spans = F.coalesce(spans, F.array().cast("array<struct<k:int,start:bigint,end:bigint,kind:string>>"))
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    def counted(kind):
        return F.coalesce(F.size(F.filter("spans", lambda x: x["kind"] == kind)), F.lit(0)).cast("long").alias(f"n_{kind}")
    count = [counted(k) for k in (*KINDS, "term")]
    return rows.select("doc_id", *count[:4], F.sha2(written(F.filter("spans", lambda x: x["k"] < len(KINDS))), 256).alias("base_sha256"),
                       written(F.col("spans")).alias("spans"), count[4])


def sanitise(docs: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """``docs`` with every span of personal data in ``text`` replaced by its kind's mask; all rows and columns stay.

    Overlapping spans become one masked stretch, with the mask of the one that starts first. ``n_chars``, if there, is
    the new text's length.
    """
    rows = _with_spans(docs, personal_spans(docs, threshold, support), [F.struct(*(F.col(c) for c in docs.columns if c != "text")).alias("row")])
    masks = F.create_map(*(F.lit(x) for kv in MASKS.items() for x in kv))

    def masked(h):
        """What stands before each stretch, the stretch's mask, and what stands after the last: every character is copied once."""
        def piece(x, i):
            at = F.coalesce(F.get(h["stretches"], i - 1)["end"], F.lit(0).cast("long"))
            return F.concat(F.array_join(F.slice(h["chars"], (at + 1).cast("int"), (x["start"] - at).cast("int")), ""), F.element_at(masks, x["kind"]))
        last = F.element_at(h["stretches"], -1)["end"]
        tail = F.slice(h["chars"], (last + 1).cast("int"), F.greatest(F.size(h["chars"]) - last, F.lit(0)).cast("int"))
        return F.concat(F.array_join(F.transform(h["stretches"], piece), ""), F.array_join(tail, ""))
    touched = F.size("stretches") > 0
    new = F.when(touched, _held(F.struct(F.split("text", "").alias("chars"), F.col("stretches")), masked)).otherwise(F.col("text"))
    kind = dict(docs.dtypes)
    def out(c):
        if c == "text":
            return new.cast(kind[c]).alias(c)
        if c == "n_chars":
            return F.when(touched, F.length(new)).otherwise(F.col("row")[c]).cast(kind[c]).alias(c)
        return F.col("row")[c].alias(c)
    return rows.select(*(out(c) for c in docs.columns))
