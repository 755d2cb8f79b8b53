"""N-gram Jaccard join with several global token orders.

A document is the set of its distinct word shingles; two link when their sets' Jaccard similarity reaches the
threshold. Sets at or above the threshold share a token among the first |x| - ceil(t |x|) + 1 tokens of either
under *every* global order of tokens. Candidates must therefore share such a prefix token under several different
orders, at places that leave enough tokens for the overlap; the filters are intersected before the sets are compared.

* Equal texts are known by their digest first. Shingles are made of one row of each text; a bitmap of those rows' keys
  tells them in a pass over the documents, so neither texts nor shingles of copies are written or shuffled.
* A document of which fewer tokens than t |x| may occur twice has no partner. A fixed-size bitmap over a hash
  sample of all tokens settles that for most documents (``repeats``); the bound stays exact under sampling.
* Equal sets are one class. Everything further works on classes. The same test, now among the classes that are
  left, takes out more of them, a few times over.
* All orders put rare tokens first (by a count sketch) and differ in the seeds that order tokens of like counts.
* Large groups are contracted first: classes that share a minimal token are compared with the leaders of that token's
  group only, a linear number of comparisons, in a round for each of a few orders; who follows a leader has no part in
  later rounds. Candidates are then formed between different components, and pairs
  between two components are compared a few at first, and all only if those did not join the components.

Connectivity is exact: a pair of classes is left uncompared only if both are already in one component, if a filter
proves it too far apart, or if it was compared before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.passes import then
from .common import NULL_ID, discard, fresh_name, id_or_null, raw_texts, small_or_shuffled, stored, tidy
from .repeats import count_sketch, releasing, repeat_filter, seen_filter
from .super_kmers import keyed_texts, mix

SHINGLE = 4
PERCENT = 85
FILTER_BITS = 29             # 64 MB
SKETCH_BITS = 26             # 64 MB
KEPT_BITS = 27               # 16 MB
SAMPLE = 3                   # every SAMPLE-th token (by hash) enters the repeat filter
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
LEADER_KEYS = 3
LEADERS = 16                 # leaders that a class is compared with in one group
GROUP_ROWS = 2000            # rows of a leader group in one task; larger groups are split
REFILTERS = 3                # times that classes without enough shared tokens are taken out before the join
FEW_PAIRS = 4                # pairs of two components compared before all of them

_U = np.uint64


def shingle_set(raw: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit shingles of a text (A-Z lower-cased); a shorter text is one shingle, no word none.

    Every word goes through a hash of all its bytes (XXH3), so that equal tokens of different words are a matter of chance
    at 2^-64 a pair, whatever the words' length and form.
    """
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)
    n = min(size, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = out * _U(0x9E3779B97F4A7C15) + h[i:len(h) - n + 1 + i]
    return np.unique(mix(out + _U(n)))


def needed(n, percent: int):
    """Tokens of a set of n that any partner must share."""
    return -(-percent * n // 100)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sampled(tokens: np.ndarray) -> np.ndarray:
    return tokens[tokens % _U(SAMPLE) == 0]


def _sampled_tokens(size: int):
    def of(raw: bytes) -> np.ndarray:
        return mix(_sampled(shingle_set(raw, size)))
    return of


def _tokens(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<u8")


def _token_hashes(blob: bytes) -> np.ndarray:
    return mix(_tokens(blob))


def _row_keys(ident: pa.Array, fp: pa.Array) -> np.ndarray:
    """A hash of (doc_id or ``NULL_ID``, text fingerprint) of each row."""
    ident, fp = (pc.fill_null(c, NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in (ident, fp))
    return mix(mix(ident) ^ fp)


def _kept_rows(kept):
    """(doc_id, text, fp, ...) -> the rows that the bitmap ``kept`` has; a few others may pass."""
    def run(batches):
        for b in batches:
            yield b.filter(pa.array(kept.value.may_repeat(_row_keys(b.column(0), b.column(2))), pa.bool_()))
    return run


def _sets(size: int, percent: int, repeats):
    """(doc_id, text, fp, body) -> body, n, node (128-bit name of the set; none without words), tokens; no tokens where a partner is ruled out."""
    def run(batches):
        for b in batches:
            n, nodes, sets = [], [], []
            for raw in raw_texts(b.column(1)):
                s = shingle_set(raw, size)
                part = _sampled(s)
                alone = np.count_nonzero(~repeats.value.may_repeat(mix(part)))
                blob = s.astype("<u8").tobytes()
                n.append(len(s))
                nodes.append(xxhash.xxh3_128_digest(blob) if len(s) else None)
                sets.append(blob if len(s) and alone <= len(s) - needed(len(s), percent) else None)
            yield pa.RecordBatch.from_arrays([b.column(3), pa.array(n, pa.int64()), pa.array(nodes, pa.binary()),
                                              pa.array(sets, pa.binary())], ["body", "n", "node", "tokens"])
    return run


def _order(tokens: np.ndarray, level: np.ndarray, seed: int) -> np.ndarray:
    return np.lexsort((mix(tokens ^ _U(seed)), level))


def _node_hashes(nodes: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(nodes.to_pylist()), "<u8")[::2]


def _leader_keys(sketch, seed: int, followers):
    """node, tokens -> (key, node, tokens, off): the minimal shared token under a hash order; ``off`` is smallest for the
    sets whose tokens are the most common, the likely centres of a group. Nodes in the bitmap ``followers`` are left out."""
    def run(batches):
        for b in batches:
            if followers is not None:
                b = b.filter(pa.array(~followers.value.may_repeat(_node_hashes(b.column(0))), pa.bool_()))
            keys, rows, off = [], [], []
            for i, blob in enumerate(b.column(1).to_pylist()):
                t = _tokens(blob)
                level = sketch.value.level(mix(t))
                centre = -float(level.mean())
                t = t[level > 1]
                if len(t):
                    keys.append(t[int(mix(t ^ _U(seed + 1)).argmin())])
                    rows.append(i)
                    off.append(centre)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), b.column(0).take(at),
                                              b.column(1).take(at), pa.array(off, pa.float64())], ["key", "node", "tokens", "off"])
    return run


def _follow_leaders(percent: int):
    """Rows ordered by (key, part) -> links (a, b) of every class with the first of its group's leaders that it links with."""
    def run(batches):
        group, leaders = None, []
        for b in batches:
            found = []
            for key, part, node, blob in zip(*(b.column(c).to_pylist() for c in range(4))):
                if (key, part) != group:
                    group, leaders = (key, part), []
                t = _tokens(blob)
                for name, other in leaders:
                    if name == node:
                        break
                    if linked(t, other, percent):
                        found.append((name, node))
                        break
                else:
                    if len(leaders) < LEADERS:
                        leaders.append((node, t))
            cols = list(zip(*found)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary())], ["a", "b"])
    return run


def _prefixes(sketch, percent: int):
    """node, n, label, tokens -> (place of the order, token, node, n, label, place in that order) of the prefix tokens that
    another may have."""
    def run(batches):
        for b in batches:
            which, toks = [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)]
            rows, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, blob in enumerate(b.column(3).to_pylist()):
                t = _tokens(blob)
                level = sketch.value.level(mix(t))
                for o, seed in enumerate(ORDERS):
                    first = _order(t, level, seed)[:len(t) - needed(len(t), percent) + 1]
                    place = np.flatnonzero(level[first] > 1)
                    first = first[place]
                    places.append(place)
                    which.append(np.full(len(first), o, np.int32))
                    toks.append(t[first])
                    rows.append(np.full(len(first), i, np.int64))
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(which)), pa.array(np.concatenate(toks).view(np.int64)),
                                              *(b.column(k).take(at) for k in range(3)), pa.array(np.concatenate(places))],
                                             ["o", "token", "node", "n", "label", "place"])
    return run


def _compare(percent: int):
    """(a, b, tokens of a, tokens of b) -> the pairs (a, b) that link."""
    def run(batches):
        for b in batches:
            hit = [linked(_tokens(x), _tokens(y), percent) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(hit, pa.bool_()))
    return run


def connect(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Merge the components ``labels`` (node, label) along ``links`` (a, b of nodes); a stored table again.

    Smallest label of the neighbours, then the label's own label, until nothing changes; both are equi-joins with
    partial minima, so a component of any size is spread out.
    """
    a = links.join(labels.select(F.col("node").alias("a"), F.col("label").alias("x")), "a")
    ab = a.join(labels.select(F.col("node").alias("b"), F.col("label").alias("y")), "b").where("x <> y").select("x", "y")
    edges = stored(ab.unionByName(ab.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "component-edges")
    if edges.isEmpty():
        return labels
    roots = stored(edges.select(F.col("x").alias("node")).distinct().withColumn("label", F.col("node")), "component-roots")
    while True:
        near = (edges.join(roots.select(F.col("node").alias("y"), "label"), "y")
                .groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near")))
        step = roots.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("over"))
        new = stored(step.join(jump, "label", "left").select("node", F.coalesce("over", "label").alias("label"), "old"), "component-step")
        changed = new.where(F.col("label") != F.col("old")).limit(1).count()
        roots = new.select("node", "label")
        if not changed:
            break
    top = roots.select(F.col("node").alias("label"), F.col("label").alias("root"))
    return stored(labels.join(top, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "components")


def _links_of(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link; each side's set comes by an equi-join of its own."""
    a = classes.select(F.col("node").alias("a"), F.col("tokens").alias("ta"))
    b = classes.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))
    both = pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(tidy(_compare(percent)), "a binary, b binary")


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) whose components differ, with the components' names x < y."""
    p = pairs.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a")
    p = p.join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b").where("la <> lb")
    return p.select("a", "b", F.least("la", "lb").alias("x"), F.greatest("la", "lb").alias("y"))


def _still_possible(sketch, percent: int):
    """node, n, tokens -> the rows with enough tokens that another remaining class may have."""
    def run(batches):
        for b in batches:
            keep = []
            for n, blob in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                shared = np.count_nonzero(sketch.value.level(mix(_tokens(blob))) > 1)
                keep.append(bool(shared >= needed(n, percent)))
            yield b.filter(pa.array(keep, pa.bool_()))
    return run


def class_components(everyone: DataFrame, classes: DataFrame, spent: DataFrame, percent: int) -> DataFrame:
    """(node, label) of ``everyone`` (node): label names its component. ``classes``: node, n, tokens of those that may have
    partners, read from the stored table ``spent``, which goes once they are fewer."""
    for _ in range(REFILTERS):
        sketch = count_sketch(classes.select("node", "tokens"), _token_hashes, 1, SKETCH_BITS)
        classes = stored(classes.mapInArrow(releasing(sketch, _still_possible(sketch, percent)), "node binary, n long, tokens binary"),
                         "linkable-classes")
        sketch.unpersist()
        discard(spent)
        spent = classes
    labels = _linkable_components(classes, percent)
    discard(classes)
    return everyone.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def _linkable_components(classes: DataFrame, percent: int) -> DataFrame:
    sketch = count_sketch(classes.select("node", "tokens"), _token_hashes, 1, SKETCH_BITS)
    links, followers = classes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0), None
    for seed in ORDERS[:LEADER_KEYS]:                    # who follows a leader stays out of the next round: its leader stands for it
        keyed = classes.select("node", "tokens").mapInArrow(
            releasing(sketch, _leader_keys(sketch, seed, followers)), "key long, node binary, tokens binary, off double")
        heavy = keyed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).alias("parts")).where(F.col("parts") > 1)
        parted = keyed.join(heavy, "key", "left").select(
            "key", F.coalesce(F.pmod(F.xxhash64("node"), F.col("parts")), F.lit(0).cast("long")).alias("part"), "node", "tokens", "off")
        groups = parted.repartition("key", "part").sortWithinPartitions("key", "part", "off", "node")
        links = links.unionByName(stored(groups.mapInArrow(tidy(_follow_leaders(percent)), "a binary, b binary").distinct(), "leader-links"))
        if followers is not None:
            followers.unpersist()
        followers = seen_filter(links.select("b"), lambda b: _node_hashes(b.column(0)), KEPT_BITS)
    followers.unpersist()
    labels = connect(stored(classes.select("node", F.col("node").alias("label")), "classes"), links.distinct())

    posts = classes.join(labels, "node").select("node", "n", "label", "tokens").mapInArrow(
        releasing(sketch, _prefixes(sketch, percent)), "o int, token long, node binary, n long, label binary, place long")
    name = F.xxhash64("label")                           # two labels of one token count as one by chance at 2^-64 a pair
    mixed = stored(posts.groupBy("o", "token").agg(F.min(name).alias("lo"), F.max(name).alias("hi")).where("lo <> hi")
                   .select("o", "token"), "mixed-tokens")
    mixed = small_or_shuffled(mixed, 200_000)
    posts = stored(posts.join(mixed, ["o", "token"], "left_semi"), "prefix-tokens")
    sketch.unpersist()
    a, b = (posts.select("o", "token", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "place", "label"))) for s in "ab")
    # at the first token that two linked sets share, enough tokens must be left in both
    left = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    near = ((F.col("node_a") < F.col("node_b")) & (F.col("label_a") != F.col("label_b"))
            & ((100 + percent) * left >= percent * (F.col("n_a") + F.col("n_b"))))
    met = a.join(b, ["o", "token"]).where(near).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "o").distinct()
    pairs = stored(met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("orders")).where(F.col("orders") == len(ORDERS))
                   .select("a", "b"), "candidate-pairs")
    discard(posts)
    if pairs.isEmpty():
        return labels
    few = Window.partitionBy("x", "y").orderBy(F.xxhash64("a", "b"))
    first = _across(pairs, labels).withColumn("i", F.row_number().over(few)).where(F.col("i") <= FEW_PAIRS)
    labels = connect(labels, stored(_links_of(first, classes, percent), "first-links"))
    return connect(labels, stored(_links_of(_across(pairs, labels), classes, percent), "other-links"))


def _classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, n, tokens of each distinct set that may have a partner; the stored table that they are read from)."""
    some = sets.where(F.col("tokens").isNotNull()).select("node", "n", "tokens")
    several = stored(some.groupBy("node").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1).select("node"), "repeated-sets")
    if several.isEmpty():
        return some, sets
    small = small_or_shuffled(several, 200_000)
    one = some.join(small, "node", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    classes = some.join(small, "node", "left_anti").unionByName(one)
    if small is not several:
        return classes, sets
    classes = stored(classes, "shingle-classes")
    discard(sets)
    return classes, classes


def _labelled(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, n, node of every row, stored; node, label of every node). Null node: linked with nothing."""
    keyed = keyed_texts(docs).withColumn("body", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    rows = stored(keyed.select("doc_id", "fp", "body"), "document-texts")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(NULL_ID)).alias("ident"), "fp")).alias("first")
    texts = stored(rows.groupBy("body").agg(first, F.count(F.lit(1)).alias("copies")).select("body", "first.*", "copies"), "distinct-texts")
    kept, choose = None, iter
    if texts.count() < rows.count():
        kept = seen_filter(texts.select("ident", "fp"), lambda b: _row_keys(b.column(0), b.column(1)), KEPT_BITS)
        choose = releasing(kept, _kept_rows(kept))
    repeats = repeat_filter(keyed.drop("body"), _sampled_tokens(size), FILTER_BITS, choose)
    sets = stored(keyed.mapInArrow(releasing(repeats, then(choose, _sets(size, percent, repeats))),
                                   "body binary, n long, node binary, tokens binary"), "shingle-sets")
    for table in filter(None, (repeats, kept)):
        table.unpersist()
    of_text = sets.groupBy("body").agg(F.first("n").alias("n"), F.first("node").alias("node"), F.max(F.col("tokens").isNotNull()).alias("linkable"))
    node = F.when(F.col("linkable") | (F.col("copies") > 1), F.col("node")).alias("node")
    out = stored(rows.join(texts.join(of_text, "body").select("body", "n", node), "body").select("doc_id", "fp", "n", "node"), "document-sets")
    discard(rows, texts)
    everyone = out.where(F.col("node").isNotNull()).select("node").distinct()
    return out, class_components(everyone, *_classes(sets), percent)


def document_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every document (component_id: smallest linked-to doc_id).

    No word or null text: no shingles, a component of its own. Repeated rows and equal texts are linked. A null
    doc_id is larger than any number; component_id is null only where every doc_id of the component is. No rows: no rows.
    """
    sets, labels = _labelled(docs, size, percent)
    ident = F.coalesce("doc_id", F.lit(NULL_ID))
    lowest = (sets.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(ident).alias("low")).join(labels, "node")
              .groupBy("label").agg(F.min("low").alias("low")))
    root = labels.join(lowest, "label").select("node", "low")
    return (sets.join(root, "node", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), id_or_null(F.coalesce("low", ident)).alias("component_id")))


def keep_one_of_each(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The rows of ``docs`` without all but one of each group of linked documents; that with the smallest doc_id stays.

    Documents linked with nothing, those without words among them, all stay. Of repeated rows one stays.
    """
    sets, labels = _labelled(docs, size, percent)
    ident = F.coalesce("doc_id", F.lit(NULL_ID)).alias("ident")
    rows = (sets.where(F.col("node").isNotNull()).groupBy(ident, "fp", "node").agg(F.count(F.lit(1)).alias("copies"))
            .join(labels, "node"))
    best = rows.groupBy("label").agg(F.min(F.struct("ident", "fp")).alias("best"))
    verdict = rows.join(best, "label").select(
        "ident", "fp", (F.struct("ident", "fp") == F.col("best")).alias("stays"), "copies")
    out = stored(verdict.where(~F.col("stays") | (F.col("copies") > 1)), "near-copies")
    single = small_or_shuffled(out, 200_000)
    key = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("ident"), F.xxhash64(F.col("text").cast("string")).alias("fp"))
    name = fresh_name(docs.columns, "cs_key")
    keyed = docs.withColumn(name, key)

    def on(side):
        return (keyed[f"{name}.ident"] == side["ident"]) & (keyed[f"{name}.fp"] == side["fp"])
    repeated = small_or_shuffled(out.where("stays"), 200_000)
    kept = keyed.join(single, on(single), "left_anti")
    return kept.unionByName(keyed.join(repeated, on(repeated), "left_semi").dropDuplicates([name])).drop(name)
