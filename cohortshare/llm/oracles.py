"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from .license_index import BASE, TEMPLATES
from .line_frequency import MAX_DOCS_PER_HOST, MIN_SHARE_LEFT, MIN_WORDS_LEFT

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[ \t\n\x0B\f\r]+"


def _low(c: str) -> str:
    return f"translate({c}, '{_UP}', '{_LOW}')"


def _words(c: str) -> str:
    """Words of a text, in order."""
    return f"list_filter(regexp_split_to_array(coalesce({c}, ''), '{_GAP}'), lambda x: x <> '')"


LINE_FREQUENCY = rf"""
  WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, {_words('text')} AS w FROM documents),
  ls AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
  ln AS (SELECT r, i, line, {_words('line')} AS lw FROM ls),
  dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM ln WHERE len(lw) > 0 GROUP BY r),
  g AS (SELECT r, i, w[i:i + 4] AS gram FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
  rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
  cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY r),
  nl AS (SELECT d.r, d.source, d.text, {_low("array_to_string(lw, ' ')")} AS norm, len(lw) AS n FROM ln JOIN d USING (r) WHERE len(lw) > 0),
  common AS (SELECT source, norm FROM nl GROUP BY 1, 2 HAVING count(DISTINCT text) > {MAX_DOCS_PER_HOST}),
  gone AS (SELECT r, sum(n) AS n FROM nl JOIN common ON nl.source IS NOT DISTINCT FROM common.source AND nl.norm = common.norm GROUP BY r),
  b AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
               length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
               coalesce(cov.n, 0) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS gone
        FROM d LEFT JOIN dup USING (r) LEFT JOIN cov USING (r) LEFT JOIN gone USING (r))
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
         n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
           AND NOT (gone > 0 AND (n_words - gone < {MIN_WORDS_LEFT} OR n_words - gone < {MIN_SHARE_LEFT} * n_words)) AS kept,
         gone AS n_line_words_removed
  FROM b"""

SUFFIX = """
  WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
  g AS (SELECT r, doc_id, i, substr(h, CAST(2 * i + 1 AS BIGINT), 100) AS gram
        FROM (SELECT r, doc_id, h, unnest(range(0, CAST(length(h) / 2 AS BIGINT) - 49)) AS i FROM d WHERE length(h) >= 100)),
  f AS (SELECT gram, min(doc_id) AS lo FROM g GROUP BY gram HAVING min(doc_id) < max(doc_id)),
  hit AS (SELECT r, i FROM g JOIN f USING (gram) WHERE doc_id > lo),
  st AS (SELECT r, i, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + 50 THEN 1 ELSE 0 END AS new FROM hit),
  sp AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS s FROM st),
  cut AS (SELECT r, min(i) AS a, max(i) + 50 AS z FROM sp GROUP BY r, s),
  seg AS (SELECT d.r, a, z, h, coalesce(lag(z) OVER (PARTITION BY d.r ORDER BY a), 0) AS prev FROM cut JOIN d USING (r)),
  kept AS (SELECT r, string_agg(substr(h, CAST(2 * prev + 1 AS BIGINT), CAST(2 * (a - prev) AS BIGINT)), '' ORDER BY a)
                     || substr(any_value(h), CAST(2 * max(z) + 1 AS BIGINT)) AS k, sum(z - a) AS gone, count(*) AS n FROM seg GROUP BY r)
  SELECT doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
         sha256(unhex(coalesce(k, h))) AS kept_sha256
  FROM d LEFT JOIN kept USING (r)"""

EXACT = f"""
  WITH d AS (SELECT doc_id, {_low("coalesce(text, '')")} AS t FROM documents)
  SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
         doc_id = max(doc_id) OVER w AND row_number() OVER (PARTITION BY t, doc_id) = 1 AS kept, sha256(t) AS text_sha256
  FROM d WINDOW w AS (PARTITION BY t)"""

WINDOWS = f"""
  WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words('text')} AS w FROM documents),
  g AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS gram
        FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
  hit AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY gram) AS n FROM g) WHERE n > 1),
  cut AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM hit),
  ws AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
  kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS k FROM ws ANTI JOIN cut USING (r, p) GROUP BY r),
  gone AS (SELECT r, count(*) AS n FROM cut GROUP BY r)
  SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
  FROM d LEFT JOIN kept USING (r) LEFT JOIN gone USING (r)"""

JACCARD = f"""
  WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_words(_low('text'))} AS w FROM documents),
  s AS (SELECT DISTINCT r, array_to_string(w[i:i + 3], ' ') AS g
        FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
  n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
  i AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
  l AS (SELECT i.a, i.b FROM i JOIN n x ON x.r = i.a JOIN n y ON y.r = i.b WHERE 100 * c >= 85 * (x.n + y.n - c)),
  e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
  reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
  low AS (SELECT a AS r, min(d.doc_id) AS c FROM reach JOIN d ON d.r = reach.b GROUP BY a)
  SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id FROM d LEFT JOIN n USING (r) JOIN low USING (r)"""


def _licence() -> str:
    """Base places and templates by comparing word lists (a key phrase in place has the votes that the index asks for)."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    base = ", ".join(f"({i}, {p.split()}, '{label}')" for i, (p, label) in enumerate(BASE))
    rows = []
    for k, (label, text, phrase) in enumerate(TEMPLATES):
        t, p = text.split(), phrase.split()
        at = next(i for i in range(len(t)) if t[i:i + len(p)] == p)
        rows.append(f"({k}, '{label}', {t}, {at}, {len(p)})")
    return rf"""
  WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                    regexp_extract_all({_low("coalesce(text, '')")}, '{word}') AS w FROM documents),
  b(k, p, label) AS (VALUES {base}),
  cand AS (SELECT * FROM d WHERE list_contains(w, 'license') OR list_contains(w, 'cc') OR list_contains(w, 'licensed')
             OR list_contains(w, 'granted') OR list_contains(w, 'redistribution') OR list_contains(w, 'creative')),
  bh AS (SELECT r, i - 1 AS place, label FROM (SELECT r, w, p, label, unnest(range(1, len(w) - len(p) + 2)) AS i FROM cand, b WHERE len(w) >= len(p))
         WHERE w[i:i + len(p) - 1] = p),
  bs AS (SELECT r, count(*) AS n, min(place) AS lo, max(place) AS hi, list_sort(list(DISTINCT label)) AS labels FROM bh GROUP BY r),
  t(k, label, tw, ps, pl) AS (VALUES {', '.join(rows)}),
  al AS (SELECT r, w, label, tw, i - ps AS off FROM (SELECT r, w, label, tw, ps, pl, unnest(range(1, len(w) - pl + 2)) AS i FROM cand, t WHERE len(w) >= pl)
         WHERE w[i:i + pl - 1] = tw[ps + 1:ps + pl]),
  sc AS (SELECT r, label, len(list_filter(range(1, len(tw) + 1), lambda q: off + q - 1 >= 1 AND w[off + q - 1] = tw[q])) / len(tw) AS score FROM al),
  th AS (SELECT r, list(DISTINCT label) AS labels, max(score) AS score FROM sc GROUP BY r)
  SELECT doc_id, len(w) AS n_words, coalesce(bs.n, 0) AS n_base, bs.lo AS first_word, bs.hi AS last_word,
         coalesce(array_to_string(bs.labels, ','), '') AS base_labels,
         coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bs.labels, []), coalesce(th.labels, [])))), ','), '') AS labels,
         coalesce(th.score, 0.0) AS score
  FROM d LEFT JOIN bs USING (r) LEFT JOIN th USING (r)"""

def _clusters(clusters: int = 16, rounds: int = 3) -> str:
    """The rounds unrolled: all distances, sums and floors in SQL."""
    parts = [f"""v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
  c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v
         FROM (SELECT sha256('1:' || vec_id) AS h, v FROM v ORDER BY h, v LIMIT {clusters}))"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS (SELECT r, min(struct_pack(d := CAST(list_sum(list_transform(list_zip(v.v, k.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT),
                              c := k.c)) AS b FROM v, c{i} k GROUP BY r)""")
        if i < rounds:
            parts.append(f"""s{i} AS (SELECT c, p, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x
         FROM (SELECT a.b.c AS c, unnest(v.v) AS x, generate_subscripts(v.v, 1) AS p FROM v JOIN a{i} a USING (r)) GROUP BY c, p),
  c{i + 1} AS (SELECT k.c, coalesce(m.v, k.v) AS v FROM c{i} k LEFT JOIN (SELECT c, list(x ORDER BY p) AS v FROM s{i} GROUP BY c) m USING (c))""")
    return f"""
  WITH {', '.join(parts)}
  SELECT vec_id, CAST(b.c AS INTEGER) AS cluster, b.d AS distance, CAST(sum(b.d) OVER (PARTITION BY b.c) AS BIGINT) AS cluster_inertia,
         CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.v, ',')) AS centroid_sha256
  FROM v JOIN a{rounds} a USING (r) JOIN c{rounds} k ON k.c = a.b.c"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

SEARCH = f"""
  WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_low("coalesce(text, '')")}, '{_TERM}') AS w FROM documents),
  p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY 1, 2),
  s AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
  q AS (SELECT k, item_id, term, count(*) AS c
        FROM (SELECT k, item_id, unnest(regexp_extract_all({_low("coalesce(text, '')")}, '{_TERM}')) AS term
              FROM (SELECT row_number() OVER () AS k, * FROM benchmark)) GROUP BY ALL),
  t AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * s.n + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
        FROM (SELECT term, count(*) AS df FROM p WHERE term IN (SELECT term FROM q) GROUP BY term), s),
  m AS (SELECT r, doc_id, 100 - 25 + ((25 * len(w) * s.n) // s.l) AS m FROM d, s WHERE len(w) > 0),
  x AS (SELECT k, item_id, m.r, doc_id, CAST(sum(c * t.w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
        FROM q JOIN t USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY ALL)
  SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
  FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0) WHERE rank <= 20"""


ORACLE = {
    "op1_line_frequency": LINE_FREQUENCY,
    "op2_suffix_dedup": SUFFIX,
    "op3_license_scan": _licence(),
    "op6_exact_dedup": EXACT,
    "op8_substring_dedup": WINDOWS,
    "op9_jaccard_join": JACCARD,
    "op12_centroid_clusters": _clusters(),
    "op13_bit_sliced_search": SEARCH,
}
