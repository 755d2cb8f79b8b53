import random
import re

import pytest

from cohortshare.functions import tags as tg
from cohortshare.operators import bio
from cohortshare.sources import bio_io

EX_SCHEMA = "text string, entities array<struct<start_idx:int,end_idx:int,type:string>>"


def _tags(spark, text, ents, type_map=None, drop_ws=False):
    df = spark.createDataFrame([(text, ents)], EX_SCHEMA)
    p = tg.spans_to_bio("text", "entities", type_map)
    if drop_ws:
        p = tg.drop_whitespace(p)
    return [(x.ch, x.tag) for x in df.select(p.alias("p")).first().p]


def test_spans_to_bio_rules(spark):
    tags = lambda *x, **k: " ".join(t for _, t in _tags(spark, *x, **k))
    assert tags("mild asthma today", [(5, 10, "dis")]) == " ".join(["O"] * 5 + ["B-DISEASE"] + ["I-DISEASE"] * 5 + ["O"] * 6)
    assert tags("Lima", [(0, 3, "place")]) == "O O O O"                    # a type without a label
    assert tags("cough", [(1, 5, "sym")]) == tags("cough", [(3, 2, "sym")]) == tags("cough", [(-1, 2, "sym")]) == "O O O O O"
    assert tags("gout", [(0, 2, "sym"), (1, 3, "dis")]) == "B-SYMPTOM B-DISEASE I-DISEASE I-DISEASE"    # the later span wins
    assert _tags(spark, "m s", [(0, 2, "dis")], drop_ws=True) == [("m", "B-DISEASE"), ("s", "I-DISEASE")]
    assert tags("ok", None) == "O O" and _tags(spark, "", [(0, 0, "dis")]) == []
    assert tags("flu", [(0, 2, "dis")], tg.SHORT_TYPE_MAP) == "B-DIS I-DIS I-DIS"


def _tag_at(i, text, spans, names):
    """The rule by position: the last valid span of a known type over a character decides."""
    over = [(start, names[kind]) for start, end, kind in spans if kind in names and 0 <= start <= i <= end < len(text)]
    return ("B-" if over[-1][0] == i else "I-") + over[-1][1] if over else "O"


def test_spans_to_bio_brute_force(spark):
    rnd = random.Random(5)
    rows = []
    for _ in range(300):
        n = rnd.randint(0, 12)
        text = "".join(rnd.choice("ab c") for _ in range(n))
        ents = [(rnd.randint(-1, n), rnd.randint(-1, n + 1), rnd.choice(["dis", "sym", "loc"]))
                for _ in range(rnd.randint(0, 4))]
        rows.append((text, ents))
    df = spark.createDataFrame(rows, EX_SCHEMA)
    got = df.select(tg.spans_to_bio("text", "entities").alias("p")).collect()
    for (text, ents), r in zip(rows, got):
        assert [x.tag for x in r.p] == [_tag_at(i, text, ents, tg.TYPE_MAP) for i in range(len(text))]


def test_spans_to_bio_long_text_many_spans(spark):
    rnd = random.Random(6)
    text = "".join(rnd.choice("abc ") for _ in range(60_000))
    spans = [(s, s + rnd.randint(0, 40), rnd.choice(["dis", "sym"])) for s in rnd.choices(range(59_900), k=1_500)]
    spans.append((100, 30_000, "sym"))                     # last in the list: covers all before it
    want = ["O"] * len(text)
    for start, end, kind in spans:
        want[start:end + 1] = [f"B-{tg.TYPE_MAP[kind]}"] + [f"I-{tg.TYPE_MAP[kind]}"] * (end - start)
    assert [t for _, t in _tags(spark, text, spans)] == want
    df = spark.createDataFrame([(None, [(0, 0, "dis")])], EX_SCHEMA)
    assert df.select(tg.spans_to_bio("text", "entities").alias("p")).first().p is None


LETTER = {"O": ".", "B-DIS": "D", "I-DIS": "d", "B-SYM": "S", "I-SYM": "s"}
ISLANDS = {"strict": "Dd*|Ss*", "lenient": "[Dd]d*|[Ss]s*"}


def _islands(tags, mode):
    """Entities as matches of a pattern over the tags written as letters."""
    found = re.finditer(ISLANDS[mode], "".join(LETTER[t] for t in tags))
    return [(m.start(), m.end() - 1, {"D": "DIS", "S": "SYM"}[m.group()[0].upper()]) for m in found]


@pytest.mark.parametrize("mode", ["strict", "lenient"])
def test_decode_fixtures_and_brute_force(spark, mode):
    rnd = random.Random(11)
    labels = ["O", "B-DIS", "I-DIS", "B-SYM", "I-SYM"]
    seqs = [["B-DIS", "I-DIS", "O"], ["B-DIS", "B-DIS"], ["O", "I-DIS", "I-DIS"], ["B-DIS", "I-SYM", "I-SYM"],
            ["B-DIS", "I-SYM", "I-DIS"], []] + [[rnd.choice(labels) for _ in range(rnd.randint(0, 9))]
                                                 for _ in range(400)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "sent_id long, tags array<string>")
    ents = bio.sentence_entities(df, "tags", "tags", mode, joiner=",").collect()
    got = {}
    for r in ents:
        got.setdefault(r.sent_id, []).append((r.start, r.end, r.type))
    for i, s in enumerate(seqs):
        assert sorted(got.get(i, [])) == _islands(s, mode), (s, mode)


BIO_TEXT = ("sO\nh O\ne O\na B-SYM\nc I-SYM\nh I-SYM\ne I-SYM\n; O\ng B-DIS\no I-DIS\nu I-DIS\nt I-DIS\n\n\n\n"
            "r B-SYM\nash I-SYM\n \nf B-DIS\r\nl I-DIS\r\nu I-DIS\r\n\r\n"
            "as B-DRUG\na I-DRUG")


def test_read_bio_modes(spark, tmp_path):
    p = tmp_path / "s.bio"
    p.write_text(BIO_TEXT, encoding="utf-8")
    with pytest.raises(Exception, match="malformed BIO line: sO"):
        bio_io.read_bio(spark, str(p)).collect()              # a bad line stops the default reader
    with pytest.raises(ValueError):
        bio_io.read_bio(spark, str(p), mode="drop")           # no mode loses lines
    perm = bio_io.read_bio(spark, str(p), mode="permissive").collect()
    assert sorted(x for r in perm for x in r.bad_lines) == ["sO"]
    assert sorted((" ".join(r.tokens), " ".join(r.tags)) for r in perm) == sorted([
        ("h e a c h e ; g o u t", "O O B-SYM I-SYM I-SYM I-SYM O B-DIS I-DIS I-DIS I-DIS"),
        ("r ash", "B-SYM I-SYM"), ("f l u", "B-DIS I-DIS I-DIS"), ("as a", "B-DRUG I-DRUG")])
    assert len({r.sent_id for r in perm}) == 4 and all(p.name in r.sent_id for r in perm)
    p2 = tmp_path / "u.bio"
    p2.write_text("a B-XYZ\nb O\n", encoding="utf-8")
    with pytest.raises(Exception, match="a B-XYZ"):
        bio_io.read_bio(spark, str(p2)).collect()
    assert [r.tokens for r in bio_io.read_bio(spark, str(p2), labels=None).collect()] == [["a", "b"]]


def test_bio_roundtrip_and_entities(spark, tmp_path):
    df = spark.createDataFrame([("no gout", [(3, 6, "dis")]), ("  ", []), ("r a sh", [(0, 5, "sym")])], EX_SCHEMA)
    conv = bio.convert_examples(df, type_map=tg.SHORT_TYPE_MAP)
    path = tmp_path / "out"
    bio_io.write_bio(conv, str(path))
    text = "".join(f.read_text(encoding="utf-8") for f in sorted(path.glob("part-*")))
    assert "n O\no O\ng B-DIS\no I-DIS\nu I-DIS\nt I-DIS\n\n" in text
    back = bio_io.read_bio(spark, str(path))
    got = sorted(("".join(r.tokens), " ".join(r.tags)) for r in back.collect())
    assert got == [("nogout", "O O B-DIS I-DIS I-DIS I-DIS"), ("rash", "B-SYM I-SYM I-SYM I-SYM")]
    ents = bio.sentence_entities(back, mode="strict").collect()
    assert sorted((e.type, e.text) for e in ents) == [("DIS", "gout"), ("SYM", "rash")]
    assert bio.count_examples(conv).first().n_examples == 3


def test_align_argmax_mask(spark):
    df = spark.createDataFrame([([None, 0, 0, 1, None], [3, 4])], "w array<int>, t array<int>")
    r = df.select(tg.align_labels("w", "t").alias("a"), tg.first_subword("w").alias("f"),
                  tg.align_labels("w", "t", 3).alias("c")).first()
    assert r.a == [-100, 3, -100, 4, -100] and r.f == [1, 3] and r.c == [-100, 3, -100]
    lg = spark.createDataFrame([([[0.1, 0.5, 0.5], [2.0, 1.0, 0.0]], [1, -100])], "l array<array<float>>, g array<int>")
    r = lg.select(tg.argmax_labels("l").alias("p"), tg.mask_ignored(tg.argmax_labels("l"), "g").alias("m")).first()
    assert r.p == [1, 0] and [(x.pred, x.gold) for x in r.m] == [(1, 1)]
    with pytest.raises(Exception):
        spark.createDataFrame([(["O", "B-XX"],)], "t array<string>").select(tg.encode_tags("t")).collect()


def test_prf_forms_agree(spark):
    gold = [["B-DIS", "I-DIS", "O", "B-SYM"], ["O", "I-DIS"]]
    pred = [["B-DIS", "I-DIS", "O", "O"], ["O", "I-DIS"]]
    df = spark.createDataFrame([(i, g, p) for i, (g, p) in enumerate(zip(gold, pred))],
                               "sent_id long, gold_tags array<string>, pred_tags array<string>")
    assert bio.prf_from_tags(df, mode="strict").first().n_gold == 2
    a = bio.prf_from_tags(df, mode="lenient").first()
    g = bio.sentence_entities(df, "gold_tags", "gold_tags", "lenient")
    p = bio.sentence_entities(df, "pred_tags", "pred_tags", "lenient")
    b = bio.entity_prf(g, p).first()
    assert (a.n_gold, a.n_pred, a.tp) == (b.n_gold, b.n_pred, b.tp) == (3, 2, 2)
    assert a.precision == 1.0 and abs(a.recall - 2 / 3) < 1e-12 and abs(a.f1 - 0.8) < 1e-12


def test_small_tag_helpers(spark):
    df = spark.createDataFrame([([0, 3, 4], "ab")], "ids array<int>, t string")
    r = df.select(tg.decode_tags("ids").alias("d"), tg.indices(tg.decode_tags("ids")).alias("i")).first()
    assert r.d == ["O", "B-SYM", "I-SYM"] and r.i == [0, 1, 2]
    rows = bio.char_rows(df, "t").collect()
    assert [(x.pos, x.ch) for x in rows] == [(0, "a"), (1, "b")]


def test_read_bio_crlf_separator(spark, tmp_path):
    p = tmp_path / "w.bio"
    p.write_bytes("a B-DIS\r\nb I-DIS\r\n\r\nc O\r\nd B-SYM\r\n\r\n\r\ne O".encode("utf-8"))
    got = sorted(("".join(r.tokens), " ".join(r.tags))
                 for r in bio_io.read_bio(spark, str(p), line_sep="\r\n\r\n").collect())
    assert got == [("ab", "B-DIS I-DIS"), ("cd", "O B-SYM"), ("e", "O")]
