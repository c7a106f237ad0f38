import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from embedflow.llm import confusables as C

SAME = [
    ("e\u0301", "\u00e9"), ("\u304b\u3099", "\u304c"), ("\u0435\u0308", "\u00eb"), ("e\u034f\u0301", "\u00e9"),
    ("ＡＢＣ１２", "ABC12"), ("ｶﾞｷﾞ", "ガギ"), ("é", "é"), ("が", "が"), ("a\u200bb", "ab"), ("a\u00a0b", "a b"), ("x\u3000y", "x y"), ("сора", "copa"), ("ΑΒΕ", "ABE"), ("A‑B", "A-B"), ("A－B", "A-B"),
    ("⽂書", "文書"), ("⻄口", "西口"), ("へク卜ル", "ヘクトル"), ("カ", "力"), ("e\u034f́", "é"), ("soft\u00adhyphen", "softhyphen"), ("文\ufe0e字", "文字"), ("ＡＢ-ｃ", "AB-c"), ("ｱ｡", "ア。"), ("ё", "ë"), ("ｄé", "dé"),
]
DIFFERENT = [
    ("a", "A"), ("e", "é"), ("は", "ば"), ("ば", "ぱ"), ("10⁴", "104"), ("a b", "a  b"), ("a b", "ab"), ("1", "l"), ("0", "O"), ("№", "No"), ("👩\u200d💻", "👩💻"), ("🐈\u200d⬛", "🐈⬛"), ("x−y", "x-y"), ("a.", "a。"), ("ソ", "ン"), ("あ", "ア"),
]


# Code points that show nothing, blanks, letters of other scripts and in another type
MORE = [
    *[(f"a{c}b", "ab") for c in "\u3164\u115f\u1160\uffa0\U000e0100\U000e01ef\U000e0001\U000e0041\U0001d173\u180e\x01\x7f\x9f"],
    ("a\tb", "a b"), ("\t", "\u3000"), ("ɡo", "go"), ("νet", "vet"), ("ոo", "no"), ("հi", "hi"), ("fӏat", "flat"), ("ᎪᏢᎢ", "APT"), ("ꓐꓳꓫ", "BOX"), ("Ⲕⲟ", "Ko"),
    ("𝐇𝖾𝓁𝔩𝕠", "Hello"), ("𝟕𝟟", "77"), ("𝚨", "A"), ("ℝ", "R"), ("Ⅹ", "X"), ("ﬁn", "fin"), ("Ǆ", "DŽ"), ("\u3164", ""), ("🏴x\U000e0067", "🏴x"),
]
SAME += MORE


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(a, b):
    assert C.skeleton(a) == C.skeleton(b)


DIFFERENT += [("a\nb", "a b"), ("🏴\U000e0067\U000e0062\U000e007f", "🏴\U000e0067\U000e0073\U000e007f"), ("🏴\U000e0067\U000e007f", "🏴"), ("З", "3"), ("α", "a"), ("ı", "i"), ("ⅱ", "ii"), ("𝐇", "h"), ("ﬅ", "st")]


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different_look(a, b):
    assert C.skeleton(a) != C.skeleton(b)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=20))
def test_skeleton_is_stable(text):
    once = C.skeleton(text)
    assert C.skeleton(once) == once


def brute(rows):
    rows = [(i, t) for i, t in rows if i is not None and t is not None]
    return {(min(a, b), max(a, b)) for (a, x), (b, y) in itertools.combinations(rows, 2) if a != b and x != y and C.skeleton(x) == C.skeleton(y)}


def test_pairs(spark):
    texts = ["AB", "ＡＢ", "AB", "АB", "ab", "", "\u200b", None, "x" * 50_000, "ｘ" + "x" * 49_999, "唯一", "唯一"]
    rows = [*enumerate(texts, 1), (None, "AB")]
    df = spark.createDataFrame([(i, t, "k", 0) for i, t in rows], "line_no int, text string, a string, id int")
    for parts in (1, 4096):
        got = C.look_alike_pairs(df, part_rows=parts).collect()
        assert sorted(map(tuple, got)) == sorted(brute(rows))
    classes = {r.id: (r.class_id, r.forms) for r in C.look_alike_classes(df).collect()}
    assert classes[4] == classes[1] == (1, 3) and classes[6] == classes[7] == (6, 2) and classes[12] == (11, 1) and len(classes) == 11
    assert {r.id: r.canonical for r in C.consistent_texts(df).collect()}[2] == "AB"


def test_empty(spark):
    df = spark.createDataFrame([], "line_no int, text string")
    assert C.look_alike_pairs(df).count() == C.look_alike_classes(df).count() == C.consistent_texts(df).count() == 0


def test_hot_text(spark):
    """A third of the rows is one text in one form: no pairs, and no join of it with itself."""
    df = spark.range(30_000).selectExpr("cast(id as int) line_no", "CASE WHEN id % 3 = 0 THEN 'same text' ELSE concat('t', id) END text").union(spark.sql("SELECT 40000, 'ｔ1'"))
    assert [tuple(r) for r in C.look_alike_pairs(df).collect()] == [(1, 40000)]
