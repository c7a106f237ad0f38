"""Problem 1: text that looks the same in other characters, by confusables skeletons.

A text is decomposed, each character is replaced by the prototype of its shape, and the result is decomposed
again. Texts with equal skeletons show the same characters in the same order.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedflow.runtime import materialize

# Letters of other scripts with the shape of a Latin letter, prototype first
LATIN_SHAPES = [
    "AΑАᎪꓮ", "BΒВᏴꓐ", "CСϹᏟꓚⲤ", "DᎠꓓ", "EΕЕᎬꓰ", "FϜꓝ", "GԌᏀꓖ", "HΗНᎻꓧⲎ", "IΙІӀꓲⲒ", "JЈͿᎫꓙ", "KΚКKᏦꓗⲔ", "LԼᏞꓡ", "MΜМϺᎷꓟⲘ", "NΝꓠⲚ",
    "OΟОՕꓳⲞ", "PΡРᏢꓑⲢ", "QԚ", "RᎡᏒꓣ", "SЅՏᏚꓢ", "TΤТᎢꓔⲦ", "UՍꓴ", "VᏙꓦ", "WԜᎳꓪ", "XΧХꓫⲬ", "YΥҮᎽꓬⲨ", "ZΖᏃꓜ",
    "aаɑ", "cсϲᴄⲥ", "dԁ", "eе", "gɡց", "hһհ", "iі", "jјϳյ", "lӏ", "nո", "oоοօᴏⲟ", "pрρⲣ", "qԛզ", "sѕꜱ", "uսᴜ", "vѵνᴠ", "wԝᴡ", "xх", "yуү", "zᴢ",
]
# Kana with the shape of an ideograph, and the one kana whose two scripts look alike, prototype first
KANA_SHAPES = ["カ力", "エ工", "ロ口", "タ夕", "ト卜", "ハ八", "ニ二", "ヘへ"]
# CJK radicals without a decomposition in Unicode and the ideographs that they show
RADICALS = {
    "⺊": "卜", "⺌": "小", "⺍": "小", "⺒": "巳", "⺓": "幺", "⺛": "旡", "⺜": "日", "⺝": "月", "⺠": "民", "⺩": "王", "⺬": "示", "⺮": "竹",
    "⺶": "羊", "⺹": "耂", "⺼": "月", "⺽": "臼", "⻁": "虎", "⻄": "西", "⻅": "见", "⻆": "角", "⻉": "贝", "⻋": "车", "⻐": "钅",
    "⻑": "長", "⻒": "镸", "⻓": "长", "⻔": "门", "⻖": "阝", "⻗": "雨", "⻘": "青", "⻙": "韦", "⻚": "页", "⻛": "风", "⻜": "飞", "⻝": "食",
    "⻢": "马", "⻣": "骨", "⻤": "鬼", "⻥": "鱼", "⻦": "鸟", "⻧": "卤", "⻨": "麦", "⻩": "黄", "⻪": "黾", "⻫": "斉", "⻬": "齐", "⻭": "歯",
    "⻮": "齿", "⻯": "竜", "⻰": "龙", "⻱": "龜", "⻲": "亀",
}
# Dashes with the shape of the hyphen
HYPHENS = "‐‑﹣－⁃"
# Ranges of code points that show nothing (joiners and emoji selectors are treated apart)
INVISIBLE = [
    (0x00, 0x08), (0x0E, 0x1F), (0x7F, 0x84), (0x86, 0x9F), (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200C), (0x200E, 0x200F),
    (0x202A, 0x202C), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0D), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB), (0x1D173, 0x1D17A), (0xE0000, 0xE001F), (0xE0080, 0xE01EF),
]


def prototypes() -> dict[int, str | None]:
    """The look-alike table: the rules over Unicode's own decompositions first, then the fixed values."""
    table: dict[int, str | None] = {}
    for cp in (*range(0x2E80, 0x3001), *range(0xFF00, 0xFFF0)):
        form = unicodedata.decomposition(chr(cp))
        if form.startswith(("<wide>", "<narrow>")) or (form.startswith("<compat>") and cp < 0x3000):
            table[cp] = unicodedata.normalize("NFKD", chr(cp))
    for cp in (*range(0x2100, 0x2150), *range(0xFB20, 0xFB2A), *range(0x1D400, 0x1D800), *range(0x1FBF0, 0x1FBFA)):  # letters and digits in another type
        if unicodedata.decomposition(chr(cp)).startswith("<font>"):
            table[cp] = unicodedata.normalize("NFKD", chr(cp))
    for cp in (*range(0x1C4, 0x1CD), *range(0x1F1, 0x1F4), *range(0xFB00, 0xFB05), 0xFB06):  # letters joined in one character
        table[cp] = unicodedata.normalize("NFKD", chr(cp))
    for cp in range(0x2160, 0x2180):  # numerals in the shape of a single letter
        if len(form := unicodedata.normalize("NFKD", chr(cp))) == 1:
            table[cp] = form
    for cp in (0x09, 0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000):
        table[cp] = " "
    for first, last in INVISIBLE:
        table |= dict.fromkeys(range(first, last + 1))
    table |= {ord(c): "-" for c in HYPHENS}
    table |= {ord(k): v for k, v in RADICALS.items()}
    for shapes in (*LATIN_SHAPES, *KANA_SHAPES):
        table |= {ord(c): shapes[0] for c in shapes[1:]}
    # a form of a character that has a prototype itself
    return {k: v and "".join(table.get(ord(c)) or c for c in v) for k, v in table.items()}


_table = prototypes()
_pictures = r"[\p{Extended_Pictographic}\p{Emoji_Modifier}\p{Regional_Indicator}]"
JOINER, TEXT_STYLE, EMOJI_STYLE, KEYCAP = "\u200d", "\ufe0e", "\ufe0f", "\u20e3"
FLAG, TAG = "\U0001f3f4", "[\U000e0020-\U000e007f]"
_may_be_idle = re.compile(f"[{JOINER}{TEXT_STYLE}{EMOJI_STYLE}]|{TAG}")
_idle = regex.compile(
    "|".join(
        [
            rf"(?<!{_pictures}{EMOJI_STYLE}?){JOINER}", rf"{JOINER}(?!{_pictures})",
            rf"(?<![\p{{Extended_Pictographic}}#*0-9]){EMOJI_STYLE}", rf"(?<=[#*0-9]){EMOJI_STYLE}(?!{KEYCAP})",
            rf"(?<!\p{{Extended_Pictographic}}){TEXT_STYLE}", rf"(?<!{FLAG}{TAG}*){TAG}",
        ]
    )
)


def skeleton(text: str) -> str:
    """The text in prototypes, decomposed. Joiners, selectors and tags stay inside emoji, where they change what is seen."""
    if text.isascii() and text.isprintable():
        return text
    text = unicodedata.normalize("NFD", text).translate(_table)
    if _may_be_idle.search(text):
        text = _idle.sub("", text)
    return unicodedata.normalize("NFD", text)


def consistent_texts(df: DataFrame, id_col: str = "line_no", text_col: str = "text") -> DataFrame:
    """(id, canonical): each text in the one form that all texts of its look share.

    Null texts and null ids have no row; the empty text stays empty; an empty frame gives an empty one. Repeated
    rows are kept.
    """

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([skeleton(t) for t in b.column("t").to_pylist()], pa.string())], names=["id", "canonical"])

    kept = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("t")).where("id IS NOT NULL AND t IS NOT NULL")
    return kept.mapInArrow(rows, "id long, canonical string")


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, a, b, t): 128 bits of the skeleton's hash and 64 of the text's."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        for b in batches:
            texts = b.column("t").to_pylist()
            whole = [xxhash.xxh3_128_intdigest(skeleton(t)) for t in texts]
            a, c = [signed(h >> 64) for h in whole], [signed(h & (1 << 64) - 1) for h in whole]
            own = [signed(xxhash.xxh3_64_intdigest(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(x, pa.int64()) for x in (a, c, own))], names=["id", "a", "b", "t"])

    kept = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("t")).where("id IS NOT NULL AND t IS NOT NULL")
    return kept.mapInArrow(rows, "id long, a long, b long, t long")


def look_alike_classes(df: DataFrame, id_col: str = "line_no", text_col: str = "text") -> DataFrame:
    """(id, class_id, forms): for each text the smallest id with its look and the number of forms that look is stored in.

    Nulls, empty texts and empty frames as in consistent_texts; empty texts look alike.
    """
    keyed = materialize(_keyed(df, id_col, text_col), "looks")
    looks = keyed.groupBy("a", "b", "t").agg(F.min("id").alias("id")).groupBy("a", "b").agg(F.min("id").alias("class_id"), F.count("*").alias("forms"))
    return keyed.join(looks, ["a", "b"]).select("id", "class_id", "forms")


def look_alike_pairs(df: DataFrame, id_col: str = "line_no", text_col: str = "text", part_rows: int = 4096) -> DataFrame:
    """(a, b), a < b: the ids of every two rows whose texts differ but look the same.

    Looks with a single form, however many rows repeat it, are left out by a pre-aggregated count before any join.
    The rows of a look with more than part_rows rows are spread over several parts, each of which meets all of the
    look's rows once. Nulls and empty frames as in consistent_texts.
    """
    keyed = materialize(_keyed(df, id_col, text_col), "looks")
    several = keyed.groupBy("a", "b").agg(F.min("t").alias("low"), F.max("t").alias("high"), F.count("*").alias("n")).where("low <> high")
    several = several.select("a", "b", F.ceil(F.col("n") / part_rows).cast("int").alias("parts"))
    rows = materialize(keyed.join(several, ["a", "b"]), "several")
    left = rows.select("a", "b", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.col("id").alias("x"), F.col("t").alias("tx"))
    right = rows.select("a", "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("id").alias("y"), F.col("t").alias("ty"))
    return left.join(right, ["a", "b", "part"]).where("x < y AND tx <> ty").select(F.col("x").alias("a"), F.col("y").alias("b"))
