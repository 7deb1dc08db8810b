"""One consistent form for text that looks the same, vectorised per distinct value (problem 2).

Steps: compatibility forms become plain letters, default-ignorable characters go, every kind of space becomes a
plain one, look-alike letters of other scripts become one letter, and the result is composed (NFC). Case is folded
for comparing (`fold=True`) or kept, for telling whether a reader sees a difference (`fold=False`).
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.session import keep

# Letters of other scripts and the letter they look like (from the public Unicode confusables data).
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХҮԌԚԜасеорхуѕіјһԁԛԝӏԍү", "ABESIJKMHOPCTYXYGQWaceopxysijhdqwlgy"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿαγινορυϲϳ", "ABEZHIKMNOPTYXCJayivopucj"))
ARMENIAN = dict(zip("ՍՕօսոհց", "UOounhg"))
KANA = dict(zip("へべぺエロニカハトタオチー", "ヘベペ工口二力八卜夕才千一"))
#: Compatibility types whose forms read as the letter itself. Circled, raised, lowered, squared and
#: fraction forms are missing on purpose: a reader sees them as different.
SAME_LETTER = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>")
#: Ignorable characters that aren't of the format category.
IGNORABLE = [0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0000, 0xE1000)]
JOINER = "‍"
#: Rows of a group from which its pairs are split.
GROUP_PART = 2000


@lru_cache(maxsize=1)
def _tables() -> tuple[dict[int, str], dict[int, str]]:
    """Character map before composing, and the look-alike map used on decomposed letters."""
    plain: dict[int, str] = {}
    for cp in [*range(0x80, 0xD800), *range(0xE000, 0x10000), *range(0x1D400, 0x1D800)]:
        c = chr(cp)
        kind, _, rest = unicodedata.decomposition(c).partition(" ")
        category = unicodedata.category(c)
        if kind in SAME_LETTER and 0x30FF < cp:
            plain[cp] = "".join(chr(int(x, 16)) for x in rest.split())
        elif kind == "<noBreak>":
            plain[cp] = "".join(chr(int(x, 16)) for x in rest.split())
        elif kind == "<compat>" and category[0] in "LN" and not 0x3131 <= cp <= 0x318E:
            full = unicodedata.normalize("NFKC", c)
            if full.isalpha():
                plain[cp] = full
        if category == "Cf" and c != JOINER:
            plain[cp] = ""
        elif category == "Zs":
            plain[cp] = " "
        elif category in ("Zl", "Zp"):
            plain[cp] = "\n"
    for cp in IGNORABLE:
        plain[cp] = ""
    for cp in (0x200B, 0xFEFF, 0xAD, 0x2060):
        plain[cp] = ""
    plain[0x85] = "\n"
    plain[ord("\t")] = " "
    alike = {ord(a): b for m in (CYRILLIC, GREEK, ARMENIAN, KANA) for a, b in m.items()}
    return plain, alike


@lru_cache(maxsize=1)
def _mapped() -> re.Pattern:
    """Finds a character that the map before composing changes, so that other texts aren't translated."""
    points, spans = sorted(_tables()[0]), []
    for cp in points:
        if spans and cp == spans[-1][1] + 1:
            spans[-1][1] = cp
        else:
            spans.append([cp, cp])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]")


def resolved(text: str) -> str:
    """Compatibility forms as plain letters, spaces as plain ones, ignorable characters gone; twice, as forms hold forms."""
    if not _mapped().search(text):
        return text
    plain = _tables()[0]
    return text.translate(plain).translate(plain)


_LONE_JOINER = re.compile("(?<![←-⯿\U0001f000-\U0001faff️\U0001f3fb-\U0001f3ff])‍|‍(?![←-⯿\U0001f000-\U0001faff])")


def canonical(text: str, fold: bool = True) -> str:
    """The consistent form of one text. With fold, case is folded and all compatibility forms (NFKC) are resolved."""
    if text.isascii():
        text = text.replace("\t", " ")
        return text.casefold() if fold else text
    alike = _tables()[1]
    if JOINER in text:
        text = _LONE_JOINER.sub("", text)
    text = resolved(text)
    text = unicodedata.normalize("NFD", unicodedata.normalize("NFC", text)).translate(alike)
    text = unicodedata.normalize("NFKC" if fold else "NFC", text)
    return unicodedata.normalize("NFC", text.casefold()).translate(alike) if fold else text


def canonical_column(c: Column, fold: bool = True) -> Column:
    """canonical() of a string column, once per distinct value of an Arrow batch; null stays null."""

    @F.pandas_udf("string")
    def form(values: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(values)
        forms = pd.Series([canonical(v, fold) for v in distinct], dtype=object)
        return pd.Series([None if k < 0 else forms[k] for k in codes], dtype=object)

    return form(c)


def same_look_pairs(df: DataFrame, id_col: str, group_col: str, fields: list[str]) -> DataFrame:
    """(id_a, id_b, field): rows of one group, id_a < id_b, whose field looks the same but isn't equal.

    Null groups and null or empty texts pair with nothing. Rows are first gathered into classes of equal text, so the
    members of a class never meet each other; a pair of classes is expanded only if their look is the same. Repeated
    ids, empty tables and columns with clashing names are fine: only the named columns are read.
    """
    long = df.select(
        F.col(id_col).alias("id"),
        F.col(group_col).alias("grp"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("x"),
    ).select("id", "grp", "x.field", "x.text").where("grp is not null and text is not null and text <> ''")
    # the form is made once; the hashes, without the texts, serve both sides
    hashed = keep(long.select("id", "grp", "field", F.xxhash64(canonical_column(F.col("text"), False)).alias("look"), F.xxhash64("text").alias("raw")).distinct())
    mixed = hashed.groupBy("grp", "field", "look").agg(F.min("raw").alias("least"), F.max("raw").alias("most"), F.count(F.lit(1)).alias("n")).where("least <> most")
    # the pairs of a hot group are split over its parts: one side once, the other in every part
    mixed = mixed.select("grp", "field", "look", F.ceil(F.col("n") / GROUP_PART).cast("int").alias("parts"))
    few = hashed.join(mixed, ["grp", "field", "look"])
    a = few.select("grp", "field", "look", F.pmod(F.xxhash64("id", "raw"), "parts").cast("int").alias("part"), F.col("raw").alias("raw_a"), F.col("id").alias("id_a"))
    b = few.select("grp", "field", "look", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("raw").alias("raw_b"), F.col("id").alias("id_b"))
    return a.join(b, ["grp", "field", "look", "part"]).where("raw_a <> raw_b and id_a < id_b").select("id_a", "id_b", "field").distinct()
