"""Languages of documents and of their segments, in place of missing or wrong labels (problem 6)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.llm.hdlang import Profiles, segments
from quillstream.llm.strings import letters

# Three-letter codes of languages and their two-letter ones.
THREE = {"kor": "ko", "eng": "en", "jpn": "ja", "zho": "zh", "chi": "zh", "cmn": "zh", "spa": "es", "por": "pt", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de", "ind": "id", "rus": "ru"}
#: Letters of a segment (bytes of its letters) from which it counts as a sentence.
LEAST_BYTES = 9


def label(c: Column) -> Column:
    """Two-letter language of a label such as ko-KR, KOR or zh-Hans; null where it names none."""
    base = F.lower(F.regexp_extract(F.trim(c), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    two = F.create_map(*[F.lit(x) for kv in THREE.items() for x in kv])
    return F.when((base != "") & (base != "und"), F.coalesce(two[base], base))


def segment_languages(df: DataFrame, profiles: Profiles, id_col: str, fields: list[str]) -> DataFrame:
    """(id, field, segment, text, lang, confidence): a row per segment with a sentence's letters.

    Links, tags, mentions and credits are no segments. Null and empty texts have none; a document of short segments only
    has its longest one. A null id is kept.
    """
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts: list[str] = []
            spans: list[tuple[int, int]] = []
            where: list[tuple[str, int]] = []
            for row in zip(*(pdf[f"f{i}"] for i in range(len(fields)))):
                begin, parts = len(texts), []
                for field, text in zip(fields, row):
                    parts += [(field, i, s) for i, s in enumerate(segments(text))] if text else []
                long = [p for p in parts if len(letters(p[2]).encode()) >= LEAST_BYTES]
                for field, i, s in long or sorted(parts, key=lambda p: -len(p[2]))[:1]:
                    texts.append(s)
                    where.append((field, i))
                spans.append((begin, len(texts)))
            cos = profiles.cosines(texts)
            out = []
            for key, (a, b) in zip(pdf["id"], spans):
                if b > a:
                    for k, (lang, conf) in zip(range(a, b), profiles.of_card(texts[a:b], cos[a:b])):
                        out.append((key, where[k][0], where[k][1], texts[k], lang, conf))
            yield pd.DataFrame(out, columns=["id", "field", "segment", "text", "lang", "confidence"])

    picked = df.select(F.col(id_col).alias("id"), *[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)])
    return picked.mapInPandas(run, f"id {kind}, field string, segment int, text string, lang string, confidence double")


def relabelled(df: DataFrame, profiles: Profiles, id_col: str, fields: list[str], declared: str) -> DataFrame:
    """(id, lang, confidence): the languages of documents whose label is missing, wrong, or that hold several languages.

    confidence is the mean over the language's segments. Documents without text give no row. Rows of one id count as one
    document, whose label is wrong if one of theirs is.
    """
    kind = dict(df.dtypes)[id_col]
    said = df.select(F.col(id_col).alias("__id"), F.struct(F.col(id_col).alias("id"), label(F.col(declared)).alias("said")).alias("__key"), *[F.col(f) for f in fields])
    found = segment_languages(said, profiles, "__key", fields).groupBy("id.id", "id.said", "lang").agg(F.sum("confidence").alias("c"), F.count(F.lit(1)).alias("n"))
    # at most a few labels times the ten languages of the profiles
    by_id = found.groupBy("id").agg(F.collect_list(F.struct("lang", "c", "n")).alias("x"), F.collect_set("lang").alias("langs"), F.collect_set("said").alias("labels"), F.max(F.col("said").isNull()).alias("unlabelled"))
    wrong = by_id.where(F.col("unlabelled") | (F.size("langs") > 1) | (F.size(F.array_except("labels", "langs")) > 0))
    each = wrong.select("id", F.explode("x").alias("x")).groupBy("id", "x.lang").agg((F.sum("x.c") / F.sum("x.n")).alias("confidence"))
    return each.select("id", "lang", "confidence")
