"""Text functions. Unicode normalisation runs in Arrow UDFs; everything else is built from Spark's own functions."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.session import keep, small

# Token, tag and contact patterns, and notices of production and upload.
TOKEN = "[가-힣A-Za-z0-9]+"
HASHTAG = r"(?U)(?<![\w#])#([가-힣A-Za-z0-9_]+)"
CONTACT = r"(?iU)https?://\S+|www\.\S+|[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}"
PRODUCTION_NOTICE = (
    r"(?iU)^[\W_]*(?:출연|편집|썸네일|촬영|카메라|마이크|장비|협업\s*제안|광고\s*문의|비즈니스\s*문의|"
    r"business\s*(?:inquiries|contact)|문의\s*메일)\s*[:：]"
)
UPLOAD_NOTICE = (
    r"(?iU)(?:같이\s*보면\s*좋은\s*추천\s*영상|생방송\s*원본|방송분\s*[:：]|"
    r"(?:매주|매일).{0,30}(?:업로드|방송|공개)|구독.{0,12}좋아요|좋아요.{0,12}구독)"
)
LINE_BREAK = r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"
HANGUL = "[가-힣]"


def _distinct(values: pd.Series, f) -> pd.Series:
    """f once per distinct non-null value."""
    codes, distinct = pd.factorize(values)
    made = [f(v) for v in distinct]
    return pd.Series([None if k < 0 else made[k] for k in codes], dtype=object)


def nfkc(c: Column) -> Column:
    """Compatibility composition; null stays null."""

    @F.pandas_udf("string")
    def form(values: pd.Series) -> pd.Series:
        return _distinct(values, lambda v: v if v.isascii() else unicodedata.normalize("NFKC", v))

    return form(c)


def nfc(c: Column) -> Column:
    """Canonical composition; null stays null."""

    @F.pandas_udf("string")
    def form(values: pd.Series) -> pd.Series:
        return _distinct(values, lambda v: v if v.isascii() else unicodedata.normalize("NFC", v))

    return form(c)


def nfc_casefold(c: Column) -> Column:
    """Canonical composition, white space collapsed and trimmed, full case folding; null stays null."""

    @F.pandas_udf("string")
    def form(values: pd.Series) -> pd.Series:
        return _distinct(values, lambda v: " ".join(unicodedata.normalize("NFC", v).split()).casefold())

    return form(c)


def tokens(c: Column) -> Column:
    """Lower-case word tokens of an already composed text."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def normalized(c: Column) -> Column:
    """Tokens of a composed text, joined by one space."""
    return F.array_join(tokens(c), " ")


def lines(c: Column) -> Column:
    """Lines of a text, breaks as Python's splitlines sees them; an ending break makes no empty line."""
    return F.split(F.regexp_replace(c, f"(?:{LINE_BREAK})\\z", ""), LINE_BREAK)


def hashtags(c: Column) -> Column:
    """Tags outside of links and e-mail addresses, without the sign."""
    return F.regexp_extract_all(F.regexp_replace(c, CONTACT, "\n"), F.lit(HASHTAG), F.lit(1))


def contacts(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(CONTACT), F.lit(0))


def masked_segments(c: Column) -> Column:
    """Token strings of the stretches between links and tags; n-grams never cross a masked part."""
    open_parts = F.split(F.regexp_replace(F.regexp_replace(c, CONTACT, "\n"), HASHTAG, "\n"), LINE_BREAK)
    return F.filter(F.transform(open_parts, normalized), lambda s: s != "")


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), the value computed once per row: inside of other lambdas an expression is computed anew for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def word_ngrams(words: Column, least: int, most: int) -> Column:
    """Distinct n-grams of `least` to `most` words of a word array, joined by spaces."""

    def grams(w: Column) -> Column:
        sizes = F.when(F.size(w) >= least, F.sequence(F.lit(least), F.least(F.lit(most), F.size(w)))).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " ")))))

    return bound(words, grams)


def phrases(segment: Column, most: int) -> Column:
    """Phrases of a token string: n-grams of 2 to `most` words that hold Hangul, and single all-Hangul words of 3 letters or more."""

    def of_words(w: Column) -> Column:
        grams = F.filter(word_ngrams(w, 2, most), lambda p: p.rlike(HANGUL))
        return F.array_distinct(F.concat(grams, F.filter(w, lambda x: x.rlike("^[가-힣]{3,}$"))))

    return bound(F.split(segment, " "), of_words)


def _stretches(text: Column, n: int) -> Column:
    """All stretches of n characters of a text, repeats kept."""
    none = F.array().cast("array<string>")
    return bound(text, lambda t: F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n)))).otherwise(none))


def char_ngrams(c: Column, n: int) -> Column:
    """Character n-grams, repeats kept, of a text in lower case without white space; none of a null."""
    return F.coalesce(_stretches(F.lower(F.regexp_replace(c, r"(?U)\s+", "")), n), F.array().cast("array<string>"))


def bigram_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of character bigrams."""
    none = F.array().cast("array<string>")
    sets = F.struct(*[F.coalesce(F.array_distinct(_stretches(c, 2)), none).alias(k) for c, k in ((a, "a"), (b, "b"))])
    return bound(sets, lambda s: F.size(F.array_intersect(s["a"], s["b"])) / F.greatest(F.lit(1), F.size(F.array_union(s["a"], s["b"]))))


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity of two strings; not symmetric, so keep the order of the pair."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p, q, autojunk=False).ratio() for p, q in zip(x, y)], dtype="float64")

    return ratio(a, b)


def contains_words(text: Column, phrase: Column) -> Column:
    """Whether a token string holds another as whole words."""
    return F.instr(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" "))) > 0


# Where a title's head ends, notes in brackets, and tags.
TITLE_BAR, TITLE_NOTE, TITLE_TAG = r"(?U)\s+[|｜]\s+", r"\[[^\]]{0,80}\]|【[^】]{0,80}】", r"(?U)(?<!\w)#\S+"


def core_title(c: Column) -> Column:
    """A title's head, before the first bar between blanks, without short notes in brackets and tags, composed (NFC), white
    space collapsed."""
    head = F.element_at(F.split(nfc(c), TITLE_BAR, 2), 1)
    bare = F.regexp_replace(F.regexp_replace(head, TITLE_NOTE, " "), TITLE_TAG, " ")
    return F.regexp_replace(F.regexp_replace(bare, r"(?U)\s+", " "), "^ | $", "")


def containing(texts: DataFrame, phrases: DataFrame, text: str, phrase: str) -> DataFrame:
    """texts joined with the phrases they hold as whole words, both token strings, any number of either.

    A phrase is met by its first word or, where it has two, by its first two: an equi-join, then the whole phrase is compared.
    The phrases are broadcast where their counted size allows, else both sides are shuffled; the texts, repeated for each of
    their words, never are broadcast, though Spark, which knows only the files' sizes, may hold them for the smaller side.
    """
    head = lambda c: F.array_join(F.slice(F.split(c, " "), 1, 2), " ")

    def starts(words: Column) -> Column:
        twos = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))
        return F.array_distinct(F.concat(words, twos))

    named = keep(phrases.where(F.col(phrase) != "").withColumn("__head", head(F.col(phrase))))
    n, size = named.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
    # an empty text has one empty start, which no phrase has
    keyed = texts.withColumn("__head", F.explode(bound(F.split(F.col(text), " "), starts)))
    return keyed.hint("merge").join(small(named, n, 64 + size // max(n, 1)), "__head").where(contains_words(F.col(text), F.col(phrase))).drop("__head")


def hash_id(prefix: str, *parts: Column) -> Column:
    """A stable id: prefix and the first 20 hex digits of a SHA-256."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\u001f", *parts), 256), 1, 20))


def split_point(seed: str, key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a seeded SHA-256."""
    head = F.substring(F.sha2(F.concat(F.lit(seed + "|"), key), 256), 1, 13)
    return F.conv(head, 16, 10).cast("double") / F.lit(float(2**52))


def canonical_json(c: Column) -> Column:
    """JSON text with sorted keys and no spaces; null for what is no JSON."""

    def form(v: str) -> str | None:
        try:
            return json.dumps(json.loads(v), ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)
        except ValueError:
            return None

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return _distinct(values, form)

    return run(c)


def counted(c: Column) -> Column:
    """A count from a number or a decimal string; null for anything else."""
    return F.when(c.cast("string").rlike("^[0-9]+$"), c.cast("string").try_cast("bigint"))


def date_info(c: Column) -> Column:
    """struct(precision, date, instant): what a published-at string says and how exactly."""
    from quillstream.functions.times import instant

    day = c.rlike(r"^\d{4}-\d{2}-\d{2}$")
    at = instant(c)
    return F.struct(
        F.when(c.isNull() | (F.trim(c) == ""), "missing").when(day, "date").when(at.isNotNull(), "instant").otherwise("invalid").alias("precision"),
        F.when(day, c.try_cast("date")).alias("date"),
        at.alias("instant"),
    )


def html_escape(c: Column) -> Column:
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    for raw, escaped in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return out


def dense(c: Column) -> Column:
    """A text without white space and case (full folding); null stays null."""

    @F.pandas_udf("string")
    def form(values: pd.Series) -> pd.Series:
        return _distinct(values, lambda v: "".join(v.split()).casefold())

    return form(c)


# Quotes that are no part of what is said, wording of parody and of its denial, and credentials.
OUTER = " \t\n\r\"'“”‘’"
PARODY, NO_PARODY = r"(?i)패러디|parody", r"(?i)패러디(?:가|는|를)?\s*(?:아니|아닙|아님)|not\s+(?:a\s+)?parody"
SECRET = (
    r"(?i)\bBearer\s+\S+|\bBasic\s+[A-Za-z0-9+/=]+|\bsk-[A-Za-z0-9_-]{12,}|\bAIza[A-Za-z0-9_-]{20,}|-----BEGIN .*PRIVATE KEY-----|"
    r"https?://[^/\s]+:[^/\s]+@|[?&](?:key|api_key|token|access_token|secret)="
)


def copy_form(c: Column) -> Column:
    """What a copy detector compares: composed for compatibility, case folded, outer quotes off, white space collapsed."""

    @F.pandas_udf("string")
    def form(values: pd.Series) -> pd.Series:
        return _distinct(values, lambda v: " ".join(unicodedata.normalize("NFKC", v).casefold().strip(OUTER).split()))

    return form(c)


def says_parody(c: Column) -> Column:
    """Whether a line of the text calls it a parody without denying it."""
    return F.exists(lines(c), lambda x: x.rlike(PARODY) & ~x.rlike(NO_PARODY))


def cue_hits(c: Column, cues: str) -> Column:
    """array(struct(line, cue)): wording that points to reuse, with the number of its line."""
    per_line = F.transform(lines(c), lambda x, i: F.transform(F.regexp_extract_all(x, F.lit(cues), F.lit(0)), lambda cue: F.struct((i + 1).alias("line"), cue.alias("cue"))))
    return F.flatten(per_line)


def holds_secret(c: Column) -> Column:
    return F.coalesce(c.rlike(SECRET), F.lit(False))


def redacted(c: Column, credential: str, mark: str = "[CREDENTIAL_REDACTED]") -> Column:
    """A text with a credential replaced wherever it stands; an empty credential changes nothing."""
    return F.replace(c, F.lit(credential), F.lit(mark)) if credential else c


def mechanical(raw: Column, required: list[str], citations: str, allowed: Column) -> Column:
    """What a machine can say of an answer: not_object, missing_fields, foreign_citations or ok, the first that applies.

    raw: JSON text; citations: the key of its list of cited ids; allowed: array of the ids it may cite.
    """
    keys = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    cited = F.coalesce(F.from_json(F.get_json_object(raw, f"$.{citations}"), "array<string>"), F.array().cast("array<string>"))
    is_object = F.coalesce(F.try_parse_json(raw).isNotNull() & F.trim(raw).startswith("{"), F.lit(False))
    return (
        F.when(~is_object, "not_object").when(F.size(F.array_except(F.array(*[F.lit(k) for k in required]), keys)) > 0, "missing_fields")
        .when(F.size(F.array_except(cited, allowed)) > 0, "foreign_citations").otherwise("ok")
    )


def repeated_frame(title: Column, query: Column) -> Column:
    """struct(token, middle, frame) of a title in which a word said twice surrounds other words, else null.

    query: the same word twice, of three letters at least; the middle has ten words at most.
    """
    words = F.regexp_extract_all(query, F.lit("[가-힣A-Za-z]+"), F.lit(0))
    token = F.get(words, F.lit(0))
    ok = (F.size(words) == 2) & (token == F.get(words, F.lit(1))) & (F.length(token) >= 3)
    found = F.call_function("regexp_extract", core_title(title), F.concat(F.lit("(?U)"), token, F.lit(r"[\s,]+"), token, F.lit(r"[\s,]+(.{1,60}?)\s+"), token, F.lit(r"(?=\W|_|$)")), F.lit(1))
    middle = F.regexp_replace(found, r"^[ ,.!?_]+|[ ,.!?_]+$", "")
    return F.when(ok & (middle != "") & (F.size(F.split(middle, r"(?U)\s+")) <= 10), F.struct(token.alias("token"), middle.alias("middle"), F.concat(token, F.lit(" "), token, F.lit(" {} "), token).alias("frame")))
