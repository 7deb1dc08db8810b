"""Text decoded with the wrong character encoding: found, its encoding chain predicted, and restored (problem 10).

A multinomial classifier over hashed byte bigrams is trained on records garbled on purpose by every known chain and on
clean ones. It judges runs of words that hold non-ASCII characters. The chains it holds likeliest are inverted, likeliest
first; a restoration counts only if every byte decodes strictly and the result reads as clean text. Runs that lost bytes
can't be restored; they are reported if the classifier is sure of them.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
#: Most labelled samples the classifier is fit on.
FIT_SAMPLES = 20_000
# Chains as (true encoding, encoding it was read with, times).
CHAINS = (
    [("utf-8", r, 1) for r in ("cp1252", "latin-1", "cp1250", "cp1251", "cp1254", "cp437", "cp850", "cp866", "mac_roman", "koi8_r", "cp949", "gbk", "cp932", "big5", "iso8859_15")]
    + [("utf-8", "cp1252", 2), ("utf-8", "latin-1", 2), ("utf-8", "cp1252", 3), ("utf-8", "mac_roman", 2)]
    + [("cp949", r, 1) for r in ("cp1252", "latin-1", "mac_roman", "gbk", "cp932", "cp437", "cp1251")]
    + [("cp932", r, 1) for r in ("cp1252", "latin-1", "cp949", "gbk", "mac_roman", "cp437")]
    + [("euc_jp", r, 1) for r in ("cp1252", "cp949", "gbk")]
    + [("gbk", r, 1) for r in ("cp1252", "latin-1", "cp949", "cp932", "mac_roman", "cp437")]
    + [("big5", r, 1) for r in ("cp1252", "gbk", "cp949")]
    + [("cp1251", r, 1) for r in ("cp1252", "latin-1", "koi8_r", "cp866", "mac_roman", "cp949")]
    + [("koi8_r", r, 1) for r in ("cp1252", "cp1251", "latin-1")]
    + [("cp866", r, 1) for r in ("cp1251", "cp1252")]
    + [("cp1252", r, 1) for r in ("mac_roman", "cp437", "cp850", "cp1251", "cp949")]
)
# Marks that stand in clean text, beside letters; kaomoji and signs that look odd but are meant.
CLEAN_MARKS = "¥ £5 25 °C § 3 ±0 ½ ¼ « » © ® ™ × ÷ · • – — ‘ ’ “ ” … € № ¿ ¡ ª º µ ¹²³ (ง •̀_•́)ง (´∀｀) (°ロ°) ʕ•ᴥ•ʔ ¯\\_(ツ)_/¯ (╯°□°)╯︵ ┻━┻ ♥ ★ ☆ → ← ↑ ↓ ✓ ✨ ❤️ 😂 🤣 😹 🔥 🎬 🙏🏽 🇰🇷 👨‍👩‍👧 ㅋㅋㅋ ㅠㅠ ㅎㅎ"
PUNCTUATED = " — “café” … ", " — “it’s fine” … ", " ñandú, ça va, Größe, São, señor "
#: Non-ASCII runs: words with such characters, with at most one plain word between two of them.
_RUN = re.compile(r"[^ \t\r\n]*[^\x00-\x7f][^ \t\r\n]*(?: (?:[^ \t\r\n]{1,12} )?[^ \t\r\n]*[^\x00-\x7f][^ \t\r\n]*)*")
_WORD = re.compile(r"[^ \t\r\n]*[^\x00-\x7f][^ \t\r\n]*")
#: Log odds, and gain in clean likelihood, from which a run counts as garbled; odds that do beside a restoration by UTF-8;
#: more per bigram where nothing is restored; counts added to each class.
SURE, LIKELY, LOST_PER_BIGRAM, LEAST_LOST, SMOOTH = 6.0, -8.0, 0.3, 16, 400.0
#: Log odds of the first fit, whose finds aren't counted: higher, so that what many documents hold is learnt as clean.
FIRST_SURE = 8.0
#: Share of the documents that a character is in to count as usual.
USUAL = 0.01
#: Pieces of a word: stretches of CJK, kana and hangul up to a sentence's end, and stretches of anything else.
_PIECE = re.compile("[\u1100-\u11ff\u2e80-\u303f\u3040-\ud7ff\uf900-\ufaff\uff00-\uffef0-9]+?(?:[。！？]+|(?=[^\u1100-\u11ff\u2e80-\u303f\u3040-\ud7ff\uf900-\ufaff\uff00-\uffef0-9])|$)|[^ \u1100-\u11ff\u2e80-\u303f\u3040-\ud7ff\uf900-\ufaff\uff00-\uffef]+")
#: Two odd characters side by side, as bytes of one letter leave them.
_PAIR = re.compile("[\u0080-\u00ff\u0102-\u0192\u02c6-\u02dd\u0393-\u03c6\u2013-\u26ff]{2}")
# Chains that lose bytes.
LOSSY = [("cp949", "utf-8", 1), ("cp932", "utf-8", 1), ("utf-8", "cp949", 1), ("utf-8", "gbk", 1), ("gbk", "utf-8", 1), ("cp1251", "utf-8", 1), ("utf-8", "cp932", 1), ("utf-8", "cp1252", 1)]
_SLOPPY = ("cp1252", "cp1250", "cp1251", "cp1254", "mac_roman")


def encode(text: str, codec: str) -> bytes | None:
    """Bytes of a text; the Windows codecs pass the control characters that stand for their unused bytes."""
    try:
        return text.encode(codec)
    except UnicodeEncodeError:
        if codec not in _SLOPPY[:4]:
            return None
    out = bytearray()
    for c in text:
        try:
            out += c.encode(codec)
        except UnicodeEncodeError:
            if not 0x80 <= ord(c) <= 0x9F:
                return None
            out.append(ord(c))
    return bytes(out)


def garble(text: str, chain: tuple[str, str, int], lossy: bool = False) -> str | None:
    """The text as it looks after the chain, or None where it can't be written or read so (or is unchanged)."""
    true, read, times = chain
    out = text
    for _ in range(times):
        try:
            data = out.encode(true, "ignore" if true != "utf-8" else "strict")
            if read in _SLOPPY[:4] and not lossy:
                out = "".join(_decode_byte(b, read) for b in data)
            else:
                out = data.decode(read, "replace" if lossy else "ignore")
        except (UnicodeDecodeError, UnicodeEncodeError):
            return None
    return out if out != text else None


def _decode_byte(b: int, codec: str) -> str:
    try:
        return bytes([b]).decode(codec)
    except UnicodeDecodeError:
        return chr(b)


def restore(text: str, chain: tuple[str, str, int]) -> str | None:
    """The text before the chain, if every byte decodes strictly."""
    true, read, times = chain
    for _ in range(times):
        data = encode(text, read)
        if data is None:
            return None
        try:
            text = data.decode(true)
        except UnicodeDecodeError:
            return None
    return text


def features(text: str) -> np.ndarray:
    data = np.frombuffer((" " + text + " ").encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.int64)
    high = (data[:-1] | data[1:]) >= 0x80
    return ((data[:-1] << 8 | data[1:]) * 40503 % 65521 % BUCKETS)[high]


def runs(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _RUN.finditer(text)] if not text.isascii() else []


class Garbles:
    """The classifier: log odds of every chain against the best of the clean classes, one per language of the labelled samples
    and one of marks, and as many with the counts of `corpus`, where given.

    Counts are smoothed towards the distribution over all classes, so that bigrams of no class speak for none.
    """

    def __init__(self, samples: list[tuple[str, str]], corpus: np.ndarray | None = None, usual: set[str] = frozenset(), sure: float = SURE):
        self.samples, self.sure, langs = samples, sure, sorted({lang for lang, _ in samples})
        marks = [CLEAN_MARKS] * 4 + CLEAN_MARKS.split(" ") + [*PUNCTUATED] * 4
        clean = [[t for lang, t in samples if lang == x] for x in langs] + [marks]
        sources = [*(t for _, t in samples), *PUNCTUATED, *CLEAN_MARKS.split(" ")]
        self.n_groups, self.n_clean = len(clean), len(clean) * (1 if corpus is None else 2)
        counts = np.zeros((self.n_clean + len(CHAINS) + 1, BUCKETS), dtype=np.float64)
        self.usual = {c for texts in clean for t in texts for c in t} | set(usual)
        for k, texts in enumerate(clean):
            for t in texts:
                np.add.at(counts[k], features(t), 1)
        if corpus is not None:
            counts[self.n_groups : self.n_clean] = corpus
        for k, chain in enumerate(CHAINS):
            for t in sources:
                g = garble(t, chain)
                if g and not g.isascii():
                    np.add.at(counts[self.n_clean + k], features(g), 1)
        for chain in LOSSY:
            for t in sources:
                g = garble(t, chain, lossy=True)
                if g:
                    np.add.at(counts[-1], features(g), 1)
        shared = (counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).sum(axis=0) + 1e-4
        shared /= shared.sum()
        self.log = np.log((counts + SMOOTH * shared) / (counts.sum(axis=1, keepdims=True) + SMOOTH)).T.astype(np.float32).copy()

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihood of each text in every class, and the texts' numbers of bigrams."""
        parts = [features(t) for t in texts]
        n = np.array([len(p) for p in parts], dtype=np.int64)
        out = np.zeros((len(texts), self.log.shape[1]), dtype=np.float32)
        at, block = 0, 0
        while at < len(texts):  # so many bigrams at once as the rows of the table fit the cache
            end, block = at, 0
            while end < len(texts) and (block == 0 or block + n[end] <= 20_000):
                block += n[end]
                end += 1
            some = np.flatnonzero(n[at:end]) + at
            if len(some):
                out[some] = np.add.reduceat(self.log[np.concatenate([parts[i] for i in some])], np.concatenate([[0], np.cumsum(n[some])[:-1]]), axis=0)
            at = end
        return out, n

    def judge_all(self, texts: list[str]) -> list[tuple[str | None, str | None]]:
        """(chain, restored text) of each run, ("lost", None) if it is garbled beyond repair, (None, None) if it is clean."""
        if not texts:
            return []
        distinct = list(dict.fromkeys(texts))
        scores, n = self.scores(distinct)
        clean = scores[:, : self.n_clean].max(axis=1)
        odds = scores[:, self.n_clean :] - clean[:, None]
        found: dict[str, tuple[str | None, str | None]] = {}
        for i in np.flatnonzero(odds.max(axis=1) >= LIKELY):
            found[distinct[i]] = self._invert(distinct[i], float(clean[i]), odds[i], int(n[i]))
        return [found.get(t, (None, None)) for t in texts]

    def _invert(self, run: str, clean: float, odds: np.ndarray, n: int) -> tuple[str | None, str | None]:
        for k in np.argsort(-odds[:-1]):
            chain = CHAINS[k]
            # valid UTF-8 hardly comes about by chance, so the classifier need not be as sure of it; other encodings decode
            # almost anything, so the text must gain
            strict = chain[0] == "utf-8" and chain[1] not in ("cp949", "gbk", "cp932", "big5")
            if odds[k] < (LIKELY if strict else self.sure):
                continue
            text = restore(run, chain)
            if text is None or text == run or not readable(text) or chain[0] == "utf-8" and len(text) >= len(run):
                continue
            if not strict and self.scores([text])[0][0, : self.n_clean].max() - clean < self.sure:
                continue
            if chain[2] == 1 and strict and not text.isascii():
                deeper = self.judge_all([text])[0]
                if deeper[1]:
                    return f"{name(chain)}, {deeper[0]}", deeper[1]
            return name(chain), text
        if odds[-1] >= self.sure and odds[-1] >= LOST_PER_BIGRAM * n or n >= LEAST_LOST and odds.max() >= self.sure + LOST_PER_BIGRAM * n:
            return "lost", None
        return None, None

    def find(self, text: str) -> list[tuple[int, int, str, str | None]]:
        return self.find_all([text])[0]

    def find_all(self, texts: list[str]) -> list[list[tuple[int, int, str, str | None]]]:
        """(start, end, chain, restored) of the garbled runs of each text. A run that isn't garbled as a whole is judged by
        words, those with characters that no clean text of the fit has, and those by stretches of one kind of script."""
        spans = [(i, a, b) for i, t in enumerate(texts) for a, b in runs(t)]
        whole = self.judge_all([texts[i][a:b] for i, a, b in spans])
        words = [(k, m.start(), m.end()) for k, (i, a, b) in enumerate(spans) if whole[k][1] is None and self._odd(texts[i][a:b])
                 for m in _WORD.finditer(texts[i], a, b) if self._odd(m[0])]
        of_words = self.judge_all([texts[spans[k][0]][a:b] for k, a, b in words])
        pieces = [(w, a + p.start(), a + p.end()) for w, (k, a, b) in enumerate(words) if of_words[w][1] is None
                  for p in _PIECE.finditer(texts[spans[k][0]][a:b]) if not p[0].isascii()]
        of_pieces = self.judge_all([texts[spans[words[w][0]][0]][a:b] for w, a, b in pieces])
        by_word: dict[int, list] = {}
        for (w, a, b), (c, f) in zip(pieces, of_pieces):
            if c:
                by_word.setdefault(w, []).append((a, b, c, f))
        by_run: dict[int, list] = {}
        for w, ((k, a, b), (c, f)) in enumerate(zip(words, of_words)):
            inner = by_word.get(w, [])
            if f is not None or c and not any(p[3] is not None for p in inner):
                inner = [(a, b, c, f)]
            by_run.setdefault(k, []).extend(inner)
        out: list[list] = [[] for _ in texts]
        for k, ((i, a, b), (chain, fixed)) in enumerate(zip(spans, whole)):
            inner = by_run.get(k, [])
            if fixed is None and (any(x[3] is not None for x in inner) or inner and chain is None):
                out[i] += inner
            elif chain is not None:
                out[i].append((a, b, chain, fixed))
        return out

    def _odd(self, part: str) -> bool:
        return not self.usual.issuperset(part) or bool(_PAIR.search(part))


def name(chain: tuple[str, str, int]) -> str:
    return f"{chain[0]} read as {chain[1]}" + (f" x{chain[2]}" if chain[2] > 1 else "")


def readable(text: str) -> bool:
    """No control, private or unassigned characters."""
    return not any(unicodedata.category(c) in ("Cc", "Co", "Cn", "Cs") and c not in "\n\t\r" for c in text)


def repair(df: DataFrame, model: Garbles, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, chain, restored, complete): a row per record with garbled text.

    chain names the chain of the longest garbled run, restored is the text with every restorable run restored,
    complete tells whether all were. Null and empty texts and clean records give no row; repeated rows give one each.
    Extra columns are not read. Each distinct text of a batch is judged once.
    """

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, distinct = [], list(dict.fromkeys(pdf["t"]))
            seen = {t: f for a in range(0, len(distinct), 500) for t, f in zip(distinct[a : a + 500], model.find_all(distinct[a : a + 500]))}
            for i, t in zip(pdf["id"], pdf["t"]):
                if found := seen[t]:
                    out, at = [], 0
                    for a, b, _, fixed in found:
                        out += [t[at:a], fixed if fixed is not None else t[a:b]]
                        at = b
                    rows.append((i, max(found, key=lambda x: x[1] - x[0])[2], "".join(out) + t[at:], all(x[3] is not None for x in found)))
            yield pd.DataFrame(rows, columns=["id", "chain", "restored", "complete"])

    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("t")).where(r"t is not null and t rlike '[^\\x00-\\x7F]'")
    return rows.mapInPandas(look, f"id {kind}, chain string, restored string, complete boolean").withColumnRenamed("id", id_col)


def corpus_counts(documents: DataFrame, model: Garbles, text: str = "text") -> tuple[np.ndarray, set[str]]:
    """(bigram counts per clean class, usual characters) over all lines of all documents in which the model finds nothing, each
    document in its likeliest class. The result has a bounded size: the buckets of the classes that occur, and the
    non-ASCII characters that a share of USUAL of the documents hold."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, chars, docs = np.zeros((model.n_groups, BUCKETS), np.int64), Counter(), 0
        for pdf in batches:
            texts = pdf["t"].tolist()
            docs += len(texts)
            texts = [t for t in texts if not t.isascii()]
            for a in range(0, len(texts), 500):
                part = [t for t, found in zip(texts[a : a + 500], model.find_all(texts[a : a + 500])) if not found]
                for t, k in zip(part, model.scores(part)[0][:, : model.n_groups].argmax(axis=1) if part else ()):
                    total[k] += np.bincount(features(t), minlength=BUCKETS)
                    chars.update(set(t))
        total = total.ravel()
        at = np.flatnonzero(total)
        yield pd.DataFrame({"kind": ["n"], "k": [0], "n": [docs]})
        yield pd.DataFrame({"kind": "bigram", "k": at, "n": total[at]})
        yield pd.DataFrame([("char", ord(c), n) for c, n in chars.items() if ord(c) > 127], columns=["kind", "k", "n"])

    parts = documents.where(F.col(text).isNotNull()).select(F.col(text).alias("t")).mapInPandas(count, "kind string, k long, n long")
    rows = parts.groupBy("kind", "k").agg(F.sum("n").alias("n")).collect()
    docs = sum(r["n"] for r in rows if r["kind"] == "n")
    total = np.zeros(model.n_groups * BUCKETS)
    for r in rows:
        if r["kind"] == "bigram":
            total[r["k"]] = r["n"]
    return total.reshape(model.n_groups, BUCKETS), {chr(r["k"]) for r in rows if r["kind"] == "char" and r["n"] >= USUAL * docs}


def fit(samples: DataFrame, documents: DataFrame | None = None, text: str = "text", most: int = FIT_SAMPLES) -> Garbles:
    """Fit on all labelled samples (lang, text), a small table; more than `most` rows are an error, not a cut. With documents,
    what all of them hold, those aside in which the first fit finds something, is counted too."""
    labelled = [(r[0], r[1]) for r in samples.select("lang", text).where(F.col(text).isNotNull()).limit(most + 1).collect()]
    if len(labelled) > most:
        raise ValueError(f"more than {most} labelled samples")
    if documents is None:
        return Garbles(sorted(labelled))
    return Garbles(sorted(labelled), *corpus_counts(documents, Garbles(sorted(labelled), sure=FIRST_SURE), text))
