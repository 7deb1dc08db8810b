"""Language of documents and their segments by hyperdimensional profiles (problem 6).

Every letter has a random vector of +1 and -1. An n-gram's vector binds its letters' vectors, each permuted by its
place; a profile bundles the n-gram vectors of its text. Every segment, whatever its script, is bundled alike and compared
with the languages' prototypes by the cosine of the bundle itself. N-grams are weighted by what they tell about the language
(one minus the normalised entropy over the languages; by that, n-grams of no sample weigh nothing).
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd

from quillstream.llm.looks import CYRILLIC, GREEK, resolved

DIMENSIONS = 2048
#: Bundles that are held at once.
BUNDLES = 512
#: Confidence from which a segment is sure; cosine by which a language may lag and still be taken from the document.
SURE, NEAR = 0.75, 0.12

_ALIKE = {ord(a): b for m in (CYRILLIC, GREEK) for a, b in m.items()}
_WORD = re.compile(r"[^\W\d_]+")
_LATIN = re.compile("[A-Za-zÀ-ɏ]")
_OTHER = re.compile("[Ͱ-ӿ]")
# What is no text of a language: links, tags, mentions and credit lines or phrases.
_LINK = re.compile(r"https?://\S+|www\.\S+|\S+@\S+\.\w+")
_TAG = re.compile(r"[#@][^\s#@]+")
# A credit ends with its name: one word, and up to three more that are written as names if nothing but an end follows.
_CREDIT = re.compile(
    r"(?:^|(?<=[\s(\[]))(?i:thanks to|edit by|edited by|bgm\s*:|music\s*:|feat\b\.?|ft\.|prod\b\.?(?: by)?|w/|cr\.|credit\s*:|sub by|art by|mix by)"
    r"[^\S\n]*[^\s)\]|/。！？]*(?:(?:[^\S\n]+(?:[A-ZÀ-Þ][\w'’-]*|&)){1,3}(?=[^\S\n]*(?:$|[|/)\]。.!?…])))?",
    re.M,
)
_CREDIT_SIGNS = ("thanks to", "edit", "bgm", "music", "feat", "ft.", "prod", "w/", "cr.", "sub by", "art by", "mix by")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+|(?<=[。！？])[\"'”’」』)\]]*\s*|\n+|(?<=다[~])\s+| \| |(?<=~)\s+")


def plain(text: str) -> str:
    """Compatibility and invisible forms resolved; look-alike letters inside Latin words become Latin."""
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKC", resolved(text.replace("‍", "")))
    if _OTHER.search(text) and _LATIN.search(text):
        text = _WORD.sub(lambda m: m[0].translate(_ALIKE) if _LATIN.search(m[0]) and _OTHER.search(m[0]) else m[0], text)
        words = _WORD.findall(text)
        latin = sum(bool(_LATIN.search(w)) for w in words)
        if latin * 2 > len(words):  # whole words of look-alikes amid a Latin text
            text = _WORD.sub(lambda m: t if _OTHER.search(m[0]) and not _OTHER.search(t := m[0].translate(_ALIKE)) else m[0], text)
    return text


_HANGUL = re.compile("[\uac00-\ud7a3]+")


def hangul(text: str) -> bool:
    """Whether nine letters of ten, and ten at least, are Hangul syllables."""
    own = sum(map(len, _HANGUL.findall(text)))
    return own >= 10 and own >= 0.9 * sum(map(len, _WORD.findall(text)))


def segments(text: str) -> list[str]:
    """Sentences of a text without links, tags and credits; what has no letters is left out."""
    out = []
    for line in text.split("\n"):
        line = plain(line)
        # most lines hold none of these, which is told faster than by the patterns
        if "http" in line or "www." in line or "@" in line:
            line = _LINK.sub(" ", line)
        if "#" in line or "@" in line:
            line = _TAG.sub(" ", line)
        if any(map(line.lower().__contains__, _CREDIT_SIGNS)):
            line = _CREDIT.sub(" ", line)
        for s in _SENTENCE.split(line):
            if s and _WORD.search(s):
                out.append(s.strip())
    return out


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, decomposed and folded, words parted by one space; the text of each code point."""
    forms = [" " + " ".join(_WORD.findall(unicodedata.normalize("NFD", t.casefold()).replace("́", "́"))) + "  " if t.isascii()
             else " " + " ".join(re.findall(r"[^\W\d_][̀-ͯᅠ-ᇿ゙゚]*(?:[^\W\d_][̀-ͯᅠ-ᇿ゙゚]*)*", unicodedata.normalize("NFD", t.casefold()))) + "  " for t in texts]
    lengths = np.array([len(f) for f in forms], dtype=np.int64)
    codes = np.frombuffer("".join(forms).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    return codes, np.repeat(np.arange(len(texts)), lengths)


def _grams(codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids (three packed code points; shorter n-grams have zeros) of the 1-, 2- and 3-grams, and their texts."""
    space = codes == 32
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    same = (owner[:-2] == owner[2:])
    three = same & ~space[1:-1]
    two = same & ~(space[:-2] & space[1:-1])
    one = ~space
    ids = np.concatenate([((a << 42) | (b << 21) | c)[three], ((a << 42) | (b << 21))[two], (codes << 42)[one]])
    return ids, np.concatenate([owner[:-2][three], owner[:-2][two], owner[one]])


class Profiles:
    """Prototypes of the languages of labelled samples (fit on a bounded sample: all given rows are used)."""

    def __init__(self, samples: list[tuple[str, str]], dimensions: int = DIMENSIONS, seed: int = 7):
        self.dimensions, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {}
        self.langs = sorted({lang for lang, _ in samples})
        texts = [plain(t) for _, t in samples]
        which = np.array([self.langs.index(lang) for lang, _ in samples])
        ids, owner = _grams(*_codes(texts))
        distinct, inverse = np.unique(ids, return_inverse=True)
        counts = np.zeros((len(self.langs), len(distinct)), dtype=np.float32)
        np.add.at(counts, (which[owner], inverse), 1.0)
        share = (counts + 0.02) / (counts + 0.02).sum(axis=0)
        # an n-gram counts by how much it tells about the language: one of many languages alike tells nothing
        self.weights = (1 + (share * np.log(share)).sum(axis=0) / np.log(max(2, len(self.langs)))).astype(np.float32)
        self.seen = distinct
        bundle = np.zeros((len(self.langs), dimensions), dtype=np.float32)
        for i in range(0, len(distinct), 2000):
            bundle += (np.sqrt(counts[:, i : i + 2000]) * self.weights[i : i + 2000]) @ self.vectors(distinct[i : i + 2000])
        bundle /= np.linalg.norm(bundle, axis=1, keepdims=True)
        bundle -= bundle.mean(axis=0)
        self.prototypes = bundle / np.linalg.norm(bundle, axis=1, keepdims=True)
        self.letters = {}
        self.bound: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"letters": {}, "bound": None}  # vectors follow from the seed

    def letter(self, cp: int) -> np.ndarray:
        v = self.letters.get(cp)
        if v is None:
            rng = np.random.Generator(np.random.PCG64([self.seed, cp]))
            v = self.letters[cp] = (rng.integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1)
        return v

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        """Bound n-gram vectors: each letter's vector is permuted by its place and multiplied in."""
        out = np.ones((len(ids), self.dimensions), dtype=np.int8)
        for place, shift in enumerate((42, 21, 0)):
            cps = ((ids >> np.uint64(shift)) & np.uint64(0x1FFFFF)).astype(np.int64)
            distinct, inverse = np.unique(cps, return_inverse=True)
            rows = np.stack([np.roll(self.letter(int(c)), place) if c else np.ones(self.dimensions, np.int8) for c in distinct])
            out *= rows[inverse]
        return out.astype(np.float32)

    def cosines(self, texts: list[str]) -> np.ndarray:
        """Cosine of each text's bundle with each prototype; zeros for texts without letters. Equal texts are bundled once."""
        if not texts:
            return np.zeros((0, len(self.langs)), dtype=np.float32)
        which, distinct = pd.factorize(np.array(texts, dtype=object))
        return self._cosines(distinct.tolist())[which]

    def _cosines(self, texts: list[str]) -> np.ndarray:
        codes, owner = _codes(texts)
        if len(codes) < 3:
            return np.zeros((len(texts), len(self.langs)), dtype=np.float32)
        ids, of = _grams(codes, owner)
        at = np.minimum(np.searchsorted(self.seen, ids), len(self.seen) - 1)
        hit = self.seen[at] == ids
        at, of = at[hit], of[hit]
        # a bundle holds each distinct n-gram once, weighted by the root of its count, as the prototypes do
        distinct, times = np.unique(of * len(self.seen) + at, return_counts=True)
        of, at = np.divmod(distinct, len(self.seen))
        amount = np.sqrt(times).astype(np.float32) * self.weights[at]
        if self.bound is None:
            self.bound = np.concatenate([self.vectors(self.seen[i : i + 2000]).astype(np.int8) for i in range(0, len(self.seen), 2000)])
            self.letters = {}
        begin = np.searchsorted(of, np.arange(len(texts) + 1))
        out = np.zeros((len(texts), len(self.langs)), dtype=np.float32)
        for i in range(0, len(texts), BUNDLES):
            bundles = np.zeros((min(BUNDLES, len(texts) - i), self.dimensions), dtype=np.float32)
            for k in range(len(bundles)):
                x = slice(begin[i + k], begin[i + k + 1])
                bundles[k] = amount[x] @ self.bound[at[x]].astype(np.float32)
            length = np.linalg.norm(bundles, axis=1, keepdims=True)
            out[i : i + BUNDLES] = bundles @ self.prototypes.T / np.maximum(length, 1e-9)
        return out

    def bundle(self, text: str) -> np.ndarray:
        """The bundle vector of one text (plain()), for itself."""
        ids, times = np.unique(_grams(*_codes([text]))[0], return_counts=True)
        at = np.minimum(np.searchsorted(self.seen, ids), len(self.seen) - 1)
        hit = self.seen[at] == ids
        return (np.sqrt(times[hit]) * self.weights[at[hit]]) @ self.vectors(ids[hit])

    def of_card(self, parts: list[str], cos: np.ndarray) -> list[tuple[str, float]]:
        """Languages of the segments of one document; an unsure segment takes a language the others are sure of, if near."""
        z = np.exp(20 * (cos - cos.max(axis=1, keepdims=True)))
        conf = z.max(axis=1) / z.sum(axis=1)
        best = cos.argmax(axis=1)
        sure = sorted({int(b) for b, c in zip(best, conf) if c >= SURE})
        out = []
        for b, c, row in zip(best, conf, cos):
            if c < SURE and sure:
                near = max(sure, key=lambda k: row[k])
                if row[near] >= row[b] - NEAR:
                    b = near
            out.append((self.langs[int(b)], float(c)))
        return out

    def classify(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and confidence (softmax of the scaled cosines) of each text; texts must be plain()."""
        cos = self.cosines(texts)
        if not len(cos):
            return [], np.zeros(0)
        z = np.exp(20 * (cos - cos.max(axis=1, keepdims=True)))
        best = cos.argmax(axis=1)
        return [self.langs[k] for k in best], (z / z.sum(axis=1, keepdims=True)).max(axis=1)
