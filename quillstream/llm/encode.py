"""Encoding of a corpus with a public byte-level BPE tokenizer by corpus-level merge replay (problem 8).

The distinct words of a chunk of texts are laid out as one chain of symbols. An inverted index from symbol pair to the
positions of the pair applies the tokenizer's merges in rank order, each to all its positions at once, and touches only
the neighbours of what it merges: those pairs leave the index and new ones enter it. A merge's new pairs always have a
later rank, as a token must exist before it can be merged. Texts need no shuffle: a chunk is what an Arrow batch holds,
and words seen before in a task keep their ids.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct words whose ids a task keeps; beyond, it starts afresh (which changes no result).
KEPT_WORDS = 400_000
# Fixed value: the public pattern of words of byte-level BPE tokenizers of 50k ids.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files of byte-level BPE."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {}, 0
    for b in range(256):
        if b in shown:
            letters[b] = chr(b)
        else:
            letters[b] = chr(256 + extra)
            extra += 1
    return [letters[b] for b in range(256)]


class Replay:
    """A tokenizer's vocabulary and merges, and the replay of the merges over many words."""

    def __init__(self, path: str):
        self.path = path
        self._load()

    def __getstate__(self):
        return {"path": self.path}

    def __setstate__(self, state):
        self.path = state["path"]
        self._load()

    def _load(self) -> None:
        with open(self.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], model["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.ranks = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.pair_of = [(vocab[a], vocab[b]) for a, b in pairs]
        self.byte_id = [vocab[c] for c in byte_letters()]
        self.split = regex.compile(WORDS).findall
        self.known: dict[str, list[int]] = {}

    def words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word. Symbols of all words form one chain; -1 parts the words and belongs to no pair."""
        symbol: list[int] = []
        starts: list[int] = []
        for w in words:
            starts.append(len(symbol))
            symbol += [self.byte_id[b] for b in w.encode("utf-8", "surrogatepass")]
            symbol.append(-1)
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks, index, heap = self.ranks, {}, []
        for i in range(n - 1):
            hit = ranks.get((symbol[i], symbol[i + 1]))
            if hit is not None:
                at = index.get(hit[0])
                if at is None:
                    index[hit[0]] = [i]
                    heap.append(hit[0])
                else:
                    at.append(i)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            positions = index.pop(rank)
            positions.sort()
            left, right = self.pair_of[rank]
            made = ranks[left, right][1]
            for i in positions:
                j = after[i]
                if symbol[i] != left or j >= n or symbol[j] != right:
                    continue  # a neighbour's merge took one of the two
                symbol[i], symbol[j] = made, -2
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    hit = ranks.get((made, symbol[k]))
                    if hit is not None:
                        if hit[0] in index:
                            index[hit[0]].append(i)
                        else:
                            index[hit[0]] = [i]
                            heapq.heappush(heap, hit[0])
                h = before[i]
                if h >= 0:
                    hit = ranks.get((symbol[h], made))
                    if hit is not None:
                        if hit[0] in index:
                            index[hit[0]].append(h)
                        else:
                            index[hit[0]] = [h]
                            heapq.heappush(heap, hit[0])
        out = []
        for s in starts:
            ids = []
            while symbol[s] != -1:
                ids.append(symbol[s])
                s = after[s]
            out.append(ids)
        return out

    def texts(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text, without special tokens; null and empty texts have none."""
        split = [self.split(t) if t else [] for t in texts]
        if len(self.known) > KEPT_WORDS:
            self.known = {}
        new = [w for w in dict.fromkeys(w for ws in split for w in ws) if w not in self.known]
        self.known.update(zip(new, self.words(new)))
        known = self.known
        return [[t for w in ws for t in known[w]] for ws in split]


def vocabulary_path(name: str = "byte_bpe_50k.json", folder: str | None = None) -> str:
    """Place of a public vocabulary file: in `folder`, else QUILLSTREAM_TOKENIZERS, else /opt/tokenizers."""
    return os.path.join(folder or os.environ.get("QUILLSTREAM_TOKENIZERS", "/opt/tokenizers"), name)


def encode(df: DataFrame, id_col: str, text: str, path: str | None = None) -> DataFrame:
    """(id, ids array<int>) of every row of df. Null and empty texts both give an empty list; special-token strings in a
    text are ordinary text; repeated rows stay repeated; other columns are not read."""
    replay_path = path or vocabulary_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        replay = _replay(replay_path)
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "ids": replay.texts(pdf["t"].where(pdf["t"].notna(), None).tolist())})

    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col).alias("id"), F.col(text).alias("t")).mapInPandas(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def token_counts(text: Column, path: str | None = None) -> Column:
    """Number of tokens of a string column; 0 for null."""
    replay_path = path or vocabulary_path()

    @F.pandas_udf("int")
    def count(values: pd.Series) -> pd.Series:
        replay = _replay(replay_path)
        return pd.Series([len(x) for x in replay.texts(values.where(values.notna(), None).tolist())], dtype="int32")

    return count(text)


_LOADED: dict[str, Replay] = {}


def _replay(path: str) -> Replay:
    """One per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Replay(path)
    return _LOADED[path]
