"""Deduplicating new batches against all history (problem 1).

Every call of admit() makes one immutable suffix array over the concatenated letters of its new records, cut into shards by
ranges of the suffixes' bytes, so that no common phrase fills a shard. The new records' substrings are binary-searched in
the stored arrays of earlier calls and in their own; each votes for the earliest line with its longest match, votes are
added up per pair of records, and pairs with enough coverage are verified by edit distance. Rows are accepted in line
order: a row repeats the earliest accepted row it matches.

The state is a folder of written tables: arrays with their levels (two of one level merge into one of the next, so n calls
leave at most log n arrays), letters, classes and ids of the records. A call reads the arrays, the classes, and the letters
of candidates; it never tokenises, sorts or searches earlier rows again.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm.anchors import Segment, choose, common_prefix, earlier_matches, merged, prefixes
from quillstream.llm.strings import edit_distance, letters
from quillstream.session import fresh_path, keep, small

#: Letters from which two texts are compared; share of letters by which they may differ ("about a tenth").
LEAST_LETTERS, DIFFER = 45, 0.125
#: Bytes hashed to choose a place; bytes of a window; bytes kept of a suffix (a longer match is found by several of its
#: places); least match; least share of a record's bytes that votes for one line must cover.
CHOOSE, WINDOW, KEEP, LEAST_MATCH, COVER = 12, 36, 128, 18, 0.12
#: Suffixes a shard is planned to hold, and suffixes of a usual record; records sampled for the ranges of the shards.
SHARD_PLACES, PLACES_PER_RECORD, RANGE_SAMPLE = 1_500_000, 22, 4000

_ENTRIES = "shard int, kind int, level int, a binary, b binary, c binary, d binary, e binary"
# Kinds of packed rows: new suffixes, suffixes that are only searched, votes, a stored array's part.
NEW, ASK, VOTES, STORED = 0, 1, 2, 3


def _z(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _u(x: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), dtype=dtype)


def prepare(rows: DataFrame, line: str, record_id: str, text: str) -> DataFrame:
    """(line, same, h, letters, local): the id-and-text key, the letters' key and the letters of each row.

    Within an Arrow batch only the first row of equal letters keeps its letters; the others name it in `local`.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made: dict[str, str] = {}
            for t in set(pdf["t"]):
                made[t] = letters(t) if t is not None and len(t) * 18 >= LEAST_LETTERS else ""
            forms = [made[t] for t in pdf["t"]]
            first: dict[str, int] = {}
            lines = pdf["line"].tolist()
            for f, n in zip(forms, lines):
                if len(f) >= LEAST_LETTERS and (f not in first or n < first[f]):
                    first[f] = n
            local = [None if len(f) < LEAST_LETTERS or first[f] == n else first[f] for f, n in zip(forms, lines)]
            kept = [f if len(f) >= LEAST_LETTERS and x is None else None for f, x in zip(forms, local)]
            yield pd.DataFrame({"line": pdf["line"], "same": pdf["same"], "letters": pd.Series(kept, dtype=object), "local": pd.Series(local, dtype="Int64")})

    keyed = rows.select(
        F.col(line).cast("long").alias("line"), F.col(text).alias("t"),
        # as bytes: numbers with nulls among them would pass through Python as floats
        F.when(F.col(record_id).isNotNull() & (F.length(F.col(text)) > 0), F.unhex(F.substring(F.sha2(F.concat_ws("\u001f", record_id, text), 256), 1, 32))).alias("same"),
    ).where("line is not null")
    made = keyed.mapInPandas(run, "line long, same binary, letters string, local long")
    return made.select("line", "same", F.unhex(F.substring(F.sha2("letters", 256), 1, 32)).alias("h"), "letters", "local")


def ranges(records: DataFrame, shards: int) -> np.ndarray:
    """Bounds of the shards, from the suffixes of a bounded sample of records: they balance the shards and change no result."""
    texts = [r[0] for r in records.select("letters").limit(RANGE_SAMPLE).collect()]
    data, place, _, _ = choose(texts, CHOOSE, WINDOW)
    keys = np.unique(prefixes(data, place, KEEP))
    if not len(keys):
        return keys
    return np.unique(keys[(np.arange(1, shards) * len(keys)) // shards])


def shards_for(records: DataFrame, n: int) -> int:
    return max(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * PLACES_PER_RECORD // SHARD_PLACES + 1)


def entries(records: DataFrame, bounds: np.ndarray, differ: float = DIFFER) -> DataFrame:
    """The suffixes of the records' letters, packed per Arrow batch of records and shard.

    Of equal suffixes within an Arrow batch the earliest line's goes to the shard; the others vote for that line at once, so
    the parts of a large group of near copies don't meet in one shard. A suffix that shares its start with the next
    shard's range is searched there too.
    """
    edges = bounds

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, lines = pdf["letters"].tolist(), pdf["line"].to_numpy(np.int64)
            data, place, of, _ = choose(texts, CHOOSE, WINDOW)
            out = []
            if len(place):
                n_bytes = np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], dtype=np.int32)
                n_letters = np.array([len(t) for t in texts], dtype=np.int32)
                start = np.concatenate([[0], np.cumsum(n_bytes.astype(np.int64) + CHOOSE + WINDOW)[:-1]])
                after = np.concatenate([place[1:], [0]])
                last = np.concatenate([of[1:] != of[:-1], [True]])
                gap = np.minimum(np.where(last, start[of] + n_bytes[of], after) - place, KEEP).astype(np.uint8)
                keys = prefixes(data, place, KEEP)
                order = np.lexsort((lines[of],))
                order = order[np.argsort(keys[order], kind="stable")]
                key = keys[order]
                head = np.concatenate([[True], key[1:] != key[:-1]])
                owner = lines[of[order]][np.flatnonzero(head)[np.cumsum(head) - 1]]
                again = ~head & (owner != lines[of[order]])
                if again.any():
                    q = of[order[again]]
                    full = np.char.str_len(key[again]).astype(np.int64)
                    ok = full >= LEAST_MATCH
                    who = np.searchsorted(np.sort(lines), owner[again])
                    s_letters = n_letters[np.argsort(lines, kind="stable")][who]
                    ok &= np.abs(n_letters[q] - s_letters) <= differ * np.maximum(n_letters[q], s_letters)
                    if ok.any():
                        votes = (lines[q[ok]], owner[again][ok], np.minimum(full, gap[order[again]])[ok], n_bytes[q[ok]])
                        out += [(int(b), VOTES, 0, *x, None) for b, x in _packed(*votes, len(edges) + 1)]
                at = order[head]
                key = key[head]
                shard = np.searchsorted(edges, key, side="right")
                parts = [(at, key, shard, NEW)]
                if len(edges):
                    low, high = shard > 0, shard < len(edges)
                    low[low] = common_prefix(key[low], edges[shard[low] - 1], KEEP) >= LEAST_MATCH
                    high[high] = common_prefix(key[high], edges[shard[high]], KEEP) >= LEAST_MATCH
                    parts += [(at[low], key[low], shard[low] - 1, ASK), (at[high], key[high], shard[high] + 1, ASK)]
                for at, key, shard, kind in parts:
                    for s in np.unique(shard):
                        m = shard == s
                        who = of[at[m]]
                        out.append((int(s), kind, 0, _z(key[m]), _z(lines[who]), _z(n_letters[who]), _z(n_bytes[who]), _z(gap[at[m]])))
            yield pd.DataFrame(out, columns=["shard", "kind", "level", "a", "b", "c", "d", "e"])

    return records.select("line", "letters").mapInPandas(run, _ENTRIES)


def _packed(q: np.ndarray, s: np.ndarray, n: np.ndarray, size: np.ndarray, buckets: int) -> Iterator[tuple[int, tuple]]:
    """Votes added up per pair, as (bucket of q, packed columns)."""
    order = np.lexsort((s, q, q % buckets))
    q, s, n, size = q[order], s[order], n[order], size[order]
    start = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (s[1:] != s[:-1])]))
    q, s, n, size = q[start], s[start], np.add.reduceat(n, start), size[start]
    ends = np.searchsorted(q % buckets, np.arange(buckets + 1))
    for k in range(buckets):
        x = slice(ends[k], ends[k + 1])
        if ends[k] < ends[k + 1]:
            yield k, (_z(np.diff(q[x], prepend=0)), _z(s[x]), _z(n[x].astype(np.int32)), _z(size[x].astype(np.int32)))


def _search_shard(stored: list[Segment], new: list, buckets: int, differ: float) -> Iterator[tuple]:
    """Votes of a shard's new suffixes, each for the earliest line of its longest match, in the stored arrays or its own."""
    if new:
        keys, lines, n_letters, n_bytes, gaps = (np.concatenate([_u(getattr(r, c), t) for r in new]) for c, t in zip("abcde", (f"S{KEEP}", "i8", "i4", "i4", "u1")))
        indexed = np.concatenate([np.full(len(_u(r.e, "u1")), r.kind == NEW) for r in new])
        order = np.argsort(lines, kind="stable")
        order = order[np.argsort(keys[order], kind="stable")]
        keys, lines, n_letters, n_bytes, gaps, indexed = (x[order] for x in (keys, lines, n_letters, n_bytes, gaps, indexed))
        length, line = earlier_matches(keys, lines, indexed, KEEP, LEAST_MATCH)
        known = np.argsort(lines, kind="stable")
        at = np.minimum(np.searchsorted(lines[known], line), len(lines) - 1)
        other = n_letters[known[at]]
        for part in stored:
            n, earliest, theirs = part.matches(keys, KEEP)
            better = (n >= LEAST_MATCH) & ((n > length) | ((n == length) & (earliest < line)))
            length, line, other = np.where(better, n, length), np.where(better, earliest, line), np.where(better, theirs, other)
        hit = (length >= LEAST_MATCH) & (line >= 0) & (np.abs(n_letters - other) <= differ * np.maximum(n_letters, other))
        yield from _packed(lines[hit], line[hit], np.minimum(length, gaps)[hit].astype(np.int64), n_bytes[hit], buckets) if hit.any() else ()


def _own_segment(new: list) -> Segment:
    rows = [r for r in new if r.kind == NEW]
    keys, lines, n_letters = (np.concatenate([_u(getattr(r, c), t) for r in rows]) if rows else np.zeros(0, t) for c, t in zip("abc", (f"S{KEEP}", "i8", "i4")))
    return Segment(keys, lines, n_letters)


def search(packed: DataFrame, buckets: int, stored: DataFrame | None = None, segments: bool = False, differ: float = DIFFER) -> tuple[DataFrame, DataFrame | None]:
    """((q, s), array): pairs of a new line and the one it votes for with enough coverage; with `segments`, the new array too."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_shard: dict[int, list] = {}
        for pdf in parts:
            for row in pdf.itertuples(index=False):
                by_shard.setdefault(row.shard if row.kind != VOTES else -1, []).append(row)
        columns = ["kind", "shard", "level", "a", "b", "c", "d", "e"]
        for shard in sorted(by_shard):
            rows = by_shard.pop(shard)
            if shard == -1:
                yield pd.DataFrame([(VOTES, r.shard, 0, r.a, r.b, r.c, r.d, None) for r in rows], columns=columns)
                continue
            new = [r for r in rows if r.kind != STORED]
            arrays: dict[int, list] = {}
            for r in rows:
                if r.kind == STORED:
                    arrays.setdefault(r.level, []).append(Segment(_u(r.a, f"S{KEEP}"), _u(r.b, "i8"), _u(r.c, "i4"), ordered=True))
            out = [(VOTES, b, 0, *x, None) for b, x in _search_shard([s for group in arrays.values() for s in group], new, buckets, differ)]
            if segments and new:
                own = _own_segment(new)
                out.append((STORED, shard, 0, _z(own.keys), _z(own.lines), _z(own.sizes), None, None))
            yield pd.DataFrame(out, columns=columns)

    both = packed if stored is None else packed.unionByName(stored.select(*packed.columns))
    # votes are passed on as they are, spread over the tasks
    found = both.repartition(buckets, "shard").mapInPandas(run, "kind int, shard int, level int, a binary, b binary, c binary, d binary, e binary")
    if segments:
        found = keep(found)
    pairs = found.where(F.col("kind") == VOTES).select("shard", "a", "b", "c", "d").repartition(buckets, "shard").mapInPandas(_add_up, "q long, s long")
    return pairs, found.where(F.col("kind") == STORED).select("shard", "kind", "level", "a", "b", "c", "d", "e") if segments else None


def _add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of the buckets of a partition whose votes, over all shards, cover enough of q."""
    by_bucket: dict[int, list] = {}
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            by_bucket.setdefault(row.shard, []).append(row)
    for bucket in sorted(by_bucket):
        rows = by_bucket.pop(bucket)
        q, s, n, size = (np.concatenate(x) for x in zip(*((np.cumsum(_u(r.a, "i8")), _u(r.b, "i8"), _u(r.c, "i4").astype(np.int64), _u(r.d, "i4")) for r in rows)))
        order = np.lexsort((s, q))
        q, s, n, size = q[order], s[order], n[order], size[order]
        start = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (s[1:] != s[:-1])]))
        enough = np.add.reduceat(n, start) >= size[start] * COVER
        yield pd.DataFrame({"q": q[start][enough], "s": s[start][enough]})


def within(a: str, b: str, differ: float = DIFFER) -> bool:
    """Whether two letter strings differ by at most the share of the longer one's letters."""
    n = max(len(a), len(b))
    most = int(differ * n)
    if abs(len(a) - len(b)) > most:
        return False
    # an edit spoils three places at most; shingles count as often as both have them, so repeated ones reject nothing
    if n >= 3 and (Counter(map("".join, zip(a, a[1:], a[2:]))) & Counter(map("".join, zip(b, b[1:], b[2:])))).total() < n - 2 - 3 * most:
        return False
    return edit_distance(a, b, most) <= most


def verified(pairs: DataFrame, new: DataFrame, old: DataFrame | None = None, differ: float = DIFFER) -> DataFrame:
    """(q, s): the pairs whose letters differ by at most the share; q is new, s new or old."""

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([within(x, y, differ) for x, y in zip(a, b)], dtype=bool)

    pairs = keep(pairs.select("q", "s"))
    side = small(pairs, pairs.count(), 24)
    every = new if old is None else new.select("line", "letters").unionByName(old.select("line", "letters"))
    left = new.select(F.col("line").alias("q"), F.col("letters").alias("a")).join(side, "q")
    right = every.select(F.col("line").alias("s"), F.col("letters").alias("b")).join(small(pairs.select("s").distinct(), pairs.count(), 12), "s")
    return left.join(right, "s").where(near("a", "b")).select("q", "s")


def exact_pairs(records: DataFrame, old: DataFrame | None = None, differ: float = DIFFER) -> DataFrame:
    """(q, s): all pairs of a new record and an earlier or old one that differ by at most the share, by comparing every two
    records of like length in blocks. The exact way, of quadratic cost, for small tables and for measuring recall."""
    n = F.length("letters")
    step = 1 / (1 - differ)
    block = F.floor(F.log(n) / F.log(F.lit(step))).cast("int")
    q = records.select(F.col("line").alias("q"), F.col("letters").alias("a"), F.explode(F.array(block - 1, block, block + 1)).alias("block"))
    s = records.select(F.col("line").alias("s"), F.col("letters").alias("b"), block.alias("block"), F.lit(False).alias("old"))
    if old is not None:
        s = s.unionByName(old.select(F.col("line").alias("s"), F.col("letters").alias("b"), block.alias("block"), F.lit(True).alias("old")))

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([within(x, y, differ) for x, y in zip(a, b)], dtype=bool)

    return q.join(s, "block").where("old or s < q").where(near("a", "b")).select("q", "s")


def resolve(pairs: DataFrame) -> DataFrame:
    """(line, of): of the lines in the pairs (line, earlier line), those not accepted and the earliest accepted match.

    A line is accepted if no accepted earlier line matches it. Rounds of joins: an s that is no q any more is accepted and
    rejects its q; pairs of rejected lines go.
    """
    pairs = keep(pairs.distinct())
    left, rejected = pairs, None
    while not left.isEmpty():
        roots = left.select("s").distinct().join(left.select(F.col("q").alias("s")).distinct(), "s", "left_anti")
        gone = keep(left.join(roots, "s", "left_semi").select(F.col("q").alias("line")).distinct())
        rejected = gone if rejected is None else rejected.unionByName(gone)
        left = keep(left.join(gone, left["q"] == gone["line"], "left_anti").join(gone, F.col("s") == gone["line"], "left_anti"))
    if rejected is None:
        return pairs.select(F.col("q").alias("line"), F.col("s").alias("of"))
    # a rejected line has an accepted match: the earliest line that isn't rejected itself
    return pairs.join(rejected, pairs["s"] == rejected["line"], "left_anti").join(rejected, pairs["q"] == rejected["line"], "left_semi").groupBy(F.col("q").alias("line")).agg(F.min("s").alias("of"))


class State:
    """What admit() leaves for the next call: a folder with a list of its written tables."""

    def __init__(self, spark: SparkSession, path: str | None):
        self.spark, self.path = spark, path
        self.parts: list[dict] = [] if path is None else json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/parts.json").collect()))

    def table(self, kind: str) -> DataFrame | None:
        paths = [p["path"] for p in self.parts if p["kind"] == kind]
        return self.spark.read.parquet(*paths) if paths else None

    def arrays(self) -> DataFrame | None:
        out = None
        for k, p in enumerate(x for x in self.parts if x["kind"] == "array"):
            one = self.spark.read.parquet(p["path"]).withColumn("level", F.lit(k))
            out = one if out is None else out.unionByName(one)
        return out

    def bounds(self) -> np.ndarray | None:
        kept = self.table("bounds")
        return None if kept is None else np.array(sorted(bytes(r[0]) for r in kept.collect()), dtype=f"S{KEEP}")

    def add(self, kind: str, df: DataFrame, level: int = 0) -> None:
        path = fresh_path(self.spark, f"history-{kind}")
        df.write.option("compression", "zstd").parquet(path)
        self.parts.append({"kind": kind, "path": path, "level": level})
        if kind == "array":
            self._merge()

    def _merge(self) -> None:
        """Two arrays of one level become one of the next; the files of both stay, as they are immutable."""

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            by_shard: dict[int, Segment] = {}
            for pdf in parts:
                for r in pdf.itertuples(index=False):
                    one = Segment(_u(r.a, f"S{KEEP}"), _u(r.b, "i8"), _u(r.c, "i4"), ordered=True)
                    by_shard[r.shard] = merged(by_shard[r.shard], one) if r.shard in by_shard else one
            rows = [(k, STORED, 0, _z(s.keys), _z(s.lines), _z(s.sizes), None, None) for k, s in by_shard.items()]
            yield pd.DataFrame(rows, columns=["shard", "kind", "level", "a", "b", "c", "d", "e"])

        while True:
            arrays = [p for p in self.parts if p["kind"] == "array"]
            if len(arrays) < 2 or arrays[-1]["level"] < arrays[-2]["level"]:
                return
            both, level = arrays[-2:], arrays[-1]["level"] + 1
            self.parts = [p for p in self.parts if p not in both]
            df = self.spark.read.parquet(*[p["path"] for p in both])
            path = fresh_path(self.spark, "history-array")
            df.repartition(max(1, len(self.bounds()) + 1), "shard").mapInPandas(run, _ENTRIES).write.option("compression", "zstd").parquet(path)
            self.parts.append({"kind": "array", "path": path, "level": level})

    def save(self) -> str:
        """Writes the list of parts to a new folder; the old state stays usable."""
        path = fresh_path(self.spark, "history-state")
        self.spark.createDataFrame([(json.dumps(self.parts),)], "value string").coalesce(1).write.text(f"{path}/parts.json")
        return path


def admit(
    rows: DataFrame, state: str | None = None, save: bool = True, exact: bool = False,
    line: str = "input_line", record_id: str = "observation_id", text: str = "text",
) -> tuple[DataFrame, str | None]:
    """((line, repeated_line), new state): every row that repeats an accepted earlier one, with the earliest such.

    rows: one new batch or several; state: what the last call returned, None for an empty history. A row repeats an earlier
    one of the same id and the same non-empty text, or whose text has, as its own, at least LEAST_LETTERS letters of which
    the two differ by at most about a tenth. Earlier are the rows of the history and those of a smaller line. With `exact`,
    all records of like length are compared (small tables only). Rows with a null line are left out; null ids and null or
    empty texts repeat nothing by id; batches don't matter beside lines; extra columns are not read. Equal letters count as
    one record (the earliest line), so groups of copies of any size meet no one but it.
    """
    spark = rows.sparkSession
    old = State(spark, state)
    prepared = keep(prepare(rows, line, record_id, text))
    # the same id and the same text; texts with enough letters are met by their letters
    short = prepared.where("same is not null and letters is null and local is null").select("line", "same")
    ids = short.groupBy("same").agg(F.min("line").alias("of"), F.count(F.lit(1)).alias("n"))
    known_ids = old.table("ids")
    if known_ids is not None:
        ids = ids.join(known_ids.groupBy("same").agg(F.min("line").alias("before")), "same", "left").withColumn("of", F.coalesce("before", "of"))
        by_id = short.join(ids.where("n > 1 or before is not null").select("same", "of"), "same").where("of <> line").select("line", "of")
    else:
        by_id = short.join(ids.where("n > 1").select("same", "of"), "same").where("of < line").select("line", "of")
    # equal letters: the earliest line stands for them
    long = prepared.where("letters is not null").select("line", "h", "letters")
    several = keep(long.groupBy("h").agg(F.min("line").alias("of"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "of"))
    copies = keep(long.select("line", "h").join(small(several, several.count(), 32), "h").where("of < line").select("line", "of"))
    records = long.join(small(copies.select("line"), copies.count(), 16), "line", "left_anti")
    answers, old_texts, classes = None, None, old.table("classes")
    if classes is not None:  # letters that history has: its accepted line stands for them
        old_texts = old.table("texts")
        met = keep(records.select("line", "h").join(classes.select("h", F.coalesce("of", "line").alias("of")), "h").select("line", "of"))
        answers = met
        records = keep(records.join(small(met.select("line"), met.count(), 16), "line", "left_anti"))
    if exact:
        pairs, array = exact_pairs(records, old_texts), None
    else:
        bounds = old.bounds()
        if bounds is None:
            n = records.count()
            bounds = ranges(records, shards_for(records, n))
        pairs, array = search(entries(records, bounds), len(bounds) + 1, old.arrays(), save)
        if classes is not None:  # what history rejected stands for the line it repeats
            pairs = pairs.join(classes.select(F.col("line").alias("s"), F.col("of").alias("known")), "s", "left").select("q", F.coalesce("known", "s").alias("s")).distinct()
        pairs = verified(pairs, records, old_texts)
    pairs = keep(pairs)
    near = keep(resolve(pairs))
    # an earlier accepted match may be no one's longest match: look for it among the matches of one's matches
    while not exact:
        links = pairs.select("q", F.col("s").alias("r")).union(pairs.select(F.col("s").alias("q"), F.col("q").alias("r")))
        further = links.join(near.select(F.col("line").alias("r"), F.col("of").alias("s")), "r").where("s < q").select("q", "s").distinct()
        more = keep(verified(further.join(pairs, ["q", "s"], "left_anti"), records, old_texts))
        if more.isEmpty():
            break
        pairs = keep(pairs.unionByName(more))
        near = keep(resolve(pairs))
    answers = near if answers is None else near.unionByName(answers)
    answers = answers.unionByName(
        copies.join(answers.select(F.col("line").alias("of"), F.col("of").alias("x")), "of", "left").select("line", F.coalesce("x", "of").alias("of"))
    )
    if save:  # by_id and local rows leave nothing new behind
        answers = keep(answers)
    local = prepared.where("local is not null").select("line", F.col("local").alias("at"))
    by_local = local.join(answers.select(F.col("line").alias("at"), "of"), "at", "left").select("line", F.coalesce("of", "at").alias("of"))
    found = by_id.unionByName(answers).unionByName(by_local).select("line", F.col("of").alias("repeated_line"))
    if not save:
        return found, None
    if known_ids is None and not exact:
        old.add("bounds", spark.createDataFrame([(bytes(b),) for b in bounds], "bound binary"))
    old.add("ids", ids.select("same", F.col("of").alias("line")))
    old.add("classes", records.select("line", "h").join(answers, "line", "left").select("line", "h", "of"))
    # sorted, so that a scan for some lines skips most row groups; rejected records are never compared again
    old.add("texts", records.select("line", "letters").join(answers, "line", "left_anti").sort("line"))
    if array is not None:
        old.add("array", array)
    return found, old.save()


def repeated_rows(rows: DataFrame, line: str = "input_line", record_id: str = "observation_id", text: str = "text") -> DataFrame:
    """(line, repeated_line): admit() of all rows at once, without leaving a state."""
    return admit(rows, save=False, line=line, record_id=record_id, text=text)[0]
