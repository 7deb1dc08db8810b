"""Content-chosen places in many texts at once, and suffix arrays over them."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)


def concatenate(texts: list[str], pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts with `pad` zero bytes after each; each text's start and length in bytes."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    lengths = np.array([len(d) for d in data], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + pad)[:-1]]) if len(data) else np.zeros(0, np.int64)
    return np.frombuffer((b"\0" * pad).join(data) + b"\0" * pad, dtype=np.uint8), starts, lengths


def _slide(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over x[i : i + w] for every i, by doubling; the end is padded with the last value."""
    out, step = x, 1
    while step * 2 <= w:
        out = op(out, np.concatenate([out[step:], np.full(min(step, len(out)), out[-1])])[: len(out)])
        step *= 2
    rest = w - step
    if rest:
        out = op(out, np.concatenate([out[rest:], np.full(min(rest, len(out)), out[-1])])[: len(out)])
    return out


def _powers(x: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of the k values from each place, by doubling."""
    have, step, out, done = x, 1, None, 0
    while k:
        if k & 1:
            if out is None:
                out = have
            else:
                shifted = np.concatenate([have[done:], np.zeros(done, np.uint64)])
                out = out + shifted * _ODD ** np.uint64(done)
            done += step
        k >>= 1
        if k:
            have = have + np.concatenate([have[step:], np.zeros(step, np.uint64)]) * _ODD ** np.uint64(step)
            step *= 2
    return out


def choose(texts: list[str], k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, place, text, hash): places whose k following bytes have the least hash of some window of w places (winnowing).

    The choice depends on nothing but the bytes nearby: texts that share k + w bytes share a place in them. Places lie at
    the start of characters; a text shorter than k bytes has none.
    """
    if not texts:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    pad = k + w
    data, starts, lengths = concatenate(texts, pad)
    n = len(data)
    with np.errstate(over="ignore"):
        h = _powers(data.astype(np.uint64) + np.uint64(1), k)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    free = np.zeros(n + 1, dtype=np.int32)
    ok = lengths >= k
    np.add.at(free, starts[ok], 1)
    np.add.at(free, (starts + lengths - k + 1)[ok], -1)
    allowed = (np.cumsum(free[:-1]) > 0) & ((data & 0xC0) != 0x80)
    top = np.uint64(2**64 - 1)
    h[~allowed] = top
    # windows are counted in bytes; the least of a window, then the greatest least of the windows that hold a place
    least = _slide(h, w, np.minimum)
    back = _slide(least[::-1], w, np.maximum)[::-1]
    place = np.flatnonzero(allowed & (h == back))
    return data, place, np.searchsorted(starts, place, side="right") - 1, h[place]


def prefixes(data: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
    """The first `width` bytes of the suffix at each place, as sortable byte strings."""
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    return padded[place[:, None] + np.arange(width)].view(f"S{width}").ravel()


def common_prefix(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Length of the common prefix of paired byte strings; trailing zeros don't count."""
    if not len(a):
        return np.zeros(0, np.int64)
    x = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), width)
    y = np.ascontiguousarray(b).view(np.uint8).reshape(len(b), width)
    same = (x == y) & (x != 0)
    return np.where(same.all(axis=1), width, (~same).argmax(axis=1))


class Segment:
    """An immutable suffix array: distinct suffixes in sorted order, each with the earliest line that has it and that record's size."""

    __slots__ = ("keys", "lines", "sizes")

    def __init__(self, keys: np.ndarray, lines: np.ndarray, sizes: np.ndarray, ordered: bool = False):
        if not ordered and len(keys):
            order = np.argsort(lines, kind="stable")
            order = order[np.argsort(keys[order], kind="stable")]
            keys = keys[order]
            order = order[first := np.concatenate([[True], keys[1:] != keys[:-1]])]
            keys, lines, sizes = keys[first], lines[order], sizes[order]
        self.keys, self.lines, self.sizes = keys, lines, sizes

    def matches(self, keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each searched suffix, the length of its longest match, the earliest line of the nearest suffix and its size."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int32)
        at = np.searchsorted(self.keys, keys, side="left")
        after = np.minimum(at, len(self.keys) - 1)
        before = np.maximum(at - 1, 0)
        x, y = common_prefix(keys, self.keys[after], width), common_prefix(keys, self.keys[before], width)
        best = np.where((x > y) | ((x == y) & (self.lines[after] <= self.lines[before])), after, before)
        return np.maximum(x, y), self.lines[best], self.sizes[best]


def earlier_matches(keys: np.ndarray, lines: np.ndarray, indexed: np.ndarray, width: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of one batch, sorted by key and line, the length of its longest match among the indexed entries of
    earlier lines and the earliest line that has it; 0 and -1 where none has `least` bytes.

    Common prefixes shrink with distance in sorted order, so the longest match is the nearest entry of an earlier line on
    one of the two sides. An entry of no earlier line passes the search on to the one it stopped at itself.
    """
    n = len(keys)
    length, line = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    if not n:
        return length, line
    group = np.cumsum(np.concatenate([[True], keys[1:] != keys[:-1]])) - 1
    at = np.flatnonzero(indexed)
    first = np.full(group[-1] + 1, n, np.int64)
    np.minimum.at(first, group[at], at)
    head = keys.astype(f"S{least}")
    block = np.cumsum(np.concatenate([[True], head[1:] != head[:-1]]))
    for way in (1, -1):
        lines_, indexed_, block_ = lines[::way], indexed[::way], block[::way]
        near = np.concatenate([[-1], np.maximum.accumulate(np.where(indexed_, np.arange(n), -1))[:-1]])
        todo = np.arange(n)
        while len(todo):
            to = near[todo]
            near[todo[(to >= 0) & (block_[to] != block_[todo])]] = -1
            todo = todo[near[todo] >= 0]
            todo = todo[lines_[near[todo]] >= lines_[todo]]
            near[todo] = near[near[todo]]
        who = np.flatnonzero(near >= 0)
        i, j = (who, near[who]) if way == 1 else (n - 1 - who, n - 1 - near[who])
        m, owner = common_prefix(keys[i], keys[j], width), lines[first[group[j]]]
        better = (m >= least) & ((m > length[i]) | ((m == length[i]) & (owner < line[i])))
        length[i[better]], line[i[better]] = m[better], owner[better]
    return length, line


def merged(a: Segment, b: Segment) -> Segment:
    """Both arrays in one; the sort meets two sorted runs and merges them."""
    return Segment(np.concatenate([a.keys, b.keys]), np.concatenate([a.lines, b.lines]), np.concatenate([a.sizes, b.sizes]))
