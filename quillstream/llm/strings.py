"""Letters of a text, and distances between letter strings by bit-parallel integers."""

from __future__ import annotations

import re
import unicodedata

_NOT_LETTER = re.compile(r"[\W_]+")


def letters(text: str) -> str:
    """Letters and digits after compatibility composition, without case."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _NOT_LETTER.sub("", text.casefold())


def _masks(a: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    bit = 1
    for c in a:
        masks[c] = masks.get(c, 0) | bit
        bit <<= 1
    return masks


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or most + 1 if it is greater. Equal ends are cut off first."""
    if a == b:
        return 0
    n = min(len(a), len(b))
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a or not b:
        return max(len(a), len(b))
    masks, full, top = _masks(a), (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score, left = full, 0, len(a), len(b)
    for c in b:
        eq = masks.get(c, 0)
        x = eq | minus
        h = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(h | plus) & full
        down = plus & h
        left -= 1
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        if score - left > most:
            return most + 1
        up = ((up << 1) | 1) & full
        down = (down << 1) & full
        plus = down | ~(x | up) & full
        minus = up & x
    return score


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    if not a or not b:
        return 0
    masks, full = _masks(a), (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & masks.get(c, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def shingles(s: str, n: int) -> set[str]:
    return {s[i : i + n] for i in range(len(s) - n + 1)} if len(s) >= n else ({s} if s else set())
