"""Phrases that follow themselves, in many lines at once.

A phrase of ``p`` words that stands twice in a row covers a place ``i`` that is a multiple of ``p``, and there the words that agree from ``i`` and ``i + p`` on, and those that
agree before them, are ``p`` together. So for each ``p`` only every ``p``-th place is looked at, n log n in all, and how far two places agree is found by bisection over
running hashes. Whatever is found is compared word by word before it counts.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Places looked at together.
_TOGETHER = 1 << 19
#: Phrases of fewer words are looked for at every place; longer ones only in lines in which so many words stand twice.
_SHORT = 6


def repeats_itself(words: list) -> bool:
    """A phrase of two words or more that follows itself: looked for where a pair of neighbouring words occurs again."""
    n, places = len(words), {}
    for i in range(n - 1):
        places.setdefault((words[i], words[i + 1]), []).append(i)
    for at in places.values():
        for x, i in enumerate(at):
            for j in at[x + 1 :]:
                if 2 * j - i > n:
                    break
                if j - i >= 2 and words[i:j] == words[j : 2 * j - i]:
                    return True
    return False


def _agree(sums, power, left, right, cap, forward: bool):
    """How many words agree from ``left`` and ``right`` on (or before them), at most ``cap``."""
    got = np.zeros(len(left), np.int64)
    step = 1 << int(cap.max(initial=0)).bit_length()
    while step:
        more = got + step
        able = np.flatnonzero(more <= cap)
        n = more[able]
        a = left[able] if forward else left[able] - n
        b = right[able] if forward else right[able] - n
        same = (sums[a + n] - sums[a]) * power[b - a] == sums[b + n] - sums[b]
        got[able[same]] += step
        step >>= 1
    return got


def _sifted(numbers: np.ndarray, line: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line whether a phrase of two to ``_SHORT - 1`` words follows itself, and whether a longer one can: some ``_SHORT`` words stand twice in it."""
    short, able = np.zeros(lines, bool), np.zeros(lines, bool)
    for p in range(2, _SHORT):
        if len(numbers) < 2 * p:
            return short, able
        same = (numbers[:-p] == numbers[p:]) & (line[:-p] == line[p:])
        run = same[: len(same) - p + 1].copy()
        for j in range(1, p):
            run &= same[j : len(same) - p + 1 + j]
        short[line[:-p][np.flatnonzero(run)]] = True
    whole = np.flatnonzero(line[: 1 - _SHORT] == line[_SHORT - 1 :])
    grams = line[whole].astype(np.uint64) * _BASE
    for j in range(_SHORT):
        grams = (grams ^ (grams >> np.uint64(31)) ^ numbers[whole + j].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    ranked = np.sort(grams)
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if len(twice):
        at = np.searchsorted(twice, grams)
        able[line[whole[twice[np.minimum(at, len(twice) - 1)] == grams]]] = True
    return short, able


def with_repeated_phrase(numbers: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each line ``numbers[off[i]:off[i + 1]]`` (a number for each word) whether a phrase of two words or more follows itself."""
    size = np.diff(off)
    line = np.repeat(np.arange(len(size)), size)
    out, able = _sifted(numbers, line, len(size))
    left = np.flatnonzero(able & ~out)
    if len(left):
        own = np.zeros(len(size), bool)
        own[left] = True
        out[left] = _long_phrase(numbers[own[line]], np.concatenate([[0], np.cumsum(size[left])]))
    return out


def _long_phrase(numbers: np.ndarray, off: np.ndarray) -> np.ndarray:
    """``with_repeated_phrase`` for lines in which a long phrase is likely."""
    n, size = len(numbers), np.diff(off)
    out = np.zeros(len(size), bool)
    longest = int(size.max(initial=0))
    if longest < 4:
        return out
    line = np.repeat(np.arange(len(size)), size)
    mixed = (numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    power = np.full(n + 1, _BASE, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((mixed ^ (mixed >> np.uint64(32))) * power[:n], out=sums[1:])
    p = 2
    while 2 * p <= longest:
        to = p
        total = 0
        while 2 * to <= longest and (to == p or total + n // to < _TOGETHER):
            total += n // to
            to += 1
        each = np.arange(p, to)
        count = (n - 1) // each
        period = np.repeat(each, count)
        at = period * (np.arange(len(period)) - np.repeat(np.cumsum(count) - count, count))
        p = to
        keep = (line[at] == line[at + period]) & ~out[line[at]]
        at, period = at[keep], period[keep]
        own = line[at]
        after = _agree(sums, power, at, at + period, np.minimum(period, off[own + 1] - at - period), True)
        before = _agree(sums, power, at, at + period, np.minimum(period - 1, at - off[own]), False)
        for i in np.flatnonzero(after + before >= period).tolist():
            if not out[own[i]]:
                a, k = int(at[i] - before[i]), int(period[i])
                words = numbers[off[own[i]] : off[own[i] + 1]]
                out[own[i]] = np.array_equal(numbers[a : a + k], numbers[a + k : a + 2 * k]) or repeats_itself(words.tolist())
    return out
