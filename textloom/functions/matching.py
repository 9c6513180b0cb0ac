"""Runs of words that two sequences share: the longest run first, of those the first of the one and then of the other sequence, and so on to its left and to its right."""

from __future__ import annotations

Block = tuple[int, int, int]

#: Pairs of equal words up to which all runs are listed at once; beyond it, as in texts that repeat themselves, each longest run is looked for by itself, in linear time.
LISTED_PAIRS = 2_000_000


def numbered(a: list, b: list):
    import numpy as np

    known: dict = {}
    return tuple(np.array([known.setdefault(w, len(known)) for w in words], np.int64) for words in (a, b))


def all_runs(a, b):
    """(start in a, start in b, length) of every run that cannot be made longer, as arrays; None if there are too many pairs."""
    import numpy as np

    order = np.argsort(b, kind="stable")
    low, high = (np.searchsorted(b[order], a, side=side) for side in ("left", "right"))
    each = high - low
    if each.sum() > LISTED_PAIRS:
        return None
    i = np.repeat(np.arange(len(a)), each)
    j = order[np.arange(len(i)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(low, each)]
    by_diagonal = np.lexsort((i, j - i))
    i, j = i[by_diagonal], j[by_diagonal]
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(j - i) != 0) | (np.diff(i) != 1)])) if len(i) else np.array([], int)
    return i[starts], j[starts], np.diff(np.append(starts, len(i)))


def longest_listed(runs, a_low: int, a_high: int, b_low: int, b_high: int):
    """(the longest run within the bounds, the runs that reach into them)."""
    import numpy as np

    i, j, size = runs
    cut = np.maximum(0, np.maximum(a_low - i, b_low - j))
    inside = np.minimum(size, np.minimum(a_high - i, b_high - j)) - cut
    able = inside > 0
    if not able.any():
        return None, runs
    i, j, inside = (i + cut)[able], (j + cut)[able], inside[able]
    best = inside.max()
    at = np.flatnonzero(inside == best)
    at = at[np.lexsort((j[at], i[at]))[0]]
    return (int(i[at]), int(j[at]), int(best)), (i, j, inside)


def longest_searched(a: list[int], b: list[int], a_low: int, a_high: int, b_low: int, b_high: int) -> Block | None:
    """The same by an automaton of all of b's runs, whose states know where their runs end first."""
    after, shorter, length, ends = [{}], [-1], [0], [-1]
    last = 0
    for j in range(b_low, b_high):
        now, at = len(after), last
        after.append({})
        shorter.append(0)
        length.append(length[last] + 1)
        ends.append(j)
        while at >= 0 and b[j] not in after[at]:
            after[at][b[j]] = now
            at = shorter[at]
        if at >= 0:
            to = after[at][b[j]]
            if length[to] == length[at] + 1:
                shorter[now] = to
            else:
                twin = len(after)
                after.append(dict(after[to]))
                shorter.append(shorter[to])
                length.append(length[at] + 1)
                ends.append(ends[to])
                shorter[to] = shorter[now] = twin
                while at >= 0 and after[at].get(b[j]) == to:
                    after[at][b[j]] = twin
                    at = shorter[at]
        last = now
    state = size = most = 0
    found = None
    for i in range(a_low, a_high):
        while state and a[i] not in after[state]:
            state = shorter[state]
            size = length[state]
        if a[i] in after[state]:
            state, size = after[state][a[i]], size + 1
        if size > most:
            most, found = size, (i - size + 1, ends[state] - size + 1, size)
    return found


def shared_runs(a: list, b: list) -> list[Block]:
    """(start in a, start in b, length), in order; runs that touch in both are one."""
    if a == b:
        return [(0, 0, len(a))] if a else []
    first, second = numbered(a, b)
    runs = all_runs(first, second)
    if runs is None:
        first, second = first.tolist(), second.tolist()
    found: list[Block] = []
    left = [(0, len(a), 0, len(b), runs)]
    while left:
        a_low, a_high, b_low, b_high, runs = left.pop()
        if runs is None:
            best = longest_searched(first, second, a_low, a_high, b_low, b_high)
        else:
            best, runs = longest_listed(runs, a_low, a_high, b_low, b_high)
        if best:
            i, j, size = best
            found.append(best)
            if a_low < i and b_low < j:
                left.append((a_low, i, b_low, j, runs))
            if i + size < a_high and j + size < b_high:
                left.append((i + size, a_high, j + size, b_high, runs))
    joined: list[Block] = []
    for i, j, size in sorted(found):
        if joined and joined[-1][0] + joined[-1][2] == i and joined[-1][1] + joined[-1][2] == j:
            i, j, size = joined[-1][0], joined[-1][1], joined.pop()[2] + size
        joined.append((i, j, size))
    return joined
