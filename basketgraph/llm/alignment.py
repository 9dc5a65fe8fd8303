"""Patience alignment of two sequences."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Hashable, Sequence


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of ``pairs`` (sorted by the first) that increases in the second."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        place = bisect_left(tails, j)
        if place == len(tails):
            tails.append(j)
            at.append(k)
        else:
            tails[place], at[place] = j, k
        back[k] = at[place - 1] if place else -1
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def longest_run(a: Sequence[Hashable], b: Sequence[Hashable]) -> tuple[int, int, int]:
    """(start in a, start in b, length) of a longest run of elements that both hold; of several
    the first in b, at its first place in a. By a suffix automaton of a, in linear time."""
    step: list[dict[Hashable, int]] = [{}]
    link, length, end = [-1], [0], [-1]
    last = 0
    for i, x in enumerate(a):
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        end.append(i)
        p, last = last, new
        while p >= 0 and x not in step[p]:
            step[p][x] = new
            p = link[p]
        if p < 0:
            continue
        q = step[p][x]
        if length[q] == length[p] + 1:
            link[new] = q
            continue
        twin = len(step)
        step.append(dict(step[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        end.append(end[q])
        while p >= 0 and step[p].get(x) == q:
            step[p][x] = twin
            p = link[p]
        link[q] = link[new] = twin
    best, state, n = (0, 0, 0), 0, 0
    for j, x in enumerate(b):
        while state and x not in step[state]:
            state = link[state]
            n = length[state]
        if x in step[state]:
            state, n = step[state][x], n + 1
        if n > best[2]:
            best = (end[state] - n + 1, j - n + 1, n)
    return best


def align(a: Sequence[Hashable], b: Sequence[Hashable], repeats: bool = True) -> list[tuple[int, int]]:
    """Matched index pairs of ``a`` and ``b``, increasing in both.

    Equal heads and tails match; between them, elements that occur once on both sides are
    anchors, of which the longest increasing run is kept; each gap between anchors is
    aligned the same way. In a gap without anchors the longest run that both sides hold is
    matched (without ``repeats`` nothing is). An explicit stack stands for the recursion, so
    depth does not grow with the input.
    """
    out: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {x: j for j, x in enumerate(b[b0:b1], b0) if in_b[x] == 1}
        anchors = increasing([(i, place[x]) for i, x in enumerate(a[a0:a1], a0) if in_a[x] == 1 and x in place])
        if not anchors and repeats and not in_a.keys().isdisjoint(in_b):
            i, j, n = longest_run(a[a0:a1], b[b0:b1])
            anchors = [(a0 + i + k, b0 + j + k) for k in range(n)]
        if not anchors:
            continue
        out += anchors
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
            if k - i > 1 and m - j > 1:
                stack.append((i + 1, k, j + 1, m))
    return sorted(out)
