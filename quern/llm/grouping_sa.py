"""Suffix arrays by grouping: suffixes are grouped by their Lyndon prefixes, then the groups are read out in order.

First the groups are taken from the highest down.  A group's suffixes point to the nearest smaller ones before them, whose
prefixes grow by the group's own; those move to the end of their groups, the ones that grow more often last.
A group's name is where it starts, so nothing is named anew.  Then suffixes are placed from the smallest
up: each puts those that end where it begins at the front of their groups.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> list[int]:
    """Starts of the suffixes of ``text`` (numbers from 0) in lexicographic order; a prefix comes first."""
    n = len(text)
    if not n:
        return []
    order = np.argsort(text, kind="stable")
    first = np.searchsorted(text[order], text)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    sa, isa, group = order.tolist(), rank.tolist(), first.tolist()
    end = [0] * n  # of the group that starts here
    starts, sizes = np.unique(first, return_counts=True)
    for s, k in zip(starts.tolist(), sizes.tolist()):
        end[s] = s + k
    before = [-1] * n
    high = n
    while high:
        low = group[sa[high - 1]]
        if high - low == 1:
            i = sa[low]
            j = i - 1
            while j >= 0 and group[j] >= low:
                j = before[j]
            before[i] = j
            if j >= 0:
                s = group[j]
                last = end[s] - 1
                if last > s:
                    at, other = isa[j], sa[last]
                    sa[at], sa[last] = other, j
                    isa[other], isa[j] = at, last
                    end[s] = last
                    end[last] = last + 1
                    group[j] = last
            high = low
            continue
        times: dict[int, int] = {}
        for i in sorted(sa[low:high]):
            j = i - 1
            while j >= 0 and group[j] >= low:
                j = before[j]
            before[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        if times:
            most = max(times.values())
            by_times = [list(times)] if most == min(times.values()) else [[j for j in times if times[j] == k] for k in range(most, 0, -1)]
            for grown in by_times:
                moved: dict[int, int] = {}
                for j in grown:
                    s = group[j]
                    if s not in moved:
                        moved[s] = end[s]
                    last = end[s] - 1
                    at, other = isa[j], sa[last]
                    sa[at], sa[last] = other, j
                    isa[other], isa[j] = at, last
                    end[s] = last
                for s, stop in moved.items():
                    start = end[s]
                    end[start] = stop
                    if start != s:
                        for at in range(start, stop):
                            group[sa[at]] = start
        high = low
    placed = [False] * n
    out = [-1] * n
    front = list(range(n))  # the first free place of the group that starts here

    def place(j: int) -> None:
        while j >= 0 and not placed[j]:
            s = group[j]
            out[front[s]] = j
            front[s] += 1
            placed[j] = True
            j = before[j]

    place(n - 1)
    for at in range(n):
        place(out[at] - 1)
    return out
