"""Suffix sorting by grouping on Lyndon prefixes, in two passes over the suffixes.

Suffixes start in groups by their first byte; a group is the run of places that
its suffixes take in the suffix array, and its number is the first of them.

1. Groups are taken from the highest down. Each suffix of the group gets the
   nearest smaller-grouped suffix before it (its previous-smaller pointer, found
   by following the pointers of what lies between). Suffixes that are pointed to
   leave their groups for new ones right behind, those with more pointers higher
   up: their known prefix has grown by that many copies of the group's prefix.
   In the end suffixes are grouped by their longest Lyndon prefix.
2. From the smallest suffix on, the suffix before each one placed, and what its
   pointers lead to, take the next place of their groups. No ranks are renamed
   and nothing recurs.
"""

from __future__ import annotations

from collections import Counter


def suffix_array(text: bytes) -> list[int]:
    """The starts of the suffixes of ``text`` in order."""
    n = len(text)
    if n < 2:
        return list(range(n))
    first: dict[int, int] = {}
    at = 0
    count = Counter(text)
    for c in sorted(count):
        first[c] = at
        at += count[c]
    place = [0] * n  # the places; what stands there is some suffix of the group
    where = [0] * n
    fill = dict(first)
    group = [0] * n
    for i, c in enumerate(text):
        k = fill[c]
        fill[c] = k + 1
        place[k], where[i], group[i] = i, k, first[c]
    end = {first[c]: first[c] + count[c] for c in count}
    before = [-1] * n

    top = n
    while top > 0:
        start = group[place[top - 1]]
        if start + 1 == top:  # a suffix alone: by far the most common case
            i = place[start]
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = before[p]
            before[i] = p
            if p >= 0 and (e := end[g := group[p]] - 1) > g:
                end[g] = e
                k, other = where[p], place[e]
                place[k], where[other] = other, k
                place[e], where[p], group[p], end[e] = p, e, e, e + 1
            top = start
            continue
        own = place[start:top]
        own.sort()
        pointed: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = before[p]
            before[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if pointed:
            if len(pointed) == 1:
                sets = [list(pointed)]
            else:
                by: dict[int, list[int]] = {}
                for p, c in pointed.items():
                    if c in by:
                        by[c].append(p)
                    else:
                        by[c] = [p]
                sets = [by[c] for c in sorted(by, reverse=True)]
            for some in sets:
                moved: dict[int, int] = {}
                for p in some:  # to the end of the group's places
                    g = group[p]
                    e = end[g] - 1
                    end[g] = e
                    moved[g] = moved.get(g, 0) + 1
                    k, other = where[p], place[e]
                    place[k], where[other] = other, k
                    place[e], where[p] = p, e
                for g, m in moved.items():
                    s = end[g]
                    if s == g:
                        end[g] = g + m  # the whole group has moved: it stays as it is
                        continue
                    end[s] = s + m
                    for k in range(s, s + m):
                        group[place[k]] = s
        top = start

    order = [-1] * n
    free = {}
    for i in range(n):
        free.setdefault(group[i], group[i])
    placed = [False] * n

    # what the end of the text stands before, then what each placed suffix stands before
    for k in range(-1, n):
        j = n - 1 if k < 0 else order[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            f = free[g]
            order[f] = j
            free[g] = f + 1
            placed[j] = True
            j = before[j]
    return order
