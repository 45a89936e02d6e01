"""Suffix arrays by linear grouping construction."""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """The suffix array of text, whose last symbol must be smaller than all others and occur once.

    First phase: suffixes are grouped, at first by their first symbol, and groups are contiguous ranges of `order`. They
    are processed in descending order. Each member of a group points to the nearest position before it that lies in a
    lower group (its previous smaller suffix). Positions that are pointed to are followed by the group's Lyndon prefix,
    so they are moved to the upper end of their own group and split off there; those with more members pointing to them,
    which are followed by more repetitions of the prefix, end higher. In the end a group's suffixes share their longest
    Lyndon prefix.

    Second phase: suffixes of a group are ordered by what follows that prefix, which is the next smaller suffix. Going
    through the array from the smallest suffix, each suffix s is the next smaller one of s - 1 and of the positions that
    the pointers reach from there, up to one that already has its place; each takes the next place of its group. No
    text of group names is sorted again.
    """
    n = len(text)
    buckets: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        if c in buckets:
            buckets[c].append(i)
        else:
            buckets[c] = [i]
    order: list[int] = []
    start, size, place = [0] * n, [0] * n, [0] * n  # group's start by position; its size by start; index in order
    for c in sorted(buckets):
        first = len(order)
        members = buckets[c]
        for i in members:
            start[i] = first
        order += members
        size[first] = len(members)
    for at, i in enumerate(order):
        place[i] = at

    before = [-1] * n
    end = n
    while end:
        low = start[order[end - 1]]
        members = order[low:end]
        for i in members:
            p = i - 1
            while p >= 0 and start[p] > low:
                p = before[p]
            before[i] = p
        counts: dict[int, int] = {}
        if len(members) == 1:
            p = before[members[0]]
            if p >= 0:
                counts[p] = 1
        else:
            for i in members:  # pointers into the group itself are followed further
                p = before[i]
                if p >= 0 and start[p] == low:
                    chain = []
                    while p >= 0 and start[p] == low:
                        chain.append(p)
                        p = before[p]
                    before[i] = p
                    for q in chain:
                        before[q] = p
                if p >= 0:
                    counts[p] = counts.get(p, 0) + 1
        if counts:
            top = max(counts.values())
            if top == 1:
                levels = [list(counts)]
            else:
                levels = [[] for _ in range(top)]
                for p, k in counts.items():
                    levels[top - k].append(p)
            for level in levels:
                touched = {}
                for p in level:
                    g = start[p]
                    last = g + size[g] - 1
                    q, at = order[last], place[p]
                    order[last], order[at] = p, q
                    place[p], place[q] = last, at
                    size[g] -= 1
                    touched[g] = touched.get(g, 0) + 1
                for g, moved in touched.items():
                    new = g + size[g]
                    if new != g:
                        size[new] = moved
                        for at in range(new, new + moved):
                            start[order[at]] = new
                    else:
                        size[g] = moved
        end = low

    out = [0] * n
    free = list(range(n))  # next free place of a group, by start
    placed = [False] * n
    out[0] = n - 1
    placed[n - 1] = True
    for at in range(n):
        p = out[at] - 1
        while p >= 0 and not placed[p]:
            g = start[p]
            out[free[g]] = p
            free[g] += 1
            placed[p] = True
            p = before[p]
    return out
