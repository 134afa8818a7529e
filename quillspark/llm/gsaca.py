"""Suffix sorting by linear grouping.

First phase: suffixes are grouped by their longest Lyndon prefix.  Groups are processed in descending order.  For every
suffix of a group the nearest smaller suffix before it is found by following previous-smaller pointers; its own prefix grows
by the group's prefix, once for each suffix that points to it, and it moves to a new group just above its old one.
Second phase: the order within the groups is emitted in one ascending pass: a suffix takes the next place of its group when
the suffix after its Lyndon prefix is met.  Nothing is renamed and nothing recurses.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(s: Sequence[int]) -> list[int]:
    """Start positions of all suffixes of ``s`` in ascending order; a suffix sorts before its extensions."""
    n = len(s)
    if n < 2:
        return list(range(n))
    members: list[list[int]] = []
    below: list[int] = []  # the next lower group, as a linked list
    above: list[int] = []
    width: list[int] = []  # length of the common Lyndon prefix
    by_char: dict[int, int] = {}
    group = [0] * n
    for c in sorted(set(s)):
        by_char[c] = len(members)
        members.append([])
        below.append(len(members) - 2)
        above.append(len(members))
        width.append(1)
    above[-1] = -1
    for i, c in enumerate(s):
        g = by_char[c]
        group[i] = g
        members[g].append(i)
    now = len(members) - 1
    done = bytearray(n)
    smaller = [-1] * n
    descending: list[list[int]] = []
    while now >= 0:
        own = [i for i in members[now] if group[i] == now]
        members[now] = own
        if not own:
            now = below[now]
            continue
        for i in own:
            done[i] = 1
        descending.append(own)
        grown: dict[int, int] = {}
        for i in own:  # ascending, so equal pointers are next to each other
            j = i - 1
            while j >= 0 and done[j]:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                grown[j] = grown.get(j, 0) + 1
        if grown:
            add = width[now]
            if len(own) == len(grown):
                levels = [(1, list(grown))]
            else:
                by_count: dict[int, list[int]] = {}
                for p, c in grown.items():
                    by_count.setdefault(c, []).append(p)
                levels = sorted(by_count.items(), reverse=True)
            for c, moved in levels:
                fresh: dict[int, int] = {}
                for p in moved:
                    q = group[p]
                    g = fresh.get(q)
                    if g is None:
                        g = fresh[q] = len(members)
                        members.append([])
                        width.append(width[q] + c * add)
                        up = above[q]
                        below.append(q)
                        above.append(up)
                        above[q] = g
                        if up >= 0:
                            below[up] = g
                    group[p] = g
                    members[g].append(p)
        now = below[now]
    # Second phase.
    place = [0] * len(members)
    at = 0
    for own in reversed(descending):
        place[group[own[0]]] = at
        at += len(own)
    first = [-1] * (n + 1)  # suffixes whose Lyndon prefix ends at a position, as linked lists
    chain = [-1] * n
    for i in range(n):
        e = i + width[group[i]]
        chain[i] = first[e]
        first[e] = i
    out = [0] * n
    i = first[n]
    while i >= 0:
        g = group[i]
        out[place[g]] = i
        place[g] += 1
        i = chain[i]
    for k in range(n):
        i = first[out[k]]
        while i >= 0:
            g = group[i]
            out[place[g]] = i
            place[g] += 1
            i = chain[i]
    return out
