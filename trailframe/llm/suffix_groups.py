"""Suffix arrays by linear grouping.

Suffixes are grouped by their longest Lyndon prefix. Groups are worked off from
the greatest down: each suffix of a group finds, by previous-smaller pointers,
the nearest suffix before it that lies in a lower group; that suffix's prefix
swallows the group's, and moves up to a new group right above its old one.
Then, from the least group up, every suffix that is placed places the suffixes
that it follows (Lyndon prefix first, then it): the order inside groups comes
out without comparing or renaming anything again.
"""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Order of the suffixes of a sequence of non-negative numbers."""
    n = len(text)
    if n == 0:
        return []
    # Groups: members, prefix length, neighbours in order (0 is the list's head), members that are left.
    members: list[list[int]] = [[]]
    length, above, below, count = [0], [0], [0], [0]
    group = [0] * n
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        by_symbol.setdefault(c, []).append(i)
    last = 0
    for c in sorted(by_symbol):
        g = len(members)
        members.append(by_symbol[c])
        count.append(len(by_symbol[c]))
        length.append(1)
        below.append(last)
        above.append(0)
        above[last] = g
        last = g
        for i in by_symbol[c]:
            group[i] = g
    top = last
    # Previous pointers of suffixes in groups that are done; -1: none is smaller.
    prev = [-2] * n
    g = top
    while g:
        # Members that have moved on are left out here, once.
        own = members[g] = sorted(i for i in members[g] if group[i] == g)
        counts: dict[int, int] = {}
        for i in own:
            # Earlier members of this group have their pointers already: own is in text order.
            p = i - 1
            while p >= 0 and prev[p] != -2:
                p = prev[p]
            q = i - 1
            while q >= 0 and prev[q] != -2 and prev[q] != p:
                prev[q], q = p, prev[q]
            prev[i] = p
            if p >= 0:
                counts[p] = counts.get(p, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for p, k in counts.items():
            moves.setdefault((group[p], k), []).append(p)
        size = length[g]
        # More repeats of this group's prefix stand higher: insert the highest last.
        for h, k in sorted(moves, reverse=True):
            fresh = len(members)
            moved = moves[(h, k)]
            members.append(moved)
            count.append(len(moved))
            length.append(length[h] + k * size)
            above.append(above[h])
            below.append(h)
            below[above[h]] = fresh
            above[h] = fresh
            for p in moved:
                group[p] = fresh
        for (h, _), moved in moves.items():
            count[h] -= len(moved)
            if not count[h]:
                above[below[h]] = above[h]
                below[above[h]] = below[h]
        g = below[g]
    # Places of the groups, and who follows whom.
    start, at, g = [0] * len(members), 0, above[0]
    while g:
        start[g] = at
        at += len(members[g])
        g = above[g]
    heads: list[list[int]] = [[] for _ in range(n + 1)]
    for i in range(n):
        heads[i + length[group[i]]].append(i)
    order = [0] * n
    for i in heads[n]:
        order[start[group[i]]] = i
        start[group[i]] += 1
    for at in range(n):
        for i in heads[order[at]]:
            order[start[group[i]]] = i
            start[group[i]] += 1
    return order


def common_prefixes(text: list[int], order: list[int]) -> list[int]:
    """Length that each suffix in order shares with the one before it (the first shares 0)."""
    n = len(text)
    rank, out, h = [0] * n, [0] * n, 0
    for r, i in enumerate(order):
        rank[i] = r
    for i in range(n):
        r = rank[i]
        if r == 0:
            h = 0
            continue
        j = order[r - 1]
        while i + h < n and j + h < n and text[i + h] == text[j + h]:
            h += 1
        out[r] = h
        if h:
            h -= 1
    return out
