"""Suffix sorting by Lyndon groups, and the runs of a string collection that share windows.

Suffixes are first grouped by their longest Lyndon prefix. Groups are taken in descending order; each element points
to the nearest earlier suffix in a lower group, and those suffixes, split by how many pointers they got, move to new
groups right above their old ones, as their prefix is extended by the group's. A second sweep in ascending order then
puts every suffix at the next free place of its group. No names are reassigned and nothing recurs.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(s: Sequence[int]) -> list[int]:
    """Positions of the suffixes of ``s`` in ascending order. A suffix that is a prefix of another comes first."""
    n = len(s)
    if n < 2:
        return list(range(n))
    names = {c: g for g, c in enumerate(sorted(set(s)))}
    group = [names[c] for c in s]
    members: list[list[int]] = [[] for _ in names]
    for i, g in enumerate(group):
        members[g].append(i)
    below = list(range(-1, len(names) - 1))  # the next lower group of each
    above = [*range(1, len(names)), -1]
    prev, done = [-1] * n, bytearray(n)
    order: list[int] = []  # final groups, descending
    g = len(names) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = own
        if own:
            order.append(g)
            pointed: dict[int, int] = {}
            for i in own:
                j = i - 1
                while j >= 0 and (done[j] or group[j] == g):
                    j = prev[j]
                prev[i] = j
                if j >= 0:
                    pointed[j] = pointed.get(j, 0) + 1
            for i in own:
                done[i] = 1
            if pointed:
                _split(pointed, group, members, below, above)
        g = below[g]
    start: dict[int, int] = {}
    at = 0
    for g in reversed(order):
        start[g] = at
        at += len(members[g])
    out, placed = [-1] * n, bytearray(n)

    def settle(j: int) -> None:
        while j >= 0 and not placed[j]:
            placed[j] = 1
            g = group[j]
            out[start[g]] = j
            start[g] += 1
            j = prev[j]

    settle(n - 1)
    for r in range(n):
        settle(out[r] - 1)
    return out


def _split(pointed: dict[int, int], group: list[int], members: list[list[int]], below: list[int], above: list[int]) -> None:
    """Move the pointed-to suffixes to new groups just above their old ones, those with more pointers higher."""
    by_count: dict[int, list[int]] = {}
    for j, k in pointed.items():
        by_count.setdefault(k, []).append(j)
    for k in sorted(by_count, reverse=True):
        new: dict[int, int] = {}
        for j in by_count[k]:
            old = group[j]
            g = new.get(old)
            if g is None:
                g = new[old] = len(members)
                members.append([])
                up = above[old]
                below.append(old)
                above.append(up)
                above[old] = g
                if up >= 0:
                    below[up] = g
            members[g].append(j)
            group[j] = g


def shared_windows(strings: Sequence[bytes], width: int) -> list[list[tuple[int, int]]]:
    """Classes of equal windows of ``width`` bytes that occur in the collection more than once, as lists of (string, offset)."""
    text: list[int] = []
    owner: list[tuple[int, int, int]] = []
    for k, b in enumerate(strings):
        text += [c + 1 for c in b]
        owner += [(k, i, len(b) - i) for i in range(len(b))]
        text.append(0)
        owner.append((k, len(b), 0))
    out: list[list[tuple[int, int]]] = []
    last, run = None, []
    for at in suffix_array(text):
        k, i, left = owner[at]
        if left < width:
            continue
        window = strings[k][i : i + width]
        if window == last:
            run.append((k, i))
            continue
        if len(run) > 1:
            out.append(run)
        last, run = window, [(k, i)]
    if len(run) > 1:
        out.append(run)
    return out
