"""Suffix arrays by linear grouping, without recursive renaming.

First the suffixes are grouped by their Lyndon prefix, the longest prefix that is a Lyndon word. All start in the group
of their first symbol. Groups are taken in descending order; each suffix of the group finds the nearest earlier one in
a lower group, its previous-smaller pointer. Those pointed at are followed by the group's prefix, once for
each pointer, and move to new groups just above what remains of their own, fewer repeats below more. So every
suffix causes one move, and at the end groups stand in the order of their prefixes.

Then the order within groups follows from that of what comes after the prefix: going up through the suffix array, the
suffix before the current one, and those its pointers lead to as long as they have no place, take the next free
place of their groups.
"""

from __future__ import annotations

from collections.abc import Sequence


def lyndon_groups(symbols: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """For each suffix its group and its pointer (-1: none), and the groups in ascending order; the last symbol must be the smallest, and the only such."""
    members: list[list[int]] = []
    names: dict[int, int] = {}
    group = []
    for i, symbol in enumerate(symbols):
        g = names.get(symbol)
        if g is None:
            g = names[symbol] = len(members)
            members.append([])
        members[g].append(i)
        group.append(g)
    ordered = [names[s] for s in sorted(names)]
    below = [-1] * len(members)
    above = [-1] * len(members)
    for low, high in zip(ordered, ordered[1:]):
        below[high], above[low] = low, high
    done = [False] * len(members)
    pointer = [-1] * len(group)

    current = ordered[-1]
    top = current
    while current >= 0:
        # Suffixes in ascending order; those that have moved on are left out.
        counts: dict[int, int] = {}
        for s in members[current]:
            if group[s] != current:
                continue
            p = s - 1
            while p >= 0 and done[group[p]]:
                p = pointer[p]
            if p >= 0 and group[p] == current:
                p = pointer[p]
            pointer[s] = p
            if p >= 0:
                counts[p] = counts.get(p, 0) + 1
        done[current] = True
        # One new group for each pair of an old group and a number of repeats.
        made: dict[int, dict[int, int]] = {}
        for p, k in counts.items():
            old = group[p]
            by_count = made.get(old)
            if by_count is None:
                by_count = made[old] = {}
            new = by_count.get(k)
            if new is None:
                new = by_count[k] = len(members)
                members.append([p])
                below.append(-1)
                above.append(-1)
                done.append(False)
            else:
                members[new].append(p)
            group[p] = new
        for old, by_count in made.items():
            low = old
            for k in sorted(by_count) if len(by_count) > 1 else by_count:
                new, high = by_count[k], above[low]
                below[new], above[new], above[low] = low, high, new
                if high >= 0:
                    below[high] = new
                low = new
        current = below[current]
    while above[top] >= 0:
        top = above[top]
    order = []
    while top >= 0:
        order.append(top)
        top = below[top]
    return group, pointer, order[::-1]


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """The suffixes of ``symbols`` in ascending order; the last symbol must be the smallest, and the only such."""
    size = len(symbols)
    group, pointer, order = lyndon_groups(symbols)
    sizes = [0] * (max(group) + 1)
    for g in group:
        sizes[g] += 1
    free, start = [0] * len(sizes), 0
    for g in order:
        if g < len(sizes):
            free[g] = start
            start += sizes[g]
    result = [0] * size
    placed = bytearray(size)
    result[0] = size - 1
    placed[size - 1] = 1
    for i in range(size):
        s = result[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            result[free[g]] = s
            free[g] += 1
            placed[s] = 1
            s = pointer[s]
    return result
