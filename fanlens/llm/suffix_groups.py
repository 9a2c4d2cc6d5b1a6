"""Suffix arrays by linear grouping, and longest matches with earlier text.

``suffix_array`` sorts suffixes in two phases.  Phase one puts suffixes with the
same Lyndon prefix into one group: groups are taken in descending order, each
member points to the nearest suffix before it that is in a lower group, and the
suffixes pointed to move up behind their old group, by how many members point to
them.  Phase two emits the order: from each placed suffix the chain of pointers
of the suffix before it is followed, and each one met takes the next free place
of its group.  No text is renamed and nothing recurses.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Order of the suffixes of ``text``, which must end in its unique smallest symbol."""
    n = len(text)
    if n < 2:
        return list(range(n))
    members: list[list[int]] = []
    group = [0] * n
    names = {c: k for k, c in enumerate(sorted(set(text)))}
    members = [[] for _ in names]
    for i, c in enumerate(text):
        group[i] = k = names[c]
        members[k].append(i)
    above = [*range(1, len(members)), -1]  # the next higher group
    below = [-1, *range(len(members) - 1)]
    state = [0] * len(members)  # 0 lower than the current group, 1 current, 2 done
    size = [len(m) for m in members]
    parent = [-1] * n

    g = len(members) - 1
    while g >= 0:
        own = members[g] if len(members[g]) == size[g] else [i for i in members[g] if group[i] == g]
        own.sort()
        state[g] = 1
        pointed: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and state[group[j]]:
                j = parent[j]
            parent[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        state[g] = 2
        moved: dict[tuple[int, int], list[int]] = {}
        for j, times in pointed.items():
            moved.setdefault((-times, group[j]), []).append(j)
        for (_, old), up in sorted(moved.items()) if len(moved) > 1 else moved.items():
            new = len(members)
            members.append(up)
            size.append(len(up))
            size[old] -= len(up)
            state.append(0)
            over = above[old]
            above.append(over)
            below.append(old)
            above[old] = new
            if over >= 0:
                below[over] = new
            for j in up:
                group[j] = new
        g = below[g]

    free = [0] * len(members)  # the next free place of each group
    g, place = 0, 0
    while below[g] >= 0:
        g = below[g]
    while g >= 0:
        free[g] = place
        place += size[g]
        g = above[g]
    order = [-1] * n
    placed = [False] * n
    order[0] = n - 1
    placed[n - 1] = True
    free[group[n - 1]] += 1
    for k in range(n):
        j = order[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            order[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = parent[j]
    return order


def common_prefixes(text: Sequence[int], order: list[int]) -> list[int]:
    """Length of the common prefix of each suffix in order with the one before it."""
    n = len(text)
    rank = [0] * n
    for k, i in enumerate(order):
        rank[i] = k
    out = [0] * n
    length = 0
    for i in range(n):
        if rank[i]:
            j = order[rank[i] - 1]
            while i + length < n and j + length < n and text[i + length] == text[j + length]:
                length += 1
            out[rank[i]] = length
            if length:
                length -= 1
        else:
            length = 0
    return out


def longest_earlier(order: list[int], common: list[int], age: Sequence[int]) -> list[int]:
    """For each suffix the longest prefix it shares with a suffix of smaller ``age`` (all ages differ).

    Suffixes leave the order from the oldest age down; what is left next to one is
    earlier, and the shared prefix of neighbours is the minimum over those that left."""
    n = len(order)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    shared = [*common, 0]  # with the left neighbour
    rank = [0] * n
    for k, i in enumerate(order):
        rank[i] = k
    out = [0] * n
    for i in sorted(range(n), key=age.__getitem__, reverse=True):
        k = rank[i]
        a, b = left[k], right[k]
        before, after = shared[k] if a >= 0 else 0, shared[b] if b < n else 0
        out[i] = max(before, after)
        if b < n:
            left[b] = a
            shared[b] = min(before, after)
        if a >= 0:
            right[a] = b
    return out
