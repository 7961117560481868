"""Suffix arrays by linear grouping: Lyndon prefixes first, then each group's order."""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(s: Sequence[int]) -> list[int]:
    """Suffix order of ``s``, whose last symbol must be the least and occur once.

    First pass: suffixes are grouped by their first symbol, and groups are taken from
    the greatest down.  Every suffix of the group points to the nearest one before it in
    a lower group (through the pointers of those between).  A suffix pointed to is
    continued by that group, so it leaves its group and stands right behind what stays,
    the further behind the more pointers it has.  In the end suffixes with the same
    longest Lyndon prefix form a group, and groups are in order.

    Second pass: suffixes are emitted in order.  After each, the suffix before it, and
    those its pointers lead to, take the next free places of their groups, until one is
    there already.  No group is sorted or renamed again.
    """
    n = len(s)
    order = sorted(range(n), key=s.__getitem__)
    place, start, size, prev = [0] * n, [0] * n, [0] * (n + 1), [-1] * n
    at, last = 0, None
    for k, i in enumerate(order):
        if s[i] != last:
            at, last = k, s[i]
        place[i], start[i] = k, at
        size[at] += 1
    top = n - 1
    while top >= 0:
        low = start[order[top]]
        if low == top:  # a group of one
            i = order[top]
            p = i - 1
            while p >= 0 and start[p] >= low:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                g = start[p]
                size[g] -= 1
                end = g + size[g]
                if end != g:
                    q, k = order[end], place[p]
                    order[k], place[q] = q, k
                    order[end], place[p], start[p] = p, end, end
                size[end] = 1
        else:
            count: dict[int, int] = {}
            for i in sorted(order[low:top + 1]):
                p = i - 1
                while p >= 0 and start[p] >= low:
                    p = prev[p]
                prev[i] = p
                if p >= 0:
                    count[p] = count.get(p, 0) + 1
            levels: dict[tuple[int, int], list[int]] = {}
            for p, c in count.items():
                levels.setdefault((c, start[p]), []).append(p)
            for c, g in sorted(levels, reverse=True) if len(levels) > 1 else levels:
                moved = levels[c, g]
                size[g] -= len(moved)
                end = g + size[g]
                spot = end + len(moved)
                for p in moved:
                    spot -= 1
                    q, k = order[spot], place[p]
                    order[k], place[q] = q, k
                    order[spot], place[p] = p, spot
                    start[p] = end
                size[end] = len(moved)
        top = low - 1
    out, free = [-1] * n, list(range(n))
    out[0] = n - 1
    done = bytearray(n)
    done[n - 1] = 1
    free[start[n - 1]] += 1
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not done[j]:
            g = start[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = 1
            j = prev[j]
    return out
