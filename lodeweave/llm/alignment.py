"""Patience alignment of two sequences."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter


def increasing(places: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    last: list[int] = []
    before = [-1] * len(places)
    for i, p in enumerate(places):
        k = bisect_left(tops, p)
        before[i] = last[k - 1] if k else -1
        tops[k:k + 1] = [p]
        last[k:k + 1] = [i]
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places of two sequences."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        i, m, j, n = gaps.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        of_a, of_b = Counter(a[i:m]), Counter(b[j:n])
        once = {x: j + k for k, x in enumerate(b[j:n]) if of_b[x] == 1}
        both = [(i + k, once[x]) for k, x in enumerate(a[i:m]) if of_a[x] == 1 and x in once]
        kept = [both[k] for k in increasing([q for _, q in both])]
        out += kept
        if kept:
            edges = [(i - 1, j - 1), *kept, (m, n)]
            gaps += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:], strict=False)]
    return sorted(out)
