"""Plain Python models of the engine's results."""

from __future__ import annotations

import heapq
from collections import Counter


def weight(program: str, u: int, v: int) -> int:
    return {"bfs": 1, "sssp": (u + v) % 128 + 1, "min_label": 0}[program]


def solve(program: str, n: int, bag: Counter, source: int = 0) -> dict[int, int]:
    out: dict[int, list[int]] = {}
    for (u, v), c in bag.items():
        if c > 0 and 0 <= u < n and 0 <= v < n:
            out.setdefault(u, []).append(v)
    best: dict[int, int] = {}
    heap = [(0, source)] if program != "min_label" else [(v, v) for v in range(n)]
    heapq.heapify(heap)
    while heap:
        d, u = heapq.heappop(heap)
        if u in best:
            continue
        best[u] = d
        for v in out.get(u, []):
            if v not in best:
                heapq.heappush(heap, (d + weight(program, u, v), v))
    return best


def apply(n: int, bag: Counter, batch: list[tuple[str, int, int]]) -> tuple[Counter, Counter, dict[str, int]]:
    """The bag after deletes, after adds, and metrics."""
    after = Counter(bag)
    missing = invalid = 0
    changed, touched = set(), set()
    for op, u, v in batch:
        if op == "d":
            if 0 <= u < n and after[u, v] > 0:
                after[u, v] -= 1
                changed.add(u)
            else:
                missing += 1
        if 0 <= u < n:
            touched.add(u)
    last = Counter(after)
    for op, u, v in batch:
        if op == "a":
            if 0 <= u < n:
                last[u, v] += 1
                changed.add(u)
            else:
                invalid += 1
    total = {"additions": sum(b[0] == "a" for b in batch), "deletions": sum(b[0] == "d" for b in batch), "touched_sources": len(touched), "changed_sources": len(changed), "missing_deletes": missing, "invalid_additions": invalid}
    total["max_source_work"] = max(Counter(u for _, u, _ in batch).values(), default=0)
    return +after, +last, total


def pagerank(n: int, bag: Counter, rounds: int = 300) -> list[float]:
    degree = Counter()
    for (u, _), c in bag.items():
        degree[u] += c
    x = [0.15] * n
    for _ in range(rounds):
        y = [0.15] * n
        for (u, v), c in bag.items():
            if c > 0 and u < n and v < n:
                y[v] += 0.85 * x[u] * c / degree[u]
        x = y
    return x
