"""Plain versions that the operators are held against."""

import heapq
from collections.abc import Sequence


def capped_targets(sizes: Sequence[int], weights: Sequence[float], share: float = 1.5, most: float = 2) -> list[float]:
    """Targets by weight that add up to ``share`` of all sizes; what is above ``most`` times a size is shared out again."""
    targets, fixed = [0.0] * len(sizes), set()
    total = share * sum(sizes)
    while len(fixed) < len(sizes):
        left = total - sum(targets[i] for i in fixed)
        free = [i for i in range(len(sizes)) if i not in fixed]
        weight = sum(weights[i] for i in free)
        for i in free:
            targets[i] = left * weights[i] / weight
        above = [i for i in free if targets[i] > most * sizes[i]]
        if not above:
            break
        for i in above:
            targets[i] = most * sizes[i]
        fixed.update(above)
    return targets


def plain_flow(patterns: Sequence[tuple[int, Sequence[int]]], quotas: Sequence[int], passes: int) -> list[dict[int, int]]:
    """Cheapest augmenting paths one by one, by Dijkstra's method with potentials; words of each pattern to each source."""
    n, m = len(patterns), len(quotas)
    start, end = n + m, n + m + 1
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []
    arcs: list[list[int]] = [[] for _ in range(n + m + 2)]

    def arc(a: int, b: int, capacity: int, price: int) -> None:
        for node, other, r, c in ((a, b, capacity, price), (b, a, 0, -price)):
            arcs[node].append(len(to))
            to.append(other)
            room.append(r)
            cost.append(c)

    middle = {}
    for p, (words, sources) in enumerate(patterns):
        for k in range(passes):
            arc(start, p, words, 2**k)
        for s in sources:
            middle[p, s] = len(to)
            arc(p, n + s, passes * words, 0)
    for s, quota in enumerate(quotas):
        arc(n + s, end, quota, 0)
    height = [0] * len(arcs)
    while True:
        far, by = [None] * len(arcs), [-1] * len(arcs)
        far[start], queue = 0, [(0, start)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for x in arcs[a]:
                if room[x]:
                    b, e = to[x], d + cost[x] + height[a] - height[to[x]]
                    if far[b] is None or e < far[b]:
                        far[b], by[b] = e, x
                        heapq.heappush(queue, (e, b))
        if far[end] is None:
            break
        height = [h + (d if d is not None else far[end]) for h, d in zip(height, far, strict=True)]
        path, node = [], end
        while node != start:
            path.append(by[node])
            node = to[by[node] ^ 1]
        push = min(room[x] for x in path)
        for x in path:
            room[x] -= push
            room[x ^ 1] += push
    flows: list[dict[int, int]] = [{} for _ in patterns]
    for (p, s), x in middle.items():
        flows[p][s] = room[x ^ 1]
    return flows
