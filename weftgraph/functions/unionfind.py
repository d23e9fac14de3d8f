"""Union-find for use on a driver or inside a batch; large graphs take ``analytics.connected_components``."""

from __future__ import annotations

from collections.abc import Hashable, Iterable


class UnionFind:
    """Disjoint sets with union by size and path halving. An item not seen before is a set of its own."""

    def __init__(self, pairs: Iterable[tuple[Hashable, Hashable]] = ()) -> None:
        self.above: dict[Hashable, Hashable] = {}
        self.sizes: dict[Hashable, int] = {}
        for a, b in pairs:
            self.union(a, b)

    def find(self, x: Hashable) -> Hashable:
        above = self.above
        if x not in above:
            above[x], self.sizes[x] = x, 1
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    def union(self, a: Hashable, b: Hashable) -> Hashable:
        a, b = self.find(a), self.find(b)
        if a != b:
            if self.sizes[a] < self.sizes[b]:
                a, b = b, a
            self.above[b] = a
            self.sizes[a] += self.sizes.pop(b)
        return a

    def same(self, a: Hashable, b: Hashable) -> bool:
        return self.find(a) == self.find(b)

    def size(self, x: Hashable) -> int:
        return self.sizes[self.find(x)]

    def count(self) -> int:
        return len(self.sizes)
