"""Running sums over cells in which single cells change: updates, prefix sums and searches in logarithmic time."""

from __future__ import annotations

from collections.abc import Sequence


class Fenwick:
    """Sums of the cells 0 to n - 1; ``tree`` is plain numbers, for a state store."""

    def __init__(self, values: Sequence, tree: list | None = None):
        self.n = len(tree) - 1 if tree is not None else len(values)
        if tree is not None:
            self.tree = tree
            return
        self.tree = [0, *values]
        for i in range(1, self.n + 1):
            up = i + (i & -i)
            if up <= self.n:
                self.tree[up] += self.tree[i]

    def add(self, i: int, delta) -> None:
        i += 1
        while i <= self.n:
            self.tree[i] += delta
            i += i & -i

    def prefix(self, i: int):
        """Sum of the first i cells."""
        total = 0
        while i > 0:
            total += self.tree[i]
            i -= i & -i
        return total

    def find(self, target) -> int:
        """The first cell at which the running sum exceeds ``target``; the last one where none does."""
        at, step = 0, 1 << max(self.n.bit_length() - 1, 0)
        while step:
            up = at + step
            if up <= self.n and self.tree[up] <= target:
                at, target = up, target - self.tree[up]
            step >>= 1
        return min(at, self.n - 1)
