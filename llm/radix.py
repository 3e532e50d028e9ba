"""An adaptive radix tree over byte keys: inner nodes of four layouts that grow
as children come, and one edge for every run of bytes without a branch."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

#: Children that a layout holds (fixed values of the structure).
SMALL, MEDIUM, INDEXED, DIRECT = 4, 16, 48, 256


class Node:
    """``edge``: the bytes from the parent's branch to here, after the byte that
    picks this child. ``value``: what a key that ends here holds."""

    __slots__ = ("edge", "value", "layout", "keys", "kids")

    def __init__(self, edge: bytes, value=None):
        self.edge, self.value = edge, value
        self.layout, self.keys, self.kids = SMALL, bytearray(), []

    def child(self, byte: int) -> Node | None:
        if self.layout == DIRECT:
            return self.kids[byte]
        if self.layout == INDEXED:
            at = self.keys[byte]
            return self.kids[at - 1] if at else None
        at = self.keys.find(byte)
        return self.kids[at] if at >= 0 else None

    def put(self, byte: int, node: Node) -> None:
        """Sets a child; a full layout grows to the next one first."""
        if self.layout == DIRECT:
            self.kids[byte] = node
            return
        if self.layout == INDEXED:
            at = self.keys[byte]
            if at:
                self.kids[at - 1] = node
                return
            if len(self.kids) == INDEXED:
                self._grow()
                self.put(byte, node)
                return
            self.kids.append(node)
            self.keys[byte] = len(self.kids)
            return
        at = bisect_left(self.keys, byte)
        if at < len(self.keys) and self.keys[at] == byte:
            self.kids[at] = node
        elif len(self.kids) < self.layout:
            self.keys.insert(at, byte)
            self.kids.insert(at, node)
        else:
            self._grow()
            self.put(byte, node)

    def _grow(self) -> None:
        if self.layout == SMALL:
            self.layout = MEDIUM
        elif self.layout == MEDIUM:
            table = bytearray(256)
            for i, b in enumerate(self.keys):
                table[b] = i + 1
            self.layout, self.keys = INDEXED, table
        else:
            kids: list[Node | None] = [None] * 256
            for b in range(256):
                if self.keys[b]:
                    kids[b] = self.kids[self.keys[b] - 1]
            self.layout, self.keys, self.kids = DIRECT, bytearray(), kids

    def children(self) -> Iterator[tuple[int, Node]]:
        """In the order of their bytes."""
        if self.layout == DIRECT:
            yield from ((b, k) for b, k in enumerate(self.kids) if k is not None)
        elif self.layout == INDEXED:
            yield from ((b, self.kids[at - 1]) for b, at in enumerate(self.keys) if at)
        else:
            yield from zip(self.keys, self.kids)


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] is common, a[:hi] is not
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class Tree:
    def __init__(self):
        self.root: Node | None = None

    def insert(self, key: bytes, value) -> None:
        """A key that is there already gets the new value."""
        if self.root is None:
            self.root = Node(key, value)
            return
        parent, branch, node, rest = None, 0, self.root, key
        while True:
            n = _common(node.edge, rest)
            if n < len(node.edge):  # the edge splits
                upper = Node(node.edge[:n])
                branch_down = node.edge[n]
                node.edge = node.edge[n + 1:]
                upper.put(branch_down, node)
                if parent is None:
                    self.root = upper
                else:
                    parent.put(branch, upper)
                node = upper
            if n == len(rest):
                node.value = value
                return
            byte = rest[n]
            below = node.child(byte)
            if below is None:
                node.put(byte, Node(rest[n + 1:], value))
                return
            parent, branch, node, rest = node, byte, below, rest[n + 1:]
