"""Phrases of a symbol sequence: each is the shortest one not seen before."""

from __future__ import annotations


class PhraseParse:
    """The state of a parse. All beginnings of a phrase are phrases themselves, so the phrases are the nodes of a tree; a node
    is known by its parent and last symbol."""

    def __init__(self, symbols: int) -> None:
        self.symbols, self.children, self.node = symbols, {}, 0

    @property
    def count(self) -> int:
        """Phrases so far, without one that has not ended."""
        return len(self.children)

    def feed(self, symbols: bytes) -> PhraseParse:
        radix, children, node = self.symbols, self.children, self.node
        step = children.get
        for s in symbols:
            key = node * radix + s
            node = step(key, 0)
            if not node:
                children[key] = len(children) + 1
        self.node = node
        return self
