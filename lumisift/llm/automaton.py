"""Generalised suffix automaton of word sequences, and matching of long word streams against it."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Sequence


class SuffixAutomaton:
    """All runs of words of many items, each state a class of runs that end at the same places.

    An item's windows are its runs of `window` words, or all of its words if it has fewer.
    """

    def __init__(self, items: Iterable[tuple[Hashable, Sequence[int]]], window: int):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last_of: list[tuple[Hashable, list[int], int]] = []
        for item, words in items:
            if len(words):
                last_of.append((item, self._add(words), len(words)))
        self._find_windows(last_of, window)

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _extend(self, last: int, word: int) -> int:
        have = self.next[last].get(word)
        if have is not None and self.length[have] == self.length[last] + 1:
            return have
        new = None if have is not None else self._state(self.length[last] + 1, 0, {})
        at = last
        if new is not None:
            while at >= 0 and word not in self.next[at]:
                self.next[at][word] = new
                at = self.link[at]
            if at < 0:
                return new
        old = self.next[at][word]
        if self.length[old] == self.length[at] + 1:
            self.link[new] = old
            return new
        # Runs of `old` that are short enough now end at more places: split them off.
        split = self._state(self.length[at] + 1, self.link[old], dict(self.next[old]))
        while at >= 0 and self.next[at].get(word) == old:
            self.next[at][word] = split
            at = self.link[at]
        self.link[old] = split
        if new is None:
            return split
        self.link[new] = split
        return new

    def _add(self, words: Sequence[int]) -> list[int]:
        last = 0
        for word in words:
            last = self._extend(last, word)
        return list(words)

    def _find_windows(self, items: list[tuple[Hashable, list[int], int]], window: int) -> None:
        """own[s]: (length, items) of windows in state s; above[s]: those in its suffixes."""
        own: list[dict[int, set]] = [{} for _ in self.link]
        for item, words, n in items:
            size = min(n, window)
            state = matched = 0
            for word in words:
                state, matched = self.step(state, matched, word)
                if matched >= size:
                    at = state
                    while self.length[self.link[at]] >= size:
                        at = self.link[at]
                    own[at].setdefault(size, set()).add(item)
        # Shorter states first, so a suffix is ready before what it is a suffix of.
        self.own: list[list[tuple[int, frozenset]]] = [sorted(((k, frozenset(v)) for k, v in o.items()), reverse=True) for o in own]
        self.above: list[tuple[int, frozenset]] = [(0, frozenset())] * len(own)
        for s in sorted(range(1, len(own)), key=self.length.__getitem__):
            up = self.link[s]
            longest, found = self.above[up]
            for size, those in self.own[up]:
                longest, found = max(longest, size), found | those
            self.above[s] = (longest, found)

    def step(self, state: int, matched: int, word: int) -> tuple[int, int]:
        """The longest suffix of what was matched, and `word`, that some item has."""
        edges = self.next[state]
        while word not in edges:
            if not state:
                return 0, 0
            state = self.link[state]
            matched = self.length[state]
            edges = self.next[state]
        return edges[word], matched + 1

    def matches(self, words: Sequence[int]) -> Iterable[tuple[int, int, frozenset]]:
        """(position, longest window that ends there, items with a window that ends there)."""
        state = matched = 0
        for at, word in enumerate(words):
            state, matched = self.step(state, matched, word)
            if state:
                longest, found = self.above[state]
                for size, those in self.own[state]:
                    if size <= matched:
                        longest, found = max(longest, size), found | those
                if longest:
                    yield at, longest, found
