"""Levenshtein automata of all terms of a lexicon at once: the automaton run along a trie."""

from __future__ import annotations

from collections.abc import Iterable


#: (trie node, edits) pairs and moves that a lexicon keeps.
MOST_PAIRS = 400_000


def allowed(term: str) -> int:
    """Edits that a misspelling of a term may have."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """Terms that a word may begin with exactly (stems), or be within a few edits of.

    A state is a set of (trie node, edits spent); states and their transitions
    are made when first needed and kept, so that walking a word costs one
    lookup a character and ends where no term can be reached any more. When the
    kept sets hold more than MOST_PAIRS they are made anew from the next word on.
    Terms named in exactly have no misspellings.
    """

    def __init__(self, stems: Iterable[str], terms: Iterable[str], exactly: frozenset[str] = frozenset()):
        self.children: list[dict[str, int]] = [{}]
        self.stem_ends: set[int] = set()
        self.term_ends: dict[int, int] = {}
        self.most: list[int] = [0]
        self.names: dict[int, str] = {}
        for term in stems:
            self.stem_ends.add(self._add(term, 0))
        for term in terms:
            most = 0 if term in exactly else allowed(term)
            node = self._add(term, most)
            self.term_ends[node], self.names[node] = most, term
        self._forget()

    def _forget(self) -> None:
        self.held = 0
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.at_stem: list[bool] = []
        self.edits: list[int | None] = []
        self.dead, self.start = self._state(frozenset()), self._state(self._closed({(0, 0)}))

    def _add(self, term: str, most: int) -> int:
        node = 0
        self.most[0] = max(self.most[0], most)
        for c in term:
            nxt = self.children[node].get(c)
            if nxt is None:
                nxt = len(self.children)
                self.children[node][c] = nxt
                self.children.append({})
                self.most.append(0)
            node = nxt
            self.most[node] = max(self.most[node], most)
        return node

    def _closed(self, pairs: set[tuple[int, int]]) -> frozenset:
        """With characters of the term left out."""
        best: dict[int, int] = {}
        todo = list(pairs)
        while todo:
            node, e = todo.pop()
            if e > self.most[node] or best.get(node, 99) <= e:
                continue
            best[node] = e
            todo += [(x, e + 1) for x in self.children[node].values()]
        return frozenset(best.items())

    def _state(self, pairs: frozenset) -> int:
        found = self.states.get(pairs)
        if found is None:
            found = self.states[pairs] = len(self.sets)
            self.held += len(pairs) + 1
            self.sets.append(pairs)
            self.moves.append({})
            self.at_stem.append(any(e == 0 and n in self.stem_ends for n, e in pairs))
            ends = [e for n, e in pairs if e <= self.term_ends.get(n, -1)]
            self.edits.append(min(ends) if ends else None)
        return found

    def _step(self, state: int, c: str) -> int:
        out: set[tuple[int, int]] = set()
        for node, e in self.sets[state]:
            out.add((node, e + 1))  # a character that the term lacks
            for d, child in self.children[node].items():
                out.add((child, e if c == d else e + 1))
        nxt = self.moves[state][c] = self._state(self._closed(out))
        self.held += 1
        return nxt

    def match(self, word: str) -> tuple[str, int] | None:
        """("stem", 0), ("term", edits) or None."""
        if self.held > MOST_PAIRS:
            self._forget()
        state, moves = self.start, self.moves
        for c in word:
            nxt = moves[state].get(c)
            state = self._step(state, c) if nxt is None else nxt
            if state == self.dead:
                return None
            if self.at_stem[state]:
                return ("stem", 0)
        e = self.edits[state]
        return None if e is None else ("term", e)

    def near(self, word: str) -> list[tuple[str, int]]:
        """All terms that word is within their edits of, with the edits."""
        state = self.start
        for c in word:
            nxt = self.moves[state].get(c)
            state = self._step(state, c) if nxt is None else nxt
        return sorted((self.names[n], e) for n, e in self.sets[state] if e <= self.term_ends.get(n, -1))
