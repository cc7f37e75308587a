"""Probabilistic automata inferred from sample strings by merging compatible states."""

from __future__ import annotations

import math
from collections.abc import Iterable


class Automaton:
    """A deterministic automaton that gives each string a probability.

    Starts as the prefix tree of the samples. States are visited breadth first; one whose
    end and next-character frequencies, and those of all its descendants, do not differ
    from an accepted state's by more than the Hoeffding bound of level ``alpha`` is merged
    into it, otherwise it is accepted as a state of its own.
    """

    def __init__(self, samples: Iterable[str], alpha: float = 0.05, unseen: float = 1e-4):
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.unseen = math.log(unseen)
        self.next: list[dict[str, int]] = [{}]
        self.passed: list[dict[str, int]] = [{}]  # samples that went on with a character
        self.ends = [0]
        self.visits = [0]
        for sample in samples:
            self._add(sample)
        self._merge_states()
        self.scores = [
            ({c: math.log(k / n) for c, k in self.passed[s].items()}, math.log(self.ends[s] / n) if self.ends[s] else self.unseen)
            for s, n in enumerate(self.visits)
            if n or not s
        ] if self.visits[0] else []

    def _add(self, sample: str) -> None:
        state = 0
        self.visits[0] += 1
        for c in sample:
            if c not in self.next[state]:
                self.next[state][c] = len(self.next)
                self.passed[state][c] = 0
                self.next.append({})
                self.passed.append({})
                self.ends.append(0)
                self.visits.append(0)
            self.passed[state][c] += 1
            state = self.next[state][c]
            self.visits[state] += 1
        self.ends[state] += 1

    def _alike(self, a: int, b: int) -> bool:
        """Whether two states, and what follows them, may be one. ``b`` heads a tree."""
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            n, m = self.visits[a], self.visits[b]
            slack = self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ends[a] / n - self.ends[b] / m) > slack:
                return False
            p, q = self.passed[a], self.passed[b]
            for c in p.keys() | q.keys():
                if abs(p.get(c, 0) / n - q.get(c, 0) / m) > slack:
                    return False
                if c in p and c in q:
                    pairs.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the counts of the tree at ``b`` to ``a`` and what follows it."""
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            self.visits[a] += self.visits[b]
            self.ends[a] += self.ends[b]
            for c, k in self.passed[b].items():
                if c in self.next[a]:
                    self.passed[a][c] += k
                    pairs.append((self.next[a][c], self.next[b][c]))
                else:
                    self.passed[a][c] = k
                    self.next[a][c] = self.next[b][c]

    def _merge_states(self) -> None:
        accepted = [0]
        is_accepted = {0}
        while True:
            # The first state that follows an accepted one and is not accepted itself.
            found = next(
                ((s, c, t) for s in accepted for c, t in self.next[s].items() if t not in is_accepted), None
            )
            if found is None:
                break
            source, c, state = found
            for old in accepted:
                if self._alike(old, state):
                    self.next[source][c] = old
                    self._fold(old, state)
                    break
            else:
                accepted.append(state)
                is_accepted.add(state)
        # Number the accepted states from 0 and drop the rest.
        number = {s: k for k, s in enumerate(accepted)}
        self.next = [{c: number[t] for c, t in self.next[s].items()} for s in accepted]
        self.passed = [self.passed[s] for s in accepted]
        self.ends = [self.ends[s] for s in accepted]
        self.visits = [self.visits[s] for s in accepted]

    def _walk(self, text: str) -> tuple[float, int]:
        state, total = 0, 0.0
        for c in text:
            steps, _ = self.scores[state]
            total += steps.get(c, self.unseen)
            state = self.next[state].get(c, 0)
        return total, state

    def log_probability(self, text: str) -> float:
        """Natural logarithm of a string's probability. A character never seen in a state
        counts as ``unseen`` and leads back to the start."""
        if not self.scores:
            return self.unseen * (len(text) + 1)
        total, state = self._walk(text)
        return total + self.scores[state][1]

    def log_prefix(self, text: str) -> float:
        """As ``log_probability``, of all strings that start so."""
        return self._walk(text)[0] if self.scores else self.unseen * len(text)
