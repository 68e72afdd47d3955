"""Probabilistic automata inferred from example strings by merging prefix-tree states."""

import math
from collections import Counter, deque
from collections.abc import Iterable

#: Probability of a step that an automaton has never seen.
UNSEEN = 1e-4


class Automaton:
    """Deterministic; steps and ends have the frequencies of the examples.

    Two states may be one if, with confidence ``1 - alpha`` by Hoeffding's bound, their
    ends and steps, and those of all states that follow, have equal frequencies.
    """

    def __init__(self, examples: Iterable[str], alpha: float = 0.05):
        self.following: list[dict[str, int]] = [{}]
        self.steps: list[Counter] = [Counter()]
        self.ends: list[int] = [0]
        self.visits: list[int] = [0]
        self._bound = math.sqrt(0.5 * math.log(2 / alpha))
        for example in sorted(examples):
            self._add(example)
        self._merge()
        self.costs = [
            {c: math.log(n / visits) for c, n in steps.items()}
            for steps, visits in zip(self.steps, self.visits)
        ]

    def _add(self, example: str) -> None:
        state = 0
        self.visits[0] += 1
        for c in example:
            self.steps[state][c] += 1
            if c not in self.following[state]:
                self.following[state][c] = len(self.following)
                for column, empty in (
                    (self.following, {}),
                    (self.steps, Counter()),
                    (self.ends, 0),
                    (self.visits, 0),
                ):
                    column.append(empty)
            state = self.following[state][c]
            self.visits[state] += 1
        self.ends[state] += 1

    def _merge(self) -> None:
        settled, known = [0], {0}
        waiting = deque((0, c) for c in sorted(self.following[0]))
        while waiting:
            parent, c = waiting.popleft()
            state = self.following[parent][c]
            if state in known:
                continue
            alike = next((s for s in settled if self._compatible(s, state)), None)
            if alike is None:
                settled.append(state)
                known.add(state)
                grown = [state]
            else:
                self.following[parent][c] = alike
                grown = self._fold(alike, state, known)
            waiting.extend((s, x) for s in grown for x in sorted(self.following[s]))

    def _differ(self, part: int, whole: int, other_part: int, other_whole: int) -> bool:
        gap = abs(part / whole - other_part / other_whole)
        return gap > self._bound * (whole**-0.5 + other_whole**-0.5)

    def _compatible(self, one: int, other: int) -> bool:
        pairs = [(one, other)]
        while pairs:
            a, b = pairs.pop()
            n, m = self.visits[a], self.visits[b]
            if not n or not m:
                continue
            if self._differ(self.ends[a], n, self.ends[b], m):
                return False
            for c in self.steps[a].keys() | self.steps[b].keys():
                if self._differ(self.steps[a][c], n, self.steps[b][c], m):
                    return False
                if c in self.following[a] and c in self.following[b]:
                    pairs.append((self.following[a][c], self.following[b][c]))
        return True

    def _fold(self, into: int, tree: int, known: set[int]) -> list[int]:
        """Add a tree's counts to a state and its followers; the settled ones it changed."""
        pairs, changed = [(into, tree)], []
        while pairs:
            a, b = pairs.pop()
            self.visits[a] += self.visits[b]
            self.ends[a] += self.ends[b]
            self.steps[a].update(self.steps[b])
            if a in known:
                changed.append(a)
            for c, child in self.following[b].items():
                if c in self.following[a]:
                    pairs.append((self.following[a][c], child))
                else:
                    self.following[a][c] = child
        return changed

    def log_likelihood(self, text: str) -> float:
        state, total = 0, 0.0
        for c in text:
            cost = self.costs[state].get(c)
            if cost is None:
                total += math.log(UNSEEN)
            else:
                total += cost
                state = self.following[state][c]
        return total + math.log(max(self.ends[state] / self.visits[state], UNSEEN))


class Pairs:
    """Ordinary text: each character follows the one before; every pair counts once more."""

    def __init__(self, examples: Iterable[str], symbols: int):
        pairs: Counter = Counter()
        firsts: Counter = Counter()
        for example in examples:
            pairs.update(zip("\0" + example, example + "\0"))
            firsts.update("\0" + example)
        self._unseen = {a: -math.log(n + symbols) for a, n in firsts.items()}
        self._never = -math.log(symbols)
        self._costs = {
            (a, b): math.log((n + 1) / (firsts[a] + symbols)) for (a, b), n in pairs.items()
        }

    def log_likelihood(self, text: str) -> float:
        total = 0.0
        for pair in zip("\0" + text, text + "\0"):
            cost = self._costs.get(pair)
            total += self._unseen.get(pair[0], self._never) if cost is None else cost
        return total
