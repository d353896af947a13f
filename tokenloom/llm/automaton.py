"""Regular rules as one minimal deterministic automaton over bytes.

Rules are written in a small regular language (literals, byte sets, sequences,
choices, repeats). Each becomes a nondeterministic automaton; all of them together,
each free to begin at any byte, are turned into a deterministic one by subset
construction and made minimal by splitting its states into ever finer blocks.

The result is a transition array over byte classes. ``scan`` takes every byte of
a group of texts through it once, in numpy: the bytes are cut into lanes behind
bytes that lead every state back to the start, and all lanes step together.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

LANE = 1024


@dataclass(frozen=True)
class Node:
    """kind: set (of bytes), then, any (choice), some (1 or more), maybe, many (0 or more)."""

    kind: str
    parts: tuple = ()


def byte_set(chars: str | bytes) -> Node:
    data = chars.encode() if isinstance(chars, str) else chars
    return Node("set", (frozenset(data),))


def span(*ranges: str) -> Node:
    """Bytes of ranges such as "az", "09"; a single character stands for itself."""
    found: set[int] = set()
    for r in ranges:
        found.update(range(ord(r[0]), ord(r[-1]) + 1))
    return Node("set", (frozenset(found),))


def literal(text: str, any_case: bool = False) -> Node:
    def one(c: str) -> Node:
        return byte_set(c.lower() + c.upper()) if any_case else byte_set(c)
    return then(*[one(c) for c in text])


def then(*parts: Node) -> Node:
    return Node("then", parts)


def either(*parts: Node) -> Node:
    return Node("any", parts)


def some(part: Node) -> Node:
    return Node("some", (part,))


def many(part: Node) -> Node:
    return Node("many", (part,))


def maybe(part: Node) -> Node:
    return Node("maybe", (part,))


class _Nfa:
    """States with byte moves and free moves."""

    def __init__(self) -> None:
        self.moves: list[list[tuple[frozenset, int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, node: Node, begin: int) -> int:
        """Wire ``node`` behind state ``begin``; gives the state after it."""
        if node.kind == "set":
            end = self.state()
            self.moves[begin].append((node.parts[0], end))
            return end
        if node.kind == "then":
            for p in node.parts:
                begin = self.add(p, begin)
            return begin
        end = self.state()
        if node.kind == "any":
            for p in node.parts:
                self.free[self.add(p, begin)].append(end)
            return end
        inner = self.state()
        self.free[begin].append(inner)
        last = self.add(node.parts[0], inner)
        self.free[last].append(end)
        if node.kind in ("some", "many"):
            self.free[last].append(inner)
        if node.kind in ("maybe", "many"):
            self.free[begin].append(end)
        return end

    def closure(self, states: frozenset) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


@dataclass
class Automaton:
    """``moves[state * classes + class_of[byte]]`` is the next state; 0 is the start.

    ``accepts`` and ``active`` hold one bit per rule: the rule matches up to here;
    a match of the rule may be under way here.
    """

    class_of: np.ndarray
    classes: int
    moves: np.ndarray
    accepts: np.ndarray
    active: np.ndarray

    @property
    def resets(self) -> np.ndarray:
        """Bytes that lead every state to the start."""
        to_start = (self.moves.reshape(-1, self.classes) == 0).all(axis=0)
        return to_start[self.class_of]


def compile_rules(rules: Sequence[Node], anywhere: bool = True) -> Automaton:
    """One automaton for all rules; ``anywhere``: a match may begin at any byte."""
    nfa = _Nfa()
    begins, ends, rule_of = [], [], {}
    for k, rule in enumerate(rules):
        first = len(nfa.moves)
        begins.append(nfa.state())
        ends.append(nfa.add(rule, begins[-1]))
        rule_of.update(dict.fromkeys(range(first, len(nfa.moves)), k))
    fresh = nfa.closure(frozenset(begins))

    # Bytes that no rule tells apart share a class.
    looks: dict[tuple, int] = {}
    class_of = np.zeros(256, dtype=np.int64)
    every = [s for moves in nfa.moves for s, _ in moves]
    for b in range(256):
        look = tuple(b in s for s in every)
        class_of[b] = looks.setdefault(look, len(looks))
    sample = [int(np.flatnonzero(class_of == c)[0]) for c in range(len(looks))]

    # Subset construction. A state is what has been reached *beyond* the fresh
    # beginnings, which are there at every byte.
    names: dict[frozenset, int] = {frozenset(): 0}
    todo, table = [frozenset()], []
    while todo:
        here = todo.pop(0)
        source = here | fresh if anywhere or not table else here
        row = []
        for b in sample:
            reached = nfa.closure(frozenset(t for s in source for on, t in nfa.moves[s] if b in on))
            if not anywhere and not reached:
                reached = frozenset([-1])
            if reached not in names:
                names[reached] = len(names)
                todo.append(reached)
            row.append(names[reached])
        table.append(row)
        if not anywhere and here == frozenset([-1]):
            table[-1] = [names[here]] * len(sample)
    moves = np.array(table, dtype=np.int64)
    accepts, active = np.zeros(len(names), dtype=np.int64), np.zeros(len(names), dtype=np.int64)
    for states, name in names.items():
        for s in states:
            if s >= 0:
                active[name] |= 1 << rule_of[s]
        for k, end in enumerate(ends):
            if end in states:
                accepts[name] |= 1 << k
    return _minimal(class_of, moves, accepts, active)


def _minimal(class_of: np.ndarray, moves: np.ndarray, accepts: np.ndarray, active: np.ndarray) -> Automaton:
    """Merge states that no input tells apart (by acceptance or activity)."""
    block = np.unique(np.stack([accepts, active], axis=1), axis=0, return_inverse=True)[1].reshape(-1)
    count = block.max() + 1
    while True:
        look = np.concatenate([block[:, None], block[moves]], axis=1)
        block = np.unique(look, axis=0, return_inverse=True)[1].reshape(-1)
        if block.max() + 1 == count:
            break
        count = block.max() + 1
    # The start state keeps the name 0.
    rename = np.zeros(count, dtype=np.int64)
    order = [block[0]] + [b for b in range(count) if b != block[0]]
    rename[order] = np.arange(count)
    block = rename[block]
    one = np.zeros(count, dtype=np.int64)
    one[block] = np.arange(len(block))
    small = block[moves[one]]
    return Automaton(class_of, moves.shape[1], small.reshape(-1), accepts[one], active[one])


def scan(auto: Automaton, data: np.ndarray) -> np.ndarray:
    """The state after each byte of ``data``, begun at the start state."""
    n = len(data)
    states = np.zeros(n, dtype=np.uint16)
    if not n:
        return states
    classes = auto.class_of.astype(np.uint16)[data]
    # Lanes begin at 0 and behind reset bytes, one at most for each LANE bytes.
    behind = np.flatnonzero(auto.resets[data]) + 1
    wanted = np.searchsorted(behind, np.arange(LANE, n, LANE))
    starts = np.unique(np.concatenate([[0], behind[wanted[wanted < len(behind)]]]))
    starts = starts[starts < n]
    lengths = np.diff(np.append(starts, n))
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    moves = (auto.moves * auto.classes).astype(np.int64)  # states come pre-multiplied
    now = np.zeros(len(starts), dtype=np.int64)
    # Lanes still running at each step, as the longest come first.
    running = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
    step = 0
    while step < lengths[0] and running[step] > 8:
        live = running[step]
        at = starts[:live] + step
        now[:live] = moves[now[:live] + classes[at]]
        states[at] = now[:live] // auto.classes
        step += 1
    if step < lengths[0]:  # a few long lanes without a reset byte
        table = moves.tolist()
        for lane in range(running[step]):
            state, begin, end = int(now[lane]), int(starts[lane]) + step, int(starts[lane] + lengths[lane])
            tail = np.empty(end - begin, dtype=np.uint16)
            for i, c in enumerate(classes[begin:end].tolist()):
                state = table[state + c]
                tail[i] = state // auto.classes
            states[begin:end] = tail
    return states
