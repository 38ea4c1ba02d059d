"""One deterministic automaton for many span rules.

Each rule's regular expression becomes a nondeterministic automaton over bytes.
Subset construction over all rules at once gives a transducer that never looks
back: it reports the position where a rule's leftmost, longest match ends, and
starts that rule afresh there, so matches of one rule don't overlap. Moore
refinement then merges equal states and equal input bytes.

The construction accepts rules whose matches end as soon as they can't grow by
the next byte, and whose leftmost match never waits on an undecided earlier
start; ``compile_rules`` raises ValueError for the rest, since one pass without
look-ahead couldn't scan them.

Syntax of a rule: literals, ``[...]`` classes with ranges, ``(a|b)`` groups,
``? * + {m,}``, and ``\\xHH`` escapes. ``(?i)`` in front folds ASCII letters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


class _Nfa:
    """Thompson construction; state 0 is made first, epsilon edges are kept apart."""

    def __init__(self) -> None:
        self.eps: list[list[int]] = []
        self.edge: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.eps.append([])
        self.edge.append(None)
        return len(self.eps) - 1

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.eps[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def step(self, states, byte: int) -> frozenset[int]:
        return self.closure({e[1] for s in states if (e := self.edge[s]) and byte in e[0]})


class _Parser:
    def __init__(self, pattern: str, reverse: bool = False) -> None:
        self.fold = pattern.startswith("(?i)")
        self.text = pattern[4:] if self.fold else pattern
        self.at = 0
        self.tree = self._either()
        if self.at != len(self.text):
            raise ValueError(f"cannot read rule at {self.text[self.at :]!r}")
        self.nfa = _Nfa()
        self.start = self.nfa.state()
        self.accept = self._build(self.tree, self.start, reverse)

    def _peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def _either(self):
        parts = [self._sequence()]
        while self._peek() == "|":
            self.at += 1
            parts.append(self._sequence())
        return ("or", parts) if len(parts) > 1 else parts[0]

    def _sequence(self):
        parts = []
        while self._peek() not in ("", "|", ")"):
            atom, c = self._atom(), self._peek()
            if c and c in "?*+":
                self.at += 1
                atom = {"?": ("opt", atom), "*": ("many", atom), "+": ("seq", [atom, ("many", atom)])}[c]
            elif c == "{":
                close = self.text.index("}", self.at)
                low, comma, high = self.text[self.at + 1 : close].partition(",")
                if high:
                    raise ValueError("a repeat may have no upper bound")
                self.at = close + 1
                atom = ("seq", [atom] * int(low) + [("many", atom)] * bool(comma))
            parts.append(atom)
        return ("seq", parts)

    def _char(self) -> int:
        c = self.text[self.at]
        self.at += 1
        if c == "\\":
            c = self.text[self.at]
            self.at += 1
            if c == "x":
                self.at += 2
                return int(self.text[self.at - 2 : self.at], 16)
        if ord(c) > 127:
            raise ValueError("rules are written in ASCII")
        return ord(c)

    def _atom(self):
        if self._peek() == "(":
            self.at += 1
            inner = self._either()
            if self._peek() != ")":
                raise ValueError("unbalanced group")
            self.at += 1
            return inner
        chars: set[int] = set()
        if self._peek() == "[":
            self.at += 1
            while self._peek() != "]":
                low = high = self._char()
                if self._peek() == "-" and self.text[self.at + 1] != "]":
                    self.at += 1
                    high = self._char()
                chars.update(range(low, high + 1))
            self.at += 1
        else:
            chars.add(self._char())
        if self.fold:
            chars |= {ord(x) for c in chars if chr(c).isalpha() for x in (chr(c).lower(), chr(c).upper())}
        return ("set", frozenset(chars))

    def _build(self, tree, at: int, reverse: bool) -> int:
        kind, what = tree
        nfa = self.nfa
        if kind == "set":
            end = nfa.state()
            hold = nfa.state()
            nfa.eps[at].append(hold)
            nfa.edge[hold] = (what, end)
            return end
        if kind == "seq":
            for part in reversed(what) if reverse else what:
                at = self._build(part, at, reverse)
            return at
        if kind == "or":
            end = nfa.state()
            for part in what:
                nfa.eps[self._build(part, at, reverse)].append(end)
            return end
        if kind == "opt":
            end = self._build(what, at, reverse)
            nfa.eps[at].append(end)
            return end
        hub = nfa.state()
        nfa.eps[at].append(hub)
        nfa.eps[self._build(what, hub, reverse)].append(hub)
        end = nfa.state()
        nfa.eps[hub].append(end)
        return end


class _RuleStates:
    """Deterministic states of one rule; each is a tuple of live starts, oldest first."""

    def __init__(self, pattern: str) -> None:
        p = _Parser(pattern)
        self.nfa, self.accept = p.nfa, p.accept
        self.fresh = p.nfa.closure([p.start])
        if self.accept in self.fresh:
            raise ValueError(f"rule {pattern!r} matches the empty text")
        self.pattern = pattern
        self.memo: dict[tuple, tuple] = {}

    def step(self, state: tuple, byte: int) -> tuple[tuple, bool]:
        """The next state, and whether a match ended just before this byte."""
        key = (state, byte)
        if key not in self.memo:
            self.memo[key] = self._step(state, byte)
        return self.memo[key]

    def _step(self, state: tuple, byte: int) -> tuple[tuple, bool]:
        if state and self.accept in state[0]:
            grown = self.nfa.step(state[0], byte)
            if grown:
                if self.accept not in grown:
                    raise ValueError(f"rule {self.pattern!r} needs look-ahead after a match")
                return (grown,), False
            return self._step((), byte)[0], True
        threads, seen = [], set()
        for t in (*state, self.fresh):
            if left := self.nfa.step(t, byte) - seen:
                seen |= left
                if self.accept in left:
                    if threads:
                        raise ValueError(f"rule {self.pattern!r} needs look-ahead to find its leftmost match")
                    return (left,), False
                threads.append(left)
        return tuple(threads), False


class Anchored:
    """A small deterministic automaton that runs from one position; used where a match was found."""

    def __init__(self, pattern: str, reverse: bool = False) -> None:
        p = _Parser(pattern, reverse)
        self.nfa, self.accept = p.nfa, p.accept
        self.first = p.nfa.closure([p.start])
        self.table: dict[tuple[frozenset[int], int], frozenset[int]] = {}

    def longest(self, data) -> int:
        """Length of the longest accepted prefix of ``data``; -1 if there is none."""
        state, best = self.first, 0 if self.accept in self.first else -1
        for n, byte in enumerate(data, 1):
            key = (state, byte)
            if (state := self.table.get(key)) is None:
                state = self.table[key] = self.nfa.step(key[0], byte)
            if not state:
                break
            if self.accept in state:
                best = n
        return best


@dataclass(frozen=True)
class Automaton:
    """Transition arrays: ``table[state * width + classes[byte]]`` is the next state.

    States numbered ``quiet`` and above were entered by a byte that ended
    matches; ``ended[state - quiet]`` are the rules concerned. ``reset`` marks
    bytes that lead to one and the same quiet state, or its reporting twins,
    from everywhere, so scanning may start anew after them.
    """

    classes: np.ndarray
    table: np.ndarray
    width: int
    quiet: int
    ended: tuple[tuple[int, ...], ...]
    reset: np.ndarray
    shortest: int


def _same(columns: np.ndarray) -> np.ndarray:
    return np.unique(columns, axis=0, return_inverse=True)[1].reshape(-1)


def compile_rules(patterns: list[str]) -> Automaton:
    rules = [_RuleStates(p) for p in patterns]
    # Bytes that no rule's sets tell apart are tried once.
    sets = sorted({e[0] for r in rules for e in r.nfa.edge if e}, key=sorted)
    alike = _same(np.array([[b in s for s in sets] for b in range(256)]))
    sample = [int(np.flatnonzero(alike == k)[0]) for k in range(alike.max() + 1)]
    first = (tuple(() for _ in rules), ())
    number, order, rows = {first: 0}, [first], []
    for state in order:
        row = []
        for byte in sample:
            moves = [r.step(s, byte) for r, s in zip(rules, state[0], strict=True)]
            target = (tuple(m[0] for m in moves), tuple(k for k, m in enumerate(moves) if m[1]))
            if target not in number:
                number[target] = len(order)
                order.append(target)
            row.append(number[target])
        rows.append(row)
    table = np.array(rows)
    reports = sorted({s[1] for s in order})
    block = np.array([reports.index(s[1]) for s in order])
    while True:  # Moore: split blocks whose members go to different blocks
        finer = _same(np.column_stack([block, block[table]]))
        if finer.max() == block.max():
            break
        block = finer
    leader = np.array([int(np.flatnonzero(block == k)[0]) for k in range(block.max() + 1)])
    says = [order[i][1] for i in leader]
    rank = sorted(range(len(leader)), key=lambda k: (bool(says[k]), k != block[0], k))
    renumber = np.empty(len(rank), dtype=np.int64)
    renumber[rank] = np.arange(len(rank))
    small = renumber[block[table[leader[rank]]]]
    merged = _same(small.T)
    columns = [int(np.flatnonzero(merged == k)[0]) for k in range(merged.max() + 1)]
    small = small[:, columns]
    classes = merged[alike].astype(np.uint8)
    quiet = sum(not s for s in says)
    # A byte resets if everything after it goes as after the start.
    clean = np.array([np.array_equal(small[k], small[0]) for k in range(len(small))])
    reset = np.array([clean[small[:, classes[b]]].all() for b in range(256)])
    depth, seen, level = 0, {0}, {0}
    while level and max(level) < quiet:
        level = {int(t) for s in level for t in small[s]} - seen
        seen |= level
        depth += 1
    return Automaton(classes, small.astype(np.int32).ravel(), small.shape[1], quiet, tuple(says[k] for k in rank[quiet:]), reset, max(0, depth - 1))


def match_ends(auto: Automaton, data: bytes, lanes_left: int = 24) -> list[tuple[int, int]]:
    """(end, rule) of every match in ``data``, which must end in a reset byte; ends are exclusive.

    Reset bytes cut the data into lanes. All lanes advance together, a byte each
    per step, through the transition array; the last few long ones are walked
    one by one. Every byte of a lane that is long enough for a match is read once.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    cuts = np.flatnonzero(auto.reset[raw]) + 1
    starts = np.concatenate(([0], cuts[:-1]))
    length = cuts - starts
    keep = np.flatnonzero(length > auto.shortest)
    keep = keep[np.argsort(-length[keep], kind="stable")]
    starts, length = starts[keep], length[keep]
    found: list[tuple[int, int]] = []
    if not len(starts):
        return found
    symbols = auto.classes[raw].astype(np.int32)
    table, width, quiet = auto.table, auto.width, auto.quiet
    state = np.zeros(len(starts), dtype=np.int32)
    # active[j]: lanes longer than j
    active = len(length) - np.searchsorted(length[::-1], np.arange(length[0]), side="right")
    step = 0
    while step < len(active) and active[step] > lanes_left:
        n = active[step]
        state = table.take(state[:n] * width + symbols.take(starts[:n] + step))
        if state.max() >= quiet:
            for lane in np.flatnonzero(state >= quiet):
                found.extend((int(starts[lane]) + step, rule) for rule in auto.ended[state[lane] - quiet])
        step += 1
    if step < len(active):
        steps = table.tolist()
        for lane in range(active[step]):
            s, base = int(state[lane]), int(starts[lane])
            for at, symbol in enumerate(symbols[base + step : base + int(length[lane])].tolist(), base + step):
                s = steps[s * width + symbol]
                if s >= quiet:
                    found.extend((at, rule) for rule in auto.ended[s - quiet])
    return found
