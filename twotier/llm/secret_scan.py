"""Secret scans with one combined automaton.

The byte patterns of all rules are compiled together: the syntax tree into an NFA,
subset construction over byte classes, minimisation, one transition array.  A text's
bytes are read once; each state says which rules end there.  A match's start is found
by running the rule's reversed automaton backwards from its end.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from re import _parser as syntax

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import listed, map_rows, read, spans_of

QUERY = "op6_secrets"


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


# Fixed patterns: kind, pattern, shortest match (0: see ``_long_enough``).  The first three are the base kinds.
_KEYWORD = "|".join(map(either_case, ["password", "passwd", "secret", "token", "api_?key"]))
ASSIGN = rf"""({_KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
RULES: list[tuple[str, str, int]] = [
    ("assign", ASSIGN, 0),
    ("access", r"AKIA[A-Z0-9]+", 20),
    ("hex", r"[0-9a-f]{8}[0-9a-f]*", 24),  # runs of fewer than eight are left out early
    ("github", r"gh[oprsu]_[A-Za-z0-9]+", 40),
    ("slack", r"xox[abeprs]-[A-Za-z0-9-]+", 15),
    ("google", r"AIza[A-Za-z0-9_-]+", 39),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
]
BASE = 3
_ASSIGN = re.compile(ASSIGN.encode())


class Nfa:
    """States with empty moves and moves on a set of bytes."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def add(self, pattern: str, backwards: bool = False) -> tuple[int, int]:
        """(first, last) state of a pattern of literals, classes, groups, alternatives
        and repeats; with ``backwards`` of its mirror image."""
        return self._sequence(list(syntax.parse(pattern)), backwards)

    def _sequence(self, nodes: list, backwards: bool) -> tuple[int, int]:
        first = last = self.state()
        for node in reversed(nodes) if backwards else nodes:
            a, b = self._node(node, backwards)
            self.empty[last].append(a)
            last = b
        return first, last

    def _node(self, node: tuple, backwards: bool) -> tuple[int, int]:
        kind, value = str(node[0]), node[1]
        first, last = self.state(), self.state()
        if kind in ("LITERAL", "IN"):
            self.moves[first] = (self._bytes([node] if kind == "LITERAL" else value), last)
        elif kind == "SUBPATTERN":
            return self._sequence(list(value[-1]), backwards)
        elif kind == "BRANCH":
            for branch in value[1]:
                a, b = self._sequence(list(branch), backwards)
                self.empty[first].append(a)
                self.empty[b].append(last)
        elif kind == "MAX_REPEAT":
            low, high, inner = value
            at = first
            for _ in range(low):
                a, b = self._sequence(list(inner), backwards)
                self.empty[at].append(a)
                at = b
            self.empty[at].append(last)
            if high == syntax.MAXREPEAT:
                a, b = self._sequence(list(inner), backwards)
                self.empty[at].append(a)
                self.empty[b].extend([a, last])
            else:
                for _ in range(high - low):
                    a, b = self._sequence(list(inner), backwards)
                    self.empty[at].append(a)
                    self.empty[b].append(last)
                    at = b
        else:
            raise ValueError(f"pattern element {kind} is not supported")
        return first, last

    @staticmethod
    def _bytes(items: list) -> frozenset[int]:
        out: set[int] = set()
        for kind, value in items:
            out |= {value} if str(kind) == "LITERAL" else set(range(value[0], value[1] + 1))
        return frozenset(out)

    def closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


def _bits(states: int) -> list[int]:
    return [n for n, c in enumerate(reversed(bin(states))) if c == "1"]


class Automaton:
    """A minimal deterministic automaton: ``table`` has the next state of each state and
    byte, ``ends`` the rules that end in each state.  State 0 is the first."""

    def __init__(self, patterns: list[str], anywhere: bool, backwards: bool = False):
        nfa = Nfa()
        start = nfa.state()
        rule_of = {}
        for n, pattern in enumerate(patterns):
            first, last = nfa.add(pattern, backwards)
            nfa.empty[start].append(first)
            rule_of[last] = n
        # bytes that no move tells apart are one class
        sets = sorted({m[0] for m in nfa.moves if m}, key=sorted)
        _, self_class = np.unique(np.array([[b in s for s in sets] for b in range(256)]), axis=0, return_inverse=True)
        member = [int(np.flatnonzero(self_class == c)[0]) for c in range(self_class.max() + 1)]
        # sets of NFA states are the bits of an integer; only states that move or end count
        counts = sum(1 << s for s in range(len(nfa.moves)) if nfa.moves[s] or s in rule_of)
        reach = [sum(1 << s for s in nfa.closure({t})) & counts for t in range(len(nfa.moves))]
        steps = {s: [reach[m[1]] if byte in m[0] else 0 for byte in member] for s, m in enumerate(nfa.moves) if m}
        first = reach[start]
        again = first if anywhere else 0
        number, order, table = {first: 0}, [first], []
        for states in order:
            row = [again] * len(member)
            for s in _bits(states):
                if s in steps:
                    row = [x | y for x, y in zip(row, steps[s])]
            for to in row:
                if to not in number:
                    number[to] = len(order)
                    order.append(to)
            table.append([number[to] for to in row])
        ends = [tuple(sorted(rule_of[s] for s in _bits(states) if s in rule_of)) for states in order]
        self.table, self.ends = self._minimal(np.array(table), ends)
        self.table = self.table[:, self_class].astype(np.int32)

    @staticmethod
    def _minimal(table: np.ndarray, ends: list[tuple]) -> tuple[np.ndarray, list[tuple]]:
        """Splits sets of states until all states of a set move alike."""
        kinds = {e: n for n, e in enumerate(dict.fromkeys(ends))}
        block = np.array([kinds[e] for e in ends])
        while True:
            _, first, new = np.unique(np.column_stack([block, block[table]]), axis=0, return_index=True, return_inverse=True)
            if new.max() == block.max():
                break
            block = new
        _, first = np.unique(block, return_index=True)
        order = np.argsort(first)  # the block of state 0 comes first
        rank = np.empty(len(order), int)
        rank[order] = np.arange(len(order))
        return rank[block[table[first[order]]]], [ends[i] for i in first[order]]

    def linked(self) -> list:
        """The first state as a list of its 256 next states, which are such lists
        themselves; element 256 is the rules that end there."""
        shared = {e: e for e in self.ends}
        rows = [[None] * 256 + [shared[e]] for e in self.ends]
        for row, to in zip(rows, self.table):
            row[:256] = [rows[t] for t in to.tolist()]
        return rows[0]


class Scanner:
    """All rules' spans in a text's bytes."""

    def __init__(self, forward: Automaton, backward: list[Automaton]):
        self.first = forward.linked()
        self.backward = [b.linked() for b in backward]

    def _runs(self, data: bytes) -> list[list[tuple[int, int]]]:
        """For each rule the runs of positions (first, last) where a match can end."""
        state, last, events = self.first, (), []
        for at, byte in enumerate(data):
            state = state[byte]
            if state[256] is not last:
                last = state[256]
                events.append((at + 1, last))
        runs: list[list[tuple[int, int]]] = [[] for _ in RULES]
        opened: dict[int, int] = {}
        for at, rules in [*events, (len(data) + 1, ())]:
            for rule in [r for r in opened if r not in rules]:
                runs[rule].append((opened.pop(rule), at - 1))
            for rule in rules:
                opened.setdefault(rule, at)
        return runs

    def _start(self, rule: int, data: bytes, end: int, floor: int) -> int | None:
        """The leftmost start, not before ``floor``, of a match that ends at ``end``."""
        state, found = self.backward[rule], None
        for at in range(end - 1, floor - 1, -1):
            state = state[data[at]]
            if state[256]:
                found = at
            elif state is state[0] is state[255]:  # nothing leads on from here
                break
        return found

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) of every match that is long enough: leftmost, longest and
        without overlap within a rule, in byte positions, by start and rule.  What ends inside
        a run can go on to its end, so one backward pass from there finds the run's match."""
        out = []
        for rule, runs in enumerate(self._runs(data)):
            floor = 0
            for _, last in runs:
                start = self._start(rule, data, last, floor)
                if start is not None:
                    floor = last
                    if self._long_enough(rule, data[start:last]):
                        out.append((start, last, rule))
        return sorted(out, key=lambda s: (s[0], s[2]))

    @staticmethod
    def _long_enough(rule: int, match: bytes) -> bool:
        if RULES[rule][0] == "assign":
            return len(_ASSIGN.fullmatch(match)[2]) >= ASSIGN_VALUE
        return len(match) >= RULES[rule][2]


def scanner() -> Callable[[], Scanner]:
    """Compiles the rules once; the result makes a task's scanner from the arrays."""
    forward = Automaton([p for _, p, _ in RULES], anywhere=True)
    backward = [Automaton([p], anywhere=False, backwards=True) for _, p, _ in RULES]
    return lambda: Scanner(forward, backward)


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of kind, start, end in code points, end exclusive, by
    start and order of the rules) of every row of ``docs``.

    Every whole text is read; a null or empty text has no spans.  Spans of one kind never overlap,
    spans of different kinds may.  Repeated rows and null ids are rows like others; an
    empty table gives an empty result.  No column but the id and text is read.
    """
    compiled = scanner()

    def make():
        scan = compiled()

        def work(ids, texts):
            out = []
            for text in texts:
                data = (text or "").encode("utf-8", "surrogatepass")
                found = scan.spans(data)
                if found and len(data) != len(text):
                    place = {b: len(data[:b].decode("utf-8", "surrogatepass")) for s in found for b in s[:2]}
                    found = [(place[a], place[b], r) for a, b, r in found]
                out.append([{"kind": RULES[r][0], "start": a, "end": b} for a, b, r in found])
            return [ids, out]
        return work

    return map_rows(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), ["doc_id", "text"], make,
                    "doc_id bigint, spans array<struct<kind string, start bigint, end bigint>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(read(spark, sf_dir, "documents"))
    kinds = [k for k, _, _ in RULES[:BASE]]
    counts = [F.size(spans_of([k])).cast("bigint").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(listed(spans_of(kinds)), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"))
