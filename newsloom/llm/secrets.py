"""Secret scans: one minimal deterministic automaton for all rules, one pass over a text's bytes.

Every rule's regular expression becomes a nondeterministic automaton. All of them together, free to start
at any byte, are made deterministic by subset construction and minimised; the result is an array of next
states by (state, byte). A text is run through it once. Where a state accepts for a rule, that rule's own
automata give the match: backwards from there to its leftmost start not before the rule's last match, then
forwards from the start to its longest end. Matches of a rule don't overlap. A match that fails the rule's
check (too short a value) is dropped, though it has used up its text.

Rules use literals, classes, groups, alternation and repetition, and stay ASCII. A rule's match that starts
further left must not end, at its earliest, after one that starts later (true of rules with a literal head).

Null and empty texts have no spans. Spans are in code points, the end exclusive; those that start at one place come in the order of
their rules. Texts may be of any length: memory beside the text is that of its spans. Each row gives one row, also if it repeats an
id or has none; an empty table gives an empty result. Further columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, text_bytes

_parser = re._parser  # the syntax tree of Python's own expressions


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0  # characters of the whole match
    value: str = ""  # how the value within a match is found, as its first group; that group then has `least` characters

    def accepts(self, match: bytes) -> bool:
        if self.value:
            found = re.search(self.value.encode(), match)
            return bool(found) and len(found[1]) >= self.least
        return len(match) >= self.least


#: The kinds that are counted, in the order in which they are listed. The hexadecimal rule asks
#: for 24 digits in the expression itself, so that the automaton does not stop at every letter from a to f.
BASE = (
    Rule("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 6, r"""(?<=[:=])\x20*["']?([A-Za-z0-9+/_.=-]+)$"""),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24}[0-9a-f]*"),
)
#: Published forms of keys.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
)
RULES = BASE + MORE


class Nfa:
    """States with byte-set edges and empty edges, built from a syntax tree."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.edges: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.edges.append([])
        return len(self.empty) - 1

    def add(self, tree, start: int, backwards: bool) -> int:
        """Add what ``tree`` matches from ``start`` on; the state reached."""
        for op, arg in reversed(list(tree)) if backwards else tree:
            start = self._one(str(op), arg, start, backwards)
        return start

    def _one(self, op: str, arg, start: int, backwards: bool) -> int:
        if op in ("LITERAL", "IN"):
            end = self.state()
            self.edges[start].append((_bytes(op, arg), end))
            return end
        if op == "SUBPATTERN":
            return self.add(arg[-1], start, backwards)
        if op == "BRANCH":
            end = self.state()
            for branch in arg[1]:
                self.empty[self.add(branch, self._after(start), backwards)].append(end)
            return end
        if op == "MAX_REPEAT":
            low, high, body = arg
            for _ in range(low):
                start = self.add(body, start, backwards)
            if high == _parser.MAXREPEAT:
                loop = self._after(start)
                self.empty[self.add(body, loop, backwards)].append(loop)
                return self._after(loop)
            end = self.state()
            for _ in range(high - low):
                self.empty[start].append(end)
                start = self.add(body, start, backwards)
            self.empty[start].append(end)
            return end
        raise ValueError(f"a rule cannot use {op}")

    def _after(self, start: int) -> int:
        s = self.state()
        self.empty[start].append(s)
        return s

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


def _bytes(op: str, arg) -> frozenset[int]:
    if op == "LITERAL":
        return frozenset([arg])
    out: set[int] = set()
    for kind, value in arg:
        if str(kind) == "LITERAL":
            out.add(value)
        elif str(kind) == "RANGE":
            out.update(range(value[0], value[1] + 1))
        else:
            raise ValueError(f"a class cannot use {kind}")
    return frozenset(out)


@dataclass
class Dfa:
    """``step[state << 8 | byte]`` is the next state << 8. State 0 is the start; states from ``final`` on
    accept, for the rules in ``accepts[state]``. ``dead`` is the state that nothing leaves, if there is one."""

    step: list[int]
    final: int
    accepts: list[tuple[int, ...]]
    dead: int = -1
    states: int = field(default=0)


def build(patterns: tuple[str, ...], anywhere: bool, backwards: bool = False) -> Dfa:
    """The minimal deterministic automaton of all patterns together; ``anywhere``: a match may start at any
    byte, else only at the first."""
    nfa = Nfa()
    start = nfa.state()
    ends: dict[int, int] = {}
    for i, p in enumerate(patterns):
        ends[nfa.add(_parser.parse(p), nfa._after(start), backwards)] = i
    if anywhere:  # a match is noticed at its earliest end; what could make it longer is left to the rule's own automaton
        for s in range(len(nfa.edges)):
            if nfa.closure([s]) & ends.keys():
                nfa.edges[s] = []
    # bytes that no edge tells apart are one letter
    sets = sorted({s for edges in nfa.edges for s, _ in edges}, key=sorted)
    letter_of: dict[tuple, int] = {}
    letters = [letter_of.setdefault(tuple(b in s for s in sets), len(letter_of)) for b in range(256)]
    sample = [letters.index(k) for k in range(len(letter_of))]
    first = nfa.closure([start])
    number, todo, table, marks = {first: 0}, [first], [], []
    while todo:
        now = todo.pop(0)
        marks.append(tuple(sorted(ends[s] for s in now if s in ends)))
        row = []
        for b in sample:
            to = {t for s in now for within, t in nfa.edges[s] if b in within}
            after = nfa.closure(to | ({start} if anywhere else set()))
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row.append(number[after])
        table.append(row)
    return _minimal(np.array(table), marks, letters)


def _minimal(table: np.ndarray, marks: list[tuple[int, ...]], letters: list[int]) -> Dfa:
    """Split states by what they accept, then by the parts their steps lead to, until nothing splits."""
    kinds = {m: i for i, m in enumerate(sorted(set(marks)))}
    part = np.array([kinds[m] for m in marks])
    while True:
        _, new = np.unique(np.c_[part, part[table]], axis=0, return_inverse=True)
        new = new.reshape(-1)
        if new.max() == part.max():
            break
        part = new
    n = part.max() + 1
    chosen = [int(np.flatnonzero(part == p)[0]) for p in range(n)]
    order = sorted(range(n), key=lambda p: (p != part[0], bool(marks[chosen[p]]), p))
    if marks[chosen[part[0]]]:
        raise ValueError("a rule matches the empty text")
    rank = {p: i for i, p in enumerate(order)}
    step = [rank[part[table[chosen[p]][letters[b]]]] << 8 for p in order for b in range(256)]
    accepts = [marks[chosen[p]] for p in order]
    final = sum(not a for a in accepts)
    dead = next((i for i in range(final) if all(step[i << 8 | b] == i << 8 for b in range(256))), -1)
    return Dfa(step, final << 8, accepts, dead << 8 if dead > 0 else -1, n)


@dataclass
class Scanner:
    rules: tuple[Rule, ...]
    all: Dfa
    forwards: list[Dfa]
    back: list[Dfa]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(rule, start, end) in bytes, by start, then rule."""
        step, final, state = self.all.step, self.all.final, 0
        last: dict[int, int] = defaultdict(int)
        found: list[tuple[int, int, int]] = []
        for i, b in enumerate(data):
            state = step[state | b]
            if state >= final:
                for r in self.all.accepts[state >> 8]:
                    if i >= last[r] and (start := self._start(data, r, i + 1, last[r])) is not None:
                        end = self._end(data, r, start)
                        last[r] = end
                        if self.rules[r].accepts(data[start:end]):
                            found.append((r, start, end))
        return sorted(found, key=lambda x: (x[1], x[0]))

    def _start(self, data: bytes, rule: int, end: int, least: int) -> int | None:
        d, state, start = self.back[rule], 0, None
        for i in range(end - 1, least - 1, -1):
            state = d.step[state | data[i]]
            if state >= d.final:
                start = i
            elif state == d.dead:
                break
        return start

    def _end(self, data: bytes, rule: int, start: int) -> int:
        d, state, end = self.forwards[rule], 0, start
        for i in range(start, len(data)):
            state = d.step[state | data[i]]
            if state >= d.final:
                end = i + 1
            elif state == d.dead:
                break
        return end


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    """Built once in each worker process."""
    patterns = tuple(r.pattern for r in rules)
    return Scanner(rules, build(patterns, True), [build((p,), False) for p in patterns], [build((p,), False, True) for p in patterns])


def code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte spans as code-point spans."""
    if data.isascii() or not spans:
        return spans
    before = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    at = lambda i: int(before[i - 1]) if i else 0
    return [(r, at(a), at(b)) for r, a, b in spans]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and its spans (kind, start, end) for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(rules)
        kinds = [r.kind for r in rules]
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for b in slices(batches):
            texts = (t or b"" for t in b.column(1).to_pylist())
            spans = [[{"kind": kinds[r], "start": x, "end": y} for r, x, y in code_points(t, s.spans(t))] for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(kind))], names=["doc_id", "spans"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(
        run, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint>>"
    )


def redactor(rules: tuple[Rule, ...] = RULES, mark: Callable[[str], str] = "[{}]".format):
    """A column function of a binary text: the text with every secret replaced by its kind; overlapping
    secrets are replaced together. Texts without secrets come back as they are."""

    @F.arrow_udf("string")
    def redact(text: pa.Array) -> pa.Array:
        s = scanner(rules)
        out = []
        for data in text.to_pylist():
            if data is None:
                out.append(None)
                continue
            parts, at = [], 0
            for r, a, b in s.spans(data):
                if a >= at:
                    parts += [data[at:a], mark(rules[r].kind).encode()]
                at = max(at, b)
            out.append(b"".join([*parts, data[at:]]).decode("utf-8", "replace"))
        return pa.array(out, pa.string())

    return redact
