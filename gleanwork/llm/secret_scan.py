"""Secret scan: all rules in one deterministic automaton, one pass over each text's bytes.

The rules' regexes are parsed by the standard library, reversed, joined and made
deterministic by subset construction over byte classes, then minimised by partition
refinement into one transition array. Reading a text from its end, the automaton is in an
accepting state of a rule exactly where a match of that rule starts, so one pass gives
every start of every rule. Matches are then taken leftmost and non-overlapping per rule,
and a rule's own regex, anchored at the start, gives end and groups.

Edge cases: null and empty texts have no span; matches under a rule's length are dropped but still
cover their text; spans are code points, end exclusive; repeated rows get one row
each; an empty table gives no rows; very long texts are read whole; other columns are kept by
redact() and ignored by scan().
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as K
from re import _parser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.functions.batches import with_made
from gleanwork.llm.common import documents, table


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its regex over bytes, and the least length of a group of it (0: the whole match)."""

    kind: str
    regex: str
    group: int
    least: int
    #: What the automaton looks for, where a longer minimum gives the same matches.
    seek: str | None = None


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # A shorter run of these characters cannot hide a longer match, so only long ones need to be sought.
    Rule("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("bearer", r"(?i:bearer)\x20+([A-Za-z0-9_.=-]+)", 1, 20),
)
RULES = BASE + MORE


class _Machine:
    """A nondeterministic automaton: moves[state] lists (bytes, next), free[state] lists next."""

    def __init__(self):
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, items, begin: int, fold: bool, backward: bool) -> int:
        """Appends the parsed items after begin, and returns where they end."""
        for op, arg in reversed(list(items)) if backward else items:
            begin = self._one(op, arg, begin, fold, backward)
        return begin

    def _one(self, op, arg, begin: int, fold: bool, backward: bool) -> int:
        if op in (K.LITERAL, K.NOT_LITERAL, K.IN, K.ANY):
            end = self.state()
            self.moves[begin].append((_bytes(op, arg, fold), end))
            return end
        if op is K.SUBPATTERN:
            _, on, off, inner = arg
            return self.add(inner, begin, (fold or bool(on & re.IGNORECASE)) and not off & re.IGNORECASE, backward)
        if op is K.BRANCH:
            end = self.state()
            for branch in arg[1]:
                entry = self.state()
                self.free[begin].append(entry)
                self.free[self.add(branch, entry, fold, backward)].append(end)
            return end
        if op is K.MAX_REPEAT:
            least, most, inner = arg
            for _ in range(least):
                begin = self.add(inner, begin, fold, backward)
            if most is K.MAXREPEAT:
                entry, end = self.state(), self.state()
                self.free[begin] += [entry, end]
                last = self.add(inner, entry, fold, backward)
                self.free[last] += [entry, end]
                return end
            end = self.state()
            for _ in range(most - least):
                self.free[begin].append(end)
                begin = self.add(inner, begin, fold, backward)
            self.free[begin].append(end)
            return end
        raise ValueError(f"a rule has {op}, which is not regular or not supported")


def _bytes(op, arg, fold: bool) -> frozenset[int]:
    if op is K.ANY:
        return frozenset(set(range(256)) - {10})
    if op is K.IN:
        found, negate = set(), arg[0][0] is K.NEGATE
        for kind, x in arg[negate:]:
            if kind not in (K.LITERAL, K.RANGE):
                raise ValueError("rules list characters and ranges only")
            found |= {x} if kind is K.LITERAL else set(range(x[0], x[1] + 1))
    else:
        found, negate = {arg}, op is K.NOT_LITERAL
    if fold:
        found |= {ord(chr(b).swapcase()) for b in found if b < 128 and chr(b).isalpha()}
    return frozenset(set(range(256)) - found if negate else found)


def starts_automaton(regexes: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(moves, accepts): moves[state, byte] over a text read backward; accepts[state] has bit i where a match of regex i starts."""
    m = _Machine()
    root, ends = m.state(), {}
    m.moves[root].append((frozenset(range(256)), root))
    for i, regex in enumerate(regexes):
        entry = m.state()
        m.free[root].append(entry)
        ends[m.add(_parser.parse(regex.encode()), entry, False, True)] = 1 << i
    # Bytes that no rule tells apart are one class.
    sets = list({s for moves in m.moves for s, _ in moves})
    classes, of_byte = np.unique([[b in s for s in sets] for b in range(256)], axis=0, return_inverse=True)
    of_byte = of_byte.reshape(-1)
    sample = [int(np.flatnonzero(of_byte == c)[0]) for c in range(len(classes))]

    def closed(states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in m.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    first = closed({root})
    known, rows, todo = {first: 0}, [], [first]
    for states in todo:  # grows meanwhile
        row = []
        for b in sample:
            to = closed({t for s in states for on, t in m.moves[s] if b in on})
            if to not in known:
                known[to] = len(known)
                todo.append(to)
            row.append(known[to])
        rows.append(row)
    moves = np.array(rows)
    accepts = np.array([sum(bit for s, bit in ends.items() if s in states) for states in todo])
    block, count = np.unique(accepts, return_inverse=True)[1].reshape(-1), 0
    while count != block.max() + 1:
        count = block.max() + 1
        block = np.unique(np.column_stack([block, block[moves]]), axis=0, return_inverse=True)[1].reshape(-1)
    order = np.unique(block, return_index=True)[1]
    small = block[moves[order]]
    relabel = np.argsort(np.argsort(np.where(np.arange(len(order)) == block[0], -1, np.arange(len(order)))))
    back = np.argsort(relabel)
    return relabel[small[back]][:, of_byte], accepts[order][back]


def linked_rows(moves: np.ndarray, accepts: np.ndarray) -> list:
    """The start state as a list: entry b is the next state's list, entry 256 its accepted rules."""
    rows: list[list] = [[] for _ in accepts]
    for row, to, bits in zip(rows, moves.tolist(), accepts.tolist(), strict=True):
        row.extend(rows[t] for t in to)
        row.append(bits)
    return rows[0]


def find(data: bytes, start: list, rules: list[tuple[Rule, re.Pattern]]) -> list[tuple[int, int, int]]:
    """(begin, rule's index, end) in bytes, by begin and then rule."""
    row, hits, at = start, [], len(data)
    for b in reversed(data):
        row = row[b]
        at -= 1
        if row[256]:
            hits.append((at, row[256]))
    spans = []
    if hits:
        hits.reverse()
        for i, (rule, regex) in enumerate(rules):
            free = 0
            for at, bits in hits:
                if bits >> i & 1 and at >= free:
                    match = regex.match(data, at)
                    free = match.end()
                    if len(match.group(rule.group)) >= rule.least:
                        spans.append((at, i, free))
        spans.sort()
    return spans


def _finder(rules: tuple[Rule, ...]):
    """A function that a task calls once for its own finder of the spans of texts."""
    moves, accepts = starts_automaton([r.seek or r.regex for r in rules])

    def ready():
        start, compiled = linked_rows(moves, accepts), [(r, re.compile(r.regex.encode())) for r in rules]

        def of(text: str) -> list[tuple[int, int, int]]:
            data = text.encode()
            spans = find(data, start, compiled)
            if spans and len(data) != len(text):
                spans = [(len(data[:a].decode()), i, len(data[:b].decode())) for a, i, b in spans]
            return spans

        return of

    return ready


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) per row of docs, in order of start and then rule."""
    ready = _finder(rules)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = ready()
        for batch in batches:
            found = [[{"kind": rules[i].kind, "start": a, "end": b} for a, i, b in of(t)] for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "spans": found})

    return documents(docs).mapInPandas(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every secret in text replaced by [kind]; overlapping spans become one, named by the first."""
    ready = _finder(rules)

    def start():
        of = ready()

        def hidden(text: str) -> str:
            parts, at = [], 0
            for a, i, b in of(text):
                if a >= at:
                    parts += [text[at:a], f"[{rules[i].kind}]"]
                at = max(at, b)
            return "".join(parts) + text[at:]

        return lambda texts: [[t and hidden(t) for t in texts]]

    return with_made(docs, "text string", ["text"], start, "text")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = scan(table(spark, sf_dir, "documents"))
    text = lambda of: F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*(r.kind for r in BASE)))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select("doc_id", *(n(r.kind) for r in BASE), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
