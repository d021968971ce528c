"""Secret scans with one combined deterministic automaton.

The rules' regular expressions are compiled to position automata over bytes,
joined, made deterministic by subset construction, minimised by partition
refinement and stored as transition arrays over byte classes. One pass over the
UTF-8 bytes of a text drives all rules at once. Where a state accepts a rule,
the rule's reversed automaton finds the leftmost start, its forward automaton
the longest end, and an exact check of lengths follows. Matches of a rule do
not overlap; matches of different rules may.

Defined cases: null text counts as empty; empty texts have no spans; repeated
rows and null ids are reported like any other; an empty table gives an empty
result. Memory is one Arrow batch and the arrays (some 100 KB).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values: (kind, pattern, least length of the match, least length of its last group). The first three are the base rules.
RULES = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 0, 12),
    ("access", r"AKIA[A-Z0-9]+", 18, 0),
    ("hex", r"[0-9a-f]+", 16, 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 40, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20, 0),
    ("google", r"AIza[0-9A-Za-z_-]+", 39, 0),
    ("stripe", r"[sr]k_live_[0-9A-Za-z]+", 24, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40, 0),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
)
BASE = ("assign", "access", "hex")


# --- patterns: byte sets, concatenation, alternation, repetition -------------


class _Pattern:
    """Parser of the little language that the rules use, to nested tuples."""

    def __init__(self, text: str):
        self.s, self.i, self.fold = text, 0, False

    def parse(self):
        node = self._either()
        if self.i != len(self.s):
            raise ValueError(f"unexpected {self.s[self.i]!r} in {self.s!r}")
        return node

    def _either(self):
        options = [self._row()]
        while self._at("|"):
            self.i += 1
            options.append(self._row())
        return options[0] if len(options) == 1 else ("or", options)

    def _at(self, c: str) -> bool:
        return self.s.startswith(c, self.i)

    def _row(self):
        parts = []
        while self.i < len(self.s) and self.s[self.i] not in "|)":
            parts.append(self._repeated(self._one()))
        return ("cat", parts)

    def _repeated(self, node):
        if self.i < len(self.s):
            if self._at("{"):
                low, _, high = (body := self.s[self.i + 1 : self.s.index("}", self.i)]).partition(",")
                self.i += len(body) + 2
                tail = [("star", node)] if body.endswith(",") else [("opt", node)] * (int(high or low) - int(low))
                return ("cat", [node] * int(low) + tail)
            for mark, build in (("?", lambda: ("opt", node)), ("*", lambda: ("star", node)), ("+", lambda: ("cat", [node, ("star", node)]))):
                if self._at(mark):
                    self.i += 1
                    return build()
        return node

    def _one(self):
        c = self.s[self.i]
        if c == "(":
            was = self.fold
            self.i += 1
            for mark, fold in (("?i:", True), ("?:", was)):
                if self._at(mark):
                    self.i += len(mark)
                    self.fold = fold
                    break
            node = self._either()
            self.i += 1
            self.fold = was
            return node
        if c == "[":
            self.i += 1
            got: set[int] = set()
            while not self._at("]"):
                a = self._char()
                if self._at("-") and self.s[self.i + 1] != "]":
                    self.i += 1
                    got |= set(range(a, self._char() + 1))
                else:
                    got.add(a)
            self.i += 1
            return ("set", self._folded(got))
        return ("set", self._folded({self._char()}))

    def _char(self) -> int:
        c = self.s[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        c = self.s[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.s[self.i - 2 : self.i], 16)
        return ord(c)

    def _folded(self, got: set[int]) -> frozenset[int]:
        return frozenset(got | {ord(chr(b).swapcase()) for b in got if chr(b).isalpha()} if self.fold else got)


def _turned(node):
    kind, x = node
    if kind == "cat":
        return ("cat", [_turned(y) for y in reversed(x)])
    if kind == "or":
        return ("or", [_turned(y) for y in x])
    return node if kind == "set" else (kind, _turned(x))


def _soonest(node):
    """The pattern without repetitions at its end: it accepts where a match can first end, and holds no state over the rest."""
    kind, x = node
    if kind != "cat":
        return node
    kept = list(x)
    while len(kept) > 1 and kept[-1][0] in ("star", "opt"):
        kept.pop()
    return ("cat", [*kept[:-1], _soonest(kept[-1])])


def _positions(node, sets: list, follow: list) -> tuple[bool, set[int], set[int]]:
    """Position automaton of a pattern: whether it can be empty, its first and last positions; fills ``sets`` and ``follow``."""
    kind, x = node
    if kind == "set":
        sets.append(x)
        follow.append(set())
        return False, {len(sets) - 1}, {len(sets) - 1}
    if kind == "or":
        parts = [_positions(y, sets, follow) for y in x]
        return any(p[0] for p in parts), set().union(*(p[1] for p in parts)), set().union(*(p[2] for p in parts))
    if kind == "cat":
        empty, first, last = True, set(), set()
        for y in x:
            e, f, z = _positions(y, sets, follow)
            for p in last:
                follow[p] |= f
            first = first | f if empty else first
            last = last | z if e else z
            empty = empty and e
        return empty, first, last
    e, f, z = _positions(x, sets, follow)
    if kind == "star":
        for p in z:
            follow[p] |= f
    return True, f, z


class Automaton:
    """Minimal deterministic automaton of several patterns; ``rows[state][byte class]``, entry 0 the bits of accepted patterns.

    With ``search`` every position of the input may start a match; without it
    only the first, and state 0 is dead.
    """

    def __init__(self, nodes: list, search: bool):
        sets: list[frozenset[int]] = []
        follow: list[set[int]] = []
        firsts: set[int] = set()
        bits: dict[int, int] = {}
        for k, node in enumerate(nodes):
            _, first, last = _positions(node, sets, follow)
            firsts |= first
            for p in last:
                bits[p] = bits.get(p, 0) | 1 << k
        kinds: dict[tuple[bool, ...], int] = {}
        self.classes = bytes(1 + kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256))
        per_class = [[p for p, inside in enumerate(key) if inside] for key in kinds]
        members = [frozenset(x) for x in per_class]

        start = frozenset([-1])
        index = {frozenset(): 0, start: 1}
        todo, table = [frozenset(), start], []
        while len(table) < len(todo):
            state = todo[len(table)]
            reach = set(firsts) if search or -1 in state else set()
            for p in state:
                if p >= 0:
                    reach |= follow[p]
            row = []
            for m in members:
                to = frozenset(reach & m)
                if to not in index:
                    index[to] = len(todo)
                    todo.append(to)
                row.append(index[to])
            table.append(row)
        accept = []
        for state in todo:
            mask = 0
            for p in state:
                mask |= bits.get(p, 0)
            accept.append(mask)
        # refine: states are one as long as they accept the same and lead to the same blocks
        block = list(accept)
        count = len(set(block))
        while True:
            names: dict[tuple, int] = {}
            block = [names.setdefault((accept[i], *(block[t] for t in table[i])), len(names)) for i in range(len(table))]
            if len(names) == count:
                break
            count = len(names)
        self.transitions: list[list[int]] = [[] for _ in range(count)]
        for i, row in enumerate(table):
            self.transitions[block[i]] = [accept[i], *(block[t] for t in row)]
        self.start, self.dead = block[1], block[0]

    def linked(self) -> tuple[list, list]:
        """The same arrays with each entry the row itself: start row, dead row."""
        rows: list[list] = [[] for _ in self.transitions]
        for r, x in zip(rows, self.transitions, strict=True):
            r.append(x[0])
            r.extend(rows[t] for t in x[1:])
        return rows[self.start], rows[self.dead]


class Scanner:
    """All rules, compiled."""

    def __init__(self, rules: tuple = RULES):
        self.rules = rules
        trees = [_Pattern(self._least(p, n)).parse() for _, p, n, _ in rules]
        self.all = Automaton([_soonest(t) for t in trees], search=True)
        self.back = [Automaton([_turned(t)], search=False) for t in trees]
        self.forth = [Automaton([t], search=False) for t in trees]
        self.exact = [re.compile(p.encode()) for _, p, _, _ in rules]
        self.rows = None

    @staticmethod
    def _least(pattern: str, least: int) -> str:
        """A rule that is a single run of one class accepts from its least length on only."""
        return f"{pattern[:-1]}{{{least},}}" if re.fullmatch(r"\[[^\]]+\]\+", pattern) else pattern

    def __getstate__(self):
        return {**self.__dict__, "rows": None}

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """``(start, rule, end)`` in bytes, in order."""
        if self.rows is None:
            self.rows = (self.all.linked()[0], [a.linked() for a in self.back], [a.linked() for a in self.forth])
        row, back, forth = self.rows
        done = [0] * len(self.rules)
        found = []
        for i, b in enumerate(data.translate(self.all.classes)):
            row = row[b]
            if row[0]:
                mask = row[0]
                for k, end in enumerate(done):
                    if mask >> k & 1 and i >= end:
                        at = self._longest(back[k], self.back[k].classes, data, i, -1, end - 1)
                        if at is None:
                            continue
                        stop = self._longest(forth[k], self.forth[k].classes, data, at, 1, len(data)) + 1
                        done[k] = stop
                        got = self.exact[k].fullmatch(data, at, stop)
                        _, _, least, least_group = self.rules[k]
                        if got and stop - at >= least and (not least_group or len(got[got.re.groups]) >= least_group):
                            found.append((at, k, stop))
        return sorted(found)

    @staticmethod
    def _longest(rows: tuple, classes: bytes, data: bytes, at: int, step: int, edge: int) -> int | None:
        """The farthest position from ``at`` on, before ``edge``, at which the automaton accepts."""
        row, dead = rows
        last = None
        while at != edge:
            row = row[classes[data[at]]]
            if row is dead:
                break
            if row[0]:
                last = at
            at += step
        return last

    def code_points(self, data: bytes) -> list[tuple[int, int, int]]:
        found = self.spans(data)
        if not found or data.isascii():
            return found
        at, seen, places = 0, 0, {}
        for x in sorted({y for s, _, e in found for y in (s, e)}):
            seen += len(data[at:x].decode("utf-8", "replace"))
            at, places[x] = x, seen
        return [(places[s], k, places[e]) for s, k, e in found]


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find_secrets(docs: DataFrame, rules: tuple = RULES) -> DataFrame:
    """One row per document with counts and spans (``kind:start:end``, code points, end exclusive)."""
    scanner = Scanner(rules)
    names = [r[0] for r in rules]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for data in batch.column(1).cast(pa.binary()).to_pylist():
                got = [(s, names[k], e) for s, k, e in scanner.code_points(data or b"")]
                base = [x for x in got if x[1] in BASE]
                for col, kind in zip(out, BASE, strict=False):
                    col.append(sum(x[1] == kind for x in base))
                out[3].append(hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, k, e in base).encode()).hexdigest())
                out[4].append(",".join(f"{k}:{s}:{e}" for s, k, e in got))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in out[:3]), *(pa.array(x, pa.string()) for x in out[3:])],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, SCHEMA)


def secrets_sql(rules: tuple = RULES) -> str:
    """The same by regular expressions: a text is split at a rule's matches, and lengths add up to places."""
    parts = []
    for order, (kind, pattern, least, group) in enumerate(rules):
        p = pattern.replace("'", "''")
        groups = f"regexp_extract_all(x, '{p}', 2)" if group else f"regexp_extract_all(x, '{p}')"
        parts.append(
            f"SELECT doc_id, n, '{kind}' AS kind, {order} AS ord, {least} AS least, {group} AS least_group, unnest(regexp_split_to_array(x, '{p}')) AS gap, "
            f"unnest(regexp_extract_all(x, '{p}')) AS m, unnest({groups}) AS g, unnest(range(1, len(regexp_extract_all(x, '{p}')) + 1)) AS i FROM t WHERE regexp_matches(x, '{p}')"
        )
    return f"""
WITH t AS (SELECT doc_id, row_number() OVER () AS n, coalesce(text, '') AS x FROM documents),
f AS ({" UNION ALL ".join(parts)}),
s AS (SELECT *, CAST(sum(length(gap)) OVER w + sum(length(m)) OVER w - length(m) AS BIGINT) AS a FROM f WHERE m IS NOT NULL WINDOW w AS (PARTITION BY n, ord ORDER BY i ROWS UNBOUNDED PRECEDING)),
k AS (SELECT n, kind, ord, a, kind || ':' || CAST(a AS VARCHAR) || ':' || CAST(a + length(m) AS VARCHAR) AS span FROM s WHERE length(m) >= least AND (least_group = 0 OR length(g) >= least_group)),
r AS (SELECT n, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
        string_agg(span, ',' ORDER BY a, ord) FILTER (WHERE ord < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY a, ord) AS spans FROM k GROUP BY n)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN r USING (n)
"""
