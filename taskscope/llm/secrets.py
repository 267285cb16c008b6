"""Secret scans with one deterministic automaton for all rules.

Every rule is a regular expression over bytes. The rules' syntax trees become one nondeterministic automaton, subset
construction makes it deterministic, partition refinement minimises it, and its transitions are one flat array over
classes of bytes. Two such automata are used:

* the scanning one starts anew at every byte, and accepts at the first part of each rule that tells it from prose (its
  ``gate``, which every match holds). Texts are cut into lanes behind bytes that no rule can hold, and all lanes of a
  batch step through it together, one byte at a time: one pass over the bytes for all rules. A lane that reaches no
  accepting state holds no match.
* the anchored one runs from every byte of the other lanes at once and drops dead starts after each step, which gives
  the longest match of each rule at each start. Rules that are a run of one class of bytes have an anchored automaton of
  their own, which starts at the first byte of a run only. From these, matches are chosen from the left without
  overlaps, rule by rule, and short ones are dropped.

Defined results: null and empty texts have no spans; a match that fails its least length still takes its text; spans
count code points, the end is exclusive; a text of any length is scanned whole; rows that repeat are scanned alike; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import tokens as T

_SLICE = 4 << 20
_LANE = 2048
_FEW = 8  # lanes that are stepped through one by one


@dataclass(frozen=True)
class Rule:
    """A pattern that the automata take; a match counts if the whole, or the part after ``head``, has ``least`` characters."""

    kind: str
    pattern: str
    least: int = 1
    head: str = ""
    ignore_case: bool = False
    gate: str = ""  # what the scanning pass looks for instead: a part of every match that counts or takes text from one that does


_ASSIGN = r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""

#: The base rules, then those that the scan adds.
RULES = (
    Rule("assign", _ASSIGN + r"[A-Za-z0-9+/_.=-]+", 6, _ASSIGN, True, r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""),
    Rule("access", r"AKIA[A-Z0-9]+", 20, gate=r"AKIA[A-Z0-9]"),
    Rule("hex", r"[0-9a-f]+", 24, gate=r"[0-9a-f]{24}"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]+", 40, gate=r"gh[opsur]_"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15, gate=r"xox[abprs]-"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40, gate=r"\.eyJ"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", gate=r"-----BEGIN "),
    Rule("uri", r"://[A-Za-z0-9._-]+:[!-.0-9;-?A-~]+@", 8, gate=r"://[A-Za-z0-9._-]+:"),
)


class _Nfa:
    """States with empty moves and moves on sets of bytes."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, tree, start: int, fold: bool) -> int:
        """Append a syntax tree behind ``start``; the state behind it."""
        for op, arg in tree:
            name = str(op)
            if name in ("LITERAL", "IN"):
                end = self.state()
                self.moves[start].append((_bytes(name, arg, fold), end))
            elif name == "BRANCH":
                end = self.state()
                for option in arg[1]:
                    self.empty[self.add(option, start, fold)].append(end)
            elif name == "SUBPATTERN":
                end = self.add(arg[3], start, fold)
            elif name == "MAX_REPEAT":
                least, most, body = arg
                end = start
                for _ in range(least):
                    end = self.add(body, end, fold)
                if str(most) == "MAXREPEAT":
                    loop, end_ = self.state(), self.state()
                    self.empty[end].append(loop)
                    self.empty[self.add(body, loop, fold)].append(loop)
                    self.empty[loop].append(end_)
                    end = end_
                else:
                    after = self.state()
                    for _ in range(most - least):
                        self.empty[end].append(after)
                        end = self.add(body, end, fold)
                    self.empty[end].append(after)
                    end = after
            else:
                raise ValueError(f"a rule can't use {name}")
            start = end
        return start

    def closed(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


def _bytes(name: str, arg, fold: bool) -> frozenset:
    found: set[int] = set()
    for op, x in [("LITERAL", arg)] if name == "LITERAL" else arg:
        if str(op) == "LITERAL":
            found.add(x)
        elif str(op) == "RANGE":
            found.update(range(x[0], x[1] + 1))
        else:
            raise ValueError(f"a rule can't use {op}")
    if max(found) > 127:
        raise ValueError("rules are over ASCII")
    if fold:
        found |= {ord(chr(b).swapcase()) for b in found if chr(b).isalpha()}
    return frozenset(found)


@dataclass
class Automaton:
    """``step[state * classes + class]``; states from ``accepting`` on accept, ``masks`` tells which rules."""

    classes: np.ndarray
    step: np.ndarray
    width: int
    start: int
    dead: int
    accepting: int
    masks: np.ndarray
    step_list: list[int]
    unused: np.ndarray  # bytes that no pattern holds


def compile_rules(patterns: Sequence[tuple[str, bool]], scanning: bool) -> Automaton:
    """Subset construction over all patterns, then minimisation. A scanning automaton starts anew at each byte."""
    from re import _parser

    nfa = _Nfa()
    start, finals = nfa.state(), {}
    for k, (pattern, fold) in enumerate(patterns):
        own = nfa.state()
        nfa.empty[start].append(own)
        finals[nfa.add(_parser.parse(pattern), own, fold)] = k
    # bytes that no rule tells apart
    sets = {m[0] for moves in nfa.moves for m in moves}
    kinds: dict[tuple, int] = {}
    classes = np.array([kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)], np.uint8)
    sample = {c: b for b, c in reversed(list(enumerate(classes.tolist())))}
    width = len(kinds)
    first = nfa.closed([start])
    names, todo, table = {first: 0}, [first], []
    while todo:
        states = todo.pop(0)
        row = []
        for c in range(width):
            to = {t for s in states for on, t in nfa.moves[s] if sample[c] in on}
            to = nfa.closed(to | {start}) if scanning else nfa.closed(to)
            if to not in names:
                names[to] = len(names)
                todo.append(to)
            row.append(names[to])
        table.append(row)
    step = np.array(table)
    masks = np.array([sum(1 << finals[s] for s in states if s in finals) for states in names], np.int64)
    # partition refinement: states stay together while their masks and the groups that they lead to are equal
    group = np.unique(masks, return_inverse=True)[1]
    while True:
        new = np.unique(np.column_stack([group, group[step]]), axis=0, return_inverse=True)[1].ravel()
        if new.max() == group.max():
            break
        group = new
    lead = np.unique(group, return_index=True)[1]
    order = np.argsort(masks[lead] != 0, kind="stable")  # accepting states last
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    lead = lead[order]
    step, masks = place[group[step[lead]]], masks[lead]
    begin = int(place[group[0]])
    dead = next((k for k in range(len(step)) if not masks[k] and (step[k] == k).all()), -1)
    unused = np.array([not any(b in s for s in sets) for b in range(256)])
    return Automaton(classes, (step * width).astype(np.int32).ravel(), width, begin * width, dead * width, int((masks == 0).sum()) * width, masks, (step * width).ravel().tolist(), unused)


@dataclass
class Compiled:
    rules: tuple[Rule, ...]
    scan: Automaton
    anchored: list[tuple[list[int], bool, Automaton]]  # numbers of the rules, whether they are runs, and their automaton
    unused: np.ndarray


def automata(rules: tuple[Rule, ...]) -> Compiled:
    runs = [bool(re.fullmatch(r"\[[^\]]*\]\+", r.pattern)) for r in rules]
    parts = [([k for k, x in enumerate(runs) if not x], False)] + [([k], True) for k, x in enumerate(runs) if x]
    anchored = [(own, run, compile_rules([(rules[k].pattern, rules[k].ignore_case) for k in own], False)) for own, run in parts if own]
    scan = compile_rules([(r.gate or r.pattern, r.ignore_case) for r in rules], True)
    return Compiled(rules, scan, anchored, np.all([a.unused for _, _, a in anchored], axis=0))


def _lanes(data: np.ndarray, offsets: np.ndarray, unused: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut every text behind bytes that no match can hold, into lanes of about equal length."""
    free = np.flatnonzero(unused[data]) + 1
    wanted = np.arange(_LANE, len(data), _LANE)
    at = np.searchsorted(free, wanted)
    cuts = np.unique(np.concatenate([offsets, free[at[at < len(free)]]]))
    return cuts[:-1], cuts[1:]


def _hit_lanes(scan: Automaton, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The lanes in which some rule accepts; the longest first, so that the live ones are a prefix at each step."""
    order = np.argsort(starts - ends, kind="stable")
    at, sizes = starts[order], (ends - starts)[order]
    state, most = np.full(len(at), scan.start, np.int32), np.zeros(len(at), np.int32)
    kinds = scan.classes[data]
    live = len(at)
    where = at.copy()
    k = 0
    while live:
        live = int(np.searchsorted(-sizes, -k, "left"))  # lanes longer than k
        if not live:
            break
        if live <= _FEW:
            for i in range(live):
                most[i] = max(int(most[i]), _walk(scan, kinds[where[i]:at[i] + sizes[i]].tolist(), int(state[i])))
            break
        stop = int(sizes[live - 1])  # all of these are live up to here
        for _ in range(k, stop):
            s = scan.step[state[:live] + kinds[where[:live]]]
            state[:live] = s
            np.maximum(most[:live], s, out=most[:live])
            where[:live] += 1
        k = stop
    return np.sort(order[most >= scan.accepting])


def _walk(scan: Automaton, kinds: list[int], state: int) -> int:
    """The highest state on the way; accepting ones are the highest."""
    step, most = scan.step_list, state
    for k in kinds:
        state = step[state + k]
        if state > most:
            most = state
    return most


def _longest(anchored: Automaton, data: np.ndarray, begin: np.ndarray, stop: np.ndarray, rules: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each rule the starts that match, and the ends of the longest matches."""
    kinds = anchored.classes
    best = np.full((rules, len(begin)), -1, np.int64)
    own, at, end = np.arange(len(begin)), begin.copy(), stop
    state = np.full(len(at), anchored.start, np.int32)
    while len(at) > _FEW:
        go = at < end
        own, at, state, end = own[go], at[go], state[go], end[go]
        state = anchored.step[state + kinds[data[at]]]
        at = at + 1
        go = state != anchored.dead
        own, at, state, end = own[go], at[go], state[go], end[go]
        ok = np.flatnonzero(state >= anchored.accepting)
        if len(ok):
            mask = anchored.masks[state[ok] // anchored.width]
            for r in range(rules):
                sub = ok[mask >> r & 1 == 1]
                best[r, own[sub]] = at[sub]
    for k, a, s, e in zip(own.tolist(), at.tolist(), state.tolist(), end.tolist(), strict=True):
        for c in kinds[data[a:e]].tolist():
            s = anchored.step_list[s + c]
            if s == anchored.dead:
                break
            a += 1
            if s >= anchored.accepting:
                mask = int(anchored.masks[s // anchored.width])
                for r in range(rules):
                    if mask >> r & 1:
                        best[r, k] = a
    return [(begin[b >= 0], b[b >= 0]) for b in best]


def scan_batch(data: np.ndarray, offsets: np.ndarray, compiled: Compiled) -> list[list[tuple[int, int, int]]]:
    """Spans (start, rule, end) in code points for each text of a batch."""
    rules = compiled.rules
    out: list[list] = [[] for _ in range(len(offsets) - 1)]
    if not len(data):
        return out
    starts, ends = _lanes(data, offsets, compiled.unused)
    hit = _hit_lanes(compiled.scan, data, starts, ends)
    if not len(hit):
        return out
    size = (ends - starts)[hit]
    last = np.cumsum(size)
    begin = np.arange(int(last[-1])) + np.repeat(starts[hit] - (last - size), size)
    stop = np.repeat(ends[hit], size)
    matches = []
    for own, run, anchored in compiled.anchored:
        can = np.array([anchored.step[anchored.start + c] != anchored.dead for c in range(anchored.width)])[anchored.classes]
        go = can[data[begin]]
        if run:
            go[1:] &= ~(can[data[begin[:-1]]] & (begin[1:] == begin[:-1] + 1) & (stop[1:] == stop[:-1]))
        matches += zip(own, _longest(anchored, data, begin[go], stop[go], len(own)), strict=True)
    for r, (s, e) in matches:
        row = np.searchsorted(offsets, s, "right") - 1
        taken = -1
        head = re.compile(rules[r].head.encode(), re.I if rules[r].ignore_case else 0)
        for a, b, k in zip(s.tolist(), e.tolist(), row.tolist(), strict=True):
            if a < taken:
                continue
            taken = b
            skip = head.match(data[a:b].tobytes()).end() if rules[r].head else 0
            if b - a - skip >= rules[r].least:
                out[k].append((a, r, b))
    for k, spans in enumerate(out):
        if spans:
            lead = np.concatenate([[0], np.cumsum((data[offsets[k]:offsets[k + 1]] & 0xC0) != 0x80)])
            out[k] = sorted((int(lead[a - offsets[k]]), r, int(lead[b - offsets[k]])) for a, r, b in spans)
    return out


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): for each document its spans as an array of (kind, start, end), by start, then in the order of rules."""
    compiled = docs.sparkSession.sparkContext.broadcast(automata(rules))  # as large as the rules make it, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for whole in batches:
            for batch in T.slices(whole, "text", _SLICE):
                spans = scan_batch(*T.flat(batch.column("text")), compiled.value)
                rows = [[{"kind": rules[r].kind, "start": a, "end": b} for a, r, b in s] for s in spans]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, kind)], ["id", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, the digest of base spans, and all spans."""
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return find_secrets(docs).select(
        F.col("id").alias("doc_id"), count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
    )
