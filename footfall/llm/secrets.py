"""Secret scans by grammar inference.

For each kind of credential, and for ordinary long tokens, a prefix tree is built from labelled
strings and its states are merged while their frequencies are statistically compatible (Hoeffding's
bound on endings and on every symbol, for the states and all that follow them). The result is a
probabilistic automaton that loops and generalises. Every token of eight characters or more, the
least that labels have, is scored by how much more likely each credential's automaton makes it than
the one of ordinary tokens; what an automaton has no path for it still scores by how classes of characters follow each other.

Labels are the base patterns' own matches. The automata are fitted to a bounded sample of the labelled
tokens of all documents: ``SAMPLE_TOKENS`` different ones of each kind, ``ORDINARY_TOKENS`` of ordinary ones,
the first by hash of those of at most ``LONGEST`` characters, or all if there are fewer. All texts are scanned and all their tokens
scored, whatever their length.

Base spans always stay; scored tokens that overlap none are added as ``like_<kind>``. Null and empty
texts have no spans; without labelled credentials nothing is added. Repeated rows are searched each;
other columns do not matter.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import cached_property
from itertools import pairwise

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from footfall.llm.common import SPANS_SQL, Taken, cut, joined_spans, map_texts, span_array, spans_of

KINDS = ("assign", "access", "hex")
ORDER = (*KINDS, *[f"like_{k}" for k in KINDS])
ORDINARY = "ordinary"
SAMPLE_TOKENS, ORDINARY_TOKENS, LONGEST = 500, 4000, 200
LEAST_ODDS = 1.5  # log odds a character

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
# As long as the shortest labels.
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the credential itself) by start, then kind."""
    spans = []
    lower = text.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        spans += [("assign", *m.span(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        spans += [("access", *m.span(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [("hex", *m.span(), m.start()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def other_tokens(text: str, spans: list[tuple[str, int, int, int]]) -> list[tuple[int, int]]:
    """The long tokens that no base span overlaps."""
    tokens = [m.span() for m in TOKEN.finditer(text)]
    taken = Taken((a, b) for _, a, b, _ in spans)
    return [t for t in tokens if not taken.meets(*t)]


# Symbols of the automata: the first characters of a token as they are, as issuers mark their
# credentials there; after them classes of characters, each with the number of its members.
LITERAL = 4
CLASSES = {"d": "0123456789", "x": "abcdef", "l": "ghijklmnopqrstuvwxyz", "X": "ABCDEF", "U": "GHIJKLMNOPQRSTUVWXYZ"}
CLASS_OF = {c: name for name, members in CLASSES.items() for c in members}
ALPHABET = "".join(CLASSES.values()) + "+/_.=-"


def symbols(token: str) -> list[str]:
    return ["=" + c for c in token[:LITERAL]] + [CLASS_OF.get(c, c) for c in token[LITERAL:]]


@dataclass
class State:
    count: int = 0
    ends: int = 0
    counts: Counter = field(default_factory=Counter)
    nexts: dict[str, int] = field(default_factory=dict)


class Automaton:
    """A probabilistic automaton inferred from tokens by merging compatible states of their prefix tree."""

    def __init__(self, tokens: list[str], alpha: float = 0.05, mixed: float = 0.05, trust: float = 2.0):
        self.states = [State()]
        for token in tokens:
            at = self.states[0]
            at.count += 1
            for s in symbols(token):
                if s not in at.nexts:
                    at.nexts[s] = len(self.states)
                    self.states.append(State())
                at.counts[s] += 1
                at = self.states[at.nexts[s]]
                at.count += 1
            at.ends += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_all()
        # How often a class of characters follows another, with ``trust`` moves' worth of how often it stands anywhere.
        moves = Counter(pair for t in tokens for pair in pairwise(["", *(CLASS_OF.get(c, c) for c in t)]))
        names = (*CLASSES, *"+/_.=-")
        anywhere = {b: 1 + sum(moves[a, b] for a in ("", *names)) for b in names}
        total = sum(anywhere.values())
        self.moves = {
            (a, b): (moves[a, b] + trust * anywhere[b] / total) / (sum(moves[a, c] for c in names) + trust)
            for a in ("", *names)
            for b in names
        }
        self.mixed = mixed

    def _differ(self, a: int, b: int, n: int, m: int) -> bool:
        return abs(a / n - b / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, first: int, second: int) -> bool:
        todo = [(first, second)]
        seen = set()
        while todo:
            pair = todo.pop()
            if pair in seen:
                continue
            seen.add(pair)
            p, q = self.states[pair[0]], self.states[pair[1]]
            if self._differ(p.ends, q.ends, p.count, q.count):
                return False
            for s in p.counts.keys() | q.counts.keys():
                if self._differ(p.counts[s], q.counts[s], p.count, q.count):
                    return False
                if s in p.nexts and s in q.nexts:
                    todo.append((p.nexts[s], q.nexts[s]))
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Adds a subtree's counts to a state and those after it."""
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            p, q = self.states[a], self.states[b]
            p.count += q.count
            p.ends += q.ends
            p.counts.update(q.counts)
            for s, follows in q.nexts.items():
                if s in p.nexts:
                    todo.append((p.nexts[s], follows))
                else:
                    p.nexts[s] = follows

    def _merge_all(self) -> None:
        settled = [0]
        fringe = [(0, s) for s in sorted(self.states[0].nexts)]
        known = {0}
        while fringe:
            parent, symbol = fringe.pop(0)
            state = self.states[parent].nexts[symbol]
            if state in known:
                continue
            match = next((r for r in settled if self._compatible(r, state)), None)
            if match is None:
                settled.append(state)
                known.add(state)
                fringe += [(state, s) for s in sorted(self.states[state].nexts)]
            else:
                self.states[parent].nexts[symbol] = match
                self._fold(match, state)
                # Folding may have hung new states below settled ones.
                fringe = [(r, s) for r in settled for s in sorted(self.states[r].nexts) if self.states[r].nexts[s] not in known]
        order = {old: new for new, old in enumerate(settled)}
        self.states = [self.states[r] for r in settled]
        for state in self.states:
            state.nexts = {s: order[t] for s, t in state.nexts.items()}

    @cached_property
    def tables(self) -> tuple[list[dict[str, tuple[float, int]]], list[dict[str, tuple[float, int]]], dict[str, dict[str, float]]]:
        """What a character adds to a token's chance, by what is before it.

        For a token's first characters, and for the others, by state: the share of the state's
        frequency, and where it leads to; the last state is the one off all paths. Then, by the
        character before: the share of the classes' moves.
        """
        both: tuple[list, list] = [], []
        for literal, table in zip((True, False), both, strict=True):
            for state in (*self.states, None):
                own = dict.fromkeys(ALPHABET, (0.0, -1))
                for c in ALPHABET if state is not None else "":
                    name = CLASS_OF.get(c, c)
                    s, size = ("=" + c, 1) if literal else (name, len(CLASSES.get(name, " ")))
                    own[c] = (1 - self.mixed) * state.counts[s] / max(1, state.count) / size, state.nexts.get(s, -1)
                table.append(own)
        moves = {
            a: {c: self.mixed * self.moves[CLASS_OF.get(a, a), name] / len(CLASSES.get(name, " ")) for c in ALPHABET for name in (CLASS_OF.get(c, c),)}
            for a in ("", *ALPHABET)
        }
        return *both, moves

    def log_likelihood(self, token: str) -> float:
        """Per character its state's frequencies, mixed with how classes follow each other; then the end."""
        first, others, moves = self.tables
        at, before, result = 0, "", 0.0
        for table, part in ((first, token[:LITERAL]), (others, token[LITERAL:])):
            for c in part:
                chance, at = table[at][c]
                result += math.log(chance + moves[before][c])
                before = c
        stop = self.states[at].ends / max(1, self.states[at].count) if at >= 0 else 0.0
        return result + math.log((1 - self.mixed) * stop + self.mixed)


@dataclass(frozen=True)
class Model:
    """The automata, and by kind the log odds a character that a token needs."""

    automata: dict[str, Automaton]
    least: dict[str, float]

    def odds(self, kind: str, token: str) -> float:
        """Log odds a character."""
        return (self.automata[kind].log_likelihood(token) - self.automata[ORDINARY].log_likelihood(token)) / len(token)

    def judge(self, token: str) -> tuple[str | None, float]:
        """Of the kinds whose limit the token reaches, the one with the highest log odds a character, and these odds."""
        if not self.least:
            return None, 0.0
        ordinary = self.automata[ORDINARY].log_likelihood(token)
        odds = {k: (self.automata[k].log_likelihood(token) - ordinary) / len(token) for k in self.least}
        kinds = [k for k in odds if odds[k] >= self.least[k]] or list(odds)
        best = max(kinds, key=odds.__getitem__)
        return (best if odds[best] >= self.least[best] else None), odds[best]


def fit(tokens: dict[str, list[str]]) -> Model:
    """Automata of the kinds that have tokens, and of ordinary ones, and the limits between.

    Four of five tokens make the automata. The others say what odds ordinary tokens reach: the limit is
    where one in a thousand of them would pass, not below ``LEAST_ODDS``, and not so high that more than
    a tenth of a kind's own tokens would fail.
    """

    def parts(kind: str) -> tuple[list[str], list[str]]:
        own = tokens.get(kind, [])
        return [t for i, t in enumerate(own) if i % 5 < 4], own[4::5] or own

    kinds = [k for k in KINDS if tokens.get(k)]
    model = Model({k: Automaton(parts(k)[0]) for k in (*kinds, ORDINARY)}, {})
    for k in kinds:
        own = sorted(model.odds(k, t) for t in parts(k)[1])
        low = own[len(own) // 10]
        others = sorted(model.odds(k, t) for t in parts(ORDINARY)[1])
        high = others[len(others) - 1 - len(others) // 1000] if others else low
        model.least[k] = max(LEAST_ODDS, min(low, high))
    return model


MOST = {**dict.fromkeys(KINDS, SAMPLE_TOKENS), ORDINARY: ORDINARY_TOKENS}


def labelled_tokens(docs: DataFrame) -> dict[str, list[str]]:
    """By kind the first different tokens of all documents by hash; see the module's text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: dict[str, set[str]] = {k: set() for k in (*KINDS, ORDINARY)}
        for text in batch.column("text").to_pylist():
            spans = base_spans(text or "")
            for k, _, end, at in spans:
                if end - at <= LONGEST:
                    found[k].add(text[at:end])
            found[ORDINARY].update(text[s:e] for s, e in other_tokens(text or "", spans) if e - s <= LONGEST)
        # The first of all are among the first of each slice.
        hashed = {k: ((xxhash.xxh64_intdigest(t) >> 1, t) for t in tokens) for k, tokens in found.items()}
        rows = [(k, h, t) for k, tokens in hashed.items() for h, t in heapq.nsmallest(MOST[k], tokens)]
        kinds = zip(("kind", "h", "token"), (pa.string(), pa.int64(), pa.string()))
        return pa.RecordBatch.from_pydict({c: pa.array([row[i] for row in rows], t) for i, (c, t) in enumerate(kinds)})

    source = docs.select(F.col("text").alias("text"))
    tokens = cut(map_texts(source, run, "kind string, h bigint, token string").distinct())
    return {
        kind: [r["token"] for r in tokens.where(F.col("kind") == kind).orderBy("h", "token").limit(most).collect()]
        for kind, most in MOST.items()
    }


def all_spans(text: str, model: Model) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans: both by start, then kind."""
    spans = base_spans(text)
    base = [s[:3] for s in spans]
    added = []
    for start, end in other_tokens(text, spans):
        kind, _ = model.judge(text[start:end])
        if kind is not None:
            added.append((f"like_{kind}", start, end))
    if not added:
        return base, base
    return base, sorted(base + added, key=lambda s: (s[1], ORDER.index(s[0])))


def find(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id") -> DataFrame:
    """``id``, ``base`` and ``spans``: arrays of (kind, start, end), in code points, ends exclusive.

    Without a model one is fitted to a sample of the given documents.
    """
    model = model or fit(labelled_tokens(docs))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [all_spans(text or "", model) for text in batch.column("text").to_pylist()]
        columns = [span_array([f[i] for f in found]) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", "base", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col("text").alias("text"))
    return map_texts(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, base {SPANS_SQL}, spans {SPANS_SQL}")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: base spans by kind, their digest, and all spans."""
    return find(docs).select(
        F.col("id").alias("doc_id"),
        *[spans_of("base", kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(joined_spans("base").cast("binary"), 256).alias("base_sha256"),
        joined_spans("spans").alias("spans"),
    )
