"""Periodic runs of words, found by string synchronising sets.

A run is a stretch of consecutive words with smallest period q, that is words q apart are identical,
of at least four periods and ``MIN_LENGTH`` words, which no neighbouring word extends.

At each dyadic scale t, positions are chosen by hash: i is chosen if, of the windows of t words that
start at i to i+t, the one with the smallest hash starts at i or at i+t. The choice depends on the 2t
words from i on, so equal contexts are chosen alike, and one of every t positions is chosen unless all
around is highly periodic. Windows with a period of at most t/4 are left out; they lie in runs that
smaller scales have found. Chosen positions with equal contexts of 2t words that follow each other
propose their distance as a period, and a proposal is checked and extended word by word. A run whose
period q is between t and 2t has a chosen position s among its first t, and s+q is chosen too; its
context has no copy in between, as that would give a smaller period, so the pair is proposed. Periods
of at most three, which no scale covers, are found by comparing words that far apart.

So every run is found, unless two different windows of one text had the same 64-bit hash; what is
returned is always checked on the words themselves. The work is proportional to n log n in a text's
words. Texts are taken whole and many at once, with separators between them that equal nothing.

A null text has no words; ties, repeated rows and other columns do not matter, each row gets its result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from footfall.llm.common import map_texts, raw_texts

MIN_LENGTH, REPEATS = 6, 4
DIRECT = 3  # the largest period that is looked for directly; the first scale is the next number
SLICE = 4_000_000  # bytes of text scanned at once
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)
FIELDS = ("start", "length", "period")
RUN = pa.struct([(name, pa.int64()) for name in FIELDS])
RUN_SQL = "struct<start:bigint,length:bigint,period:bigint>"

Run = tuple[int, int, int]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _doubled(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of windows of twice that size from those of the size; as many as fit."""
    if len(hashes) <= size:
        return hashes[:0]
    return _mixed(hashes[:-size] * np.uint64(0x9E3779B97F4A7C15) + hashes[size:])


def _window_minima(values: np.ndarray, size: int) -> np.ndarray:
    """The smallest of each ``size + 1`` values in a row, for a power of two."""
    least, reach = values, 1
    while reach < size:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    return np.minimum(least[:-1], least[1:]) if size == 1 else np.minimum(least[: len(values) - size], values[size:])


def synchronising(hashes: np.ndarray, size: int, periodic: np.ndarray) -> np.ndarray:
    """The chosen positions at a scale; ``periodic`` marks windows that are left out."""
    values = np.where(periodic, NEVER, hashes)
    if len(values) <= size:
        return np.zeros(0, np.int64)
    least = _window_minima(values, size)
    first, last = values[: len(least)], values[size:]
    return np.flatnonzero(((first == least) | (last == least)) & (least != NEVER))


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where maximal stretches of true start and end."""
    edges = np.diff(np.concatenate([[0], equal.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _matching(words: np.ndarray, at: int, period: int, step: int) -> int:
    """How many positions from ``at`` on, upwards or downwards, equal the one a period later."""
    found, size = 0, 16
    room = len(words) - period - at if step > 0 else at + 1
    while found < room:
        n = min(size, room - found)
        low = at + found if step > 0 else at - found - n + 1
        equal = words[low : low + n] == words[low + period : low + period + n]
        if not equal.all():
            return found + int(np.argmin(equal if step > 0 else equal[::-1]))
        found += n
        size *= 2
    return room


def _proposed(words: np.ndarray, chosen: np.ndarray, contexts: np.ndarray, size: int) -> list[Run]:
    """(start, end, period) of the stretches of at least four periods that equal contexts propose."""
    chosen = chosen[chosen < len(contexts)]
    order = np.argsort(contexts[chosen], kind="stable")
    ordered = chosen[order]
    same = contexts[ordered[:-1]] == contexts[ordered[1:]]
    gap = ordered[1:] - ordered[:-1]
    fits = same & (gap >= size) & (gap <= 2 * size)
    starts, periods = ordered[:-1][fits], gap[fits]
    order = np.lexsort((starts, periods))
    found, period, done = [], 0, 0
    for s, q in zip(starts[order].tolist(), periods[order].tolist(), strict=True):
        if q != period:
            period, done = q, -1
        if s < done:
            continue
        right = _matching(words, s, q, 1)
        first = s - _matching(words, s - 1, q, -1)
        done = s + right
        if done + q - first >= REPEATS * q:
            found.append((first, done + q, q))
    return found


def find(texts: Sequence[np.ndarray], min_length: int = MIN_LENGTH) -> list[list[Run]]:
    """The runs (start, length, period) of each text, given as numbers that stand for its words, by start, then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    parts = [x for i, t in enumerate(texts) for x in (t, np.array([-1 - i], np.int64))]
    words = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
    offsets = np.cumsum(sizes + 1) - sizes - 1
    found: list[Run] = []
    for q in range(1, DIRECT + 1):
        starts, ends = _stretches(words[:-q] == words[q:])
        long = ends - starts + q >= REPEATS * q
        found += [(s, e + q, q) for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    hashes, at = _mixed(words.astype(np.uint64)), np.arange(len(words))
    scale, longest = 1, int(sizes.max(initial=0))
    lengths = np.repeat(sizes, sizes + 1)
    while REPEATS * scale <= longest:
        if scale > DIRECT:
            # Of texts too short for a period of this scale nothing is kept.
            keep = lengths >= REPEATS * scale
            if not keep.all():
                words, at, lengths = words[keep], at[keep], lengths[keep]
                hashes = hashes[keep[: len(hashes)]]
            periodic = np.zeros(len(hashes) + 1, np.int32)
            for s, e, q in found:
                if REPEATS * q <= scale <= e - s:
                    s, e = np.searchsorted(at, (s, e))
                    if e - s >= scale:
                        periodic[s] += 1
                        periodic[min(e - scale + 1, len(hashes))] -= 1
            chosen = synchronising(hashes, scale, np.cumsum(periodic[:-1]) > 0)
            contexts = _doubled(hashes, scale)
            found += [
                (int(at[s]), int(at[e - 1]) + 1, q) for s, e, q in _proposed(words, chosen, contexts, scale)
            ]
            hashes = contexts
        else:
            hashes = _doubled(hashes, scale)
        scale *= 2
    # A stretch has also the multiples of its period; the smallest counts.
    smallest: dict[tuple[int, int], int] = {}
    for s, e, q in found:
        if e - s >= min_length:
            smallest[s, e] = min(q, smallest.get((s, e), q))
    result: list[list[Run]] = [[] for _ in texts]
    for (s, e), q in sorted(smallest.items(), key=lambda x: (x[0][0], x[1])):
        text = int(np.searchsorted(offsets, s, "right")) - 1
        result[text].append((s - int(offsets[text]), e - s, q))
    return result


def kept_words(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that any run repeats, that is has after its first period."""
    if not runs:
        return words
    dropped = np.zeros(len(words) + 1, np.int32)
    for start, length, period in runs:
        dropped[start + period] += 1
        dropped[start + length] -= 1
    gone = np.cumsum(dropped) > 0
    return [w for w, out in zip(words, gone.tolist()) if not out]


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest length by period; of equal ones the first, then the one of the smallest period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


Rewriting = Callable[[list[bytes], int], list[bytes]]


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", min_length: int = MIN_LENGTH, rewrite: Rewriting | None = None, key: Column | None = None
) -> DataFrame:
    """Per row its ``id``, ``runs`` by start, ``best`` of them, and ``collapsed``, the words that stay, joined by blanks.

    ``rewrite`` may change the words first, given a row's number ``key``; rows without one keep theirs.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        numbers: dict[bytes, int] = {}
        words, coded = [], []
        for text, own in zip(raw_texts(batch.column("text")), batch.column("key").to_pylist(), strict=True):
            split = text.split()
            if rewrite is not None and own is not None:
                split = rewrite(split, own)
            words.append(split)
            coded.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in split), np.int64, len(split)))
        runs = find(coded, min_length)
        listed = [[dict(zip(FIELDS, r)) for r in own] for own in runs]
        best = [None if (r := strongest(own)) is None else dict(zip(FIELDS, r)) for own in runs]
        collapsed = [b" ".join(kept_words(w, own)).decode() for w, own in zip(words, runs)]
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(listed, pa.list_(RUN)), pa.array(best, RUN), pa.array(collapsed, pa.string())],
            ["id", "runs", "best", "collapsed"],
        )

    number = F.lit(None) if key is None else key
    rows = docs.select(F.col(id_col).alias("id"), F.col("text").alias("text"), number.cast("bigint").alias("key"))
    kind = rows.schema["id"].dataType.simpleString()
    return map_texts(rows, run, f"id {kind}, runs array<{RUN_SQL}>, best {RUN_SQL}, collapsed string", size=SLICE)


def planted(words: list[bytes], h: int) -> list[bytes]:
    """The words with a period of the contract's in every tenth text, by the checksum of its id."""
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def report(docs: DataFrame) -> DataFrame:
    """One row per document with the digests of its runs. A document without id keeps its words as they are."""
    checksum = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return periodic_runs(docs, rewrite=planted, key=checksum).select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
