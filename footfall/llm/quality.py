"""Quality rules on repetition, from a suffix array over the words of each text.

The suffixes of all texts of a batch are sorted by prefix doubling; as the first rank holds the text,
suffixes of different texts never compare equal. Neighbours in that order give the longest common
prefix of each suffix with any other of its text. A suffix whose longest such prefix has n words
starts an occurrence of a maximal repeated substring of n words, so the union of the spans of all
maximal repeats of at least m words is the union of [i, i + n) over all i with n >= m.

A text is kept if it passes the base rules (at least ``MIN_WORDS`` words; at most half of them in
repeated windows of ``WINDOW`` words) and the verdict on repeats: those of at least ``REPEAT``
words cover at most ``MAX_COVERED`` of the words, and the longest has at most ``MAX_REPEAT`` words.

Null and empty texts have no words and fail the base rules. Repeated rows are judged each; other
columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from footfall.llm.common import BLANKS, INNER, map_texts, raw_texts

SYMBOLS = b"#*$%&|<>"
ALL_BYTES = bytes(range(256))
NOT_SYMBOLS = bytes(b for b in ALL_BYTES if b not in SYMBOLS)


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    window: int = 3
    max_window_percent: int = 50
    repeat: int = 10
    max_covered_percent: int = 30
    max_repeat: int = 100


def first_ranks(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """A key of (text, word) for each word of the texts, one after the other, and where the texts end."""
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    flat = pa.array([x for w in words for x in w], pa.large_binary())
    codes = pc.dictionary_encode(flat).indices.to_numpy(zero_copy_only=False).astype(np.int64)
    span = int(codes.max(initial=0)) + 1
    text = np.repeat(np.arange(len(words), dtype=np.int64), [len(w) for w in words])
    return text * span + codes, ends


def longest_repeats(keys: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position the most words from there on that stand elsewhere in the same text too.

    A rank is the place of the first suffix of its group in sorted order, so the ranks of other
    groups stay valid while a group is split. Only suffixes in groups of two or more go on.
    """
    n = len(keys)
    if n == 0:
        return np.zeros(0, np.int64)
    until = np.repeat(ends, np.diff(ends, prepend=0))
    order = np.argsort(keys, kind="stable")
    ranks = _group_starts(keys[order], order, np.arange(n))
    levels = [(1, ranks)]
    step = 1
    while True:
        counts = np.bincount(ranks, minlength=n)
        active = np.flatnonzero(counts[ranks] > 1)
        if len(active) == 0:
            break
        ahead = active + step
        inside = ahead < until[active]
        second = np.where(inside, ranks[np.where(inside, ahead, 0)] + 1, 0)
        both = ranks[active] * (n + 1) + second
        within = np.argsort(both, kind="stable")
        sorted_first = ranks[active][within]
        # Places of a group go on from its start.
        begins = np.flatnonzero(np.diff(sorted_first, prepend=-1))
        sizes = np.diff(begins, append=len(active))
        places = sorted_first + np.arange(len(active)) - np.repeat(begins, sizes)
        refined = ranks.copy()
        refined[active] = _group_starts(both[within], within, places)
        ranks = refined
        step *= 2
        levels.append((step, ranks))
    order = np.empty(n, np.int64)
    order[ranks] = np.arange(n)
    return _with_neighbours(order, until, levels)


def _group_starts(in_order: np.ndarray, order: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each element the place of the first one with an equal key."""
    new = np.ones(len(in_order), bool)
    new[1:] = in_order[1:] != in_order[:-1]
    starts = places[new][np.cumsum(new) - 1]
    ranks = np.empty(len(in_order), np.int64)
    ranks[order] = starts
    return ranks


def _with_neighbours(order: np.ndarray, until: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """The longer of the common prefixes with the suffix before and after in sorted order."""
    n = len(order)
    common = np.zeros(n - 1, np.int64)
    left, right = order[:-1], order[1:]
    tops = [np.arange(n - 1)]  # pairs whose first ``step`` words are equal, level by level
    for _, ranks in levels:
        at = tops[-1]
        tops.append(at[ranks[left[at]] == ranks[right[at]]])
    tops = tops[1:]
    for top in range(len(levels)):
        deeper = np.zeros(n - 1, bool)
        if top + 1 < len(tops):
            deeper[tops[top + 1]] = True
        pairs = tops[top][~deeper[tops[top]]]
        a, b = left[pairs], right[pairs]
        length = np.full(len(pairs), levels[top][0], np.int64)
        for step, ranks in reversed(levels[:top]):
            x, y = a + length, b + length
            fits = (x < until[a]) & (y < until[b])
            x, y = np.where(fits, x, 0), np.where(fits, y, 0)
            length += np.where(fits & (ranks[x] == ranks[y]), step, 0)
        common[pairs] = length
    best = np.zeros(n, np.int64)
    best[left] = common
    best[right] = np.maximum(best[right], common)
    return best


def covered(repeats: np.ndarray, least: int) -> np.ndarray:
    """Whether each word is inside a repeat of at least that many words."""
    at = np.arange(len(repeats))
    reach = np.maximum.accumulate(np.where(repeats >= least, at + repeats, 0))
    return reach > at


def per_text(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the values of each text."""
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return sums[ends] - sums[np.concatenate(([0], ends[:-1]))]


def most_per_text(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lengths = np.diff(ends, prepend=0)
    result = np.zeros(len(ends), np.int64)
    filled = lengths > 0
    if filled.any():
        result[filled] = np.maximum.reduceat(values, (ends - lengths)[filled])
    return result


def repeated_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip(BLANKS)]
    return len(lines) - len(set(lines))


def measures(texts: list[bytes], rules: Rules) -> dict[str, np.ndarray]:
    words = [text.split() for text in texts]
    keys, ends = first_ranks(words)
    repeats = longest_repeats(keys, ends)
    return {
        "n_words": np.array([len(w) for w in words], np.int64),
        "word_chars": np.array([len(t.translate(None, BLANKS + INNER)) for t in texts], np.int64),
        "n_symbols": np.array([len(t.translate(None, NOT_SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array([repeated_lines(t) for t in texts], np.int64),
        "n_repeat_words": per_text(covered(repeats, rules.window), ends),
        "n_covered": per_text(covered(repeats, rules.repeat), ends),
        "longest_repeat": most_per_text(repeats, ends),
    }


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat")


def measured(
    docs: DataFrame, rules: Rules = Rules(), keep: tuple[str, ...] = ("doc_id",), text: bool = False
) -> DataFrame:
    """``row`` (the columns named in ``keep``), ``measures`` of the text, ``base_failed`` and ``kept``.

    Both are structs, so that columns of the same names stay apart. ``text`` asks for the text as well.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("text").alias("text"))
    fields = ", ".join(f"{c}: bigint" for c in COLUMNS)
    schema = f"row {rows.schema['row'].dataType.simpleString()}, measures struct<{fields}>" + ", text string" * text

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = measures(raw_texts(batch.column("text")), rules)
        made = pa.StructArray.from_arrays([pa.array(found[c]) for c in COLUMNS], list(COLUMNS))
        columns = {"row": batch.column("row"), "measures": made}
        if text:
            columns["text"] = batch.column("text")
        return pa.RecordBatch.from_pydict(columns)

    m = F.col("measures")
    failed = (m.n_words < rules.min_words) | (
        100 * m.n_repeat_words > rules.max_window_percent * m.n_words
    )
    passed = (100 * m.n_covered <= rules.max_covered_percent * m.n_words) & (
        m.longest_repeat <= rules.max_repeat
    )
    return map_texts(rows, run, schema).withColumns({"base_failed": failed, "kept": ~failed & passed})


def report(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per document with its measures and whether it is kept."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return measured(docs, rules).select(
        F.col("row.doc_id").alias("doc_id"), *[F.col(f"measures.{c}").alias(c) for c in names], "base_failed", "kept"
    )


def spans_of_repeats(texts: list[bytes], least: int) -> tuple[list[list[dict[str, int]]], list[int]]:
    """For each text the united spans of its repeats of at least that many words, and the longest repeat."""
    keys, ends = first_ranks([text.split() for text in texts])
    repeats = longest_repeats(keys, ends)
    inside = covered(repeats, least)
    spans = []
    for start, end in zip((ends - np.diff(ends, prepend=0)).tolist(), ends.tolist()):
        edges = np.flatnonzero(np.diff(inside[start:end].astype(np.int8), prepend=0, append=0))
        spans.append([{"start": int(s), "end": int(e)} for s, e in edges.reshape(-1, 2)])
    return spans, most_per_text(repeats, ends).tolist()


def repeats(docs: DataFrame, least: int = Rules.repeat, id_col: str = "doc_id") -> DataFrame:
    """``id``, ``spans`` of words in repeats of at least ``least`` words (ends exclusive), ``longest``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans, longest = spans_of_repeats(raw_texts(batch.column("text")), least)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.RecordBatch.from_pydict(
            {"id": batch.column("id"), "spans": pa.array(spans, kind), "longest": pa.array(longest, pa.int64())}
        )

    rows = docs.select(F.col(id_col).alias("id"), F.col("text").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return map_texts(rows, run, f"id {kind}, spans array<struct<start:int,end:int>>, longest bigint")


def clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that are kept, with all their columns."""
    others = tuple(c for c in docs.columns if c != "text")
    rows = measured(docs, rules, others, text=True).where("kept")
    return rows.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
