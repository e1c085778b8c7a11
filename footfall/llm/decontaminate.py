"""Benchmark decontamination with a suffix automaton of the test items.

Each document streams its words through generalised suffix automata of the items. At every word the automaton knows the longest run of words ending there that
stands in an item. Where that run has at least ``window`` words, all of it lies in windows of items.
An item of fewer words is one window: it counts where all of it stands.

Items go into automata of at most ``block`` words each. Longer items are divided with an overlap of
a window less one word, so no window is lost. Tasks build the automata and store them in the shared
folder; Spark's file distribution brings those files to each executor's disk. One stage takes the
documents through them: a task holds some megabytes of texts and one automaton at a time, however
large the benchmark is. That is a stated query set against all rows: no rows are paired or shuffled.

Null and empty texts have no words and no hits; items without words have no window. A repeated item
counts once by its id. An item without id marks words but is neither counted nor listed. Repeated
documents are judged each; other columns do not matter. Without items nothing is hit.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, functions as F

from footfall.llm.common import folded_words, raw_texts, show_package, slices, stored

WINDOW = 13
BLOCK = 200_000
MAX_PERCENT = 5
# Bytes of texts that a task holds while it goes through several automata.
HELD = 64_000_000

Item = tuple[str | None, list[bytes], bool]
Span = tuple[int, int]


class Automaton:
    """Suffix automaton of word sequences.

    ``nexts``, ``links`` and ``lengths`` are the usual transitions, suffix links and longest lengths
    by state; state 0 is the start. ``groups`` are the different sets of items that share a window,
    ``group`` the number of that set by state. ``short`` has the (length, id) of whole short items.
    """

    def __init__(self, items: list[Item], window: int):
        self.window = window
        self.nexts: list[dict[bytes, int]] = [{}]
        self.links = [-1]
        self.lengths = [0]
        for _, words, _ in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        sharing: dict[int, set[str | None]] = {}
        self.short: dict[int, list[tuple[int, str | None]]] = {}
        for item, words, whole in items:
            state = 0
            for n, word in enumerate(words, 1):
                state = self.nexts[state][word]
                if n >= window:
                    sharing.setdefault(self._window_state(state), set()).add(item)
            if whole and 0 < len(words) < window:
                self.short.setdefault(state, []).append((len(words), item))
        numbers: dict[frozenset[str | None], int] = {}
        self.group = {state: numbers.setdefault(frozenset(own), len(numbers)) for state, own in sharing.items()}
        self.groups = list(numbers)
        # The shortest run that has to be looked at, by state.
        self.least = [window] * len(self.links)
        for state in sorted(range(1, len(self.links)), key=self.lengths.__getitem__):
            own = min((n for n, _ in self.short.get(state, ())), default=window)
            self.least[state] = min(own, self.least[self.links[state]])

    def _add(self, length: int, nexts: dict[bytes, int], link: int) -> int:
        self.nexts.append(nexts)
        self.links.append(link)
        self.lengths.append(length)
        return len(self.links) - 1

    def _extend(self, last: int, word: bytes) -> int:
        """The state of the sequence at ``last`` and one more word."""
        nexts, links, lengths = self.nexts, self.links, self.lengths
        known = nexts[last].get(word)
        if known is not None:
            return known if lengths[known] == lengths[last] + 1 else self._split(last, word, known)
        new = self._add(lengths[last] + 1, {}, 0)
        at = last
        while at >= 0 and word not in nexts[at]:
            nexts[at][word] = new
            at = links[at]
        if at >= 0:
            known = nexts[at][word]
            links[new] = known if lengths[known] == lengths[at] + 1 else self._split(at, word, known)
        return new

    def _split(self, at: int, word: bytes, known: int) -> int:
        """Takes the shorter sequences out of a state that also stands for longer ones."""
        copy = self._add(self.lengths[at] + 1, dict(self.nexts[known]), self.links[known])
        self.links[known] = copy
        while at >= 0 and self.nexts[at].get(word) == known:
            self.nexts[at][word] = copy
            at = self.links[at]
        return copy

    def _window_state(self, state: int) -> int:
        while self.lengths[self.links[state]] >= self.window:
            state = self.links[state]
        return state

    def hits(self, words: list[bytes]) -> tuple[list[Span], set[str | None]]:
        """The merged (start, end) of hit words, and the items hit."""
        nexts, links, lengths, least = self.nexts, self.links, self.lengths, self.least
        spans: list[Span] = []
        found: set[str | None] = set()
        groups: set[int] = set()
        state = run = 0
        for at, word in enumerate(words, 1):
            known = nexts[state].get(word)
            if known is None:
                while state:
                    state = links[state]
                    known = nexts[state].get(word)
                    if known is not None:
                        break
                run = lengths[state]
                if known is None:
                    continue
            state = known
            run += 1
            if run < least[state]:
                continue
            longest = 0
            if run >= self.window:
                groups.add(self.group[self._window_state(state)])
                longest = run
            up = state
            while up > 0 and least[up] < self.window:
                for n, item in self.short.get(up, ()):
                    if n <= run:
                        found.add(item)
                        longest = max(longest, n)
                up = links[up]
            if longest:
                spans.append((at - longest, at))
        return merged(spans), found.union(*[self.groups[g] for g in groups])


def merged(spans: list[Span]) -> list[Span]:
    result: list[Span] = []
    for start, end in sorted(spans):
        if result and start <= result[-1][1]:
            result[-1] = (result[-1][0], max(end, result[-1][1]))
        else:
            result.append((start, end))
    return result


def packed(items: Iterable[tuple[str | None, bytes]], window: int, block: int) -> Iterator[list[Item]]:
    """The items (id, text) as (id, words, whether whole), in lists of at most ``block`` words."""
    held: list[Item] = []
    size = 0
    for item, text in items:
        words = folded_words(text)
        step = block - window + 1
        for start in range(0, max(1, len(words) - window + 1), step):
            part = words[start : start + block]
            if not part:
                continue
            if held and size + len(part) > block:
                yield held
                held, size = [], 0
            held.append((item, part, len(part) == len(words)))
            size += len(part)
    if held:
        yield held


def automata(benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """The automata of all items, pickled, one row each, as a stored table; an empty one if there are no words.

    Equal rows of the benchmark become one before that. Partitions are sized for one automaton each.
    """
    if block < 2 * window:
        raise ValueError("a block has to hold two windows")
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where(F.col("text").isNotNull())
    # English has some six bytes a word; other texts give smaller or more automata a partition.
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.distinct().coalesce(1 + size // (6 * block))
    show_package(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = (
            row
            for batch in batches
            for part in slices([batch], "text")
            for row in zip(part.column("item").to_pylist(), raw_texts(part.column("text")))
        )
        for own in packed(items, window, block):
            yield pa.RecordBatch.from_pydict({"automaton": pa.array([pickle.dumps(Automaton(own, window), 5)], pa.binary())})

    table = stored(rows.mapInArrow(run, "automaton binary"))
    if not table.isEmpty():
        return table
    return stored(benchmark.sparkSession.createDataFrame([(pickle.dumps(Automaton([], window), 5),)], "automaton binary"))


def with_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: tuple[str, ...] = ("doc_id",),
    window: int = WINDOW,
    block: int = BLOCK,
    cut: tuple[int, int] | None = None,
) -> DataFrame:
    """``row`` (the columns named in ``keep``), ``n_words``, ``spans`` of hit words, ``items``, ``n_hit``.

    ``cut`` (longest, percent) asks for the ``text`` as well, without the spans of more than
    ``longest`` words, or without all spans if they cover that percentage of it; ``changed`` says
    whether anything was cut.
    """
    context = docs.sparkSession.sparkContext
    table = automata(benchmark, window, block)
    number = table.count()
    files = []
    for path in table.inputFiles():
        context.addFile(path)
        files.append(unquote(path.rsplit("/", 1)[1]))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("text").alias("text"))
    schema = (
        f"row {rows.schema['row'].dataType.simpleString()}, n_words bigint, "
        "spans array<struct<start:int,end:int>>, items array<string>" + ", text string, changed boolean" * (cut is not None)
    )
    show_package(rows)
    rows = rows.mapInArrow(_streaming(files, number, cut), schema)
    total = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + (s["end"] - s["start"]))
    return rows.withColumn("n_hit", total)


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _loaded(files: list[str]) -> Iterator[Automaton]:
    """The automata from the executor's copies of the files, one after the other."""
    for name in files:
        for batch in pq.ParquetFile(SparkFiles.get(name)).iter_batches(batch_size=1):
            for value in batch.column("automaton"):
                yield pickle.loads(value.as_py())


def _streaming(files: list[str], number: int, cut: tuple[int, int] | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A single automaton stays in memory; several are read again for each lot of texts.
        single = list(_loaded(files)) if number == 1 else None
        held: list[pa.RecordBatch] = []
        size = 0
        for part in slices(batches, "text"):
            held.append(part)
            size += part.column("text").nbytes
            if single or size >= HELD:
                yield from _judged(held, single or _loaded(files), cut)
                held, size = [], 0
        if held:
            yield from _judged(held, single or _loaded(files), cut)

    return run


def _judged(parts: list[pa.RecordBatch], several: Iterable[Automaton], cut: tuple[int, int] | None) -> Iterator[pa.RecordBatch]:
    texts = [raw_texts(part.column("text")) for part in parts]
    sizes = [[0] * len(own) for own in texts]
    hits: list[list[tuple[list[Span], set[str | None]]]] = [[([], set())] * len(own) for own in texts]
    for automaton in several:
        for own, counts, before in zip(texts, sizes, hits):
            for i, text in enumerate(own):
                words = folded_words(text)
                counts[i] = len(words)
                spans, found = automaton.hits(words)
                if spans:
                    before[i] = (merged(before[i][0] + spans) if before[i][0] else spans, before[i][1] | found)
    for part, own, counts, found in zip(parts, texts, sizes, hits):
        columns = {
            "row": part.column("row"),
            "n_words": pa.array(counts, pa.int64()),
            "spans": pa.array([[{"start": s, "end": e} for s, e in spans] for spans, _ in found], SPANS),
            "items": pa.array([sorted(items - {None}) for _, items in found], pa.list_(pa.string())),
        }
        if cut is not None:
            gone = [_to_cut(spans, n, *cut) for (spans, _), n in zip(found, counts)]
            kept = [cut_words(text, spans) if spans else text for text, spans in zip(own, gone)]
            text = pa.array(kept, pa.binary()).cast(pa.string())
            columns["text"] = pa.array(
                [None if old is None else new for old, new in zip(part.column("text").to_pylist(), text.to_pylist())], pa.string()
            )
            columns["changed"] = pa.array([bool(spans) for spans in gone], pa.bool_())
        yield pa.RecordBatch.from_pydict(columns)


def _to_cut(spans: list[Span], n_words: int, longest: int, percent: int) -> list[Span]:
    if 100 * sum(end - start for start, end in spans) >= percent * n_words:
        return spans
    return [(start, end) for start, end in spans if end - start > longest]


def _contaminated(percent: int):
    return (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))


def report(docs: DataFrame, benchmark: DataFrame, percent: int = MAX_PERCENT) -> DataFrame:
    """One row per document: words, hit words, items with hits, and whether it is contaminated."""
    return with_hits(docs, benchmark).select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        _contaminated(percent).alias("contaminated"),
    )


def _whole(docs: DataFrame, benchmark: DataFrame, longest: int, percent: int) -> DataFrame:
    others = tuple(c for c in docs.columns if c != "text")
    return with_hits(docs, benchmark, others, cut=(longest, percent))


def _columns(docs: DataFrame, length: str | None) -> list[Column]:
    def column(name: str) -> Column:
        if name == "text":
            return F.col("text")
        own = F.col(f"row.`{name}`")
        if name == length:
            own = F.when(F.col("changed"), F.length("text").cast(docs.schema[name].dataType)).otherwise(own)
        return own.alias(name)

    return [column(c) for c in docs.columns]


def clean(
    docs: DataFrame, benchmark: DataFrame, longest: int = WINDOW, percent: int = MAX_PERCENT, length: str | None = "n_chars"
) -> DataFrame:
    """The documents that are not contaminated, with all their columns.

    Hit spans of more than ``longest`` words are taken out of them. A text that changes gets its new
    length in the column named by ``length``, if there is one; others stay as they are.
    """
    rows = _whole(docs, benchmark, longest, percent)
    return rows.where(~_contaminated(percent)).select(*_columns(docs, length))


def without_spans(
    docs: DataFrame, benchmark: DataFrame, longest: int = WINDOW, percent: int = MAX_PERCENT, length: str | None = "n_chars"
) -> DataFrame:
    """All documents with the hit spans taken out of their texts.

    Spans of more than ``longest`` words go from any document, all spans from a contaminated one. A
    span reaches from the start of its first word to the start of the word after it. Columns stay,
    but for the length of changed texts, see ``clean``.
    """
    return _whole(docs, benchmark, longest, percent).select(*_columns(docs, length))


def cut_words(text: bytes, spans: list[Span]) -> bytes:
    if not spans:
        return text
    folded = text.translate(_MARKS)
    starts = [i for i in range(len(folded)) if folded[i] and (i == 0 or not folded[i - 1])]
    starts.append(len(text))
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at : starts[start]])
        at = starts[end]
    return b"".join(kept) + text[at:]


# Zero for what separates words.
_MARKS = bytes(1 if folded_words(bytes([b])) else 0 for b in range(256))
