"""Language-model scores of whole texts by a hashed maximum-entropy model.

A text is its words and one end. The leading bits of a word's hash, three at a time, are its class, its
subclass and so on, so a word's probability after a history is a product of softmaxes over eight
classes each, and of the word's share in the last class. Each softmax adds the logarithm of the
classes' counts and weights of three features: the word before (n-gram of two), the two words before
(n-gram of three), and the word before the last (skip). Weights lie in ``ROWS`` hashed rows of eight for each level of classes.
There are as many classes as the training words ask for, at most ``8 ** MAX_DEPTH``. With all weights
zero the model is the smoothed unigram model; within a last class words keep their smoothed shares,
and each has one place for all words not seen.

Training goes over all training rows, one part of them in each of ``ROUNDS`` rounds: tasks sum the gradient of the
log-likelihood over their texts, Spark adds the sums row by row, and the weights take a step along
them, scaled by how often a row was met. What is broadcast is bounded: the rows of weights,
the classes' counts, and the head of the vocabulary, the words of at most ``HEAD_BYTES`` bytes that
make up at least one in ``HEAD`` training tokens, of which there can be no more than ``HEAD``. The counts
of all other words, however many there are, meet the texts by a shuffle join.

A null text is empty and has the end alone. Rows without id are trained on. Without training rows no word is known.
Repeated rows count and come out each; other columns do not matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from footfall.llm.common import BLANKS, UPPER, map_texts, raw_texts, show_package, slices, stored
from footfall.operators.lookup import shuffled_join

FAN, FAN_BITS, MAX_DEPTH = 8, 3, 5
ROW_BITS = 16
ROWS = 1 << ROW_BITS  # of each level
FEATURES = 3
ROUNDS, RATE, PRIOR = 2, 0.3, 3.0
HEAD, HEAD_BYTES = 1 << 20, 64
PARTS = 4  # of the input that a task of training reads, where there are more than can run at once
SMOOTH = 0.1
END_WORD = " "  # no word of a text has a blank
SLICE = 4_000_000  # bytes of text handled at once
BLOCK = 1 << 14  # tokens whose probabilities are computed at once
CHUNK = 1 << 20  # bytes whose words are hashed at once

# A-Z in lower case, all blanks alike.
FOLDED = bytes(b + 32 if b in UPPER else 32 if b in BLANKS else b for b in range(256))
BASE = 0x9E3779B97F4A7C15
END, START = np.uint64(0x8F1BBCDC8F1BBCDC), np.uint64(0x5A8279995A827999)
NODE = 0xD6E8FEB86659FD93
SHIFT = np.uint64(64 - ROW_BITS)
ONES = np.ones(FAN, np.float32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base modulo 2^64 and their inverses."""
    both = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        powers = np.full(size, base, np.uint64)
        powers[0] = 1
        both.append(np.multiply.accumulate(powers))
    return both[0], both[1]


def word_hashes(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a folded text, and where they start. Equal words have equal hashes."""
    hashes, starts, at = [], [], 0
    while at < len(buffer):
        end = buffer.find(b" ", at + CHUNK)
        end = len(buffer) if end < 0 else end
        raw = np.frombuffer(buffer, np.uint8, end - at, at)
        size = max(CHUNK, 1 << (len(raw) + 1).bit_length())
        powers, inverses = _powers(size)
        blank = np.concatenate([[True], raw == 32, [True]])
        first = np.flatnonzero(blank[:-1] & ~blank[1:])
        last = np.flatnonzero(~blank[:-1] & blank[1:])
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[: len(raw)], out=sums[1:])
        hashes.append(_mixed((sums[last] - sums[first]) * inverses[first]))
        starts.append(first + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


@dataclass
class Stream:
    """Tokens of several texts in a row; ``firsts`` are where texts start."""

    tokens: np.ndarray
    firsts: np.ndarray

    def __post_init__(self):
        self.padded = np.concatenate([[START, START], self.tokens])
        self.first = np.zeros(len(self.tokens) + 1, bool)
        self.first[self.firsts] = True

    def blocks(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Where a block starts, its tokens, and the hashes of its features in rows."""
        for i in range(0, len(self.tokens), BLOCK):
            tokens = self.tokens[i : i + BLOCK]
            n = len(tokens)
            first = self.first[i : i + n]
            second = np.concatenate([[bool(i) and bool(self.first[i - 1])], first[:-1]])
            before = np.where(first, START, self.padded[i + 1 : i + 1 + n])
            earlier = np.where(first | second, START, self.padded[i : i + n])
            features = np.stack([before * np.uint64(3), before * np.uint64(5) + _mixed(earlier), earlier * np.uint64(7)])
            yield i, tokens, _mixed(features)


def stream(texts: list[bytes]) -> Stream:
    """The tokens of folded texts."""
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    words, starts = word_hashes(b" ".join(texts))
    before = np.searchsorted(starts, np.cumsum(lengths) - lengths)
    sizes = np.diff(np.append(before, len(words))) + 1
    tokens = np.full(len(words) + len(texts), END)
    inner = np.ones(len(tokens), bool)
    ends = np.cumsum(sizes) - 1
    inner[ends] = False
    tokens[inner] = words
    return Stream(tokens, ends - sizes + 1)


def depth_for(words: int) -> int:
    """Levels of classes, so that there are about as many last classes as words."""
    depth = 1
    while depth < MAX_DEPTH and FAN**depth < words:
        depth += 1
    return depth


def last_classes(hashes: np.ndarray, depth: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - FAN_BITS * depth)).astype(np.int64)


@dataclass
class Gradient:
    """Sums over tokens: what was seen less what was expected, by weight, and how often a row was met."""

    wrong: np.ndarray = field(default_factory=lambda: np.zeros((MAX_DEPTH, ROWS, FAN), np.float32))
    met: np.ndarray = field(default_factory=lambda: np.zeros((MAX_DEPTH, ROWS), np.float32))


class Model:
    """``mass`` has the smoothed counts of the last classes."""

    def __init__(self, mass: np.ndarray, weights: np.ndarray | None = None):
        self.depth = round(math.log(len(mass), FAN))
        self.weights = np.zeros((MAX_DEPTH, ROWS, FAN), np.float32) if weights is None else weights
        # By level: the logarithms of the classes' shares in the class above, a row for each of these.
        masses = [mass.reshape(FAN**level, FAN, -1).sum(axis=2) for level in range(self.depth)]
        self.biases = [np.log(m / m.sum(axis=1, keepdims=True)).astype(np.float32) for m in masses]
        self.log_mass = np.log(mass)

    def __setstate__(self, state: dict) -> None:
        """After unpickling, arrays have types of their own, with which numpy adds many times slower than with its."""
        self.__dict__.update(state)
        self.weights = self.weights.view(np.float32)
        self.biases = [b.view(np.float32) for b in self.biases]

    def _level(self, level: int, tokens: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The rows of weights by feature, the places of the classes taken, the logits, and their exponentials.

        Logits are below the weights' few steps, so that no exponential is too large.
        """
        above = tokens >> np.uint64(64 - FAN_BITS * level) if level else np.zeros(len(tokens), np.uint64)
        taken = (tokens >> np.uint64(64 - FAN_BITS * (level + 1))) & np.uint64(FAN - 1)
        node = (above + np.uint64(1)) * np.uint64(NODE)
        rows = (((features ^ node) * np.uint64(BASE)) >> SHIFT).astype(np.int64)
        logits = self.biases[level].take(above.astype(np.int64), axis=0)
        for own in rows:
            logits += self.weights[level].take(own, axis=0)
        return rows, np.arange(len(tokens)) * FAN + taken.astype(np.int64), logits, np.exp(logits)

    def log_chances(self, texts: Stream) -> np.ndarray:
        """By token, the logarithm of the chance of its last class, less that class's mass."""
        result = -self.log_mass.take(last_classes(texts.tokens, self.depth))
        blocks = list(texts.blocks())
        # One level after the other, so that its weights stay near the processor.
        for level in range(self.depth):
            for i, tokens, features in blocks:
                _, taken, logits, powers = self._level(level, tokens, features)
                result[i : i + len(tokens)] += logits.ravel().take(taken) - np.log(powers @ ONES)
        return result

    def add_gradient(self, texts: Stream, gradient: Gradient) -> None:
        columns = np.arange(FAN)
        blocks = list(texts.blocks())
        for level in range(self.depth):
            sums, met = gradient.wrong[level].ravel(), gradient.met[level]
            for _, tokens, features in blocks:
                rows, taken, _, powers = self._level(level, tokens, features)
                powers *= (-1 / (powers @ ONES))[:, None]
                wrong = powers.ravel()
                wrong[taken] += 1
                for own in rows:
                    np.add.at(sums, np.add.outer(own * FAN, columns).ravel(), wrong)
                    np.add.at(met, own, np.float32(1))

    def stepped(self, wrong: np.ndarray, met: np.ndarray) -> Model:
        """The model after a step along the gradient; rows met more often take it with more certainty."""
        step = RATE * wrong / (met[..., None] / FAN + PRIOR)
        after = Model.__new__(Model)
        after.__dict__.update(self.__dict__)
        after.weights = self.weights + np.clip(step, -1, 1).astype(np.float32)
        return after


def held_out(key: Column) -> Column:
    """Whether a row is kept from learning: CRC-32 of its id as text, modulo 10, is 0; never for null."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def word_counts(rows: DataFrame) -> DataFrame:
    """``word`` and ``n`` of the tokens of all texts; the end is ``END_WORD``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = raw_texts(batch.column("text"))
        counts = Counter(b" ".join(texts).translate(FOLDED).split())
        words = [w.decode() for w in counts] + [END_WORD]
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array([*counts.values(), len(texts)], pa.int64())], ["word", "n"]
        )

    return map_texts(rows, run, "word string, n bigint", size=SLICE).groupBy("word").agg(F.sum("n").alias("n"))


def class_masses(counts: DataFrame, depth: int) -> np.ndarray:
    """The smoothed counts of the last classes: each word's count and a bit, and a bit for words not seen."""

    def run(batches):
        for batch in batches:
            words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            hashes = np.empty(len(words), np.uint64)
            is_end = np.array([w == END_WORD for w in words], bool)
            hashes[is_end] = END
            hashes[~is_end] = word_hashes(b" ".join(w.encode() for w in words if w != END_WORD))[0]
            classes = last_classes(hashes, depth)
            used, where = np.unique(classes, return_inverse=True)
            sums = np.zeros(len(used), np.int64)
            np.add.at(sums, where, n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(used), pa.array(sums), pa.array(np.bincount(where, minlength=len(used)))], ["class", "n", "words"]
            )

    show_package(counts)
    sums = (
        counts.mapInArrow(run, "class bigint, n bigint, words bigint")
        .groupBy("class")
        .agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
        .collect()
    )
    mass = np.full(FAN**depth, SMOOTH)
    for r in sums:
        mass[r["class"]] += r["n"] + SMOOTH * r["words"]
    return mass


def trained(rows: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    """The model after one step for each part of the rows, ``id`` and ``text``."""
    show_package(rows)
    part = F.pmod(F.xxhash64("id", "text"), F.lit(rounds))
    parts = [f"w{i}" for i in range(FAN)]

    def gradients(shared: Broadcast):
        def run(batches):
            gradient = Gradient()
            for batch in slices(batches, "text", SLICE):
                shared.value.add_gradient(stream([t.translate(FOLDED) for t in raw_texts(batch.column("text"))]), gradient)
            met = np.flatnonzero(gradient.met)
            wrong = gradient.wrong.reshape(-1, FAN)[met]
            yield pa.RecordBatch.from_arrays(
                [pa.array(met.astype(np.int32)), pa.array(gradient.met.ravel()[met]), *[pa.array(wrong[:, i].copy()) for i in range(FAN)]],
                ["row", "met", *parts],
            )

        return run

    # What a task sends is of one size whatever it reads, so a task reads several of the input's parts.
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions() // PARTS)
    for number in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(model)
        own = rows.where(part == number).select("text").coalesce(tasks)
        schema = "row int, met float, " + ", ".join(f"{p} float" for p in parts)
        sums = own.mapInArrow(gradients(shared), schema).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("met", *parts)])
        found = sums.toArrow()
        at = found.column("row").to_numpy()
        wrong, met = np.zeros((MAX_DEPTH * ROWS, FAN)), np.zeros(MAX_DEPTH * ROWS)
        met[at] = found.column("met").to_numpy()
        for i, name in enumerate(parts):
            wrong[at, i] = found.column(name).to_numpy()
        model = model.stepped(wrong.reshape(MAX_DEPTH, ROWS, FAN), met.reshape(MAX_DEPTH, ROWS))
        shared.unpersist()
    return model


@dataclass
class LanguageModel:
    """The model with the counts of all training words and their sums."""

    model: Model
    counts: DataFrame
    tokens: int
    words: int

    def head(self) -> dict[bytes, int]:
        """The counts of the frequent words; by what frequent means, at most ``HEAD``."""
        frequent = (F.col("n") * HEAD >= self.tokens) & (F.octet_length("word") <= HEAD_BYTES)
        found = self.counts.where(frequent).toArrow()
        return dict(zip((w.encode() for w in found.column("word").to_pylist()), found.column("n").to_pylist(), strict=True))


def fit(rows: DataFrame, rounds: int = ROUNDS) -> LanguageModel:
    """Learns from ``id`` and ``text``."""
    counts = stored(word_counts(rows))
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("words")).first()
    model = trained(rows, Model(class_masses(counts, depth_for(sums["words"]))), rounds)
    return LanguageModel(model, counts, sums["n"], sums["words"])


def _known(count: Column | str) -> Column:
    return F.log10(F.coalesce(count, F.lit(0)) + F.lit(SMOOTH))


def score(docs: DataFrame, fitted: LanguageModel, id_col: str = "doc_id") -> DataFrame:
    """``id``, ``n_tokens``, ``n_known``, ``base_score`` and ``score`` of each row.

    A pass over the texts computes what the broadcast model knows and lists the words beyond the head,
    which then meet their counts.
    """
    shared = docs.sparkSession.sparkContext.broadcast((fitted.model, fitted.head()))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, head = shared.value
        texts = [t.translate(FOLDED) for t in raw_texts(batch.column("text"))]
        flow = stream(texts)
        chances = np.add.reduceat(model.log_chances(flow), flow.firsts) if texts else np.zeros(0)
        end = head.get(END_WORD.encode(), 0)
        tokens, seen, logs, rest = [], [], [], []
        for text in texts:
            words = text.split()
            counts = np.fromiter(map(head.get, words, repeat(0)), np.float64, len(words))
            beyond = Counter(words[i] for i in np.flatnonzero(counts == 0).tolist())
            if end == 0:
                beyond[END_WORD.encode()] = 1
            counts = np.append(counts[counts > 0], [end] * (end > 0))
            tokens.append(len(words) + 1)
            seen.append(len(counts))
            logs.append(float(np.log10(counts + SMOOTH).sum()))
            rest.append([{"word": w.decode(), "n": n} for w, n in beyond.items()])
        return pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                pa.array(tokens, pa.int64()),
                pa.array(seen, pa.int64()),
                pa.array(logs, pa.float64()),
                pa.array(chances / math.log(10), pa.float64()),
                pa.array(rest, pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))),
            ],
            ["id", "tokens", "seen", "logs", "chances", "rest"],
        )

    rows = docs.select(F.col(id_col).alias("id"), F.col("text").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    sums = "tokens bigint, seen bigint, logs double, chances double"
    passed = map_texts(rows, run, f"id {kind}, {sums}, rest array<struct<word:string,n:bigint>>", size=SLICE)
    numbered = passed.withColumn("row", F.monotonically_increasing_id())
    # One entry has a text's own sums, under a key that no word has; the others are its rare words.
    sums_of = F.struct("id", "tokens", "seen", "logs", "chances")
    key = F.concat(F.lit("  "), F.col("row").cast("string"))
    own = F.struct(key.alias("word"), F.lit(0).cast("bigint").alias("n"), sums_of.alias("own"))
    nothing = F.lit(None).cast(numbered.select(sums_of.alias("own")).schema["own"].dataType)
    rare = F.transform("rest", lambda r: F.struct(r["word"].alias("word"), r["n"].alias("n"), nothing.alias("own")))
    entries = numbered.select("row", F.inline(F.concat(F.array(own), rare)))
    joined = shuffled_join(entries, fitted.counts.withColumnRenamed("n", "count"), ["word"], "left")
    found = F.sum(F.when(F.col("count").isNotNull(), F.col("n")).otherwise(0))
    added = joined.groupBy("row").agg(
        F.max("own").alias("own"), found.alias("found"), F.sum(F.col("n") * _known("count")).alias("more")
    )
    total = added.select(
        "own.id",
        F.col("own.tokens").alias("n_tokens"),
        (F.col("own.seen") + F.col("found")).alias("n_known"),
        (F.col("own.logs") + F.col("more")).alias("known"),
        "own.chances",
    )
    # Of all V words and one place for those not seen.
    norm = math.log10(fitted.tokens + SMOOTH * (fitted.words + 1))
    return total.select(
        "id",
        "n_tokens",
        "n_known",
        (F.col("known") - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        (F.col("known") + F.col("chances")).alias("score"),
    )


def report(docs: DataFrame) -> DataFrame:
    """One row per document, scored by a model of the rows that are not held out."""
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("text"))
    fitted = fit(rows.where(~held_out(F.col("id"))))
    return score(rows, fitted, "id").select(
        F.col("id").alias("doc_id"),
        held_out(F.col("id")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(fitted.tokens).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
    )
