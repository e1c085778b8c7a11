"""Language identification of whole texts by a linear-chain conditional random field over their words.

Each word has features: itself (lexicon), its first and last letters (affixes) and its n-grams, all of
bytes with A-Z in lower case, hashed into one table of weights by language. A transition matrix is
learned with them, from sequences in which pieces of several texts follow each other, so that it
knows how seldom a text switches languages. Forward-backward labels every word of a text in one
chain; the text's language is the one with the largest sum of word probabilities, and the score is
its mean. ``words`` gives the labels of the words themselves.

The field is fitted to a bounded sample, the documented limit: about ``SAMPLE_ROWS`` labelled rows a
language, chosen by a hash of their id, of each at most ``PIECES`` pieces of ``PIECE`` words spread
over the text. Predictions see nothing but whole texts.

A text that is null or has no letter is ``und`` with score 0. Without labelled rows every text is.
Ties go to the language that sorts first. Repeated rows are predicted each; other columns do not
matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from footfall.llm.common import LOWER, map_texts, raw_texts

SAMPLE_ROWS, PIECES, PIECE = 400, 3, 48
BUCKETS = 1 << 18
UNKNOWN = "und"
SLICE = 4_000_000  # bytes of text labelled at once
# Bytes that are no part of a word are blanks: all of ASCII but letters.
LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in LOWER)
MULTIPLIER = np.uint32(0x9E3779B1)


def word_bytes(text: bytes) -> bytes:
    """The words with one blank after each and one before the first."""
    words = text.translate(LETTERS).split()
    return b" " + b" ".join(words) + b" " if words else b""


def has_letter(text: bytes) -> bool:
    folded = text.translate(LETTERS).split()
    if not folded:
        return False
    return any(w.isascii() for w in folded) or any(map(str.isalpha, text.decode()))


def _bucket(codes: np.ndarray, kind: int) -> np.ndarray:
    mixed = codes + np.uint32(kind * 0x632BE5AB & 0xFFFFFFFF)
    mixed *= MULTIPLIER
    mixed ^= mixed >> np.uint32(15)
    mixed *= MULTIPLIER
    mixed >>= np.uint32(32 - 18)
    return mixed


@dataclass
class Features:
    """Buckets by position of the buffer, and where words start and end in it."""

    grams: list[np.ndarray]
    words: list[np.ndarray]
    starts: np.ndarray
    ends: np.ndarray


def features(buffer: bytes) -> Features:
    """N-grams of three and four bytes that may reach into the blanks around, affixes of three, and the word.

    A gram belongs to the word in which its second byte is.
    """
    raw = np.frombuffer(buffer, np.uint8)
    blank = raw == 32
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    n = len(raw)
    b = np.full(n + 3, 32, np.uint32)
    b[:n] = raw
    three = b[:n] << np.uint32(16)
    three |= b[1 : n + 1] << np.uint32(8)
    three |= b[2 : n + 2]
    four = three << np.uint32(8)
    four |= b[3 : n + 3]
    # The hash of a word sums products of its bytes with odd numbers by place.
    place = np.arange(n, dtype=np.uint32)
    place -= np.repeat(np.concatenate(([0], starts)).astype(np.uint32), np.diff(np.concatenate(([0], starts, [n]))))
    place *= MULTIPLIER
    place += np.uint32(0x66FD93)
    place ^= place >> np.uint32(13)
    place *= b[:n] + np.uint32(7)
    sums = np.concatenate((np.zeros(1, np.uint32), np.cumsum(place, dtype=np.uint32)))
    return Features(
        [_bucket(three, 2), _bucket(four, 3)],
        [_bucket(sums[ends] - sums[starts], 4), _bucket(three[starts], 5), _bucket(three[np.maximum(ends - 3, 0)], 6)],
        starts,
        ends,
    )


def word_scores(f: Features, weights: np.ndarray) -> np.ndarray:
    """For each word the sum of its features' weights, by language."""
    result = np.zeros((len(f.starts), weights.shape[1]), np.float32)
    if len(f.starts) == 0:
        return result
    # From the blank before the word to its last letter.
    bounds = np.stack((f.starts - 1, f.ends - 1), 1).ravel()
    for language in range(weights.shape[1]):
        own = np.ascontiguousarray(weights[:, language])
        total = own.take(f.grams[0])
        for grams in f.grams[1:]:
            total += own.take(grams)
        sums = np.add.reduceat(total, bounds)[::2]
        for each in f.words:
            sums += own.take(each)
        result[:, language] = sums
    return result


def flat_features(f: Features) -> tuple[np.ndarray, np.ndarray]:
    """All (word, bucket) pairs."""
    lengths = f.ends - f.starts
    word = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(f.starts - 1, lengths)
    each = np.arange(len(lengths))
    return (
        np.concatenate([word] * len(f.grams) + [each] * len(f.words)),
        np.concatenate([g[at] for g in f.grams] + f.words),
    )


def posteriors(
    scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, pairs: np.ndarray | None = None
) -> np.ndarray:
    """Word probabilities by forward-backward for chains that follow each other in ``scores``.

    All chains go forward together, the longest first: the words of one step lie side by side, and a
    step works on the chains that still have a word. Messages are normalised at each word. If given,
    ``pairs`` gets the probabilities of all pairs of neighbours added.
    """
    if not len(scores):
        return scores
    by_length = np.argsort(-lengths, kind="stable")
    rank = np.empty(len(lengths), np.int64)
    rank[by_length] = np.arange(len(lengths))
    steps = int(lengths.max())
    alive = np.searchsorted(-lengths[by_length], -np.arange(steps), side="left")
    offsets = np.concatenate(([0], np.cumsum(alive)))
    step_of_word = np.arange(len(scores)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = offsets[step_of_word] + np.repeat(rank, lengths)
    local = np.empty_like(scores)
    local[place] = np.exp(scores - scores.max(axis=1, keepdims=True))
    moves = np.exp(transitions - transitions.max()).astype(scores.dtype)
    back_moves = np.ascontiguousarray(moves.T)
    ones = np.ones((scores.shape[1], 1), scores.dtype)
    result = local.copy()
    bounds = offsets.tolist()
    message = None
    for start, end in zip(bounds, bounds[1:]):
        value = result[start:end]
        if message is not None:
            value *= message[: end - start] @ moves
        value /= value @ ones
        message = value
    back = np.ones((int(alive[0]), scores.shape[1]), scores.dtype)
    for step in range(steps - 1, -1, -1):
        start, end = bounds[step], bounds[step + 1]
        held = back[: end - start]
        value = result[start:end]
        value *= held
        value /= value @ ones
        held *= local[start:end]
        if pairs is not None and step:
            left = result[bounds[step - 1] : bounds[step - 1] + end - start]
            joint = left[:, :, None] * moves * held[:, None, :]
            pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        message = held @ back_moves
        np.divide(message, message @ ones, out=held)
    return result[place]


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray
    transitions: np.ndarray

    def label(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word probabilities of all texts, one after the other, and their numbers of words."""
        parts = [word_bytes(t) for t in texts]
        lengths = np.array([p.count(b" ") - 1 if p else 0 for p in parts], np.int64)
        buffer = b"".join(parts)
        if not buffer:
            return np.zeros((0, len(self.languages)), np.float32), lengths
        scores = word_scores(features(buffer), self.weights)
        return posteriors(scores, lengths, self.transitions), lengths

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        chances, lengths = self.label(texts)
        ends = np.cumsum(lengths)
        sums = np.zeros((len(texts), len(self.languages)))
        filled = np.flatnonzero(lengths)
        if len(filled):
            sums[filled] = np.add.reduceat(chances.astype(np.float64), (ends - lengths)[filled], axis=0)
        labels, scores = [], []
        for text, total, n in zip(texts, sums, lengths):
            if n and (has_letter(text)):
                best = int(total.argmax())
                labels.append(self.languages[best])
                scores.append(float(min(1.0, total[best] / n)))
            else:
                labels.append(UNKNOWN)
                scores.append(0.0)
        return labels, scores


def fit(
    samples: list[tuple[str, list[bytes]]], epochs: int = 6, batch: int = 64, rate: float = 0.3, seed: int = 7
) -> Model:
    """From (language, words of a piece). Pieces are shuffled and joined in threes to a chain.

    Steps follow the likelihood's gradient (observed less expected features and moves), scaled by each
    weight's past gradients.
    """
    languages = tuple(sorted({language for language, _ in samples}))
    samples = [(language, words) for language, words in samples if words]
    if not samples:
        return Model((), np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0), np.float32))
    k = len(languages)
    weights, transitions = np.zeros((BUCKETS, k), np.float32), np.zeros((k, k), np.float32)
    seen, moved = np.full((BUCKETS, k), 1e-3, np.float32), np.full((k, k), 1e-3, np.float32)
    number = {language: i for i, language in enumerate(languages)}
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        order = random.permutation(len(samples))
        chains = [order[i : i + 3] for i in range(0, len(order), 3)]
        for start in range(0, len(chains), batch):
            chosen = [[samples[i] for i in chain] for chain in chains[start : start + batch]]
            gold = np.concatenate([np.full(len(w), number[a]) for chain in chosen for a, w in chain])
            lengths = np.array([sum(len(w) for _, w in chain) for chain in chosen])
            f = features(b" " + b" ".join(x for chain in chosen for _, w in chain for x in w) + b" ")
            expected = np.zeros((k, k))
            chances = posteriors(word_scores(f, weights), lengths, transitions, expected)
            wrong = -chances
            wrong[np.arange(len(gold)), gold] += 1
            word, bucket = flat_features(f)
            used, where = np.unique(bucket, return_inverse=True)
            step = np.stack([np.bincount(where, wrong[word, j], len(used)) for j in range(k)], 1).astype(np.float32)
            step -= 1e-3 * weights[used]
            seen[used] += step**2
            weights[used] += rate * step / np.sqrt(seen[used])
            real = np.zeros((k, k))
            inside = np.ones(len(gold), bool)
            inside[np.cumsum(lengths) - lengths] = False
            after = np.flatnonzero(inside)
            np.add.at(real, (gold[after - 1], gold[after]), 1)
            move = (real - expected).astype(np.float32)
            moved += move**2
            transitions += rate * move / np.sqrt(moved)
    return Model(languages, weights, transitions)


def pieces(text: Column) -> Column:
    """Up to ``PIECES`` pieces of the text's words, spread over it."""
    words = F.split(text, "\\s+")
    n = F.size(words)
    gap = F.greatest(F.lit(1), F.floor((n - PIECE) / F.lit(max(1, PIECES - 1))).cast("int"))
    starts = F.filter(F.array(*[gap * i for i in range(PIECES)]), lambda s: (s == 0) | (s + PIECE <= n))
    return F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, PIECE), " "))


def samples(rows: DataFrame, most: int = SAMPLE_ROWS) -> list[tuple[str, list[bytes]]]:
    """From ``id``, ``text`` and ``lang``: about ``most`` rows of each language, all if it has fewer.

    Rows are chosen by a hash of id and text. Rows equal in both are chosen together, so of all pieces
    of the chosen rows the first by that hash are taken, twice as many as are expected at most.
    """
    known = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    shares = F.create_map(*[x for a, n in sorted(counts.items()) for x in (F.lit(a), F.lit(-(-most * (1 << 30) // n)))])
    hashed = F.pmod(F.xxhash64(F.lit(11), "id", "text"), F.lit(1 << 30))
    chosen = known.select("text", "lang", hashed.alias("hashed")).where(F.col("hashed") < shares[F.col("lang")])
    chosen = chosen.select("hashed", "lang", F.explode(pieces(F.col("text"))).alias("piece"))
    chosen = chosen.orderBy("hashed", "lang", "piece").limit(2 * most * PIECES * len(counts))
    found = sorted((r["lang"], r["piece"]) for r in chosen.collect())
    return [(language, word_bytes(piece.encode()).split()) for language, piece in found]


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """``id``, ``lang_pred`` and ``score`` of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        labels, scores = shared.value.predict(raw_texts(batch.column("text")))
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"]
        )

    rows = docs.select(F.col(id_col).alias("id"), F.col("text").alias("text"))
    return map_texts(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double", size=SLICE)


def words(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """``id`` and ``labels``: the most likely language of each word of the text, in order."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        field = shared.value
        texts = raw_texts(batch.column("text"))
        if not field.languages:
            labels = [[] for _ in texts]
        else:
            chances, lengths = field.label(texts)
            names = np.array(field.languages, object)[chances.argmax(axis=1)] if len(chances) else np.zeros(0, object)
            labels = [part.tolist() for part in np.split(names, np.cumsum(lengths)[:-1])] if texts else []
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(labels, pa.list_(pa.string()))], ["id", "labels"])

    rows = docs.select(F.col(id_col).alias("id"), F.col("text").alias("text"))
    return map_texts(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, labels array<string>", size=SLICE)


def held_out(key: Column) -> Column:
    """Whether a row is kept from learning: CRC-32 of its id as text, modulo 4, is 2; never for null."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def report(docs: DataFrame) -> DataFrame:
    """One row per document, predicted by a field learned from the rows that are not held out."""
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("text"), F.col("lang").alias("lang"))
    model = fit(samples(rows.where(~held_out(F.col("id")))))
    return predict(rows, model, "id").select(
        F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score"
    )
