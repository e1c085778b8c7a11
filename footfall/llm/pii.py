"""Personal data by weak supervision.

Patterns, a gazetteer and context words propose candidate spans and vote on each: personal (1), not
personal (0) or no opinion (-1). Votes of all candidates of all texts are counted by pattern; as each
labeler has three answers and each feature a few buckets, the counts stay few however large the input.
On them expectation-maximisation estimates how often each labeler is right and how likely each
pattern is personal, and a logistic regression over kind, votes and span features is trained with
those likelihoods as soft labels. It decides on the candidates in a second pass over the texts.

Base spans are found exactly by their patterns and checks, in linear time on any text, and always
stay; other candidates are added if the classifier takes them and no span overlaps them. Null and
empty texts have no spans. Repeated rows are searched (and counted) each; other columns do not
matter. Without any candidate nothing is added.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from footfall.llm.common import SPANS_SQL, Taken, joined_spans, map_texts, span_array, spans_of

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "ssn", "iban", "birth", "person", "account")

# Gazetteers: frequent given names and forms of address, top-level domains, country codes.
NAMES = frozenset(
    """Mr Mrs Ms Dr Prof James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara
    Richard Susan Joseph Jessica Thomas Sarah Charles Karen Christopher Nancy Daniel Lisa Matthew Betty Anthony
    Margaret Mark Sandra Donald Ashley Steven Kimberly Paul Emily Andrew Donna Joshua Michelle Kenneth Carol Kevin
    Amanda Brian Melissa George Deborah Edward Stephanie Ronald Rebecca Timothy Laura Jason Sharon Jeffrey Cynthia
    Ryan Kathleen Jacob Amy Gary Angela Nicholas Shirley Eric Anna Jonathan Brenda Stephen Pamela Larry Emma Justin
    Nicole Scott Helen Brandon Samantha Benjamin Katherine Samuel Christine Hans Peter Klaus Ursula Monika Petra
    Pierre Jean Marie Jacques Sophie Camille Carlos Juan Maria Jose Luis Carmen Lucia Javier Miguel Giovanni
    Francesca Marco Giulia Fatima Mohammed Ahmed Wei Yuki Olga Ivan Dmitri Priya Raj""".split()
)
DOMAINS = frozenset("com org net edu gov mil int info biz io co uk de fr es it nl ch at be se no dk fi pl pt eu us ca".split())
COUNTRIES = frozenset("AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM".split())
DIALLING = ("1", "2", "3", "4", "5", "6", "7", "8", "9")
FOR_CONTEXT = frozenset(
    "call phone tel telephone mobile fax contact email mail e-mail address write born birth dob ssn social iban account "
    "card credit visa name named mr mrs dr ip host user customer patient client".split()
)
AGAINST_CONTEXT = frozenset(
    "version isbn order invoice page figure fig table chapter section build sku part no number example rfc".split()
)

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")
BIRTH = re.compile(r"(?i:born|birth|dob)[^0-9\n]{1,20}([0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4})(?![0-9])")
HIDDEN = re.compile(
    r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{1,64})\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:[\[(]dot[\])]|\.)\x20?[A-Za-z0-9-]{1,63}){1,4}"
)
PERSON = re.compile(r"(?<!\w)(?:" + "|".join(sorted(NAMES)) + r")\.?\x20[A-Z][a-z]+(?:\x20[A-Z][a-z]+)?(?!\w)")
WORD = re.compile(r"\w+")
WORD_BEFORE = re.compile(r"[A-Za-z-]+")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    doubled = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(doubled[int(d)] if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def find_emails(text: str) -> list[tuple[int, int]]:
    """Every match ends at an @, so each @ is looked at once, with the run of local characters before it."""
    spans, at, free = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and (text[start - 1] in LOCAL):
            start -= 1
        match = DOMAIN.match(text, at) if start < at else None
        if match:
            spans.append((start, match.end()))
            free = match.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return spans


LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def find_ips(text: str) -> list[tuple[int, int]]:
    """A match starts with the first digit of a run, as a shorter start would fail or match alike."""
    small = lambda part: len(part := part.lstrip("0")) <= 3 and int(part or 0) <= 255
    return [m.span() for m in IP.finditer(text) if all(map(small, m[0].split(".")))]


def plain_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def number_runs(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span(), plain_digits(m[0])) for m in CARD.finditer(text) if m.end() - m.start() >= 13]


def find_phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 9 <= len(plain_digits(m[0])) <= 15]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind, then start."""
    spans = [("email", *s) for s in find_emails(text)] if "@" in text else []
    if DIGIT.search(text):
        spans += [("ip", *s) for s in find_ips(text)]
        spans += [("card", s, e) for s, e, d in number_runs(text) if 13 <= len(d) <= 19 and luhn(d)]
        spans += [("phone", *s) for s in find_phones(text)] if "+" in text else []
    return spans


def words_before(text: str, start: int) -> list[str]:
    return [w.lower() for w in WORD_BEFORE.findall(text[max(0, start - 40) : start])[-4:]]


def more_candidates(text: str) -> list[tuple[str, int, int]]:
    """What patterns and gazetteer propose beside the base spans."""
    found = []
    if DIGIT.search(text):
        found += [("ssn", *m.span()) for m in SSN.finditer(text)]
        found += [("iban", *m.span()) for m in IBAN.finditer(text)]
        found += [("phone", *m.span()) for m in LOCAL_PHONE.finditer(text)]
        found += [("birth", *m.span(1)) for m in BIRTH.finditer(text)]
        for start, end, digits in number_runs(text):
            # A number that is no card is proposed only where a context word speaks for it.
            if 13 <= len(digits) <= 19 and not luhn(digits) and not FOR_CONTEXT.isdisjoint(words_before(text, start)):
                found.append(("account", start, end))
    if "at]" in text or "at)" in text:
        found += [("email", *m.span()) for m in HIDDEN.finditer(text)]
    # A name in PERSON is a whole run of \w, as nothing but a point or a blank follows it.
    if not NAMES.isdisjoint(WORD.findall(text)):
        found += [("person", *m.span()) for m in PERSON.finditer(text)]
    return found


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Base spans, and the other candidates that no base span overlaps."""
    base = base_spans(text)
    taken = Taken((s, e) for _, s, e in base)
    return base + [c for c in more_candidates(text) if not taken.meets(c[1], c[2])]


def well_formed(kind: str, value: str) -> int:
    """The labeler on form: checksums and ranges."""
    digits = plain_digits(value)
    if kind == "card" or kind == "account":
        return int(luhn(digits))
    if kind == "ssn":
        return int(digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000")
    if kind == "iban":
        plain = value.replace(" ", "")
        number = "".join(str(int(c, 36)) for c in plain[4:] + plain[:4])
        return int(int(number) % 97 == 1)
    if kind == "birth":
        parts = [int(p) for p in re.split("[./-]", value)]
        years = [p for p in parts if p > 31]
        return int(len(years) == 1 and 1900 <= years[0] <= 2100 and all(p >= 1 for p in parts))
    if kind == "phone":
        return int(9 <= len(digits) <= 15)
    return 1


def in_gazetteer(kind: str, value: str) -> int:
    """The labeler on lists; it has no opinion on kinds without one."""
    if kind == "email":
        return int(re.split(r"[^A-Za-z]+", value)[-1].lower() in DOMAINS)
    if kind == "iban":
        return int(value[:2] in COUNTRIES)
    if kind == "person":
        return int(re.split(r"[.\x20]", value)[0] in NAMES)
    if kind == "phone" and value.startswith("+"):
        return int(value[1] in DIALLING)
    return -1


def votes_and_features(text: str, kind: str, start: int, end: int) -> tuple:
    """The pattern of a candidate: kind, votes, then bucketed features."""
    value = text[start:end]
    before = words_before(text, start)
    near = [text[start - 1] if start else " ", text[end] if end < len(text) else " "]
    digits = plain_digits(value)
    varied = len(set(digits)) if digits else len(set(value.lower()))
    votes = (
        well_formed(kind, value),
        in_gazetteer(kind, value),
        1 if not FOR_CONTEXT.isdisjoint(before) else -1,
        0 if not AGAINST_CONTEXT.isdisjoint(before) else -1,
        1 if varied >= 4 else 0,
        0 if any(c.isalnum() or c in "@/_" for c in near) else 1,
    )
    features = (min(4, (end - start) // 8), min(2, 3 * len(digits) // (end - start)))
    return (kind, *votes, *features)


N_VOTES = 6


@dataclass(frozen=True)
class Model:
    """Reliabilities as (personal, not) rates of a yes by labeler, and the classifier's weights."""

    rates: tuple[tuple[float, float], ...]
    weights: dict[tuple[int, object], float]

    def likelihood(self, pattern: tuple) -> float:
        return logistic(sum(self.weights.get(f, 0.0) for f in one_hot(pattern)))


def logistic(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def one_hot(pattern: tuple) -> list[tuple[int, object]]:
    return [(-1, "bias"), *enumerate(pattern)]


def fit(counts: dict[tuple, int], rounds: int = 50, prior: float = 4.0) -> Model:
    """EM on the counts of patterns, then the classifier on its likelihoods.

    Every labeler starts as right four times in five, and keeps ``prior`` candidates' worth of that
    belief, so that one that never speaks, or speaks alone, stays defined.
    """
    patterns = sorted(counts, key=str)
    if not patterns:
        return Model((), {})
    n = np.array([counts[p] for p in patterns], float)
    votes = np.array([p[1 : 1 + N_VOTES] for p in patterns])
    yes, no = votes == 1, votes == 0
    rates = np.tile([[0.8], [0.2]], N_VOTES)
    share = 0.5
    likely = np.full(len(patterns), 0.5)
    for _ in range(rounds):
        logs = yes @ np.log(rates).T + no @ np.log(1 - rates).T + np.log([share, 1 - share])
        likely = 1 / (1 + np.exp(np.clip(logs[:, 1] - logs[:, 0], -50, 50)))
        for row, weight in enumerate((n * likely, n * (1 - likely))):
            said = weight @ yes + prior * (0.8, 0.2)[row]
            rates[row] = said / (weight @ (yes | no) + prior)
        rates = np.clip(rates, 0.01, 0.99)
        share = float(np.clip(((n * likely).sum() + prior / 2) / (n.sum() + prior), 0.01, 0.99))
    names = {f: i for i, f in enumerate(sorted({f for p in patterns for f in one_hot(p)}, key=str))}
    x = np.zeros((len(patterns), len(names)))
    for i, p in enumerate(patterns):
        x[i, [names[f] for f in one_hot(p)]] = 1
    w, mass = np.zeros(len(names)), n / n.sum()
    for _ in range(200):  # Newton steps, halved while they do not help
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (mass * (p - likely)) + 1e-4 * w
        if np.abs(gradient).max() < 1e-9:
            break
        hessian = (x.T * (mass * p * (1 - p))) @ x + 1e-4 * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    return Model(tuple(zip(rates[0].tolist(), rates[1].tolist())), {f: float(w[i]) for f, i in names.items()})


def patterns(docs: DataFrame) -> dict[tuple, int]:
    """How often each pattern of votes and features stands in all texts."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: Counter[str] = Counter()
        for text in batch.column("text").to_pylist():
            for span in candidates(text) if text else ():
                found["\t".join(map(str, votes_and_features(text, *span)))] += 1
        return pa.RecordBatch.from_pydict(
            {"pattern": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())}
        )

    rows = map_texts(docs.select(F.col("text").alias("text")), run, "pattern string, n bigint")
    totals = rows.groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    return {(p[0], *map(int, p[1:])): r["n"] for r in totals for p in [r["pattern"].split("\t")]}


def all_spans(text: str, model: Model) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans: both by kind as listed, then start."""
    base = base_spans(text)
    found = list(base)
    # Candidates of one kind do not meet each other, so the spans of the kinds before are all that can be in their way.
    for _, group in groupby(more_candidates(text), key=lambda s: s[0]):
        taken = Taken((s, e) for _, s, e in found)
        found += [
            span for span in group if not taken.meets(*span[1:]) and model.likelihood(votes_and_features(text, *span)) >= 0.5
        ]
    return base, sorted(found, key=lambda s: (KINDS.index(s[0]), s[1]))


def find(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id") -> DataFrame:
    """``id``, ``base`` and ``spans``: arrays of (kind, start, end), in code points, ends exclusive.

    Without a model one is fitted to the given documents.
    """
    model = model or fit(patterns(docs))

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
        *[spans_of("base", kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(joined_spans("base").cast("binary"), 256).alias("base_sha256"),
        joined_spans("spans").alias("spans"),
    )


def masked_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with ``[KIND]`` for each span; overlapping spans become one, named by the first."""
    parts, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(parts) + text[at:]


def masked(docs: DataFrame, model: Model | None = None, length: str | None = "n_chars") -> DataFrame:
    """The documents with all spans masked in ``text``, and the new length in the column so named, if there is one.

    Texts without spans stay as they are, with the length they came with.
    """
    model = model or fit(patterns(docs))
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col("text").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, changed = [], []
        for text in batch.column("text").to_pylist():
            spans = all_spans(text, model)[1] if text else []
            texts.append(masked_text(text, spans) if spans else text)
            changed.append(bool(spans))
        return pa.RecordBatch.from_pydict(
            {"row": batch.column("row"), "text": pa.array(texts, pa.string()), "changed": pa.array(changed, pa.bool_())}
        )

    def column(name: str) -> Column:
        if name == "text":
            return F.col("text")
        own = F.col(f"row.`{name}`")
        if name == length:
            own = F.when(F.col("changed"), F.length("text").cast(docs.schema[name].dataType)).otherwise(own)
        return own.alias(name)

    schema = f"row {rows.schema['row'].dataType.simpleString()}, text string, changed boolean"
    return map_texts(rows, run, schema).select(*[column(c) for c in docs.columns])
