"""The pipeline against a plain version of all its stages, and each stage on its own input."""

import hashlib
import re

import corpus_pipeline
import pytest
from footfall.llm import bpe, pii, quality, simhash
from footfall.llm.common import folded_words

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_long_spans(text, hit):
    """The text without its stretches of more than 13 hit words, each up to the next word's start."""
    starts = [m.start() for m in re.finditer(r"[A-Za-z0-9\u0080-\U0010ffff]+", text or "")] + [len(text or "")]
    parts, at, i = [], 0, 0
    while i < len(starts) - 1:
        end = i
        while end in hit:
            end += 1
        if end - i > 13:
            parts.append(text[at : starts[i]])
            at = starts[end]
        i = max(end, i + 1)
    return "".join(parts) + text[at:] if parts else text


def plain_version(documents, benchmark):
    """Stages as loops over lists of rows; models are fitted to the counts of the same rows."""
    rules = quality.Rules()
    kept = []
    for row in documents:
        words = (row["text"] or "").encode().split()
        counts = {}
        repeats = {}
        for size in (rules.window, rules.repeat, rules.max_repeat + 1):
            counts = {}
            for i in range(len(words) - size + 1):
                counts.setdefault(tuple(words[i : i + size]), []).append(i)
            repeats[size] = len({at + j for places in counts.values() if len(places) > 1 for at in places for j in range(size)})
        n = len(words)
        if n < 50 or 100 * repeats[3] > 50 * n or 100 * repeats[10] > rules.max_covered_percent * n or repeats[101]:
            continue
        kept.append(row)
    fps = {r["doc_id"]: simhash.fingerprint(simhash.shingle_hashes((r["text"] or "").encode(), 3)) for r in kept}
    root = {own: own for own in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if ((fps[a] ^ fps[b]) % (1 << 64)).bit_count() <= 2 and root[b] < root[a]:
                    root[a] = root[b]
                    changed = True
    kept = [r for r in kept if root[r["doc_id"]] == r["doc_id"]]
    windows = set()
    for item in benchmark:
        words = folded_words(item["text"].encode())
        size = min(13, len(words))
        windows |= {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
    clean = []
    for row in kept:
        words = folded_words((row["text"] or "").encode())
        hit = {at + j for w in windows for at in range(len(words) - len(w) + 1) if tuple(words[at : at + len(w)]) == w for j in range(len(w))}
        if not hit or 20 * len(hit) < len(words):
            clean.append(row | {"text": without_long_spans(row["text"], hit)})
    counts = {}
    for row in clean:
        for span in pii.candidates(row["text"]):
            pattern = pii.votes_and_features(row["text"], *span)
            counts[pattern] = counts.get(pattern, 0) + 1
    model = pii.fit(counts)
    coder = bpe.encoding(bpe.RANKS, bpe.PATTERN)
    result = []
    for row in clean:
        text = pii.masked_text(row["text"], pii.all_spans(row["text"], model)[1])
        ids = coder.encode_ordinary(text)
        sha = [hashlib.sha256(x).hexdigest() for x in (" ".join(map(str, ids)).encode(), text.encode())]
        result.append((row["doc_id"], len(ids), ids, *sha))
    return sorted(result)


def test_whole_pipeline(spark):
    read = lambda name: [r.asDict() for r in spark.read.parquet(f"{SMALL}/{name}.parquet").collect()]
    found = corpus_pipeline.run(spark, SMALL)
    assert found.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    want = plain_version(read("documents"), read("benchmark"))
    assert sorted(map(tuple, found.collect())) == want
    assert 0 < len(want) < spark.read.parquet(f"{SMALL}/documents.parquet").count()


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_rows(spark, documents, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    text = " ".join(f"word{i}" for i in range(120))
    docs = documents(text, text, None, "", (None, text), (None, None), "mail a@b.com " + text, "x " * 100_000)
    for rows in (docs, docs.limit(0)):
        result = stage(spark, rows, SMALL)
        assert result.columns == COLUMNS or name == "tokens"
        got = result.collect()
        assert len(got) <= 8
        if name in ("personal_data", "tokens"):
            assert len(got) == rows.count()


def test_decisions_take_effect(spark, documents):
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").first()["text"]
    prose = " ".join(f"word{i}" for i in range(120))
    docs = documents("too short", prose, prose.upper(), "more " + item, "see a@b.com for " + " ".join(f"other{i}" for i in range(90)))
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda frame: sorted(r.doc_id for r in frame.collect())
    assert ids(stages["quality_rules"](spark, docs, SMALL)) == [1, 2, 4]
    assert ids(stages["near_duplicates"](spark, docs, SMALL)) == [0, 1, 3, 4]
    assert ids(stages["decontamination"](spark, docs, SMALL)) == [0, 1, 2, 4]
    long = documents("start " + "filler " * 2000 + item + " end")
    (left,) = stages["decontamination"](spark, long, SMALL).collect()
    assert left.text == "start " + "filler " * 2000 + "end" and left.n_chars == len(left.text)
    texts = {r.doc_id: (r.text, r.n_chars) for r in stages["personal_data"](spark, docs, SMALL).collect()}
    assert texts[1] == (prose, len(prose)) and texts[4][0].startswith("see [EMAIL] for") and texts[4][1] == len(texts[4][0])
