"""Licence detection by ordered signature rules.

A rule is a regex over the normalised words of a text (A-Z in lower case, one blank between words), a
label, a priority and a confidence. Rules are gated by keywords: a rule is tried only if one of its
keywords is among the text's words, and a text with no keyword at all is not searched. Every text that a
rule's pattern matches has one of its keywords: each alternative of the pattern holds one as a whole word. A
detection is suppressed if its interval lies in that of a rule that comes earlier. The order is: identifier tags, full phrases with a version, licence texts, links, names.

The base phrases are counted apart, at all places; their labels always stay. Null and empty texts have
no words, no labels and score 0. Repeated rows are searched each; other columns do not matter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from footfall.llm.common import FOLD, map_texts, raw_texts

# Base phrases and their labels.
BASE = {b"mit license": "mit", b"apache license": "apache", b"general public license": "gpl"}


@dataclass(frozen=True)
class Rule:
    label: str
    kind: str
    pattern: str
    keyword: bytes
    confidence: float
    spare: tuple[bytes, ...] = ()  # further keywords, for spellings without the first


# Label: keywords, name, versions (as words), identifier (as words).
FAMILIES: dict[str, tuple[str, str, str, str]] = {
    "mit": ("mit", "mit", "", "mit"),
    "mit-0": ("mit", "mit (?:no attribution|0)", "", "mit 0"),
    "apache": ("apache", "apache(?: software)?", "1 0|1 1|2 0|2", "apache (?:1 0|1 1|2 0)"),
    "agpl": ("affero", "(?:gnu )?affero general public", "1|3|3 0", "agpl (?:1 0|3 0)"),
    "lgpl": ("lesser", "(?:gnu )?lesser general public", "2 1|3|3 0", "lgpl (?:2 0|2 1|3 0)"),
    "lgpl-library": ("library", "gnu library general public", "2|2 0", "lgpl 2 0"),
    "gpl": ("general", "(?:gnu )?general public", "1|2|2 0|3|3 0", "gpl (?:1 0|2 0|3 0)"),
    "gfdl": ("documentation", "(?:gnu )?free documentation", "1 1|1 2|1 3", "gfdl 1 [123]"),
    "bsd": ("bsd", "(?:new |modified |simplified |original )?(?:[234] clause )?bsd(?: [234] clause)?", "", "bsd [1234] clause"),
    "0bsd": ("0bsd zero", "0bsd|zero clause bsd", "", "0bsd"),
    "isc": ("isc", "isc", "", "isc"),
    "zlib": ("zlib", "zlib(?: libpng)?", "", "zlib"),
    "libpng": ("libpng", "libpng", "2|2 0", "libpng(?: 2 0)?"),
    "mpl": ("mozilla", "mozilla public", "1 0|1 1|2 0", "mpl (?:1 0|1 1|2 0)"),
    "epl": ("eclipse", "eclipse public", "1 0|2 0", "epl [12] 0"),
    "cpl": ("common", "common public", "1 0", "cpl 1 0"),
    "cddl": ("distribution", "common development and distribution", "1 0|1 1", "cddl 1 [01]"),
    "eupl": ("european", "european union public", "1 0|1 1|1 2", "eupl 1 [012]"),
    "artistic": ("artistic", "(?:clarified )?artistic", "1 0|2 0", "artistic [12] 0"),
    "boost": ("boost", "boost software", "1 0", "bsl 1 0"),
    "busl": ("business", "business source", "1 1", "busl 1 1"),
    "unlicense": ("unlicense", "unlicense", "", "unlicense"),
    "wtfpl": ("wtfpl", "wtfpl", "2", "wtfpl"),
    "beerware": ("beerware", "beerware", "42", "beerware"),
    "postgresql": ("postgresql", "postgresql", "", "postgresql"),
    "python": ("python", "python(?: software foundation)?", "2|2 0", "(?:psf|python) 2 0"),
    "php": ("php", "php", "3 0|3 01", "php 3 01?"),
    "ruby": ("ruby", "ruby", "", "ruby"),
    "perl": ("perl", "perl", "5", "perl 5"),
    "openssl": ("openssl", "openssl", "", "openssl"),
    "ncsa": ("ncsa", "(?:university of illinois )?ncsa(?: open source)?", "", "ncsa"),
    "ofl": ("font", "(?:sil )?open font", "1 0|1 1", "ofl 1 [01]"),
    "ms-pl": ("microsoft", "microsoft public", "", "ms pl"),
    "ms-rl": ("reciprocal", "microsoft reciprocal", "", "ms rl"),
    "ecl": ("educational", "educational community", "1 0|2 0", "ecl [12] 0"),
    "osl": ("open", "open software", "1 0|2 0|2 1|3 0", "osl [123] [01]"),
    "afl": ("academic", "academic free", "2 0|2 1|3 0", "afl [123] [012]"),
    "upl": ("universal", "universal permissive", "1 0", "upl 1 0"),
    "vim": ("vim", "vim", "", "vim"),
    "tcl": ("tcl", "tcl(?: tk)?", "", "tcl"),
    "x11": ("x11", "x11", "", "x11"),
    "curl": ("curl", "curl", "", "curl"),
    "icu": ("icu", "icu|unicode icu", "", "icu"),
    "unicode": ("unicode", "unicode", "3|v3", "unicode (?:dfs 2016|3 0)"),
    "w3c": ("w3c", "w3c(?: software(?: notice)?)?", "", "w3c"),
    "qpl": ("q", "q public", "1 0", "qpl 1 0"),
    "sleepycat": ("sleepycat", "sleepycat", "", "sleepycat"),
    "watcom": ("watcom", "sybase open watcom public", "1 0", "watcom 1 0"),
    "apsl": ("apple", "apple public source", "1 0|1 1|2 0", "apsl [12] [012]"),
    "ipl": ("ibm", "ibm public", "1 0", "ipl 1 0"),
    "npl": ("netscape", "netscape public", "1 0|1 1", "npl 1 [01]"),
    "rpl": ("reciprocal", "reciprocal public", "1 1|1 5", "rpl 1 [15]"),
    "sspl": ("server", "server side public", "1|1 0", "sspl 1 0"),
    "elastic": ("elastic", "elastic", "2|2 0", "elastic 2 0"),
    "cecill": ("cecill", "cecill", "1 0|2 0|2 1", "cecill (?:[12] [01]|b|c)"),
    "mulan": ("mulan", "mulan (?:psl|permissive software)", "1|2", "mulanpsl [12] 0"),
    "odbl": ("database", "open(?: data commons open)? database", "1 0", "odbl 1 0"),
    "odc-by": ("attribution", "open data commons attribution", "1 0", "odc by 1 0"),
    "pddl": ("domain", "public domain dedication and", "1 0", "pddl 1 0"),
    "openrail": ("openrail", "(?:creativeml |bigscience )?openrail(?: m)?", "", "openrail"),
    "llama": ("llama", "llama [234](?: [0-9])? community", "", "llama[234]"),
    "jpeg": ("jpeg", "independent jpeg group", "", "ijg"),
    "hpnd": ("historical", "historical permission notice and disclaimer", "", "hpnd"),
    "naist": ("naist", "naist", "", "naist 2003"),
    "ogl": ("open", "open government", "1 0|2 0|3 0", "ogl (?:uk )?[123] 0"),
    "gsoap": ("gsoap", "gsoap public", "1 3b", "gsoap 1 3b"),
    "lppl": ("latex", "latex project public", "1 0|1 3c|1 3", "lppl 1 [03]c?"),
    "nosl": ("netizen", "netizen open source", "1 0", "nosl"),
    "zpl": ("zope", "zope public", "1 1|2 0|2 1", "zpl [12] [01]"),
    "apl": ("adaptive", "adaptive public", "1 0", "apl 1 0"),
}

# Parts of Creative Commons names: words in a licence's name, words in its short form.
COMMONS = {
    "by": ("attribution", "by"),
    "by-sa": ("attribution share ?alike", "by sa"),
    "by-nd": ("attribution no ?deriv(?:ative|ativework)s?", "by nd"),
    "by-nc": ("attribution non ?commercial", "by nc"),
    "by-nc-sa": ("attribution non ?commercial share ?alike", "by nc sa"),
    "by-nc-nd": ("attribution non ?commercial no ?deriv(?:ative|ativework)s?", "by nc nd"),
}

# Sentences of licence texts and notices that name no licence.
TEXTS = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", b"hereby", 0.9),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", b"permission", 0.9),
    ("bsd", "redistribution and use in source and binary forms with or without modification", b"redistribution", 0.9),
    ("bsd", "neither the name of .{1,80} nor the names of its contributors may be used", b"neither", 0.85),
    ("zlib", "this software is provided as is without any express or implied warranty in no event", b"warranty", 0.7),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under", b"applicable", 0.85),
    ("gpl", "this program is free software you can redistribute it and or modify it", b"redistribute", 0.85),
    ("gpl", "gnu gpl(?: ?v ?[123])?(?: or later)?", b"gnu", 0.9),
    ("lgpl", "gnu lgpl(?: ?v ?[23])?(?: or later)?", b"gnu", 0.9),
    ("agpl", "gnu agpl(?: ?v ?3)?(?: or later)?", b"gnu", 0.9),
    ("unlicense", "this is free and unencumbered software released into the public domain", b"unencumbered", 0.95),
    ("wtfpl", "do what the fuck you want to public license", b"fuck", 0.95),
    ("cc0", "(?:cc0|cc zero)(?: 1 0)?(?: universal)?", b"cc0 zero", 0.9),
    ("public-domain", "(?:released|dedicated|placed|is) (?:in|into|to) the public domain", b"domain", 0.8),
    ("proprietary", "all rights reserved", b"reserved", 0.5),
    ("proprietary", "may not be (?:copied|reproduced|redistributed|distributed) without", b"without", 0.5),
    ("proprietary", "proprietary and confidential", b"proprietary", 0.7),
    ("boost", "boost software license version 1 0 august 17th 2003", b"boost", 0.95),
    ("openssl", "this product includes software developed by the openssl project", b"openssl", 0.85),
    ("bsd", "regents of the university of california", b"regents", 0.6),
)

LINKS = (
    ("mit", "opensource org licenses mit", b"opensource"),
    ("bsd", "opensource org licenses bsd [234] clause", b"opensource"),
    ("apache", "apache org licenses license 2 0", b"apache"),
    ("gpl", "gnu org licenses gpl(?: [123] 0)?", b"gnu"),
    ("lgpl", "gnu org licenses lgpl(?: [23] [01])?", b"gnu"),
    ("agpl", "gnu org licenses agpl(?: 3 0)?", b"gnu"),
    ("gfdl", "gnu org licenses fdl(?: 1 [123])?", b"gnu"),
    ("mpl", "mozilla org mpl(?: 2 0)?", b"mozilla"),
    ("epl", "eclipse org legal epl v[12]0", b"eclipse"),
    ("boost", "boost org license 1 0", b"boost"),
    ("unlicense", "unlicense org", b"unlicense"),
    ("ofl", "scripts sil org ofl", b"ofl"),
    ("cc0", "creativecommons org publicdomain zero 1 0", b"creativecommons"),
)


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, in order of priority."""
    tags, versions, texts, links, names = [], [], [], [], []
    for label, (keyword, name, numbers, identifier) in FAMILIES.items():
        key, *spare = keyword.encode().split()
        tags.append(Rule(label, "tag", f"spdx license identifier (?:{identifier})(?: only| or later)?", b"spdx", 1.0))
        tags.append(Rule(label, "tag", f"license (?:is )?(?:{identifier})(?: only| or later)?", b"license", 0.8))
        stem = f"(?:the )?(?:{name}) licen[cs]e"
        given = f"(?:licensed|released|distributed|available|provided|published|made available) (?:under|with) (?:the )?(?:terms of )?{stem}"
        if numbers:
            versions.append(Rule(label, "version", f"{given}(?: as published by the free software foundation)? (?:version |v ?)?(?:{numbers})", key, 1.0, tuple(spare)))
            versions.append(Rule(label, "version", f"{stem} (?:version |v ?)?(?:{numbers})", key, 0.95, tuple(spare)))
        versions.append(Rule(label, "given", given, key, 0.95, tuple(spare)))
        names.append(Rule(label, "name", stem, key, 0.8, tuple(spare)))
    for label, (words, short) in COMMONS.items():
        full, number = f"creative commons {words}", "(?:1 0|2 0|2 5|3 0|4 0)"
        tags.append(Rule(f"cc-{label}", "tag", f"spdx license identifier cc {short} {number}", b"spdx", 1.0))
        versions.append(Rule(f"cc-{label}", "version", f"{full} {number}(?: international| unported)?", b"creative", 1.0))
        versions.append(Rule(f"cc-{label}", "version", f"cc {short} {number}", b"cc", 0.95))
        links.append(Rule(f"cc-{label}", "link", f"creativecommons org licenses {short} {number}", b"creativecommons", 0.95))
        names.append(Rule(f"cc-{label}", "name", f"{full}(?: licen[cs]e)?", b"creative", 0.8))
        names.append(Rule(f"cc-{label}", "name", f"cc {short}", b"cc", 0.7))
    # Longer forms of the commons come first, as the shorter ones are their prefixes.
    longer = lambda rule: -len(rule.pattern) if rule.label.startswith("cc-") else 0
    texts = [
        Rule(label, "text", pattern, key, sure, tuple(spare))
        for label, pattern, keys, sure in TEXTS
        for key, *spare in [keys.split()]
    ]
    links += [Rule(label, "link", pattern, key, 0.9) for label, pattern, key in LINKS]
    return tuple(tags + sorted(versions, key=longer) + texts + sorted(links, key=longer) + sorted(names, key=longer))


@lru_cache(maxsize=1)
def gated() -> dict[bytes, list[tuple[int, Rule, re.Pattern]]]:
    """Rules by keyword, with their place in the order; each matches whole words."""
    by_keyword: dict[bytes, list[tuple[int, Rule, re.Pattern]]] = {}
    for place, rule in enumerate(rules()):
        pattern = re.compile(rb" (?:" + rule.pattern.encode() + rb")(?= )")
        for keyword in (rule.keyword, *rule.spare):
            by_keyword.setdefault(keyword, []).append((place, rule, pattern))
    return by_keyword


def detections(text: bytes, keywords: set[bytes]) -> list[tuple[int, int, Rule]]:
    """What stays of the detections in normalised text, as (start, end, rule) by start."""
    found = []
    tried = {entry[0]: entry for keyword in keywords for entry in gated()[keyword]}
    for place, rule, pattern in tried.values():
        found += [(m.start(), -m.end(), place, rule) for m in pattern.finditer(text)]
    # What contains an interval comes before it here, and still reaches beyond its start.
    kept: list[tuple[int, int, Rule]] = []
    reaching: list[tuple[int, int]] = []
    for start, back, place, rule in sorted(found, key=lambda f: f[:3]):
        reaching = [(end, order) for end, order in reaching if end > start]
        if not any(end >= -back and order < place for end, order in reaching):
            kept.append((start, -back, rule))
        reaching.append((-back, place))
    return kept


def base_places(text: bytes) -> list[tuple[int, str]]:
    """(word, label) of every place of a base phrase in normalised text."""
    places: list[tuple[int, str]] = []
    if b" license " not in text:
        return places
    for phrase, label in BASE.items():
        at = text.find(b" " + phrase + b" ")
        while at >= 0:
            places.append((at, label))
            at = text.find(b" " + phrase + b" ", at + 1)
    word_at = words_before(text, [at for at, _ in places])
    return sorted((word_at[at], label) for at, label in places)


def words_before(text: bytes, offsets: list[int]) -> dict[int, int]:
    """How many blanks come before each offset, in one pass."""
    counts, at, n = {}, 0, 0
    for offset in sorted(set(offsets)):
        n += text.count(b" ", at, offset)
        at = offset
        counts[offset] = n
    return counts


COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def scan_text(text: bytes) -> dict:
    words = text.translate(FOLD).split()
    result = dict(zip(COLUMNS, (len(words), 0, None, None, "", "", 0.0)), matches=[])
    gates = gated().keys()
    if gates.isdisjoint(words):
        return result
    normal = b" " + b" ".join(words) + b" "
    base = base_places(normal)
    kept = detections(normal, gates & set(words))
    base_labels = {label for _, label in base}
    word_at = words_before(normal, [x for s, e, _ in kept for x in (s, e)])
    result["matches"] = [
        {"start": word_at[s], "end": word_at[e], "label": r.label, "rule": r.kind} for s, e, r in kept
    ]
    result["labels"] = ",".join(sorted(base_labels | {r.label for _, _, r in kept}))
    result["score"] = max([r.confidence for _, _, r in kept] + [0.9] * bool(base), default=0.0)
    if base:
        result |= {"n_base": len(base), "first_word": base[0][0], "last_word": base[-1][0]}
        result["base_labels"] = ",".join(sorted(base_labels))
    return result


MATCHES = "matches array<struct<start:bigint,end:bigint,label:string,rule:string>>"
SCHEMA = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
    f"score double, {MATCHES}"
)
ARROW = pa.schema(
    [(c, pa.int64()) for c in COLUMNS[:4]]
    + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
    + [("matches", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("rule", pa.string())])))]
)


def scan(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id``, the report columns and ``matches``: kept detections as word spans (end exclusive)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.RecordBatch.from_pylist([scan_text(t) for t in raw_texts(batch.column("text"))], schema=ARROW)
        return pa.RecordBatch.from_arrays([batch.column("id"), *found.columns], ["id", *ARROW.names])

    rows = docs.select(F.col(id_col).alias("id"), F.col("text").alias("text"))
    return map_texts(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, {SCHEMA}")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: words, base places, labels and the surest detection's confidence."""
    return scan(docs).select(F.col("id").alias("doc_id"), *COLUMNS)
