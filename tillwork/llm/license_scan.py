"""Licence notices in whole texts, with errors.

A notice of ``L`` characters with at most ``k`` errors, cut into ``k + 1`` seeds,
must hold one seed unharmed. All seeds of all notices are looked for in one pass
(Aho-Corasick). A seed fixes where its notice would lie, give or take ``k``
characters; there the regex library's bounded-error matching verifies the edits.
With no errors allowed the only seed is the phrase itself, which is how the base
phrases are found: in all places, at whole words.

Texts are compared as words with one blank between them, A-Z lower-cased, marks
dropped. Spans are given in words and in code points of the text.

Defined cases: a null text is empty and has no words. Places of one phrase may
overlap. Of matches with errors of one notice, those that do not overlap are
reported, from the left.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tillwork.llm.text import alnum_words, documents_of, slices

# The base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Short notices looked for with errors: text, label, most errors.
NOTICES = (
    ("licensed under cc by", "cc-by", 2),
    ("creative commons attribution", "cc-by", 3),
    ("gnu general public license", "gpl", 3),
    ("all rights reserved", "reserved", 2),
    ("licensed under the apache license", "apache", 4),
    ("apache license version 2 0", "apache", 3),
    ("released under the mit license", "mit", 3),
    ("permission is hereby granted free of charge", "mit", 5),
    ("redistribution and use in source and binary forms", "bsd", 5),
    ("mozilla public license", "mpl", 2),
    ("dedicated to the public domain", "public-domain", 3),
    ("proprietary and confidential", "proprietary", 3),
)


@dataclass(frozen=True)
class Match:
    label: str
    exact: bool
    errors: int
    size: int
    first_word: int
    last_word: int


def _seeds(text: str, errors: int) -> list[tuple[str, int]]:
    """``errors + 1`` parts of nearly equal length and where each begins."""
    cuts = np.linspace(0, len(text), errors + 2).astype(int)
    return [(text[a:b], int(a)) for a, b in zip(cuts, cuts[1:], strict=False)]


@cache
def _scanner() -> tuple[ahocorasick.Automaton, list[regex.Pattern]]:
    """The seeds' automaton and a pattern for each notice."""
    owners: dict[str, list[tuple[int, int]]] = {}
    for number, phrase in enumerate(PHRASES):
        owners.setdefault(f" {phrase} ", []).append((-1 - number, 0))
    for number, (text, _, errors) in enumerate(NOTICES):
        for seed, place in _seeds(text, errors):
            owners.setdefault(seed, []).append((number, place))
    automaton = ahocorasick.Automaton()
    for seed, found in owners.items():
        automaton.add_word(seed, (len(seed), found))
    automaton.make_automaton()
    patterns = [
        regex.compile(f"(?e)(?<= )(?:{regex.escape(text)}){{e<={errors}}}(?= )") for text, _, errors in NOTICES]
    return automaton, patterns


def scan_words(words: list[bytes]) -> list[Match]:
    """All matches in the words of a text."""
    automaton, patterns = _scanner()
    line = f" {b' '.join(words).decode('utf-8', 'replace')} "
    labels = list(PHRASES.values())
    sizes = [p.count(" ") + 1 for p in PHRASES]
    exact: list[tuple[int, int]] = []
    near: dict[int, list[int]] = {}
    for end, (length, owners) in automaton.iter(line):
        start = end + 1 - length
        for number, place in owners:
            if number < 0:
                exact.append((start, -1 - number))
            else:
                near.setdefault(number, []).append(start - place)
    if not exact and not near:
        return []
    blanks = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), np.uint32) == 0x20)
    word_at = lambda place: int(np.searchsorted(blanks, place, "right")) - 1
    matches = []
    for start, number in exact:
        first = word_at(start)
        matches.append(Match(labels[number], True, 0, len(list(PHRASES)[number]), first, first + sizes[number] - 1))
    for number, starts in near.items():
        text, label, errors = NOTICES[number]
        for low, high in _stretches(starts, len(text), errors, len(line)):
            for found in patterns[number].finditer(line, low, high):
                matches.append(Match(
                    label, False, sum(found.fuzzy_counts), len(text),
                    word_at(found.start()), word_at(found.end() - 1)))
    return matches


def _stretches(starts: list[int], size: int, errors: int, end: int) -> Iterator[tuple[int, int]]:
    """Where a notice may lie, overlaps joined. One blank on each side belongs to it."""
    low = high = -1
    for start in sorted(starts):
        first, last = max(start - errors - 1, 0), min(start + size + errors + 1, end)
        if first <= high:
            high = max(high, last)
            continue
        if high > low:
            yield low, high
        low, high = first, last
    if high > low:
        yield low, high


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

SCAN = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
    "labels string, score double, spans array<struct<label string, exact boolean, errors int, "
    "first_word long, last_word long, start long, `end` long>>")


def scan(docs: DataFrame) -> DataFrame:
    """Counts, labels, score and spans of every row of ``docs``.

    ``score`` is the best likeness of a match: 1 less its errors per character;
    0 without one. ``spans`` lists all matches; ``start`` and ``end`` are code
    points of the text, the end exclusive.
    """
    struct = pa.struct([
        ("label", pa.string()), ("exact", pa.bool_()), ("errors", pa.int32()), ("first_word", pa.int64()),
        ("last_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(struct)]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [_row(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))],
                names=names)

    return documents_of(docs).mapInArrow(find, SCAN)


def _row(text: bytes) -> tuple:
    words = alnum_words(text)
    matches = scan_words(words)
    base = [m for m in matches if m.exact]
    spans = []
    if matches:
        places = [m.span() for m in _WORD.finditer(text.decode("utf-8", "replace"))]
        order = sorted(set(matches), key=lambda m: (m.first_word, m.last_word, m.label, not m.exact))
        spans = [
            {"label": m.label, "exact": m.exact, "errors": m.errors, "first_word": m.first_word,
             "last_word": m.last_word, "start": places[m.first_word][0], "end": places[m.last_word][1]}
            for m in order]
    return (
        len(words), len(base),
        min((m.first_word for m in base), default=None), max((m.first_word for m in base), default=None),
        ",".join(sorted({m.label for m in base})), ",".join(sorted({m.label for m in matches})),
        max((1 - m.errors / m.size for m in matches), default=0.0), spans)
