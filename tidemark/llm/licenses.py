"""License scan: ordered signature rules behind a keyword prefilter.

Base phrases are sought in the words of every text. Texts that hold one of the rules' keywords are then read
as words joined by blanks, and each rule whose own keyword is there runs its pattern. Matches are taken by priority,
then length, then place and rule; one that lies inside an accepted match is dropped. The labels of what
stays join the base labels.

The rules stand in ``license_rules``, by hand and in order: names, versions, notices, license texts, SPDX identifiers and addresses.

Nulls: a null text counts as empty: no words, no labels, score 0. Rows are taken one by one.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import slices, table
from tidemark.llm.license_rules import RULES_TEXT
from tidemark.llm.words import Words

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


class Rule(NamedTuple):
    label: str
    priority: int
    score: float
    keyword: str
    pattern: str


def build_rules(text: str = RULES_TEXT) -> list[Rule]:
    """The rules in order: of equal priority and length, an earlier rule goes first. What is more certain has more priority, so the score follows it."""
    parts = [line.split(" ", 3) for line in text.strip().split("\n")]
    return [Rule(label, int(priority), min(1.0, int(priority) / 90), keyword, rf"\b(?:{pattern})\b") for label, priority, keyword, pattern in parts]


RULES = build_rules()


def accepted(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, rule) in order of place, of matches (priority, start, end, rule): by priority, then length, place and rule, but none inside an accepted one."""
    starts: list[int] = []  # accepted matches that lie in no other; their ends rise with their starts
    ends: list[int] = []
    kept = []
    for _, _, start, rule, end in sorted((-p, a - b, a, r, b) for p, a, b, r in found):
        at = bisect_right(starts, start)
        if at and ends[at - 1] >= end:
            continue
        kept.append((start, end, rule))
        at, to = bisect_left(starts, start), bisect_right(ends, end)
        starts[at : max(at, to)], ends[at : max(at, to)] = [start], [end]
    return sorted(kept)


class Scanner:
    def __init__(self, rules: list[Rule] = RULES):
        self.rules = [(r, re.compile(r.pattern)) for r in rules]
        self.by: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            self.by.setdefault(r.keyword, []).append(i)

    def scan(self, text: str) -> list[tuple[int, int, Rule]]:
        """Accepted matches in ``text``, words joined by blanks: (start, end, rule) in order of place."""
        run = sorted(i for word in self.by.keys() & set(text.split(" ")) for i in self.by[word])
        found = [(r.priority, m.start(), m.end(), i) for i in run for r, p in [self.rules[i]] for m in p.finditer(text)]
        return [(a, b, self.rules[i][0]) for a, b, i in accepted(found)]


_scanner: list[Scanner] = []


def _phrase_hashes() -> dict[str, Words]:
    return {p: Words(pa.array([p], pa.large_string())) for p in BASE}


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not _scanner:
        _scanner.append(Scanner())
    scanner, phrases = _scanner[0], _phrase_hashes()
    pattern = re.compile(rb"(?<![0-9a-z\x80-\xff])(?:" + b"|".join(sorted(map(re.escape, (k.encode() for k in scanner.by)))) + rb")(?![0-9a-z\x80-\xff])")
    for batch, col in slices(batches):
        words, n = Words(col), len(col)
        n_base, first, last = np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1)
        labels: list[set[str]] = [set() for _ in range(n)]
        score = np.zeros(n)
        for phrase, own in phrases.items():
            k = len(own.hash)
            at = np.flatnonzero(words.fits(k))
            for j in range(k):
                at = at[words.hash[at + j] == own.hash[j]]
            at = np.array([i for i in at.tolist() if words.text(i, i + k) == phrase.encode()], np.int64)
            for i in at.tolist():
                d = int(words.doc[i])
                p = i - int(words.first[d])
                n_base[d] += 1
                first[d] = p if first[d] < 0 else min(first[d], p)
                last[d] = max(last[d], p)
                labels[d].add(BASE[phrase])
                score[d] = max(score[d], 0.7)
        base = [",".join(sorted(x)) for x in labels]
        blob = words.data.tobytes()
        off = words.off.tolist()
        for d in range(n):
            if pattern.search(blob, off[d], off[d + 1]):
                text = words.text(int(words.first[d]), int(words.first[d + 1])).decode()
                for _, _, rule in scanner.scan(text):
                    labels[d].add(rule.label)
                    score[d] = max(score[d], rule.score)
        none = first < 0
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(words.count.astype(np.int64)), pa.array(n_base), pa.array(first, pa.int64(), mask=none), pa.array(last, pa.int64(), mask=none), pa.array(base, pa.string()), pa.array([",".join(sorted(x)) for x in labels], pa.string()), pa.array(score)],
            ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
        )


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts and places of base phrases, base labels, all labels, score."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scan, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op7(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
