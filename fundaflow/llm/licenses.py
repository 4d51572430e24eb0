"""Licence scans by ordered signature rules.

A text becomes its lower-case words, joined by single blanks.  One pass of a keyword automaton says which rules
can match at all; only their patterns run, over the whole text.  Detections then compete: one that lies inside
a detection of higher priority, or of the same priority and longer (ties: the earlier rule), is suppressed, so
a name inside a grant and a family inside a version do not count beside them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundaflow.llm.license_rules import BASE, KINDS, rules
from fundaflow.llm.shared import arrow_map, pick

#: ASCII other than letters and digits separates words; only A-Z change case; all else belongs to words.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
_FOUND = "struct<label string, kind string, rule string, start long, `end` long, weight double>"


class Scanner:
    """The compiled rules; one per Python worker."""

    def __init__(self):
        self.rules = rules()
        self.order = list(KINDS)
        self.compiled = [re.compile(r.pattern) for r in self.rules]
        gates: dict[str, list[int]] = {}
        for k, rule in enumerate(self.rules):
            for word in rule.keywords:
                gates.setdefault(word, []).append(k)
        self.gate = ahocorasick.Automaton()
        for word in gates.keys() | BASE.keys():
            self.gate.add_word(word, (word, tuple(gates.get(word, ()))))
        self.gate.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[str, int]], list[tuple]]:
        """(words, base places (label, word), kept detections (label, kind, rule, start, end, weight)) of a text; end is exclusive."""
        words = (text or "").encode("utf-8", "replace").translate(_FOLD).split()
        data = b" " + b" ".join(words) + b" "
        line = data.decode("latin-1")  # a character a byte
        base, may = [], set()
        for last, (word, numbers) in self.gate.iter(line):
            may.update(numbers)
            if word in BASE and line[last - len(word)] == " " == line[last + 1]:
                base.append((BASE[word], last + 1 - len(word)))
        if not may:
            return len(words), [], []
        blanks = np.flatnonzero(np.frombuffer(data, np.uint8) == 0x20)
        word_at = lambda p: int(np.searchsorted(blanks, p)) - 1
        hits = []
        for k in sorted(may):
            for m in self.compiled[k].finditer(line):
                hits.append((word_at(m.start()), word_at(m.end()) + 1, k))
        kept = [(r.label, r.kind, r.name, s, e, KINDS[r.kind]) for s, e, r in ((s, e, self.rules[k]) for s, e, k in self.kept(hits))]
        return len(words), [(label, word_at(p)) for label, p in base], kept

    def kept(self, hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Detections (start, end, rule) that no other one suppresses, by start."""
        out: list[tuple[int, int, int]] = []
        for kind in self.order:
            starts, reach = [], []
            for s, e, _ in sorted(out):
                starts.append(s)
                reach.append(max(e, reach[-1]) if reach else e)
            furthest = -1
            for s, e, k in sorted((h for h in hits if self.rules[h[2]].kind == kind), key=lambda h: (h[0], -h[1], h[2])):
                at = bisect_right(starts, s)
                if e > furthest and not (at and reach[at - 1] >= e):
                    out.append((s, e, k))
                furthest = max(furthest, e)
        return sorted(out)


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


def detections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_words, base (label, start) of every place, found (label, kind, rule, start, end, weight).

    Starts and ends are words from 0, ends exclusive.  A null or empty text has no words and no detection; null
    ids and repeated rows pass through; other columns are ignored whatever their names; an empty table gives an
    empty table.  Whole texts of any length; a map over the scan, no shuffle.
    """
    source = pick(docs, _id=id_col, _text=text_col)
    kind = source.schema["_id"].dataType.simpleString()
    places = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
    found = pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("weight", pa.float64())]))

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, base, hits = [], [], []
        for text in batch.column(1):
            words, at, kept = scanner().scan(text.as_py())
            n.append(words)
            base.append([{"label": label, "start": s} for label, s in at])
            hits.append([dict(zip(("label", "kind", "rule", "start", "end", "weight"), k, strict=True)) for k in kept])
        return pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(base, places), pa.array(hits, found)], names=[id_col, "n_words", "base", "found"])

    return arrow_map(source, scan, f"`{id_col}` {kind}, n_words long, base array<struct<label string, start long>>, found array<{_FOUND}>", rows=1000)


def digests(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document the base places and labels, the labels of both, and a score: 1 - the product of 1 - weight of the detections kept."""
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    base = F.col("base.label")
    starts = F.col("base.start")
    score = F.lit(1.0) - F.aggregate(F.col("found.weight"), F.lit(1.0), lambda p, w: p * (F.lit(1.0) - w))
    return scanned.select(
        f"`{id_col}`", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.col("found.label"))).alias("labels"), score.alias("score"),
    )
