import random
import re

import pytest

from fundaflow.llm import licenses
from fundaflow.llm.license_rules import BASE, KINDS, rules

SCHEMA = "doc_id long, text string, Text string, n_words int, `a.b` int, base string, found int"


def brute(text):
    """All rules without keywords, detections compared with each other one by one."""
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)
    places = [(label, i) for phrase, label in BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    line, order = f" {' '.join(words)} ", list(KINDS)
    hits = []
    for k, rule in enumerate(rules()):
        for m in re.finditer(rule.pattern, line):
            hits.append((line.count(" ", 0, m.start()) - 1, line.count(" ", 0, m.end()), k, rule))
    rank = lambda h: order.index(h[3].kind)
    inside = lambda h, o: o[0] <= h[0] and h[1] <= o[1]
    beats = lambda o, h: rank(o) < rank(h) or (rank(o) == rank(h) and (o[1] - o[0], -o[2]) > (h[1] - h[0], -h[2]))
    kept = [h for h in hits if not any(o is not h and inside(h, o) and beats(o, h) for o in hits)]
    product = 1.0
    for h in sorted(kept, key=lambda h: h[:3]):
        product *= 1 - KINDS[h[3].kind]
    base = sorted({label for label, _ in places})
    starts = [i for _, i in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted({*base, *(h[3].label for h in kept)})), pytest.approx(1 - product))


SAMPLES = [
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "SPDX-License-Identifier: GPL-2.0-or-later", "This text is CC BY 4.0.", "Released under the MIT License. All rights reserved.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "GNU General Public License", "the GNU Lesser General Public License v2.1 or later", "https://creativecommons.org/licenses/by-nc-sa/4.0/",
    "BSD 3-Clause License", "apache license apache license", "gnu general public license gnu general public license version 3", "cc by cc by-sa 3.0", "mit licence", "öffentlich mit Lizenz",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
]


def test_equals_brute_force(spark):
    rng = random.Random(2)
    texts = [*SAMPLES, None, "", " .,;", "ccby", "Admit license", "cc by" * 3, "the mit license" + "é", "x " * 50_000 + "MIT License"]
    for _ in range(60):
        parts = [rng.choice([*SAMPLES, "filler words", "\n", "é 中", "GNU"]) for _ in range(8)]
        texts.append(rng.choice([" ", "\n\n", ", "]).join(p[rng.choice([0, 0, 3]) : rng.choice([None, None, -4])] for p in parts))
    frame = spark.createDataFrame([(i, t, "MIT License", 1, 2, "b", 3) for i, t in enumerate(texts)], SCHEMA)
    got = {r[0]: tuple(r)[1:] for r in licenses.digests(licenses.detections(frame)).collect()}
    for i, text in enumerate(texts):
        assert got[i] == brute(text), text
    assert {k for r in got.values() for k in r[5].split(",")} > {"apache-2.0", "gpl-2.0", "cc-by-nc-sa-4.0", "mit", "lgpl-2.1", "bsd-3-clause"}


def test_rules_are_many_and_their_keywords_are_words():
    every = rules()
    assert len(every) > 300 and len({r.name for r in every}) == len(every)
    for r in every:
        assert all(w == w.lower() and not re.search("[^a-z0-9 ]", w) for w in r.keywords), r


def test_specific_rules_suppress_what_they_contain():
    found = lambda text: [(label, kind) for label, kind, *_ in licenses.scanner().scan(text)[2]]
    assert found("under the Apache License, Version 2.0") == [("apache-2.0", "name")]
    assert found("licensed under the Apache License, Version 2.0") == [("apache-2.0", "notice")]
    assert found("the Apache License") == [("apache", "base")]
    assert found("SPDX-License-Identifier: LGPL-2.1-only") == [("lgpl-2.1", "identifier")]
    assert found("creative commons attribution sharealike 4.0 international license") == [("cc-by-sa-4.0", "name")]


def test_rows_and_empty_tables(spark):
    frame = spark.createDataFrame([(None, "MIT license", "x", 1, 2, "b", 3), (7, None, "x", 1, 2, "b", 3), (7, None, "x", 1, 2, "b", 3)], SCHEMA)
    got = sorted(map(tuple, licenses.digests(licenses.detections(frame)).collect()), key=str)
    assert [r[0] for r in got] == [7, 7, None] and got[0][1:] == (0, 0, None, None, "", "", 0.0)
    assert licenses.digests(licenses.detections(frame.limit(0))).collect() == []
