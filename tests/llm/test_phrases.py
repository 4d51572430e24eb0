import random
import re
from collections import Counter, defaultdict

import pytest

from fundaflow.llm import phrases

SCHEMA = "doc_id long, text string, lang string, Text string, n int, `a.b` int, word string, block int"


def brute(rows, support=30, covered=80, top=2000):
    f, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = set()
    for lang, count in f.items():
        candidates = {p: n for p, n in count.items() if len(p) > 1 and n >= support}
        kept = []
        for p, a in candidates.items():
            inside = (q for q in candidates if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
            if any(100 * candidates[q] >= covered * a for q in inside):
                continue
            score, k = min((2_000_000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], start=1):
            out.add((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return out


def chatter(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "a", "é", "中", "x\x00y", "z", "ab"]
    rows = []
    for i in range(300):
        words = []
        while len(words) < 60:
            words.append(rng.choice(vocabulary[: rng.choice([2, 4, 9])]))
            if rng.random() < 0.2:
                words += ["new", "york", "city", "hall"][: rng.choice([2, 3, 4, 4])]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "!"]) for w in words)
        rows.append((i, text, rng.choice(["en", "en", "de", None, "und", ""])))
    return rows


@pytest.mark.parametrize("block", [7, 1 << 19])
def test_equals_brute_force(spark, block):
    rows = [*chatter(3), (1, None, "en"), (2, "", "en"), (3, " \t.;", "fr"), (3, "only few words", "es"), (3, "only few words", "es"), (None, "of the of the", "en")]
    frame = spark.createDataFrame([(*r, "X", 1, 2, "w", 3) for r in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in phrases.collocations(frame, block=block).collect()]
    want = brute(rows)
    assert set(got) == want and len(got) == len(want)
    assert {len(r[2].split(" ")) for r in want} == {2, 3, 4}


def test_top_of_each_language_and_long_pieces(spark):
    rng = random.Random(8)
    rows = [(1, " ".join(rng.choice(["a", "b", "c"]) for _ in range(20_000)), "en"), (2, "one two " * 400, "de"), (2, "one two " * 400, "de")]
    frame = spark.createDataFrame([(*r, "X", 1, 2, "w", 3) for r in rows], SCHEMA)
    got = {tuple(r) for r in phrases.collocations(frame, top=5, block=1000).collect()}
    assert got == brute(rows, top=5)
    assert phrases.collocations(frame.limit(0)).collect() == []
