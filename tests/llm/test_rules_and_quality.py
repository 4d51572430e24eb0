import collections
import random
import re

import numpy as np

from fundaflow.llm import quality, rules

SCHEMA = "doc_id long, text string, source string, lang string, Text string, kept int, `x.y` int"
LABELS = "doc_id long, quality int, toxic int"


def plain_counts(text):
    """The base statistics, written the slow way."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, lines = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(inside)


def test_statistics_equal_the_slow_way():
    rng = random.Random(2)
    texts = ["", " ", "a", "a b", "a a a", "a a a a", "x\n\nx\n \nx ", "é\xa0b \x1c c #*$%&|<>", "\x85 a   b"]
    texts += [" ".join(rng.choice(["a", "b", "ç", "#d", "\n", "e\ne", "😀"]) for _ in range(rng.randint(1, 80))) for _ in range(200)]
    for t in texts:
        assert rules.statistics(t)[:5] == plain_counts(t)


def words(rng, n):
    return [rng.choice("bcdfglmnprst") + rng.choice("aeiou") + rng.choice(["", "n", "st", "ll"]) + str(rng.choice(["", "o", "ing"])) for _ in range(n)]


def document(rng, kind, n=120):
    w = words(rng, n)
    if kind == "symbols":
        w = [x + rng.choice(["###", "%%%", "$$$"]) for x in w]
    elif kind == "shout":
        w = [x.upper() + "!!" for x in w]
    elif kind == "loop":
        w = (w[:4] * n)[:n]
    return " ".join(w)


def corpus(seed, n=400):
    rng = random.Random(seed)
    kinds = [rng.choice(["good", "good", "good", "symbols", "shout"]) for _ in range(n)]
    return [(i, document(rng, k), f"s{rng.randint(0, 5)}", rng.choice(["en", "de"]), "c", 1, 1) for i, k in enumerate(kinds)], kinds


def test_rules_hold_out(spark):
    rows, kinds = corpus(1)
    labels = [(i, int(k == "good"), 0) for i, k in enumerate(kinds) if i < 250]
    out, learned = rules.quality_rules(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS))
    got = {r.doc_id: r for r in out.collect()}
    assert learned and all(got[i].kept == (k == "good") for i, k in enumerate(kinds) if i >= 250)
    for i, text, *_ in rows:
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == plain_counts(text)
    # the ordered expression says the same as the rules one by one
    x = {k: np.array([{"symbol_share": r.n_symbols / max(1, r.word_chars), "upper_share": r.n_upper / max(1, r.word_chars), "digit_share": r.n_digits / max(1, r.word_chars),
                       "mark_share": r.n_marks / max(1, r.word_chars), "repeat_share": r.n_repeat_words / max(1, r.n_words), "distinct_share": r.n_distinct / max(1, r.n_words),
                       "dup_line_share": r.n_dup_lines / max(1, r.n_lines), "word_length": r.word_chars / max(1, r.n_words), "words_per_line": r.n_words / max(1, r.n_lines),
                       "n_words": r.n_words}[k] for r in got.values()], float) for k in rules.ratios()}
    first = np.zeros(len(got), int)
    for k, rule in reversed(list(enumerate(learned, 1))):
        first[rules.covers(rule, x)] = k
    assert [r.rule or 0 for r in got.values()] == first.tolist()


def test_rules_cases(spark):
    rng = random.Random(3)
    rows = [(1, None), (2, ""), (3, document(rng, "good")), (3, document(rng, "good")), (None, document(rng, "loop")), (5, document(rng, "good", 49)), (6, document(rng, "good", 60_000))]
    frame = spark.createDataFrame([(i, t, None, None, "c", 1, 1) for i, t in rows], SCHEMA)
    out, learned = rules.quality_rules(frame, spark.createDataFrame([(1, None, 0), (None, 1, 0)], LABELS))
    assert learned == []
    assert sorted(((r.doc_id, r.base_failed, r.kept) for r in out.collect()), key=str) == sorted([(1, True, False), (2, True, False), (3, False, True), (3, False, True), (None, True, False), (5, True, False), (6, False, True)], key=str)
    assert rules.quality_rules(frame.limit(0), spark.createDataFrame([], LABELS))[0].count() == 0


def test_conjunctions_are_grown_and_pruned():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(3000), "b": rng.random(3000), "noise": rng.random(3000)}
    bad = (x["a"] > 0.7) & (x["b"] <= 0.4)
    learned = rules.learn(x, bad)
    assert {c.feature for c in learned[0]} == {"a", "b"}
    assert (rules.covers(learned[0], x) & ~bad).sum() <= 10
    assert rules.learn(x, np.zeros(3000, bool)) == []


def slow_posteriors(evidence, sites):
    """The hierarchy in plain loops: (score) of each document, given its log odds and (host, path)."""
    p = [1 / (1 + np.exp(-e)) for e in evidence]
    hosts, paths = collections.defaultdict(list), collections.defaultdict(list)
    for x, (h, q) in zip(p, sites, strict=True):
        hosts[h].append(x)
        paths[h, q].append(x)
    mean = sum(p) / len(p)

    def weight(groups, centre):
        n, g = sum(map(len, groups.values())), len(groups)
        within = sum(sum((x - np.mean(v)) ** 2 for x in v) for v in groups.values()) / (n - g)
        between = (sum(len(v) * (np.mean(v) - centre(k)) ** 2 for k, v in groups.items()) - g * within) / n
        return quality.MOST_WEIGHT if between <= 0 else min(quality.MOST_WEIGHT, max(quality.LEAST_WEIGHT, within / between))

    kh, kp = weight(hosts, lambda k: mean), weight(paths, lambda k: np.mean(hosts[k[0]]))
    out = []
    for x, e, (h, q) in zip(p, evidence, sites, strict=True):
        mh = (sum(hosts[h]) - x + kh * mean) / (len(hosts[h]) - 1 + kh)
        mp = (sum(paths[h, q]) - x + kp * mh) / (len(paths[h, q]) - 1 + kp)
        out.append(1 / (1 + np.exp(-(e + np.log(mp / (1 - mp)) - np.log(mean / (1 - mean))))))
    return out


def test_quality_hold_out_and_hierarchy(spark):
    rows, kinds = corpus(4)
    labels = spark.createDataFrame([(i, int(k == "good"), 0) for i, k in enumerate(kinds) if i < 250], LABELS)
    got = {r.doc_id: r for r in quality.classified(spark.createDataFrame(rows, SCHEMA), labels).collect()}
    assert np.mean([got[i].kept == (k == "good") for i, k in enumerate(kinds) if i >= 250]) >= 0.98
    want = slow_posteriors([got[r[0]].evidence for r in rows], [(r[2], r[3]) for r in rows])
    assert np.allclose([got[r[0]].score for r in rows], want, atol=1e-9)


def test_sites_pull_unclear_documents(spark):
    """Evidence that a host is bad moves its unclear documents; a sparse host stays near the corpus."""
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(300):
        host = "bad" if i < 150 else "fine"
        kind = "symbols" if host == "bad" and i % 10 else "good"
        rows.append((i, document(rng, kind), host, "en", "c", 1, 1))
        labels.append((i, int(kind == "good"), 0))
    rows.append((999, document(rng, "good"), "rare", "en", "c", 1, 1))
    got = {r.doc_id: r for r in quality.classified(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)).collect()}
    good = lambda host: next(got[r[0]].path_mean for r in rows if r[2] == host)
    assert good("bad") < 0.3 < good("rare") < 0.9 < good("fine")


def test_quality_cases(spark):
    rng = random.Random(3)
    rows = [(1, None, None, None), (2, "", "h", None), (3, document(rng, "good"), None, "en"), (3, document(rng, "good"), None, "en"), (None, document(rng, "good"), "h", "en"), (6, "word " * 50_000, "h", "en")]
    frame = spark.createDataFrame([(*r, "c", 1, 1) for r in rows], SCHEMA)
    got = quality.classified(frame, spark.createDataFrame([(3, 1, 0)], LABELS)).collect()
    assert sorted((str(r.doc_id), r.kept) for r in got) == sorted([("1", False), ("2", False), ("3", True), ("3", True), ("None", True), ("6", True)])
    assert quality.classified(frame.limit(0), spark.createDataFrame([], LABELS)).count() == 0
