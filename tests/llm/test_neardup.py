import random
import re

import numpy as np
import pytest

from fundaflow.llm import graph, neardup, vectors

SCHEMA = "doc_id long, text string, Text string, component_id string, `x.y` int"


def whole(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(rows, width, percent):
    sets = [(i, whole(t, width)) for i, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            if s and t and a is not None and b is not None and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return sorted(((i, len(s), find(i) if i is not None else None, i is None or find(i) == i) for i, s in sets), key=str)


def corpus(rng, n):
    """Copies, near copies of all degrees, chains, and documents that share a passage."""
    base = [[rng.choice("abcdefghij") + str(rng.randint(0, 400)) for _ in range(rng.choice([3, 30, 200]))] for _ in range(n // 8)]
    passage = ["shared", *(f"p{i}" for i in range(25))]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5, 12])):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 9999)}"
        w = w + passage if rng.random() < 0.3 else w
        out.append((i, rng.choice([" ", "\n", "\t "]).join(x.upper() if rng.random() < 0.2 else x for x in w)))
    return out


def result(frame, **args):
    return sorted((tuple(r) for r in neardup.near_duplicates(frame, **args).collect()), key=str)


def test_equals_brute_force(spark):
    rng, width = random.Random(2), 2
    rows = [*corpus(rng, 260), (900, None), (901, ""), (902, " \n"), (903, "one"), (904, "One"), (905, "A b"), (906, "a  b"), (None, "a b"), (907, "x" * 50_000), (908, "w " * 20_000)]
    frame = spark.createDataFrame([(i, t, "c", "c", 1) for i, t in rows], SCHEMA)
    assert result(frame, width=width) == brute(rows, width, 80)


def test_members_that_only_the_base_links(spark):
    """Near copies that reach 0.8 with the base but not with each other; the base has neither least nor greatest id."""
    rng = random.Random(1)
    base = [f"b{i}" for i in range(120)]
    rows = [(50, " ".join(base))]
    for i in range(100, 140):
        w = list(base)
        for at in rng.sample(range(120), 8):
            w[at] = f"y{i}-{at}"
        rows.append((i, " ".join(w)))
    rows.append((7, " ".join(["y100", *rows[1][1].split()[1:]])))
    frame = spark.createDataFrame([(i, t, "c", "c", 1) for i, t in rows], SCHEMA)
    assert result(frame, width=2) == brute(rows, 2, 80)


def test_second_pass_joins_what_hubs_leave(spark, monkeypatch):
    """Blocks of two members, so that groups are dealt into many tiles; five words."""
    monkeypatch.setattr(neardup, "BLOCK", 2)
    rng = random.Random(6)
    rows = corpus(rng, 120)
    frame = spark.createDataFrame([(i, t, "c", "c", 1) for i, t in rows], SCHEMA)
    assert result(frame, width=5) == brute(rows, 5, 80)


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, "a b c"), (3, "z z z z"), (3, "z z z z")]
    frame = spark.createDataFrame([(i, t, "c", "c", 1) for i, t in rows], SCHEMA)
    assert [r[2] for r in result(frame, width=2)] == [1, 1, 1, 3, 3]
    assert neardup.near_duplicates(frame.limit(0)).count() == 0


def test_rows_that_share_an_id_keep_their_own_links(spark):
    """Id 1 has two texts that have nothing in common; each is linked to what its own set is linked to."""
    a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    near = lambda w: [*w[:-1], "other"]
    rows = [(1, " ".join(a)), (1, " ".join(b)), (5, " ".join(near(a))), (6, " ".join(near(b))), (7, " ".join(b)), (8, "alone here")]
    got = result(spark.createDataFrame([(i, t, "c", "c", 1) for i, t in rows], SCHEMA), width=2)
    assert [(r[0], r[2], r[3]) for r in got] == [(1, 1, True), (1, 1, True), (5, 1, False), (6, 1, False), (7, 1, False), (8, 8, True)]
    # the two components of id 1 are told apart where the least ids differ
    rows = [(3, " ".join(a)), (3, " ".join(b)), (2, " ".join(near(b))), (9, " ".join(near(a)))]
    got = result(spark.createDataFrame([(i, t, "c", "c", 1) for i, t in rows], SCHEMA), width=2)
    assert [(r[0], r[2], r[3]) for r in got] == [(2, 2, True), (3, 2, False), (3, 3, True), (9, 3, False)]


def test_only_members_with_likely_partners_get_sets():
    """The first pass of a tile names each row of a pair of different components that passes sizes and signatures, and no other."""
    rng = random.Random(4)
    sets = [s for s in (neardup.shingles(t) for _, t in corpus(rng, 120)) if len(s)]
    n, comp = np.array([len(s) for s in sets]), np.arange(len(sets)) // 2
    sig = np.array([np.frombuffer((neardup._mix(neardup.minima(s)) & np.uint64(0xFF)).astype(np.uint8).tobytes(), np.uint8) for s in sets])
    rows = np.arange(len(sets))
    got = {int(i) for x, y, _ in neardup.likely(rows[::2], rows[1::2], comp, n, sig, 80) for i in [*x, *y]}
    passes = lambda i, j: comp[i] != comp[j] and 100 * min(n[i], n[j]) >= 80 * max(n[i], n[j]) and (sig[i] == sig[j]).sum() >= neardup.AGREEING
    assert got == {int(k) for i in rows[::2] for j in rows[1::2] if passes(i, j) for k in (i, j)}


def test_tiles_emit_a_forest_of_links_across_components():
    """Against all pairs: the same components, and fewer links than members."""
    rng = random.Random(3)
    texts = [t for _, t in corpus(rng, 150)]
    sets = [neardup.shingles(t) for t in texts]
    keep = [i for i, s in enumerate(sets) if len(s)]
    sets = [sets[i] for i in keep]
    n, node = np.array([len(s) for s in sets]), np.arange(len(sets))
    sig = np.array([np.frombuffer((neardup._mix(neardup.minima(s)) & np.uint64(0xFF)).astype(np.uint8).tobytes(), np.uint8) for s in sets])
    comp = np.where(node % 3 == 0, 0, node)  # a third is one component already
    sizes = neardup.shared_sizes(sets, sets)
    assert all(sizes[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(0, len(sets), 7) for j in range(len(sets)))
    links = neardup.joining_links(node, node, node, comp, n, sig, [s.tobytes() for s in sets], 80)
    assert len(links) < len(sets)

    def labels(edges):
        up = {int(c): int(c) for c in comp}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in edges:
            x, y = sorted((find(int(comp[a])), find(int(comp[b]))))
            up[y] = x
        return [find(int(c)) for c in comp]

    every = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * sizes[i, j] >= 80 * (n[i] + n[j] - sizes[i, j])]
    assert labels(links) == labels(every)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(300)] + [(1000 + rng.randint(0, 80), 1000 + rng.randint(0, 80)) for _ in range(60)] + [(5000, 5000 + i) for i in range(200)] + [(None, 3), (9, 9)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in up if find(x) != x}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def cosines(rows):
    def unit(v):
        if v is None or not len(v) or any(x is None for x in v):
            return None
        v = np.array(v, float)
        with np.errstate(all="ignore"):
            return v / np.linalg.norm(v) if np.isfinite(v).all() and v.any() else None

    u = [(i, None if i is None else unit(v)) for i, v in rows]
    up = {i: i for i, _ in rows if i is not None}
    links = [0] * len(rows)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, x) in enumerate(u):
        for b, (j, y) in enumerate(u[:a]):
            if x is not None and y is not None and len(x) == len(y) and x @ y >= 0.95:
                links[a] += 1
                links[b] += 1
                p, q = sorted((find(i), find(j)))
                up[q] = p
    return sorted(((i, links[k], None if i is None else find(i), i is None or find(i) == i) for k, (i, _) in enumerate(u)), key=str)


@pytest.mark.parametrize("kind,tile", [("float", (2048, 4096)), ("double", (16, 24))])
def test_vectors_equal_brute_force(spark, monkeypatch, kind, tile):
    monkeypatch.setattr(vectors, "OWNERS", tile[0])
    monkeypatch.setattr(vectors, "VISITORS", tile[1])
    monkeypatch.setattr(vectors, "PER_PIVOT", 40)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    x = [(centres[rng.integers(12)] + rng.normal(size=8) * rng.choice([0.01, 0.2, 0.5])).astype(np.float32).tolist() for _ in range(300)]
    rows = [(int(i), v) for i, v in enumerate(x)]
    rows += [(500 + i, x[3]) for i in range(40)] + [(600 + i, [float(np.float32(2)) * c for c in x[3]]) for i in range(3)]
    rows += [(700, None), (701, []), (702, [0.0] * 8), (703, [1.0, None] + [0.0] * 6), (704, [float("nan")] * 8), (705, [float("inf")] + [1.0] * 7), (706, [1.0, 0.0]), (707, [2.0, 0.1]), (None, x[3]), (3, x[3])]
    frame = spark.createDataFrame([(i, v, 1, "c") for i, v in rows], f"vec_id long, embedding array<{kind}>, n_links int, Embedding string")
    got = sorted((tuple(r) for r in vectors.near_vectors(frame).collect()), key=str)
    assert got == cosines(rows)
    assert vectors.near_vectors(frame.limit(0)).count() == 0


def test_replication_bounds_lose_no_pair():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pivots, r = x[:17], 0.3162
    d = vectors.distances(x, pivots)
    home = d.argmin(axis=1)
    radius = np.array([d[home == k, k].max() if (home == k).any() else -9 for k in range(17)])
    sent = vectors.reached(x, home, pivots, radius, r)
    for i in range(400):
        for j in range(400):
            if home[i] < home[j] and np.linalg.norm(x[i] - x[j]) <= r:
                assert sent[i, home[j]]
    assert sent.sum() < 0.7 * (np.arange(17)[None, :] > home[:, None]).sum()
