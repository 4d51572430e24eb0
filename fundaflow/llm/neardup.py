"""Near duplicates by MinHash: universal hash minima, banding, signature verification, exact confirmation, star components.

Documents with the same set of shingles form one class before anything is compared, however many they are.
Classes that share a band meet in its bucket.  A bucket's hub, the member with the most company over all
bands, is compared with every other member.  Buckets of one hub make up its group; where a group still holds
several components, its members are compared across components in bounded tiles: first on signatures alone,
then the members that have a likely partner in their tile on full sets, of which the tile emits a spanning
forest of links, not pairs.  So g members that belong together cost g comparisons, and no
pair of a bucket whose link could matter goes unexamined.  A pair becomes a link only on its full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundaflow.llm.graph import components
from fundaflow.llm.shared import arrow_map, checkpointed, pick

#: Rows of a band and bands: a pair at 0.8 is missed with probability (1 - 0.8^4)^32 = 5e-8.
ROWS, BANDS = 4, 32
HASHES = ROWS * BANDS
#: Of HASHES minima (compared by a byte each), as many as a pair at 0.8 has but for a chance of 2e-7.
AGREEING = 79
#: Members of a tile's side, and of the small groups that share a task.
BLOCK, BUNDLE = 512, 1000
MEMO = 500_000

_rng = np.random.default_rng(20_231)
_A = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_M1, _M2, _M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """64-bit hashes of words, worked out once per worker."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, width: int = 2) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the runs of `width` words (A-Z lower-cased); fewer words: the whole sequence as one."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(width, len(h))):
        out = _mix(out * _M3 + h[k : k + n] + np.uint64(k + 1))
    return np.unique(out)


def minima(s: np.ndarray) -> np.ndarray:
    """HASHES minima of a non-empty set under multiply-shift universal hashing."""
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):
        h = s[at : at + 4096]
        out = np.minimum(out, (_A[:, None] * h[None, :] + _B[:, None]).min(axis=1))
    return out >> np.uint64(32)


def bands(m: np.ndarray) -> np.ndarray:
    rows = m.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = _mix(key * _M3 + rows[:, k])
    return key.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """doc, n (size of the set), h1, h2 (the set itself, 128 bits), bands, sig (a byte of each minimum)."""

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, h1, h2, keys, sigs = [], [], [], [], []
        for text in batch.column(1).to_pylist():
            s = shingles(text, width)
            n.append(len(s))
            d = xxhash.xxh3_128_digest(s.tobytes())
            h1.append(int.from_bytes(d[:8], "big", signed=True))
            h2.append(int.from_bytes(d[8:], "big", signed=True))
            m = minima(s) if len(s) else np.zeros(HASHES, np.uint64)
            keys.append(bands(m) if len(s) else None)
            sigs.append((_mix(m) & np.uint64(0xFF)).astype(np.uint8).tobytes())
        data = [batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())]
        return pa.record_batch(data, names=["doc", "n", "h1", "h2", "bands", "sig"])

    source = pick(docs, doc=id_col, text=text_col).withColumn("doc", F.col("doc").cast("long"))
    return arrow_map(source, sign, "doc long, n long, h1 long, h2 long, bands array<long>, sig binary", rows=1000)


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal bytes of each row of a with each row of b, in strips of bounded size."""
    out = np.empty((len(a), len(b)), np.int16)
    for at in range(0, len(a), 16):
        out[at : at + 16] = (a[at : at + 16, None, :] == b[None, :, :]).sum(axis=2)
    return out


def _fits(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can reach the similarity at all."""
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def filtered(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), once each, that sizes and signatures do not rule out."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b, na, sa, nb, sb = batch.columns
        x = np.frombuffer(b"".join(sa.to_pylist()), np.uint8).reshape(-1, HASHES)
        y = np.frombuffer(b"".join(sb.to_pylist()), np.uint8).reshape(-1, HASHES)
        keep = ((x == y).sum(axis=1) >= AGREEING) & _fits(na.to_numpy(), nb.to_numpy(), percent)
        return pa.record_batch([a, b], names=["a", "b"]).filter(pa.array(keep))

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return arrow_map(both.select("a", "b", "na", "sa", "nb", "sb"), check, "a long, b long", rows=20_000)


def full_sets(nodes: DataFrame, docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(node, set): the full sets of the nodes given (node, least, h1, h2), read from the texts of their least ids again."""
    texts = pick(docs, doc=id_col, text=text_col).withColumn("doc", F.col("doc").cast("long"))

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        node, text, h1, h2 = (c.to_pylist() for c in batch.columns)
        out = {}
        for i, t, x, y in zip(node, text, h1, h2, strict=True):
            s = shingles(t, width)
            d = xxhash.xxh3_128_digest(s.tobytes())
            if (int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)) == (x, y):
                out[i] = s.tobytes()  # of rows that share the id, those with the node's own set
        return pa.record_batch([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.binary())], names=["node", "set"])

    of_nodes = texts.join(nodes, texts["doc"] == nodes["least"]).select("node", "text", "h1", "h2")
    return arrow_map(of_nodes, whole, "node long, set binary", rows=1000)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            at = np.searchsorted(b, a)
            shared = int((b[np.minimum(at, len(b) - 1)] == a).sum())
            keep.append(100 * shared >= percent * (len(a) + len(b) - shared))
        return pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    return arrow_map(pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb"), check, "a long, b long", rows=2000)


def shared_sizes(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of each left with each right set, as products of incidence matrices over the hashes that both sides have."""
    common = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.float32)
    # float32 counts whole numbers exactly up to 2^24, far beyond a strip's width
    for at in range(0, len(common), 4096):
        strip = common[at : at + 4096]
        sides = []
        for sets in (left, right):
            m = np.zeros((len(sets), len(strip)), np.float32)
            for i, s in enumerate(sets):
                lo, hi = np.searchsorted(s, [strip[0], strip[-1]])
                part = s[lo : hi + 1]
                place = np.searchsorted(strip, part)
                place[place == len(strip)] = 0
                m[i, place[strip[place] == part]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def likely(left: np.ndarray, right: np.ndarray, comp: np.ndarray, n: np.ndarray, sig: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Strips (rows, others, ok) of the rows `left` and `right` with partners of another component that sizes and signatures do not rule out."""
    names, count = np.unique(comp[np.concatenate([left, right])], return_counts=True)
    if len(names) < 2:
        return
    largest = names[count.argmax()]
    # no pair inside the largest component matters: its rows meet the other rows only
    for x, y in ((left[comp[left] != largest], right), (left[comp[left] == largest], right[comp[right] != largest])):
        for at in range(0, len(x), 128):
            rows = x[at : at + 128]
            ok = (comp[rows][:, None] != comp[y][None, :]) & _fits(n[rows][:, None], n[y][None, :], percent)
            if ok.any():
                ok &= _agreement(sig[rows], sig[y]) >= AGREEING
            if ok.any():
                yield rows[ok.any(axis=1)], y[ok.any(axis=0)], ok[ok.any(axis=1)][:, ok.any(axis=0)]


def joining_links(left: np.ndarray, right: np.ndarray, node: np.ndarray, comp: np.ndarray, n: np.ndarray, sig: np.ndarray, sets: list[bytes],
                  percent: int) -> list[tuple[int, int]]:
    """Links between rows `left` and rows `right` that join different components: a spanning forest of them, not all."""
    up = {c: c for c in np.unique(comp[np.concatenate([left, right])]).tolist()}

    def root(c: int) -> int:
        while up[c] != c:
            up[c] = up[up[c]]
            c = up[c]
        return c

    out = []
    for rows, others, ok in likely(left, right, comp, n, sig, percent):
        shared = shared_sizes([np.frombuffer(sets[i], np.uint64) for i in rows], [np.frombuffer(sets[j], np.uint64) for j in others])
        union = n[rows][:, None] + n[others][None, :] - shared
        for i, j in zip(*np.nonzero(ok & (100 * shared >= percent * union)), strict=True):
            a, b = root(int(comp[rows[i]])), root(int(comp[others[j]]))
            if a != b:
                up[max(a, b)] = min(a, b)
                out.append((int(node[rows[i]]), int(node[others[j]])))
    return out


def _sides(group: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(left, right) rows of each of a task's groups: the two blocks of a tile, or all of a small group with itself."""
    hub, own = group.column("hub").to_numpy(), group.column("own").to_numpy()
    i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    order = np.argsort(hub, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(hub[order])) + 1):
        yield (at[own[at] == i], at[own[at] == j]) if i >= 0 else (at, at)


def _signed(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    comp, n = group.column("comp").to_numpy(), group.column("n").to_numpy()
    return comp, n, np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)


def across(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join different components within the groups given (hub, node, comp, n, sig); sets: (node, set).

    A large group is dealt into tiles of two blocks each, small groups are bundled; a task holds one tile or
    bundle.  A first pass compares signatures; only members with a likely partner in their tile go on to the
    second, get their full sets there, and give at most one link per component.
    """
    sized = members.join(members.groupBy("hub").agg(F.count("*").alias("m")), "hub")
    total = int(sized.where(F.col("m") <= BLOCK).count())
    bundles = max(1, total // BUNDLE)
    blocks = F.ceil(F.col("m") / F.lit(BLOCK)).cast("int")
    block = F.pmod(F.xxhash64("node"), blocks).cast("int")
    tile = lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j"))
    dealt = sized.withColumn("own", block).withColumn("tiles", F.transform(F.sequence(F.lit(0), blocks - 1), tile))
    small = F.col("m") <= BLOCK
    rows = dealt.withColumn("t", F.explode("tiles")).select(
        F.when(small, F.pmod(F.xxhash64("hub"), F.lit(bundles))).otherwise(F.col("hub")).alias("g"), F.when(small, F.lit(-1)).otherwise(F.col("t.i")).alias("i"),
        F.when(small, F.lit(-1)).otherwise(F.col("t.j")).alias("j"), "hub", "node", "comp", "n", "sig", "own",
    )

    def compare_signatures(group: pa.Table) -> pa.Table:
        comp, n, sig = _signed(group)
        keep = np.zeros(len(group), bool)
        for left, right in _sides(group):
            for strip, others, _ in likely(left, right, comp, n, sig, percent):
                keep[strip], keep[others] = True, True
        return group.filter(pa.array(keep))

    def compare(group: pa.Table) -> pa.Table:
        comp, n, sig = _signed(group)
        node, full = group.column("node").to_numpy(), group.column("set").to_pylist()
        out: list[tuple[int, int]] = []
        for left, right in _sides(group):
            out += joining_links(left, right, node, comp, n, sig, full, percent)
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    met = checkpointed(rows.groupBy("g", "i", "j").applyInArrow(compare_signatures, rows.schema))
    return met.join(sets, "node").groupBy("g", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id, kept.

    Linked are documents with 100 * intersection >= percent * union of their sets of `width`-word shingles;
    component_id is the least id reachable over links, kept says whether that is the document itself.  Null,
    empty and blank texts have an empty set and are linked with nothing; rows with a null id are linked with
    nothing and kept.  Rows that repeat an id are texts of their own, each linked through its own set and no
    other; so the same id may stand in several components.
    Ids must be whole numbers; other columns are ignored; an empty table gives an empty table.
    """
    signed = checkpointed(signatures(docs, id_col, text_col, width))
    some = signed.where("n > 0 AND doc IS NOT NULL")
    nodes = checkpointed(
        some.groupBy("h1", "h2").agg(
            F.min("doc").alias("least"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"),
        ).withColumn("node", F.monotonically_increasing_id())  # one a set, also where sets share their least id; fixed by the checkpoint
    )
    members = nodes.select(F.explode("bands").alias("key"), "node")
    shared = members.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    members = checkpointed(members.join(shared, "key"))
    weight = members.groupBy("node").agg(F.sum("m").alias("weight")).join(nodes.select("node", (-F.col("least")).alias("minus")), "node")
    hubs = members.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", "minus", "node")).alias("h")).select("key", F.col("h.node").alias("hub"))
    met = checkpointed(members.join(hubs, "key").select("hub", "node").distinct())  # the hub itself is in each of its groups
    spokes = met.where("node != hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    near = checkpointed(filtered(spokes, nodes, percent))
    crowds = met.groupBy("hub").agg(F.count("*").alias("m")).where("m > 2")  # beyond the hub's own pairs, only these have any
    needed = near.select(F.explode(F.array("a", "b")).alias("node")).union(met.join(crowds, "hub").select("node")).distinct()
    sets = checkpointed(full_sets(nodes.select("node", "least", "h1", "h2").join(needed, "node"), docs, width, id_col, text_col))
    links = checkpointed(confirmed(near, sets, percent))
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    found = components(edges)

    placed = met.join(found, "node", "left").select("hub", "node", F.coalesce("component", "node").alias("comp"))
    apart = placed.groupBy("hub").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).where("lo != hi AND m > 2").select("hub")
    rest = checkpointed(placed.join(apart, "hub"))
    if rest.take(1):
        members = rest.join(nodes.select("node", "n", "sig"), "node")
        further = checkpointed(across(members, sets, percent).select(F.col("a").alias("u"), F.col("b").alias("v")))
        if further.take(1):
            found = components(edges.union(further))

    linked = found.union(found.select("component", "component").distinct())
    placed = nodes.select("h1", "h2", "node", "least", "copies").join(linked, "node", "left")
    placed = checkpointed(placed.where("copies > 1 OR component IS NOT NULL").withColumn("component", F.coalesce("component", "node")))
    named = placed.groupBy("component").agg(F.min("least").alias("label"))
    same = placed.join(named, "component").select("h1", "h2", F.col("label").alias("component"))
    out = signed.select("doc", "n", "h1", "h2").join(same, ["h1", "h2"], "left")
    label = F.when((F.col("n") > 0) & F.col("doc").isNotNull(), F.coalesce("component", "doc")).otherwise(F.col("doc"))
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), label.alias("component_id"), F.coalesce(F.col("doc") == label, F.lit(True)).alias("kept"))
