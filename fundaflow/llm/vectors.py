"""Embedding near duplicates: an exact metric range join.

Unit vectors are points of Euclidean space, where cosine >= c means distance <= r = sqrt(2 - 2c).  Pivots
partition the points into the cells of their nearest pivots.  A point x of cell i can only have a partner y in
cell j if, by the triangle inequality, |x - pj| <= R + r (R: the cell's radius) and |x - pj| - |x - pi| <= 2r,
and, since y lies on j's side of the plane between the two pivots, if x is at most r away from that plane.
x is replicated to the cells that pass, of higher number only, so that each pair meets in one cell.  Cells are
cut into tiles of bounded size and every tile is joined on its own; it emits sums of links and a spanning
forest instead of pairs.  Equal vectors form one point before anything is compared.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundaflow.llm.graph import components
from fundaflow.llm.shared import arrow_map, checkpointed, pick

#: Points that a pivot is meant for, and the bounds on the number of pivots (they go to every task).
PER_PIVOT, LEAST_PIVOTS, MOST_PIVOTS = 4096, 4, 512
#: Owners and visitors of a tile.
OWNERS, VISITORS = 2048, 4096
#: Added to every bound, for rounding.
SLACK = 1e-9


def is_wide(vectors: DataFrame, vector_col: str) -> bool:
    """Whether components are kept as float64 (all types but float)."""
    return pick(vectors, vector=vector_col).schema["vector"].dataType.elementType.simpleString() != "float"


def points_of(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec, dim, raw (the components as float64 or float32), h1, h2; raw is null for vectors that link with nothing."""
    source = pick(vectors, vec=id_col, vector=vector_col).withColumn("vec", F.col("vec").cast("long"))
    kind = np.float64 if is_wide(vectors, vector_col) else np.float32
    source = source.withColumn("vector", F.col("vector").cast("array<double>" if kind is np.float64 else "array<float>"))

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, h1, h2 = [], [], []
        for v in batch.column(1):
            values = v.values if v.is_valid else None
            x = None
            if values is not None and len(values) and not values.null_count:
                x = values.to_numpy(zero_copy_only=False).astype(kind) + kind(0)  # -0.0 becomes 0.0
                with np.errstate(over="ignore", invalid="ignore"):
                    x = x if np.isfinite(x).all() and x.any() else None
            data = None if x is None else x.tobytes()
            d = xxhash.xxh3_128_digest(data or b"")
            raw.append(data)
            h1.append(int.from_bytes(d[:8], "big", signed=True))
            h2.append(int.from_bytes(d[8:], "big", signed=True))
        dim = [None if x is None else len(x) // kind().itemsize for x in raw]
        data = [batch.column(0), pa.array(dim, pa.int32()), pa.array(raw, pa.binary()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())]
        return pa.record_batch(data, names=["vec", "dim", "raw", "h1", "h2"])

    return arrow_map(source, read, "vec long, dim int, raw binary, h1 long, h2 long", rows=5000)


def units(raw: list[bytes], wide: bool) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that the norm neither overflows nor vanishes."""
    x = np.frombuffer(b"".join(raw), np.float64 if wide else np.float32).astype(np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ p.T)))


def reached(x: np.ndarray, home: np.ndarray, pivots: np.ndarray, radius: np.ndarray, r: float) -> np.ndarray:
    """Boolean rows: the cells of higher number where points of x may have partners."""
    d = distances(x, pivots)
    own = d[np.arange(len(x)), home][:, None]
    between = distances(pivots, pivots)[home]
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = np.where(between > SLACK, (d * d - own * own) / (2 * between), -np.inf)
    ok = (d <= radius[None, :] + r + SLACK) & (d - own <= 2 * r + SLACK) & (plane <= r + SLACK)
    return ok & (np.arange(len(pivots))[None, :] > home[:, None])


class Forest:
    """Labels under merging: each label is the least node of its tree."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def merge(self, nodes: np.ndarray) -> None:
        labels = np.unique(self.up[nodes])
        if len(labels) > 1:
            self.up[np.isin(self.up, labels)] = labels[0]


def join_tile(owners: np.ndarray, visitors: np.ndarray, same: np.ndarray, guests: np.ndarray, copies_o: np.ndarray, copies_v: np.ndarray,
              cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links of owners, links of visitors, labels of owners then visitors).

    same[i] is the place of owner i among the visitors, or -1; guests marks visitors of other cells, whose links
    count here, while those of the cell's own visitors count where they are owners.
    """
    links_o, links_v = np.zeros(len(owners), np.int64), np.zeros(len(visitors), np.int64)
    forest = Forest(len(owners) + len(visitors))
    for i in np.flatnonzero(same >= 0):
        forest.merge(np.array([i, len(owners) + same[i]]))
    for at in range(0, len(owners), 512):
        hit = owners[at : at + 512] @ visitors.T >= cosine
        for i in np.flatnonzero(same[at : at + 512] >= 0):
            hit[i, same[at + i]] = False
        links_o[at : at + 512] += hit @ copies_v
        links_v += copies_o[at : at + 512] @ hit
        for i in np.flatnonzero(hit.any(axis=1)):
            forest.merge(np.append(np.flatnonzero(hit[i]) + len(owners), at + i))
    return links_o, np.where(guests, links_v, 0), forest.up


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """One row per row of vectors: id_col, n_links, component_id, kept.

    Linked are vectors of the same length with cosine >= `cosine` in double precision.  Vectors that are null,
    empty, zero, or hold null or non-finite components link with nothing; so do rows with a null id, which are
    kept.  Repeated rows are vectors like any other: each counts the others.  Ids must be whole numbers; other
    columns are ignored; an empty table gives an empty table.
    """
    r = math.sqrt(2 - 2 * cosine)
    rows = checkpointed(points_of(vectors, id_col, vector_col))
    some = rows.where("raw IS NOT NULL AND vec IS NOT NULL")
    points = checkpointed(
        some.groupBy("h1", "h2").agg(F.min("vec").alias("point"), F.count("*").alias("copies"), F.first("dim").alias("dim"), F.first("raw").alias("raw"))
    )
    dims = points.groupBy("dim").agg(F.count("*").alias("n"))
    wide = is_wide(vectors, vector_col)
    links, edges = None, None
    for found in dims.orderBy("dim").collect():  # a few lengths, one as a rule
        weight, edge = _of_length(points.where(F.col("dim") == found["dim"]), int(found["n"]), wide, r, cosine)
        links = weight if links is None else links.union(weight)
        edges = edge if edges is None else edges.union(edge)
    flat = rows.select("vec", "h1", "h2", (F.col("raw").isNotNull() & F.col("vec").isNotNull()).alias("usable"))
    if links is None:
        out = flat.select("vec", F.lit(0).cast("long").alias("n_links"), F.col("vec").alias("component_id"))
    else:
        label = components(edges)
        known = points.select("h1", "h2", "point", "copies").join(links.groupBy("point").agg(F.sum("links").alias("links")), "point", "left")
        known = known.join(label.withColumnRenamed("node", "point"), "point", "left")
        known = known.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "point").alias("component_id"))
        known = known.where("n_links > 0")
        joined = flat.join(known, ["h1", "h2"], "left")
        pick_one = lambda c, other: F.when(F.col("usable"), F.coalesce(c, other)).otherwise(other)
        out = joined.select("vec", pick_one("n_links", F.lit(0)).cast("long").alias("n_links"), pick_one("component_id", F.col("vec")).alias("component_id"))
    return out.select(F.col("vec").alias(id_col), "n_links", "component_id", F.coalesce(F.col("vec") == F.col("component_id"), F.lit(True)).alias("kept"))


def _of_length(points: DataFrame, n: int, wide: bool, r: float, cosine: float) -> tuple[DataFrame, DataFrame]:
    """(point, links) and edges (u, v) of the points of one length."""
    count = min(n, MOST_PIVOTS, max(LEAST_PIVOTS, n // PER_PIVOT))
    chosen = points.orderBy("h1", "h2").limit(count).select("raw").collect()  # at most MOST_PIVOTS
    pivots = units([bytes(x["raw"]) for x in chosen], wide)

    def home(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = units(batch.column(2).to_pylist(), wide)
        d = distances(x, pivots)
        at = d.argmin(axis=1)
        return pa.record_batch([*batch.columns, pa.array(at, pa.int32()), pa.array(d[np.arange(len(x)), at])], names=["point", "copies", "raw", "home", "d"])

    placed = checkpointed(arrow_map(points.select("point", "copies", "raw"), home, "point long, copies long, raw binary, home int, d double", rows=4096))
    stats = {x["home"]: (x["d"], x["n"]) for x in placed.groupBy("home").agg(F.max("d").alias("d"), F.count("*").alias("n")).collect()}  # a row per pivot
    radius = np.array([stats.get(k, (-9.0, 0))[0] for k in range(len(pivots))])
    size = np.array([stats.get(k, (0.0, 0))[1] for k in range(len(pivots))])

    def cells(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Each point in its own cell and in the cells it may have partners in."""
        x = units(batch.column(2).to_pylist(), wide)
        at = batch.column(3).to_numpy()
        far, cell = np.nonzero(reached(x, at, pivots, radius, r))
        row = pa.array(np.concatenate([np.arange(len(x)), far]))
        kind = np.concatenate([np.zeros(len(x), bool), np.ones(len(far), bool)])
        out = [batch.column(k).take(row) for k in (0, 1, 2)]
        return pa.record_batch([*out, pa.array(np.concatenate([at, cell]), pa.int32()), pa.array(kind)], names=["point", "copies", "raw", "cell", "guest"])

    spread = arrow_map(placed, cells, "point long, copies long, raw binary, cell int, guest boolean", rows=1024)
    counted = {x["cell"]: x["n"] for x in spread.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row per pivot
    shape = {k: (math.ceil(size[k] / OWNERS), math.ceil(counted[k] / VISITORS)) for k in counted if size[k]}
    if not shape:
        shape = {0: (1, 1)}
    pairs_of = F.create_map(*[F.lit(x) for k, v in shape.items() for x in (int(k), f"{v[0]},{v[1]}")])
    both = F.split(F.element_at(pairs_of, F.col("cell")), ",")
    sized = spread.where(F.col("cell").isin(*map(int, shape))).withColumn("nb", both[0].cast("int")).withColumn("nv", both[1].cast("int"))
    sized = sized.withColumn("b", F.pmod(F.xxhash64("point"), F.col("nb")).cast("int")).withColumn("v", F.pmod(F.xxhash64("point", F.lit(1)), F.col("nv")).cast("int"))
    columns = ["point", "copies", "raw", "cell", "guest"]
    as_owner = sized.where("NOT guest").withColumn("v", F.explode(F.sequence(F.lit(0), F.col("nv") - 1))).select(*columns, "b", "v", F.lit(True).alias("owner"))
    as_visitor = sized.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(*columns, "b", "v", F.lit(False).alias("owner"))

    def tile(group: pa.Table) -> pa.Table:
        owner = group.column("owner").to_numpy()
        point, copies, guest = (group.column(c).to_numpy() for c in ("point", "copies", "guest"))
        if owner.all() or not owner.any():
            return pa.table({"point": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "label": pa.array([], pa.int64())})
        x = units(group.column("raw").to_pylist(), wide)
        o, v = np.flatnonzero(owner), np.flatnonzero(~owner)
        place = {p: k for k, p in enumerate(point[v].tolist())}
        same = np.array([place.get(p, -1) for p in point[o].tolist()])
        links_o, links_v, up = join_tile(x[o], x[v], same, guest[v], copies[o], copies[v], cosine)
        ids = np.concatenate([point[o], point[v]])
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, up, ids)
        links = np.concatenate([links_o, links_v])
        keep = (links > 0) | (least[up] != ids)
        return pa.table({"point": ids[keep], "links": links[keep], "label": least[up][keep]})

    joined = checkpointed(as_owner.union(as_visitor).groupBy("cell", "b", "v").applyInArrow(tile, "point long, links long, label long"))
    edges = joined.where("label != point").select(F.col("point").alias("u"), F.col("label").alias("v")).distinct()
    return joined.where("links > 0").select("point", "links"), edges
