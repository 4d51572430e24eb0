"""Mixing to target weights by soft membership.

A softmax classifier trained on a labelled table gives each document its posteriors of the domains.  Rates per
document, not below zero, are then fitted by projected gradients so that the expected tokens of each domain
match the targets, in least squares, with a small pull toward rate 1.

At the optimum a document's rate is 1 minus its posteriors times one multiplier a domain, projected onto the
allowed rates; so the gradient steps are taken in the few multipliers, scaled by the curvature that the
documents with free rates give.  A round is one grouped sum over a narrow table of posteriors, of which only
domain totals and their second moments reach the driver.  The fit ends when the projected gradient vanishes,
however many rounds that takes; the objective is piecewise quadratic, so they are few.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundaflow.llm.shared import arrow_map, checkpointed, pick

#: Hashed byte pairs that the classifier sees, labelled rows it learns from at most, and its training rounds.
WIDTH = 512
MAX_LABELLED = 8_192
TRAINING_ROUNDS = 300
#: Pull of each rate toward 1, relative to the domains' mismatch.
PULL = 1e-4
#: The fit ends when no component of the projected gradient is more than this share of the total.
FLAT = 1e-9
#: Copies of a document that one task writes; of more, the pieces are dealt to other tasks.
TOGETHER = 64
#: A fit whose totals are further off than this share of the total warns.
CLOSE = 1e-4


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte pairs (A-Z lower-cased); zero for an empty text."""
    raw = np.frombuffer(text.encode("utf-8", "replace").lower(), np.uint8).astype(np.uint32)
    if not len(raw):
        return np.zeros(WIDTH, np.float32)
    pairs = np.append(raw, 32)[1:] * np.uint32(31) + raw * np.uint32(17) + (raw >> np.uint32(7)) * np.uint32(101)
    return np.sqrt(np.bincount(pairs % WIDTH, minlength=WIDTH) / len(raw)).astype(np.float32)


def words(text: str) -> int:
    return len(text.encode("utf-8", "replace").split())


@dataclass(frozen=True)
class Domains:
    names: tuple[str, ...]
    weights: np.ndarray  # WIDTH + 1 rows, the last the intercept

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights[:-1] + self.weights[-1]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(x: np.ndarray, domain: np.ndarray, names: tuple[str, ...], ridge: float = 1e-5) -> Domains:
    """Softmax regression by accelerated gradients; the shares of the domains where there is nothing to learn from."""
    w = np.zeros((WIDTH + 1, len(names)))
    if len(domain):
        a = np.hstack([x.astype(float), np.ones((len(x), 1))])
        y = np.eye(len(names))[domain]
        lipschitz = 0.5 * float((a * a).sum(axis=1).max())
        ahead, momentum = w, 1.0
        for _ in range(TRAINING_ROUNDS):
            z = a @ ahead
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            new = ahead - (a.T @ (p - y) / len(x) + ridge * ahead) / lipschitz
            faster = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
            ahead, w, momentum = new + (momentum - 1) / faster * (new - w), new, faster
    return Domains(names, w)


def domain_classifier(labelled: DataFrame, names: tuple[str, ...], text_col: str = "text", domain_col: str = "domain", id_col: str = "doc_id",
                      most: int = MAX_LABELLED) -> Domains:
    """Trained on about `most` labelled rows at most, chosen by hash; rows of other or null domains teach nothing."""
    rows = pick(labelled, doc=id_col, text=text_col, domain=domain_col).where(F.col("domain").isin(*names))
    total = rows.select("doc").distinct().count()
    if total > most:
        rows = rows.where(F.pmod(F.xxhash64("doc", F.lit("mixing")), F.lit(1 << 30)) < F.lit(int((1 << 30) * most / total)))
    rows = rows.groupBy("doc", "domain").agg(F.min("text").alias("text")).select("doc", "text", "domain")  # one row a label, however often its id stands in the corpus

    def see(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column(2), pa.array([features(t or "").tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["domain", "x"])

    seen = arrow_map(rows.select("doc", "text", F.col("domain").cast("string")), see, "domain string, x binary", rows=1000).collect()
    seen.sort(key=lambda r: (r["domain"], bytes(r["x"])))  # the same model whatever the partitions
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in seen), np.float32).reshape(-1, WIDTH)
    return train(x, np.array([names.index(r["domain"]) for r in seen], int), names)


def with_posteriors(docs: DataFrame, model: Domains, text_col: str = "text") -> DataFrame:
    """docs and their `mix_tokens` (words) and `mix_p` (posteriors in the order of model.names)."""
    columns = docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    at = columns.index(text_col)
    fields = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(at).to_pylist()]
        p = model.posteriors(np.array([features(t) for t in texts], float).reshape(-1, WIDTH))
        return pa.record_batch([*batch.columns, pa.array([words(t) for t in texts], pa.int64()), pa.array(list(p), pa.list_(pa.float64()))], names=[*batch.schema.names, "mix_tokens", "mix_p"])

    return arrow_map(flat, judge, f"{fields}, mix_tokens long, mix_p array<double>", rows=1000).toDF(*columns, "mix_tokens", "mix_p")


def _dot(g: list[float]) -> Column:
    out = F.lit(0.0)
    for k, v in enumerate(g):
        out = out + F.get("mix_p", F.lit(k)) * F.lit(v)
    return out


@dataclass(frozen=True)
class Fit:
    """The multipliers of the domains, and where the rates that follow from them lead."""

    multipliers: list[float]
    totals: list[float]
    wanted: list[float]
    least: float
    most: float
    rounds: int = 0

    def rate(self) -> Column:
        return _projected(_dot(self.multipliers), self.least, self.most) if self.multipliers else F.lit(1.0)

    @property
    def off(self) -> float:
        """How far the domain furthest from its target is off, as a share of the total aimed at."""
        total = sum(self.wanted)
        return max(abs(a - b) for a, b in zip(self.totals, self.wanted, strict=True)) / total if total > 0 else 0.0

    @property
    def met(self) -> bool:
        return self.off <= CLOSE


def _projected(pressure: Column, least: float, most: float) -> Column:
    rate = F.greatest(F.lit(1.0) - pressure, F.lit(least))
    return rate if math.isinf(most) else F.least(rate, F.lit(most))


def fitted(members: DataFrame, targets: tuple[float, ...], least: float = 0.0, most: float = math.inf, whole: bool = False) -> Fit:
    """Rates for rows of (mix_tokens, mix_p): their expected domain tokens against `targets` (shares, which are scaled to 1).

    The total aimed at is the one that there is; with `whole` it is the smallest one that no domain exceeds
    already, so that no document has to be thinned out.  Rates have no upper bound unless `most` is given.
    Minimized is half the sum over domains of (total - wanted)^2 / scale, scale being the domain's own tokens, plus
    half of PULL times tokens * (rate - 1)^2; a target that cannot be met leaves the totals off, which warns.
    """
    share = np.array(targets, float) / sum(targets)
    size = len(share)
    p = [F.get("mix_p", F.lit(k)) for k in range(size)]
    pairs = [(k, j) for k in range(size) for j in range(k, size)]

    def measured(multipliers: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Domain totals at the projected rates, second moments of the free documents, and the dual objective's sum."""
        pressure, tokens = F.col("pressure"), F.col("mix_tokens").cast("double")
        rows = members.select("mix_tokens", "mix_p", _dot(multipliers.tolist()).alias("pressure")).withColumn("w", _projected(pressure, least, most))
        w, free = F.col("w"), (F.col("w") == F.lit(1.0) - pressure).cast("double")
        row = rows.agg(
            *[F.sum(tokens * p[k] * w) for k in range(size)], *[F.sum(tokens * p[k] * p[j] * free) for k, j in pairs],
            F.sum(tokens * (w * (F.lit(1.0) - pressure) - w * w / 2)),
        ).first()
        values = [x or 0.0 for x in row]
        moments = np.zeros((size, size))
        for (k, j), v in zip(pairs, values[size:-1], strict=True):
            moments[k, j] = moments[j, k] = v
        return np.array(values[:size]), moments, values[-1]

    at = np.zeros(size)
    totals, moments, value = measured(at)
    total = float(totals.sum())
    if total <= 0:
        return Fit([], [0.0] * size, [0.0] * size, least, most)
    aimed = max(totals / np.maximum(share, 1e-12)) if whole else total
    wanted = share * aimed
    ridge = PULL * np.maximum(totals, 1e-6 * total)
    dual = lambda value, at: value + float(wanted @ at) + float(ridge @ (at * at)) / 2
    rounds = 0
    while True:
        gradient = totals - wanted - ridge * at  # of the projected rates' least squares
        if np.abs(gradient).max() <= FLAT * aimed:
            break
        step = np.linalg.solve(moments + np.diag(ridge), gradient)
        length, here, moved = 1.0, dual(value, at), False
        while not moved and length > 1e-9:
            rounds += 1
            next_totals, next_moments, next_value = measured(at + length * step)
            # no lower by the sum's own rounding: as flat as doubles can tell
            moved = dual(next_value, at + length * step) <= here - 1e-4 * length * float(gradient @ step)
            length = length if moved else length / 2
        if not moved:
            break
        at, totals, moments, value = at + length * step, next_totals, next_moments, next_value
    out = Fit(at.tolist(), totals.tolist(), wanted.tolist(), least, most, rounds)
    if not out.met:
        warnings.warn(f"mixing: a domain is {out.off:.2%} of the total off its target; wanted {out.wanted}, got {out.totals}", stacklevel=2)
    return out


def copies(rate: Column, key: Column) -> Column:
    """rate rounded up or down by a hash of the key, so that it is met in expectation and the same in every run."""
    chance = F.pmod(F.xxhash64(key, F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate + chance).cast("int")


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain",
          least: float = 0.0, most: float = math.inf, whole: bool = False) -> tuple[DataFrame, Fit]:
    """(one row per row of docs: id_col, tokens, posteriors, domain, rate, copies; the fit).

    tokens: words of the text; posteriors: in the order of `targets`; domain: the most likely one, the first of
    equals; copies: how often the document is taken, `rate` times on average.  A null or empty text has no
    tokens, the classifier's base posteriors, and a rate like any other.  Without labelled rows all domains
    are equally likely.  Null ids and repeated rows are mixed like any other (equal ids round alike); other
    columns are ignored; an empty table gives an empty table.
    """
    names = tuple(targets)
    model = domain_classifier(labelled, names, text_col, domain_col, id_col)
    source = pick(docs, id=id_col, text=text_col)
    members = checkpointed(with_posteriors(source, model).drop("text"))
    fit = fitted(members, tuple(targets.values()), least, most, whole)
    rated = members.withColumn("rate", fit.rate())
    likely = F.element_at(F.array(*map(F.lit, names)), F.array_position("mix_p", F.array_max("mix_p")).cast("int"))
    out = rated.select(
        F.col("id").alias(id_col), F.col("mix_tokens").alias("tokens"), F.col("mix_p").alias("posteriors"), likely.alias("domain"), "rate", copies(F.col("rate"), F.col("id")).alias("copies"),
    )
    return out, fit


def applied(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain",
            least: float = 0.0, most: float = math.inf, whole: bool = False) -> DataFrame:
    """docs, each row as often as its rate says.

    Texts are read twice (to fit, then to copy).  Only documents of more than TOGETHER copies are shuffled, as one row for
    that many copies, so that no task writes all the copies of one; they are read once more, where there are any.
    """
    names = tuple(targets)
    model = domain_classifier(labelled, names, text_col, domain_col, id_col)
    columns = docs.columns
    members = checkpointed(with_posteriors(pick(docs, text=text_col), model).drop("text"))
    fit = fitted(members, tuple(targets.values()), least, most, whole)
    flat = with_posteriors(docs.toDF(*[f"c{i}" for i in range(len(columns))]), model, f"c{columns.index(text_col)}")
    times = copies(fit.rate(), F.col(f"c{columns.index(id_col)}"))
    flat = flat.withColumn("mix_times", times).drop("mix_tokens", "mix_p")
    few = flat.withColumn("mix_copy", F.explode(F.array_repeat(F.lit(1), F.when(F.col("mix_times") <= TOGETHER, F.col("mix_times")).otherwise(0))))
    out = few.drop("mix_times", "mix_copy")
    if (members.agg(F.max(fit.rate())).first()[0] or 0.0) > TOGETHER - 1:
        first = F.explode(F.sequence(F.lit(0), F.col("mix_times") - 1, F.lit(TOGETHER)))
        many = flat.where(F.col("mix_times") > TOGETHER).withColumn("mix_first", first).repartition(F.xxhash64(f"c{columns.index(id_col)}", "mix_first"))
        here = F.least(F.lit(TOGETHER), F.col("mix_times") - F.col("mix_first"))
        out = out.union(many.withColumn("mix_copy", F.explode(F.array_repeat(F.lit(1), here))).drop("mix_times", "mix_first", "mix_copy"))
    return out.toDF(*columns)
