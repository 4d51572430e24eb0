"""Quality classifier by hierarchical empirical Bayes.

A document classifier (logistic, over binned text statistics, trained on labelled rows) gives every document
its own log odds.  Grouped sums of its probabilities give posteriors of each host and each path of a host:
a path shrinks toward its host and a host toward the corpus, by weights that the variances between and within
groups give.  A document's own probability is taken out of its groups' sums before it is judged by them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundaflow.llm.rules import MAX_LABELLED, labelled_sample, ratios, text_statistics
from fundaflow.llm.shared import checkpointed, pick

BINS = 12
RIDGE = 1.0
ROUNDS = 40
#: Evidence is held to this many log odds, so that no statistic alone makes a site certain.
MOST_ODDS = 12.0
#: Bounds of the shrinkage weights, in documents.
LEAST_WEIGHT, MOST_WEIGHT = 5.0, 1e7


@dataclass(frozen=True)
class Evidence:
    """An additive classifier: per statistic, cuts and the log odds of the bins between them; a bin takes its upper cut."""

    intercept: float
    cuts: dict[str, tuple[float, ...]]
    weights: dict[str, tuple[float, ...]]

    def column(self, values: dict[str, Column]) -> Column:
        out = F.lit(self.intercept)
        for name, cuts in self.cuts.items():
            w = self.weights[name]
            part = F.lit(w[-1])
            for cut, weight in zip(cuts[::-1], w[-2::-1], strict=True):
                part = F.when(values[name] <= F.lit(cut), F.lit(weight)).otherwise(part)
            out = out + part
        return F.least(F.greatest(out, F.lit(-MOST_ODDS)), F.lit(MOST_ODDS))

    def of(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.full(len(next(iter(x.values()))), self.intercept)
        for name, cuts in self.cuts.items():
            out += np.array(self.weights[name])[np.searchsorted(np.array(cuts), x[name], side="left")]
        return np.clip(out, -MOST_ODDS, MOST_ODDS)


def fit(x: dict[str, np.ndarray], good: np.ndarray) -> Evidence:
    """Ridge logistic regression on bins, by Newton steps; no evidence at all unless both classes occur.

    Half of a statistic's cuts are quantiles of the good rows, half of the others, so that a rare class is
    resolved too.
    """
    if not len(good) or good.all() or not good.any():
        return Evidence(0.0, {}, {})
    cuts, blocks = {}, [np.ones((len(good), 1))]
    for name, v in x.items():
        at = np.linspace(0, 1, BINS // 2 + 2)[1:-1]
        # midway to the next value that occurs, so that ties fall into one bin
        values = np.unique(v)
        q = np.unique(np.concatenate([np.quantile(v[good], [0.01, *at, 0.99], method="lower"), np.quantile(v[~good], at, method="lower")]))
        q = q[q < values[-1]]
        q = (q + values[np.searchsorted(values, q, side="right")]) / 2
        cuts[name] = tuple(q.tolist())
        blocks.append(np.eye(len(q) + 1)[np.searchsorted(q, v, side="left")])
    a = np.hstack(blocks)
    b, ridge = np.zeros(a.shape[1]), np.full(a.shape[1], RIDGE)
    ridge[0] = 1e-6
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        g = a.T @ (good - p) - ridge * b
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge)
        step = np.linalg.solve(h, g)
        step *= min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
        b += step
        if np.abs(step).max() < 1e-8:
            break
    weights, at = {}, 1
    for name, q in cuts.items():
        weights[name] = tuple(b[at : at + len(q) + 1].tolist())
        at += len(q) + 1
    return Evidence(float(b[0]), cuts, weights)


def _shrinkage(groups: DataFrame, sums: str, squares: str, n: str, mean: Column) -> float:
    """Within-group variance over between-group variance, by moments; large where groups do not differ."""
    m = F.col(sums) / F.col(n)
    row = groups.agg(
        F.sum(n).alias("n"), F.count("*").alias("g"), F.sum(F.col(squares) - F.col(n) * m * m).alias("within"), F.sum(F.col(n) * (m - mean) ** 2).alias("between"),
    ).first()
    if not row["n"] or row["n"] <= row["g"]:
        return MOST_WEIGHT
    within = max(0.0, row["within"]) / (row["n"] - row["g"])
    between = (row["between"] - row["g"] * within) / row["n"]
    return MOST_WEIGHT if between <= 0 else min(MOST_WEIGHT, max(LEAST_WEIGHT, within / between))


def classified(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang",
               label_col: str = "quality", threshold: float = 0.5, most: int = MAX_LABELLED) -> DataFrame:
    """One row per row of docs: id_col, evidence (log odds), host_mean, path_mean, score, kept (score >= threshold).

    The classifier learns from at most about `most` labelled rows (label 0: bad, else good), chosen by hash;
    everything else is over all rows.  Without labels of both kinds there is no evidence and all documents are
    kept.  A text without words (null, empty, blank) has score 0 and does not count for its site.  Null hosts
    and null paths are a host and a path of their own; null ids and repeated rows are judged like any other;
    columns other than the named ones are ignored; an empty table gives an empty table.
    """
    # the statistics come from text alone; the key columns ride along in the id, so that rows are not joined back
    source = pick(docs, text=text_col, _id=id_col, _host=host_col, _path=path_col)
    packed = source.select(F.struct("_id", "_host", "_path").alias("row"), "text")
    stats = checkpointed(text_statistics(packed, "row", "text").select(F.col("row._id").alias("_id"), F.col("row._host").alias("host"), F.col("row._path").alias("path"), "*").drop("row"))
    features = ratios()
    data, bad = labelled_sample(stats.withColumn("base_failed", F.col("n_words") == 0).withColumnRenamed("_id", id_col), labels, id_col, label_col, most)
    model = fit(data, ~bad)
    odds = lambda p: F.ln(p / (F.lit(1.0) - p))
    worded = F.col("n_words") > 0
    judged = stats.select("_id", "host", "path", "n_words", model.column(features).alias("evidence")).withColumn("p", F.when(worded, F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("evidence")))))
    judged = judged.withColumn("one", worded.cast("long"))

    paths = checkpointed(
        judged.where(worded).groupBy("host", "path").agg(F.count("*").alias("path_n"), F.sum("p").alias("path_p"), F.sum(F.col("p") * F.col("p")).alias("path_q"))
    )
    hosts = checkpointed(paths.groupBy("host").agg(F.sum("path_n").alias("host_n"), F.sum("path_p").alias("host_p"), F.sum("path_q").alias("host_q")))
    whole = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_p").alias("p")).first()
    mean = min(1 - 1e-6, max(1e-6, whole["p"] / whole["n"])) if whole["n"] else 0.5
    weight_host = _shrinkage(hosts, "host_p", "host_q", "host_n", F.lit(mean))
    same = lambda a, b: a.eqNullSafe(b)
    h = hosts.withColumnRenamed("host", "of_host")
    placed = paths.join(h, same(paths["host"], h["of_host"])).select("host", "path", "path_n", "path_p", "path_q", "host_n", "host_p")
    weight_path = _shrinkage(placed, "path_p", "path_q", "path_n", F.col("host_p") / F.col("host_n"))

    site = placed.select(F.col("host").alias("site_host"), F.col("path").alias("site_path"), "path_n", "path_p", "host_n", "host_p")
    both = judged.join(site, same(judged["host"], site["site_host"]) & same(judged["path"], site["site_path"]), "left")
    others = lambda total, own: F.coalesce(total, F.lit(0)) - F.coalesce(own, F.lit(0))
    host_mean = (others(F.col("host_p"), F.col("p")) + F.lit(weight_host * mean)) / (others(F.col("host_n"), F.col("one")) + F.lit(weight_host))
    out = both.withColumn("host_mean", host_mean)
    path_mean = (others(F.col("path_p"), F.col("p")) + F.lit(weight_path) * F.col("host_mean")) / (others(F.col("path_n"), F.col("one")) + F.lit(weight_path))
    out = out.withColumn("path_mean", F.least(F.greatest(path_mean, F.lit(1e-6)), F.lit(1 - 1e-6)))
    total = F.col("evidence") + odds(F.col("path_mean")) - F.lit(float(np.log(mean / (1 - mean))))
    out = out.withColumn("score", F.when(worded, F.lit(1.0) / (F.lit(1.0) + F.exp(-total))).otherwise(F.lit(0.0)))
    return out.select(F.col("_id").alias(id_col), "evidence", "host_mean", "path_mean", "score", (F.col("score") >= threshold).alias("kept"))
