"""Quality rules as a learned decision list.

Text statistics come from one pass over the scan.  Sequential covering grows conjunctions of thresholds on a
part of the labelled rows (FOIL's gain) and prunes them on the rest; the list is applied as one ordered Spark
conditional expression over the statistics, which says which rule decided.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundaflow.llm.shared import arrow_map, checkpointed, pick

#: Labelled rows that the driver learns from at most: those of the smallest share of hashes.
MAX_LABELLED = 20_000
MAX_CONDITIONS = 4
MAX_RULES = 24
#: A rule is kept if it covers so many rows of the pruning part, and so large a share of them is to be rejected.
MIN_COVER = 5
MIN_PRECISION = 0.98

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper", "n_digits", "n_marks", "n_lines", "longest")
_BLANK, _SYMBOLS, _UPPER, _DIGITS, _MARKS = b" \t\n\r\x0b\x0c", b"#*$%&|<>", bytes(range(65, 91)), bytes(range(48, 58)), b"!?"


def repeated_words(words: list[bytes], window: int = 3) -> tuple[int, int]:
    """Words inside windows that occur twice or more, the first included; distinct words."""
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    n = len(a) - window + 1
    if n < 2:
        return 0, len(ids)
    code = a[:n]
    for k in range(1, window):
        code = code * len(ids) + a[k : k + n]
        if k < window - 1 and len(ids) > 1_000_000:
            code = np.unique(code, return_inverse=True)[1]
    _, place, count = np.unique(code, return_inverse=True, return_counts=True)
    twice = count[place] > 1
    inside = np.zeros(len(a), bool)
    for k in range(window):
        inside[k : k + n] |= twice
    return int(inside.sum()), len(ids)


def statistics(text: str) -> tuple[int, ...]:
    """COUNTS of a text; words are runs of other than ASCII white space, characters are code points."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeat, distinct = repeated_words(words)
    return (
        len(words), len(text) - without(_BLANK), without(_SYMBOLS), len(lines) - len(set(lines)), repeat, distinct, without(_UPPER),
        without(_DIGITS), without(_MARKS), len(lines), max(map(len, words), default=0),
    )


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col and COUNTS.  A null text has none of anything."""
    source = pick(docs, _id=id_col, _text=text_col)
    kind = source.schema["_id"].dataType.simpleString()

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [statistics(t or "") for t in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], names=[id_col, *COUNTS])

    return arrow_map(source, count, f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in COUNTS), rows=1000)


def ratios() -> dict[str, Column]:
    """What rules speak of; 0 where the base is 0."""
    share = lambda x, of: F.coalesce(F.try_divide(F.col(x).cast("double"), F.col(of).cast("double")), F.lit(0.0))
    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "upper_share": share("n_upper", "word_chars"),
        "digit_share": share("n_digits", "word_chars"),
        "mark_share": share("n_marks", "word_chars"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "distinct_share": share("n_distinct", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "word_length": share("word_chars", "n_words"),
        "words_per_line": share("n_words", "n_lines"),
        "n_words": F.col("n_words").cast("double"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.cut if self.above else x[self.feature] <= self.cut

    def column(self) -> Column:
        return F.col(self.feature) > F.lit(self.cut) if self.above else F.col(self.feature) <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for c in rule:
        out &= c.mask(x)
    return out


def best_condition(x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, Condition] | None:
    """The threshold of the greatest FOIL gain over all rows given; cuts lie midway between neighbours."""
    p0, n0 = int(bad.sum()), int((~bad).sum())
    if not p0 or not n0:
        return None
    best, before = None, np.log2(p0 / (p0 + n0))
    for name in x:
        order = np.argsort(x[name], kind="stable")
        v, b = x[name][order], bad[order]
        edge = np.flatnonzero(v[1:] > v[:-1])
        if not len(edge):
            continue
        p, n = np.cumsum(b)[edge], np.cumsum(~b)[edge]
        for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - before), -1.0)
            k = int(np.argmax(gain))
            if gain[k] > 1e-9 and (best is None or gain[k] > best[0] + 1e-9):
                best = float(gain[k]), Condition(name, above, float((v[edge[k]] + v[edge[k] + 1]) / 2))
    return best


def grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    rule: Rule = ()
    while len(rule) < MAX_CONDITIONS:
        inside = covers(rule, x)
        found = best_condition({k: v[inside] for k, v in x.items()}, bad[inside])
        if found is None:
            break
        rule = (*rule, found[1])
    return rule


def prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The beginning of the rule that is worth most, (p - n) / (p + n), on the pruning part; the shorter one on ties."""
    best, worth = rule, -2.0
    for k in range(1, len(rule) + 1):
        inside = covers(rule[:k], x)
        p, n = int((bad & inside).sum()), int((~bad & inside).sum())
        value = (p - n) / (p + n) if p + n else -1.0
        if value > worth + 1e-9:
            best, worth = rule[:k], value
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, seed: int = 7) -> list[Rule]:
    """Sequential covering: rules for the rows to reject, in order, until none good enough is found."""
    rules: list[Rule] = []
    if not len(bad):
        return rules
    part = np.random.default_rng(seed).random(len(bad)) < 2 / 3
    open_rows = np.ones(len(bad), bool)
    while len(rules) < MAX_RULES:
        g, q = open_rows & part, open_rows & ~part
        if bad[g].sum() < MIN_COVER:
            break
        rule = grow({k: v[g] for k, v in x.items()}, bad[g])
        if not rule:
            break
        pruning = {k: v[q] for k, v in x.items()}
        rule = prune(rule, pruning, bad[q])
        inside = covers(rule, pruning)
        p, n = int((bad[q] & inside).sum()), int((~bad[q] & inside).sum())
        if p < MIN_COVER or p < MIN_PRECISION * (p + n):
            break
        rules.append(rule)
        open_rows &= ~covers(rule, x)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that applies (from 1), or null: one ordered conditional expression."""
    if not rules:
        return F.lit(None).cast("int")
    out: Column | None = None
    for k, rule in enumerate(rules, 1):
        test = rule[0].column()
        for c in rule[1:]:
            test &= c.column()
        out = F.when(test, F.lit(k)) if out is None else out.when(test, F.lit(k))
    return out


def labelled_sample(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
                    most: int = MAX_LABELLED) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Ratios and labels (0: reject) of about `most` labelled rows at most, chosen by hash; rows failing the base are left out."""
    given = pick(labels, _key=id_col, _label=label_col).where(F.col("_label").isNotNull() & F.col("_key").isNotNull())
    total = given.count()
    if total > most:
        given = given.where(F.pmod(F.xxhash64("_key", F.lit("rules")), F.lit(1 << 30)) < F.lit(int((1 << 30) * most / total)))
    features = ratios()
    rows = stats.where(~F.col("base_failed")).join(given, F.col(id_col) == given["_key"]).select("_label", *[c.alias(k) for k, c in features.items()])
    data = rows.orderBy(*rows.columns).toPandas()  # bounded by `most`; ordered, so that the list is the same whatever the partitions
    return {k: data[k].to_numpy(float) for k in features}, (data["_label"].to_numpy() == 0) if len(data) else np.zeros(0, bool)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                  most: int = MAX_LABELLED) -> tuple[DataFrame, list[Rule]]:
    """(one row per row of docs, the rules): id_col, COUNTS, base_failed, rule (number of the rule that rejects, or null), kept.

    base_failed: fewer than 50 words, or more than half of the words inside repeated windows.  kept: neither
    base_failed nor rejected by a rule.  A null or empty text fails the base.  Rows whose label or id is null
    are not learned from; without any label no rule is learned and the base decides alone.  Repeated rows and
    null ids are judged like any other; columns other than the named ones are ignored.
    """
    failed = (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))
    stats = checkpointed(text_statistics(docs, id_col, text_col).withColumn("base_failed", failed))
    rules = learn(*labelled_sample(stats, labels, id_col, label_col, most))
    judged = stats.withColumns({f"r_{k}": c for k, c in ratios().items()})
    named = [tuple(Condition(f"r_{c.feature}", c.above, c.cut) for c in rule) for rule in rules]
    out = judged.withColumn("rule", verdict(named)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    return out.select(f"`{id_col}`", *COUNTS, "base_failed", "rule", "kept"), rules
