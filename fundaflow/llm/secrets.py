"""Secret scans: fixed patterns, and a battery of randomness tests under false-discovery control.

Built-in column functions only, as maps over the scan.  A candidate is a long run of code-like characters.
Its encoding is inferred, which gives an alphabet; three tests ask whether its characters could be drawn
uniformly from that alphabet (chi-squared, runs about the middle, serial correlation).  A second p-value asks
how likely running text is to give a string of that length that looks so random (evenness of the characters,
changes of character class); it shrinks with length, so short strings need more.  Candidates count as secrets
if the battery does not reject randomness and the second p-value passes Benjamini-Hochberg over all
candidates of the corpus.  The threshold comes from a histogram of at most BINS rows, not from the candidates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundaflow.llm.shared import pick

#: Patterns, and the least length of what counts: of group 2, or of the whole match.  Fixed values, in the order of kinds.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # AKIA[A-Z0-9]+ of 16 characters or more: shorter runs hold no longer one
HEX = r"[0-9a-f]{32,}"  # runs of 32 or more
ASSIGN_LEAST = 8
#: Candidates of the battery.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"

#: Rejecting randomness: the battery's level, divided by its three tests.
ALPHA = 0.001
#: False-discovery rate.
FDR = 0.001
#: Running text: chance that two letters agree, chance that three do, chance that the class changes at a character.
TEXT_PAIRS, TEXT_TRIPLES, TEXT_SWITCH = 0.066, 0.0056, 0.08
BINS = 4000  # of 0.1 in -log10 p
MASK = "[SECRET]"
_BLOCK = 256

_ALPHABETS = {
    10: "0123456789",
    16: "0123456789abcdef",
    26: "abcdefghijklmnopqrstuvwxyz",
    32: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    36: "0123456789abcdefghijklmnopqrstuvwxyz",
    64: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def _sum(a: Column, kind: str = "double") -> Column:
    return F.aggregate(a, F.lit(0).cast(kind), lambda x, y: x + y)


def running(a: Column) -> Column:
    """Sums of all earlier elements, for each element of an array of long; in blocks, so that long arrays stay cheap."""
    n = F.size(a)

    def prefix(x: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<bigint>").alias("out"))
        step = lambda s, y: F.struct((s["at"] + y).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(x, start, step, lambda s: s["out"])

    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / F.lit(_BLOCK)).cast("int")), lambda b: F.slice(a, b * _BLOCK + 1, F.lit(_BLOCK)))
    totals = prefix(F.transform(blocks, lambda x: _sum(x, "long")), F.lit(0).cast("long"))
    done = F.flatten(F.zip_with(blocks, totals, lambda x, t: prefix(x, t)))
    return F.when(n > 0, done).otherwise(F.array().cast("array<bigint>"))


def found(text: Column, pattern: str) -> Column:
    """array(struct(s, start, end)): leftmost matches that do not overlap, in code points, end exclusive."""
    parts = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("s"),
        F.transform(F.split(text, pattern, -1), lambda p: F.length(p).cast("long")).alias("gap"),
    )

    def spans(p: Column) -> Column:
        size = F.transform(p["s"], lambda s: F.length(s).cast("long"))
        # a match starts after its own gap and all gaps and matches before it
        step = F.zip_with(F.slice(p["gap"], F.lit(2), F.size(p["s"])), size, lambda g, m: g + m)
        first = F.element_at(p["gap"], 1)
        start = F.transform(running(step), lambda x: x + first)
        both = F.zip_with(p["s"], start, lambda s, x: F.struct(s.alias("s"), x.alias("start")))
        return F.transform(both, lambda x: F.struct(x["s"].alias("s"), x["start"].alias("start"), (x["start"] + F.length(x["s"])).alias("end")))

    none = F.array().cast("array<struct<s:string,start:bigint,end:bigint>>")
    return F.when(text.rlike(pattern), F.transform(F.array(parts), spans)[0]).otherwise(none)


def assigned(s: Column) -> Column:
    return F.length(F.regexp_extract(s, ASSIGN, 2)) >= ASSIGN_LEAST


def _upper_tail_ln(z: Column) -> Column:
    """ln of the normal upper tail (Abramowitz and Stegun 26.2.17), for any z."""
    x = F.abs(z)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * x)
    poly = t * (F.lit(0.319381530) + t * (F.lit(-0.356563782) + t * (F.lit(1.781477937) + t * (F.lit(-1.821255978) + t * F.lit(1.330274429)))))
    ln = -x * x / F.lit(2.0) - F.lit(0.9189385332046727) + F.ln(poly)
    return F.when(z >= 0, ln).otherwise(F.ln(F.lit(1.0) - F.exp(ln)))


def _with(name: str, value: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A step that adds a field to a struct: each value is worked out once and then referred to."""
    return lambda c: c.withField(name, value(c))


def battery(s: Column) -> Column:
    """struct(random, ln_p, ...) for one candidate string."""

    def alphabet(k: Column) -> Column:
        out = F.lit(_ALPHABETS[64])
        for size, letters in _ALPHABETS.items():
            out = F.when(k == size, F.lit(letters)).otherwise(out)
        return out

    core = F.rtrim(s, F.lit("="))
    size = (
        F.when(core.rlike("^[0-9]+$"), 10).when(core.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), 16).when(core.rlike("^(?:[A-Za-z]?[a-z]+|[A-Z]+)$"), 26)
        .when(core.rlike("^[A-Z2-7]+$"), 32).when(core.rlike("^(?:[a-z0-9]+|[A-Z0-9]+)$"), 36).otherwise(64)
    )
    folded = lambda c: F.when(c["k"] == 64, F.translate(c["core"], "-_", "+/")).when(c["k"] == 32, c["core"]).otherwise(F.lower(c["core"]))
    d = lambda c: c.cast("double")
    squeeze = lambda c, *classes: squeeze(F.regexp_replace(c, f"[{classes[0]}]+", F.lit(classes[0][-1])), *classes[1:]) if classes else c

    def mean_runs(c: Column) -> Column:
        return F.lit(2.0) * c["ones"] * (c["n"] - c["ones"]) / c["n"] + F.lit(1.0)

    def z_runs(c: Column) -> Column:
        spread = (c["mu"] - 1) * (c["mu"] - 2) / (c["n"] - 1)
        return F.when(spread > 0, (c["runs"] - c["mu"]) / F.sqrt(spread)).otherwise(F.lit(99.0))

    def z_serial(c: Column) -> Column:
        below = c["n"] * c["v2"] - c["v1"] * c["v1"]
        r = (c["n"] * c["lag"] - c["v1"] * c["v1"]) / below
        return F.when(below > 0, (r + F.lit(1.0) / (c["n"] - 1)) * F.sqrt(c["n"] - 2)).otherwise(F.lit(99.0))

    def z_chi(c: Column) -> Column:
        df = d(c["k"]) - 1
        chi = d(c["k"]) / c["n"] * c["c2"] - c["n"]
        w = F.lit(2.0) / (F.lit(9.0) * df)
        return (F.cbrt(chi / df) - (F.lit(1.0) - w)) / F.sqrt(w)

    def z_even(c: Column) -> Column:
        """Standard errors below the share of agreeing pairs that running text has."""
        share = (c["c2"] - c["n"]) / (c["n"] * (c["n"] - 1))
        spread = F.lit(2 * TEXT_PAIRS * (1 - TEXT_PAIRS)) / (c["n"] * (c["n"] - 1)) + F.lit(4 * (TEXT_TRIPLES - TEXT_PAIRS**2)) / c["n"]
        return (F.lit(TEXT_PAIRS) - share) / F.sqrt(spread)

    def z_switch(c: Column) -> Column:
        m = c["n"] - 1
        return (c["switches"] - m * F.lit(TEXT_SWITCH)) / F.sqrt(m * F.lit(TEXT_SWITCH * (1 - TEXT_SWITCH)))

    def fisher(c: Column) -> Column:
        """ln p of -(ln p1 + ln p2), chi-squared with four degrees of freedom."""
        x = -(_upper_tail_ln(c["z_even"]) + _upper_tail_ln(c["z_switch"]))
        return -x + F.ln(F.lit(1.0) + x)

    steps = [
        _with("folded", folded),
        _with("letters", lambda c: alphabet(c["k"])),
        _with("v", lambda c: F.transform(F.split(c["folded"], ""), lambda x: d(F.instr(c["letters"], x)) - 1)),
        _with("n", lambda c: d(F.size(c["v"]))),
        _with("c2", lambda c: _sum(F.transform(F.split(c["letters"], ""), lambda x: F.pow(c["n"] - F.length(F.replace(c["folded"], x, F.lit(""))), F.lit(2.0))))),
        _with("v1", lambda c: _sum(c["v"])),
        _with("v2", lambda c: _sum(F.transform(c["v"], lambda x: x * x))),
        _with("lag", lambda c: _sum(F.zip_with(c["v"], F.concat(F.slice(c["v"], F.lit(2), F.size(c["v"]) - 1), F.slice(c["v"], 1, 1)), lambda x, y: x * y))),
        _with("bits", lambda c: F.array_join(F.transform(c["v"], lambda x: F.when(x * 2 >= c["k"], F.lit("1")).otherwise(F.lit("0"))), "")),
        _with("ones", lambda c: d(F.length(F.replace(c["bits"], F.lit("0"), F.lit(""))))),
        _with("runs", lambda c: d(F.length(squeeze(c["bits"], "0", "1")))),
        _with("switches", lambda c: d(F.length(squeeze(c["core"], "a-z", "A-Z", "0-9", "+/_\\-"))) - 1),
        _with("mu", mean_runs),
        _with("z_chi", z_chi),
        _with("z_runs", z_runs),
        _with("z_serial", z_serial),
        _with("z_even", z_even),
        _with("z_switch", z_switch),
        _with("ln_p", fisher),
    ]
    cur = F.array(F.struct(core.alias("core"), size.alias("k")))
    for step in steps:
        cur = F.transform(cur, step)
    limit = 3.59  # two-sided ALPHA / 3

    def verdict(c: Column) -> Column:
        uniform = (F.abs(c["z_chi"]) <= limit) & (F.abs(c["z_runs"]) <= limit) & (F.abs(c["z_serial"]) <= limit)
        return F.struct(
            c["k"].alias("k"), ((c["k"] != 10) & uniform).alias("random"), c["ln_p"].alias("ln_p"), c["z_chi"].alias("z_chi"),
            c["z_runs"].alias("z_runs"), c["z_serial"].alias("z_serial"),
        )

    return F.transform(cur, verdict)[0]


def _bin(ln_p: Column) -> Column:
    return F.least(F.lit(BINS - 1), F.floor(-ln_p / F.lit(0.1 * 2.302585092994046)).cast("int"))


def discovery_bin(texts: DataFrame, rate: float = FDR) -> int:
    """The lowest bin of -log10 p (tenths) that passes Benjamini-Hochberg over all candidates; BINS if none does.

    A bin's largest p stands for all in it, which errs on the side of fewer findings.
    """
    one = texts.where(F.col("text").rlike(CANDIDATE)).select(F.explode(F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).alias("s"))
    tested = one.select(battery(F.col("s")).alias("b")).groupBy(_bin(F.col("b.ln_p")).alias("bin")).count()
    counts = {int(r["bin"]): int(r["count"]) for r in tested.collect()}  # at most BINS rows
    total, seen, lowest = sum(counts.values()), 0, BINS
    for b in sorted(counts, reverse=True):
        seen += counts[b]
        if 10 ** (-b / 10) <= rate * seen / total:
            lowest = b
    return lowest


def _is_secret(s: Column, lowest: int) -> Column:
    return F.transform(F.array(battery(s)), lambda b: b["random"] & (_bin(b["ln_p"]) >= lowest))[0]


def _cases(lowest: int) -> list[tuple[int, str, Callable[[Column], Column] | None]]:
    return [(0, ASSIGN, assigned), (1, ACCESS, None), (2, HEX, None), (3, CANDIDATE, lambda s: _is_secret(s, lowest))]


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = FDR) -> DataFrame:
    """One row per row of docs: id_col and spans, array(struct(start, kind, end)) ordered by start, then kind (its number in KINDS).

    Base kinds follow their patterns; `random` is what the battery finds, also inside base spans.  Null and
    empty texts have no spans; null ids and repeated rows pass through; other columns are ignored; an empty
    table gives an empty table.  Numbers alone are never a finding.
    """
    source = pick(docs, doc=id_col, text=text_col).select("doc", F.coalesce("text", F.lit("")).alias("text"))
    lowest = discovery_bin(source, rate)

    def kind(no: int, pattern: str, test: Callable[[Column], Column] | None) -> Column:
        all_of = found(F.col("text"), pattern)
        kept = F.filter(all_of, lambda m: test(m["s"])) if test else all_of
        return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(no).alias("kind"), m["end"].alias("end")))

    return source.select(F.col("doc").alias(id_col), F.sort_array(F.concat(*[kind(*c) for c in _cases(lowest)])).alias("spans"))


def spans_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", F.element_at(names, m["kind"] + 1), m["start"], m["end"])), ",")


def digests(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the hash of the base spans, and all spans as text."""
    count = lambda no: F.size(F.filter("spans", lambda m: m["kind"] == no)).cast("long")
    return spans.select(
        id_col, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(spans_text(F.filter("spans", lambda m: m["kind"] < 3)), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"),
        count(3).alias("n_random"),
    )


def masked(docs: DataFrame, text_col: str = "text", rate: float = FDR) -> DataFrame:
    """docs with every secret in text_col replaced by MASK; all other columns and rows as they are, null texts stay null.

    Kinds are masked one after the other, so a secret inside an assignment goes with it.
    """
    columns = docs.columns
    at = f"c{columns.index(text_col)}"
    flat = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    lowest = discovery_bin(flat.select(F.coalesce(at, F.lit("")).alias("text")), rate)

    def mask(text: Column, pattern: str, test: Callable[[Column], Column] | None) -> Column:
        hits = F.concat(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array(F.lit("")))
        put = lambda m: F.when(m == "", m).when(test(m), F.lit(MASK)).otherwise(m) if test else F.when(m == "", m).otherwise(F.lit(MASK))
        pairs = F.zip_with(F.split(text, pattern, -1), hits, lambda gap, m: F.concat(gap, put(m)))
        return F.when(text.rlike(pattern), F.array_join(pairs, "")).otherwise(text)

    for _, pattern, test in _cases(lowest):
        flat = flat.withColumn(at, mask(F.col(at), pattern, test))
    return flat.toDF(*columns)
