"""Which filings to discover, fetch and parse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fundaflow.config import FormLimits
from fundaflow.functions.text import archive_url, form_allowed, form_names, normalize_cik
from fundaflow.sources.ledger import event_rows
from fundaflow.sources.tables import new_rows

ANNUAL_FORMS = ("10-K", "10-K/A")
QUARTERLY_FORMS = ("10-Q", "10-Q/A")


def discover_filings(submissions: DataFrame, forms: str, limit: int) -> DataFrame:
    """First `limit` allowed filings of each issuer in submission order, with their document URL."""
    allowed = submissions.filter((F.col("accession_number") != "") & form_allowed(F.col("form"), forms))
    in_order = W.partitionBy("cik").orderBy("pos")
    return (
        allowed.withColumn("rn", F.row_number().over(in_order))
        .filter(F.col("rn") <= limit)
        .drop("rn")
        .withColumn("source_url", archive_url(F.col("cik"), F.col("accession_number"), F.col("primary_document")))
    )


def new_filings(discovered: DataFrame, stored: DataFrame) -> DataFrame:
    return new_rows(stored, discovered, ["accession_number"])


def ingest_groups(limits: FormLimits) -> list[tuple[str, list[str] | None, int | None]]:
    """(group, forms, limit); one group without filter when the list has a wildcard."""
    if not limits.forms.replace(",", "").strip():
        return []
    names = form_names(limits.forms)
    if names is None:
        both = None if limits.annual is None or limits.quarterly is None else limits.annual + limits.quarterly
        total = both if limits.other == 0 else limits.other
        return [("all", None, total)] if total != 0 else []
    rest = [n for n in names if n not in ANNUAL_FORMS + QUARTERLY_FORMS]
    groups = [
        ("annual", [f for f in ANNUAL_FORMS if f in names], limits.annual),
        ("quarterly", [f for f in QUARTERLY_FORMS if f in names], limits.quarterly),
        ("other", rest, limits.other),
    ]
    return [g for g in groups if g[1] and (g[2] is None or g[2] > 0)]


def select_filings_by_group(filings: DataFrame, limits: FormLimits) -> DataFrame:
    """Newest filings of each issuer and form group, all of a group without a limit; each accession once."""
    groups = ingest_groups(limits)
    label, cap = F.lit(None).cast("string"), F.lit(0)
    for name, forms, n in reversed(groups):
        hit = F.lit(True) if forms is None else F.upper(F.trim("form")).isin(forms)
        label, cap = F.when(hit, F.lit(name)).otherwise(label), F.when(hit, F.lit(n).cast("int")).otherwise(cap)
    newest = W.partitionBy("cik", "form_group").orderBy(F.col("filing_date").desc(), F.col("accepted_at").desc(), "accession_number")
    rows = (
        filings.withColumn("form_group", label)
        .withColumn("group_limit", cap)
        .filter(F.col("form_group").isNotNull())
        .withColumn("group_rank", F.row_number().over(newest))
    )
    if all(n is not None for _, _, n in groups):
        # constant bound: lets Spark limit groups before the shuffle
        rows = rows.filter(F.col("group_rank") <= max((n for _, _, n in groups), default=0))
    kept = F.col("group_limit").isNull() | (F.col("group_rank") <= F.col("group_limit"))
    return rows.filter(kept).drop("group_limit").dropDuplicates(["accession_number"])


FILING_SEEN_FIELDS = ["cik", "accession_number", "form", "filing_date", "accepted_at", "primary_document", "source_url"]


def filing_seen(emitted: DataFrame, created_at: Column) -> DataFrame:
    """One ledger event per emitted filing, whether it was stored before or not."""
    return event_rows(emitted, "filing_seen", FILING_SEEN_FIELDS, created_at)


def _newest_first() -> list[Column]:
    return [F.col("filing_date").desc(), F.col("accepted_at").desc(), F.col("accession_number").asc()]


def pending_filings(filings: DataFrame, accession: str = "", cik: str = "", forms: str = "*", limit: int | None = None) -> DataFrame:
    """Filings whose index or named primary document has not been fetched; a named accession is always pending."""
    if accession:
        rows = filings.filter(F.col("accession_number") == accession)
    else:
        primary = F.coalesce("primary_document", F.lit("")) != ""
        rows = filings.filter(F.col("raw_index_uri").isNull() | (primary & F.col("raw_primary_uri").isNull()))
        if cik:
            rows = rows.filter(F.col("cik") == normalize_cik(F.lit(cik)))
    rows = rows.filter(form_allowed(F.col("form"), forms))
    return rows if limit is None else rows.orderBy(*_newest_first()).limit(limit)


def latest_fetched(filings: DataFrame, cik: str = "", forms: str = "*") -> DataFrame:
    """Newest fetched filing, optionally of one issuer."""
    rows = filings.filter(F.col("raw_index_uri").isNotNull() & form_allowed(F.col("form"), forms))
    if cik:
        rows = rows.filter(F.col("cik") == normalize_cik(F.lit(cik)))
    return rows.orderBy(*_newest_first()).limit(1)


def package_hash(files: DataFrame) -> DataFrame:
    """Hash of each package: the hashes of its files joined by newlines, index first, then by name.

    A package is one filing; its file list is bounded by the index that names it.
    """
    order = F.struct((F.col("name") != "index.json").alias("later"), "name", "sha256")
    listed = files.groupBy("accession_number").agg(F.array_sort(F.collect_set(order)).alias("files"))
    return listed.select("accession_number", F.sha2(F.array_join("files.sha256", "\n"), 256).alias("package_sha256"))
