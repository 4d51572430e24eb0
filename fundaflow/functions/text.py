"""Identifier, name and unit normalizers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fundaflow import vocab


def normalize_cik(c: Column) -> Column:
    """Digits only, last ten of them, padded with zeros to ten."""
    return F.lpad(F.right(F.regexp_replace(c, "[^0-9]", ""), F.lit(10)), 10, "0")


def security_id_of(cik: Column) -> Column:
    return normalize_cik(cik).cast("long")


def slug(c: Column) -> Column:
    """ASCII letters and digits lower-cased, every other run one underscore, none at the ends."""
    return F.lower(F.btrim(F.regexp_replace(c, "[^0-9A-Za-z]+", "_"), F.lit("_")))


def unclassified(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("unclassified"))


def form_names(forms: str) -> list[str] | None:
    """Parse a comma list of form names; None stands for "no filter"."""
    names = sorted({f.strip().upper() for f in forms.split(",") if f.strip()})
    if "*" in names or "ALL" in names:
        return None
    return names


def form_allowed(c: Column, forms: str) -> Column:
    """True where the form is in the list.  Any wildcard in the list disables the filter."""
    names = form_names(forms)
    if names is None:
        return F.lit(True)
    if not names:
        return F.lit(False)
    return F.upper(F.trim(c)).isin(names)


def qname_prefix(c: Column) -> Column:
    return F.when(c.contains(":"), F.substring_index(c, ":", 1)).otherwise(F.lit(""))


def qname_local(c: Column) -> Column:
    """Everything after the first colon, or the whole name."""
    return F.when(c.contains(":"), F.regexp_replace(c, "^[^:]*:", "")).otherwise(c)


def taxonomy_of(namespace: Column) -> Column:
    return F.when(namespace.contains("us-gaap"), F.lit("us-gaap")).when(
        namespace.contains("xbrl.sec.gov/dei"), F.lit("dei")
    )


def normalize_unit(measure: Column) -> Column:
    m = F.trim(measure)
    return (
        F.when(m.isin("xbrli:shares", "shares"), F.lit("shares"))
        .when(m.contains("USD"), F.lit("USD"))
        .otherwise(m)
    )


def unit_signature(measures: Column) -> Column:
    """The first measure only; a unit without measures is `unknown`."""
    return F.coalesce(
        F.when(F.size(measures) > 0, normalize_unit(F.try_element_at(measures, F.lit(1)))),
        F.lit("unknown"),
    )


def archive_url(cik: Column, accession: Column, document: Column | None = None) -> Column:
    """Folder by integer issuer id and undashed accession; the index page when no document is named."""
    doc = F.lit("") if document is None else F.coalesce(document, F.lit(""))
    return F.concat_ws(
        "/",
        F.lit(vocab.ARCHIVE_BASE_URL),
        normalize_cik(cik).cast("long").cast("string"),
        F.replace(accession, F.lit("-"), F.lit("")),
        F.when(doc == "", F.lit("index.json")).otherwise(doc),
    )


def is_safe_relative_path(name: Column) -> Column:
    return (name != "") & ~name.startswith("/") & ~name.rlike(r"(^|/)\.\.(/|$)")


def is_package_artefact(name: Column, primary: Column) -> Column:
    """Instance, schema and primary files; html only while no primary document is known."""
    lower, main = F.lower(name), F.coalesce(primary, F.lit(""))
    wanted = (
        (name == main)
        | lower.endswith(".xml")
        | lower.endswith(".xsd")
        | ((main == "") & (lower.endswith(".htm") | lower.endswith(".html")))
    )
    return F.coalesce(is_safe_relative_path(name) & wanted, F.lit(False))


def artefact_kind(name: Column, primary: Column, has_extracted_instance: Column) -> Column:
    lower = F.lower(name)
    html = lower.endswith(".htm") | lower.endswith(".html")
    return (
        F.when(name == "index.json", F.lit("sec_archive_index"))
        .when(html & has_extracted_instance & (name == F.coalesce(primary, F.lit(""))), F.lit("primary_document"))
        .when(html, F.lit("inline_xbrl"))
        .when(lower.endswith(".xsd"), F.lit("xbrl_schema"))
        .when(lower.rlike("_(lab|pre|def|cal)[.]xml$"), F.lit("xbrl_linkbase"))
        .when(lower.isin("filingsummary.xml", "metalinks.json"), F.lit("xbrl_report_metadata"))
        .otherwise(F.lit("xbrl_instance"))
    )


def code_of(c: Column, names: list[str]) -> Column:
    """Position of a name in a fixed vocabulary; unknown names map to 0."""
    return F.greatest(F.array_position(F.array(*[F.lit(n) for n in names]), c) - 1, F.lit(0)).cast("int")


def name_of(c: Column, names: list[str]) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(n) for n in names]), c.cast("int")), F.lit(names[0]))


def metric_name(metric_id: Column) -> Column:
    return name_of(metric_id, ["unknown"] + [vocab.METRICS[i][0] for i in sorted(vocab.METRICS)])


def metric_kind(metric_id: Column) -> Column:
    return name_of(metric_id, ["unknown"] + [vocab.METRICS[i][1] for i in sorted(vocab.METRICS)])
