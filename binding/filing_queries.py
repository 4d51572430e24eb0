"""Filing discovery and XBRL corpus queries.

The corpus is written from all bound observations by string functions: one document per
issuer, quarter end and version, a later version being a later filing; the values of a
segment stand in a context of their own.  Issuers with key mod 5 = 0 file instances, the
others inline documents; even keys state fiscal metadata; key mod 3 = 0 adds a product
context; a few documents are cut short on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binding import testdata as t
from binding.registry import query
from binding.source_queries import filings
from binding.views import view
from fundaflow.config import FormLimits
from fundaflow.operators import discovery, xbrl
from fundaflow.sources import files

CONCEPT = {1: "Revenues", 2: "NetIncomeLoss", 3: "EarningsPerShareDiluted", 4: "WeightedAverageNumberOfDilutedSharesOutstanding",
           5: "NetCashProvidedByUsedInOperatingActivities", 6: "PaymentsToAcquirePropertyPlantAndEquipment",
           7: "CashAndCashEquivalentsAtCarryingValue", 8: "LongTermDebtCurrent", 9: "GrossProfit"}
#: Days from the period's end to the filing of each version; the version that tells of a segment.
FILED_AFTER = {1: 30, 2: 155, 3: 50, 4: 200, 5: 45}
SEGMENT_VERSION = 5
NAMESPACES = ('xmlns:xbrli="http://www.xbrl.org/2003/instance" xmlns:iso4217="http://www.xbrl.org/2003/iso4217" '
              'xmlns:us-gaap="http://fasb.org/us-gaap/2024" xmlns:dei="http://xbrl.sec.gov/dei/2024" '
              'xmlns:xbrldi="http://xbrl.org/2006/xbrldi" xmlns:ix="http://www.xbrl.org/2013/inlineXBRL"')


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def corpus(spark, d) -> DataFrame:
    """One document row per issuer, period end and version, with its bytes."""
    k = F.col("security_id") - 1
    finish = F.coalesce("raw_end_date", "raw_instant_date")
    version = F.substring_index("observation_id", "-", -1).cast("int")
    number = F.lpad((F.quarter("finish") + 10 * (F.col("version") - 1)).cast("string"), 6, "0")
    rows = t.wide_observations(spark, d).select(
        "security_id", "cik", F.regexp_replace("accession_number", "[0-9]{6}$", "").alias("start_of_number"), "metric_id",
        F.when(version == SEGMENT_VERSION, F.concat("period_semantics", F.lit("-segment"))).otherwise(F.col("period_semantics")).alias("ref"), "period_semantics",
        "raw_start_date", finish.alias("finish"), "value", version.alias("version"),
    ).withColumn("accession_number", F.concat("start_of_number", number)).drop("start_of_number")
    instance = k % 5 == 0
    concept = F.element_at(F.create_map(*[x for i, c in CONCEPT.items() for x in (F.lit(i), F.lit(c))]), F.col("metric_id"))
    metric, sem, ref = F.col("metric_id"), F.col("period_semantics"), F.col("ref")
    # in thousands where that loses nothing
    shares = (metric == 4) & (F.col("version") == 1)
    # six decimals by whole numbers, so that both engines write the same text where a half is to be rounded
    amount = F.expr("cast(cast(floor(value * 1000000D + 0.5D) as decimal(20,0)) * cast(0.000001 as decimal(6,6)) as decimal(38,6))").cast("string")
    thousands = F.format_number(F.col("value") / 1000.0, 0)
    unit = F.when(metric == 4, F.lit("u-shares")).when(metric == 3, F.lit("u-eps")).otherwise(F.lit("u-usd"))
    inline_fact = _text('<p><ix:nonFraction name="us-gaap:', concept, '" contextRef="', ref, '" unitRef="', unit, '" decimals="-3" scale="',
                        F.when(shares, "3").otherwise("0"), '">', F.when(shares, thousands).otherwise(amount), "</ix:nonFraction></p>")
    instance_fact = _text("<us-gaap:", concept, ' contextRef="', ref, '" unitRef="', unit, '">', amount, "</us-gaap:", concept, ">")

    def context(ident: Column | str, period: Column, segment: str = "") -> Column:
        return _text('<xbrli:context id="', ident, '"><xbrli:entity><xbrli:identifier scheme="cik">', F.col("cik"), "</xbrli:identifier>", segment,
                     "</xbrli:entity><xbrli:period>", period, "</xbrli:period></xbrli:context>")

    span = _text("<xbrli:startDate>", F.col("raw_start_date").cast("string"), "</xbrli:startDate><xbrli:endDate>", F.col("finish").cast("string"), "</xbrli:endDate>")
    point = _text("<xbrli:instant>", F.col("finish").cast("string"), "</xbrli:instant>")
    product = context("product", span, '<xbrli:segment><xbrldi:explicitMember dimension="srt:ProductOrServiceAxis">x:Gadgets</xbrldi:explicitMember>'
                      '<xbrldi:explicitMember dimension="dei:LegalEntityAxis">x:Sub</xbrldi:explicitMember></xbrli:segment>')
    period = F.when(sem == "instant", point).otherwise(span)
    region = '<xbrli:segment><xbrldi:explicitMember dimension="us-gaap:StatementGeographicalAxis">x:Region</xbrldi:explicitMember></xbrli:segment>'
    segment = F.col("version") == SEGMENT_VERSION
    docs = rows.withColumn("fact", F.when(instance, instance_fact).otherwise(inline_fact)).withColumn(
        "context", F.when(segment, context(ref, period, region)).otherwise(context(ref, period))
    ).withColumn("product", F.when((sem != "instant") & (k % 3 == 0) & (metric == 1) & ~segment, product)).withColumn(
        "product_fact", F.when(F.col("product").isNotNull(), F.when(instance, F.replace(instance_fact, _text('"', ref, '"'), F.lit('"product"'))).otherwise(
            F.replace(inline_fact, _text('contextRef="', ref, '"'), F.lit('contextRef="product"')))))
    # a document holds at most thirty facts, so the collected lists are small
    docs = docs.groupBy("security_id", "cik", "accession_number", "finish", "version").agg(
        F.array_sort(F.collect_set("context")).alias("contexts"), F.array_sort(F.collect_list("fact")).alias("facts"),
        F.max("product").alias("product"), F.max("product_fact").alias("product_fact"), F.min("ref").alias("any_context"))

    def dei(name: str, value: Column) -> Column:
        inline = _text(f'<ix:nonNumeric name="dei:{name}" contextRef="', F.col("any_context"), '">', value, "</ix:nonNumeric>")
        element = _text(f"<dei:{name}", ' contextRef="', F.col("any_context"), '">', value, f"</dei:{name}>")
        return F.when(k % 2 == 0, F.when(instance, element).otherwise(inline)).otherwise(F.lit(""))

    units = ('<xbrli:unit id="u-usd"><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit>'
             '<xbrli:unit id="u-shares"><xbrli:measure>xbrli:shares</xbrli:measure></xbrli:unit>'
             '<xbrli:unit id="u-eps"><xbrli:divide><xbrli:unitNumerator><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unitNumerator>'
             '<xbrli:unitDenominator><xbrli:measure>xbrli:shares</xbrli:measure></xbrli:unitDenominator></xbrli:divide></xbrli:unit>')
    body = _text(
        F.array_join("contexts", ""), F.coalesce("product", F.lit("")), units, F.array_join("facts", ""), F.coalesce("product_fact", F.lit("")),
        dei("DocumentFiscalYearFocus", F.year("finish").cast("string")),
        dei("DocumentFiscalPeriodFocus", F.concat(F.lit("Q"), F.quarter("finish").cast("string"))),
        dei("DocumentPeriodEndDate", F.col("finish").cast("string")))
    tag = F.when(instance, "xbrli:xbrl").otherwise("html")
    broken = (k % 10 == 7) & (F.quarter("finish") == 4)
    page = _text("<", tag, f" {NAMESPACES}>", body, F.when(broken, "").otherwise(_text("</", tag, ">")))
    name = F.when(instance, F.lit("report_ins.xml")).otherwise(F.lit("report.htm"))
    filed = F.date_add("finish", F.element_at(F.create_map(*[F.lit(x) for pair in FILED_AFTER.items() for x in pair]), F.col("version")))
    return docs.select(
        F.concat_ws("/", "accession_number", name).alias("doc_id"), "cik", "accession_number",
        F.when(instance, "xbrl_instance").otherwise("inline_xbrl").alias("document_kind"), F.lit("10-Q").alias("form"),
        filed.cast("string").alias("filed_at"), F.date_format(filed, "yyyy-MM-dd'T'16:30:00'Z'").alias("accepted_at"),
        name.alias("name"), page.cast("binary").alias("content"))


def parsed(spark, d) -> DataFrame:
    return xbrl.parse_documents(corpus(spark, d))


_FILED_SQL = "CASE ver " + " ".join(f"WHEN {v} THEN {n}" for v, n in FILED_AFTER.items()) + " END"
view("v_filed", f"""
SELECT * EXCLUDE (stem), stem || lpad(CAST(quarter(finish) + 10 * (ver - 1) AS VARCHAR), 6, '0') AS accession_number,
  period_semantics || CASE WHEN ver = {SEGMENT_VERSION} THEN '-segment' ELSE '' END AS ref, {_FILED_SQL} AS filed_after, floor(value * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS amount, NOT (k % 10 = 7 AND quarter(finish) = 4) AS readable
FROM (SELECT * EXCLUDE (accession_number), security_id - 1 AS k, coalesce(raw_end_date, raw_instant_date) AS finish, accession_number[:-7] AS stem,
  CAST(string_split(observation_id, '-')[-1] AS INTEGER) AS ver FROM v_observations)
""")
view("v_filed_contexts", f"""
SELECT DISTINCT accession_number, k, cik, finish, ref AS raw_context_id, period_semantics AS sem, raw_start_date, raw_end_date, raw_instant_date, duration_days AS days FROM v_filed WHERE readable
UNION ALL SELECT accession_number, k, cik, finish, 'product', period_semantics, raw_start_date, raw_end_date, raw_instant_date, duration_days FROM v_filed
  WHERE readable AND k % 3 = 0 AND metric_id = 1 AND ver <> {SEGMENT_VERSION} QUALIFY row_number() OVER (PARTITION BY accession_number ORDER BY raw_start_date) = 1
""")
view("v_assigned", """
SELECT *, CASE WHEN raw_instant_date IS NOT NULL THEN 'instant' WHEN k % 2 = 0 AND q > 1 AND days BETWEEN q * 70 AND q * 110 THEN 'fiscal_ytd' WHEN days >= 330 THEN 'fiscal_year'
    WHEN days BETWEEN 70 AND 110 THEN 'fiscal_quarter' ELSE 'irregular' END AS semantics,
  CASE WHEN raw_instant_date IS NOT NULL THEN NULL WHEN k % 2 = 0 AND ((q > 1 AND days BETWEEN q * 70 AND q * 110) OR days BETWEEN 70 AND 110) THEN 'Q' || q
    WHEN days BETWEEN 70 AND 110 THEN 'Q' || q END AS label
FROM (SELECT *, quarter(finish) AS q FROM v_filed_contexts)
""")


@query("xbrl_contexts", "C6", "accession_number:s raw_context_id:s entity_identifier:s raw_start_date:s raw_end_date:s raw_instant_date:s",
       "SELECT *, cik AS entity_identifier FROM v_filed_contexts")
def xbrl_contexts(spark, d):
    return xbrl.extract_contexts(parsed(spark, d))


@query("dimension_signatures", "C7", "dimensions_json:s scope_class:s axis_count:i dimensions_hash:s", """
SELECT '{}' AS dimensions_json, 'consolidated_total' AS scope_class, 0 AS axis_count, sha256('{}') AS dimensions_hash
UNION ALL SELECT j, 'segment', 1, sha256(j) FROM (SELECT '[{"dimension":"us-gaap:StatementGeographicalAxis","member":"x:Region"}]' AS j)
UNION ALL SELECT j, 'product', 2, sha256(j) FROM (SELECT '[{"dimension":"dei:LegalEntityAxis","member":"x:Sub"},{"dimension":"srt:ProductOrServiceAxis","member":"x:Gadgets"}]' AS j)
""")
def dimension_signatures(spark, d):
    return xbrl.dimension_signatures(xbrl.extract_contexts(parsed(spark, d)))


@query("xbrl_units", "C8", "accession_number:s raw_unit_id:s unit_signature:s", """
SELECT DISTINCT accession_number, u AS raw_unit_id, s AS unit_signature FROM v_filed, (VALUES ('u-usd', 'USD'), ('u-shares', 'shares'), ('u-eps', 'USD')) x(u, s) WHERE readable
""")
def xbrl_units(spark, d):
    return xbrl.extract_units(parsed(spark, d))


@query("fiscal_metadata", "C9", "accession_number:s fiscal_year:i fiscal_period:s ordinal:i document_end:s", """
SELECT DISTINCT accession_number, CASE WHEN k % 2 = 0 THEN year(finish) END AS fiscal_year, CASE WHEN k % 2 = 0 THEN 'Q' || quarter(finish) END AS fiscal_period,
  CASE WHEN k % 2 = 0 THEN quarter(finish) END AS ordinal, CASE WHEN k % 2 = 0 THEN finish END AS document_end FROM v_filed WHERE readable
""")
def fiscal_metadata(spark, d):
    return xbrl.fiscal_metadata(parsed(spark, d))


@query("assigned_periods", "C10", "accession_number:s raw_context_id:s period_semantics:s fiscal_year:i fiscal_period:s duration_days:i period_length_class:s", """
SELECT accession_number, raw_context_id, semantics AS period_semantics, year(finish) AS fiscal_year, label AS fiscal_period, CASE WHEN semantics = 'instant' THEN 0 ELSE days END AS duration_days,
  CASE WHEN semantics = 'instant' THEN 'instant' WHEN days BETWEEN 70 AND 110 THEN '13w' WHEN days BETWEEN 330 AND 380 THEN 'year' ELSE 'irregular' END AS period_length_class FROM v_assigned
""")
def assigned_periods(spark, d):
    return xbrl.extract_contexts(parsed(spark, d))


@query("reporting_period_dim", "C11", "accession_number:s period_id:s period_kind:s start_date_inclusive:s end_date_exclusive:s", """
SELECT DISTINCT accession_number, 'period-' || sha256('cik=' || cik || '|accession_number=' || accession_number || '|raw_start_date=' || coalesce(CAST(raw_start_date AS VARCHAR), '~') || '|raw_end_date=' || coalesce(CAST(raw_end_date AS VARCHAR), '~')
    || '|raw_instant_date=' || coalesce(CAST(raw_instant_date AS VARCHAR), '~') || '|period_semantics=' || semantics || '|fiscal_year=' || year(finish) || '|fiscal_period=' || coalesce(label, '~')) AS period_id,
  CASE WHEN semantics = 'instant' THEN 'instant' ELSE 'duration' END AS period_kind, CAST(coalesce(raw_start_date, raw_instant_date) AS VARCHAR) AS start_date_inclusive,
  CAST(coalesce(CAST(raw_end_date + 1 AS DATE), raw_instant_date) AS VARCHAR) AS end_date_exclusive FROM v_assigned
""")
def reporting_period_dim(spark, d):
    return xbrl.reporting_periods(xbrl.extract_contexts(parsed(spark, d)))


_CONCEPT_SQL = "CASE metric_id " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in CONCEPT.items()) + " END"
# the unit of earnings per share is a quotient, of which the first measure counts
_UNIT_SQL = "CASE metric_id WHEN 4 THEN 'shares' ELSE 'USD' END"
view("v_filed_facts", f"""
SELECT accession_number, k, finish, filed_after, 'us-gaap' AS taxonomy, {_CONCEPT_SQL} AS concept_local_name, ref AS raw_context_id, {_UNIT_SQL} AS unit_signature,
  amount AS value_decimal, NULL AS value_text FROM v_filed WHERE readable
UNION ALL SELECT f.accession_number, f.k, f.finish, filed_after, 'us-gaap', 'Revenues', 'product', 'USD', max(amount), NULL
  FROM v_filed f WHERE readable AND f.k % 3 = 0 AND metric_id = 1 AND ver <> {SEGMENT_VERSION} GROUP BY ALL
UNION ALL SELECT accession_number, k, finish, filed_after, 'dei', n, c, NULL, CASE WHEN k % 5 = 0 AND n = 'DocumentFiscalYearFocus' THEN CAST(v AS DOUBLE) END, CASE WHEN k % 5 = 0 AND n = 'DocumentFiscalYearFocus' THEN NULL ELSE v END
  FROM (SELECT accession_number, k, finish, filed_after, min(ref) AS c FROM v_filed WHERE readable AND k % 2 = 0 GROUP BY ALL) x,
  LATERAL (VALUES ('DocumentFiscalYearFocus', CAST(year(finish) AS VARCHAR)), ('DocumentFiscalPeriodFocus', 'Q' || quarter(finish)), ('DocumentPeriodEndDate', CAST(finish AS VARCHAR))) y(n, v)
""")
RAW = "accession_number:s taxonomy:s concept_local_name:s raw_context_id:s unit_signature:s value_decimal:f value_text:s"


@query("inline_facts", "C12", RAW, "SELECT * FROM v_filed_facts WHERE k % 5 <> 0")
def inline_facts(spark, d):
    return xbrl.extract_inline_facts(parsed(spark, d))


@query("instance_facts", "C13", RAW, "SELECT * FROM v_filed_facts WHERE k % 5 = 0")
def instance_facts(spark, d):
    return xbrl.extract_instance_facts(parsed(spark, d))


@query("raw_facts", "C14", f"{RAW} security_id:i available_at:t", """
SELECT *, k + 1 AS security_id, CAST(finish + filed_after AS TIMESTAMP) + INTERVAL 16 HOUR + INTERVAL 30 MINUTE AS available_at FROM v_filed_facts
""")
def raw_facts(spark, d):
    """The corpus delivered twice; equal facts count once."""
    docs = corpus(spark, d)
    return xbrl.build_raw_facts(xbrl.parse_documents(xbrl.distinct_documents(docs.unionByName(docs))))


@query("resolved_observations", "C15", "security_id:i metric_id:i basis_id:i period_semantics:s fiscal_year:i fiscal_period:s duration_days:i value:f unit_signature:s selection_reason:s", """
SELECT f.security_id, f.metric_id, CASE f.metric_id WHEN 1 THEN 104 WHEN 8 THEN 801 ELSE f.metric_id * 100 + 1 END AS basis_id, semantics AS period_semantics, year(f.finish) AS fiscal_year, label AS fiscal_period,
  CASE WHEN semantics = 'instant' THEN 0 ELSE days END AS duration_days, amount AS value,
  CASE metric_id WHEN 4 THEN 'shares' ELSE 'USD' END AS unit_signature, 'concept_candidate_priority_' || CASE metric_id WHEN 1 THEN 4 WHEN 8 THEN 2 ELSE 1 END AS selection_reason
FROM v_filed f JOIN v_assigned a ON a.accession_number = f.accession_number AND a.raw_context_id = f.ref WHERE readable AND ver <> 5
""")
def resolved_observations(spark, d):
    return xbrl.resolve_observations(xbrl.build_raw_facts(parsed(spark, d)))


@query("parse_summary", "C16", "accession_number:s documents_stored:i raw_facts_inserted:i canonical_selected_inserted:i parse_errors:i", """
SELECT accession_number, 1 AS documents_stored, coalesce(n, 0) AS raw_facts_inserted, CASE WHEN readable THEN obs ELSE 0 END AS canonical_selected_inserted, CASE WHEN readable THEN 0 ELSE 1 END AS parse_errors
FROM (SELECT accession_number, readable, count(*) FILTER (ver <> 5) AS obs FROM v_filed GROUP BY ALL) LEFT JOIN (SELECT accession_number, count(*) AS n FROM v_filed_facts GROUP BY 1) USING (accession_number)
""")
def parse_summary(spark, d):
    from fundaflow.plans.ingest import ingest_documents

    return ingest_documents(corpus(spark, d))["parse_summary"]


@query("vocabulary_join", "C17", "metric_id:i metric_name:s metric_kind:s concepts:i bases:i n:i", """
SELECT metric_id, metric_name, metric_kind, CASE metric_id WHEN 1 THEN 4 WHEN 2 THEN 2 WHEN 7 THEN 2 WHEN 8 THEN 3 ELSE 1 END AS concepts, CASE metric_id WHEN 1 THEN 4 ELSE 1 END AS bases, count(*) AS n FROM v_observations GROUP BY ALL
""")
def vocabulary_join(spark, d):
    concepts = xbrl.concept_dim(spark).groupBy("metric_id").agg(F.count("*").alias("concepts"))
    bases = xbrl.basis_dim(spark).groupBy("metric_id").agg(F.count("*").alias("bases"))
    counted = t.observations(spark, d).groupBy("metric_id").agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(xbrl.metric_dim(spark)), "metric_id").join(F.broadcast(concepts), "metric_id").join(F.broadcast(bases), "metric_id")


# ---- discovery ------------------------------------------------------------------------------------------

@query("discover_filings", "C1", "accession_number:s form:s source_url:s is_new:b events:i", """
SELECT accession_number, form, ok % 10 <> 0 AS is_new, 'https://www.sec.gov/Archives/edgar/data/' || CAST(cik AS BIGINT) || '/' || replace(accession_number, '-', '') || '/' || primary_document AS source_url, 1 AS events
FROM (SELECT * FROM v_submissions WHERE upper(form) IN ('10-K', '10-Q/A') QUALIFY row_number() OVER (PARTITION BY cik ORDER BY pos) <= 3)
""")
def discover_filings(spark, d):
    every = filings(spark, d)
    found = discovery.discover_filings(every, "10-K,10-Q/A", 3)
    fresh = discovery.new_filings(found, every.filter(F.col("ok") % 10 == 0)).select("accession_number", F.lit(True).alias("is_new"))
    seen = discovery.filing_seen(found, F.lit(t.INSERTED_AT).cast("timestamp"))
    counted = seen.groupBy(F.get_json_object("payload_json", "$.accession_number").alias("accession_number")).agg(F.count("*").alias("events"))
    return found.join(counted, "accession_number").join(fresh, "accession_number", "left").withColumn("is_new", F.coalesce("is_new", F.lit(False)))


@query("filings_by_group", "C2", "accession_number:s form_group:s group_rank:i", """
SELECT *, row_number() OVER (PARTITION BY cik, form_group ORDER BY filing_date DESC, accepted_at DESC, accession_number) AS group_rank
FROM (SELECT *, CASE WHEN upper(form) IN ('10-K', '10-K/A') THEN 'annual' WHEN upper(form) IN ('10-Q', '10-Q/A') THEN 'quarterly' ELSE 'other' END AS form_group FROM v_submissions)
QUALIFY group_rank <= CASE form_group WHEN 'annual' THEN 2 WHEN 'quarterly' THEN 3 ELSE 1 END
""")
def filings_by_group(spark, d):
    return discovery.select_filings_by_group(filings(spark, d), FormLimits(2, 3, 1, "10-K,10-K/A,10-Q,10-Q/A,8-K"))


def stored_filings(spark, d) -> DataFrame:
    ok = F.col("ok")
    return filings(spark, d).withColumn("raw_index_uri", F.when(ok % 4 != 1, F.lit("index"))).withColumn(
        "raw_primary_uri", F.when(ok % 8 != 2, F.lit("primary"))).withColumn(
        "primary_document", F.when(ok % 16 == 2, F.lit("")).otherwise(F.col("primary_document")))


@query("pending_filings", "C3", "accession_number:s form:s", """
SELECT * FROM v_submissions WHERE (ok % 4 = 1 OR (ok % 16 <> 2 AND ok % 8 = 2)) AND upper(form) IN ('10-K', '10-Q')
""")
def pending_filings(spark, d):
    return discovery.pending_filings(stored_filings(spark, d), forms="10-K,10-Q")


@query("latest_fetched_filing", "C4", "accession_number:s form:s filing_date:s", """
SELECT * FROM v_submissions WHERE ok % 4 <> 1 AND upper(form) = '10-K' AND cik = '0000000007' ORDER BY filing_date DESC, accepted_at DESC, accession_number LIMIT 1
""")
def latest_fetched_filing(spark, d):
    return discovery.latest_fetched(stored_filings(spark, d), "7", "10-K")


@query("package_hashes", "C5", "accession_number:s package_sha256:s", r"""
SELECT 'pkg-' || (doc_id // 4) AS accession_number, sha256(string_agg(sha256(text), chr(10) ORDER BY doc_id % 4 <> 0, CAST(doc_id AS VARCHAR))) AS package_sha256 FROM documents GROUP BY 1
""")
def package_hashes(spark, d):
    k = F.col("doc_id")
    rows = t.table(spark, d, "documents").select(
        F.concat(F.lit("pkg-"), F.floor(k / 4).cast("string")).alias("accession_number"),
        F.when(k % 4 == 0, F.lit("index.json")).otherwise(k.cast("string")).alias("name"), F.sha2("text", 256).alias("sha256"))
    return discovery.package_hash(rows)


@query("package_files", "A6", "accession_number:s name:s document_kind:s", """
SELECT DISTINCT accession_number, name, kind AS document_kind FROM (SELECT accession_number, k FROM v_filed GROUP BY ALL),
  LATERAL (VALUES ('index.json', 'sec_archive_index'), (CASE WHEN k % 5 = 0 THEN 'report_ins.xml' ELSE 'report.htm' END, CASE WHEN k % 5 = 0 THEN 'xbrl_instance' ELSE 'inline_xbrl' END)) x(name, kind)
""")
def package_files(spark, d):
    """Packages with an index, the document, listed notes and an unlisted file."""
    docs = corpus(spark, d)
    index = F.concat(F.lit('{"directory": {"item": [{"name": "'), "name", F.lit('"}, {"name": "notes.txt"}, {"name": "../up.xml"}, {"name": "/abs.xsd"}]}}'))
    package = F.replace("accession_number", F.lit("-"), F.lit(""))
    items = docs.select("cik", package.alias("package"), F.inline(F.array(
        F.struct(F.lit("index.json").alias("file"), index.alias("value")),
        F.struct(F.col("name").alias("file"), F.col("content").cast("string").alias("value")),
        F.struct(F.lit("notes.txt").alias("file"), F.lit("note").alias("value")),
        F.struct(F.lit("extra.xml").alias("file"), F.lit("<a/>").alias("value")))))
    listed = items.select(
        F.concat_ws("/", "cik", "package", "file").alias("path"), F.sha2("value", 256).alias("sha256"),
        F.when(F.col("file") == "index.json", F.col("value")).alias("index_json"))
    known = docs.select("cik", "accession_number", F.col("name").alias("primary_document"), "form", "filed_at", "accepted_at")
    return files.package_files(listed, known)
