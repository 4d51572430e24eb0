"""File sources and sinks, the XBRL reader, discovery, lineage and streaming on small inputs."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from fundaflow.config import FormLimits
from fundaflow.functions import dates, flags, ids, numbers, text
from fundaflow.operators import audit, discovery, lineage, market, xbrl
from fundaflow.plans.ingest import ingest_documents
from fundaflow.sources import files, tables
from fundaflow.streaming import jobs
from fundaflow.streaming.table import StreamTable
from tests import builders as b

XML = '<?xml version="1.0" encoding="UTF-8"?>'
NS = ('xmlns:x="http://www.xbrl.org/2003/instance" xmlns:ix="http://www.xbrl.org/2013/inlineXBRL" xmlns:us-gaap="http://fasb.org/us-gaap/2023" '
      'xmlns:d="http://xbrl.org/2006/xbrldi"')


def context(ident, period, members=""):
    return f'<x:context id="{ident}"><x:entity><x:identifier>77</x:identifier>{members}</x:entity><x:period>{period}</x:period></x:context>'


def span(start, end):
    return f"<x:startDate>{start}</x:startDate><x:endDate>{end}</x:endDate>"


UNIT = '<x:unit id="u"><x:measure>iso4217:USD</x:measure></x:unit>'
REVENUE = "us-gaap:RevenueFromContractWithCustomerExcludingAssessedTax"
INLINE = (
    f"{XML}<html {NS}>" + context("quarter", span("2023-01-01", "2023-03-31")) + context("half", span("2022-10-01", "2023-03-31"))
    + context("day", "<x:instant>2023-03-31</x:instant>") + UNIT
    + f'<ix:nonFraction name="{REVENUE}" contextRef="quarter" unitRef="u" scale="6">1,50<b>0</b></ix:nonFraction>'
    + f'<ix:nonFraction name="{REVENUE}" contextRef="half" unitRef="u" scale="6">2800</ix:nonFraction>'
    + '<ix:nonFraction name="us-gaap:NetIncomeLoss" contextRef="quarter" unitRef="u" scale="6">(40)</ix:nonFraction>'
    + '<ix:nonNumeric name="dei:DocumentFiscalYearFocus" contextRef="quarter">2023</ix:nonNumeric>'
    + '<ix:nonNumeric name="dei:DocumentFiscalPeriodFocus" contextRef="quarter">Q2</ix:nonNumeric>'
    + '<ix:nonNumeric name="dei:DocumentPeriodEndDate" contextRef="day">2023-03-31</ix:nonNumeric>'
    + '<ix:nonNumeric name="dei:CurrentFiscalYearEndDate" contextRef="day">--09-30</ix:nonNumeric>'
    + '<ix:nonFraction name="us-gaap:Revenues" contextRef="nowhere" unitRef="u">1</ix:nonFraction></html>')
INSTANCE = (
    f"{XML}<x:xbrl {NS}>" + context("day", "<x:instant>2023-03-31</x:instant>")
    + context("part", span("2023-01-01", "2023-03-31"), '<x:segment><d:explicitMember dimension="srt:ProductOrServiceAxis">p:Lamp</d:explicitMember></x:segment>')
    + UNIT + '<us-gaap:CashAndCashEquivalentsAtCarryingValue contextRef="day" unitRef="u">900</us-gaap:CashAndCashEquivalentsAtCarryingValue>'
    + f'<{REVENUE} contextRef="part" unitRef="u">77</{REVENUE}></x:xbrl>')


def documents(spark):
    rows = [("a", "inline_xbrl", INLINE.encode()), ("b", "xbrl_instance", INSTANCE.encode()), ("c", "inline_xbrl", b"<html><p></html>"),
            ("d", "inline_xbrl", b"\xff\xfe<html/>"), ("e", "inline_xbrl", b"<!DOCTYPE html><html/>"), ("f", "xbrl_schema", b"<s/>")]
    full = [(i, "0000000077", "0000000077-23-000001", kind, "10-Q", "2023-04-30", "2023-04-30T12:00:00Z", data) for i, kind, data in rows]
    return spark.createDataFrame(full, ", ".join(f"{c} string" for c in xbrl.DOCUMENT_COLUMNS) + ", content binary")


def test_package_of_two_documents(spark):
    out = ingest_documents(documents(spark))
    assert out["xbrl_facts"].count() == 9
    obs = out["canonical_observations"].collect()
    assert sorted((o.metric_name, o.period_semantics, o.fiscal_period, o.value) for o in obs) == [
        ("cash", "instant", None, 900.0), ("net_income", "fiscal_quarter", "Q2", -40e6),
        ("revenue", "fiscal_quarter", "Q2", 1500e6), ("revenue", "fiscal_ytd", "Q2", 2800e6)]
    assert {o.fiscal_year for o in obs} == {2023}
    errors = {r.doc_id: r.error for r in out["parse_errors"].collect()}
    assert set(errors) == {"c", "d", "e"} and errors["d"].startswith("non-UTF8")
    scopes = {r.scope_class: r.dimensions_hash for r in out["dimension_signatures"].collect()}
    assert set(scopes) == {"consolidated_total", "product"}
    assert scopes["consolidated_total"].startswith("44136fa355b3678a")
    summary = out["parse_summary"].collect()[0]
    assert (summary.documents_stored, summary.parse_errors, summary.canonical_selected_inserted) == (6, 3, 4)
    again = ingest_documents(documents(spark), out)
    assert again["xbrl_facts"].count() == 0 and again["canonical_observations"].count() == 0


def test_submissions_document(spark, tmp_path):
    (tmp_path / "CIK.json").write_text("""{"cik": "77", "filings": {"recent": {
      "accessionNumber": ["a-2", "a-1"], "form": ["10-Q", "8-K"], "filingDate": ["2024-02-01", "2024-01-01"],
      "acceptanceDateTime": ["2024-02-01T01:00:00Z"], "primaryDocument": ["x.htm", ""]}}}""")
    rows = files.read_submissions(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.cik, r.pos, r.accession_number, r.accepted_at) for r in rows] == [
        ("0000000077", 0, "a-2", "2024-02-01T01:00:00Z"), ("0000000077", 1, "a-1", "")]


def write_package(root):
    folder = root / "0000000077" / "000000007723000001"
    folder.mkdir(parents=True)
    (folder / "index.json").write_text('{"directory": {"item": [{"name": "main.htm"}, {"name": "data.xml"}, {"name": "../x.xml"}, {"name": "other.htm"}]}}')
    (folder / "main.htm").write_text(INLINE)
    (folder / "data.xml").write_text(INSTANCE)
    (folder / "other.htm").write_text("<html/>")
    (folder / "stray.xml").write_text("<a/>")


def filing(spark):
    return spark.createDataFrame(
        [("0000000077", "0000000077-23-000001", "main.htm", "10-Q", "2023-04-30", "2023-04-30T12:00:00Z")],
        "cik string, accession_number string, primary_document string, form string, filed_at string, accepted_at string")


def test_read_packages(spark, tmp_path):
    write_package(tmp_path)
    kept = {r.name: (r.document_kind, r.source_url) for r in files.read_packages(spark, str(tmp_path), filing(spark)).collect()}
    assert {n: k for n, (k, _) in kept.items()} == {"index.json": "sec_archive_index", "main.htm": "inline_xbrl", "data.xml": "xbrl_instance"}
    assert kept["main.htm"][1].endswith("/77/000000007723000001/main.htm")


def test_stream_filings_once(spark, tmp_path):
    write_package(tmp_path / "raw")
    for _ in range(2):
        q = jobs.stream_filings(spark, f"{tmp_path}/raw", filing(spark), f"{tmp_path}/store", f"{tmp_path}/cursor", availableNow=True)
        q.awaitTermination()
    assert StreamTable(spark, f"{tmp_path}/store/canonical_observations").read().count() == 4


def test_streaming_retry_replaces_its_batch(spark, tmp_path):
    rows = spark.range(10).select("id", (F.col("id") % 5).alias("key"))
    table = StreamTable(spark, f"{tmp_path}/t", ["key"])
    for _ in range(2):
        table.append_once(rows, 0)
    table.append_once(rows.withColumn("key", F.col("id")), 1)
    assert table.read().count() == 10


def test_security_master_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text("rank,cik,ticker,price_usd,adv_usd,investable\n1,12,aa,1.5,10,1\n2,0012,ab,2,20,0\n3,13,b,3,5,\n")
    rows = files.read_security_master(spark, str(tmp_path / "m.csv"), True)
    kept = {r.cik: (r.ticker, r.investable) for r in files.dedup_security_master(rows).collect()}
    assert kept == {"0000000012": ("AB", False), "0000000013": ("B", True)}


def test_market_feed(spark, tmp_path):
    (tmp_path / "bars.jsonl").write_text('{"symbol":"zz","ts_event":"2024-01-01","close":"100","volume":10}\n\n'
                                         '{"raw_symbol":"ZZ","ts_recv":"2024-01-02","close_price":110,"size":"20"}\n{"symbol":" ","close":1}\n')
    (tmp_path / "master.jsonl").write_text('{"symbol":"zz","cik":"5","name":"Old"}\n{"symbol":"ZZ","issuer_cik":5,"issuer_name":"Zed","shares_outstanding":"1,000"}\n')
    bars, master = files.read_bars(spark, f"{tmp_path}/bars.jsonl"), files.read_market_master(spark, f"{tmp_path}/master.jsonl")
    (seed,) = market.security_seeds(master, bars, ["ZZ"], 2).collect()
    assert (seed.price_usd, seed.adv_usd, seed.market_cap_usd, seed.issuer_name, seed.bar_count) == (110.0, 1600.0, 110_000.0, "Zed", 2)
    asked = spark.createDataFrame([("ZZ",), ("YY",)], "symbol string")
    assert [(r.symbol, r.missing) for r in market.seed_gaps(asked, master, bars).collect()] == [("YY", "security_master")]


def test_ingest_groups():
    groups = discovery.ingest_groups(FormLimits(4, 12, 1, "10-K,10-Q,10-K/A,10-Q/A"))
    assert [(n, limit) for n, _, limit in groups] == [("annual", 4), ("quarterly", 12)]
    assert discovery.ingest_groups(FormLimits(4, 12, 0, "10-K,*")) == [("all", None, 16)]
    assert discovery.ingest_groups(FormLimits(forms=" , ")) == []


@pytest.mark.parametrize(("raw", "want"), [("Internet Platforms", "internet_platforms"), ("  Digital--Ads!", "digital_ads"), ("É", "")])
def test_slug(spark, raw, want):
    assert spark.range(1).select(text.slug(F.lit(raw))).first()[0] == want


@pytest.mark.parametrize(("raw", "scale", "want"), [("1,234", "3", 1234000.0), ("(5.5)", "0", -5.5), ("5d", "0", None), ("", "0", None),
                                                   (" 7", "x", 7.0), ("1e2", "-1", 10.0)])
def test_scaled_number(spark, raw, scale, want):
    got = spark.range(1).select(numbers.scaled_number(F.lit(raw), F.lit(scale))).first()[0]
    assert got == want if want is None else got == pytest.approx(want)


def test_fiscal_year_ignores_missing_leap_day(spark):
    cases = [("2023-03-30", "2024-03-31", 2023), ("2024-02-29", "2025-02-28", None), ("2025-03-31", "2024-03-31", None), ("2013-03-31", "2024-03-31", None)]
    df = spark.createDataFrame(cases, "e string, d string, want int")
    got = df.withColumn("got", dates.comparable_fiscal_year(F.col("e"), F.col("d"), F.lit(2024))).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_instants(spark):
    df = spark.createDataFrame([("2024-01-02",), ("2024-01-02T03:04:05.678Z",), ("2024-01-02T03:04:05+02:00",), ("2024-01",), ("x",)], "s string")
    assert [r[0] for r in df.select(dates.epoch_second(F.col("s"))).collect()] == [1704153600, 1704164645, 1704157445, 0, 0]


def test_flag_names_and_ids(spark):
    row = spark.range(1).select(
        flags.flag_names(F.lit(0).cast("long"), ["a", "b"]).alias("none"), flags.flag_names(F.lit(3).cast("long"), ["a", "b"]).alias("both"),
        ids.stable_id("p", a=F.lit("1|b=2")).alias("x"), ids.stable_id("p", a=F.lit("1"), b=F.lit("2")).alias("y")).first()
    assert (row.none, row.both) == ("none", "a,b") and row.x != row.y


def test_upsert_keeps_the_last_update(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    updates = spark.createDataFrame([(1, "c", 1), (1, "d", 2), (3, "e", 1)], "k int, v string, n int")
    assert sorted(tables.merge_latest(base, updates, ["k"], F.col("n")).collect()) == [(1, "d"), (2, "b"), (3, "e")]


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "from_node_id string, to_node_id string")


def test_cycles(spark):
    assert audit_nodes(spark, [("a", "b"), ("b", "c"), ("a", "c")]) == []
    assert audit_nodes(spark, [("s", "a"), ("a", "b"), ("b", "a"), ("b", "z")]) == ["a", "b", "z"]


def audit_nodes(spark, pairs):
    return sorted(r.subject for r in lineage.audit_cycles(edges(spark, pairs)).collect())


def test_ancestors_stop_on_cycles_and_mark_missing(spark):
    rows = spark.createDataFrame([("c", "b", "i"), ("b", "a", "i"), ("a", "c", "i"), ("b", "gone", "i")], "child_product_id string, parent_product_id string, role string")
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "product_id string")
    out = lineage.ancestors(rows, known, known.filter("product_id = 'c'"))
    assert sorted((r.product_id, r.is_missing) for r in out.collect()) == [("a", False), ("b", False), ("c", False), ("gone", True)]


def test_product_id_ignores_parent_order(spark):
    new = spark.createDataFrame([("k", "t", "c", "h", "a", "g", datetime(2024, 1, 1))],
                                "product_key string, product_type string, cell_id string, content_sha256 string, created_by_algorithm string, config_sha256 string, available_at timestamp")

    def ident(parents):
        df = spark.createDataFrame([("k", p, "in") for p in parents], "product_key string, parent_product_id string, role string")
        return lineage.product_ids(new, df).first().product_id

    assert ident(["p", "q"]) == ident(["q", "p"]) != ident(["p", "r"])


def test_audits_accept_clean_rows(spark):
    rows = spark.sql("select 'o1' observation_id, 'flow' metric_kind, 90 duration_days, 'selected' observation_status, 'consolidated_total' dimensional_scope")
    assert audit.audit_observations(rows).isEmpty()
    assert not audit.audit_observations(rows.withColumn("duration_days", F.lit(0))).isEmpty()


def test_load_facts_uses_instant_for_both_ends(spark):
    obs = b.facts(spark, [b.fact(1, 7, 5, "2024-03-31", "2024-03-31", "instant")]).drop("period_start", "period_end").withColumn(
        "period_id", F.lit("p")).withColumn("dimensional_scope", F.lit("consolidated_total"))
    periods = spark.sql("select 'p' period_id, cast(null as date) raw_start_date, cast(null as date) raw_end_date, date'2024-03-31' raw_instant_date")
    row = tables.load_facts(obs, periods).first()
    assert row.period_start == row.period_end == date(2024, 3, 31)
