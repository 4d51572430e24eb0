"""Cases of limits, identities, streamed packages and the decision chain that once went wrong."""

from __future__ import annotations

from dataclasses import replace
from datetime import date, timedelta
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from fundaflow.config import DEFAULT_SCENARIOS, REFERENCE_FORM_LIMITS, FormLimits
from fundaflow.functions import ids, numbers
from fundaflow.operators import discovery, features, gate, growth, lineage, statements, valuation
from fundaflow.plans.ingest import ingest_documents
from fundaflow.session import shared_dir
from fundaflow.sources import files, tables
from fundaflow.streaming import jobs
from fundaflow.streaming.table import StreamTable
from tests import builders as b
from tests.test_model_cases import LIMITS, NOW, intents, rows_of
from tests.test_sources_and_filings import INLINE, INSTANCE, filing


def test_buys_a_hair_above_cash_are_rejected(spark):
    sec = b.securities(spark, [(1, True, 10, 1e6), (2, True, 10, 1e6)])
    two = intents(spark, [(1, "buy", 500.0000002, .01), (2, "buy", 500.0000002, .01)])
    assert {r["approved"] for r in rows_of(gate.risk_gate(two, sec, replace(LIMITS, cash_usd=1000.0)))} == {False}
    even = intents(spark, [(1, "buy", 500.0, .01), (2, "buy", 500.0, .01)])
    assert {r["approved"] for r in rows_of(gate.risk_gate(even, sec, replace(LIMITS, cash_usd=1000.0)))} == {True}


def test_exact_sum_keeps_small_and_large_values(spark):
    def total(*values):
        return spark.createDataFrame([(float(v),) for v in values], "x double").agg(numbers.exact_sum(F.col("x"))).first()[0]

    assert total(1e21, 1.0, -1e21) == 1.0
    assert total(1e-19, 2e-19) == pytest.approx(3e-19)
    assert total(*[0.1] * 10) == 1.0
    assert total(1e300, 1e300) == 2e300 and total(float("inf"), 1.0) == float("inf")


def test_statements_that_differ_below_a_millionth_stay_apart(spark):
    rows = [list(b.statement(1, "2024-03-31")) for _ in range(2)]
    rows[0][7], rows[1][7] = 0.0000001, 0.0000004
    snaps = statements.statement_snapshots(b.statements(spark, [tuple(r) for r in rows]), F.lit("2024-01-01").cast("timestamp"))
    assert snaps.select("snapshot_id").distinct().count() == 2
    assert tables.new_rows(snaps.limit(0), snaps, ["snapshot_id"]).count() == 2


def test_set_digest_sees_every_bit(spark):
    def digest(*hashes):
        return spark.createDataFrame([(h,) for h in hashes], "h string").agg(ids.set_digest(F.col("h"))).first()[0]

    one, other = "0" * 63 + "1", "0" * 63 + "2"
    assert digest(one) != digest(other)
    assert digest(one, other) == digest(other, one) != digest(one, one)
    assert digest("f" * 64).count(":") == 8


def test_no_cap_without_being_asked(spark):
    quarters = [(date(2018 + i // 4, 3 * (i % 4) + 1, 1)) for i in range(20)]
    facts = b.facts(spark, [b.fact(1, 1, 100, q, (q + timedelta(days=92)).replace(day=1) - timedelta(days=1)) for q in quarters])
    sec = b.securities(spark, [(1, True, 10, 1e6)])
    assert statements.build_statements(facts, sec, NOW).count() == 17  # the first three quarters have no four
    assert statements.build_statements(facts, sec, NOW, max_anchors=12).count() == 12
    four = [*DEFAULT_SCENARIOS, replace(DEFAULT_SCENARIOS[0], name="worse")]
    assert valuation.check_scenarios(four) == []
    assert {r["scenario"] for r in rows_of(valuation.dcf(b.statements(spark, [b.statement(1, "2024-03-31")]), four))} == {s.name for s in four}
    filed = spark.createDataFrame([("77", f"a-{i}", "10-K", f"20{i:02d}-01-01", "", "") for i in range(10)], "cik string, accession_number string, form string, filing_date string, accepted_at string, primary_document string")
    assert discovery.select_filings_by_group(filed, FormLimits()).count() == 10
    assert discovery.select_filings_by_group(filed, FormLimits(**REFERENCE_FORM_LIMITS)).count() == 4


def test_two_broker_states_are_refused(spark):
    state = spark.sql("select true as reconciled, timestamp'2024-06-29 23:30:00' as checked_at, 5000.0D as portfolio_value_usd, 700.0D as cash_usd")
    with pytest.raises(ValueError, match="more than one row"):
        gate.risk_limits(state.union(state), NOW)


def test_projection_has_no_dates_for_instants(spark):
    obs = spark.createDataFrame([("o1", 1, 7, 5.0, "p1", "a-1", "us-gaap:Cash", "USD", 0, "h1", "selected"), ("o2", 1, 1, 6.0, "p2", "a-1", "us-gaap:Revenues", "USD", 0, "h2", "derived"), ("o3", 1, 1, 6.0, "p2", "a-1", "x:y", "USD", 0, "h3", "rejected")],
                                "observation_id string, security_id long, metric_id int, value double, period_id string, accession_number string, concept_qname string, unit_signature string, quality_flags long, observation_hash string, observation_status string").withColumn("available_at", F.lit("2024-01-01").cast("timestamp"))
    periods = spark.createDataFrame([("p1", None, None, date(2024, 1, 1)), ("p2", date(2023, 1, 1), date(2023, 12, 31), None)], "period_id string, raw_start_date date, raw_end_date date, raw_instant_date date")
    got = {r.fact_id: r for r in tables.canonical_facts_view(obs, periods).collect()}
    assert set(got) == {"o1", "o2"}
    assert got["o1"].period_start_date is None and got["o1"].period_end_date is None
    assert (got["o2"].period_end_date, got["o2"].taxonomy, got["o2"].tag, got["o2"].fact_hash) == (date(2023, 12, 31), "us-gaap", "us-gaap:Revenues", "h2")


def test_an_event_for_every_emitted_filing(spark):
    emitted = spark.createDataFrame([("77", f"a-{i}", "10-K", "2024-01-01", "", "x.htm", "u") for i in range(3)], ", ".join(f"{c} string" for c in discovery.FILING_SEEN_FIELDS))
    assert discovery.filing_seen(emitted, F.lit("2024-01-01").cast("timestamp")).count() == 3


def package(root, accession, listed, **content):
    folder = root / "0000000077" / accession
    folder.mkdir(parents=True, exist_ok=True)
    names = ", ".join(f'{{"name": "{n}"}}' for n in listed)
    (folder / "index.json").write_text(f'{{"directory": {{"item": [{names}]}}}}')
    for name, text in content.items():
        (folder / name.replace("__", ".")).write_text(text)


def test_streamed_packages_equal_the_batch_run(spark, tmp_path):
    """An extracted instance, an unlisted page, a late filing row, a late file and a broken document."""
    raw, store = tmp_path / "raw", f"{tmp_path}/store"
    package(raw, "000000007723000001", ["main.htm", "main_htm.xml"], main__htm=INLINE, main_htm__xml=INSTANCE, other__htm=INLINE)
    package(raw, "000000007723000002", ["late.htm"], late__htm=INLINE)
    package(raw, "000000007723000003", ["a_ins.xml", "b_ins.xml"], a_ins__xml=INSTANCE)
    package(raw, "000000007723000004", ["bad_ins.xml"], bad_ins__xml="<x:xbrl")
    schema = filing(spark).schema
    rows = [("0000000077", f"0000000077-23-00000{i}", "main.htm" if i == 1 else "late.htm" if i == 2 else "", "10-Q", "2023-04-30", "2023-04-30T12:00:00Z") for i in (1, 2, 3, 4)]
    known = [rows[0], rows[2], rows[3]]

    def run():
        q = jobs.stream_filings(spark, str(raw), lambda: spark.createDataFrame(known, schema), store, f"{tmp_path}/cursor", 6, availableNow=True)
        q.awaitTermination()
        assert q.exception() is None

    run()
    assert {r.accession_number for r in StreamTable(spark, f"{store}/xbrl_facts").read().collect()} == {"0000000077-23-000001"}
    known.append(rows[1])
    package(raw, "000000007723000003", ["a_ins.xml", "b_ins.xml"], b_ins__xml=INSTANCE)
    run()
    every = files.read_package_files(spark, str(raw))
    filings = spark.createDataFrame(rows, schema)
    listed = files.package_files(every.drop("content"), filings).join(every.select("path", "content"), "path")
    want = ingest_documents(listed.withColumn("doc_id", F.concat_ws("/", "accession_number", "name")))
    for name in ("xbrl_facts", "canonical_observations", "reporting_periods", "xbrl_contexts", "xbrl_units", "dimension_signatures", "parse_errors"):
        columns = sorted(set(want[name].columns))
        got = sorted(map(str, StreamTable(spark, f"{store}/{name}").read().select(columns).collect()))
        assert got == sorted(map(str, want[name].select(columns).collect())), name
    assert want["parse_errors"].count() == 1


def test_orders_approved_before_a_mode_change_are_staged_after_it(spark, tmp_path):
    sec = b.securities(spark, [(i, True, 10, 1e6) for i in range(1, 5)])
    mode = ["observe"]

    def offer(part, *rows):
        made = intents(spark, [(s, "buy", 500, .01) for s in rows]).withColumn("intent_id", F.concat(F.lit(part), "intent_id"))
        made.withColumn("run_id", F.lit("r")).withColumn("created_at", F.lit("2024-06-30").cast("timestamp")).write.mode("append").parquet(f"{tmp_path}/in")
        stream = jobs.stream_files(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
        q = jobs.stream_decisions(stream, f"{tmp_path}/store", sec, LIMITS, lambda: mode[0], f"{tmp_path}/cursor", availableNow=True)
        q.awaitTermination()
        assert q.exception() is None

    offer("a", 1, 2)
    mode[0] = "stage"
    offer("b", 3)
    offer("c", 4)
    decisions = StreamTable(spark, f"{tmp_path}/store/risk_decisions").read()
    staged = StreamTable(spark, f"{tmp_path}/store/staged_orders").read()
    assert decisions.filter("approved").count() == 4
    assert staged.count() == 4 and staged.select("staged_order_id", "decision_id").distinct().count() == 4
    events = {r.event_type: r["count"] for r in StreamTable(spark, f"{tmp_path}/store/events").read().groupBy("event_type").count().collect()}
    assert events == {"gate_completed": 3, "order_staged": 4}
    none_sent = spark.createDataFrame([], "staged_order_id string, event_type string")
    assert gate.submittable(staged, none_sent, "paper", LIMITS).count() == 4


def test_latest_and_prior_in_one_pass(spark):
    rows = [b.statement(1, e) for e in ("2024-03-31", "2023-12-31", "2023-03-31", "2022-03-31")] + [b.statement(2, "2024-03-31"), b.statement(3, "2024-03-31"), b.statement(3, "2021-03-31")]
    snaps = statements.statement_snapshots(b.statements(spark, rows), F.lit("2024-01-01").cast("timestamp"))
    sec = b.securities(spark, [(1, True, 1, 1), (2, True, 1, 1), (3, True, 1, 1)])
    two = features.prior_year(features.latest_as_of(snaps, sec, NOW), snaps, NOW)
    one = features.latest_with_prior(snaps, sec, NOW)
    assert sorted(map(str, one.select(*two.columns).collect())) == sorted(map(str, two.collect()))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_max_by(struct(snapshot_id") <= 1


def test_tied_statements_do_not_depend_on_partitions(spark):
    """Two stored statements of one end and availability: the greatest content, by snapshot id where there is one."""
    rows = [b.statement(1, "2024-03-31", revenue=r) for r in (900e6, 1100e6, 1000e6)]
    for order in (rows, rows[::-1]):
        frame = b.statements(spark, order).repartition(3)
        assert [r.revenue_usd for r in valuation.latest_two_statements(frame).collect()] == [1100e6]
        named = frame.withColumn("snapshot_id", F.concat(F.lit("s"), (F.lit(5000e6) - F.col("revenue_usd")).cast("long").cast("string")))
        assert [r.revenue_usd for r in valuation.latest_two_statements(named).collect()] == [900e6]


def test_an_issuer_with_most_restatements(spark):
    rows = [b.fact(1, m, 100 + i % 7, "2023-10-01", "2023-12-31", lag=30 + i) for i in range(300) for m in (1, 2)]
    rows += [b.fact(s, m, 100 + k, f"2023-{q}-01", f"2023-{e}") for s in (1, 2, 3) for m in (1, 2) for k, (q, e) in enumerate([("04", "06-30"), ("07", "09-30"), ("10", "12-31")])]
    got = {(r.security_id, r.metric_id): r.latest_value for r in growth.latest_two(b.facts(spark, rows)).collect()}
    assert len(got) == 6 and got[2, 1] == 102 and got[1, 1] == 100 + 299 % 7


def test_product_ids_do_not_depend_on_the_order_of_parents(spark):
    new = spark.createDataFrame([("k", "t", "c", "h", "a", "f")], "product_key string, product_type string, cell_id string, content_sha256 string, created_by_algorithm string, config_sha256 string").withColumn("available_at", F.lit("2024-01-01").cast("timestamp"))
    parents = [("k", f"p{i}", "input") for i in range(5)]
    made = [lineage.product_ids(new, spark.createDataFrame(p, "product_key string, parent_product_id string, role string")).first().product_id for p in (parents, parents[::-1], parents[:4])]
    assert made[0] == made[1] != made[2]


def test_earnings_per_share_in_plain_dollars_resolve(spark):
    """The candidate for USD/shares also takes a fact whose unit is USD; a segment context has a scope of its own and resolves to nothing."""
    from fundaflow.operators import xbrl
    from tests.test_sources_and_filings import NS, UNIT, XML, context, span

    segment = '<x:segment><d:explicitMember dimension="us-gaap:StatementGeographicalAxis">p:North</d:explicitMember></x:segment>'
    body = (f"{XML}<x:xbrl {NS}>" + context("q", span("2023-01-01", "2023-03-31")) + context("s", span("2023-01-01", "2023-03-31"), segment) + UNIT
            + '<us-gaap:EarningsPerShareDiluted contextRef="q" unitRef="u">1.25</us-gaap:EarningsPerShareDiluted>'
            + '<us-gaap:EarningsPerShareDiluted contextRef="q" unitRef="u" decimals="2">1.250</us-gaap:EarningsPerShareDiluted>'
            + '<us-gaap:GrossProfit contextRef="q" unitRef="u">7</us-gaap:GrossProfit><us-gaap:GrossProfit contextRef="s" unitRef="u">9</us-gaap:GrossProfit></x:xbrl>')
    docs = spark.createDataFrame([("d", "0000000077", "a-1", "xbrl_instance", "10-Q", "2023-04-30", "2023-04-30T12:00:00Z", bytearray(body.encode()))],
                                 "doc_id string, cik string, accession_number string, document_kind string, form string, filed_at string, accepted_at string, content binary")
    parsed = xbrl.parse_documents(docs)
    assert {r.scope_class for r in xbrl.dimension_signatures(xbrl.extract_contexts(parsed)).collect()} == {"consolidated_total", "segment"}
    raw = xbrl.build_raw_facts(parsed)
    # 1.25 and 1.250 are one fact: equal number, name, context and unit
    assert raw.count() == 3 and raw.select("raw_fact_hash").distinct().count() == 3
    got = {r.metric_name: (r.value, r.unit_signature) for r in xbrl.resolve_observations(raw).collect()}
    assert got == {"eps_diluted": (1.25, "USD"), "gross_profit": (7.0, "USD")}


def test_each_document_is_parsed_once_and_facts_are_not_shuffled(spark):
    from binding.filing_queries import resolved_observations

    plan = resolved_observations(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    after = plan[: plan.index("MapInArrow")]
    assert plan.count("MapInArrow") == 1 and "Exchange hashpartitioning(raw_fact_hash" not in after


def test_long_chains_take_few_rounds(spark, monkeypatch):
    written = []
    cut = lineage.cut_lineage
    monkeypatch.setattr(lineage, "cut_lineage", lambda df: written.append(1) or cut(df))
    chain = [(f"c{i}", f"c{i + 1}") for i in range(60)]
    behind = [("x", "y"), ("y", "x"), ("y", "z0"), *((f"z{i}", f"z{i + 1}") for i in range(9)), ("c60", "x")]
    got = {r.subject for r in lineage.audit_cycles(spark.createDataFrame(chain + behind, "from_node_id string, to_node_id string")).collect()}
    assert got == {"x", "y", *(f"z{i}" for i in range(10))}
    assert len(written) < 2 * 12
    written.clear()
    assert lineage.audit_cycles(spark.createDataFrame(chain, "from_node_id string, to_node_id string")).count() == 0
    assert len(written) < 2 * 12


def test_a_batch_of_packages_leaves_no_copies(spark, tmp_path):
    """What a batch reads again is kept as files that go with it: no checkpoint of documents or facts, no copy in any table."""
    fact = '<us-gaap:Revenues contextRef="c{0}" unitRef="u">{0}</us-gaap:Revenues>'
    context = ('<xbrli:context id="c{0}"><xbrli:entity><xbrli:identifier scheme="cik">7</xbrli:identifier></xbrli:entity><xbrli:period>'
               '<xbrli:instant>2020-03-31</xbrli:instant></xbrli:period></xbrli:context>')
    body = "".join(context.format(i) + fact.format(i) for i in range(400)) + fact.format(3)  # one fact comes twice
    page = ('<xbrli:xbrl xmlns:xbrli="http://www.xbrl.org/2003/instance" xmlns:us-gaap="http://fasb.org/us-gaap/2024"><xbrli:unit id="u">'
            f"<xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit>{body}</xbrli:xbrl>")
    paths = [("0000000007/000000000720000001/index.json", b'{"directory": {"item": [{"name": "a_ins.xml"}]}}'),
             ("0000000007/000000000720000001/a_ins.xml", page.encode())]
    spark.createDataFrame(paths, "path string, content binary").write.parquet(f"{tmp_path}/in")
    known = spark.createDataFrame([("0000000007", "0000000007-20-000001", "a_ins.xml", "10-Q", "2020-05-01", "2020-05-01T16:30:00Z")],
                                  "cik string, accession_number string, primary_document string, form string, filed_at string, accepted_at string")
    shared = Path(urlparse(spark.sparkContext.getCheckpointDir() or shared_dir(spark)).path)

    def size(folder):
        return sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())

    before = size(shared)
    stream = jobs.stream_files(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    query = jobs.stream_packages(stream, known, f"{tmp_path}/store", f"{tmp_path}/cursor", availableNow=True)
    query.awaitTermination()
    assert query.exception() is None
    assert StreamTable(spark, f"{tmp_path}/store/xbrl_facts").read().count() == 400
    assert StreamTable(spark, f"{tmp_path}/store/canonical_observations").read().count() == 400
    assert size(shared) - before < len(page)
    assert not [p for p in (tmp_path / "store").rglob("_copies")]


def test_the_streamed_corpus_is_made_once(spark, monkeypatch):
    from binding import stream_queries as q

    rows = spark.range(5).selectExpr("cast(id as string) as cik", "cast(cast(id as string) as binary) as content")
    monkeypatch.setattr(q, "corpus", lambda spark, d: rows)
    docs = q.written_corpus(spark, "", q.scratch(spark))
    assert docs.inputFiles() and rows_of(docs.orderBy("cik")) == rows_of(rows.orderBy("cik"))
