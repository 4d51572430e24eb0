"""Integrity audits and lineage graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binding import testdata as t
from binding.registry import query
from binding.source_queries import bound_ledger, stamp
from binding.views import view
from fundaflow.operators import audit, lineage

FINDING = "rule:s subject:s detail:s"
INVARIANT = "invariant_id:s subject:s"

# ---- audits -----------------------------------------------------------------------------------------


@query("audit_required", "L1", "rule:s subject:s", """
SELECT 'securities.peer_group.required' AS rule, cik AS subject FROM v_securities WHERE peer_group = ''
UNION ALL SELECT 'securities.industry.required', cik FROM v_securities WHERE industry = ''
UNION ALL SELECT 'observations.observation_status.enum', observation_id FROM v_observations WHERE observation_status = 'rejected'
""")
def audit_required(spark, d):
    sec = audit.audit_required(t.securities(spark, d), "securities", "cik", ["cik", "symbol", "peer_group", "industry"])
    obs = audit.audit_required(t.observations(spark, d), "observations", "observation_id", ["period_id", "metric_name"],
                               {"observation_status": ["selected", "derived", "superseded"]})
    return sec.unionByName(obs)


@query("audit_hashes", "L2", "rule:s subject:s", """
SELECT 'events.payload_sha256.hash_length' AS rule, CAST(event_id AS VARCHAR) AS subject FROM events WHERE event_id % 97 = 3
UNION ALL SELECT 'events.payload_json.json', CAST(event_id AS VARCHAR) FROM events WHERE event_id % 101 = 5
UNION ALL SELECT 'events.event_version.version', CAST(event_id AS VARCHAR) FROM events WHERE event_id % 103 = 7
""")
def audit_hashes(spark, d):
    e = F.col("event_id")
    rows = t.table(spark, d, "events").select(
        "event_id", F.when(e % 101 == 5, F.lit("{broken")).otherwise(F.col("props")).alias("payload_json"),
        F.when(e % 97 == 3, F.lit("short")).otherwise(F.sha2("props", 256)).alias("payload_sha256"),
        F.when(e % 103 == 7, 2).otherwise(1).alias("event_version"))
    return audit.audit_hashes(rows, "events", "event_id", ["payload_sha256"], ["payload_json"], "event_version")


@query("audit_references", "L3", "rule:s subject:s detail:s", """
SELECT 'risk_decisions.intent_id.reference' AS rule, CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber AS subject, CAST(l_orderkey AS VARCHAR) AS detail FROM lineitem WHERE l_orderkey % 50 = 0
UNION ALL SELECT 'order_intents.run_id.reference', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderkey % 50 <> 0 AND o_custkey % 10 = 0
UNION ALL SELECT 'staged_orders.intent_id.reference', CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber, CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_orderkey % 50 = 0
UNION ALL SELECT 'staged_orders.decision_id.reference', CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber, CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber FROM lineitem l
  WHERE NOT EXISTS (SELECT 1 FROM lineitem m WHERE m.l_orderkey = l.l_orderkey AND m.l_linenumber = l.l_linenumber AND m.l_returnflag <> 'R')
""")
def audit_references(spark, d):
    orders, lines = t.table(spark, d, "orders"), t.table(spark, d, "lineitem")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber")
    tables = {
        "model_runs": t.table(spark, d, "customer").filter(F.col("c_custkey") % 10 != 0).select(F.col("c_custkey").alias("run_id")),
        "order_intents": orders.filter(F.col("o_orderkey") % 50 != 0).select(F.col("o_orderkey").alias("intent_id"), F.col("o_custkey").alias("run_id")),
        "risk_decisions": lines.select(key.alias("decision_id"), F.col("l_orderkey").alias("intent_id"), (F.col("l_returnflag") != "R").alias("approved")),
        "staged_orders": lines.select(key.alias("staged_order_id"), key.alias("decision_id"), F.col("l_orderkey").alias("intent_id")),
    }
    return audit.audit_references(tables)


@query("audit_observations", "L4", "rule:s subject:s", """
SELECT 'observations.flow_duration' AS rule, observation_id AS subject FROM v_observations WHERE metric_id = 9
UNION ALL SELECT 'observations.selected_scope', observation_id FROM v_observations WHERE dimensional_scope = 'segment'
""")
def audit_observations(spark, d):
    bent = t.observations(spark, d).withColumn("duration_days", F.when(F.col("metric_id") == 9, 0).otherwise(F.col("duration_days"))).withColumn(
        "observation_status", F.when(F.col("observation_status") == "derived", F.lit("selected")).otherwise(F.col("observation_status")))
    return audit.audit_observations(bent)


@query("audit_periods", "L5", "rule:s subject:s", "SELECT 'periods.dates' AS rule, period_id AS subject FROM v_periods WHERE period_semantics = 'fiscal_ytd'")
def audit_periods(spark, d):
    bent = t.reporting_periods(spark, d).withColumn(
        "raw_start_date", F.when(F.col("period_semantics") != "fiscal_ytd", F.col("raw_start_date")))
    return audit.audit_periods(bent)


@query("audit_event_payloads", "L6", "rule:s subject:s", """
SELECT 'events.click.$.k.ge' AS rule, CAST(event_id AS VARCHAR) AS subject FROM events WHERE event_type = 'click' AND CAST(json_extract(props, '$.k') AS INTEGER) < 90
UNION ALL SELECT 'events.error.$.k.eq', CAST(event_id AS VARCHAR) FROM events WHERE event_type = 'error' AND CAST(json_extract(props, '$.k') AS INTEGER) <> 7
""")
def audit_event_payloads(spark, d):
    rows = t.table(spark, d, "events").select("event_id", "event_type", F.col("props").alias("payload_json"))
    return audit.audit_event_payloads(rows, [("click", "$.k", "ge", 90), ("error", "$.k", "eq", 7)])


@query("audit_unique", "L7", FINDING, """
SELECT 'documents.sha256.unique' AS rule, sha256(text) AS subject, CAST(count(*) AS VARCHAR) AS detail FROM documents GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'events.event_type_user_id.unique', event_type || '|' || user_id, CAST(count(*) AS VARCHAR) FROM events GROUP BY 2 HAVING count(*) > 1
""")
def audit_unique(spark, d):
    docs = t.table(spark, d, "documents").select(F.sha2("text", 256).alias("sha256"))
    return audit.audit_unique(docs, "documents", ["sha256"]).unionByName(
        audit.audit_unique(t.table(spark, d, "events"), "events", ["event_type", "user_id"]))


@query("audit_payload_hash", "L8", "rule:s subject:s", """
SELECT 'events.payload_sha256.recomputed' AS rule, h AS subject FROM (SELECT event_id, 'e' || event_id AS h FROM events) WHERE event_id % 37 = 1
""")
def audit_payload_hash(spark, d):
    e = F.col("event_id")
    rows = t.table(spark, d, "events").select(
        F.concat(F.lit("e"), e.cast("string")).alias("event_id"), F.col("props").alias("payload_json"),
        F.sha2(F.when(e % 37 == 1, F.concat("props", F.lit(" "))).otherwise(F.col("props")), 256).alias("payload_sha256"))
    return audit.audit_payload_hash(rows, "events", "event_id")


# ---- products from conversations ----------------------------------------------------------------------

TYPES = ["canonical_fact_set.v1", "order_intent_set.v1", "risk_decision_set.v1", "staged_order_set.v1", "reconciliation_snapshot.v1",
         "broker_event_set.v1", "command_output.v1", "report.v1"]
view("v_products", f"""
SELECT conv_id || ':' || turn AS product_id, conv_id, turn, list_extract([{', '.join(repr(x) for x in TYPES)}], CAST(turn % 8 + 1 AS INTEGER)) AS product_type,
  CASE role WHEN 'system' THEN 'A' WHEN 'user' THEN 'B' ELSE 'C' END AS hazard_class, TIMESTAMP '2024-01-01' + to_days(CAST(conv_id % 30 AS INTEGER)) + to_hours(CAST(turn AS INTEGER)) AS available_at,
  'algo.' || (conv_id % 6) AS created_by_algorithm, sha256(text) AS content_sha256, conv_id % 5 AS config
FROM conversations
""")
view("v_lineage", """
SELECT product_id AS child_product_id, parent_product_id, 'input' AS role FROM (SELECT *, lag(product_id) OVER (PARTITION BY conv_id ORDER BY turn) AS parent_product_id FROM v_products) WHERE parent_product_id IS NOT NULL
""")


def products(spark, d) -> DataFrame:
    c, n = F.col("conv_id"), F.col("turn")
    return t.table(spark, d, "conversations").select(
        F.concat_ws(":", c, n).alias("product_id"), "conv_id", "turn",
        F.element_at(F.array(*[F.lit(x) for x in TYPES]), (n % 8 + 1).cast("int")).alias("product_type"),
        F.when(F.col("role") == "system", "A").when(F.col("role") == "user", "B").otherwise("C").alias("hazard_class"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(days=(c % 30).cast("int"), hours=n.cast("int"))).alias("available_at"),
        F.concat(F.lit("algo."), (c % 6).cast("string")).alias("created_by_algorithm"), F.sha2("text", 256).alias("content_sha256"),
        (c % 5).cast("string").alias("config_sha256"), F.concat(F.lit("cell:"), c.cast("string")).alias("cell_id"), F.col("text").alias("payload_json"))


def lineage_edges(spark, d) -> DataFrame:
    w = t.W.partitionBy("conv_id").orderBy("turn")
    return products(spark, d).withColumn("parent_product_id", F.lag("product_id").over(w)).filter("parent_product_id is not null").select(
        F.col("product_id").alias("child_product_id"), "parent_product_id", F.lit("input").alias("role"))


def algorithms(spark, d) -> DataFrame:
    """One algorithm per conversation residue, classes and contracts derived from it."""
    k = F.col("conv_id") % 6
    return t.table(spark, d, "conversations").select(k.alias("k")).distinct().select(
        F.concat(F.lit("algo."), F.col("k").cast("string")).alias("algorithm_id"),
        F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("k") % 3 + 1).cast("int")).alias("hazard_class"),
        (F.col("k") != 4).alias("deterministic"),
        F.array(*[F.lit(x) for x in TYPES[:4]]).alias("inputs"), F.array(*[F.lit(x) for x in TYPES[:6]]).alias("outputs"),
        F.when(F.col("k") == 5, "external_write").otherwise("pure").alias("purity"),
        F.array(F.concat(F.lit("res."), (F.col("k") % 4).cast("string"))).alias("resources"))


_LANES = " || ':' || ".join(
    f"l || ':' || l".replace("l", f"CAST(CAST(CAST('0x' || substr(h, {1 + 16 * k}, 16) AS UBIGINT) AS HUGEINT) - CASE WHEN substr(h, {1 + 16 * k}, 1) >= '8' THEN 18446744073709551616::HUGEINT ELSE 0 END AS VARCHAR)")
    for k in range(4))
view("v_registered", f"""
SELECT *, 'prod_' || left(sha256('available_at=' || CAST(epoch(available_at) AS BIGINT) || '|cell_id=cell:' || conv_id || '|config_sha256=' || config || '|content_sha256=' || content_sha256
  || '|created_by_algorithm=' || created_by_algorithm || '|parents=' || coalesce('1:' || {_LANES}, 'none') || '|product_type=' || product_type), 48) AS made_id
FROM (SELECT p.*, sha256(l.parent_product_id) AS h FROM v_products p LEFT JOIN v_lineage l ON l.child_product_id = p.product_id)
""")


@query("register_products", "M1", "product_id:s product_type:s cell_id:s n_edges:i", """
SELECT made_id AS product_id, product_type, 'cell:' || conv_id AS cell_id, CAST(h IS NOT NULL AS INTEGER) AS n_edges FROM v_registered WHERE conv_id % 3 <> 0
""")
def register_products(spark, d):
    """Registers everything twice, with the parents in two orders, on top of a third already stored."""
    rows = products(spark, d).withColumn("product_key", F.col("product_id")).drop("product_id", "payload_json")
    parents = lineage_edges(spark, d).select(F.col("child_product_id").alias("product_key"), "parent_product_id", "role")
    stored = lineage.product_ids(rows.filter(F.col("conv_id") % 3 == 0), parents)
    no_edges = parents.filter(F.lit(False)).select(F.col("product_key").alias("child_product_id"), "parent_product_id", "role")
    first = lineage.register_products(rows, parents, stored, no_edges)
    # the second delivery, dealt and ordered otherwise, adds nothing
    known = stored.select("product_id").unionByName(first[0].select("product_id"))
    again = lineage.register_products(rows, parents.repartition(5, "parent_product_id").sortWithinPartitions(F.col("parent_product_id").desc()), known, first[1])
    vertices, edges = first[0].unionByName(again[0]), first[1].unionByName(again[1])
    per_child = edges.groupBy(F.col("child_product_id").alias("product_id")).agg(F.count("*").alias("n_edges"))
    return vertices.join(per_child, "product_id", "left").select("product_id", "product_type", "cell_id", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


@query("product_ancestors", "M2", "root_product_id:s product_id:s is_missing:b", """
WITH RECURSIVE r AS (SELECT product_id AS root_product_id, product_id FROM v_products WHERE turn = 5
  UNION SELECT r.root_product_id, l.parent_product_id FROM r JOIN v_lineage l ON l.child_product_id = r.product_id)
SELECT *, product_id LIKE '%:1' AS is_missing FROM r
""")
def product_ancestors(spark, d):
    known = products(spark, d)
    roots = known.filter(F.col("turn") == 5)
    return lineage.ancestors(lineage_edges(spark, d), known.filter(F.col("turn") != 1), roots)


view("v_uses", "SELECT parent_product_id AS product_id, 'algo.' || (c.conv_id % 6) AS algorithm_id FROM v_lineage JOIN v_products c ON c.product_id = child_product_id")


def uses(spark, d) -> DataFrame:
    child = products(spark, d).select(F.col("product_id").alias("child_product_id"), F.col("created_by_algorithm").alias("algorithm_id"))
    return lineage_edges(spark, d).join(child, "child_product_id").select(F.col("parent_product_id").alias("product_id"), "algorithm_id")


@query("audit_lookahead", "M3", INVARIANT, """
SELECT 'NO_LOOKAHEAD' AS invariant_id, product_id AS subject FROM v_uses JOIN v_products USING (product_id) WHERE available_at > TIMESTAMP '2024-01-20'
""")
def audit_lookahead(spark, d):
    from datetime import datetime

    return lineage.audit_lookahead(uses(spark, d), products(spark, d), datetime(2024, 1, 20))


view("v_algo_class", "SELECT 'algo.' || k AS algorithm_id, k, list_extract(['A', 'B', 'C'], CAST(k % 3 + 1 AS INTEGER)) AS cls FROM (SELECT DISTINCT conv_id % 6 AS k FROM conversations)")
view("v_hazard", """
SELECT 'NO_CLASS_A_FROM_CLASS_C' AS invariant_id, algorithm_id || '|' || product_id AS subject FROM v_uses JOIN v_products USING (product_id) JOIN v_algo_class USING (algorithm_id) WHERE cls = 'A' AND hazard_class = 'C'
UNION ALL SELECT 'CLASS_C_CANNOT_CREATE_AUTHORITY', algorithm_id || '|' || product_id FROM v_products JOIN v_algo_class ON algorithm_id = created_by_algorithm
WHERE cls = 'C' AND product_type IN ('order_intent_set.v1', 'risk_decision_set.v1', 'staged_order_set.v1', 'broker_event_set.v1', 'reconciliation_snapshot.v1')
""")


@query("audit_hazard_flow", "M4", INVARIANT, "SELECT * FROM v_hazard")
def audit_hazard_flow(spark, d):
    return lineage.audit_hazard_flow(uses(spark, d), products(spark, d), algorithms(spark, d))


view("v_needs", """
SELECT CASE parent_type WHEN 'risk_decision_set.v1' THEN 'STAGED_ORDER_REQUIRES_APPROVED_RISK' WHEN 'staged_order_set.v1' THEN 'BROKER_EVENT_REQUIRES_STAGED_ORDER' ELSE 'BROKER_EVENT_REQUIRES_RECONCILIATION' END AS invariant_id, product_id AS subject
FROM v_products p JOIN (VALUES ('staged_order_set.v1', 'risk_decision_set.v1'), ('broker_event_set.v1', 'staged_order_set.v1'), ('broker_event_set.v1', 'reconciliation_snapshot.v1')) n(of_type, parent_type) ON of_type = product_type
WHERE NOT EXISTS (SELECT 1 FROM v_lineage l JOIN v_products q ON q.product_id = l.parent_product_id WHERE l.child_product_id = p.product_id AND q.product_type = n.parent_type)
""")


@query("audit_required_parents", "M5", INVARIANT, "SELECT * FROM v_needs")
def audit_required_parents(spark, d):
    return lineage.audit_required_parents(products(spark, d), lineage_edges(spark, d))


@query("audit_contracts", "M6", INVARIANT, f"""
WITH n AS (SELECT product_id AS node_id, CASE WHEN conv_id % 13 = 2 THEN 'algo.none' ELSE created_by_algorithm END AS algorithm_id, product_type, conv_id, turn FROM v_products),
i AS (SELECT child_product_id AS node_id, CASE WHEN conv_id % 11 = 3 THEN parent_product_id || 'x' ELSE parent_product_id END AS from_node_id, CASE WHEN conv_id % 7 = 1 THEN 'other' ELSE 'out' END AS role FROM v_lineage JOIN v_products ON product_id = child_product_id)
SELECT 'UNKNOWN_ALGORITHM' AS invariant_id, node_id AS subject FROM n WHERE algorithm_id = 'algo.none'
UNION ALL SELECT 'UNKNOWN_INPUT_NODE', node_id || '|' || from_node_id FROM i WHERE from_node_id LIKE '%x'
UNION ALL SELECT 'UNKNOWN_INPUT_ROLE', node_id || '|' || from_node_id || '|' || role FROM i WHERE from_node_id NOT LIKE '%x' AND role = 'other'
UNION ALL SELECT 'INPUT_CONTRACT_MISMATCH', i.node_id || '|' || p.product_type FROM i JOIN n p ON p.node_id = i.from_node_id JOIN n ON n.node_id = i.node_id WHERE role = 'out' AND n.algorithm_id <> 'algo.none' AND p.turn % 8 >= 4
UNION ALL SELECT 'OUTPUT_CONTRACT_MISMATCH', node_id || '|' || product_type FROM n WHERE algorithm_id <> 'algo.none' AND turn % 8 >= 6
UNION ALL SELECT 'UNKNOWN_PRODUCT_TYPE', node_id || '|' || product_type FROM n WHERE product_type = 'report.v1'
""")
def audit_contracts(spark, d):
    c = F.col("conv_id")
    made = products(spark, d)
    nodes = made.select(F.col("product_id").alias("node_id"), F.when(c % 13 == 2, F.lit("algo.none")).otherwise(F.col("created_by_algorithm")).alias("algorithm_id"))
    outputs = made.select(F.col("product_id").alias("node_id"), F.lit("out").alias("role"), "product_type")
    keyed = lineage_edges(spark, d).join(made.select(F.col("product_id").alias("child_product_id"), "conv_id"), "child_product_id")
    inputs = keyed.select(
        F.col("child_product_id").alias("node_id"),
        F.when(c % 11 == 3, F.concat("parent_product_id", F.lit("x"))).otherwise(F.col("parent_product_id")).alias("from_node_id"),
        F.when(c % 7 == 1, F.lit("other")).otherwise(F.lit("out")).alias("role"))
    types = made.select("product_type").distinct().filter(F.col("product_type") != "report.v1")
    return lineage.audit_contracts(nodes, inputs, outputs, algorithms(spark, d), types)


@query("audit_modes", "M7", INVARIANT, """
SELECT 'NO_EXTERNAL_WRITE_IN_OBSERVE_OR_SHADOW' AS invariant_id, algorithm_id AS subject FROM v_algo_class WHERE k = 5
UNION ALL SELECT 'UNKNOWN_RESOURCE', algorithm_id || '|res.3' FROM v_algo_class WHERE k % 4 = 3
UNION ALL SELECT 'RESOURCE_MODE', algorithm_id || '|res.' || (k % 4) FROM v_algo_class WHERE k % 4 IN (1, 2)
UNION ALL SELECT 'BROKER_RESOURCE_MODE', algorithm_id || '|res.2' FROM v_algo_class WHERE k % 4 = 2
""")
def audit_modes(spark, d):
    k = F.col("k")
    resources = t.table(spark, d, "conversations").select((F.col("conv_id") % 3).alias("k")).distinct().select(
        F.concat(F.lit("res."), k.cast("string")).alias("resource_id"),
        F.when(k == 2, "broker").otherwise("network").alias("resource_kind"),
        F.when(k == 0, F.array(F.lit("shadow"), F.lit("paper"))).otherwise(F.array(F.lit("paper"))).alias("allowed_modes"))
    nodes = products(spark, d).select(F.col("created_by_algorithm").alias("algorithm_id"))
    return lineage.audit_modes(nodes, algorithms(spark, d), resources, "shadow")


@query("audit_declarations", "M8", INVARIANT, """
SELECT 'DUPLICATE_LAYER' AS invariant_id, 'layer.' || conv_id AS subject FROM conversations GROUP BY conv_id HAVING count(*) > 1
UNION ALL SELECT 'UNKNOWN_PARENT_LAYER', 'layer.' || conv_id || '|layer.none' FROM conversations WHERE conv_id % 9 = 4
UNION ALL SELECT 'DUPLICATE_NODE', conv_id || ':' || role FROM conversations GROUP BY conv_id, role HAVING count(*) > 1
UNION ALL SELECT 'DUPLICATE_OUTPUT_ROLE', conv_id || ':' || role || '|out' FROM conversations GROUP BY conv_id, role HAVING count(*) > 1
UNION ALL SELECT 'UNKNOWN_CELL_LAYER', conv_id || ':' || role || '|gone' FROM conversations WHERE conv_id % 8 = 5
""")
def audit_declarations(spark, d):
    c = F.col("conv_id")
    rows = t.table(spark, d, "conversations")
    layer, node = F.concat(F.lit("layer."), c.cast("string")), F.concat_ws(":", c, "role")
    return lineage.audit_declarations(
        rows.select(layer.alias("layer"), F.when(c % 9 == 4, F.lit("layer.none")).alias("parent")),
        rows.select(node.alias("node_id"), F.when(c % 8 == 5, F.lit("gone")).otherwise(layer).alias("cell_layer")),
        rows.select(node.alias("node_id"), F.lit("out").alias("role")))


@query("audit_cycles", "M9", INVARIANT, """
WITH RECURSIVE e AS (SELECT parent_product_id AS f, child_product_id AS t FROM v_lineage
  UNION SELECT conv_id || ':' || max(turn), conv_id || ':' || min(turn + 1) FROM v_products WHERE conv_id % 7 = 3 GROUP BY conv_id HAVING count(*) > 2),
p AS (SELECT f AS root, t FROM e UNION SELECT p.root, e.t FROM p JOIN e ON e.f = p.t),
c AS (SELECT DISTINCT root FROM p WHERE root = t)
SELECT DISTINCT 'GRAPH_MUST_BE_ACYCLIC' AS invariant_id, t AS subject FROM p JOIN c USING (root)
""")
def audit_cycles(spark, d):
    """Turn chains; every seventh conversation gets an edge from its last to its second turn."""
    forward = lineage_edges(spark, d).select(F.col("parent_product_id").alias("from_node_id"), F.col("child_product_id").alias("to_node_id"))
    back = t.table(spark, d, "conversations").filter(F.col("conv_id") % 7 == 3).groupBy("conv_id").agg(
        F.max("turn").alias("last"), F.min(F.col("turn") + 1).alias("second"), F.count("*").alias("n")).filter("n > 2").select(
        F.concat_ws(":", "conv_id", "last").alias("from_node_id"), F.concat_ws(":", "conv_id", "second").alias("to_node_id"))
    return lineage.audit_cycles(forward.unionByName(back))


@query("replay_compare", "M10", "node_id:s replay_status:s", """
SELECT p.product_id AS node_id, CASE WHEN conv_id % 6 = 4 THEN 'skipped_not_deterministic' WHEN conv_id % 17 = 5 THEN 'node_not_succeeded' WHEN conv_id % 19 = 6 THEN 'config_mismatch'
  WHEN conv_id % 23 = 8 AND l.parent_product_id IS NOT NULL THEN 'parent_mismatch' WHEN turn % 8 = 6 THEN 'exit_code' ELSE 'record_matched' END AS replay_status
FROM v_products p LEFT JOIN v_lineage l ON l.child_product_id = p.product_id
""")
def replay_compare(spark, d):
    c = F.col("conv_id")
    made = products(spark, d)
    nodes = made.select(
        F.col("product_id").alias("node_id"), F.col("created_by_algorithm").alias("algorithm_id"),
        F.when(c % 17 == 5, "failed").otherwise("succeeded").alias("status"),
        F.when(c % 19 == 6, F.lit("changed")).otherwise(F.col("config_sha256")).alias("config_sha256"))
    parents = lineage_edges(spark, d).select(F.col("child_product_id").alias("product_id"), "parent_product_id")
    outputs = made.join(parents, "product_id", "left").select(
        F.col("product_id").alias("node_id"), "product_id",
        F.when(F.col("parent_product_id").isNull() | (c % 23 == 8), F.array().cast("array<string>")).otherwise(F.array("parent_product_id")).alias("input_product_ids"))
    return lineage.replay_compare(nodes, outputs, made, lineage_edges(spark, d), algorithms(spark, d))


@query("violation_table", "M11", "workflow_run_id:s invariant_id:s subject_json:s severity:s", """
SELECT 'wf-1' AS workflow_run_id, invariant_id, '{"subject":"' || subject || '"}' AS subject_json, 'error' AS severity FROM (SELECT * FROM v_hazard UNION ALL SELECT * FROM v_needs)
""")
def violation_table(spark, d):
    made, edges = products(spark, d), lineage_edges(spark, d)
    found = [lineage.audit_hazard_flow(uses(spark, d), made, algorithms(spark, d)), lineage.audit_required_parents(made, edges)]
    return lineage.violations(found, "wf-1", stamp())
