"""Products, their lineage and the graph checks.

Frames: products (product_id, product_type, hazard_class, available_at, created_by_algorithm,
...), lineage (child_product_id, parent_product_id, role), nodes (node_id, algorithm_id, ...),
edges (from_node_id, to_node_id, product_role) and contract tables of algorithms, resources
and product types.  Checks return (invariant_id, subject, explanation).
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundaflow import vocab
from fundaflow.functions.dates import as_utc
from fundaflow.functions.ids import LANES, hash_lanes, set_digest, short_id
from fundaflow.session import cut_lineage
from fundaflow.sources.tables import new_rows


def _found(df: DataFrame, invariant: str, subject: Column, explanation: Column) -> DataFrame:
    return df.select(F.lit(invariant).alias("invariant_id"), subject.cast("string").alias("subject"), explanation.alias("explanation"))


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# ---- registration and closure ---------------------------------------------------------------------

def product_ids(new: DataFrame, parents: DataFrame) -> DataFrame:
    """Adds `product_id`: a hash of content, maker and the set of parents.

    `new` has a `product_key`; `parents` lists (product_key, parent_product_id, role).  The
    parent set enters as an order-free digest of the whole parent hashes, which combines on the
    map side however many parents a product has; without parents it is the text `none`.
    """
    sets = parents.select("product_key", "parent_product_id").groupBy("product_key").agg(
        set_digest(F.sha2("parent_product_id", 256)).alias("parent_set"))
    joined = new.join(sets, "product_key", "left")
    return joined.withColumn("product_id", short_id(
        "prod_", 48, product_type=F.col("product_type"), cell_id=F.col("cell_id"), content_sha256=F.col("content_sha256"),
        created_by_algorithm=F.col("created_by_algorithm"), config_sha256=F.col("config_sha256"),
        available_at=(F.col("available_at"), "time"), parents=F.coalesce("parent_set", F.lit("none")),
    )).drop("parent_set")


def register_products(new: DataFrame, parents: DataFrame, products: DataFrame, lineage: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertex and edge rows to append; known products and edges are left out."""
    identified = product_ids(new, parents)
    edges = parents.join(identified.select("product_key", F.col("product_id").alias("child_product_id")), "product_key").select(
        "child_product_id", "parent_product_id", "role")
    vertices = new_rows(products, identified.drop("product_key"), ["product_id"])
    return vertices, new_rows(lineage, edges, ["child_product_id", "parent_product_id", "role"])


def _doubled(step: DataFrame) -> DataFrame:
    """(a, b) for walks of two steps; walks that end where they began are left out."""
    further = step.select(F.col("b").alias("m"), F.col("a").alias("first"))
    onward = step.select(F.col("a").alias("m"), F.col("b").alias("second"))
    return further.join(onward, "m").where("first != second").select(F.col("first").alias("a"), F.col("second").alias("b")).distinct()


def ancestors(lineage: DataFrame, products: DataFrame, roots: DataFrame) -> DataFrame:
    """All products reachable from each root through its parents, the root included.

    Path doubling: after round i everything within 2^i - 1 steps of a root is known, and `step` holds the
    pairs that are 2^i steps apart, so a chain of n products takes log2(n) + 2 rounds.  What a round adds lies
    2^i steps beyond what was known; when it adds nothing there is nothing further away.  No shortest path
    returns to a product, so steps that do are left out, and cycles end.  Only what is reachable from the roots
    is kept per root; pairs of `step` are as many as products have ancestors at just that distance.  Products
    missing from the table are marked.
    """
    step = cut_lineage(lineage.select(F.col("child_product_id").alias("a"), F.col("parent_product_id").alias("b")).where("a != b").distinct())
    visited = cut_lineage(roots.select(F.col("product_id").alias("root_product_id"), "product_id").distinct())
    while True:
        reached = visited.join(step, visited["product_id"] == step["a"]).select("root_product_id", F.col("b").alias("product_id")).distinct()
        fresh = cut_lineage(reached.join(visited, ["root_product_id", "product_id"], "left_anti"))
        if fresh.isEmpty():
            break
        visited = visited.unionByName(fresh)
        step = cut_lineage(_doubled(step))
    known = products.select("product_id", F.lit(True).alias("known")).distinct()
    return visited.join(known, "product_id", "left").select("root_product_id", "product_id", F.col("known").isNull().alias("is_missing"))


def ancestor_edges(lineage: DataFrame, closure: DataFrame) -> DataFrame:
    """Lineage edges between the products of each closure."""
    return closure.select("root_product_id", F.col("product_id").alias("child_product_id")).join(lineage, "child_product_id").select(
        "root_product_id", "child_product_id", "parent_product_id", "role")


# ---- checks on stored products ----------------------------------------------------------------------

def audit_lookahead(uses: DataFrame, products: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """Consumed products that became available after the decision time.

    `uses` has product_id and, unless one time is given for all, decision_as_of.
    """
    moment = F.col("decision_as_of") if as_of is None else as_utc(as_of)
    late = uses.join(products.select("product_id", "available_at"), "product_id").filter(F.col("available_at") > moment)
    return _found(late, "NO_LOOKAHEAD", F.col("product_id"),
                  F.concat(F.lit("product "), "product_id", F.lit(" became available after decision_as_of")))


def audit_hazard_flow(uses: DataFrame, products: DataFrame, algorithms: DataFrame) -> DataFrame:
    """Class A must not consume class C; class C must not create authority products.

    `uses` links algorithm_id to the consumed product_id.
    """
    classes = algorithms.select("algorithm_id", F.col("hazard_class").alias("algorithm_class"))
    consumed = (
        uses.join(products.select("product_id", "product_type", "hazard_class"), "product_id")
        .join(classes, "algorithm_id")
        .filter((F.col("algorithm_class") == "A") & (F.col("hazard_class") == "C"))
    )
    created = products.join(classes, F.col("created_by_algorithm") == F.col("algorithm_id")).filter(
        (F.col("algorithm_class") == "C") & F.col("product_type").isin(*vocab.AUTHORITY_PRODUCT_TYPES))
    return union([
        _found(consumed, "NO_CLASS_A_FROM_CLASS_C", F.concat_ws("|", "algorithm_id", "product_id"),
               F.concat(F.lit("Class A algorithm "), "algorithm_id", F.lit(" cannot consume Class C product "), "product_type")),
        _found(created, "CLASS_C_CANNOT_CREATE_AUTHORITY", F.concat_ws("|", "algorithm_id", "product_id"),
               F.concat(F.lit("Class C algorithm "), "algorithm_id", F.lit(" cannot create authority product "), "product_type")),
    ])


# Fixed values: (product type, parent type it needs, invariant)
REQUIRED_PARENTS = (
    ("staged_order_set.v1", "risk_decision_set.v1", "STAGED_ORDER_REQUIRES_APPROVED_RISK"),
    ("broker_event_set.v1", "staged_order_set.v1", "BROKER_EVENT_REQUIRES_STAGED_ORDER"),
    ("broker_event_set.v1", "reconciliation_snapshot.v1", "BROKER_EVENT_REQUIRES_RECONCILIATION"),
)


def audit_required_parents(products: DataFrame, lineage: DataFrame) -> DataFrame:
    """Staged orders need a risk decision, broker events a staged order and a reconciliation."""
    types = products.select(F.col("product_id").alias("parent_product_id"), F.col("product_type").alias("parent_type"))
    has = lineage.join(types, "parent_product_id").select(F.col("child_product_id").alias("product_id"), "parent_type").distinct()
    needs = products.select(
        "product_id", "product_type",
        F.explode(F.filter(F.array(*[
            F.struct(F.lit(t).alias("of_type"), F.lit(p).alias("parent_type"), F.lit(i).alias("invariant")) for t, p, i in REQUIRED_PARENTS
        ]), lambda r: r["of_type"] == F.col("product_type"))).alias("need"),
    ).select("product_id", "product_type", "need.parent_type", "need.invariant")
    lost = needs.join(has, ["product_id", "parent_type"], "left_anti")
    return lost.select(
        F.col("invariant").alias("invariant_id"), F.col("product_id").alias("subject"),
        F.concat("product_type", F.lit(" without parent "), "parent_type").alias("explanation"))


# ---- checks on declarations ---------------------------------------------------------------------------

def audit_contracts(nodes: DataFrame, inputs: DataFrame, outputs: DataFrame, algorithms: DataFrame, product_types: DataFrame) -> DataFrame:
    """Types and names used by nodes that their contracts do not declare.

    nodes (node_id, algorithm_id); inputs (node_id, from_node_id, role); outputs (node_id,
    role, product_type); algorithms (algorithm_id, inputs, outputs as arrays).
    """
    contracts = algorithms.select("algorithm_id", F.col("inputs").alias("may_read"), F.col("outputs").alias("may_write"))
    stranger = nodes.join(contracts.select("algorithm_id"), "algorithm_id", "left_anti")
    known = nodes.join(contracts, "algorithm_id")
    node_ids = nodes.select(F.col("node_id").alias("from_node_id")).distinct()
    produced = outputs.select(F.col("node_id").alias("from_node_id"), "role", "product_type")
    no_node = inputs.join(node_ids, "from_node_id", "left_anti")
    placed = inputs.join(node_ids, "from_node_id", "left_semi")
    no_role = placed.join(produced, ["from_node_id", "role"], "left_anti")
    read = placed.join(produced, ["from_node_id", "role"]).join(known.select("node_id", "algorithm_id", "may_read"), "node_id")
    wrote = outputs.join(known.select("node_id", "algorithm_id", "may_write"), "node_id")
    no_type = outputs.join(product_types.select("product_type"), "product_type", "left_anti")
    key = F.concat_ws("|", "node_id", "product_type")
    return union([
        _found(stranger, "UNKNOWN_ALGORITHM", F.col("node_id"), F.concat(F.lit("unknown algorithm "), "algorithm_id")),
        _found(no_node, "UNKNOWN_INPUT_NODE", F.concat_ws("|", "node_id", "from_node_id"), F.concat(F.lit("unknown input node "), "from_node_id")),
        _found(no_role, "UNKNOWN_INPUT_ROLE", F.concat_ws("|", "node_id", "from_node_id", "role"), F.concat(F.lit("missing role "), "role")),
        _found(read.filter(~F.array_contains("may_read", F.col("product_type"))), "INPUT_CONTRACT_MISMATCH", key,
               F.concat("algorithm_id", F.lit(" does not declare input "), "product_type")),
        _found(wrote.filter(~F.array_contains("may_write", F.col("product_type"))), "OUTPUT_CONTRACT_MISMATCH", key,
               F.concat("algorithm_id", F.lit(" does not declare output "), "product_type")),
        _found(no_type, "UNKNOWN_PRODUCT_TYPE", key, F.concat(F.lit("unknown product type "), "product_type")),
    ])


def audit_modes(nodes: DataFrame, algorithms: DataFrame, resources: DataFrame, mode: str,
                allow_external_write: bool = False, allow_broker_resource: bool = False) -> DataFrame:
    """What the nodes' algorithms do that the mode does not permit.

    algorithms (algorithm_id, purity, resources as array); resources (resource_id,
    resource_kind, allowed_modes as array).
    """
    used = nodes.select("algorithm_id").distinct().join(algorithms, "algorithm_id")
    submits = mode in vocab.SUBMIT_MODES
    writes = used.filter((F.col("purity") == "external_write") & F.lit(not (submits and allow_external_write)))
    stages = used.filter((F.col("algorithm_id") == vocab.STAGING_ALGORITHM) & F.lit(mode not in vocab.STAGE_MODES))
    holds = used.select("algorithm_id", F.explode("resources").alias("resource_id"))
    bound = holds.join(resources, "resource_id", "left")
    key = F.concat_ws("|", "algorithm_id", "resource_id")
    parts = [
        _found(writes, "NO_EXTERNAL_WRITE_IN_OBSERVE_OR_SHADOW", F.col("algorithm_id"), F.lit(f"external_write purity in mode={mode}")),
        _found(stages, "STAGE_MODE", F.col("algorithm_id"), F.lit(f"cannot stage orders in mode={mode}")),
        _found(bound.filter(F.col("resource_kind").isNull()), "UNKNOWN_RESOURCE", key, F.concat(F.lit("unknown resource "), "resource_id")),
        _found(bound.filter(~F.array_contains("allowed_modes", mode)), "RESOURCE_MODE", key, F.lit(f"resource not allowed in mode={mode}")),
        _found(bound.filter((F.col("resource_kind") == "broker") & F.lit(not (submits and allow_broker_resource))), "BROKER_RESOURCE_MODE", key,
               F.lit(f"broker resource not allowed in mode={mode}")),
    ]
    if mode not in vocab.ALL_MODES:
        one = nodes.sparkSession.range(1)
        parts.append(_found(one, "UNKNOWN_MODE", F.lit(mode), F.lit(f"unknown mode {mode}")))
    return union(parts)


def _repeated(df: DataFrame, keys: Sequence[str], invariant: str, what: str) -> DataFrame:
    twice = df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    return _found(twice, invariant, F.concat_ws("|", *keys), F.concat(F.lit(f"duplicate {what} "), F.concat_ws("|", *keys)))


def audit_declarations(layers: DataFrame, nodes: DataFrame, outputs: DataFrame) -> DataFrame:
    """Duplicate, dangling and blank declarations.

    layers (layer, parent); nodes (node_id, cell_layer); outputs (node_id, role).
    """
    names = layers.select("layer").distinct()
    orphan = layers.filter(F.col("parent").isNotNull()).join(names.select(F.col("layer").alias("parent")), "parent", "left_anti")
    lost_cell = nodes.join(names.select(F.col("layer").alias("cell_layer")), "cell_layer", "left_anti")
    return union([
        _repeated(layers, ["layer"], "DUPLICATE_LAYER", "layer"),
        _repeated(nodes, ["node_id"], "DUPLICATE_NODE", "node"),
        _repeated(outputs, ["node_id", "role"], "DUPLICATE_OUTPUT_ROLE", "output role"),
        _found(orphan, "UNKNOWN_PARENT_LAYER", F.concat_ws("|", "layer", "parent"), F.concat(F.lit("unknown parent "), "parent")),
        _found(lost_cell, "UNKNOWN_CELL_LAYER", F.concat_ws("|", "node_id", "cell_layer"), F.concat(F.lit("unknown cell layer "), "cell_layer")),
        _found(layers.filter(F.trim("layer") == ""), "LAYER_ID_REQUIRED", F.lit(""), F.lit("layer id is required")),
        _found(nodes.filter(F.trim("node_id") == ""), "NODE_ID_REQUIRED", F.lit(""), F.lit("node_id is required")),
    ])


#: Pairs that a doubled graph may have for each edge of the given one.
WALKS = 8


def audit_cycles(edges: DataFrame) -> DataFrame:
    """Nodes on a directed cycle or behind one.

    Each round keeps the edges whose source has an incoming edge; when that removes nothing, what is left is
    the answer.  Between rounds the graph is replaced by that of walks of two edges: nodes on or behind a cycle
    have incoming walks of any length, all others lose theirs, so the next round removes twice as many layers
    of nodes and an acyclic graph of n layers takes log2(n) rounds, however it branches.  Where walks of two
    edges would be many more than edges (inside a large knot of cycles), only sources with a single parent are
    replaced by it, so the graph never grows beyond WALKS times its size.  Both replacements leave walks of
    the graph, and an incoming one from the answer for each node of the answer, so no result depends on them.
    """
    left = cut_lineage(edges.select("from_node_id", "to_node_id").distinct())
    most = WALKS * left.count()
    while True:
        before = left.count()
        fed = left.select(F.col("to_node_id").alias("from_node_id")).distinct()
        kept = cut_lineage(left.join(fed, "from_node_id", "left_semi"))
        if kept.count() in (0, before):
            break
        parents = kept.groupBy(F.col("to_node_id").alias("node")).agg(F.count("*").alias("n"), F.min("from_node_id").alias("parent"))
        walks = kept.join(parents, kept["from_node_id"] == parents["node"])
        if (walks.agg(F.sum("n")).first()[0] or 0) <= most:
            back = kept.select(F.col("from_node_id").alias("first"), F.col("to_node_id").alias("from_node_id"))
            left = cut_lineage(kept.join(back, "from_node_id").select(F.col("first").alias("from_node_id"), "to_node_id").distinct())
        else:
            single = parents.filter("n = 1").select(F.col("node").alias("from_node_id"), "parent")
            left = cut_lineage(kept.join(single, "from_node_id", "left").select(F.coalesce("parent", "from_node_id").alias("from_node_id"), "to_node_id").distinct())
    nodes = kept.select(F.col("to_node_id").alias("node_id")).distinct()
    return _found(nodes, "GRAPH_MUST_BE_ACYCLIC", F.col("node_id"), F.lit("workflow graph contains a directed cycle"))


def replay_compare(nodes: DataFrame, node_outputs: DataFrame, products: DataFrame, lineage: DataFrame, algorithms: DataFrame) -> DataFrame:
    """Recorded products against what their node would produce again: one status per product.

    nodes (node_id, algorithm_id, status, config_sha256), node inputs as rows are in
    `node_outputs` (node_id, product_id, input_product_ids as array of the node).  Parents of a
    product are compared as sets through order-free digests, never collected.
    """
    stored = lineage.select("child_product_id", "parent_product_id").distinct().groupBy("child_product_id").agg(
        F.count("*").alias("parent_count"), *[F.bit_xor(lane).alias(f"parent_{k}") for k, lane in enumerate(hash_lanes(F.sha2("parent_product_id", 256)))])
    none = F.array_repeat(F.lit(0).cast("long"), LANES)
    hashes = F.transform(F.array_distinct("input_product_ids"), lambda p: F.array(*hash_lanes(F.sha2(p, 256))))
    expected = F.aggregate(hashes, none, lambda a, b: F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)))
    found = F.coalesce(F.array(*[F.col(f"parent_{k}") for k in range(LANES)]), none)
    made = products.select(
        "product_id", "product_type", "created_by_algorithm", F.col("config_sha256").alias("product_config"), "content_sha256", "payload_json")
    rows = (
        node_outputs.withColumn("want_count", F.size(F.array_distinct("input_product_ids"))).withColumn("want_digest", expected)
        .join(nodes, "node_id")
        .join(algorithms.select("algorithm_id", "deterministic"), "algorithm_id", "left")
        .join(made, "product_id", "left")
        .join(stored.withColumnRenamed("child_product_id", "product_id"), "product_id", "left")
    )
    parents_equal = (F.coalesce("parent_count", F.lit(0)) == F.col("want_count")) & (
        F.when(F.col("parent_count").isNull(), none).otherwise(found) == F.col("want_digest"))
    is_command = F.col("product_type") == vocab.COMMAND_OUTPUT
    status = (
        F.when(F.col("deterministic").isNull(), F.lit("algorithm_not_found"))
        .when(~F.col("deterministic"), F.lit("skipped_not_deterministic"))
        .when(F.col("status") != "succeeded", F.lit("node_not_succeeded"))
        .when(F.col("product_type").isNull(), F.lit("missing_product"))
        .when(F.col("created_by_algorithm") != F.col("algorithm_id"), F.lit("creator_mismatch"))
        .when(F.col("product_config") != F.col("config_sha256"), F.lit("config_mismatch"))
        .when(~parents_equal, F.lit("parent_mismatch"))
        .when(is_command & (F.sha2("payload_json", 256) != F.col("content_sha256")), F.lit("content_mismatch"))
        .when(is_command & (F.coalesce(F.get_json_object("payload_json", "$.exit_code").try_cast("int"), F.lit(-1)) != 0), F.lit("exit_code"))
        .otherwise(F.lit("record_matched"))
    )
    return rows.select("node_id", "product_id", status.alias("replay_status"))


def violations(audits: Sequence[DataFrame], workflow_run_id: str, created_at: Column) -> DataFrame:
    """All findings of a run as rows of the violation table."""
    every = union(audits)
    return every.select(
        short_id("viol_", 48, workflow_run_id=F.lit(workflow_run_id), invariant_id=F.col("invariant_id"), subject=F.col("subject"),
                 created_at=(created_at, "time")).alias("violation_id"),
        F.lit(workflow_run_id).alias("workflow_run_id"), "invariant_id",
        F.to_json(F.struct("subject")).alias("subject_json"), F.lit("error").alias("severity"), "explanation",
        created_at.alias("created_at"),
    )
