"""Control flow of bodies: reachability, cyclomatic complexity, shapes of terminators, reaching definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.graphs import _cut

#: For each kind of terminator the least and most successors by kind (others: none) and the unwind action it has.
SHAPES = {
    "goto": ({"normal": (1, 1)}, "none"),
    "switch_int": ({"otherwise": (1, 1), "switch_value": (0, None)}, "none"),
    "return": ({}, "none"),
    "unwind_resume": ({}, "none"),
    "unreachable": ({}, "none"),
    "coroutine_drop": ({}, "none"),
    "tail_call": ({}, "none"),
    "unwind_terminate": ({}, "terminate"),
    "drop": ({"normal": (1, 1), "coroutine_drop": (0, 1), "unwind": (0, 1)}, "some"),
    "call": ({"normal": (0, 1), "unwind": (0, 1)}, "some"),
    "assert": ({"normal": (1, 1), "unwind": (0, 1)}, "some"),
    "false_unwind": ({"normal": (1, 1), "unwind": (0, 1)}, "some"),
    "yield": ({"resume": (1, 1), "coroutine_drop": (0, 1)}, "none"),
    "false_edge": ({"normal": (1, 1), "imaginary": (1, 1)}, "none"),
    "inline_asm": ({"normal": (0, None), "unwind": (0, 1)}, "some"),
}
KINDS = ("normal", "otherwise", "switch_value", "unwind", "coroutine_drop", "resume", "imaginary")
#: The greatest switch value, of 128 bits.
GREATEST = str(2**128 - 1)


def reachable(edges: DataFrame, entry: int = 0) -> DataFrame:
    """(body_id, block) of the blocks that the entry block of a body reaches, all bodies at once."""
    steps = _cut(edges.select("body_id", "block", "target").distinct())  # each round reads them
    seen = _cut(steps.select("body_id", F.lit(entry).cast(edges.schema["block"].dataType).alias("block")).distinct())
    front = seen
    while not front.isEmpty():
        found = front.join(steps, ["body_id", "block"]).select("body_id", F.col("target").alias("block")).distinct()
        front = _cut(found.join(seen, ["body_id", "block"], "left_anti"))
        seen = _cut(seen.unionByName(front))
    return seen


def cyclomatic(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """(body_id, nodes, edges, exits, cyclomatic) of each body: E - N + 2 with one exit node and an edge from each exit.

    blocks: body_id, block, term_kind, unwind; edges: body_id, block, target, kind. Imaginary successors and the unwinding of
    a false_unwind never run and don't count; parallel successors do. An exit is a block without a successor or one whose
    unwinding leaves the body (continue, terminate; not of a false_unwind). Only blocks that the entry reaches count. A body
    without an exit has no complexity (null), never 0.
    """
    terms = blocks.select("body_id", "block", (F.col("term_kind") == "false_unwind").alias("never"), F.coalesce(F.col("unwind").isin("continue", "terminate"), F.lit(False)).alias("leaves"))
    runs = edges.join(terms, ["body_id", "block"]).where("kind <> 'imaginary' and not (never and kind = 'unwind')").select("body_id", "block", "target")
    seen = reachable(runs.unionByName(blocks.select("body_id", F.col("block"), F.col("block").alias("target")).where("block = 0")))
    outs = runs.groupBy("body_id", "block").agg(F.count("*").alias("n"))
    rows = seen.join(terms, ["body_id", "block"]).join(outs, ["body_id", "block"], "left").fillna(0, ["n"])
    exit = (F.col("leaves") & ~F.col("never")) | (F.col("n") == 0)
    rows = rows.groupBy("body_id").agg((F.count("*") + 1).alias("nodes"), F.sum("n").alias("runtime"), F.count_if(exit).alias("exits"))
    total = F.col("runtime") + F.col("exits")
    return rows.select("body_id", "nodes", total.alias("edges"), "exits", F.when(F.col("exits") > 0, total - F.col("nodes") + 2).alias("cyclomatic"))


def shape_violations(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """(body_id, block, term_kind, rules) of blocks whose successors don't suit their terminator; rules, joined by commas:

    switch_values (a switch edge without a value, one that isn't a canonical number of 128 bits, twice the same, or a value
    elsewhere), unwind_edge (a cleanup without exactly one unwind edge to its target, or an unwind edge without a cleanup),
    shape (SHAPES; unknown kinds have none).
    """
    value, switch = F.col("switch_value"), F.col("kind") == "switch_value"
    number = value.rlike(r"\A(0|[1-9][0-9]{0,38})\z") & ((F.length(value) < len(GREATEST)) | (value <= GREATEST))
    bad = F.when(switch, ~F.coalesce(number, F.lit(False))).otherwise(value.isNotNull())
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS]
    out = edges.groupBy("body_id", "block").agg(
        *counts, F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.countDistinct(F.when(switch, value)).alias("values"), F.min(F.when(F.col("kind") == "unwind", F.col("target"))).alias("unwinds_to")
    )
    rows = blocks.join(out, ["body_id", "block"], "left").fillna(0, ["n", "bad", "values", *(f"n_{k}" for k in KINDS)])
    cleanup = F.coalesce(F.col("unwind") == "cleanup", F.lit(False))
    to_target = F.coalesce((F.col("n_unwind") == 1) & (F.col("unwinds_to") == F.col("unwind_target")), F.lit(False))
    suits = F.lit(False)
    for kind, (most, unwind) in SHAPES.items():
        fits = F.col("n") == sum((F.col(f"n_{k}") for k in most), F.lit(0))
        for k, (low, high) in most.items():
            fits &= F.col(f"n_{k}").between(low, high) if high is not None else F.col(f"n_{k}") >= low
        fits &= {"none": F.col("unwind").isNull(), "some": F.col("unwind").isNotNull(), "terminate": F.coalesce(F.col("unwind") == "terminate", F.lit(False))}[unwind]
        suits |= (F.col("term_kind") == kind) & fits
    rules = F.concat_ws(
        ",", F.when((F.col("bad") > 0) | (F.col("values") < F.col("n_switch_value")), "switch_values"), F.when(F.when(cleanup, ~to_target).otherwise(F.col("n_unwind") > 0), "unwind_edge"),
        F.when(~F.coalesce(suits, F.lit(False)), "shape"),
    )
    return rows.select("body_id", "block", "term_kind", rules.alias("rules")).where("rules <> ''")


def reaching_definitions(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """(body_id, block, local, defined_in): which definitions of the local that a block reads reach its start.

    blocks: defines and uses name one local each. A definition in a block ends those that come in; only blocks that the
    entry block 0 reaches define anything. Rounds of joins over all bodies push definitions that are new to a block until
    none is.
    """
    ends = _cut(edges.select("body_id", "block", "target").distinct())
    kills = blocks.select("body_id", "block", F.col("defines").alias("local"))
    entered = reachable(ends.unionByName(blocks.where("block = 0").select("body_id", "block", F.col("block").alias("target"))))
    made = kills.join(entered, ["body_id", "block"], "left_semi").select("body_id", "block", "local", F.col("block").alias("defined_in"))
    reach = None
    front = made
    while True:
        inflow = front.join(ends, ["body_id", "block"]).select("body_id", F.col("target").alias("block"), "local", "defined_in").distinct()
        fresh = _cut(inflow if reach is None else inflow.join(reach, ["body_id", "block", "local", "defined_in"], "left_anti"))
        if fresh.isEmpty():
            break
        reach = fresh if reach is None else _cut(reach.unionByName(fresh))
        front = fresh.join(kills, ["body_id", "block", "local"], "left_anti")
    reach = made.limit(0) if reach is None else reach
    uses = blocks.select("body_id", "block", F.col("uses").alias("local"))
    return reach.join(uses, ["body_id", "block", "local"])
