"""Reaching definitions of whole locals in compiler bodies, all bodies at once.

Input rows (steps of a block count from 0; its terminator is the step after its statements):

* bodies: body_id, arguments. locals: body_id, local.
* blocks: body_id, block, statements (their number), term_kind.
* effects: body_id, block, step, action, local; action: use, move, storage_live, storage_dead, def.
* unknowns: body_id, block, step, effect: effects on memory that no local names.
* edges: body_id, block, target, kind. returns: body_id, block, local: locals that a normal return of the block's call assigns.

A step reads first (use, move), then clears (move, storage_live, storage_dead), then defines. So of a block only the last step
that touches a local matters to what leaves it: its definition, or none. A local without a definition is a definition too, of no
place, which makes "may be uninitialised" a matter of union like all else. Arguments are defined at the entry, other locals have
none there. Normal edges define what the call returns; imaginary edges never run. Unknown effects taint what comes after them.

Rounds push facts that are new to a block over its edges until none is; a round handles its delta only, of all bodies.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.graphs import _cut

#: The order of points, and what a suspension adds to its terminator's unknown effects.
ENTRY, STATEMENT, TERMINATOR, RETURN = range(4)
SUSPENDED = "external_state"
READS, CLEARS = ("use", "move"), ("move", "storage_live", "storage_dead")
ACTIONS = ("use", "move", "storage_live", "storage_dead", "def")
EDGES = ("normal", "switch_value", "otherwise", "unwind", "resume", "coroutine_drop", "imaginary")
#: The local of the fact that an unknown effect has happened.
TAINT = -1
_KEY = ["body_id", "block"]


class Dataflow(NamedTuple):
    """reachable: body_id, block. definitions: body_id, local, point. uses: body_id, local, point, reaching,
    may_be_uninitialized, possibly_changed_by_unknown_memory. unknown_effects: body_id, point, effects. bodies: body_id, imaginary
    (excluded edges), truncated, coverage."""

    reachable: DataFrame
    definitions: DataFrame
    uses: DataFrame
    unknown_effects: DataFrame
    bodies: DataFrame


def point(kind: Column | int, block: Column | None = None, at: Column | None = None) -> Column:
    """A place in a body as a struct that sorts as points do."""
    number = lambda c: (F.lit(0) if c is None else c).cast("long")
    return F.struct((F.lit(kind) if isinstance(kind, int) else kind).cast("int").alias("kind"), number(block).alias("block"), number(at).alias("at"))


def text(p: Column) -> Column:
    """A point in words: entry, statement b:i, terminator b, normal_return b:t."""
    block, at = p["block"].cast("string"), p["at"].cast("string")
    return (
        F.when(p["kind"] == ENTRY, "entry").when(p["kind"] == STATEMENT, F.concat(F.lit("statement "), block, F.lit(":"), at))
        .when(p["kind"] == TERMINATOR, F.concat(F.lit("terminator "), block)).otherwise(F.concat(F.lit("normal_return "), block, F.lit(":"), at))
    )


def violations(bodies: DataFrame, locals_: DataFrame, blocks: DataFrame, effects: DataFrame, edges: DataFrame, returns: DataFrame) -> DataFrame:
    """(body_id, rule, n): bodies that aren't fit for the analysis, by rule."""
    known = locals_.select("body_id", "local").distinct()
    there = blocks.select("body_id", "block").distinct()
    b, last = bodies.select("body_id", "arguments"), blocks.select("body_id", "block", "statements")
    wanted = b.select("body_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("arguments").cast("long"))).alias("local"))
    checks = [
        ("no_entry_block", b.join(there.where("block = 0"), "body_id", "left_anti")),
        ("duplicate_block", blocks.groupBy("body_id", "block").count().where("count > 1")),
        ("duplicate_local", locals_.groupBy("body_id", "local").count().where("count > 1")),
        ("missing_argument_or_return_local", wanted.join(known, ["body_id", "local"], "left_anti")),
        ("effect_of_missing_local", effects.join(known, ["body_id", "local"], "left_anti")),
        ("return_to_missing_local", returns.join(known, ["body_id", "local"], "left_anti")),
        ("effect_outside_the_block", effects.join(last, _KEY, "left").where("statements is null or step < 0 or step > statements")),
        ("unknown_action", effects.where(~F.col("action").isin(*ACTIONS))),
        ("unknown_edge_kind", edges.where(~F.col("kind").isin(*EDGES))),
        ("missing_successor", edges.join(there.withColumnRenamed("block", "target"), ["body_id", "target"], "left_anti")),
    ]
    rows = [df.select("body_id", F.lit(rule).alias("rule")) for rule, df in checks]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    return every.groupBy("body_id", "rule").agg(F.count("*").alias("n"))


def _spread(seeds: DataFrame, step, keys: list[str]) -> DataFrame:
    """The fixed point of rows under ``step``, which gives what new rows lead to."""
    seen = fresh = _cut(seeds.select(*keys).distinct())
    while not fresh.isEmpty():
        fresh = _cut(step(fresh).select(*keys).distinct().join(seen, keys, "left_anti"))
        seen = seen.unionByName(fresh)
    return seen


def reaching_definitions(bodies: DataFrame, locals_: DataFrame, blocks: DataFrame, effects: DataFrame, unknowns: DataFrame, edges: DataFrame, returns: DataFrame, max_blocks: int = 1000, max_locals: int = 1000) -> Dataflow:
    """What each read of a local may see. Inputs as the module says, without ``violations``; nothing is claimed of unreachable blocks.

    Nothing is claimed of a body of more blocks or locals than the limits either: it is truncated, its coverage partial.
    """
    runs = edges.where("kind <> 'imaginary'").select(*_KEY, "target", (F.col("kind") == "normal").alias("normal"), F.col("kind").isin("resume", "coroutine_drop").alias("suspends"))
    runs = _cut(runs.groupBy(*_KEY, "target", "normal").agg(F.bool_or("suspends").alias("suspends")).repartition("body_id"))
    large = blocks.groupBy("body_id").count().where(F.col("count") > max_blocks).select("body_id").unionByName(locals_.groupBy("body_id").count().where(F.col("count") > max_locals).select("body_id"))
    large = _cut(large.distinct())
    entry = blocks.where("block = 0").select(*_KEY).join(large, "body_id", "left_anti")
    reachable = _spread(entry, lambda fresh: fresh.join(runs, _KEY).select("body_id", F.col("target").alias("block")), _KEY)
    reachable = _cut(reachable)
    terms = blocks.join(reachable, _KEY).select(*_KEY, "statements", "term_kind")
    at = F.when(F.col("step") < F.col("statements"), point(STATEMENT, F.col("block"), F.col("step"))).otherwise(point(TERMINATOR, F.col("block")))
    suspends = runs.where("suspends").select(*_KEY, F.lit(True).alias("ends")).distinct()
    external = terms.join(suspends, _KEY, "left").where("ends or term_kind = 'yield'").select(*_KEY, F.col("statements").alias("step"), F.lit(SUSPENDED).alias("effect"))
    taints = unknowns.join(terms.select(*_KEY), _KEY, "left_semi").select(*_KEY, "step", "effect").unionByName(external).distinct()
    taints = _cut(taints.join(terms, _KEY).select(*_KEY, "step", "effect", at.alias("point")))
    acts = effects.join(terms, _KEY).select(*_KEY, "step", "local", "action", at.alias("point"))
    steps = acts.groupBy(*_KEY, "local", "step", "point").agg(
        F.bool_or(F.col("action").isin(*READS)).alias("reads"), F.bool_or(F.col("action") == "def").alias("defines"), F.bool_or((F.col("action") == "def") | F.col("action").isin(*CLEARS)).alias("touches")
    )
    # What the last touching step before each step left: null if none touched the local yet.
    before = Window.partitionBy(*_KEY, "local").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    left = F.struct(F.when(F.col("defines"), F.col("point")).alias("definition"))
    steps = _cut(steps.withColumn("last", F.last(F.when(F.col("touches"), left), ignorenulls=True).over(before)))
    last = steps.where("touches").groupBy(*_KEY, "local").agg(F.max_by(F.when(F.col("defines"), F.col("point")), "step").alias("point"))
    given = returns.join(reachable, _KEY).select(*_KEY, "local").distinct()
    # A block leaves its own facts once; what passes through it comes in rounds.
    made = last.unionByName(taints.select(*_KEY, F.lit(TAINT).cast("long").alias("local"), F.lit(None).cast(last.schema["point"].dataType).alias("point")).distinct())
    stops = _cut(last.select(*_KEY, "local"))
    given = _cut(given)

    def out(facts: DataFrame) -> DataFrame:
        """Facts at the end of blocks, at the start of what follows."""
        flagged = facts.join(given.withColumn("given", F.lit(True)), [*_KEY, "local"], "left")
        moved = flagged.join(runs, _KEY).where(~(F.col("normal") & F.coalesce("given", F.lit(False))))
        return moved.select("body_id", F.col("target").alias("block"), "local", "point")

    none = F.lit(None).cast(last.schema["point"].dataType)
    first = locals_.join(bodies.select("body_id", "arguments"), "body_id").select("body_id", F.lit(0).cast("long").alias("block"), F.col("local").cast("long").alias("local"), F.when(F.col("local").between(1, F.col("arguments")), point(ENTRY)).otherwise(none).alias("point"))
    first = first.join(entry, _KEY, "left_semi")
    returned = given.join(runs.where("normal"), _KEY).select("body_id", F.col("target").alias("block"), "local", point(RETURN, F.col("block"), F.col("target")).alias("point"))
    seeds = first.unionByName(out(made)).unionByName(returned)
    # A key of strings joins null points too.
    code = F.coalesce(F.concat_ws(":", "point.kind", "point.block", "point.at"), F.lit(""))
    facts = _spread(seeds.withColumn("code", code), lambda fresh: out(_decoded(fresh).join(stops, [*_KEY, "local"], "left_anti")).withColumn("code", code), [*_KEY, "local", "code"])
    facts = _decoded(facts)
    tainted = facts.where(F.col("local") == TAINT).select(*_KEY, F.lit(True).alias("tainted"))
    since = taints.groupBy(*_KEY).agg(F.min("step").alias("since"))
    reads = steps.where("reads").join(tainted, _KEY, "left").join(since, _KEY, "left")
    changed = F.coalesce("tainted", F.lit(False)) | F.coalesce(F.col("since") <= F.col("step"), F.lit(False))
    reads = reads.select(*_KEY, "step", "local", F.col("point").alias("use"), "last", changed.alias("changed"))
    within = reads.where("last is not null").select("body_id", "local", "use", "changed", F.col("last.definition").alias("point"))
    across = reads.where("last is null").join(facts, [*_KEY, "local"], "left").select("body_id", "local", "use", "changed", "point")
    uses = within.unionByName(across).groupBy("body_id", "local", "use", "changed").agg(F.array_sort(F.collect_set("point")).alias("reaching"), F.bool_or(F.col("point").isNull()).alias("bare"))
    uses = uses.select("body_id", "local", text(F.col("use")).alias("point"), F.transform("reaching", text).alias("reaching"), F.col("bare").alias("may_be_uninitialized"), F.col("changed").alias("possibly_changed_by_unknown_memory"))
    defined = steps.where("defines").select("body_id", "local", "point").unionByName(returned.select("body_id", "local", "point")).unionByName(first.where("point is not null").select("body_id", "local", "point"))
    definitions = defined.distinct().select("body_id", "local", text(F.col("point")).alias("point"))
    effects_ = taints.groupBy("body_id", text(F.col("point")).alias("point")).agg(F.array_sort(F.collect_set("effect")).alias("effects"))
    never = edges.where("kind = 'imaginary'").groupBy("body_id").agg(F.count("*").alias("imaginary"))
    unsure = taints.select("body_id", F.lit(True).alias("unsure")).distinct()
    rows = bodies.select("body_id").join(never, "body_id", "left").join(unsure, "body_id", "left").join(large.withColumn("large", F.lit(True)), "body_id", "left").fillna(0, ["imaginary"])
    truncated = F.coalesce("large", F.lit(False))
    coverage = F.when((F.col("imaginary") > 0) | F.coalesce("unsure", F.lit(False)) | truncated, "partial").otherwise("complete")
    return Dataflow(reachable, definitions, uses, effects_, rows.select("body_id", "imaginary", truncated.alias("truncated"), coverage.alias("coverage")))


def _decoded(facts: DataFrame) -> DataFrame:
    part = F.split("code", ":")
    return facts.withColumn("point", F.when(F.col("code") != "", point(part[0].cast("int"), part[1].cast("long"), part[2].cast("long")))).drop("code")
