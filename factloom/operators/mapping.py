"""Bodies to definitions, selected graphs with their frontier, and intervals of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The kinds of definitions that a body of a kind may belong to.
BODY_KINDS = {"function": ("function", "method"), "associated_function": ("function", "method"), "closure_or_coroutine": ("closure",)}


def map_bodies(bodies: DataFrame, definitions: DataFrame, stretch: int = 1024) -> DataFrame:
    """(body_id, definition_id, state) of each body: the narrowest definition of its file around it that suits its kind (BODY_KINDS).

    state: mapped, none around it, or ambiguous if several are as narrow; inactive definitions don't
    count, nor do those of another kind; a body of a kind that isn't in BODY_KINDS has none. A definition is a row for each stretch of its file that it touches, a body one for the stretch of its start, so the
    join's key is (file, stretch) and pairs are few in a file of any length.
    """
    around = definitions.where("cfg_status <> 'inactive'").select(F.col("id").alias("definition_id"), F.col("kind").alias("definition_kind"), "file_id", F.col("start").alias("from"), F.col("stop").alias("to"))
    around = around.where(F.col("from") <= F.col("to")).withColumn("at", F.explode(F.sequence(F.floor(F.col("from") / stretch), F.floor(F.col("to") / stretch))))
    inside = bodies.withColumn("at", F.floor(F.col("start") / stretch)).join(around, ["file_id", "at"]).where((F.col("from") <= F.col("start")) & (F.col("to") >= F.col("stop")))
    suits = F.lit(False)
    for kind, kinds in BODY_KINDS.items():
        suits |= (F.col("kind") == kind) & F.col("definition_kind").isin(*kinds)
    inside = inside.where(suits)
    width = (F.col("to") - F.col("from")).alias("width")
    # Of each width only the count and the least id travel, so a body in many definitions is a row for each width.
    best = inside.select("body_id", width, "definition_id").groupBy("body_id", "width").agg(F.count("*").alias("n"), F.min("definition_id").alias("definition_id"))
    best = best.groupBy("body_id").agg(F.min(F.struct("width", "n", "definition_id")).alias("b"))
    rows = bodies.select("body_id").join(best, "body_id", "left")
    one = F.col("b.n") == 1
    return rows.select("body_id", F.when(one, F.col("b.definition_id")).alias("definition_id"), F.when(F.col("b").isNull(), "none").when(one, "mapped").otherwise("ambiguous").alias("state"))


def frontier(nodes: DataFrame, relations: DataFrame, max_nodes: int) -> DataFrame:
    """(source_id, relation_id, reason) of calls that leave the ``max_nodes`` nodes of the smallest ids.

    A call without a target keeps its reason; a target outside the selection and a source outside it that calls in are
    external boundaries.
    """
    chosen = nodes.select("id").orderBy("id").limit(max_nodes)
    calls = relations.where("kind = 'calls'")
    sources = chosen.select(F.col("id").alias("source_id"), F.lit(True).alias("from_in"))
    targets = chosen.select(F.col("id").alias("target_id"), F.lit(True).alias("to_in"))
    rows = calls.join(sources, "source_id", "left").join(targets, "target_id", "left")
    inner, outer = F.coalesce("from_in", F.lit(False)), F.coalesce("to_in", F.lit(False))
    reason = F.when(inner & F.col("target_id").isNull(), F.col("reason")).when(inner != outer, "external_boundary")
    return rows.select("source_id", F.col("id").alias("relation_id"), reason.alias("reason")).where("reason is not null")


def matching_intervals(streams: DataFrame) -> DataFrame:
    """(stream_id, interval) from the first to the last timestamp of each stream; null if a timestamp decreases."""
    last = F.lag("timestamp").over(Window.partitionBy("stream_id").orderBy("pos"))
    rows = streams.withColumn("back", F.coalesce(F.col("timestamp") < last, F.lit(False)))
    return rows.groupBy("stream_id").agg(F.when(~F.bool_or("back"), F.max_by("timestamp", "pos") - F.min_by("timestamp", "pos")).alias("interval"))
