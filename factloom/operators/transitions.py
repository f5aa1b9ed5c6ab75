"""State transitions of an enum in a function, from token rows: arms of top-level matches that assign the matched local.

A selection names a function of a file, an enum's path and a local. Nothing is inferred where the local may be another one than it looks:
if the function has not exactly one binding of that name, a direct one without a reference, or a macro, an attribute, a
reference or a copy of the local. Candidates are syntax: they don't say that a state is reachable, and a missing one isn't
impossible.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators import syntax
from factloom.operators.graphs import _stored


class Transitions(NamedTuple):
    """candidates: selection, from_variant, to_variant, guard, first, last (tokens of the arm). unknowns: selection, reason, seq."""

    candidates: DataFrame
    unknowns: DataFrame


def _tokens(rows: DataFrame, chosen: DataFrame, id: str) -> DataFrame:
    """The tokens of the chosen functions that tell something, by windows within the file; no table of tokens is joined with another.

    (selection, enum, state, seq, word, around), reasons (those that withhold the selection), clean (whether it has none), other (the reason
    of a match that isn't read), end (at the first token of the braces of a match of the local: the closing one), arrow (of an arm),
    opens (whether a brace follows the arrow) and block (its closing one).
    """
    names = ["first", "last", "body", "chosen"]
    spans = chosen.groupBy(id, "first", "last", "body").agg(F.collect_list(F.struct("selection", "enum", "state")).alias("chosen"))
    level = _stored(syntax.enclosing(spans, id))
    own = level.select(id, F.col("first").alias("parent"), F.struct(*names).alias("up"))
    level = level.join(own, [id, "parent"], "left").withColumn("own", F.struct(*names))
    # Where a function begins its tokens are its own, where it ends those of the one around it.
    mark = lambda seq, o, own, deep: F.struct(F.col(seq).alias("seq"), F.lit(o).alias("o"), deep.alias("l"), F.col(own).alias("own"))
    marks = level.select(id, F.explode(F.array(mark("first", 0, "own", F.col("level")), mark("last", 2, "up", -F.col("level")))).alias("m")).select(id, "m.*")
    points = rows.select(id, "seq", F.lit(1).alias("o"), "kind", "word", "around", "close", "balanced")
    every = points.unionByName(marks, allowMissingColumns=True)
    order = Window.partitionBy(id).orderBy("seq", "o", F.coalesce("l", F.lit(0))).rowsBetween(Window.unboundedPreceding, -1)
    held = every.withColumn("own", F.last(F.when(F.col("o") != 1, F.struct("own")), ignorenulls=True).over(order)["own"]).where("o = 1")
    file, text = Window.partitionBy(id).orderBy("seq"), F.coalesce("word", F.lit(""))
    near = {f"b{k}": F.lag(text, k).over(file) for k in (1, 2, 3, 4)} | {f"n{k}": F.lead(text, k).over(file) for k in (1, 2)}
    held = held.withColumns(near | {"before": F.lag(F.struct("around", "close")).over(file), "block": F.lead("close", 2).over(file)}).where("own is not null")
    held = held.withColumns({"first": F.col("own.first"), "body": F.col("own.body"), "_s": F.explode("own.chosen")}).select("*", "_s.*").drop("own", "_s")
    word, state = F.col("word"), F.col("state")
    b1, b2, b3, b4, n1, n2 = (F.coalesce(c, F.lit("")) for c in ("b1", "b2", "b3", "b4", "n1", "n2"))
    mutable = F.when(b1 == "mut", b2).otherwise(b1)
    by_name = (F.col("kind") == "ident") & (word == state)
    declared = by_name & ((mutable == "let") | (mutable == "ref") | mutable.isin("(", ",", "|") & (n1 == ":") & (n2 != ":") | (mutable == "|") & n1.isin("|", ",") | (n1 == "=") & (n2 == ">") | (mutable == "(") & n1.isin(")", ",") & (b2 == "Some"))
    direct = declared & ((mutable == "let") & (F.col("around") == F.col("body")) | mutable.isin("(", ",") & (n1 == ":") & (F.col("seq") < F.col("body")))
    typed = declared & (n1 == ":") & (n2 == "&")
    alias = by_name & (b1 == "=") & (n1 == ";") & ((b3 == "let") | (b3 == "mut") & (b4 == "let"))
    taken = (word == "&") & ((n1 == state) | (n1 == "mut") & (n2 == state) | (n1 == "(") & (n2 == state))
    macro = (word == "!") & b1.rlike(r"^\w+$") & n1.isin(*syntax.OPENS) & ~b1.isin("if", "while", "return", "match", "in")
    reason = (
        F.when(macro, "macro").when((word == "#") & n1.isin("[", "!"), "attribute").when(taken, "reference").when(alias, "copy")
        .when(declared & (~direct | typed), "indirect_binding").when(~F.col("balanced") | (F.col("kind") == "error"), "broken_source")
    )
    top = F.col("around") == F.col("body")
    begins = top & (word == "match") & b1.isin("{", ";", "}")
    of_state = begins & (n1 == state) & (n2 == "{")
    # The first token in the braces of such a match knows it as well: the match stands three tokens before it.
    opened = (F.col("seq") == F.col("around") + 1) & (b1 == "{") & (b2 == state) & (b3 == "match") & b4.isin("{", ";", "}") & (F.col("before.around") == F.col("body"))
    held = held.select(
        id, "selection", "enum", "state", "seq", "word", "around", "first", F.coalesce(declared, F.lit(False)).alias("declared"), reason.alias("reason"), F.coalesce(begins, F.lit(False)).alias("begins"), F.coalesce(of_state, F.lit(False)).alias("of_state"),
        (F.coalesce((word == "match") & (n1 == state), F.lit(False)) & ~top).alias("nested"), F.when(opened, F.col("before.close")).alias("close"), F.coalesce((word == "=") & (n1 == ">"), F.lit(False)).alias("arrow"), (n2 == "{").alias("opens"), "block",
    )
    whole = Window.partitionBy(id, "selection")
    held = held.withColumns({"n": F.count_if("declared").over(whole), "bound": F.min(F.when(F.col("declared"), F.col("seq"))).over(whole), "odd": F.count("reason").over(whole)})
    one = F.col("n") == 1
    reasons = F.array_compact(F.array("reason", F.when((F.col("seq") == F.col("first")) & ~one, "not_one_binding")))
    bound = F.col("bound")
    # A match before the binding is another one.
    other = F.when(F.col("begins") & ~(F.col("of_state") & (F.col("seq") > bound)), "other_match").when(F.col("nested"), "nested_match")
    held = held.select(
        "selection", "enum", "state", "seq", "word", "around", reasons.alias("reasons"), (one & (F.col("odd") == 0)).alias("clean"), other.alias("other"),
        F.when(F.col("seq") - 3 > bound, F.col("close")).alias("end"), "arrow", "opens", "block",
    )
    return held.where(F.col("clean") | (F.size("reasons") > 0))


def transitions(rows: DataFrame, selections: DataFrame, id: str = "file_id") -> Transitions:
    """rows: of ``syntax.brackets``; selections: selection, id, function, enum (a path of names joined by ::), state; a function is
    selected once. A file whose brackets don't match tells nothing."""
    functions = syntax.functions(rows, id).withColumnRenamed("name", "function")
    chosen = selections.select("selection", id, "function", "enum", "state").join(functions, [id, "function"])
    live = _stored(_tokens(rows, _stored(chosen), id))
    found = live.select("selection", F.explode("reasons").alias("reason"), "seq")
    live = live.where("clean")
    others = live.where("other is not null").select("selection", F.col("other").alias("reason"), "seq")
    # Arms: what stands between commas at the level of the match. Only arrows, commas and the first token tell where they are.
    group = Window.partitionBy("selection", "around")
    inside = live.where(F.col("end").isNotNull() | F.col("arrow") | (F.col("word") == ",")).drop("reasons", "clean", "other")
    comma = F.last(F.when(F.col("word") == ",", F.col("seq")), ignorenulls=True).over(group.orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1))
    inside = inside.withColumn("comma", comma).withColumn("end", F.max("end").over(group))
    last = F.when(F.col("opens"), F.col("block")).otherwise(F.least(F.coalesce("comma", "end"), "end") - 1)
    arrows = inside.where("arrow and end is not null").select("selection", "enum", "state", "around", F.col("seq").alias("arrow"), last.alias("last"))
    since = F.lag("last").over(group.orderBy("arrow"))
    arms = arrows.withColumn("first", F.coalesce(since, "around") + 1).where("last >= arrow").select("selection", "enum", "state", "first", "last")
    words = syntax.held_by(live.select("selection", "seq", "word"), arms.select("selection", "first", "last"), "selection").where("holder is not null")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.coalesce("word", F.lit('"')).alias("w")))), lambda x: x["w"]), " ")
    texts = words.groupBy("selection", F.col("holder").alias("first")).agg(text.alias("text"))
    told = arms.join(texts, ["selection", "first"])
    path = F.concat(F.lit(r"\Q"), F.replace("enum", F.lit("::"), F.lit(" : : ")), F.lit(r" : : \E(\w+)"))
    place = F.concat(F.lit(r"\Q"), F.col("state"), F.lit(r" = \E"))
    pattern = F.concat(F.lit(r"\A(?:, )?"), path, F.lit(r"( if (?:(?! = > )[^(){}\[\]?#])+)? = > (?:"), place, path, F.lit(r"|\{ "), place, path, F.lit(r"(?: ;)? \})\z"))
    part = lambda k: F.expr(f"regexp_extract(text, pattern, {k})")
    told = told.withColumn("pattern", pattern).withColumns({"from_variant": part(1), "guard": part(2), "a": part(3), "b": part(4)})
    # A guard may compare but not assign.
    plain = ~F.col("guard").rlike(r"(?<![=!<>] )= (?!=)(?! >)(?<! = = )")
    fits = (F.col("from_variant") != "") & ((F.col("guard") == "") | plain)
    candidates = told.where(fits).select("selection", "from_variant", F.when(F.col("a") != "", F.col("a")).otherwise(F.col("b")).alias("to_variant"), F.when(F.col("guard") != "", F.trim("guard")).alias("guard"), "first", "last")
    odd = told.where(~fits).select("selection", F.lit("unsupported_arm").alias("reason"), F.col("first").alias("seq"))
    return Transitions(candidates, found.unionByName(others).unionByName(odd))
