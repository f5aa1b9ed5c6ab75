"""Configuration predicates of Rust, such as ``all(unix, not(feature = "x"))``, as columns.

A predicate becomes an array of steps in postfix order: an atom pushes its status, a call takes as many as it has arguments. The
array is made once for each text, evaluated by ``aggregate`` over a stack for each row and its settings, in three values: true is
active, false inactive, null unknown.

Settings are three columns: cfg, a map from key to value (null: a bare key that is set); features, an array; unknown_features.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = "array<struct<op:string,key:string,value:string,n:int>>"
_WORD = re.compile(r'\s*(?:(?P<name>(?:r#)?[A-Za-z_]\w*)|(?P<text>"(?:[^"\\]|\\.)*")|(?P<mark>[(),=]))')
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "\\": "\\", '"': '"', "'": "'"}


def postfix(text: str | None) -> list[dict] | None:
    """The steps of a predicate, or None if the text isn't one. op: atom, pair, true, false, all, any, not or other (an unknown call)."""
    words, at = [], 0
    text = (text or "").rstrip()
    while at < len(text):
        m = _WORD.match(text, at)
        if not m:
            return None
        words.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    steps: list[dict] = []
    calls: list[list] = []  # open calls: [name, number of arguments]
    step = lambda op, key=None, value=None, n=0: steps.append({"op": op, "key": key, "value": value, "n": n})
    i, want = 0, True  # whether a predicate may begin here
    while i < len(words):
        kind, word = words[i]
        following = words[i + 1][1] if i + 1 < len(words) else ""
        if kind == "name" and want:
            if following == "(":
                calls.append([word, 0])
                i += 2
                continue
            if following == "=":
                if i + 2 >= len(words) or words[i + 2][0] != "text":
                    return None
                step("pair", word, re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), words[i + 2][1][1:-1]))
                i += 2
            else:
                step(word if word in ("true", "false") else "atom", word)
            want = False
        elif word == "," and not want and calls:
            calls[-1][1] += 1
            want = True
        elif word == ")" and calls:
            name, n = calls.pop()
            step(name if name in ("all", "any", "not") else "other", name, None, n + (not want))
            want = False
        else:
            return None
        i += 1
    return None if calls or want or not steps else steps


def parsed(predicates: DataFrame, text: str = "predicate") -> DataFrame:
    """(text, steps) of each different predicate: a store repeats few predicates many times. steps is null where it isn't one."""

    @F.pandas_udf(STEP)
    def steps(texts: pd.Series) -> pd.Series:
        return texts.map(postfix)

    return predicates.select(text).where(F.col(text).isNotNull()).distinct().select(text, steps(text).alias("steps"))


def _status(s: Column, cfg: Column, features: Column, unknown_features: Column) -> Column:
    """An atom's truth: features are known unless some are unknown; other keys are known if they are set, and test isn't set."""
    held, value = F.map_contains_key(cfg, s["key"]), F.element_at(cfg, s["key"])
    pair = F.when(s["key"] == "feature", F.when(~unknown_features, F.array_contains(features, s["value"]))).when(held, F.coalesce(value == s["value"], F.lit(False)))
    bare = F.when(held, value.isNull()).when(s["key"] == "test", False)
    return F.when(s["op"] == "true", True).when(s["op"] == "false", False).when(s["op"] == "pair", pair).when(s["op"] == "atom", bare)


def evaluate(steps: Column, cfg: Column, features: Column, unknown_features: Column) -> Column:
    """active, inactive or unknown of the steps of a predicate; unknown if there are none.

    all() of nothing is active, any() of nothing inactive; not() of another number of arguments than one is unknown, as is any
    other call.
    """

    def push(stack: Column, s: Column) -> Column:
        # The stack of maybe-true values is an array of bytes: 1, 0 and -1 for unknown.
        code = lambda truth: F.when(truth, 1).when(~truth, 0).otherwise(-1)
        rest = F.slice(stack, F.lit(1), F.size(stack) - s["n"])
        taken = F.slice(stack, F.size(stack) - s["n"] + 1, s["n"])
        has = lambda x: F.array_contains(taken, x)
        every = F.when(has(0), 0).when(has(-1), -1).otherwise(1)
        some = F.when(has(1), 1).when(has(-1), -1).otherwise(0)
        first = F.get(taken, F.lit(0))
        negated = F.when(s["n"] != 1, -1).when(first == 1, 0).when(first == 0, 1).otherwise(-1)
        made = F.when(s["op"] == "all", every).when(s["op"] == "any", some).when(s["op"] == "not", negated).when(s["op"] == "other", -1).otherwise(code(_status(s, cfg, features, unknown_features)))
        return F.concat(rest, F.array(made))

    top = F.element_at(F.aggregate(steps, F.array().cast("array<int>"), push), -1)
    return F.when(top == 1, "active").when(top == 0, "inactive").otherwise("unknown")


def negate(status: Column) -> Column:
    """active to inactive and back; unknown stays."""
    return F.when(status == "active", "inactive").when(status == "inactive", "active").otherwise("unknown")


def feature_closure(requested: DataFrame, declared: DataFrame) -> DataFrame:
    """(package, feature, known): features that requested ones enable, directly or not.

    requested: package, feature; declared: package, feature, enables. A name with a slash or with ``dep:`` isn't a feature of the
    package; it makes the package's features not known in full (known is false, the name isn't a row), as does a null in enables.

    Requested and found features grow with the input, so both sides of each join are shuffled: none passes the driver.
    """
    from factloom.operators.graphs import _cut

    foreign = lambda c: F.col(c).isNull() | F.col(c).contains("/") | F.col(c).startswith("dep:")
    steps = _cut(declared.select("package", "feature", "enables").distinct())
    fresh = _cut(requested.select("package", "feature").distinct())
    seen, odd = fresh.where(~foreign("feature")), fresh.where(foreign("feature")).select("package")
    fresh = seen
    while not fresh.isEmpty():
        found = fresh.hint("merge").join(steps.hint("merge"), ["package", "feature"]).select("package", F.col("enables").alias("feature")).distinct()
        odd = odd.unionByName(found.where(foreign("feature")).select("package"))
        fresh = _cut(found.where(~foreign("feature")).join(seen.hint("merge"), ["package", "feature"], "left_anti"))
        seen = seen.unionByName(fresh)
    gaps = odd.distinct().withColumn("known", F.lit(False))
    return seen.join(gaps, "package", "left").select("package", "feature", F.coalesce("known", F.lit(True)).alias("known"))
