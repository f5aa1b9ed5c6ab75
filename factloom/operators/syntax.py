"""Rust syntax from token rows: brackets, items, nesting, unsafe boundaries, calls and lexical metrics.

Tokens are rows (``functions.lexer``); everything above them is window sums and joins over all files at once. A file's brackets
give each token its depth and the bracket around it, so "the next ; at this level" is a window within (file, bracket). What is
around what follows from well-nested spans: the level of a span is a running sum over starts and stops.

Only captured syntax is told: nothing is expanded, and what stands in a macro's brackets is neither nested nor unsafe code. The
grammar isn't parsed: a block after if, match, while, for or loop is the first brace at its level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.graphs import _cut, _stored

OPENS, CLOSES = ("(", "[", "{"), (")", "]", "}")
#: Keywords of items and of what nests.
ITEMS = ("fn", "struct", "enum", "trait", "mod", "impl")
NESTS = ("if", "match", "loop", "while", "for")
BLOCKS = {"async": "async_block", "try": "try_block", "gen": "gen_block"}
KEYWORDS = ("if", "match", "while", "for", "loop", "return", "fn", "in", "as", "let", "else", "move", "mut", "ref", "pub", "where", "impl", "unsafe", "async", "await")


def brackets(tokens: DataFrame, id: str = "file_id") -> DataFrame:
    """Tokens with depth (open brackets before it; a closing one has that of its opening one), around (seq of the bracket
    around it, -1 outside), close (of an opening one: the seq of its closing one), n1 (the word after), macro (whether it stands in a
    macro's brackets) and balanced (of its file: every bracket closes one of its kind)."""
    file = Window.partitionBy(id).orderBy("seq")
    opens, closes = F.coalesce(F.col("word").isin(*OPENS), F.lit(False)), F.coalesce(F.col("word").isin(*CLOSES), F.lit(False))
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    rows = tokens.withColumn("opens", opens).withColumn("closes", closes).withColumn("sum", F.sum(step).over(file.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("depth", F.col("sum") - opens.cast("int")).withColumn("p1", F.lag("word", 1).over(file)).withColumn("p2", F.lag("word", 2).over(file)).withColumn("p3", F.lag("word", 3).over(file))
    rows = rows.withColumn("n1", F.lead(F.coalesce("word", F.lit(""))).over(file))
    macro = F.col("opens") & ((F.col("p1") == "!") & F.col("p2").rlike(r"^\w+$") & ~F.col("p2").isin("if", "while", "return", "match", "in") | (F.col("p2") == "!") & (F.col("p3") == "macro_rules"))
    level = Window.partitionBy(id, "depth", "bracket").orderBy("seq")
    rows = rows.withColumn("bracket", F.col("opens") | F.col("closes")).withColumn("_m", F.coalesce(macro, F.lit(False)))
    rows = rows.withColumns({"close": F.when(F.col("opens"), F.lead("seq").over(level)), "pair": F.when(F.col("opens"), F.lead("word").over(level)), "_d": F.when(F.col("closes"), F.lag("_m").over(level))})
    fits = ~F.col("opens") | F.coalesce(F.concat("word", "pair").isin("()", "[]", "{}"), F.lit(False))
    # The bracket around a token is the last opening one of the depth below.
    none = F.lit(None).cast("long")
    asks, marks = F.struct((F.col("depth") - 1).alias("key"), none.alias("own")), F.struct(F.col("depth").alias("key"), F.col("seq").alias("own"))
    both = rows.withColumn("_k", F.explode(F.when(F.col("opens"), F.array(asks, marks)).otherwise(F.array(asks))))
    around = F.last("_k.own", ignorenulls=True).over(Window.partitionBy(id, "_k.key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    rows = both.withColumn("around", F.coalesce(around, F.lit(-1))).where("_k.own is null").drop("_k")
    inside = F.sum(F.col("_m").cast("int") - F.coalesce("_d", F.lit(False)).cast("int")).over(file.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_m").cast("int")
    whole = file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    balanced = F.min(F.when(fits, 1).otherwise(0)).over(whole) * F.when(F.min("depth").over(whole) >= 0, 1).otherwise(0) * F.when(F.sum(step).over(whole) == 0, 1).otherwise(0)
    rows = rows.withColumns({"macro": inside > 0, "balanced": balanced == 1}).drop("_m", "_d", "opens", "closes", "sum", "bracket", "pair", "p1", "p2", "p3")
    return _stored(rows)  # what follows may read these rows several times


def enclosing(spans: DataFrame, id: str = "file_id") -> DataFrame:
    """Well-nested spans (id, first, last) with level (how many spans hold it, itself too) and parent (first of the one around it, else null)."""
    own = F.struct(*(c for c in spans.columns if c != id)).alias("own")
    none = F.lit(None).cast(spans.select(own).schema["own"].dataType)
    ends = F.array(F.struct(F.col("first").alias("seq"), F.lit(1).alias("d"), (-F.col("last")).alias("o"), own), F.struct(F.col("last").alias("seq"), F.lit(-1).alias("d"), F.col("first").alias("o"), none.alias("own")))
    # At one token starts come before stops, outer starts first.
    run = F.sum("m.d").over(Window.partitionBy(id).orderBy("m.seq", F.desc("m.d"), "m.o").rowsBetween(Window.unboundedPreceding, 0))
    levels = spans.select(id, F.explode(ends).alias("m")).withColumn("level", run).where("m.d = 1").select(id, "m.own", "level")
    # A span asks in the level above for what its own row, as a mark, answers in its level.
    roles = F.array(F.struct((F.col("level") - 1).alias("key"), F.lit(False).alias("mark")), F.struct(F.col("level").alias("key"), F.lit(True).alias("mark")))
    above = Window.partitionBy(id, "r.key").orderBy("own.first", "r.mark").rowsBetween(Window.unboundedPreceding, -1)
    found = levels.withColumn("r", F.explode(roles)).withColumn("parent", F.last(F.when(F.col("r.mark"), F.col("own.first")), ignorenulls=True).over(above))
    return found.where("not r.mark").select(id, "own.*", "level", "parent")


def _near(rows: DataFrame, id: str) -> DataFrame:
    """Tokens with n1..n4 (the words after) and b1, b2 (before)."""
    file = Window.partitionBy(id).orderBy("seq")
    word = F.coalesce("word", F.lit(""))
    return rows.withColumns({f"n{k}": F.lead(word, k).over(file) for k in (1, 2, 3, 4)} | {f"b{k}": F.lag(word, k).over(file) for k in (1, 2)})


def _ahead(rows: DataFrame, id: str, when, name: str) -> DataFrame:
    """Adds the seq of the next token at the same level, in the same bracket, for which ``when`` holds."""
    return rows.withColumn(name, F.last(F.when(when, F.col("seq")), ignorenulls=True).over(_behind(id)))


def _behind(id: str):
    """What follows a token at its level, from the end on: a frame that grows backwards costs each row once."""
    return Window.partitionBy(id, "around").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)


def _wide(rows: DataFrame, id: str, at=None) -> DataFrame:
    """Tokens with what stands near and ahead of them, all by windows within the file: no table of tokens is joined with another.

    at: a value of each token that items and sites carry for their first and last token and for that where their body begins.
    then: of an opening bracket, its closing one; tail: where ``else {`` follows that, the closing one of that block. since: the last
    ; or } before at this level, head: the token after it; brace, semi, stop (a , or ;), bar: the next ones; until: the bracket around.
    """
    file, level = Window.partitionBy(id).orderBy("seq"), Window.partitionBy(id, "around").orderBy("seq")
    ahead, ever = _behind(id), level.rowsBetween(Window.unboundedPreceding, 0)
    rows = _near(rows.withColumn("at", F.lit(0) if at is None else at), id).withColumns({"after": F.lead("at").over(file), "prior": F.lag("at").over(file)})
    pairs = Window.partitionBy(id, "depth", F.coalesce(F.col("word").isin(*OPENS, *CLOSES), F.lit(False))).orderBy("seq")
    opener = F.col("close").isNotNull()
    then = F.when(opener, F.lead(F.struct("seq", "at", "prior", F.col("n1").alias("x1"), F.col("n2").alias("x2"))).over(pairs))
    rows = rows.withColumn("then", then).withColumn("tail", F.when((F.col("then.x1") == "else") & (F.col("then.x2") == "{"), F.lead("seq", 3).over(pairs)))
    rows = rows.withColumn("holds", F.lag(F.when(opener, F.col("then"))).over(file))
    last = lambda when, what, over: F.last(F.when(when, what), ignorenulls=True).over(over)
    rows = rows.withColumn("since", last(F.col("word").isin(";", "}"), F.col("seq"), level.rowsBetween(Window.unboundedPreceding, -1))).withColumn("first", F.coalesce("since", "around") + 1)
    rows = rows.withColumns({"head": last(F.col("seq") == F.col("first"), F.col("at"), ever), "until": last(F.col("seq") == F.col("around") + 1, F.struct("holds.seq", "holds.prior"), ever)})
    rows = rows.withColumns({
        "brace": last(F.col("word") == "{", F.struct("seq", "close", "tail", "at", F.col("then.at").alias("end")), ahead), "semi": last(F.col("word") == ";", F.struct("seq", "at"), ahead),
        "stop_at": last(F.col("word").isin(",", ";"), F.struct("seq", "prior"), ahead),
    })
    following = F.lag(F.struct("seq", "word", "close", F.col("then.at").alias("end"), "stop_at")).over(Window.partitionBy(id, "around").orderBy(F.desc("seq")))
    rows = rows.withColumn("following", following)
    return rows.withColumn("bar", last((F.col("word") == "|") & ~F.col("macro"), F.struct("seq", "after", "following"), ahead))


def _of_items(wide: DataFrame, id: str) -> DataFrame:
    """(id, kind, name, first, keyword, body, last, and the values at of first, body and last) of the items among these tokens."""
    starts = (F.col("b1").isNull() | F.col("b1").isin("", ";", "}", "{", "]", "unsafe")) & (F.col("word") == "impl")
    named = F.col("word").isin(*ITEMS[:-1]) & F.col("n1").rlike(r"^\w+$")
    found = wide.where((F.col("kind") == "ident") & ~F.col("macro") & (starts | named))
    has = F.col("brace").isNotNull() & (F.col("semi").isNull() | (F.col("brace.seq") < F.col("semi.seq")))
    closed = has & F.col("brace.close").isNotNull()
    return found.select(
        id, F.when(F.col("word") == "fn", "function").otherwise(F.col("word")).alias("kind"), F.when(F.col("word") != "impl", F.col("n1")).alias("name"), "first", F.col("seq").alias("keyword"),
        F.when(has, F.col("brace.seq")).alias("body"), F.when(closed, F.col("brace.close")).otherwise(F.col("semi.seq")).alias("last"),
        F.col("head").alias("at_first"), F.when(has, F.col("brace.at")).alias("at_body"), F.when(closed, F.col("brace.end")).otherwise(F.col("semi.at")).alias("at_last"),
    ).where("last is not null")


def items(rows: DataFrame, id: str = "file_id") -> DataFrame:
    """(id, kind, name, first, keyword, body, last, parent) of functions, structs, enums, traits, modules and impls of ``brackets``.

    first: the item's first token (attributes and qualifiers count), keyword: that of the kind, body: its opening brace (null: none),
    last: its last token; parent: first of the nearest item around it. Items within macros aren't known.
    """
    found = _of_items(_wide(rows, id), id).drop("at_first", "at_body", "at_last")
    return enclosing(found, id).drop("level")


def functions(rows: DataFrame, id: str = "file_id") -> DataFrame:
    """(id, name, first, last, body) of the functions with a body among ``items``, from the few tokens where items begin and end."""
    few = rows.where(F.col("word").isin("fn", ";", "{", "}")).select(id, "seq", "kind", "word", "n1", "macro", "around", "close")
    level = Window.partitionBy(id, "around").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda when, what, over: F.last(F.when(when, what), ignorenulls=True).over(over)
    few = few.withColumn("since", last(F.col("word").isin(";", "}"), F.col("seq"), level))
    few = few.withColumns({"brace": last(F.col("word") == "{", F.struct("seq", "close"), _behind(id)), "semi": last(F.col("word") == ";", F.col("seq"), _behind(id))})
    found = few.where((F.col("word") == "fn") & (F.col("kind") == "ident") & ~F.col("macro") & F.col("n1").rlike(r"^\w+$"))
    found = found.where(F.col("brace").isNotNull() & (F.col("semi").isNull() | (F.col("brace.seq") < F.col("semi"))))
    stop = F.coalesce("brace.close", "semi")
    return found.select(id, F.col("n1").alias("name"), (F.coalesce("since", "around") + 1).alias("first"), stop.alias("last"), F.col("brace.seq").alias("body")).where("last is not null")


def _of_sites(wide: DataFrame, id: str) -> DataFrame:
    """(id, kind, first, last, body, and the values at of first, body and last) of what nests among these tokens, functions left out."""
    word, b1 = F.col("word"), F.col("b1")
    # `for` of higher-ranked bounds and of impls isn't a loop.
    loop = word.isin(*NESTS) & (F.col("kind") == "ident") & ~((word == "for") & ((F.col("n1") == "<") | F.coalesce(b1.rlike(r"^(\w+|>)$") & ~b1.isin("else", "return", "in"), F.lit(False)))) & F.col("brace.close").isNotNull()
    block = word.isin(*BLOCKS) & ((F.col("n1") == "{") | (F.col("n1") == "move") & (F.col("n2") == "{"))
    # A closure's first bar stands where an expression begins; its parameters end at the next bar of that level.
    begins = b1.isNull() | b1.isin("(", ",", "=", "{", ";", "[", ">", "move", "return", "async", ":", "}") & ~((b1 == ">") & (F.coalesce("b2", F.lit("")) != "="))
    closure = (word == "|") & begins & F.col("bar.after").isNotNull()
    braced = F.col("bar.following.word") == "{"
    stop, until = F.col("bar.following.stop_at"), F.col("until")
    nearer = stop.isNotNull() & (until["seq"].isNull() | (stop["seq"] < until["seq"]))
    end = F.when(braced, F.col("bar.following.close")).otherwise(F.least(stop["seq"], until["seq"]) - 1)
    at_end = F.when(braced, F.col("bar.following.end")).when(nearer, stop["prior"]).otherwise(until["prior"])
    names = F.create_map(*[F.lit(x) for pair in BLOCKS.items() for x in pair])
    kind = F.when(loop, word).when(block, names[word]).when(closure & end.isNotNull(), "closure")
    moved = (F.col("kind") == "punct") & F.coalesce(b1 == "move", F.lit(False))
    found = wide.where(~F.col("macro")).select(
        id, kind.alias("kind"), (F.col("seq") - F.when(closure & moved, 1).otherwise(0)).alias("first"), F.when(closure, end).otherwise(F.col("brace.close")).alias("last"),
        F.when(closure, F.col("bar.seq") + 1).alias("body"), F.when(closure & moved, F.col("prior")).otherwise(F.col("at")).alias("at_first"), F.when(closure, F.col("bar.after")).alias("at_body"),
        F.when(closure, at_end).otherwise(F.col("brace.end")).alias("at_last"), "around", "b1", F.col("brace.tail").alias("tail"),
    ).where("kind is not null")
    is_if = F.col("kind") == "if"
    chain = F.sum(F.when(F.coalesce(F.col("b1") == "else", F.lit(False)), 0).otherwise(1)).over(Window.partitionBy(id, "around", is_if).orderBy("first"))
    found = found.withColumn("chain", chain)
    whole = F.max(F.coalesce("tail", "last")).over(Window.partitionBy(id, "around", is_if, "chain"))
    return found.withColumn("last", F.when(is_if, whole).otherwise(F.col("last"))).drop("around", "b1", "tail", "chain")


def nesting_sites(rows: DataFrame, id: str = "file_id", functions: DataFrame | None = None) -> DataFrame:
    """(id, kind, first, last, body) of what nests: if, match, loop, while, for, closure, nested_function and async, try and gen blocks.
    body: where that of a closure or function begins, else null. functions: the items that are functions with a body, if they are
    known already.

    An if holds its else branches, so an else-if is one level deeper. Every function is a row; it nests in what is around it.
    """
    out = _of_sites(_wide(rows, id), id).select(id, "kind", "first", "last", "body")
    if functions is None:
        functions = items(rows, id).where("kind = 'function' and body is not null")
    return out.unionByName(functions.select(id, F.lit("nested_function").alias("kind"), "first", "last", "body"))


def _unsafe(rows: DataFrame, id: str) -> DataFrame:
    """Tokens with what (the kind of an unsafe boundary that begins here, else null) and what_last."""
    file, end = Window.partitionBy(id).orderBy("seq"), F.coalesce("close", "seq")
    rows = _near(rows, id).withColumns({f"c{k}": F.lead(end, k).over(file) for k in (1, 2, 3, 4)})
    rows = rows.withColumn("_ends", F.last(F.when(F.col("word").isin("{", ";"), end), ignorenulls=True).over(_behind(id)))
    n, c = ([F.col(f"{x}{k}") for k in (1, 2, 3, 4)] for x in "nc")
    # After the keyword there may be extern and its ABI, whose word is empty.
    fn_at = F.when(n[0] == "fn", 1).when((n[0] == "extern") & (n[1] == "fn"), 2).when((n[0] == "extern") & (n[2] == "fn"), 3)
    past = F.when(fn_at == 1, n[1]).when(fn_at == 2, n[2]).otherwise(n[3])
    kind = (
        F.when(n[0] == "{", "block").when(n[0] == "impl", "impl").when(n[0] == "trait", "trait").when(fn_at.isNotNull() & (past == "("), "function_pointer_type").when(fn_at.isNotNull(), "function")
        .when((n[0] == "extern") & ((n[1] == "{") | (n[2] == "{")), "extern_block").when(n[0] == "(", "attribute")
    )
    last = F.when(kind.isin("attribute", "block"), c[0]).when(kind == "function_pointer_type", F.when(fn_at == 1, c[1]).when(fn_at == 2, c[2]).otherwise(c[3])).otherwise(F.col("_ends"))
    here = (F.col("word") == "unsafe") & ~F.col("macro") & last.isNotNull()
    return rows.withColumns({"what": F.when(here, kind), "what_last": last}).drop("_ends", *(f"c{k}" for k in (1, 2, 3, 4)))


def unsafe_sites(rows: DataFrame, id: str = "file_id") -> DataFrame:
    """(id, kind, first, last): unsafe functions, blocks, impls, traits, extern blocks, attributes and function pointer types, from the keyword on."""
    return _unsafe(rows, id).where("what is not null").select(id, F.col("what").alias("kind"), F.col("seq").alias("first"), F.col("what_last").alias("last"))


def calls(rows: DataFrame, id: str = "file_id") -> DataFrame:
    """(id, seq, name, kind): syntactic calls and macro invocations; what they mean isn't known."""
    near = _near(rows, id).where((F.col("kind") == "ident") & ~F.col("macro"))
    call = (F.col("n1") == "(") & ~F.coalesce(F.col("b1").isin("fn", "!"), F.lit(False)) & ~F.col("word").isin(*KEYWORDS)
    macro = (F.col("n1") == "!") & F.col("n2").isin(*OPENS) & (F.col("word") != "macro_rules")
    kind = F.when(macro, "macro_invocation").when(call, "calls")
    return near.select(id, "seq", F.col("word").alias("name"), kind.alias("kind")).where("kind is not null")


def held_by(points: DataFrame, spans: DataFrame, id: str = "file_id") -> DataFrame:
    """(id, seq, ..., holder): each point with the first token of the nearest span around it; null outside."""
    names = [c for c in points.columns if c not in (id, "seq")]
    level = enclosing(spans.select(id, "first", "last").distinct(), id)
    mark = lambda seq, o, own, deep: F.struct(F.col(seq).alias("seq"), F.lit(o).alias("o"), F.col(own).alias("own"), deep.alias("l"))
    marks = level.select(id, F.explode(F.array(mark("first", 0, "first", F.col("level")), mark("last", 2, "parent", -F.col("level")))).alias("m")).select(id, "m.*")
    held = points.select(id, "seq", F.lit(1).alias("o"), F.struct(*names).alias("point"))
    every = held.unionByName(marks, allowMissingColumns=True)
    # The last start or stop before the point says what it stands in: the span itself or the one around it; deeper stops come first.
    order = Window.partitionBy(id).orderBy("seq", "o", F.coalesce("l", F.lit(0))).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("o") != 1, F.struct("own")), ignorenulls=True).over(order)
    return every.withColumn("holder", last["own"]).where("o = 1").select(id, "seq", "point.*", "holder")


_POINT = ("return", "break", "continue")


def _found(rows: DataFrame, id: str) -> DataFrame:
    """One pass over the tokens: functions, sites and other points, each with its line and place, so nothing is looked up again.

    (id, what, kind, name, first, last, body, start, body_start, lines); what: function, site or point."""
    at = F.struct("start", "line", F.coalesce(F.array_max("lines"), "line").alias("end"))
    wide = _wide(rows, id, at)
    word, before = F.col("word"), F.coalesce(F.col("b1"), F.lit(""))
    plain = (
        F.when(word.isin(*_POINT) & (F.col("kind") == "ident"), word).when((word == "await") & (before == "."), "await")
        .when((word == "?") & ~before.isin(":", "+", "<", ",", "(", "|", "dyn"), "error_propagation").when((word == "unsafe") & (F.col("n1") == "{"), "unsafe")
    )
    asks = word.isin("fn", "|", *NESTS, *BLOCKS) | plain.isNotNull()
    wide = _stored(wide.where(~F.col("macro") & asks).withColumn("point", plain).select(id, "seq", "kind", "word", "macro", "around", "first", "head", "at", "prior", "n1", "n2", "b1", "b2", "brace", "semi", "bar", "until", "point"))
    shape = lambda df, what, name: df.select(id, F.lit(what).alias("what"), "kind", name.alias("name"), "first", "last", "body", F.col("at_first.start").alias("start"), F.col("at_body.start").alias("body_start"), (F.col("at_last.end") - F.col("at_body.line") + 1).alias("lines"))
    none = F.lit(None).cast("string")
    functions = shape(_of_items(wide, id).where("kind = 'function' and body is not null"), "function", F.col("name"))
    points = wide.where("point is not null").select(id, F.lit("point").alias("what"), F.col("point").alias("kind"), F.col("seq").alias("first"), F.col("at.start").alias("start"))
    return _stored(functions.unionByName(shape(_of_sites(wide, id), "site", none)).unionByName(points, allowMissingColumns=True))


def _bodies(found: DataFrame) -> DataFrame:
    """Functions and closures with a body among what ``_found`` gives."""
    return found.where("what = 'function' or what = 'site' and kind = 'closure'")


def flow_points(rows: DataFrame, id: str = "file_id", found: DataFrame | None = None) -> DataFrame:
    """(id, holder, kind, seq, start): the flow points of functions and closures, the innermost one around a point being its holder.

    kind: entry (where a body begins), branch, return, await, error_propagation, break, continue or unsafe (a block). Points in
    macros aren't known, and this is structure of the source, not a control-flow graph.
    """
    found = _found(rows, id) if found is None else found
    bodies, branch = _bodies(found), F.col("what") == "site"
    points = found.where((F.col("what") == "point") | branch & F.col("kind").isin(*NESTS)).select(id, F.col("first").alias("seq"), F.when(branch, "branch").otherwise(F.col("kind")).alias("kind"), "start")
    held = held_by(points, bodies, id).where("holder is not null")
    entries = bodies.select(id, F.col("body").alias("seq"), F.lit("entry").alias("kind"), F.col("body_start").alias("start"), F.col("first").alias("holder")).where("start is not null")
    return held.unionByName(entries).select(id, "holder", "kind", "seq", "start")


def counters(rows: DataFrame, id: str = "file_id") -> DataFrame:
    """(id, name, first, lines, branches, returns, awaits, unsafe_blocks) of every function and closure with a body; what stands in an
    inner one counts there only."""
    found = _found(rows, id)
    points = flow_points(rows, id, found)
    count = lambda kind, name: F.count_if(F.col("kind") == kind).alias(name)
    counts = points.groupBy(id, F.col("holder").alias("first")).agg(count("branch", "branches"), count("return", "returns"), count("await", "awaits"), count("unsafe", "unsafe_blocks"))
    return _bodies(found).where("lines is not null").select(id, "name", "first", "lines").join(counts, [id, "first"])


def metrics(rows: DataFrame, id: str = "file_id") -> DataFrame:
    """(id, name, first, start, stop, code_lines, tokens, max_nesting, unsafe_boundaries, status) of every function with a body.

    Header, attributes and inner functions count. Prefix sums at a function's first and last token give its counts, so tokens aren't
    copied for the functions around them. status is partial always (syntax only), or failed: a file whose brackets don't match
    or that has a lexer error tells nothing, and its counts are null.
    """
    file = Window.partitionBy(id).orderBy("seq")
    upto = file.rowsBetween(Window.unboundedPreceding, 0)
    top = F.coalesce(F.max(F.array_max("lines")).over(file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    counted = _unsafe(rows, id).withColumn("own", F.when(F.col("what").isNotNull(), 1).otherwise(0)).withColumn("top", top)
    counted = counted.withColumns({"fresh": F.size(F.filter("lines", lambda x: x > F.col("top"))).cast("long"), "shared": F.element_at("lines", 1) <= F.col("top")}).drop("lines")
    broken = F.max((F.col("kind") == "error").cast("int")).over(file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) + (~F.col("balanced")).cast("int")
    counted = counted.withColumns({"lines_upto": F.sum("fresh").over(upto), "unsafe_upto": F.sum("own").over(upto), "broken": broken})
    at = F.struct("start", "stop", "fresh", "shared", "lines_upto", "unsafe_upto", "own", "broken")
    wide = _wide(counted, id, at).where(~F.col("macro") & F.col("word").isin("fn", "|", *NESTS, *BLOCKS))
    wide = _stored(wide.select(id, "seq", "kind", "word", "macro", "around", "first", "head", "at", "prior", "n1", "n2", "b1", "b2", "brace", "semi", "bar", "until"))
    functions = _cut(_of_items(wide, id).where("kind = 'function' and body is not null"))
    values = lambda end, name: [F.col(f"{name}.{c}").alias(f"{end}_{c}") for c in ("start", "stop", "fresh", "shared", "lines_upto", "unsafe_upto", "own", "broken")]
    found = functions.select(id, "name", "first", "last", *values("a", "at_first"), *values("z", "at_last"))
    sites = _of_sites(wide, id).select(id, "kind", "first", "last").unionByName(functions.select(id, F.lit("nested_function").alias("kind"), "first", "last"))
    spans = _cut(enclosing(sites, id))
    holder = spans.where("kind = 'nested_function'").select(id, "first", "last", F.col("level").alias("base"))
    sites = held_by(spans.select(id, F.col("first").alias("seq"), "level", "kind"), holder, id)
    # A function's own row stands at its first token; it belongs to what is around it.
    around = enclosing(holder.drop("base"), id).select(F.col(id).alias("_i"), F.col("first").alias("_f"), F.col("parent").alias("_p"))
    sites = sites.join(around, (F.col(id) == F.col("_i")) & (F.col("seq") == F.col("_f")) & (F.col("kind") == "nested_function"), "left")
    sites = sites.withColumn("holder", F.when(F.col("kind") == "nested_function", F.col("_p")).otherwise(F.col("holder")))
    deepest = _cut(sites.where("holder is not null").groupBy(id, F.col("holder").alias("first")).agg(F.max("level").alias("deepest")))
    parents = _cut(around.where("_p is not null").select(F.col("_i").alias(id), F.col("_f").alias("first"), F.col("_p").alias("up")))
    while True:  # from inner functions to those around them, as often as functions nest
        up = deepest.join(parents, [id, "first"]).groupBy(id, F.col("up").alias("first")).agg(F.max("deepest").alias("deepest"))
        grown = _cut(deepest.unionByName(up).groupBy(id, "first").agg(F.max("deepest").alias("deepest")))
        if grown.exceptAll(deepest).isEmpty():
            break
        deepest = grown
    found = found.join(deepest, [id, "first"], "left").join(holder.select(id, "first", "base"), [id, "first"])
    ok = F.col("a_broken") == 0
    lines = F.col("z_lines_upto") - F.col("a_lines_upto") + F.col("a_fresh") + F.col("a_shared").cast("int")
    return found.select(
        id, "name", "first", F.col("a_start").alias("start"), F.col("z_stop").alias("stop"), F.when(ok, lines).alias("code_lines"), F.when(ok, F.col("last") - F.col("first") + 1).alias("tokens"),
        F.when(ok, F.coalesce(F.col("deepest") - F.col("base"), F.lit(0))).cast("long").alias("max_nesting"), F.when(ok, F.col("z_unsafe_upto") - F.col("a_unsafe_upto") + F.col("a_own")).alias("unsafe_boundaries"),
        F.when(ok, "partial").otherwise("failed").alias("status"),
    )
