"""Scalar rules as columns: three-valued configuration, decimal numbers, labels and line windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unsigned64(text: Column) -> Column:
    """A decimal text of ASCII digits as a number; null unless it is one below 2**64."""
    bare = F.regexp_replace(text, "^0+(?=[0-9])", "")
    number = F.when(text.rlike(r"\A[0-9]+\z") & (F.length(bare) <= 20), bare).try_cast("decimal(20,0)")
    return F.when(number <= F.lit("18446744073709551615").cast("decimal(20,0)"), number)


def status_all(parts: list[Column]) -> Column:
    """active, inactive or unknown of a conjunction: SQL's three-valued AND with unknown as null."""
    known = [F.when(p == "active", True).when(p == "inactive", False) for p in parts]
    both = F.lit(True)
    for k in known:
        both = both & k
    return F.when(both, "active").when(~both, "inactive").otherwise("unknown")


def status_any(parts: list[Column]) -> Column:
    known = [F.when(p == "active", True).when(p == "inactive", False) for p in parts]
    one = F.lit(False)
    for k in known:
        one = one | k
    return F.when(one, "active").when(~one, "inactive").otherwise("unknown")


def status_not(parts: list[Column]) -> Column:
    """The other status of one part; unknown of none or several."""
    if len(parts) != 1:
        return F.lit("unknown")
    return F.when(parts[0] == "active", "inactive").when(parts[0] == "inactive", "active").otherwise("unknown")


def short_label(text: Column, length: int = 100) -> Column:
    """Runs of white space (of all Unicode) as one space, without ends, cut to a number of characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(text, r"[\p{IsWhite_Space}]+", " "), r"\A | \z", ""), 1, length)


def lines(files: DataFrame, id: str = "file_id", text: str = "text") -> DataFrame:
    """(id, line, start_byte, content) of every line of every file; lines count from 1, bytes are of UTF-8."""
    rows = files.select(id, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("pos", "content"))
    before = Window.partitionBy(id).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length("content") + 1).over(before), F.lit(0)).cast("long")
    return rows.select(id, (F.col("pos") + 1).cast("long").alias("line"), start.alias("start_byte"), "content")


def line_at(text: Column, byte: Column) -> Column:
    """The line, from 1, of a byte offset of a text in UTF-8; null for an offset outside it or within a character."""
    data = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    before = F.substring(data, F.lit(1), byte).cast("string")
    apart = byte.between(0, F.octet_length(data)) & ~F.hex(F.substring(data, byte + 1, F.lit(1))).rlike("^[89AB]")
    return F.when(apart, (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("long"))


def _first_bytes(text: Column, most: int) -> Column:
    """The longest beginning of a text that has ``most`` bytes of UTF-8 at most and ends with a whole character."""
    data = F.encode(text, "UTF-8")
    inside = lambda at: F.hex(F.substring(data, at + 1, 1)).rlike("^[89AB]")  # noqa: E731  (of a character that began before)
    end = F.lit(most - 3)
    for at in (most - 2, most - 1, most):
        end = F.when(~inside(at), at).otherwise(end)
    return F.when(F.octet_length(text) > most, F.substring(data, F.lit(1), end).cast("string")).otherwise(text)


def source_windows(files: DataFrame, start_line: int | Column, line_count: int, id: str = "file_id", text: str = "text", most: int = 262_144) -> DataFrame:
    """(id, total_lines, start_byte, window, truncated) of a window of lines of every file; files with fewer lines give none.

    start_line may be a column (``line_at`` gives the line of an offset). Lines keep their ends; a window has ``most`` bytes at
    most and ends with a whole character; truncated says whether it is less than the file.
    """
    if isinstance(start_line, int) and start_line < 1 or not 1 <= line_count <= 1000 or most < 4:
        raise ValueError("a window starts at line 1 or later and has 1..1000 lines")
    first = F.lit(start_line) if isinstance(start_line, int) else start_line.cast("int")
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = files.select(id, F.split(whole, "\n", -1).alias("lines"), first.alias("first"), F.octet_length(whole).alias("bytes")).where((F.col("first") >= 1) & (F.size("lines") >= F.col("first")))
    before = F.aggregate(F.slice("lines", F.lit(1), F.col("first") - 1), F.lit(0).cast("long"), lambda s, x: s + F.octet_length(x) + 1)
    end = F.when(F.size("lines") >= F.col("first") + line_count, "\n").otherwise("")
    window = _first_bytes(F.concat(F.array_join(F.slice("lines", F.col("first"), F.lit(line_count)), "\n"), end), most)
    rows = rows.select(id, F.size("lines").cast("long").alias("total_lines"), before.alias("start_byte"), window.alias("window"), "bytes")
    return rows.select(id, "total_lines", "start_byte", "window", (F.octet_length("window") < F.col("bytes")).alias("truncated"))


def text_metrics(files: DataFrame, id: str = "file_id", text: str = "text") -> DataFrame:
    """(id, code_lines, tokens, bytes): lines with something on them, tokens (runs of letters, digits and _, or one other
    character) and bytes of UTF-8."""
    t = F.coalesce(F.col(text), F.lit(""))
    held = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^ \t\r]"))
    tokens = F.regexp_count(t, F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"))
    return files.select(id, F.size(held).cast("long").alias("code_lines"), tokens.cast("long").alias("tokens"), F.octet_length(t).cast("long").alias("bytes"))
