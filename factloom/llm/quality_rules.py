"""Quality rules: a threshold table compiled into one projection of built-in expressions.

Each row of RULES names a measure and the band it must lie in. ``measures`` adds the measures to a
table of texts, ``verdict`` turns the table into one boolean expression and the list of broken rules.
No shuffle and no user function: a text never leaves its scan task.

Defined results: a null or empty text has no words, so every measure is zero and it fails the base
rule of ten words. Repeated rows are measured each. Columns other than the id and the text pass through.
"""

from __future__ import annotations

from string import ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.tables import table

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "a an and are as at be by for from in is it not of on or that the this to was with "
    "au aux dans de des du elle est et il la le les ne par pas pour que qui sur un une "
    "auf das dem den der des die ein eine für im in ist mit nicht und von zu zum "
    "al con de del el en es la las lo los no para por que se su un una y"
).split()

#: (rule, numerator, denominator, slack of the denominator, least, most), bounds in hundredths; None: no bound.
#: The slack keeps a ratio from judging short texts by chance: 100 * numerator against bound * (denominator - slack).
RULES = (
    ("word_length", "word_chars", "n_words", 0, 200, 1400),
    ("symbols", "n_symbols", "n_words", 0, None, 10),
    ("capitals", "n_capitals", "word_chars", 0, None, 40),
    ("stop_words", "n_stop_words", "n_words", 30, 5, None),
    ("repeated_lines", "n_dup_lines", "n_lines", 0, None, 50),
    ("echoed_words", "n_echo_words", "n_words", 0, None, 30),
    ("repeated_windows", "n_repeat_words", "n_words", 0, None, 20),
)
MIN_WORDS = 10

_SPACE = "\t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def _words(text: Column) -> Column:
    """Words between ASCII white space: one-character split, which needs no regular expression engine."""
    return F.filter(F.split(F.translate(text, _SPACE, " " * len(_SPACE)), " "), lambda w: w != "")


def _repeated(starts: Column, window: int) -> Column:
    """Words covered by windows at the sorted positions ``starts``."""
    step = F.aggregate(
        starts,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1 - window).cast("int").alias("last")),
        lambda s, p: F.struct((s.n + F.least(p - s.last, F.lit(window))).alias("n"), p.alias("last")),
        lambda s: s.n,
    )
    return step


def measures(df: DataFrame, text: str = "text", window: int = 5) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_capitals (A-Z), n_lines, n_dup_lines, n_stop_words, n_echo_words (words
    equal to the one before) and n_repeat_words (long).

    Windows are compared by a 64-bit hash of 64-bit word hashes, within one text only.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    stop = sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)})
    keep = [F.col(c) for c in df.columns]
    df = df.select(
        *keep,
        _words(t).alias("_w"),
        F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, " " + _SPACE, "")) > 0).alias("_lines"),
        F.length(F.translate(t, " " + _SPACE, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(t) - F.length(F.translate(t, ascii_uppercase, ""))).cast("long").alias("n_capitals"),
    )
    df = df.select(
        *keep, "word_chars", "n_symbols", "n_capitals",
        F.size("_w").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_w", lambda w: w.isin(stop))).cast("long").alias("n_stop_words"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    last = F.size("_h") - window
    ids = [c for c in df.columns if c != "_h"]
    grams = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.col("_h")[i + k] for k in range(window)]))
    echoes = F.size(F.filter("_h", lambda h, i: h == F.get(F.col("_h"), i - 1))).cast("long").alias("n_echo_words")
    df = df.select(*ids, F.when(last >= 0, grams).alias("_g"), echoes)
    ids.append("n_echo_words")
    placed = F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    df = df.select(*ids, F.when(F.size(F.array_distinct("_g")) < F.size("_g"), placed).alias("_p"))
    same = lambda i, j: F.coalesce(F.get(F.col("_p"), i)["g"] == F.get(F.col("_p"), j)["g"], F.lit(False))
    twice = F.filter(F.transform("_p", lambda p, i: F.when(same(i, i - 1) | same(i, i + 1), p["i"])), lambda i: i.isNotNull())
    df = df.select(*ids, F.when(F.col("_p").isNotNull(), F.sort_array(twice)).alias("_twice"))
    # The row id makes this projection one that the optimizer keeps filters above: pushed below, a filter on the
    # verdict would copy the word arrays into the lambdas that index them, which makes the work quadratic.
    counted = F.coalesce(_repeated(F.col("_twice"), window), F.lit(0)).cast("long")
    return df.select(*ids, F.when(F.monotonically_increasing_id() >= 0, counted).alias("n_repeat_words"))


def verdict(rules=RULES) -> tuple[Column, Column]:
    """(all rules hold, names of the broken rules) over the columns of ``measures``."""
    broken = []
    for name, top, base, slack, least, most in rules:
        value, unit = F.col(top) * 100, F.col(base) - slack
        off = F.lit(False)
        if least is not None:
            off = off | (value < unit * least)
        if most is not None:
            off = off | (value > unit * most)
        broken.append(F.when(off, F.lit(name)))
    names = F.array_compact(F.array(*broken))
    return F.size(names) == 0, names


#: What apply_rules adds.
ADDED = ("n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_stop_words", "n_echo_words", "n_repeat_words", "base_failed", "broken_rules", "kept")


def apply_rules(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The table with its measures, base_failed, broken_rules and kept; these replace columns of the same names."""
    good, names = verdict(rules)
    found = measures(df.select(F.struct(*df.columns).alias("_row"), F.col(text).cast("string").alias("_text")), "_text")
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    found = found.withColumns({"base_failed": base, "broken_rules": names})
    found = found.withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))
    return found.select(*(F.col(f"_row.`{c}`") for c in df.columns if c not in ADDED), *ADDED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = apply_rules(docs)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words", "n_capitals", "n_echo_words")


def _sql() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)}))
    rules = " AND ".join(
        f"{top} * 100 {sign} ({base} - {slack}) * {bound}"
        for _, top, base, slack, least, most in RULES
        for sign, bound in ((">=", least), ("<=", most))
        if bound is not None
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
words AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM s),
grams AS (SELECT r, i, string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS g,
                 count(*) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS n FROM words),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM grams WHERE n = 5) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM again, range(5) AS x(k) GROUP BY r),
echo AS (SELECT r, count(*) AS n FROM (SELECT r, word, lag(word) OVER (PARTITION BY r ORDER BY i) AS p FROM words) WHERE word = p GROUP BY r),
stops AS (SELECT r, count(*) AS n FROM words WHERE word IN ({stop}) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(length(regexp_replace(t, '[^A-Z]', '', 'g')) AS BIGINT) AS n_capitals, CAST(coalesce(echo.n, 0) AS BIGINT) AS n_echo_words,
             CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(stops.n, 0) AS BIGINT) AS n_stop_words
      FROM s LEFT JOIN rep USING (r) LEFT JOIN echo USING (r) LEFT JOIN stops USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {rules} AS kept, n_lines, n_stop_words, n_capitals, n_echo_words FROM b
"""


SQL = _sql()
