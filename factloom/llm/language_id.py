"""Language identification by Bayesian fusion of evidence.

posterior(l) ~ text likelihood(l) * P(declared | l) * P(address suffix | l) * P(l | host)

* Text: hashed byte trigrams, one multinomial for each language and a flat one for "und". Counts are gathered over all
  labelled texts; the table is LANGUAGES x BUCKETS whatever the corpus. A text counts as at most EVIDENCE trigrams, for
  neighbouring trigrams aren't independent.
* Declared language and address suffix: counts of each value by the language of the text, smoothed. A value is a code of
  two or three letters or "other", so both tables have at most 27**3 + 1 rows and are broadcast.
* Host: a page's host prior is smoothed towards its domain's and that towards the language shares of all pages, by counts
  of the other pages only. Hosts meet pages in an equality join that adaptive execution can split.

Defined results: a text without letters is "und" with confidence 0; null evidence counts as "other"; rows without a host
share one host; repeated rows are pages of their own; an empty table gives no rows; without labelled texts all languages
are equally likely to the text.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import blocks as B
from factloom.llm.tables import cut, table

LANGUAGES = ("de", "en", "es", "fr")
UND = "und"
BUCKETS = 1 << 15
EVIDENCE = 60
ALPHA = 0.1
"""Added to each count of a trigram."""
STRENGTH = 4.0
"""Pages that a domain's or the whole table's shares count as in a host's prior."""

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of all rows and the offsets of each row's."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    x = _FOLD[data].astype(np.uint32)
    space = x == 0x20
    valid = ~(space[:-2] & space[1:-1] | space[1:-1] & space[2:])
    for back in (1, 2):
        ends = offsets[1:] - back
        valid[ends[(ends >= 0) & (ends < len(valid))]] = False
    h = (x[:-2] * np.uint32(0x01000193) + x[1:-1]) * np.uint32(0x01000193) + x[2:]
    h = (h * np.uint32(0x9E3779B1)) >> np.uint32(17)
    at = np.flatnonzero(valid)
    return h[at].astype(np.int64), np.searchsorted(at, offsets)


def fit(df: DataFrame, text: str = "text", lang: str = "lang") -> np.ndarray:
    """Log probabilities (languages, buckets) from all texts whose label is one of LANGUAGES."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(LANGUAGES) * BUCKETS, np.int64)
        for part in parts:
            kind = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for row, end, data, offsets in B.text_blocks(part.column(0)):
                ids, rows = _trigrams(data, offsets)
                total += np.bincount(ids + np.repeat(kind[row:end] * BUCKETS, np.diff(rows)), minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["cell", "n"])

    kind = F.array_position(F.array(*map(F.lit, LANGUAGES)), F.lower(F.substring(lang, 1, 2))) - 1
    rows = df.select(F.col(text).cast("string").alias("t"), kind.cast("int").alias("k")).where("k >= 0 and t is not null").mapInArrow(count, "cell int, n bigint")
    counts = np.zeros(len(LANGUAGES) * BUCKETS)
    for cell, n in rows.groupBy("cell").agg(F.sum("n")).collect():  # LANGUAGES x BUCKETS cells at most
        counts[cell] = n
    counts = counts.reshape(len(LANGUAGES), BUCKETS) + ALPHA
    return np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def _likelihoods(df: DataFrame, model: np.ndarray, text: str) -> DataFrame:
    """Replaces the text by n (trigrams) and ll (array: a language's or und's log likelihood of EVIDENCE trigrams at most)."""
    names = [c for c in df.columns if c != text]
    flat = -float(np.log(BUCKETS))

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row, end, data, offsets in B.text_blocks(part.column("text")):
                ids, rows = _trigrams(data, offsets)
                n = np.diff(rows)
                means = np.full((end - row, len(LANGUAGES) + 1), flat)
                for k in range(len(LANGUAGES)):
                    total = np.append(0.0, np.cumsum(model[k][ids], dtype=np.float64))
                    means[:, k] = (total[rows[1:]] - total[rows[:-1]]) / np.maximum(n, 1)
                means *= np.minimum(n, EVIDENCE)[:, None]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(means) + 1, dtype=np.int32) * means.shape[1]), pa.array(means.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(c).slice(row, end - row) for c in names), pa.array(n), lists], names=[*names, "n", "ll"])

    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names] + ["n bigint", "ll array<double>"])
    return df.select(*names, F.col(text).alias("text")).mapInArrow(score, schema)


def _code(c: Column) -> Column:
    """A language or country code, or other."""
    c = F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), r"^[A-Za-z]{2,3}(?![A-Za-z])", 0))
    return F.when(c == "", "other").otherwise(c)


def _sums(df: DataFrame, key: str, name: str) -> DataFrame:
    """For each value of key how many texts of each language it has."""
    return df.groupBy(key).agg(F.array(*[F.sum((F.col("best") == k).cast("double")) for k in range(len(LANGUAGES))]).alias(name))


def identify(df: DataFrame, model: np.ndarray, text: str, declared: Column, suffix: Column, host: Column) -> DataFrame:
    """The other columns of df with lang, confidence and text_lang (of the text alone)."""
    names = [c for c in df.columns if c != text]
    host = F.coalesce(host, F.lit(""))
    parts = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], F.col(text).cast("string").alias("text"), _code(declared).alias("declared"), _code(suffix).alias("suffix"), host.alias("host"))
    k = range(len(LANGUAGES))
    ll = F.col("ll")
    scored = _likelihoods(parts, model, "text")
    best = F.array_position(ll, F.array_max(ll)) - 1  # und is the last
    scored = cut(scored.withColumn("best", F.when(F.col("n") > 0, best).otherwise(len(LANGUAGES)).cast("int")).withColumn("domain", F.regexp_extract("host", r"[^.]*(\.[^.]*)?$", 0)))
    total = scored.agg(*[F.sum((F.col("best") == i).cast("double")) for i in k]).first()  # one row
    total = [x or 0.0 for x in total]
    shares = [(x + 1) / (sum(total) + len(LANGUAGES)) for x in total]
    hosts = _sums(scored, "host", "by_host").withColumn("domain", F.regexp_extract("host", r"[^.]*(\.[^.]*)?$", 0))
    domains = hosts.groupBy("domain").agg(F.array(*[F.sum(F.col("by_host")[i]) for i in k]).alias("by_domain"))
    hosts = cut(hosts.join(domains, "domain").select(F.col("host").alias("_host"), "by_host", "by_domain"))
    of = lambda key, name: F.broadcast(_sums(scored, key, name))  # noqa: E731  at most 27**3 + 1 codes
    joined = scored.join(of("declared", "by_declared"), "declared").join(of("suffix", "by_suffix"), "suffix").join(hosts, scored.host == hosts._host)
    own = [(F.col("best") == i).cast("double") for i in k]
    mine = (F.col("best") < len(LANGUAGES)).cast("double")

    def prior(name: str, i: int, above: Column) -> Column:
        all_but_own = reduce(lambda a, b: a + b, [F.col(name)[j] for j in k]) - mine
        return (F.col(name)[i] - own[i] + STRENGTH * above) / (all_but_own + STRENGTH)

    def value(name: str, i: int) -> Column:
        """P(value | language), of the other pages."""
        return (F.col(name)[i] - own[i] + 0.5) / (F.lit(total[i]) - own[i] + 1.0)

    logs = [ll[i] + F.log(value("by_declared", i)) + F.log(value("by_suffix", i)) + F.log(prior("by_host", i, prior("by_domain", i, F.lit(shares[i])))) for i in k]
    # Nothing but the text tells und from a language: it gets the mean of what the rest says.
    rest = reduce(lambda a, b: a + b, [logs[i] - ll[i] for i in k]) / len(LANGUAGES)
    joined = joined.withColumn("logs", F.array(*logs, ll[len(LANGUAGES)] + rest))
    top = F.array_max("logs")
    chosen = F.array_position("logs", top)
    share = 1 / F.aggregate(F.transform("logs", lambda x: F.exp(x - top)), F.lit(0.0), lambda a, b: a + b)
    label = F.array(*map(F.lit, (*LANGUAGES, UND)))
    none = F.col("n") == 0
    return joined.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(names)],
        F.when(none, UND).otherwise(F.element_at(label, chosen.cast("int"))).alias("lang_id"),
        F.when(none, 0.0).otherwise(share).alias("confidence"),
        F.element_at(label, F.col("best") + 1).alias("text_lang"),
    )


_HIDDEN = re.compile(rb"<(script|style)\b")
_ENDS = {name: re.compile(rb"</%s\s*>" % name) for name in (b"script", b"style")}
_LANG = re.compile(rb"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""")


def untagged(page: bytes) -> bytes:
    """A page with a space for each script, style, comment and tag; what isn't closed is text.

    One pass: an end that isn't found once isn't looked for again.
    """
    low, out, at, gone = page.lower(), [], 0, set()

    def end_of(kind: bytes, start: int) -> int:
        if kind in gone:
            return -1
        if kind in _ENDS:
            found = _ENDS[kind].search(low, start)
            end = found.end() if found else -1
        else:
            end = low.find(kind, start)
            end += len(kind) if end >= 0 else 0
        if end < 0:
            gone.add(kind)
        return end

    while (start := low.find(b"<", at)) >= 0:
        end = end_of(m[1], m.end()) if (m := _HIDDEN.match(low, start)) else end_of(b"-->", start + 4) if low.startswith(b"<!--", start) else -1
        end = end_of(b">", start + 1) if end < 0 else end
        if end < 0:
            break
        out += [page[at:start], b" "]
        at = end
    return b"".join([*out, page[at:]])


def page_texts(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, url, text, declared): the text of a page without scripts, styles, comments and tags, and its lang attribute."""

    def strip(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, len(part), 200):
                few = part.slice(at, 200)
                raw = [(x.as_py() or "").encode() for x in few.column(2)]
                texts = [entities.unescape(untagged(x).decode("utf-8", "replace")) for x in raw]
                declared = [m[1].decode() if (m := _LANG.search(x)) else None for x in raw]
                yield pa.RecordBatch.from_arrays([few.column(0), few.column(1), pa.array(texts, pa.string()), pa.array(declared, pa.string())], names=[id, url, "text", "declared"])

    kind = pages.schema[id].dataType.simpleString()
    return pages.select(id, F.col(url).cast("string"), F.col(html).cast("string")).mapInArrow(strip, f"`{id}` {kind}, `{url}` string, text string, declared string")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def identify_pages(pages: DataFrame, model: np.ndarray, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, url, lang_id, confidence, text_lang, declared) of web pages."""
    host = host_of(F.col(url))
    suffix = F.regexp_extract(host, r"([a-z]+)$", 1)
    out = identify(page_texts(pages, id, url, html), model, "text", F.col("declared"), suffix, host)
    return out.select(id, url, "lang_id", "confidence", "text_lang", "declared")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit(table(spark, sf_dir, "documents"))
    return identify_pages(table(spark, sf_dir, "pages"), model).select("page_id", F.col("lang_id").alias("lang"), "confidence", "text_lang", "declared")
