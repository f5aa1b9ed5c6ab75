"""I-Match document fingerprints from DataFrame functions only.

1. Document frequencies of all terms of all documents; a term is known by its 64-bit hash. The lexicon keeps the band
   LOW..HIGH of the share of documents: a band of the inverse document frequency. Each of its terms is in LOW of all
   documents at least, so it has at most (mean distinct terms of a document) / LOW terms however many documents there
   are; it goes with the tasks as a hash set.
2. A document's distinct lexicon terms, sorted, are hashed as a whole and for SUBSETS randomised subsets of the lexicon,
   16 bits each; 0000 stands for a subset without a term of the document. Subsets are drawn at several rates, so that
   short and long documents have subsets of a few of their terms.
3. The likeness of two fingerprints is the share of equal hashes among the subsets that either has terms of.

Terms are lower-cased runs between white space and ASCII punctuation.

Defined results: a text without lexicon terms is hashed over all its terms, all subsets 0000; two of these are alike if
equal (1) or not (0). Null texts are empty. Repeated rows follow each other; rows of one id are in the order of a hash of
their texts. A null id comes before all others. Texts are hashed whole, however long. fingerprint() takes no
columns _terms, _band, _drawn and _subs; with_next() takes any.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.tables import cut, table

LOW, HIGH = 0.01, 0.2
#: (one in so many terms is in a subset, subsets of that rate); each rate reads its own bits of a second hash.
RATES = ((16, 2), (64, 14), (256, 20), (1024, 28))
SUBSETS = sum(n for _, n in RATES)
#: Rows of a stretch of neighbours, the most bounds of ids, and the most parts of what lies between two of them.
STRETCH, STRETCHES, FINER = 500, 1024, 128
_LEAST = -(1 << 63)
_DROPPED = "\t\n\x0b\x0c\r!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def terms(text: Column) -> Column:
    """Hashes of the terms in order; that of the empty string stands between neighbouring separators."""
    flat = F.translate(F.lower(text), _DROPPED, " " * len(_DROPPED))
    return F.transform(F.split(flat, " "), lambda w: F.xxhash64(w))


def lexicon(df: DataFrame, text: str = "text", low: float = LOW, high: float = HIGH) -> list[int]:
    """The terms in the band; at most (mean distinct terms of a document) / low."""
    n = df.count()
    found = df.select(F.explode(F.array_distinct(terms(F.coalesce(text, F.lit(""))))).alias("t"))
    counts = found.groupBy("t").agg(F.count("*").alias("n")).where((F.col("n") >= max(2, low * n)) & (F.col("n") <= max(2, high * n)))
    return sorted(r.t for r in counts.where(F.col("t") != F.xxhash64(F.lit(""))).collect())


def _drawn(rate: int, k: int):
    return lambda x: x[f"r{rate}"] == k


def fingerprint(df: DataFrame, band: list[int], text: str, name: str) -> DataFrame:
    """Adds the fingerprint of a text column: 16 hexadecimal digits of the whole, then 4 of each subset."""
    keep = list(df.columns)
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.select(*keep, terms(t).alias("_terms"))
    # One string for the set: as columns, each number would be a call to the JVM.
    held = F.expr(f"filter(_terms, x -> x IN ({', '.join(f'{x}L' for x in band)}))") if band else F.array().cast("array<bigint>")
    df = df.select(*keep, F.sort_array(F.array_distinct(held)).alias("_band"))
    draw = lambda x: F.struct(x.alias("t"), *[F.pmod(F.xxhash64(x, F.lit(rate)), F.lit(rate)).alias(f"r{rate}") for rate, _ in RATES])
    df = df.select(*keep, "_band", F.transform("_band", draw).alias("_drawn"))
    subsets = [F.filter("_drawn", _drawn(rate, k)) for rate, n in RATES for k in range(n)]
    df = df.select(*keep, "_band", F.array(*subsets).alias("_subs"))
    piece = lambda sub: F.when(F.size(sub) == 0, "0000").otherwise(F.lpad(F.lower(F.hex(F.pmod(F.xxhash64(sub), F.lit(65535)) + 1)), 4, "0"))
    whole = F.when(F.size("_band") > 0, F.xxhash64("_band")).otherwise(F.xxhash64(F.sort_array(F.array_distinct(terms(t))), F.lit(1)))
    # The row id keeps later filters from being evaluated below, where they would repeat the work on the arrays.
    whole = F.when(F.monotonically_increasing_id() >= 0, whole)
    return df.select(*keep, F.concat(F.lpad(F.lower(F.hex(whole)), 16, "0"), F.array_join(F.transform("_subs", piece), "")).alias(name))


def likeness(a: str, b: str) -> Column:
    """0 to 1 for two columns of fingerprints."""
    at = F.sequence(F.lit(17), F.lit(17 + 4 * (SUBSETS - 1)), F.lit(4))
    x = lambda i: F.substring(F.col(a), i, F.lit(4))
    y = lambda i: F.substring(F.col(b), i, F.lit(4))
    held = F.size(F.filter(at, lambda i: (x(i) != "0000") | (y(i) != "0000")))
    same = F.size(F.filter(at, lambda i: (x(i) == y(i)) & (x(i) != "0000")))
    return F.when(F.col(a) == F.col(b), 1.0).when(held == 0, 0.0).otherwise(same / held)


def _search(value: Column, bounds: list[int], first: int = 0) -> Column:
    """The number of bounds at or below a value, by a tree of comparisons."""
    if not bounds:
        return F.lit(first)
    mid = len(bounds) // 2
    return F.when(value < bounds[mid], _search(value, bounds[:mid], first)).otherwise(_search(value, bounds[mid + 1 :], first + mid + 1))


def _stretches(flat: DataFrame) -> tuple[list[int], DataFrame, DataFrame]:
    """Bounds of k, (p, one, cuts) and (p, q, head, before) of the stretches of rows (k, t) in order.

    Bounds of k by approximate quantiles; a k that fills more than one stretch lies alone between two bounds. What lies
    between two bounds is cut again at up to FINER quantiles of k, or of t where there is one k only. head is a stretch's
    first (k, t), before the stretch that comes before it, the last one for the first.
    """
    flat = cut(flat)
    parts = min(STRETCHES, max(1, flat.count() // STRETCH))
    found = flat.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)], 20 * parts)).first()[0] or [] if parts > 1 else []
    filled = {a for a, b in zip(found, found[1:], strict=False) if a == b}
    bounds = sorted({*found, *(k + 1 for k in filled if k < -_LEAST - 1)})  # at most 2 * STRETCHES numbers
    flat = flat.withColumn("p", _search(F.col("k"), bounds))
    sizes = flat.groupBy("p").agg(F.count("*").alias("n"), (F.min("k") == F.max("k")).alias("one")).collect()
    most = max((r.n for r in sizes), default=0)
    finer = min(FINER, math.ceil(most / STRETCH)) if most > 4 * STRETCH else 1
    one = F.col("p").isin([r.p for r in sizes if r.one])
    found = F.percentile_approx(F.when(one, F.col("t")).otherwise(F.col("k")), [i / finer for i in range(1, finer)], 20 * finer) if finer > 1 else F.array().cast("array<bigint>")
    cuts = cut(flat.groupBy("p").agg(found.alias("cuts")).select("p", one.alias("one"), F.array_distinct("cuts").alias("cuts")))
    heads = cut(_placed(flat, cuts).groupBy("p", "q").agg(F.min(F.struct("k", "t")).alias("head")))
    last = {r.p: r.q for r in heads.groupBy("p").agg(F.max("q").alias("q")).collect()}
    used = sorted(last)
    prior = {p: (b, last[b]) for p, b in zip(used, used[-1:] + used[:-1], strict=True)}
    earlier = F.create_map(*[x for p, (b, q) in prior.items() for x in (F.lit(p), F.struct(F.lit(b).alias("p"), F.lit(q).alias("q")))]) if prior else None
    within = F.lag(F.struct("p", "q")).over(Window.partitionBy("p").orderBy("q"))
    return bounds, cuts, heads.select("p", "q", "head", F.coalesce(within, earlier[F.col("p")]).alias("before") if prior else within.alias("before"))


def _placed(df: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds q, the place of (k, t) among the cuts of p; cuts has 2 * STRETCHES rows of FINER numbers at most."""
    out = df.join(F.broadcast(cuts), "p")
    value = F.when(F.col("one"), F.col("t")).otherwise(F.col("k"))
    return out.withColumn("q", F.size(F.filter("cuts", lambda c: c <= value))).drop("one", "cuts")


def with_next(df: DataFrame, id: str, columns: tuple[str, ...], tie: str = "text") -> DataFrame:
    """Adds next_<column>, the values of the row that follows by ascending id; after the last row comes the first.

    Rows of one id are in the order of the hash of the column ``tie``, on which the others have to depend. Rows are dealt
    into stretches; the first row of each goes to the one before it too, as the follower of that one's last row.
    """
    keep = list(df.columns)
    key, hashed = F.coalesce(F.col(id).cast("long"), F.lit(_LEAST)), F.xxhash64(tie)
    bounds, cuts, heads = _stretches(df.select(key.alias("k"), hashed.alias("t")))
    rows = df.select(F.struct(*keep).alias("row"), key.alias("k"), hashed.alias("t"))
    dealt = _placed(rows.withColumn("p", _search(F.col("k"), bounds)), cuts)
    dealt = dealt.join(F.broadcast(heads), ["p", "q"])  # 2 * STRETCHES * FINER rows of numbers at most
    own, also = (F.struct(p.alias("p"), q.alias("q"), F.lit(after).alias("after")) for p, q, after in ((F.col("p"), F.col("q"), 0), (F.col("before.p"), F.col("before.q"), 1)))
    dealt = dealt.select("row", "k", "t", F.explode(F.when(F.struct("k", "t") == F.col("head"), F.array(own, also)).otherwise(F.array(own))).alias("at"))
    order = Window.partitionBy("at.p", "at.q").orderBy("at.after", "k", "t")
    out = dealt.select("row", "at", *[F.lead(f"row.{c}").over(order).alias(f"next_{c}") for c in columns])
    return out.where("at.after = 0").select("row.*", *[f"next_{c}" for c in columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    band = lexicon(docs)
    docs = with_next(fingerprint(docs, band, "text", "fingerprint"), "doc_id", ("text", "fingerprint"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    docs = docs.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", edited.alias("edited"))
    docs = fingerprint(docs, band, "edited", "edited_fingerprint")
    return docs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )
