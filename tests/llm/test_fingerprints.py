"""Document fingerprints against a reading of one document at a time."""

import random
import re
import struct
from collections import Counter

import pytest
import xxhash

from factloom.llm import imatch
from tests.llm.conftest import prose

MASK = (1 << 64) - 1


def signed(x):
    return x - ((x >> 63) << 64)


def of_string(text):
    return signed(xxhash.xxh64_intdigest(text.encode(), 42))


def of_numbers(numbers, seed=42):
    for x in numbers:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", x), seed & MASK)
    return signed(seed)


def with_int(seed, n):
    return signed(xxhash.xxh64_intdigest(struct.pack("<i", n), seed & MASK))


def terms(text):
    return [of_string(w) for w in re.split(" ", "".join(" " if c in imatch._DROPPED else c.lower() for c in text))]


def band_of(texts):
    counts = Counter(t for text in texts for t in set(terms(text or "")))
    low, high = max(2, imatch.LOW * len(texts)), max(2, imatch.HIGH * len(texts))
    return sorted(t for t, n in counts.items() if low <= n <= high and t != of_string(""))


def fingerprint(text, band):
    own = sorted({*terms(text)} & {*band})
    whole = of_numbers(own) if own else with_int(of_numbers(sorted({*terms(text)})), 1)
    pieces = []
    for rate, n in imatch.RATES:
        for k in range(n):
            drawn = [t for t in own if with_int(of_numbers([t]), rate) % rate == k]
            pieces.append(f"{of_numbers_of(drawn) % 65535 + 1:04x}" if drawn else "0000")
    return f"{whole & MASK:016x}" + "".join(pieces)


def of_numbers_of(drawn):
    """Spark hashes a struct field by field: a term, then its remainder at each rate."""
    seed = 42
    for t in drawn:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", t), seed & MASK)
        for rate, _ in imatch.RATES:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", with_int(of_numbers([t]), rate) % rate), seed & MASK)
    return signed(seed)


def likeness(a, b):
    x, y = ([f[i : i + 4] for i in range(16, len(f), 4)] for f in (a, b))
    held = sum(p != "0000" or q != "0000" for p, q in zip(x, y, strict=True))
    same = sum(p == q != "0000" for p, q in zip(x, y, strict=True))
    return 1.0 if a == b else same / held if held else 0.0


def test_fingerprints_and_likeness_equal_brute_force(spark):
    words = prose(40, 400).split()
    rng = random.Random(3)
    texts = [" ".join(rng.choices(words, k=rng.randrange(5, 200))) for _ in range(60)] + ["", None, "Aa,bB  cC", "aa bb cc", "x" * 300_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    band = imatch.lexicon(df)
    assert band == band_of(texts)
    found = imatch.fingerprint(df, band, "text", "f")
    pairs = found.alias("a").join(found.alias("b").selectExpr("id - 1 as id", "f as g"), "id").withColumn("near", imatch.likeness("f", "g")).collect()
    expected = [fingerprint(t or "", band) for t in texts]
    assert {r.id: r.f for r in found.collect()} == dict(enumerate(expected))
    assert all(abs(r.near - likeness(expected[r.id], expected[r.id + 1])) < 1e-12 for r in pairs)


@pytest.mark.parametrize("stretch", [3, 20, 500])
def test_every_row_meets_the_one_that_follows(spark, monkeypatch, stretch):
    monkeypatch.setattr(imatch, "STRETCH", stretch)
    rng = random.Random(stretch)
    ids = [None] * 60 + [7] * 70 + [rng.randrange(-1000, 1000) for _ in range(90)] + [(1 << 63) - 1] * 40 + [-(1 << 63)] * 2
    rows = [(i, f"text {rng.randrange(200)}") for i in ids]
    df = spark.createDataFrame(rows, "id long, text string").selectExpr("id", "text", "'clash' AS p", "'clash' AS `row`", "'clash' AS k")
    found = imatch.with_next(df, "id", ("text",)).collect()
    order = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], of_string(r[1])))
    expected = Counter((order[i][1], order[(i + 1) % len(order)][1]) for i in range(len(order)))
    assert Counter((r.text, r.next_text) for r in found) == expected
    assert Counter(r.id for r in found) == Counter(ids) and set(found[0].asDict()) == {"id", "text", "p", "row", "k", "next_text"}


def test_one_row_follows_itself_and_none_gives_none(spark):
    df = spark.createDataFrame([(4, "a")], "id long, text string")
    assert [r.next_text for r in imatch.with_next(df, "id", ("text",)).collect()] == ["a"]
    assert imatch.with_next(df.where("id = 5"), "id", ("text",)).collect() == []
