"""The factorization machine: terms and scores against plain Python, pairs against additive weights, held-out labels."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from factloom.llm import blocks, toxicity
from factloom.llm.tables import table

SF = "/root/testdata/sf0.01"


def _terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w.encode() for w in re.findall(r"[0-9a-z\u0080-\U0010ffff]+", lower)]
    return {(0, w) for w in words} | {(n, w[:n]) for w in words for n in toxicity.BEGINNINGS if len(w) > n}


def test_terms_are_words_and_beginnings():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abCDé ü1_-\n中") for _ in range(rng.randrange(60))) for _ in range(300)] + ["", None, "x" * 50]
    names, found = {}, {}
    for _, _, data, offsets in blocks.text_blocks(pa.array(texts)):
        for row, term in zip(*toxicity.terms(data, offsets)):
            found.setdefault(int(row), set()).add(int(term))
    for row, text in enumerate(texts):
        expected = _terms(text)
        assert len(found.get(row, set())) == len(expected)
        if len(expected) == 1:
            names[next(iter(expected))] = found[row]
    assert all(len(v) == 1 for v in names.values())


def test_logits_are_the_sum_over_all_pairs():
    rng = np.random.default_rng(1)
    machine = toxicity.Machine(30, -0.5)
    machine.w, machine.v = rng.normal(size=30), rng.normal(size=(30, toxicity.FACTORS))
    bits = rng.random((20, 30)) < 0.3
    bits[3] = False
    rows, numbers = np.nonzero(bits)
    for row, logit in enumerate(machine.logits(rows, numbers, 20)):
        held = np.flatnonzero(bits[row])
        pairs = sum(machine.v[i] @ machine.v[j] for i in held for j in held if i < j)
        assert abs(logit - (-0.5 + machine.w[held].sum() + pairs)) < 1e-9


def _rows(n, seed):
    """Toxic texts have an insult and a group; many clean ones have one of them."""
    rng = random.Random(seed)
    for i in range(n):
        words = [f"w{rng.randrange(60)}" for _ in range(20)]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words += [rng.choice(["moron", "scum"])] * insult + [rng.choice(["tribe", "sect"])] * group
        rng.shuffle(words)
        yield i, " ".join(words), int(insult and group)


def test_pairs_are_learned_that_additive_weights_miss(spark):
    rows = list(_rows(3000, 1))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    known, scores = toxicity.fit(docs, labels)
    fresh = spark.createDataFrame([(i, t, y) for i, t, y in _rows(1000, 2)], "doc_id long, text string, y int")
    found = toxicity.score(fresh, known, scores).collect()
    assert sum((r.score >= 0.5) == r.y for r in found) > 980
    # Without pairs, an insult alone and a group alone together weigh as much as both at once and nothing.
    machine = scores.__self__
    machine.v[:] = 0
    logits = {}
    for name, text in (("none", "w1"), ("insult", "w1 moron"), ("group", "w1 tribe"), ("both", "w1 moron tribe")):
        for _, _, data, offsets in blocks.text_blocks(pa.array([text])):
            logits[name] = machine.logits(*known.of(data, offsets), 1)[0]
    assert abs(logits["insult"] + logits["group"] - logits["none"] - logits["both"]) < 1e-9


def test_held_out_labels_and_no_inputs_but_text(spark):
    found = {r.doc_id: r for r in toxicity.query(spark, SF).collect()}
    labels = [tuple(r) for r in table(spark, SF, "labels").select("doc_id", "toxic").collect()]
    held = [(found[i].score, y) for i, y in labels if found[i].held_out]
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in found)
    pairs = [(a > b) + 0.5 * (a == b) for a, y in held if y == 1 for b, z in held if z == 0]
    assert sum(pairs) / len(pairs) > 0.85
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in found.values())
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    first = {}
    for i, r in found.items():
        assert first.setdefault(texts[i] or "", r.score) == r.score  # equal texts score alike


@pytest.mark.parametrize("labels, share", [([], 0.5), ([(1, 1), (2, 1)], 1.0), ([(1, 0), (2, 5), (None, 1)], 0.0)])
def test_labels_of_one_kind_give_their_share(spark, labels, share):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (None, "x")], "doc_id long, text string")
    known, scores = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert [r.score for r in toxicity.score(docs, known, scores).collect()] == [share] * 4


def test_a_long_text_is_read_to_its_end(spark):
    rows = list(_rows(2000, 3))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    known, scores = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    long = "q " * 1_500_000
    found = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame([(0, long), (1, long + "moron tribe")], "doc_id long, text string"), known, scores).collect()}
    assert found[0] < 0.2 < 0.8 < found[1]


def test_a_score_of_a_taken_name_is_an_error(spark):
    docs = spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, score int")
    with pytest.raises(ValueError, match="another name"):
        toxicity.score(docs, None, None)
    known, scores = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, known, scores, name="toxicity").columns == ["doc_id", "score", "toxicity"]
