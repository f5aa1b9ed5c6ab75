"""Sizes beyond the fixed ones of the operators."""

import math
import random

import numpy as np
import public_tokenizers
import pytest

from factloom.llm import language_model, packing, simhash


def test_a_word_of_more_than_65536_ids_is_scored_in_full(spark):
    from pyspark.sql import functions as F

    path = public_tokenizers.path(language_model.TOKENIZER)
    rng = random.Random(4)
    texts = ["some words before it", "".join(rng.choice("abcxyz0123456789") for _ in range(160_000)), "and words after it"]
    size, end = len(language_model.codec(path).text_of), language_model.codec(path).special["<|endoftext|>"]
    model = language_model.Model(np.arange(size) % language_model.CLASSES)
    model.ready(np.zeros(size))
    found = {r.doc_id: r.score for r in language_model.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), F.lit(False)).collect()}
    for i, text in enumerate(texts):
        words = [w.encode() for w in text.split()]
        ids = np.append(language_model.encode_words(words, path)[0], end)
        assert i != 1 or len(ids) > 65_537
        expected = model.score(ids, np.array([0, len(ids)])).sum() + (len(words) + 1) * math.log10(language_model.spelled_weight(0, 0))
        assert abs(found[i] - expected) < 1e-5 * abs(expected)


def test_crowded_keys_at_other_radii_are_an_error(spark):
    prints = spark.createDataFrame([(1 << n,) for n in range(20)], "fp long")
    with pytest.raises(ValueError, match="radius"):
        simhash.links(prints, 4, 3)
    assert simhash.links(prints, 4, 64).count() == 190


def test_the_encoder_pauses_the_collector_for_a_block_only(monkeypatch):
    import gc

    encoder, seen = packing.word_encoder(public_tokenizers.path(packing.TOKENIZER)), []
    monkeypatch.setattr(encoder, "_learn", lambda words, f=encoder._learn: seen.append(gc.isenabled()) or f(words))
    encoder.ids(["words that zzyzx has never seen before"])
    assert seen == [False] and gc.isenabled()
