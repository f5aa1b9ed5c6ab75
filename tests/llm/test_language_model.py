"""The score of every token against a reading of one id at a time."""

import math
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers

from factloom.llm import language_model as lm


def test_every_id_of_a_token_is_told_by_the_attention_and_the_ids_before_it_in_its_word(spark, monkeypatch):
    from pyspark.sql import functions as F

    texts = ["the theatre then the thermometer", "THE other theory, the others", None, "", "the the unseenest thermostat"] * 3
    models, fit = [], lm.fit
    monkeypatch.setattr(lm, "fit", lambda *a: models.append(fit(*a)) or models[-1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in lm.score(docs, F.col("doc_id") % 5 != 4).collect()}

    path = public_tokenizers.path(lm.TOKENIZER)
    end = lm.codec(path).special["<|endoftext|>"]
    spelled = {w: lm.encode_words([w.encode()], path)[0].tolist() for t in texts for w in (t or "").lower().split()}
    trained = Counter(w for i, t in enumerate(texts) if i % 5 != 4 for w in (t or "").lower().split())
    model = models[0]
    full, last = defaultdict(Counter), defaultdict(Counter)
    for word, n in trained.items():
        for at, i in enumerate(spelled[word]):
            full[*spelled[word][:at]][i] += n
            last[spelled[word][at - 1] if at else None][i] += n

    def narrowed(counts, i, lower):
        same = {j: n for j, n in counts.items() if model.classes[j] == model.classes[i]}
        total, kinds = sum(same.values()), len(same)
        return (same.get(i, 0) + kinds * lower) / (total + kinds) if total else lower

    for number, text in enumerate(texts):
        words = (text or "").lower().split()
        ids = np.array([*(i for w in words for i in spelled[w]), end])
        classes, at, whole, known = model.class_scores(ids, np.array([0, len(ids)])), 0, 0.0, 0.0
        for word in [*words, None]:
            token = 0.0
            for place, i in enumerate(spelled[word] if word else [end]):
                own = 10 ** model.inside[i]
                if word:
                    before = spelled[word][:place]
                    own = narrowed(full[*before], i, narrowed(last[before[-1] if before else None], i, own))
                token += classes[at] + math.log10(own)
                at += 1
            whole, known = whole + token, known + token * (word is None or trained[word] > 0)
        assert abs(found[number].score - whole) < 1e-4 * abs(whole) and abs(found[number].known_score - known) < 1e-4 * abs(known)


def test_what_is_told_within_a_class_sums_to_one():
    rng = np.random.default_rng(3)
    model = lm.Model(np.arange(300) % lm.CLASSES)
    model.ready(rng.integers(0, 5, 300))
    ids, n = np.tile(np.arange(300), 2), np.append(rng.integers(0, 4, 300), np.zeros(300, int))
    full, last = np.repeat([7, 8], 300).astype(np.uint64), np.repeat([5, 5], 300)
    for part in np.split(10 ** lm.told(full, last, ids, n, model), 2):
        assert np.allclose(np.bincount(model.classes, part), 1)


def test_packed_numbers_come_back():
    for x in (np.zeros(0, np.uint32), np.arange(70_000, dtype=np.uint64) << np.uint64(40), np.array([True, False]), np.float32([-1.5, 0])):
        assert np.array_equal(lm._unpack(lm._pack(x), x.dtype), x) and lm._length(lm._pack(x)) == len(x)
