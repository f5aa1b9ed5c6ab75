"""Classes of near copies against brute force over all pairs."""

import random

import corpus_pipeline
from factloom.llm import near_copies, simhash
from factloom.llm.tables import table


def _shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or ({" ".join(words)} if words else set())


def _alike(x, y):
    return x == y or len(x & y) >= 0.8 * len(x | y) - 1e-9


def _classes(docs):
    """{id: smallest id of its class}."""
    sets = {i: _shingles(t) for i, t in docs}
    near = {a: [b for b in sets if _alike(sets[a], sets[b])] for a in sets}
    least = {}
    for first in sorted(sets):
        todo = [] if first in least else [first]
        while todo:
            at = todo.pop()
            if at not in least:
                least[at] = first
                todo += near[at]
    return least


def _crowd(seed, copies):
    """Copies of one text with so many edits that a pair is as often above 0.8 as below."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = []
    for n in range(copies):
        words = list(base)
        for at in rng.sample(range(150), rng.randrange(1, 6)):
            words[at] = f"x{n}y{at}"
        texts.append(" ".join(words))
    return texts


def test_crowded_keys_lose_no_pair(spark):
    texts = [t for seed in range(2) for t in _crowd(seed, 45)] + [f"only {n} of its kind" for n in range(5)] + ["", None]
    docs = list(enumerate(texts))
    random.Random(1).shuffle(docs)
    found = {r.id: r.component for r in near_copies.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == _classes(docs)


def test_rounds_of_a_crowd_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "FEW", 2)
    rng = random.Random(5)
    words, docs = [f"w{i}" for i in range(100)], []
    for n in range(40):  # a chain: each text is like its neighbours only
        docs.append((n, " ".join(words)))
        words[rng.randrange(100)] = f"y{n}"
        words[rng.randrange(100)] = f"z{n}"
    for rounds in (0, 2):
        monkeypatch.setattr(near_copies, "ROUNDS", rounds)
        found = {r.id: r.component for r in near_copies.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        assert found == _classes(docs)


def test_the_stage_keeps_what_brute_force_keeps(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    texts = [(r.doc_id, r.text) for r in docs.collect()] + [(10**6 + n, t) for n, t in enumerate(_crowd(9, 40))]
    more = docs.unionByName(spark.createDataFrame(texts[-40:], "doc_id long, text string").selectExpr("*", "'en' AS lang", "'x' AS source", "length(text) AS n_chars"), allowMissingColumns=True)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, more, "").collect()}
    assert kept == {i for i, least in _classes(texts).items() if i == least}


def test_rows_go_and_not_ids(spark):
    """Texts of one id are documents of their own; of equal rows one stays; rows without an id stay."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    docs = [(3, b), (5, a), (5, b), (7, c), (7, c), (7, c), (None, a), (None, a), (9, c + " more"), (11, None), (12, "")]
    found = near_copies.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found), key=str) == sorted([(3, b), (5, a), (7, c), (None, a), (None, a), (11, None)], key=str)


def test_equal_rows_with_other_columns_leave_one(spark):
    docs = spark.createDataFrame([(1, "one text here", {"k": 1}), (1, "one text here", {"k": 2}), (2, "another", None)], "doc_id long, text string, _row map<string,int>")
    found = near_copies.deduplicate(docs)
    assert found.columns == docs.columns and sorted(r.doc_id for r in found.collect()) == [1, 2]


def test_the_language_stage_drops_rows(spark):
    words = "the quick brown fox and the dog are in the house of the king"
    docs = spark.createDataFrame([(1, words, "en", "s", 5), (1, "123 456 789", "en", "s", 3), (2, words, "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.language(spark, docs, None).collect()
    assert sorted((r.doc_id, r.text) for r in found) == [(1, words), (2, words)]


def test_what_simhash_links_is_one_class_before_any_key_is_paired(spark, monkeypatch):
    """The stage goes by SimHash first; with no key at all it finds what op4 links and is similar."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    docs = [(n, " ".join([*words[:-n], f"z{n}"] if n else words)) for n in range(4)] + [(9, " ".join(words[:1500]))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    prints = {r.id: r.fp for r in simhash.fingerprints(frame).collect()}
    assert max(bin((prints[0] ^ prints[n]) & (1 << 64) - 1).count("1") for n in range(1, 4)) <= 2
    monkeypatch.setattr(near_copies, "_keys", lambda single, *_: spark.createDataFrame([], "key bigint, node bigint, size int, at int"))
    assert {r.id: r.component for r in near_copies.near_duplicates(frame).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 9: 9}
