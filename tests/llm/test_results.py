"""Operators against brute force, an exact round trip or held-out labels on small inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

from factloom.llm import bpe, components, imatch, language_id, language_model, license_scan, near_copies, packing, quality_model, quality_rules, simhash, substring_dedup
from factloom.llm.tables import table

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


def _texts(spark, where):
    return [(r.doc_id, r.text or "") for r in table(spark, where, "documents").collect()]


@pytest.mark.parametrize("module", [quality_rules, substring_dedup])
def test_equal_to_sql(spark, corpora, module):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{corpora['hard']}/documents.parquet/*.parquet' WHERE doc_id IS NOT NULL")
    result = connection.execute(module.SQL)
    names = [c[0] for c in result.description]
    found = module.query(spark, corpora["hard"]).where("doc_id is not null")
    at = [names.index(c) for c in found.columns]
    assert Counter(map(tuple, found.collect())) == Counter(tuple(r[i] for i in at) for r in result.fetchall())


def test_bpe_equals_the_library_and_round_trips():
    path = public_tokenizers.path(bpe.TOKENIZER)
    library, own = Tokenizer.from_file(path), bpe.Codec(path)
    rng = random.Random(2)
    letters = "ab'sté ÉΣσς  \u0085\x1c​İß1٣中文😀!_-aaaahh\n\t\v"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) + rng.choice(["", "<|endoftext|>", "it's I'll  "]) for _ in range(3000)] + ["", "a" * 999, " " * 77]
    ids, shown = own.encode(texts)
    for text, i, s, back in zip(texts, ids, shown, own.decode(ids), strict=True):
        expected = library.encode(text, add_special_tokens=False).ids
        assert i.tolist() == expected and s == ",".join(map(str, expected))
        assert back.decode() == text == library.decode(expected, skip_special_tokens=False)


def test_word_encoder_equals_the_library():
    path = public_tokenizers.path(packing.TOKENIZER)
    library, own = Tokenizer.from_file(path), packing.WordEncoder(path)
    rng = random.Random(3)
    letters = "ab'sté ÉΣσς  \u0085\x1c\x1fßÀöÿªKİ​İß10٣中文😀!_-<|endoftext|>\n\t\v"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(30)))
        assert np.frombuffer(own.ids([text])[0], np.uint16).tolist() == library.encode(text, add_special_tokens=False).ids


def test_packing_holds_every_id_once(spark, corpora):
    library = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    library.no_truncation()
    library.no_padding()
    pieces = packing.query(spark, corpora["hard"]).collect()
    expected, found, rows = Counter(), Counter(), defaultdict(list)
    for p in pieces:
        rows[p.doc_id, p.doc_tokens].append(p)
    for doc, text in _texts(spark, corpora["hard"]):
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [2], "<u4")
        spans = {(p.start, p.length): p.ids_crc32 for p in rows[doc, len(ids)]}
        assert all(crc == zlib.crc32(ids[a : a + n].tobytes()) for (a, n), crc in spans.items()) or doc is None
        expected.update((doc, len(ids), i) for i in range(len(ids)))
    for p in pieces:
        assert (p.doc_id, p.doc_tokens, p.start) in expected and 0 < p.length <= 4096
        found.update((p.doc_id, p.doc_tokens, i) for i in range(p.start, p.start + p.length))
    assert found == +expected  # each id of each row in exactly one piece
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096
    assert sum(sum(n for _, n in held) < 4096 for held in sequences.values()) == 1


def test_equal_rows_are_dealt_into_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_DOCS", 50)
    pieces = packing.pack_documents(spark.range(1000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "'the same text' AS text")).collect()
    groups = Counter(p.sequence_id >> 32 for p in pieces)
    assert len(groups) == 20 and max(groups.values()) < 120


def test_pack_leaves_one_gap_at_most():
    rng = np.random.default_rng(1)
    for _ in range(100):
        lengths = rng.integers(1, rng.choice([5, 50, 500]), rng.integers(0, 60))
        pieces, held = packing.pack(lengths, 100), Counter()
        for _, _, n, b, _ in pieces:
            held[b] += n
        assert sum(held.values()) == lengths.sum() and len(held) == -(-int(lengths.sum()) // 100) and max(held.values(), default=0) <= 100


def _fingerprint(text):
    words = re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_classes_equal_all_pairs(spark, corpora):
    texts = [(i, t) for i, t in _texts(spark, corpora["hard"]) if i is not None]
    prints = {i: _fingerprint(t) for i, t in texts}
    found = {r.doc_id: r for r in simhash.query(spark, corpora["hard"]).where("doc_id is not null").collect()}
    least = {i: i for i in prints}
    for _ in prints:
        for a in prints:
            least[a] = min(least[b] for b in prints if (prints[a] ^ prints[b]).bit_count() <= 2)
    for i in prints:
        assert found[i].fingerprint == f"{prints[i]:016x}" and found[i].component_id == least[i]


@pytest.mark.parametrize("crowd", [0, 3, 64])
def test_links_of_crowded_keys_lose_no_class(spark, crowd):
    rng = random.Random(crowd)
    centre, prints = rng.getrandbits(63), set()
    for _ in range(150):
        x = centre
        for _ in range(rng.randrange(7)):
            x ^= 1 << rng.randrange(64)
        prints.add(x - ((x >> 63) << 64))
    prints = sorted(prints)
    links = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), 2, crowd)
    assert all((r.a ^ r.b).bit_count() <= 2 or ((r.a ^ r.b) & ((1 << 64) - 1)).bit_count() <= 2 for r in links.collect())
    found = {r.node: r.root for r in components.components(links).collect()}
    least = {p: p for p in prints}
    for _ in prints:
        new = {a: min(least[b] for b in prints if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2) for a in prints}
        if new == least:
            break
        least = new
    assert {p: found.get(p, p) for p in prints} == least


def test_near_duplicates_are_caught_and_others_left_alone(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(3000)]
    docs = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(200)]
        docs.append((3 * i, " ".join(base)))
        base[rng.randrange(200)] = "changed"
        docs.append((3 * i + 1, " ".join(base)))
        docs.append((3 * i + 2, " ".join(base)))
    found = {r.id: r.component for r in near_copies.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(found[3 * i] == 3 * i and found[3 * i + 2] == found[3 * i + 1] for i in range(60))
    assert sum(found[3 * i + 1] == 3 * i for i in range(60)) >= 57


def test_removed_passages_leave_other_text_as_it_is(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    docs = [(1, f"a  b\n{passage} c"), (2, f"x y\t{passage}  z"), (3, "left\n alone "), (4, passage)]
    found = {r.doc_id: (r.text, r.n_removed) for r in substring_dedup.remove(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == {1: (docs[0][1], 0), 2: ("x y  z", 20), 3: (docs[2][1], 0), 4: ("", 20)}


def test_quality_scores_tell_held_out_labels_apart(spark):
    found = quality_model.query(spark, "/root/testdata/sf0.01").toPandas()
    labels = table(spark, "/root/testdata/sf0.01", "labels").toPandas()
    rows = found[found.held_out].merge(labels, on="doc_id")
    good, bad = rows[rows.quality == 1].score.to_numpy(), rows[rows.quality == 0].score.to_numpy()
    assert (good[:, None] > bad).mean() > 0.95 and found.score.between(0, 1).all()


def test_base_scores_of_the_language_model(spark):
    texts = _texts(spark, SF)
    words = {i: [*t.encode().lower().split(), None] for i, t in texts}
    counts = Counter(w for i in words if zlib.crc32(str(i).encode()) % 7 != 2 for w in words[i])
    total, distinct = sum(counts.values()), len(counts)
    for r in language_model.query(spark, SF).collect():
        own = words[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), total)
        assert abs(r.base_score - sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own)) < 1e-6
        assert r.score < 0


def test_attention_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    model = language_model.Model(np.arange(500) % language_model.CLASSES)
    model.ready(rng.integers(0, 9, 500).astype(float))
    x = rng.integers(0, language_model.CLASSES + 1, (1, language_model.WINDOW))
    each = [model.window_scores(x, np.full_like(x, c)) for c in range(language_model.CLASSES)]
    assert np.allclose(sum(10**e for e in each), 1, atol=1e-4)
    assert np.allclose(np.bincount(model.classes, 10**model.inside), 1)


def test_windows_change_nothing_for_short_texts_and_score_each_id_once():
    rng = np.random.default_rng(1)
    model = language_model.Model(np.arange(50) % language_model.CLASSES)
    model.ready(np.ones(50))
    ids = rng.integers(0, 50, 300)
    whole = model.score(ids, np.array([0, 20, 300]))
    assert np.allclose(whole[:20], model.score(ids[:20], np.array([0, 20])), atol=1e-5) and (whole < 0).all()


def test_attention_equals_a_reading_of_one_id_at_a_time():
    rng = np.random.default_rng(2)
    model = language_model.Model(rng.integers(0, language_model.CLASSES, 60))
    model.fill(rng.normal(0, 0.4, len(model.flat())))
    model.ready(rng.integers(1, 9, 60).astype(float))
    t, size, stride, groups, members = model.t, language_model.WINDOW, language_model.STRIDE, language_model.GROUPS, language_model.MEMBERS
    ids = rng.integers(0, 60, 3 * size + 5)
    classes = model.classes[ids]
    before = [language_model.CLASSES, *classes[:-1]]
    expected = []
    for i, c in enumerate(classes):
        start = 0 if i < size else stride * -(-(i - size + 1) // stride)
        span = range(start, i + 1)
        pull = np.array([t["q"][before[i]] @ t["k"][before[j]] / math.sqrt(language_model.KEYS) + t["d"][i - j] for j in span])
        share = np.exp(pull - pull.max()) / np.exp(pull - pull.max()).sum()
        h = sum(s * t["v"][before[j]] for s, j in zip(share, span, strict=True)) + t["p"][before[i]]
        z = h / (1 + np.abs(h)) @ t["w"] + t["b"]
        group = c // members
        inner = z[groups + group * members : groups + (group + 1) * members]
        chance = np.exp(z[group]) / np.exp(z[:groups]).sum() * np.exp(inner[c % members]) / np.exp(inner).sum()
        expected.append(math.log10(chance) + model.inside[ids[i]])
    assert np.allclose(model.score(ids, np.array([0, len(ids)])), expected, atol=1e-4)


def test_windows_for_training_hold_each_class_once():
    ids, classes = np.arange(100), np.arange(100) % 7
    rows = np.array([0, 1, 33, 33 + language_model.WINDOW, 100])
    found = [(x, y) for xs, ys in language_model.windows_of(ids, rows, classes) for x, y in zip(xs, ys, strict=True)]
    assert np.array_equal(np.concatenate([y[y >= 0] for _, y in found]), classes)
    assert sum(x[0] == language_model.CLASSES for x, _ in found) == len(rows) - 1


def test_the_language_model_tells_words_it_knows_better_than_their_counts(spark):
    rows = language_model.query(spark, "/root/testdata/sf0.01").where("held_out").toPandas()
    known = rows.n_known.sum()
    docs = [t.split() for t in table(spark, "/root/testdata/sf0.01", "documents").where("crc32(cast(doc_id as string)) % 7 != 2").toPandas().text.fillna("")]
    distinct = len({"".join(c.lower() if c.isascii() else c for c in w) for d in docs for w in d}) + 1
    unseen = -math.log10(rows.train_tokens[0] + distinct + 1)
    base = (rows.base_score.sum() - (rows.n_tokens.sum() - known) * unseen) / known
    assert rows.known_score.sum() / known > base + 0.05


def test_languages_of_documents(spark):
    from pyspark.sql import functions as F

    docs = table(spark, SF, "documents")
    found = language_id.identify(docs.select("doc_id", "text", F.col("lang").alias("said")), language_id.fit(docs), "text", F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("h"))
    assert found.where("said = lang_id").count() >= 0.99 * found.count()


def test_fingerprints_of_edited_texts(spark):
    texts = sorted(_texts(spark, SF))
    found = {r.doc_id: r for r in imatch.query(spark, SF).collect()}
    for n, (i, t) in enumerate(texts):
        half = len(t) // 2
        edited = t[: len(t) - half] + texts[(n + 1) % len(texts)][1][:half]
        assert found[i].n_chars == len(t) and found[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    by_text = {}
    assert all(by_text.setdefault(t, found[i].fingerprint) == found[i].fingerprint for i, t in texts)
    assert np.mean([r.near_edited for r in found.values()]) > 5 * np.mean([r.near_next for r in found.values()])


def test_licences_are_found_and_inherited(spark):
    files = [
        (1, "a/LICENSE", "Released under the MIT License.\nSome more words that follow it, and more of them, and more."),
        (2, "a/src/x.rs", "fn main"),
        (3, "a/src/y.rs", "// Licensed under the Apache License, Version 2.0.\n" + "code and more code\n" * 20),
        (4, "b/z.rs", "code"),
        (5, "a/src/sub/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        (6, "a/src/sub/q.rs", None),
        (7, None, "nothing"),
    ]
    rows = {r.doc_id: (r.licence, r.origin, r.origin_path) for r in license_scan.scan(spark.createDataFrame(files, "doc_id int, path string, text string")).collect()}
    assert rows == {
        1: ("MIT", "notice", "a/LICENSE"), 2: ("MIT", "directory", "a/LICENSE"), 3: ("Apache-2.0", "notice", "a/src/y.rs"), 4: (None, "none", None),
        5: ("GPL-3.0", "notice", "a/src/sub/COPYING"), 6: ("GPL-3.0", "directory", "a/src/sub/COPYING"), 7: (None, "none", None),
    }


def test_whole_licences_and_wrapped_headers_are_found(spark):
    texts = dict(license_scan.TEXTS)
    bsd = "Copyright (c) 2020. All rights reserved.\n\n" + "\n\n".join(texts["BSD-3-Clause"])
    gpl = "\n".join([
        "// This program is free software: you can redistribute it and/or modify", "// it under the terms of the GNU General Public License as published by", "// the Free Software Foundation, either version 3",
        "// of the License, or (at your option) any later version.", "fn main() {}", *["    let licence_of_word = other(words);"] * 9,
    ])
    files = [
        (1, "a/LICENSE", texts["ISC"][0]), (2, "b/LICENSE", bsd), (3, "c/x.rs", gpl), (4, "d/LICENSE", "Copyright (c) 2020 A. B.\n\n" + "\n\n".join(texts["MIT"])), (5, "b/y.rs", "code"),
        (6, "e/LICENSE", "# " * 30_000 + "-" * 50_000 + "x\n" * 30_000 + "#\n" * 30_000), (7, "f/z.txt", "Copyright. All rights reserved."),
        (8, "g/LICENSE", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\n" + "\n\n".join(f"{n}. Some clause of a licence with words of its own, as clause {n} has." for n in range(90))),
    ]
    rows = {r.doc_id: r.licence for r in license_scan.scan(spark.createDataFrame(files, "doc_id int, path string, text string")).collect()}
    assert rows == {1: "ISC", 2: "BSD-3-Clause", 3: "GPL-3.0", 4: "MIT", 5: "BSD-3-Clause", 6: None, 7: "Proprietary", 8: "GPL-3.0"}


def test_licence_scores_equal_a_plain_cosine(spark):
    texts = [(f"k{n}", line.lower(), n % 3 + 1) for n, line in enumerate(["Released under the MIT License.", "licensed under version 3 of the gnu public license, words", "no license here", "copyright 2020", license_scan.TEXTS[2][1][0], "...", ""])]
    terms = lambda line: Counter(re.findall(r"[^\W\d_]+|[0-9]+", line.lower()))
    forms = [(name, terms(form)) for name, form in license_scan.FORMS]
    known, total = set().union(*(f for _, f in forms)), sum(n for *_, n in texts)
    seen = Counter()
    for _, line, n in texts:
        seen.update(dict.fromkeys(terms(line), n))
    weights = lambda found: {t: c * (math.log((1 + total) / (1 + (seen[t] if t in known else 0))) + 1) for t, c in found.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    expected = {}
    for key, line, _ in texts:
        v = weights(terms(line))
        best = min(((-round(sum(v.get(t, 0) * x for t, x in w.items()) / norm(w) / norm(v), 6), name) for name, w in ((name, weights(f)) for name, f in forms)), default=None) if v else (0, None)
        if -best[0] >= license_scan.ALIKE:
            expected[key] = (best[1], -best[0])
    found = {r.key: (r.licence, r.score) for r in license_scan.score_notices(spark.createDataFrame(texts, "key string, line string, n long")).collect()}
    assert found.keys() == expected.keys() and all(found[k][0] == expected[k][0] and abs(found[k][1] - expected[k][1]) < 2e-6 for k in found)
