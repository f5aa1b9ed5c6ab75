"""The Merkle manifest against a tree that is built whole in plain Python."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from factloom.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def _lower(text):
    return text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def _tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def _steps(levels, at):
    for level in levels[:-1]:
        first = at - at % 8
        yield "".join(level[first:at]), "".join(level[at + 1 : first + 8])
        at //= 8


def expected(docs):
    groups = defaultdict(list)
    for doc_id, text, lang, source, n_chars in docs:
        head = [doc_id, source, lang, n_chars]
        altered = _lower(text) if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 else text
        groups[lang].append((doc_id is not None, doc_id or 0, H(*map(_field, [*head, text])), H(*map(_field, [*head, altered])), doc_id))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: _tree([r[2] for r in sorted(rows)]) for g, rows in groups.items()}
    top = _tree([trees[g][-1][0] for g in order])
    for g, rows in groups.items():
        for i, (_, _, leaf, altered, doc_id) in enumerate(sorted(rows)):
            folded, siblings = altered, ""
            for left, right in [*_steps(trees[g], i), *_steps(top, order.index(g))]:
                folded, siblings = H(left, folded, right), siblings + left + right
            yield doc_id, leaf, trees[g][-1][0], top[-1][0], H(siblings), folded, folded == top[-1][0]


def _docs(spark, where):
    return [tuple(r) for r in spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]


@pytest.mark.parametrize("corpus", ["hard", "extra", "empty"])
def test_every_proof_equals_the_whole_tree(spark, corpora, corpus):
    found = merkle.query(spark, corpora[corpus])
    assert Counter(map(tuple, found.collect())) == Counter(expected(_docs(spark, corpora[corpus])))


def test_groups_of_all_sizes_and_many_groups(spark, tmp_path):
    """Single rows, whole and broken runs and subtrees, more groups than a run has places, equal rows."""
    docs, sizes = [], [1, 2, 7, 8, 9, 63, 64, 65, 511, 512, 513, 1030]
    for g, n in enumerate(sizes):
        docs += [(100_000 * g + i * 3, f"Text {i % 5}", f"lang{g}", None if i % 7 == 0 else "src", i) for i in range(n)]
    docs += [(5, "equal", None, "s", 5)] * 20
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    found = merkle.query(spark, str(tmp_path))
    assert Counter(map(tuple, found.collect())) == Counter(expected(docs))


def test_equal_to_sql_where_ids_differ(spark):
    sf = "/root/testdata/sf0.001"
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    result = connection.execute(merkle.SQL)
    names = [c[0] for c in result.description]
    found = merkle.query(spark, sf)
    assert Counter(map(tuple, found.collect())) == Counter(tuple(r[names.index(c)] for c in found.columns) for r in result.fetchall())


def test_only_every_third_level_is_stored(spark):
    leaves = spark.range(1030).selectExpr("id", "'g' AS `group`", "sha2(CAST(id AS STRING), 256) AS leaf")
    manifest = merkle.build(leaves)
    assert [level.count() for level in manifest.levels] == [1030, 3]
    assert manifest.root == _tree([H(str(i)) for i in range(1030)])[-1][0]
