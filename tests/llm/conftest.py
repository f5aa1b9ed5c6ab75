import random

import pytest

LABEL, PAGE = "doc_id long, quality int, toxic int", "page_id long, url string, html string"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, words, syllables="th er on an re he in ed nd ha at en es of or".split()):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(words))


def rows():
    long = prose(1, 20_000)
    shared = prose(2, 60)
    texts = [None, "", " \n\t ", "one", "two words", prose(3, 400), prose(3, 400), long, long, shared + " " + prose(4, 80), prose(5, 30) + "\n" + shared]
    texts += ["A b c d e f g h i j k l", "line one here\nline one here\nLicensed under the Apache License, Version 2.0.", "x" * 5000, "é ü 中文 😀 <|endoftext|> it's"]
    texts += [prose(10 + i, 120) for i in range(12)] + ["THE!! " * 40, "%%% a&&& " * 30]
    found = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return found + [found[5], (None, prose(6, 50), None, None, None), (None, None, "de", "src0", 3)]


def _write(spark, base, docs, labels, pages, extra=False):
    frames = {"documents": spark.createDataFrame(docs, DOC), "labels": spark.createDataFrame(labels, LABEL), "pages": spark.createDataFrame(pages, PAGE)}
    for name, frame in frames.items():
        if extra:
            for column in ("id", "block", "n", "fp", "score", "word", "_w", "group", "path", "keys", "row", "n_words", "n_removed", "kept", "document", "_row", "_text", "_c1", "size", "sketch"):
                if column not in frame.columns:
                    frame = frame.selectExpr("*", f"'clash' AS `{column}`")
        frame.write.parquet(f"{base}/{name}.parquet")
    return str(base)


@pytest.fixture(scope="session")
def corpora(spark, tmp_path_factory):
    """Folders of an empty corpus, one of hard cases, and the latter with more columns."""
    docs = rows()
    labels = [(i, int(i < 24), 0) for i in range(28)] + [(3, 0, 0), (None, 1, 0)]
    page = '<!DOCTYPE html><html lang="en"><head><style>p{}</style></head><body><p>%s</p></body></html>'
    pages = [(0, "http://a.example.com/en/1", page % prose(7, 200)), (1, None, None), (2, "nonsense", ""), (None, "https://b.example.de/x", page % "the"), (0, "http://a.example.com/en/1", page % prose(7, 200))]
    make = tmp_path_factory.mktemp
    return {"empty": _write(spark, make("empty"), [], [], []), "hard": _write(spark, make("hard"), docs, labels, pages), "extra": _write(spark, make("extra"), docs, labels, pages, True)}
