"""Tokens of Rust source: one small scanner for each text, run by tasks over files."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What separates tokens (in UTF-8) and how tokens are written. Compound punctuation is a token for each character.
_SPACE = rb"(?:[\t\n\x0b\x0c\r ]|\xc2\x85|\xe2\x80[\x8e\x8f\xa8\xa9])"
_ID = rb"[A-Za-z_\x80-\xff][0-9A-Za-z_\x80-\xff]*+"
_TOKEN = re.compile(
    rb"(?P<space>" + _SPACE + rb"++)|(?P<comment>//[^\n]*+)|(?P<open>/\*)|(?P<raw>(?:r|br|cr)(?P<hashes>\#*+)\")|(?P<rawid>r\#" + _ID + rb")"
    rb"|(?P<string>[bc]?\"(?:[^\"\\]|\\[\s\S])*+\"(?:" + _ID + rb")?)|(?P<char>b?'(?:\\(?:u\{[^}']*\}|x[^']{2}|[^u])|[^'\\\x80-\xff]|[\xc0-\xff][\x80-\xbf]++)'(?:" + _ID + rb")?)|(?P<lifetime>'" + _ID + rb")"
    rb"|(?P<number>(?:0[xX][0-9a-fA-F_]++|0[bo][0-9_]++|[0-9][0-9_]*+(?:\.(?![.A-Za-z_\x80-\xff])(?:[0-9][0-9_]*+)?)?(?:[eE][+-]?_*[0-9][0-9_]*+)?)(?:" + _ID + rb")?)"
    rb"|(?P<ident>" + _ID + rb")|(?P<bad>b?['\"])|(?P<punct>[\x00-\x7f])"
)
_COMMENT = re.compile(rb"/\*|\*/")
_BLANK = re.compile(_SPACE + rb"*+")
_BREAK = re.compile(rb"\n")
NAMED = ("ident", "lifetime", "punct")


def scan(text: bytes) -> Iterator[tuple[str, int, int]]:
    """(kind, start, stop) of all tokens; kind: space, comment, string, char, lifetime, number, ident, punct or error.

    A comment, string or raw string that doesn't end is an error up to the end of the text, as is a lone quote.
    """
    at, size = 0, len(text)
    while at < size:
        m = _TOKEN.match(text, at)
        kind, stop = (m.lastgroup, m.end()) if m else ("error", at + 1)
        if kind == "open":
            kind, depth, stop = "error", 0, size
            for n in _COMMENT.finditer(text, at):
                depth += 1 if n[0] == b"/*" else -1
                if not depth:
                    kind, stop = "comment", n.end()
                    break
        elif m and m["raw"] is not None:
            end = text.find(b'"' + m["hashes"], m.end())
            kind, stop = ("string", end + 1 + len(m["hashes"])) if end >= 0 else ("error", size)
        elif kind == "rawid":
            kind = "ident"
        elif kind == "bad":
            kind, stop = "error", size
        yield kind, at, stop
        at = stop


def _rows(text: bytes) -> Iterator[tuple]:
    """(seq, kind, word, start, stop, line, lines) of the tokens that are code; lines: those on which it has more than white space."""
    ends = [m.start() for m in _BREAK.finditer(text)]
    seq = 0
    for kind, start, stop in scan(text):
        if kind in ("space", "comment"):
            continue
        first, last = bisect_right(ends, start - 1), bisect_right(ends, stop - 1)
        lines = [first]
        if last > first:
            bounds = [start, *(e + 1 for e in ends[first:last]), stop]
            lines = [first + i for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if a < b and _BLANK.match(text, a, b).end() < b]
        word = text[start:stop].decode("utf-8", "replace") if kind in NAMED else None
        if kind == "ident" and word is not None:
            word = word.removeprefix("r#")
            kind = "ident" if word.isidentifier() else "error"
        yield seq, kind, word, start, stop, first, lines
        seq += 1


_NAMES = ("seq", "kind", "word", "start", "stop", "line", "lines")
_TYPES = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
#: Tokens of a batch: a file may have hundreds of thousands, and many small files share one.
BATCH = 50_000


def tokens(files: DataFrame, id: str = "file_id", text: str = "text") -> DataFrame:
    """(id, seq, kind, word, start, stop, line, lines) of the code tokens of every file, comments and white space left out.

    seq counts from 0; start and stop are bytes of UTF-8; lines count from 0. word is the text of identifiers (raw ones without
    r#), lifetimes and punctuation. A null text has no tokens. Files are dealt by id first: a small table is one split, but its texts are
    many times its size. They are dealt to a fixed number of tasks, as a megabyte of texts gives many megabytes of tokens.
    """
    kind = files.schema[id].dataType.simpleString()

    def batch(ids: pa.Array, found: list[tuple]) -> pa.RecordBatch:
        of, *columns = zip(*found, strict=True)
        own = ids.take(pa.array(of, pa.int32()))
        return pa.RecordBatch.from_arrays([own, *(pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True))], names=[id, *_NAMES])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, texts, found = part.column(0), part.column(1), []
            for row in range(part.num_rows):
                for token in _rows((texts[row].as_py() or "").encode()):
                    found.append((row, *token))
                    if len(found) == BATCH:
                        yield batch(ids, found)
                        found = []
            if found:
                yield batch(ids, found)

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number that is named isn't lowered by the size of the texts
    dealt = files.select(id, F.col(text).cast("string")).repartition(parts, F.col(id))
    return dealt.mapInArrow(run, f"`{id}` {kind}, seq bigint, kind string, word string, start bigint, stop bigint, line bigint, lines array<bigint>")
