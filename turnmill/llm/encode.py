"""Encoding of a corpus with a public byte-level BPE tokenizer, and back.

A text is cut into the tokenizer's pre-tokens, and those at byte pairs that no
vocabulary entry contains: no merge can cross such a pair, so the pieces encode
alone to the same ids.  Pieces repeat, within and across texts, and a worker
encodes each one once: new pieces of whatever length go, a batch at a time, to
one DuckDB recursive query whose token-position rows join the merge table; every
step contracts each piece's leftmost pair of minimum rank until none is left.
Decoding joins the ids to their bytes and aggregates these in order.

Defined results: NULL and empty texts have no ids; special-token strings are
ordinary text; lone surrogates cannot occur in Spark strings; texts of any
length are encoded whole.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; a parameter of every public function here.
TOKENIZERS = os.environ.get("TURNMILL_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"
#: Pre-tokens remembered by a worker; the memory is emptied when full, which costs time only.
MEMORY = 400_000
#: Fixed value: the pre-token pattern of the public byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

# A piece's rows are keyed by their position, so the recursion keeps one row a position however many steps it takes.
# Every step contracts the pair of minimum rank: all its occurrences, leftmost first where they overlap.
_CONTRACT = """
WITH RECURSIVE step(piece, pos, token) USING KEY (piece, pos) AS (
  SELECT piece, pos, token FROM new_rows
  UNION ALL
  SELECT piece, pos, CASE WHEN kept THEN merged WHEN lag(kept) OVER (PARTITION BY piece ORDER BY pos) THEN NULL ELSE token END
  FROM (
    SELECT piece, pos, token, merged, hit AND row_number() OVER (PARTITION BY piece, hit, run ORDER BY pos) % 2 = 1 AS kept
    FROM (
      SELECT piece, pos, token, merged, hit, k - sum(hit::INT) OVER (PARTITION BY piece ORDER BY pos) AS run
      FROM (
        SELECT piece, pos, token, merged, k, min(merged) OVER (PARTITION BY piece) AS best, coalesce(merged = best, false) AS hit
        FROM (
          SELECT piece, pos, token, lead(token) OVER w AS next, row_number() OVER w AS k
          FROM step WHERE token IS NOT NULL WINDOW w AS (PARTITION BY piece ORDER BY pos)) p
        LEFT JOIN merges m ON m.a = p.token AND m.b = p.next)
      WHERE best IS NOT NULL)))
SELECT piece, list(token ORDER BY pos) FILTER (token IS NOT NULL) AS tokens FROM step GROUP BY piece
"""
# Hexadecimal, since only strings can be joined in order.
_DECODE = """
SELECT i.doc, from_hex(string_agg(b.bytes, '' ORDER BY i.pos)) AS bytes FROM id_rows i JOIN token_bytes b ON b.token = i.token GROUP BY i.doc
"""


class _Numbered(dict):
    """Words by number of first sight; the new ones wait in ``new``."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class Vocabulary:
    """The ranks of a ``.tiktoken`` file, its merge table and its uncrossable byte pairs."""

    def __init__(self, folder: str, name: str):
        with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines)}
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        inside = {t[i : i + 2] for t in self.ranks for i in range(len(t) - 1)}
        self.crossable = [[bytes([a, b]) in inside for b in range(256)] for a in range(256)]
        self.pattern = regex.compile(PATTERN)
        self.forget()
        self.pieces: dict[bytes, tuple[int, ...]] = {}
        self._db = None
        self._decodes = False

    def merges(self) -> list[tuple[int, int, int]]:
        """Every pair of tokens that makes a token: ``(a, b, merged)``; the merged id is the rank."""
        ranks = self.ranks
        return [
            (ranks[t[:i]], ranks[t[i:]], r)
            for t, r in ranks.items()
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        ]

    def cut(self, word: bytes) -> list[bytes]:
        """The word cut at the byte pairs that no token contains."""
        crossable, out, start = self.crossable, [], 0
        for i in range(1, len(word)):
            if not crossable[word[i - 1]][word[i]]:
                out.append(word[start:i])
                start = i
        out.append(word[start:])
        return out

    def db(self):
        if self._db is None:
            import duckdb

            self._db = duckdb.connect(config={"threads": 1})
            a, b, m = zip(*self.merges())
            self._db.register("merge_rows", pa.table({"a": a, "b": b, "merged": m}))
            self._db.execute("CREATE TABLE merges AS SELECT a::INT AS a, b::INT AS b, merged::INT AS merged FROM merge_rows")
        return self._db

    def contract(self, pieces: list[bytes]) -> None:
        """Encode new pieces, of any length, by the recursive query and remember their ids."""
        if not pieces:
            return
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        piece = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        pos = np.arange(len(piece)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        token = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        db = self.db()
        db.register("new_rows", pa.table({"piece": piece, "pos": pos.astype(np.int32), "token": token}))
        got = db.sql(_CONTRACT).to_arrow_table()
        db.unregister("new_rows")
        for k, ids in zip(got["piece"].to_pylist(), got["tokens"].to_pylist()):
            self.pieces[pieces[k]] = tuple(ids)

    def decode(self, ids: list[list[int] | None]) -> list[str | None]:
        """The texts of lists of ids: their bytes joined in order, read as UTF-8."""
        db = self.db()
        if not self._decodes:
            db.register("ranked", pa.table({"token": list(self.ranks.values()), "bytes": [t.hex() for t in self.ranks]}))
            db.execute("CREATE TABLE token_bytes AS SELECT token::INT AS token, bytes FROM ranked")
            db.unregister("ranked")
            self._decodes = True
        sizes = np.array([len(x) if x else 0 for x in ids], np.int64)
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        pos = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        token = np.fromiter(chain.from_iterable(x for x in ids if x), np.int32, len(doc))
        if unknown := set(token.tolist()) - set(self.ranks.values()):
            raise ValueError(f"ids outside the vocabulary: {sorted(unknown)[:5]}")
        db.register("id_rows", pa.table({"doc": doc, "pos": pos.astype(np.int32), "token": token}))
        got = db.sql(_DECODE).to_arrow_table()
        db.unregister("id_rows")
        out: list[str | None] = [None if x is None else "" for x in ids]
        for k, raw in zip(got["doc"].to_pylist(), got["bytes"].to_pylist()):
            out[k] = raw.decode("utf-8", "replace")
        return out

    def forget(self) -> None:
        self.words = _Numbered()
        self.flat = np.zeros(1 << 16, np.int32)  # the ids of all words, end to end
        self.starts = np.zeros(1 << 12, np.int64)  # where those of each word begin
        self.used = 0

    def learn(self, words: list[str], first: int) -> None:
        """Encode new words, numbered from ``first`` on."""
        cut, pieces = self.cut, self.pieces
        parts = [cut(w.encode()) for w in words]
        self.contract([p for p in dict.fromkeys(chain.from_iterable(parts)) if p not in pieces])
        ids = [list(chain.from_iterable([pieces[p] for p in ps])) for ps in parts]
        ends = self.used + np.cumsum([len(x) for x in ids])
        if ends[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(int(ends[-1]), np.int32)])
        if first + len(words) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(first + len(words) + 1, np.int64)])
        self.flat[self.used : ends[-1]] = list(chain.from_iterable(ids))
        self.starts[first + 1 : first + 1 + len(words)] = ends
        self.used = int(ends[-1])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, and the offsets at which they begin and end."""
        if len(self.words) > MEMORY:
            self.forget()
        if len(self.pieces) > MEMORY:
            self.pieces.clear()
        words, find = self.words, self.pattern.findall
        split = [find(t) if t else () for t in texts]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in split])]).astype(np.int64)
        first = len(words)
        number = np.fromiter(map(words.__getitem__, chain.from_iterable(split)), np.int64, int(bounds[-1]))
        if words.new:
            self.learn(words.new, first)
            words.new = []
        begin = self.starts[number]
        ends = np.concatenate([[0], np.cumsum(self.starts[number + 1] - begin)])
        spread = np.repeat(begin - ends[:-1], np.diff(ends)) + np.arange(ends[-1])
        return self.flat[spread], ends[bounds]


@cache
def vocabulary(folder: str, name: str) -> Vocabulary:
    return Vocabulary(folder, name)


def encode_corpus(df: DataFrame, key: str, text: str, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """``(key, ids)`` of every row; the vocabulary file must lie in ``folder`` on every executor."""
    from pyspark.sql.pandas.types import to_arrow_type

    key_type = df.schema[key].dataType
    arrow_key = to_arrow_type(key_type)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(folder, name)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                ids, ends = v.encode(some.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([some.column(0).cast(arrow_key), lists], ["key", "ids"])

    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(work, f"key {key_type.simpleString()}, ids array<int>").withColumnRenamed("key", key)


def decode_corpus(df: DataFrame, key: str, ids: str, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """``(key, text)`` of every row: the bytes of its ids in order, read as UTF-8; an empty text for no ids, NULL for NULL."""
    from pyspark.sql.pandas.types import to_arrow_type

    key_type = df.schema[key].dataType
    arrow_key = to_arrow_type(key_type)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(folder, name)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                texts = v.decode(some.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0).cast(arrow_key), pa.array(texts, pa.string())], ["key", "text"])

    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{ids}`").alias("ids"))
    return rows.mapInArrow(work, f"key {key_type.simpleString()}, text string").withColumnRenamed("key", key)
