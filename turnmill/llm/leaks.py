"""Evaluation passages leaking into a training corpus.

Documents and passages are reduced to their letters, digits and ideographs in
lower case, look-alikes, marks, width and spacing removed.  Windows about as
long as the least leak (12 words or 24 ideographs) are fingerprinted: SimHash of
their shingles of ``GRAM`` characters, 64 bits.  Passage windows start at every
character, document windows at every ``STRIDE``-th; as a window is at least
``STRIDE - 1`` characters shorter than any leak, every leak holds a document
window that equals a passage window.  Multi-index Hamming lookup (``RADIUS + 1``
bands, of which one must agree) finds every pair of fingerprints within
``RADIUS``; the weighted-shingle similarity of the two windows verifies it, and
the run of equal characters around a verified pair is measured exactly.

Passages are a stated query set: they are taken in blocks of at most ``BLOCK``
rows and ``BLOCK_CHARACTERS`` characters (a longer passage is a block of its own),
each block against all documents, so what a task holds is bounded.

Defined results: documents or passages without text give no row; repeated rows
count once; whole texts are searched, however long.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.llm.forms import LOOKALIKES

LEAST_WORDS = 12
LEAST_CHARACTERS = 24
GRAM = 4
STRIDE = 5
RADIUS = 3
SIMILARITY = 0.8
BLOCK, BLOCK_CHARACTERS = 2000, 4_000_000
CHUNK = 1 << 15

SILENT, BREAK, MANY = 0, 1, 2  # character values that are no letters


@cache
def folding() -> np.ndarray:
    """For every code point its folded letter, or ``SILENT``, ``BREAK`` or ``MANY`` (folds to several)."""
    table = np.full(0x110000, BREAK, np.uint32)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000 or 0x30000 <= c < 0xE0000 or c > 0xE01EF:
            continue
        if 0x3400 <= c < 0xA000 or 0xAC00 <= c < 0xD7A4 or 0x20000 <= c < 0x2F800:
            table[c] = c
            continue
        ch = chr(c)
        category = unicodedata.category(ch)
        if category == "Cn":
            continue
        if ch in "'’ʼ" or category in ("Cf", "Mn", "Me", "Mc"):
            table[c] = SILENT
            continue
        plain = [x for x in unicodedata.normalize("NFKD", ch) if unicodedata.category(x)[0] != "M"]
        low = [LOOKALIKES.get(y, y).lower() for x in plain for y in LOOKALIKES.get(x, x).lower()]
        if len(low) == 1 and low[0].isalnum():
            table[c] = ord(low[0])
        elif any(x.isalnum() for x in low):
            table[c] = MANY
    return table


def _unfold(text: str) -> str:
    """The text with characters that fold to several letters written out."""
    table = folding()
    return "".join(unicodedata.normalize("NFKD", ch) if table[ord(ch)] == MANY else ch for ch in text)


@dataclass
class Letters:
    """Texts end to end: folded letters, where words begin, and where each text begins."""

    codes: np.ndarray
    begins: np.ndarray  # whether something stood between a letter and the letter before it
    starts: np.ndarray  # of each text, and the end of the last


def letters(texts: list[str]) -> Letters:
    def values(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        return raw, folding()[raw]

    _, value = values(texts)
    many = np.flatnonzero(value == MANY)
    if len(many):
        texts = list(texts)
        for i in set(np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), many, "right").tolist()):
            texts[i] = _unfold(texts[i])
        _, value = values(texts)
        value = np.where(value == MANY, BREAK, value)
    is_letter = value > MANY
    breaks = np.cumsum(value == BREAK)[is_letter]
    begins = np.ones(len(breaks), bool)
    begins[1:] = breaks[1:] != breaks[:-1]
    ends = np.cumsum([len(t) + 1 for t in texts])
    upto = np.concatenate([[0], np.cumsum(is_letter)])
    starts = upto[np.concatenate([[0], np.minimum(ends, len(value))]).astype(np.int64)]
    return Letters(value[is_letter], begins, starts)


def grams(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` characters that begin at each place."""
    n = len(codes) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n].astype(np.uint64) + np.uint64(1)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _fingerprints(sums: np.ndarray, n: int) -> np.ndarray:
    return np.packbits(sums > n // 2, axis=1).view(np.uint64).ravel()


def simhash_all(codes: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of the windows of ``size`` shingles that begin at every place."""
    bits = np.unpackbits(grams(codes).view(np.uint8).reshape(-1, 8), axis=1)
    if len(bits) < size:
        return np.zeros(0, np.uint64)
    total = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    return _fingerprints(total[size:] - total[:-size], size)


@dataclass
class Index:
    """The windows of one kind of passage (English or Chinese) under multi-index lookup."""

    units: int  # the window's length in strides of shingles
    prints: np.ndarray
    places: np.ndarray
    tables: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def build(self) -> None:
        bits = 64 // (RADIUS + 1)
        for band in range(RADIUS + 1):
            key = ((self.prints >> np.uint64(band * bits)) & np.uint64((1 << bits) - 1)).astype(np.int64)
            order = np.argsort(key, kind="stable")
            offsets = np.searchsorted(key[order], np.arange((1 << bits) + 1))
            self.tables.append((order, offsets))

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs ``(row of prints, row of the index)`` at most ``RADIUS`` bits apart."""
        bits = 64 // (RADIUS + 1)
        found = []
        for band, (order, offsets) in enumerate(self.tables):
            key = ((prints >> np.uint64(band * bits)) & np.uint64((1 << bits) - 1)).astype(np.int64)
            begin = offsets[key]
            count = offsets[key + 1] - begin
            some = np.flatnonzero(count)
            count = count[some]
            left = np.repeat(some, count)
            inside = np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count)
            right = order[np.repeat(begin[some], count) + inside]
            near = np.bitwise_count(prints[left] ^ self.prints[right]) <= RADIUS
            found.append(np.stack([left[near], right[near]], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pairs[:, 0], pairs[:, 1]


class Passages:
    """A block of passages, ready to be searched for."""

    def __init__(self, rows: list[tuple[int, str | None, str | None]]):
        rows = [r for r in rows if r[1]]
        self.ids = [r[0] for r in rows]
        self.letters = letters([r[1] for r in rows])
        self.chinese = [self._is_chinese(i, r[2]) for i, r in enumerate(rows)]
        self.word_at = np.cumsum(self.letters.begins) - 1
        self.indexes = [x for x in (self._index(True), self._index(False)) if x is not None]
        shingles, counts = np.unique(grams(self.letters.codes), return_counts=True)
        self.shingles, self.weights = shingles, 1.0 + np.log(counts.sum() / counts) if len(counts) else counts

    def span(self, i: int) -> tuple[int, int]:
        return int(self.letters.starts[i]), int(self.letters.starts[i + 1])

    def _is_chinese(self, i: int, lang: str | None) -> bool:
        if lang and lang.lower()[:2] in ("zh", "en"):
            return lang.lower().startswith("zh")
        a, b = self.span(i)
        return bool(b > a and (self.letters.codes[a:b] >= 0x3400).mean() > 0.5)

    def _index(self, chinese: bool) -> Index | None:
        spans = [self.span(i) for i in range(len(self.ids)) if self.chinese[i] == chinese]
        least = LEAST_CHARACTERS
        if not chinese:
            sizes = []
            for a, b in spans:
                heads = np.append(np.flatnonzero(self.letters.begins[a:b]), b - a)
                sizes += list(heads[LEAST_WORDS:] - heads[:-LEAST_WORDS])
            if not sizes:
                return None
            least = int(min(sizes))
        units = (least - GRAM + 1 - (STRIDE - 1)) // STRIDE
        if units < 1:
            raise ValueError(f"a least leak of {least} characters is too short for shingles of {GRAM} and strides of {STRIDE}")
        prints = [simhash_all(self.letters.codes[a:b], units * STRIDE) for a, b in spans]
        if not sum(map(len, prints)):
            return None
        places = [a + np.arange(len(p)) for (a, _), p in zip(spans, prints)]
        index = Index(units, np.concatenate(prints), np.concatenate(places))
        index.build()
        return index

    def weight(self, shingle: np.ndarray) -> np.ndarray:
        """Inverse frequency among the passages; the highest for shingles that none has."""
        at = np.minimum(np.searchsorted(self.shingles, shingle), len(self.shingles) - 1)
        return np.where(self.shingles[at] == shingle, self.weights[at], self.weights.max())

    def _verified(self, text: Letters, index: Index, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the two windows' weighted shingles, each at its place, are similar enough."""
        offsets = np.arange(index.units * STRIDE)
        all_text, all_own = grams(text.codes), grams(self.letters.codes)
        keep = np.zeros(len(left), bool)
        for at in range(0, len(left), 4096):
            a = all_text[left[at : at + 4096, None] + offsets]
            b = all_own[right[at : at + 4096, None] + offsets]
            wa, same = self.weight(a), a == b
            both = (wa * same).sum(1)
            keep[at : at + 4096] = both >= SIMILARITY * (wa.sum(1) + self.weight(b).sum(1) - both)
        return keep

    def search(self, texts: list[str]) -> list[tuple[int, int]]:
        """``(row of texts, item id)`` of every leak."""
        if not self.indexes or not texts:
            return []
        text = letters(texts)
        n = len(text.codes) - GRAM + 1
        out: set[tuple[int, int]] = set()
        if n <= 0:
            return []
        for index in self.indexes:
            lefts, rights = [], []
            for at in range(0, n, CHUNK * STRIDE):
                # strides of shingles: their bits are added once, windows are sums of neighbouring strides
                upto = min(n, at + (CHUNK + index.units) * STRIDE)
                g = grams(text.codes[at : upto + GRAM - 1])
                m = len(g) // STRIDE
                if m < index.units:
                    continue
                bits = np.unpackbits(g[: m * STRIDE].view(np.uint8).reshape(-1, 8), axis=1).reshape(m, STRIDE, 64)
                strides = bits[:, 0].copy()
                for k in range(1, STRIDE):
                    strides += bits[:, k]
                windows = strides[: m - index.units + 1].astype(np.uint8 if index.units * STRIDE < 256 else np.uint16)
                for k in range(1, index.units):
                    windows += strides[k : m - index.units + 1 + k]
                prints = _fingerprints(windows, index.units * STRIDE)
                left, right = index.within(prints)
                lefts.append(at + left * STRIDE)
                rights.append(index.places[right])
            if not lefts:
                continue
            left, right = np.concatenate(lefts), np.concatenate(rights)
            ok = self._verified(text, index, left, right)
            left, right = left[ok], right[ok]
            row = np.searchsorted(text.starts, left, "right") - 1
            item = np.searchsorted(self.letters.starts, right, "right") - 1
            # pairs on one diagonal of a document and a passage belong to one alignment
            first = np.unique(np.stack([row, item, left - right], axis=1), axis=0) if len(row) else np.zeros((0, 3), int)
            for r, i, shift in first.tolist():
                if (r, self.ids[i]) not in out and self._leaks(text, r, i, shift):
                    out.add((r, self.ids[i]))
        return sorted(out)

    def _leaks(self, text: Letters, row: int, item: int, shift: int) -> bool:
        """Whether the texts agree along the alignment for as long as a leak."""
        a, b = self.span(item)
        lo = max(a, int(text.starts[row]) - shift)
        hi = min(b, int(text.starts[row + 1]) - shift)
        if hi <= lo:
            return False
        same = np.concatenate([[False], self.letters.codes[lo:hi] == text.codes[lo + shift : hi + shift], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(lo + edges[::2], lo + edges[1::2]):
            if self.chinese[item]:
                if e - s >= LEAST_CHARACTERS:
                    return True
                continue
            # whole words of the passage, whose outer ends are word ends of the document too
            places = np.arange(s, e + 1)
            own = np.append(self.letters.begins, True)[places] | (places == b)
            there = places + shift
            other = np.append(text.begins, True)[there] | (there == text.starts[row + 1])
            ends = places[own & other]
            if len(ends) > 1 and self.word_at[ends[-1] - 1] - self.word_at[ends[0]] + 1 >= LEAST_WORDS:
                return True
        return False


def _blocks(rows: list[tuple]) -> Iterator[list[tuple]]:
    """The rows in blocks that keep both bounds."""
    block: list[tuple] = []
    size = 0
    for row in rows:
        if block and (len(block) == BLOCK or size + len(row[1]) > BLOCK_CHARACTERS):
            yield block
            block, size = [], 0
        block.append(row)
        size += len(row[1])
    yield block


def find_leaks(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """``(doc_id, item_id)`` of every document and each passage of which it contains a leak."""
    spark = documents.sparkSession
    items = passages.select(F.col("item_id").cast("bigint"), "text", "lang").where("text is not null").distinct()
    n, characters = items.agg(F.count("*"), F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()
    hashed = max(1, -(-n // (BLOCK // 2)), -(-characters // (BLOCK_CHARACTERS // 2)))
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null and text != ''")
    out = None
    # one hashed share of the passages at a time comes to the driver, and is cut where it is over a bound
    shares = ([tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(hashed)) == share).collect()] for share in range(hashed))
    for some in (block for share in shares for block in _blocks(share)):
        shared = spark.sparkContext.broadcast(some)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            found = Passages(shared.value)
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    ids = part.column(0).to_pylist()
                    hits = found.search(part.column(1).to_pylist())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[r] for r, _ in hits], pa.int64()), pa.array([i for _, i in hits], pa.int64())], ["doc_id", "item_id"]
                    )

        found = rows.mapInArrow(work, "doc_id bigint, item_id bigint")
        out = found if out is None else out.unionByName(found)
    return out.distinct()
