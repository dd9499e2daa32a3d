"""A skip-chain conditional random field over batches of texts, in arrays.

Tokens are words, numbers, single ideographs and signs.  A token's features are
64-bit keys made of the hashes of the tokens around it, its shape, its ending,
family names near it and the formats that cover it; a trained feature is found by
its whole key, so that unseen ones weigh nothing.  The chain has a transition
weight for each pair of labels.  Skip edges tie tokens of a text that repeat
(``SAME``, or ``PAIR`` for ideographs) or resemble (``ALIKE``) each other; for each kind of edge and each label
of a value there is a weight for both ends having it, learned with the rest.

Inference is max-product: exact along the chain, loopy over the skip edges, with
damped messages, until they stand still or ``ROUNDS`` have passed, after which the
labels are those of the last beliefs.  A token is passed over only if no label but
"none" can be the best one there (:meth:`Field.possible`).
"""

from __future__ import annotations

import re
from hashlib import blake2b
from collections.abc import Callable

import numpy as np

#: The most rounds of message passing on a text.
ROUNDS = 60
#: Rounds without damping, and the damping after them.
UNDAMPED, DAMPING = 8, 0.5
SAME, ALIKE, PAIR = 0, 1, 2
#: By how much the right label of a token must lead in training.
MARGIN = 12.0
SPACE, LETTER, DIGIT, HAN, SIGN = range(5)
_SLOT_BITS = 20
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


def word_hash(word: str) -> int:
    """The hash of a lower-cased token, as :class:`Batch` has it."""
    codes = np.array([ord(c) for c in word.lower()], _U)
    return int(_mix(((codes + _U(1)) * _U(0x9E3779B97F4A7C15) * _POWER[: len(codes)]).sum(dtype=_U)[None])[0])


_POWER = np.cumprod(np.full(4096, 0xD1342543DE82EF95, _U))
_SALT = {}


def _salt(name: str) -> np.uint64:
    if name not in _SALT:
        _SALT[name] = _U(int.from_bytes(blake2b(name.encode(), digest_size=8).digest(), "little"))
    return _SALT[name]


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind = np.full(0x110000, SIGN, np.uint8)
    low = np.arange(0x110000, dtype=np.uint32)
    upper = np.zeros(0x110000, bool)
    for c in range(0x250):
        ch = chr(c)
        if ch.isspace():
            kind[c] = SPACE
        elif ch.isalpha() and (c < 0x80 or c >= 0xC0):
            kind[c] = LETTER
            upper[c] = ch.isupper()
            if len(ch.lower()) == 1:
                low[c] = ord(ch.lower())
    kind[ord("0") : ord("9") + 1] = DIGIT
    kind[0x3400:0xA000] = HAN
    for c in (0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        kind[c] = SPACE
    return kind, low, upper


_KIND, _LOW, _UPPER = _tables()


class Lexicon:
    """What the features know beforehand: words by class, characters of family names, formats with what a text must have for each.

    A format's need is a function of ``has`` (how many tokens of each text are of a class) and of the digits of each text.
    ``quiet`` classes only serve such needs, words of ``untied`` classes have no skip edges.
    """

    def __init__(self, classes: dict[str, list[str]], surnames: str, compounds: list[str], formats: dict[str, tuple[re.Pattern, Callable]], quiet: dict[str, list[str]], untied: tuple[str, ...] = ()):
        self.bit = {name: np.uint32(1 << i) for i, name in enumerate([*classes, *quiet])}
        self.classes, self.untied, self.formats = list(classes), untied, formats
        of: dict[int, int] = {}
        for name, words in [*classes.items(), *quiet.items()]:
            for w in words:
                of[word_hash(w)] = of.get(word_hash(w), 0) | int(self.bit[name])
        self._words, self._bits = np.zeros(1 << 20, _U), np.zeros(1 << 20, np.uint32)
        for h, bits in of.items():
            if self._words[h >> 44]:
                raise ValueError("two words of the classes fall into one slot")
            self._words[h >> 44], self._bits[h >> 44] = h, bits
        self.surname = np.zeros(0x110000, bool)
        self.surname[[ord(c) for c in surnames]] = True
        self.first = np.zeros(0x110000, bool)
        self.first[[ord(c[0]) for c in compounds]] = True
        self.compound = np.sort(np.array([ord(a) << 21 | ord(b) for a, b in compounds], np.int64))

    def bits(self, words: np.ndarray) -> np.ndarray:
        """The classes of each word, as bits."""
        slot = (words >> _U(44)).astype(np.int64)
        return np.where(self._words[slot] == words, self._bits[slot], np.uint32(0))


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


class Batch:
    """The tokens of plain texts, and their features."""

    def __init__(self, texts: list[str], lexicon: Lexicon):
        self.texts, self.lexicon = texts, lexicon
        codes = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_start = np.concatenate([[0], np.cumsum(sizes + 1)])
        kind, low = _KIND[codes], _LOW[codes]
        letter = kind == LETTER
        if len(codes) > 2:  # an apostrophe between letters belongs to the word
            inner = np.zeros(len(codes), bool)
            inner[1:-1] = ((codes[1:-1] == 0x27) | (codes[1:-1] == 0x2019)) & letter[:-2] & letter[2:]
            kind = np.where(inner, LETTER, kind)
        before = np.concatenate([[SPACE], kind[:-1]]) if len(kind) else kind
        start = (kind != SPACE) & ((kind != before) | (kind >= HAN))
        self.start = np.flatnonzero(start)
        n = len(self.start)
        number = np.cumsum(start) - 1
        inside = kind != SPACE
        self.size = np.bincount(number[inside], minlength=n).astype(np.int64) if n else np.zeros(0, np.int64)
        self.end = self.start + self.size
        self.kind = kind[self.start]
        place = np.minimum(np.arange(len(codes)) - self.start[np.maximum(number, 0)] if n else np.zeros(0, int), len(_POWER) - 1)
        self.word = _mix(np.add.reduceat(np.where(inside, (low.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15) * _POWER[place], _U(0)), self.start)) if n else np.zeros(0, _U)
        self.bits = lexicon.bits(self.word)
        self.code = low[self.start].astype(np.int64)
        self.row = np.searchsorted(self.text_start, self.start, "right") - 1
        bounds = np.searchsorted(self.row, np.arange(len(texts) + 1))
        self.row_start, self.row_size = bounds[:-1], np.diff(bounds)
        upper = _UPPER[codes]
        first = upper[self.start]
        capitals = np.add.reduceat((upper & inside).astype(np.int64), self.start) if n else np.zeros(0, np.int64)
        shape = self.code + 100  # a sign is its own shape
        word = self.kind == LETTER
        shape[word] = np.select([(first & (capitals == 1) & (self.size > 1))[word], (first & (self.size == 1))[word], ((capitals == self.size) & (self.size > 1))[word], (capitals == 0)[word]], [1, 2, 3, 4], 5)
        digits = self.kind == DIGIT
        shape[digits] = 10 + np.searchsorted([2, 3, 4, 5, 8, 12, 18, 19], self.size[digits], "right")
        shape[self.kind == HAN] = 30
        self.shape, self.capital = shape, word & first
        # whether nothing stands between a token and the one before and after it
        joined = np.concatenate([[False], self.end[:-1] == self.start[1:]]) if n else np.zeros(0, bool)
        self.joined = joined.astype(np.int64) + 2 * np.concatenate([joined[1:], [False]]) if n else np.zeros(0, np.int64)
        tail = np.zeros(n, _U)
        for k in (1, 2, 3):
            tail = tail * _U(0x110001) + np.where(self.size >= k, low[np.maximum(self.end - k, 0)], 0).astype(_U) + _U(1)
        self.tail = tail

    def __len__(self) -> int:
        return len(self.start)

    def near(self, values: np.ndarray, by: int, outside) -> np.ndarray:
        """For every token the value of the token ``by`` places on, or ``outside`` the text."""
        out = np.full(len(values), outside, values.dtype)
        if by == 0:
            return values
        if abs(by) < len(values):
            a, b = (slice(None, -by), slice(by, None)) if by > 0 else (slice(-by, None), slice(None, by))
            same = self.row[a] == self.row[b]
            out[a][same] = values[b][same]
        return out

    def covers(self) -> tuple[np.ndarray, np.ndarray]:
        """``(token, format)`` of all tokens that a format covers; the first token of a match has an odd format number."""
        tokens, formats = [], []
        n_rows = len(self.texts)
        digits = np.bincount(self.row, np.where(self.kind == DIGIT, self.size, 0), n_rows)

        def has(name: str) -> np.ndarray:
            return np.bincount(self.row, self.bits & self.lexicon.bit[name] != 0, n_rows)

        for number, (pattern, needs) in enumerate(self.lexicon.formats.values()):
            for r in np.flatnonzero(needs(has, digits)):
                a, size = self.row_start[r], self.row_size[r]
                for m in pattern.finditer(self.texts[r]):
                    lo, hi = m.start() + self.text_start[r], m.end() + self.text_start[r]
                    i, j = a + np.searchsorted(self.start[a : a + size], [lo, hi])
                    if i < j:
                        tokens.append(np.arange(i, j))
                        f = np.full(j - i, 2 * number)
                        f[0] += 1
                        formats.append(f)
        if not tokens:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(tokens), np.concatenate(formats)

    def features(self):
        """The features by kind: ``(tokens or None for all, keys)``."""
        n = len(self)
        if not n:
            return
        out = _U(7)
        word, shape = self.word, self.shape.astype(_U)
        p1, p2, n1, n2 = (self.near(word, k, out) for k in (-1, -2, 1, 2))
        ps, ns = self.near(shape, -1, out), self.near(shape, 1, out)
        m1, m2, m3 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)

        def key(name, *values):
            k = _salt(name) + np.zeros(len(values[0]) if values else n, _U)
            for v, m in zip(values, (m1, m2, m3)):
                k = (k ^ (v * m)) * _U(0xD6E8FEB86659FD93)
            return _mix(k)

        yield None, key("s", shape, self.joined.astype(_U))
        yield None, key("p1", p1, shape)
        yield None, key("n1", n1, shape)
        yield None, key("ps ns", ps, ns, shape + (self.joined.astype(_U) << _U(24)))
        yield None, key("p2", p2, p1)
        yield None, key("n2", n1, n2)
        for name in self.lexicon.classes:
            at = np.flatnonzero(self.bits & self.lexicon.bit[name])
            yield at, key("class " + name, shape[at])
        latin = np.flatnonzero(self.kind == LETTER)
        if len(latin):
            yield latin, key("w", word[latin])
            begins = np.concatenate([[True], self.row[1:] != self.row[:-1]])
            stop = np.isin(self.code, [ord(c) for c in ".!?>:]}。！？：\n"]) & (self.kind == SIGN)
            before_stop = np.concatenate([[True], stop[:-1]])
            cap = self.shape[latin]
            first = (begins | before_stop)[latin].astype(_U) + _U(3) * cap.astype(_U)
            yield latin, key("first", first)
            yield latin, key("first w", first, word[latin])
            yield latin, key("first p1", first, p1[latin])
            yield latin, key("first n1", first, n1[latin])
            yield latin, key("pn", p1[latin], n1[latin])
            yield latin, key("tail", self.tail[latin], cap.astype(_U))
            t1 = self.near(self.tail, 1, out)[latin]
            yield latin, key("tail after", t1, cap.astype(_U), ns[latin])
            yield latin, key("tail p1", self.tail[latin], p1[latin])
        han = np.flatnonzero(self.kind == HAN)
        if len(han):
            yield han, key("h", word[han])
            yield han, key("h n", word[han], n1[han])
            yield han, key("h p", word[han], p1[han])
            yield han, key("h ahead", n1[han], n2[han], _U(1) + np.zeros(len(han), _U))
            code = self.code
            after = self.near(code, 1, 0)
            surname = (self.kind == HAN) & (self.lexicon.surname[code])
            begins_two = np.flatnonzero((self.kind == HAN) & self.lexicon.first[code])
            surname[begins_two[_among(code[begins_two] << 21 | after[begins_two], self.lexicon.compound)]] = True
            n3, n4, n5 = (self.near(word, k, out) for k in (3, 4, 5))
            ahead = [word, n1, n2, n3, n4, n5]
            for back in range(4):
                at = np.flatnonzero(surname)
                at = at[at + back < n]
                at = at[(self.row[at + back] == self.row[at]) & (self.kind[at + back] == HAN)]
                to = at + back
                b = _U(back) + np.zeros(len(at), _U)
                yield to, key("sur", b)
                yield to, key("sur p1", b, p1[at])
                yield to, key("sur p2", b, p1[at], p2[at])
                for k in (1, 2, 3):  # what follows a name of this many characters
                    if k + 1 < len(ahead):
                        yield to, key(f"sur n{k}", b, ahead[k + 0][at], ahead[k + 1][at])
                        yield to, key(f"sur pn{k}", b, p1[at], ahead[k + 0][at])
        digit = np.flatnonzero(self.kind == DIGIT)
        if len(digit):
            for back in range(1, 9):
                yield digit, key("near", self.near(word, -back, out)[digit])
        tokens, formats = self.covers()
        if len(tokens):
            yield tokens, key("f", formats.astype(_U))
            yield tokens, key("f s", formats.astype(_U), shape[tokens])

    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Skip edges ``(token, later token, SAME, ALIKE or PAIR)``: each of some tokens with the next that repeats or resembles it.

        Words with a capital and long numbers repeat if they are equal but for case, and resemble each other if their
        first five letters or last five digits are equal; so do two ideographs of which the first is a family name.
        """
        a, b, kinds = [], [], []
        plain = np.zeros(len(self), bool)
        for name in self.lexicon.untied:
            plain |= self.bits & self.lexicon.bit[name] != 0
        capital = np.flatnonzero(self.capital & (self.size > 2) & ~plain)
        number = np.flatnonzero((self.kind == DIGIT) & (self.size >= 5))
        after = self.near(self.code, 1, 0)
        han = np.flatnonzero((self.kind == HAN) & self.lexicon.surname[self.code] & (self.near(self.kind, 1, SPACE) == HAN))
        whole = np.concatenate([self.word[capital], self.word[number], _mix((self.code[han] << 21 | after[han]).astype(_U))])
        part = np.concatenate([self._piece(capital, 5, False), self._piece(number, 5, True), np.zeros(len(han), _U)])
        at = np.concatenate([capital, number, han])
        taken: set = set()
        for kind, keys, some in ((SAME, whole, np.arange(len(at))), (ALIKE, part, np.flatnonzero(part))):
            order = some[np.lexsort((at[some], keys[some], self.row[at[some]]))]
            if len(order) < 2:
                continue
            left, right = order[:-1], order[1:]
            ok = (keys[left] == keys[right]) & (self.row[at[left]] == self.row[at[right]]) & (at[right] - at[left] > 1)
            for i, j in zip(at[left[ok]].tolist(), at[right[ok]].tolist()):
                if (i, j) not in taken:
                    taken.add((i, j))
                    a.append(i)
                    b.append(j)
                    kinds.append(PAIR if self.kind[i] == HAN else kind)
        return np.array(a, np.int64), np.array(b, np.int64), np.array(kinds, np.int64)

    def _piece(self, tokens: np.ndarray, k: int, last: bool) -> np.ndarray:
        """A key of the first or last ``k`` characters of longer tokens; 0 for others."""
        out = np.zeros(len(tokens), _U)
        for i, t in enumerate(tokens.tolist()):
            if self.size[t] > k:
                s = self.start[t] - self.text_start[self.row[t]]
                word = self.texts[self.row[t]][s : s + self.size[t]].lower()
                out[i] = (hash(word[-k:] if last else word[:k]) & 0x7FFFFFFFFFFFFFFF) | 1
        return out


class Pieces:
    """Chains of tokens, each of one text, end to end: ``at`` are the tokens, ``row_start`` and ``row_size`` the chains, ``text`` whose they are."""

    def __init__(self, starts: np.ndarray, sizes: np.ndarray, text: np.ndarray):
        self.row_size, self.text = sizes, text
        self.row_start = np.cumsum(sizes) - sizes
        self.at = np.arange(int(sizes.sum())) + np.repeat(starts - self.row_start, sizes)

    def __len__(self) -> int:
        return len(self.at)

    def part(self, rows: np.ndarray) -> Pieces:
        """Some of the chains; ``at`` are then tokens of this one."""
        return Pieces(self.row_start[rows], self.row_size[rows], self.text[rows])

    def local(self, tokens: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, tokens)


def _layout(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by falling size, and how many of them reach each place."""
    order = np.argsort(-sizes, kind="stable")
    s = sizes[order]
    reach = len(s) - np.searchsorted(s[::-1], np.arange(s[0] if len(s) else 0), "right")
    return order, reach


class Field:
    """The weights and inference."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, transition: np.ndarray, skip: np.ndarray):
        self._potentials(transition, skip)
        self.marks = np.zeros(1 << _SLOT_BITS, np.uint32)
        self.at = np.zeros(1 << _SLOT_BITS, np.int32)
        self.weights = weights.astype(np.float32)
        # of features that fall into one slot the weightiest has it
        order = np.argsort(np.abs(weights).max(1), kind="stable")
        slot = (keys >> _U(64 - _SLOT_BITS)).astype(np.int64)
        self.marks[slot[order]] = keys[order].astype(np.uint32)
        self.at[slot[order]] = order

    def _potentials(self, transition: np.ndarray, skip: np.ndarray) -> None:
        self.transition = transition.astype(np.float32)
        self.skip = skip.astype(np.float32)  # by kind of edge and label; nothing for "none"
        self.labels = len(transition)

    def emissions(self, batch: Batch) -> np.ndarray:
        out = np.zeros((len(batch), self.labels), np.float32)
        for tokens, keys in batch.features():
            slot = (keys >> _U(64 - _SLOT_BITS)).astype(np.int64)
            hit = np.flatnonzero(self.marks[slot] == keys.astype(np.uint32))
            if len(hit):
                w = self.weights[self.at[slot[hit]]]
                if tokens is None:
                    out[hit] += w
                elif _repeats(tokens):
                    np.add.at(out, tokens[hit], w)
                else:
                    out[tokens[hit]] += w
        return out

    def possible(self, row: np.ndarray, emission: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which labels each token can have in a best labelling; "none" is always among them.

        A value's label cannot stand where "none" in its place would be better whatever the labels beside it that are
        possible themselves, and were both ends of each of its edges rewarded.
        """
        t, k = self.transition, self.labels
        left_gain, right_gain = t[:, 1:] - t[:, :1], t[1:, :] - t[:1, :]  # over "none", by the label before or after
        lead = emission[:, 1:] - emission[:, :1]
        if len(a):
            np.add.at(lead, np.concatenate([a, b]), self.skip.max(0)[1:])
        new_text = np.concatenate([[True], row[1:] != row[:-1]])
        last = np.concatenate([new_text[1:], [True]])
        open_ = np.zeros((len(row), k), bool)
        open_[:, 0] = True
        # at the ends of a text a neighbour is missing, which gains nothing
        open_[:, 1:] = lead + (np.maximum(left_gain.max(0), 0) + np.maximum(right_gain.max(1), 0)) >= -1e-3
        some = np.flatnonzero(open_[:, 1:].any(1))
        for _ in range(5):
            if not len(some):
                break
            left, right = open_[np.maximum(some - 1, 0)], open_[np.minimum(some + 1, len(row) - 1)]
            before, after = np.broadcast_to(left_gain[0], (len(some), k - 1)).copy(), np.broadcast_to(right_gain[:, 0], (len(some), k - 1)).copy()
            for u in range(1, k):
                before = np.maximum(before, np.where(left[:, u, None], left_gain[u], -np.inf))
                after = np.maximum(after, np.where(right[:, u, None], right_gain[:, u], -np.inf))
            bound = lead[some] + np.where(new_text[some][:, None], 0, before) + np.where(last[some][:, None], 0, after)
            shut = (bound < -1e-3) & open_[some, 1:]
            if not shut.any():
                break
            open_[some, 1:] &= ~shut
            some = some[open_[some, 1:].any(1)]
        return open_

    def decode(self, row: np.ndarray, emission: np.ndarray, edges: tuple[np.ndarray, np.ndarray, np.ndarray], every: bool = False) -> np.ndarray:
        """The label of every token; ``row`` says of which text it is, ``every`` that no token is passed over."""
        path = np.zeros(len(row), np.int8)
        if not len(row):
            return path
        a, b, kind = edges
        open_ = np.ones((len(row), self.labels), bool) if every else self.possible(row, emission, a, b)
        some = open_[:, 1:].any(1)
        if not some.any():
            return path
        # between tokens that are surely "none" lie chains of their own; such a token stands at either end of each
        new_text = np.concatenate([[True], row[1:] != row[:-1]])
        begins = np.flatnonzero(some & (new_text | ~np.concatenate([[False], some[:-1]])))
        ends = np.flatnonzero(some & (np.concatenate([new_text[1:], [True]]) | ~np.concatenate([some[1:], [False]]))) + 1
        begins = np.where(new_text[begins], begins, begins - 1)
        ends = np.where(np.concatenate([new_text, [True]])[ends], ends, ends + 1)
        local = np.where(open_, emission, np.float32(-1e9))
        chains = Pieces(begins, ends - begins, row[begins])
        live = (open_[a, 1:] & open_[b, 1:]).any(1) if len(a) else np.zeros(0, bool)
        tied = np.isin(chains.text, row[a[live]]) if live.any() else np.zeros(len(begins), bool)
        for loose, rows in ((True, np.flatnonzero(~tied)), (False, np.flatnonzero(tied))):
            if len(rows):
                part = Pieces(begins[rows], (ends - begins)[rows], row[begins[rows]])
                if loose:
                    got = self._chain(part, local[part.at])
                else:
                    # a token at the ends of two chains is "none" in both and has no live edge
                    got = self._loopy(part, local[part.at], part.local(a[live]), part.local(b[live]), kind[live])
                path[part.at] = np.maximum(path[part.at], got)
        return path

    def _chain(self, chains: Pieces, emission: np.ndarray) -> np.ndarray:
        path = np.zeros(len(chains), np.int8)
        order, reach = _layout(chains.row_size)
        starts, sizes = chains.row_start[order], chains.row_size[order]
        t, k = self.transition, self.labels
        back = np.zeros((len(chains), k), np.int8)
        best = emission[starts]
        for i in range(1, len(reach)):
            m = reach[i]
            now = best[:m, 0, None] + t[0]
            arg = np.zeros((m, k), np.int8)
            for y in range(1, k):
                other = best[:m, y, None] + t[y]
                more = other > now
                arg[more] = y
                now = np.where(more, other, now)
            at = starts[:m] + i
            back[at] = arg
            best[:m] = now + emission[at]
        state = best.argmax(1).astype(np.int8)
        path[starts + sizes - 1] = state
        for i in range(len(reach) - 1, 0, -1):
            m = reach[i]
            state[:m] = back[starts[:m] + i, state[:m]]
            path[starts[:m] + i - 1] = state[:m]
        return path

    def _loopy(self, chains: Pieces, emission: np.ndarray, a: np.ndarray, b: np.ndarray, kind: np.ndarray) -> np.ndarray:
        path = np.zeros(len(chains), np.int8)
        tie = self.skip[kind]
        k, t = self.labels, self.transition
        still = 1e-2 * float(self.skip.max()) + 1e-6
        forth, back = np.zeros((len(a), k), np.float32), np.zeros((len(a), k), np.float32)  # messages to b and to a
        text = np.repeat(chains.text, chains.row_size)
        edge_text = text[a]
        left = np.unique(chains.text)
        ahead, behind = np.zeros_like(emission), np.zeros_like(emission)
        for turn in range(ROUNDS):
            rows = np.flatnonzero(np.isin(chains.text, left))
            order, reach = _layout(chains.row_size[rows])
            starts = chains.row_start[rows][order]
            local = emission.copy()
            np.add.at(local, b, forth)
            np.add.at(local, a, back)
            for i in range(1, len(reach)):
                at = starts[: reach[i]] + i
                ahead[at] = ((ahead[at - 1] + local[at - 1])[:, :, None] + t).max(1)
            for i in range(len(reach) - 1, 0, -1):
                at = starts[: reach[i]] + i
                behind[at - 1] = ((behind[at] + local[at])[:, None, :] + t).max(2)
            belief = local + ahead + behind
            of_left = np.isin(text, left)
            path[of_left] = belief[of_left].argmax(1)
            live = np.isin(edge_text, left)
            change = np.zeros(len(a))
            sent = []
            for source, came in ((a, back), (b, forth)):
                rest = belief[source] - came
                sent.append(np.maximum(rest + tie - rest.max(1, keepdims=True), 0))  # the same label is rewarded, any other is free
            for message, new in ((forth, sent[0]), (back, sent[1])):
                change = np.maximum(change, np.abs(new - message).max(1))
                message[live] += (1.0 if turn < UNDAMPED else 1 - DAMPING) * (new - message)[live]
            left = left[np.isin(left, edge_text[live & (change > still)])]
            if not len(left):
                break
        return path


def _repeats(tokens: np.ndarray) -> bool:
    return len(tokens) > 1 and bool((np.diff(tokens) <= 0).any())


class _Part:
    """Some training texts: their labels, feature numbers token by token, and skip edges."""

    def __init__(self, batch: Batch, gold: np.ndarray, known: np.ndarray):
        tokens, numbers = [], []
        for t, keys in batch.features():
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            ok = known[at] == keys
            tokens.append((np.arange(len(batch), dtype=np.int32) if t is None else t.astype(np.int32))[ok])
            numbers.append(at[ok].astype(np.int32))
        token, number = np.concatenate(tokens), np.concatenate(numbers)
        self.feature = number[np.argsort(token, kind="stable")]
        self.bounds = np.concatenate([[0], np.cumsum(np.bincount(token, minlength=len(batch)))])
        self.gold, self.edges = gold, batch.edges()
        self.row_start, self.row_size, self.edge_row = batch.row_start, batch.row_size, batch.row[self.edges[0]]


def train(texts: list[str], gold: Callable[[Batch, int], np.ndarray], lexicon: Lexicon, labels: int, passes: int, least: int, seed: int, size: int = 64, part: int = 4000) -> Field:
    """The field by an averaged structured perceptron: all weights, those of skip edges too, follow the mistakes of loopy inference.

    The texts are read in parts, so that only numbers of frequent features are held.
    """
    rng = np.random.default_rng(seed)
    known, count = np.zeros(0, _U), np.zeros(0, np.int64)
    begins = range(0, len(texts), part)
    for begin in begins:
        found = [np.unique(k, return_counts=True) for _, k in Batch(texts[begin : begin + part], lexicon).features()]
        keys, inverse = np.unique(np.concatenate([known, *[k for k, _ in found]]), return_inverse=True)
        count = np.bincount(inverse, np.concatenate([count, *[c for _, c in found]]), len(keys)).astype(np.int64)
        known = keys
    known = known[count >= least]
    del count, keys, inverse, found
    parts = []
    for begin in begins:
        batch = Batch(texts[begin : begin + part], lexicon)
        parts.append(_Part(batch, gold(batch, begin), known))
    w, w_sum = np.zeros((len(known), labels), np.float32), np.zeros((len(known), labels), np.float32)
    t, t_sum = np.zeros((labels, labels)), np.zeros((labels, labels))
    skip, skip_sum = np.zeros((3, labels)), np.zeros((3, labels))
    rounds = sum(max(1, len(p.row_size) // size) for p in parts) * passes
    step = 0
    for _ in range(passes):
        for p in (parts[i] for i in rng.permutation(len(parts))):
            ea, eb, ek = p.edges
            for rows in np.array_split(rng.permutation(len(p.row_size)), max(1, len(p.row_size) // size)):
                left = (rounds - step) / rounds  # a change counts for the average as long as it stands
                step += 1
                rows = np.sort(rows[p.row_size[rows] > 0])
                view = Pieces(p.row_start[rows], p.row_size[rows], rows)
                at, row = view.at, np.repeat(rows, view.row_size)
                f = np.concatenate([p.feature[p.bounds[p.row_start[r]] : p.bounds[p.row_start[r] + p.row_size[r]]] for r in rows])
                sizes = p.bounds[at + 1] - p.bounds[at]
                want = p.gold[at]
                emission = np.add.reduceat(w[f], np.cumsum(sizes) - sizes, axis=0)
                emission += np.float32(MARGIN) * (np.arange(labels) != want[:, None])  # the right labelling must win by a margin
                field = object.__new__(Field)
                field._potentials(t, np.maximum(skip, 0))
                live = np.isin(p.edge_row, rows)
                la, lb, lk = view.local(ea[live]), view.local(eb[live]), ek[live]
                path = field.decode(row, emission, (la, lb, lk))
                wrong = np.flatnonzero(path != want)
                if not len(wrong):
                    continue
                token_of = np.repeat(np.arange(len(at)), sizes)
                bad = np.isin(token_of, wrong)
                fs, ts = f[bad], token_of[bad]
                joined = np.flatnonzero(np.diff(row) == 0)
                for some, sign in ((want, 1.0), (path, -1.0)):
                    np.add.at(w, (fs, some[ts]), sign)
                    np.add.at(w_sum, (fs, some[ts]), sign * left)
                    np.add.at(t, (some[joined], some[joined + 1]), sign)
                    np.add.at(t_sum, (some[joined], some[joined + 1]), sign * left)
                    both = (some[la] == some[lb]) & (some[la] > 0)
                    np.add.at(skip, (lk[both], some[la[both]]), sign)
                    np.add.at(skip_sum, (lk[both], some[la[both]]), sign * left)
    skip_sum = np.maximum(0, skip_sum)
    skip_sum[:, 0] = 0
    used = np.abs(w_sum).max(1) > 1e-6
    return Field(known[used], w_sum[used], t_sum, skip_sum)
