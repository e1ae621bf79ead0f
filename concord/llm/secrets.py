"""Secrets in texts: fixed patterns, and a linear-chain conditional random field for what they miss.

The base patterns give spans that always stay. Tokens of a text are tagged as
beginning, inside or outside of a secret by a conditional random field over
three tags. Its features are the token itself (shape, length, make-up,
variety), the two tokens before and the one after it (words, or shapes) and
the text as a whole (shares of digits, punctuation and blanks); their weights
are summed per token and the best sequence is found by Viterbi.

The field is trained here, on windows around base spans and on windows of
texts without any (``FIT_WINDOWS`` of each at most, those of the smallest
hashes). Every window comes once more with a made-up secret of a random
alphabet, length and key word in it, so that the field learns places and
variety rather than the forms that the patterns know.

Most tokens are words that no neighbour could turn into a secret: where the
outside tag wins by more than transitions can change, every best sequence
passes through it. Texts are cut there, and only the runs of other tokens
between go through Viterbi, with the same result.
"""

from __future__ import annotations

import functools
import random
import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches

KINDS = ("assign", "access", "hex")
#: Name of the added spans' kind, after the base kinds in order.
ADDED = "field"
# The base patterns. An assigned value has 12 characters at least, an access key 18, a hex run 16.
_ASSIGN = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: Every text with an assignment has one of these, whatever the case.
_HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Words that the base pattern takes before a value; training windows swap them.
KEY_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_BEFORE = {*KEY_WORDS, "=", ":", '"', "'"}
# Alphabets and beginnings of made-up secrets.
ALPHABETS = ("abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEF0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
             "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
PREFIXES = ("", "", "sk_", "ghp_", "AKIA", "eyJ")

#: Training windows with and without secrets, tokens on either side of a secret, tokens of a window at most.
FIT_WINDOWS, SIDE, LONGEST = 1200, 10, 48
SHARES = 32
#: Hashed features, training rounds, least bytes of text tagged at a time, tokens whose features a worker keeps.
DIM, ROUNDS, PIECE, KEPT = 1 << 14, 60, 4 << 20, 1 << 19
#: Weight of the squared weights against the likelihood; those of file features, which every token of a text has, weigh more.
PENALTY, FILE_PENALTY = 0.3, 30.0
OUT, BEGIN, INSIDE = 0, 1, 2

# Byte classes: 0 blank, 1 of a word, 2 a token by itself.
_CLASS = np.array([1 if b >= 0x80 or chr(b).isalnum() or b in b"_+/.-" else 0 if b <= 0x20 or b == 0x7F else 2 for b in range(256)], dtype=np.int8)
_KIND = bytes(b"A"[0] if 0x41 <= b <= 0x5A else b"a"[0] if 0x61 <= b <= 0x7A else b"9"[0] if 0x30 <= b <= 0x39 else b"u"[0] if b >= 0x80 else b
              for b in range(256))
_RUNS, _DIGIT, _JOINT = re.compile(rb"(.)\1*", re.DOTALL), re.compile(rb"[0-9]"), re.compile(rb"[_./+-]")


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """``(start, kind, end, start of the value)`` of the base spans, by start and kind; code points."""
    out = []
    low = text.lower().encode("utf-8", "surrogatepass") if text else b""
    if any(h in low for h in _HINTS):
        out += [(m.start(), 0, m.end(), m.start(1)) for m in _ASSIGN.finditer(text) if m.end() - m.start(1) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end(), m.start()) for m in _HEX.finditer(text)]
    return sorted(out)


class Tokens:
    """Places of the tokens of some texts, which are joined by blanks, and their hashes."""

    def __init__(self, texts: list[bytes]):
        self.data = b" ".join(texts)
        raw = np.frombuffer(self.data, dtype=np.uint8)
        kind = np.concatenate(([0], _CLASS[raw], [0]))
        edge = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        self.start = np.flatnonzero(edge[:-1] & (kind[1:-1] != 0))
        ends = np.flatnonzero(edge)
        self.end = ends[np.searchsorted(ends, self.start, side="right")]
        first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        self.first = first
        self.text = np.searchsorted(first, self.start, side="right") - 1
        self.raw = raw

    def __len__(self) -> int:
        return len(self.start)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]]


@functools.lru_cache(1 << 16)
def _hash(*parts) -> int:
    return zlib.crc32("\x1f".join(map(str, parts)).encode("utf-8", "replace")) % DIM


def _step(x: float, parts: int) -> int:
    return min(parts - 1, int(x * parts))


def own_features(word: bytes) -> list[int]:
    """What a token itself shows."""
    n, kinds = len(word), word.translate(_KIND)
    size = int(2 * np.log2(n))
    runs = _RUNS.findall(kinds)
    upper, lower, digit, other = kinds.count(b"A"), kinds.count(b"a"), kinds.count(b"9"), kinds.count(b"u")
    symbols = n - upper - lower - digit - other
    made = (upper > 0) + 2 * (lower > 0) + 4 * (digit > 0) + 8 * (symbols > 0) + 16 * (other > 0)
    shape = b"".join(runs[:8]) + (b"+" if len(runs) > 8 else b"")
    changes = _step((len(runs) - 1) / max(1, n - 1), 6)
    variety = _step((len(set(word)) - 1) / min(n, 40), 5)
    vowels = n - len(word.translate(None, b"aeiouyAEIOUY"))
    out = [_hash("shape", shape), _hash("size", size), _hash("made", made, size), _hash("digits", _step(digit / n, 5), size),
           _hash("changes", changes, size), _hash("variety", variety, size), _hash("vowels", _step(vowels / n, 6), size, made)]
    if not word.translate(None, b"0123456789abcdefABCDEF"):
        out.append(_hash("hex", size, digit == n))
    if digit + symbols == 0 and n <= 16:
        out.append(zlib.crc32(b"word" + word.lower()) % DIM)
    elif n > 4:
        out.append(zlib.crc32(b"head" + word[:4]) % DIM)
    return out


def near_features(word: bytes) -> list[int]:
    """What a token says about those next to it: itself if it is short and has no digits, its last part, else its shape."""
    low = word.lower()
    if len(low) <= 24 and not _DIGIT.search(low):
        part = low if low.isalpha() else _JOINT.split(low.strip(b"_./+-"))[-1]
        return [zlib.crc32(b"near" + low) % DIM, zlib.crc32(b"part" + part) % DIM]
    runs = _RUNS.findall(word.translate(_KIND))
    return [_hash("nearshape", b"".join(runs[:4])), _hash("nearsize", int(np.log2(len(word))))]


#: Places that a token's neighbours are looked at, each with weights of its own.
AROUND = (-1, -2, 1)


def file_features(data: bytes) -> list[int]:
    """Shares of digits, punctuation and blanks in a whole text, in powers of two."""
    counts = np.zeros(256, dtype=np.int64)
    for at in range(0, len(data), PIECE):
        counts += np.bincount(np.frombuffer(data[at:at + PIECE], dtype=np.uint8), minlength=256)
    shares = counts[0x30:0x3A].sum(), counts[_CLASS == 2].sum(), counts[_CLASS == 0].sum()
    return [_hash("file", i, min(7, int(-np.log2((x + 1) / (len(data) + 256))))) for i, x in enumerate(map(int, shares))]


class Field:
    """Weights of the trained field, and what they give for tokens seen before."""

    def __init__(self, own: np.ndarray, near: np.ndarray, file: np.ndarray, move: np.ndarray):
        #: own (DIM, 3), near (len(AROUND), DIM, 3), file (DIM, 3), move (3, 3): from tag, to tag
        self.own, self.near, self.file, self.move = own, near, file, move
        # most that a tag other than OUT can gain over it by the transitions on both sides
        through = move[:, :, None] + move[None, :, :]  # from, at, to
        self.gain = np.array([(through[:, x] - through[:, OUT]).max() for x in range(3)])
        self.seen: dict[bytes, int] = {}
        self.rows = [np.zeros((0, 3)) for _ in range(1 + len(near))]  # sums for the token itself, and for its neighbours at each place

    def __getstate__(self):
        return self.own, self.near, self.file, self.move

    def __setstate__(self, state):
        self.__init__(*state)

    def _add(self, words: list[bytes]) -> None:
        """Sum the weights of ``words``."""
        for w in words:
            self.seen[w] = len(self.seen)

        def summed(features, weights):
            first = np.concatenate(([0], np.cumsum([len(f) for f in features])))[:-1]
            return np.add.reduceat(weights[np.array([x for f in features for x in f])], first, axis=0)

        own, near = [own_features(w) for w in words], [near_features(w) for w in words]
        n = len(self.seen)
        for j, new in enumerate((summed(own, self.own), *(summed(near, x) for x in self.near))):
            if n > len(self.rows[j]):
                self.rows[j] = np.concatenate([self.rows[j], np.zeros((max(len(self.rows[j]), n), 3))])
            self.rows[j][n - len(words):n] = new

    def emissions(self, tokens: Tokens, files: list[list[int]]) -> np.ndarray:
        """Summed weights of every token's features, by tag; ``files``: the texts' own features."""
        n = len(tokens)
        data = tokens.data
        words = [data[a:b] for a, b in zip(tokens.start.tolist(), tokens.end.tolist())]
        if len(self.seen) > KEPT:
            self.seen = {}
        new = set(words).difference(self.seen)
        if new:
            self._add(list(new))
        at = np.array(list(map(self.seen.__getitem__, words)), dtype=np.int64)
        out = self.rows[0].take(at, axis=0) + np.array([self.file[f].sum(axis=0) for f in files]).reshape(-1, 3).take(tokens.text, axis=0)
        for j, step in enumerate(AROUND):
            if abs(step) < n:
                mine, other = (slice(-step, None), slice(None, step)) if step < 0 else (slice(None, -step), slice(step, None))
                near = self.rows[1 + j].take(at[other], axis=0)
                near[tokens.text[mine] != tokens.text[other]] = 0.0
                out[mine] += near
        return out

    def sure(self, e: np.ndarray) -> np.ndarray:
        """Tokens that are outside in every best sequence."""
        return ((e[:, OUT, None] - e[:, 1:]) > self.gain[1:]).all(axis=1)

    def viterbi(self, e: np.ndarray) -> list[int]:
        """Best tags of a run of tokens between two that are outside."""
        move = self.move
        score, back = move[OUT] + e[0], []
        for row in e[1:]:
            every = score[:, None] + move
            back.append(every.argmax(axis=0))
            score = every.max(axis=0) + row
        tag = int((score + move[:, OUT]).argmax())
        tags = [tag]
        for b in reversed(back):
            tag = int(b[tag])
            tags.append(tag)
        return tags[::-1]

    def tagged(self, tokens: Tokens, e: np.ndarray, sure: np.ndarray) -> list[tuple[int, int]]:
        """``(first, last + 1)`` tokens of every secret; a run of unsure tokens never crosses into another text."""
        unsure = np.flatnonzero(~sure)
        if not len(unsure):
            return []
        begins = np.flatnonzero(np.concatenate(([True], (np.diff(unsure) > 1) | (np.diff(tokens.text[unsure]) > 0))))
        first, size = unsure[begins], np.diff(np.append(begins, len(unsure)))
        # most runs are one token: all at once
        alone = (self.move[OUT] + e[first] + self.move[:, OUT]).argmax(axis=1)
        out = []
        for i in np.flatnonzero((size > 1) | (alone != OUT)).tolist():
            a, b = int(first[i]), int(first[i] + size[i])
            tags, begun = self.viterbi(e[a:b]), None
            for j, tag in enumerate([*tags, OUT]):
                if begun is not None and tag != INSIDE:
                    out.append((a + begun, a + j))
                    begun = None
                if tag == BEGIN or (tag == INSIDE and begun is None):
                    begun = j
        return out


def _bounds(tokens: Tokens, a: int, b: int) -> tuple[int, int]:
    """Bytes of a secret's tokens without the dots and dashes at its end."""
    lo, hi = int(tokens.start[a]), int(tokens.end[b - 1])
    return lo, lo + len(tokens.data[lo:hi].rstrip(b".-,"))


def _long(field: Field, data: bytes) -> list[tuple[int, int]]:
    """Byte spans of the secrets in one long text, tagged piece by piece.

    Pieces overlap: a piece is decoded up to its last token that is surely
    outside, and the next one starts two tokens before it, so that every
    token has its neighbours. Without such a token the piece grows.
    """
    files, out, lo, size, skip = [file_features(data)], [], 0, PIECE, 0
    while True:
        hi = min(len(data), lo + size)
        while hi < len(data) and _CLASS[data[hi]]:
            hi += 1
        tokens = Tokens([data[lo:hi]])
        if not len(tokens):
            if hi == len(data):
                return out
            lo, size, skip = hi, PIECE, 0
            continue
        e = field.emissions(tokens, files)
        sure = field.sure(e)
        sure[:skip] = True  # known from the piece before
        end = len(tokens)
        if hi < len(data):
            known = np.flatnonzero(sure[:-1])
            if not len(known) or known[-1] <= max(skip, 2):
                size *= 2
                continue
            end = int(known[-1])
            sure[end:] = True
        out += [(lo + x, lo + y) for x, y in (_bounds(tokens, a, b) for a, b in field.tagged(tokens, e, sure))]
        if hi == len(data):
            return out
        lo, size, skip = lo + int(tokens.start[end - 2]), PIECE, 3


def found(field: Field, texts: list[bytes]) -> list[list[tuple[int, int]]]:
    """Byte spans of the secrets that the field finds in each text."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    at = 0
    while at < len(texts):
        if len(texts[at]) > PIECE:
            out[at] = _long(field, texts[at])
            at += 1
            continue
        to, size = at, 0
        while to < len(texts) and size + len(texts[to]) <= PIECE:
            size += len(texts[to])
            to += 1
        tokens = Tokens(texts[at:to])
        if len(tokens):
            e = field.emissions(tokens, [file_features(t) for t in texts[at:to]])
            for a, b in field.tagged(tokens, e, field.sure(e)):
                i = int(tokens.text[a])
                lo, hi = _bounds(tokens, a, b)
                if hi > lo:
                    out[at + i].append((lo - int(tokens.first[i]), hi - int(tokens.first[i])))
        at = to
    return out


def _bytes(text) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def _points(data: bytes, at: list[int]) -> list[int]:
    """Code points before each of the ascending byte places ``at``."""
    out, done, n = [], 0, 0
    for x in at:
        n += len(data[done:x].decode("utf-8", "surrogatepass"))
        done = x
        out.append(n)
    return out


# -- training ----------------------------------------------------------------------

def windows(text: str, mark: int) -> list[tuple[bool, list[str], list[int], list[int]]]:
    """Training windows of a text: (with a secret, tokens, tags, file features); ``mark`` picks the places.

    Runs of digits alone are no examples of secrets: numbers are not. A window
    without a secret, but with a key word and a separator, tells nothing: what
    follows may be a secret that the patterns miss.
    """
    data = _bytes(text)
    tokens = Tokens([data])
    n = len(tokens)
    if not n:
        return []
    spans = base_spans(text)
    tags = np.zeros(n, dtype=np.int64)
    places = []
    for s, _, e, v in spans:
        if text[v:e].isdigit():
            continue
        lo, hi = len(text[:v].encode("utf-8", "surrogatepass")), len(text[:e].encode("utf-8", "surrogatepass"))
        own = np.flatnonzero((tokens.start < hi) & (tokens.end > lo))
        tags[own] = INSIDE
        tags[own[0]] = BEGIN
        places.append((int(own[0]), int(own[-1]) + 1))
    if places:
        a, b = places[mark % len(places)]
        lo, hi = max(0, a - SIDE), min(n, b + SIDE)
    else:
        lo = mark % n
        hi = min(n, lo + 2 * SIDE)
    if hi - lo > LONGEST or tokens.end[hi - 1] - tokens.start[lo] > 2048:
        return []
    words = [tokens.word(i).decode("utf-8", "replace") for i in range(lo, hi)]
    if not places and any(a.lower() in KEY_WORDS and b in "=:" for a, b in zip(words, words[1:])):
        return []
    return [(bool(places), words, tags[lo:hi].tolist(), file_features(data))]


def _drawn(rng: random.Random, least: int) -> str:
    """A made-up secret: random letters of one alphabet."""
    letters = rng.choice(ALPHABETS)
    return "".join(rng.choice(letters) for _ in range(int(least * (200 / least) ** rng.random())))


def planted(words: list[str], tags: list[int], rng: random.Random) -> tuple[list[str], list[int]]:
    """The window with a made-up secret in it: after a key word and a separator, or a longer one alone.

    A secret that is there gives its place; else the place is drawn. Words
    joined to a long one or a path stand before it, as what secrets are not.
    """
    at = tags.index(BEGIN) if BEGIN in tags else rng.randrange(len(words) + 1)
    after = at + 1
    while after < len(words) and tags[after] == INSIDE:
        after += 1
    if BEGIN not in tags:
        after = at
    while at and words[at - 1].lower() in _BEFORE:
        at -= 1
    if rng.random() < 0.5:
        key = rng.choice(KEY_WORDS)
        key = rng.choice((key, key.upper(), key.capitalize(), "my_" + key, key + "_key"))
        quote = rng.choice(([], [], ['"'], ["'"]))
        before = [key, *rng.choice((["="], [":"], [":", "="])), *quote]
        own = [*before, _drawn(rng, 8), *quote]
        marks = [OUT] * len(before) + [BEGIN] + [OUT] * len(quote)
    else:
        own, marks = [rng.choice(PREFIXES) + _drawn(rng, 18)], [BEGIN]
    plain = [w for w, t in zip(words, tags) if t == OUT] or ["the"]
    parts = [rng.choice(plain) for _ in range(rng.randint(2, 5))]
    decoy = ["https", ":", "//" + "/".join(parts)] if rng.random() < 0.3 else [rng.choice(("", "/", "-", ".", "_")).join(parts)]
    return [*words[:at], *decoy, *own, *words[after:]], [*tags[:at], *[OUT] * len(decoy), *marks, *tags[after:]]


def fit(examples: list[tuple[list[str], list[int], list[int]]], rounds: int = ROUNDS) -> Field:
    """Weights that make the tags of ``examples (tokens, tags, file features)`` likeliest (with a penalty), by steps of each weight's own pace (Rprop)."""
    spaces = 2 + len(AROUND)  # own, near each, file
    feats, owner, place, lengths, gold = [], [], [], [], []
    n = 0
    for words, tags, file in examples:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        near = [near_features(w) for w in raw]
        for i, w in enumerate(raw):
            own = own_features(w) + [(spaces - 1) * DIM + f for f in file]
            for j, step in enumerate(AROUND):
                if 0 <= i + step < len(raw):
                    own += [(1 + j) * DIM + f for f in near[i + step]]
            feats += own
            owner += [n + i] * len(own)
        place += range(len(words))
        lengths.append(len(words))
        gold += tags
        n += len(words)
    feats, owner, gold, lengths = np.array(feats), np.array(owner), np.array(gold), np.array(lengths)
    # features that occur, numbered
    used, feats = np.unique(feats, return_inverse=True)
    window, place = np.repeat(np.arange(len(lengths)), lengths), np.array(place)
    width = int(lengths.max())
    real = np.arange(width)[None, :] < lengths[:, None]
    w, move = np.zeros((len(used), 3)), np.zeros((3, 3))
    penalty = np.where(used >= (spaces - 1) * DIM, FILE_PENALTY, PENALTY)[:, None]
    states = [(np.zeros_like(x), np.full_like(x, 0.1)) for x in (w, move)]  # last slope and pace of every weight
    seen = np.zeros((3, 3))  # moves in the examples, from and to the outside at their ends
    bounds = np.cumsum(lengths)
    starts = np.concatenate(([0], bounds[:-1]))
    inner = np.flatnonzero(place > 0)
    np.add.at(seen, (gold[inner - 1], gold[inner]), 1)
    np.add.at(seen, (np.full(len(starts), OUT), gold[starts]), 1)
    np.add.at(seen, (gold[bounds - 1], np.full(len(starts), OUT)), 1)
    truth = np.eye(3)[gold]

    def lse(x, axis):
        top = x.max(axis=axis, keepdims=True)
        return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)

    for _ in range(rounds):
        e = np.zeros((len(lengths), width, 3))
        e[window, place] = np.column_stack([np.bincount(owner, weights=w[feats, c], minlength=n) for c in range(3)])
        forward = np.zeros_like(e)
        forward[:, 0] = move[OUT] + e[:, 0]
        for t in range(1, width):
            new = lse(forward[:, t - 1, :, None] + move, 1) + e[:, t]
            forward[:, t] = np.where(real[:, t, None], new, forward[:, t - 1])
        z = lse(forward[:, -1] + move[:, OUT], 1)
        back = np.broadcast_to(move[:, OUT], e.shape).copy()
        pairs = np.zeros((3, 3))
        for t in range(width - 2, -1, -1):
            rows = real[:, t + 1]
            after = move + (e[rows, t + 1] + back[rows, t + 1])[:, None, :]
            back[rows, t] = lse(after, 2)
            pairs += np.exp(forward[rows, t][:, :, None] + after - z[rows][:, None, None]).sum(axis=0)
        p = np.exp(forward + back - z[:, None, None])
        pairs[OUT] += p[:, 0].sum(axis=0)
        pairs[:, OUT] += p[np.arange(len(lengths)), lengths - 1].sum(axis=0)
        miss = truth - p[window, place]
        slope = np.column_stack([np.bincount(feats, weights=miss[owner, c], minlength=len(used)) for c in range(3)])
        for x, g, (last, pace) in ((w, slope - penalty * w, states[0]), (move, seen - pairs - PENALTY * move, states[1])):
            turned = g * last < 0
            pace *= np.where(turned, 0.5, np.where(g * last > 0, 1.2, 1.0))
            np.clip(pace, 1e-4, 0.5, out=pace)
            last[:] = np.where(turned, 0.0, g)
            x += np.sign(last) * pace
    every = np.zeros((spaces * DIM, 3))
    every[used] = w
    every = every.reshape(spaces, DIM, 3)
    return Field(every[0], every[1:-1], every[-1], move)


def nothing() -> Field:
    """A field that finds no secrets: the texts had none to learn from."""
    move = np.zeros((3, 3))
    move[:, 1:] = -30.0
    return Field(np.zeros((DIM, 3)), np.zeros((len(AROUND), DIM, 3)), np.zeros((DIM, 3)), move)


def learn(docs: DataFrame, limit: int = FIT_WINDOWS) -> Field:
    """The field, trained on at most ``limit`` windows with secrets and as many without, of the smallest text hashes."""
    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(mark, *w) for mark, text in zip(pdf["mark"], pdf["text"]) for w in windows(text, int(mark) & 0x7FFFFFFF)]
            yield pd.DataFrame(rows, columns=["mark", "secret", "words", "tags", "file"])

    src = docs.where(F.length("text") > 0).select("text", F.xxhash64("text").alias("mark"))
    rows = src.mapInPandas(run, "mark bigint, secret boolean, words array<string>, tags array<int>, file array<int>")
    # the smallest of each of SHARES parts first, so that the last task of a kind gets SHARES * limit rows at most
    for part in (("secret", F.pmod(F.xxhash64("words"), F.lit(SHARES))), ("secret",)):
        at = F.row_number().over(Window.partitionBy(*part).orderBy("mark"))
        rows = rows.withColumn("_at", at).where(F.col("_at") <= limit).drop("_at")
    sample = rows.collect()  # 2 * limit short rows
    sample.sort(key=lambda r: (r["mark"], r["words"]))
    if not any(r["secret"] for r in sample):
        return nothing()
    rng = random.Random(1)
    return fit([(r["words"], r["tags"], r["file"]) for r in sample]
               + [(*planted(r["words"], r["tags"], rng), r["file"]) for r in sample])


def secrets(docs: DataFrame, limit: int = FIT_WINDOWS) -> DataFrame:
    """``(doc_id, base, spans)`` per row of ``docs (doc_id, text)``: arrays of (s, k, e).

    s and e are code points, e exclusive; k is the place of the kind in KINDS,
    and after those for spans of the field. ``base`` are the spans of the fixed
    patterns: leftmost non-overlapping matches of each kind, without those that
    are too short. ``spans`` are these and what the field finds outside of
    them, by start, then kind. NULL and empty texts have none; texts of which
    none has a base span give no field and so no added spans; repeated rows
    give repeated rows, an empty table none; other columns are ignored.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(learn(docs, limit))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf.pop("text")]
            raw = [_bytes(t) for t in texts]
            base = [base_spans(t) for t in texts]
            spans = []
            for data, own, new in zip(raw, base, found(shared.value, raw)):
                points = iter(_points(data, [x for span in new for x in span]))
                more = [(s, len(KINDS), e) for s, e in zip(points, points)]
                plain = [(s, k, e) for s, k, e, _ in own]
                spans.append(sorted(plain + _apart(more, plain)))
            pdf["base"] = [[{"s": s, "k": k, "e": e} for s, k, e, _ in own] for own in base]
            pdf["spans"] = [[{"s": s, "k": k, "e": e} for s, k, e in every] for every in spans]
            yield pdf

    parts = "array<struct<s: int, k: int, e: int>>"
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, base {parts}, spans {parts}")


def _apart(more: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of the ascending ``more`` that overlap none of ``base``, by one merge."""
    out, at, reach = [], 0, -1
    for span in more:
        while at < len(base) and base[at][0] < span[2]:
            reach = max(reach, base[at][2])
            at += 1
        if reach <= span[0]:
            out.append(span)
    return out


def listed(spans: str) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*map(F.lit, (*KINDS, ADDED)))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")
