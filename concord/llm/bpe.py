"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens as arc labels. Before any merge it has one state
with a loop for every byte: every split into bytes is a path. The merges are
then compiled in, in their order, one gadget each. The gadget of ``a b -> ab``
acts where an arc ``a`` leads to a state with an arc ``b``:

* the target of the ``a`` arcs is split off without its ``b`` arc, so ``a``
  can no longer be followed by ``b``;
* every state that has an ``a`` arc gets an ``ab`` arc to where ``a b`` led.

All arcs of one label lead to one state, so the states are named by their last
token, and a split-off state differs from the one it was copied from by one
arc. States are therefore stored as (copied from, arc removed, merge number):
compiling is one step per merge, the copy is shared. An arc exists in a state
if it was added by a gadget while its first half's arc existed and no gadget
removed it since; arcs that a text asks for are looked up once and kept in a
transition table.

Exactly one path spells each word. Encoding follows it through the transition
table; the path's labels are the ids. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, text_key

#: Fixed value: the pattern by which byte-level tokenizers split a text into words.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words and transitions kept per Python worker.
MAX_WORDS, MAX_ARCS = 400_000, 2_000_000
#: Longer words are encoded, but not kept.
KEEP_BYTES = 64


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in vocabulary files: printable Latin-1 as itself, the rest from 256 up."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """States by last token. ``born``: number of the merge that made a token, 0 for bytes."""

    def __init__(self, labels: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.label = {i: t for t, i in labels.items()}
        self.born: dict[int, int] = {i: 0 for t, i in labels.items() if len(t) == 1}
        self.parts: dict[int, tuple[int, int]] = {}
        #: (token, arc) -> number of the merge whose gadget removed the arc from the token's state
        self.removed: dict[tuple[int, int], int] = {}
        self._table: dict[int, bool] = {}
        for n, (a, b) in enumerate(merges, 1):
            self._gadget(n, labels[a], labels[b], labels[a + b])
        #: every beginning of a label -> its id, or -1 where it is none itself
        self.reach: dict[bytes, int] = {}
        for t, i in labels.items():
            if i in self.born:
                for j in range(1, len(t)):
                    self.reach.setdefault(t[:j], -1)
                self.reach[t] = i

    def _gadget(self, n: int, a: int, b: int, ab: int) -> None:
        if a not in self.born or b not in self.born or not self._find(a, b):
            return  # no such two arcs are left to merge
        self.removed[a, b] = n
        if ab not in self.born:  # a token that two merges spell keeps its first arcs
            self.born[ab], self.parts[ab] = n, (a, b)

    def _gone(self, state: int, arc: int, until: int) -> int:
        """Number of the first merge up to ``until`` after both existed that removed ``arc`` from the state, else 0."""
        while True:
            n = self.removed.get((state, arc), 0)
            since = self.born[state]
            if n and n <= until and n > since and n > self.born[arc]:
                return n
            if state not in self.parts:
                return 0
            # before its merge, the state was that of its second half
            until, state = min(until, since - 1), self.parts[state][1]
            if until <= self.born[arc]:
                return 0

    def _find(self, state: int, arc: int) -> bool:
        until = len(self.removed) + 1 << 1
        while True:
            if self._gone(state, arc, until):
                return False
            if arc not in self.parts:
                return True
            # the arc was added where its first half's arc was left by that merge's split
            until, arc = self.born[arc], self.parts[arc][0]

    def has_arc(self, state: int, arc: int) -> bool:
        key = state << 20 | arc
        known = self._table.get(key)
        if known is None:
            if len(self._table) >= MAX_ARCS:
                self._table.clear()
            known = self._table[key] = self._find(state, arc)
        return known

    def encode(self, word: bytes) -> list[int]:
        """Ids of the path that spells ``word``.

        Takes the longest arc that the word allows at each state and steps back
        to a shorter one at a dead end. Only one valid path leads to a place of
        the word, so a place left as dead is not entered again.
        """
        reach, has, n = self.reach, self.has_arc, len(word)
        path: list[int] = []
        rest: list[list[int]] = []  # arcs not tried yet, the longest last, by depth
        dead: set[int] = set()
        at, label = 0, self.label
        arcs = None
        while at < n:
            if arcs is None:
                arcs, j = [], at + 1
                while (t := reach.get(word[at:j])) is not None and j <= n:
                    if t >= 0:
                        arcs.append(t)
                    j += 1
            while arcs:
                t = arcs.pop()
                to = at + len(label[t])
                if to not in dead and (not path or has(path[-1], t)):
                    path.append(t)
                    rest.append(arcs)
                    at, arcs = to, None
                    break
            else:  # a dead end
                dead.add(at)
                arcs = rest.pop()
                at -= len(label[path.pop()])
        return path


class Tokenizer:
    """A byte-level BPE vocabulary file compiled to an automaton."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only plain byte-level BPE files are read")
        of = byte_alphabet()

        def raw(token: str) -> bytes:
            return bytes(of[c] for c in token)

        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        labels = {raw(t): i for t, i in model["vocab"].items() if t not in self.special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.automaton = Automaton(labels, [(raw(a), raw(b)) for a, b in pairs])
        arc = dict(self.automaton.label) | {i: t.encode() for t, i in self.special.items()}
        self.arc = [arc.get(i, b"") for i in range(max(arc, default=-1) + 1)]
        self._decimal = [str(i) for i in range(len(self.arc))]
        self._split = regex.compile(SPLIT)
        self._specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._kept: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}

    def _word(self, word: str) -> tuple[int, ...]:
        raw = word.encode("utf-8", "replace")
        ids = self._older.get(word)
        if ids is None:
            ids = tuple(self.automaton.encode(raw))
        if len(raw) <= KEEP_BYTES:
            if len(self._kept) >= MAX_WORDS // 2:
                self._older, self._kept = self._kept, {}  # words in use come back from the older half
            self._kept[word] = ids
        return ids

    def _plain(self, text: str) -> list[int]:
        out = []
        for w in self._split.findall(text):
            ids = self._kept.get(w)
            out += self._word(w) if ids is None else ids
        return out

    def encode(self, text: str) -> list[int]:
        if self._specials is None:
            return self._plain(text)
        out, at = [], 0
        for m in self._specials.finditer(text):
            out += self._plain(text[at:m.start()])
            out.append(self.special[m.group()])
            at = m.end()
        return out + self._plain(text[at:] if at else text)

    def decode(self, ids: list[int]) -> str:
        arc = self.arc
        return b"".join([arc[i] for i in ids]).decode("utf-8", "replace")


    def digest(self, ids: list[int]) -> str:
        """SHA-256 of the comma-joined decimal ids."""
        decimal = self._decimal
        return hashlib.sha256(",".join([decimal[i] for i in ids]).encode()).hexdigest()


_OPEN: dict[str, Tokenizer] = {}


def open_tokenizer(path: str) -> Tokenizer:
    """The compiled tokenizer, once per Python worker."""
    if path not in _OPEN:
        _OPEN[path] = Tokenizer(path)
    return _OPEN[path]


def bpe_encode(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Encode and decode every whole text of ``docs (doc_id, text)``.

    Returns ``doc_id, text_key, n_tokens, ids_sha256, decoded_sha256`` per row
    (and ``ids`` if asked for): digests of the comma-joined decimal ids and of
    the decoded text in UTF-8. NULL is the empty text, which has no ids. Rows
    repeated in full give repeated rows, an empty table none. The strings of
    added tokens in a text are those tokens. Other columns are ignored.
    ``path`` is the vocabulary file, at the same place on every machine.
    """
    arrow_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        tok = open_tokenizer(path)
        for pdf in batches:
            rows = []
            for t in pdf.pop("text"):
                ids = tok.encode(t) if isinstance(t, str) else []
                rows.append((len(ids), tok.digest(ids),
                             hashlib.sha256(tok.decode(ids).encode("utf-8", "replace")).hexdigest())
                            + ((ids,) if with_ids else ()))
            cols = ["n_tokens", "ids_sha256", "decoded_sha256"] + (["ids"] if with_ids else [])
            for i, c in enumerate(cols):
                pdf[c] = [r[i] for r in rows]
            yield pdf

    src = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    return src.mapInPandas(run, f"doc_id {kind}, text_key bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
                           + (", ids array<int>" if with_ids else ""))
