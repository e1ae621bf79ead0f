import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer as Library

from concord.llm.bpe import Automaton, Tokenizer, bpe_encode

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tok():
    return Tokenizer(PATH)


@pytest.fixture(scope="module")
def lib():
    t = Library.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def merged(word, merges):
    """Textbook BPE: the earliest merge first, from left to right."""
    parts = [bytes([b]) for b in word]
    rank = {m: i for i, m in enumerate(merges)}
    while True:
        best = min((rank.get(p, 1 << 30) for p in zip(parts, parts[1:])), default=1 << 30)
        if best == 1 << 30:
            return parts
        a, b = merges[best]
        out, i = [], 0
        while i < len(parts):
            if parts[i:i + 2] == [a, b]:
                out.append(a + b)
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out


def test_automaton_against_merging_on_random_vocabularies():
    rng = random.Random(7)
    for _ in range(60):
        labels = {bytes([c]): i for i, c in enumerate(b"abc")}
        merges = []
        while len(merges) < 9:
            a, b = rng.choice(list(labels)), rng.choice(list(labels))
            if a + b not in labels and len(a + b) < 9:
                # train-like: only merges that can still happen
                merges.append((a, b))
                labels[a + b] = len(labels)
        auto = Automaton(labels, merges)
        for _ in range(150):
            w = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14)))
            want = merged(w, merges)
            assert [auto.label[i] for i in auto.encode(w)] == want


def test_like_the_library(tok, lib):
    rng = random.Random(3)
    pool = ["a" * k for k in range(1, 40)] + [" " * k for k in range(1, 20)] + [
        "the", "ing", " ", "\n", "\t", "'s", "'ll", "É", "ß", "日本", "😀", "0", "12", "--", "<|endoftext|>", "́", "\x00"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["".join(rng.choice("abct eh.'!\n") for _ in range(60)) for _ in range(2000)]
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert [tok.encode(t) for t in texts] == want
    assert [tok.decode(i) for i in want] == lib.decode_batch(want, skip_special_tokens=False)


def test_very_long_words(tok, lib):
    for text in ("a" * 50_000, "ab" * 20_000, "=" * 9_999):
        assert tok.encode(text) == lib.encode(text, add_special_tokens=False).ids


def test_rows(spark, lib):
    schema = "doc_id bigint, text string, ids string, n_tokens string"
    assert bpe_encode(spark.createDataFrame([], schema), PATH).count() == 0
    rows = [(1, "Hello  world", "x", None), (1, "Hello  world", "x", None), (None, None, None, None), (3, "", "", "")]
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in
                 bpe_encode(spark.createDataFrame(rows, schema), PATH).collect())

    def want(d, t):
        ids = lib.encode(t, add_special_tokens=False).ids
        return (d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())

    assert got == sorted([want(1, "Hello  world"), want(1, "Hello  world"), want(0, ""), want(3, "")])
