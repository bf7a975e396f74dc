"""Texts on which polynomials modulo 2^64 collide, and hashes that clash by force."""

import numpy as np
import pytest

from reliefspark.llm import bpe, decontaminate, neardup, quality, textkit, tokenfiles
from tests.llm.conftest import DOCUMENTS
from tests.llm.test_bpe import PATH, check, encode, library
from tests.llm.test_neardup import brute, got


def thue_morse(n):
    bits = np.zeros(1, int)
    while len(bits) < n:
        bits = np.concatenate([bits, 1 - bits])
    return bits[:n]


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_patterns_are_told_apart(n):
    bits = thue_morse(n)
    a, b = ("".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits))
    for encoder in (bpe.Encoder(vocab := bpe.vocabulary(PATH), lambda x: [vocab.encode(t) for t in x]), tokenfiles.library_encoder(PATH)):
        assert encode(encoder, [a, b]) == [library(a), library(b)]
    data = np.frombuffer((a + b).encode(), np.uint8)
    assert len(np.unique(textkit.hash_spans(data, np.array([0, n]), np.array([n, 2 * n])))) == 2
    sets = neardup.shingle_sets(data, np.array([0, n, 2 * n]), 2)
    assert sets[0] != sets[1]
    lines = np.frombuffer(f"{a}\n{b}\n{a}".encode(), np.uint8)
    metrics, normal, _, _ = quality.measure(lines, np.array([0, len(lines)]))
    assert metrics["n_dup_lines"].tolist() == [1] and len(np.unique(normal)) == 2


@pytest.mark.parametrize("n", [1024, 4096])
def test_tiling_ends(n):
    """An item and a text that differ in every word, but for the ends that they have in common."""
    two, bits = np.array([3 << 40, 5 << 40], np.uint64), thue_morse(n)
    found = decontaminate.tile([two[bits]], two[1 - bits], 5)
    p, q, k = (np.array(x) for x in zip(*found, strict=True))
    assert all((two[bits][b : b + c] == two[1 - bits][a : a + c]).all() for a, b, c in found) and k.max() < n
    # the longest stretch that both have, by plain search
    text, item = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
    longest = max(m for m in range(1, n) if any(item[i : i + m] in text for i in range(n - m + 1))) if n == 1024 else k[0]
    assert k[0] == longest


def test_tiling_when_hashes_clash(monkeypatch):
    monkeypatch.setattr(decontaminate, "PRIME", 7)
    monkeypatch.setattr(decontaminate, "BASES", (3, 5))
    rng = np.random.default_rng(4)
    from tests.llm.test_decontaminate import tiles

    for _ in range(60):
        text, item = rng.integers(0, 9, 30), rng.integers(0, 9, 20)
        assert decontaminate.tile([text.astype(np.uint64)], item.astype(np.uint64), 2) == tiles(text.tolist(), item.tolist(), 2)


def test_ids_when_hashes_clash(spark, tricky, monkeypatch):
    plain = textkit.Spans.__init__

    def clashing(self, *a, **b):
        plain(self, *a, **b)
        self.hashes = (self.lengths % 3).astype(np.uint64)

    monkeypatch.setattr(textkit.Spans, "__init__", clashing)
    vocab = bpe.vocabulary(PATH)
    rows = [(r.doc_id, r.text) for r in tricky.collect()] + [(100 + i, f"some words and others {i} sown word") for i in range(30)]
    encoder = bpe.Encoder(vocab, lambda x: [vocab.encode(t) for t in x])
    for part in (rows[:9], rows[9:30], rows[30:], rows):
        assert encode(encoder, [t or "" for _, t in part]) == [library(t) for _, t in part]


def test_queries_over_patterns(spark):
    bits = thue_morse(2048)
    texts = ["".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits), " ".join("ab"[x] for x in bits), " ".join("ba"[x] for x in bits)]
    rows = [(i, f"{t} {'tail of both' if i > 1 else ''}") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, "en", "s", 0, "", "", "", "") for r in rows], DOCUMENTS)
    check(bpe.round_trip(docs, PATH, bpe.build_lexicon(docs, PATH)).collect(), rows)
    assert got(neardup.near_duplicates(docs, size=2)) == brute(rows, 2)
    assert {r.doc_id: r.n_words for r in quality.quality(docs).collect()} == {i: len(t.split()) for i, t in rows}
