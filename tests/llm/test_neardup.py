import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from reliefspark.llm import neardup
from reliefspark.llm.graph import components
from tests.llm.conftest import DOCUMENTS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(rows, size):
    """Exact, by counting shared shingles."""
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    by = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            by[g].append(k)
    shared = Counter()
    for k, s in enumerate(sets):
        if rows[k][0] is not None:
            own = Counter(j for g in s for j in by[g] if j < k and rows[j][0] is not None)
            for j, n in own.items():
                if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                    root[find(k)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(sets[k]), least[find(k)] if i is not None else None, i is None or i == least[find(k)]) for k, (i, _) in enumerate(rows)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query(spark, sf, documents):
    assert got(neardup.op6_neardup(spark, sf)) == brute([(r.doc_id, r.text) for r in documents.collect()], 2)


def test_tricky(tricky, no_documents):
    assert got(neardup.near_duplicates(tricky, size=2)) == brute([(r.doc_id, r.text) for r in tricky.collect()], 2)
    assert neardup.near_duplicates(no_documents).count() == 0


@pytest.mark.parametrize(("rounds", "large"), [(0, 32), (2, 32), (1, 2)])
def test_chains_and_groups(spark, rounds, large, monkeypatch):
    """Groups of near copies of near copies, with similarities on both sides of the limit, and short sets."""
    monkeypatch.setattr(neardup, "LARGE", large)
    plain, cluster = neardup.visiting_links, neardup.cluster_links
    monkeypatch.setattr(neardup, "visiting_links", lambda *a: plain(*a, block=3))
    monkeypatch.setattr(neardup, "cluster_links", lambda *a: cluster(*a, block=100))
    rng, rows = random.Random(3), []
    for _ in range(6):
        text = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([8, 12, 30, 120]))]
        for _ in range(25):
            rows.append((len(rows), " ".join(text)))
            text = list(text)
            for _ in range(max(1, len(text) // rng.choice([12, 30, 60]))):
                text[rng.randrange(len(text))] = f"w{rng.randrange(4000)}"
    docs = spark.createDataFrame([(*r, "en", "s", 0, "", "", "", "") for r in rows], DOCUMENTS)
    assert got(neardup.near_duplicates(docs, size=2, star_rounds=rounds)) == brute(rows, 2)


def test_small_blocks(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(60):
        text = list(base)
        for _ in range(rng.randrange(1, 9)):
            text[rng.randrange(60)] = f"x{rng.randrange(900)}"
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame([(*r, "en", "s", 0, "", "", "", "") for r in rows], DOCUMENTS)
    plain = neardup.weak_edges
    monkeypatch.setattr(neardup, "weak_edges", lambda *a: plain(*a, block=7))
    assert got(neardup.near_duplicates(docs, size=2, star_rounds=0)) == brute(rows, 2)


def test_estimates_are_close():
    rng = np.random.default_rng(1)
    for n in (200, 2000):
        pool = np.unique(rng.integers(0, 2**64, 4 * n, dtype=np.uint64))
        for share in (0.0, 0.5, 0.9):
            k = int(2 * n * share / (1 + share))
            a, b = np.sort(pool[:n]), np.sort(pool[n - k : 2 * n - k])
            regs, filled = neardup.registers([a, b])
            found = neardup.estimates(regs, filled, np.array([n, n]), np.array([0]), np.array([1]))[0]
            assert abs(found - share) < 0.16


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7), (200, 200), (100, 102)]
    found = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)}


def test_components_of_long_chains(spark):
    order = list(range(400))
    random.Random(3).shuffle(order)
    links = list(zip(order, order[1:])) + [(i, i + 1) for i in range(1001, 1150)] + [(1150, 1000)]
    found = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(400)} | {i: 1000 for i in range(1000, 1151)}
