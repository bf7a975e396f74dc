import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reliefspark.llm import decontaminate
from tests.llm.conftest import DOCUMENTS

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def tiles(text, item, least):
    """Greedy string tiling as first published, by plain search."""
    free_t, free_i, out = [True] * len(text), [True] * len(item), []
    while True:
        best = []
        for p in range(len(item)):
            for q in range(len(text)):
                n = 0
                while p + n < len(item) and q + n < len(text) and free_i[p + n] and free_t[q + n] and item[p + n] == text[q + n]:
                    n += 1
                if n >= least:
                    best.append((-n, p, q))
        if not best:
            return out
        longest = min(best)[0]
        for n, p, q in sorted(best):
            if n == longest and all(free_i[p : p - n]) and all(free_t[q : q - n]):
                free_i[p : p - n] = [False] * -n
                free_t[q : q - n] = [False] * -n
                out.append((p, q, -n))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.integers(0, 3), max_size=25), st.integers(1, 4))
def test_tiling(text, item, least):
    got = decontaminate.tile([np.array(text, np.uint64)], np.array(item, np.uint64), least)
    assert got == tiles(text, item, least)


def test_runs_are_apart():
    assert decontaminate.tile([np.array([1, 2], np.uint64), np.array([3, 4], np.uint64)], np.array([1, 2, 3, 4], np.uint64), 3) == []
    assert decontaminate.tile([], np.array([1], np.uint64), 1) == []


def brute(docs, items, seed=5, coverage=0.5):
    out = []
    for i, t in docs:
        w = words(t)
        have = {tuple(w[k : k + n]) for n in range(1, seed + 1) for k in range(len(w) - n + 1)}
        for j, x in items:
            v = words(x)
            n = min(seed, len(v))
            if j is None or not v or not any(tuple(v[k : k + n]) in have for k in range(len(v) - n + 1)):
                continue
            found = tiles(w, v, n)
            held = sum(n for _, _, n in found)
            if held >= coverage * len(v):
                out.append((i, j, len(v), len(found), held, held / len(v)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query(spark, sf, documents):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert got(decontaminate.op10_decontaminate(spark, sf)) == brute([(r.doc_id, r.text) for r in documents.collect()], items)


@pytest.mark.parametrize("block_bytes", [1 << 20, 600])
def test_reordered_and_tricky(spark, tricky, no_documents, block_bytes):
    rng = random.Random(4)
    passages = [[f"v{rng.randrange(500)}" for _ in range(30)] for _ in range(5)]
    moved = [p[20:] + ["and"] + p[:9] + ["!"] + p[9:20] for p in passages]
    texts = [" ".join(["x"] * 7 + m + ["y"] * 7).upper() for m in moved] + [" ".join(p[:14]) for p in passages] + [" ".join(p[:16]) for p in passages]
    extra = spark.createDataFrame([(100 + i, t, "en", "s", 0, "", "", "", "") for i, t in enumerate(texts)], DOCUMENTS)
    docs = tricky.union(extra)
    items = [(i, " ".join(p)) for i, p in enumerate(passages)] + [(0, "no id at all"), (7, None), (8, "..."), (9, "One, two"), (None, "one two"), (5, "w " * 40), (10, "The cat sat. The cat sat.")]
    benchmark = spark.createDataFrame([(*x, "e", "e") for x in items], "item_id long, text string, doc_id string, keys string")
    found = decontaminate.contaminated(docs, benchmark, block_bytes=block_bytes)
    want = brute([(r.doc_id, r.text) for r in docs.collect()], items)
    assert got(found.drop("text_key")) == want and {100, 104, 110} <= {r[0] for r in want} and 105 not in {r[0] for r in want}
    left = decontaminate.without_contaminated(docs, benchmark, block_bytes=block_bytes)
    bad = {(r[0]) for r in want}
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == sorted(r.doc_id for r in docs.collect() if r.doc_id not in bad)
    assert decontaminate.contaminated(no_documents, benchmark).count() == 0
    assert decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0
