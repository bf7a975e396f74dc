import re
from collections import Counter

from reliefspark.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeated = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), failed)


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def brute(rows, min_docs, share, least_words=3, least_share=0.2):
    lines = [Counter(tuple(WORD.findall(lower(x))) for x in (t or "").split("\n") if WORD.search(x)) for _, t, _ in rows]
    n = Counter((h or "", x) for (_, _, h), own in zip(rows, lines, strict=True) for x in own)
    sizes = Counter(h or "" for _, _, h in rows)
    out = []
    for (i, t, h), own in zip(rows, lines, strict=True):
        b, h = base(t), h or ""
        bad = [x for x in own if n[h, x] > min_docs and n[h, x] > share * sizes[h]]
        left = b[0] - sum(len(x) * own[x] for x in bad)
        out.append((i, *b, not b[5] and left >= least_words and left >= least_share * b[0], len(bad), left))
    return sorted(out, key=str)


def test_against_brute_force(spark, tricky, sf, documents):
    rows = [(r.doc_id, r.text, r.source) for r in tricky.collect()]
    assert sorted((tuple(r) for r in quality.quality(tricky, min_docs=1, share=0.1).collect()), key=str) == brute(rows, 1, 0.1)
    rows = [(r.doc_id, r.text, r.source) for r in documents.collect()]
    assert sorted((tuple(r) for r in quality.op9_quality(spark, sf).collect()), key=str) == brute(rows, 20, 0.002)
    assert sorted((tuple(r) for r in quality.quality(documents, min_docs=1, share=0.05).collect()), key=str) == brute(rows, 1, 0.05)


def test_none(no_documents):
    assert quality.quality(no_documents).count() == 0


def test_without_frequent_lines(tricky, documents, no_documents):
    """The documents that are kept, all their columns, without the lines above the limits."""
    for docs, limits in ((tricky, (1, 0.1, 0, 0.0)), (documents, (1, 0.02, 3, 0.2))):
        rows = [tuple(r) for r in docs.collect()]
        at = {c: i for i, c in enumerate(docs.columns)}
        i, t, h = at["doc_id"], at["text"], at["source"]
        names = dict(zip(("min_docs", "share", "least_words", "least_share"), limits, strict=True))
        n, sizes = Counter(), Counter(r[h] or "" for r in rows)
        normal = lambda x: tuple(WORD.findall(lower(x)))
        for r in rows:
            n.update((r[h] or "", x) for x in {normal(x) for x in (r[t] or "").split("\n")} if x)
        want, some = [], 0
        for r in rows:
            frequent = lambda x, r=r: bool(normal(x)) and n[r[h] or "", normal(x)] > limits[0] and n[r[h] or "", normal(x)] > limits[1] * sizes[r[h] or ""]
            lines = (r[t] or "").split("\n")
            left = [x for x in lines if not frequent(x)]
            b, w = base(r[t]), sum(len(normal(x)) for x in left)
            if not b[5] and w >= limits[2] and w >= limits[3] * b[0]:
                gone = len(left) < len(lines)
                some += gone
                text = "".join(x + "\n" for x in left)
                text = text if gone and frequent(lines[-1]) else text[:-1]
                want.append(tuple(text if k == t else v for k, v in enumerate(r)))
        got = quality.without_frequent_lines(docs, **names)
        assert got.columns == docs.columns
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and (some or docs is tricky)
    assert quality.without_frequent_lines(no_documents).count() == 0


def test_lines_that_just_reach_the_limit(spark):
    body = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(i, f"shared by all\n{body} {i}" + ("\nshared by three" if i < 3 else ""), "s") for i in range(6)], "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in quality.without_frequent_lines(docs, min_docs=3, share=0.0).collect()}
    assert got == {i: f"{body} {i}" + ("\nshared by three" if i < 3 else "") for i in range(6)}
