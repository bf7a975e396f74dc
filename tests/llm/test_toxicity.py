import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from reliefspark.llm import toxicity
from tests.llm.conftest import DOCUMENTS

SF = "/root/testdata/sf0.1"


def lattice_best(word, logp, apart=False):
    """The best path by trying all of them."""
    best = None
    paths = [(0.0, "")]
    for choices in toxicity.Restorer.lattice(word.lower(), apart):
        paths = [(s + c, t + x) for s, t in paths for x, _, c in choices]
    table = toxicity.symbol_table()
    for s, t in paths:
        a = b = 0
        for x in t:
            k = int(table[ord(x)])
            s += logp[a, b, k]
            a, b = b, k
        s += logp[a, b, 0]
        best = max(best, (s, t)) if best else (s, t)
    return best[1]


@pytest.fixture(scope="module")
def logp():
    text = " ".join(["you are an idiot and a stupid moron", "such a loser and clown", "this is trash and garbage", "the weather is pathetic today"] * 30)
    s = np.concatenate([[0, 0], toxicity.symbols(np.frombuffer(text.encode(), np.uint8)), [0, 0]]).astype(int)
    n = np.bincount((s[:-2] * 64 + s[1:-1]) * 64 + s[2:], minlength=64**3).reshape(64, 64, 64).astype(float)
    return toxicity.language_model(n)


def test_language_model_sums_to_one(logp):
    assert np.allclose(np.exp(logp).sum(-1), 1)


@pytest.mark.parametrize(("word", "want"), [
    ("1d10t", "idiot"), ("stuuupid", "stupid"), ("m0r0n", "moron"), ("$tup1d", "stupid"), ("tr4$h", "trash"), ("i.d.i.o.t", "idiot"), ("l0ser", "loser"), ("cl0wn", "clown"), ("p@th3t1c", "pathetic"), ("idiot", "idiot"),
    ("idi07", "idiot"), ("idio7", "idiot"), ("lo$3r", "loser"), ("id-iot", "idiot"), ("idioott", "idiot"), ("mor\u043en", "moron"), ("\uff49diot", "idiot"), ("stup\u0456d", "stupid"),
])
def test_restores(logp, word, want):
    assert toxicity.Restorer(logp).restore(word) == want == lattice_best(word, logp)


@pytest.mark.parametrize(("word", "want"), [("idiot", "idiot"), ("1diot", "idiot"), ("st0p1d", "stopid"), ("lo$er", "loser"), ("youareanidiot", "you are an idiot")])
def test_restores_what_stood_apart(logp, word, want):
    found = toxicity.Restorer(logp).restore(word, apart=True)
    assert found == want and (len(word) > 8 or found == lattice_best(word, logp, True))


def test_long_words_in_one_search(logp):
    """Words far above 48 characters: the best of all paths where they can be tried, and the same as for short words within them."""
    restorer = toxicity.Restorer(logp)
    word = "weather" * 9 + "1d10t" + "weather" * 9
    assert len(word) > 120 and restorer.restore(word) == lattice_best(word, logp) and "idiot" in restorer.restore(word)
    long = "an.1d10t.and.a.m0r0n." * 2000
    assert restorer.restore(long).count("idiot") == 2000 and (long, False) not in restorer.known
    # where a word of 48 characters was cut before, the letters before the cut count now
    for pad in range(40, 52):
        assert restorer.restore("w" + "eather" * (pad // 6) + "." * (pad % 6) + "m0r0n").endswith("moron")


def test_disguised_words():
    texts = ["plain text, 1999 was foo### bar$$$", "an 1d10t here", "soooo i d i o t !", None, "", "a.b.c.d e", "a$$ idio7, sh1+ id-iot; $100 4 5 6", "s h 1 t", "1 d i o t", "mor\u043en \u043c\u043e\u0440 \uff49diot", "s \u043e b"]
    coded = [(t or "").encode() for t in texts]
    row, number, found = toxicity.disguised(np.frombuffer(b"".join(coded), np.uint8), np.cumsum([0, *map(len, coded)]))
    got = sorted((int(r), *found[n]) for r, n in zip(row, number, strict=True))
    assert got == sorted([(0, "foo", False), (0, "bar$$$", False), (1, "1d10t", False), (2, "soooo", False), (2, "idiot!", True), (5, "a.b.c.d", False), (6, "a$$", False), (6, "idio7", False), (6, "sh1+", False), (6, "id-iot", False), (6, "$100", False), (7, "sh1t", True), (8, "1diot", True), (9, "mor\u043en", False), (9, "\uff49diot", False), (10, "s\u043eb", True)])


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.fit(docs, labels)


def score(model, *texts):
    coded = [t.encode() for t in texts]
    return model.scores(np.frombuffer(b"".join(coded), np.uint8), np.cumsum([0, *map(len, coded)]), toxicity.Restorer(model.logp))


def test_held_out(spark):
    rows = toxicity.op7_toxicity(spark, SF).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == 10_000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    hits, toxic, clean = sum(a and b for a, b in held), sum(a for a, _ in held), sum(not a for a, _ in held)
    assert hits > 0.9 * toxic and sum(b and not a for a, b in held) < 0.05 * clean


def test_disguise_is_seen_through(model):
    plain, odd, clean = score(model, "it was an idiot and a stupid moron on that", "it was an id10t and a stuuupid m0r0n on that", "it was an and a on that")
    assert plain > 0.5 and odd > 0.5 and clean < 0.5


def test_tricky(spark, tricky, no_documents, model):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(8)] + [(None, 1, "x"), (3, None, "x"), (3, 1, "x"), (3, 1, "x")], "doc_id long, toxic int, text string")
    for m in (toxicity.fit(tricky, labels), toxicity.fit(tricky, labels.limit(0)), toxicity.fit(no_documents, labels), model):
        scored = toxicity.with_scores(tricky, m)
        assert scored.columns == [*tricky.columns, "score"]
        assert all(0 <= r.score <= 1 for r in scored.collect()) and toxicity.with_scores(no_documents, m).count() == 0
    assert toxicity.without_toxic(tricky, labels).columns == tricky.columns


def test_copies_count_once(spark):
    body = " ".join(f"w{i}" for i in range(40))
    rows = [(i, f"{body} x{i}") for i in range(20)] + [(100 + i, " ".join(f"v{i}_{k}" for k in range(20))) for i in range(20)] + [(200, "two words")]
    docs = spark.createDataFrame([(*r, "en", "s", 0, "", "", "", "") for r in rows], DOCUMENTS)
    kept = {r.doc_id for r in toxicity.shared_ids(docs).collect()}
    assert kept >= {0, 200, *range(100, 120)} and len(kept) <= 24


def plain_gate(text):
    """What may be disguised, word by word: see ``disguised``."""
    tokens, out, run = re.findall(r"[^\x20\x09-\x0D]+", text), [], []
    ascii_letter = lambda c: c.isascii() and c.isalpha()
    alike = lambda c: c in toxicity.LOOK_ALIKES or c.lower() in toxicity.LOOK_ALIKES and len(c.encode()) == 2 or c.encode()[:2] in (b"\xef\xbc", b"\xef\xbd")
    sign = lambda c: c.isascii() and not c.isspace() and c.isprintable() and not c.isalnum()

    def close():
        if len(run) >= 3 and any(ascii_letter(c) or alike(c) for c in run):
            out.append(("".join(run), True))
        run.clear()

    for w in tokens:
        letters, digits = sum(map(ascii_letter, w)), sum(c in toxicity.LEET and c.isdigit() for c in w)
        signs, likes = sum(c in toxicity.LEET and not c.isdigit() for c in w), sum(map(alike, w))
        twice = any(ascii_letter(a) and a.lower() == b.lower() for a, b in zip(w, w[1:]))
        between = any(ascii_letter(a) and (sign(b) or b in toxicity.LEET) and ascii_letter(c) for a, b, c in zip(w, w[1:], w[2:]))
        if len(w) > 1 and (letters and (digits or signs or likes or twice or between) or not letters and digits and signs):
            out.append((w.strip(toxicity.EDGES) or w, False))
        if len(w) == 1 and letters + digits + signs + likes:
            run.append(w)
        else:
            close()
    close()
    return out


def plain_words(text):
    low = "".join(c.lower() if c.isascii() else c for c in text)
    return re.findall(r"(?:[0-9a-z]|[^\x00-\x7F])+", low)


def plain_features(text, restorer):
    """By distinct word: the word and its prefixes of 4 to 8 bytes."""
    words = set(plain_words(text))
    for w, apart in plain_gate(text):
        words |= set(plain_words(restorer.restore(w, apart)))
    return {w: [w, *((n, w.encode()[:n]) for n in toxicity.PREFIXES if len(w.encode()) > n)] for w in words}


def test_scores_by_hand(spark):
    """Model and scores by dictionaries: character counts, words, restored words, weights, chance limit, calibration."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    table, counts = toxicity.symbol_table(), np.zeros((64, 64, 64))
    for t in texts.values():
        s = [0, 0, *(int(table[min(ord(c), 0xFFFF)]) for c in t), 0, 0]
        for a, b, c in zip(s, s[1:], s[2:]):
            counts[a, b, c] += 1
    counts[0, 0, 0] = 0  # how many ends follow one another depends on how documents are put together
    model = toxicity.fit(docs, labels)
    made = toxicity.trigram_counts(docs)
    made[0, 0, 0] = 0
    assert (made == counts).all()
    restorer = toxicity.Restorer(model.logp)
    chosen = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 5}
    single = {r.doc_id for r in toxicity.shared_ids(docs.where(docs.doc_id.isin(list(chosen)))).collect()}
    quarter = lambda i: xxhash.xxh64_intdigest(struct.pack("<i", 1), xxhash.xxh64_intdigest(struct.pack("<q", i), 42)) % 4 == 0
    have, total = Counter(), Counter()
    for i in single:
        if not quarter(i):
            total[chosen[i]] += 1
            for f in {f for own in plain_features(texts[i], restorer).values() for f in own}:
                have[f, chosen[i]] += 1
    clean, toxic = total[0], total[1]
    features = [f for f, label in have if label == 1 and have[f, 1] >= 3]
    weight = {}
    for f in features:
        pos, neg = have[f, 1], have[f, 0]
        w = math.log((pos + 0.5) / (toxic + 1)) - math.log((neg + 0.5) / (clean + 1))
        if w > 0 and (pos + 0.5) / (pos + neg + 1) >= 0.5 and toxicity.tail(pos, pos + neg, toxic / (toxic + clean)) * (len(features) + 1) < 0.05:
            weight[f] = w
    assert len(weight) == len(model.keys) > 5 and np.allclose(sorted(weight.values()), sorted(model.weights))
    scored = {r.doc_id: r.score for r in toxicity.with_scores(docs, model).collect()}
    for i, t in texts.items():
        x = sum(max([0.0, *(weight[f] for f in own if f in weight)]) for own in plain_features(t, restorer).values())
        assert abs(scored[i] - 1 / (1 + math.exp(-min(30, max(-30, model.prior + model.slope * x))))) < 1e-9
    held = sorted(i for i in single if quarter(i))
    y = [chosen[i] for i in held]
    if min(sum(y), len(y) - sum(y)) >= 5:  # the fitted prior and slope are where the penalised likelihood is flat
        x = np.array([sum(max([0.0, *(weight[f] for f in own if f in weight)]) for own in plain_features(texts[i], restorer).values()) for i in held])
        p = 1 / (1 + np.exp(-(model.prior + model.slope * x)))
        assert abs((np.array(y) - p).sum()) < 1e-3 and abs((x * (np.array(y) - p)).sum() - 0.5 * (model.slope - 1)) < 1e-3 or model.slope == 0.05
