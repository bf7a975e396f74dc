import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from reliefspark.llm import langid
from tests.llm.conftest import DOCUMENTS, TRICKY

SF = "/root/testdata/sf0.1"


def fold_all(text):
    out = []
    for c in text:
        if unicodedata.category(c)[0] == "L":
            low = c.lower()[0] if ord(c) <= 0xFFFF else c
            out.append(ord(low) if ord(low) <= 0xFFFF else 0xE000 + ord(c) % 0x1000)
        elif out and out[-1] != 32:
            out.append(32)
    return out


class Plain:
    """Interpolated Kneser-Ney by dictionaries."""

    def __init__(self, texts, symbols):
        grams = Counter()
        for t in texts:
            s = [32] * 3 + fold_all(t) + [32]
            grams.update(tuple(s[i - 3 : i + 1]) for i in range(3, len(s)))
        self.levels = {4: grams}
        for order in (3, 2, 1):
            self.levels[order] = Counter(g[1:] for g in self.levels[order + 1])
        self.discount = {}
        for order, level in self.levels.items():
            ones, twos = (sum(n == k for n in level.values()) for k in (1, 2))
            self.discount[order] = ones / (ones + 2 * twos) if ones and twos else 0.5
        self.total, self.kinds = defaultdict(float), Counter()
        for level in self.levels.values():
            for g, n in level.items():
                self.total[g[:-1], len(g)] += n
                self.kinds[g[:-1], len(g)] += 1
        self.symbols = symbols

    def p(self, g):
        order = len(g)
        if order == 0:
            return 1 / (self.symbols + 1)
        context = (g[:-1], order)
        lower = self.p(g[1:])
        if not self.total[context]:
            return lower
        d = self.discount[order]
        return max(self.levels[order][g] - d, 0) / self.total[context] + d * self.kinds[context] / self.total[context] * lower

    def nats(self, text):
        s = [32] * 3 + fold_all(text) + [32]
        return -sum(np.log(self.p(tuple(s[i - 3 : i + 1]))) for i in range(3, len(s))) / (len(s) - 3)


TEXTS = {"en": ["The cat sat on the mat. The dog ran.", "that this then there", "over the hill"], "de": ["Die Katze saß auf der Matte, über dem Hügel", "das dieser denn dort Öl"], "xx": ["𝔘𝔫𝔦 日本語 テスト"]}


@pytest.fixture(scope="module")
def toy(spark):
    docs = spark.createDataFrame([(k, t, lang) for lang, ts in TEXTS.items() for t in ts for k in (0, 1)], "doc_id long, text string, lang string").where("doc_id = 0")
    return langid.fit_models(langid.gram_counts(docs), segment=40)


def test_entropies_by_hand(toy):
    symbols = len({c for ts in TEXTS.values() for t in ts for c in [*fold_all(t), 32]})
    plain = {lang: Plain(ts, symbols) for lang, ts in TEXTS.items()}
    asked = [t or "" for t in TRICKY] + [t for ts in TEXTS.values() for t in ts]
    coded = [t.encode() for t in asked]
    nats, n, has = toy.entropies(np.frombuffer(b"".join(coded), np.uint8), np.cumsum([0, *map(len, coded)]))
    for i, t in enumerate(asked):
        assert has[i] == any(c != 32 for c in fold_all(t)) and n[i] == len(fold_all(t)) + 1
        if len(t) < 200:
            assert np.allclose(nats[i], [plain[x].nats(t) for x in toy.langs], rtol=2e-4)


def test_models_sum_to_one(toy):
    every = np.unique(np.array([c for ts in TEXTS.values() for t in ts for c in [*fold_all(t), 32]], np.uint64))
    for context in ([32, 116, 104], [97, 98, 99], [120, 32, 100]):
        head = np.uint64((context[0] << 48) | (context[1] << 32) | (context[2] << 16))
        total = np.exp(toy.logs(head | every).astype(float)).sum(0) + np.exp(toy.logs(np.array([head | np.uint64(0xFFF0)])).astype(float)).sum(0)
        assert np.allclose(total, 1, atol=2e-3)


def test_held_out(spark):
    rows = langid.op5_langid(spark, SF).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) > 0.995 * len(held) and sum(r.rejected for r in held) < 0.02 * len(held)


def test_tricky(spark, tricky, no_documents):
    known = spark.createDataFrame([(i, t, lang, "s", 0, "", "", "", "") for i, (lang, t) in enumerate((x, t) for x, ts in TEXTS.items() for t in ts)], DOCUMENTS)
    model = langid.fit(tricky.union(known))
    found = langid.with_language(tricky, model)
    assert found.columns == [*tricky.columns, "lang_pred", "score", "rejected"]
    for r in found.collect():
        letter = any(c != 32 for c in fold_all(r.text or ""))
        assert (r.lang_pred == "und") == (not letter) and 0 <= r.score <= 1 and (letter or r.score == 0)
    assert langid.with_language(no_documents, model).count() == 0
    nothing = langid.fit(no_documents)
    assert {r.lang_pred for r in langid.with_language(tricky, nothing).collect()} == {"und"}
    strange = spark.createDataFrame([(0, "zzqx jjkw vvqq xxzz kkqj qqqz wxyz jqxz")], "doc_id long, text string")
    assert langid.with_language(strange, langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))).first().rejected


def test_limits_of_all_rows(spark):
    """Every training row counts towards the limits, and a language of one row has a limit above that row's entropy."""
    texts = [" ".join(f"{'aeiou'[i * k % 5]}{'bcdfg'[(i + k) % 5]}n" for k in range(3 + i % 9)) for i in range(5000)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(9000 + i, "quxx zyzz wvw", "xx") for i in range(4)] + [(9100, "12 34", "no letter")]
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    rows = [r for r in rows if r[2] != "xx"] + [r for r in rows if r[2] == "xx"][:1]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.models.langs == ["en", "xx"]
    coded = [t.encode() for _, t, lang in rows if lang != "no letter"]
    nats = model.models.entropies(np.frombuffer(b"".join(coded), np.uint8), np.cumsum([0, *map(len, coded)]))[0]
    en = nats[:-1, 0]
    assert len(en) > 3000 and np.isclose(model.limits[0], en.mean() + 4 * en.std())
    assert nats[-1, 1] < model.limits[1] < np.inf


def test_model_of_many_grams(spark):
    """Over 1.5 million distinct grams in one language, a few in another, in files of 100,000 entries: all of them count."""
    rng = np.random.default_rng(8)
    parts = ["".join(map(chr, rng.integers(0x4E00, 0x5E00, 40_000))) for _ in range(39)]
    parts.append(parts[0][:9000])
    rows = [(i, t, "zz") for i, t in enumerate(parts)] + [(100, "qux wyv quy", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    made = langid.fit_models(langid.gram_counts(docs), segment=100_000)
    symbols = len({c for _, t, _ in rows for c in [*map(ord, t), 32]})
    plain = [Plain([t for _, t, x in rows if x == lang], symbols) for lang in ("aa", "zz")]
    assert made.langs == ["aa", "zz"] and len(plain[1].levels[4]) > 1_500_000 and made.store.bits > 4
    asked = [parts[0][:60], parts[7][900:950], parts[3][:10] + parts[5][:10], "quy wux", "nothing of this"]
    coded = [t.encode() for t in asked]
    for held in (None, langid.Remembered(2, 1)):
        nats, _, _ = made.entropies(np.frombuffer(b"".join(coded), np.uint8), np.cumsum([0, *map(len, coded)]), held)
        assert np.allclose(nats, [[p.nats(t) for p in plain] for t in asked], rtol=2e-4)


def test_remembered_grams_are_forgotten(toy):
    texts = [t for ts in TEXTS.values() for t in ts] * 3 + ["".join(map(chr, range(a, a + 900))) for a in (0x400, 0x3400, 0x5000, 0x6000, 0x7000, 0x400)]
    coded = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(coded), np.uint8), np.cumsum([0, *map(len, coded)])
    held = langid.Remembered(len(toy.langs), 1)
    held.most = 700
    assert np.allclose(toy.entropies(data, offsets, held)[0], toy.entropies(data, offsets)[0]) and len(held.values) <= 700


def test_query_by_hand(spark, sf, documents):
    """Language, score and rejection of every document of the query, by dictionaries over the training rows."""
    rows = [(r.doc_id, r.text or "", r.lang) for r in documents.collect()]
    train = [(t, x) for i, t, x in rows if zlib.crc32(str(i).encode()) % 3 != 1 and x is not None and any(c != 32 for c in fold_all(t))]
    langs = sorted({x for _, x in train})
    symbols = len({c for t, _ in train for c in fold_all(t)} | {32})
    plain = [Plain([t for t, x in train if x == lang], symbols) for lang in langs]
    for p in plain:  # each probability once
        known, of = {}, p.p
        p.p = lambda g, known=known, of=of: known[g] if g in known else known.setdefault(g, of(g))
    nats = {t: np.array([p.nats(t) for p in plain]) for t in {t for _, t, _ in rows} if any(c != 32 for c in fold_all(t))}
    own = {lang: np.array([nats[t][langs.index(lang)] for t, x in train if x == lang]) for lang in langs}
    together = sum(v.var() * len(v) for v in own.values()) / len(train)
    limit = {x: v.mean() + 4 * (v.var() if len(v) >= 30 else max(v.var(), together)) ** 0.5 for x, v in own.items()}
    found = {r.doc_id: r for r in langid.op5_langid(spark, sf).collect()}
    assert len(found) == len(rows)
    for i, t, _ in rows:
        r = found[i]
        if t not in nats:
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0, True)
            continue
        gaps = (nats[t] - nats[t].min()) * 0.5 * min(len(fold_all(t)) + 1, 60)
        best = langs[int(nats[t].argmin())]
        assert r.lang_pred == best and abs(r.score - 1 / np.exp(-gaps).sum()) < 2e-3
        assert r.rejected == (nats[t].min() > limit[best]) or abs(nats[t].min() - limit[best]) < 1e-3
