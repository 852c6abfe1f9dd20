import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from skylattice.llm import langid
from skylattice.llm.langid import fit, grams, identify, keep_identified, train

from .samples import documents, empty


def corpus(spark, n=400):
    r = random.Random(1)
    parts = {"aa": "the ing tion ou er st".split(), "bb": "sch ung ein über ge zu".split(), "cc": "que eau les ré ment oui".split()}
    rows = []
    for i in range(n):
        lang = r.choice(list(parts))
        rows.append((i, " ".join("".join(r.choice(parts[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(3, 80))), lang))
    rows += [(n, None, "aa"), (n + 1, "12 !!", "bb"), (n + 2, "", None), (n + 3, "the ing", None), (None, "que eau", "cc")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_grams_of_a_text():
    keys, at, letters = grams(pa.array(["Ab, 1c", None, "..", "ab c"]))
    text = ["".join(chr((int(k) >> (16 * (3 - i))) & 0xFFFF) for i in range(4)) for k in keys]
    assert text[: at[1]] == ["   a", "  ab", " ab ", "ab c", "b c "]
    assert at.tolist() == [0, 5, 5, 5, 10] and letters.tolist() == [3, 0, 0, 3] and text[:5] == text[5:]


def test_probabilities_sum_to_one(spark):
    docs = corpus(spark)
    model = train(docs.where("doc_id < 300"), docs.where("doc_id >= 300"))
    keys, _, _ = grams(pa.array([r["text"] for r in docs.limit(5).collect()]))
    symbols = np.unique(np.concatenate([grams(pa.array([r["text"] for r in docs.collect()]))[0] & np.uint64(0xFFFF)]))
    for key in keys[:40]:
        history = key & ~np.uint64(0xFFFF)
        p = np.exp(model.log_probabilities(history | symbols).astype(float)).sum(axis=0)
        assert (p < 1.0001).all() and (p > 0.5).all()


def test_held_out_accuracy(spark):
    docs = corpus(spark)
    got = identify(docs, fit(docs)).collect()
    labelled = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 400]
    assert sum(r["lang_pred"] == r["lang"] for r in labelled) >= 0.98 * len(labelled)
    assert all(0 <= r["score"] <= 1 for r in got)
    none = {r["doc_id"]: r for r in got}
    for i in (400, 401, 402):
        assert none[i]["lang_pred"] == "und" and none[i]["score"] == 0 and none[i]["rejected"]
    kept = keep_identified(docs, fit(docs))
    assert kept.columns == docs.columns and kept.where("doc_id < 400").count() >= 395


def test_awkward_tables(spark):
    docs = documents(spark)
    assert identify(docs, fit(docs)).count() == docs.count()
    model = fit(empty(spark))
    assert identify(empty(spark), model).count() == 0
    assert {r["lang_pred"] for r in identify(docs.limit(3), model).collect()} == {"und"}


def brute_force(texts, keys, uniform=None):
    """Interpolated Kneser-Ney log probabilities of one language, n-gram by n-gram, from all of its 4-grams."""
    tables = [Counter(k for t in texts for k in grams(pa.array([t]))[0].tolist())]
    for m in (3, 2, 1):
        tables.append(Counter(k & ((1 << (16 * m)) - 1) for k in tables[-1]))
    symbols, facts = len(tables[-1]), []
    for table in tables:
        seen = Counter(table.values())
        d = min(0.9, max(0.1, seen[1] / (seen[1] + 2 * seen[2]))) if seen[1] else 0.5
        total, kinds = Counter(), Counter()
        for k, n in table.items():
            total[k >> 16] += n
            kinds[k >> 16] += 1
        facts.append((table, d, total, kinds))

    def p(k, i):
        if i == 4:
            return uniform or 1 / (symbols + 1)
        table, d, total, kinds = facts[i]
        lower = p(k & ((1 << (16 * (3 - i))) - 1), i + 1)
        h = k >> 16
        return (max(table[k] - d, 0) + d * kinds[h] * lower) / total[h] if total[h] else lower

    return np.log([p(k, 0) for k in keys])


def test_every_gram_counts(spark):
    """More different 4-grams than any bound on them: rare ones shape the model like all others."""
    r = random.Random(5)
    signs = [chr(c) for c in range(0x4E00, 0x5200)]
    text = "".join(r.choices(signs, k=150_000))
    model = train(spark.createDataFrame([("zh", text), ("zh", text[:1000])], "lang string, text string"), spark.createDataFrame([], "lang string, text string"))
    keys = grams(pa.array([text[:300] + text[70_000:71_000] + "".join(r.choices(signs, k=100))]))[0]
    assert np.allclose(model.log_probabilities(keys)[:, 0], brute_force([text, text[:1000]], keys.tolist()), atol=1e-4)


def test_many_languages_in_small_parts(spark, monkeypatch):
    """No language goes, and a model in parts that no worker holds together says the same as one in a single part."""
    r = random.Random(6)
    rows = [(f"l{i:03}", " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(6))) for i in range(300)]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    whole = train(docs, docs.limit(0))
    assert whole.languages == [lang for lang, _ in rows]
    keys = np.unique(grams(pa.array([rows[299][1], rows[7][1], "xyz abc"]))[0])
    for i in (7, 299):
        assert np.allclose(whole.log_probabilities(keys)[:, i], brute_force([rows[i][1]], keys.tolist(), np.exp(whole.log_uniform)), atol=1e-4)
    few = docs.where("doc_id < 12")
    whole = train(few, docs.limit(0))
    monkeypatch.setattr(langid, "PART_CELLS", 1 << 10)
    monkeypatch.setattr(langid, "HELD_BYTES", 0)
    parts = train(few, docs.limit(0))
    assert not parts.held and whole.held and len(parts.blocks[0][0].grams.parts) > 1
    assert np.array_equal(parts.log_probabilities(keys), whole.log_probabilities(keys))
    for model in (whole, parts):
        got = {x["doc_id"]: x["lang_pred"] for x in identify(few, model).collect()}
        assert got == {i: lang for i, (lang, _) in enumerate(rows[:12])}


def test_every_language_has_a_limit(spark, monkeypatch):
    """A language that a hash over all rows would leave without calibration rows rejects what is unlike it."""
    monkeypatch.setattr(langid, "CALIBRATION_ROWS", 1)
    r = random.Random(8)
    parts = {"aa": "the ing tion ou er st".split(), "bb": "sch ung ein uber ge zu".split()}
    rows = [(i, " ".join("".join(r.choices(parts[x], k=2)) for _ in range(30)), x) for i, x in enumerate(["aa"] * 200 + ["bb"] * 40)]
    model = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert np.isfinite(model.mean).all() and (model.deviation > 0).all()
    junk = ["".join(r.choices("qwxzvkj", k=400)), rows[0][1], rows[220][1]]
    assert model.predict(pa.array(junk))[3].tolist() == [True, False, False]


def test_limits_of_few_rows():
    r = np.random.default_rng(1)
    best, low = np.repeat([0, 1], [100, 3]), np.concatenate([r.normal(2, 0.1, 100), r.normal(5, 0.1, 3)])
    mean, deviation = langid._limits(3, best, low)
    assert np.allclose([mean[0], deviation[0]], [low[:100].mean(), low[:100].std()])
    assert np.isclose(mean[1], low[100:].mean()) and 0.05 < deviation[1] < 0.3
    assert np.allclose([mean[2], deviation[2]], [low.mean(), low.std()])
    assert np.isinf(langid._limits(2, best[:0], low[:0])[0]).all()


def plain_kneser_ney(counts, symbols):
    """p(last symbol | the three before) of one language by the definition, from counts of 4-grams (tuples)."""
    tables = {4: counts}
    for m in (3, 2, 1):
        tables[m] = Counter(g[1:] for g in tables[m + 1])
    discount = {}
    for m, t in tables.items():
        once, twice = sum(n == 1 for n in t.values()), sum(n == 2 for n in t.values())
        discount[m] = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5
    totals = {m: Counter() for m in tables}
    types = {m: Counter() for m in tables}
    for m, t in tables.items():
        for g, n in t.items():
            totals[m][g[:-1]] += n
            types[m][g[:-1]] += 1

    def p(g):
        m = len(g)
        if not m:
            return 1 / (symbols + 1)
        h = g[:-1]
        if not totals[m][h]:
            return p(g[1:])
        own = max(tables[m][g] - discount[m], 0) if g in tables[m] else 0
        return own / totals[m][h] + discount[m] * types[m][h] / totals[m][h] * p(g[1:])

    return p


def test_probabilities_against_the_definition(spark):
    r = random.Random(11)
    texts = {lang: ["".join(r.choice(letters) for _ in range(r.randint(3, 60))) for _ in range(15)] for lang, letters in (("xx", "aabbcdé "), ("yy", "ab xyzü"))}
    rows = spark.createDataFrame([(lang, t) for lang, own in texts.items() for t in own], "lang string, text string")
    model = train(rows, rows.limit(0))
    split = lambda key: tuple((int(key) >> (16 * i)) & 0xFFFF for i in (3, 2, 1, 0))
    counts = {lang: Counter(split(k) for k in grams(pa.array(own))[0]) for lang, own in texts.items()}
    symbols = len({g[-1] for c in counts.values() for g in c})
    keys = grams(pa.array([*texts["xx"], *texts["yy"], "new zeta text", "aqa baq"]))[0]
    got = np.exp(model.log_probabilities(keys))
    for i, lang in enumerate(model.languages):
        p = plain_kneser_ney(counts[lang], symbols)
        assert got[:, i] == pytest.approx([p(split(k)) for k in keys], rel=1e-4)
