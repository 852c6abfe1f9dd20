import random
import re

from skylattice.llm.line_dedup import dedup_lines
from skylattice.llm.setjoin import Rule

from .samples import documents, empty


def by_hand(rows, part, over):
    """Texts after each line that an earlier one is alike to is taken out."""
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    seen, out = [], []
    for key, text in rows:
        keep = []
        for line in (text or "").split("\n"):
            own = set(re.findall(r"[^\x20\x09-\x0D]+", low(line)))
            if not own:
                keep.append(line)
                continue
            if not any(over * len(own & s) >= part * len(own | s) for s in seen):
                keep.append(line)
            seen.append(own)
        out.append((key, text and "\n".join(keep)))
    return out


def sample(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(120)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(1, 30))] for _ in range(25)]
    rows = []
    for i in range(60):
        own = []
        for _ in range(r.randint(1, 8)):
            line = list(r.choice(base)) if r.random() < 0.6 else [r.choice(vocabulary) for _ in range(r.randint(1, 25))]
            for _ in range(r.randint(0, 3)):
                line[r.randrange(len(line))] = r.choice(vocabulary)
            r.shuffle(line)
            own.append(r.choice(["", "  "]) + " ".join(line).capitalize())
        rows.append((i, r.choice(["\n", "\n\n", "\n \n"]).join(own)))
    return rows + [(60, None), (61, ""), (62, "\n"), (63, "w1 w2\nw2 W1"), (64, "w1 w2")]


def test_against_all_pairs(spark):
    for seed, part, over in ((1, 80, 100), (2, 50, 100)):
        rows = sample(seed)
        docs = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, record int")
        got = dedup_lines(docs.repartition(5), rule=Rule(part, over), counts=True)
        want = by_hand(rows, part, over)
        found = {r["doc_id"]: r for r in got.collect()}
        assert {k: r["text"] for k, r in found.items()} == dict(want)
        for (k, t), (_, w) in zip(rows, want, strict=True):
            n = 0 if t is None else t.count("\n") + 1
            assert found[k]["n_lines"] == n
            if w:
                assert found[k]["n_removed"] == t.count("\n") - w.count("\n")


def test_repeated_rows_and_awkward_tables(spark):
    docs = spark.createDataFrame([(1, "a b c\nd e f", "x"), (1, "a b c\nd e f", "x"), (1, "other words", "x"), (None, "d e f", "x"), (None, None, None)], "doc_id long, text string, version string")
    got = sorted((str(r["doc_id"]), str(r["text"]), str(r["version"])) for r in dedup_lines(docs).collect())
    assert got == sorted([("1", "a b c", "x"), ("1", "", "x"), ("1", "other words", "x"), ("None", "d e f", "x"), ("None", "None", "None")])
    assert dedup_lines(empty(spark)).count() == 0
    big = documents(spark, 40)
    assert dedup_lines(big).columns == big.columns and dedup_lines(big).count() == big.count()


def test_keys_that_need_a_number(spark):
    """Texts, repeated keys and keys far apart: the order of lines is that of keys all the same."""
    rows = sample(3)
    named = [(f"k{i:03d}", t) for i, t in rows]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame(named, "doc_id string, text string").repartition(5)).collect()}
    assert got == dict(by_hand(named, 80, 100))
    far = [((i - 30) * (1 << 57), t) for i, t in rows]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame(far, "doc_id long, text string").repartition(5)).collect()}
    assert got == dict(by_hand(far, 80, 100))
    below = [(i - 5, t) for i, t in rows]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame(below, "doc_id int, text string").repartition(5)).collect()}
    assert got == dict(by_hand(below, 80, 100))
