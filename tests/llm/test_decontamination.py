import random
import re

import pytest
from pyspark.sql import functions as F

from quire.llm import decontamination as d


@pytest.fixture(scope="module")
def words():
    r = random.Random(5)
    return ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]


def runs(equal, need):
    """Words in any stretch of at least ``need`` words, four fifths of them equal, as maximal runs: the rule itself, over all stretches."""
    before = [0]
    for e in equal:
        before.append(before[-1] + bool(e))
    inside = [False] * len(equal)
    for a in range(len(equal)):
        for b in range(a + need, len(equal) + 1):
            if 5 * (before[b] - before[a]) >= 4 * (b - a):
                inside[a:b] = [True] * (b - a)
    out, a = [], None
    for i, x in enumerate([*inside, False]):
        if x and a is None:
            a = i
        elif not x and a is not None:
            out.append((a, i, before[i] - before[a]))
            a = None
    return out


def brute(docs, tests, rule=d.Rule()):
    """The rule on every diagonal, without seeds."""
    out = set()
    for i, t in docs:
        x = re.findall(r"[^\W_]+", (t or "").lower())
        for k, s in tests:
            y = re.findall(r"[^\W_]+", (s or "").lower())
            need = max(rule.least, min(rule.words, len(y)))
            for diagonal in range(-len(y) + 1, len(x)):
                a, b = max(0, -diagonal), min(len(y), len(x) - diagonal)
                equal = [y[p] == x[p + diagonal] for p in range(a, b)]
                if 5 * sum(equal) >= 4 * need:
                    out |= {(i, k, a + start + diagonal, a + start, end - start, same) for start, end, same in runs(equal, need)}
    return out


def planted(words):
    r = random.Random(9)
    tests = [(k, " ".join(r.choice(words) for _ in range(25))) for k in range(6)] + [(6, None), (7, ""), (8, "a b"), (9, " ".join(words[:8]))]
    docs = []
    for i in range(40):
        body = [r.choice(words) for _ in range(120)]
        if i % 2:
            passage = tests[i % 6][1].split()
            for p in r.sample(range(25), i % 5):
                passage[p] = "zzz"
            at = r.randrange(100)
            body[at:at] = [w.upper() + "," for w in passage]
        docs.append((i, " ".join(body)))
    return docs + [(100, None), (101, ""), (102, " ".join(words[:8]))], tests


def test_overlaps_match_brute_force(spark, words):
    docs, tests = planted(words)
    got = d.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(tests, "item_id long, text string"))
    rows = {tuple(r) for r in got.collect()}
    assert rows == brute(docs, tests)
    assert {r[0] for r in rows} == {i for i in range(40) if i % 2} | {102}


def test_blocks_give_the_same(spark, words, monkeypatch):
    docs, tests = planted(words)
    x, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(tests, "item_id long, text string")
    one = {tuple(r) for r in d.overlaps(x, y).collect()}
    monkeypatch.setattr(d, "BLOCK_BYTES", 300)
    assert {tuple(r) for r in d.overlaps(x, y).collect()} == one
    kept = {r["doc_id"] for r in d.decontaminate(x, y).collect()}
    assert kept == {i for i, _ in docs} - {r[0] for r in one}


def test_real_tables(spark, docs, sf_dir):
    tests = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.limit(40).collect()]
    x = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in d.overlaps(x, tests).collect()} == brute(rows, [(r["item_id"], r["text"]) for r in tests.collect()])
    verbatim = {r["doc_id"] for r in docs.join(tests.select(F.col("text").alias("t")), F.instr("text", F.col("t")) > 0).collect()}
    found = {r["doc_id"] for r in d.overlaps(docs, tests).collect()}
    assert verbatim <= found


def test_odd_rows(odd, empty, spark, sf_dir):
    tests = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert d.overlaps(odd, tests).count() == 0 and d.decontaminate(odd, tests).count() == odd.count()
    assert d.overlaps(empty, tests).count() == 0 and d.overlaps(odd, tests.limit(0)).count() == 0
    assert d.decontaminate(odd, tests.limit(0)).columns == odd.columns
    same = odd.select("doc_id", "text").where("doc_id = 9").withColumnRenamed("doc_id", "item_id")
    assert {r["doc_id"] for r in d.overlaps(odd.where("doc_id in (4, 5)"), same).collect()} == set()


def test_every_stretch_of_the_rule_is_accepted():
    """The rule itself, over all stretches of a diagonal, and a 15-word item with one word replaced anywhere."""
    r = random.Random(11)
    for _ in range(1500):
        n = r.randrange(1, 34)
        equal = [r.random() < 0.8 for _ in range(n)]
        need = max(6, min(13, r.randrange(1, 26)))
        assert d.accepted_stretches(d.np.array(equal, dtype=bool), need, 0.8) == runs(equal, need)
    item = [f"w{k}" for k in range(15)]
    index = d.Index([(1, " ".join(item))], d.Rule())
    for k in range(15):
        assert index.search(" ".join(["x", "y", *item[:k], "zzz", *item[k + 1 :], "z"]))


def test_recall_of_substituted_passages():
    """Passages of 13 to 50 words with up to a fifth of them replaced: at least 0.99 of those that meet the rule are found, in each case."""
    r = random.Random(4)
    for n in (13, 20, 30, 50):
        items = [[f"t{n}x{k}x{p}" for p in range(n)] for k in range(200)]
        index = d.Index([(k, " ".join(words)) for k, words in enumerate(items)], d.Rule())
        for share in (0, 0.05, 0.1, 0.15, 0.2):
            met = hit = 0
            for k, words in enumerate(items):
                copy = list(words)
                for p in r.sample(range(n), int(n * share)):
                    copy[p] = "zzz"
                if runs([a == b for a, b in zip(copy, words, strict=True)], 13):
                    met += 1
                    hit += any(row[0] == k for row in index.search(" ".join(["a", "b", *copy, "c"])))
            assert met and hit >= 0.99 * met, (n, share, hit, met)


def test_many_hits_of_one_seed():
    """Repeated words and items that share their start: hits are spread in bounded chunks, equal items are searched once."""
    index = d.Index([(1, "go " * 200), (2, "go " * 200), *[(k, "the very same long start of a question " + f"a{k} b{k} c{k} d{k} e{k} f{k}") for k in range(3, 400)]], d.Rule())
    assert len(index.items) == 398 and index.item_ids[0] == [1, 2]
    whole = index.search("go " * 2000)
    index.HITS = 1000
    assert index.search("go " * 2000) == whole and {k for k, *_ in whole} == {0} and len(whole) == 2200 - 2 * 12 - 1
    assert index.search("the very same long start of a question " + "x " * 50) == []
    assert [r[0] for r in index.search("the very same long start of a question a9 b9 c9 d9 e9 f9")] == [index.item_ids.index([9])]


def test_equal_items_give_an_overlap_each(spark, words):
    text = " ".join(words[:20])
    tests = spark.createDataFrame([(1, text), (2, text.upper()), (2, text)], "item_id long, text string")
    rows = d.overlaps(spark.createDataFrame([(5, text), (5, text), (None, text)], "doc_id long, text string"), tests).collect()
    assert sorted((str(r["doc_id"]), r["item_id"]) for r in rows) == sorted((str(i), k) for i in (5, 5, None) for k in (1, 2, 2))
