import re

import numpy as np
import pytest
import xxhash

from quire.llm import bitslice, simhash
from quire.llm.components import components


def brute_fingerprint(text, words=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    token = re.findall(r"[^\x20\x09-\x0D]+", low)
    runs = [" ".join(token[i : i + words]) for i in range(max(1, len(token) - words + 1))] if token else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, sets, radius=3):
    fp = [brute_fingerprint(t) for _, t in rows]
    s = sets(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= radius:
                s.join(i, j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = s.find(i)
        if d is not None and d < least.get(r, 1 << 62):
            least[r] = d
    return sorted((str(d), f"{fp[i]:016x}", least.get(s.find(i))) for i, (d, _) in enumerate(rows))


def result(df):
    return sorted((str(r[0]), r[1], r[2]) for r in df.collect())


def test_components_match_brute_force(docs, sets):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert result(simhash.simhash_components(docs)) == brute_components(rows, sets)


def test_odd_rows(odd, empty, sets):
    short = odd.where("length(coalesce(text, '')) < 1000")
    rows = [(r["doc_id"], r["text"]) for r in short.select("doc_id", "text").collect()]
    assert result(simhash.simhash_components(short)) == brute_components(rows, sets)
    assert simhash.simhash_components(odd).count() == odd.count()
    assert simhash.simhash_components(empty).count() == 0
    assert simhash.deduplicate(empty).columns == empty.columns


@pytest.mark.parametrize("radius", [0, 1, 3, 5, 18])
def test_close_pairs(radius):
    r = np.random.default_rng(radius)
    fps = r.integers(0, 1 << 63, 700, dtype=np.uint64)
    fps[::3] = fps[1::3][: len(fps[::3])][0] ^ (np.uint64(1) << r.integers(0, 64, len(fps[::3])).astype(np.uint64))
    cells = np.sort(r.integers(0, 6, 700))
    got = [(int(x), int(y)) for a, b in bitslice.close_pairs(cells, fps, radius) for x, y in zip(a, b, strict=True)]
    want = {(i, j) for j in range(700) for i in range(j) if cells[i] == cells[j] and int(fps[i] ^ fps[j]).bit_count() <= radius}
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("n", [1, 1 << 25, 1 << 34])
def test_key_plans_lose_no_pair(n):
    masks = simhash.key_plan(n, 3)
    r = np.random.default_rng(1)
    for _ in range(300):
        flips = sum(1 << int(b) for b in r.choice(64, 3, replace=False))
        assert any(flips & m == 0 for m in masks)


def test_large_cells_are_dealt_without_loss(spark, monkeypatch):
    base = 0x0123456789ABCDEF
    values = sorted({base ^ (1 << i) ^ (1 << j) for i in range(40) for j in range(i)})
    fps = spark.createDataFrame([(v,) for v in values], "fp long").coalesce(2)
    want = {r["node"]: r["root"] for r in components(simhash.links(fps, 3)).collect()}
    monkeypatch.setattr(simhash, "CELL_WEIGHT", 64 * simhash.FP_WEIGHT)
    assert {r["node"]: r["root"] for r in components(simhash.links(fps, 3)).collect()} == want
    assert len(want) == len(values) and len(set(want.values())) == 1


@pytest.mark.parametrize("light", [1 << 17, 0])
def test_component_shapes(spark, sets, monkeypatch, light):
    monkeypatch.setattr("quire.llm.components.LIGHT", light)
    n = 60
    chain = [(i, i + 1) for i in range(0, 30)]
    star = [(40, i) for i in range(41, 55)]
    edges = spark.createDataFrame(chain + star + [(58, 57), (5, 5), (None, 3), (57, 58)], "u long, v long")
    s = sets(n)
    for a, b in [*chain, *star, (57, 58)]:
        s.join(a, b)
    assert {r["node"]: r["root"] for r in components(edges).collect()} == {i: s.find(i) for i in [*range(31), *range(40, 55), 57, 58]}
    assert components(edges.where("u < 0")).count() == 0


def brute_survivors(rows, sets, words=5, similarity=0.8):
    shingles = [frozenset(simhash.shingles((t or "").encode(), words)) for _, t in rows]
    s = sets(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            both = len(shingles[i] & shingles[j])
            if shingles[i] == shingles[j] and rows[i][1] == rows[j][1] or both and both >= similarity * len(shingles[i] | shingles[j]):
                s.join(i, j)
    best = {}
    for i, (d, _) in enumerate(rows):
        r = s.find(i)
        key = (d is None, d or 0)
        best[r] = min(best.get(r, key), key)
    return sorted(str(None if k[0] else k[1]) for k in best.values())


def test_deduplicate_matches_brute_force(docs, sets):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = sorted(str(r["doc_id"]) for r in simhash.deduplicate(docs).collect())
    assert got == brute_survivors(rows, sets)


def test_deduplicate_odd_rows(odd):
    kept = simhash.deduplicate(odd).collect()
    assert sorted(str(r["doc_id"]) for r in kept if r["text"] and "one two" == r["text"]) == ["4"]
    assert [r["doc_id"] for r in kept if r["text"] and r["text"].startswith("lorem")] == [9]
    assert [r["doc_id"] for r in kept if not r["text"]] == [1]
    assert all(r["node"] == "x" and r["fp"] == "y" for r in kept)


def test_near_copies_go(spark):
    r = np.random.default_rng(3)
    words = [f"w{i}" for i in range(5000)]
    base = [[words[k] for k in r.integers(0, 5000, 400)] for _ in range(5)]
    rows = []
    for g, text in enumerate(base):
        for c in range(30):
            t = list(text)
            for p in r.choice(400, 4, replace=False)[: c % 5]:
                t[p] = "changed"
            rows.append((g * 100 + c, " ".join(t)))
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(k["doc_id"] for k in kept) == [0, 100, 200, 300, 400]


def test_near_copies_with_repeated_lines_go(spark):
    r = np.random.default_rng(12)
    rows = []
    for g in range(20):
        text = [f"w{k}" for k in r.integers(0, 50_000, 300)]
        rows += [(2 * g, " ".join(text)), (2 * g + 1, " ".join(text + text[-8:] * 100))]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(k["doc_id"] for k in kept) == [2 * g for g in range(20)]


def test_look_alikes_do_not_end_the_search(spark):
    """11 families of 60 texts of Jaccard similarity 88/112; ten pairs of one family share a word more (89/111)."""
    rows = []
    for g in range(11):
        for c in range(60):
            own = [f"o{g}x{c}x{k}" for k in range(12)]
            if g == 0 and c < 20:
                own[0] = f"pair{c // 2}"
            rows.append((g * 100 + c, " ".join([f"f{g}x{k}" for k in range(88)] + own)))
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), words=1).collect()
    assert sorted(k["doc_id"] for k in kept) == [i for i, _ in rows if not (i < 20 and i % 2)]


def test_hot_families_are_dealt_without_loss(spark, monkeypatch, sets):
    """Cells far beyond the weight that one comparison takes: a family of near copies, one of look-alikes, and links between them."""
    r = np.random.default_rng(8)
    common = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(90):
        text = list(common)
        text[int(r.integers(0, 60))] = f"x{i}"
        rows.append((i, " ".join(text)))
    for i in range(90, 150):
        rows.append((i, " ".join(common[:44] + [f"y{i}x{k}" for k in range(16 if i % 10 else 5)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_survivors(rows, sets, words=1)
    monkeypatch.setattr(simhash, "BANDS", 12)
    monkeypatch.setattr(simhash, "ROWS", 1)
    monkeypatch.setattr(simhash, "STEPS", ((3, False), (12, True)))
    for weight in (1 << 21, 1500):
        monkeypatch.setattr(simhash, "CELL_WEIGHT", weight)
        assert sorted(str(k["doc_id"]) for k in simhash.deduplicate(df, words=1).collect()) == want


def test_null_and_empty_texts_of_one_id_are_one(spark):
    rows = [(1, None, "a"), (1, "", "b"), (2, "x y", "c"), (2, "x y", "d"), (None, None, "e")]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, node string")).collect()
    assert sorted((k["doc_id"], k["text"] or "") for k in kept) == [(1, ""), (2, "x y")]


def test_hot_keys_are_joined_by_broadcast(spark, monkeypatch):
    from pyspark.sql import functions as F

    from quire.llm import common

    monkeypatch.setattr(common, "HOT", 16)
    rows = spark.range(2000).select(F.when(F.col("id") % 10 > 0, 7).otherwise(F.col("id")).alias("k"), "id").union(spark.range(1).selectExpr("cast(-5 as long) k", "id"))
    values = rows.where("k >= 0").groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 2)
    inner = common.skew_join(rows, values, "k", "n", 2001)
    assert inner.count() == 2000 and inner.where("v <> 2 * k").count() == 0 and inner.where("k = 7").count() == 1800
    outer = common.skew_join(rows, values, "k", "n", 2001, "left")
    assert outer.count() == 2001 and outer.where("v is null").count() == 1


def test_screen_lets_every_key_through(spark):
    from pyspark.sql import functions as F

    from quire.llm.common import screened

    rows = spark.range(20_000).select(F.xxhash64("id").alias("h"), "id")
    seen = screened(rows, rows.where("id % 100 = 0").select(F.col("h").alias("key")), "h", "may")
    assert seen.where("id % 100 = 0 and not may").count() == 0 and seen.where("may").count() < 3000
    assert screened(rows, rows.where("false").select("h"), "h", "may").where("may").count() == 0


def test_hot_keys_name_their_rows(spark):
    """Rows of hot keys are told apart by the keys, not by a join that writes all other rows; null keys and keys without a value stay in a left join."""
    from quire.llm import common

    rows = spark.range(5_000).selectExpr("case when id < 3000 then 7 when id < 3001 then null else id end as k", "id")
    values = spark.createDataFrame([(7, 3_000, "hot"), (4_000, 1, "few"), (9_999, 0, "none")], "k long, n long, v string")
    for how in ("inner", "left"):
        got = common.skew_join(rows, values, "k", "n", 5_000, how)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftAnti" not in plan and "Union" in plan
        assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(values, "k", how).select(*got.columns).collect()))
    none = common.skew_join(rows.where("k <> 7"), values.where("n < 100"), "k", "n", 1_000_000, "left")
    assert "Union" not in none._jdf.queryExecution().optimizedPlan().toString() and none.count() == 1_999
