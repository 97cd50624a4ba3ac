import math
from collections import defaultdict
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import packing, sharding


@pytest.mark.parametrize("histogram,k", [({1: 5, 3: 2, 7: 1, 8: 9}, 2), ({5: 1}, 3), ({}, 2), ({i: (i * 7) % 5 + 1 for i in range(1, 13)}, 4), ({2: 0, 3: 4}, 1)])
def test_boundaries_are_optimal(histogram, k):
    got = packing.boundaries(histogram, k)
    lengths = [n for n, c in histogram.items() if c]
    best = min((packing.bound_padding(histogram, list(c)) for j in range(1, k + 1) for c in combinations(lengths, j)), default=0)
    assert len(got) <= k and packing.bound_padding({n: histogram[n] for n in lengths}, got) == best


def check(rows, docs, max_len, budget, lengths):
    per_doc, batches = defaultdict(list), defaultdict(list)
    for r in rows:
        per_doc[r["doc_id"]].append(r)
        batches[r["bucket"], r["batch"]].append(r)
        assert 1 <= r["n_tokens"] <= r["bucket_len"] <= max_len
    for members in batches.values():
        assert sum(m["bucket_len"] for m in members) <= max(budget, members[0]["bucket_len"])
        assert sorted(m["place"] for m in members) == list(range(len(members)))
    for b in {k[0] for k in batches}:
        numbers = sorted(k[1] for k in batches if k[0] == b)
        assert numbers == list(range(len(numbers)))
        full = [len(batches[b, n]) for n in numbers[:-1]]
        assert all(n == max(1, budget // batches[b, numbers[0]][0]["bucket_len"]) for n in full)
    for d, n in lengths.items():
        assert sum(r["n_tokens"] for r in per_doc[d]) == n


def test_pack(docs):
    lengths = {r["doc_id"]: r["n"] for r in docs.select("doc_id", (packing.n_tokens(F.col("text")) + 1).alias("n")).collect()}
    rows = packing.pack(docs, max_len=300, buckets=5, budget=2000).collect()
    check(rows, docs, 300, 2000, lengths)
    assert len(rows) == sum(math.ceil(n / 300) for n in lengths.values())
    histogram = defaultdict(int)
    for r in rows:
        histogram[r["n_tokens"]] += 1
    assert sorted({r["bucket_len"] for r in rows}) == packing.boundaries(histogram, 5)
    total = packing.padding(packing.pack(docs, max_len=300, buckets=5, budget=2000)).agg(F.sum("tokens"), F.sum("padded")).first()
    assert total[0] == sum(lengths.values()) and total[1] - total[0] == packing.bound_padding(histogram, packing.boundaries(histogram, 5))


def test_pack_odd_rows(odd, empty):
    rows = packing.pack(odd, max_len=64, budget=256).collect()
    n = {r["doc_id"]: 0 for r in rows}
    for r in rows:
        n[r["doc_id"]] += r["n_tokens"]
    assert n[1] == 1 and n[2] == 1 and n[3] == 1 and n[4] == 3 and n[5] == 6 and n[9] == 100_001
    assert packing.pack(empty).count() == 0
    exact = packing.pack(odd, max_len=3, buckets=2, budget=1).collect()
    assert {r["place"] for r in exact} == {0}
    assert packing.pack(odd, length=F.lit(10)).agg(F.sum("n_tokens")).first()[0] == 11 * odd.count()


def brute_shard(key, weights):
    best = None
    for s, w in enumerate(weights):
        if w <= 0:
            continue
        h = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)
        h = xxhash.xxh64_intdigest(s.to_bytes(4, "little"), h)
        draw = w / -math.log(((h >> 11) + 0.5) / (1 << 53))
        best = max(best or (draw, s), (draw, s))
    return best[1]


def test_shards(docs):
    weights = [1.0] * 24
    rows = sharding.assign(docs, weights).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    import zlib

    slots = defaultdict(list)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert r["shard"] == brute_shard(r["doc_id"], weights) and r["grown_shard"] == brute_shard(r["doc_id"], [1.0] * 25)
        assert r["grown_shard"] in (r["shard"], 24)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights(spark):
    keys = spark.range(20_000)
    got = {r["s"]: r["count"] for r in keys.select(sharding.rendezvous(F.col("id"), [1.0, 2.0, 0.0, 1.0]).alias("s")).groupBy("s").count().collect()}
    assert 2 not in got and abs(got[1] - 10_000) < 400 and abs(got[0] - 5000) < 300
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("id"), [0.0])


def test_shard_odd_rows(odd, empty, spark, tmp_path):
    rows = sharding.assign(odd, [1.0] * 3).collect()
    assert len(rows) == odd.count() and len({r["shard"] for r in rows if r["doc_id"] is None}) == 1
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] in (1, 2)} == {(8, 0)}
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert sharding.assign(empty, [1.0]).count() == 0
    sharding.write_shards(odd, str(tmp_path / "out"), [1.0, 1.0])
    assert spark.read.parquet(str(tmp_path / "out")).count() == odd.count()


@pytest.mark.parametrize("copies", [1 << 16, 7])
def test_numbers_of_equal_rows(spark, monkeypatch, copies):
    """One row holds nine tenths of all: numbers have no gap, and depend on neither order nor partitions."""
    from quire.llm import common

    monkeypatch.setattr(common, "COPIES", copies)
    rows = [(1, "same", None)] * 900 + [(1, f"x{k}", k) for k in range(60)] + [(None, "y", 1)] * 40
    out = []
    for parts in (1, 5):
        df = spark.createDataFrame(rows[::-1] if parts == 1 else rows, "g int, name string, k int").repartition(parts)
        got = common.numbered(df, ["g"], ["name", "k"], "i").collect()
        assert sorted(r["i"] for r in got if r["g"] == 1) == list(range(960)) and sorted(r["i"] for r in got if r["g"] is None) == list(range(40))
        out.append(sorted(map(str, got)))
    assert out[0] == out[1]
    assert common.numbered(df.where("false"), ["g"], ["name", "k"], "i").count() == 0


def test_repeated_rows_get_places_of_their_own(spark):
    df = spark.createDataFrame([(None, "")] * 500 + [(k, "a b c") for k in range(50)], "doc_id long, text string")
    packed = packing.pack(df, max_len=16, budget=64)
    assert packed.count() == 550 and packed.select("bucket", "batch", "place").distinct().count() == 550
    shards = sharding.assign(df, [1.0] * 4)
    assert shards.select("shard", "slot").distinct().count() == 550
