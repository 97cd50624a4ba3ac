import zlib
from collections import Counter
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import language as L
from quire.llm import urls as U

D = "/root/testdata/sf0.01"


def brute_vector(text):
    out, prev = np.zeros(L.DIMS), None
    seq = [0]
    for c in text.lower():
        c = ord(c) if c.isalpha() else 0
        if c or seq[-1]:
            seq.append(c)
    if seq[-1]:
        seq.append(0)
    for a, b, c in zip(seq, seq[1:], seq[2:], strict=False):
        out += np.roll(L.letter_vector(a), 2).astype(int) * np.roll(L.letter_vector(b), 1) * L.letter_vector(c)
    return out


@pytest.mark.parametrize("limit", [4096, 7])
def test_bundles_match_brute_force(monkeypatch, limit):
    monkeypatch.setattr(L, "GRAMS", limit)
    texts = ["Hello, world", "", "ça va? -- Ça va!", "12 34", "a", "漢字 kana ß", " x"]
    e = L.Encoder()
    owner, gram, triples, has = e.grams(texts)
    got = e.bundle(owner, gram, triples, len(texts))
    for k, t in enumerate(texts):
        assert np.array_equal(got[k], brute_vector(t)), t
    assert has.tolist() == [True, False, True, False, True, True, True]


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = L.predict(docs.drop("lang", "source"), L.train(docs)).collect()
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in rows if r["held_out"]]) >= 0.98


def test_held_out_rows_teach_nothing(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    one = L.train(docs)
    other = L.train(docs.withColumn("text", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit("zzz")).otherwise(F.col("text"))))
    assert all(np.array_equal(one[k], other[k]) for k in one) and set(one) == set(other)


def test_language_odd_rows(odd, empty, spark):
    model = L.train(odd)
    rows = L.predict(odd, model).collect()
    assert len(rows) == odd.count() and {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert {r["score"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0.0}
    assert L.train(empty) == {} and {r["lang_pred"] for r in L.predict(odd, {}).collect()} == {"und"}
    assert L.predict(empty, model).count() == 0


URLS = [
    (1, "https://WWW.Example.com/en/7?x"), (2, "http://a.example.com/en/81#t"), (3, "http://net/de/1"), (4, "http://m.example.net/de/8"), (5, "http://x.org/es"),
    (6, "http://x.org/es/"), (7, "nohost"), (8, None), (9, ""), (None, "http://x.com"), (10, "http://a.com?b=://c.com/en/"), (11, "http://acom/en/1"), (12, "://com/en/é"),
    (12, "://com/en/é"), (13, "ftp://É.Com/EN/"),
]
WANT = {
    1: ("www.example.com", "/en/7", "example.com/en/7"), 2: ("a.example.com", "/en/81", "com/en/"), 3: ("net", "/de/1", "net/de/"), 4: ("m.example.net", "/de/8", "example.net/de/8"),
    5: ("x.org", "/es", None), 6: ("x.org", "/es/", "org/es/"), 7: ("", "", None), 8: ("", "", None), 9: ("", "", None), None: ("x.com", "", None), 10: ("a.com", "", None),
    11: ("acom", "/en/1", None), 12: ("com", "/en/é", "com/en/"), 13: ("É.com", "/EN/", None),
}


def test_rules(spark):
    df = spark.createDataFrame(URLS, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("ratio", F.lit("x"))
    rows = U.judge(df).collect()
    assert len(rows) == len(URLS)
    verdict = {r: v for v, r in U.RULES}
    for r in rows:
        assert (r["host"], r["path"], r["rule"]) == WANT[r["page_id"]]
        assert r["verdict"] == verdict.get(r["rule"], r["verdict"]) and r["verdict"] in ("allow", "block")
    assert U.judge(df.limit(0)).count() == 0


def brute_model(urls):
    n = Counter()
    for u in urls:
        pad = bytes([2] * U.ORDER) + u
        for i in range(U.ORDER, len(pad)):
            for k in range(U.ORDER + 1):
                n[pad[i - k : i], pad[i]] += 1
    return n


def brute_ratio(n, url):
    """Of one class's counts: the log-likelihood of a URL."""
    total, kinds = Counter(), Counter()
    for (c, _), v in n.items():
        total[c] += v
        kinds[c] += 1
    pad, out = bytes([2] * U.ORDER) + url, 0.0
    for i in range(U.ORDER, len(pad)):
        p = 1 / 256
        for k in range(U.ORDER + 1):
            c = pad[i - k : i]
            if total[c] >= U.SEEN:
                p = (n[c, pad[i]] + kinds[c] * p) / (total[c] + kinds[c])
        out += log(p)
    return out


@pytest.mark.parametrize("grams,hot", [(1 << 18, 1 << 16), (50, 20), (1, 0)])
def test_ratios_match_brute_force(spark, monkeypatch, grams, hot):
    """Counts by the whole context, also where few grams are judged at once and where few or none of their ratios are sent."""
    monkeypatch.setattr(U, "GRAMS", grams)
    monkeypatch.setattr(U, "HOT_GRAMS", hot)
    r = np.random.default_rng(6)
    train = [(bytes(r.integers(97, 97 + k, 30).astype(np.uint8)).decode(), c) for k, c in ((26, "allow"), (4, "block")) for _ in range(60)]
    train += [("http://ü.com/abd", "allow"), ("", "block")]
    rest = [("http://c.com/abcd", None), ("\x00\x02é", None), ("", None), ("http://c.com/abcd", None)]
    base = spark.createDataFrame(train + rest, "url string, said string").repartition(3)
    counts = U.count(base)
    got = U._with_ratio(base, U.ratios(counts, U.short_contexts(counts))).collect()
    allow, block = (brute_model([u.encode() for u, c in train if c == k]) for k in ("allow", "block"))
    assert len(got) == len(train) + len(rest)
    for row in got:
        url = row["url"].encode()
        assert abs(row["ratio"] - (brute_ratio(allow, url) - brute_ratio(block, url)) / max(1, len(url))) < 2e-6


def test_model_separates_unseen_urls(spark):
    r = np.random.default_rng(4)
    word = lambda a: "".join(r.choice(list(a), 8))
    data = [(i, f"http://{word('aeiou')}.net/de/{word('klm')}" if i % 2 else f"http://{word('xyzq')}.org/es/{word('789')}") for i in range(600)]
    data += [(1000 + i, f"http://{word('aeiou')}.info/{word('klm')}" if i % 2 else f"http://{word('xyzq')}.info/{word('789')}") for i in range(100)]
    rows = [x for x in U.judge(spark.createDataFrame(data, "page_id long, url string")).collect() if x["rule"] is None]
    assert np.mean([(x["verdict"] == "allow") == bool(x["page_id"] % 2) for x in rows]) >= 0.95


def test_threshold():
    assert U.threshold({}) is None and U.threshold({3000: 10}) == 0.0
    assert U.threshold({100: 1, 1000: 98, 3900: 1}) == 1000 * 2 * U.LIMIT / U.BINS - U.LIMIT


def test_real_pages(spark):
    pages = spark.read.parquet(f"{D}/pages.parquet")
    rows = U.judge(pages).collect()
    assert len(rows) == pages.count()
    assert {x["verdict"] for x in rows} == {"allow", "block"}
