import corpus_pipeline as p
import __spark_entry__ as entry
from quire.llm import decontamination, packing, pii, quality, simhash


def test_registered():
    names = list(entry.queries())
    assert "pipeline" in names and [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert [n for n, _ in p.STAGES] == ["quality", "near_dedup", "decontamination", "pii", "packing"]


def test_stages_on_real_tables(spark, sf_dir, docs):
    """Each stage, on its own input, does what its operator's (separately tested) decisions say; nothing else changes."""
    labels, tests = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    now = docs
    good = {r["doc_id"] for r in quality.score(now, quality.train(docs, labels)).collect() if r["predicted"]}
    out = p.quality_stage(spark, now, sf_dir).cache()
    assert {r["doc_id"] for r in out.collect()} == good and out.columns == docs.columns
    now = p.near_dedup_stage(spark, out, sf_dir).cache()
    ids = {r["doc_id"] for r in now.collect()}
    roots = {}
    for r in simhash.near_duplicates(out).collect():
        roots.setdefault(r["root"], set()).add(r["least"])
    assert ids == {min(v) for v in roots.values()}
    bad = {r["doc_id"] for r in decontamination.overlaps(now, tests).collect()}
    out = p.decontamination_stage(spark, now, sf_dir).cache()
    assert {r["doc_id"] for r in out.collect()} == ids - bad and bad
    before = {r["doc_id"]: r["text"] for r in out.collect()}
    now = p.pii_stage(spark, out, sf_dir).cache()
    assert now.columns == docs.columns
    finder = pii.Finder()
    for r in now.collect():
        assert r["text"] == pii.masked(before[r["doc_id"]], finder.find(before[r["doc_id"]])) and r["n_chars"] == len(r["text"])
    packed = p.packing_stage(spark, now, sf_dir)
    assert {r["doc_id"] for r in packed.collect()} == ids - bad and "batch" in packed.columns


def test_run(spark, sf_dir):
    assert p.run(spark, sf_dir).columns == packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).columns


def test_odd_and_empty_tables(spark, sf_dir, odd, empty):
    for table in (odd, empty):
        now = table
        for name, stage in p.STAGES[:-1]:
            now = stage(spark, now, sf_dir).cache()
            assert now.columns == table.columns, name
        assert p.packing_stage(spark, now, sf_dir).count() >= now.count()
