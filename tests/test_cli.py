import json

import pytest

from quire import cli
from quire.plans import catalogue, views


def test_pipeline(spark, sf_dir, tmp_path):
    views.regions(spark, sf_dir).write.parquet(str(tmp_path / "in" / "regions.parquet"))
    views.pages(spark, sf_dir).write.parquet(str(tmp_path / "in" / "pages.parquet"))
    cli.run(spark, [str(tmp_path / "in"), "-o", str(tmp_path / "out"), "--debug"])
    got = spark.read.parquet(str(tmp_path / "out" / "markdown"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, catalogue.markdown_documents(spark, sf_dir).collect()))
    tree = json.loads(spark.read.parquet(str(tmp_path / "out" / "document")).first()["document"])
    assert tree["pages"] and set(tree["pages"][0]) == {"index", "size", "blocks", "discarded"}
    cli.run(spark, [str(tmp_path / "in"), "-o", str(tmp_path / "some"), "-m", "text", "--pages", "0:1"])
    assert "![](" not in spark.read.parquet(str(tmp_path / "some" / "markdown")).first()["markdown"]


def test_vlm_and_hybrid(spark, sf_dir, tmp_path):
    views.vlm_answers(spark, sf_dir).write.parquet(str(tmp_path / "answers.parquet"))
    views.pages(spark, sf_dir).write.parquet(str(tmp_path / "pages.parquet"))
    assert cli.run(spark, [str(tmp_path), "-o", str(tmp_path / "out"), "-b", "vlm"]).count() == catalogue.vlm_assemble(spark, sf_dir).count()


def test_bad_arguments(spark):
    for argv in (["in"], ["in", "-o", "x", "-b", "other"], ["in", "-o", "x", "--effort", "low"]):
        with pytest.raises(SystemExit):
            cli.run(spark, argv)
    with pytest.raises(ValueError):
        cli.run(spark, ["in", "-o", "x", "--pages", "a:b"])
