import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import render
from quire.plans import catalogue, engine, views
from quire.sources import documents as d
from quire.sources import sinks
from quire.streaming.stream import parse_stream


def test_page_ranges():
    assert d.parse_page_range(None) is None and d.parse_page_range("2") == (2, None) and d.parse_page_range("1:5") == (1, 5) and d.parse_page_range(" 3: ") == (3, None)
    for bad in ("x", "1:y", "", "-1", "1:2:3"):
        with pytest.raises(ValueError):
            d.parse_page_range(bad)


def test_paths():
    assert d.safe_join("/base/", "a/./b.png") == "/base/a/b.png"
    for bad in ("../x", "/etc/x", "a/../../x"):
        with pytest.raises(ValueError):
            d.safe_join("/base", bad)


def test_characters():
    assert len(d.characters("a\nb\nc", False)) == 4 and d.characters("a\r\nb\n") == ["blank", "a", "b", " "]
    with pytest.raises(ValueError):
        d.characters("")


def test_config(tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"models_dir": "/m", "vlm_server_url": "http://x"}')
    env = {"QUIRE_DEVICE": "cpu", "QUIRE_CONFIG": str(path)}.get
    c = d.Config.load(env=env)
    assert (c.device, c.models_dir, c.vlm_server_url) == ("cpu", "/m", "http://x") and d.Config.load(str(tmp_path / "none"), env={}.get) == d.Config()
    with pytest.raises(ValueError):
        d.Config.load(env={"QUIRE_DEVICE": "abacus"}.get)


def test_effort():
    assert d.image_analysis("high", True) and not d.image_analysis("medium", True)
    for bad in ("low", "Medium"):
        with pytest.raises(ValueError):
            d.check_effort(bad)


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.pdf", "b.x.pdf", "c.txt"):
        (tmp_path / "in" / name).write_bytes(name.encode())
    rows = d.read_files(spark, str(tmp_path / "in")).orderBy("stem").collect()
    assert [(r["stem"], bytes(r["content"])) for r in rows] == [("a", b"a.pdf"), ("b.x", b"b.x.pdf")]


def test_page_checks(spark):
    counts = spark.createDataFrame([(1, 2), (2, 0)], "doc_id long, n_pages int")
    assert [tuple(r) for r in d.page_rows(counts).collect()] == [(1, 0), (1, 1)]
    bad = spark.createDataFrame([(1, 5)], "doc_id long, page_idx int")
    with pytest.raises(Exception, match="page 5 of 2"):
        d.check_pages(bad, counts).collect()


def test_strict_keys(spark):
    names, fields = (spark.createDataFrame([(n,) for n in x], "name string") for x in (("a", "b"), ("a",)))
    assert [r["name"] for r in d.unused_keys(names, fields, strict=False).collect()] == ["b"]
    with pytest.raises(ValueError, match="b"):
        d.unused_keys(names, fields)


def read_png(data):
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    w, h = struct.unpack(">II", data[16:24])
    n = struct.unpack(">I", data[33:37])[0]
    raw = np.frombuffer(zlib.decompress(data[41 : 41 + n]), np.uint8).reshape(h, 1 + 3 * w)
    return raw[:, 1:].reshape(h, w, 3)


def test_crops(spark):
    image = np.arange(4 * 6 * 3, dtype=np.uint8).reshape(4, 6, 3)
    assert np.array_equal(read_png(sinks.png(image)), image)
    assert sinks.crop(image, (-5, 1.5, 3.9, 99))[0].shape == (2, 3, 3) and sinks.crop(image, (2, 2, 2.5, 4)) is None
    assert sinks.crop_share(image, (0.5, 0.5, 0.5, 0.5)).shape == (1, 1, 3)
    box = "struct<x0:float,y0:float,x1:float,y1:float>"
    regions = spark.createDataFrame([(1, 0, 7, (1.0, 1.0, 3.0, 3.0)), (1, 0, 8, (0.0, 0.0, 0.2, 3.0))], f"doc_id long, page_idx int, order int, bbox {box}")
    pages = spark.createDataFrame([(1, 0, 6, 4, bytearray(image.tobytes()))], "doc_id long, page_idx int, width_px int, height_px int, pixels binary")
    (row,) = sinks.crops(regions, pages).collect()
    assert row["name"] == "p0_o7.png" and np.array_equal(read_png(bytes(row["png"])), image[1:3, 1:3])
    url = spark.createDataFrame([(bytearray(b"abc" * 40),)], "b binary").select(sinks.png_data_url(F.col("b"))).first()[0]
    assert url.startswith("data:image/png;base64,") and "\n" not in url
    assert sinks.data_url(image).startswith("data:image/png;base64,")


def test_outputs(spark, sf_dir, tmp_path):
    blocks = catalogue._assembled(spark, sf_dir)
    pages = views.pages(spark, sf_dir)
    text, items = render.markdown(blocks), render.content_list(render.content_items(blocks, pages))
    sinks.write_outputs(text, items, str(tmp_path / "out"), render.document_json(blocks, pages))
    assert all(spark.read.parquet(str(tmp_path / "out" / n)).count() > 100 for n in ("markdown", "content_list", "document"))

    for r in items.limit(20).collect():
        assert all("type" in x and "page_idx" in x and x.get("image_caption") != [] for x in json.loads(r["content_list"]))
    few = text.limit(2).withColumn("stem", F.col("doc_id").cast("string"))
    sinks.write_text_files(few, "markdown", str(tmp_path / "files"))
    assert len(list((tmp_path / "files").glob("stem=*"))) == 2


def test_engine(spark, sf_dir):
    backend = engine.PipelineBackend(lambda docs: views.regions(spark, sf_dir))
    e = engine.Engine().with_backend("pipeline", backend).with_config(d.Config(device="cpu"))
    all_ = e.markdown("pipeline", views.table(spark, sf_dir, "documents"))
    assert sorted(map(tuple, all_.collect())) == sorted(map(tuple, catalogue.markdown_documents(spark, sf_dir).collect()))
    some = e.blocks("pipeline", views.table(spark, sf_dir, "documents"), d.ParseOptions(page_range=(1, 3)))
    assert {r[0] for r in some.select("page_idx").distinct().collect()} == {1, 2}
    with pytest.raises(ValueError, match="no backend"):
        e.blocks("other", all_)


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))

    def transform(batch):
        return batch.select("doc_id", F.regexp_replace("text", r"\s+", " ").alias("text"))

    for _ in range(2):  # the second run finds nothing new
        parse_stream(spark, str(tmp_path / "in"), docs.schema, str(tmp_path / "out"), str(tmp_path / "check"), transform).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, transform(docs).collect()))
