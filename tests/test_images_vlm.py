import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.operators import images, native_text
from quire.plans import engine
from quire.sources import documents, vlm

RNG = np.random.default_rng(0)


def picture(h, w):
    return RNG.integers(0, 256, (h, w, 3), dtype=np.uint8)


def test_resize():
    image = picture(13, 17)
    for kernel in images.KERNELS:
        assert np.array_equal(images.resize(image, 17, 13, kernel), image)
        flat = np.full((9, 7, 3), 77, dtype=np.uint8)
        assert (images.resize(flat, 20, 3, kernel) == 77).all()
    half = images.resize(np.array([[[0] * 3, [100] * 3]], dtype=np.uint8).repeat(2, axis=0), 1, 1)
    assert half.tolist() == [[[50, 50, 50]]]
    with pytest.raises(ValueError):
        images.resize(image, 0, 5)


def test_inputs():
    assert images.layout_input(picture(30, 40)).shape == (3, 800, 800)
    line = images.line_input(picture(24, 100))
    assert line.shape == (3, 48, 320) and (line[:, :, 200:] == 0).all() and np.abs(line).max() <= 1
    assert images.line_input(picture(10, 4000)).shape == (3, 48, 2560)
    red = np.zeros((48, 400, 3), dtype=np.uint8)
    red[:, :, 0] = 255
    assert (images.line_input(red)[2] == 1).all() and (images.line_input(red)[0] == -1).all()
    wide = images.structure_input(picture(100, 50))
    assert wide.shape == (3, 488, 488) and (wide[:, :, 244:] == 0).all() and (wide[:, :, 243] != 0).any()
    assert images.class_input(picture(300, 500)).shape == (3, 224, 224)
    for f in (images.line_input, images.class_input):
        with pytest.raises(ValueError):
            f(np.zeros((0, 5, 3), dtype=np.uint8))


@pytest.mark.parametrize("size,want", [((100, 100), (96, 96)), ((1920, 960), (960, 480)), ((10, 10), (32, 32)), ((4800, 48), (960, 32)), ((112, 112), (128, 128))])
def test_detector_size(size, want):
    assert images.detector_size(*size) == want


def test_formula_margins():
    page = np.full((60, 90, 3), 255, dtype=np.uint8)
    page[20:30, 40:70] = 0
    assert images.without_margin(page).shape == (10, 30, 3)
    assert images.without_margin(np.full((5, 6, 3), 9, dtype=np.uint8)).shape == (5, 6, 3)
    out = images.formula_input(page)
    assert out.shape == (192, 672) and out[0, 0] == pytest.approx(-0.7931 / 0.1738, rel=1e-4)


def test_greedy():
    assert images.greedy(lambda t, p: [3, 4, 9][p], 0, 9, 10) == ([3, 4], True) and images.greedy(lambda t, p: t + 1, 0, 99, 4) == ([1, 2, 3, 4], False)
    assert images.table_class([0.5, 0.5]) == "wireless" and images.table_class([0.6, 0.4]) == "wired"


def test_model_boundary(spark):
    def load():
        return lambda batch: batch.assign(y=batch["x"] * 2)

    assert sorted(r["y"] for r in images.with_model(spark.range(5).withColumnRenamed("id", "x"), load, "x long, y long").collect()) == [0, 2, 4, 6, 8]


def test_structure_box(spark):
    b = spark.range(1).select(g.structure_box(g.box(*[F.lit(x).cast("float") for x in (0.0, 0.0, 100.0, 100.0)]), F.lit(200.0), F.lit(100.0)).alias("b")).first()["b"]
    assert tuple(b) == pytest.approx((0, 0, 100, 200))


def test_glyph_scan(spark):
    edges = "struct<left:float,bottom:float,right:float,top:float>"
    rows = [(1, 0, 0, "a", (1.0, 80.0, 5.0, 90.0), None, 99.5, 0.0, "F", 10.5, 400), (1, 0, 1, None, (1.0, 1.0, 2.0, 2.0), None, 99.5, 0.0, "F", 1.0, 1), (1, 0, 2, "b", None, (1.0, 1.0, 2.0, 2.0), 99.5, None, "F", 1.0, None), (1, 0, 3, "c", None, None, 99.5, 0.0, "F", 1.0, 1)]
    raw = spark.createDataFrame(rows, f"doc_id long, page_idx int, char_idx int, ch string, loose {edges}, tight {edges}, page_height float, angle float, font string, font_size float, weight int")
    got = native_text.scan_glyphs(raw).orderBy("char_idx").collect()
    assert [(r["ch"], r["x0"], r["y0"], r["x1"], r["y1"], r["size"], r["weight"]) for r in got] == [("a", 1, 10, 5, 20, 10500, 400), ("b", 1, 98, 2, 99, 1000, 0)]


LAYOUT = "<|box_start|>0 0 500 500<|box_end|><|ref_start|>title<|ref_end|>\n<|box_start|>0 500 500 900<|box_end|><|ref_start|>table<|ref_end|><|im_end|>"


def test_two_steps(spark):
    def fake(body):
        asked = json.loads(body)
        assert asked["messages"][0] == {"role": "system", "content": "You are a helpful assistant."} and asked["max_tokens"] == 4096 and asked["vllm_xargs"] == {"no_repeat_ngram_size": 100}
        image, words = asked["messages"][1]["content"]
        assert image["image_url"]["url"].startswith("data:") and words["type"] == "text"
        if "Layout" in words["text"]:
            answer = LAYOUT
        elif "Table" in words["text"]:
            raise OSError("no answer")
        else:
            answer = "Hello\nthere<|im_end|>"
        return json.dumps({"choices": [{"message": {"content": answer}}]})

    pages = spark.createDataFrame([(1, 0, 200.0, 100.0, "data:x"), (1, 1, 200.0, 100.0, "data:y")], "doc_id long, page_idx int, width double, height double, image_url string")
    answers = vlm.read_pages(pages, lambda b: b.withColumn("image_url", F.lit("data:crop")), "m", fake, lambda df: df.cache())
    blocks = engine.VlmBackend(lambda _: answers).analyze(pages, documents.ParseOptions()).orderBy("page_idx", "block_idx").collect()
    assert [(b["page_idx"], b["kind"], b["html"]) for b in blocks] == [(0, "text", None), (0, "table", ""), (1, "text", None), (1, "table", "")]
    assert blocks[0]["lines"][0]["spans"][0]["text"] == "Hello there" and tuple(blocks[0]["bbox"]) == (0, 0, 100, 50)


def test_answers():
    assert vlm.first_choice('{"choices": [{"message": {"content": "a"}}]}') == "a"
    for bad in ('{"choices": []}', '{"choices": [{"message": {"content": null}}]}'):
        with pytest.raises(ValueError):
            vlm.first_choice(bad)
