"""Operators on hand-made pages, tables and images."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.operators import assemble, decode, grouping, native_text, render, tables, vision
from quire.plans import catalogue

REGION = (
    "doc_id long, page_idx int, order int, idx int, label string, bbox struct<x0:float,y0:float,x1:float,y1:float>, "
    "text_lines array<struct<bbox:struct<x0:float,y0:float,x1:float,y1:float>,text:string,score:float>>, latex string, inline_latex string, html string, image string"
)


def region(order, label, box, text=None, doc=1, **more):
    box = tuple(map(float, box))
    lines = None if text is None else [(box, x, 1.0) for x in (text if isinstance(text, list) else [text])]
    return (doc, 0, order, order, label, box, lines, more.get("latex"), more.get("inline_latex"), more.get("html"), more.get("image"))


def assembled(spark, *regions):
    return assemble.assemble(spark.createDataFrame(list(regions), REGION)).orderBy("doc_id", "discarded", "block_idx").collect()


def text_of(lines):
    return " ".join("".join(s["text"] if s["kind"] == "text" else f"${s['latex']}$" for s in x["spans"]) for x in lines)


def test_caption_goes_to_the_image_above(spark):
    blocks = assembled(spark, region(0, "image", (0, 0, 100, 100)), region(1, "image", (0, 200, 100, 300)), region(2, "figure_title", (0, 300, 100, 320), "Figure"), region(3, "vision_footnote", (0, 101, 100, 110), "Note"))
    assert [len(b["captions"]) for b in blocks] == [0, 1] and [len(b["footnotes"]) for b in blocks] == [1, 0]
    assert text_of(blocks[1]["captions"][0]["lines"]) == "Figure" and blocks[0]["image"] == ""


def test_caption_without_visual_is_dropped(spark):
    assert [b["kind"] for b in assembled(spark, region(0, "figure_title", (0, 0, 1, 1), "x"), region(1, "text", (0, 0, 9, 9), "y"))] == ["text"]


@pytest.mark.parametrize("x,flat", [(80, "text $eq$"), (0, "$eq$ text")])
def test_inline_formula_stands_by_its_left_edge(spark, x, flat):
    text = (1, 0, 0, 0, "text", (0.0, 0.0, 200.0, 20.0), [((40.0, 0.0, 75.0, 20.0), "text", 1.0)], None, None, None, None)
    (block,) = assembled(spark, text, region(1, "inline_formula", (x, 2, x + 20, 18), inline_latex="eq"))
    assert " ".join(s["text"] or f"${s['latex']}$" for s in block["lines"][0]["spans"]) == flat and len(block["lines"]) == 1


def test_far_inline_formula_is_dropped_and_unmatched_line_is_added(spark):
    (block,) = assembled(spark, region(0, "text", (0, 0, 200, 20), "t"), region(1, "inline_formula", (0, 500, 20, 520), inline_latex="eq"))
    assert text_of(block["lines"]) == "t"
    text = (1, 0, 0, 0, "text", (0.0, 0.0, 200.0, 60.0), [((0.0, 0.0, 200.0, 20.0), "t", 1.0)], None, None, None, None)
    (block,) = assembled(spark, text, region(1, "inline_formula", (0, 40, 20, 60), inline_latex="eq"))
    assert text_of(block["lines"]) == "t $eq$" and len(block["lines"]) == 2


def test_full_page(spark):
    blocks = assembled(
        spark, region(5, "footer", (0, 90, 100, 100), "7"), region(0, "doc_title", (0, 0, 100, 10), "Title"), region(1, "text", (0, 10, 100, 20), ["a", "b"]),
        region(2, "image", (0, 20, 100, 40), image="f.png"), region(3, "figure_title", (0, 40, 100, 45), "Cap"), region(4, "table", (0, 50, 100, 80), html="<t/>"), region(6, "formula_number", (0, 0, 1, 1)),
        region(7, "display_formula", (0, 81, 9, 85), latex="x"), region(8, "seal", (0, 0, 5, 5)), region(9, "header_image", (0, 0, 5, 5)),
    )
    assert [(b["discarded"], b["kind"], b["role"], b["level"]) for b in blocks] == [
        (False, "text", "title", 0), (False, "text", "body", None), (False, "image", None, None), (False, "table", None, None), (False, "equation", None, None), (False, "image", None, None),
        (True, "text", "footer", None), (True, "text", "body", None),
    ]
    assert blocks[7]["lines"] == []


def test_unknown_label_is_an_error(spark):
    with pytest.raises(Exception, match="unknown layout label"):
        assembled(spark, region(0, "mystery", (0, 0, 1, 1)))


def test_paragraphs(spark):
    def merged(*boxes):
        df = assemble.assemble(spark.createDataFrame([region(i, label, (0, a, 10, b), f"l{i}") for i, (label, a, b) in enumerate(boxes)], REGION))
        return assemble.merge_paragraphs(df).orderBy("block_idx").collect()

    one = merged(("text", 0, 20), ("text", 25, 45))
    assert [(b["bbox"]["y1"], text_of(b["lines"])) for b in one] == [(45.0, "l0 l1")]
    assert len(merged(("text", 0, 20), ("paragraph_title", 25, 45))) == 2 and len(merged(("text", 0, 20), ("text", 200, 220))) == 2
    assert len(merged(("doc_title", 0, 20), ("doc_title", 21, 30))) == 2
    # Near the grown block, though not near the last one.
    assert len(merged(("text", 0, 100), ("text", 90, 95), ("text", 105, 110))) == 1
    assert sum(len(b["lines"]) for b in merged(("text", 0, 20), ("text", 25, 45), ("abstract", 46, 50), ("abstract", 50, 60))) == 4


def rendered(spark, *regions, mode=render.MARKDOWN):
    return render.markdown(assemble.assemble(spark.createDataFrame(list(regions), REGION)), mode).first()["markdown"]


def test_markdown(spark):
    assert rendered(spark, region(0, "doc_title", (0, 0, 1, 1), "A"), region(1, "paragraph_title", (0, 0, 1, 1), "B"), region(2, "text", (0, 0, 1, 1), ["c", "", "d"]), region(3, "footer", (0, 0, 1, 1), "x")) == "# A\n\n## B\n\nc  d"
    assert rendered(spark, region(0, "display_formula", (0, 0, 1, 1), latex="E=mc^2")) == "$$\nE=mc^2\n$$"
    image = [region(0, "image", (0, 0, 9, 9), image="fig1.png"), region(1, "figure_title", (0, 9, 9, 12), "Figure 1"), region(2, "figure_title", (0, 9, 9, 12), " ")]
    assert rendered(spark, *image) == "![](images/fig1.png)\nFigure 1" and rendered(spark, *image, mode=render.TEXT_ONLY) == ""
    assert rendered(spark, region(0, "table", (0, 0, 9, 9), html="<table/>"), region(1, "figure_title", (0, 9, 9, 12), "T")) == "T\n<table/>"
    assert rendered(spark, region(0, "text", (0, 0, 1, 1)), region(1, "text", (0, 0, 1, 1), "x")) == "\n\nx"


def test_code(spark):
    vlm = spark.createDataFrame([(1, 0, 0, "code", (0.0, 0.0, 1.0, 1.0), "a = 1\nb", None), (1, 0, 1, "index", (0.0, 0.0, 1.0, 1.0), "i", None)], "doc_id long, page_idx int, idx int, label string, bbox struct<x0:float,y0:float,x1:float,y1:float>, content string, image string")
    blocks = assemble.assemble_vlm(vlm)
    assert render.markdown(blocks).first()["markdown"] == "```\na = 1\nb\n```"
    assert render.markdown(blocks.withColumn("language", F.lit("python"))).first()["markdown"].startswith("```python\n")


def test_vlm_order_and_orphans(spark):
    box = (0.0, 0.0, 9.0, 9.0)
    rows = [(1, 0, 0, "image", box, None, "i.png"), (1, 0, 1, "title", box, "A\n b", None), (1, 0, 2, "image_caption", box, "cap", None), (2, 0, 0, "table_footnote", box, "foot", None), (2, 0, 1, "image_caption", box, "cap", None), (2, 0, 2, "text", box, "t", None)]
    df = spark.createDataFrame(rows, "doc_id long, page_idx int, idx int, label string, bbox struct<x0:float,y0:float,x1:float,y1:float>, content string, image string")
    got = {}
    for b in assemble.assemble_vlm(df).orderBy("doc_id", "block_idx").collect():
        got.setdefault(b["doc_id"], []).append((b["kind"], text_of(b["lines"]), len(b["captions"])))
    assert got == {1: [("text", "A b", 0), ("image", "", 1)], 2: [("text", "t", 0), ("text", "cap", 0), ("text", "foot", 0)]}


def test_hybrid(spark):
    box = lambda y: (0.0, float(y), 100.0, float(y + 10))
    rows = [(1, 0, 0, 0, "title", box(0), "A\nB", None), (1, 0, 1, 1, "title", box(20), "C", None), (1, 0, 2, 2, "header", box(40), "h", None), (1, 0, 3, 3, "table", box(60), "<t/>", None), (1, 0, 4, 4, "equation", box(80), " x ", None), (1, 0, 5, 5, "formula_number", box(80), "1", None)]
    df = spark.createDataFrame(rows, "doc_id long, page_idx int, order int, idx int, vlm_type string, bbox struct<x0:float,y0:float,x1:float,y1:float>, content string, image string")
    titles = spark.createDataFrame([(1, 0, box(1))], "doc_id long, page_idx int, bbox struct<x0:float,y0:float,x1:float,y1:float>")
    blocks = assemble.assemble_hybrid(df, titles).orderBy("discarded", "block_idx").collect()
    assert [(b["kind"], b["level"], b["discarded"]) for b in blocks] == [("text", 0, False), ("text", 1, False), ("table", None, False), ("equation", None, False), ("text", None, True)]
    assert text_of(blocks[0]["lines"]) == "A B" and blocks[3]["latex"] == "x"


def test_ocr_fills_blank_regions(spark):
    regions = spark.createDataFrame([(1, 0, 0, "text", "  "), (1, 0, 1, "text", "keep"), (1, 0, 2, "table", None), (1, 0, 3, "text", None)], "doc_id long, page_idx int, idx int, vlm_type string, content string")
    ocr = spark.createDataFrame([(1, 0, i, n, x, s) for i in range(3) for n, x, s in ((1, "b", 0.9), (0, "a", 0.7), (2, "c", 0.6), (3, " ", 0.9))], "doc_id long, page_idx int, idx int, line_idx int, text string, score float")
    assert [r["content"] for r in assemble.fill_from_ocr(regions, ocr).orderBy("idx").collect()] == ["a b", "keep", None, None]


def glyphs(spark, rows):
    return spark.createDataFrame([(1, 0, i, c, float(x), float(y), float(x + w), float(y + h), float(r), f, 10_000, 400) for i, (c, x, y, w, h, r, f) in enumerate(rows)], native_text.GLYPHS)


def word(text, x=0, y=0, pitch=8, w=7, h=10, r=0, font="A"):
    return [(c, x + pitch * i, y, w, h, r, font) for i, c in enumerate(text)]


def filled(spark, rows, *boxes):
    regions = spark.createDataFrame([(1, 0, i, tuple(map(float, b))) for i, b in enumerate(boxes)], "doc_id long, page_idx int, idx int, bbox struct<x0:float,y0:float,x1:float,y1:float>")
    got = {r["idx"]: r["text"] for r in native_text.fill_regions(native_text.group_glyphs(glyphs(spark, rows)), regions).collect()}
    return [got.get(i) for i in range(len(boxes))]


def test_glyph_lines(spark):
    def spans(rows):
        df = glyphs(spark, rows)
        one, two = native_text.glyph_spans(df).orderBy("span_idx").collect(), native_text.spans(native_text.group_glyphs(df)).orderBy("span_idx").collect()
        assert one == two
        return [(r["line_idx"], r["text"]) for r in one]

    assert spans(word("Hello")) == [(0, "Hello")]
    assert spans(word("AB\n") + word("CD", y=20)) == [(0, "AB\n"), (1, "CD")]
    assert spans(word("X") + word("Y", x=8, font="B")) == [(0, "X"), (0, "Y")]
    assert spans(word("A") + [("A", 0.3, 0, 7, 10, 0, "A")]) == [(0, "A")] and spans(word("B") + [("B", 1.8, 1.8, 7, 10, 0, "A")]) == [(0, "B")]
    assert spans(word("A") + word("A", x=8)) == [(0, "AA")]


def test_native_fill(spark):
    page = (0, 0, 300, 100)
    assert filled(spark, word("AB") + word("CD", x=40), page) == ["AB CD"]
    assert filled(spark, word("First\n") + word("Second", y=20), page) == ["First Second"]
    assert filled(spark, word("TITLE", pitch=30, w=24, h=24) + [("\n", 150, 0, 1, 24, 0, "A")] + word("to", y=40) + word("do", x=26, y=40), (0, 0, 300, 100)) == ["TITLE to do"]
    assert filled(spark, word("ab", r=1.57), page) == [None] and filled(spark, word("a"), (0, 0, 3000, 10)) == [None]
    left, right = filled(spark, word("left") + word("right", x=100), (0, 0, 50, 20), (90, 0, 200, 20))
    assert (left, right) == ("left", "right")


def test_native_pages(spark):
    pages = spark.createDataFrame([(1, 0, 0), (1, 1, 90)], "doc_id long, page_idx int, rotation int")
    assert [r["page_idx"] for r in native_text.native_fill_pages(glyphs(spark, word("a")), pages).collect()] == [0]


def test_median(spark):
    m = lambda *v: spark.range(1).select(native_text.median(F.array(*[F.lit(float(x)).cast("float") for x in v]).cast("array<float>"))).first()[0]
    assert (m(1, 2, 3, 4), m(5, 1, 3), m()) == (2.5, 3.0, 0.0)


def test_ctc(spark):
    one = lambda *best: [(1, s, [1.0 if c == b else 0.0 for c in range(3)]) for s, b in enumerate(best)]
    df = lambda rows: spark.createDataFrame(rows, "k int, step int, logits array<float>")
    assert decode.ctc(df(one(1, 1, 0, 2)), ["k"]).first()["classes"] == [1, 2] and decode.ctc(df(one(1, 0, 1)), ["k"]).first()["classes"] == [1, 1]
    assert decode.ctc(df([(1, 0, [0.0] * 4)]), ["k"]).first()["confidence"] == 0.25 and decode.ctc(df([(1, 0, [30.0, 0.0, 0.0])]), ["k"]).first()["confidence"] > 0.99


def test_order_ranks(spark):
    def ranks(sign):
        m = [sign * 20.0 if j > i else 0.0 for i in range(3) for j in range(3)]
        return spark.createDataFrame([(m,)], "m array<float>").select(decode.order_ranks(F.col("m"), 3)).first()[0]

    assert ranks(1) == [0, 1, 2] and ranks(-1) == [2, 1, 0]


def test_order_ranks_in_double(spark):
    """Chances that are one number in single precision: the second of two items comes first, by less than a chance's eighth digit."""
    near = -1e-9
    rows = [(1, [0.0, near, 0.0, 0.0]), (2, [0.0, -near, 0.0, 0.0])]
    got = spark.createDataFrame(rows, "k int, m array<float>").select("k", decode.order_ranks(F.col("m"), 2).alias("r")).orderBy("k").collect()
    assert [list(r["r"]) for r in got] == [[1, 0], [0, 1]]


def test_top_classes_of_one_score(spark):
    """Different logits with one score in single precision rank by logit; equal logits by place."""
    df = spark.createDataFrame([(1, [20.0, 21.0, 0.1, 0.10000001, 21.0, 0.0])], "k int, logits array<float>")
    top = decode.top_classes(df, ["k"], 2).orderBy("rank").collect()
    assert [(r["query"], r["class"]) for r in top] == [(0, 1), (2, 0), (0, 0)] and len({r["score"] for r in top}) == 1


def test_top_classes_and_detections(spark):
    df = spark.createDataFrame([(1, [-5.0, 5.0, -5.0, 4.0, -5.0, -9.0])], "k int, logits array<float>")
    top = decode.top_classes(df, ["k"], 3)
    assert [(r["query"], r["class"]) for r in top.orderBy("rank").collect()] == [(0, 1), (1, 0)]
    boxes = spark.createDataFrame([(1, 0, 0.5, 0.5, 0.5, 0.5), (1, 1, 0.1, 0.1, 0.1, 0.1)], "k int, query int, cx float, cy float, w float, h float")
    ranks = spark.createDataFrame([(1, 0, 1), (1, 1, 0)], "k int, query int, rank int")
    got = decode.detections(top, boxes, ranks, ["k"], F.lit(200.0), F.lit(200.0)).orderBy("order").collect()
    assert [(r["order"], r["label_id"], round(r["score"], 4)) for r in got] == [(0, 0, 0.982), (1, 1, 0.9933)]
    assert tuple(got[1]["bbox"]) == (50, 50, 150, 150)


def test_structure(spark):
    token = decode.STRUCTURE_TOKENS.index
    assert len(decode.STRUCTURE_TOKENS) == 50
    steps = [token("<tr>"), token("<td></td>"), token("</tr>"), token("eos"), token("<tr>")]
    rows = [(1, s, [1.0 if c == k else 0.0 for c in range(50)], [0.25, 0.5, 0.25, 0.5], 200.0, 200.0) for s, k in enumerate(steps)]
    got = decode.structure(spark.createDataFrame(rows, "k int, step int, probs array<float>, loc array<float>, width float, height float"), ["k"]).first()
    assert got["tokens"] == ["<html>", "<body>", "<table>", "<tr>", "<td></td>", "</tr>", "</table>", "</body>", "</html>"]
    assert [tuple(b) for b in got["boxes"]] == [(50, 100, 50, 100)] and got["score"] == 1.0


def cells_html(spark, spans, cells, tokens=("<table>", "<tr>", "<td></td>", "<td></td>", "</tr>", "</table>")):
    box = "struct<x0:float,y0:float,x1:float,y1:float>"
    s = spark.createDataFrame([(1, i, tuple(map(float, b)), x) for i, (b, x) in enumerate(spans)], f"k int, span_idx int, bbox {box}, text string")
    c = spark.createDataFrame([(1, i, tuple(map(float, b))) for i, b in enumerate(cells)], f"k int, cell_idx int, bbox {box}")
    t = spark.createDataFrame([(1, list(tokens))], "k int, tokens array<string>")
    return tables.splice(t, tables.match_cells(s, c, ["k"]), ["k"]).first()["html"]


def test_table_html(spark):
    two = [(0, 0, 10, 10), (20, 0, 30, 10)]
    assert cells_html(spark, [((21, 1, 29, 9), "hi")], two) == "<table><tr><td></td><td>hi</td></tr></table>"
    assert cells_html(spark, [((20, 0, 25, 10), "foo"), ((25, 0, 30, 10), "bar")], two) == "<table><tr><td></td><td>foo bar</td></tr></table>"
    assert cells_html(spark, [((0, 0, 5, 9), "<b>a</b>"), ((5, 0, 9, 9), " <b>c</b>")], two) == "<table><tr><td><b>a c</b></td><td></td></tr></table>"
    assert cells_html(spark, [((0, -20, 10, -10), "above"), ((0, 0, 9, 9), "x")], two) == "<table><tr><td>x</td><td></td></tr></table>"
    spanned = ("<thead>", "<tr>", "<td", ' colspan="2"', ">", "</td>", "</tr>", "</thead>")
    assert cells_html(spark, [((0, 0, 9, 9), "x")], two, spanned) == '<tr><td colspan="2">x</td></tr>'


def test_logic_points():
    points = lambda *t: tables.token_positions(t)
    assert points("<tr>", "<td", ' colspan="2"', ">", "</td>", "<td></td>", "</tr>") == [(0, 0, 0, 1), (0, 0, 2, 2)]
    assert points("<tr>", "<td", ' rowspan="2"', ">", "</td>", "<td></td>", "</tr>", "<tr>", "<td></td>", "</tr>") == [(0, 1, 0, 0), (0, 0, 1, 1), (1, 1, 1, 1)]


def quad(x0, y0, x1, y1):
    return [x0, y0, x0, y1, x1, y1, x1, y0]


def test_grid_recovery(spark):
    assert [r.tolist() for r in tables.split_rows(np.array([0, 0, 100, 100]), 10)] == [[0, 1], [2, 3]]
    four = [quad(0, 0, 50, 50), quad(50, 0, 100, 50), quad(0, 50, 50, 100), quad(50, 50, 100, 100)]
    assert tables.recover_cells(np.array(four)) == [(0, 0, 0, 0), (0, 0, 1, 1), (1, 1, 0, 0), (1, 1, 1, 1)]
    wide = [quad(0, 0, 100, 50), quad(0, 50, 50, 100), quad(50, 50, 100, 100)]
    assert tables.recover_cells(np.array(wide)) == [(0, 0, 0, 1), (1, 1, 0, 0), (1, 1, 1, 1)]
    tall = [quad(0, 0, 50, 100), quad(50, 0, 100, 50), quad(50, 50, 100, 100)]
    assert tables.recover_cells(np.array(tall))[0] == (0, 1, 0, 0)
    assert tables.recover_cells(np.zeros((0, 8))) == []
    df = spark.createDataFrame([([list(map(float, q)) for q in four],), (None,)], "p array<array<float>>")
    assert [r[0] if r[0] is None else len(r[0]) for r in df.select(tables.recover("p")).collect()] == [4, None]


def test_grid_html():
    unit = [(0, 0, 0, 0), (0, 0, 1, 1), (1, 1, 0, 0), (1, 1, 1, 1)]
    td = lambda x, r=1, c=1: f"<td rowspan={r} colspan={c}>{x}</td>"
    frame = "<html><body><table>{}</table></body></html>"
    assert tables.plot_table(unit, dict(enumerate("abcd"))) == frame.format(f"<tr>{td('a')}{td('b')}</tr><tr>{td('c')}{td('d')}</tr>")
    assert tables.plot_table([(0, 0, 0, 1), (1, 1, 0, 0), (1, 1, 1, 1)], {0: "x"}) == frame.format(f"<tr>{td('x', 1, 2)}</tr><tr>{td('')}{td('')}</tr>")
    assert tables.plot_table([(0, 0, 0, 0), (1, 1, 1, 1)], {0: "a", 1: "b"}) == frame.format(f"<tr>{td('a')}<td></td></tr><tr><td></td>{td('b')}</tr>")
    assert tables.plot_table([], {}) == frame.format("")
    # A last row that is not filled and has no text is cut off; a full one stays.
    assert tables.plot_table([(0, 0, 0, 0), (0, 0, 1, 1), (1, 1, 0, 0)], {0: "a"}) == frame.format(f"<tr>{td('a')}{td('')}</tr>")


def test_hull_and_rectangle():
    square = np.array([[0, 0], [2, 0], [2, 2], [0, 2], [1, 1], [1, 0], [0, 0]])
    assert vision.convex_hull(square).tolist() == [[0, 0], [2, 0], [2, 2], [0, 2]]
    rect, side = vision.min_area_rect(square)
    assert side == 2 and sorted(map(tuple, rect)) == [(0, 0), (0, 2), (2, 0), (2, 2)]
    assert vision.min_area_rect(np.array([[1, 1], [3, 3]]))[1] == 0 and vision.min_area_rect(np.zeros((0, 2))) is None
    r = np.random.default_rng(1)
    for _ in range(20):
        p = r.integers(0, 20, (80, 2))
        hull = vision.convex_hull(p)
        edge = np.roll(hull, -1, axis=0) - hull
        assert all((e[0] * (p - h)[:, 1] - e[1] * (p - h)[:, 0] >= 0).all() for e, h in zip(edge, hull, strict=True))


def test_components_match_flood_fill():
    r = np.random.default_rng(2)
    for _ in range(20):
        mask = r.random((12, 15)) < 0.4
        todo, want = {(x, y) for y, x in zip(*np.nonzero(mask), strict=True)}, []
        while todo:
            stack, part = [todo.pop()], set()
            while stack:
                x, y = stack.pop()
                part.add((x, y))
                for n in [(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                    if n in todo:
                        todo.remove(n)
                        stack.append(n)
            want.append(frozenset(part))
        assert {frozenset(map(tuple, c.tolist())) for c in vision.labelled(mask)} == set(want)


def test_closing():
    row = np.array([[1, 0, 0, 1, 0, 0, 0, 0, 1]], dtype=bool)
    assert vision.closed(row, 2, 1).astype(int).tolist() == [[1, 1, 1, 1, 0, 0, 0, 0, 1]] and vision.closed(row, 1, 1) is row


def test_text_boxes():
    prob = np.zeros((40, 40), dtype=np.float32)
    assert vision.text_boxes(prob, 40, 40) == []
    prob[10:30, 10:30] = 1
    ((box, score),) = vision.text_boxes(prob, 40, 40)
    assert score == 1 and np.ptp(box, axis=0).min() >= 20
    assert vision.text_boxes(prob * 0.4, 40, 40) == []


def test_mask_cells():
    mask = np.zeros((128, 128), dtype=int)
    for r in (4, 60, 121):
        mask[r : r + 2, 4:123] = 1
    for c in (4, 60, 121):
        mask[4:123, c : c + 2] = np.where(mask[4:123, c : c + 2] == 1, 1, 2)
    cells = vision.cell_polygons(mask)
    assert len(cells) == 4
    assert tables.recover_cells(np.array(cells)) == [(0, 0, 0, 0), (0, 0, 1, 1), (1, 1, 0, 0), (1, 1, 1, 1)]
    assert vision.cell_polygons(np.zeros((0, 0), dtype=int)) == []


def test_reading_order():
    poly = lambda x, y: np.array([[x, y], [x, y + 10], [x + 10, y + 10], [x + 10, y]], dtype=np.float32)
    got = vision.reading_order([poly(50, 0), poly(0, 5), poly(0, 100)])
    assert [tuple(p[0]) for p in got] == [(0, 5), (50, 0), (0, 100)]


def test_page_bounds():
    assert grouping.page_bounds(5, None) == (0, 5) and grouping.page_bounds(5, (2, 10)) == (2, 5) and grouping.page_bounds(4, (1, None)) == (1, 4) and grouping.page_bounds(3, (9, 2)) == (3, 3)


def test_box_properties(spark):
    r = np.random.default_rng(3)
    rows = [tuple(map(float, r.integers(0, 30, 8))) for _ in range(300)]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} float" for i in range(8)))
    a, b = g.box(*[F.col(f"c{i}") for i in range(4)]), g.box(*[F.col(f"c{i}") for i in range(4, 8)])
    again = g.box(a["x0"], a["y0"], a["x1"], a["y1"])
    for x, y, same in df.select(g.iou(a, b), g.iou(b, a), a == again).collect():
        assert x == y and 0 <= x <= 1 and same


def test_kept_glyphs_of_neighbours_and_others():
    """Neighbours that are decided at once give what looking at every glyph gives."""

    def one_by_one(page, sign, white, box):
        keep = []
        for i in range(len(page)):
            last = next((j for j in reversed(range(i)) if keep[j]), None)
            alike = lambda j: j is not None and page[j] == page[i] and sign[j] == sign[i]
            shadow = alike(last) and native_text._shadows(box[last : last + 1], box[i : i + 1])[0]
            near = any(keep[j] and alike(j) and (np.abs(box[j].astype(float) - box[i]) <= native_text.NEAR).all() for j in range(i))
            keep.append(bool(white[i] or not (shadow or near)))
        return keep

    gone = 0
    for seed in range(400):
        r = np.random.default_rng(seed)
        n = int(r.integers(1, 50))
        page, sign = np.sort(r.integers(0, 3, n)), r.integers(0, int(r.integers(1, 4)), n)
        x = np.cumsum(r.choice([0, 0.3, 1.0, 1.5, 2, 6], n)) if seed % 2 else r.integers(0, 9, n) * 0.9
        corner = np.stack([x, r.choice([0, 0, 0.2, 1.8, 2], n)], axis=1)
        box = np.concatenate([corner, corner + [5, 12] + r.choice([0, 0, 0.05], (n, 2))], axis=1).astype(np.float32)
        want = one_by_one(page, sign, sign == 2, box)
        assert native_text.kept_glyphs(page, sign, sign == 2, box).tolist() == want, seed
        gone += want.count(False)
    assert gone > 1000


@pytest.mark.parametrize("name", ["glyph_dedup", "glyph_spans_lines", "interval_fill", "native_or_ocr"])
def test_glyphs_stay_in_the_task_that_reads_them(spark, sf_dir, name):
    """No exchange of glyphs, and no sort of them: their rows are many times the documents."""
    plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("MapInArrow") :].split("Relation")[0]
    assert "texts" in below and not any(x in below for x in ("Repartition", "Sort", "Join", "Aggregate"))


def test_pages_of_repeated_ids_and_long_texts(spark, tmp_path):
    """A page's lines are together whatever text of an id they come from, also where a text is taken page by page; null texts have no pages."""
    long = "\n".join(f"line {k} " + "x" * 70 for k in range(4_000))
    for name, rows in (("twice", [(1, "one\ntwo"), (2, "other"), (1, "uno\ndos\ntres"), (3, None)]), ("long", [(1, long), (2, "")])):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
    got = {(r["doc_id"], r["page_idx"]): r["n_glyphs"] for r in catalogue.glyph_dedup(spark, f"{tmp_path}/twice").collect()}
    assert got == {(1, 0): len("onetwounodostres"), (2, 0): len("other")}
    pages = catalogue.glyph_dedup(spark, f"{tmp_path}/long").collect()
    lines = long.split("\n")
    assert len(pages) == 500 and sum(r["n_kept"] for r in pages) == sum(map(len, lines))
    assert {r["page_idx"]: r["n_kept"] for r in pages}[499] == sum(map(len, lines[-8:]))
