"""Column functions on the cases that the document model fixes."""

import pytest
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.functions import latex
from quire.functions import text as t


@pytest.fixture
def value(spark):
    def get(column):
        return spark.range(1).select(column.alias("v")).first()["v"]

    return get


def box(*c):
    return g.box(*[F.lit(float(x)).cast("float") for x in c])


def points(*ps):
    return F.array(*[F.struct(F.lit(float(x)).cast("float").alias("x"), F.lit(float(y)).cast("float").alias("y")) for x, y in ps])


def test_boxes(value):
    assert tuple(value(box(10, 20, 0, 5))) == (0, 5, 10, 20)
    assert value(g.intersection(box(0, 0, 1, 1), box(2, 2, 3, 3))) is None and value(g.intersection(box(0, 0, 1, 1), box(1, 0, 2, 1))) is None
    assert value(g.iou(box(0, 0, 1, 1), box(2, 2, 3, 3))) == 0 and value(g.iou(box(0, 0, 2, 2), box(0, 0, 2, 2))) == 1
    assert value(g.iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0
    assert value(g.overlap_ratio(box(0, 0, 4, 2), box(0, 0, 2, 2))) == 0.5 and value(g.overlap_ratio(box(0, 0, 0, 2), box(0, 0, 2, 2))) == 0
    assert value(F.to_json(F.struct(g.to_array(box(1, 2, 3, 4)).alias("b")))) == '{"b":[1.0,2.0,3.0,4.0]}'
    assert tuple(value(g.from_array(F.array(*map(F.lit, (3.0, 4.0, 1.0, 2.0)))))) == (1, 2, 3, 4)
    assert tuple(value(g.from_center(*[F.lit(x).cast("float") for x in (0.5, 0.5, 0.2, 0.4)]))) == pytest.approx((0.4, 0.3, 0.6, 0.7))
    assert tuple(value(g.page_to_top_left(*[F.lit(float(x)).cast("float") for x in (1, 10, 5, 20)], F.lit(99.5)))) == (1, 80, 5, 90)


def test_thousandths(value):
    assert value(g.to_thousandths(box(0, 0, 10, 10), F.lit(100.0), F.lit(100.0))) == [0, 0, 100, 100]
    assert value(g.to_thousandths(box(0, 0, 10, 10), F.lit(50.0), F.lit(100.0))) == [0, 0, 200, 100]
    assert value(g.to_thousandths(box(0, 0, 10, 10), F.lit(0.0), F.lit(0.0))) is None
    assert tuple(value(g.from_thousandths(*map(F.lit, (12, 34, 560, 780))))) == pytest.approx((0.012, 0.034, 0.56, 0.78))
    assert value(g.from_thousandths(*map(F.lit, (12, 34, 1200, 780)))) is None and value(g.from_thousandths(*map(F.lit, (12, 34, 12, 780)))) is None


def test_polygons(value):
    square = points((0, 0), (2, 0), (2, 2), (0, 2))
    assert value(g.polygon_area(square)) == 4 and value(g.polygon_perimeter(square)) == 8
    at = lambda x, y: value(g.in_polygon(F.lit(x).cast("float"), F.lit(y).cast("float"), square))
    assert at(1.0, 1.0) and not at(3.0, 1.0) and not at(1.0, -1.0)
    assert [tuple(p) for p in value(g.ordered_corners(points((2, 2), (0, 0), (0, 2), (2, 0))))] == [(0, 0), (2, 0), (2, 2), (0, 2)]
    assert tuple(value(g.flat_quad_box(F.array(*[F.lit(x).cast("float") for x in (0.1, 0.2, 0.3, 0.2, 0.3, 0.4, 0.1, 0.4)])))) == pytest.approx((0.1, 0.2, 0.3, 0.4))
    assert value(g.kernel_length(F.lit(1024))) == 38


@pytest.mark.parametrize("text,heading", [
    ("1 Introduction", True), ("3.2.1 Foo", True), ("10.4 Bar", True), ("3.1", False), ("3", False), ("3D rendering of", False), ("A Introduction", False), ("", False),
    ("1. Intro", False), ("References.", True), ("ABSTRACT", True), ("Conclusions", False), ("2 Method", True),
])
def test_section_headings(value, text, heading):
    assert value(t.is_section_heading(F.lit(text))) is heading


def test_titles(value):
    assert value(t.collapse_newlines(F.lit(" A\n  b\n\nc\td "))) == "A b  c\td"
    assert value(t.strip_end_token(F.lit("hello<|im_end|>"))) == "hello" and value(t.strip_end_token(F.lit(" a <|im_end|><|im_end|>\n"))) == "a"
    assert value(t.write_out(F.lit("eﬃcient ﬂow\u0002"))) == "efficient flow-"
    assert value(t.clean_formula(F.lit(r"\[E = mc^2 \tag{1}\]"))) == r"E = mc^2 \tag{1}"
    assert value(t.join_path(F.lit("images/"), F.lit("/a.png"))) == "images/a.png" and value(t.join_path(F.lit(""), F.lit("a"))) == "a" and value(t.join_path(F.lit("d/"), F.lit(""))) == "d"


@pytest.mark.parametrize("text,spans", [
    (r"energy \(E=mc^2\) equation", [("t", "energy "), ("f", "E=mc^2"), ("t", " equation")]), ("plain", [("t", "plain")]), (r"a \(b", [("t", r"a \(b")]),
    (r"\( \)", [("f", "")]), (r"  \(x\)  ", [("f", "x")]), (r"\) a \( b", [("t", r"\) a "), ("t", " b")]), ("", [("t", "")]), (r"\(a\)\(b\)", [("f", "a"), ("f", "b")]), (r"\) \(", [("t", r"\) "), ("t", "")]),
])
def test_inline_formulas(value, text, spans):
    got = value(t.inline_spans(F.lit(text), box(0, 0, 1, 1)))
    assert [("t", s["text"]) if s["kind"] == "text" else ("f", s["latex"]) for s in got] == spans


def test_layout_answer(value):
    block = lambda c, label, tail="": f"<|box_start|>{c}<|box_end|><|ref_start|>{label}<|ref_end|>{tail}"
    answer = (
        block("12 34 560 780", "text") + " prose " + block("0 0 1200 10", "text") + block("5 5 5 9", "text") + block("9 9 1 1", "Title", "<|rotate_left|>")
        + block("1 1 2 2", "unknown", "<|rotate_up|>") + block("1 1 2 2", "inline_formula") + block("99999999999999999999 1 2 3", "text")
    )
    got = value(t.layout_answer(F.lit(answer)))
    assert [(b["label"], b["angle"]) for b in got] == [("text", 0), ("title", 270), ("image", 0)]
    assert tuple(got[0]["bbox"]) == pytest.approx((0.012, 0.034, 0.56, 0.78)) and tuple(got[1]["bbox"]) == pytest.approx((0.001, 0.001, 0.009, 0.009))
    assert value(t.layout_answer(F.lit("nothing"))) == []


def test_prompts(value):
    assert value(t.extraction_prompt(F.lit("table"))) == "\nTable Recognition:" and value(t.extraction_prompt(F.lit("image_block"))) == "\nText Recognition:"
    s = value(t.extraction_sampling(F.lit("table")))
    assert (s["frequency_penalty"], s["presence_penalty"], s["top_k"], s["no_repeat_ngram_size"]) == (pytest.approx(0.005), 1.0, 1, 100)


@pytest.mark.parametrize("raw,clean", [
    ("x + y\\\\", "x + y"), ("a}b", "ab"), ("a{b", "ab"), (r"a\{b", r"a\{b"), (r"\left( x", "( x"), (r"\left( x \right)", r"\left( x \right)"),
    (r"\leftarrow", ""), (r"\upalpha \uparrow \upsilon \uplus", r"\alpha \uparrow \upsilon \uplus"), (r"\boldmath x", " x"), (r"\Bar{x}", r"\hat{x}"), (r"a \end{matrix}", r"\begin{matrix} a \end{matrix}"),
    (r"\begin{cases} b", r"\begin{cases} b \end{cases}"), (r"e \end{array}", r"\begin{array}{c} e \end{array}"), (r"a\qquad b", r"a\qquad b"), (r"\qquad+", r"\qquad +"), (r"\d x", r"\ d x"),
    (r"\,", r"\ ,"), (r"\%", r"\%"), (r"\\d x", r"\\d x"),
])
def test_latex(value, raw, clean):
    assert value(latex.cleaned(F.lit(raw))) == clean


def test_latex_scanners():
    assert latex.drop_unpaired_braces(r"a}b{c") == "abc" and latex.drop_unpaired_braces(r"{a}\}") == r"{a}\}"
    assert latex.balance_left_right(r"\left(x \right) y") == r"\left. \right) y"
    assert latex.balance_left_right(r"\left( a") == "( a"
    assert latex.move_rights(r"{\left( a } b \right)") == r"{\left( a \right)} b "
    assert latex.move_rights(r"\left( {a \right) }") == r"\left( {a \right) }"
