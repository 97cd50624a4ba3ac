"""Queries of single functions on boxes, corners, characters and images, and the longer SQL of the catalogue."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.operators import images, native_text, page_run
from quire.operators.tables import COLUMN_GAP, FIT, ROW_GAP
from quire.plans import views as v
from quire.plans.registered import query
from quire.sources import pages as page_source

_Q = "floor(CAST({} AS DOUBLE) * 1000000)::BIGINT"


def _whole(b: Column, prefix: str) -> list[Column]:
    return [b[c].cast("int").alias(f"{prefix}_{c}") for c in ("x0", "y0", "x1", "y1")]


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("float").alias("x"), y.cast("float").alias("y"))


# --- boxes and corners -----------------------------------------------------------------------------------------------


@query(f"""WITH {v.BOXES_SQL}
SELECT grp, idx, x0 + 3 AS moved_x0, y0 - 2 AS moved_y0, x1 + 3 AS moved_x1, y1 - 2 AS moved_y1, x0 AS quad_x0, y0 AS quad_y0, x1 AS quad_x1, y1 AS quad_y1, x0 * 2 AS full_x0, y0 * 4 AS full_y0, x1 * 2 AS full_x1, y1 * 4 AS full_y1,
  x0 AS top_x0, 792 - y1 AS top_y0, x1 AS top_x1, 792 - y0 AS top_y1, x0 * (2 - idx % 2) AS frame_x0, y0 * (1 + idx % 2) AS frame_y0, x1 * (2 - idx % 2) AS frame_x1, y1 * (1 + idx % 2) AS frame_y1 FROM v_boxes""")
def box_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes moved, around their corners in any order, from shares of a page, turned about a page's height, and out of a structure model's frame."""
    b = v.box_of("x0", "y0", "x1", "y1")
    corners = F.array(*[_point(F.col(x), F.col(y)) for x, y in (("x1", "y0"), ("x0", "y1"), ("x1", "y1"), ("x0", "y0"))])
    shares = g.raw_box(b["x0"] / 64, b["y0"] / 64, b["x1"] / 64, b["y1"] / 64)
    top = g.page_to_top_left(b["x0"], b["y0"], b["x1"], b["y1"], F.lit(791.5))
    wide = F.when(F.col("idx") % 2 == 1, 244.0).otherwise(61.0)
    return v.boxes(spark, sf_dir).select(
        "grp", "idx", *_whole(g.offset(b, 3, -2), "moved"), *_whole(g.quad_box(corners), "quad"), *_whole(g.denormalize(shares, F.lit(128), F.lit(256)), "full"), *_whole(top, "top"),
        *_whole(g.structure_box(b, wide, F.lit(122.0)), "frame"),
    )


@query(f"""WITH {v.BOXES_SQL}
SELECT grp, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, 0 AS none FROM v_boxes GROUP BY grp""")
def box_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    around = v.boxes(spark, sf_dir).groupBy("grp").agg(F.collect_list(v.box_of("x0", "y0", "x1", "y1")).alias("b"))
    box, none = g.union_all(F.col("b")), g.union_all(F.slice("b", 1, 0))
    return around.select("grp", *[box[c].cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")], (none["x0"] + none["y1"]).cast("int").alias("none"))


_CORNERS = f"""{v.BOXES_SQL},
corner AS (SELECT grp, idx, unnest([{{'x': x1 + 6, 'y': y0}}, {{'x': x0, 'y': y0 + partkey % 9}}, {{'x': x1 + 5, 'y': y1 + partkey % 3}}, {{'x': x0 + 1, 'y': y1 - partkey % 11}}]) AS p FROM v_boxes),
by_x AS (SELECT grp, idx, p.x AS x, p.y AS y, row_number() OVER (PARTITION BY grp, idx ORDER BY p.x) AS k FROM corner),
by_y AS (SELECT *, row_number() OVER (PARTITION BY grp, idx, k > 2 ORDER BY y, x) AS r FROM by_x),
four AS (SELECT grp, idx, CASE WHEN k > 2 THEN (CASE r WHEN 1 THEN 'ur' ELSE 'lr' END) ELSE (CASE r WHEN 1 THEN 'ul' ELSE 'll' END) END AS name, x || ',' || y AS place FROM by_y)"""


@query(f"""WITH {_CORNERS},
named AS (SELECT grp, idx, max(place) FILTER (name = 'ul') AS ul, max(place) FILTER (name = 'ur') AS ur, max(place) FILTER (name = 'lr') AS lr, max(place) FILTER (name = 'll') AS ll FROM four GROUP BY ALL)
SELECT grp, idx, concat_ws(' ', ul, ur, lr, ll) AS clockwise, concat_ws(' ', ul, ll, lr, ur) AS down_first FROM named""")
def corner_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four corners in order, and as the recogniser of tables wants them: down the left side first."""
    x0, y0, x1, y1, p = (F.col(c) for c in ("x0", "y0", "x1", "y1", "partkey"))
    points = F.array(_point(x1 + 6, y0), _point(x0, y0 + p % 9), _point(x1 + 5, y1 + p % 3), _point(x0 + 1, y1 - p % 11))
    found = v.boxes(spark, sf_dir).select("grp", "idx", g.ordered_corners(points).alias("c"))
    said = lambda *order: F.concat_ws(" ", *[F.concat_ws(",", F.col("c")[i]["x"].cast("int"), F.col("c")[i]["y"].cast("int")) for i in order])
    return found.select("grp", "idx", said(0, 1, 2, 3).alias("clockwise"), said(0, 3, 2, 1).alias("down_first"))


_HITS = " + ".join(
    f"CASE WHEN ({b}.y > py) <> ({a}.y > py) AND px < CAST((({a}.x - {b}.x) * (py - {b}.y)) / CASE WHEN {a}.y <> {b}.y THEN {a}.y - {b}.y END AS FLOAT) + {b}.x THEN 1 ELSE 0 END" for a, b in (("p", "q"), ("q", "r"), ("r", "p"))
)


@query(f"""WITH {v.BOXES_SQL},
t AS (SELECT *, {{'x': x0::DOUBLE, 'y': y0::DOUBLE}} AS p, {{'x': x1::DOUBLE, 'y': y0::DOUBLE}} AS q, {{'x': x1::DOUBLE, 'y': y1::DOUBLE}} AS r, x0 + idx * 7 + 0.5 AS px, y0 + partkey % 25 + 0.5 AS py FROM v_boxes)
SELECT grp, idx, {_Q.format("CAST(sqrt(CAST((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) AS DOUBLE)) AS FLOAT)")} AS diagonal, y1 - y0 AS a, x0 - x1 AS b, x1 * y0 - x0 * y1 AS c,
  trunc((y1 - y0) * px + (x0 - x1) * py + x1 * y0 - x0 * y1)::INTEGER AS side, (x1 - x0) * (y1 - y0) AS twice,
  {_Q.format("CAST(CAST(x1 - x0 AS FLOAT) + CAST(y1 - y0 AS FLOAT) AS FLOAT) + CAST(sqrt(CAST((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) AS DOUBLE)) AS FLOAT)")} AS around, ({_HITS}) % 2 = 1 AS inside FROM t""")
def segment_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths, lines, sides of lines, and the area, perimeter and inside of triangles."""
    x0, y0, x1, y1 = (F.col(c).cast("float") for c in ("x0", "y0", "x1", "y1"))
    triangle = F.array(_point(x0, y0), _point(x1, y0), _point(x1, y1))
    px, py = g.f32(x0 + F.col("idx") * 7 + g.f32(0.5)), g.f32(y0 + F.col("partkey") % 25 + g.f32(0.5))
    line = g.line_through(x0, y0, x1, y1)
    return v.boxes(spark, sf_dir).select(
        "grp", "idx", v.micro(g.distance(x0, y0, x1, y1)).alias("diagonal"), *[line[c].cast("int").alias(c) for c in "abc"], g.side_of_line(line, px, py).cast("int").alias("side"),
        (g.polygon_area(triangle) * 2).cast("int").alias("twice"), v.micro(g.polygon_perimeter(triangle)).alias("around"), g.in_polygon(px, py, triangle).alias("inside"),
    )


# --- characters ------------------------------------------------------------------------------------------------------


def _raw_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw character per line: its first sign, with a loose box, a tight one, both or none."""
    i = F.col("line_idx")
    box = lambda grow: F.struct(*[(F.col(c).cast("float") + k * grow).alias(n) for c, k, n in (("x0", -1, "left"), ("y0", -1, "bottom"), ("x1", 1, "right"), ("y1", 1, "top"))])
    return v.lines(spark, sf_dir).select(
        "doc_id", "page_idx", i.alias("char_idx"), F.when(F.col("line") != "", F.substring("line", 1, 1)).alias("ch"), F.when(i % 4 < 2, box(2)).alias("loose"), F.when(i % 2 == 0, box(0)).alias("tight"),
        F.lit(791.25).cast("float").alias("page_height"), F.when(i % 5 == 0, F.lit(1.5).cast("float")).alias("angle"), F.lit("F").alias("font"), (F.lit(9.5) + i % 3).cast("float").alias("font_size"),
        F.when(i % 3 == 0, 700).alias("weight"),
    )


@query(f"""WITH {v.LINES_SQL},
raw AS (SELECT *, CASE WHEN line_idx % 4 < 2 THEN 2 WHEN line_idx % 2 = 0 THEN 0 END AS grow FROM v_lines WHERE line <> '')
SELECT doc_id, page_idx, line_idx AS char_idx, substr(line, 1, 1) AS ch, x0 - grow AS x0, 792 - y1 - grow AS y0, x1 + grow AS x1, 792 - y0 + grow AS y1, CASE WHEN line_idx % 5 = 0 THEN 1500 ELSE 0 END AS angle,
  9500 + 1000 * (line_idx % 3) AS size, CASE WHEN line_idx % 3 = 0 THEN 700 ELSE 0 END AS weight FROM raw WHERE grow IS NOT NULL""")
def glyph_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glyphs of a native reader's characters: without a sign or a box they are skipped, the loose box goes first."""
    found = native_text.scan_glyphs(_raw_characters(spark, sf_dir))
    corners = [F.col(c).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")]
    return found.select("doc_id", "page_idx", "char_idx", "ch", *corners, (F.col("rotation") * 1000).cast("int").alias("angle"), "size", "weight")


@query(f"""WITH {v.LINES_SQL}
SELECT doc_id, page_idx FROM v_lines WHERE (doc_id + page_idx) % 4 = 0 GROUP BY ALL HAVING bool_or((doc_id * 3 + line_idx) % 5 = 0)""")
def native_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose native text can be taken over: upright ones with an upright glyph."""
    glyphs = v.lines(spark, sf_dir).select("doc_id", "page_idx", ((F.col("doc_id") * 3 + F.col("line_idx")) % 5).cast("float").alias("rotation"))
    pages = v.pages(spark, sf_dir).withColumn("rotation", (F.col("doc_id") + F.col("page_idx")) % 4 * 90)
    return native_text.native_fill_pages(glyphs, pages)


# --- images ----------------------------------------------------------------------------------------------------------


def _image_facts(w: int, h: int, red: int) -> tuple:
    """What the models' inputs of a picture of one colour are: sizes and normalised values."""
    image = np.zeros((h, w, 3), dtype=np.uint8)
    image[:, :] = (red, 100, 50)
    layout, mask, line, structure, kind = (f(image) for f in (images.layout_input, images.mask_input, images.line_input, images.structure_input, images.class_input))
    dw, dh = images.detector_size(w, h)
    shown = structure[0] != 0
    parts = lambda x: int(np.floor(float(x) * 1e4 + 0.5))
    return (
        layout.shape[1], parts(layout[0].min()), parts(layout[0].max()), mask.shape[2], parts(mask[2].mean(dtype=np.float64)), dw, dh, line.shape[2], int((line[0] != 0).any(axis=0).sum()), parts(line[2, 0, 0]),
        int(shown.any(axis=0).sum()), int(shown.any(axis=1).sum()), parts(kind[1, 0, 0]),
    )


_FACTS = ("layout_side", "layout_low", "layout_high", "mask_side", "mask_blue", "det_w", "det_h", "line_canvas", "line_used", "line_red", "table_w", "table_h", "class_green")


@query(f"""WITH i AS (SELECT p_partkey AS id, (20 + p_partkey * 37 % 300)::INTEGER AS w, (16 + p_partkey * 53 % 200)::INTEGER AS h, (p_partkey * 11 % 250)::INTEGER AS red FROM part WHERE p_partkey % 20 = 0),
s AS (SELECT *, ceil(CAST(CAST(48 AS FLOAT) * CAST(CAST(w AS FLOAT) / CAST(h AS FLOAT) AS FLOAT) AS FLOAT))::INTEGER AS own, CAST(488 AS FLOAT) / CAST(greatest(w, h) AS FLOAT) AS k FROM i)
SELECT id, 800 AS layout_side, round(red / 255.0::DOUBLE * 10000)::BIGINT AS layout_low, round(red / 255.0::DOUBLE * 10000)::BIGINT AS layout_high, 1024 AS mask_side, round(50 / 255.0::DOUBLE * 10000)::BIGINT AS mask_blue,
  (greatest(32, floor(w / 32.0 + 0.5) * 32))::INTEGER AS det_w, (greatest(32, floor(h / 32.0 + 0.5) * 32))::INTEGER AS det_h, least(greatest(own, 320), 2560) AS line_canvas, least(own, greatest(own, 320), 2560) AS line_used,
  round((red / 127.5::DOUBLE - 1) * 10000)::BIGINT AS line_red, least(greatest(trunc(CAST(w * k AS FLOAT))::INTEGER, 1), 488) AS table_w, least(greatest(trunc(CAST(h * k AS FLOAT))::INTEGER, 1), 488) AS table_h,
  round((100 / 255.0::DOUBLE - 0.456) / 0.224 * 10000)::BIGINT AS class_green FROM s""")
def image_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and values of models' inputs from pictures of one colour, in whole ten-thousandths, which leave single precision room."""
    k = F.col("p_partkey")
    rows = v.table(spark, sf_dir, "part").where(k % 20 == 0).select(k.alias("id"), (20 + k * 37 % 300).cast("int").alias("w"), (16 + k * 53 % 200).cast("int").alias("h"), (k * 11 % 250).cast("int").alias("red"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            facts = [_image_facts(w, h, red) for w, h, red in zip(pdf["w"], pdf["h"], pdf["red"], strict=True)]
            yield pd.concat([pdf[["id"]].reset_index(drop=True), pd.DataFrame(facts, columns=list(_FACTS))], axis=1)

    return rows.repartition(4 * spark.sparkContext.defaultParallelism).mapInPandas(run, "id long, " + ", ".join(f"{c} {'long' if c in _MICRO else 'int'}" for c in _FACTS))


_MICRO = ("layout_low", "layout_high", "mask_blue", "line_red", "class_green")


# --- a page's run ----------------------------------------------------------------------------------------------------


@query(f"""WITH {v.DETS_SQL},
made AS (SELECT doc_id, page_idx, line_idx AS idx, kind, x0, kind IN ('text', 'caption', 'footnote', 'discarded') AS reads, line_idx % 3 = 0 AS wired FROM v_dets)
SELECT doc_id, page_idx, idx, kind, x0, CASE WHEN NOT reads THEN 0 WHEN idx % 3 = 0 THEN 1 WHEN idx % 4 <> 0 THEN 2 ELSE 0 END AS n_lines,
  CASE WHEN NOT reads THEN '' WHEN idx % 3 = 0 THEN 'n' || idx WHEN idx % 4 <> 0 THEN 'o' || idx || ' more' ELSE '' END AS text, CASE WHEN kind = 'equation' AND idx % 2 = 0 THEN 'x_' || idx END AS latex,
  CASE WHEN kind = 'inline_formula' AND idx % 2 = 0 THEN 'x_' || idx END AS inline_latex, CASE WHEN kind <> 'table' THEN NULL WHEN wired AND idx % 5 > 0 THEN '<w' || idx || '>' WHEN NOT wired AND idx % 7 > 0 THEN '<l' || idx || '>' END AS html,
  CASE WHEN kind IN ('image', 'chart', 'table') THEN 'p' || page_idx || '_o' || idx || '.png' END AS image, CASE WHEN kind = 'table' AND wired AND idx % 5 = 0 THEN 'wired: bad' END AS warning FROM made""")
def page_run_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections in pixels with the results of the stages that their kinds call for: failed wired tables, tables that weren't classed, absent rows."""
    i = F.col("line_idx")
    dets = v.dets(spark, sf_dir).select("doc_id", "page_idx", i.alias("idx"), i.alias("order"), "label", g.scale(v.box_of("x0", "y0", "x1", "y1"), 2.0).alias("bbox"))
    i = F.col("idx")
    key = lambda where, *more: dets.where(where).select(*page_run.KEY, *more)
    two = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.concat(F.lit("o"), i).alias("t")), F.struct(F.lit(1).alias("k"), F.lit("more").alias("t"))))
    ocr = dets.where(i % 4 != 0).select(*page_run.KEY, "bbox", two.alias("x")).select(*page_run.KEY, F.col("x.k").alias("line_idx"), "bbox", F.col("x.t").alias("text"), g.f32(0.9).alias("score"))
    stages = page_run.Stages(
        native=key(i % 3 == 0, F.concat(F.lit("n"), i).alias("text")), ocr=ocr, formulas=key(i % 2 == 0, F.concat(F.lit("x_"), i).alias("latex")),
        classes=key(i % 6 != 5, F.when(i % 3 == 0, "wired").when(i % 3 == 1, "wireless").alias("class")),
        wired=key(i >= 0, F.concat(F.lit("<w"), i, F.lit(">")).alias("html"), F.when(i % 5 == 0, "bad").alias("error")),
        wireless=key(i % 7 != 0, F.concat(F.lit("<l"), i, F.lit(">")).alias("html"), F.lit(None).cast("string").alias("error")),
    )
    found = page_run.recognised(dets, stages, 2.0, writes_images=True)
    text = F.array_join(F.transform("text_lines", lambda x: x["text"]), " ")
    return found.select(*page_run.KEY, "kind", F.col("bbox.x0").cast("int").alias("x0"), F.size("text_lines").alias("n_lines"), text.alias("text"), "latex", "inline_latex", "html", "image", "warning")


_STAGE_OF = "['rasterize', 'native_text', 'layout', 'ocr', 'formula', 'table_classify', 'table_recognize'][line_idx % 6 + 1 + line_idx % 2]"


@query(f"""WITH {v.LINES_SQL},
t AS (SELECT {_STAGE_OF} AS stage, sum((doc_id * 7 + line_idx) % 64 / 64.0::DOUBLE) AS seconds FROM v_lines GROUP BY ALL),
every AS (SELECT unnest(['rasterize', 'native_text', 'layout', 'ocr', 'formula', 'table_classify', 'table_recognize']) AS stage),
s AS (SELECT stage, coalesce(seconds, 0) AS seconds FROM every LEFT JOIN t USING (stage)),
b AS (SELECT * FROM s UNION ALL SELECT 'table', sum(seconds) FROM s WHERE starts_with(stage, 'table_'))
SELECT stage, seconds, round(seconds / (SELECT sum(seconds) FROM s) * 100, 6) AS percent FROM b""")
def stage_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of stages summed over all pages, with their shares."""
    names = F.array(*[F.lit(n) for n in page_run.STAGES])
    i = F.col("line_idx")
    times = v.lines(spark, sf_dir).select(F.element_at(names, i % 6 + 1 + i % 2).alias("stage"), ((F.col("doc_id") * 7 + i) % 64 / 64.0).alias("seconds"))
    return page_run.stage_times(times).withColumn("percent", F.round("percent", 6))


class _LineReader:
    """A stand-in for a native reader: a text's lines, eight on a page, each with its first sign; an empty text can't be opened."""

    def __init__(self, content: bytes):
        self.lines = content.decode().split("\n")
        if not content:
            raise ValueError("empty file")

    def page_count(self) -> int:
        return -(-len(self.lines) // v.LINES)

    def page(self, index: int) -> dict:
        box = (72.0, 80.0, 80.0, 92.0)
        signs = [{"char_idx": k, "ch": x[:1] or None, "loose": box, "tight": None, "angle": 0.0, "font": "F", "font_size": 10.0, "weight": "weight700Bold"} for k, x in enumerate(self.lines[v.LINES * index : v.LINES * (index + 1)])]
        return {"width": 612.0, "height": 792.0, "rotation": ("none", "degrees90")[index % 2], "characters": signs}

    def picture(self, index: int, width: int, height: int) -> bytes:
        return bytes(3 * width * height)


@query(f"""WITH {v.LINES_SQL},
p AS (SELECT doc_id, page_idx, count(*) FILTER (line <> '') AS signs FROM v_lines JOIN documents USING (doc_id) WHERE text <> '' GROUP BY ALL),
r AS (SELECT * FROM p WHERE page_idx BETWEEN 1 AND 2)
SELECT doc_id, coalesce(count(r.page_idx), 0) AS n_pages, coalesce(sum(signs), 0)::BIGINT AS n_glyphs, coalesce(sum(page_idx % 2 * 90), 0)::BIGINT AS turns, (any_value(coalesce(text, '')) = '')::BIGINT AS n_errors FROM documents LEFT JOIN r USING (doc_id) GROUP BY doc_id""")
def reader_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages one and two of every document through the reader's boundary: how many there are, their glyphs, their turns and what couldn't be opened."""
    files = v.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    pages = page_source.read_pages(files, lambda: _LineReader, (1, 3))
    glyphs = native_text.scan_glyphs(page_source.raw_characters(pages)).where("weight = 700").groupBy("doc_id").agg(F.count("*").alias("n_glyphs"))
    turned = page_source.page_table(pages).groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.sum("rotation").alias("turns"))
    wrong = page_source.open_errors(pages).groupBy("doc_id").agg(F.count("*").alias("n_errors"))
    out = files.select("doc_id").join(glyphs, "doc_id", "left").join(turned, "doc_id", "left").join(wrong, "doc_id", "left")
    return out.select("doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_pages", "n_glyphs", "turns", "n_errors")])


# --- SQL of folds ----------------------------------------------------------------------------------------------------

#: A box goes left of the boxes before it while it lies further left and the tops are near; the state is the list of placed boxes.
READING_ORDER_SQL = f"""WITH RECURSIVE {v.BOXES_SQL},
sorted AS (SELECT grp, list({{'idx': idx, 'x': x0, 'y': y0, 'b': y1}} ORDER BY y0, x0, idx) AS l FROM v_boxes GROUP BY grp),
fold AS (SELECT grp, l, 1 AS n, l[1:1] AS s FROM sorted
  UNION ALL SELECT grp, l, n + 1, s[1 : k] || [l[n + 1]] || s[k + 1 : n] FROM (SELECT *, coalesce(list_max(list_filter(range(1, n + 1), lambda q: NOT (l[n + 1].x < s[q].x AND abs(s[q].y - l[n + 1].y) < 20
    AND (((s[q].b - s[q].y) - (least(s[q].b, l[n + 1].b) - greatest(s[q].y, l[n + 1].y))) / (s[q].b - s[q].y) < 20
      OR ((l[n + 1].b - l[n + 1].y) - (least(s[q].b, l[n + 1].b) - greatest(s[q].y, l[n + 1].y))) / (l[n + 1].b - l[n + 1].y) < 20)))), 0) AS k FROM fold WHERE n < len(l)))
SELECT grp, (unnest(range(len(s))))::INTEGER AS place, unnest(list_transform(s, lambda x: x.idx)) AS idx FROM fold WHERE n = len(l)"""

#: A hull edge joins two points with all others on its left, or on it between the two.
HULL_SQL = f"""WITH {v.BOXES_SQL},
point AS (SELECT DISTINCT grp, x::DOUBLE AS x, y::DOUBLE AS y FROM (SELECT grp, x0 AS x, y0 AS y FROM v_boxes UNION ALL SELECT grp, x1, y1 FROM v_boxes)),
edge AS (SELECT a.grp, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM point a JOIN point b ON a.grp = b.grp AND (a.x <> b.x OR a.y <> b.y)
  WHERE NOT EXISTS (SELECT 1 FROM point c WHERE c.grp = a.grp AND ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0
    OR ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0 AND ((c.x - a.x) * (c.x - b.x) + (c.y - a.y) * (c.y - b.y)) > 0)))),
unit AS (SELECT *, (bx - ax) / sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) AS ux, (by_ - ay) / sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) AS uy FROM edge),
size AS (SELECT e.grp, ax, ay, bx, by_, max(p.x * ux + p.y * uy) - min(p.x * ux + p.y * uy) AS w, max(p.y * ux - p.x * uy) - min(p.y * ux - p.x * uy) AS h FROM unit e JOIN point p ON p.grp = e.grp GROUP BY ALL),
best AS (SELECT grp, count(*)::INTEGER AS n, min(w * h) AS area FROM size GROUP BY grp)
SELECT grp, n AS n_hull, n < 3 AS flat, CASE WHEN n < 3 THEN 0 ELSE round(area, 2) END AS area FROM best"""

_SPAN = """CASE WHEN len({sizes}) < {start} THEN len({sizes}) - {start} + 1 ELSE list_transform([list_filter(range(1, len({sizes}) - {start} + 2), lambda k: abs(list_sum({sizes}[{start} : {start} + k - 1]) - {extent}) <= {fit}
  OR list_sum({sizes}[{start} : {start} + k - 1]) > {extent})], lambda h: CASE WHEN len(h) = 0 THEN len({sizes}) - {start} + 1 WHEN abs(list_sum({sizes}[{start} : {start} + h[1] - 1]) - {extent}) > {fit} AND h[1] > 1
  AND abs(list_sum({sizes}[{start} : {start} + h[1] - 1]) - {sizes}[{start} + h[1] - 1] - {extent}) <= abs(list_sum({sizes}[{start} : {start} + h[1] - 1]) - {extent}) THEN h[1] - 1 ELSE h[1] END)[1] END"""

#: Rows, then column starts as a fold over all edges with the list of starts and the reach as its state, then a fold over each row's cells with the columns used so far.
GRID_RECOVER_SQL = f"""WITH RECURSIVE {v.BOXES_SQL},
cell AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY y0, x0, idx) - 1 AS k FROM v_boxes),
broken AS (SELECT *, CASE WHEN abs(y0 - lag(y0) OVER (PARTITION BY grp ORDER BY k)) > {ROW_GAP} THEN 1 ELSE 0 END AS b FROM cell),
rowed AS (SELECT *, (sum(b) OVER (PARTITION BY grp ORDER BY k))::BIGINT AS r FROM broken),
lists AS (SELECT grp, r, list(x0 ORDER BY k) AS lefts, list(x1 ORDER BY k)[-1] AS reach, first(y0 ORDER BY k) AS top, max(y1 - y0) AS tall, count(*) AS n FROM rowed GROUP BY grp, r),
longest AS (SELECT grp, lefts, reach FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, r DESC) AS q FROM lists) WHERE q = 1),
edges AS (SELECT grp, list(x0 ORDER BY k) AS l, list(x1 ORDER BY k) AS u FROM rowed GROUP BY grp),
fold AS (SELECT grp, l, u, 0 AS n, lefts AS starts, reach FROM edges JOIN longest USING (grp)
  UNION ALL SELECT grp, l, u, n + 1, CASE WHEN x > reach THEN CASE WHEN n % 2 = 0 AND abs(starts[1] - x) > {COLUMN_GAP} THEN starts || [x] ELSE starts END
    WHEN h IS NOT NULL AND abs(starts[h] - x) > {COLUMN_GAP} THEN starts[1 : h - 1] || [x] || starts[h :] ELSE starts END,
    CASE WHEN x > reach AND abs(starts[1] - x) > {COLUMN_GAP} THEN x ELSE reach END
  FROM (SELECT *, list_min(list_filter(range(1, len(starts) + 1), lambda q: abs(starts[q] - x) <= {COLUMN_GAP} OR x < starts[q])) AS h FROM (SELECT *, CASE WHEN n % 2 = 0 THEN l[n // 2 + 1] ELSE u[n // 2 + 1] END AS x FROM fold WHERE n < 2 * len(l)))),
columns AS (SELECT grp, starts, list_transform(range(1, len(starts) + 1), lambda q: CASE WHEN q < len(starts) THEN starts[q + 1] ELSE reach END - starts[q]) AS widths FROM fold WHERE n = 2 * len(l)),
heights AS (SELECT grp, list(coalesce(after - top, tall) ORDER BY r) AS heights FROM (SELECT *, lead(top) OVER (PARTITION BY grp ORDER BY r) AS after FROM lists) GROUP BY grp),
placed AS (SELECT c.grp, c.k, c.r, c.x1 - c.x0 AS w, c.y1 - c.y0 AS t, row_number() OVER (PARTITION BY c.grp, c.r ORDER BY c.k) AS i, widths, heights,
  list_min(list_filter(range(1, len(starts) + 1), lambda q: abs(starts[q] - c.x0) = list_min(list_transform(starts, lambda s: abs(s - c.x0))))) - 1 AS nearest FROM rowed c JOIN columns USING (grp) JOIN heights USING (grp)),
walk AS (SELECT grp, r, 0::BIGINT AS i, 0::BIGINT AS used, NULL::BIGINT AS k, NULL::BIGINT AS first, NULL::BIGINT AS n FROM lists
  UNION ALL SELECT grp, r, i, used + greatest(m, 0), k, first, m FROM (SELECT p.grp, p.r, p.i, p.k, f.used, greatest(f.used, p.nearest) AS first,
    {_SPAN.format(sizes="p.widths", start="(greatest(f.used, p.nearest) + 1)", extent="p.w", fit=FIT)} AS m FROM walk f JOIN placed p ON p.grp = f.grp AND p.r = f.r AND p.i = f.i + 1))
SELECT p.grp, p.k::INTEGER AS cell_idx, p.r::INTEGER AS row_start, (p.r + {_SPAN.format(sizes="p.heights", start="(p.r + 1)", extent="p.t", fit=FIT)} - 1)::INTEGER AS row_end, w.first::INTEGER AS col_start, (w.first + w.n - 1)::INTEGER AS col_end
FROM placed p JOIN walk w ON w.grp = p.grp AND w.k = p.k"""

#: Edge rows, then edge columns, that have no text and aren't full are cut off; what is left runs from the first to the last other one.
GRID_HTML_SQL = f"""WITH {v.BOXES_SQL},
cell AS (SELECT grp, idx, idx // 3 AS r0, idx // 3 + partkey % 2 AS r1, idx % 3 AS c0, idx % 3 + partkey // 2 % 2 AS c1, CASE WHEN idx % 2 = 0 THEN 't' || idx ELSE '' END AS t FROM v_boxes),
slot AS (SELECT grp, r, c, max(idx) AS idx FROM (SELECT grp, idx, c0, c1, unnest(range(r0, r1 + 1)) AS r FROM cell) x, LATERAL (SELECT unnest(range(x.c0, x.c1 + 1)) AS c) GROUP BY ALL),
ends AS (SELECT grp, max(r1) AS h, max(c1) AS w FROM cell GROUP BY grp),
place AS (SELECT grp, r, unnest(range(w + 1)) AS c FROM (SELECT grp, w, unnest(range(h + 1)) AS r FROM ends)),
full_ AS (SELECT p.grp, p.r, p.c, s.idx, coalesce(t.t, '') AS t FROM place p LEFT JOIN slot s USING (grp, r, c) LEFT JOIN cell t USING (grp, idx)),
good_row AS (SELECT grp, r FROM full_ GROUP BY grp, r HAVING bool_or(t <> '') OR count(idx) = count(*)),
tall AS (SELECT grp, min(r) AS top, max(r) AS bottom FROM good_row GROUP BY grp),
good_column AS (SELECT grp, c FROM full_ JOIN tall USING (grp) WHERE r BETWEEN top AND bottom GROUP BY grp, c HAVING bool_or(t <> '') OR count(idx) = count(*)),
wide AS (SELECT grp, min(c) AS l, max(c) AS u FROM good_column GROUP BY grp),
shown AS (SELECT f.grp, f.r, f.c, CASE WHEN f.idx IS NULL THEN '<td></td>' WHEN f.r = greatest(r0, top) AND f.c = greatest(c0, l)
  THEN '<td rowspan=' || (least(r1, bottom) - greatest(r0, top) + 1) || ' colspan=' || (least(c1, u) - greatest(c0, l) + 1) || '>' || f.t || '</td>' ELSE '' END AS s
  FROM full_ f JOIN tall USING (grp) JOIN wide USING (grp) LEFT JOIN cell k ON k.grp = f.grp AND k.idx = f.idx WHERE f.r BETWEEN top AND bottom AND f.c BETWEEN l AND u),
row_ AS (SELECT grp, r, '<tr>' || string_agg(s, '' ORDER BY c) || '</tr>' AS s FROM shown GROUP BY grp, r),
made AS (SELECT grp, string_agg(s, '' ORDER BY r) AS s FROM row_ GROUP BY grp)
SELECT grp, '<html><body><table>' || coalesce(s, '') || '</table></body></html>' AS html FROM ends LEFT JOIN made USING (grp)"""
