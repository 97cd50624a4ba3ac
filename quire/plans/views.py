"""Document-shaped tables derived from the plain test tables, with whole numbers, in both engines.

Each view is a function that gives a DataFrame and a common table expression that gives the same rows in DuckDB.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.operators import native_text
from quire.schema import LAYOUT_LABELS, layout_labels, values_sql

PAGE_WIDTH, PAGE_HEIGHT, LINES = 612, 792, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def box_of(*names: str) -> Column:
    return g.box(*[F.col(n).cast("float") for n in names])


def micro(x: Column) -> Column:
    """A float or double as whole millionths."""
    return F.floor(x.cast("double") * 1_000_000).cast("long")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents, eight on a page, with boxes that lie 10 to 26 points apart."""
    split = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_idx", "line"))
    d, i = F.col("doc_id"), F.col("line_idx")
    y0 = (72 + (i % LINES) * 18 + (d * 3 + i * 7) % 9).cast("int")
    out = split.withColumn("page_idx", F.floor(i / LINES).cast("int")).withColumn("x0", F.lit(72)).withColumn("y0", y0)
    return out.withColumn("x1", (72 + 6 * F.least(F.char_length("line"), F.lit(78))).cast("int")).withColumn("y1", F.col("y0") + 12)


LINES_SQL = f"""v_split AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL),
v_numbered AS (SELECT doc_id, unnest(range(len(a)))::INTEGER AS line_idx, unnest(a) AS line FROM v_split),
v_lines AS (SELECT doc_id, line_idx, line, (line_idx // {LINES})::INTEGER AS page_idx, 72 AS x0,
  (72 + (line_idx % {LINES}) * 18 + (doc_id * 3 + line_idx * 7) % 9)::INTEGER AS y0, (72 + 6 * least(length(line), 78))::INTEGER AS x1,
  (84 + (line_idx % {LINES}) * 18 + (doc_id * 3 + line_idx * 7) % 9)::INTEGER AS y1 FROM v_numbered)"""


def dets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines as detections of all 25 labels."""
    d, i = F.col("doc_id"), F.col("line_idx")
    labelled = lines(spark, sf_dir).withColumn("label_id", ((d * 7 + i * 3) % 25).cast("int")).withColumn("score", ((d * 31 + i * 17) % 101).cast("int"))
    return labelled.join(F.broadcast(layout_labels(spark)), "label_id")


DETS_SQL = (
    LINES_SQL
    + ",\n"
    + values_sql("dim_label", "label_id, label, threshold, order_category, kind, role, level, vlm_type", LAYOUT_LABELS)
    + """,
v_dets AS (SELECT l.*, (doc_id * 31 + line_idx * 17) % 101 AS score, d.* FROM v_lines l JOIN dim_label d ON d.label_id = (doc_id * 7 + line_idx * 3) % 25)"""
)


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detections as recognised regions."""
    box = box_of("x0", "y0", "x1", "y1")
    text = F.array(F.struct(F.col("bbox").alias("bbox"), F.col("line").alias("text"), F.lit(1.0).cast("float").alias("score")))
    number = lambda a, b: F.concat(F.lit(a), F.col("line_idx"), F.lit(b))
    image = F.concat(F.lit("p"), F.col("page_idx"), F.lit("_o"), F.col("line_idx"), F.lit(".png"))
    return dets(spark, sf_dir).withColumn("bbox", box).select(
        "doc_id", "page_idx", F.col("line_idx").alias("order"), F.col("line_idx").alias("idx"), "label", "bbox", text.alias("text_lines"), number("x_{", "}").alias("latex"),
        number("i_{", "}").alias("inline_latex"), number("<table>", "</table>").alias("html"), image.alias("image"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "page_idx").distinct().withColumn("width", F.lit(float(PAGE_WIDTH))).withColumn("height", F.lit(float(PAGE_HEIGHT)))


_BOX_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as boxes, a group per order, numbered in a unique order."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", *_BOX_ORDER, "l_quantity")
    idx = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_BOX_ORDER)) - 1
    x0, y0 = (F.col("l_linenumber") * 10).cast("int"), F.col("l_quantity").cast("int")
    return items.select(
        F.col("l_orderkey").alias("grp"), idx.alias("idx"), x0.alias("x0"), y0.alias("y0"), (x0 + 20 + F.col("l_partkey") % 30).cast("int").alias("x1"), (y0 + 12 + F.col("l_suppkey") % 20).cast("int").alias("y1"),
        F.col("l_partkey").alias("partkey"),
    )


BOXES_SQL = f"""v_boxes AS (SELECT l_orderkey AS grp, (row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(_BOX_ORDER)}) - 1)::INTEGER AS idx,
  (l_linenumber * 10)::INTEGER AS x0, trunc(l_quantity)::INTEGER AS y0, (l_linenumber * 10 + 20 + l_partkey % 30)::INTEGER AS x1,
  (trunc(l_quantity) + 12 + l_suppkey % 20)::INTEGER AS y1, l_partkey AS partkey FROM lineitem)"""


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as eight steps of eight classes."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    steps = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda s: F.struct(s.alias("step"), F.slice("embedding", s * 8 + 1, F.lit(8)).alias("logits")))
    return emb.select("vec_id", F.explode(steps).alias("s")).select("vec_id", "s.step", "s.logits")


LOGITS_SQL = "v_logits AS (SELECT vec_id, s::INTEGER AS step, list_slice(embedding, s * 8 + 1, s * 8 + 8) AS logits FROM embeddings, range(8) t(s))"


def vlm_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layout answer per page, with boxes out of range, empty boxes, odd labels and rotations among its blocks, and the lines as contents."""
    d, i = F.col("doc_id"), F.col("line_idx")
    names = F.array(*[F.lit(n) for n in VLM_NAMES])
    turns = F.array(*[F.lit(n) for n in TURNS])
    a, b, c, e = (d * 13 + i * 37) % 1020, (d * 7 + i * 53) % 1010, (d * 13 + i * 71) % 1003, (d * 29 + i * 31) % 1001
    text = F.concat(
        F.lit("<|box_start|>"), F.concat_ws(" ", a, b, c, e), F.lit("<|box_end|><|ref_start|>"), F.element_at(names, ((d + i) % len(VLM_NAMES) + 1).cast("int")), F.lit("<|ref_end|>"),
        F.element_at(turns, ((d + i * 3) % len(TURNS) + 1).cast("int")), F.lit("\n"),
    )
    each = lines(spark, sf_dir).withColumn("t", text)
    ordered = F.array_sort(F.collect_list(F.struct("line_idx", "t", "line")))
    by_page = each.groupBy("doc_id", "page_idx").agg(ordered.alias("s"))
    return by_page.select(
        "doc_id", "page_idx", F.lit(1000.0).alias("width"), F.lit(500.0).alias("height"), F.array_join(F.transform("s", lambda x: x["t"]), "").alias("answer"), F.transform("s", lambda x: x["line"]).alias("contents")
    )


VLM_NAMES = ("text", "Title", "unknown", "inline_formula", "table", "image_caption", "equation", "index", "list", "header", "chart", "table_footnote", "code", "page_footnote", "phonetic", "zzz")
TURNS = ("", "<|rotate_up|>", "", "<|rotate_right|>", "", "<|rotate_down|>", "<|rotate_left|>")
VLM_SQL = (
    LINES_SQL
    + f""",
v_vlm AS (SELECT doc_id, page_idx, line_idx, line, (doc_id * 13 + line_idx * 37) % 1020 AS a, (doc_id * 7 + line_idx * 53) % 1010 AS b, (doc_id * 13 + line_idx * 71) % 1003 AS c,
  (doc_id * 29 + line_idx * 31) % 1001 AS e, lower(([{", ".join(f"'{n}'" for n in VLM_NAMES)}])[(doc_id + line_idx) % {len(VLM_NAMES)} + 1]) AS raw,
  ([{", ".join(f"'{n}'" for n in TURNS)}])[(doc_id + line_idx * 3) % {len(TURNS)} + 1] AS turn FROM v_lines),
v_blocks AS (SELECT doc_id, page_idx, line_idx, line, (row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY line_idx) - 1)::INTEGER AS idx, CASE raw WHEN 'unknown' THEN 'image' ELSE raw END AS label,
  CASE turn WHEN '<|rotate_right|>' THEN 90 WHEN '<|rotate_down|>' THEN 180 WHEN '<|rotate_left|>' THEN 270 ELSE 0 END AS angle,
  least(a, c) AS x0, least(b, e) AS y0, greatest(a, c) AS x1, greatest(b, e) AS y1 FROM v_vlm
  WHERE a <= 1000 AND b <= 1000 AND c <= 1000 AND e <= 1000 AND a <> c AND b <> e AND raw <> 'inline_formula')"""
)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure tokens of a table per order: two rows of three cells, some of them wide or tall."""
    k = F.col("o_orderkey")
    arr = lambda *xs: F.array(*[F.lit(x) for x in xs])
    cell = lambda n: F.when((k + n) % 5 == 0, arr("<td", ' colspan="2"', ">", "</td>")).when((k + n) % 7 == 0, arr("<td", ' rowspan="2"', ">", "</td>")).otherwise(arr("<td></td>"))
    row = lambda a: F.concat(arr("<tr>"), cell(a), cell(a + 1), cell(a + 2), arr("</tr>"))
    return table(spark, sf_dir, "orders").select(k.alias("grp"), F.concat(arr("<html>", "<tbody>"), row(0), row(3), arr("</tbody>", "</html>")).alias("tokens"))


def _cell_sql(n: int) -> str:
    return f"""CASE WHEN (o_orderkey + {n}) % 5 = 0 THEN ['<td', ' colspan="2"', '>', '</td>'] WHEN (o_orderkey + {n}) % 7 = 0 THEN ['<td', ' rowspan="2"', '>', '</td>'] ELSE ['<td></td>'] END"""


def _row_sql(a: int) -> str:
    return f"['<tr>'] || {_cell_sql(a)} || {_cell_sql(a + 1)} || {_cell_sql(a + 2)} || ['</tr>']"


TOKENS_SQL = f"v_tokens AS (SELECT o_orderkey AS grp, ['<html>', '<tbody>'] || {_row_sql(0)} || {_row_sql(3)} || ['</tbody>', '</html>'] AS tokens FROM orders)"

#: Formulas with something to clean up, chosen by key.
LATEX = (
    "x + y\\\\", "a}b{c", "\\left( x", "\\left( a \\right) + b", "{\\left( a } \\right) b", "\\begin{array}{cc} a & b", "a \\end{matrix}", "\\upalpha + \\uparrow \\upsilon",
    "\\boldmath x \\qquady \\qquad z", "\\Bar{x} \\sun \\copyright", "\\d x \\alpha\\,\\%", "\\{a\\} \\begin{cases} b \\end{cases}", "e \\end{array} \\begin{array}{ll} c", "\\left\\{ x \\right.", "\\frac{a}{b",
)


def latex(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = F.array(*[F.lit(x) for x in LATEX])
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.element_at(forms, (F.col("p_partkey") % len(LATEX) + 1).cast("int")).alias("raw"))


LATEX_SQL = f"v_latex AS (SELECT p_partkey AS id, ([{', '.join(chr(39) + x + chr(39) for x in LATEX)}])[p_partkey % {len(LATEX)} + 1] AS raw FROM part)"


#: Characters whose glyphs are made at once; longer documents are taken page by page.
CHARACTERS = 1 << 17


def whole_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, texts): a row per document, so that a page's lines are in the task that reads it. Texts are shuffled only if ids repeat; the pages of one id are then made of the lines of all its texts."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null and text is not null").select("doc_id", "text")
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        return docs.groupBy("doc_id").agg(F.sort_array(F.collect_list("text")).alias("texts"))
    return docs.select("doc_id", F.array("text").alias("texts"))


class Characters(NamedTuple):
    """Of whole pages: lines (document, number, top), and characters without line ends (number of their line here, place in it, code point)."""

    doc: np.ndarray
    number: np.ndarray
    y0: np.ndarray
    line: np.ndarray
    i: np.ndarray
    code: np.ndarray

    def left(self) -> np.ndarray:
        """Six points apart, four more after every ninth."""
        return 72 + 6 * self.i + 4 * ((self.i + np.fmod(self.doc, 9)[self.line]) // 9)

    def signs(self, rows: np.ndarray | slice) -> pa.DictionaryArray:
        values = np.flatnonzero(np.bincount(self.code))
        place = np.zeros(int(values[-1]) + 1 if len(values) else 1, dtype=np.int32)
        place[values] = np.arange(len(values))
        return pa.DictionaryArray.from_arrays(pa.array(place[self.code][rows]), pa.array([chr(c) for c in values.tolist()], pa.string()))

    def in_order(self, *last: np.ndarray, rows: np.ndarray | slice = slice(None)) -> np.ndarray | slice:
        """Rows by line, place and ``last``: as they are, but where lines of several texts stand beside each other."""
        same = (self.doc[1:] == self.doc[:-1]) & (self.number[1:] == self.number[:-1])
        return np.lexsort((*last, self.i[rows], np.cumsum(np.append(True, ~same))[self.line[rows]])) if same.any() else slice(None)


def _runs(doc: int, texts: list[str]) -> Iterator[list[tuple[int, int, str]]]:
    """A document's whole pages as stretches (document, number of the first line, text) in order."""
    if len(texts) == 1 and len(texts[0]) <= CHARACTERS:
        yield [(doc, 0, texts[0])]
        return
    split = [t.split("\n") for t in texts]
    for k in range(0, max(map(len, split)), LINES):
        yield [(doc, n, s[n]) for n in range(k, k + LINES) for s in split if n < len(s)]


def _characters(held: list[tuple[int, int, str]]) -> Characters:
    code = np.frombuffer("\n".join([*(t for _, _, t in held), ""]).encode("utf-32-le"), "<u4")
    ends = np.flatnonzero(code == 10)
    length = np.diff(ends, prepend=-1) - 1
    n = np.array([t.count("\n") + 1 for _, _, t in held])
    doc, first = (np.repeat(np.array([x[k] for x in held], dtype=np.int64), n) for k in (0, 1))
    number = first + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    code = code[code != 10]
    i = np.arange(len(code)) - np.repeat(np.cumsum(length) - length, length)
    return Characters(doc, number, 72 + number % LINES * 18 + np.fmod(doc * 3 + number * 7, 9), np.repeat(np.arange(len(doc)), length), i, code)


def characters(batches: Iterator[pa.RecordBatch]) -> Iterator[Characters]:
    """The characters of ``whole_documents``, many whole pages at a time."""
    held: list[tuple[int, int, str]] = []
    size = 0
    for batch in batches:
        for doc, texts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for run in _runs(doc, texts):
                held += run
                size += sum(len(t) + 1 for _, _, t in run)
                if size >= CHARACTERS:
                    yield _characters(held)
                    held, size = [], 0
    if held:
        yield _characters(held)


def glyphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Characters of the lines as glyphs: six points apart, four more after every ninth, every eleventh doubled on the spot or as a shadow, two fonts."""
    for c in characters(batches):
        row = np.repeat(np.arange(len(c.code)), 1 + ((c.i % 11 == 5) & (c.code != 32)))
        copy = np.zeros(len(row), dtype=np.int64)
        copy[1:] = row[1:] == row[:-1]
        order = c.in_order(copy, rows=row)
        row, copy = row[order], copy[order]
        i, line = c.i[row], c.line[row]
        shift = copy * (i % 2) * 2
        doc, x0, y0 = c.doc[line], (c.left()[row] + shift).astype(np.float32), (c.y0[line] + shift).astype(np.float32)
        fonts = pa.DictionaryArray.from_arrays(pa.array((np.fmod(doc + i, 97) >= 90).astype(np.int32)), pa.array(["Regular", "Bold"]))
        whole = lambda v: np.full(len(row), v, dtype=np.int32)
        cells = [doc, (c.number // LINES).astype(np.int32)[line], ((c.number % LINES)[line] * 1_000_000 + i * 2 + copy).astype(np.int32), c.signs(row), x0, y0, x0 + np.float32(5), y0 + np.float32(12), np.zeros(len(row), dtype=np.float32), fonts, whole(10_000), whole(400)]
        yield pa.table(cells, [x.split()[0] for x in native_text.GLYPHS.split(", ")])


#: Regions of every page: two rows of two, the right ones wide.
AREAS = tuple((72 + 240 * (k % 2), 60 + 76 * (k // 2), 312 if k % 2 == 0 else 1600, 136 + 76 * (k // 2)) for k in range(4))


def regions_and_glyphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Characters of the lines as glyphs whose lines are given, six points apart, four more after every ninth, behind the AREAS of their page."""
    for c in characters(batches):
        order = c.in_order()
        i, line = c.i[order], c.line[order]
        page_idx = c.number // LINES
        new = np.append(True, (c.doc[1:] != c.doc[:-1]) | (page_idx[1:] != page_idx[:-1]))
        page, at = (np.cumsum(new) - 1), np.flatnonzero(new)
        n, k = len(AREAS) * len(at), len(AREAS)
        # Both parts are in the pages' order already; a stable sort puts a page's regions before its glyphs.
        place = np.argsort(np.concatenate([np.repeat(np.arange(len(at)), k), page[line]]), kind="stable")
        both = lambda a, b, kind: np.concatenate([np.asarray(a, dtype=kind), np.asarray(b, dtype=kind)])[place]
        x0, y0 = c.left()[order], c.y0[line]
        corner = lambda m, own: both(np.tile([a[m] for a in AREAS], len(at)), own, np.float32)
        signs = c.signs(order)
        numbers = pa.concat_arrays([pa.nulls(n, pa.int32()), signs.indices]).take(pa.array(place))
        cells = {
            "doc_id": both(np.repeat(c.doc[at], k), c.doc[line], np.int64), "page_idx": both(np.repeat(page_idx[at], k), page_idx[line], np.int32), "kind": (place >= n).astype(np.int32),
            "line_idx": both(np.zeros(n), c.number[line], np.int32), "char_idx": both(np.tile(np.arange(k), len(at)), i, np.int32), "ch": pa.DictionaryArray.from_arrays(numbers, signs.dictionary),
            "x0": corner(0, x0), "y0": corner(1, y0), "x1": corner(2, x0 + 5), "y1": corner(3, y0 + 12), "rotation": np.zeros(len(place), dtype=np.float32),
        }
        yield pa.table(cells)
