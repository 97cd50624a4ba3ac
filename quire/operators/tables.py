"""Tables: cells to logical positions, spans to cells, grids and structure tokens to HTML."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import geometry as g
from quire.operators.matching import argmax_join

#: Heights apart that make a row, widths apart that make a column, how far a span's extent may miss, least overlap.
ROW_GAP, COLUMN_GAP, FIT, LEAST_IOU = 10.0, 15.0, 10.0, 1e-8
#: Rows and columns of a cell, ends included.
LOGIC = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("row_start", "row_end", "col_start", "col_end")]))
_F = np.float32


# --- logical positions of cells --------------------------------------------------------------------------------------


def split_rows(tops: np.ndarray, gap: float) -> list[np.ndarray]:
    """Cell numbers of each row: a row ends where the next cell's top is more than ``gap`` away."""
    return np.split(np.arange(len(tops)), np.flatnonzero(np.abs(np.diff(tops)) > _F(gap)) + 1) if len(tops) else []


def column_starts(left: np.ndarray, right: np.ndarray, rows: list[np.ndarray], gap: float) -> tuple[np.ndarray, np.ndarray]:
    """Starts and widths of columns.

    The longest row (the last one of equals) gives the first starts and how far the table reaches. Then both edges of every cell are tried in reading order.
    An edge beyond the reach moves it there, and starts a column if it is a left one; only one near the first start is passed over. For any other edge, the first
    start that is right of it or within ``gap`` decides: if it isn't within ``gap``, the edge starts a column before it. (Starts of a row that slants can be out of order.)
    """
    longest = rows[max(range(len(rows)), key=lambda k: (len(rows[k]), k))]
    starts, reach = left[longest], right[longest[-1]]
    cells = np.concatenate(rows)
    for x, opens in zip(np.stack([left[cells], right[cells]], axis=1).ravel(), np.tile([True, False], len(cells)), strict=True):
        near = (x - _F(gap) <= starts) & (starts <= x + _F(gap))
        if x > reach:
            if not near[0]:
                reach = x
                starts = np.append(starts, x) if opens else starts
            continue
        first = np.flatnonzero(near | (x < starts))[:1]
        if len(first) and not near[first[0]]:
            starts = np.insert(starts, first[0], x)
    return starts, np.diff(np.append(starts, reach))


def spanned(sizes: np.ndarray, start: int, extent: np.float32) -> int:
    """How many columns or rows from ``start`` an extent covers: up to the first running sum within FIT of it, or beyond it; of a sum beyond, one
    less if the sum before is nearer (but one at least); all that are left if no sum gets there."""
    sums = np.cumsum(sizes[start:], dtype=_F)
    fits = np.abs(sums - extent) <= _F(FIT)
    there = np.flatnonzero(fits | (sums > extent))
    if not len(there):
        return len(sizes) - start
    k = int(there[0])
    nearer_before = not fits[k] and k > 0 and abs(sums[k] - sizes[start + k] - extent) <= abs(sums[k] - extent)
    return k if nearer_before else k + 1


def recover_cells(polygons: np.ndarray, row_gap: float = ROW_GAP, column_gap: float = COLUMN_GAP) -> list[tuple[int, int, int, int]]:
    """(row_start, row_end, col_start, col_end) of each cell, from corners (n, 4, 2): upper left, lower left, lower right, upper right, in reading order."""
    p = np.asarray(polygons, dtype=_F).reshape(-1, 4, 2)
    if not len(p):
        return []
    rows = split_rows(p[:, 0, 1], row_gap)
    starts, column_widths = column_starts(p[:, 0, 0], p[:, 2, 0], rows, column_gap)
    side = lambda a, b: np.sqrt(((p[:, b] - p[:, a]) ** 2).sum(axis=1, dtype=_F), dtype=_F)
    widths, heights = side(3, 0), side(1, 0)
    tops = [p[r[0], 0, 1] for r in rows]
    tall = np.append(np.diff(np.array(tops, dtype=_F)), max(_F(0), heights[rows[-1]].max())).astype(_F)
    out: list = [None] * len(p)
    for r, row in enumerate(rows):
        used = 0
        for c in row:
            nearest = int(np.argmin(np.abs(starts - p[c, 0, 0])))
            first = max(used, nearest)
            n = spanned(column_widths, first, widths[c])
            used += max(n, 0)
            k = spanned(tall, r, heights[c])
            out[c] = (r, r + k - 1, first, first + n - 1)
    return out


@F.pandas_udf(LOGIC)
def recover(polygons: pd.Series) -> pd.Series:
    """Logical positions of a table's cells from an array of their 8 corner numbers."""
    names = ("row_start", "row_end", "col_start", "col_end")
    return pd.Series([None if p is None else [dict(zip(names, map(int, c), strict=True)) for c in recover_cells(np.array([list(q) for q in p], dtype=_F))] for p in polygons])


def token_positions(tokens: Sequence[str]) -> list[tuple[int, int, int, int]]:
    """Logical positions of a token stream's cells, beside cells that reach down from rows above."""
    out, taken = [], set()
    row = column = 0
    it = iter(enumerate(tokens))
    for _, token in it:
        if token == "<tr>":
            column = 0
        elif token == "</tr>":
            row += 1
        elif token.startswith("<td"):
            spans = {"colspan": 1, "rowspan": 1}
            if token != "<td></td>":
                for _, part in it:
                    if part.startswith(">"):
                        break
                    for name in spans:
                        value = _span_value(part, name)
                        if value is not None:
                            spans[name] = value
                            break
            while (row, column) in taken:
                column += 1
            cell = (row, row + spans["rowspan"] - 1, column, column + spans["colspan"] - 1)
            out.append(cell)
            taken.update((r, c) for r in range(cell[0], cell[1] + 1) for c in range(cell[2], cell[3] + 1))
            column += spans["colspan"]
    return out


def _span_value(token: str, name: str) -> int | None:
    parts = token.split(f"{name}=")
    if len(parts) < 2:
        return None
    value = parts[1].strip("\"' >")
    return int(value) if re.fullmatch(r"\+?[0-9]+", value) else None


@F.pandas_udf(LOGIC)
def logic_points(tokens: pd.Series) -> pd.Series:
    names = ("row_start", "row_end", "col_start", "col_end")
    return pd.Series([None if t is None else [dict(zip(names, c, strict=True)) for c in token_positions(list(t))] for t in tokens])


# --- spans to cells --------------------------------------------------------------------------------------------------


def match_cells(spans: DataFrame, cells: DataFrame, group: Sequence[str], drop_above: bool = True) -> DataFrame:
    """(group, cell_idx, spans): the recognised spans of each cell, in order, as array of (span_idx, text).

    A span goes to the cell of largest intersection over union, then of smallest corner distance, then the first; without any overlap to none.
    ``drop_above`` leaves out spans that end above all cells. ``spans``: group, span_idx, bbox, text; ``cells``: group, cell_idx, bbox.
    """
    if drop_above:
        top = cells.groupBy(*group).agg(F.min(F.least("bbox.y0", "bbox.y1")).alias("_top"))
        spans = spans.join(top, list(group)).where(F.col("bbox.y1") >= F.col("_top")).drop("_top")
    right = cells.select(*group, "cell_idx", F.col("bbox").alias("cell"))
    share, far = g.iou_double(F.col("bbox"), F.col("cell")), g.corner_distance(F.col("cell"), F.col("bbox"))
    matched = argmax_join(spans, right, group, ["span_idx"], [-(1.0 - share), -far], "cell_idx")
    good = matched.where((1.0 - g.iou_double(F.col("bbox"), F.col("cell"))) < 1.0 - LEAST_IOU)
    return good.groupBy(*group, "cell_idx").agg(F.array_sort(F.collect_list(F.struct("span_idx", "text"))).alias("spans"))


def match_polygons(spans: DataFrame, cells: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, span_idx, cell_idx): each span with the cell whose extent covers most of it, the first of equals; spans that no cell touches are left out."""
    right = cells.select(*group, "cell_idx", F.col("bbox").alias("cell"))
    w = F.least("bbox.x1", "cell.x1") - F.greatest("bbox.x0", "cell.x0")
    h = F.least("bbox.y1", "cell.y1") - F.greatest("bbox.y0", "cell.y0")
    ratio = g.f32((w * h) / F.greatest(g.area(F.col("bbox")), g.f32(1e-6)))
    return argmax_join(spans, right, group, ["span_idx"], [ratio], "cell_idx", where=(w > 0) & (h > 0)).select(*group, "span_idx", "cell_idx")


def nearest_start(cells: DataFrame, columns: DataFrame, group: Sequence[str]) -> DataFrame:
    """Each cell (group, cell_idx, x0) with the column start (group, col_idx, start) nearest to its left edge, the first of equals."""
    return argmax_join(cells, columns, group, ["cell_idx"], [-F.abs(F.col("start") - F.col("x0"))], "col_idx")


# --- HTML ------------------------------------------------------------------------------------------------------------


def cell_html(texts: Column) -> Column:
    """A cell's content from its spans' texts. One text stands as it is. Several are stripped of one leading blank and of bold tags, joined by blanks, and bold together if the first one was."""
    n = F.size(texts)
    bold = F.coalesce(F.get(texts, F.lit(0)).contains("<b>"), F.lit(False))

    def part(x: Column, i: Column) -> Column:
        s = F.when(x.startswith(" "), F.substring(x, F.lit(2), F.length(x))).otherwise(x)
        s = F.when(s.contains("<b>"), F.substring(s, F.lit(4), F.length(s))).otherwise(s)
        s = F.when(s.contains("</b>"), F.substring(s, F.lit(1), F.greatest(F.length(s) - 4, F.lit(0)))).otherwise(s)
        return F.when(s == "", "").when((i != n - 1) & ~s.endswith(" "), F.concat(s, F.lit(" "))).otherwise(s)

    several = F.array_join(F.transform(texts, part), "")
    return F.when(n == 0, "").when(n == 1, F.get(texts, F.lit(0))).otherwise(F.when(bold, F.concat(F.lit("<b>"), several, F.lit("</b>"))).otherwise(several))


def splice(tokens: DataFrame, matched: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, html): structure tokens with cell contents put in. ``tokens``: group, tokens; ``matched``: group, cell_idx, spans.

    The n-th token that closes a cell takes the content of cell n. Head and body tags are taken out.
    """
    by_table = matched.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("cell_idx", cell_html(F.transform("spans", lambda s: s["text"]))))).alias("cells"))
    joined = tokens.join(by_table, list(group), "left").withColumn("cells", F.coalesce("cells", F.create_map().cast("map<int,string>")))
    # A mark before what closes a cell cuts the joined tokens into pieces; a cell's content goes between two of them.
    mark = "\x00"
    one = lambda x: F.when(x == "<td></td>", F.lit(f"<td>{mark}</td>")).when(x.contains("</td>"), F.concat(F.lit(mark), x)).otherwise(x)
    pieces = F.split(F.array_join(F.transform("tokens", one), ""), mark)
    html = F.array_join(F.transform(pieces, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.coalesce(F.try_element_at("cells", i - 1), F.lit("")), x))), "")
    return joined.select(*group, F.regexp_replace(html, "</?(thead|tbody)>", "").alias("html"))


def plot_table(cells: Sequence[tuple[int, int, int, int]], texts: dict[int, str]) -> str:
    """HTML of cells at logical positions. Where cells overlap the later one shows. Edge rows and columns without text that cells don't fill are cut off: above, below, left, right."""
    frame = "<html><body><table>{}</table></body></html>"
    if not cells:
        return frame.format("")
    grid: dict[tuple[int, int], int] = {}
    for k, (r0, r1, c0, c1) in enumerate(cells):
        grid.update({(r, c): k for r in range(r0, r1 + 1) for c in range(c0, c1 + 1)})
    top, bottom, left, right = 0, max(c[1] for c in cells), 0, max(c[3] for c in cells)

    def noise(row: int | None, column: int | None) -> bool:
        places = [(row, c) for c in range(left, right + 1)] if row is not None else [(r, column) for r in range(top, bottom + 1)]
        found = [grid[p] for p in places if p in grid]
        return not any(texts.get(k, "").strip() for k in found) and len(found) < max(1, len(places))

    while top <= bottom and noise(top, None):
        top += 1
    while bottom >= top and noise(bottom, None):
        bottom -= 1
    while left <= right and noise(None, left):
        left += 1
    while right >= left and noise(None, right):
        right -= 1
    out = []
    for r in range(top, bottom + 1) if left <= right else ():
        out.append("<tr>")
        for c in range(left, right + 1):
            k = grid.get((r, c))
            if k is None:
                out.append("<td></td>")
                continue
            r0, r1, c0, c1 = cells[k]
            r0, c0 = max(r0, top), max(c0, left)
            if (r, c) == (r0, c0):
                out.append(f"<td rowspan={min(r1, bottom) - r0 + 1} colspan={min(c1, right) - c0 + 1}>{texts.get(k, '')}</td>")
        out.append("</tr>")
    return frame.format("".join(out))


@F.pandas_udf(T.StringType())
def grid_html(logic: pd.Series, texts: pd.Series) -> pd.Series:
    """HTML from an array of logical positions and an array of the cells' texts (null for none)."""
    out = []
    for cells, words in zip(logic, texts, strict=True):
        if cells is None:
            out.append(None)
            continue
        places = [(c["row_start"], c["row_end"], c["col_start"], c["col_end"]) for c in cells]
        out.append(plot_table(places, {i: w for i, w in enumerate(words if words is not None else ()) if w}))
    return pd.Series(out)


def grid(cells: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, row, col, cell_idx): the slots that cells (group, cell_idx, row_start, row_end, col_start, col_end) fill; the last cell wins a slot."""
    rows = cells.select(*group, "cell_idx", "col_start", "col_end", F.explode(F.sequence("row_start", "row_end")).alias("row"))
    slots = rows.select(*group, "cell_idx", "row", F.explode(F.sequence("col_start", "col_end")).alias("col"))
    return slots.groupBy(*group, "row", "col").agg(F.max("cell_idx").alias("cell_idx"))
