"""Glyphs to spans, lines and the texts of regions.

Removing duplicates and building spans and lines depend on what has been gathered so far. Glyphs are dealt and sorted by page once; a task then works on
Arrow batches of many whole pages with array operations, and walks glyph by glyph only where a glyph may depend on the ones before it.

A glyph's row is many times its share of a file, so where glyphs come from a reader, the functions ``read_...`` take the documents and the reader (a function from Arrow
batches of documents to tables of whole pages, in order): pages are worked on in the task that reads them, and no glyph is shuffled, sorted or spilled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.functions import text as t

#: Tolerances in points and shares.
NEAR, SHIFT, RIGID, OVERLAP = 1.0, 2.5, 0.1, 0.45
SUPER_HEIGHT, SUPER_RISE, SPAN_HEIGHT, SPACE, SPARSE = 0.7, 0.1, 0.33, 0.25, 0.5
#: Signs that may stand beyond a region's edge, at the end and at the start of a line.
STOP_SIGNS = ".!?。！？)）\"”:：;；]】}>》、,，-—–"
START_SIGNS = "(（\"“【{《<「『["
GLYPHS = "doc_id long, page_idx int, char_idx int, ch string, x0 float, y0 float, x1 float, y1 float, rotation float, font string, size int, weight int"


def scan_glyphs(raw: DataFrame) -> DataFrame:
    """Glyphs from a native reader's characters: doc_id, page_idx, char_idx, ch, loose and tight (left, bottom, right, top in points from below), page_height,
    angle, font, font_size, weight. Characters without a sign or any box are skipped; the loose box goes first."""
    b = F.coalesce("loose", "tight")
    top = g.page_to_top_left(b["left"], b["bottom"], b["right"], b["top"], F.col("page_height"))
    size = F.round(F.col("font_size").cast("double") * 1000).cast("int")
    boxed = raw.where(F.col("ch").isNotNull() & b.isNotNull()).withColumn("_b", top)
    return boxed.select(
        "doc_id", "page_idx", "char_idx", "ch", *[F.col(f"_b.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")], F.coalesce(F.col("angle").cast("float"), g.f32(0)).alias("rotation"), "font",
        size.alias("size"), F.coalesce("weight", F.lit(0)).alias("weight"),
    )


SPANS = "doc_id long, page_idx int, line_idx int, span_idx int, text string, x0 float, y0 float, x1 float, y1 float, rotation float, font string, size int, weight int"
FILLED = "doc_id long, page_idx int, idx int, text string, n_chars int"
#: From batches of documents to tables of whole pages: GLYPHS by char_idx, or regions and glyphs as ``_fill`` takes them.
Read = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.Table]]
#: Glyphs of whole pages that are handled at once, and slots in which they are counted.
ROWS, SLOTS = 1 << 17, 1 << 20
_LINE_ENDS = ("\n", "\x02")
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _by_page(rows: DataFrame, *order: str) -> DataFrame:
    """Rows dealt by page and sorted. (By a hash of the page: a repartition by columns that a join was made on may be left out, and pages come in pieces.)"""
    return rows.repartition(F.xxhash64("doc_id", "page_idx")).sortWithinPartitions("doc_id", "page_idx", *order)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in any column; the first row does."""
    out = np.zeros(len(columns[0]), dtype=bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole pages (doc_id, page_idx first) from batches sorted by page."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= ROWS:
            table = pa.Table.from_batches(held)
            last = int(np.flatnonzero(_changes(np.asarray(table.column(0)), np.asarray(table.column(1))))[-1])
            if last:
                yield table.slice(0, last)
                held, rows = table.slice(last).to_batches(), rows - last
    if rows:
        yield pa.Table.from_batches(held)


def _floats(table: pa.Table, *names: str) -> np.ndarray:
    return np.stack([np.asarray(table.column(n), dtype=np.float32) for n in names], axis=1)


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, list]:
    """A number for each row, and the value of each number; null is a value."""
    d = column.combine_chunks()
    if not pa.types.is_dictionary(column.type):
        d = pc.dictionary_encode(d, null_encoding="encode")
    d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
    values = d.dictionary.to_pylist()
    # A reader's dictionary may leave null without a number.
    return np.asarray(pc.fill_null(d.indices, len(values))).astype(np.int64), [*values, None] if d.indices.null_count else values


def _merged(*columns: np.ndarray) -> np.ndarray:
    """One number for each combination of values."""
    out = np.zeros(len(columns[0]), dtype=np.int64)
    for c in columns:
        if len(c) and (c != c[0]).any():
            if c.dtype.kind == "i" and int(c.max()) - int(c.min()) < 1 << 16:
                n, place = int(c.max()) - int(c.min()) + 1, c - c.min()
            else:
                values, place = np.unique(c, return_inverse=True)
                n = len(values)
            out = out * n + place
            if out.max() > 1 << 31:
                out = np.unique(out, return_inverse=True)[1]
    return out


def _shadows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each box of ``b`` is that of ``a`` moved a little on both axes and still covers much of it."""
    d = b - a
    moved = np.abs(d[:, :2])
    rigid = (np.abs(d[:, :2] - d[:, 2:]) <= np.float32(RIGID)).all(axis=1) & ((moved > NEAR) & (moved <= SHIFT)).all(axis=1)
    a, b = a.astype(np.float64), b.astype(np.float64)
    common = np.minimum(a[:, 2:], b[:, 2:]) - np.maximum(a[:, :2], b[:, :2])
    smaller = np.minimum(*(np.prod(x[:, 2:] - x[:, :2], axis=1) for x in (a, b)))
    share = (np.prod(common, axis=1) / np.where(smaller == 0, 1, smaller)).astype(np.float32)
    return rigid & (common > 0).all(axis=1) & (smaller != 0) & (share >= np.float32(OVERLAP))


def kept_glyphs(page: np.ndarray, sign: np.ndarray, white: np.ndarray, box: np.ndarray) -> np.ndarray:
    """Which glyphs stay, over whole pages in order. White space does. Others go if they are the last kept glyph of the page shifted a little (a shadow), or nearly
    cover an earlier kept glyph of the page with the same signature.

    Glyphs that share no square of twice the tolerance, on any of four grids shifted by it, are never near each other. Of two neighbours that share squares with each other only, the first of
    which is no shadow, the second goes if it is near or a shadow, and so does a shadow if neither shares a square: that is decided for all of them at once. Only other glyphs that share squares, other shadows, and what follows a glyph that went
    are looked at one by one.
    """
    n = len(page)
    group = _merged(page, sign)
    square = np.floor(box[:, :2].astype(np.float64) / NEAR).astype(np.int64)
    twin = np.zeros(n, dtype=bool)
    mate = np.full(n, -1)
    several = np.zeros(n, dtype=bool)
    inked = np.flatnonzero(~white)
    for dx in (0, 1):
        for dy in (0, 1):
            key = (group[inked] * 0x2545F491 + (square[inked, 0] + dx >> 1)) * 0x9E3779B1 + (square[inked, 1] + dy >> 1)
            # Keys that share a slot with no other aren't sorted.
            slot = (key * 0x4F1BBCDCBFA53E0B - (1 << 62) >> 40) & (SLOTS - 1)
            may = np.flatnonzero(np.bincount(slot, minlength=SLOTS)[slot] > 1)
            may = may[np.argsort(key[may], kind="stable")]
            same = np.diff(key[may]) == 0
            own = inked[may]
            first = np.flatnonzero(same)
            a, b = own[first], own[first + 1]
            twin[a] = twin[b] = True
            # Runs of two have a mate each; longer ones, and glyphs with different mates on different grids, are looked at one by one.
            more = np.flatnonzero(same[1:] & same[:-1])
            several[own[more]] = several[own[more + 1]] = several[own[more + 2]] = True
            for x, y in ((a, b), (b, a)):
                several[x[(mate[x] >= 0) & (mate[x] != y)]] = True
                mate[x] = y
    shadow = np.zeros(n, dtype=bool)
    alike = np.flatnonzero(group[1:] == group[:-1]) + 1
    shadow[alike] = _shadows(box[alike - 1], box[alike]) & ~white[alike]
    keep = np.ones(n, dtype=bool)
    seen: dict[tuple[int, int, int], list[list[float]]] = {}

    def goes(i: int) -> bool:
        if white[i]:
            return False
        last = i - 1
        while last >= 0 and not keep[last]:
            last -= 1
        if last >= 0 and group[last] == group[i] and (shadow[i] if last == i - 1 else _shadows(box[last : last + 1], box[i : i + 1])[0]):
            return True
        if not twin[i]:
            return False
        k, (x, y), b = int(group[i]), square[i].tolist(), box[i].tolist()
        for u in (x - 1, x, x + 1):
            for v in (y - 1, y, y + 1):
                for o in seen.get((k, u, v), ()):
                    if abs(b[0] - o[0]) <= NEAR and abs(b[1] - o[1]) <= NEAR and abs(b[2] - o[2]) <= NEAR and abs(b[3] - o[3]) <= NEAR:
                        return True
        seen.setdefault((k, x, y), []).append(b)
        return False

    # Neighbours that are each other's only mates.
    a = np.flatnonzero(twin[:-1] & (mate[:-1] == np.arange(1, n)) & (mate[1:] == np.arange(n - 1)) & ~several[:-1] & ~several[1:] & ~shadow[:-1])
    near = (np.abs(box[a + 1].astype(np.float64) - box[a]) <= NEAR).all(axis=1)
    alone = ~twin & ~shadow
    lone = np.flatnonzero(alone[:-1] & shadow[1:] & ~twin[1:]) + 1
    gone = np.concatenate([a[near | shadow[a + 1]] + 1, lone])
    keep[gone] = False
    asked = twin | shadow
    asked[a] = asked[a + 1] = asked[lone] = False
    after = gone[gone + 1 < n] + 1
    asked[after[group[after] == group[after - 1]]] = True
    done = 0
    for i in np.flatnonzero(asked).tolist():
        if i < done:
            continue
        while done <= i < n:
            keep[i] = not goes(i)
            done = i + 1
            if not keep[i] and done < n and page[done] == page[i]:
                i = done
    return keep


def span_starts(page: np.ndarray, style: np.ndarray, ends: np.ndarray, box: np.ndarray) -> np.ndarray:
    """Which glyphs begin a span: the page's first, one of another style than the one before, one after a newline or soft hyphen (``ends``), and a
    superscript to the right of all of the span so far. Only a glyph that is higher than the one before and right of it can be that."""
    first = _changes(page, style)
    first[1:] |= ends[:-1]
    x0, y0, x1, y1 = box.astype(np.float64).T
    rise, tall = float(np.float32(SUPER_RISE)), float(np.float32(SUPER_HEIGHT))
    begun = np.maximum.accumulate(np.where(first, np.arange(len(page)), 0))
    may = np.flatnonzero(~first[1:] & (y0[1:] < y0[:-1]) & (x0[1:] > x1[:-1])) + 1
    last = 0
    for i in may.tolist():
        s = slice(max(int(begun[i]), last), i)
        top, bottom = y0[s].min(), y1[s].max()
        if y0[i] < top - (bottom - top) * rise and y1[i] < (bottom - top) * tall + top and x0[i] > x1[s].max():
            first[i] = True
            last = i
    return first


def line_starts(page: np.ndarray, ends: np.ndarray, rotation: np.ndarray, box: np.ndarray) -> np.ndarray:
    """Which spans begin a line: the page's first, one after a newline or soft hyphen, at a turn of 45 to 135 degrees, or below all of the line so far."""
    out = np.zeros(len(page), dtype=bool)
    pi = np.float32(np.pi)
    top, low, fresh = box[:, 1].tolist(), box[:, 3].tolist(), _changes(page).tolist()
    after, turns = [False, *ends[:-1].tolist()], rotation.tolist()
    bottom, turn = 0.0, 0.0
    for i in range(len(out)):
        begins = fresh[i] or after[i] or top[i] > bottom
        if not begins and turns[i] != turn:
            d = abs(np.float32(turns[i]) - np.float32(turn)) % (2 * pi)
            begins = bool(pi / 4 <= min(d, 2 * pi - d) <= 3 * pi / 4)
        if begins:
            out[i], bottom, turn = True, low[i], turns[i]
        elif low[i] > bottom:
            bottom = low[i]
    return out


def _within(page: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Numbers from 0 on each page of the runs that begin at ``starts``."""
    number = np.cumsum(starts)
    return (number - number[np.maximum.accumulate(np.where(_changes(page), np.arange(len(page)), 0))]).astype(np.int32)


def _kept(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Of whole pages: the pages' numbers, the glyphs' signs (numbers, and their values), style, rotations and boxes, and which glyphs stay."""
    page = np.cumsum(_changes(np.asarray(table.column("doc_id")), np.asarray(table.column("page_idx"))))
    ch, signs = _codes(table.column("ch"))
    font = _merged(_codes(table.column("font"))[0], *(np.asarray(table.column(c)) for c in ("size", "weight")))
    rotation, box = _floats(table, "rotation")[:, 0], _floats(table, "x0", "y0", "x1", "y1")
    half_up = np.trunc(rotation * np.float32(1000) + np.copysign(np.float32(0.5), rotation)).astype(np.int64)
    keep = kept_glyphs(page, _merged(ch, font, half_up), np.array([c.isspace() for c in signs], dtype=bool)[ch], box)
    return page, ch, signs, font, rotation, box, keep


def _grouped(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """Of whole pages: the kept glyphs, their span and line numbers, and where spans begin."""
    page, ch, signs, font, rotation, box, keep = _kept(table)
    table, page, ch, rotation, box = table.filter(pa.array(keep)), page[keep], ch[keep], rotation[keep], box[keep]
    ends = np.array([c in _LINE_ENDS for c in signs], dtype=bool)[ch]
    first = span_starts(page, _merged(font[keep], rotation), ends, box)
    at = np.flatnonzero(first)
    around = np.concatenate([np.minimum.reduceat(box[:, :2], at), np.maximum.reduceat(box[:, 2:], at)], axis=1)
    lines = _within(page[at], line_starts(page[at], ends[np.append(at[1:], len(page)) - 1], rotation[at], around))
    return table, _within(page, first), np.repeat(lines, np.diff(np.append(at, len(page)))), at


def group_glyphs(glyphs: DataFrame) -> DataFrame:
    """The kept glyphs with span_idx and line_idx."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pages in _whole_pages(batches):
            table, span, line, _ = _grouped(pages)
            yield from table.append_column("span_idx", pa.array(span)).append_column("line_idx", pa.array(line)).combine_chunks().to_batches()

    return _by_page(glyphs.select(*[c.split()[0] for c in GLYPHS.split(", ")]), "char_idx").mapInArrow(run, f"{GLYPHS}, span_idx int, line_idx int")


def _spans(pages: pa.Table) -> Iterator[pa.RecordBatch]:
    """The spans (SPANS) of whole pages of glyphs."""
    table, span, line, at = _grouped(pages)
    ch, signs = _codes(table.column("ch"))
    shown = np.array(signs, dtype=object)[ch].tolist()
    text = ["".join(shown[a:b]) for a, b in zip(at, np.append(at[1:], len(shown)), strict=True)]
    box = _floats(table, "x0", "y0", "x1", "y1")
    corners = [f.reduceat(box[:, k], at) for k, f in enumerate((np.minimum, np.minimum, np.maximum, np.maximum))]
    first = table.take(pa.array(at))
    cells = [first.column("doc_id"), first.column("page_idx"), line[at], span[at], pa.array(text, pa.string()), *corners, first.column("rotation"), first.column("font").cast(pa.string()), *(first.column(c) for c in ("size", "weight"))]
    names = [c.split()[0] for c in SPANS.split(", ")]
    yield from pa.table([c if isinstance(c, (pa.ChunkedArray, pa.Array)) else pa.array(c) for c in cells], names).combine_chunks().to_batches()


def _boxed(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "page_idx", "line_idx", "span_idx", "text", g.raw_box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("bbox"), "rotation", "font", "size", "weight")


def glyph_spans(glyphs: DataFrame) -> DataFrame:
    """``spans`` of ``group_glyphs`` in one pass: glyphs are dealt by page once and leave the task as spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pages in _whole_pages(batches):
            yield from _spans(pages)

    return _boxed(_by_page(glyphs.select(*[c.split()[0] for c in GLYPHS.split(", ")]), "char_idx").mapInArrow(run, SPANS))


def read_spans(documents: DataFrame, read: Read) -> DataFrame:
    """``glyph_spans`` of the glyphs that ``read`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pages in read(batches):
            if pages.num_rows:
                yield from _spans(pages)

    return _boxed(documents.mapInArrow(run, SPANS))


def read_counts(documents: DataFrame, read: Read) -> DataFrame:
    """(doc_id, page_idx, n_glyphs, n_kept): the glyphs of each page that ``read`` gives any of, and how many of them ``group_glyphs`` keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pages in read(batches):
            if pages.num_rows:
                page, *_, keep = _kept(pages)
                at = np.flatnonzero(_changes(page))
                first = pages.select(["doc_id", "page_idx"]).take(pa.array(at))
                n, kept = np.diff(np.append(at, len(page))), np.add.reduceat(keep, at, dtype=np.int64)
                yield from first.append_column("n_glyphs", pa.array(n)).append_column("n_kept", pa.array(kept)).combine_chunks().to_batches()

    return documents.mapInArrow(run, "doc_id long, page_idx int, n_glyphs long, n_kept long")


def spans(grouped: DataFrame) -> DataFrame:
    """One row per span: text, box, and style and rotation of its first glyph."""
    ordered = F.array_sort(F.collect_list(F.struct("char_idx", "ch", "rotation", "font", "size", "weight")))
    one = grouped.groupBy("doc_id", "page_idx", "line_idx", "span_idx").agg(
        ordered.alias("c"), g.raw_box(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).alias("bbox")
    )
    text = F.array_join(F.transform("c", lambda x: x["ch"]), "")
    return one.select("doc_id", "page_idx", "line_idx", "span_idx", text.alias("text"), "bbox", *[F.col("c")[0][k].alias(k) for k in ("rotation", "font", "size", "weight")])


def native_fill_pages(glyphs: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page_idx) whose text can be taken over: not turned (rotation 0), and with an upright glyph."""
    upright = glyphs.where(F.abs("rotation") < 1e-3).select("doc_id", "page_idx").distinct()
    return pages.where("rotation = 0").select("doc_id", "page_idx").join(upright, ["doc_id", "page_idx"], "left_semi")


def median(values: Column) -> Column:
    """Of an array of floats, the middle one or the mean of the two; 0 for none."""

    def middle(s: Column) -> Column:
        n = F.size(s)
        at = lambda i: F.get(s, i.cast("int"))
        half = F.floor(n / 2)
        return F.when(n == 0, g.f32(0)).when(n % 2 == 1, at(half)).otherwise(g.f32((at(half - 1) + at(half)) / 2))

    return t.let(F.array_sort(values), middle)


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Row numbers of ranges: ``n`` of them from each ``start``."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _belong(box: np.ndarray, line: np.ndarray, stop: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A glyph is in a line's box by its centre; closing signs may touch its right end, opening ones its left end."""
    half = np.float32(0.5)
    cx, cy = (box[:, 0] + box[:, 2]) * half, (box[:, 1] + box[:, 3]) * half
    x0, y0, x1, y1 = line.T
    h = np.maximum(y1 - y0, np.float32(0))
    level = (y0 < cy) & (cy < y1) & (np.abs(cy - (y0 + y1) * half) < h * np.float32(SPAN_HEIGHT))
    after, before = x0 < cx, cx < x1
    closes = stop & after & (x1 - h < box[:, 0]) & (box[:, 0] < x1)
    opens = ~stop & start & before & (x0 < box[:, 2]) & (box[:, 2] < x0 + h)
    return level & (after & before | closes | opens)


def _blanks(segment: np.ndarray, at: np.ndarray, box: np.ndarray, blank: np.ndarray) -> np.ndarray:
    """After which glyphs a blank is due: those of a segment (they begin at ``at``) whose gap to the next is above a quarter of the median width, unless a side is a blank."""
    width = np.maximum(box[:, 2] - box[:, 0], np.float32(0))
    order = np.lexsort((width, segment))
    n = np.diff(np.append(at, len(segment)))
    low, high = width[order[at + (n - 1) // 2]], width[order[at + n // 2]]
    limit = np.where(n % 2 == 1, high, ((low + high).astype(np.float64) / 2).astype(np.float32)) * np.float32(SPACE)
    out = np.zeros(len(segment), dtype=bool)
    out[:-1] = (segment[1:] == segment[:-1]) & (box[1:, 0] - box[:-1, 2] > np.repeat(limit, n)[:-1]) & ~blank[1:] & ~blank[:-1]
    return out


def _fill(table: pa.Table) -> tuple[list, ...]:
    """Columns doc_id, page_idx, idx, text, n_chars of the regions (kind 0, idx in char_idx) of whole pages that their glyphs (kind 1) fill."""
    doc, number, kind, idx = (np.asarray(table.column(c)) for c in ("doc_id", "page_idx", "kind", "char_idx"))
    page = np.cumsum(_changes(doc, number))
    box = _floats(table, "x0", "y0", "x1", "y1")
    region, glyph = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
    if not len(region) or not len(glyph):
        return ([],) * 5
    half = np.float32(0.5)
    # Lines: runs of glyphs, and the box around all of them.
    first = np.flatnonzero(_changes(page[glyph], np.asarray(table.column("line_idx"))[glyph]))
    size = np.diff(np.append(first, len(glyph)))
    mine = box[glyph]
    line = np.concatenate([np.minimum.reduceat(mine[:, :2], first), np.maximum.reduceat(mine[:, 2:], first)], axis=1)
    middle = (line[:, 1] + line[:, 3]) * half
    # Every line with the regions of its page that its middle lies in.
    lo = np.searchsorted(page[region], page[glyph[first]], "left")
    n = np.searchsorted(page[region], page[glyph[first]], "right") - lo
    of_line, of_region = np.repeat(np.arange(len(first)), n), region[_spread(lo, n)]
    met = (box[of_region, 1] <= middle[of_line]) & (middle[of_line] <= box[of_region, 3])
    of_line, of_region = of_line[met], of_region[met]
    # Their glyphs that are shown, upright and in the region and the line.
    code, signs = _codes(table.column("ch"))
    is_ = lambda f: np.array([c is not None and f(c) for c in signs], dtype=bool)[code]
    stop, start = is_(lambda c: c in STOP_SIGNS), is_(lambda c: c in START_SIGNS)
    shown = (np.abs(np.asarray(table.column("rotation"), dtype=np.float64)) < 1e-3) & ~is_(lambda c: c in "\r\n" and c != "")
    pair = np.repeat(np.arange(len(of_line)), size[of_line])
    row = glyph[_spread(first[of_line], size[of_line])]
    ok = shown[row]
    pair, row = pair[ok], row[ok]
    area = box[of_region[pair]]
    cx = (box[row, 0] + box[row, 2]) * half
    ok = (stop[row] | start[row] | ((area[:, 0] < cx) & (cx < area[:, 2]))) & _belong(box[row], line[of_line[pair]], stop[row], start[row])
    pair, row = pair[ok], row[ok]
    if not len(pair):
        return ([],) * 5
    at = np.flatnonzero(_changes(pair))
    due = _blanks(pair, at, box[row], is_(lambda c: c == " ")[row])
    written = np.array([s or "" for s in signs] + [f"{s or ''} " for s in signs], dtype=object)[code[row] + len(signs) * due].tolist()
    ligatures = [x for x in t.LIGATURES if any(x[0] in (s or "") for s in signs)]
    found: dict[int, list[tuple]] = {}
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(pair)], strict=True):
        text = "".join(written[a:b])
        for sign, letters in ligatures:
            text = text.replace(sign, letters)
        text = text.strip(_WHITE)
        if text:
            k = of_line[pair[a]]
            found.setdefault(int(of_region[pair[a]]), []).append((middle[k], k, text, b - a))
    out: tuple[list, ...] = ([], [], [], [], [])
    for r, parts in sorted(found.items()):
        text = " ".join(p[2] for p in sorted(parts)).strip(_WHITE)
        x0, y0, x1, y1 = box[r]
        if np.float32(len(text)) * max(y1 - y0, np.float32(0)) >= max(x1 - x0, np.float32(0)) * np.float32(SPARSE):
            for column, value in zip(out, (int(doc[r]), int(number[r]), int(idx[r]), text, sum(p[3] for p in parts)), strict=True):
                column.append(value)
    return out


def _filled(pages: pa.Table) -> pa.RecordBatch:
    doc, page, idx, text, n = _fill(pages)
    cells = [pa.array(doc, pa.int64()), pa.array(page, pa.int32()), pa.array(idx, pa.int32()), pa.array(text, pa.string()), pa.array(n, pa.int32())]
    return pa.RecordBatch.from_arrays(cells, [c.split()[0] for c in FILLED.split(", ")])


def read_fill(documents: DataFrame, read: Read) -> DataFrame:
    """``fill_regions`` of the regions and glyphs that ``read`` gives: doc_id, page_idx, kind (0 for a region, 1 for a glyph), line_idx, char_idx (a region's idx), ch, x0, y0, x1, y1 and
    rotation, a page's regions first, then its glyphs by line and number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pages in read(batches):
            if pages.num_rows:
                yield _filled(pages)

    return documents.mapInArrow(run, FILLED)


def fill_regions(grouped: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc_id, page_idx, idx, text, n_chars): the native text of each region (doc_id, page_idx, idx, bbox) that has enough of it.

    Lines meet a region by their centre's height (an interval join within the page); their upright glyphs by the x range or as punctuation, and by
    ``_belong``. Lines are put from top to bottom, joined by blanks. A text too sparse for its region's width isn't taken.
    Regions and glyphs, narrow rows both, are dealt by page once; the join is made on the arrays of whole pages.
    """
    corners = ("x0", "y0", "x1", "y1")
    glyphs = grouped.select("doc_id", "page_idx", F.lit(1).alias("kind"), "line_idx", F.col("char_idx").cast("int").alias("char_idx"), "ch", *corners, "rotation")
    none = F.lit(None).cast("string").alias("ch")
    asked = regions.where("bbox is not null").select("doc_id", "page_idx", F.lit(0).alias("kind"), F.lit(0).alias("line_idx"), F.col("idx").cast("int").alias("char_idx"), none, *[F.col(f"bbox.{c}").alias(c) for c in corners], g.f32(0).alias("rotation"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pages in _whole_pages(batches):
            yield _filled(pages)

    rows = _by_page(glyphs.unionByName(asked), "kind", "line_idx", "char_idx")
    filled = rows.mapInArrow(run, FILLED)
    return filled.withColumn("idx", F.col("idx").cast(regions.schema["idx"].dataType))
