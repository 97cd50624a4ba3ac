"""Pages of blocks from regions.

A page is small (some hundred regions) and independent of the others, so each assembler shuffles once, by page, and
works on the page's array of regions with higher-order functions. Nothing is collected beyond a page.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.functions import text as t
from quire.schema import BBOX, BLOCK, LINE, MERGEABLE_ROLES, SPAN, TEXT_BLOCK, VISUAL_KINDS, layout_labels, vlm_labels, vlm_types

PAGE = ("doc_id", "page_idx")
#: Shares and gaps that decide.
INLINE_IN_BLOCK, INLINE_IN_LINE, TITLE_OVERLAP, MERGE_GAP, OCR_SCORE = 0.5, 0.6, 0.8, 12.0, 0.6

_none = lambda kind: F.lit(None).cast(kind)


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def block(kind: Column, bbox: Column, **fields: Column) -> Column:
    """A block struct; fields that aren't given are null (empty for lines, captions and footnotes)."""
    types = {"role": "string", "level": "int", "latex": "string", "html": "string", "image": "string", "language": "string"}
    arrays = {"lines": LINE, "captions": TEXT_BLOCK, "footnotes": TEXT_BLOCK}
    get = lambda n: fields.get(n, _empty(arrays[n]) if n in arrays else _none(types[n]))
    names = ("role", "level")
    parts = [kind.alias("kind"), *[get(n).alias(n) for n in names], bbox.alias("bbox"), get("lines").alias("lines")]
    parts += [get(n).alias(n) for n in ("latex", "html", "image", "language", "captions", "footnotes")]
    return F.struct(*parts).cast(BLOCK)


def text_span(bbox: Column, text: Column, score: Column) -> Column:
    null = _none("string")
    return F.struct(F.lit("text").alias("kind"), bbox.alias("bbox"), text.alias("text"), null.alias("latex"), null.alias("image"), score.alias("score")).cast(SPAN)


def line(bbox: Column, spans: Column) -> Column:
    return F.struct(bbox.alias("bbox"), spans.alias("spans")).cast(LINE)


def recognised_lines(text_lines: Column) -> Column:
    """Lines of one text span each; none for null."""
    made = F.transform(text_lines, lambda x: line(x["bbox"], F.array(text_span(x["bbox"], x["text"], x["score"]))))
    return F.coalesce(made, _empty(LINE))


def text_block(bbox: Column, lines: Column) -> Column:
    return F.struct(bbox.alias("bbox"), lines.alias("lines")).cast(TEXT_BLOCK)


def nearest_body(bodies: Column, bbox: Column) -> Column:
    """Place (from 0) of the body that ``bbox`` covers most, then of the nearest centre, then the first; null without bodies."""

    def rank(b: Column, i: Column) -> Column:
        return F.struct(g.overlap_ratio(b["bbox"], bbox).alias("o"), (-g.center_distance_sq(bbox, b["bbox"])).alias("d"), (-i).alias("i"))

    return -F.array_max(F.transform(bodies, rank))["i"]


def nearest_visual(bodies: Column, bbox: Column) -> Column:
    """Place of the best visual: by the share of ``bbox`` it covers, or else by the centres' distance; the first of equals; null without visuals."""

    def rank(b: Column, i: Column) -> Column:
        over = g.overlap_ratio(bbox, b["bbox"])
        far = g.f32(F.sqrt(g.center_distance_sq(bbox, b["bbox"]).cast("double")))
        return F.struct(F.when(over > 0, over).otherwise(g.f32(-far / g.f32(1e6))).alias("s"), (-i).alias("i"))

    return -F.array_max(F.transform(bodies, rank))["i"]


def _attached(satellites: Column, kind: str, place: Column) -> Column:
    mine = F.filter(satellites, lambda s: (s["kind"] == kind) & (s["place"] == place))
    return F.transform(mine, lambda s: text_block(s["bbox"], s["lines"]))


def _visual(r: Column, place: Column, satellites: Column) -> Column:
    return block(
        r["kind"], r["bbox"],
        html=F.when(r["kind"] == "table", F.coalesce(r["html"], F.lit(""))),
        image=F.when(r["kind"] == "table", r["image"]).otherwise(F.coalesce(r["image"], F.lit(""))),
        captions=_attached(satellites, "caption", place), footnotes=_attached(satellites, "footnote", place),
    )


def insert_inline(lines: Column, formula: Column) -> Column:
    """The lines with a formula's span in the first line of largest vertical overlap above 0.6, sorted there by its left
    edge, the line's box drawn around its spans anew; in a line of its own if there is none."""
    null = _none("string")
    span = F.struct(F.lit("inline_equation").alias("kind"), formula["bbox"].alias("bbox"), null.alias("text"), formula["latex"].alias("latex"), null.alias("image"), g.f32(1).alias("score")).cast(SPAN)
    ranks = F.transform(lines, lambda x, i: F.struct(g.y_overlap_ratio(formula["bbox"], x["bbox"]).alias("o"), (-i).alias("i")))
    best = F.array_max(F.filter(ranks, lambda r: r["o"] > g.f32(INLINE_IN_LINE)))

    def joined(x: Column) -> Column:
        spans = F.array_sort(
            F.concat(x["spans"], F.array(span)),
            lambda a, b: F.when(a["bbox"]["x0"] < b["bbox"]["x0"], -1).when(a["bbox"]["x0"] > b["bbox"]["x0"], 1).otherwise(0),
        )
        return line(g.union_all(F.transform(spans, lambda s: s["bbox"])), spans)

    grown = F.transform(lines, lambda x, i: F.when(i == -best["i"], joined(x)).otherwise(x))
    return F.when(best.isNull(), F.concat(lines, F.array(line(formula["bbox"], F.array(span))))).otherwise(grown)


def fold_inline(blocks: Column, formulas: Column) -> Column:
    """Each formula goes into the first text block that covers more than half of it; one that none covers is dropped.
    Formulas are put in one after the other, since a line's box grows with each."""

    def home(f: Column) -> Column:
        places = F.transform(blocks, lambda b, i: F.when((b["kind"] == "text") & (g.overlap_ratio(f["bbox"], b["bbox"]) > g.f32(INLINE_IN_BLOCK)), i))
        return F.array_min(F.array_compact(places))

    placed = F.transform(formulas, lambda f: F.struct(f["bbox"].alias("bbox"), f["latex"].alias("latex"), home(f).alias("home")))

    def filled(b: Column, i: Column) -> Column:
        mine = F.filter(placed, lambda f: f["home"] == i)
        lines = F.aggregate(mine, b["lines"], insert_inline)
        return F.when(F.size(mine) > 0, b.withField("lines", lines)).otherwise(b)

    return F.when(F.size(formulas) > 0, F.transform(blocks, filled)).otherwise(blocks)


def _pages(regions: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per page: its regions sorted by reading order, then by input order."""
    one = F.struct(*[F.col(f) for f in ("order", "idx", *fields)])
    return regions.groupBy(*PAGE).agg(F.array_sort(F.collect_list(one)).alias("_r"))


def _blocks(pages: DataFrame) -> DataFrame:
    """One row per block from columns blocks and discarded."""
    kept = F.transform("blocks", lambda b, i: F.struct(i.alias("block_idx"), F.lit(False).alias("discarded"), b.alias("b")))
    gone = F.transform("discarded", lambda b, i: F.struct(i.alias("block_idx"), F.lit(True).alias("discarded"), b.alias("b")))
    return pages.select(*PAGE, F.explode(F.concat(kept, gone)).alias("x")).select(*PAGE, "x.discarded", "x.block_idx", "x.b.*")


def assemble(regions: DataFrame) -> DataFrame:
    """Blocks of every page (doc_id, page_idx, discarded, block_idx and the block's fields) from classified regions.

    ``regions``: doc_id, page_idx, order, idx, label, bbox, text_lines, latex, inline_latex, html, image. Captions and
    footnotes go to their nearest visual and are dropped on pages without one; visuals keep their place in reading order. An
    unknown label is an error.
    """
    labelled = regions.join(F.broadcast(layout_labels(regions.sparkSession).select("label", "kind", "role", "level")), "label", "left")
    kind = F.coalesce("kind", F.raise_error(F.concat(F.lit("unknown layout label "), F.col("label"))))
    first = F.get(F.col("text_lines"), F.lit(0))["text"]
    ready = labelled.select(
        *PAGE, "order", "idx", kind.alias("kind"), "role", t.title_level(F.col("role"), F.col("level"), first).alias("level"), "bbox",
        recognised_lines(F.col("text_lines")).alias("lines"), "latex", "inline_latex", "html", "image",
    )
    pages = _pages(ready, ("kind", "role", "level", "bbox", "lines", "latex", "inline_latex", "html", "image"))
    pages = pages.withColumn("_bodies", F.filter("_r", lambda r: r["kind"].isin(*VISUAL_KINDS)))
    sats = F.filter("_r", lambda r: r["kind"].isin("caption", "footnote"))
    pages = pages.withColumn(
        "_sats", t.let(F.col("_bodies"), lambda bodies: F.transform(sats, lambda s: F.struct(s["kind"].alias("kind"), s["bbox"].alias("bbox"), s["lines"].alias("lines"), nearest_body(bodies, s["bbox"]).alias("place"))))
    )
    flow = F.filter("_r", lambda r: r["kind"].isin("text", "equation", *VISUAL_KINDS))

    def made(r: Column) -> Column:
        place = F.array_position(F.transform("_bodies", lambda b: b["idx"]), r["idx"]) - 1
        text = block(r["kind"], r["bbox"], role=r["role"], level=r["level"], lines=r["lines"])
        equation = block(r["kind"], r["bbox"], latex=F.coalesce(r["latex"], F.lit("")))
        return F.when(r["kind"] == "text", text).when(r["kind"] == "equation", equation).otherwise(_visual(r, place, F.col("_sats")))

    formulas = F.transform(
        F.filter("_r", lambda r: (r["kind"] == "inline_formula") & r["inline_latex"].isNotNull()), lambda r: F.struct(r["bbox"].alias("bbox"), r["inline_latex"].alias("latex"))
    )
    gone = F.transform(F.filter("_r", lambda r: r["kind"] == "discarded"), lambda r: block(F.lit("text"), r["bbox"], role=r["role"], lines=r["lines"]))
    pages = pages.withColumn("_flow", F.transform(flow, made)).withColumn("_formulas", formulas)
    return _blocks(pages.select(*PAGE, fold_inline(F.col("_flow"), F.col("_formulas")).alias("blocks"), gone.alias("discarded")))


def assemble_hybrid(regions: DataFrame, doc_titles: DataFrame | None = None) -> DataFrame:
    """Blocks from regions whose content a VLM read: doc_id, page_idx, order, idx, vlm_type, bbox, content, image.

    A title is of level 0 if a box of ``doc_titles`` (doc_id, page_idx, bbox) and it cover 0.8 of the smaller one, else of level 1.
    """
    types = F.broadcast(vlm_types(regions.sparkSession))
    typed = regions.join(types, "vlm_type")
    titles = F.col("_titles")
    if doc_titles is not None:
        by_page = doc_titles.groupBy(*PAGE).agg(F.collect_list("bbox").alias("_titles"))
        typed = typed.join(by_page, list(PAGE), "left")
    else:
        typed = typed.withColumn("_titles", _empty(BBOX))
    promoted = F.coalesce(F.exists(titles, lambda b: g.smaller_overlap(F.col("bbox"), b) >= g.f32(TITLE_OVERLAP)), F.lit(False))
    content = F.coalesce("content", F.lit(""))
    shown = F.when(F.col("role") == "title", t.collapse_newlines(content)).otherwise(content)
    ready = typed.select(
        *PAGE, "order", "idx", "kind", "role", F.when(F.col("role") == "title", F.when(promoted, 0).otherwise(1)).alias("level"), "bbox",
        F.array(line(F.col("bbox"), t.inline_spans(shown, F.col("bbox")))).alias("lines"), t.trim(content).alias("latex"), content.alias("html"), "image",
    )
    pages = _pages(ready, ("kind", "role", "level", "bbox", "lines", "latex", "html", "image"))
    pages = pages.withColumn("_bodies", F.filter("_r", lambda r: r["kind"].isin(*VISUAL_KINDS)))
    sats = F.filter("_r", lambda r: r["kind"].isin("caption", "footnote"))
    pages = pages.withColumn(
        "_sats", t.let(F.col("_bodies"), lambda bodies: F.transform(sats, lambda s: F.struct(s["kind"].alias("kind"), s["bbox"].alias("bbox"), s["lines"].alias("lines"), nearest_body(bodies, s["bbox"]).alias("place"))))
    )

    def made(r: Column) -> Column:
        place = F.array_position(F.transform("_bodies", lambda b: b["idx"]), r["idx"]) - 1
        text = block(r["kind"], r["bbox"], role=r["role"], level=r["level"], lines=r["lines"])
        return F.when(r["kind"] == "text", text).when(r["kind"] == "equation", block(r["kind"], r["bbox"], latex=r["latex"])).otherwise(_visual(r, place, F.col("_sats")))

    flow = F.transform(F.filter("_r", lambda r: r["kind"].isin("text", "equation", *VISUAL_KINDS)), made)
    gone = F.transform(F.filter("_r", lambda r: r["kind"] == "discarded"), lambda r: block(F.lit("text"), r["bbox"], role=r["role"], lines=r["lines"]))
    return _blocks(pages.select(*PAGE, flow.alias("blocks"), gone.alias("discarded")))


def assemble_vlm(blocks: DataFrame) -> DataFrame:
    """Blocks of pages that a VLM read whole: doc_id, page_idx, idx, label, bbox (page units), content, image.

    Visuals follow all text and equations; captions and footnotes of a page without a visual become body text, in that order. Labels
    that aren't known are ignored.
    """
    labelled = blocks.join(F.broadcast(vlm_labels(blocks.sparkSession).drop("vlm_type")), "label")
    content = F.coalesce("content", F.lit(""))
    shown = F.when(F.col("role") == "title", t.collapse_newlines(content)).otherwise(content)
    ready = labelled.select(
        *PAGE, F.col("idx").alias("order"), "idx", "kind", "role", "level", "bbox", F.array(line(F.col("bbox"), t.inline_spans(shown, F.col("bbox")))).alias("lines"),
        t.clean_formula(content).alias("latex"), content.alias("html"), "image",
    )
    pages = _pages(ready, ("kind", "role", "level", "bbox", "lines", "latex", "html", "image"))
    pages = pages.withColumn("_bodies", F.filter("_r", lambda r: r["kind"].isin(*VISUAL_KINDS, "code")))
    sats = F.concat(F.filter("_r", lambda r: r["kind"] == "caption"), F.filter("_r", lambda r: r["kind"] == "footnote"))
    pages = pages.withColumn(
        "_sats", t.let(F.col("_bodies"), lambda bodies: F.transform(sats, lambda s: F.struct(s["kind"].alias("kind"), s["bbox"].alias("bbox"), s["lines"].alias("lines"), nearest_visual(bodies, s["bbox"]).alias("place"))))
    )
    text = F.transform(
        F.filter("_r", lambda r: r["kind"].isin("text", "equation")),
        lambda r: F.when(r["kind"] == "text", block(r["kind"], r["bbox"], role=r["role"], level=r["level"], lines=r["lines"])).otherwise(block(r["kind"], r["bbox"], latex=r["latex"])),
    )
    orphans = F.transform(F.filter("_sats", lambda s: s["place"].isNull()), lambda s: block(F.lit("text"), s["bbox"], role=F.lit("body"), lines=s["lines"]))

    def visual(r: Column, i: Column) -> Column:
        code = block(r["kind"], r["bbox"], lines=r["lines"], captions=_attached(F.col("_sats"), "caption", i), footnotes=_attached(F.col("_sats"), "footnote", i))
        return F.when(r["kind"] == "code", code).otherwise(_visual(r, i, F.col("_sats")))

    gone = F.transform(F.filter("_r", lambda r: r["kind"] == "discarded"), lambda r: block(F.lit("text"), r["bbox"], role=r["role"], lines=r["lines"]))
    return _blocks(pages.select(*PAGE, F.concat(text, orphans, F.transform("_bodies", visual)).alias("blocks"), gone.alias("discarded")))


def merge_paragraphs(blocks: DataFrame) -> DataFrame:
    """The kept blocks of each page, neighbours of the same mergeable role at most 12 apart made one.

    A block is compared with the grown box of the one before it, so this is a fold over the page's blocks.
    """
    fields = [f for f in blocks.columns if f not in (*PAGE, "discarded", "block_idx")]
    one = F.struct("block_idx", F.struct(*fields).cast(BLOCK).alias("b"))
    pages = blocks.where(~F.col("discarded")).groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["b"]).alias("_b"))

    def step(done: Column, b: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        near = g.vertical_gap(last["bbox"], b["bbox"]) <= g.f32(MERGE_GAP)
        same = (last["kind"] == "text") & (b["kind"] == "text") & last["role"].isin(*MERGEABLE_ROLES) & (last["role"] == b["role"])
        grown = last.withField("bbox", g.union(last["bbox"], b["bbox"])).withField("lines", F.concat(last["lines"], b["lines"])).cast(BLOCK)
        return F.when(F.coalesce(same & near, F.lit(False)), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(b)))

    merged = pages.select(*PAGE, F.posexplode(F.aggregate("_b", _empty(BLOCK), step)).alias("block_idx", "b")).select(*PAGE, F.lit(False).alias("discarded"), "block_idx", "b.*")
    return merged.unionByName(blocks.where("discarded"))


def hybrid_type(dets: DataFrame) -> DataFrame:
    """Detections with the VLM type of their layout label; those that are skipped go."""
    labels = F.broadcast(layout_labels(dets.sparkSession).select("label", "vlm_type"))
    return dets.join(labels, "label").where("vlm_type <> 'unknown'").withColumn("is_seal", F.col("label") == "seal")


def prompt_type(blocks: DataFrame) -> DataFrame:
    """A VLM's blocks with the type of their own label; those without one go."""
    labels = F.broadcast(vlm_labels(blocks.sparkSession).select("label", "vlm_type"))
    return blocks.join(labels, "label").where("vlm_type <> 'unknown'")


def sent_to_vlm(vlm_type: Column, image_analysis: bool) -> Column:
    return ~vlm_type.isin("image", "chart") | F.lit(image_analysis)


def skips_extraction(label: Column, image_analysis: bool) -> Column:
    return (label == "unknown") | (label.isin("image", "chart", "image_block") & ~F.lit(image_analysis))


def needs_ocr(vlm_type: Column, content: Column) -> Column:
    read = vlm_type.isin(
        "text", "title", "index", "ref_text", "aside_text", "header", "footer", "page_number", "page_footnote", "image_caption", "image_footnote", "code"
    )
    return read & t.is_blank(F.coalesce(content, F.lit("")))


def reduce_contents(contents: Column) -> Column:
    """The contents that aren't blank, one on a line; null if there is none."""
    kept = F.filter(contents, lambda c: c.isNotNull() & ~t.is_blank(c))
    return F.when(F.size(kept) > 0, F.array_join(kept, "\n"))


def fill_from_ocr(regions: DataFrame, ocr: DataFrame) -> DataFrame:
    """Blank text-like regions get their OCR lines (doc_id, page_idx, idx, line_idx, text, score) of score above 0.6, joined by blanks; regions without such lines stay."""
    good = ocr.where((F.col("score") > g.f32(OCR_SCORE)) & ~t.is_blank(F.col("text")))
    by_region = good.groupBy(*PAGE, "idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "text"))), lambda x: x["text"]), " ").alias("_ocr"))
    filled = F.when(needs_ocr(F.col("vlm_type"), F.col("content")), F.coalesce("_ocr", "content")).otherwise(F.col("content"))
    return regions.join(by_region, [*PAGE, "idx"], "left").withColumn("content", filled).drop("_ocr")


def native_or_ocr(regions: DataFrame, native: DataFrame, ocr: DataFrame) -> DataFrame:
    """Regions with text_lines: one line of score 1 from the page's own text (doc_id, page_idx, idx, text) where there is one, else all OCR lines
    (doc_id, page_idx, idx, line_idx, bbox, text, score)."""
    lines = ocr.groupBy(*PAGE, "idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "bbox", "text", "score"))), lambda x: F.struct(x["bbox"], x["text"], x["score"])).alias("_ocr"))
    own = F.array(F.struct(F.col("bbox").alias("bbox"), F.col("_native").alias("text"), g.f32(1).alias("score")))
    joined = regions.join(native.select(*PAGE, "idx", F.col("text").alias("_native")), [*PAGE, "idx"], "left").join(lines, [*PAGE, "idx"], "left")
    kind = "array<struct<bbox:%s,text:string,score:float>>" % BBOX
    return joined.withColumn("text_lines", F.when(F.col("_native").isNotNull(), own.cast(kind)).otherwise(F.coalesce(F.col("_ocr").cast(kind), F.array().cast(kind)))).drop("_native", "_ocr")
