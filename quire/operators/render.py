"""Markdown, content lists and JSON documents from blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.functions import text as t
from quire.schema import BLOCK_FIELDS, SILENT_ROLES

MARKDOWN, TEXT_ONLY = "markdown", "text"


def flat_line(line: Column) -> Column:
    """A line's spans as text: formulas between dollar signs, images left out."""

    def one(s: Column) -> Column:
        return F.when(s["kind"] == "text", F.coalesce(s["text"], F.lit(""))).when(s["kind"] == "inline_equation", F.concat(F.lit("$"), F.coalesce(s["latex"], F.lit("")), F.lit("$"))).otherwise(F.lit(""))

    return F.array_join(F.transform(line["spans"], one), "")


def joined_lines(lines: Column, by: str = " ") -> Column:
    return F.array_join(F.transform(lines, flat_line), by)


def texts(text_blocks: Column) -> Column:
    """The texts of captions or footnotes that aren't blank."""
    return F.filter(F.transform(text_blocks, lambda b: joined_lines(b["lines"])), lambda s: ~t.is_blank(s))


def fragment(mode: str = MARKDOWN, image_dir: str = "images") -> Column:
    """A block's Markdown over the block's columns; null for what isn't shown."""
    kind, body = F.col("kind"), joined_lines(F.col("lines"))
    title = F.concat(F.repeat(F.lit("#"), F.least(F.col("level") + 1, F.lit(6))), F.lit(" "), body)
    text = F.when(F.col("role") == "title", title).when(~F.col("role").isin(*SILENT_ROLES), body)
    path = t.join_path(F.lit(image_dir), F.coalesce("image", F.lit("")))
    above = F.array_join(F.transform(texts(F.col("captions")), lambda c: F.concat(c, F.lit("\n"))), "")
    below = F.array_join(F.transform(texts(F.col("captions")), lambda c: F.concat(F.lit("\n"), c)), "")
    image = F.concat(F.lit("![]("), path, F.lit(")"), below) if mode != TEXT_ONLY else F.lit(None).cast("string")
    return (
        F.when(kind == "text", text)
        .when(kind == "equation", F.concat(F.lit("$$\n"), F.col("latex"), F.lit("\n$$")))
        .when(kind.isin("image", "chart"), image)
        .when(kind == "table", F.concat(above, F.coalesce("html", F.lit(""))))
        .when(kind == "code", F.concat(F.lit("```"), F.coalesce("language", F.lit("")), F.lit("\n"), joined_lines(F.col("lines"), "\n"), F.lit("\n```")))
    )


def markdown(blocks: DataFrame, mode: str = MARKDOWN, image_dir: str = "images") -> DataFrame:
    """(doc_id, markdown): the shown blocks of each document, by page and place, with a blank line between. Empty texts are kept."""
    shown = blocks.where(~F.col("discarded")).select("doc_id", "page_idx", "block_idx", fragment(mode, image_dir).alias("f"))
    parts = F.filter(F.array_sort(F.collect_list(F.struct("page_idx", "block_idx", "f"))), lambda x: x["f"].isNotNull())
    return shown.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["f"]), "\n\n").alias("markdown"))


def _some(a: Column) -> Column:
    return F.when(F.size(a) > 0, a)


def content_items(blocks: DataFrame, pages: DataFrame, image_dir: str = "images") -> DataFrame:
    """(doc_id, page_idx, block_idx, item): the JSON item of every shown block. ``pages``: doc_id, page_idx, width, height.

    Absent and empty fields are left out; a page without extent gives items without bbox.
    """
    sized = blocks.where(~F.col("discarded")).join(pages.select("doc_id", "page_idx", "width", "height"), ["doc_id", "page_idx"], "left")
    place = g.to_thousandths(F.col("bbox"), F.col("width"), F.col("height")).alias("bbox")
    tail = [place, F.col("page_idx").alias("page_idx")]
    path = t.join_path(F.lit(image_dir), F.coalesce("image", F.lit("")))
    captions, footnotes = _some(texts(F.col("captions"))), _some(texts(F.col("footnotes")))
    item = lambda kind, *fields: F.to_json(F.struct(F.lit(kind).alias("type"), *fields, *tail))
    body = joined_lines(F.col("lines"))
    text = item("text", body.alias("text"), F.when((F.col("role") == "title") & (F.col("level") != 0), F.col("level")).alias("text_level"))
    found = (
        F.when((F.col("kind") == "text") & ~F.col("role").isin(*SILENT_ROLES), text)
        .when(F.col("kind") == "equation", item("equation", F.col("latex").alias("text"), F.lit("latex").alias("text_format")))
        .when(F.col("kind") == "image", item("image", path.alias("img_path"), captions.alias("image_caption"), footnotes.alias("image_footnote")))
        .when(F.col("kind") == "chart", item("chart", path.alias("img_path"), captions.alias("chart_caption"), footnotes.alias("chart_footnote")))
        .when(
            F.col("kind") == "table",
            item("table", F.when((F.col("image").isNotNull()) & (path != ""), path).alias("img_path"), F.coalesce("html", F.lit("")).alias("table_body"), captions.alias("table_caption"), footnotes.alias("table_footnote")),
        )
        .when(
            F.col("kind") == "code",
            item("code", joined_lines(F.col("lines"), "\n").alias("code_body"), F.col("language").alias("code_language"), captions.alias("code_caption"), footnotes.alias("code_footnote")),
        )
    )
    return sized.select("doc_id", "page_idx", "block_idx", found.alias("item")).where("item IS NOT NULL")


def content_list(items: DataFrame) -> DataFrame:
    """(doc_id, content_list): the items of a document as one JSON array."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page_idx", "block_idx", "item"))), lambda x: x["item"])
    return items.groupBy("doc_id").agg(F.concat(F.lit("["), F.array_join(ordered, ","), F.lit("]")).alias("content_list"))


# --- the document tree as JSON -------------------------------------------------------------------------------------


def _role_json() -> Column:
    return F.when(F.col("role") == "title", F.concat(F.lit('{"title":'), F.col("level"), F.lit("}"))).otherwise(F.concat(F.lit('"'), F.col("role"), F.lit('"')))


def _wire_lines(lines: Column) -> Column:
    span = lambda s: F.struct(
        s["kind"].alias("kind"), g.to_array(s["bbox"]).alias("bbox"), s["text"].alias("text"), s["latex"].alias("latex"), s["image"].alias("image"),
        F.when(s["kind"] != "image", s["score"]).alias("score"),
    )
    return F.transform(lines, lambda x: F.struct(g.to_array(x["bbox"]).alias("bbox"), F.transform(x["spans"], span).alias("spans")))


def _wire_texts(blocks: Column) -> Column:
    return F.transform(blocks, lambda b: F.struct(g.to_array(b["bbox"]).alias("bbox"), _wire_lines(b["lines"]).alias("lines")))


def block_json() -> Column:
    """A block's JSON: tagged by type; a title's role is an object with its level; boxes are arrays."""
    box = g.to_array(F.col("bbox")).alias("bbox")
    kind = F.col("kind")
    lines = F.to_json(_wire_lines(F.col("lines")))
    text = F.concat(F.lit('{"type":"text","bbox":'), F.to_json(g.to_array(F.col("bbox"))), F.lit(',"role":'), _role_json(), F.lit(',"lines":'), lines, F.lit("}"))
    equation = F.to_json(F.struct(F.lit("interline_equation").alias("type"), box, F.col("latex").alias("latex")))
    body = F.when(
        kind == "table", F.to_json(F.struct(box, F.col("html").alias("html"), F.col("image").alias("image")))
    ).when(kind == "code", F.to_json(F.struct(box, _wire_lines(F.col("lines")).alias("lines"), F.col("language").alias("language")))).otherwise(F.to_json(F.struct(box, F.col("image").alias("image"))))
    captioned = F.concat(
        F.lit('{"type":"'), kind, F.lit('","body":'), body, F.lit(',"captions":'), F.to_json(_wire_texts(F.col("captions"))), F.lit(',"footnotes":'), F.to_json(_wire_texts(F.col("footnotes"))), F.lit("}")
    )
    return F.when(kind == "text", text).when(kind == "equation", equation).otherwise(captioned)


def document_json(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, document): pages with index, size, blocks and discarded blocks as one JSON text."""
    one = F.struct("block_idx", block_json().alias("j"))
    per_page = blocks.groupBy("doc_id", "page_idx").agg(
        F.array_sort(F.collect_list(F.when(~F.col("discarded"), one))).alias("kept"), F.array_sort(F.collect_list(F.when(F.col("discarded"), one))).alias("gone")
    )
    text = lambda a: F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x["j"]), ","), F.lit("]"))
    size = F.to_json(F.array(g.f32(F.col("width")), g.f32(F.col("height"))))
    empty = F.lit("[]")
    page = F.concat(
        F.lit('{"index":'), F.col("page_idx"), F.lit(',"size":'), size, F.lit(',"blocks":'), F.coalesce(text(F.col("kept")), empty), F.lit(',"discarded":'), F.coalesce(text(F.col("gone")), empty), F.lit("}")
    )
    sized = pages.join(per_page, ["doc_id", "page_idx"], "left").select("doc_id", "page_idx", page.alias("p"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page_idx", "p"))), lambda x: x["p"])
    return sized.groupBy("doc_id").agg(F.concat(F.lit('{"pages":['), F.array_join(ordered, ","), F.lit("]}")).alias("document"))


_WIRE_LINE = "struct<bbox:array<float>,spans:array<struct<kind:string,bbox:array<float>,text:string,latex:string,image:string,score:float>>>"
_WIRE_TEXT = f"struct<bbox:array<float>,lines:array<{_WIRE_LINE}>>"
_WIRE_BODY = f"struct<bbox:array<float>,html:string,image:string,lines:array<{_WIRE_LINE}>,language:string>"
_WIRE_BLOCK = f"struct<type:string,bbox:array<float>,role:string,lines:array<{_WIRE_LINE}>,latex:string,body:{_WIRE_BODY},captions:array<{_WIRE_TEXT}>,footnotes:array<{_WIRE_TEXT}>>"
_WIRE_DOCUMENT = f"struct<pages:array<struct<index:int,size:array<float>,blocks:array<{_WIRE_BLOCK}>,discarded:array<{_WIRE_BLOCK}>>>>"


def _lines_from(lines: Column) -> Column:
    from quire.schema import LINE, SPAN

    span = lambda s: F.struct(s["kind"].alias("kind"), g.from_array(s["bbox"]).alias("bbox"), s["text"].alias("text"), s["latex"].alias("latex"), s["image"].alias("image"), s["score"].alias("score")).cast(SPAN)
    return F.transform(lines, lambda x: F.struct(g.from_array(x["bbox"]).alias("bbox"), F.transform(x["spans"], span).alias("spans")).cast(LINE))


def _texts_from(blocks: Column) -> Column:
    from quire.schema import TEXT_BLOCK

    return F.transform(blocks, lambda b: F.struct(g.from_array(b["bbox"]).alias("bbox"), _lines_from(b["lines"]).alias("lines")).cast(TEXT_BLOCK))


def read_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, pages) from (doc_id, document): the inverse of ``document_json``."""
    from quire.operators.assemble import _empty
    from quire.schema import LINE, TEXT_BLOCK

    parsed = documents.select("doc_id", F.explode(F.from_json("document", _WIRE_DOCUMENT)["pages"]).alias("p"))
    pages = parsed.select("doc_id", F.col("p.index").alias("page_idx"), F.col("p.size")[0].alias("width"), F.col("p.size")[1].alias("height"))
    parts = [parsed.select("doc_id", F.col("p.index").alias("page_idx"), F.lit(gone).alias("discarded"), F.posexplode(f"p.{name}").alias("block_idx", "w")) for name, gone in (("blocks", False), ("discarded", True))]
    wire = parts[0].union(parts[1])
    w = F.col("w")
    kind = F.when(w["type"] == "interline_equation", F.lit("equation")).otherwise(w["type"])
    title = w["role"].startswith("{")
    fields = {
        "kind": kind,
        "role": F.when(title, F.lit("title")).otherwise(w["role"]),
        "level": F.when(title, F.get_json_object(w["role"], "$.title").cast("int")),
        "bbox": g.from_array(F.coalesce(w["bbox"], w["body"]["bbox"])),
        "lines": F.coalesce(_lines_from(F.coalesce(w["lines"], w["body"]["lines"])), _empty(LINE)),
        "latex": w["latex"],
        "html": w["body"]["html"],
        "image": w["body"]["image"],
        "language": w["body"]["language"],
        "captions": F.coalesce(_texts_from(w["captions"]), _empty(TEXT_BLOCK)),
        "footnotes": F.coalesce(_texts_from(w["footnotes"]), _empty(TEXT_BLOCK)),
    }
    return wire.select("doc_id", "page_idx", "discarded", "block_idx", *[fields[f].alias(f) for f in BLOCK_FIELDS]), pages
