"""Types of the document model and its fixed dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BBOX = "struct<x0:float,y0:float,x1:float,y1:float>"
SPAN = f"struct<kind:string,bbox:{BBOX},text:string,latex:string,image:string,score:float>"
LINE = f"struct<bbox:{BBOX},spans:array<{SPAN}>>"
TEXT_BLOCK = f"struct<bbox:{BBOX},lines:array<{LINE}>>"
BLOCK = (
    f"struct<kind:string,role:string,level:int,bbox:{BBOX},lines:array<{LINE}>,latex:string,html:string,image:string,"
    f"language:string,captions:array<{TEXT_BLOCK}>,footnotes:array<{TEXT_BLOCK}>>"
)
#: Fields of a block, in order.
BLOCK_FIELDS = ("kind", "role", "level", "bbox", "lines", "latex", "html", "image", "language", "captions", "footnotes")
#: A recognised line of text in a region.
TEXT_LINE = f"struct<bbox:{BBOX},text:string,score:float>"
FONT = "struct<name:string,flags:int,size_millipoints:int,weight:int>"

#: Id, name, score threshold, order category, kind, role and title level of a region, VLM type.
LAYOUT_LABELS = (
    (0, "abstract", 0.5, 4, "text", "abstract", None, "text"),
    (1, "algorithm", 0.5, 2, "text", "body", None, "code"),
    (2, "aside_text", 0.5, 14, "text", "aside_text", None, "aside_text"),
    (3, "chart", 0.5, 1, "chart", None, None, "chart"),
    (4, "content", 0.5, 5, "text", "body", None, "index"),
    (5, "display_formula", 0.4, 7, "equation", None, None, "equation"),
    (6, "doc_title", 0.4, 8, "text", "title", 0, "title"),
    (7, "figure_title", 0.5, 6, "caption", None, None, "image_caption"),
    (8, "footer", 0.5, 11, "discarded", "footer", None, "footer"),
    (9, "footer_image", 0.5, 11, "image", None, None, "footer"),
    (10, "footnote", 0.5, 9, "text", "page_footnote", None, "page_footnote"),
    (11, "formula_number", 0.5, 13, "ignored", None, None, "formula_number"),
    (12, "header", 0.5, 10, "discarded", "header", None, "header"),
    (13, "header_image", 0.5, 10, "image", None, None, "header"),
    (14, "image", 0.5, 1, "image", None, None, "image"),
    (15, "inline_formula", 0.4, 2, "inline_formula", None, None, "unknown"),
    (16, "number", 0.5, 3, "discarded", "page_number", None, "page_number"),
    (17, "paragraph_title", 0.4, 0, "text", "title", 1, "title"),
    (18, "reference", 0.5, 2, "text", "ref_text", None, "unknown"),
    (19, "reference_content", 0.5, 2, "text", "ref_text", None, "ref_text"),
    (20, "seal", 0.45, 12, "discarded", "body", None, "image"),
    (21, "table", 0.5, 1, "table", None, None, "table"),
    (22, "text", 0.4, 2, "text", "body", None, "text"),
    (23, "vertical_text", 0.4, 15, "text", "body", None, "text"),
    (24, "vision_footnote", 0.5, 6, "footnote", None, None, "image_footnote"),
)
#: VLM type, its kind, role and title level for the hybrid assembler.
VLM_TYPES = (
    ("text", "text", "body", None),
    ("title", "text", "title", 1),
    ("index", "text", "body", None),
    ("code", "text", "body", None),
    ("ref_text", "text", "ref_text", None),
    ("aside_text", "discarded", "aside_text", None),
    ("header", "discarded", "header", None),
    ("footer", "discarded", "footer", None),
    ("page_number", "discarded", "page_number", None),
    ("page_footnote", "discarded", "page_footnote", None),
    ("formula_number", "ignored", None, None),
    ("image_caption", "caption", None, None),
    ("image_footnote", "footnote", None, None),
    ("image", "image", None, None),
    ("chart", "chart", None, None),
    ("table", "table", None, None),
    ("equation", "equation", None, None),
    ("unknown", "ignored", None, None),
)
#: A VLM's own label, its type for the hybrid assembler, and kind, role and title level for the VLM assembler.
VLM_LABELS = (
    ("text", "text", "text", "body", None),
    ("phonetic", "text", "text", "body", None),
    ("title", "title", "text", "title", 1),
    ("list", "unknown", "text", "list", None),
    ("index", "index", "ignored", None, None),
    ("ref_text", "ref_text", "text", "ref_text", None),
    ("header", "header", "discarded", "header", None),
    ("footer", "footer", "discarded", "footer", None),
    ("page_number", "page_number", "discarded", "page_number", None),
    ("aside_text", "aside_text", "discarded", "aside_text", None),
    ("page_footnote", "page_footnote", "discarded", "page_footnote", None),
    ("formula_number", "formula_number", "ignored", None, None),
    ("image_caption", "image_caption", "caption", None, None),
    ("table_caption", "image_caption", "caption", None, None),
    ("code_caption", "image_caption", "caption", None, None),
    ("image_footnote", "image_footnote", "footnote", None, None),
    ("table_footnote", "image_footnote", "footnote", None, None),
    ("image", "image", "image", None, None),
    ("image_block", "image", "image", None, None),
    ("chart", "chart", "chart", None, None),
    ("table", "table", "table", None, None),
    ("code", "code", "code", None, None),
    ("algorithm", "code", "code", None, None),
    ("equation", "equation", "equation", None, None),
)
VISUAL_KINDS = ("image", "chart", "table")
#: Roles that a renderer leaves out.
SILENT_ROLES = ("header", "footer", "page_number", "page_footnote", "aside_text")
#: Roles whose neighbouring blocks may be one paragraph.
MERGEABLE_ROLES = ("body", "list", "ref_text", "abstract")


def layout_labels(spark: SparkSession) -> DataFrame:
    """25 rows: the dimension that detections are joined with (broadcast)."""
    return spark.createDataFrame(
        LAYOUT_LABELS, "label_id int, label string, threshold float, order_category int, kind string, role string, level int, vlm_type string"
    )


def vlm_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VLM_TYPES, "vlm_type string, kind string, role string, level int")


def vlm_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VLM_LABELS, "label string, vlm_type string, kind string, role string, level int")


def values_sql(name: str, columns: str, rows: tuple) -> str:
    """A dimension as a common table expression."""

    def text(v) -> str:
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)

    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)})"
