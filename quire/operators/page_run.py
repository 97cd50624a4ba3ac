"""A page's recognition as joins: each detected region gets the result of the stage that its kind calls for.

Stages are tables keyed by doc_id, page_idx, idx that models have filled; one that couldn't be loaded is absent, and what it would have given is null.
A failure inside a stage is a row's error text. Neither ends the run: warnings are a column.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quire.functions import geometry as g
from quire.operators import assemble as a
from quire.schema import VISUAL_KINDS, layout_labels
from quire.sources.sinks import crop_name

KEY = ("doc_id", "page_idx", "idx")
#: Kinds whose text is read.
TEXT_KINDS = ("text", "caption", "footnote", "discarded")
#: Names of a native reader's page rotations and font weights.
ROTATIONS = {"none": 0, "degrees90": 90, "degrees180": 180, "degrees270": 270}
WEIGHTS = {"weight100": 100, "weight200": 200, "weight300": 300, "weight400normal": 400, "weight500": 500, "weight600": 600, "weight700bold": 700, "weight800": 800, "weight900": 900}
#: Stages of a run, in the order of their report; the two table stages are also reported together.
STAGES = ("rasterize", "native_text", "layout", "ocr", "formula", "table_classify", "table_recognize")


def _named(name: Column, values: dict[str, int]) -> Column:
    out = F.lit(None).cast("int")
    for k, v in values.items():
        out = F.when(F.lower(name) == k, v).otherwise(out)
    return out


def rotation_degrees(name: Column) -> Column:
    """Degrees of a page rotation's name; null for another name."""
    return _named(name, ROTATIONS)


def font_weight(name: Column) -> Column:
    """A font weight from its name, or from a number as text (a custom weight); null for anything else."""
    return F.coalesce(_named(name, WEIGHTS), F.when(name.rlike(r"\A-?[0-9]{1,9}\z"), name.cast("int")))


@dataclass(frozen=True)
class Stages:
    """Results of a page run's stages; None where a stage is absent.

    native: KEY, text. ocr: KEY, line_idx, bbox, text, score. formulas: KEY, latex. classes: KEY, class (wired or wireless; null where the classifier failed).
    wired, wireless: KEY, html, error.
    """

    native: DataFrame | None = None
    ocr: DataFrame | None = None
    formulas: DataFrame | None = None
    classes: DataFrame | None = None
    wired: DataFrame | None = None
    wireless: DataFrame | None = None


def best_effort(name: str, load: Callable[[], DataFrame]) -> DataFrame | None:
    """A stage's table, or None with a warning if it can't be loaded."""
    try:
        return load()
    except Exception as e:  # whatever a stage's loader meets, the run goes on without the stage
        warnings.warn(f"stage {name} is absent: {e}", stacklevel=2)
        return None


def _given(stage: DataFrame | None, regions: DataFrame, columns: str) -> DataFrame:
    """The stage's table; an empty one if it is absent."""
    empty = f"doc_id long, page_idx int, idx int, {columns}"
    return stage.select(*[c.split()[0] for c in empty.split(", ")]) if stage is not None else regions.sparkSession.createDataFrame([], empty)


def table_html(tables: DataFrame, stages: Stages) -> DataFrame:
    """``tables`` (KEY and more) with html and warning: a table that is classed as wired from the wired recogniser, any other, also one that
    wasn't classed, from the wireless one. A failed or absent recogniser gives null; a failure is told in warning."""
    one = lambda stage, name: _given(stage, tables, "html string, error string").select(*KEY, F.col("html").alias(f"_{name}"), F.col("error").alias(f"_{name}_error"))
    out = tables.join(_given(stages.classes, tables, "class string"), list(KEY), "left")
    for stage, name in ((stages.wired, "wired"), (stages.wireless, "wireless")):
        out = out.join(one(stage, name), list(KEY), "left")
    wired = F.coalesce(F.col("class") == "wired", F.lit(False))
    html, error = (F.when(wired, F.col(f"_wired{x}")).otherwise(F.col(f"_wireless{x}")) for x in ("", "_error"))
    told = F.concat(F.when(wired, F.lit("wired: ")).otherwise(F.lit("wireless: ")), error)
    return out.withColumn("html", F.when(error.isNull(), html)).withColumn("warning", told).drop("class", "_wired", "_wired_error", "_wireless", "_wireless_error")


def recognised(detections: DataFrame, stages: Stages, pixels_per_point: float = 1.0, writes_images: bool = False) -> DataFrame:
    """Regions as the assembler wants them, with kind and warning, from detections (KEY, order, label, bbox in pixels).

    Text, captions, footnotes and discarded text take the page's own text, else the recognised lines; equations and inline formulas their
    formula; tables their HTML, and a reference to their crop if images are written; images and charts always a reference. Boxes become points.
    """
    labels = F.broadcast(layout_labels(detections.sparkSession).select("label", "kind"))
    kind = F.coalesce("kind", F.raise_error(F.concat(F.lit("unknown layout label "), F.col("label"))))
    points = g.scale(F.col("bbox"), 1.0 / pixels_per_point)
    regions = detections.join(labels, "label", "left").select(*KEY, "order", "label", kind.alias("kind"), points.alias("bbox"))
    native = _given(stages.native, regions, "text string")
    ocr = stages.ocr if stages.ocr is not None else regions.select(*KEY, F.lit(0).alias("line_idx"), "bbox", F.lit("").alias("text"), g.f32(0).alias("score")).limit(0)
    read = a.native_or_ocr(regions, native, ocr)
    lines = F.col("text_lines")
    read = read.withColumn("text_lines", F.when(F.col("kind").isin(*TEXT_KINDS), lines).otherwise(F.slice(lines, 1, 0)))
    read = read.join(_given(stages.formulas, regions, "latex string").withColumnRenamed("latex", "_latex"), list(KEY), "left")
    read = table_html(read, stages)
    only = lambda kinds, value: F.when(F.col("kind").isin(*kinds), value)
    pictured = tuple(k for k in VISUAL_KINDS if writes_images or k != "table")
    return read.select(
        *KEY, "order", "label", "kind", "bbox", "text_lines", only(("equation",), F.col("_latex")).alias("latex"), only(("inline_formula",), F.col("_latex")).alias("inline_latex"),
        only(("table",), F.col("html")).alias("html"), only(pictured, crop_name()).alias("image"), only(("table",), F.col("warning")).alias("warning"),
    )


def without(regions: DataFrame, formula: bool = True, table: bool = True) -> DataFrame:
    """``regions`` as they are without the formula or the table stage: their results are null."""
    for wanted, columns in ((formula, ("latex", "inline_latex")), (table, ("html",))):
        if not wanted:
            regions = regions.withColumns({c: F.lit(None).cast("string") for c in columns})
    return regions


def stage_times(times: DataFrame) -> DataFrame:
    """(stage, seconds, percent) from rows (stage, seconds): sums over all pages and their shares of the sum of all stages, 0 if that is 0, and one
    row ``table`` for both table stages. Stages without a row have 0."""
    known = times.sparkSession.createDataFrame([(s,) for s in STAGES], "stage string")
    each = known.join(F.broadcast(times.groupBy("stage").agg(F.sum("seconds").alias("seconds"))), "stage", "left").select("stage", F.coalesce("seconds", F.lit(0.0)).alias("seconds"))
    both = each.where(F.col("stage").startswith("table_")).agg(F.sum("seconds").alias("seconds")).select(F.lit("table").alias("stage"), "seconds")
    shared = each.withColumn("part", F.lit(True)).unionByName(both.withColumn("part", F.lit(False))).withColumn("one", F.lit(0))
    total = F.sum(F.when(F.col("part"), F.col("seconds"))).over(Window.partitionBy("one"))
    return shared.withColumn("percent", F.when(total == 0, F.lit(0.0)).otherwise(F.col("seconds") / total * 100)).select("stage", "seconds", "percent")
