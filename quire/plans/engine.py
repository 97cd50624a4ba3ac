"""Backends and their builder. Models and native readers are pluggable: functions from DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as t
from quire.operators import assemble as a
from quire.operators import page_run, render
from quire.operators.grouping import in_page_range
from quire.sources.documents import DPI, POINTS, Config, ParseOptions, check_effort, image_analysis

Stage = Callable[[DataFrame], DataFrame]


class Backend(Protocol):
    """From documents (or the tables that stand for them) to blocks (doc_id, page_idx, discarded, block_idx, block fields)."""

    def analyze(self, documents: DataFrame, options: ParseOptions) -> DataFrame: ...


@dataclass(frozen=True)
class PipelineBackend:
    """``regions`` gives classified, recognised regions of documents."""

    regions: Stage

    def analyze(self, documents: DataFrame, options: ParseOptions) -> DataFrame:
        regions = page_run.without(in_page_range(self.regions(documents), options.page_range), options.formula, options.table)
        return a.merge_paragraphs(a.assemble(regions))


@dataclass(frozen=True)
class PageRunBackend:
    """``detections`` gives layout detections in pixels (doc_id, page_idx, idx, order, label, bbox); the other stages their results by region, each of them
    None or failing where it is absent. Formula and table stages that the options leave out aren't loaded."""

    detections: Stage
    stages: dict[str, Stage] = field(default_factory=dict)
    pixels_per_point: float = DPI / POINTS
    writes_images: bool = False

    def analyze(self, documents: DataFrame, options: ParseOptions) -> DataFrame:
        left_out = (() if options.formula else ("formulas",)) + (() if options.table else ("classes", "wired", "wireless"))
        given = {name: page_run.best_effort(name, lambda load=load: load(documents)) for name, load in self.stages.items() if name not in left_out}
        dets = in_page_range(self.detections(documents), options.page_range)
        regions = page_run.recognised(dets, page_run.Stages(**given), self.pixels_per_point, self.writes_images)
        return a.merge_paragraphs(a.assemble(regions.drop("kind", "warning")))


@dataclass(frozen=True)
class VlmBackend:
    """``pages`` gives a VLM's answers: doc_id, page_idx, width, height, layout answer, and contents (array of texts by block)."""

    pages: Stage

    def analyze(self, documents: DataFrame, options: ParseOptions) -> DataFrame:
        return a.assemble_vlm(vlm_blocks(in_page_range(self.pages(documents), options.page_range), options.image_analysis))


@dataclass(frozen=True)
class HybridBackend:
    """``detections`` gives layout detections with their crops' contents (medium effort); ``pages`` a VLM's answers for whole pages (high effort)."""

    detections: Stage
    pages: Stage | None = None
    ocr: Stage | None = None
    effort: str = "medium"

    def analyze(self, documents: DataFrame, options: ParseOptions) -> DataFrame:
        dets = in_page_range(self.detections(documents), options.page_range)
        if check_effort(self.effort) == "high" and self.pages is not None:
            blocks = vlm_blocks(in_page_range(self.pages(documents), options.page_range), image_analysis(self.effort, options.image_analysis))
            regions = a.prompt_type(blocks).withColumn("order", F.col("idx"))
        else:
            regions = a.hybrid_type(dets)
            asked = a.sent_to_vlm(F.col("vlm_type"), image_analysis(self.effort, options.image_analysis))
            regions = regions.withColumn("content", F.when(asked, a.reduce_contents(F.col("contents"))))
        if self.ocr is not None:
            ocr = self.ocr(documents)
            if options.lang is not None and "lang" in ocr.columns:
                ocr = ocr.where(F.col("lang") == options.lang)
            regions = a.fill_from_ocr(regions, ocr)
        titles = dets.where("label = 'doc_title'").select("doc_id", "page_idx", "bbox")
        return a.assemble_hybrid(regions, titles)


def vlm_blocks(pages: DataFrame, with_images: bool) -> DataFrame:
    """(doc_id, page_idx, idx, label, angle, bbox in page units, content, image) from layout answers; contents that aren't asked for are null."""
    from quire.functions import geometry as g

    keep = ["doc_id", "page_idx", "width", "height", "contents"]
    each = pages.select(*keep, F.posexplode(t.layout_answer(F.col("answer"))).alias("idx", "b"))
    content = F.when(~a.skips_extraction(F.col("label"), with_images), t.strip_end_token(F.get("contents", F.col("idx"))))
    found = each.select(*keep, "idx", F.col("b.label").alias("label"), F.col("b.angle").alias("angle"), g.denormalize(F.col("b.bbox"), F.col("width"), F.col("height")).alias("bbox"))
    return found.select("doc_id", "page_idx", "idx", "label", "angle", "bbox", content.alias("content"), F.lit(None).cast("string").alias("image"))


@dataclass(frozen=True)
class Engine:
    """Built step by step; parses documents into blocks, Markdown, content lists and JSON documents."""

    config: Config = field(default_factory=Config)
    backends: dict[str, Backend] = field(default_factory=dict)

    def with_backend(self, name: str, backend: Backend) -> Engine:
        return replace(self, backends={**self.backends, name: backend})

    def with_config(self, config: Config) -> Engine:
        return replace(self, config=config)

    def blocks(self, backend: str, documents: DataFrame, options: ParseOptions | None = None) -> DataFrame:
        if backend not in self.backends:
            raise ValueError(f"no backend {backend!r}; there are {sorted(self.backends)}")
        return self.backends[backend].analyze(documents, options or ParseOptions())

    def markdown(self, backend: str, documents: DataFrame, options: ParseOptions | None = None, mode: str = render.MARKDOWN) -> DataFrame:
        return render.markdown(self.blocks(backend, documents, options), mode)
