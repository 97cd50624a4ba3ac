"""Command line: tables of recognised regions, of stages' results, or of VLM answers to Markdown, content lists and JSON documents.

Reading page images and running models is left to the operators that make these tables (see README). Every option acts: there are none for models that
don't run here.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from quire.operators import render
from quire.plans import engine
from quire.sources.documents import DPI, EFFORTS, POINTS, Config, ParseOptions, check_effort, parse_page_range
from quire.sources.sinks import write_outputs

BACKENDS = ("pipeline", "pages", "vlm", "hybrid")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quire", description=__doc__)
    p.add_argument(
        "input",
        help="folder with pages.parquet and: regions.parquet (pipeline); detections.parquet and what there is of native, ocr, formulas, classes, wired, wireless (pages); answers.parquet (vlm, hybrid); "
        "detections.parquet and ocr.parquet (hybrid)",
    )
    p.add_argument("-o", "--output", required=True, help="folder for the tables markdown, content_list and document")
    p.add_argument("-b", "--backend", choices=BACKENDS, default="pipeline")
    p.add_argument("-m", "--mode", choices=(render.MARKDOWN, render.TEXT_ONLY), default=render.MARKDOWN)
    p.add_argument("--pages", help="START, START: or START:END (from 0, end exclusive)")
    p.add_argument("--effort", choices=EFFORTS, default="medium")
    p.add_argument("--lang", help="only OCR lines of this language, if they have a column lang (hybrid)")
    p.add_argument("--no-formula", action="store_true", help="leave formulas out")
    p.add_argument("--no-table", action="store_true", help="leave tables' contents out")
    p.add_argument("--dpi", type=float, default=DPI, help="of the detections' pixels (pages)")
    p.add_argument("--image-dir", default="images")
    p.add_argument("--debug", action="store_true", help="also write the JSON documents")
    p.add_argument("--config", help="JSON file with settings")
    return p


def _backend(spark: SparkSession, args: argparse.Namespace) -> engine.Backend:
    def table(name: str):
        return lambda _: spark.read.parquet(f"{args.input.rstrip('/')}/{name}.parquet")

    if args.backend == "pipeline":
        return engine.PipelineBackend(table("regions"))
    if args.backend == "pages":
        stages = {name: table(name) for name in ("native", "ocr", "formulas", "classes", "wired", "wireless")}
        return engine.PageRunBackend(table("detections"), stages, args.dpi / POINTS, writes_images=True)
    if args.backend == "vlm":
        return engine.VlmBackend(table("answers"))
    high = check_effort(args.effort) == "high"
    return engine.HybridBackend(table("detections"), table("answers") if high else None, table("ocr"), args.effort)


def run(spark: SparkSession, argv: Sequence[str]) -> DataFrame:
    """Parses, writes the outputs, and returns the blocks."""
    args = parser().parse_args(argv)
    config = Config.load(args.config)
    options = ParseOptions(args.lang, not args.no_formula, not args.no_table, parse_page_range(args.pages), args.image_dir)
    pages = spark.read.parquet(f"{args.input.rstrip('/')}/pages.parquet")
    built = engine.Engine().with_config(config).with_backend(args.backend, _backend(spark, args))
    blocks = built.blocks(args.backend, pages, options)
    text = render.markdown(blocks, args.mode, args.image_dir)
    items = render.content_list(render.content_items(blocks, pages, args.image_dir))
    write_outputs(text, items, args.output, render.document_json(blocks, pages) if args.debug else None)
    return blocks


def main() -> None:
    import sys

    run(SparkSession.builder.appName("quire").getOrCreate(), sys.argv[1:])


if __name__ == "__main__":
    main()
