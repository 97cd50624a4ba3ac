"""Document files, page ranges, dictionaries and configuration."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Dots per inch that pages are drawn with; PDF points per inch.
DPI, POINTS = 200.0, 72.0


def read_files(spark: SparkSession, path: str, pattern: str = "*.pdf", schema_only: bool = False) -> DataFrame:
    """(doc_id, path, stem, content): files below a path; doc_id is a hash of the path. Contents are only read if they are selected."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    stem = F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)
    out = files.select(F.xxhash64("path").alias("doc_id"), "path", stem.alias("stem"), "content")
    return out.drop("content") if schema_only else out


def parse_page_range(spec: str | None) -> tuple[int, int | None] | None:
    """START, START:END (end exclusive) or START: as numbers; None for all pages. Anything else is a ValueError."""
    if spec is None:
        return None
    start, colon, end = spec.strip().partition(":")
    number = lambda s: int(s) if s.strip().removeprefix("+").isascii() and s.strip().removeprefix("+").isdigit() else _bad(spec)
    return number(start), number(end) if colon and end.strip() else None


def _bad(spec: str) -> int:
    raise ValueError(f"not a page range: {spec!r}")


def safe_join(base: str, relative: str) -> str:
    """``relative`` below ``base``; parent folders and absolute paths are a ValueError."""
    path = PurePosixPath(relative)
    if path.is_absolute() or ".." in path.parts:
        raise ValueError(f"path escapes its folder: {relative!r}")
    return "/".join([base.rstrip("/"), *[p for p in path.parts if p != "."]])


def page_pixels(points: float, dpi: float = DPI) -> int:
    return max(1, int(points * dpi / POINTS + 0.5))


def with_pixels(pages: DataFrame, dpi: float = DPI) -> DataFrame:
    """Pages (width, height in points) with width_px, height_px, one at least."""
    px = lambda c: F.greatest(F.lit(1), F.floor(F.col(c) * F.lit(dpi / POINTS) + 0.5).cast("int"))
    return pages.withColumn("width_px", px("width")).withColumn("height_px", px("height"))


def check_pages(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """``rows`` (doc_id, page_idx); a page beyond its document's n_pages is an error when it is read."""
    joined = rows.join(counts.select("doc_id", "n_pages"), "doc_id")
    message = F.concat(F.lit("page "), F.col("page_idx"), F.lit(" of "), F.col("n_pages"))
    fine = (F.col("page_idx") >= 0) & (F.col("page_idx") < F.col("n_pages"))
    return joined.withColumn("page_idx", F.when(fine, F.col("page_idx")).otherwise(F.raise_error(message).cast("int"))).drop("n_pages")


def page_rows(counts: DataFrame) -> DataFrame:
    """(doc_id, page_idx) of all pages from (doc_id, n_pages)."""
    return counts.where("n_pages > 0").select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("n_pages") - 1).cast("int"))).alias("page_idx"))


def characters(text: str, blank_last: bool = True) -> list[str]:
    """A recogniser's characters: blank at 0, one on a line, a blank sign at the end if wanted. One empty last line is dropped; an empty list is an error."""
    lines = [x.rstrip("\r") for x in text.split("\n")]
    if lines[-1] == "":
        lines.pop()
    if not lines:
        raise ValueError("character list is empty")
    return ["blank", *lines, *([" "] if blank_last else [])]


def remap_keys(keys: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(key, name): keys with regular-expression rules applied in order."""
    name = F.col("key")
    for old, new in rules:
        name = F.regexp_replace(name, old, new)
    return keys.withColumn("name", name)


def unused_keys(names: DataFrame, fields: DataFrame, strict: bool = True) -> DataFrame:
    """Names without a field of the model. In strict use any of them is an error."""
    left = names.join(fields.select("name").distinct(), "name", "left_anti")
    if strict and (some := [r["name"] for r in left.orderBy("name").limit(5).collect()]):
        raise ValueError(f"weights that no field takes: {some}")
    return left


def missing_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Entries of a manifest (name, sha256) without a file (name, content) of that checksum."""
    good = files.select("name", F.sha2("content", 256).alias("sha256"))
    return manifest.join(good, ["name", "sha256"], "left_anti")


@dataclass(frozen=True)
class Config:
    """Settings, from a JSON file if there is one, then from environment variables."""

    device: str = "auto"
    model_source: str = "local"
    models_dir: str = "./models"
    vlm_server_url: str | None = None

    DEVICES = ("auto", "cpu", "gpu")
    VARIABLES = {"models_dir": "QUIRE_MODELS_DIR", "device": "QUIRE_DEVICE", "model_source": "QUIRE_MODEL_SOURCE"}

    @classmethod
    def load(cls, path: str | None = None, env: Callable[[str], str | None] = os.environ.get) -> Config:
        config = cls()
        path = path or env("QUIRE_CONFIG")
        if path and os.path.exists(path):
            with open(path) as f:
                config = replace(config, **json.load(f))
        changes = {k: v for k, name in cls.VARIABLES.items() if (v := env(name)) is not None}
        config = replace(config, **changes)
        if config.device not in cls.DEVICES:
            raise ValueError(f"unknown device: {config.device!r}")
        return config


@dataclass(frozen=True)
class ParseOptions:
    lang: str | None = None
    formula: bool = True
    table: bool = True
    page_range: tuple[int, int | None] | None = None
    image_dir: str | None = None
    extra: dict = field(default_factory=dict)

    @property
    def image_analysis(self) -> bool:
        return self.formula or self.table


EFFORTS = ("medium", "high")


def check_effort(effort: str) -> str:
    if effort not in EFFORTS:
        raise ValueError(f"effort must be one of {', '.join(EFFORTS)}, not {effort!r}")
    return effort


def image_analysis(effort: str, wanted: bool) -> bool:
    return check_effort(effort) == "high" and wanted
