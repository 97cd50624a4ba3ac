"""Outputs: Markdown, content lists, documents, and crops of page images."""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def png(image: np.ndarray) -> bytes:
    """A (height, width, 3) array of bytes as PNG."""
    h, w, _ = image.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(image, dtype=np.uint8).reshape(h, w * 3)], axis=1)
    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def png_data_url(png_bytes: Column) -> Column:
    return F.concat(F.lit("data:image/png;base64,"), F.translate(F.base64(png_bytes), "\r\n", ""))


def data_url(image: np.ndarray) -> str:
    return "data:image/png;base64," + base64.b64encode(png(image)).decode()


def crop(image: np.ndarray, box: tuple[float, float, float, float]) -> tuple[np.ndarray, float, float] | None:
    """The part of an image in a box held to its bounds, with the box's origin; None if it has no whole pixel."""
    h, w = image.shape[:2]
    x0, x1 = (min(max(float(np.float32(v)), 0.0), float(w)) for v in (box[0], box[2]))
    y0, y1 = (min(max(float(np.float32(v)), 0.0), float(h)) for v in (box[1], box[3]))
    cw, ch = int(max(0.0, x1 - x0)), int(max(0.0, y1 - y0))
    return (image[int(y0) : int(y0) + ch, int(x0) : int(x0) + cw], x0, y0) if cw and ch else None


def crop_share(image: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """The part of an image in a box of shares, rounded to pixels, one at least on each side."""
    h, w = image.shape[:2]
    r = lambda v, n: int(min(max(np.floor(v * n + 0.5), 0), n))
    x0, y0, x1, y1 = r(box[0], w), r(box[1], h), r(box[2], w), r(box[3], h)
    return image[y0 : max(y1, y0 + 1), x0 : max(x1, x0 + 1)]


def crop_name() -> Column:
    return F.concat(F.lit("p"), F.col("page_idx"), F.lit("_o"), F.col("order"), F.lit(".png"))


def crops(regions: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_idx, order, name, png): crops of regions (doc_id, page_idx, order, bbox in pixels) from page images
    (doc_id, page_idx, width_px, height_px, pixels binary RGB). Boxes without a pixel give none. A page's image is joined
    with its regions' boxes as one array, so it is sent once."""
    boxes = regions.groupBy("doc_id", "page_idx").agg(F.collect_list(F.struct("order", "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1")).alias("boxes"))
    joined = pages.join(boxes, ["doc_id", "page_idx"]).select("doc_id", "page_idx", "width_px", "height_px", "pixels", "boxes")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples():
                image = np.frombuffer(r.pixels, np.uint8).reshape(r.height_px, r.width_px, 3)
                for b in r.boxes:
                    part = crop(image, (b["x0"], b["y0"], b["x1"], b["y1"]))
                    if part:
                        out.append((r.doc_id, r.page_idx, b["order"], f"p{r.page_idx}_o{b['order']}.png", png(part[0])))
            yield pd.DataFrame(out, columns=["doc_id", "page_idx", "order", "name", "png"])

    return joined.mapInPandas(run, "doc_id long, page_idx int, order int, name string, png binary")


def write_outputs(markdown: DataFrame, content_lists: DataFrame, path: str, documents: DataFrame | None = None, mode: str = "overwrite") -> None:
    """Parquet tables markdown, content_list and, if given, document under ``path``: one row per document, so writing spreads and no task opens
    a file per document."""
    for name, df in (("markdown", markdown), ("content_list", content_lists), ("document", documents)):
        if df is not None:
            df.write.mode(mode).parquet(f"{path.rstrip('/')}/{name}")


def write_text_files(df: DataFrame, text: str, path: str, mode: str = "overwrite") -> None:
    """One folder per document (stem=...) with its text: for few documents that are read by people."""
    df.select("stem", F.col(text).alias("value")).repartition("stem").write.mode(mode).partitionBy("stem").option("lineSep", "\n").text(path)
