"""The boundary to a native document reader: pages, their characters and their pictures from files.

No reader is part of this package. ``load`` is called once in a task, binds whatever library it needs, and gives a ``Reader``.
"""

from __future__ import annotations

import platform
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.page_run import font_weight, rotation_degrees
from quire.sources.documents import DPI, page_pixels

_BOX = "struct<left:float,bottom:float,right:float,top:float>"
_CHARS = f"array<struct<char_idx:int,ch:string,loose:{_BOX},tight:{_BOX},angle:float,font:string,font_size:float,weight:string>>"
PAGES = f"doc_id long, page_idx int, n_pages int, width double, height double, rotation string, chars {_CHARS}, pixels binary, width_px int, height_px int, error string"
_F, _S, _I = pa.float32(), pa.string(), pa.int32()
_ARROW_BOX = pa.struct([("left", _F), ("bottom", _F), ("right", _F), ("top", _F)])
_ARROW_CHAR = pa.struct([("char_idx", _I), ("ch", _S), ("loose", _ARROW_BOX), ("tight", _ARROW_BOX), ("angle", _F), ("font", _S), ("font_size", _F), ("weight", _S)])
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("page_idx", _I), ("n_pages", _I), ("width", pa.float64()), ("height", pa.float64()), ("rotation", _S), ("chars", pa.list_(_ARROW_CHAR)), ("pixels", pa.binary()), ("width_px", _I), ("height_px", _I), ("error", _S)]
)
#: A native library's archive, the library in it and its name beside the program, by system and processor.
ASSETS = {
    ("macos", "aarch64"): ("pdfium-mac-arm64.tgz", "lib/libpdfium.dylib", "libpdfium.dylib"),
    ("macos", "x86_64"): ("pdfium-mac-x64.tgz", "lib/libpdfium.dylib", "libpdfium.dylib"),
    ("linux", "x86_64"): ("pdfium-linux-x64.tgz", "lib/libpdfium.so", "libpdfium.so"),
    ("linux", "aarch64"): ("pdfium-linux-arm64.tgz", "lib/libpdfium.so", "libpdfium.so"),
    ("windows", "x86_64"): ("pdfium-win-x64.zip", "bin/pdfium.dll", "pdfium.dll"),
}


class Document(Protocol):
    """An open document. A page is a dictionary with width, height (points), rotation (a name) and characters; a picture is RGB bytes of the wanted size."""

    def page_count(self) -> int: ...

    def page(self, index: int) -> dict: ...

    def picture(self, index: int, width: int, height: int) -> bytes: ...


#: From a file's bytes (no password) to a document; an unreadable file is an exception.
Reader = Callable[[bytes], Document]


def native_asset(system: str | None = None, machine: str | None = None) -> tuple[str, str, str]:
    """Archive, library in it, and file name of the native library for a system and processor (this machine's by default); ValueError where there is none."""
    system = system or {"darwin": "macos"}.get(platform.system().lower(), platform.system().lower())
    machine = machine or {"arm64": "aarch64", "amd64": "x86_64"}.get(platform.machine().lower(), platform.machine().lower())
    if (system, machine) not in ASSETS:
        raise ValueError(f"no native library for {system} on {machine}")
    return ASSETS[system, machine]


def _character(c: dict) -> dict:
    """A character with its boxes (left, bottom, right, top) as structs."""
    box = lambda b: None if b is None else dict(zip(("left", "bottom", "right", "top"), b, strict=True))
    return {**c, "loose": box(c.get("loose")), "tight": box(c.get("tight"))}


def read_pages(files: DataFrame, load: Callable[[], Reader], page_range: tuple[int, int | None] | None = None, dpi: float | None = None) -> DataFrame:
    """One row per page (PAGES) of files (doc_id, content). Pages outside ``page_range`` aren't opened; pictures are drawn only with a ``dpi``.

    A file that can't be opened gives one row with its error and no page; a page that can't be read one with its number and error. Files are spread over tasks as they are
    read; a document's pages leave its task one by one.
    """

    def rows(reader: Reader, doc_id: int, content: bytes) -> Iterator[dict]:
        try:
            document = reader(bytes(content or b""))
            n = document.page_count()
        except Exception as e:  # a native reader's own error types
            yield {"doc_id": doc_id, "error": str(e) or type(e).__name__}
            return
        first, end = page_range or (0, None)
        for k in range(min(first, n), n if end is None else min(end, n)):
            row = {"doc_id": doc_id, "page_idx": k, "n_pages": n}
            try:
                page = document.page(k)
                row |= {"width": page["width"], "height": page["height"], "rotation": page.get("rotation", "none"), "chars": [_character(c) for c in page.get("characters", [])]}
                if dpi is not None:
                    row |= {"width_px": page_pixels(page["width"], dpi), "height_px": page_pixels(page["height"], dpi)}
                    row["pixels"] = document.picture(k, row["width_px"], row["height_px"])
            except Exception as e:  # as above
                row["error"] = f"page {k} of {n}: {e}"
            yield row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = load()
        for batch in batches:
            for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for row in rows(reader, doc_id, content):
                    yield pa.RecordBatch.from_pylist([row], schema=_ARROW)

    return files.select("doc_id", "content").mapInArrow(run, PAGES)


def page_table(pages: DataFrame) -> DataFrame:
    """(doc_id, page_idx, width, height, rotation) of the pages that could be read, rotation in degrees."""
    return pages.where("error is null").select("doc_id", "page_idx", "width", "height", rotation_degrees(F.col("rotation")).alias("rotation"))


def raw_characters(pages: DataFrame) -> DataFrame:
    """The characters of pages as ``native_text.scan_glyphs`` wants them."""
    each = pages.where("error is null").select("doc_id", "page_idx", F.col("height").cast("float").alias("page_height"), F.explode("chars").alias("c"))
    same = [F.col(f"c.{n}").alias(n) for n in ("char_idx", "ch", "loose", "tight", "angle", "font", "font_size")]
    return each.select("doc_id", "page_idx", "page_height", *same, font_weight(F.col("c.weight")).alias("weight"))


def open_errors(pages: DataFrame) -> DataFrame:
    """(doc_id, page_idx, error): what couldn't be read; page_idx is null for a whole file."""
    return pages.where("error is not null").select("doc_id", "page_idx", "error")


__all__ = ["DPI", "PAGES", "Document", "Reader", "native_asset", "open_errors", "page_table", "raw_characters", "read_pages"]
