"""Text functions over columns: blanks, titles, inline formulas, VLM answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.schema import BBOX

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Headings that count as sections without a number.
SECTION_WORDS = (
    "abstract", "references", "acknowledgment", "acknowledgments", "acknowledgement", "acknowledgements", "appendix", "conclusion", "introduction",
)
#: Typographic signs written out; the control sign 2 is a soft hyphen.
LIGATURES = (("\u0002", "-"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "ft"), ("ﬆ", "st"))
END_TOKEN = "<|im_end|>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body (or a lambda in it) uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trim(s: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+\z", "")


def is_blank(s: Column) -> Column:
    return s.rlike(r"(?U)\A\s*\z")


def ascii_lower(s: Column) -> Column:
    return F.translate(s, UPPER, LOWER)


def has_section_number(s: Column) -> Column:
    """Digit groups joined by single dots, then white space and more; ``s`` is trimmed."""
    return s.rlike(r"(?U)\A[0-9]+(\.[0-9]+)*\s")


def is_section_word(s: Column) -> Column:
    return ascii_lower(F.regexp_replace(s, r"\.+\z", "")).isin(*SECTION_WORDS)


def is_section_heading(s: Column) -> Column:
    return has_section_number(s) | is_section_word(s)


def title_level(role: Column, level: Column, first_line: Column) -> Column:
    """A document title that reads like a section heading is of level 1."""
    heading = is_section_heading(trim(F.coalesce(first_line, F.lit(""))))
    return F.when((role == "title") & (level == 0) & heading, F.lit(1)).otherwise(level)


def write_out(s: Column) -> Column:
    for sign, letters in LIGATURES:
        s = F.replace(s, F.lit(sign), F.lit(letters))
    return s


def collapse_newlines(s: Column) -> Column:
    """Every newline, with the other white space after it, becomes one blank; the ends are trimmed."""
    return trim(F.regexp_replace(s, r"(?U)\n[\s&&[^\n]]*", " "))


def strip_end_token(s: Column, token: str = END_TOKEN) -> Column:
    """Trimmed, without repeats of the token at the end, and trimmed again."""
    return trim(F.regexp_replace(trim(s), rf"(?:\Q{token}\E)+\z", "")) if token else trim(s)


def clean_formula(s: Column) -> Column:
    r"""Without white space around and one outer \[ and \]."""
    return trim(F.regexp_replace(F.regexp_replace(trim(s), r"\A\\\[", ""), r"\\\]\z", ""))


def inline_spans(s: Column, bbox: Column) -> Column:
    r"""Spans of a text in which \( and \) set off formulas.

    If their counts differ or are 0, the whole text is one span. Otherwise, formulas and the texts between them
    alternate; blank texts are left out; what follows an opening sign without a closing one behind it is text. Nothing left makes one empty text.
    """
    opens, closes = F.regexp_count(s, F.lit(r"\\\(")), F.regexp_count(s, F.lit(r"\\\)"))

    def span(kind: str, text: Column | None, latex: Column | None) -> Column:
        null = F.lit(None).cast("string")
        return F.struct(
            F.lit(kind).alias("kind"), bbox.cast(BBOX).alias("bbox"), (null if text is None else text).alias("text"), (null if latex is None else latex).alias("latex"),
            null.alias("image"), F.lit(1.0).cast("float").alias("score"),
        )

    # A formula is an opening sign up to the first closing one; the pieces between formulas are texts.
    formula = r"(?s)\\\((.*?)\\\)"
    formulas = F.regexp_extract_all(s, F.lit(formula), F.lit(1))
    texts = F.split(s, formula, -1)
    n = F.size(formulas)
    last = F.element_at(texts, -1)
    # In the last piece an opening sign may be left over: both sides of it are texts of their own, and the scan ends there.
    cut = F.instr(last, "\\(")
    tail = F.when(cut > 0, F.array(F.substring(last, F.lit(1), cut - 1), F.substring(last, cut + 2, F.length(last)))).otherwise(F.array(last))
    pairs = F.flatten(F.transform(formulas, lambda f, i: F.array(span("text", F.get(texts, i), None), span("inline_equation", None, trim(f)))))
    ends = F.transform(tail, lambda t, i: span("text", t, None))
    # The text right behind a left-over opening sign is kept even if it is blank.
    kept = F.filter(F.concat(pairs, ends), lambda x, i: (x["kind"] != "text") | ~is_blank(x["text"]) | ((cut > 0) & (i == 2 * n + 1)))
    split = F.when(F.size(kept) > 0, kept).otherwise(F.array(span("text", F.lit(""), None)))
    return F.when((opens == 0) | (opens != closes), F.array(span("text", s, None))).otherwise(split)


def join_path(folder: Column, name: Column) -> Column:
    a, b = F.rtrim(folder, F.lit("/")), F.ltrim(name, F.lit("/"))
    return F.when(a == "", b).when(b == "", a).otherwise(F.concat(a, F.lit("/"), b))


def layout_answer(s: Column) -> Column:
    """Blocks of a VLM's layout answer: array of (bbox in shares of the page, label, angle).

    Boxes outside 0 to 1000 or empty, and inline formulas, are left out; ``unknown`` is an image; labels are lower-cased.
    """
    from quire.functions import geometry as g

    pattern = F.lit(
        r"(?U)<\|box_start\|>(\d+)\s+(\d+)\s+(\d+)\s+(\d+)<\|box_end\|><\|ref_start\|>(\w+?)<\|ref_end\|>(<\|rotate_(?:up|right|down|left)\|>)?"
    )
    part = [F.regexp_extract_all(s, pattern, F.lit(i)) for i in range(1, 7)]
    rows = F.arrays_zip(*[p.alias(f"g{i}") for i, p in enumerate(part)])
    number = lambda r, i: F.when(r[f"g{i}"].rlike(r"\A[0-9]+\z"), F.try_to_number(r[f"g{i}"], F.lit("9" * 38)).cast("decimal(38,0)"))

    def block(r: Column) -> Column:
        n = [F.when(number(r, i) <= 1000, number(r, i).cast("int")) for i in range(4)]
        label = ascii_lower(r["g4"])
        angle = F.when(r["g5"] == "<|rotate_right|>", 90).when(r["g5"] == "<|rotate_down|>", 180).when(r["g5"] == "<|rotate_left|>", 270).otherwise(0)
        return F.struct(g.from_thousandths(*n).alias("bbox"), F.when(label == "unknown", F.lit("image")).otherwise(label).alias("label"), angle.alias("angle"))

    return F.filter(F.transform(rows, block), lambda b: b["bbox"].isNotNull() & (b["label"] != "inline_formula"))


def extraction_prompt(label: Column) -> Column:
    return (
        F.when(label == "table", F.lit("\nTable Recognition:"))
        .when(label == "equation", F.lit("\nFormula Recognition:"))
        .when(label.isin("image", "chart"), F.lit("\nImage Analysis:"))
        .otherwise(F.lit("\nText Recognition:"))
    )


def extraction_sampling(label: Column) -> Column:
    """Sampling parameters of a request for a block's content."""
    fixed = {"temperature": 0.0, "top_p": 0.01, "presence_penalty": 1.0, "repetition_penalty": 1.0}
    frequency = F.when(label == "table", F.lit(0.005)).otherwise(F.lit(0.05)).cast("float")
    whole = [F.lit(1).alias("top_k"), F.lit(100).alias("no_repeat_ngram_size")]
    return F.struct(*[F.lit(v).cast("float").alias(k) for k, v in fixed.items()], frequency.alias("frequency_penalty"), *whole)
