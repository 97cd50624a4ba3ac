"""Quality rules kept as a ledger of failure bits and measurements; policies and ablations read the bits."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import as_bytes

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
#: Bytes that continue a code point in UTF-8.
CONTINUED = bytes(range(0x80, 0xC0))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits")
#: Each rule: name and the condition (over measurements, integers only) under which a text fails it. Its bit is its place here.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeats", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 30 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 40 * n_lines"),
    ("short_words", "2 * word_chars < 3 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("capitals", "100 * n_upper > 50 * word_chars"),
    ("digits", "100 * n_digits > 30 * word_chars"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}


def policy(*names: str) -> int:
    """The bits of the named rules."""
    return sum(BIT[n] for n in set(names))


#: Versioned policies: a text is kept if it fails none of a policy's rules.
POLICIES = {"base": policy("few_words", "repeats"), "v1": policy("few_words", "repeats", "symbols", "duplicate_lines"), "v2": policy(*BIT)}


def measure(text: bytes) -> tuple[int, ...]:
    """The measurements of a whole text, in the order of MEASURES."""
    words = text.split()
    n = len(words)
    word_chars = len(text.translate(None, SPACES + CONTINUED))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(text) - len(text.translate(None, b"0123456789"))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        count = Counter(windows)
        reach = 0
        for i, window in enumerate(windows):
            if count[window] > 1:
                repeated += i + 3 - max(i, reach)
                reach = i + 3
    return n, word_chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), upper, digits


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, the measurements (long), and failed (int), a bit for each rule that the text fails.

    A null text counts as empty, which has no words and fails few_words only. Null ids and repeated rows are carried as they are. An empty
    table gives an empty result. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([measure(t) for t in as_bytes(batch.column(1))], dtype=np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, k]) for k in range(len(MEASURES)))], ["doc_id", *MEASURES])

    measured = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, condition) in enumerate(RULES)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured.withColumn("failed", failed)


def passes(failed: Column, bits: int) -> Column:
    return failed.bitwiseAND(F.lit(bits)) == 0


def judged(docs: DataFrame, version: str = "v2", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger's rows with base_failed and kept under a policy; a text that fails the base is never kept."""
    base = ~passes(F.col("failed"), POLICIES["base"])
    return ledger(docs, id_col, text_col).withColumn("base_failed", base).withColumn("kept", passes(F.col("failed"), POLICIES["base"] | POLICIES[version]))


def ablations(entries: DataFrame, version: str = "v2") -> DataFrame:
    """For each rule of a policy: rule, n_failed, n_only (texts that only this rule rejects), n_kept (texts kept without it).

    The ledger is first counted by its bits, at most 2 ** len(RULES) rows, and never measured again.
    """
    bits = POLICIES[version]
    counts = entries.groupBy(F.col("failed").bitwiseAND(F.lit(bits)).alias("failed")).agg(F.count("*").alias("n"))
    names = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).alias("bit")) for n, b in BIT.items() if b & bits])).alias("r")
    each = counts.select("failed", "n", names).select("failed", "n", "r.rule", "r.bit")
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("failed") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when((F.col("failed") == 0) | (F.col("failed") == F.col("bit")), F.col("n")).otherwise(0)).alias("n_kept"),
    )


def judged_sql(version: str = "v2") -> str:
    """DuckDB SQL for ``judged`` over the view documents."""
    white = r"[\x20\x09-\x0D]"
    failed = " + ".join(f"CASE WHEN {c} THEN {1 << k} ELSE 0 END" for k, (_, c) in enumerate(RULES))
    removed = lambda cls: f"length(t) - length(regexp_replace(t, '[{cls}]', '', 'g'))"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, row_number() OVER () AS r FROM documents),
win AS (SELECT r, unnest(list_transform(range(1, len(w) - 1), lambda i: {{'i': i, 'g': w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]}}), recursive := true) FROM d WHERE len(w) > 2),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
cover AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY r),
line AS (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d),
lines AS (SELECT r, count(*) AS n, count(DISTINCT l) AS u FROM line WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{white}', '', 'g'))::BIGINT AS word_chars,
  ({removed("#*$%&|<>")})::BIGINT AS n_symbols, coalesce(lines.n - lines.u, 0)::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words,
  coalesce(lines.n, 0)::BIGINT AS n_lines, ({removed("A-Z")})::BIGINT AS n_upper, ({removed("0-9")})::BIGINT AS n_digits
  FROM d LEFT JOIN cover USING (r) LEFT JOIN lines USING (r)),
f AS (SELECT *, ({failed})::INTEGER AS failed FROM m)
SELECT *, (failed & {POLICIES["base"]}) <> 0 AS base_failed, (failed & {POLICIES["base"] | POLICIES[version]}) = 0 AS kept FROM f"""
