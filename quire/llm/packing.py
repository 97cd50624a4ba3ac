"""Length buckets with the least padding, and token-budget batches inside them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut, numbered, numbered_sql

#: Word runs, or single other signs, as regular-expression tokens.
TOKEN = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\x20\x09-\x0D]"


def n_tokens(text: Column) -> Column:
    """Tokens of a whole text (0 for null). Another tokenizer's counts can be given to ``pack`` as a column."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets that minimise sum(count * (upper - length)), by dynamic programming.

    ``histogram`` maps a length to a count; fewest buckets among equals; [] for no lengths. O(buckets * lengths ** 2).
    """
    lengths = sorted(n for n, c in histogram.items() if c > 0)
    if not lengths:
        return []
    size = np.array(lengths, dtype=np.float64)
    count = np.concatenate([[0], np.cumsum([histogram[n] for n in lengths], dtype=np.float64)])
    mass = np.concatenate([[0], np.cumsum([histogram[n] * n for n in lengths], dtype=np.float64)])
    m = len(lengths)
    best = np.full(m + 1, np.inf)
    best[0] = 0
    steps: list[np.ndarray] = []
    costs: list[float] = []
    for _ in range(min(buckets, m)):
        now, step = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=np.int64)
        for j in range(1, m + 1):
            pad = best[:j] + size[j - 1] * (count[j] - count[:j]) - (mass[j] - mass[:j])
            step[j] = int(np.argmin(pad))
            now[j] = pad[step[j]]
        steps.append(step)
        costs.append(now[m])
        best = now
    out, j = [], m
    for step in reversed(steps[: int(np.argmin(costs)) + 1]):
        out.append(lengths[j - 1])
        j = int(step[j])
    return out[::-1]


def pack(
    docs: DataFrame,
    max_len: int = 2048,
    buckets: int = 16,
    budget: int = 65_536,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: Column | None = None,
) -> DataFrame:
    """One row per piece: doc_id, piece, n_pieces, start, n_tokens, bucket, bucket_len, batch, place.

    A document's tokens and one end mark are cut into pieces of ``max_len`` and a rest, so every length is 1 to ``max_len``
    and the histogram that reaches the driver has at most ``max_len`` rows. Buckets minimise the padding over all
    pieces. Inside a bucket, pieces are numbered in an order fixed by id and length, and each run of ``budget // bucket_len`` is a
    batch of at most ``budget`` padded tokens (one piece if the budget is smaller than the bucket).
    ``length`` is a column of token counts that replaces ``n_tokens``. A null, empty or blank text is one piece, its end mark. Null
    ids and repeated rows are packed like others, each row once. An empty table gives an empty result. Other columns are ignored.
    """
    counted = docs.select(F.col(id_col).alias("doc_id"), ((length if length is not None else n_tokens(F.col(text_col))) + 1).cast("long").alias("_all"))
    counted = cut(counted)
    whole, rest = F.floor((F.col("_all") - 1) / max_len).cast("long"), (F.col("_all") - 1) % max_len + 1
    tails = counted.groupBy(rest.alias("n")).agg(F.count("*").alias("c"))
    histogram = {r["n"]: r["c"] for r in tails.collect()}
    full = counted.agg(F.sum(whole).alias("f")).first()["f"] or 0
    if full:
        histogram[max_len] = histogram.get(max_len, 0) + full
    bounds = boundaries(histogram, buckets)
    pieces = counted.select("doc_id", "_all", F.explode(F.sequence(F.lit(0).cast("long"), whole)).alias("piece"))
    left = F.col("_all") - F.col("piece") * max_len
    bounds_ = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array(F.lit(max_len))
    in_buckets = (
        pieces.withColumn("n_tokens", F.least(left, F.lit(max_len)))
        .withColumn("n_pieces", F.ceil(F.col("_all") / max_len).cast("long"))
        .withColumn("start", F.col("piece") * max_len)
        .withColumn("bucket", F.size(F.filter(bounds_, lambda b: b < F.col("n_tokens"))))
        .withColumn("bucket_len", F.element_at(bounds_, F.col("bucket") + 1).cast("long"))
    )
    ranked = numbered(in_buckets, ["bucket"], ["doc_id", "piece", "_all"], "_rank")
    per_batch = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.col("bucket_len")))
    return ranked.select(
        "doc_id", "piece", "n_pieces", "start", "n_tokens", "bucket", "bucket_len",
        F.floor(F.col("_rank") / per_batch).cast("long").alias("batch"), (F.col("_rank") % per_batch).cast("long").alias("place"),
    )


def pack_sql(max_len: int = 2048, buckets: int = 16, budget: int = 65_536) -> str:
    """DuckDB SQL for ``pack`` over the view documents: the dynamic program is a query for each number of buckets over all pairs of lengths."""
    levels = ["level1 AS (SELECT l.j, [l.n * l.count - l.mass, 0]::DOUBLE[] AS best FROM lengths l)"]
    for k in range(2, buckets + 1):
        cost = "i.best[1] + l.n * (l.count - p.count) - (l.mass - p.mass)"
        levels.append(f"level{k} AS (SELECT l.j, min([{cost}, p.j]::DOUBLE[]) AS best FROM lengths l JOIN lengths p ON p.j < l.j JOIN level{k - 1} i ON i.j = p.j GROUP BY l.j)")
    every = " UNION ALL ".join(f"SELECT {k} AS k, j, best[1] AS pad, best[2]::BIGINT AS step FROM level{k}" for k in range(1, buckets + 1))
    return rf"""
WITH RECURSIVE counted AS (SELECT doc_id, (len(regexp_extract_all(coalesce(text, ''), '{TOKEN}')) + 1)::BIGINT AS _all FROM documents),
pieces AS (SELECT doc_id, _all, unnest(range((_all - 1) // {max_len} + 1)) AS piece FROM counted),
sized AS (SELECT *, least(_all - piece * {max_len}, {max_len}) AS n_tokens FROM pieces),
lengths AS (SELECT row_number() OVER (ORDER BY n) AS j, n::DOUBLE AS n, (sum(c) OVER (ORDER BY n))::DOUBLE AS count, (sum(c * n) OVER (ORDER BY n))::DOUBLE AS mass FROM (SELECT n_tokens AS n, count(*) AS c FROM sized GROUP BY n)),
{", ".join(levels)},
every AS ({every}),
chosen AS (SELECT k, j, step FROM every WHERE j = (SELECT max(j) FROM lengths) ORDER BY pad, k LIMIT 1),
back AS (SELECT k, j, step FROM chosen UNION ALL SELECT e.k, e.j, e.step FROM back b JOIN every e ON e.k = b.k - 1 AND e.j = b.step),
bounds AS (SELECT list(n::BIGINT ORDER BY n) AS bounds FROM back JOIN lengths USING (j)),
placed AS (SELECT doc_id, piece, ((_all + {max_len - 1}) // {max_len})::BIGINT AS n_pieces, (piece * {max_len})::BIGINT AS start, n_tokens, len(list_filter(bounds, lambda b: b < n_tokens))::INTEGER AS bucket, bounds, _all FROM sized, bounds),
ranked AS (SELECT *, bounds[bucket + 1] AS bucket_len, {numbered_sql(["bucket"], ["doc_id", "piece", "_all"])} AS rank FROM placed)
SELECT doc_id, piece, n_pieces, start, n_tokens, bucket, bucket_len, (rank // greatest(1, {budget} // bucket_len))::BIGINT AS batch, (rank % greatest(1, {budget} // bucket_len))::BIGINT AS place FROM ranked"""


def padding(packed: DataFrame) -> DataFrame:
    """Per bucket: bucket, bucket_len, pieces, batches, tokens, padded (tokens with padding)."""
    by_batch = packed.groupBy("bucket", "bucket_len", "batch").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"))
    return by_batch.groupBy("bucket", "bucket_len").agg(
        F.sum("n").alias("pieces"), F.count("*").alias("batches"), F.sum("t").alias("tokens"), (F.sum("n") * F.first("bucket_len")).alias("padded")
    )


def bound_padding(histogram: dict[int, int], bounds: list[int]) -> int:
    """Padding of given bounds; infinite if a length exceeds them all."""
    total = 0
    for n, c in histogram.items():
        fit = [b for b in bounds if b >= n]
        if not fit:
            return math.inf
        total += c * (min(fit) - n)
    return total
