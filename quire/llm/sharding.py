"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import crc32_sql, numbered, numbered_sql


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0 to len(weights) - 1) of a key: each shard draws -weight / ln(u) with u from XXH64(key, shard), the largest draw wins.

    A shard's share of the keys is its weight's share of the weights. A shard that is added takes keys only into itself,
    one that is removed (weight 0) gives up only its own, since no other draw changes. Ties go to the higher number. A null key is hashed as the seed alone.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must be 0 or more, and one above 0")

    def draw(shard: int, weight: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((F.lit(float(weight)) / -F.log(u)).alias("draw"), F.lit(shard).alias("shard"))

    return F.array_max(F.array(*[draw(i, w) for i, w in enumerate(weights) if w > 0]))["shard"]


def assign(docs: DataFrame, weights: Sequence[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes plus 8; ``slot`` numbers a shard's rows from 0 without gaps, in an order that
    depends on id and text only; ``grown_shard`` is the shard if one more of the mean weight is added.
    A null or empty text has size 8 and crc32 0. Rows with a null id are one key and so share a shard. Repeated rows get slots
    of their own. An empty table gives an empty result. Other columns are ignored. Only these few numbers are shuffled, never the text.
    """
    grown = [*weights, sum(weights) / len(weights)]
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(raw) + F.lit(8)).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(id_col), weights).cast("int").alias("shard"),
        rendezvous(F.col(id_col), grown).cast("int").alias("grown_shard"),
    )
    placed = numbered(rows, ["shard"], ["doc_id", "text_crc32", "size"], "slot")
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


#: The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def assign_sql(shards: int) -> str:
    """DuckDB SQL for ``assign`` with shards of equal weight over the view documents; the hash is XXH64 of the id (eight bytes), then of the shard (four)."""
    mod = "18446744073709551616::UHUGEINT"
    times = lambda x, p: f"(({x})::UHUGEINT * {p}::UHUGEINT % {mod})"
    plus = lambda x, p: f"((({x})::UHUGEINT + {p}::UHUGEINT) % {mod})"
    turned = lambda x, n: f"(({x})::UHUGEINT * {1 << n}::UHUGEINT % {mod} + ({x})::UHUGEINT // {1 << 64 - n}::UHUGEINT)"
    mixed = lambda x, y: f"xor(({x})::UBIGINT, ({y})::UBIGINT)"
    down = lambda x, n: f"(({x})::UHUGEINT // {1 << n}::UHUGEINT)"
    steps: list[str] = []

    def step(name: str, source: str, value: str, keep: str) -> None:
        steps.append(f"{name} AS (SELECT {keep}, {value} AS v FROM {source})")

    def finish(name: str, source: str, keep: str) -> None:
        step(f"{name}_a", source, times(mixed("v", down("v", 33)), _P2), keep)
        step(f"{name}_b", f"{name}_a", times(mixed("v", down("v", 29)), _P3), keep)
        step(f"{name}_c", f"{name}_b", mixed("v", down("v", 32)), keep)

    step("key1", "(SELECT DISTINCT doc_id FROM documents)", times("CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616::HUGEINT ELSE doc_id::HUGEINT END", _P2), "doc_id")
    step("key2", "key1", mixed((42 + _P5 + 8) % (1 << 64), times(turned("v", 31), _P1)), "doc_id")
    step("key3", "key2", plus(times(turned("v", 27), _P1), _P4), "doc_id")
    finish("key", "key3", "doc_id")
    each = f"(SELECT doc_id, coalesce(v, 42) AS h, unnest(range({shards + 1})) AS shard FROM key_c)"
    step("draw1", each, mixed(plus("h", (_P5 + 4) % (1 << 64)), times("shard", _P1)), "doc_id, shard")
    step("draw2", "draw1", plus(times(turned("v", 23), _P2), _P3), "doc_id, shard")
    finish("draw", "draw2", "doc_id, shard")
    best = lambda upto: f"(max([1.0 / -ln((({down('v', 11)})::DOUBLE + 0.5) / {float(1 << 53)!r}), shard]) FILTER (shard < {upto}))[2]::INTEGER"
    return f"""
WITH {', '.join(steps)},
choice AS (SELECT doc_id, {best(shards)} AS shard, {best(shards + 1)} AS grown_shard FROM draw_c GROUP BY doc_id),
rows AS (SELECT d.doc_id, (octet_length(encode(coalesce(text, ''))) + 8)::BIGINT AS size, coalesce({crc32_sql("text")}, 0)::BIGINT AS text_crc32, 'key' AS law, c.shard, c.grown_shard
  FROM documents d JOIN choice c ON c.doc_id IS NOT DISTINCT FROM d.doc_id)
SELECT *, ({numbered_sql(["shard"], ["doc_id", "text_crc32", "size"])})::BIGINT AS slot FROM rows"""


def write_shards(docs: DataFrame, path: str, weights: Sequence[float], id_col: str = "doc_id") -> None:
    """Writes all columns of ``docs`` (but one named shard) as Parquet under ``path``/shard=N. Tasks are even: rows aren't gathered by shard.
    Null texts, null ids (one key) and repeated rows are written like others; an empty table writes no shard."""
    docs.withColumn("shard", rendezvous(F.col(id_col), weights)).write.mode("overwrite").partitionBy("shard").parquet(path)
