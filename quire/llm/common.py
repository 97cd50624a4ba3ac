"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Cells that a group's rows are dealt over when they get consecutive numbers.
CELLS = 1024
#: Copies of one row that are numbered together.
COPIES = 1 << 16
#: A key with more than one in HOT of all rows is joined by broadcast: fewer than HOT keys can have so many.
HOT = 2048
#: Most 64-bit words of a screen.
WORDS = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder: the session's ``spark.checkpoint.dir``. Where none is set, a temporary one is made if the driver is the only machine; a cluster must name one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quire-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the cluster's checkpoint folder, so that a lost executor costs a read and not a recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % modulus


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the CRC-32 of a text's UTF-8 bytes; null for null."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    turn = "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, _: xor(v >> 1, 3988292384 * (v & 1)))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {octets}), lambda c, b: {turn}), 4294967295::BIGINT)"


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null becomes empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def as_text(column: pa.Array) -> list[str]:
    return [s or "" for s in column.to_pylist()]


def numbered(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """Adds ``out``: a number from 0 without gaps in each group. It depends on the rows alone: they stand by their cell, a hash of ``order`` (columns that name
    a row: the others must follow from them), then by ``order``. Equal rows are interchangeable.

    A group, or one row's copies, may hold any share of all rows. Copies are counted before the shuffle; rows are numbered inside their cell, one of ``CELLS``
    of a group, by running sums of the counts and shifted by the size of the cells before. Only the cells' counts (``CELLS`` per group) are
    summed in one place. Numbers are then dealt to copies, ``COPIES`` at a time, spread anew if a row has more.
    """
    dealt = cut(df.groupBy(*df.columns).agg(F.count("*").alias("_n")).withColumn("_cell", cell(order)))
    counts = dealt.groupBy(*group, "_cell").agg(F.sum("_n").alias("_all"))
    before = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_cell").alias("_c"), F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_start"))
    above = Window.partitionBy(*group, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    on = F.col("_cell") == F.col("_c")
    for g in group:
        on &= F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    placed = dealt.withColumn("_i", F.coalesce(F.sum("_n").over(above), F.lit(0))).join(starts, on).withColumn("_from", F.col("_start") + F.col("_i"))
    placed = placed.select(*df.columns, "_n", "_from")
    if (dealt.agg(F.max("_n")).first()[0] or 0) > COPIES:
        part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / COPIES).cast("long")))
        chunks = placed.withColumn("_part", part).repartition("_from", "_part")
        placed = chunks.select(*df.columns, F.least(F.lit(COPIES), F.col("_n") - F.col("_part") * COPIES).alias("_n"), (F.col("_from") + F.col("_part") * COPIES).alias("_from"))
    one = F.when(F.col("_n") == 1, F.array("_from")).otherwise(F.sequence(F.col("_from"), F.col("_from") + F.col("_n") - 1))
    return placed.select(*df.columns, F.explode(one.cast("array<bigint>")).alias(out))


def cell(columns: list[str]) -> Column:
    """A number below CELLS from the MD5 of the columns as text, joined by blanks (null: nothing)."""
    text = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % CELLS).cast("int")


def numbered_sql(group: list[str], order: list[str]) -> str:
    """DuckDB SQL for the number that ``numbered`` gives."""
    text = " || ' ' || ".join(f"coalesce({c}::VARCHAR, '')" for c in order)
    by = ", ".join(f"{c} NULLS FIRST" for c in order)
    return f"row_number() OVER (PARTITION BY {', '.join(group)} ORDER BY ('0x' || substr(md5({text}), 1, 8))::BIGINT % {CELLS}, {by}) - 1"


def skew_join(rows: DataFrame, values: DataFrame, key: str, n: str, total: int, how: str = "inner", light: int = 0) -> DataFrame:
    """``rows`` joined with ``values`` (one row per key, with the number ``n`` of ``rows`` it meets) on ``key``, inner or left.

    Keys with more than one in HOT of all ``total`` rows, fewer than HOT of them, are sent to the rows; the others meet by a shuffle in which no key has more
    than that. So no task gathers a hot key. The hot keys (longs, fewer than HOT) are brought to the driver and name the rows of either side, so that no join
    only tells rows apart; if there are none, the join is a plain one. Else ``rows`` are read twice. Up to ``light`` rows in all, which one task can take whatever their keys are, are joined plainly.
    """
    if total <= light:
        return rows.join(values, key, how)
    large = F.col(n) * HOT > total
    keys = [r[0] for r in values.where(large & F.col(key).isNotNull()).select(key).collect()]
    if not keys:
        return rows.join(values, key, how)
    among = F.coalesce(F.col(key).isin(keys), F.lit(False))
    return rows.where(among).join(F.broadcast(values.where(among)), key).unionByName(rows.where(~among).join(values.where(~among), key, how))


def screened(rows: DataFrame, keys: DataFrame, column: str, out: str) -> DataFrame:
    """``rows`` with ``out``: false for rows whose ``column`` (a hash, long) isn't in ``keys`` (one column of such hashes), but for some that share a bit.

    The bits, sixteen for each key, are sent to all rows. There are at most 64 * WORDS, so far more keys than 4 * WORDS let more and more rows through:
    the caller's join decides, the screen only keeps most rows without a partner out of its shuffle.
    """
    words = 1 << max(4, min(WORDS.bit_length() - 1, math.ceil(math.log2(keys.count() / 4 + 1))))
    at = lambda c: F.col(c).bitwiseAND(F.lit(words - 1)).alias("_q_word")
    bit = lambda c: F.shiftrightunsigned(F.col(c), 58).cast("int")
    (key,) = keys.columns
    bits = keys.select(at(key), F.call_function("shiftleft", F.lit(1).cast("long"), bit(key)).alias("b")).groupBy("_q_word").agg(F.bit_or("b").alias("_q_bits"))
    found = rows.withColumn("_q_word", at(column)).join(F.broadcast(bits), "_q_word", "left")
    hit = F.call_function("shiftright", F.coalesce("_q_bits", F.lit(0).cast("long")), bit(column)).bitwiseAND(F.lit(1)) == 1
    return found.withColumn(out, hit).drop("_q_word", "_q_bits")
