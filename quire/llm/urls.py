"""URL filters: host and path rules first, then a ratio of character language models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import as_bytes, crc32_sql, cut, fold

#: Fixed values: (verdict, host and path prefix).
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Longest context, in bytes. A context of k bytes is the number 2**32 * k + its bytes (the last byte first), and a cell is 256 times that plus the byte that follows.
ORDER = 4
#: Grams (a longest context and the byte that follows) whose ratios are sent to all tasks: the most frequent ones. The others meet their URLs by a join.
HOT_GRAMS = 1 << 16
#: Grams that are judged at once, in whole groups of the context's last two bytes.
GRAMS = 1 << 18
#: A context counts from this many occurrences on; with fewer the shorter one speaks alone.
SEEN = 2
#: Share of accepted calibration URLs that the model may block.
FALSE_BLOCKS = 0.01
#: Rows with crc32(page_id) modulo FOLDS 0 calibrate, the others train.
FOLDS = 5
#: Bins of the calibration histogram, over log-likelihood differences per byte from -LIMIT to LIMIT.
BINS, LIMIT = 4000, 4.0
_START = 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ? or # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host_: Column, path_: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (its host or a subdomain, and a path that starts with its path) and its verdict; null if none fits."""
    which, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: len(x[1])):
        h, slash, p = r.partition("/")
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(slash + p)
        which, verdict = F.when(fits, F.lit(r)).otherwise(which), F.when(fits, F.lit(v)).otherwise(verdict)
    return which, verdict


def _grams(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of every URL: the URL's number, and its gram: the bytes before it, the last one first, and the byte."""
    padded = np.frombuffer(b"".join(bytes([_START] * ORDER) + u for u in urls), dtype=np.uint8).astype(np.int64)
    sizes = np.array([len(u) for u in urls], dtype=np.int64)
    at = np.repeat(np.cumsum(sizes + ORDER) - sizes, sizes) + (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))
    code = np.zeros(len(at), dtype=np.int64)
    for k in range(1, ORDER + 1):
        code = code << 8 | padded[at - k]
    return np.repeat(np.arange(len(urls)), sizes), code << 8 | padded[at]


def _contexts(gram: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The byte and the contexts of each length, the shortest first."""
    return gram & 255, [(k << 32) + (gram >> 8 * (ORDER + 1 - k)) for k in range(ORDER + 1)]


def _summed(cells: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells that aren't zero, in order, with the sums of their counts."""
    cells, counts = cells[counts > 0], counts[counts > 0]
    order = np.argsort(cells, kind="stable")
    cells, counts = cells[order], counts[order]
    start = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))[: len(cells)]
    return cells[start], np.add.reduceat(counts, start) if len(start) else counts


@dataclass
class Model:
    """Counts of a class: its cells that aren't zero, sorted."""

    cells: np.ndarray
    counts: np.ndarray

    def tables(self) -> tuple[np.ndarray, ...]:
        """Cells and their counts; contexts, the occurrences of each and the kinds of bytes that follow it."""
        contexts, start = np.unique(self.cells >> 8, return_index=True)
        total = np.add.reduceat(self.counts, start) if len(start) else self.counts
        return self.cells, self.counts, contexts, total, np.diff(np.append(start, len(self.cells)))


def _found(keys: np.ndarray, values: tuple[np.ndarray, ...], wanted: np.ndarray) -> list[np.ndarray]:
    """The values of each wanted key, 0 for keys that aren't there. ``keys`` is sorted."""
    if not len(keys):
        return [np.zeros(len(wanted)) for _ in values]
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    there = keys[at] == wanted
    return [np.where(there, v[at], 0).astype(np.float64) for v in values]


def log_likelihood(tables: tuple[np.ndarray, ...], symbol: np.ndarray, slots: list[np.ndarray]) -> np.ndarray:
    """Natural log of each byte's probability: Witten-Bell mixing of ever longer contexts, from 1/256 up.
    A context passes on the share kinds / (count + kinds) to the next shorter one; one seen less than SEEN times passes all."""
    cells, counts, contexts, total, kinds = tables
    p = np.full(len(symbol), 1 / 256)
    for slot in slots:
        n, t = _found(contexts, (total, kinds), slot)
        (c,) = _found(cells, (counts,), slot << 8 | symbol)
        p = np.where(n >= SEEN, (c + t * p) / np.maximum(n + t, 1), p)
    return np.log(p)


def count(pages: DataFrame) -> DataFrame:
    """(gram, n, accepted, rejected): every gram of (url, class) with its occurrences in all URLs, and in those of class allow and block. Tasks count before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, gram = _grams(as_bytes(batch.column(0)))
            classes = np.array([{"allow": 1, "block": 2}.get(c, 0) for c in batch.column(1).to_pylist()], dtype=np.int64)
            known, place, n = np.unique(gram, return_inverse=True, return_counts=True)
            by_class = [np.bincount(place[classes[owner] == c], minlength=len(known)) for c in (1, 2)] if len(gram) else [n, n]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (known, n, *by_class)], ["gram", "n", "accepted", "rejected"])

    counted = pages.mapInArrow(run, "gram long, n long, accepted long, rejected long")
    return counted.groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("n", "accepted", "rejected")])


def short_contexts(counts: DataFrame) -> dict[str, Model]:
    """For each class the cells of contexts of no byte and of one: at most 256 + 65,536 of them, which is what reaches the driver."""
    cell = F.shiftright("gram", 8 * ORDER) * 256 + F.col("gram").bitwiseAND(F.lit(255))
    rows = counts.groupBy(cell.alias("cell")).agg(*[F.sum(c).alias(c) for c in ("accepted", "rejected")]).toArrow()
    cell = np.asarray(rows.column("cell")).astype(np.int64)
    both = np.concatenate([cell & 255, (1 << 40) + cell])
    return {c: Model(*_summed(both, np.tile(np.asarray(rows.column(c)), 2))) for c in ("accepted", "rejected")}


def ratios(counts: DataFrame, short: dict[str, Model]) -> DataFrame:
    """(gram, n, ratio): the accepted less the rejected log-likelihood of each gram's byte after its context.

    Grams are dealt by the last two bytes of their contexts, so that the counts of all longer contexts come from grams that stand together; those of the shorter ones are sent.
    """
    sent = counts.sparkSession.sparkContext.broadcast(short)

    def judged(table: pa.Table) -> pa.RecordBatch:
        gram, n, *by_class = (np.asarray(table.column(c)) for c in ("gram", "n", "accepted", "rejected"))
        symbol, contexts = _contexts(gram)
        likely = []
        for name, c in zip(("accepted", "rejected"), by_class, strict=True):
            less = sent.value[name]
            own = _summed(np.concatenate([x << 8 | symbol for x in contexts[2:]]), np.tile(c, ORDER - 1))
            likely.append(log_likelihood(Model(np.concatenate([less.cells, own[0]]), np.concatenate([less.counts, own[1]])).tables(), symbol, contexts))
        return pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n), pa.array(likely[0] - likely[1])], ["gram", "n", "ratio"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= GRAMS:
                table = pa.Table.from_batches(held)
                group = np.asarray(table.column("gram")) >> 8 * (ORDER - 1)
                whole = int(np.searchsorted(group, group[-1]))
                if whole:
                    yield judged(table.slice(0, whole))
                    held, rows = table.slice(whole).to_batches(), rows - whole
        if rows:
            yield judged(pa.Table.from_batches(held))

    dealt = counts.repartition(F.xxhash64(F.shiftright("gram", 8 * (ORDER - 1)))).sortWithinPartitions("gram")
    return dealt.mapInArrow(run, "gram long, n long, ratio double")


def _with_ratio(base: DataFrame, scored: DataFrame) -> DataFrame:
    """``base`` with the ratio of column url: the sum over its grams per byte, 0 for an empty URL, to six places.

    The ratios of the HOT_GRAMS most frequent grams are sent to all tasks and added there. A gram that isn't among them has at most one in HOT_GRAMS of all
    bytes, and so has a URL that holds it: what is left meets by joins on grams and on URLs in which no key is hot.
    """
    hot = scored.orderBy(F.desc("n"), "gram").limit(HOT_GRAMS).toArrow().sort_by("gram")
    sent = base.sparkSession.sparkContext.broadcast(tuple(np.asarray(hot.column(c)) for c in ("gram", "ratio")))
    at = base.columns.index("url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ratio = sent.value
        for batch in batches:
            urls = as_bytes(batch.column(at))
            owner, gram = _grams(urls)
            place = np.minimum(np.searchsorted(known, gram), max(len(known) - 1, 0))
            there = known[place] == gram if len(known) else np.zeros(len(gram), dtype=bool)
            part = np.bincount(owner[there], weights=ratio[place[there]], minlength=len(urls)) if len(known) else np.zeros(len(urls))
            rest = np.split(gram[~there], np.cumsum(np.bincount(owner[~there], minlength=len(urls)))[:-1]) if urls else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.float64()), pa.array(rest, pa.list_(pa.int64()))], [*batch.schema.names, "part", "rest"])

    parts = cut(base.mapInArrow(run, f"{base.schema.simpleString()[7:-1]},part:double,rest:array<bigint>"))
    some = parts.where(F.size("rest") > 0)
    sums = some.dropDuplicates(["url"]).select("url", F.explode("rest").alias("gram")).join(scored.select("gram", "ratio"), "gram").groupBy("url").agg(F.sum("ratio").alias("more"))
    zero = F.lit(0.0).alias("more")
    every = parts.where(F.size("rest") == 0).select(*base.columns, "part", zero).unionByName(some.join(sums, "url").select(*base.columns, "part", "more"))
    mean = (F.col("part") + F.col("more")) / F.greatest(F.octet_length("url"), F.lit(1))
    return every.select(*base.columns, F.round(mean, 6).alias("ratio"))


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, ratio.

    URLs that a rule decides keep its verdict; they are also the accepted and rejected examples: models count those
    outside the calibration fold, and the threshold is the ratio below which at most FALSE_BLOCKS of the
    fold's accepted URLs fall, never above 0. Other URLs are blocked below it and allowed else. If either class has no example, or no accepted URL calibrates, they are allowed.
    A null or empty URL, or one without ://, has an empty host and path and no rule; empty URLs have ratio 0. Null ids train but don't
    calibrate; repeated rows count as often as they stand. An empty table gives an empty result. Other columns are ignored.
    The models grow with the distinct contexts of the corpus; they are a table, of which bounded parts are sent.
    """
    url = F.col(url_col)
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), host(url).alias("host"), path(url).alias("path"), F.coalesce(url, F.lit("")).alias("url"))
    which, said = rule(F.col("host"), F.col("path"), rules)
    base = base.withColumn("rule", which).withColumn("said", said).withColumn("calibrates", F.coalesce(fold(F.col("page_id"), FOLDS) == 0, F.lit(False)))
    counts = cut(count(base.select("url", F.when(~F.col("calibrates"), F.col("said")))))
    short = short_contexts(counts)
    judged = cut(_with_ratio(base, cut(ratios(counts, short))))
    limit = None
    if all(len(m.cells) for m in short.values()):
        bin_ = F.floor((F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.col("ratio"))) + LIMIT) * (BINS / (2 * LIMIT)))
        bins = judged.where(F.col("calibrates") & (F.col("said") == "allow")).groupBy(bin_.alias("b")).agg(F.count("*").alias("n"))
        limit = threshold({r["b"]: r["n"] for r in bins.collect()})
    blocks = F.col("ratio") < F.lit(limit) if limit is not None else F.lit(False)
    verdict = F.coalesce("said", F.when(blocks, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "ratio")


def judge_sql(rules=RULES) -> str:
    """DuckDB SQL for ``judge`` over the view pages. Bytes are pairs of hexadecimal digits."""
    said, which = "", ""
    for v, r in sorted(rules, key=lambda x: -len(x[1])):
        h, slash, p = r.partition("/")
        fits = f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{slash + p}') THEN"
        said, which = f"{said} {fits} '{v}'", f"{which} {fits} '{r}'"
    orders = range(ORDER + 1)
    ctx = ", ".join(f"substr(x, {2 * ORDER + 1} + 2 * (i - 1) - {2 * k}, {2 * k}) AS c{k}" for k in orders)
    parts = []
    for c in ("allow", "block"):
        p = f"{1 / 256}::DOUBLE"
        for k in orders:
            p = f"CASE WHEN coalesce({c}_x{k}.n, 0) >= {SEEN} THEN (coalesce({c}_c{k}.n, 0) + {c}_x{k}.t * ({p})) / ({c}_x{k}.n + {c}_x{k}.t) ELSE {p} END"
        parts.append(f"ln({p})")
    joins = " ".join(
        f"LEFT JOIN ctx {c}_x{k} ON {c}_x{k}.said = '{c}' AND {c}_x{k}.k = {k} AND {c}_x{k}.c = g.c{k} LEFT JOIN cell {c}_c{k} ON {c}_c{k}.said = '{c}' AND {c}_c{k}.k = {k} AND {c}_c{k}.c = g.c{k} AND {c}_c{k}.s = g.s"
        for c in ("allow", "block")
        for k in orders
    )
    cells = " UNION ALL ".join(f"SELECT said, {k} AS k, c{k} AS c, s, count(*) AS n FROM pos WHERE said IS NOT NULL AND NOT calibrates GROUP BY ALL" for k in orders)
    return f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, row_number() OVER () AS r, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
b AS (SELECT *, CASE {said} END AS said, CASE {which} END AS rule, coalesce({crc32_sql("page_id::VARCHAR")} % {FOLDS} = 0, false) AS calibrates, '{"02" * ORDER}' || hex(encode(url)) AS x FROM u),
each AS (SELECT r, said, calibrates, x, unnest(range(1, octet_length(encode(url)) + 1)) AS i FROM b),
pos AS (SELECT r, said, calibrates, substr(x, {2 * ORDER + 1} + 2 * (i - 1), 2) AS s, {ctx} FROM each),
cell AS ({cells}),
ctx AS (SELECT said, k, c, sum(n) AS n, count(*) AS t FROM cell GROUP BY ALL),
gram AS (SELECT DISTINCT s, {", ".join(f"c{k}" for k in orders)} FROM pos),
gr AS (SELECT g.s, g.c{ORDER}, {parts[0]} - {parts[1]} AS d FROM gram g {joins}),
ratio AS (SELECT r, sum(d) AS d FROM pos JOIN gr USING (s, c{ORDER}) GROUP BY r),
j AS (SELECT b.*, round(coalesce(d, 0) / greatest(1, octet_length(encode(url))), 6) AS ratio FROM b LEFT JOIN ratio USING (r)),
bins AS (SELECT floor((greatest({-LIMIT}, least({LIMIT}, ratio)) + {LIMIT}) * {BINS / (2 * LIMIT)}) AS bin, count(*) AS n FROM j WHERE calibrates AND said = 'allow' GROUP BY ALL),
below AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS n, sum(n) OVER () AS every FROM bins),
lim AS (SELECT CASE WHEN (SELECT count(DISTINCT said) FROM cell) = 2 THEN least(0.0, min(bin) FILTER (n > {FALSE_BLOCKS} * every) * {2 * LIMIT / BINS} - {LIMIT}) END AS edge FROM below)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN ratio < coalesce(lim.edge, -1e9) THEN 'block' ELSE 'allow' END) AS verdict, ratio FROM j, lim"""


def threshold(histogram: dict[int, int]) -> float | None:
    """The lower edge of the first bin up to which more than FALSE_BLOCKS of the rows would be blocked, 0 at most; None without rows."""
    total, below = sum(histogram.values()), 0
    if not total:
        return None
    for b in sorted(histogram):
        below += histogram[b]
        if below > FALSE_BLOCKS * total:
            return min(0.0, b * (2 * LIMIT / BINS) - LIMIT)
    return 0.0
