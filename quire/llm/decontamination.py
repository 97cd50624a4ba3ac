"""Benchmark decontamination by spaced seeds and substitution-tolerant overlaps."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import as_text, cut

#: Which token positions a seed compares (1) and ignores (0).
MASKS = ("111111", "11011011", "1101100101", "1010011011", "11100010101", "100101001111")
_WORD = re.compile(r"[^\W_]+")
#: Text bytes of the test set that one search holds; a larger test set is searched in several blocks, each over all documents.
BLOCK_BYTES = 4 << 20
_RNG = np.random.default_rng(20_011)
_FACTORS = _RNG.integers(1, 1 << 63, size=(len(MASKS), 16), dtype=np.uint64) | np.uint64(1)


@dataclass(frozen=True)
class Rule:
    """What counts as an overlap: an aligned stretch of at least ``words`` words (of a shorter test item, all its words),
    at least ``identity`` of them equal, not below ``least`` words."""

    words: int = 13
    identity: float = 0.8
    least: int = 6

    def need(self, n: int) -> int:
        """Words that a stretch of an item of ``n`` words must have."""
        return max(self.least, min(self.words, n))


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return _WORD.findall(text.lower())


def seed_hashes(ids: np.ndarray, masks: Sequence[str] = MASKS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each mask: start positions and hashes of the windows whose compared positions all hold known words (id >= 0)."""
    out = []
    known = ids >= 0
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    for m, mask in enumerate(masks):
        n = len(ids) - len(mask) + 1
        if n <= 0:
            out.append((np.zeros(0, np.int64), np.zeros(0, np.uint64)))
            continue
        offsets = [i for i, c in enumerate(mask) if c == "1"]
        ok = known[offsets[0] : offsets[0] + n].copy()
        for o in offsets[1:]:
            ok &= known[o : o + n]
        at = np.flatnonzero(ok)
        h = np.full(len(at), (m + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        for k, o in enumerate(offsets):
            h += mixed[at + o] * _FACTORS[m, k]
        h ^= h >> np.uint64(29)
        out.append((at, h))
    return out


def accepted_stretches(equal: np.ndarray, need: int, identity: float) -> list[tuple[int, int, int]]:
    """(start, end, equal words) of the maximal runs of words that lie in a stretch of at least ``need`` words with at least ``identity`` of them equal.

    A word adds 1 - ``identity`` to a running balance if it is equal and takes ``identity`` from it else, in whole numbers. A stretch has enough equal words
    if the balance isn't lower at its end than at its start; the first such start of an end is found in the balance's running minimum.
    """
    if len(equal) < need:
        return []
    share = Fraction(identity).limit_denominator(10_000)
    balance = np.concatenate([[0], np.cumsum(np.where(equal, share.denominator - share.numerator, -share.numerator))])
    lowest = np.minimum.accumulate(balance)
    ends = np.arange(need, len(balance))
    ends = ends[balance[ends] >= lowest[ends - need]]
    if not len(ends):
        return []
    starts = np.searchsorted(-lowest, -balance[ends])
    covered = np.zeros(len(balance) + 1, dtype=np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, ends, -1)
    inside = np.concatenate([[0], np.cumsum(covered) > 0, [0]])
    edge = np.flatnonzero(np.diff(inside.astype(np.int64)))
    return [(int(a), int(b), int(equal[a:b].sum())) for a, b in zip(edge[::2], edge[1::2], strict=True)]


class Index:
    """The seeds of a block of test items, sorted by hash, with a bit filter before them."""

    FILTER_BITS = 24
    #: Hits of seeds that are spread out at once.
    HITS = 1 << 20

    def __init__(self, items: list[tuple[int, str]], rule: Rule):
        self.rule = rule
        vocab: dict[str, int] = {}
        self.vocab = vocab
        # Items with the same words are searched as one. An item of fewer words than the least stretch, null or empty, can't be found.
        named: dict[tuple[str, ...], list[int]] = {}
        for i, t in items:
            named.setdefault(tuple(words_of(t or "")), []).append(i)
        self.item_ids = list(named.values())
        self.items = [np.array([vocab.setdefault(w, len(vocab)) for w in words], dtype=np.int64) for words in named]
        hashes, item, place = [], [], []
        for k, ids in enumerate(self.items):
            for at, h in seed_hashes(ids):
                hashes.append(h)
                item.append(np.full(len(h), k, dtype=np.int32))
                place.append(at.astype(np.int32))
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash = h[order]
        self.item = np.concatenate(item)[order] if item else np.zeros(0, np.int32)
        self.place = np.concatenate(place)[order] if place else np.zeros(0, np.int32)
        self.seen = np.zeros(1 << self.FILTER_BITS, dtype=bool)
        self.seen[self._slot(self.hash)] = True

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.FILTER_BITS)).astype(np.int64)

    def _diagonals(self, ids: np.ndarray) -> np.ndarray:
        """The distinct (item, diagonal) that a seed hits, as item * 2**32 + diagonal + 2**31, sorted. Each hit is spread over the places of its seed, so many at a time."""
        met = [np.zeros(0, dtype=np.int64)]
        for at, h in seed_hashes(ids):
            keep = self.seen[self._slot(h)]
            at, h = at[keep], h[keep]
            lo = np.searchsorted(self.hash, h, "left")
            n = np.searchsorted(self.hash, h, "right") - lo
            total = np.cumsum(n)
            first = 0
            while first < len(n):
                to = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + self.HITS, side="right")))
                k = n[first:to]
                place = np.repeat(lo[first:to], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                diagonal = np.repeat(at[first:to], k) - self.place[place]
                met.append(np.unique((self.item[place].astype(np.int64) << 32) + diagonal + (1 << 31)))
                first = to
        return np.unique(np.concatenate(met))

    def search(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item number, first word in the text, first word in the item, words, equal words): the rule's stretches on every diagonal that a seed hits."""
        ids = np.array([self.vocab.get(w, -1) for w in words_of(text)], dtype=np.int64)
        if len(ids) < self.rule.least:
            return []
        found = []
        for code in self._diagonals(ids).tolist():
            k, diagonal = code >> 32, (code & 0xFFFFFFFF) - (1 << 31)
            item = self.items[k]
            a, b = max(0, -diagonal), min(len(item), len(ids) - diagonal)
            need = self.rule.need(len(item))
            for start, end, same in accepted_stretches(item[a:b] == ids[a + diagonal : b + diagonal], need, self.rule.identity):
                found.append((k, a + start + diagonal, a + start, end - start, same))
        return found


class Sent:
    """A block on its way to the executors; each worker process builds its index once."""

    def __init__(self, items: list[tuple[int, str]], rule: Rule):
        self.items, self.rule, self._index = items, rule, None

    def __getstate__(self) -> tuple:
        return self.items, self.rule

    def __setstate__(self, state: tuple) -> None:
        self.items, self.rule = state
        self._index = None

    def index(self) -> Index:
        if self._index is None:
            self._index = Index(self.items, self.rule)
        return self._index


def _blocks(tests: DataFrame) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for row in tests.toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1] or "")
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


_SCHEMA = "doc_id long, item_id long, doc_word long, item_word long, n_words long, n_equal long"


def _on_each_block(tests: DataFrame, rule: Rule, run, last) -> DataFrame | None:
    """``run`` (block on the executors to DataFrame) over every block. One block's rows stay lazy; of several, each is computed into the
    checkpoint folder (as ``last`` shapes it) and its broadcast is freed before the next is read, so one block at a time is in memory."""
    spark = tests.sparkSession
    blocks = _blocks(tests)
    block, out = next(blocks, None), None
    while block is not None:
        after = next(blocks, None)
        sent = spark.sparkContext.broadcast(Sent(block, rule))
        if out is None and after is None:
            return run(sent)
        part = cut(last(run(sent)))
        sent.unpersist(blocking=True)
        out = part if out is None else out.union(part)
        block = after
    return out


def overlaps(
    docs: DataFrame, tests: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text", test_id_col: str = "item_id", test_text_col: str = "text"
) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, n_words, n_equal): verified overlaps of documents with test items.

    Every diagonal (place of an item's words against a text's) that a seed hits gives the maximal runs of words that lie in a stretch the rule accepts.
    The test side is sent out in blocks of a fixed size (``BLOCK_BYTES``), one at a time; documents are
    read once for each block and never shuffled. Null and empty texts on either side have no overlap; null ids are carried as they are; repeated rows
    give repeated overlaps; an empty table on either side gives none. Other columns are ignored.
    """
    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def part(sent) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = sent.value.index()
            for batch in batches:
                rows = [[] for _ in range(6)]
                for i, text in zip(batch.column(0).to_pylist(), as_text(batch.column(1)), strict=True):
                    for k, *rest in index.search(text):
                        for name in index.item_ids[k]:
                            for column, value in zip(rows, (i, name, *rest), strict=True):
                                column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], ["doc_id", "item_id", "doc_word", "item_word", "n_words", "n_equal"])

        return wanted.mapInArrow(run, _SCHEMA)

    out = _on_each_block(tests.select(F.col(test_id_col).cast("long"), F.col(test_text_col)), rule, part, lambda df: df)
    return out if out is not None else docs.sparkSession.createDataFrame([], _SCHEMA)


def decontaminate(docs: DataFrame, tests: DataFrame, rule: Rule = Rule(), text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text overlaps a test item.

    A row is judged by its text alone, whatever its id, also a null one; equal texts stay or go together. Null and empty texts stay. An empty table on either
    side removes nothing. All columns are kept, whatever they are named. With one block of test items nothing is shuffled; with more, the hashes and sizes of the
    overlapping texts are gathered and their rows left out by a join.
    """
    at = docs.columns.index(text_col)
    blocks = _blocks(tests.select(F.col("item_id").cast("long"), F.col("text")))
    first = next(blocks, None)
    if first is None:
        return docs
    if next(blocks, None) is None:
        sent = docs.sparkSession.sparkContext.broadcast(Sent(first, rule))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = sent.value.index()
            for batch in batches:
                yield batch.filter(pa.array([not index.search(t) for t in as_text(batch.column(at))], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)
    name = [F.xxhash64(text_col), F.octet_length(text_col)]
    texts = docs.where(F.col(text_col).isNotNull()).select(name[0].alias("_hash"), name[1].alias("_size"), F.col(text_col).alias("text"))

    def part(sent) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = sent.value.index()
            for batch in batches:
                yield batch.filter(pa.array([bool(index.search(t)) for t in as_text(batch.column(2))], pa.bool_())).select([0, 1])

        return texts.mapInArrow(run, "_hash long, _size int")

    found = _on_each_block(tests.select(F.col("item_id").cast("long"), F.col("text")), rule, part, lambda df: df.distinct()).distinct()
    return docs.join(found, (name[0] == found["_hash"]) & (name[1] == found["_size"]), "left_anti")


def overlaps_sql(rule: Rule = Rule()) -> str:
    """DuckDB SQL for ``overlaps`` over the views documents and benchmark: seeds as joined words, then the rule over all stretches of their diagonals."""
    share = Fraction(rule.identity).limit_denominator(10_000)
    seeds = []
    for mask in MASKS:
        key = " || ' ' || ".join(f"w[i + {o}]" for o, c in enumerate(mask) if c == "1")
        side = lambda t, key=key, n=len(mask): f"(SELECT r, i, {key} AS h FROM (SELECT r, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM {t}))"
        seeds.append(f"SELECT d.r, t.r AS q, d.i - t.i AS diagonal FROM {side('d')} d JOIN {side('t')} t USING (h)")
    words = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {words} AS w FROM documents),
t AS (SELECT item_id, row_number() OVER () AS r, {words} AS w FROM benchmark),
hit AS (SELECT DISTINCT r, q, diagonal FROM ({" UNION ".join(seeds)})),
pair AS (SELECT row_number() OVER () AS k, h.*, greatest({rule.least}, least({rule.words}, len(t.w))) AS need, greatest(0, -diagonal) AS a, least(len(t.w), len(d.w) - diagonal) AS b, d.w AS dw, t.w AS tw
  FROM hit h JOIN d ON d.r = h.r JOIN t ON t.r = h.q),
place AS (SELECT k, need, p, (tw[p + 1] = dw[p + diagonal + 1])::INTEGER AS e FROM (SELECT *, unnest(range(a, b)) AS p FROM pair)),
balance AS (SELECT k, need, p + 1 AS p, sum(CASE WHEN e = 1 THEN {share.denominator - share.numerator} ELSE {-share.numerator} END) OVER (PARTITION BY k ORDER BY p) AS v FROM place
  UNION ALL SELECT k, need, a, 0 FROM pair),
stretch AS (SELECT k, x.p AS s, max(y.p) AS e FROM balance x JOIN balance y USING (k) WHERE y.p >= x.p + x.need AND y.v >= x.v GROUP BY k, x.p),
inside AS (SELECT DISTINCT k, unnest(range(s, e)) AS p FROM stretch),
run AS (SELECT k, p, p - row_number() OVER (PARTITION BY k ORDER BY p) AS g FROM inside),
found AS (SELECT k, min(run.p) AS s, count(*) AS n, sum(e) AS same FROM run JOIN place USING (k, p) GROUP BY k, g)
SELECT doc_id, item_id, s + diagonal AS doc_word, s AS item_word, n AS n_words, same::BIGINT AS n_equal FROM found JOIN pair USING (k) JOIN d ON d.r = pair.r JOIN t ON t.r = pair.q"""
