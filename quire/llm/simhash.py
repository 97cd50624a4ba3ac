"""SimHash fingerprints, their exact Hamming links by bit-sliced comparison, and near-duplicate removal."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.bitslice import close_pairs, unite
from quire.llm.common import as_bytes, cut, screened, skew_join
from quire.llm.components import components

SEED = 42
#: Most weight of a cell that one comparison takes; a heavier cell is dealt over blocks. A row weighs its shingles and ROW_WEIGHT, a mere fingerprint FP_WEIGHT.
CELL_WEIGHT, ROW_WEIGHT, FP_WEIGHT = 1 << 20, 64, 128
#: Weight gathered before complete cells are compared.
GATHER = 1 << 21


def shingles(text: bytes, words: int) -> list[bytes]:
    """Space-joined runs of ``words`` words, repeats included; one run if there are fewer words, none if there are none.

    A-Z are lower-cased; words are split at space and 0x09 to 0x0D.
    """
    token = text.lower().split()
    if len(token) <= words:
        return [b" ".join(token)] if token else []
    return [b" ".join(token[i : i + words]) for i in range(len(token) - words + 1)]


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    runs = shingles(text, words)
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), dtype=np.uint64, count=len(runs))


def fingerprint(hashes: np.ndarray) -> int:
    """Unsigned 64 bits, each set if it is set in over half of the hashes; 0 for none."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[i : i + (1 << 16)], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of every row's whole text as a signed long; null texts count as empty (0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(shingle_hashes(t, words)) for t in as_bytes(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def key_plan(n: int, radius: int) -> list[tuple[int, ...]]:
    """Masks such that two values within ``radius`` bits agree under at least one of them.

    64 bits are cut into ``radius`` + k blocks and every choice of k blocks is a mask. k grows with the number of values,
    so that cells stay small: more masks with longer keys. Every plan is exact.
    """
    keep = 1 if n < 1 << 24 else 2 if n < 1 << 33 else 3
    blocks = radius + keep
    bounds = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [sum(1 << b for b in range(bounds[i], bounds[i + 1])) for i in range(blocks)]
    return [sum(c) for c in combinations(parts, keep)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _dealt(keyed: DataFrame, meet: bool = True) -> DataFrame:
    """Rows (cell, node, weight, label, ...) with the cell they are compared in. A cell whose rows all have one label has nothing to compare and goes.

    A cell heavier than ``CELL_WEIGHT`` becomes blocks of half that weight, and each pair of blocks a cell; if not ``meet``, each block alone. A label that fills more than a
    block has blocks of its own, which don't meet each other: a family of copies that is linked already isn't compared again.
    """
    sizes = keyed.groupBy("cell").agg(F.sum("weight").alias("_w"), F.count("*").alias("_n"), F.min("label").alias("_lo"), F.max("label").alias("_hi"))
    live = sizes.where("_lo <> _hi").select("cell", "_w", "_n")
    rows = skew_join(keyed, live, "cell", "_n", keyed.count()).drop("_n")
    small = rows.where(F.col("_w") <= CELL_WEIGHT).select(*keyed.columns)
    if live.where(F.col("_w") > CELL_WEIGHT).limit(1).count() == 0:
        return small
    large = rows.where(F.col("_w") > CELL_WEIGHT)
    blocks = lambda w: F.ceil(F.col(w) / F.lit(CELL_WEIGHT / 2)).cast("long")
    full = large.groupBy("cell", "label").agg(F.sum("weight").alias("_own")).where(F.col("_own") > CELL_WEIGHT / 2)
    own = large.join(full, ["cell", "label"], "left")
    pure = F.col("_own").isNotNull()
    # The rows of a label that fills blocks are spread over these; the others by their label, so that rows which needn't meet stand together, or by their node.
    number = F.when(pure, F.pmod(F.xxhash64("node", "cell"), blocks("_own"))).otherwise(F.pmod(F.xxhash64("label", "cell"), blocks("_w")))
    own = own.withColumn("_pure", F.when(pure, F.col("label"))).withColumn("_block", F.xxhash64(number, F.col("_pure")))
    if not meet:
        own = own.withColumn("cell", F.xxhash64("cell", "_block"))
        return small.unionByName(own.select(*keyed.columns))
    there = own.select("cell", "_block", "_pure").distinct()
    one, two = (there.select("cell", F.col("_block").alias(f"_b{k}"), F.col("_pure").alias(f"_p{k}")) for k in (1, 2))
    meets = one.join(two, "cell").where((F.col("_b1") == F.col("_b2")) & F.col("_p1").isNull() | (F.col("_b1") != F.col("_b2")) & ~F.coalesce(F.col("_p1") == F.col("_p2"), F.lit(False)))
    meets = meets.select("cell", F.col("_b1").alias("_block"), F.xxhash64("cell", F.least("_b1", "_b2"), F.greatest("_b1", "_b2")).alias("_to"))
    met = own.join(meets, ["cell", "_block"]).withColumn("cell", F.col("_to"))
    return small.unionByName(met.select(*keyed.columns))


def _by_cell(batches: Iterator[pa.RecordBatch], limit: int = GATHER) -> Iterator[pa.Table]:
    """Whole cells of rows sorted by cell, many at a time: some ``limit`` of weight (column 1)."""
    held: list[pa.RecordBatch] = []
    weight = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            weight += pc.sum(batch.column(1)).as_py()
        if weight >= limit:
            table = pa.Table.from_batches(held)
            cell = np.asarray(table.column(0))
            whole = int(np.searchsorted(cell, cell[-1], side="left"))
            if whole:
                yield table.slice(0, whole)
                held = table.slice(whole).combine_chunks().to_batches()
                weight = sum(pc.sum(b.column(1)).as_py() for b in held)
    if held:
        yield pa.Table.from_batches(held)


def _longs(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [np.asarray(table.column(n)) for n in names]


def _in_cells(dealt: DataFrame, f, schema: str) -> DataFrame:
    """``f`` over batches (cell, weight, ...) in which cells are whole.

    Rows are dealt by a hash of the cell: a repartition by the cell itself is left out after a join on it, and adaptive execution may then read the join's sides
    as they lie, with cells in pieces.
    """
    rest = [c for c in dealt.columns if c not in ("cell", "weight")]
    return dealt.select("cell", "weight", *rest).repartition(F.xxhash64("cell")).sortWithinPartitions("cell", "node").mapInArrow(f, schema)


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(u, v): edges between distinct fingerprints whose components are those of all pairs within ``radius`` bits.

    ``fps`` has one row per distinct fingerprint in column fp. No link is lost: a cell's close pairs are all found and
    its classes are emitted as stars, at most one edge per fingerprint and cell.
    """
    masks = key_plan(fps.count(), radius)
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)])
    keyed = fps.select(F.explode(keys).alias("cell"), F.lit(FP_WEIGHT).cast("long").alias("weight"), F.col("fp").alias("node"), F.col("fp").alias("label"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_cell(batches):
            cell, node, fp = _longs(table, "cell", "node", "fp")
            label = np.arange(len(fp))
            for a, b in close_pairs(cell, fp.view(np.uint64), radius):
                unite(label, a, b)
            moved = np.flatnonzero(label != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label[moved]])], ["u", "v"])

    return _in_cells(_dealt(keyed), run, "u long, v long")


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 lowercase hex digits), component_id (smallest doc_id reachable over links of at most ``radius`` bits).

    Nulls: a null or wordless text has fingerprint 0, which links like any other; a null doc_id keeps its row but can't
    be a component's id (null if the component has no other). Repeated rows are returned as often as they stand. An empty
    table gives an empty result. Other columns are ignored.
    Equal fingerprints are collapsed before the comparison (combined before the shuffle), so any number of copies costs one. Components are
    brought back to the rows by ``skew_join``, so that a fingerprint of very many rows doesn't gather in one task.
    """
    marked = cut(fingerprints(docs, words, id_col, text_col))
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = cut(components(links(nodes.select("fp"), radius)))
    rooted = roots.withColumnRenamed("node", "fp").join(nodes, "fp")
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes"))
    moved = skew_join(rooted.select("fp", "root"), best, "root", "nodes", roots.count()).select("fp", "component_id")
    named = nodes.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "n")
    return skew_join(marked, named, "fp", "n", marked.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near duplicates by similarity of shingle sets -----------------------------------------------------------------

#: Min-hash bands that name the cells: BANDS keys of ROWS values each. A pair of similarity 0.8 shares a key with probability 0.998.
BANDS, ROWS = 12, 4


def search_radius(similarity: float) -> int:
    """Bits within which the fingerprints of sets of that Jaccard similarity lie but for three standard deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return min(31, math.ceil(64 * p + 3 * math.sqrt(64 * p * (1 - p))))


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(SEED)
    return r.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def _band_keys(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[int]:
    least = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), 4096):
        mixed = hashes[None, i : i + 4096] * a[:, None] + b[:, None]
        mixed ^= mixed >> np.uint64(29)
        least = np.minimum(least, mixed.min(axis=1))
    return [_signed(xxhash.xxh64_intdigest(bytes([k]) + least[ROWS * k : ROWS * k + ROWS].tobytes(), SEED)) for k in range(BANDS)]


def _signatures(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, node, fp, size, keys) of every row: the XXH64 of its text, and the fingerprint, size and band keys of its shingle set (no keys without a word)."""
    a, b = _multipliers()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, fp, size, keys = [], [], [], []
            for text in as_bytes(batch.column(1)):
                # Similarity is that of sets, so a shingle counts once in the fingerprint too.
                h = np.unique(shingle_hashes(text, words))
                node.append(_signed(xxhash.xxh64_intdigest(text, SEED)))
                fp.append(_signed(fingerprint(h)))
                size.append(len(h))
                keys.append(_band_keys(h, a, b) if len(h) else [])
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in (node, fp, size)), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "node", "fp", "size", "keys"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, node long, fp long, size long, keys array<long>")


def _close(cell: np.ndarray, fp: np.ndarray, size: np.ndarray, label: np.ndarray, radius: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one cell with different labels within ``radius`` bits whose sets' sizes allow the similarity. ``label`` may change between chunks."""
    for a, b in close_pairs(cell, fp.view(np.uint64), radius):
        fit = (label[a] != label[b]) & (np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) - 1e-6)
        if fit.any():
            yield a[fit], b[fit]


def _with_partner(dealt: DataFrame, radius: int, similarity: float) -> DataFrame:
    """(cell, node): the rows that have a partner to verify in their cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_cell(batches):
            cell, node, fp, size, label = _longs(table, "cell", "node", "fp", "size", "label")
            has = np.zeros(len(cell), dtype=bool)
            for a, b in _close(cell, fp, size, label, radius, similarity):
                has[a] = has[b] = True
            yield pa.RecordBatch.from_arrays([pa.array(cell[has]), pa.array(node[has])], ["cell", "node"])

    return _in_cells(dealt, run, "cell long, node long")


def _linked(cell: np.ndarray, fp: np.ndarray, label: np.ndarray, texts: list[bytes], words: int, radius: int, similarity: float) -> np.ndarray:
    """Classes of the rows after every close pair of different classes has been verified by its sets' exact similarity; class numbers are rows.

    The shingles of all sets get numbers; the sets of a row's partners lie in one array of them, in which those of the row itself are looked up.
    """
    _, place = np.unique(label, return_index=True)
    of = np.zeros(len(label), dtype=np.int64)
    of[:] = place[np.searchsorted(label[place], label)]
    sets = [np.unique(shingle_hashes(t, words)) for t in texts]
    size = np.array([len(x) for x in sets], dtype=np.int64)
    known, number = np.unique(np.concatenate(sets), return_inverse=True) if sets else (np.zeros(0), np.zeros(0, np.int64))
    number = number.astype(np.int32)
    start = np.cumsum(size) - size
    held = np.zeros(len(known), dtype=bool)
    for a, b in _close(cell, fp, size, of, radius, similarity):
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        edge = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        for lo, hi in zip(edge, np.append(edge[1:], len(a)), strict=True):
            x, y = a[lo], b[lo:hi]
            y = y[of[y] != of[x]]
            mine = number[start[x] : start[x] + size[x]]
            held[mine] = True
            for at in range(0, len(y), PARTNERS):
                z = y[at : at + PARTNERS]
                n = size[z]
                ends = np.cumsum(n)
                both = np.add.reduceat(held[number[np.repeat(start[z] - (ends - n), n) + np.arange(ends[-1])]], ends - n, dtype=np.int64)
                near = z[both >= similarity * (size[x] + n - both) - 1e-9]
                if len(near):
                    unite(of, np.full(len(near), x), near)
            held[mine] = False
    return of


#: Partners of a row whose sets are looked up at once.
PARTNERS = 1024


def _verified(asked: DataFrame, texts: DataFrame, words: int, radius: int, similarity: float) -> DataFrame:
    """(u, v): links between labels of rows (cell, node, fp, size, label) that meet in a cell, verified by the exact Jaccard similarity of their shingle sets.

    Every pair that ``_close`` finds in a cell is verified unless its rows are united already; classes are emitted as stars.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_cell(batches):
            cell, node, fp, label = _longs(table, "cell", "node", "fp", "label")
            # Each cell alone: labels are unique inside it only. Rows that repeat a node are one.
            text = table.column("text")
            edge = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            u, v = [], []
            for lo, hi in zip(edge, np.append(edge[1:], len(cell)), strict=True):
                rows = lo + np.flatnonzero(np.append(True, node[lo + 1 : hi] != node[lo : hi - 1]))
                rows = rows[np.argsort(label[rows], kind="stable")]
                of = _linked(cell[rows], fp[rows], label[rows], as_bytes(text.take(pa.array(rows))), words, radius, similarity)
                top = label[rows[of]]
                moved = np.flatnonzero(top != label[rows])
                u.append(label[rows][moved])
                v.append(top[moved])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (u, v)], ["u", "v"])

    return _in_cells(asked.join(texts, "node"), run, "u long, v long").distinct()


#: Steps of the search: how many bands' cells, and whether the blocks of a heavy cell meet. The last one leaves no pair of a cell untried.
STEPS = ((3, False), (BANDS, True))


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, root, least, n): one row per distinct text, with its group's smallest node, its smallest id and its number of rows.

    Texts with equal bytes are one node (its 64-bit XXH64); null texts count as empty, which is one node; a null id is never the smallest. An empty table
    gives an empty result; other columns are ignored. Signatures are made where the documents are read, so that only they
    are shuffled; copies are combined before that. Cells come from min-hash bands over the shingle sets; inside
    a cell the bit-sliced comparison of SimHash fingerprints finds the pairs within the search radius, and those
    whose exact Jaccard similarity is at least ``similarity`` link. The first step compares in a few bands' cells, and in heavy ones inside blocks only; groups found there are contracted. The last
    step verifies every pair of different groups that is left in any cell. Texts of nodes that have a pair to verify are read once.
    """
    signed = _signatures(docs, words, id_col, text_col)
    nodes = cut(
        signed.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    )
    radius = search_radius(similarity)

    def cells(of: DataFrame, bands: int) -> DataFrame:
        return of.select(F.explode(F.slice("keys", 1, bands)).alias("cell"), (F.col("size") + ROW_WEIGHT).alias("weight"), "node", "fp", "size", "label")

    # Who has a partner at all: inside blocks, and in the blocks that meet.
    met = _with_partner(_dealt(cells(nodes.withColumn("label", F.col("node")), BANDS)), radius, similarity)
    ends = cut(nodes.join(met.select("node").distinct(), "node", "left_semi"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("node"), text.alias("text"))
    likely = screened(hashed, ends.select("node"), "node", "_may").where("_may").drop("_may")
    wanted = ends.select(F.col("node").alias("_node"), "least")
    on = (likely["node"] == wanted["_node"]) & likely["doc_id"].eqNullSafe(wanted["least"])
    texts = cut(likely.join(wanted, on, "left_semi").select("node", "text"))
    group = ends.select("node", F.col("node").alias("root"))
    for bands, meet in STEPS:
        near = ends.join(group, "node").withColumn("label", F.col("root"))
        dealt = cut(_dealt(cells(near, bands), meet))
        asked = dealt.join(_with_partner(dealt, radius, similarity), ["cell", "node"], "left_semi")
        merged = components(_verified(asked, texts, words, radius, similarity)).select(F.col("node").alias("root"), F.col("root").alias("up"))
        group = cut(group.join(merged, "root", "left").select("node", F.coalesce("up", "root").alias("root")))
    return nodes.select("node", "least", "n").join(group, "node", "left").withColumn("root", F.coalesce("root", "node"))


def deduplicate(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the smallest id.

    Null texts count as empty; all empty texts are one group. A row with a null id stays only if no row of its group has an id.
    Where rows repeat id and text (null and empty being one), one of them stays. An empty table stays empty. Columns are those of ``docs``, whatever they are named.
    Rows of groups of one row stay where they are read, but for the few that the screen can't tell; only the others are shuffled.
    """
    groups = cut(near_duplicates(docs, words, similarity, id_col, text_col))
    best = F.min(F.struct(F.col("least").isNull().alias("no"), F.col("least").alias("least"), F.col("node").alias("node"))).alias("best")
    many = groups.groupBy("root").agg(best, F.sum("n").alias("all"), F.count("*").alias("nodes")).where("all > 1")
    # The nodes of groups of several rows, and the id that stays if the node is the group's best.
    decided = skew_join(groups.select("root", "node", "n"), many, "root", "nodes", groups.count())
    decided = cut(decided.select(F.col("node").alias("_q_node"), F.col("n").alias("_q_n"), (F.col("best.node") == F.col("node")).alias("_q_best"), F.col("best.least").alias("_q_id")))
    marked = screened(docs.withColumn("_q_node", F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))), decided.select("_q_node"), "_q_node", "_q_may")
    total = groups.agg(F.sum("n")).first()[0] or 0
    unsure = skew_join(marked.where("_q_may"), decided, "_q_node", "_q_n", total, "left")
    alone = unsure.where("_q_best is null").select(*docs.columns)
    firsts = unsure.where(F.col("_q_best") & F.col(id_col).cast("long").eqNullSafe(F.col("_q_id")))
    if firsts.groupBy("_q_node").agg(F.count("*").alias("_n")).where("_n > 1").limit(1).count():
        firsts = firsts.dropDuplicates(["_q_node"])
    return marked.where("not _q_may").select(*docs.columns).unionByName(alone).unionByName(firsts.select(*docs.columns))
