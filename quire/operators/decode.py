"""Model outputs to symbols: arg-max, CTC, top-k over classes, reading order, table structure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.schema import BBOX

CONFIDENCE = 0.45
#: Structure tokens between the marks for start and end: fixed values, the spans 2 to 20 from a rule.
STRUCTURE_TOKENS = (
    "sos", "<thead>", "</thead>", "<tbody>", "</tbody>", "<tr>", "</tr>", "<td", ">", "</td>",
    *(f' colspan="{n}"' for n in range(2, 21)), *(f' rowspan="{n}"' for n in range(2, 21)), "<td></td>", "eos",
)
CELL_TOKENS = ("<td>", "<td", "<td></td>")


def first_argmax(a: Column) -> Column:
    """Place (from 0) of the largest value, the first of equals."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def ctc(steps: DataFrame, group: Sequence[str], blank: int = 0) -> DataFrame:
    """(group, classes, confidence) from (group, step, logits): repeats collapse, then blanks go; a blank between equals keeps both.

    ``confidence`` is the mean over steps of the largest softmax share.
    """
    best = first_argmax(F.col("logits"))
    top = F.array_max("logits")
    share = F.lit(1.0) / F.aggregate("logits", F.lit(0.0), lambda s, v: s + F.exp((v - top).cast("double")))
    w = Window.partitionBy(*group).orderBy("step")
    seen = steps.select(*group, "step", best.alias("_c"), share.alias("_p")).withColumn("_new", ~F.col("_c").eqNullSafe(F.lag("_c").over(w)))
    one = F.when(F.col("_new") & (F.col("_c") != blank), F.struct("step", "_c"))
    return seen.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["_c"]).alias("classes"), F.avg("_p").cast("float").alias("confidence"))


def spell(classes: DataFrame, group: Sequence[str], characters: Sequence[str]) -> DataFrame:
    """(group, text): classes as characters; 0 (blank) and classes without a character are skipped. The dictionary is a literal array."""
    known = F.array(*[F.lit(c) for c in characters])
    picked = F.transform(F.filter("classes", lambda c: (c > 0) & (c < len(characters))), lambda c: F.element_at(known, c + 1))
    return classes.select(*group, F.array_join(picked, "").alias("text"))


def top_classes(logits: DataFrame, group: Sequence[str], classes: int) -> DataFrame:
    """(group, rank, query, class, score): of all (query, class) pairs of a group, as many of the highest as there are queries; ties by flat place.

    ``logits``: group, logits as one flat array of query * classes values. They rank, not the scores: different logits may have one score in single precision.
    """
    flat = logits.select(*group, F.floor(F.size("logits") / classes).alias("_k"), F.posexplode("logits").alias("_pos", "_v"))
    scored = flat.withColumn("score", g.sigmoid(F.col("_v")))
    w = Window.partitionBy(*group).orderBy(F.col("_v").desc(), "_pos")
    ranked = scored.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < F.col("_k"))
    return ranked.select(*group, "rank", F.floor(F.col("_pos") / classes).cast("int").alias("query"), (F.col("_pos") % classes).cast("int").alias("class"), "score")


def order_ranks(logits: Column, n: int) -> Column:
    """Reading-order rank of each of ``n`` items from a flat n by n array: items that few others come before are first.

    Item j gets the chance of every i < j to come before it, and for i > j one less the chance of j before i; only the upper triangle is read. Chances and their sums (in order of i) are
    in double: chances rounded to single precision make sums equal, or change their order, that differ in the eighth digit.
    """
    at = lambda i, j: F.lit(1.0) / (F.lit(1.0) + F.exp(-F.get(logits, i * n + j).cast("double")))
    items = F.sequence(F.lit(0), F.lit(n - 1))

    def vote(j: Column) -> Column:
        return F.aggregate(items, F.lit(0.0), lambda s, i: s + F.when(i < j, at(i, j)).when(i > j, F.lit(1.0) - at(j, i)).otherwise(F.lit(0.0)))

    order = F.transform(F.array_sort(F.transform(items, lambda j: F.struct(vote(j).alias("v"), j.alias("j")))), lambda x: x["j"])
    return F.transform(items, lambda j: (F.array_position(order, j) - 1).cast("int"))


def detections(top: DataFrame, boxes: DataFrame, ranks: DataFrame, group: Sequence[str], width: Column, height: Column, confidence: float = CONFIDENCE) -> DataFrame:
    """(group, order, label_id, score, bbox): top pairs of enough confidence, scaled to the page and numbered by reading order.

    ``boxes``: group, query, cx, cy, w, h as shares of the page; ``ranks``: group, query, rank. Equal ranks keep their order in ``top``.
    """
    b = g.from_center(*[F.col(c).cast("float") for c in ("cx", "cy", "w", "h")])
    placed = top.where(F.col("score") >= g.f32(confidence)).join(boxes.withColumn("b", b), [*group, "query"]).join(ranks.withColumnRenamed("rank", "read"), [*group, "query"], "left")
    w = Window.partitionBy(*group).orderBy(F.col("read").asc_nulls_last(), "rank")
    return placed.select(*group, (F.row_number().over(w) - 1).alias("order"), F.col("class").alias("label_id"), g.round4(F.col("score")).alias("score"), g.denormalize(F.col("b"), width, height).alias("bbox"))


def above_threshold(logits: DataFrame, labels: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, class, score, keep): the best class of each query, kept from its class's own threshold on (a broadcast dimension)."""
    best = logits.select(*key, first_argmax(F.col("logits")).alias("class"), g.sigmoid(F.array_max("logits")).alias("score"))
    return best.join(F.broadcast(labels.select(F.col("label_id").alias("class"), "threshold")), "class").select(*key, "class", "score", (F.col("score") >= F.col("threshold")).alias("keep"))


def structure(steps: DataFrame, group: Sequence[str], tokens: Sequence[str] = STRUCTURE_TOKENS) -> DataFrame:
    """(group, tokens, boxes, score) from (group, step, probs, loc as shares, width, height).

    Reading stops at the end mark, but not at step 0; start and end marks give nothing; each cell token gives a box. ``score`` is
    the mean of the largest probability over the steps that gave a token.
    """
    end = len(tokens) - 1
    known = F.array(*[F.lit(x) for x in tokens])
    read = steps.withColumn("c", first_argmax(F.col("probs"))).withColumn("p", F.array_max("probs"))
    stop = F.min(F.when((F.col("c") == end) & (F.col("step") > 0), F.col("step"))).over(Window.partitionBy(*group))
    used = read.withColumn("_stop", stop).where(F.coalesce(F.col("step") < F.col("_stop"), F.lit(True)))
    used = used.withColumn("gives", ~F.col("c").isin(0, end))
    token = F.element_at(known, F.col("c") + 1)
    cell = g.denormalize(g.raw_box(*[F.col("loc")[i] for i in range(4)]), F.col("width"), F.col("height"))
    row = F.struct("step", token.alias("t"), F.when(token.isin(*CELL_TOKENS), cell).alias("b"), F.col("p").alias("p"))
    rows = used.groupBy(*group).agg(F.array_sort(F.collect_list(F.when(F.col("gives"), row))).alias("r"))
    around = lambda a: F.concat(F.array(*map(F.lit, ("<html>", "<body>", "<table>"))), a, F.array(*map(F.lit, ("</table>", "</body>", "</html>"))))
    total = F.aggregate("r", g.f32(0), lambda s, x: g.f32(s + x["p"]))
    boxes = F.transform(F.filter("r", lambda x: x["b"].isNotNull()), lambda x: x["b"]).cast(f"array<{BBOX}>")
    score = F.when(F.size("r") > 0, g.f32(total / g.f32(F.size("r")))).otherwise(g.f32(0))
    return rows.select(*group, around(F.transform("r", lambda x: x["t"])).alias("tokens"), boxes.alias("boxes"), score.alias("score"))
