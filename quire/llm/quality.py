"""Quality classifier from positive and unlabelled texts (non-negative risk)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import as_bytes, fold

#: Folds of crc32(doc_id as text); fold 0 is held out.
FOLDS = 5
#: Rows with score at or above are predicted 1.
THRESHOLD = 0.3
#: Most trusted positives, and most texts taken without their label, that one fit takes from the labelled rows (those with the smallest hash of the id).
SAMPLE = 12_000
#: The estimated prior is kept this far from 0 and 1.
LEAST_PRIOR = 0.02
#: Hashed byte-pair features besides the measured ones.
PAIRS = 256
_SYMBOLS = b"#*$%&|<>{}[]\\^~=_+@/"


def features(text: bytes) -> np.ndarray:
    """Style measurements and hashed byte-pair frequencies of a whole text; all zero but the first for an empty one."""
    out = np.zeros(N_FEATURES, dtype=np.float32)
    out[0] = 1
    n = len(text)
    words = text.split()
    if not words:
        return out
    raw = np.frombuffer(text, dtype=np.uint8)
    kinds = np.bincount(raw, minlength=256)
    n_words = len(words)
    letters = kinds[65:91].sum() + kinds[97:123].sum() + kinds[128:].sum()
    lines = text.split(b"\n")
    full = [x for x in lines if x.strip()]
    short = [w for w in words if len(w) > 1]
    shouted = sum(w.isupper() for w in short)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    pairs = n_words - 1 and len(set(zip(words, words[1:], strict=False))) / (n_words - 1)
    ended = sum(x.rstrip()[-1:] in (b".", b"!", b"?", b":", b'"') for x in full)
    symbols = sum(kinds[c] for c in _SYMBOLS)
    marked = sum(not (w[-1:].isalnum() or w[-1] >= 128 or w[-1:] in (b".", b",", b";", b":", b"?", b"!", b'"', b")", b"'")) for w in words)
    bare = sum(not any(c > 64 for c in w) for w in words)
    alone = (kinds[33] + kinds[63]) / n_words
    values = [
        np.log1p(n) / 10, np.log1p(n_words) / 8, n / n_words / 10, letters / n, kinds[65:91].sum() / max(1, letters), shouted / max(1, len(short)),
        kinds[48:58].sum() / n, symbols / n * 10, min(1.0, symbols / n_words), kinds[124] / n_words, alone, kinds[33] / n_words, len(set(words)) / n_words,
        same / n_words, pairs, ended / len(full), len(set(full)) / len(full), min(1.0, len(full) / n_words * 5), marked / n_words, bare / n_words,
        (kinds[44] + kinds[46]) / n_words, float(np.log1p(max(map(len, words)))) / 5, min(1.0, 10 / n_words), min(1.0, 50 / n_words),
    ]
    out[1 : 1 + len(values)] = values
    sharp = [values[5], values[8], values[9], values[11], values[13], values[18]]
    out[1 + MEASURED : 1 + MEASURED + len(sharp)] = [min(1.0, 8 * v) for v in sharp]
    if n > 1:
        code = (raw[:-1].astype(np.uint32) * 0x9E3779B1 + raw[1:].astype(np.uint32) * 0x85EBCA77) >> 13 & (PAIRS - 1)
        out[FIRST_PAIR:] = np.sqrt(np.bincount(code, minlength=PAIRS) / (n - 1))
    return out


MEASURED, SHARP = 24, 6
FIRST_PAIR = 1 + MEASURED + SHARP
N_FEATURES = FIRST_PAIR + PAIRS


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.03, decay: float = 2e-3) -> Model:
    """Logistic model by gradient steps on the non-negative unbiased risk
    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)]), plus ridge ``decay``.

    When the bracket falls below zero, the step goes up the bracket's slope instead, which undoes the over-fit that made it negative.
    Without positives or without unlabelled texts there is nothing to learn: the score is the prior everywhere.
    """
    dims = N_FEATURES
    if not len(positive) or not len(unlabelled):
        p = min(max(prior, 1e-3), 1 - 1e-3)
        return Model(np.zeros(dims), np.ones(dims), np.zeros(dims), float(np.log(p / (1 - p))), prior)
    every = np.concatenate([positive, unlabelled])
    mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-3
    xp, xu = (np.clip((x - mean) / scale, -8, 8).astype(np.float32) for x in (positive, unlabelled))
    w, b = np.zeros(dims, dtype=np.float64), float(np.log(max(prior, 1e-3) / max(1 - prior, 1e-3)))
    m, v = np.zeros(dims + 1), np.zeros(dims + 1)
    for t in range(1, steps + 1):
        w32 = w.astype(np.float32)
        zp, zu = (np.clip((x @ w32).astype(np.float64) + b, -30, 30) for x in (xp, xu))
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp_pos = np.append((sp - 1).astype(np.float32) @ xp, (sp - 1).sum()) / len(xp)
        slope = np.append(su.astype(np.float32) @ xu, su.sum()) / len(xu) - prior * np.append(sp.astype(np.float32) @ xp, sp.sum()) / len(xp)
        g = prior * gp_pos + slope if negative >= 0 else -slope
        g = g + decay * np.append(w, 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model(mean.astype(np.float64), scale.astype(np.float64), w, float(b), prior)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, sides: tuple[np.ndarray, np.ndarray] | None = None, doubt: float = 0.1, slack: float = 0.01) -> float:
    """The share of positives among unlabelled texts, from features of both; labels of the unlabelled ones aren't looked at.

    A classifier of positives against unlabelled texts is fitted on each half of both and scores the other half. ``sides`` says which half each row is in; a
    text that is in both sets must be in the same half of both, or the half that learned it as a positive would score it. Above any score, the unlabelled texts'
    share divided by the positives' is at least the prior, and equal to it where only positives score so high. The score is taken at which that
    quotient with a confidence bound (of probability 1 - ``doubt``) is smallest.
    """
    if len(positive) < 2 or len(unlabelled) < 2:
        return 0.5
    half = sides or tuple(np.arange(len(x)) % 2 == 0 for x in (positive, unlabelled))
    if any(h.all() or not h.any() for h in half):
        return 0.5
    scores: tuple[list, list] = ([], [])
    for side in (True, False):
        model = fit(positive[half[0] == side], unlabelled[half[1] == side], 0.5)
        for k, x in enumerate((positive, unlabelled)):
            scores[k].append(model.scores(x[half[k] != side]))
    p, u = (np.sort(np.concatenate(x)) for x in scores)
    above = 1 - np.arange(len(p)) / len(p)
    those = 1 - np.searchsorted(u, p, side="left") / len(u)
    width = sum(np.sqrt(np.log(4 / doubt) / (2 * len(x))) for x in (p, u))
    best = np.argmin((those + (1 + slack) * width) / above)
    return float(np.clip(those[best] / above[best], LEAST_PRIOR, 1 - LEAST_PRIOR))


def _matrix(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and features of a bounded number of texts (doc_id, text), in the order of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t).tobytes() for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["doc_id", "f"])

    rows = sorted(df.select("doc_id", "text").mapInArrow(run, "doc_id long, f binary").collect())
    ids = np.array([r["doc_id"] for r in rows], dtype=np.int64)
    return ids, np.stack([np.frombuffer(r["f"], dtype=np.float32) for r in rows]) if rows else np.zeros((0, N_FEATURES), dtype=np.float32)


def _sample(ids: DataFrame, n: int) -> DataFrame:
    return ids.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from trusted positives (label 1) and texts whose label isn't looked at, of the folds that are not held out.

    Both are bounded samples of ``sample`` ids of the labelled rows; the class prior is estimated from the two. An id that several rows carry has the least of
    their texts, an id with several labels is trusted if one of them is 1. Rows with a null id, label or text teach nothing. Without any the score is the middle everywhere.
    """
    learn = fold(F.col("doc_id"), FOLDS) != 0
    known = labels.where(learn & F.col("quality").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    texts = docs.where(learn & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen = (_sample(known.where("quality = 1"), sample), _sample(known, sample))
    # One text for an id, however many rows carry it: no more than ``sample`` rows reach the driver.
    (p_ids, positive), (u_ids, unlabelled) = (_matrix(texts.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))) for ids in chosen)
    sides = tuple(np.array([zlib.crc32(str(i).encode()) // FOLDS % 2 == 0 for i in ids.tolist()], dtype=bool) for ids in (p_ids, u_ids))
    return fit(positive, unlabelled, estimate_prior(positive, unlabelled, sides))


def _scored(batch: pa.RecordBatch, column: int, model: Model) -> np.ndarray:
    x = [features(t) for t in as_bytes(batch.column(column))]
    return model.scores(np.stack(x)) if x else np.zeros(0)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted. Only the text enters a score.

    A null text counts as empty. A null id is never held out. Repeated rows get equal scores; an empty table gives an empty result; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _scored(batch, 2, sent.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"), "text")
    return wanted.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accept(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whatever they are named, that the model predicts 1: each row by its text alone, a null one as an empty one, whatever its id;
    repeated rows stay or go together; an empty table stays empty."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scored(batch, at, sent.value) >= threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
