"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import as_text, fold

DIMS = 1024
SEED = 7
FOLDS, HELD_OUT = 4, 2
#: Texts and letters that are handled at once, and n-grams whose vectors stand in memory at once.
TEXTS, LETTERS, GRAMS = 256, 1 << 19, 4096
#: Most languages a model may have, which bounds what training brings to the driver.
LANGUAGES = 4096


def letter_vector(code: int) -> np.ndarray:
    """The random vector of +1 and -1 of a code point (0: the boundary of a word)."""
    return np.random.default_rng([SEED, code]).integers(0, 2, DIMS).astype(np.int8) * 2 - 1


class Encoder:
    """Bundles of bound trigrams: the vector of letters a, b, c is rot(rot(a)) * rot(b) * c.

    Letters are those of str.isalpha after lower-casing; any run of other signs is one word boundary, which binds like a letter.
    """

    def __init__(self) -> None:
        self.known: dict[int, np.ndarray] = {}

    def _vectors(self, codes: np.ndarray) -> np.ndarray:
        for c in codes.tolist():
            if c not in self.known:
                self.known[c] = letter_vector(c)
        return np.stack([self.known[c] for c in codes.tolist()])

    def grams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per trigram occurrence: its text and its number among the distinct trigrams; those as (k, 3) code points; whether a text has a letter."""
        raw = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
        sizes = np.array([len(r) + 2 for r in raw])
        codes = np.zeros(int(sizes.sum()), dtype=np.uint32)
        at = 0
        for r in raw:
            codes[at + 1 : at + 1 + len(r)] = r
            at += len(r) + 2
        owner = np.repeat(np.arange(len(texts)), sizes)
        there = np.flatnonzero(np.bincount(codes))
        slot = np.zeros(int(there[-1]) + 1, dtype=np.int64)
        letters = [c for c in there.tolist() if chr(c).isalpha()]
        slot[letters] = np.arange(1, len(letters) + 1)
        seq = slot[codes]
        has = np.bincount(owner, weights=seq > 0, minlength=len(texts)) > 0
        keep = np.append(True, (seq[1:] > 0) | (seq[:-1] > 0) | (owner[1:] != owner[:-1]))
        seq, owner = seq[keep], owner[keep]
        a = len(letters) + 1
        whole = (owner[2:] == owner[:-2]) & ((seq[1:-1] > 0) | (seq[2:] > 0)) if len(seq) > 2 else np.zeros(0, bool)
        code = ((seq[:-2] * a + seq[1:-1]) * a + seq[2:])[whole] if len(seq) > 2 else np.zeros(0, np.int64)
        mine = owner[:-2][whole] if len(seq) > 2 else np.zeros(0, np.int64)
        if a**3 <= 1 << 24:
            distinct = np.flatnonzero(np.bincount(code, minlength=1))
            number = np.zeros(a**3, dtype=np.int64)
            number[distinct] = np.arange(len(distinct))
            gram = number[code]
        else:
            distinct, gram = np.unique(code, return_inverse=True)
        names = np.array([0, *letters], dtype=np.int64)
        return mine, gram, np.stack([names[distinct // (a * a)], names[distinct // a % a], names[distinct % a]], axis=1), has

    def bundle(self, owner: np.ndarray, gram: np.ndarray, triples: np.ndarray, n: int) -> np.ndarray:
        """(n, DIMS): the sum of the trigram vectors of each owner."""
        out = np.zeros((n, DIMS), dtype=np.float32)
        letters, back = np.unique(triples, return_inverse=True)
        if not len(letters):
            return out
        back = back.reshape(triples.shape)
        c = self._vectors(letters)
        b, a = np.roll(c, 1, axis=1), np.roll(c, 2, axis=1)
        order = np.argsort(gram, kind="stable") if len(triples) > GRAMS else None
        og, oo = (gram[order], owner[order]) if order is not None else (gram, owner)
        for lo in range(0, len(triples), GRAMS):
            part = back[lo : lo + GRAMS]
            i, j = (np.searchsorted(og, lo), np.searchsorted(og, lo + GRAMS)) if order is not None else (0, len(og))
            counts = np.bincount(oo[i:j] * len(part) + (og[i:j] - lo), minlength=n * len(part)).reshape(n, len(part))
            out += counts.astype(np.float32) @ (a[part[:, 0]] * b[part[:, 1]] * c[part[:, 2]]).astype(np.float32)
        return out


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and (i - start >= TEXTS or size + len(t) > LETTERS):
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def train(docs: DataFrame) -> dict[str, np.ndarray]:
    """A prototype for each language: the bundle of all its training texts (whose fold is known and not held out, with text and lang).

    Every task bundles its texts; the sums are whole numbers, added per language and dimension before they reach the driver.
    """
    learn = (fold(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    wanted = docs.where(learn).select("lang", "text")
    if wanted.select("lang").distinct().limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sums = Encoder(), {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), as_text(batch.column(1))
            for i, j in _groups(texts):
                names = sorted(set(langs[i:j]))
                place = {n: k for k, n in enumerate(names)}
                owner, gram, triples, _ = encoder.grams(texts[i:j])
                got = encoder.bundle(np.array([place[x] for x in langs[i:j]])[owner], gram, triples, len(names))
                for n, k in place.items():
                    sums[n] = sums.get(n, 0) + got[k].astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "v"])

    parts = wanted.mapInArrow(run, "lang string, v array<double>")
    sums = parts.select("lang", F.posexplode("v").alias("d", "x")).groupBy("lang", "d").agg(F.sum("x").alias("x"))
    found: dict[str, np.ndarray] = {}
    for row in sums.collect():
        found.setdefault(row["lang"], np.zeros(DIMS))[row["d"]] = row["x"]
    return {k: v / (np.linalg.norm(v) or 1.0) for k, v in sorted(found.items())}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score: the language whose prototype has the largest cosine with the text's bundle, and that cosine (0 at least).

    A null text, one without a letter, or any text if nothing was learned: und, 0. Ties go to the first language in
    alphabetical order. Null ids aren't held out; repeated rows get equal results; an empty table gives an empty result; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast((list(prototypes), np.stack(list(prototypes.values())) if prototypes else np.zeros((0, DIMS))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, profile = sent.value
        encoder = Encoder()
        for batch in batches:
            texts = as_text(batch.column(2))
            lang, score = [], []
            for i, j in _groups(texts):
                owner, gram, triples, has = encoder.grams(texts[i:j])
                v = encoder.bundle(owner, gram, triples, j - i).astype(np.float64)
                length = np.linalg.norm(v, axis=1)
                if not names:
                    lang, score = lang + ["und"] * (j - i), score + [0.0] * (j - i)
                    continue
                cosine = (v @ profile.T) / np.where(length > 0, length, 1)[:, None]
                best = np.argmax(cosine, axis=1)
                lang += [names[k] if h else "und" for k, h in zip(best, has, strict=True)]
                score += [float(min(1.0, max(0.0, cosine[r, k]))) if has[r] else 0.0 for r, k in enumerate(best)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "text")
    return wanted.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
