"""License scans with DataFrame functions only: phrase places, and an exact set-similarity join of text blocks with templates."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut

#: Characters that end a word: ASCII but digits and letters. A-Z count as the letters they are lower-cased to.
_OTHER = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
WORD, GAP = f"[^{_OTHER}]", f"[{_OTHER}]+"
#: Base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices that name a license, by label.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
)
#: Share of a template's distinct tokens that a block must hold.
CONTAINMENT = 0.9
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokens(template: str) -> list[str]:
    """The distinct words of a template, A-Z lower-cased."""
    return sorted(set(re.findall(f"{WORD}+", template.translate(str.maketrans(_UPPER, _LOWER)))))


def _words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; the first and the last are empty where the text begins or ends with other signs."""
    return F.split(F.translate(text, _UPPER, _LOWER), GAP)


def _phrase(words: str) -> str:
    return GAP.join(words.split())


_ANY = rf"(?<!{WORD})(?:{'|'.join(_phrase(p) for p, _ in PHRASES)})(?!{WORD})"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def _blocks(docs: DataFrame, longest: int, order: list[str], may_hold) -> DataFrame:
    """One row per text block that ``may_hold`` lets through: the document's key and _own, the tokens of ``order`` that the block holds, in that order. A block is a line, or ``longest`` consecutive words of a text with several lines, over line ends.

    Such stretches are cut from overlapping spans of twice the length, so that few are made where no span holds a template.
    """
    # The words are a bound variable of the lambda: written out in it, the text would be cut anew for every span.
    span = lambda w: F.transform(F.sequence(F.lit(1), F.size(w), F.lit(longest)), lambda i: F.struct(F.lit(True).alias("cuts"), F.slice(w, i, 2 * longest).alias("w")))
    spans = F.element_at(F.transform(F.array(_words(F.col("_text"))), span), 1)
    line = lambda x: F.struct(F.lit(False).alias("cuts"), _words(x).alias("w"))
    lines = F.transform(F.split("_text", "\n"), line)
    parts = docs.select("_id", "_hash", "_size", F.explode(F.when(F.instr("_text", "\n") > 0, F.concat(lines, spans)).otherwise(lines)).alias("_part"))
    own = F.array_intersect(F.array(*map(F.lit, order)), "w")
    parts = parts.select("_id", "_hash", "_size", "_part.cuts", F.col("_part.w").alias("w")).withColumn("_own", own).where(may_hold(F.col("_own")))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - longest + 1))
    stretches = F.when(F.col("cuts"), F.transform(starts, lambda i: F.slice("w", i, longest))).otherwise(F.array("w"))
    return parts.select("_id", "_hash", "_size", F.explode(stretches).alias("w")).select("_id", "_hash", "_size", own.alias("_own"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with equal id, hash and size have the same text, and so the same result."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_hash"), F.length(text).alias("_size"), text.alias("_text"))


def _sets(templates, containment: float) -> list[tuple[str, list[str], int]]:
    """Label, tokens and the tokens that a block must hold, of each template."""
    return [(label, tokens(t), math.ceil(containment * len(tokens(t)) - 1e-9)) for label, t in templates]


def _enough(own: Column, sets: list[tuple[str, list[str], int]]) -> Column:
    """Whether tokens are enough for a template: first by their number alone."""
    may = F.lit(False)
    for _, s, need in sets:
        may |= F.size(F.array_intersect(F.array(*map(F.lit, s)), own)) >= need
    return F.when(F.size(own) >= min((need for *_, need in sets), default=1), may).otherwise(F.lit(False))


def profiled(keyed: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """``keyed`` with n_words, _own (the templates' tokens that the text holds) and the text only where it holds enough tokens of a template in all.

    A text is cut into words once, here; every later step works on what this leaves.
    """
    sets = _sets(templates, containment)
    vocabulary = sorted({t for _, s, _ in sets for t in s})
    split = keyed.withColumn("_w", _words(F.col("_text")))
    ends = (F.get("_w", F.lit(0)) == "").cast("long") + ((F.size("_w") > 1) & (F.element_at("_w", -1) == "")).cast("long")
    held = split.withColumn("n_words", F.size("_w") - ends).withColumn("_own", F.array_intersect(F.array(*map(F.lit, vocabulary)), "_w")).drop("_w")
    may = _enough(F.col("_own"), sets)
    return held.withColumn("_may", F.when(may, F.col("_text")))


def token_order(profile: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary by the number of texts that hold a token, rarest first (ties by the token). One row per token of the templates reaches the driver."""
    held = profile.select(F.explode("_own").alias("t"))
    count = {r["t"]: r["n"] for r in held.groupBy("t").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda t: (count.get(t, 0), t))


def similarity_join(profile: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """(_id, _hash, _size, label, score): every document (a row of ``profiled``) and template label with a block that holds at least
    ``containment`` of a template's tokens, and the largest share held.

    Blocks are lines and stretches over line ends as long as the longest template and 1 / ``containment`` of it. Only documents that hold
    enough tokens of a template in their whole text are cut into blocks.
    Tokens stand in the corpus's order, rarest first. To share o of a template's n tokens, a block must hold one of its
    first n - o + 1 (prefix filter), have at least o tokens of the vocabulary (length filter), and from the first shared token
    on have o - 1 more on both sides (positional filter). What is left is counted exactly.
    """
    sets = _sets(templates, containment)
    order = token_order(profile, sorted({t for _, s, _ in sets for t in s}))
    rank = {t: k for k, t in enumerate(order)}
    prefixes = []
    for label, s, need in sets:
        s = sorted(s, key=rank.get)
        prefixes += [(t, i, need, len(s), label, s) for i, t in enumerate(s[: len(s) - need + 1])]
    first = sorted({p[0] for p in prefixes})
    # As many rows as the templates have prefix tokens: a literal table as large as what the caller holds.
    table = profile.sparkSession.createDataFrame(prefixes, "t string, i int, need int, n int, label string, tokens array<string>")
    longest = _longest(templates, containment)

    may_hold = lambda own: F.arrays_overlap(own, F.array(*map(F.lit, first))) & _enough(own, sets)
    # array_intersect keeps the order of its first argument: a block's tokens, rarest first.
    known = _blocks(profile.where("_may is not null").select("_id", "_hash", "_size", F.col("_may").alias("_text")), longest, order, may_hold)
    probes = known.select("_id", "_hash", "_size", "_own", F.posexplode("_own").alias("j", "t"))
    met = probes.join(F.broadcast(table), "t").where(
        (F.size("_own") >= F.col("need")) & (F.least(F.col("n") - F.col("i"), F.size("_own") - F.col("j")) >= F.col("need"))
    )
    both = F.size(F.array_intersect("_own", "tokens"))
    return met.where(both >= F.col("need")).groupBy("_id", "_hash", "_size", "label").agg(F.max(both / F.col("n")).alias("score"))


def _longest(templates, containment: float) -> int:
    """Words of a stretch over line ends."""
    return math.ceil(max((len(re.findall(f"{WORD}+", t)) for _, t in templates), default=1) / containment)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the largest share of a template held by a block that reaches the threshold, 1 where a base phrase stands, else 0.
    A null or empty text has no words, no labels and score 0. Null ids and repeated rows are carried as they are. An empty table gives an empty result. Other columns are ignored.
    """
    text, has = F.col("_text"), F.col("n_base") > 0
    words_before = lambda lazy: F.when(has, _count(F.regexp_extract(text, f"(?is)^(.*{lazy}){_ANY}", 1), f"{WORD}+"))
    base = F.array(*[F.when(has, F.when(text.rlike(rf"(?i)(?<!{WORD}){_phrase(p)}(?!{WORD})"), F.lit(label))) for p, label in PHRASES])
    # A word that all base phrases share: the pattern with its looks around is tried only on texts with it.
    shared = set.intersection(*(set(p.split()) for p, _ in PHRASES)).pop()
    n_base = F.when(text.rlike(f"(?i){shared}"), _count(text, f"(?i){_ANY}")).otherwise(F.lit(0).cast("long"))
    profile = profiled(_keyed(docs, id_col, text_col), templates, containment).withColumn("n_base", n_base)
    profile = cut(
        profile.select(
            "_id", "_hash", "_size", F.col("n_words").cast("long").alias("n_words"), "n_base", words_before("?").alias("first_word"), words_before("").alias("last_word"),
            F.array_sort(F.array_distinct(F.array_compact(base))).alias("_base"), "_own", "_may",
        )
    )
    rows = profile.drop("_own", "_may")
    found = similarity_join(profile, templates, containment)
    by_doc = found.groupBy("_id", "_hash", "_size").agg(F.collect_set("label").alias("_labels"), F.max("score").alias("_score"))
    names = [F.col(c).alias(f"{c}_m") for c in ("_id", "_hash", "_size")]
    by_doc = by_doc.select(*names, "_labels", "_score")
    on = F.col("_id").eqNullSafe(F.col("_id_m")) & (F.col("_hash") == F.col("_hash_m")) & (F.col("_size") == F.col("_size_m"))
    labels = F.array_sort(F.array_union("_base", F.coalesce("_labels", F.array().cast("array<string>"))))
    return rows.join(by_doc, on, "left").select(
        F.col("_id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word",
        F.array_join("_base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_score", F.lit(0.0))).alias("score"),
    )


def scan_sql(templates=TEMPLATES, containment: float = CONTAINMENT) -> str:
    """DuckDB SQL for ``scan`` over the view documents."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
    longest = _longest(templates, containment)
    at = []
    for phrase, label in PHRASES:
        hit = " AND ".join(f"w[i + {k}] = '{p}'" if k else f"w[i] = '{p}'" for k, p in enumerate(phrase.split()))
        at.append((f"list_filter(range(1, len(w) + 1), lambda i: {hit})", label))
    shares, enough = [], []
    for label, s, need in _sets(templates, containment):
        names = ", ".join(f"'{x}'" for x in s)
        enough.append(f"len(list_intersect(w, [{names}])) >= {need}")
        shares.append(f"{{'label': '{label}', 'n': {len(s)}, 'need': {need}, 'held': list_max(list_transform(blocks, lambda l: len(list_intersect(l, [{names}]))))}}")
    stretches = f"CASE WHEN contains(t, chr(10)) THEN list_transform(range(1, greatest(1, len(w) - {longest} + 1) + 1), lambda i: w[i : i + {longest} - 1]) ELSE [] END"
    return f"""
WITH d AS (SELECT doc_id, {lower} AS t FROM documents),
v AS (SELECT doc_id, t, regexp_extract_all(t, '{word}') AS w FROM d),
w AS (SELECT doc_id, w, CASE WHEN {" OR ".join(enough) or "false"} THEN list_concat(list_transform(string_split(t, chr(10)), lambda l: regexp_extract_all(l, '{word}')), {stretches}) ELSE [] END AS blocks FROM v),
p AS (SELECT doc_id, len(w) AS n_words, {", ".join(f"{x} AS at_{label}" for x, label in at)},
  list_filter([{", ".join(shares)}], lambda s: s.held >= s.need) AS met FROM w),
q AS (SELECT *, list_concat(list_concat(at_mit, at_apache), at_gpl) AS places,
  list_sort(list_filter([CASE WHEN len(at_mit) > 0 THEN 'mit' END, CASE WHEN len(at_apache) > 0 THEN 'apache' END, CASE WHEN len(at_gpl) > 0 THEN 'gpl' END], lambda x: x IS NOT NULL)) AS base FROM p)
SELECT doc_id, n_words::BIGINT AS n_words, len(places)::BIGINT AS n_base, (list_min(places) - 1)::BIGINT AS first_word, (list_max(places) - 1)::BIGINT AS last_word,
  coalesce(array_to_string(base, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(base, list_transform(met, lambda s: s.label)))), ','), '') AS labels,
  CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(list_max(list_transform(met, lambda s: s.held::DOUBLE / s.n)), 0.0::DOUBLE) END AS score FROM q"""
