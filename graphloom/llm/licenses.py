"""Licence scans: a trained paragraph classifier in DataFrame functions, confirmed against templates.

A paragraph ends at a blank line; comment prefixes are dropped and its wrapped lines joined. Its lines, its sentences
and the paragraph as a whole are candidates: a notice may fill a line, be wrapped, or stand in a longer paragraph. The
classifier's features are the word n-grams (1 to 3 words). A multinomial logistic regression over these sparse n-grams, trained in
numpy on the templates below, their mutilations, and text that is no licence (the ``unknown`` class), identifies the family. Its
weights are a table of bounded size (the n-grams of the training texts) that is broadcast and joined; scores
are sums, the softmax and the threshold are column expressions.

Unknown: the threshold is the score that loses the least of held-back notices (a share) plus of held-back texts that are none, among them
notices of families left out of a training of their own. A predicted family is a notice only if it is confirmed: enough of the
3-word n-grams of its closest template are in the candidate; an unconfirmed one is given as ``suspected``.

Screen: the weights tell which words a candidate must hold two of to reach the threshold for any family (``screen``). Candidates
without them are unknown whatever else they hold, so their n-grams are not made; no decision is changed by that.

Defined results: null and empty texts have no licence; repeated rows give repeated results; of several paragraphs the
confirmed, then the most probable decides (ties: the earlier one); extra columns are ignored; an empty table
gives an empty result. ``n_notices`` counts, in each paragraph with a notice, the sentences that are one or the
lines, whichever are more, and one at least.
"""

from __future__ import annotations

import functools
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common

#: Short notices of licence families, in words of our own or the customary notice line.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This software is available under the terms of the MIT license; permission is granted free of charge to any person."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the Apache License Version 2.0."),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software; you can redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("LGPL", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD", "Distributed under the BSD 3-Clause License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD license."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("CC-BY", "This text is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA", "Available under the Creative Commons Attribution-ShareAlike 4.0 License."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC", "This text is licensed under the Creative Commons Attribution-NonCommercial 4.0 License."),
    ("CC0", "Dedicated to the public domain under the Creative Commons CC0 license."),
    ("ISC", "Released under the ISC License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain under the Unlicense license."),
)
#: Text that is no licence notice, with words of notices and without.
OTHERS = (
    "the driver license was renewed last week", "a license plate in the street", "he lost his fishing license and the permit", "license to build a house near the public road",
    "the warranty covers the first version of the product", "copyright law is taught in this course", "all rights of the public are protected", "she has poetic license with the terms of the story",
    "the license fee for the software was high", "an open source project without a licence", "under the terms of the agreement", "released under the new version of the rules", "the general public was free to come",
    "this text is about the work of a creative person", "the source of the river is in the mountains", "a copy of the file was found in the use of the software", "it is free of charge for any person",
    "the foundation of the house was built in the first year", "you may not use the road except on foot", "the domain of the king was open to the commons", "the form of the code is subject to change",
    "the library of the university lends books", "mit der neuen version", "the attribution of the painting is in doubt", "redistribution of income and of land", "an international agreement on trade", "the apache people lived there", "a modification of the binary system",
)
#: Words that any text may hold: n-grams of them alone are no features.
PLAIN = "the of and to in that it is was for on with this under as by or are be from an at which not you may any can".split()
UNKNOWN = "unknown"
#: The parts of a paragraph that are candidates.
LINE, SENTENCE, WHOLE = range(3)
COMMENT = r"(?m)^[ \t]*(?:/\*+|\*+/?|//+|#+|;+|--+|%+|>+|<!--|dnl\b|REM\b)[ \t]*"
WORD = r"[a-z0-9.+-]*[a-z0-9]"
GRAMS = 3
#: Share of the closest template's 3-word n-grams that confirms a prediction; longest paragraph n-grams are unbounded.
CONFIRM = 0.6
#: Steps, their length, and the penalty of a weight, which leaves few n-grams that tell families from other text.
EPOCHS, RATE, SPARSE = 300, 0.5, 0.01


def grams_of(text: str) -> list[str]:
    words = re.findall(WORD, text.lower())
    return sorted({" ".join(words[i : i + n]) for n in range(1, GRAMS + 1) for i in range(len(words) - n + 1)})


def _examples(seed: int = 3) -> tuple[list[str], list[str]]:
    rng = np.random.default_rng(seed)
    texts, labels = [], []
    noise = lambda k: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 8))) for _ in range(k))
    plain = [w for t in OTHERS for w in t.split()]
    for _ in range(12):
        for family, text in (*TEMPLATES, *((UNKNOWN, x) for x in OTHERS)):
            words = text.split()
            if rng.random() < 0.5 and len(words) > 8:
                words = [w for w in words if rng.random() > 0.1]
            around = [rng.choice(plain, rng.integers(0, 16) * (family != UNKNOWN and rng.random() < 0.5)) for _ in range(2)]
            texts.append(" ".join([noise(rng.integers(0, 4)), *around[0], *words, *around[1], noise(rng.integers(0, 4))]))
            labels.append(family)
        for _, text in TEMPLATES:  # a few words of a notice are none
            words = text.split()
            at = int(rng.integers(0, max(1, len(words) - 2)))
            texts.append(" ".join([noise(2), *rng.choice(plain, 4), *words[at : at + 2], *rng.choice(plain, 4)]))
            labels.append(UNKNOWN)
        texts += ["license " + noise(6), noise(8), *(" ".join(rng.choice(plain, 12)) for _ in range(6)), " ".join(rng.choice(PLAIN, 12))]
        labels += [UNKNOWN] * 9
    return texts, labels


def _fit(x: np.ndarray, y: np.ndarray, families: int, epochs: int) -> tuple[np.ndarray, np.ndarray]:
    w, b, target = np.zeros((x.shape[1], families)), np.zeros(families), np.eye(families)[y]
    for _ in range(epochs):
        p = softmax(x @ w + b)
        w -= RATE * x.T @ (p - target) / len(p) * 4
        w = np.sign(w) * np.maximum(np.abs(w) - RATE * SPARSE, 0)
        b -= RATE * (p - target).mean(0)
    return w, b


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


@functools.cache
def trained() -> tuple[list[str], dict[str, list[float]], list[float], float]:
    """(families, weights of each n-gram, biases, calibrated threshold)."""
    texts, labels = _examples()
    families = sorted(set(labels))
    unknown = families.index(UNKNOWN)
    y = np.array([families.index(x) for x in labels])
    vocabulary = sorted({g for t in (*[t for _, t in TEMPLATES], *OTHERS) for g in grams_of(t) if not set(g.split(" ")) <= set(PLAIN)})
    at = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(texts), len(vocabulary)))
    for i, t in enumerate(texts):
        for g in grams_of(t):
            if g in at:
                x[i, at[g]] = 1
    held = np.arange(len(texts)) % 4 == 3
    w, b = _fit(x[~held], y[~held], len(families), EPOCHS)
    p = softmax(x[held] @ w + b)
    p[:, unknown] = np.where(p.argmax(1) == unknown, 2, 0)  # a text taken for unknown has no score to pass with
    top, got = np.where(p.argmax(1) == unknown, 0, p.max(1)), p.argmax(1)
    right = top[(y[held] != unknown) & (got == y[held])]
    wrong = [top[(y[held] == unknown) | (got != y[held])]]
    for left in range(len(families)):
        if left != unknown:
            some = ~held & (y != left)
            v, c = _fit(x[some], y[some], len(families), EPOCHS // 4)
            q = softmax(x[held & (y == left)] @ v + c)
            wrong.append(np.where(q.argmax(1) == unknown, 0, q.max(1)))
    wrong = np.concatenate(wrong)
    cuts = np.unique(np.concatenate([[0.4], right[right >= 0.4], np.nextafter(wrong[(wrong >= 0.4) & (wrong < 1)], 1)]))
    lost = [(right < t).mean() + (wrong >= t).mean() for t in cuts]
    return families, {g: [float(v) for v in w[i]] for g, i in at.items() if w[i].any()}, [float(v) for v in b], float(cuts[int(np.argmin(lost))])


@functools.cache
def screen() -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(words, telling ones): every text that is taken for a licence holds two of the words, or one of the telling ones.

    A score of ``threshold`` for a family needs log odds against unknown, which n-grams add to by their weights. What all n-grams of one
    word and plain ones can add is a sum over the model: where it falls short for every family, a text without a second word
    is unknown whatever it holds.
    """
    families, weights, bias, threshold = trained()
    unknown = families.index(UNKNOWN)
    need = {f: np.log(threshold / (1 - threshold)) - (bias[f] - bias[unknown]) - 1e-6 for f in range(len(families)) if f != unknown}
    words, one = set(), {}
    for gram, w in weights.items():
        rare = set(gram.split(" ")) - set(PLAIN)
        if any(w[f] > w[unknown] for f in need):
            words |= rare
        if len(rare) == 1:
            for f in need:
                x = next(iter(rare)), f
                one[x] = one.get(x, 0.0) + max(0.0, w[f] - w[unknown])
    if min(need.values()) <= 0:
        raise ValueError("a text without any n-gram passes")
    return tuple(sorted(words)), tuple(sorted({x for (x, f), gain in one.items() if gain >= need[f]}))


def _pattern(words: tuple[str, ...]) -> str:
    """Holds wherever one of the words stands."""
    return rf"(?<![a-z0-9.+-])(?:{'|'.join(sorted(map(re.escape, words), reverse=True))})(?![a-z0-9])"


def possible(text: Column) -> Column:
    """Whether a text passes the screen."""
    words, telling = screen()
    low = F.lower(text)
    two = F.size(F.array_distinct(F.regexp_extract_all(low, F.lit(_pattern(words)), F.lit(0)))) > 1
    return two | low.rlike(_pattern(telling)) if telling else two


def paragraphs(docs: DataFrame) -> DataFrame:
    """(row, doc_id, place, paragraph) of the candidates, which are chosen before any exploding.

    ``place`` grows with the number of the paragraph, then by part (LINE, SENTENCE, WHOLE), then along the text.
    """
    text = F.regexp_replace(F.regexp_replace("text", r"\r\n?", "\n"), COMMENT, "")

    def parts(block: Column, i: Column) -> Column:
        joined = F.regexp_replace(block, r"\s*\n\s*", " ")
        of = lambda kind, xs: F.transform(xs, lambda x, k: F.struct((F.shiftleft(i.cast("long") * 3 + kind, 32) + k).alias("place"), x.alias("paragraph")))
        each = F.concat(of(LINE, F.split(block, r"\n")), of(SENTENCE, F.split(joined, r"(?<=[.!?])\s+")), of(WHOLE, F.array(joined)))
        return F.filter(each, lambda s: possible(s["paragraph"]))

    return docs.where("text IS NOT NULL").select("row", "doc_id", F.inline(F.flatten(F.transform(F.split(text, r"\n\s*\n"), parts))))


def _grams(words: Column) -> Column:
    def of(n: int) -> Column:
        many = F.size(words) - (n - 1)
        return F.when(many > 0, F.transform(F.sequence(F.lit(1), many), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of(n) for n in range(1, GRAMS + 1)]))


def classify(found: DataFrame) -> DataFrame:
    """(row, place, family, score, confirmed) of every candidate paragraph."""
    spark = found.sparkSession
    families, weights, bias, threshold = trained()
    words = F.regexp_extract_all(F.lower("paragraph"), F.lit(WORD), F.lit(0))
    three = [(k, family, len(t3), g) for k, (family, t) in enumerate(TEMPLATES) for t3 in [[g for g in grams_of(t) if g.count(" ") == GRAMS - 1]] for g in t3]
    # the tables are bounded by the templates; n-grams in neither say nothing
    none = [0.0] * len(families)
    known = F.broadcast(spark.createDataFrame([(g, weights.get(g, none), g in weights) for g in sorted({*weights, *(t[3] for t in three)})], "gram string, w array<double>, weighs boolean"))
    grams = found.select("row", "place", words.alias("w")).select("row", "place", F.explode(_grams(F.col("w"))).alias("gram")).join(known, "gram")
    grams = common.settle(grams, "licence-grams")
    templates = F.broadcast(spark.createDataFrame(three, "template int, family string, size int, gram string"))
    scored = grams.where("weighs").groupBy("row", "place").agg(*[F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(len(families))])
    z = F.array(*[F.struct((F.col(f"s{i}") + bias[i]).alias("z"), F.lit(f).alias("family")) for i, f in enumerate(families)])
    scored = scored.select("row", "place", z.alias("z")).withColumn("best", F.array_max("z")).withColumn("score", 1 / F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x["z"] - F.col("best")["z"])))
    known = scored.select("row", "place", F.when(F.col("score") >= threshold, F.col("best")["family"]).otherwise(F.lit(UNKNOWN)).alias("family"), "score")
    shares = grams.join(templates, "gram").groupBy("row", "place", "family", "template").agg((F.count(F.lit(1)) / F.max("size")).alias("share")).groupBy("row", "place", "family").agg(F.max("share").alias("share"))
    return known.join(shares, ["row", "place", "family"], "left").select("row", "place", "family", "score", (F.coalesce("share", F.lit(0.0)) >= CONFIRM).alias("confirmed"))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, license, score, confirmed, n_notices, suspected) of every row: license is null where no paragraph is a notice."""
    rows = common.settle(
        docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.when(possible(F.col("text")), F.col("text")).alias("text")), "licence-rows"
    )
    each = classify(paragraphs(rows)).where(F.col("family") != UNKNOWN)
    best = F.max_by(F.struct("family", "score", "confirmed"), F.struct("confirmed", F.round("score", 9), -F.col("place")))
    part = F.shiftright("place", 32)
    counted = lambda kind: F.sum(((part % 3 == kind) & F.col("confirmed")).cast("long"))
    some = F.max(F.col("confirmed").cast("long"))
    by_block = each.groupBy("row", F.floor(part / 3).alias("block")).agg(best.alias("b"), F.greatest(counted(SENTENCE), counted(LINE), some).alias("n"), F.min("place").alias("place"))
    best = F.max_by("b", F.struct(F.col("b")["confirmed"], F.round(F.col("b")["score"], 9), -F.col("place")))
    best = by_block.groupBy("row").agg(best.alias("b"), F.sum("n").alias("n")).select(F.col("row").alias("at"), "b.*", "n")
    sure = F.coalesce("confirmed", F.lit(False))
    return rows.select("row", "doc_id").join(best, F.col("row") == F.col("at"), "left").select(
        "doc_id", F.when(sure, F.col("family")).alias("license"), F.round("score", 6).alias("score"), sure.alias("confirmed"), F.coalesce("n", F.lit(0)).cast("long").alias("n_notices"), F.when(~sure, F.col("family")).alias("suspected")
    )


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))


QUERIES = {"op7_licenses": op7_licenses}
SQL: dict[str, str] = {}
