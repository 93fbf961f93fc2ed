"""Licence scans by a trained paragraph classifier, in DataFrame and Spark ML operations only.

A sparse logistic regression on words and pairs of words tells licence families apart,
and an unknown class. It is trained on templates, parts of templates with words of the
corpus around them, and paragraphs of the corpus as the unknown class. A logistic
calibration on held-out rows, templates with words left out and further paragraphs of the
corpus, turns its score for any known family into a probability. A family counts where
that is ``PROBABLE`` or more and the paragraph shares enough pairs of words with one of
the family's templates.

Every position of a text is looked at (``places``): each line, with a cue or without; the
lines near one with a cue, one of the stems in ``CUES``, in its run of lines that are not
blank, joined; and stretches of words, over lines, blank ones and marks alike, in windows
of ``WINDOW`` words that overlap by half, so that a notice of up to half a window is whole
in one of them, however it is wrapped. A stretch goes from the first to the last pair of
words that a window shares with a template, and ``MARGIN`` words beyond on each side, so
that two families in one window are told apart.

Only what cannot count is left out beforehand: a text without any of the words that
``needed`` derives from the templates, or which as a whole shares too few pairs with every
template, has no place that shares enough. Results are kept by the digest of a text, so
texts themselves are not shuffled.

At most ``SAMPLE`` paragraphs of the corpus, picked by a hash, train the unknown class.

A null or empty text has no place and no family. Rows that repeat get the same
result. An empty table gives an empty result, after training on the templates alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import cut, digest_of, hashed_sample, positive_hash, sent_if_few

SAMPLE = 4000
#: Share of a template's pairs of words that confirms a family.
CONFIRM = 0.6
#: Calibrated probability of being a licence at all.
PROBABLE = 0.5
#: Lines of a paragraph before and after the line with the cue.
BEFORE, AFTER = 2, 6
#: Words of a window; three times a template's words fit in half of one.
WINDOW = 200
#: Words beside a stretch that tell families apart whose notices share an end.
MARGIN = 2
UNKNOWN = "unknown"

# Stems by which lines are found, and phrases and titles by which the families' notices are known.
CUES = ("licen", "permission", "redistribut", "reserved", "proprietary", "public domain", "cc0", "cc by", "warrant", "mozilla public")
TEMPLATES = {
    "agpl": [
        "GNU Affero General Public License",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ],
    "apache": [
        "Apache License", "Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License",
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ],
    "bsd": [
        "BSD License", "Released under the BSD License", "BSD 2-Clause License", "BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    ],
    "cc-by": ["Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "Licensed under CC BY-NC-SA 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0", "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "epl": ["Eclipse Public License", "made available under the terms of the Eclipse Public License 2.0"],
    "gpl": [
        "GNU General Public License", "licensed under the GNU General Public License, version 3",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ],
    "isc": ["ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl": [
        "GNU Lesser General Public License",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "mit": ["MIT License", "Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "mpl": ["Mozilla Public License", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "proprietary": ["All rights reserved", "Confidential and proprietary, no part may be reproduced without permission"],
    "public-domain": ["This is free and unencumbered software released into the public domain", "CC0 1.0 Universal", "Dedicated to the public domain under CC0 1.0 Universal"],
}
FAMILIES = [UNKNOWN, *sorted(TEMPLATES)]


def words(text: Column) -> Column:
    """Lower-case words; letters, digits, and dots or hyphens within."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}.-]+|[.-]+(?=[^\p{L}\p{N}]|$)", " "), " +"), lambda w: w != "")


def in_turn(w: Column) -> Column:
    """Pairs of words that stand together."""
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat_ws(" ", a, b))


def pairs(w: Column) -> Column:
    """Distinct pairs of words that stand together."""
    return F.array_distinct(in_turn(w))


def grams(w: Column) -> Column:
    """Distinct words and pairs of words."""
    return F.array_union(w, pairs(w))


def _templates(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(f).alias("family"), F.lit(t).alias("text")) for f, texts in TEMPLATES.items() for t in texts]
    known = spark.range(1).select(F.explode(F.array(*rows)).alias("x")).select("x.family", words(F.col("x.text")).alias("w"))
    return known.withColumn("pairs", pairs(F.col("w")))


def has_cue(text: Column) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [low.contains(c) for c in CUES])


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _lines(text: Column) -> Column:
    return F.split(text, r"\r?\n")


def _near(lines: Column, line: Column) -> Column:
    """The lines near ``line``, those beyond a blank one left out."""
    first = F.greatest(line - BEFORE, F.lit(0))
    before = F.slice(lines, first + 1, line - first)
    after = F.slice(lines, line + 1, AFTER + 1)

    def run(part: Column) -> Column:
        """The part's lines up to the first blank one."""
        blank = F.array_position(F.transform(part, lambda x: F.trim(x) == ""), F.lit(True))
        return F.when(blank > 0, F.slice(part, 1, (blank - 1).cast("int"))).otherwise(part)

    return F.concat_ws(" ", F.concat(F.reverse(run(F.reverse(before))), run(after)))


def _around(lines: Column) -> Column:
    """(line, w) of each line with a cue, alone and with the lines near it."""
    cues = F.filter(F.transform(lines, lambda x, k: F.struct(k.alias("line"), x.alias("text"))), lambda r: has_cue(r["text"]))
    both = lambda r: F.array_distinct(F.array(r["text"], _near(lines, r["line"])))
    return F.flatten(F.transform(cues, lambda r: F.transform(both(r), lambda t: F.struct(r["line"].alias("line"), words(t).alias("w")))))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(digest, line, w): words of the paragraphs around each line with a cue, by the digest of the text; copies give the same rows."""
    # one expression: the lines are not copied for each paragraph
    units = docs.where(has_cue(F.col("text"))).select(digest_of(F.col("text")).alias("digest"), F.explode(_let(_lines(F.col("text")), _around)).alias("unit"))
    return units.select("digest", "unit.line", "unit.w")


def needed(templates: list[tuple[list[str], list[str]]], least: float) -> list[str]:
    """Strings of which a lower-case text has one wherever it shares ``least`` of a template's pairs.

    ``templates`` are (words, pairs). Of each template, words are taken until the pairs
    without any of them are fewer than the share, long words and those taken already first.
    """
    taken: set[str] = set()
    for w, own in sorted(templates, key=lambda t: (len(t[1]), t[0])):
        left = [p.split(" ") for p in own]
        for word in sorted(set(w), key=lambda x: (x not in taken, -len(x), x)):
            if len(left) / len(own) < least:
                break
            fewer = [p for p in left if word not in p]
            if len(fewer) < len(left):
                taken.add(word)
                left = fewer
    return sorted(x for x in taken if not any(y != x and y in x for y in taken))


@dataclass
class Shares:
    """The templates, and which words share at least ``least`` of the pairs of one."""

    templates: list[tuple[list[str], list[str]]]
    least: float

    @classmethod
    def of(cls, spark: SparkSession, least: float) -> Shares:
        return cls([(r["w"], r["pairs"]) for r in _templates(spark).collect()], least)

    def met(self, own: Column) -> Column:
        """Pairs of the templates that ``own`` shares enough of."""
        # the pairs of all templates first, as few texts have any
        known = F.array(*[F.lit(p) for p in sorted({p for _, t in self.templates for p in t})])
        all_of = F.array(*[F.array(*[F.lit(p) for p in t]) for _, t in self.templates])
        return _let(F.array_intersect(own, known), lambda x: F.filter(all_of, lambda t: F.size(F.array_intersect(x, t)) / F.size(t) >= self.least))

    def enough(self, w: Column) -> Column:
        return F.size(_let(w, lambda x: self.met(in_turn(x)))) > 0

    def may_hold(self, text: Column) -> Column:
        """Whether any place of ``text`` can share enough; where not, none does."""
        low = F.lower(text)
        return reduce(lambda a, b: a | b, [low.contains(x) for x in needed(self.templates, self.least)]) & self.enough(words(text))

    def stretches(self, w: Column) -> Column:
        """Words from the first to the last pair that a window of ``w`` shares with a template, and some beside them."""
        step = WINDOW // 2

        def within(i: Column) -> Column:
            def stretch(beside: Column, t: Column) -> Column:
                shared = F.transform(beside, lambda x: F.array_contains(t, x))
                first = F.array_position(shared, True)
                last = F.size(shared) - F.array_position(F.reverse(shared), True) + 1
                start = F.greatest(i + first - MARGIN, F.lit(1)).cast("int")
                return F.slice(w, start, (i + last + 1 + MARGIN - start + 1).cast("int"))

            return _let(in_turn(F.slice(w, i + 1, WINDOW)), lambda x: F.transform(self.met(x), lambda t: stretch(x, t)))

        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - 1 - step, F.lit(0)), F.lit(step))
        return F.array_distinct(F.flatten(F.transform(starts, within)))


def places(docs: DataFrame, shares: Shares) -> DataFrame:
    """(digest, line, w): words of every place of the texts that shares enough pairs with a template; a stretch of words has no line."""

    def every(lines: Column) -> Column:
        def of(w: Column) -> Column:
            alone = F.transform(w, lambda x, k: F.struct(k.alias("line"), x.alias("w")))
            over = F.transform(_let(F.flatten(w), shares.stretches), lambda x: F.struct(F.lit(None).cast("int").alias("line"), x.alias("w")))
            return F.concat(alone, _around(lines), over)

        units = _let(F.transform(lines, words), of)
        return F.filter(units, lambda u: shares.enough(u["w"]))

    text = F.col("text")
    units = docs.where(shares.may_hold(text)).select(digest_of(text).alias("digest"), F.explode(_let(_lines(text), every)).alias("unit"))
    return units.select("digest", "unit.line", "unit.w")


@dataclass
class Model:
    vocabulary: CountVectorizerModel
    families: LogisticRegressionModel
    calibration: LogisticRegressionModel

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` (w, and other columns) with the likeliest family and the calibrated probability of any."""
        ready = self.vocabulary.transform(rows.withColumn("grams", grams(F.col("w"))))
        return _known(self.calibration, _likely(self.families.transform(ready))).drop("grams", "x", "rawPrediction", "probability", "prediction")


def _likely(scored: DataFrame) -> DataFrame:
    """The best known family, and the log odds of all known ones together."""
    p = vector_to_array(F.col("probability"))
    best = F.array_max(F.transform(F.slice(p, 2, len(FAMILIES) - 1), lambda x, k: F.struct(x.alias("p"), k.alias("k"))))
    none = F.greatest(F.element_at(p, 1), F.lit(1e-9))
    odds = F.log(F.greatest(1 - none, F.lit(1e-9)) / none)
    return scored.withColumns({"family": F.element_at(F.array(*[F.lit(f) for f in FAMILIES[1:]]), best["k"] + 1), "odds": odds})


def _known(calibration: LogisticRegressionModel, rows: DataFrame) -> DataFrame:
    slope, shift = float(calibration.coefficients[0]), float(calibration.intercept)
    return rows.withColumn("known", 1 / (1 + F.exp(-(F.col("odds") * slope + shift)))).drop("odds")


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on the templates and a bounded sample of paragraphs."""
    spark = docs.sparkSession
    whole = cut(_templates(spark).coalesce(1))
    # paragraphs of a sample of documents, and those with a cue of another, are the unknown class and the surroundings
    share = min(1.0, sample / max(1, docs.count()))
    lines = docs.where(hashed_sample(share, 37, "doc_id", "text")).select(F.explode(F.split("text", r"\r?\n")).alias("text")).where(F.trim("text") != "")
    near = paragraphs(docs.where(hashed_sample(share, 39, "doc_id", "text"))).select("w")
    corpus = lines.select(words(F.col("text")).alias("w")).unionByName(near).where(F.size("w") > 0).distinct()
    corpus = corpus.orderBy(positive_hash(F.lit(41), F.col("w")), "w").limit(sample).select(F.slice("w", 1, 200).alias("w"))
    # a paragraph with a template's words belongs to its family, not to the unknown
    templates = F.array(*[F.array(*[F.lit(x) for x in r["pairs"]]) for r in whole.collect()])
    close = F.transform(F.array(pairs(F.col("w"))), lambda own: F.exists(templates, lambda t: F.size(F.array_intersect(own, t)) >= CONFIRM * F.size(t)))[0]
    unknown = cut(corpus.where(~close))
    some = unknown.orderBy(positive_hash(F.lit(45), F.col("w")), "w").limit(50).select(F.slice("w", 1, 12).alias("w")).collect()
    around = F.array(*[F.array(*[F.lit(x) for x in r["w"]]) for r in some]) if some else F.array(F.array().cast("array<string>"))
    size = F.greatest(F.lit(2), (F.size("w") * 2 / 3).cast("int"))
    parts = whole.select("family", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1)), lambda i: F.slice("w", i, size))).alias("w"))
    bare = whole.select("family", "w").unionByName(parts).withColumn("held", F.lit(False))
    # held out: a word in seven is left out
    worn = whole.select("family", F.explode(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda j: F.filter("w", lambda _, i: (F.size("w") < 5) | (i % 7 != j)))).alias("w")).withColumn("held", F.lit(True))
    bare = bare.unionByName(worn)
    pick = F.element_at(around, (positive_hash(F.lit(47), F.col("w")) % max(1, len(some)) + 1).cast("int"))
    known = bare.select("family", "w", "held").unionByName(bare.select("family", F.concat(F.slice(pick, 1, 4), "w", F.slice(pick, 5, 8)).alias("w"), "held"))
    other = unknown.select(F.lit(UNKNOWN).alias("family"), "w", (positive_hash(F.lit(43), F.col("w")) % 4 == 3).alias("held"))
    number = F.array_position(F.array(*[F.lit(f) for f in FAMILIES]), F.col("family")) - 1
    # without a corpus there is no unknown paragraph; a row without words keeps the class
    blank = spark.range(2).select(F.lit(UNKNOWN).alias("family"), F.array().cast("array<string>").alias("w"), (F.col("id") == 1).alias("held"))
    rows = cut(known.unionByName(other).unionByName(blank).withColumns({"grams": grams(F.col("w")), "label": number.cast("double")}).coalesce(1))
    # n-grams of templates alone are features; words of the corpus beyond them say nothing of a family
    vocabulary = CountVectorizer(inputCol="grams", outputCol="x", binary=True, vocabSize=1 << 16).fit(whole.withColumn("grams", grams(F.col("w"))))
    ready = vocabulary.transform(rows)
    families = LogisticRegression(featuresCol="x", family="multinomial", regParam=0.001, elasticNetParam=0.5, maxIter=60).fit(ready.where("NOT held"))
    odds = _likely(families.transform(ready.where("held"))).select("odds", F.when(F.col("label") > 0, 1.0).otherwise(0.0).alias("y"))
    odds = VectorAssembler(inputCols=["odds"], outputCol="z").transform(odds.select("odds", "y"))
    calibration = LogisticRegression(featuresCol="z", labelCol="y", regParam=0.001, maxIter=60).fit(odds)
    return Model(vocabulary, families, calibration)


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(digest, line, family, probability, share) of the places that the model gives a family, and the best template's share of pairs.

    A place shares at least ``CONFIRM`` of the pairs of a template, of that family or another.
    """
    model = model or train(docs)
    scored = model.score(places(docs, Shares.of(docs.sparkSession, CONFIRM))).where(F.col("known") >= PROBABLE)
    templates = _templates(docs.sparkSession).groupBy("family").agg(F.collect_list("pairs").alias("templates"))
    of = F.array_max(F.transform("templates", lambda t: F.size(F.array_intersect(F.col("own"), t)) / F.size(t)))
    met = scored.withColumn("own", pairs(F.col("w"))).join(F.broadcast(templates), "family").select("digest", "line", "family", F.col("known").alias("probability"), of.alias("share"))
    return met.groupBy("digest", "line", "family").agg(F.max("probability").alias("probability"), F.max("share").alias("share"))


def report(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Families of each document, comma-joined in order, confirmed by a template; lines with one, and the best probability.

    A family that no line shows, alone or with those near it, but a stretch of words does, counts as one line.
    """
    lines = scan(docs, model).where(F.col("share") >= CONFIRM).groupBy("digest", "line").agg(F.collect_set("family").alias("families"), F.max("probability").alias("probability"))
    # families are few, lines are not
    flags = [F.max(F.array_contains("families", f)).alias(f"f{k}") for k, f in enumerate(FAMILIES[1:])]
    shown = [F.max(F.array_contains("families", f) & F.col("line").isNotNull()) for f in FAMILIES[1:]]
    beside = reduce(lambda a, b: a + b, [(F.max(F.array_contains("families", f)) & ~own).cast("long") for f, own in zip(FAMILIES[1:], shown, strict=True)])
    found = lines.groupBy("digest").agg(*flags, (F.count("line") + beside).alias("n_paragraphs"), F.max("probability").alias("probability"))
    named = F.concat_ws(",", *[F.when(F.col(f"f{k}"), F.lit(f)) for k, f in enumerate(FAMILIES[1:])])
    found = cut(found.select("digest", named.alias("families"), "n_paragraphs", F.round("probability", 4).alias("probability")))
    joined = docs.select("doc_id", digest_of(F.col("text")).alias("digest")).join(sent_if_few(found), "digest", "left")
    return joined.select("doc_id", F.coalesce("families", F.lit("")).alias("families"), F.coalesce("n_paragraphs", F.lit(0)).cast("long").alias("n_paragraphs"), F.coalesce("probability", F.lit(0.0)).alias("probability"))
