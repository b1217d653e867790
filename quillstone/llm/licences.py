"""Licence scans by a trained paragraph classifier, with DataFrame functions and MLlib only.

A paragraph's words and word pairs are hashed to a sparse vector, and a multinomial logistic
regression gives it a licence family or the class ``unknown``. It is trained on notices of the
families, each with words left out at random and with foreign words around it, against paragraphs
of the corpus. On examples kept back, a temperature is fitted to its probabilities and the least
probability of a family is set, so that at most one unknown paragraph in a thousand passes. A
prediction is confirmed by comparing the paragraph with the family's own notices.

The words of a text are found and hashed once. Each bucket has one number, the most that it can
lift a family over ``unknown``. A segment whose numbers do not add up to the lift that the least
probability takes is unknown for certain; the regression judges all others.

Of the corpus, ``sampled_docs`` documents are used for training, those with the smallest hash of
their key; the scan itself reads all paragraphs of all documents.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import release, stage_table

SAMPLED_DOCS = 1_000
SAMPLED_PARAGRAPHS = 6_000
VARIANTS = 24  # of each notice
SEGMENT_WORDS, SEGMENT_STEP = 60, 30  # a longer paragraph is scanned in overlapping segments
BUCKETS = 1 << 13
TEMPERATURES = (0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)
UNKNOWN = "unknown"
UNKNOWN_PASSED = 0.001
LEAST_SIMILARITY = 0.5
GRAM = 3

#: Common public notices of each family.
NOTICES = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
    ),
    "Apache": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0.",
        "This software is distributed under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "GPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU GPL v3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "AGPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Content is available under the Creative Commons Attribution License.",
    ),
    "CC-BY-SA": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ),
    "CC-BY-NC": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "Available for non-commercial use under the Creative Commons Attribution-NonCommercial License.",
    ),
    "Public domain": (
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released under CC0 1.0 Universal, public domain dedication.",
    ),
    "All rights reserved": (
        "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
        "All rights reserved.",
        "Copyright (c) 2020 Example Company. All rights reserved.",
    ),
}
#: Paragraphs that use such words and are no notice.
OTHERS = (
    "You need a driving license to rent a car in this country.", "The license plate of the vehicle was reported to the police.",
    "He asked for permission to leave the room.", "The court ruled that the copyright of the song belongs to the author.",
    "Version 2.0 of the program was released in March.", "The warranty covers parts and labour for two years.",
    "The general public was invited to the opening.", "She was granted a licence to practise medicine.",
    "Copy the file and modify the path before you distribute it.", "The software is free to try for thirty days.",
)
CLASSES = (UNKNOWN, *NOTICES)


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, with the hyphens and dots inside them."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[-.][\p{L}\p{N}]+)*"), 0)


def _grams(found: str, n: int) -> Column:
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(found) - n + 1, F.lit(1))), lambda i: i + n - 1 <= F.size(found))
    return F.transform(starts, lambda i: F.concat_ws(" ", F.slice(found, i, n)))


def _hashes(found: str) -> Column:
    return F.transform(found, lambda w: F.hash(w))


def _bucket(hashed: Column) -> Column:
    return F.pmod(hashed, F.lit(BUCKETS))


def _pair_bucket(hashes: str, hashed: Column, i: Column) -> Column:
    """Of the word at ``i`` and its next."""
    return _bucket(F.hash(hashed, F.get(F.col(hashes), i + 1)))


def segments(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(_key, paragraph, first_word, _words): the lines of the texts that have words, long ones in overlapping segments."""
    lines = docs.select(F.col(key).alias("_key"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("paragraph", "_line"))
    worded = lines.select("_key", "paragraph", words(F.col("_line")).alias("_all")).filter(F.size("_all") > 0)
    last = F.greatest(F.size("_all") - SEGMENT_WORDS + SEGMENT_STEP - 1, F.lit(0))
    cut = worded.select("_key", "paragraph", "_all", F.explode(F.sequence(F.lit(0), last, F.lit(SEGMENT_STEP))).alias("first_word"))
    return cut.select("_key", "paragraph", "first_word", F.slice("_all", F.col("first_word") + 1, F.lit(SEGMENT_WORDS)).alias("_words"))


def promising(docs: DataFrame, text: str, key: str, lifts: Column, least: float) -> DataFrame:
    """(_key, paragraph, first_word, last_paragraph, _words): the segments of the lines, and overlapping segments of
    the whole texts that hold words of several lines, whose lifts add up to ``least``. A bucket counts once a segment.

    ``lifts`` has a number for each bucket, no two equal. paragraph and first_word tell where a segment starts.
    """
    lines = docs.select(F.col(key).alias("_key"), F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), words).alias("_lines"))
    none = F.array().cast("array<int>")
    flat = lines.select(
        "_key",
        F.flatten("_lines").alias("_all"),
        F.flatten(F.transform("_lines", lambda found, i: F.array_repeat(i, F.size(found)))).alias("_line"),
        F.flatten(F.transform("_lines", lambda found: F.when(F.size(found) > 0, F.sequence(F.lit(0), F.size(found) - 1)).otherwise(none))).alias("_place"),
    )
    size = F.size("_all")
    hashed = flat.select(
        "*",
        _hashes("_all").alias("_hashes"),
        F.when(size > 0, F.filter(F.sequence(F.lit(0), size - 1), lambda i: F.get("_place", i) == 0)).otherwise(none).alias("_firsts"),
    )

    def cut(start: Column, words: Column) -> Column:
        last = F.greatest(words - SEGMENT_WORDS + SEGMENT_STEP - 1, F.lit(0))
        return F.transform(
            F.sequence(F.lit(0), last, F.lit(SEGMENT_STEP)),
            lambda at: F.struct((start + at).alias("at"), F.least(F.lit(SEGMENT_WORDS), words - at).alias("n")),
        )

    def line_of(place: Column) -> Column:
        return F.get("_line", place)

    single = F.flatten(F.transform("_firsts", lambda first, i: cut(first, F.coalesce(F.get("_firsts", i + 1), size) - first)))
    over = F.filter(cut(F.lit(0), size), lambda s: line_of(s["at"]) < line_of(s["at"] + s["n"] - 1))
    lifted = hashed.select(
        "_key", "_all", "_line", "_place",
        F.transform("_hashes", lambda h: F.get(lifts, _bucket(h))).alias("_lifts"),
        F.transform("_hashes", lambda h, i: F.get(lifts, _pair_bucket("_hashes", h, i))).alias("_pair_lifts"),
        F.concat(single, over).alias("_segments"),
    )

    def lift(s: Column) -> Column:
        own, pairs = F.slice("_lifts", s["at"] + 1, s["n"]), F.slice("_pair_lifts", s["at"] + 1, s["n"] - 1)
        return F.aggregate(F.array_distinct(F.concat(own, pairs)), F.lit(0.0), lambda a, x: a + x)

    likely = F.transform(
        F.filter("_segments", lambda s: lift(s) >= least),
        lambda s: F.struct(
            line_of(s["at"]).alias("paragraph"), F.get("_place", s["at"]).alias("first_word"), line_of(s["at"] + s["n"] - 1).alias("last_paragraph"),
            F.slice("_all", s["at"] + 1, s["n"]).alias("_words"),
        ),
    )
    # The outer form and a filter behind it: no filter on the segments is put before this step, where all would be made twice.
    return lifted.select("_key", F.inline_outer(likely)).filter(F.col("paragraph").isNotNull())


def _vectors(worded: DataFrame) -> DataFrame:
    hashed = worded.withColumn("_hashes", _hashes("_words"))
    pairs = F.slice(F.transform("_hashes", lambda h, i: _pair_bucket("_hashes", h, i)), F.lit(1), F.greatest(F.size("_hashes") - 1, F.lit(0)))
    terms = hashed.withColumn("_terms", F.concat(F.transform("_hashes", _bucket), pairs).cast("array<string>"))
    counted = CountVectorizerModel.from_vocabulary([str(n) for n in range(BUCKETS)], inputCol="_terms", outputCol="_features").setBinary(True)
    return counted.transform(terms).drop("_hashes", "_terms")


def _literal(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    made = F.array(*[F.struct(F.lit(family).alias("family"), F.lit(notice).alias("notice")) for family, notice in rows])
    return spark.range(1).select(F.posexplode(made).alias("number", "_row")).select("number", "_row.*")


def _examples(docs: DataFrame, text: str, key: str, sampled_docs: int, sampled_paragraphs: int) -> DataFrame:
    """(label, kept_back, _words) rows: variants of the notices, and paragraphs of sampled documents."""
    spark = docs.sparkSession
    chosen = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("_chosen")).distinct()
    chosen = stage_table(chosen.withColumn("_draw", F.md5(F.concat_ws(":", F.lit("licences"), "_chosen"))).orderBy("_draw").limit(sampled_docs))
    # At most ``sampled_docs`` keys.
    texts = docs.join(F.broadcast(chosen), docs[key] == chosen["_chosen"], "left_semi")
    lines = segments(texts, text, key).filter(~F.exists("_words", lambda w: w.rlike("licen[cs]|copyright|permi(t|ss)|spdx|reserved")))
    place = F.md5(F.concat_ws(":", "_key", "paragraph", "first_word"))
    lines = lines.withColumn("_place", place).orderBy("_place").limit(sampled_paragraphs)
    order = Window.orderBy("_place")  # over the sample only
    foreign = stage_table(lines.select("_words", (F.row_number().over(order) - 1).alias("number")))
    there = foreign.count()
    others = _literal(spark, [(UNKNOWN, o) for o in OTHERS]).select(F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))).alias("variant"), words(F.col("notice")).alias("_words"))
    unknown = foreign.select("_words", (F.col("number") % 4 == 3).alias("kept_back")).union(others.select("_words", F.col("variant") % 4 == 3))
    notices = _literal(spark, [(f, n) for f, texts in NOTICES.items() for n in texts]).select(
        "number", "family", words(F.col("notice")).alias("_notice"), F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))).alias("variant")
    )
    left = F.filter("_notice", lambda w, i: (F.col("variant") < 2) | (F.pmod(F.xxhash64(w, i, F.col("variant")), F.lit(10)) > 0))
    varied = notices.withColumn("_left", left).withColumn("_partner", (F.col("number") * 31 + F.col("variant")) % max(1, there))
    paired = varied.join(foreign, varied["_partner"] == foreign["number"], "left")
    some = F.when(F.col("variant") % 2 == 0, F.array().cast("array<string>")).otherwise(F.slice(F.coalesce("_words", F.array().cast("array<string>")), F.lit(1), F.col("variant")))
    whole = F.when(F.col("variant") % 3 == 0, F.concat("_left", some)).otherwise(F.concat(some, "_left"))
    known = paired.select(F.col("family"), whole.alias("_words"), (F.col("variant") % 4 == 3).alias("kept_back"))
    every = known.unionByName(unknown.select(F.lit(UNKNOWN).alias("family"), "_words", "kept_back"))
    label = reduce(lambda made, n: made.when(F.col("family") == CLASSES[n], float(n)), range(1, len(CLASSES)), F.when(F.col("family") == UNKNOWN, 0.0))
    examples = stage_table(every.select(label.alias("label"), "kept_back", "_words").repartition(2))
    release(chosen, foreign)
    return examples


@dataclass(frozen=True)
class Scanner:
    regression: LogisticRegressionModel
    temperature: float
    least: float  # probability of a family

    def lifts(self) -> tuple[Column, float]:
        """How far each bucket can lift any family over ``unknown``, and the lift that a family needs.

        Rounded up to numbers that differ from bucket to bucket and whose sums are exact.
        """
        over = self.regression.coefficientMatrix.toArray()
        most = (over[1:] - over[0]).max(axis=0)
        numbers = np.ceil(most * 2.0**16) / 2.0**16 + np.arange(BUCKETS) / 2.0**30
        start = self.regression.interceptVector.toArray()
        least = min(self.least, 1 - 1e-9)
        needed = self.temperature * np.log(least / (1 - least)) - (start[1:] - start[0]).max()
        written = ",".join(repr(float(x)) for x in numbers)
        return F.split(F.lit(written), ",").cast("array<double>"), float(needed) - 1e-6

    def promising(self, docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
        """The segments that are not unknown for certain; see above."""
        return promising(docs, text, key, *self.lifts())

    def predict(self, worded: DataFrame) -> DataFrame:
        """``worded`` with family and probability; what is not sure enough is unknown."""
        scored = self.regression.transform(_vectors(worded)).withColumn("_raw", vector_to_array("_margins"))
        topped = scored.select(*worded.columns, "_raw", F.array_max("_raw").alias("_top"))
        sure = 1 / F.aggregate("_raw", F.lit(0.0), lambda a, m: a + F.exp((m - F.col("_top")) / self.temperature))
        judged = topped.select(*worded.columns, F.array_position("_raw", F.col("_top")).cast("int").alias("_class"), sure.alias("probability"))
        family = F.element_at(F.array(*map(F.lit, CLASSES)), F.col("_class"))
        named = F.struct(F.when(F.col("probability") >= self.least, family).otherwise(UNKNOWN).alias("family"), "probability")
        # A filter on a generated column stays above it, so no paragraph is judged twice.
        return judged.select(*worded.columns, F.inline(F.array(named)))


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", sampled_docs: int = SAMPLED_DOCS, sampled_paragraphs: int = SAMPLED_PARAGRAPHS) -> Scanner:
    """Train and calibrate; see above. Works without any document too, on the notices alone."""
    examples = _examples(docs, text, key, sampled_docs, sampled_paragraphs)
    vectors = stage_table(_vectors(examples).select("label", "kept_back", "_features"))
    regression = LogisticRegression(
        featuresCol="_features", rawPredictionCol="_margins", probabilityCol="_p", predictionCol="_class", family="multinomial", maxIter=30, regParam=1e-4, standardization=False
    ).fit(vectors.filter("NOT kept_back"))
    raw = regression.transform(vectors.filter("kept_back")).select("label", vector_to_array("_margins").alias("m"))
    raw = stage_table(raw)
    losses = [
        F.avg(F.log(F.aggregate(F.transform("m", lambda x: F.exp((x - F.array_max("m")) / t)), F.lit(0.0), lambda a, x: a + x))
              - (F.get("m", F.col("label").cast("int")) - F.array_max("m")) / t)
        for t in TEMPERATURES
    ]
    measured = raw.agg(*losses).first()
    temperature = min(zip(measured, TEMPERATURES))[1]
    odds = F.transform("m", lambda x: F.exp((x - F.array_max("m")) / temperature))
    best_family = F.array_max(F.slice("_odds", 2, len(CLASSES) - 1)) / F.aggregate("_odds", F.lit(0.0), lambda a, x: a + x)
    passed = raw.filter("label = 0").select(odds.alias("_odds")).select(best_family.alias("p"))
    bound = passed.agg(F.percentile("p", F.lit(1 - UNKNOWN_PASSED))).first()[0]
    release(examples, vectors, raw)
    return Scanner(regression, temperature, max(0.5, bound or 0.0))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """A row for each segment with a licence: the key, paragraph (number of its first line, from 0),
    first_word, family, probability, similarity and confirmed.

    Lines are scanned one by one, and segments over several lines too, so that wrapped notices are
    seen whole. A segment over several lines counts if none of its lines has the family by itself.

    The similarity is the share of word trigrams that the segment has in common with a notice of the
    family, over the smaller of the two, at best; from one half on the prediction is confirmed.
    NULL and empty texts have no paragraphs; repeated rows are each scanned; other columns are not
    looked at. A paragraph of more than 60 words is scanned in segments that overlap by 30.
    """
    scanner = fit(docs, text, key, **options)
    judged = stage_table(scanner.predict(scanner.promising(docs, text, key)).filter(F.col("family") != UNKNOWN))
    single, over = judged.filter("paragraph = last_paragraph"), judged.filter("paragraph < last_paragraph")
    lines = single.select(F.col("_key").alias("_there"), F.col("paragraph").alias("_line"), F.col("family").alias("_family")).distinct()
    same = F.col("_key").eqNullSafe(F.col("_there")) & (F.col("family") == F.col("_family"))
    over = over.join(lines, same & F.col("_line").between(F.col("paragraph"), F.col("last_paragraph")), "left_anti")
    found = single.unionByName(over).drop("last_paragraph")
    found = found.withColumn("_grams", F.array_distinct(_grams("_words", GRAM)))
    notices = _literal(docs.sparkSession, [(f, n) for f, texts in NOTICES.items() for n in texts])
    notices = notices.select("family", words(F.col("notice")).alias("_notice")).select("family", F.array_distinct(_grams("_notice", GRAM)).alias("_own"))
    # A row per family, with its few notices.
    notices = notices.groupBy("family").agg(F.collect_list("_own").alias("_all_own"))
    compared = found.join(F.broadcast(notices), "family")

    def near(own: Column) -> Column:
        smaller = F.greatest(F.least(F.size(own), F.size("_grams")), F.lit(1))
        return F.size(F.array_intersect(own, F.col("_grams"))) / smaller

    similarity = F.array_max(F.transform("_all_own", near))
    return compared.select(
        F.col("_key").alias(key), "paragraph", "first_word", "family", "probability", similarity.alias("similarity"),
        (similarity >= LEAST_SIMILARITY).alias("confirmed"),
    )
