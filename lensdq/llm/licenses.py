"""License scans: a trained paragraph classifier over word n-grams, confirmed by comparison with templates.

Everything runs as SQL functions and Spark ML stages. Only labelled lines are learned from:
templates of families, wording of licences outside them, and lines that are no licence.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NONE, UNKNOWN = "none", "unknown"
#: Parts of the labelled lines that are held out in turn to calibrate the cutoff.
FOLDS = 3

#: Short notices of common licences by family; callers may give their own.
TEMPLATES: dict[str, list[str]] = {
    "mit": [
        "License: MIT", "Released under the MIT License.", "This project is licensed under the terms of the MIT license.", "Distributed under the MIT License, see LICENSE for details.", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ],
    "apache-2.0": [
        "License: Apache-2.0", "Licensed under the Apache License, Version 2.0.", "This work is released under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org",
    ],
    "gpl": [
        "License: GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version",
    ],
    "lgpl": [
        "License: LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    ],
    "bsd": [
        "License: BSD-3-Clause", "Released under the BSD 3-Clause License.", "Licensed under the BSD license.", "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "mpl-2.0": ["License: MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Released under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by": ["License: CC-BY-4.0", "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-sa": ["License: CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["License: CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0": ["License: CC0-1.0", "Released into the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0."],
    "proprietary": ["All rights reserved.", "Copyright, all rights reserved. No part may be reproduced without prior written permission of the owner."],
}

#: Wording of licences that belong to no family: they are licence text, and unknown.
UNLISTED = [
    "Licensed under the terms given in the file LICENSE.", "License: custom", "Licence: see the file LICENCE", "Released under our own public license.", "Released under a permissive license.",
    "This work is released under the terms of the license below.", "Distributed under the license of the project.", "The licence of this text is given at the end.", "Use is subject to the license agreement.",
    "SPDX-License-Identifier: other", "SPDX-License-Identifier: ISC", "This software is licensed under a license of its own.", "Available under the community license, version 1.0.", "You may use, copy and distribute this text under the following licence.",
    "This document is under the open license 1.1.", "Licensed to the public under the research licence.", "Licence: OSL-3.0", "License: other", "License: see below", "Licence: own",
    "Released into the public domain under the Unlicense.", "The Unlicense", "WTFPL License", "Licence: commercial", "Licensed under a dual licence.",
    "The Sleepycat License", "Licence: CeCILL-2.1", "License: Ms-PL", "The code is licensed under its own terms.", "This code is licensed.", "Academic Free License", "Python Software Foundation License", "Hippocratic Licence", "Free Art License", "Nethack License", "Sample Licence",
]

#: Lines that are no licence, some of them with words that licences use.
PLAIN = [
    "The weather was fine and the work went well in the morning.", "She renewed her driving licence at the office last week.", "He lost his driving permit after the third accident.", "The minister asked for permission to speak.",
    "All people have the same rights under the law.", "The public library is open to any person from nine to five.", "A general of the army gave the order.", "This program is about the history of the town.",
    "The source of the river lies in the mountains.", "Version 2 of the plan was better than version 1.", "The software was written in a year by two people.", "It is free of charge for children.",
    "This file is part of the collection of letters.", "The foundation of the house was laid in stone.", "See the next chapter for details.", "You can find more about this in the notes below.",
    "The terms of the contract were not kept.", "Redistribution of land was the aim of the law.", "The source code did not compile without changes.", "We use the library for all of our work.",
    "Please read the following page first.", "The author has written several books.", "Copy the first line and go on with the second.", "The domain of the function is the set of real numbers.",
    "Conditions in the north are met by few plants.", "The international meeting was held in June.", "A form was sent to the owner of the car.", "The bank was licensed by the state in 1990.",
    "They released the prisoners in the spring.", "It was distributed to the schools of the district.", "The project is of interest to the public.", "Any later train will be too late.",
    "Er kam mit dem Zug in die Stadt.", "Mit ihr und mit ihm ging es gut.", "Die Frau mit dem Hut war in der Nacht da.", "Das Haus ist mit Gras bedeckt.", "Mit.", "Wir sind mit der Arbeit fertig.",
    "La casa es grande y la general es otra.", "Los derechos de todos son los mismos.", "Le public est venu en grand nombre.", "Les sources de la loi sont dans le code.", "Il mit la version dans le texte.",
    "Stand by.", "It came by train, by car or by boat.", "In general.", "The public.", "This is the first version.", "No part of it was good.", "The identifier of the row is 12.",
]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]++(?:[.-][\p{L}\p{N}]++)*+"), F.lit(0))


def grams(words: Column) -> Column:
    """Words and pairs of neighbouring words."""
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)))
    return F.concat(words, F.array_compact(pairs))


def paragraphs(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_paragraphs, place, paragraph): lines with a letter or digit, counted from 0 over all lines.

    A row whose text is null or has no such line gives one row with null place and paragraph.
    """
    lines = F.filter(F.transform(F.split(F.col(text).cast("string"), "\n"), lambda p, i: F.struct(i.alias("place"), p.alias("paragraph"))), lambda s: s["paragraph"].rlike(r"[\p{L}\p{N}]"))
    kept = df.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.coalesce(lines, F.array().cast("array<struct<place:int,paragraph:string>>")).alias("lines"))
    return kept.select("doc_id", "row", F.size("lines").cast("bigint").alias("n_paragraphs"), F.explode_outer("lines").alias("p")).select("doc_id", "row", "n_paragraphs", "p.place", "p.paragraph")


def _with_grams(rows: DataFrame) -> DataFrame:
    """``rows`` with the distinct grams of their paragraph; the words are a column first, so they are cut once."""
    cut = rows.withColumn("_w", words_of(F.col("paragraph")))
    return cut.withColumn("grams", F.coalesce(F.array_distinct(grams(F.col("_w"))), F.array().cast("array<string>"))).drop("_w")


def _labelled_rows(spark: SparkSession, templates: dict[str, list[str]]) -> DataFrame:
    """(family, line, fold, grams): families are held out whole, the other two classes line by line."""
    rows = [(f, t, i % FOLDS) for i, f in enumerate(sorted(templates)) for t in templates[f]]
    rows += [(f, t, i % FOLDS) for f, lines in ((UNKNOWN, UNLISTED), (NONE, PLAIN)) for i, t in enumerate(lines)]
    return spark.createDataFrame(rows, "family string, line string, fold int").withColumn("grams", F.array_distinct(grams(words_of(F.col("line")))))


def gram_weights(labelled: DataFrame) -> dict[str, float]:
    """What a gram tells about its class: the logarithm of all classes by those that use it.

    One entry for each gram of the labelled lines; grams of a single class weigh most.
    """
    classes = labelled.select("family").distinct().count()
    used = labelled.select("family", F.explode("grams").alias("gram")).distinct().groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return {r["gram"]: math.log(classes / r["n"]) for r in used.collect()}


class LicenseModel:
    """A fitted classifier over a vocabulary of grams, its classes by number, the cutoff, templates and gram weights."""

    def __init__(self, model: LogisticRegressionModel, vocabulary: list[str], classes: list[str], cutoff: float, templates: dict[str, list[str]], weights: dict[str, float]):
        self.model, self.vocabulary, self.classes, self.cutoff, self.templates, self.weights = model, vocabulary, classes, cutoff, templates, weights


def _features(df: DataFrame, vocabulary: list[str]) -> DataFrame:
    return CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features", binary=True).transform(df)


def _trained(rows: DataFrame) -> LogisticRegressionModel:
    """Families weigh alike whatever their lines, ``unknown`` as all families together, ``none`` as all the rest."""
    sizes = {r["family"]: r["n"] for r in rows.groupBy("family").agg(F.count(F.lit(1)).alias("n")).collect()}
    named = max(1, len(sizes.keys() - {NONE, UNKNOWN}))
    share = {f: {NONE: 2.0 * named, UNKNOWN: float(named)}.get(f, 1.0) / n for f, n in sizes.items()}
    weighted = rows.withColumn("weight", F.element_at(F.create_map(*[F.lit(x) for f in sorted(share) for x in (f, share[f])]), F.col("family")))
    return LogisticRegression(weightCol="weight", family="multinomial", regParam=0.002, maxIter=40, tol=1e-5).fit(weighted)


def _best_cutoff(held: list[tuple[float, bool]]) -> float:
    """Halfway between the chances around the cut that parts held-out licence lines best from the others, at least 0.5."""
    at = sorted({p for p, _ in held})
    n = {kind: max(1, sum(k == kind for _, k in held)) for kind in (True, False)}
    cuts = [(a + b) / 2 for a, b in zip([0.0, *at], [*at, 1.0], strict=True)]
    return max((max(0.5, c) for c in cuts), key=lambda c: (sum(p >= c for p, k in held if k) / n[True] - sum(p >= c for p, k in held if not k) / n[False], c))


def fit(spark: SparkSession, templates: dict[str, list[str]] | None = None) -> LicenseModel:
    """Sparse word n-gram logistic regression over the licence families, ``unknown`` and ``none``.

    The labelled lines are the templates, ``UNLISTED`` and ``PLAIN``, some hundred whatever the
    corpus. The cutoff from which a paragraph counts as licence text is calibrated on lines held
    out in ``FOLDS`` parts; a family is held out whole, so its lines stand for licences that no
    template tells of. Without templates every licence is unknown.
    """
    templates = TEMPLATES if templates is None else templates
    classes = [NONE, UNKNOWN, *sorted(templates)]
    labelled = _labelled_rows(spark, templates).coalesce(1).cache()
    vocabulary = sorted(r["gram"] for r in labelled.select(F.explode("grams").alias("gram")).distinct().collect())
    number = F.create_map(*[F.lit(x) for i, f in enumerate(classes) for x in (f, float(i))])
    rows = _features(labelled, vocabulary).withColumn("label", F.element_at(number, F.col("family"))).select("family", "fold", "label", "features").cache()
    held = []
    for fold in range(FOLDS):
        model = _trained(rows.where(F.col("fold") != fold))
        out = model.transform(rows.where(F.col("fold") == fold)).select((1 - vector_to_array("probability")[0]).alias("p"), (F.col("family") != NONE).alias("licence"))
        held += [(r["p"], r["licence"]) for r in out.collect()]  # labelled lines only
    model = LicenseModel(_trained(rows), vocabulary, classes, _best_cutoff(held), templates, gram_weights(labelled))
    rows.unpersist()
    labelled.unpersist()
    return model


def _shapes(spark: SparkSession, model: LicenseModel) -> DataFrame:
    """(guess, shapes): one row per family, each template as its grams with their weights."""
    rows = [(f, t) for f in sorted(model.templates) for t in model.templates[f]]
    lines = spark.createDataFrame(rows, "guess string, line string").select("guess", "line", F.explode(F.array_distinct(grams(words_of(F.col("line"))))).alias("gram"))
    told = spark.createDataFrame(sorted(model.weights.items()), "gram string, weight double")
    one = lines.join(F.broadcast(told), "gram").groupBy("guess", "line").agg(F.collect_list(F.struct("gram", "weight")).alias("shape"))
    return one.groupBy("guess").agg(F.collect_list("shape").alias("shapes"))


def own_weight(own: Column, model: LicenseModel) -> Column:
    """Weight of all grams of a paragraph; those of no labelled line tell of an unlisted licence and weigh most."""
    most = max(model.weights.values(), default=1.0)
    common = [F.struct(F.lit(g).alias("gram"), F.lit(most - w).alias("less")) for g, w in sorted(model.weights.items()) if w < most]
    less = F.aggregate(F.filter(F.array(*common), lambda x: F.array_contains(own, x["gram"])), F.lit(0.0), lambda acc, x: acc + x["less"]) if common else F.lit(0.0)
    return F.size(own) * F.lit(most) - less


def likeness(own: Column, weight: Column, shape: Column) -> Column:
    """Weight of the grams that a paragraph shares with a template, as a share of the lighter of the two."""
    shared = F.aggregate(F.filter(shape, lambda x: F.array_contains(own, x["gram"])), F.lit(0.0), lambda acc, x: acc + x["weight"])
    lighter = F.least(weight, F.aggregate(shape, F.lit(0.0), lambda acc, x: acc + x["weight"]))
    return F.when(lighter > 1e-9, shared / lighter).otherwise(0.0)


def scan_paragraphs(df: DataFrame, model: LicenseModel, doc_id: str = "doc_id", text: str = "text", confirm: float = 0.6) -> DataFrame:
    """(doc_id, row, n_paragraphs, place, paragraph, family, probability, likeness) of licence paragraphs.

    A paragraph whose probability of being licence text reaches the calibrated cutoff gets the
    likeliest family, if a template of it shares at least ``confirm`` of the lighter side's gram
    weights (``likeness``); otherwise ``unknown``. Paragraphs without licence text are left out, but every
    row of ``df`` stays: one without any has a single row with null place.
    """
    rows = _with_grams(paragraphs(df, doc_id, text))
    scored = model.model.transform(_features(rows, model.vocabulary)).withColumn("p", vector_to_array("probability"))
    licence = (1 - F.col("p")[0] >= model.cutoff) & F.col("paragraph").isNotNull()
    chances = F.slice("p", 3, len(model.classes) - 2)
    names = F.array(*[F.lit(f) for f in model.classes[2:]]).cast("array<string>")
    guess = F.try_element_at(names, F.array_position(chances, F.array_max(chances)).cast("int")) if model.templates else F.lit(None).cast("string")
    kept = scored.withColumn("licence", licence).select("doc_id", "row", "n_paragraphs", F.when(F.col("licence"), F.col("place")).alias("place"), F.when(F.col("licence"), F.col("paragraph")).alias("paragraph"), F.when(F.col("licence"), F.col("grams")).alias("grams"), F.when(F.col("licence"), guess).alias("guess"), F.when(F.col("licence"), 1 - F.col("p")[0]).alias("probability"))
    # One row per family.
    compared = kept.join(F.broadcast(_shapes(df.sparkSession, model)), "guess", "left").withColumn("weight", F.when(F.col("grams").isNotNull(), own_weight(F.col("grams"), model)))
    compared = compared.withColumn("likeness", F.array_max(F.transform("shapes", lambda t: likeness(F.col("grams"), F.col("weight"), t))))
    family = F.when(F.col("place").isNotNull(), F.when(F.col("likeness") >= confirm, F.col("guess")).otherwise(UNKNOWN))
    return compared.select(F.col("doc_id").alias(doc_id), "row", "n_paragraphs", "place", "paragraph", family.alias("family"), "probability", "likeness")


def scan(df: DataFrame, model: LicenseModel, doc_id: str = "doc_id", text: str = "text", confirm: float = 0.6) -> DataFrame:
    """(doc_id, n_paragraphs, n_license, n_unknown, families, places) of every row of ``df``.

    ``families`` are the confirmed families by name, comma-joined; ``places`` lists
    place:family of every licence paragraph, ``unknown`` ones too. Null and empty texts have none.
    Rows that repeat an id each keep their row.
    """
    # A row number of a scan holds inside one job; the paragraphs of a row stay in its task, so the
    # grouping combines them before its shuffle.
    found = scan_paragraphs(df, model, doc_id, text, confirm)
    place = F.when(F.col("place").isNotNull(), F.struct("place", "family"))
    grouped = found.groupBy("row", doc_id).agg(F.max("n_paragraphs").alias("n_paragraphs"), F.array_sort(F.collect_list(place)).alias("found"))
    named = F.array_sort(F.array_distinct(F.filter(F.transform("found", lambda s: s["family"]), lambda f: f != UNKNOWN)))
    return grouped.select(
        doc_id, "n_paragraphs", F.size("found").cast("bigint").alias("n_license"), F.size(F.filter("found", lambda s: s["family"] == UNKNOWN)).cast("bigint").alias("n_unknown"),
        F.array_join(named, ",").alias("families"), F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["place"].cast("string"), s["family"])), ",").alias("places"),
    )
