"""Licence scan of paragraphs, in DataFrame operations only.

A multinomial logistic regression over sparse word 1- and 2-grams is trained on licence notices (the
templates below, whole and in cut forms), on notices of no known family and on a bounded sample of
the corpus's own lines. Its classes are the families, ``unknown`` and ``none``. A family is believed above
the largest probability that any has on notices of licences which training never saw (``UNSEEN``). A believed family must then be confirmed by a template: at least ``CONFIRM`` of the
template's word pairs stand in the paragraph. Whatever fails either test is ``unknown``. A confirmed notice that
also names other families (``NAMED``) is a notice of each of them, one row a family; one that extends a known licence to another
(``EXTENDED``: a NonCommercial-ShareAlike work, MIT-0) is ``unknown``, whatever template it holds.

A paragraph is a run of lines up to a blank one, its lines joined, so that wrapped notices and comment
blocks are whole; each of its lines is tried on its own, too. A confirmed line stands for itself; where a
paragraph has none, the whole paragraph counts if it is confirmed, else its lines that look like unknown notices.

Every paragraph has a score. The features are words and pairs of the notices that fewer than one in
``COMMON`` of the sampled lines hold, so a paragraph without any of them has the score of the
intercepts alone, which is ``none`` (its intercept is raised to the largest where it isn't); only the others are looked up one by one.

Null and empty texts have no paragraphs. Rows that repeat doc_id and text count once; rows without a
doc_id come out with a null one. Ties between classes go to the first by name. An empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import scratch

SAMPLE = 3000  # corpus lines in the training, those of least hash
SAMPLED_TEXTS = 1000  # distinct texts, about, that they are drawn from
NONE_WEIGHT = 0.05  # of a corpus line in the training, beside 1 for a notice
COMMON = 100
VOCABULARY = 8192
CONFIRM = 0.6

# Customary wording of licence notices, one list a family.
TEMPLATES = {
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Licensed under the Apache License, Version 2.0.", "Released under the Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Released under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "SPDX-License-Identifier: BSD-2-Clause"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "Content is available under CC BY 3.0."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0.", "Available under CC BY-NC 3.0."],
    "cc-by-nd": ["This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "Licensed under CC BY-ND 4.0."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.", "Dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This work is licensed under the GNU General Public License, version 3.", "Distributed under the GNU GPL v2.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License.", "SPDX-License-Identifier: ISC"],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.", "Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only"],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", "Released under the MIT License.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": ["Copyright (c) the authors. All rights reserved.", "This document is confidential and proprietary. Unauthorized copying is strictly prohibited."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
}
# The licences' short names, as they stand after "License:" and in file headers.
NAMES = {
    "agpl": ["AGPL", "AGPLv3", "AGPL-3.0", "GNU AGPL v3", "GNU Affero General Public License"],
    "apache-2.0": ["Apache 2.0", "Apache-2.0", "Apache License 2.0", "Apache Software License"],
    "bsd": ["BSD", "BSD-2-Clause", "BSD-3-Clause", "New BSD", "Simplified BSD"],
    "cc-by": ["CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0"],
    "cc-by-nd": ["CC BY-ND 4.0", "CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0"],
    "cc0": ["CC0", "CC0 1.0", "CC0-1.0"],
    "gpl": ["GPL", "GPLv2", "GPLv3", "GPL-2.0", "GPL-3.0", "GNU GPL v3", "GNU General Public License"],
    "isc": ["ISC"],
    "lgpl": ["LGPL", "LGPLv2.1", "LGPLv3", "LGPL-2.1", "LGPL-3.0", "GNU LGPL v3", "GNU Lesser General Public License"],
    "mit": ["MIT", "Expat", "X11 MIT"],
    "mpl-2.0": ["MPL 2.0", "MPL-2.0", "Mozilla Public License 2.0"],
    "proprietary": ["Proprietary", "All rights reserved"],
    "unlicense": ["Unlicense", "The Unlicense"],
}
# Words and pairs by which a notice names a family beside the one that it is taken for, and such as make another licence of a known one.
NAMED = {
    "agpl": ["agpl", "agplv3", "affero general"],
    "apache-2.0": ["apache license", "apache licence", "apache 2", "apache software"],
    "bsd": ["bsd license", "bsd licence", "bsd 2", "bsd 3", "license bsd", "or bsd", "bsd or"],
    "cc0": ["cc0"],
    "gpl": ["gpl", "gplv2", "gplv3", "gnu general"],
    "isc": ["isc license", "isc licence", "license isc", "or isc", "isc or"],
    "lgpl": ["lgpl", "lgplv2", "lgplv3", "lesser general"],
    "mit": ["mit license", "mit licence", "license mit", "identifier mit", "or mit", "mit or"],
    "mpl-2.0": ["mpl", "mozilla public"],
    "unlicense": ["unlicense"],
}
EXTENDED = ["nc sa", "nc nd", "noncommercial sharealike", "noncommercial noderivatives", "noncommercial noderivs", "noncommercial no", "noncommercial share", "mit 0"]
# Further sentences of the families' texts.
MORE = {
    "gpl": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."],
    "lgpl": ["This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY. See the GNU Lesser General Public License for more details.", "Licensed under the GNU Lesser General Public License, version 3.", "This work is licensed under the GNU Lesser General Public License, version 3."],
    "mit": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "bsd": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "apache-2.0": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
}
FORMS = ["License: {}", "Licence: {}", "Licensed under {}", "Code: {}", "SPDX-License-Identifier: {}", "Released under the {} license"]
# Notices of licences that training never sees, for the calibration of ``unknown``.
UNSEEN = [
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission is hereby granted to use or copy this program under the terms of the Boost Software License, Version 1.0.",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "Licensed under the Common Development and Distribution License, version 1.0.",
    "Everyone is permitted to copy and distribute verbatim or modified copies of this license document.",
    "This software is released under the Microsoft Public License (Ms-PL).",
    "Distributed under the terms of the PostgreSQL License.",
    "Licensed under the Academic Free License version 3.0.",
    "Released under the zlib license.",
    "License: WTFPL",
    "License: CDDL-1.0",
    "License: OFL-1.1",
    "SPDX-License-Identifier: BSL-1.0",
    "SPDX-License-Identifier: Zlib",
    "This database is made available under the terms of the Community Data License Agreement.",
    "Licensed under the CeCILL-C free software license agreement.",
    "Use of this software is governed by the Business Source License included in the file.",
    "The contents of this file are subject to the Common Public Attribution License Version 1.0.",
]
# Notices of no family above.
UNKNOWN = [
    "Licensed under the terms of the accompanying agreement.",
    "Use of this material is subject to the site's terms and conditions.",
    "Distributed under a custom license, see the enclosed file for details.",
    "This work may be shared for personal use only.",
    "Released under the Example Community License, version 1.",
    "Permission is granted to members of the society for internal use.",
    "License terms are available on request.",
    "Copying is allowed with the written permission of the publisher.",
    "Licensed under the Eclipse Public License, version 2.0.",
    "Released under the Artistic License 2.0.",
    "This file is made available under the Open Data Commons Open Database License.",
    "Subject to the European Union Public Licence, version 1.2.",
]


NO_WORD = "[^\\p{L}\\p{N}]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NO_WORD), lambda w: w != "")


def _pairs(words: Column) -> Column:
    """Adjacent word pairs; a single word is a pair with nothing."""
    after = F.concat(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), F.array(F.lit("")))
    return F.filter(F.zip_with(words, after, lambda a, b: F.concat_ws(" ", a, b)), lambda p: p.contains(" ") & ~p.endswith(" "))


def _features(text: Column) -> Column:
    """The distinct words and word pairs of a text; the words are taken once, bound by the lambda."""
    return F.element_at(F.transform(F.array(_words(text)), lambda w: F.array_distinct(F.concat(w, _pairs(w)))), 1)


def _rows(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small fixed table as literals."""
    one = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names, strict=True)]) for r in rows]))
    return spark.range(1).select(one.alias("r")).select("r.*")


def known_texts() -> list[tuple[str, str]]:
    """(family, template): the notices by which a family is confirmed."""
    whole = [(f, t) for table in (TEMPLATES, MORE) for f, ts in table.items() for t in ts]
    return whole + [(f, form.format(name)) for f, names in NAMES.items() for name in names for form in FORMS]


def notices(spark: SparkSession) -> DataFrame:
    """Training notices (line, label): each text whole, in capitals, with a sentence after it, and halves of the long ones."""
    known = [(t, f) for f, t in known_texts()] + [(t, "unknown") for t in UNKNOWN]
    base = _rows(spark, known, ["line", "label"]).withColumn("w", F.split("line", " "))
    n = F.size("w")
    cut = lambda a, b: F.array_join(F.slice("w", a, F.greatest(b, F.lit(1))), " ")
    half = F.when(n > 14, F.array(cut(F.lit(1), F.floor(n * 0.6).cast("int")), cut(F.ceil(n * 0.4).cast("int"), n))).otherwise(F.array().cast("array<string>"))
    forms = F.concat(F.array("line", F.upper("line"), F.concat(F.col("line"), F.lit(" See the file for details."))), half)
    return base.select("label", F.explode(forms).alias("line"))


def sampled_lines(docs: DataFrame) -> DataFrame:
    """``SAMPLE`` distinct lines of the corpus that hold no plain word of licences, from about ``SAMPLED_TEXTS`` texts."""
    texts = docs.filter("text is not null").select("text", F.xxhash64("text").alias("h"))
    n = texts.agg(F.approx_count_distinct("h").alias("n")).first()[0]
    share = min(1.0, 2 * SAMPLED_TEXTS / max(1, n))
    some = texts.filter(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("text").distinct()
    lines = some.select(F.explode(F.split("text", "\n")).alias("line")).filter(F.col("line").rlike("\\p{L}"))
    plain = lines.filter(~F.lower("line").rlike("licen[sc]|copyright|permission|spdx|creative commons|rights reserved|redistribut|public domain|all rights|\\bcc[0 -]"))
    return plain.distinct().withColumn("h", F.xxhash64("line")).orderBy("h", "line").limit(SAMPLE).select("line")


class Model:
    """Weights per feature and class, the feature words and the calibrated probability."""

    def __init__(self, weights: DataFrame, classes: list[str], intercepts: list[float], words: list[str], believed: float) -> None:
        self.weights, self.classes, self.intercepts, self.words, self.believed = weights, classes, intercepts, words, believed

    def scores(self, rows: DataFrame, marks: DataFrame | None = None) -> DataFrame:
        """Most probable class and its probability of rows with ``key`` (a struct) and ``line``; rows without a feature are left out.

        With ``marks`` (feature) there is also ``own``, those of them that the row has.
        """
        table = self.weights
        if marks is not None:
            table = table.join(marks.withColumn("mark", F.col("feature")), "feature", "full_outer")
        grams = rows.select("key", F.explode(_features(F.col("line"))).alias("feature"))
        held = [F.collect_set("mark").alias("own")] if marks is not None else []
        # a mark outside the vocabulary has no weights and adds nothing
        sums = grams.join(F.broadcast(table), "feature").groupBy("key").agg(*[F.sum(F.element_at("weights", i + 1)).alias(f"_{i}") for i in range(len(self.classes))], *held).filter("_0 is not null")
        logits = F.array(*[F.struct((F.col(f"_{i}") + b).alias("logit"), F.lit(-i).alias("order"), F.lit(c).alias("label")) for i, (c, b) in enumerate(zip(self.classes, self.intercepts, strict=True))])
        best = F.array_max("logits")
        total = F.aggregate("logits", F.lit(0.0), lambda s, x: s + F.exp(x["logit"] - F.col("best.logit")))
        kept = ["own"] if marks is not None else []
        return sums.select("key", *kept, logits.alias("logits")).withColumn("best", best).select("key", F.col("best.label").alias("label"), (1 / total).alias("probability"), *kept)

    def confirmed(self, rows: DataFrame) -> DataFrame:
        """``scores`` with the similarity to the family's nearest template, whether both tests are passed, and the ``families`` named."""
        table = _rows(rows.sparkSession, known_texts(), ["family", "template"]).select("family", F.array_distinct(_marks(F.col("template"))).alias("t"))
        templates = table.groupBy("family").agg(F.collect_set("t").alias("templates"))
        told = _rows(rows.sparkSession, [(m,) for ms in [*NAMED.values(), EXTENDED] for m in ms], ["feature"])
        found = self.scores(rows, table.select(F.explode("t").alias("feature")).unionByName(told).distinct()).filter("label <> 'none'")
        joined = found.join(F.broadcast(templates), found["label"] == templates["family"], "left")
        share = F.array_max(F.transform("templates", lambda t: F.size(F.array_intersect(t, F.col("own"))) / F.size(t)))
        rows = joined.withColumn("similarity", F.round(F.coalesce(share, F.lit(0.0)), 4))
        holds = lambda marks: F.arrays_overlap("own", F.array(*[F.lit(m) for m in marks]))
        rows = rows.withColumn("confirmed", (F.col("similarity") >= CONFIRM) & (F.col("probability") > self.believed) & ~holds(EXTENDED))
        named = F.array_compact(F.array(*[F.when(holds(marks), F.lit(f)) for f, marks in NAMED.items()]))
        both = F.concat(F.array("label"), F.array_except(named, F.array("label")))
        return rows.withColumn("families", F.when(F.col("confirmed"), both).otherwise(F.array(F.lit("unknown"))))


def _marks(text: Column) -> Column:
    """What a template is compared by: its word pairs, or its only word."""
    words = _words(text)
    return F.when(F.size(words) > 1, _pairs(words)).otherwise(words)


def train(docs: DataFrame) -> Model:
    """Fit on the notices and ``SAMPLE`` corpus lines, and calibrate."""
    spark = docs.sparkSession
    data = notices(spark).unionByName(sampled_lines(docs).select("line", F.lit("none").alias("label")))
    data = scratch.table(data.withColumn("features", _features(F.col("line"))).coalesce(2), "notices")
    each = data.select((F.col("label") == "none").cast("int").alias("plain"), F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("plain").alias("plain"), F.sum(1 - F.col("plain")).alias("notice"))
    most = data.filter("label = 'none'").count() // COMMON
    telling = {r["feature"] for r in each.filter(F.col("notice") > 0).filter(F.col("plain") <= most).collect()}  # features of the fixed notices
    words = sorted(f for f in telling if " " not in f)
    telling = sorted(f for f in telling if set(f.split(" ")) & set(words))
    classes = sorted(r[0] for r in data.select("label").distinct().collect())
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")) - 1
    used = data.withColumn("features", F.filter("features", lambda f: f.isin(telling)))
    vectors = CountVectorizer(inputCol="features", outputCol="x", vocabSize=VOCABULARY, minDF=1.0, binary=True).fit(used.filter("label <> 'none'"))
    weight = F.when(F.col("label") == "none", NONE_WEIGHT).otherwise(1.0)
    rows = vectors.transform(used).select("x", place.cast("double").alias("y"), weight.alias("w"))
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", family="multinomial", regParam=1e-4, maxIter=200, standardization=False).fit(rows)
    matrix, intercepts = model.coefficientMatrix.toArray(), model.interceptVector.toArray().tolist()
    if "none" in classes:  # a paragraph without features is none, however few lines the sample has
        intercepts[classes.index("none")] = max(intercepts[classes.index("none")], max(intercepts) + 1e-6)
    table = [(v, matrix[:, i].tolist()) for i, v in enumerate(vectors.vocabulary)]
    weights = scratch.table(spark.createDataFrame(table, "feature string, weights array<double>"), "weights")
    out = Model(weights, classes, intercepts, sorted(v for v in vectors.vocabulary if " " not in v), 0.0)
    unseen = out.scores(_rows(spark, [(t,) for t in UNSEEN], ["line"]).select(F.struct("line").alias("key"), "line"))
    out.believed = unseen.filter("label not in ('unknown', 'none')").agg(F.max("probability")).first()[0] or 0.0
    return out


def units(docs: DataFrame, words: list[str]) -> DataFrame:
    """Lines and paragraphs with one of ``words``: key (doc_id, text_hash, paragraph, first_line, n_lines) and line."""
    clean = F.regexp_replace("text", "\r\n?", "\n")
    rows = docs.filter("text is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), clean.alias("text"))
    asked = F.array(*[F.lit(w) for w in words]).cast("array<string>")
    telling = lambda t: F.arrays_overlap(F.split(F.lower(t), NO_WORD), asked)
    # the test runs on the whole text once, so that only texts with a feature word become rows
    some = rows.filter(telling(F.col("text"))).groupBy("doc_id", "text_hash").agg(F.min("text").alias("text"))
    # the number of blank lines before a line tells its paragraph; the window and the groups keep the partitioning of ``some``
    lines = some.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    before = Window.partitionBy("doc_id", "text_hash").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("filled", F.col("line").rlike("\\S")).withColumn("paragraph", F.count_if(~F.col("filled")).over(before).cast("int")).filter("filled").drop("filled")
    joined = lines.groupBy("doc_id", "text_hash", "paragraph").agg(F.min("i").alias("i"), F.count("*").alias("n_lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda s: s["line"]), " ").alias("line"))
    both = lines.withColumn("n_lines", F.lit(1).cast("long")).unionByName(joined.filter("n_lines > 1")).filter(telling(F.col("line")))
    return both.select(F.struct("doc_id", "text_hash", "paragraph", F.col("i").alias("first_line"), "n_lines").alias("key"), "line")


def scan(docs: DataFrame) -> DataFrame:
    """One row per licence notice and family: doc_id, paragraph, first_line, n_lines, family, and the notice's probability, similarity, confirmed."""
    model = train(docs)
    tried = scratch.table(units(docs, model.words), "units")
    found = scratch.table(model.confirmed(tried).select("key.doc_id", "key.text_hash", "key.paragraph", "key.first_line", "key.n_lines", "families", "probability", "similarity", "confirmed"), "judged")
    whole = Window.partitionBy("doc_id", "text_hash", "paragraph")
    single = F.col("n_lines") == 1
    told = found.withColumn("by_line", F.max(single & F.col("confirmed")).over(whole)).withColumn("by_whole", F.max(~single & F.col("confirmed")).over(whole))
    # a confirmed line; else the confirmed paragraph; else the lines; else the paragraph
    told = told.withColumn("lines", F.max(single).over(whole))
    kept = told.filter(F.when(F.col("by_line"), single & (F.col("confirmed") | ~F.col("by_whole"))).when(F.col("by_whole"), ~single).when(F.col("lines"), single).otherwise(True))
    long = lambda c: F.col(c).cast("long").alias(c)
    return kept.select("doc_id", long("paragraph"), long("first_line"), long("n_lines"), F.explode("families").alias("family"), F.round("probability", 4).alias("probability"), "similarity", "confirmed")
