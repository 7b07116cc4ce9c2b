"""License scans: a trained paragraph classifier, with an unknown class, confirmed by comparison with templates.

A paragraph is a line of the text together with those that it is wrapped to: a line that does not end a sentence goes on in the
next, unless that is blank; marks of comments before it are left out. Its words and word pairs (those that occur in the training table) are the sparse
features of a multinomial logistic regression over licence families and ``unknown``. The training table is made
from the templates below, by dropping and cutting words, and from other prose; a part of it is held out to calibrate
the least probability at which a family is believed. A believed family is confirmed where enough of the paragraph's
word pairs, or of a template's, are common to the paragraph and a template of that family.

Native: DataFrame expressions and JVM estimators only."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from markloom.llm.common import least_by_hash, let

UNKNOWN = "unknown"

# Wording of public licence notices and grants, by family.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license. See LICENSE in the project root for license information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache", "Licensed under the Apache License, Version 2.0."),
    ("Apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL", "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    ("LGPL", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD", "Licensed under the BSD 3-Clause License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("MPL", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL", "Licensed under the Mozilla Public License, Version 2.0."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("Proprietary", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher."),
    ("Proprietary", "Copyright. All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."),
]
OTHER = [
    "The driver must carry a valid license and the version of the form that the office has issued.",
    "She worked for the general public and was granted permission to use the library.",
    "The committee published the terms of the agreement under the new law.",
    "A copy of the letter was distributed to any person who asked for it.",
    "The source of the river is in the mountains, and its form changes with the season.",
    "Free of charge, the museum opens its doors to all visitors on the first of the month.",
    "The software was sold without warranty, and the buyer took the company to court.",
    "In the hope that it will be useful, he wrote down all that he had seen.",
    "The conditions of the contract were met, and the work was done in time.",
    "Fishing license fees rose again, version after version of the bill having failed.",
    "Il a été publié sous la direction de la commission, et la licence est le premier grade.",
    "Die Lizenz wurde unter der Leitung des Amtes erteilt, und das Werk ist bekannt.",
    "La obra fue publicada bajo la dirección de la comisión, y la licencia es el primer grado.",
    "See the file for more details about the project and how to build it from source.",
    "The rights of the workers were discussed at the public meeting of the foundation.",
    "You may obtain the form at the office, and you may not use it for any other purpose.",
]
VARIANTS = 24
HELD_OUT = 4  # every so-manieth variant calibrates and is not trained on
PROSE_SAMPLE = 1000  # different paragraphs of the corpus taken as unknown, by least hash
FALSE_ACCEPT = 0.005  # share of held-out unknown paragraphs that may pass the calibrated threshold
CONFIRM = 0.5


def words_of(text: Column) -> Column:
    """Lower-case words of letters, digits and inner points, pluses and dashes."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+(?:[.+\-][\p{L}\p{N}]+)*)"), F.lit(1))


def pairs_of(words: Column) -> Column:
    """Pairs of words that follow each other; none where there are fewer than two words."""
    return F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1))
    )


def features_of(words: Column) -> Column:
    """Words and word pairs; a paragraph of one word has that word alone."""
    return F.when(F.size(words) < 2, words).otherwise(F.concat(words, let(words, pairs_of)))


def training_table(spark: SparkSession, prose: DataFrame) -> DataFrame:
    """(family, words, held_out): templates and other prose, whole, with words dropped, and cut to a part; and
    paragraphs of the corpus that have no word pair of a template, as unknown."""
    base = spark.createDataFrame([*TEMPLATES, *((UNKNOWN, t) for t in OTHER)], "family string, text string")
    varied = base.select("family", "text", words_of(F.col("text")).alias("w"), F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))).alias("v"))
    dropped = F.filter(
        "w", lambda x, i: (F.col("v") % 3 == 0) | (F.pmod(F.xxhash64(x, i, F.col("v")), F.lit(10)) > F.col("v") % 3)
    )
    n = F.size("w")
    # odd variants of long texts: a window of a quarter, a half or three quarters of the words
    share = (F.floor(F.col("v") / 2) % 3 + 1) / 4
    first = F.pmod(F.xxhash64("text", "v"), F.greatest(F.floor(n * (1 - share)), F.lit(1)).cast("bigint")).cast("int")
    cut = F.when((F.col("v") % 2 == 1) & (n > 12), F.slice(dropped, first + 1, F.ceil(n * share).cast("int"))).otherwise(dropped)
    made = varied.select("family", cut.alias("words"), (F.col("v") % HELD_OUT == 1).alias("held_out"))
    known = F.array(*(F.lit(p) for p in _template_pairs()))
    n = prose.agg(F.approx_count_distinct("par").alias("n")).first()["n"]
    bound = min(1 << 40, 3 * PROSE_SAMPLE * (1 << 40) // max(n, 1))  # leaves some 3,000 different paragraphs to choose from
    few = prose.select("par").where(F.pmod(F.xxhash64("par"), F.lit(1 << 40)) < bound).distinct()
    other = (
        least_by_hash(few, ["par"], PROSE_SAMPLE, 0).select(F.xxhash64("par").alias("h"), words_of(F.col("par")).alias("words"))
        .where(F.size("words") > 0)
        .where(~F.arrays_overlap(let(F.col("words"), pairs_of), known))
        .select(F.lit(UNKNOWN).alias("family"), "words", (F.pmod("h", F.lit(HELD_OUT)) == 1).alias("held_out"))
    )
    return made.unionByName(other)


def _template_pairs() -> list[str]:
    """Word pairs of the templates that tell of a licence: those with a marked word."""
    import re

    marked = re.compile(r"licen[sc]|gnu|copyright|cc$|cc0|warrant|permission|redistribut|mozilla|apache|creative|rights")
    out = set()
    for _, text in TEMPLATES:
        w = re.findall(r"[^\W_]+(?:[.+\-][^\W_]+)*", text.lower())
        out |= {f"{a} {b}" for a, b in zip(w, w[1:], strict=False) if marked.search(a) or marked.search(b)}
    return sorted(out)


class LicenseModel:
    """Fitted vocabulary and regression, the families by label, and the calibrated threshold."""

    def __init__(self, vocabulary, regression, families: list[str], threshold: float):
        self.vocabulary, self.regression, self.families, self.threshold = vocabulary, regression, families, threshold

    def classify(self, paragraphs: DataFrame) -> DataFrame:
        """``paragraphs`` (with ``words``) and the most likely ``family`` with its ``probability``; below the threshold
        the family is unknown."""
        with_features = paragraphs.withColumn("_features", features_of(F.col("words")))
        scored = self.regression.transform(self.vocabulary.transform(with_features))
        named = F.element_at(F.array(*(F.lit(f) for f in self.families)), F.col("_label").cast("int") + 1)
        p = F.array_max(vector_to_array("_p"))
        believed = F.when((named != UNKNOWN) & (p >= self.threshold), named).otherwise(UNKNOWN)
        return scored.select(*paragraphs.columns, believed.alias("family"), p.alias("probability"))


def fit(spark: SparkSession, prose: DataFrame) -> LicenseModel:
    """Train on the table above with at most PROSE_SAMPLE paragraphs of ``prose`` (par) as further unknown ones."""
    table = training_table(spark, prose).withColumn("_features", features_of(F.col("words"))).cache()
    train, held = table.where(~F.col("held_out")), table.where("held_out")
    vocabulary = CountVectorizer(inputCol="_features", outputCol="_x", binary=True, vocabSize=1 << 16).fit(
        train.where(F.col("family") != UNKNOWN)
    )
    index = StringIndexer(inputCol="family", outputCol="_y", stringOrderType="alphabetAsc").fit(train)
    # each family weighs the same, and all families together as much as what is unknown
    size = F.count(F.lit(1)).over(Window.partitionBy("family"))
    weighted = train.withColumn("_weight", F.when(F.col("family") == UNKNOWN, float(len(index.labels) - 1)).otherwise(1.0) * 1000 / size)
    regression = LogisticRegression(
        featuresCol="_x", labelCol="_y", predictionCol="_label", probabilityCol="_p", rawPredictionCol="_raw",
        family="multinomial", regParam=0.001, maxIter=60, weightCol="_weight",
    ).fit(index.transform(vocabulary.transform(weighted)))
    model = LicenseModel(vocabulary, regression, list(index.labels), 0.0)
    checked = model.classify(held.select(F.col("family").alias("truth"), "words"))
    wrong = checked.where((F.col("truth") == UNKNOWN) & (F.col("family") != UNKNOWN)).select("probability").collect()
    n = held.where(F.col("family") == UNKNOWN).count()
    allowed = int(FALSE_ACCEPT * n)
    scores = sorted((r["probability"] for r in wrong), reverse=True)
    model.threshold = max(0.5, scores[allowed] + 1e-9 if len(scores) > allowed else 0.0)
    table.unpersist()
    return model


#: A line end inside a paragraph: behind a line that ends no sentence (with nine blanks after it at most), before one that is not
#: blank, with its mark of a comment. It starts with the line end, which is rare, so that most characters cost little.
WRAP = r"(?:\r\n|[\n\r])(?<=[^\s.!?:;][ \t]{0,9}(?:\r\n|[\n\r]))[ \t]*(?:(?:#+|//+|\*+|;+|--|>+)[ \t]+)?(?=\S)"


def pars_of(text: Column) -> Column:
    """The paragraphs of a text, those of white space too, which ``\\S`` tells apart."""
    return F.split(F.regexp_replace(text, WRAP, " "), r"\R")


def paragraphs_of(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keys``, par_no, par: the paragraphs of each text that hold more than white space. Null texts have none."""
    return docs.select(*keys, F.posexplode(pars_of(F.col("text"))).alias("par_no", "par")).where(F.col("par").rlike(r"\S"))


def scan(docs: DataFrame, model: LicenseModel, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keys`` of the row, par_no, family, probability, confirmed for every paragraph believed to be of a licence
    family.

    ``confirmed``: for some template of the family, at least half of the paragraph's word pairs or of the template's
    are common to both. Null, empty and white-space texts have no paragraphs and no rows; repeated rows are scanned
    each; very long texts are many paragraphs, a very long line or run of wrapped lines is one; other columns are not used. An empty table
    gives no rows."""
    spark = docs.sparkSession
    pars = paragraphs_of(docs, keys)
    found = model.classify(pars.select(*keys, "par_no", words_of(F.col("par")).alias("words"))).where(F.col("family") != UNKNOWN)
    templates = (
        spark.createDataFrame(TEMPLATES, "family string, text string")
        .select("family", let(words_of(F.col("text")), pairs_of).alias("pairs"))
        .groupBy("family").agg(F.collect_list(F.col("pairs")).alias("templates"))
    )
    with_pairs = found.withColumn("own", F.array_distinct(let(F.col("words"), pairs_of)))

    def common(t: Column) -> Column:
        shared = F.size(F.array_intersect(F.col("own"), t))
        return F.greatest(shared / F.greatest(F.size("own"), F.lit(1)), shared / F.greatest(F.size(t), F.lit(1)))

    best = F.array_max(F.transform("templates", common))
    return (
        with_pairs.join(F.broadcast(templates), "family")
        .select(*keys, "par_no", "family", "probability", (best >= CONFIRM).alias("confirmed"))
    )


def op4_license_scans(spark, sf_dir: str) -> DataFrame:
    """Per row of documents: doc_id, n_paragraphs, n_license (believed), n_confirmed, families (confirmed, sorted,
    comma-joined). Repeated rows have the same paragraphs, so each paragraph of an id and text is counted once and
    every row of them gets the result; a null id is an id like others."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.xxhash64("doc_id", "text").alias("_digest"), "*")
    keys = ("_id", "_digest")
    n = F.size(F.filter(pars_of(F.col("text")), lambda p: p.rlike(r"\S")))
    counted = docs.select(*keys, "doc_id", F.when(F.col("text").isNull(), 0).otherwise(n).cast("long").alias("n_paragraphs"))
    per_row = (
        scan(docs, fit(spark, paragraphs_of(docs)), keys)
        .select(*keys, "par_no", "family", "confirmed").distinct()
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_license"),
            F.count_if("confirmed").alias("n_confirmed"),
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"),
        )
    )
    return counted.join(per_row, list(keys), "left").select(
        "doc_id", "n_paragraphs", F.coalesce("n_license", F.lit(0)).alias("n_license"),
        F.coalesce("n_confirmed", F.lit(0)).alias("n_confirmed"), F.coalesce("families", F.lit("")).alias("families"),
    )
