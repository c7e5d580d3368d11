"""Licence scanning with a trained paragraph classifier, in DataFrame operations alone.

A paragraph is what stands between blank lines, its lines joined again; a line of signs alone, as in comments,
is blank.  Every paragraph is classified, a long one in pieces that overlap by more than the longest template, so
a notice is whole in one of them.  Words and word pairs, hashed into a sparse vector, go through a multinomial
logistic regression over the licence families, one class for notices of licences that are not listed, and one
for everything else.  A family is accepted above a cut that is calibrated on held-out notices of unlisted licences,
phrases that merely mention licences, and paragraphs of the corpus; below it the notice is ``unknown``.  The
family's templates then confirm the prediction: enough of one template's word pairs must stand in the paragraph, and more
than of any other family's.

The regression is trained on notices made by rule from names and wordings, alone and inside paragraphs of the corpus.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, SQLTransformer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import sample_by_hash, written

OTHER, UNKNOWN = "other", "unknown"
#: Notices by family.
TEMPLATES = (
    ("MIT", "released under the mit license"),
    ("MIT", "licensed under the mit license"),
    ("MIT", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "licensed under the apache license version 2 0"),
    ("Apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("GPL-2.0", "licensed under the gnu general public license version 2"),
    ("GPL-3.0", "licensed under the gnu general public license version 3"),
    ("GPL-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3"),
    ("GPL-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2"),
    ("LGPL", "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3"),
    ("LGPL", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1"),
    ("AGPL", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3"),
    ("LGPL", "licensed under the gnu lesser general public license"),
    ("AGPL", "licensed under the gnu affero general public license"),
    ("BSD", "licensed under the bsd 3 clause license"),
    ("BSD", "licensed under the bsd 2 clause license"),
    ("BSD", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("ISC", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
    ("CC0", "to the extent possible under law the author has waived all copyright and related rights to this work under cc0"),
    ("CC-BY", "licensed under cc by 4 0"),
    ("CC-BY", "licensed under a creative commons attribution 4 0 international license"),
    ("CC-BY-SA", "licensed under cc by sa 4 0"),
    ("CC-BY-SA", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("CC-BY-NC", "licensed under cc by nc 4 0"),
    ("CC-BY-NC", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("MIT", "distributed under mit"),
    ("Apache-2.0", "distributed under apache 2 0"),
    ("GPL-2.0", "distributed under gplv2"),
    ("GPL-2.0", "distributed under the gpl version 2"),
    ("GPL-3.0", "distributed under gplv3"),
    ("GPL-3.0", "distributed under the gpl version 3"),
    ("LGPL", "distributed under the lgpl"),
    ("AGPL", "distributed under the agpl"),
    ("BSD", "distributed under bsd"),
    ("MPL-2.0", "distributed under mpl 2 0"),
    ("MIT", "spdx license identifier mit"),
    ("Apache-2.0", "spdx license identifier apache 2 0"),
    ("GPL-2.0", "spdx license identifier gpl 2 0"),
    ("GPL-3.0", "spdx license identifier gpl 3 0"),
    ("LGPL", "spdx license identifier lgpl"),
    ("AGPL", "spdx license identifier agpl"),
    ("BSD", "spdx license identifier bsd"),
    ("MPL-2.0", "spdx license identifier mpl 2 0"),
    ("ISC", "spdx license identifier isc"),
    ("Unlicense", "spdx license identifier unlicense"),
    ("CC0", "spdx license identifier cc0 1 0"),
    ("CC-BY", "spdx license identifier cc by 4 0"),
    ("CC-BY-SA", "spdx license identifier cc by sa 4 0"),
    ("CC-BY-NC", "spdx license identifier cc by nc 4 0"),
    (UNKNOWN, "everyone is permitted to copy and distribute verbatim or modified copies of this license document"),
    (UNKNOWN, "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    (UNKNOWN, "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
)
#: Names of licences, for notices made by rule.
NAMES = (
    ("MIT", "mit license"), ("MIT", "mit licence"), ("MIT", "expat license"), ("Apache-2.0", "apache license version 2 0"), ("Apache-2.0", "apache 2 0 license"), ("Apache-2.0", "apache license 2 0"),
    ("GPL-2.0", "gnu general public license version 2"), ("GPL-2.0", "gplv2"), ("GPL-2.0", "gnu gpl version 2 only"), ("GPL-3.0", "gnu general public license version 3"), ("GPL-3.0", "gplv3"), ("GPL-3.0", "gnu gpl version 3 or later"),
    ("LGPL", "gnu lesser general public license"), ("LGPL", "lgpl"), ("AGPL", "gnu affero general public license"), ("AGPL", "agpl"), ("BSD", "bsd license"), ("BSD", "bsd 3 clause license"), ("BSD", "new bsd license"),
    ("MPL-2.0", "mozilla public license 2 0"), ("MPL-2.0", "mpl 2 0"), ("ISC", "isc license"), ("Unlicense", "unlicense"), ("CC0", "cc0 1 0 universal"), ("CC0", "creative commons zero"), ("CC-BY", "cc by 4 0"), ("CC-BY", "creative commons attribution 4 0 license"),
    ("CC-BY-SA", "cc by sa 4 0"), ("CC-BY-SA", "creative commons attribution sharealike 4 0 license"), ("CC-BY-NC", "cc by nc 4 0"), ("CC-BY-NC", "creative commons attribution noncommercial 4 0 license"),
    ("GPL-2.0", "gpl 2 0 only"), ("GPL-2.0", "gpl 2 0 or later"), ("GPL-3.0", "gpl 3 0 only"), ("GPL-3.0", "gpl 3 0 or later"), ("LGPL", "lgpl 2 1 only"), ("LGPL", "lgpl 2 1 or later"), ("LGPL", "lgpl 3 0 or later"), ("AGPL", "agpl 3 0 only"), ("AGPL", "agpl 3 0 or later"), ("BSD", "bsd 2 clause"), ("BSD", "bsd 3 clause"),
    (UNKNOWN, "boost software license"), (UNKNOWN, "eclipse public license"), (UNKNOWN, "zlib license"), (UNKNOWN, "artistic license"), (UNKNOWN, "european union public licence"), (UNKNOWN, "open font license"), (UNKNOWN, "python software foundation license"),
    (UNKNOWN, "microsoft public license"), (UNKNOWN, "common development and distribution license"), (UNKNOWN, "educational community license"), (UNKNOWN, "academic free license"), (UNKNOWN, "our own company license"),
)
#: How a notice names its licence.
WORDINGS = ("licensed under the %", "released under the %", "distributed under the terms of the %", "this work is licensed under %", "available under the %", "this project uses the %", "subject to the %", "see the % for details", "license %", "copyright 2020 the authors released under %", "spdx license identifier %", "all content %")
#: What templates end with.
CLOSINGS = ("", "see the file license for details", "all rights reserved", "and comes without warranty of any kind")
#: Phrases that mention licences and are none.
MENTIONS = (
    "he lost his driving license", "a licensed physician must sign", "the licence fee went up", "copyright law is taught here", "permission to enter was denied", "the warranty covers two years",
    "a license plate from ohio", "the licensing board met", "ask permission before you copy", "artistic licence in film", "the fishing license expired", "without permission nobody may leave",
    "redistribution of income", "the public domain of knowledge", "copyright infringement cases rose", "his licence was renewed in may", "the license of the pub", "a licence to fish in the lake",
    "the work was distributed under the supervision of the council", "subject to the terms of the contract between both firms", "the prisoner was released under the condition", "water is available under the bridge", "the film was released under another title",
    "see the file for details", "all content of the jar", "distributed under the tables", "this project uses the old road", "the program is free this evening", "the general public was invited", "version 3 of the plan",
    "anyone could obtain a copy of the report at the office free of charge", "you may not use this room except with a ticket", "the public was free to use the beach and to copy the map", "goods in any form were met with the following conditions", "without permission of the bank no copy may be published", "in no event will the shop be liable for lost coats",
    "the software is slow today", "modify the recipe as you like", "the terms of the treaty", "a creative person with common sense", "the apache helicopter", "free of charge on sundays",
)
#: No notice is longer, in words; a piece has PIECE words, and the next begins before its end.
LONGEST = max(len(x.split()) for _, x in TEMPLATES)
PIECE = 3 * LONGEST
#: Shares of a template's word pairs that confirm a prediction, and that make a paragraph a licence whatever its cut.
CONFIRM, CLEAR = 0.6, 0.8
#: A break between paragraphs.
BREAK = r"\n(?:[^\p{L}\p{N}\n]*\n)+"


def _words(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _pairs(words: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i))))


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, id, paragraph, words): the paragraphs of each whole text in pieces; ``words`` is an array, ``key`` tells the rows of ``docs`` apart."""
    rows = docs.where(F.col(text_col).isNotNull()).select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), BREAK)).alias("paragraph", "block"))
    rows = rows.select("key", "id", "paragraph", _words(F.col("block")).alias("line")).where("line <> ''").select("key", "id", "paragraph", F.split("line", " ").alias("all"))
    step = PIECE - LONGEST
    begins = F.sequence(F.lit(0), F.greatest(F.size("all") - LONGEST - 1, F.lit(0)), F.lit(step))
    return rows.select("key", "id", "paragraph", F.explode(F.transform(begins, lambda b: F.slice("all", b + 1, PIECE))).alias("words"))


def _similarity(rows: DataFrame, family: Column | None = None) -> DataFrame:
    """``rows`` (words, ...) with ``similarity``: the largest share of one template's word pairs that the row has.

    With ``family`` that is of the family's templates, and ``rival`` is the largest share of any other template.
    """
    fixed = []
    for name, text in TEMPLATES:
        words = text.split()
        pairs = dict.fromkeys(map(" ".join, zip(words, words[1:], strict=False)))
        fixed.append(F.struct(F.lit(name).alias("family"), F.array(*map(F.lit, pairs)).alias("pairs")))
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  what ``use`` gets is computed once, however often it stands there
    shares = once(_pairs(F.col("words")), lambda own: F.transform(F.array(*fixed), lambda t: F.struct(t["family"].alias("family"), (F.size(F.array_intersect(t["pairs"], own)) / F.size(t["pairs"])).alias("share"))))
    best = lambda all_, keep: F.round(F.coalesce(F.array_max(F.transform(F.filter(all_, keep), lambda t: t["share"])), F.lit(0.0)), 6)
    if family is None:
        return rows.withColumn("similarity", best(shares, lambda t: F.lit(True)))
    mine = once(F.struct(shares.alias("all"), family.alias("family")), lambda x: F.struct(best(x["all"], lambda t: t["family"] == x["family"]).alias("similarity"), best(x["all"], lambda t: t["family"] != x["family"]).alias("rival")))
    return rows.withColumn("both", mine).select(*rows.columns, "both.similarity", "both.rival")


def examples(spark: SparkSession, prose: DataFrame) -> DataFrame:
    """(family, words, held, prose): notices and mentions, alone and inside ``prose`` (words), and the prose itself; ``held`` ones are kept from training.

    Half of the prose and of the unlisted names, whole names, are held out, and a quarter of the mentions.
    """
    names = spark.createDataFrame(list(NAMES), "family string, name string").withColumn("wording", F.explode(F.array(*map(F.lit, WORDINGS))))
    made = names.select("family", F.expr("replace(wording, '%', name)").alias("notice"), F.col("name").alias("group"))
    templates = spark.createDataFrame(list(TEMPLATES), "family string, template string").withColumn("closing", F.explode(F.array(*map(F.lit, CLOSINGS))))
    templates = templates.select("family", F.trim(F.concat_ws(" ", "template", "closing")).alias("notice"), F.col("template").alias("group"))
    mentions = spark.createDataFrame([(OTHER, x, x) for x in MENTIONS], "family string, notice string, group string")
    every = made.unionByName(templates).unionByName(mentions)
    # dealt by hash: both lists are bounded (fixed phrases, a bounded sample)
    some = prose.groupBy(F.pmod(F.xxhash64("words"), F.lit(97)).alias("place")).agg(F.min("words").alias("around"))
    inside = every.withColumn("place", F.pmod(F.xxhash64("notice"), F.lit(97))).join(some, "place", "left")
    around = F.coalesce("around", F.array().cast("array<string>"))
    words = F.split("notice", " ")
    alone = every.select("family", words.alias("words"), "group")
    behind = inside.select("family", F.concat(F.slice(around, 1, 60), words).alias("words"), "group")
    between = inside.select("family", F.concat(F.slice(around, 1, 30), words, F.slice(around, 31, 60)).alias("words"), "group")
    own = prose.select(F.lit(OTHER).alias("family"), "words", F.array_join("words", " ").alias("group"))
    out = alone.unionByName(behind).unionByName(between).withColumn("prose", F.lit(False)).unionByName(own.withColumn("prose", F.lit(True)))
    return out.select("family", "words", "prose", (F.col("family").isin(OTHER, UNKNOWN) & (F.pmod(F.xxhash64("group"), F.when(F.col("prose") | (F.col("family") == UNKNOWN), 2).otherwise(4)) == 1)).alias("held"))


def fit(docs: DataFrame, sample_rows: int = 2000, features: int = 1 << 14, text_col: str = "text", sample_pieces: int = 5000) -> tuple[PipelineModel, float, float]:
    """The trained pipeline, the cut of families and that of licences, from notices made by rule and paragraphs of ``sample_rows`` documents.

    The documents are picked by a hash of their texts, each text once, and of their pieces ``sample_pieces`` at most, by
    a hash; those with a third of a template's word pairs are left out.  A family's probability must pass what 99 in 100 of the held-out
    rows stay below, and a paragraph is a licence at all above what 999 in 1000 held-out paragraphs of the corpus stay below, but no higher than
    19 in 20 held-out notices of unlisted licences reach, or with CLEAR of a template's pairs.  Null and
    empty texts give no paragraph, and an empty table leaves the made notices alone.
    """
    spark = docs.sparkSession
    sample = sample_by_hash(docs.where(F.col(text_col).isNotNull()), text_col, sample_rows)
    prose = paragraphs(sample.select(F.lit(0).alias("id"), F.col(text_col).alias("text")), "id", "text").select("words").distinct()
    prose = _similarity(prose.orderBy(F.xxhash64("words")).limit(sample_pieces)).where("similarity < 0.34").select("words")
    prose = written(prose, "licence-prose")
    # bounded by the fixed lists and sample_pieces; one partition, so that a training step is one task
    rows = written(examples(spark, prose).coalesce(1), "licence-examples")
    teach = rows.where("not held")
    stages = [
        NGram(n=2, inputCol="words", outputCol="bigrams"),
        SQLTransformer(statement="SELECT *, concat(words, bigrams) AS grams FROM __THIS__"),
        HashingTF(inputCol="grams", outputCol="counts", numFeatures=features, binary=True),
    ]
    names = StringIndexer(inputCol="family", outputCol="label", stringOrderType="alphabetAsc").fit(teach)
    fitted = Pipeline(stages=[*stages, names, LogisticRegression(featuresCol="counts", labelCol="label", regParam=0.0005, maxIter=60, family="multinomial")]).fit(teach)
    model = PipelineModel([*fitted.stages[:-2], fitted.stages[-1]])
    model.names = names.labels
    # notices that another family's template claims don't come to the cut
    held = _similarity(predict(rows.where("held").select("words", "prose", F.col("family").alias("truth")), model), F.col("family")).where(~_claimed(CONFIRM))
    cuts = held.agg(F.percentile_approx("probability", 0.99, 10000).alias("family"), F.percentile_approx(F.when(F.col("prose"), F.col("licence")), 0.999, 10000).alias("licence"), F.percentile_approx(F.when(F.col("truth") == UNKNOWN, F.col("licence")), 0.05, 10000).alias("unlisted")).first()
    return model, max(0.5, cuts["family"] or 0.0), max(0.5, min(cuts["licence"] or 0.0, cuts["unlisted"] or 0.0))


def _claimed(confirm: float) -> Column:
    """Whether another family's template fits, and better than the likeliest family's."""
    return (F.col("rival") >= confirm) & (F.col("rival") > F.col("similarity"))


def predict(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """``rows`` (words, ...) with ``family``, the likeliest that is listed, its ``probability``, and ``licence``, how likely it is any licence."""
    kept = rows.columns
    found = model.transform(rows).select(*kept, vector_to_array("probability").alias("p"))
    pairs = F.array(*(F.struct(F.get("p", i).alias("probability"), F.lit(name).alias("family")) for i, name in enumerate(model.names) if name not in (OTHER, UNKNOWN)))
    other = F.get("p", model.names.index(OTHER)) if OTHER in model.names else F.lit(0.0)
    return found.withColumn("best", F.array_max(pairs)).select(*kept, F.col("best.family").alias("family"), F.col("best.probability").alias("probability"), (1 - other).alias("licence"))


def scan(docs: DataFrame, confirm: float = CONFIRM, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, paragraph, family, probability, similarity, confirmed): the paragraphs that are licence notices.

    Paragraphs count from 0.  A long paragraph gives a row for each family found in its pieces, the surest first found.  ``family``
    is ``unknown`` below the calibrated cut, and where another family's template fits better.  ``similarity`` is the largest share of word pairs
    of one of the likeliest family's templates that the piece has; ``confirmed`` says whether it reaches ``confirm`` above the cut and
    no other template has as much.  Null and empty texts have
    none, null ids pass through, repeated rows repeat theirs, an empty table gives an empty result, and other columns
    are ignored.
    """
    model, cut, licence = fit(docs, text_col=text_col, **how)
    found = predict(paragraphs(docs, id_col, text_col), model).where("licence >= 0.5")
    rows = _similarity(found, F.col("family")).drop("words").where((F.col("licence") >= licence) | (F.greatest("similarity", "rival") >= CLEAR))
    sure = (F.col("probability") >= cut) & ~_claimed(confirm)
    rows = rows.withColumns({"confirmed": sure & (F.col("similarity") >= confirm) & (F.col("similarity") > F.col("rival")), "family": F.when(sure, F.col("family")).otherwise(UNKNOWN)})
    best = F.max(F.struct("confirmed", "similarity", "probability")).alias("best")
    rows = written(rows.groupBy("key", "id", "paragraph", "family").agg(best), "licence-found")
    # an unconfirmed piece of a paragraph tells nothing beside a confirmed one
    some = rows.groupBy("key", "paragraph").agg(F.max("best.confirmed").alias("any")).select(F.col("key").alias("k"), F.col("paragraph").alias("n"), "any")
    rows = rows.join(some, (F.col("key") == F.col("k")) & (F.col("paragraph") == F.col("n"))).where("best.confirmed or not any")
    return rows.select(F.col("id").alias(id_col), "paragraph", "family", F.round("best.probability", 6).alias("probability"), F.col("best.similarity").alias("similarity"), F.col("best.confirmed").alias("confirmed"))
