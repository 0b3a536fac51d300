"""License scans: Dice coefficient of word bigrams against licence templates.

Texts and templates are normalised to lower-case (A-Z) runs of letters and digits. A template is looked for in windows of its own
number of words (the whole text if that is shorter) that begin with one of its bigrams. Size bounds prune before any comparison:
a Dice coefficient of ``t`` needs at least t / (2 - t) of the template's bigrams, so a text with fewer words cannot match, nor can
a window with fewer of them. What passes is compared with the text: Dice over the sets of bigrams of window and template.

The first pass keeps positions of template bigrams only; the second reads the texts of documents with a candidate window.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxelweave.llm.common import ascii_lower, sized, stored
from voxelweave.llm.decontamination import split_words

KEY = ("doc_id", "text_key")

# The public wordings of licence notices and short licences, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies."
    ),
    "LicenseRef-all-rights-reserved": "All rights reserved.",
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def bigrams(words: Column) -> Column:
    """All word pairs in order; none for fewer than two words."""
    return F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))).otherwise(F.array().cast("array<string>"))


def template_table(spark, templates: Mapping[str, str]) -> DataFrame:
    """(licence, size: words, grams: distinct bigrams). Templates are a bounded list that the caller gives."""
    rows = spark.createDataFrame(sorted(templates.items()), "licence string, text string")
    words = rows.select("licence", split_words(ascii_lower(F.col("text"))).alias("words")).where(F.size("words") > 1)
    return words.select("licence", F.size("words").alias("size"), F.array_sort(F.array_distinct(bigrams(F.col("words")))).alias("grams"))


def matches(documents: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """(doc_id, text_key, licence, score, first, last): windows that are similar enough; word positions from 0. They are taken from
    the best on (of equals the longer, then the smaller name, then the earlier) unless they overlap one that was taken."""
    known = stored(template_table(documents.sparkSession, templates), "templates")
    each = known.select("licence", "size", F.size("grams").alias("n_grams"), F.explode("grams").alias("gram")).withColumn("h", F.xxhash64("gram"))
    keys = F.broadcast(each.select("h").distinct())  # bounded by the given templates
    texts = documents.select("doc_id", F.xxhash64("text").alias("text_key"), split_words(ascii_lower(F.col("text"))).alias("words"))
    hashes = F.when(F.size("words") > 1, F.transform(F.sequence(F.lit(0), F.size("words") - 2), lambda i: F.xxhash64(F.concat_ws(" ", F.get(F.col("words"), i), F.get(F.col("words"), i + 1)))))
    hits = stored(texts.select(*KEY, F.size("words").alias("n_words"), F.posexplode(hashes).alias("pos", "h")).join(keys, "h").select(*KEY, "n_words", "pos", "h").distinct(), "bigram_hits")

    least = F.ceil(F.col("n_grams") * threshold / (2 - threshold) - 1e-9)
    of = hits.join(F.broadcast(each.select("licence", "size", "n_grams", "h")), "h").where(F.col("n_words") - 1 >= least)
    enough = of.groupBy(*KEY, "licence").agg(F.count_distinct("h").alias("n"), F.first("n_grams").alias("n_grams")).where(F.col("n") >= least).select(*KEY, "licence")
    enough = stored(enough, "enough")
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])
    near = of.join(sized(enough), same(of, enough) & (of["licence"] == enough["licence"]), "left_semi")
    # Windows begin at hits; the number of hits ahead bounds the overlap. Frames are as long as the template, by position.
    start = F.when(F.col("n_words") < F.col("size"), F.lit(0)).otherwise(F.least("pos", F.col("n_words") - F.col("size")))
    order = Window.partitionBy(*KEY, "licence").orderBy("pos")
    longest = max([2, *(r[0] for r in known.agg(F.max("size")).collect() if r[0])])
    ahead = F.size(F.filter(F.collect_list("pos").over(order.rangeBetween(-longest, longest)), lambda p: (p >= F.col("start")) & (p <= F.col("start") + F.col("size") - 2)))
    windows = near.withColumn("start", start).withColumn("bound", ahead).where(F.col("bound") >= least).select(*KEY, "licence", "size", "start").distinct()
    candidates = stored(windows, "licence_windows")
    suspects = stored(candidates.select(*KEY).distinct(), "suspects")
    keyed = documents.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    plain = keyed.join(sized(suspects), same(keyed, suspects), "left_semi").dropDuplicates([*KEY]).select(*KEY, split_words(ascii_lower(F.col("text"))).alias("words"))
    per_text = candidates.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("licence", "start", "size"))).alias("found"))
    cut = plain.join(per_text, same(plain, per_text)).select(plain["doc_id"], plain["text_key"], F.size("words").alias("n_words"), F.explode(F.transform("found", lambda c: F.struct(c["licence"].alias("licence"), c["start"].alias("first"), F.slice("words", c["start"] + 1, c["size"]).alias("w")))).alias("c"))
    compared = cut.select(*KEY, "c.licence", "c.first", F.array_distinct(bigrams(F.col("c.w"))).alias("own"), F.size("c.w").alias("length")).join(F.broadcast(known), "licence")
    dice = 2 * F.size(F.array_intersect("own", "grams")) / (F.size("own") + F.size("grams"))
    alike = compared.withColumn("score", dice).where(F.col("score") >= threshold)
    order = F.struct((-F.col("score")).alias("worse"), (-F.col("length")).alias("shorter"), "licence", "first", "score", "length")
    listed = alike.groupBy(*KEY).agg(F.array_sort(F.collect_list(order)).alias("all"))

    def take(taken: Column, m: Column) -> Column:
        met = F.exists(taken, lambda o: (o["first"] < m["first"] + m["length"]) & (m["first"] < o["first"] + o["length"]))
        return F.when(met, taken).otherwise(F.concat(taken, F.array(m)))

    kept = listed.select(*KEY, F.explode(F.aggregate("all", F.slice("all", 1, 0), take)).alias("m"))
    return kept.select(*KEY, "m.licence", "m.score", "m.first", (F.col("m.first") + F.col("m.length") - 1).alias("last"))


def scan(documents: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """Rows (doc_id, n_licences, licences, spans, best_score), one for each row of ``documents``.

    licences: names joined by commas in the order of position, spans: ``first-last`` word positions likewise; empty strings
    and score 0 without a match. Only doc_id and text are read, so further columns may have any name. Null or empty
    texts have no match. Repeated rows come back as often as given; a null doc_id is kept. A template of fewer than two words
    is ignored; no templates or an empty table give no matches or rows.
    """
    found = matches(documents, templates, threshold)
    per_text = stored(
        found.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("first", "last", "licence"))).alias("m"), F.max("score").alias("best_score"))
        .select(*KEY, F.size("m").cast("long").alias("n_licences"), F.array_join(F.col("m.licence"), ",").alias("licences"), F.array_join(F.transform("m", lambda s: F.concat_ws("-", s["first"], s["last"])), ",").alias("spans"), "best_score"),
        "licences",
    )
    keyed = documents.select("doc_id", F.xxhash64("text").alias("text_key"))
    joined = keyed.join(sized(per_text), keyed["doc_id"].eqNullSafe(per_text["doc_id"]) & (keyed["text_key"] == per_text["text_key"]), "left")
    return joined.select(keyed["doc_id"], F.coalesce("n_licences", F.lit(0).cast("long")).alias("n_licences"), F.coalesce("licences", F.lit("")).alias("licences"), F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("best_score", F.lit(0.0)).alias("best_score"))


def oracle_sql(templates: Mapping[str, str] = TEMPLATES, threshold: float = 0.8) -> str:
    """Every window of a template's length that begins with one of its bigrams, compared outright."""
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(templates.items()))
    words = lambda t: rf"regexp_extract_all(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    pairs = lambda w: f"list_distinct(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"
    apart = lambda w: f"list_filter({w}[2:], lambda o: o.first >= {w}[1].first + {w}[1].length OR {w}[1].first >= o.first + o.length)"
    return f"""
WITH RECURSIVE tw AS (SELECT licence, {words('t')} AS w FROM (VALUES {values}) v(licence, t)),
tp AS (SELECT licence, len(w) AS size, {pairs('w')} AS grams FROM tw WHERE len(w) > 1),
tg AS (SELECT licence, size, grams, unnest(grams) AS gram FROM tp),
d AS (SELECT row_number() OVER () AS r, doc_id, {words('text')} AS w FROM documents),
g AS (SELECT r, unnest(range(1, len(w))) AS pos, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM d),
st AS (SELECT DISTINCT g.r, licence, size, grams, CASE WHEN len(w) < size THEN 1 ELSE least(pos, len(w) - size + 1) END AS first FROM g JOIN tg USING (gram) JOIN d ON d.r = g.r),
wn AS (SELECT st.r, licence, first, grams, w[first:first + size - 1] AS x FROM st JOIN d ON d.r = st.r),
ow AS (SELECT *, {pairs('x')} AS own FROM wn),
sc AS (SELECT r, licence, first - 1 AS first, len(x) AS length, 2 * len(list_intersect(own, grams))::DOUBLE / (len(own) + len(grams))::DOUBLE AS score FROM ow),
al AS (SELECT r, list({{'licence': licence, 'first': first, 'length': length, 'score': score}} ORDER BY score DESC, length DESC, licence, first) AS l FROM sc WHERE score >= {threshold}::DOUBLE GROUP BY r),
tk AS (SELECT r, l[1] AS m, {apart('l')} AS rest FROM al UNION ALL SELECT r, rest[1], {apart('rest')} FROM tk WHERE len(rest) > 0),
kp AS (SELECT r, m.licence AS licence, m.first AS first, m.length AS length, m.score AS score FROM tk),
ag AS (SELECT r, count(*) AS n, string_agg(licence, ',' ORDER BY first, first + length, licence) AS licences, string_agg(first || '-' || (first + length - 1), ',' ORDER BY first, first + length, licence) AS spans, max(score) AS best FROM kp GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_licences, coalesce(licences, '') AS licences, coalesce(spans, '') AS spans, coalesce(best, 0) AS best_score FROM d LEFT JOIN ag USING (r)
"""
