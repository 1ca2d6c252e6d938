"""License scans by diagonal voting.

The word k-grams of every whole text are hashed and joined to the positions at which the license templates have them.
A hit votes for its offset diagonal (document position less template position) of one document and template; votes
are summed by diagonal, neighbouring diagonals (a word put in or left out) are merged, and a merged run is verified:
the template words that it covers, word for word, must make up MIN_COVER of the template.

Only DataFrame functions are used. The template table is a constant of some thousand rows, so it is broadcast; its
hashes also filter the k-grams in the row, before any row is made of them, and a hit compares the words themselves.
Texts are read once: what the row needs later is written to the shared folder, texts left out.

Defined cases: a null or empty text has no words and no labels; a document without base places has null first_word
and last_word; repeated rows and rows without doc_id are scanned each on its own; texts of any length are scanned
whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

K, MIN_COVER, MAX_SHIFT = 3, 0.8, 2
#: Words of a lower-cased text.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The phrases and labels of the base.
BASE = [("mit", ["mit", "license"]), ("apache", ["apache", "license"]), ("gpl", ["general", "public", "license"])]
# Wording of public licenses and license notices, lower case, words only.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "licensed under the bsd license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("cc-by", "this work is licensed under the creative commons attribution 4 0 international license to view a copy of this license visit http creativecommons org licenses by 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
]


def _grams(spark: SparkSession) -> DataFrame:
    """(hash, gram, template, label, at, length): every k-gram of every template."""
    rows = [(n, label, i, " ".join(w[i : i + K]), len(w)) for n, (label, text) in enumerate(TEMPLATES) for w in [text.split()] for i in range(len(w) - K + 1)]
    d = spark.createDataFrame(rows, "template int, label string, at int, gram string, length int")
    return d.withColumn("hash", F.xxhash64("gram"))


def scan(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    spans: (label, start, words, cover) of each verified span of the method.
    """
    spark = docs.sparkSession
    grams = _grams(spark)
    known = ", ".join(f"{r.hash}L" for r in grams.select("hash").distinct().collect())  # of the constant templates
    text = F.coalesce(F.col("text"), F.lit(""))
    lower = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))  # A-Z only
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_extract_all(lower, F.lit(WORDS), F.lit(0)).alias("w"))
    gram = "concat_ws(' ', " + ", ".join(f"get(w, i + {k})" for k in range(K)) + ")"
    hits = f"filter(transform(sequence(0, size(w) - {K}), i -> struct(i AS pos, xxhash64({gram}) AS hash)), x -> x.hash IN ({known}))"
    d = d.withColumn("hits", F.expr(f"get(transform(array(w), w -> CASE WHEN size(w) >= {K} THEN transform({hits}, x -> struct(x.pos AS pos, x.hash AS hash, array_join(slice(w, x.pos + 1, {K}), ' ') AS gram)) END), 0)"))
    places = [f"transform(filter(sequence(0, size(w) - 1), i -> {' AND '.join(f"coalesce(get(w, i + {k}) = '{x}', false)" for k, x in enumerate(words))}), i -> struct('{label}' AS label, CAST(i AS BIGINT) AS at))" for label, words in BASE]
    d = d.withColumn("base", F.expr(f"get(transform(array(w), w -> CASE WHEN array_contains(w, 'license') THEN concat({', '.join(places)}) END), 0)"))
    per_doc = materialize(d.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("w").cast("long").alias("n_words"), "base", "hits"), "license-hits")

    votes = per_doc.where("size(hits) > 0").select("row", F.explode("hits").alias("hit"))
    votes = votes.join(F.broadcast(grams), (F.col("hit.hash") == F.col("hash")) & (F.col("hit.gram") == F.col("gram")))
    tally = votes.groupBy("row", "template", "label", "length", (F.col("hit.pos") - F.col("at")).alias("diagonal")).agg(F.array_sort(F.collect_set("at")).alias("ats"), F.min("hit.pos").alias("pos"))
    # a diagonal's votes are at most the template's k-grams; neighbours within MAX_SHIFT are one occurrence
    by = Window.partitionBy("row", "template").orderBy("diagonal")
    tally = tally.withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(by) > MAX_SHIFT).cast("int")).withColumn("run", F.sum(F.coalesce("new", F.lit(1))).over(by))
    runs = tally.groupBy("row", "template", "label", "length", "run").agg(F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"), F.min("pos").alias("start"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + K - 1)))))
    spans = runs.withColumn("cover", covered / F.col("length")).where(F.col("cover") >= MIN_COVER)
    found = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("label", F.col("start").cast("long").alias("start"), F.col("length").alias("words"), "cover"))).alias("spans"))

    out = per_doc.drop("hits").join(found, "row", "left")
    base = F.coalesce("base", F.array().cast("array<struct<label:string,at:bigint>>"))
    spans_ = F.coalesce("spans", F.array().cast("array<struct<label:string,start:bigint,words:int,cover:double>>"))
    out = out.withColumn("base", base).withColumn("spans", spans_)
    labels = F.array_sort(F.array_distinct(F.col("base.label")))
    every = F.array_sort(F.array_distinct(F.concat("base.label", "spans.label")))
    best = F.coalesce(F.array_max("spans.cover"), F.lit(0.0))
    return out.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.at").alias("first_word"), F.array_max("base.at").alias("last_word"), F.array_join(labels, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), F.least(F.lit(1.0), F.greatest(best, F.when(F.size("base") > 0, 0.5).otherwise(0.0))).alias("score"), "spans")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("spans")


_TEMPLATES = ", ".join(f"({n}, '{label}', '{text}')" for n, (label, text) in enumerate(TEMPLATES))
_BASE = " UNION ALL ".join(f"SELECT doc_id, i AS place, '{label}' AS label FROM word WHERE {' AND '.join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(words))}" for label, words in BASE)
OP9_SQL = rf"""
WITH t AS (SELECT n, label, string_split(x, ' ') AS w FROM (VALUES {_TEMPLATES}) v(n, label, x)),
g AS (SELECT n, label, len(w) AS length, i AS place, w[i + 1 : i + {K}] AS gram FROM (SELECT *, unnest(range(0, len(w) - {K - 1})) AS i FROM t)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}') AS w FROM documents),
word AS (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM d),
base AS ({_BASE}),
tally AS (SELECT doc_id, n, g.label, length, i - place AS diagonal, list(DISTINCT place) AS ats FROM (SELECT doc_id, i, w[i + 1 : i + {K}] AS gram FROM word WHERE i + {K} <= len(w)) h JOIN g USING (gram) GROUP BY ALL),
run AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, n ORDER BY diagonal) AS r FROM (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, n ORDER BY diagonal) <= {MAX_SHIFT} THEN 0 ELSE 1 END AS new FROM tally)),
span AS (SELECT doc_id, label, count(DISTINCT place + k) / any_value(length) AS cover FROM (SELECT doc_id, n, label, length, r, place, unnest(range(0, {K})) AS k FROM (SELECT *, unnest(ats) AS place FROM run)) GROUP BY doc_id, n, label, r HAVING count(DISTINCT place + k) / any_value(length) >= {MIN_COVER}),
b AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels FROM base GROUP BY doc_id),
s AS (SELECT doc_id, max(cover) AS cover FROM span GROUP BY doc_id),
every AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM (SELECT doc_id, label FROM base UNION ALL SELECT doc_id, label FROM span) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CAST(least(1.0, greatest(coalesce(cover, 0), CASE WHEN n_base > 0 THEN 0.5 ELSE 0 END)) AS DOUBLE) AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN s USING (doc_id) LEFT JOIN every USING (doc_id)
"""
