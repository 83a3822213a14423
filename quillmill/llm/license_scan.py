"""Licence scans by a positional index of rare tokens.

Templates (base phrases, notices and characteristic clauses of licences, and mandatory key phrases) are indexed as
postings (word, template, position). A file keeps the positions of its licence words; a licence word's weight is its
inverse document frequency over all files. Only a template's words of highest weight open it in a file: as many as may
be wrong in it and one more, so that a stretch that agrees enough holds at least one of them and none is lost. A word's
position in a file less its position in a template is where that template would start; the postings of the templates
that a file opens are intersected by counting those that agree on a start. A base or key phrase stands where all its
words agree, a notice or clause where ``ENOUGH`` of them do, and all that may not be wrong: numbers, and the words of the label's
key phrases where the clause has them. A label of the latter is accepted if the file holds all its mandatory key phrases.

Function words are not indexed. All rows are dealt by document, and a document's places are pre-aggregated, so neither
a frequent licence line nor a very long text makes a large group. The templates, their words and postings are fixed,
small tables.

Null and empty texts have no words. Rows with equal or null doc_id each give their own row. An empty table gives an
empty result; columns besides ``doc_id`` and ``text`` are ignored. Only built-in functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import work

WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENOUGH = 0.8

#: Base phrases and their labels: fixed values.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_GRANT = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
_GNU = "this program is free software you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation either version {} of the license or at your option any later version"
_GNU_WARRANTY = "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {} for more details"
_REDISTRIBUTION = [
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
]

_DISCLAIMED = (
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits "
    "or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_FREEDOM = "the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public license is intended to guarantee your freedom to share and change free software to make sure the software is free for all its users"
_FREEDOM_3 = "the licenses for most software and other practical works are designed to take away your freedom to share and change the works by contrast the gnu general public license is intended to guarantee your freedom to share and change all versions of a program to make sure it remains free software for all its users"

#: Notices and characteristic clauses of public licences: label, clauses in lower-case words, mandatory key phrases.
NOTICES = [
    ("0bsd", [_GRANT], [_GRANT, "software is provided as is"]),
    ("agpl-3.0", ["licensed under the gnu affero general public license version 3", _GNU.format("affero general public license", 3), _GNU_WARRANTY.format("affero general public license")], ["gnu affero general public license"]),
    ("apache-2.0", [
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable except as stated in this section patent license to make have made use offer to sell sell import and otherwise transfer the work",
        "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form",
    ], ["apache license", "version 2 0"]),
    ("bsd", [*_REDISTRIBUTION, _DISCLAIMED], ["redistribution and use", "following conditions are met"]),
    ("bsd-3-clause", ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"], ["redistribution and use", "endorse or promote products"]),
    ("bsl-1.0", ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software"], ["person or organization"]),
    ("cc-by-4.0", ["licensed under cc by 4 0"], ["cc by 4 0"]),
    ("cc-by-4.0-text", ["this work is licensed under a creative commons attribution 4 0 international license"], ["creative commons attribution 4 0"]),
    ("cc-by-nc-4.0", ["licensed under cc by nc 4 0"], ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", ["licensed under cc by sa 4 0"], ["cc by sa 4 0"]),
    ("cc0-1.0", ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"], ["waived all copyright"]),
    ("epl-2.0", ["this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at"], ["eclipse public license 2 0"]),
    ("gpl-2.0", ["licensed under the gnu general public license version 2", _GNU.format("general public license", 2), _FREEDOM], ["gnu general public license", "version 2"]),
    ("gpl-3.0", ["licensed under the gnu general public license version 3", _GNU.format("general public license", 3), _FREEDOM_3], ["gnu general public license", "version 3"]),
    ("isc", ["permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"], ["appear in all copies"]),
    ("lgpl", ["licensed under the gnu lesser general public license", _GNU_WARRANTY.format("lesser general public license")], ["gnu lesser general public license"]),
    ("mit-notice", ["released under the mit license"], ["mit license"]),
    ("mit-text", [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ], ["permission is hereby granted", "without restriction"]),
    ("mpl-2.0", ["this source code form is subject to the terms of the mozilla public license v 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at"], ["mozilla public license"]),
    ("unlicense", ["this is free and unencumbered software released into the public domain", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"], ["public domain"]),
    ("wtfpl", ["everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"], ["license document"]),
    ("zlib", ["this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"], ["arising from the use of this software"]),
]
FUNCTION_WORDS = {"a", "and", "any", "are", "for", "in", "is", "of", "or", "that", "the", "this", "to", "with"}


def templates() -> list[tuple[str, str, list[tuple[int, str, int]], int]]:
    """(kind, label, indexed words with their positions and whether they may not be wrong, how many must agree) of all templates."""
    out = [("base", label, phrase, []) for phrase, label in BASE.items()]
    out += [("clause", label, clause, keys) for label, clauses, keys in NOTICES for clause in clauses]
    out += [("key", key, key, []) for key in sorted({k for *_, keys in NOTICES for k in keys})]
    found = []
    for kind, label, text, keys in out:
        words = text.split()
        strict = {i for i, w in enumerate(words) if w.isdigit()}
        for key in map(str.split, keys):
            strict |= {i + j for i in range(len(words)) if words[i : i + len(key)] == key for j in range(len(key))}
        own = [(i, w, int(kind == "clause" and i in strict)) for i, w in enumerate(words) if w not in FUNCTION_WORDS]
        found.append((kind, label, own, math.ceil(ENOUGH * len(own)) if kind == "clause" else len(own)))
    return found


def openers(df: dict[str, int]) -> list[tuple[int, str]]:
    """(template, word): the words of highest weight that open each template, one position more than may be wrong."""
    out = []
    for t, (_, _, own, need) in enumerate(templates()):
        least = len(own) - need + 1
        for w in sorted({w for _, w, _ in own}, key=lambda w: (df.get(w, 0), w)):
            if least > 0:
                out.append((t, w))
                least -= sum(x == w for _, x, _ in own)
    return out


def _fixed(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A small table of strings and integers, as literals in the plan."""
    return spark.sql(f"SELECT * FROM VALUES {', '.join(f'{r!r}' for r in rows)} AS fixed({names})")


def _files(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """row, doc_id, n_words, and the licence words with their places."""
    lower = F.translate(F.coalesce("text", F.lit("")), UPPER, UPPER.lower())
    words = F.filter(F.split(lower, WORD_BREAK), lambda w: w != "")
    hits = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: h["w"].isin(vocabulary))
    return (
        docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words.alias("words"))
        .select("row", "doc_id", F.size("words").cast("long").alias("n_words"), hits.alias("hits"))
    )


def scan(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    known = templates()
    vocabulary = sorted({w for _, _, own, _ in known for _, w, _ in own})
    files = work.put(_files(docs, vocabulary), "files")
    seen = files.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["w"]))).alias("w")).groupBy("w").count()
    df = {r["w"]: r["count"] for r in seen.collect()}  # a row for each word of the templates at most

    index = _fixed(spark, [(w, t, i, strict, len(own), need, sum(x for *_, x in own)) for t, (_, _, own, need) in enumerate(known) for i, w, strict in own], "w, t, position, strict, size, need, must")
    named = _fixed(spark, [(t, kind, label) for t, (kind, label, _, _) in enumerate(known)], "t, kind, label")
    by_word = openers(df)
    first = F.array_distinct(F.filter(F.transform("hits", lambda h: h["w"]), lambda w: w.isin(sorted({w for _, w in by_word}))))
    opened = files.select("row", F.explode(first).alias("w")).join(F.broadcast(_fixed(spark, by_word, "t, w")), "w").select("row", "t").distinct()
    opened = work.put(opened, "opened")
    places = files.join(opened.select("row").distinct(), "row", "left_semi").select("row", F.explode("hits").alias("h")).select("row", "h.w", "h.i")
    places = places.join(F.broadcast(index), "w").join(opened, ["row", "t"]).groupBy("row", "t", "size", "need", "must", (F.col("i") - F.col("position")).alias("start"))
    agreed = places.agg(F.count("*").alias("n"), F.sum("strict").alias("strict")).filter("n >= need AND strict = must").join(F.broadcast(named), "t")

    best = agreed.groupBy("row", "kind", "label").agg(F.count("*").alias("places"), F.min("start").alias("first"), F.max("start").alias("last"), F.max(F.col("n") / F.col("size")).alias("part"))
    of_base = lambda c: F.when(F.col("kind") == "base", F.col(c))
    in_file = best.groupBy("row").agg(
        F.sum(of_base("places")).alias("n_base"),
        F.min(of_base("first")).cast("long").alias("first_word"),
        F.max(of_base("last")).cast("long").alias("last_word"),
        F.collect_set(of_base("label")).alias("base"),
        F.collect_set(F.when(F.col("kind") == "key", F.col("label"))).alias("keys"),
        F.collect_set(F.when(F.col("kind") == "clause", F.struct("label", "part"))).alias("clauses"),
    )
    in_file = work.put(in_file, "in_file")
    wanted = _fixed(spark, [(label, ",".join(keys)) for label, _, keys in NOTICES], "label, wanted").select("label", F.split("wanted", ",").alias("wanted"))
    verified = in_file.select("row", "keys", F.explode("clauses").alias("x")).select("row", "keys", "x.label", "x.part").join(F.broadcast(wanted), "label")
    verified = verified.filter(F.size(F.array_except("wanted", "keys")) == 0).groupBy("row").agg(F.collect_set("label").alias("own"), F.max("part").alias("part"))
    none = F.array().cast("array<string>")
    text = lambda c: F.array_join(F.array_sort(c), ",")
    base, own = F.coalesce("base", none), F.coalesce("own", none)
    out = files.select("row", "doc_id", "n_words").join(in_file, "row", "left").join(verified, "row", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).alias("n_base"),
        "first_word",
        "last_word",
        text(base).alias("base_labels"),
        text(F.array_union(base, own)).alias("labels"),
        F.round(F.when(F.coalesce("n_base", F.lit(0)) > 0, 1.0).otherwise(F.coalesce("part", F.lit(0.0))), 6).alias("score"),
    )
