"""Licence scan by sentence rules, in DataFrame functions only.

A text is cut into sentences: comment leaders at line starts go, lines of a paragraph are joined,
and a sentence ends at ``. ! ? ; :`` before a blank or at an empty line. As notices often stand
on a line of their own without a full stop, each line of a sentence is looked up as well. Normalised
sentences are joined with a dictionary of known licence sentences; a text's identifiers in order
form its sequence, in which the ordered licence rules are looked up. Unknown sentences may stand
between the known ones of a rule, at most ``MAX_GAP``. A rule within a longer matching rule does not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences from one known sentence to the next of a rule, at most.
MAX_GAP = 30

_GPL_TERMS = "you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation"
_LATER = "either version {} of the license or at your option any later version"

#: Identifier and normalised sentence (fixed values, words of the licences): lower case, runs of other characters than a-z, 0-9 and
#: the dot as one blank. Several sentences may have one identifier.
SENTENCES: tuple[tuple[str, str], ...] = (
    ("apache2-short", "licensed under the apache license version 2.0"),
    ("apache2-grant", "licensed under the apache license version 2.0 the license"),
    ("apache2-comply", "you may not use this file except in compliance with the license"),
    ("apache2-copy", "you may obtain a copy of the license at"),
    ("apache2-copy", "you may obtain a copy of the license at http www.apache.org licenses license 2.0"),
    ("apache2-copy", "you may obtain a copy of the license at http www.apache.org licenses license 2.0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("mit-short", "released under the mit license"),
    ("mit-licensed", "licensed under the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("notice-kept", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("as-is", "the software is provided as is without warranty of any kind express or implied"),
    ("as-is", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-grant", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("gpl3-short", "this work is licensed under the gnu general public license version 3"),
    ("gpl2-short", "this work is licensed under the gnu general public license version 2"),
    ("gpl-free", "this program is free software"),
    ("gpl-free", "this library is free software"),
    ("gpl-terms", _GPL_TERMS.format("general public license")),
    ("lgpl-terms", _GPL_TERMS.format("lesser general public license")),
    ("agpl-terms", _GPL_TERMS.format("affero general public license")),
    ("later-2", _LATER.format("2")),
    ("later-2.1", _LATER.format("2.1")),
    ("later-3", _LATER.format("3")),
    ("gpl2-terms", f"{_GPL_TERMS.format('general public license')} {_LATER.format('2')}"),
    ("gpl3-terms", f"{_GPL_TERMS.format('general public license')} {_LATER.format('3')}"),
    ("lgpl2.1-terms", f"{_GPL_TERMS.format('lesser general public license')} {_LATER.format('2.1')}"),
    ("lgpl3-terms", f"{_GPL_TERMS.format('lesser general public license')} {_LATER.format('3')}"),
    ("agpl3-terms", f"{_GPL_TERMS.format('affero general public license')} {_LATER.format('3')}"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-names", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("boost-grant", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
    ("zlib-as-is", "this software is provided as is without any express or implied warranty"),
    ("zlib-grant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-short", "licensed under cc by 4.0"),
    ("cc-by-sa-short", "licensed under cc by sa 4.0"),
    ("cc-by-nc-short", "licensed under cc by nc 4.0"),
    ("cc0-short", "released under cc0 1.0"),
    ("mpl2-terms", "this source code form is subject to the terms of the mozilla public license v"),
    ("mpl2-terms", "this source code form is subject to the terms of the mozilla public license version 2.0"),
    ("all-rights", "all rights reserved"),
)

#: Licence and the identifiers that must follow one another.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("apache2-short",)),
    ("Apache-2.0", ("apache2-grant", "apache2-comply", "apache2-copy")),
    ("MIT", ("mit-short",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-grant", "notice-kept", "as-is")),
    ("ISC", ("isc-grant",)),
    ("GPL-3.0", ("gpl3-short",)),
    ("GPL-2.0", ("gpl2-short",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl3-terms")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-terms", "later-3")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl2-terms")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-terms", "later-2")),
    ("LGPL-2.1-or-later", ("gpl-free", "lgpl2.1-terms")),
    ("LGPL-2.1-or-later", ("gpl-free", "lgpl-terms", "later-2.1")),
    ("LGPL-3.0-or-later", ("gpl-free", "lgpl3-terms")),
    ("LGPL-3.0-or-later", ("gpl-free", "lgpl-terms", "later-3")),
    ("AGPL-3.0-or-later", ("gpl-free", "agpl3-terms")),
    ("AGPL-3.0-or-later", ("gpl-free", "agpl-terms", "later-3")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSL-1.0", ("boost-grant",)),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("Unlicense", ("unlicense",)),
    ("CC-BY-4.0", ("cc-by-short",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-short",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-short",)),
    ("CC0-1.0", ("cc0-short",)),
    ("MPL-2.0", ("mpl2-terms",)),
    ("LicenseRef-proprietary", ("all-rights",)),
)

#: Between sentences of a text that is being cut; between identifiers too far apart.
END, FAR = "\u0001", "~|"
LEADERS = "(^|\\n)[ \\t]*(?:/\\*+|\\*+/|//+|#+|;+|--+|>+|%+|<!--|\\*+)[ \\t]*"
ENDS = "[.!?;:][ \\t\\r\\n]+|\\n[ \\t\\r]*\\n[ \\t\\r\\n]*"
OTHER = f"[^a-z0-9.{END}\\n]+"


def sentences(text: Column) -> Column:
    """Sentences of a text, normalised but for the line breaks inside."""
    text = F.regexp_replace(F.lower(text), LEADERS, "$1")
    text = F.regexp_replace(F.regexp_replace(text, ENDS, END), OTHER, " ")
    return F.split(text, END)


def candidates(sentence: Column) -> Column:
    """The whole sentence on one line, and, if it has several, each of its lines."""
    clean = lambda x: F.regexp_replace(x, "^[ .\\n]+|[ .\\n]+$", "")
    lines = F.when(F.contains(sentence, F.lit("\n")), F.transform(F.split(sentence, "\n"), clean)).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(clean(F.regexp_replace(sentence, " *\n *", " "))), lines)


def pattern(ids: tuple[str, ...]) -> str:
    return "|" + "|".join(ids) + "|"


def scan_licenses(docs: DataFrame, known=SENTENCES, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, license, known_sentences``: one row for each licence of a text; texts without one give no row.

    ``known_sentences`` counts the known sentences and lines of the text. Null and empty texts have none, very long ones are
    scanned whole; a null id is kept as such. Rows repeated under one id with one text count as one text, with different texts
    each for itself. An empty table gives an empty result, other columns are ignored whatever their names. Dictionary and
    rules are parameters of fixed size, sent to every task.
    """
    spark = docs.sparkSession
    names = spark.createDataFrame([*known], "sentence_id string, sentence string")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    cut = texts.select("doc_id", "text_hash", F.posexplode(sentences(F.col("text"))).alias("at", "s"))
    cut = cut.select("doc_id", "text_hash", "at", F.posexplode(candidates(F.col("s"))).alias("sub", "sentence"))
    hits = cut.join(F.broadcast(names), "sentence").dropDuplicates(["doc_id", "text_hash", "at", "sub"])
    sequence = hits.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("at", "sub", "sentence_id"))).alias("found"))
    far = lambda x, i: (i > 0) & (x["at"] - F.get("found", F.greatest(i - 1, F.lit(0)))["at"] > MAX_GAP)
    ids = F.transform("found", lambda x, i: F.concat(F.when(far(x, i), FAR).otherwise(""), x["sentence_id"], F.lit("|")))
    sequence = sequence.select("doc_id", F.size("found").alias("known_sentences"), F.concat(F.lit("|"), F.array_join(ids, "")).alias("ids"))
    table = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(pattern(ids)).alias("ids")) for name, ids in rules])
    matched = sequence.withColumn("m", F.filter(table, lambda r: F.contains(F.col("ids"), r["ids"])))
    outer = F.filter("m", lambda r: ~F.exists("m", lambda o: (o["ids"] != r["ids"]) & F.contains(o["ids"], r["ids"])))
    return matched.select("doc_id", "known_sentences", F.explode(F.array_distinct(F.transform(outer, lambda r: r["license"]))).alias("license"))
