"""License scans by sentence rules, with DataFrame functions only.

A text is cut into sentences (at line ends and after ``.``, ``!``, ``?`` before white space), each
is normalised (ASCII lower case, runs of other characters to one blank) and looked up in a map of
known license sentences. The identifiers found, in text order, are matched against ordered rules:
a rule is a sequence of sentence identifiers that must follow each other without another known
sentence between them, and a sentence that an earlier rule has used is no later rule's. So a
license that goes on where another one ends (BSD-3-Clause, BSD-2-Clause) stands first. Sentences
that are wrapped over lines are looked up whole first (line ends joined up to a sentence end, a
blank line or the start of a known sentence), then by line.

The SQL beside it is plain: it looks up SENTENCES by line only, so on wrapped texts and the full
license sentences of WHOLE it finds less. ``n_sentences`` counts by line in both.

Defined results: null and empty texts hold no sentence and no license; an empty table gives no
rows; very long texts are read whole. A sentence that occurs twice is found twice, its license is
listed once. Rows with equal ids are each scanned. The rest of the input's columns are not carried over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .url_rules import LOWER, UPPER

#: Normalised license sentences and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache-line",
    "released under the mit license": "mit-line",
    "licensed under cc by nc 4 0": "cc-by-nc-line",
    "this work is licensed under the gnu general public license version 3": "gpl3-line",
    "licensed under the apache license version 2 0 the license": "apache-head-1",
    "you may not use this file except in compliance with the license": "apache-head-2",
    "you may obtain a copy of the license at": "apache-head-3",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit-1",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-2",
    "the software is provided as is without warranty of any kind": "mit-3",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-1",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-2",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-3",
    "this program is free software": "gpl-1",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-2",
}

#: License, ordered sentence identifiers; an earlier rule takes its sentences first.
RULES = (
    ("Apache-2.0", ("apache-line",)),
    ("Apache-2.0", ("apache-head-1", "apache-head-2")),
    ("Apache-2.0", ("apache-head-2", "apache-head-3")),
    ("MIT", ("mit-line",)),
    ("MIT", ("mit-1", "mit-2", "mit-3")),
    ("MIT", ("mit-1", "mit-2")),
    ("MIT", ("mit-2", "mit-3")),
    ("CC-BY-NC-4.0", ("cc-by-nc-line",)),
    ("GPL-3.0", ("gpl3-line",)),
    ("GPL", ("gpl-1", "gpl-2")),
    ("BSD-2-Clause", ("bsd-1", "bsd-2", "bsd-3")),
    ("BSD-2-Clause", ("bsd-1", "bsd-2")),
)

MIT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"
FSF = "you can redistribute it and or modify it under the terms of the gnu {} public license as published by the free software foundation"
LATER = "{} either version {} of the license or at your option any later version"
#: The licenses' own full sentences, where SENTENCES has parts of them or none.
WHOLE = {
    f"{MIT} including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-1",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-3",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-head",
    **{f"you may obtain a copy of the license at {h} www apache org licenses license 2 0": "apache-head-3" for h in ("http", "https")},
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-name",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc",
    "this source code form is subject to the terms of the mozilla public license v": "mpl-1",
    **{f"if a copy of the mpl was not distributed with this file you can obtain one at {h} mozilla org mpl 2 0": "mpl-2" for h in ("http", "https")},
    "this is free and unencumbered software released into the public domain": "unlicense",
    **{f"{LATER.format(f'{w} is free software {FSF}', v)}".format(k): f"{i}-{v.replace(' ', '.')}-later" for k, i, vs in (("general", "gpl", ("1", "2", "3")), ("lesser general", "lgpl", ("2 1", "3")), ("affero general", "agpl", ("3",))) for v in vs for w in ("this program", "this library")},
    **{f"{w} is free software {FSF} version {v} of the license".format(k): f"{i}-{v.replace(' ', '.')}-only" for k, i, vs in (("general", "gpl", ("2", "3")), ("lesser general", "lgpl", ("2 1", "3"))) for v in vs for w in ("this program", "this library")},
}
WHOLE_RULES = (
    ("Apache-2.0", ("apache-head", "apache-head-3")),
    ("Apache-2.0", ("apache-head",)),
    ("BSD-3-Clause", ("bsd-1", "bsd-2", "bsd-3", "bsd-name")),
    ("ISC", ("isc",)),
    ("MPL-2.0", ("mpl-1", "mpl-2")),
    ("Unlicense", ("unlicense",)),
    *((f"{i.upper()}-{v}{'' if '.' in v else '.0'}-{'or-later' if k == 'later' else k}", (f"{i}-{v}-{k}",)) for i, v, k in (x.rsplit("-", 2) for x in sorted({x for x in WHOLE.values() if "gpl" in x}))),
)

#: Line ends that a known sentence follows, after marks such as those of comments.
STARTS = "permission is hereby|the above copyright notice and|the software is provided|redistribution and use|redistributions (?:of|in)|this (?:program|library|source code|is free)|neither the name|permission to use|if a copy of the mpl|this work is licensed|you may not use this|you may obtain a|licensed under|released under"
JOINED = rf"(?<=[.!?])[ \t\r\n]+|\n(?=[^a-z0-9\n]*\n)|\n(?=[^a-z0-9\n]*(?:[0-9a-z][.)])?[^a-z0-9\n]*(?:{STARTS}))"
CUT = r"\n+|(?<=[.!?])[ \t\r]+"


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def normal(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))


def sentences(text: Column) -> Column:
    return F.transform(F.split(lowered(text), CUT), normal)


def scan(docs: DataFrame, known: dict[str, str] = SENTENCES | WHOLE, rules=WHOLE_RULES + RULES) -> DataFrame:
    """doc_id, n_sentences, sentence_ids (in text order), licenses (sorted, distinct), n_rules."""
    ids = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])

    def found(s):
        """Identifiers of a sentence: its own, or those of its lines."""
        whole = F.element_at(ids, normal(s))
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(F.split(s, r"\n+"), lambda x: F.element_at(ids, normal(x))))

    df = docs.select("doc_id", sentences(F.col("text")).alias("_s"), F.flatten(F.transform(F.split(lowered(F.col("text")), JOINED), found)).alias("_f"))
    df = df.withColumn("_k", F.filter("_f", lambda x: x.isNotNull()))
    df = df.select(
        "doc_id",
        F.size(F.filter("_s", lambda s: s != "")).cast("long").alias("n_sentences"),
        F.col("_k").alias("sentence_ids"),
        F.array_join(F.transform("_k", lambda k: F.concat(F.lit("<"), k, F.lit(">"))), "").alias("_seq"),
    )
    # what a rule has matched is taken out of the sequence before the next rule looks; each step is a
    # struct's field, so that the plan's expressions grow with the number of rules and not with its power
    steps = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{i}>" for i in seq)).alias("seq")) for name, seq in rules])
    begin = F.struct(F.col("_seq").alias("rest"), F.array().cast("array<string>").alias("hit"))

    def step(state, rule):
        hit = F.contains(state["rest"], rule["seq"])
        return F.struct(
            F.when(hit, F.replace(state["rest"], rule["seq"], F.lit("<>"))).otherwise(state["rest"]).alias("rest"),
            F.when(hit, F.concat(state["hit"], F.array(rule["name"]))).otherwise(state["hit"]).alias("hit"),
        )

    hits = F.when(F.col("_seq") == "", F.array().cast("array<string>")).otherwise(F.aggregate(steps, begin, step, lambda x: x["hit"]))
    return df.withColumn("_hit", hits).select(
        "doc_id",
        "n_sentences",
        "sentence_ids",
        F.sort_array(F.array_distinct("_hit")).alias("licenses"),
        F.size("_hit").cast("long").alias("n_rules"),
    )


def brute_sql() -> str:
    """DuckDB SQL for op5's columns: the scan as plain list operations."""
    known = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    rest, hits = "q", []
    for name, seq in RULES:
        marked = "".join(f"<{i}>" for i in seq)
        hits.append(f"CASE WHEN contains({rest}, '{marked}') THEN '{name}' END")
        rest = f"replace({rest}, '{marked}', '<>')"
    return f"""
    WITH known(s, i) AS (VALUES {known}),
    parts AS (SELECT doc_id, unnest(string_split_regex(translate(replace(coalesce(text, ''), chr(13), ' '), '{UPPER}', '{LOWER}'), chr(10) || '+')) AS line,
                     generate_subscripts(string_split_regex(translate(replace(coalesce(text, ''), chr(13), ' '), '{UPPER}', '{LOWER}'), chr(10) || '+'), 1) AS l1 FROM documents),
    sent AS (SELECT doc_id, l1, unnest(string_split(regexp_replace(line, '([.!?])[ \\t]+', '\\1' || chr(1), 'g'), chr(1))) AS s,
                    generate_subscripts(string_split(regexp_replace(line, '([.!?])[ \\t]+', '\\1' || chr(1), 'g'), chr(1)), 1) AS l2 FROM parts),
    norm AS (SELECT doc_id, l1, l2, trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')) AS s FROM sent),
    seq AS (SELECT doc_id, '|' || coalesce(string_agg(i, '|' ORDER BY l1, l2), '') || '|' AS ids, coalesce(string_agg('<' || i || '>', '' ORDER BY l1, l2), '') AS q, count(*) FILTER (norm.s <> '') AS n FROM norm LEFT JOIN known ON known.s = norm.s GROUP BY doc_id),
    hit AS (SELECT doc_id, n, ids, list_filter([{", ".join(hits)}], lambda x: x IS NOT NULL) AS found FROM seq)
    SELECT doc_id, CAST(n AS BIGINT) AS n_sentences, ids AS sentence_sequence, array_to_string(list_sort(list_distinct(found)), ',') AS licenses, CAST(len(found) AS BIGINT) AS n_rules FROM hit"""
