"""Licence scan by sentence rules.

Sentences are normalised and mapped to identifiers of known licence sentences;
the sequence of a document's identifiers is then matched against ordered rules.
DataFrame functions only; there is no Python code on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Known sentences, normalised ({v} stands for each version), and their identifiers.
SENTENCES = (
    ("licensed under the apache license version {v}", "apache-{v}", ("1.0", "1.1", "2.0")),
    ("licensed under the apache license version {v} the license", "apache-{v}-notice", ("1.1", "2.0")),
    ("you may not use this file except in compliance with the license", "apache-comply", ("",)),
    ("you may obtain a copy of the license at", "apache-copy", ("",)),
    ("released under the mit license", "mit", ("",)),
    ("licensed under the mit license", "mit", ("",)),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit-grant", ("",)),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit-notice", ("",)),
    ("the software is provided as is without warranty of any kind", "mit-as-is", ("",)),
    ("this work is licensed under the gnu general public license version {v}", "gpl-{v}", ("1", "2", "3")),
    ("licensed under the gnu general public license version {v}", "gpl-{v}", ("1", "2", "3")),
    ("licensed under the gnu lesser general public license version {v}", "lgpl-{v}", ("2.1", "3")),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl-free", ("",)),
    ("either version {v} of the license or at your option any later version", "gpl-either-{v}", ("2", "3")),
    ("licensed under cc by {v}", "cc-by-{v}", ("2.0", "2.5", "3.0", "4.0")),
    ("licensed under cc by sa {v}", "cc-by-sa-{v}", ("2.0", "2.5", "3.0", "4.0")),
    ("licensed under cc by nc {v}", "cc-by-nc-{v}", ("2.0", "2.5", "3.0", "4.0")),
    ("licensed under cc by nd {v}", "cc-by-nd-{v}", ("2.0", "2.5", "3.0", "4.0")),
    ("licensed under the bsd {v} clause license", "bsd-{v}", ("2", "3")),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd-source", ("",)),
    ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "bsd-binary", ("",)),
    ("all rights reserved", "rights", ("",)),
)

#: Rules in the order in which they are tried; what a rule has matched is no longer there for the next.
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("BSD-2-Clause", ("bsd-source", "bsd-binary")),
    *((f"Apache-{v}", (f"apache-{v}-notice", "apache-comply", "apache-copy")) for v in ("1.1", "2.0")),
    *((f"GPL-{v}.0-or-later", ("gpl-free", f"gpl-either-{v}")) for v in ("2", "3")),
    *((f"Apache-{v}", (f"apache-{v}-notice",)) for v in ("1.1", "2.0")),
    *((f"Apache-{v}", (f"apache-{v}",)) for v in ("1.0", "1.1", "2.0")),
    ("MIT", ("mit",)),
    *((f"GPL-{v}.0-only", (f"gpl-{v}",)) for v in ("1", "2", "3")),
    *((f"LGPL-{v}", (f"lgpl-{v}",)) for v in ("2.1", "3")),
    *((f"BSD-{v}-Clause", (f"bsd-{v}",)) for v in ("2", "3")),
    *((f"CC-BY{kind}-{v}", (f"cc-by{kind.lower()}-{v}",)) for kind in ("-SA", "-NC", "-ND", "") for v in ("2.0", "2.5", "3.0", "4.0")),
    ("Proprietary", ("rights",)),
)

#: Sentences and rules that the SQL does not have: how the official
#: texts go on or are cut where SENTENCES has a part of them, or the parts as one.
_GRANT, _AS_IS = (next(text for text, name, _ in SENTENCES if name == n) for n in ("mit-grant", "mit-as-is"))
_FREE = "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"
OFFICIAL_SENTENCES = (
    (f"{_GRANT} including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "mit-grant", ("",)),
    (f"{_AS_IS} express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "mit-as-is", ("",)),
    (_FREE, "gpl-free", ("",)),
    (f"{_FREE} either version {{v}} of the license or at your option any later version", "gpl-free-either-{v}", ("2", "3")),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd-endorse", ("",)),
)
OFFICIAL_RULES = (
    ("BSD-3-Clause", ("bsd-source", "bsd-binary", "bsd-endorse")),
    *((f"GPL-{v}.0-or-later", (f"gpl-free-either-{v}",)) for v in ("2", "3")),
)

#: Each known sentence contains one of these, so a text without them needs no splitting.
#: They are parts of words, so no line break or second blank can hide them.
TRIGGERS = ("licen", "permission", "redistribut", "reserved", "warranty")
#: Between sentences, and between the lines of one.
END, WRAP = "\x01", "\x02"


def known_sentences(table: tuple = SENTENCES) -> list[tuple[str, str]]:
    return [(text.format(v=v), name.format(v=v)) for text, name, versions in table for v in versions]


def _sequence(names: tuple[str, ...]) -> str:
    return "".join(f"<{n}>" for n in names)


def _marked(text: Column) -> Column:
    """The normalised text: lower-case letters and numbers, one blank between words,
    ``END`` between sentences and paragraphs, ``WRAP`` between other lines."""
    out = F.translate(F.lower(text), END + WRAP, "__")
    out = F.regexp_replace(out, r"([.!?;:])\s+", f"$1{END}")
    out = F.regexp_replace(out, rf"\n(?=[^a-z0-9\n{END}]*\n)", END)
    out = F.translate(out, "\n", WRAP)
    out = F.regexp_replace(out, f"[^a-z0-9.{END}{WRAP}]+", " ")
    out = F.regexp_replace(out, rf"\.(?=[ {END}{WRAP}]|$)", "")
    return F.regexp_replace(F.regexp_replace(out, " +", " "), f" ?([{END}{WRAP}]) ?", "$1")


def found_sentences(text: Column, known: list[str]) -> Column:
    """The known sentences of a text, in order. One begins and ends at a line or a
    sentence of the text; inside it lines may be wrapped. Longer ones go first."""
    words = lambda s: s.replace(".", r"\.").replace(" ", f"[ {WRAP}]")
    either = "|".join(words(s) for s in sorted(known, key=lambda s: (-len(s), s)))
    edge = f"[{END}{WRAP}]"
    found = F.regexp_extract_all(F.concat(F.lit(END), F.trim(_marked(text)), F.lit(END)), F.lit(f"(?<={edge})(?:{either})(?={edge})"), 0)
    return F.transform(found, lambda s: F.translate(s, WRAP, " "))


def licences(docs: DataFrame) -> DataFrame:
    """(doc_id, licences, n_known, n_left) of each document with a known licence sentence.

    ``docs`` has doc_id and text; other columns are ignored and rows without a
    doc_id or text have no finding; repeated rows are one finding each.
    ``licences`` lists the matched rules' licences in the order of the rules,
    each once; ``n_known`` counts the known sentences, ``n_left`` those that no
    rule has used. A sentence may be wrapped over lines. The table of known
    sentences is a constant of this module.
    """
    text = F.lower("text")
    likely = F.lit(False)
    for word in TRIGGERS:
        likely = likely | F.contains(text, F.lit(word))
    rows = docs.where("doc_id is not null").where(likely).select(F.col("doc_id").cast("long"), "text")
    table = known_sentences(SENTENCES + OFFICIAL_SENTENCES)
    known = F.map_from_entries(F.array(*[F.struct(F.lit(s), F.lit(f"<{n}>")) for s, n in table]))
    names = F.transform(found_sentences(F.col("text"), [s for s, _ in table]), lambda s: F.get(F.array(known), F.lit(0))[s])
    found = rows.select("doc_id", names.alias("names")).where(F.size("names") > 0)
    rules = F.array(*[F.struct(F.lit(name).alias("licence"), F.lit(_sequence(r)).alias("sequence")) for name, r in OFFICIAL_RULES + RULES])
    start = F.struct(F.array_join("names", "").alias("left"), F.array().cast("array<string>").alias("licences"))
    matched = F.aggregate(
        rules,
        start,
        lambda state, rule: F.when(
            F.contains(state["left"], rule["sequence"]),
            F.struct(
                F.replace(state["left"], rule["sequence"], F.lit("|")).alias("left"),
                F.array_union(state["licences"], F.array(rule["licence"])).alias("licences"),
            ),
        ).otherwise(state),
    )
    left = F.length("m.left") - F.length(F.replace(F.col("m.left"), F.lit("<")))
    return found.select("doc_id", matched.alias("m"), F.size("names").cast("long").alias("n_known")).select(
        "doc_id", F.array_join("m.licences", ",").alias("licences"), "n_known", left.cast("long").alias("n_left")
    )


def oracle() -> str:
    """The same in DuckDB."""
    values = ", ".join(f"('{s}', '<{n}>')" for s, n in known_sentences())
    left, steps, names = "s0", [], []
    for k, (name, rule) in enumerate(RULES, 1):
        steps.append(f"contains(s{k - 1}, '{_sequence(rule)}') AS f{k}, replace(s{k - 1}, '{_sequence(rule)}', '|') AS s{k}")
        names.append(f"CASE WHEN f{k} THEN '{name}' END")
        left = f"s{k}"
    return rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(regexp_replace(lower(text), '([.!?;:])\s+', '\1' || chr(10), 'g'), chr(10))) AS s,
         generate_subscripts(string_split(regexp_replace(lower(text), '([.!?;:])\s+', '\1' || chr(10), 'g'), chr(10)), 1) AS i
  FROM documents
), plain AS (
  SELECT doc_id, i, trim(regexp_replace(regexp_replace(regexp_replace(s, '[^a-z0-9.]+', ' ', 'g'), '\.( |$)', '\1', 'g'), ' +', ' ', 'g')) AS s
  FROM lines
), known(s, name) AS (VALUES {values}),
found AS (
  SELECT doc_id, string_agg(name, '' ORDER BY i) AS s0, count(*) AS n_known FROM plain JOIN known USING (s) GROUP BY doc_id
), matched AS (SELECT *, {", ".join(steps)} FROM found),
listed AS (SELECT *, [{", ".join(names)}] AS all_names FROM matched),
named AS (SELECT *, [x FOR x, k IN all_names IF x IS NOT NULL AND list_position(all_names, x) = k] AS list_distinct_in_order FROM listed)
SELECT doc_id, array_to_string(list_distinct_in_order, ',') AS licences,
       n_known, length({left}) - length(replace({left}, '<', '')) AS n_left
FROM named
"""
