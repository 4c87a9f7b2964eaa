"""Licence scans by sentence rules; only DataFrame functions.

A text is cut into passages at the ends of sentences and at empty lines. Inside a passage a line's end
may end a sentence or only wrap it, so every run of a passage's whole lines counts as a sentence. Each is
normalised and mapped to the identifier of a known licence sentence, if it is one; of runs that begin
together the longest counts, and none inside another. The identifiers of a text, in order, are then
matched against ordered rules: a rule that finds its sequence names a licence and uses the identifiers
up, so that a more general rule further down does not see them.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of licences as notices write them, normalised, by SPDX identifier.
NAMES = {
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache 2 0"),
    "MIT": ("mit license", "mit"),
    "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license", "bsd 3 clause"),
    "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license", "bsd 2 clause"),
    "GPL-3.0": ("gnu general public license version 3", "gnu gpl version 3", "gpl 3 0", "gplv3"),
    "GPL-2.0": ("gnu general public license version 2", "gnu gpl version 2", "gpl 2 0", "gplv2"),
    "LGPL-3.0": ("gnu lesser general public license version 3", "lgpl 3 0", "lgplv3"),
    "AGPL-3.0": ("gnu affero general public license version 3", "agpl 3 0", "agplv3"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0"),
    "CC-BY-4.0": ("cc by 4 0", "creative commons attribution 4 0 international license"),
    "CC-BY-SA-4.0": ("cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"),
    "CC-BY-NC-4.0": ("cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"),
    "CC-BY-NC-ND-4.0": ("cc by nc nd 4 0", "creative commons attribution noncommercial noderivatives 4 0 international license"),
    "CC0-1.0": ("cc0 1 0", "cc0 1 0 universal license"),
}
#: How a notice brings a name up.
FORMS = ("licensed under {}", "licensed under the {}", "licensed under the {} the license", "released under {}", "released under the {}", "distributed under the {}", "this work is licensed under {}", "this work is licensed under the {}", "this work is licensed under a {}", "this file is licensed under the {}", "this software is licensed under the {}", "available under the {} license", "spdx license identifier {}")
#: Sentences of licence texts, normalised, by identifier.
SENTENCES = {
    "apache-condition": ("you may not use this file except in compliance with the license", "you may not use this work except in compliance with the license"),
    "apache-copy": ("you may obtain a copy of the license at",),
    "apache-as-is": ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",),
    "mit-grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",),
    "mit-notice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "as-is": ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    "bsd-grant": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsd-source": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "bsd-binary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "bsd-endorse": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "gpl-program": ("this program is free software",),
    "gpl-terms": ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "gpl-hope": ("this program is distributed in the hope that it will be useful but without any warranty",),
    "gpl-purpose": ("without even the implied warranty of merchantability or fitness for a particular purpose",),
    "rights": ("all rights reserved",),
}
#: Each known sentence holds one of these words' beginnings; texts without them are done at once.
HINTS = "licen|permission|distribut|released|warrant|copyright|rights|software|spdx"


@dataclass(frozen=True)
class Rule:
    """Identifiers that must follow each other; ``?`` marks one that may be missing."""

    licence: str
    sequence: tuple[str, ...]


#: Rules in order, long sequences first, single references last.
RULES = (
    Rule("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "as-is?")),
    Rule("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "as-is?")),
    Rule("MIT", ("ref:MIT?", "mit-grant", "mit-notice?", "as-is?")),
    Rule("Apache-2.0", ("ref:Apache-2.0?", "apache-condition", "apache-copy?", "apache-as-is?")),
    Rule("Apache-2.0", ("ref:Apache-2.0", "apache-copy?", "apache-as-is?")),
    Rule("GPL-3.0-or-later", ("gpl-program?", "gpl-terms", "gpl-hope?", "gpl-purpose?")),
    *(Rule(name, (f"ref:{name}",)) for name in NAMES),
    Rule("AllRightsReserved", ("rights",)),
)


def known_sentences() -> dict[str, str]:
    """Normalised sentence to identifier: all forms of all names, and the sentences themselves."""
    out = {form.format(name): f"ref:{spdx}" for spdx, names in NAMES.items() for name in names for form in FORMS}
    return out | {s: key for key, own in SENTENCES.items() for s in own}


LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Ends of passages: a mark before white space, or an empty line.
END = "[.;:!?]+[ \\t\\r\\n]+|\\n[ \\t\\r]*\\n"
LINE_END = "[\\r\\n]+"
TAG = "spdx-license-identifier"  # the one name whose colon ends nothing


def _let(value: Column, f) -> Column:
    """f(value) with the value computed once, also where a lambda uses it again and again."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _normal(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))


def sentence_ids(text: Column) -> Column:
    """A text's known sentences in order: array of structs of identifier, place (number of the passage) and line in it."""
    known = known_sentences()
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in known.items()))
    first = sorted({k.split()[0] for k in known})
    lines_most, chars_most = max(len(k.split()) for k in known), max(map(len, known))
    kind = "array<struct<id:string,place:int,line:int,end:int>>"

    def longest(lines: Column, i: Column) -> Column:
        """The longest known run of lines from the i-th (from 1); no known sentence has more words than lines_most, and a line has one at least."""
        runs = F.transform(F.sequence(F.least(F.lit(lines_most), F.size(lines) - i + 1), F.lit(1)), lambda k: F.struct(F.array_join(F.slice(lines, i, k), " ").alias("s"), (i + k - 1).alias("end")))
        hits = F.filter(runs, lambda r: (F.length(r["s"]) <= chars_most) & r["s"].isin(*known))
        return _let(F.get(hits, F.lit(0)), lambda r: F.struct(table[r["s"]].alias("id"), r["end"].alias("end")))

    def of_lines(lines: Column, place: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: F.substring_index(F.get(lines, i - 1), " ", 1).isin(*first))
        found = F.transform(starts, lambda i: _let(longest(lines, i), lambda r: F.struct(r["id"].alias("id"), place.alias("place"), i.alias("line"), r["end"].alias("end"))))
        found = F.filter(found, lambda x: x["id"].isNotNull())
        return _let(found, lambda hits: F.filter(hits, lambda h, j: ~F.exists(F.slice(hits, F.greatest(j + 1 - lines_most, F.lit(1)), F.least(j, F.lit(lines_most))), lambda g: g["end"] >= h["end"])))

    def of_passage(passage: Column, place: Column) -> Column:
        lines = F.filter(F.transform(F.split(passage, LINE_END), _normal), lambda x: x != "")
        none = F.array().cast(kind)
        return F.when(passage.rlike(HINTS), _let(lines, lambda own: F.when(F.size(own) > 0, of_lines(own, place)).otherwise(none))).otherwise(none)

    low = F.replace(F.translate(text, *LETTERS), F.lit(TAG + ":"), F.lit(TAG))
    found = _let(low, lambda t: F.when(t.rlike(HINTS), F.flatten(F.transform(F.split(t, END), of_passage))).otherwise(F.array().cast(kind)))
    return F.transform(found, lambda x: F.struct(x["id"].alias("id"), x["place"].alias("place"), x["line"].alias("line")))


def _pattern(rule: Rule) -> str:
    quoted = lambda s: "<" + s.replace(".", "\\.") + ">"
    return "".join(f"({quoted(s[:-1])})?" if s.endswith("?") else quoted(s) for s in rule.sequence)


def scan_licenses(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Append ``sentences`` (array of id, place and line) and ``licenses`` (distinct, in the rules' order).

    A null, empty or unlicensed text has empty arrays. Rows are independent, repeated ones give the same;
    columns of these two names are replaced and all others kept, whatever their names; an empty table
    gives an empty result.
    """
    kept = [c for c in docs.columns if c not in ("sentences", "licenses")]
    df = docs.select(F.struct(*docs.columns).alias("row"), sentence_ids(F.coalesce(F.col(text), F.lit(""))).alias("sentences"))
    df = df.select("row", "sentences", F.array_join(F.transform("sentences", lambda s: F.concat(F.lit("<"), s["id"], F.lit(">"))), "").alias("left"), F.array().cast("array<string>").alias("found"))
    for rule in rules:
        hit = F.col("left").rlike(_pattern(rule))
        df = df.select("row", "sentences", F.when(hit, F.regexp_replace("left", _pattern(rule), "|")).otherwise(F.col("left")).alias("left"), F.when(hit, F.array_append("found", F.lit(rule.licence))).otherwise(F.col("found")).alias("found"))
    return df.select(*[F.col(f"row.`{c}`") for c in kept], "sentences", F.array_distinct("found").alias("licenses"))


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents``; odd rows as in ``scan_licenses``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_licenses(docs)
    return found.select("doc_id", F.size("sentences").cast("long").alias("n_sentences"), F.array_join(F.col("sentences.id"), ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def _oracle() -> str:
    """In DuckDB: every run of lines is joined with the known sentences, then the rules go one after another."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({q(s)}, {q(i)})" for s, i in known_sentences().items())
    most = max(len(k.split()) for k in known_sentences())
    steps = ["s0 AS (SELECT doc_id, row_id, n, ids, left0 AS l, '' AS f FROM seq)"]
    for k, rule in enumerate(RULES, 1):
        p = q(_pattern(rule))
        steps.append(f"s{k} AS (SELECT doc_id, row_id, n, ids, regexp_replace(l, {p}, '|', 'g') AS l, CASE WHEN regexp_matches(l, {p}) AND NOT contains(f || ',', ',' || {q(rule.licence)} || ',') THEN f || ',' || {q(rule.licence)} ELSE f END AS f FROM s{k - 1})")
    return rf"""
WITH known(sentence, id) AS (VALUES {known}),
d AS (SELECT doc_id, row_number() OVER () AS row_id, lower(regexp_replace(coalesce(text, ''), '[^\x00-\x7f]', '~', 'g')) AS t FROM documents),
cut AS (SELECT row_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS place FROM (SELECT row_id, regexp_split_to_array(t, '[.;:!?]+[ \t\r\n]+|\n[ \t\r]*\n') AS parts FROM d)),
lined AS (SELECT row_id, place, list_filter(list_transform(regexp_split_to_array(s, '[\r\n]+'), lambda x: trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS lines FROM cut),
starts AS (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM lined),
runs AS (SELECT row_id, place, i, e, array_to_string(lines[i:e], ' ') AS sentence FROM (SELECT *, unnest(range(i, least(len(lines), i + {most} - 1) + 1)) AS e FROM starts)),
longest AS (SELECT row_id, place, i, max(e) AS e, arg_max(id, e) AS id FROM runs JOIN known USING (sentence) GROUP BY row_id, place, i),
hit AS (SELECT * FROM (SELECT *, max(e) OVER (PARTITION BY row_id, place ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM longest) WHERE before IS NULL OR before < e),
per AS (SELECT row_id, count(*) AS n, string_agg(id, ',' ORDER BY place, i) AS ids, string_agg('<' || id || '>', '' ORDER BY place, i) AS left0 FROM hit GROUP BY row_id),
seq AS (SELECT d.doc_id, d.row_id, coalesce(n, 0) AS n, coalesce(ids, '') AS ids, coalesce(left0, '') AS left0 FROM d LEFT JOIN per USING (row_id)),
{", ".join(steps)}
SELECT doc_id, n::BIGINT AS n_sentences, ids AS sentence_ids, ltrim(f, ',') AS licenses FROM s{len(RULES)}
"""


ORACLE = _oracle()
