"""Licence scans (operator 3): sentences to identifiers, identifier sequences to licences.

DataFrame functions only. A text is cut into sentences (a line break inside a sentence, that
is one before a lower-case letter, counts as a blank); each sentence is normalised (lower
case, runs of other characters than letters, digits, + and . to one blank) and mapped to the
identifiers of the known sentences that it holds, in the order of SENTENCES ("under the MIT license
or the Apache License, Version 2.0" holds two), but not to a general one whose special form it
holds too; sentences without one are dropped. Where other
line breaks, with no end mark or blank line, stand inside a known sentence (a wrap before a
capital), the lines are read as one too: identifiers of the whole that no line has follow those
of the lines, and a general one of a line goes where the whole has its special form. The
identifiers of a document, in order, are matched against RULES from top to bottom; a rule
takes the places it matches, so that a longer rule keeps a shorter one from matching there.

Only texts with a cue word can hold a known sentence, others skip the work. All steps stay in
the document's row: no shuffle. Defined results: a null or empty text has no sentences and no
licences; rows are independent, so repeated rows, other columns and empty tables pass through.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import drop_names

#: (identifier, regular expression over a normalised sentence).
SENTENCES = (
    ("spdx-mit", r"spdx license identifier mit\b"),
    ("spdx-apache", r"spdx license identifier apache 2\.0"),
    ("spdx-gpl2", r"spdx license identifier gpl 2\.0"),
    ("spdx-gpl3", r"spdx license identifier gpl 3\.0"),
    ("spdx-bsd2", r"spdx license identifier bsd 2 clause"),
    ("spdx-bsd3", r"spdx license identifier bsd 3 clause"),
    ("spdx-mpl", r"spdx license identifier mpl 2\.0"),
    ("apache-notice", r"(under|or|and|by)( the)?( terms of the)? apache license,? (version|v\.?) ?2|apache license,? version 2(\.0)?,? (or|and) "),
    ("apache-title", r"^ ?apache license( version 2\.0.*)?$"),
    ("apache-asis", r"distributed under the license is distributed on an as is basis"),
    ("mit-notice", r"(released|licensed|distributed|available|dual licensed) (under|by) (either )?(of )?(the )?(terms of the )?mit license|(under|or|and) (the )?(terms of the )?mit license"),
    ("mit-title", r"^ ?(the )?mit license( mit)?$"),
    ("mit-grant", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit-condition", r"above copyright notice and this permission notice shall be included"),
    ("asis", r"software is provided as is"),
    ("bsd-grant", r"redistribution and use in source and binary forms"),
    ("bsd-source", r"redistributions of source code must retain"),
    ("bsd-binary", r"redistributions in binary form must reproduce"),
    ("bsd-name", r"neither the name of .* may be used to endorse"),
    ("bsd-notice", r"(released|licensed|distributed|or|and)( under)? (either )?(the )?(terms of the )?bsd license"),
    ("isc-grant", r"permission to use copy modify and or distribute this software for any purpose"),
    ("lgpl-notice", r"gnu (lesser|library) general public license"),
    ("agpl-notice", r"gnu affero general public license"),
    ("gpl3-notice", r"gnu (general public license|gpl),?( as published by .*)? (version|v\.?) ?3|version 3 of the gnu (general public license|gpl)|\bgpl ?v3"),
    ("gpl2-notice", r"gnu (general public license|gpl),?( as published by .*)? (version|v\.?) ?2|version 2 of the gnu (general public license|gpl)|\bgpl ?v2"),
    ("gpl-notice", r"gnu general public license"),
    ("mpl-notice", r"mozilla public license,?( v\.| version)? ?2\.0"),
    ("cc0-notice", r"(cc0 1\.0|creative commons zero|cc zero)"),
    ("cc-by-nc-nd", r"(cc by nc nd|creative commons attribution noncommercial noderiv)"),
    ("cc-by-nc-sa", r"(cc by nc sa|creative commons attribution noncommercial sharealike)"),
    ("cc-by-nc", r"(cc by nc|creative commons attribution noncommercial)"),
    ("cc-by-sa", r"(cc by sa|creative commons attribution sharealike)"),
    ("cc-by-nd", r"(cc by nd|creative commons attribution noderiv)"),
    ("cc-by", r"(cc by\b|creative commons attribution)"),
    ("public-domain", r"(released|dedicated) (in|to) the public domain"),
    ("reserved", r"all rights reserved"),
)
#: A text without one of these (lower case) holds no known sentence.
CUES = ("licen", "gpl", "permission", "software is", "redistribution", "neither the name", "creative commons", "cc0", "cc-by", "cc by", "cc zero", "public domain", "all rights reserved", "an \"as is\"", "an as is")
#: (licence, sequence of identifiers), tried in this order.
RULES = (
    ("MIT", ("mit-title", "mit-grant", "mit-condition", "asis")),
    ("MIT", ("mit-grant", "mit-condition", "asis")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "asis")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "asis")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant", "asis")),
    ("ISC", ("isc-grant",)),
    ("Apache-2.0", ("apache-notice", "apache-asis")),
    ("Apache-2.0", ("spdx-apache",)),
    ("Apache-2.0", ("apache-notice",)),
    ("Apache-2.0", ("apache-title",)),
    ("MIT", ("mit-grant", "mit-condition")),
    ("MIT", ("spdx-mit",)),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-title",)),
    ("BSD-2-Clause", ("spdx-bsd2",)),
    ("BSD-3-Clause", ("spdx-bsd3",)),
    ("BSD", ("bsd-notice",)),
    ("GPL-2.0", ("spdx-gpl2",)),
    ("GPL-3.0", ("spdx-gpl3",)),
    ("LGPL", ("lgpl-notice",)),
    ("AGPL", ("agpl-notice",)),
    ("GPL-3.0", ("gpl3-notice",)),
    ("GPL-2.0", ("gpl2-notice",)),
    ("GPL", ("gpl-notice",)),
    ("MPL-2.0", ("spdx-mpl",)),
    ("MPL-2.0", ("mpl-notice",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("CC-BY-NC-ND", ("cc-by-nc-nd",)),
    ("CC-BY-NC-SA", ("cc-by-nc-sa",)),
    ("CC-BY-NC", ("cc-by-nc",)),
    ("CC-BY-SA", ("cc-by-sa",)),
    ("CC-BY-ND", ("cc-by-nd",)),
    ("CC-BY", ("cc-by",)),
    ("Public-Domain", ("public-domain",)),
    ("All-Rights-Reserved", ("reserved",)),
)
_CUE = "|".join(CUES)
#: CUES in any spelling that normalises to them.
_ANY_CUE = "|".join(dict.fromkeys(re.sub("[^a-z0-9.+]+", "[^a-z0-9.+]+", c.strip('"')) for c in CUES))
#: General identifiers, and the special ones whose sentences hold theirs.
GENERAL = {"gpl-notice": ("gpl2-notice", "gpl3-notice"), "cc-by-nc": ("cc-by-nc-nd", "cc-by-nc-sa"), "cc-by": ("cc-by-nc-nd", "cc-by-nc-sa", "cc-by-nc", "cc-by-sa", "cc-by-nd")}


def _names(sentence: Column) -> Column:
    """Identifiers of a sentence in the order of SENTENCES, without general ones beside their special forms."""
    return F.array_compact(F.array(*[F.when(sentence.rlike(pattern), F.lit(name)) for name, pattern in SENTENCES]))


def _special(held: Column, i: Column) -> Column:
    """Whether the general identifier i stands in held beside a special form."""
    return F.coalesce(*[F.when((i == g) & F.arrays_overlap(held, F.array(*map(F.lit, names))), True) for g, names in GENERAL.items()], F.lit(False))


def _clean(part: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(part), r"[^a-z0-9.+]+", " "))


def paragraphs(text: Column) -> Column:
    """Sentences of a text as they stand, cut at end marks and blank lines but not at other line breaks."""
    joined = F.regexp_replace(F.regexp_replace(text, r"\r", ""), r"\n[ /#*;-]*([a-z])", " $1")
    return F.split(joined, r"[.!?;:]+[\x20\x09]+|[.!?;:]+\n+|\n[\x20\x09/#*;-]*\n+|[.!?;:]+$")


def _identifiers(parts: Column) -> Column:
    """Identifiers of the lines of each part, then those that only the whole part holds. Steps bind what the next uses more than once."""
    cut = F.transform(parts, lambda p: F.struct(p.contains("\n").alias("wraps"), _clean(p).alias("whole"), F.filter(F.transform(F.split(p, r"\n+"), _clean), lambda s: s != "").alias("lines")))

    def named(x: Column) -> Column:
        new = lambda p: x["whole"].rlike(p) & ~F.exists(x["lines"], lambda s: s.rlike(p))
        across = F.filter(F.array(*[F.when(new(p), F.lit(n)) for n, p in SENTENCES]), lambda i: i.isNotNull())
        # each line's names are bound before they are looked at twice
        held = F.transform(x["lines"], lambda s: F.struct(_names(s).alias("n")))
        own = F.flatten(F.transform(held, lambda h: F.filter(h["n"], lambda i: ~_special(h["n"], i))))
        return F.struct(own.alias("own"), F.when(x["wraps"], across).otherwise(F.array().cast("array<string>")).alias("across"))

    def joined(x: Column) -> Column:
        return F.when(F.size(x["across"]) == 0, x["own"]).otherwise(F.filter(F.concat(x["own"], x["across"]), lambda i: ~_special(x["across"], i)))

    return F.flatten(F.transform(F.transform(cut, named), joined))


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """df with license_sentences (identifiers in order) and licenses (names in order of RULES, each once)."""
    kept = drop_names(df, ["license_sentences", "licenses", "__left"])
    t = F.col(text)
    # "identifier:" and "license:" end no sentence
    body = F.regexp_replace(t, r"(?i)(identifier|license):", "$1")
    ids = _identifiers(paragraphs(body))
    found = F.when(F.lower(F.regexp_replace(t, r"\r", "")).rlike(_ANY_CUE), ids).otherwise(F.array().cast("array<string>"))
    staged = kept.withColumn("license_sentences", F.coalesce(found, F.array().cast("array<string>")))
    # Each rule takes its matches out of the sequence, leaving a bar that no other rule spans.
    # Commas are doubled so that neighbours both match: ,a,,b,
    staged = staged.withColumn("__left", F.concat(F.lit(","), F.array_join("license_sentences", ",,"), F.lit(",")))
    state = F.struct(F.col("__left").alias("left"), F.array().cast("array<string>").alias("got"))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("," + ",,".join(seq) + ",").alias("seq")) for name, seq in RULES])
    licenses = F.aggregate(
        rules,
        state,
        lambda acc, r: F.struct(
            F.replace(acc["left"], r["seq"], F.lit("|")).alias("left"),
            F.when(F.contains(acc["left"], r["seq"]), F.array_append(acc["got"], r["name"])).otherwise(acc["got"]).alias("got"),
        ),
        lambda acc: F.array_distinct(acc["got"]),
    )
    return staged.withColumn("licenses", F.when(F.size("license_sentences") > 0, licenses).otherwise(F.array().cast("array<string>"))).drop("__left")


def oracle(table: str = "documents") -> str:
    """DuckDB SQL of the query over scan()."""
    names = ", ".join(f"CASE WHEN regexp_matches(s, '{p}') THEN '{n}' END" for n, p in SENTENCES)
    special = " OR ".join(f"(i = '{g}' AND list_has_any(h, {list(forms)}))" for g, forms in GENERAL.items())
    cues = _CUE.replace("'", "''")
    steps, last = [], "x0"
    for i, (name, seq) in enumerate(RULES):
        pattern = ("," + ",,".join(seq) + ",").replace("'", "''")
        steps.append(f"x{i + 1} AS (SELECT doc_id, ids, replace(l, '{pattern}', '|') AS l, CASE WHEN contains(l, '{pattern}') THEN list_append(got, '{name}') ELSE got END AS got FROM {last})")
        last = f"x{i + 1}"
    return rf"""
WITH d AS (
  SELECT doc_id, text, regexp_matches(lower(coalesce(text, '')), '{cues}') AS cue,
    regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(identifier|license):', '\1', 'gi'), '\r', '', 'g'), '\n[ /#*;-]*([a-z])', ' \1', 'g') AS j FROM {table}),
s AS (
  SELECT doc_id, CASE WHEN cue THEN list_filter(list_transform(string_split_regex(j, '[.!?;:]+[\x20\x09]+|[.!?;:]*\n+|[.!?;:]+$'),
    lambda x: trim(regexp_replace(lower(x), '[^a-z0-9.+]+', ' ', 'g'))), lambda x: x <> '') ELSE [] END AS ss FROM d),
i AS (
  SELECT doc_id, coalesce(flatten(list_transform(list_transform(ss, lambda s: list_filter([{names}], lambda x: x IS NOT NULL)), lambda h: list_filter(h, lambda i: NOT ({special})))), []) AS ids FROM s),
x0 AS (SELECT doc_id, ids, ',' || array_to_string(ids, ',,') || ',' AS l, CAST([] AS VARCHAR[]) AS got FROM i),
{", ".join(steps)}
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_license_sentences, coalesce(array_to_string(ids, ','), '') AS license_sentences,
  coalesce(array_to_string(list_filter(got, lambda g, k: list_position(got, g) = k), ','), '') AS licenses
FROM {last}"""
