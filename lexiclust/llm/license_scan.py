"""License scans by ordered signature rules, in DataFrame functions only.

A rule is a regular expression over the words of a text (A-Z lowered, words
joined by one space) with a label, a priority and a keyword that every match
holds.  The hand-written parts are below: sentences of license texts and, for
each license family, its title and identifiers, which ``TEMPLATES`` turn into
rules of falling priority.  One case-blind search for the keywords decides which
rules a text meets at all, so most texts cost that search only.  A detection is
the interval of words that a rule matches; it is suppressed where a detection of
a better priority (or of the same, if longer or of an earlier rule) holds the
whole interval.  The phrases of the contract are rules of the best priority.

Everything happens within a row: nothing is shuffled and no group is gathered.

Defined results: null text counts as empty; a text without words has 0 words, no
detections, empty labels and score 0; texts are read whole whatever their length;
of detections with equal interval and priority the earlier rule stays; repeated
rows each get the same result; null ids pass through; an empty table gives no
rows; other columns pass through ``detect`` unchanged (columns named like its
outputs are replaced).
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

# The phrases of the contract, as (label, priority, keyword, pattern).
PHRASES = [
    ("mit", 0, "mit", "under the mit license"),
    ("apache-2", 0, "apache", "apache license version 2"),
    ("cc-by-nc", 0, "cc", "cc by nc"),
]

# License families as (label, keyword, title, identifiers).
# Patterns are over lower-case words with one space between them.
FAMILIES = [
    ("mit", "mit", r"mit( x11| expat)?", r"mit"),
    ("mit-0", "mit", r"mit no attribution", r"mit 0"),
    ("apache-2", "apache", r"apache( software)?( license)?( version| v)? ?2( 0)?", r"apache 2( 0)?"),
    ("apache-1.1", "apache", r"apache( software)?( license)?( version| v)? ?1 1", r"apache 1 1"),
    ("bsd-2-clause", "bsd", r"(simplified|freebsd|2 clause|two clause) bsd|bsd( license)? (2 clause|two clause)", r"bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(new|modified|revised|3 clause|three clause) bsd|bsd( license)? (3 clause|three clause)", r"bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(original|old|4 clause|four clause) bsd|bsd( license)? (4 clause|four clause)", r"bsd 4 clause"),
    ("0bsd", "0bsd", r"zero clause 0bsd", r"0bsd"),
    ("isc", "isc", r"isc|internet systems consortium isc", r"isc"),
    ("gpl-1", "gpl", r"(gnu )?gpl( version| v)? ?1( 0)?", r"gpl 1 0( only| or later)?"),
    ("gpl-2", "gpl", r"(gnu )?gpl( version| v)? ?2( 0)?", r"gpl 2 0( only| or later)?"),
    ("gpl-3", "gpl", r"(gnu )?gpl( version| v)? ?3( 0)?", r"gpl 3 0( only| or later)?"),
    ("lgpl-2", "lgpl", r"(gnu )?lgpl( version| v)? ?2( 0)?", r"lgpl 2 0( only| or later)?"),
    ("lgpl-2.1", "lgpl", r"(gnu )?lgpl( version| v)? ?2 1", r"lgpl 2 1( only| or later)?"),
    ("lgpl-3", "lgpl", r"(gnu )?lgpl( version| v)? ?3( 0)?", r"lgpl 3 0( only| or later)?"),
    ("agpl-3", "agpl", r"(gnu )?agpl( version| v)? ?3( 0)?", r"agpl 3 0( only| or later)?"),
    ("gfdl-1.3", "gfdl", r"(gnu )?gfdl( version| v)? ?1 3", r"gfdl 1 3( only| or later)?"),
    ("gpl-2", "gnu", r"gnu general public license( version| v)? ?2( 0)?", r"gnu gpl 2( 0)?"),
    ("gpl-3", "gnu", r"gnu general public license( version| v)? ?3( 0)?", r"gnu gpl 3( 0)?"),
    ("lgpl-2.1", "gnu", r"gnu lesser general public license( version| v)? ?2 1", r"gnu lgpl 2 1"),
    ("lgpl-3", "gnu", r"gnu lesser general public license( version| v)? ?3( 0)?", r"gnu lgpl 3( 0)?"),
    ("agpl-3", "gnu", r"gnu affero general public license( version| v)? ?3( 0)?", r"gnu agpl 3( 0)?"),
    ("gfdl", "gnu", r"gnu free documentation license", r"gnu fdl"),
    ("mpl-1.1", "mpl", r"mpl( version| v)? ?1 1", r"mpl 1 1"),
    ("mpl-2", "mpl", r"mpl( version| v)? ?2( 0)?", r"mpl 2 0"),
    ("mpl-1.1", "mozilla", r"mozilla public license( version| v)? ?1 1", r"mozilla 1 1"),
    ("mpl-2", "mozilla", r"mozilla public license( version| v)? ?2( 0)?", r"mozilla 2 0"),
    ("epl-1", "eclipse", r"eclipse public license( version| v)? ?1( 0)?", r"eclipse 1 0"),
    ("epl-2", "eclipse", r"eclipse public license( version| v)? ?2( 0)?", r"eclipse 2 0"),
    ("epl-2", "epl", r"epl( version| v)? ?2( 0)?", r"epl 2 0"),
    ("cddl-1", "cddl", r"cddl( version| v)? ?1( 0)?", r"cddl 1 0"),
    ("cpl-1", "cpl", r"cpl( version| v)? ?1( 0)?", r"cpl 1 0"),
    ("eupl-1.2", "eupl", r"eupl( version| v)? ?1 2", r"eupl 1 2"),
    ("artistic-2", "artistic", r"artistic license( version| v)? ?2( 0)?", r"artistic 2 0"),
    ("artistic-1", "artistic", r"artistic license( version| v)? ?1( 0)?", r"artistic 1 0( perl)?"),
    ("zlib", "zlib", r"zlib( libpng)?", r"zlib"),
    ("libpng", "libpng", r"libpng( version 2)?", r"libpng 2 0"),
    ("unlicense", "unlicense", r"the unlicense|unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl( version 2)?", r"wtfpl"),
    ("bsl-1", "boost", r"boost software license( version| v)? ?1( 0)?", r"boost 1 0"),
    ("bsl-1", "bsl", r"bsl( version| v)? ?1 0", r"bsl 1 0"),
    ("ms-pl", "microsoft", r"microsoft public license", r"microsoft pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal license", r"microsoft rl"),
    ("ofl-1.1", "sil", r"sil open font license( version| v)?( 1 1)?", r"sil ofl 1 1"),
    ("ofl-1.1", "ofl", r"ofl( version| v)? ?1 1", r"ofl 1 1"),
    ("ncsa", "ncsa", r"(university of illinois )?ncsa( open source)?", r"ncsa"),
    ("postgresql", "postgresql", r"postgresql license", r"postgresql"),
    ("python-2", "psf", r"psf license( version| v)? ?2( 0)?", r"psf 2 0"),
    ("php-3.01", "php", r"php license( version| v)? ?3 01", r"php 3 01"),
    ("ruby", "ruby", r"ruby license", r"ruby"),
    ("vim", "vim", r"vim license", r"vim"),
    ("w3c", "w3c", r"w3c software( notice and)? license", r"w3c"),
    ("x11", "x11", r"x11 license", r"x11"),
    ("afl-3", "afl", r"afl( version| v)? ?3( 0)?", r"afl 3 0"),
    ("osl-3", "osl", r"osl( version| v)? ?3( 0)?", r"osl 3 0"),
    ("odbl-1", "odbl", r"odbl( version| v)?( 1 0)?", r"odbl 1 0"),
    ("pddl-1", "pddl", r"pddl( version| v)?( 1 0)?", r"pddl 1 0"),
    ("cc0", "cc0", r"cc0( 1 0)?( universal)?", r"cc0 1 0"),
    ("cc-by", "cc", r"cc by( [1-4] 0)?", r"cc by [1-4] 0"),
    ("cc-by-sa", "cc", r"cc by sa( [1-4] 0)?", r"cc by sa [1-4] 0"),
    ("cc-by-nd", "cc", r"cc by nd( [1-4] 0)?", r"cc by nd [1-4] 0"),
    ("cc-by-nc", "cc", r"cc by nc( [1-4] 0)?", r"cc by nc [1-4] 0"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa( [1-4] 0)?", r"cc by nc sa [1-4] 0"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd( [1-4] 0)?", r"cc by nc nd [1-4] 0"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike( [1-4] 0)?", r"creative commons by sa"),
    ("cc-by-nd", "creative", r"creative commons attribution no ?deriv(ative)?s( [1-4] 0)?", r"creative commons by nd"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial( [1-4] 0)?", r"creative commons by nc"),
    ("cc-by-nc-sa", "creative", r"creative commons attribution non ?commercial share ?alike( [1-4] 0)?", r"creative commons by nc sa"),
    ("cc-by", "creative", r"creative commons attribution( [1-4] 0)?", r"creative commons by"),
    ("cc0", "creative", r"creative commons zero", r"creative commons cc0"),
]

# How a family's title or identifiers become rules, as (priority,
# what stands before, which of the two, what stands after).
TEMPLATES = [
    (1, "spdx license identifier ", "id", ""),
    (2, "(licen[sc]ed|released|distributed|available|published|provided|redistributed) under (the )?"
        "(terms of )?(the )?", "title", "( licen[sc]e)?"),
    (3, "licen[sc]e ", "id", ""),
    (3, "", "title", " licen[sc]e"),
    (4, "under ", "id", ""),
]

# Sentences of license texts and notices, as (label, priority,
# keyword, pattern).
SENTENCES = [
    ("mit", 1, "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", 2, "substantial", r"shall be included in all copies or substantial portions of the software"),
    ("isc", 1, "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", 1, "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", 2, "redistributions", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", 2, "redistributions", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", 2, "endorse", r"may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", 1, "advertising", r"all advertising materials mentioning features or use of this software must display"),
    ("bsd", 3, "bsd", r"bsd style( licen[sc]e)?"),
    ("apache-2", 1, "apache", r"licensed under the apache license version 2( 0)?( the license)?"),
    ("apache-2", 2, "apache", r"apache org licenses license 2 0"),
    ("apache-2", 2, "apache", r"(the )?asf licenses this file to you under the apache license"),
    ("gpl", 1, "gnu", r"it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", 1, "gnu", r"it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", 1, "gnu", r"it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("gpl", 2, "gnu", r"you should have received a copy of the gnu general public license"),
    ("lgpl", 2, "gnu", r"you should have received a copy of the gnu lesser general public license"),
    ("gpl", 4, "gnu", r"gnu (general public license|gpl)"),
    ("lgpl", 4, "gnu", r"gnu (lesser|library) general public license"),
    ("agpl", 4, "gnu", r"gnu affero general public license"),
    ("mpl-2", 1, "mozilla", r"this source code form is subject to the terms of the mozilla public license( v| version)? ?2 0"),
    ("mpl", 4, "mozilla", r"mozilla public license"),
    ("epl", 4, "eclipse", r"eclipse public license"),
    ("cddl", 4, "cddl", r"common development and distribution license cddl"),
    ("unlicense", 1, "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("zlib", 1, "misrepresented", r"the origin of this software must not be misrepresented"),
    ("bsl-1", 1, "boost", r"distributed under the boost software license version 1 0"),
    ("wtfpl", 1, "fuck", r"do what the fuck you want to public license"),
    ("ofl-1.1", 1, "sil", r"this font software is licensed under the sil open font license"),
    ("cc-by", 2, "creativecommons", r"creativecommons org licenses by [1-4] 0"),
    ("cc-by-sa", 2, "creativecommons", r"creativecommons org licenses by sa [1-4] 0"),
    ("cc-by-nc", 2, "creativecommons", r"creativecommons org licenses by nc [1-4] 0"),
    ("cc-by-nd", 2, "creativecommons", r"creativecommons org licenses by nd [1-4] 0"),
    ("cc-by-nc-sa", 2, "creativecommons", r"creativecommons org licenses by nc sa [1-4] 0"),
    ("cc-by-nc-nd", 2, "creativecommons", r"creativecommons org licenses by nc nd [1-4] 0"),
    ("cc0", 2, "creativecommons", r"creativecommons org publicdomain zero 1 0"),
    ("creative-commons", 4, "creative", r"creative commons( licen[sc]e)?"),
    ("public-domain", 2, "domain", r"(released|dedicated|placed|put) (in|in to|into|to) the public domain"),
    ("public-domain", 4, "domain", r"public domain (dedication|work|notice)"),
    ("proprietary", 3, "proprietary", r"proprietary and confidential"),
    ("proprietary", 3, "reserved", r"copyright( [^ ]+){0,12} all rights reserved"),
    ("proprietary", 4, "reserved", r"all rights reserved"),
    ("no-warranty", 4, "warranty", r"without warranty of any kind( express or implied)?"),
    ("no-warranty", 4, "warranties", r"without warranties or conditions of any kind"),
]

#: how sure a detection of each priority is
CONFIDENCE = [1.0, 1.0, 0.9, 0.75, 0.5]
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: the same on texts whose capitals are not lowered yet
RAW_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def rules() -> list[dict]:
    """All rules, in order: ``rule, label, priority, keyword, pattern``."""
    found = PHRASES + SENTENCES
    for priority, before, kind, after in TEMPLATES:
        for label, keyword, title, ids in FAMILIES:
            found = [*found, (label, priority, keyword, f"{before}({title if kind == 'title' else ids}){after}")]
    # texts hold their words with two spaces between them and one at each end, so that
    # neighbouring matches need not share a space; " ?" makes a space optional
    wide = [(label, priority, keyword, re.sub(r" (?!\?)", "  ", pattern).replace(" ?", "( {2})?"))
            for label, priority, keyword, pattern in found]
    return [{"rule": i, "label": label, "priority": priority, "keyword": keyword, "pattern": f" ({pattern}) "}
            for i, (label, priority, keyword, pattern) in enumerate(wide)]


def _lower(text) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _spaced(text) -> Column:
    """The words of a text, two spaces between them and one at each end."""
    words = F.trim(F.regexp_replace(_lower(text), WORD_BREAK, "  "))
    return F.concat(F.lit(" "), words, F.lit(" "))


def _matches(spaced: Column, rule: Column) -> Column:
    """The detections of one rule: its matches are put between two marks, which
    no word holds, and the words that carry them give the intervals."""
    marked = F.regexp_replace(spaced, rule["pattern"], F.lit(" \u0001$1\u0002 "))

    def places(words, has):
        return F.filter(F.transform(words, lambda w, i: F.when(has(w), i.cast("long"))), lambda i: i.isNotNull())

    def intervals(words):
        ends = places(words, lambda w: w.endswith("\u0002"))
        return F.transform(places(words, lambda w: w.startswith("\u0001")), lambda start, k: F.struct(
            start.alias("first"), (-F.get(ends, k)).alias("_last"), rule["priority"].alias("priority"),
            rule["rule"].alias("rule"), rule["label"].alias("label")))

    return let(F.split(marked.substr(F.lit(2), F.length(marked) - 2), "  "), intervals)


def _unsuppressed(found: Column, priorities: int) -> Column:
    """Of detections in the order of start, then falling end, then rule: those
    that none before of an equal or better priority reaches over."""
    start = F.struct(F.slice(found, 1, 0).alias("kept"), F.array_repeat(F.lit(-1).cast("long"), priorities).alias("reach"))

    def step(state, d):
        last = -d["_last"]
        inside = F.exists(F.slice(state["reach"], 1, d["priority"] + 1), lambda r: r >= last)
        return F.struct(
            F.when(inside, state["kept"]).otherwise(F.concat(state["kept"], F.array(d))).alias("kept"),
            F.transform(state["reach"], lambda r, p: F.when(p == d["priority"], F.greatest(r, last)).otherwise(r)).alias("reach"))

    return F.aggregate(found, start, step, lambda state: state["kept"])


def detect(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words`` and ``detections``, an array of ``first, last``
    (words from 0), ``priority, rule, label`` by place, suppressed ones left out."""
    groups = {}
    for rule in rules():
        groups.setdefault(rule["keyword"], []).append(rule)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    any_keyword = rf"(?<![0-9A-Za-z])(?i:{'|'.join(groups)})(?![0-9A-Za-z])"
    gated = F.from_json(F.lit(json.dumps([{"keyword": f" {k} ", "rules": g} for k, g in groups.items()])),
                        "array<struct<keyword: string, rules: array<struct<rule: int, label: string, priority: int, pattern: string>>>>")

    def scan(spaced):
        near = F.flatten(F.transform(F.filter(gated, lambda g: F.contains(spaced, g["keyword"])), lambda g: g["rules"]))
        met = F.filter(near, lambda r: F.rlike(spaced, r["pattern"]))
        found = F.array_sort(F.flatten(F.transform(met, lambda r: _matches(spaced, r))))
        return F.transform(let(found, lambda x: _unsuppressed(x, len(CONFIDENCE))), lambda d: F.struct(
            d["first"].alias("first"), (-d["_last"]).alias("last"), d["priority"].alias("priority"),
            d["rule"].alias("rule"), d["label"].alias("label")))

    none = F.array().cast("array<struct<first: long, last: long, priority: int, rule: int, label: string>>")
    return docs.withColumns({
        "n_words": F.size(F.array_remove(F.split(text, RAW_BREAK), "")).cast("long"),
        "detections": F.when(F.rlike(text, F.lit(any_keyword)), let(_spaced(text), scan)).otherwise(none)})


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words``, places of the contract's phrases (``n_base, first_word,
    last_word, base_labels``), ``labels`` of all detections that stand, and
    ``score``: the confidence of the best one."""
    base = F.filter("detections", lambda d: d["priority"] == 0)
    firsts = F.transform(base, lambda d: d["first"])

    def joined(found):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda d: d["label"]))), ",")

    sure = F.array_max(F.transform("detections", lambda d: F.get(F.array(*(F.lit(c) for c in CONFIDENCE)), d["priority"])))
    return detect(docs.select(id_col, text_col), text_col).select(
        F.col(id_col).alias("doc_id"), "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(firsts).alias("first_word"), F.array_max(firsts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("detections")).alias("labels"),
        F.coalesce(sure, F.lit(0.0)).alias("score"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_VALUES = ",\n".join(f"({r['rule']}, {_quoted(r['label'])}, {r['priority']}, {_quoted(r['keyword'])}, {_quoted(r['pattern'])})"
                     for r in rules())

SQL = rf"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, ' ' || trim(regexp_replace(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD_BREAK}', '  ', 'g'), ' ') || ' ' AS spaced
  FROM documents),
rules(rule, label, priority, keyword, pattern) AS (VALUES
{_VALUES}),
met AS MATERIALIZED (SELECT r, rule, label, priority, pattern, spaced FROM docs JOIN rules ON contains(spaced, ' ' || keyword || ' ')),
marked AS MATERIALIZED (
  SELECT r, rule, label, priority,
         string_split(trim(regexp_replace(spaced, pattern, ' ' || chr(1) || '\1' || chr(2) || ' ', 'g'), ' '), '  ') AS words
  FROM met),
ends AS (
  SELECT r, rule, label, priority,
         list_filter(list_transform(range(len(words)), lambda i: CASE WHEN starts_with(words[i + 1], chr(1)) THEN i END), lambda i: i IS NOT NULL) AS firsts,
         list_filter(list_transform(range(len(words)), lambda i: CASE WHEN ends_with(words[i + 1], chr(2)) THEN i END), lambda i: i IS NOT NULL) AS lasts
  FROM marked),
found AS MATERIALIZED (
  SELECT r, rule, label, priority, unnest(firsts) AS first, unnest(lasts) AS last FROM ends WHERE len(firsts) > 0),
kept AS MATERIALIZED (
  SELECT * FROM found d WHERE NOT EXISTS (
    SELECT 1 FROM found e WHERE e.r = d.r AND e.first <= d.first AND e.last >= d.last AND e.priority <= d.priority
    AND (e.priority < d.priority OR e.first < d.first OR e.last > d.last OR e.rule < d.rule))),
seen AS (
  SELECT r, count(*) FILTER (priority = 0) AS n_base, min(first) FILTER (priority = 0) AS first_word,
         max(first) FILTER (priority = 0) AS last_word,
         coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (priority = 0), '') AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, min(priority) AS best
  FROM kept GROUP BY r)
SELECT doc_id, CASE WHEN spaced = '  ' THEN 0 ELSE len(string_split(trim(spaced, ' '), '  ')) END::BIGINT AS n_words,
       coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(list_extract([{', '.join(str(c) + '::DOUBLE' for c in CONFIDENCE)}], best + 1), 0::DOUBLE) AS score
FROM docs LEFT JOIN seen ON docs.r = seen.r
"""
