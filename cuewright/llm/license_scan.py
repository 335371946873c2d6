"""Licence detection by ordered signature rules, as one native projection without a shuffle.

Texts are reduced to their words (ASCII letters lower-cased). A keyword prefilter leaves almost all
texts alone; where a keyword stands, only the rules gated by a keyword that begins a word there run over the joined
words. Neither changes a result: every match of a rule holds one of its keywords at the start of a word, and a word of ``GATES``. Each detection is an interval of that string with a priority; an interval inside another of at
least its priority is suppressed.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import LOWER, UPPER, let

#: Words in text before lower-casing; the same words as those of the lower-cased text.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: label -> (keywords of which one must stand in the text, pattern of the licence's name in lower-case words).
FAMILIES = {
    "mit": ("mit", r"(?:the )?mit"),
    "x11": ("x11", r"(?:the )?x11"),
    "apache": ("apache", r"(?:the )?apache(?: software)?"),
    "apache-1.1": ("apache", r"(?:the )?apache(?: software)? (?:license |licence )?(?:version |v)?1 1"),
    "apache-2.0": ("apache", r"(?:the )?apache(?: software)? (?:license |licence )?(?:version |v)?2(?: 0)?"),
    "gpl": ("gpl|general public", r"(?:the )?(?:gnu )?(?:gpl|general public)"),
    "gpl-2.0": ("gpl|general public", r"(?:the )?(?:gnu )?(?:gpl|general public)(?: license| licence)? (?:version |v)?2(?: 0)?"),
    "gpl-3.0": ("gpl|general public", r"(?:the )?(?:gnu )?(?:gpl|general public)(?: license| licence)? (?:version |v)?3(?: 0)?"),
    "lgpl": ("lgpl|lesser general|library general", r"(?:the )?(?:gnu )?(?:lgpl|(?:lesser|library) general public)"),
    "lgpl-2.1": ("lgpl|lesser general", r"(?:the )?(?:gnu )?(?:lgpl|lesser general public)(?: license| licence)? (?:version |v)?2 1"),
    "lgpl-3.0": ("lgpl|lesser general", r"(?:the )?(?:gnu )?(?:lgpl|lesser general public)(?: license| licence)? (?:version |v)?3(?: 0)?"),
    "agpl": ("agpl|affero", r"(?:the )?(?:gnu )?(?:agpl|affero general public)"),
    "agpl-3.0": ("agpl|affero", r"(?:the )?(?:gnu )?(?:agpl|affero general public)(?: license| licence)? (?:version |v)?3(?: 0)?"),
    "gfdl": ("fdl|gfdl|free documentation", r"(?:the )?(?:gnu )?(?:gfdl|fdl|free documentation)"),
    "bsd": ("bsd|berkeley", r"(?:the )?(?:bsd|berkeley software distribution)"),
    "bsd-2-clause": ("bsd|freebsd", r"(?:the )?(?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd|freebsd)"),
    "bsd-3-clause": ("bsd", r"(?:the )?(?:bsd (?:3|three) clause|(?:3|three) clause bsd|(?:new|modified|revised) bsd)"),
    "bsd-4-clause": ("bsd", r"(?:the )?(?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd)"),
    "isc": ("isc|internet systems", r"(?:the )?(?:isc|internet systems consortium)"),
    "mpl": ("mpl|mozilla", r"(?:the )?(?:mpl|mozilla public)"),
    "mpl-1.1": ("mpl|mozilla", r"(?:the )?(?:mpl|mozilla public)(?: license| licence)? (?:version |v)?1 1"),
    "mpl-2.0": ("mpl|mozilla", r"(?:the )?(?:mpl|mozilla public)(?: license| licence)? (?:version |v)?2(?: 0)?"),
    "epl": ("epl|eclipse", r"(?:the )?(?:epl|eclipse public)"),
    "eupl": ("eupl|european union", r"(?:the )?(?:eupl|european union public)"),
    "cddl": ("cddl|common development", r"(?:the )?(?:cddl|common development and distribution)"),
    "cpl": ("cpl|common public", r"(?:the )?(?:cpl|common public)"),
    "artistic": ("artistic", r"(?:the )?(?:perl )?artistic"),
    "boost": ("boost", r"(?:the )?boost(?: software)?"),
    "zlib": ("zlib", r"(?:the )?(?:zlib|zlib libpng)"),
    "unlicense": ("unlicense", r"(?:the )?unlicense"),
    "wtfpl": ("wtf|do what", r"(?:the )?(?:wtfpl|do what the fuck you want to public)"),
    "python": ("psf|python", r"(?:the )?(?:python software foundation|psf|python)"),
    "ruby": ("ruby", r"(?:the )?ruby"),
    "php": ("php", r"(?:the )?php"),
    "postgresql": ("postgres", r"(?:the )?postgres(?:ql)?"),
    "openssl": ("openssl", r"(?:the )?openssl"),
    "ofl": ("ofl|open font", r"(?:the )?(?:sil )?(?:ofl|open font)"),
    "odbl": ("odbl|open database", r"(?:the )?(?:odbl|open database)"),
    "ms-pl": ("ms pl|microsoft", r"(?:the )?(?:ms pl|microsoft public)"),
    "cc0": ("cc0|cc zero|creative commons", r"(?:the )?(?:cc0|cc zero|creative commons zero)(?: 1 0)?"),
    "cc-by": ("cc by|creative commons", r"(?:the )?(?:cc by|creative commons attribution)(?: [1-4] \d)?"),
    "cc-by-sa": ("cc by|creative commons", r"(?:the )?(?:cc by sa|creative commons attribution share ?alike)(?: [1-4] \d)?"),
    "cc-by-nd": ("cc by|creative commons", r"(?:the )?(?:cc by nd|creative commons attribution no ?deriv\w+)(?: [1-4] \d)?"),
    "cc-by-nc": ("cc by|creative commons", r"(?:the )?(?:cc by nc|creative commons attribution non ?commercial)(?: [1-4] \d)?"),
    "cc-by-nc-sa": ("cc by|creative commons", r"(?:the )?(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1-4] \d)?"),
    "cc-by-nc-nd": ("cc by|creative commons", r"(?:the )?(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv\w+)(?: [1-4] \d)?"),
}

#: How a name appears: (pattern around it, priority, confidence). Higher priorities suppress what lies inside.
FORMS = [
    (r"spdx licen[sc]e identifier (?:{name})", 9, 1.0),
    (r"(?:licen[sc]ed|released|distributed|available|published|made available) under (?:the terms of )?(?:{name})(?: licen[sc]e)?(?: as published by the free software foundation)?", 8, 1.0),
    (r"(?:under|subject to|according to) the terms (?:and conditions )?of (?:{name})(?: licen[sc]e)?", 7, 0.98),
    (r"(?:governed|covered|protected) by (?:{name})(?: licen[sc]e)?", 6, 0.95),
    (r"licen[sc]e (?:is )?(?:{name})", 5, 0.9),
    (r"(?:{name}) licen[sc]e", 4, 0.9),
    (r"licen[sc]ed? (?:as|with|by) (?:{name})", 4, 0.85),
]

#: A name with a version stands for itself.
VERSIONED = [(r"(?:{name})(?: licen[sc]e)?", 3, 0.85)]

#: Whole sentences of licence texts: (label, keyword, pattern, priority, confidence).
SENTENCES = [
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software", 9, 1.0),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose", 9, 1.0),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted", 9, 1.0),
    ("gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e", 9, 1.0),
    ("lgpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e", 9, 1.0),
    ("agpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e", 9, 1.0),
    ("apache-2.0", "compliance", r"you may not use this file except in compliance with the licen[sc]e", 8, 0.9),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public licen[sc]e", 9, 1.0),
    ("zlib", "warranty", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", 9, 1.0),
    ("boost", "permission", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software", 9, 1.0),
    ("unlicense", "public domain", r"this is free and unencumbered software released into the public domain", 9, 1.0),
    ("public-domain", "public domain", r"(?:released|placed|dedicated|is) (?:into|in|to) the public domain", 6, 0.9),
    ("public-domain", "public domain", r"public domain dedication", 6, 0.9),
    ("all-rights-reserved", "rights reserved", r"all rights reserved", 5, 0.8),
    ("all-rights-reserved", "rights reserved", r"copyright (?:c )?(?:\d{4} )?(?:\w+ ){0,6}all rights reserved", 6, 0.9),
    ("proprietary", "proprietary", r"proprietary and confidential", 6, 0.8),
    ("proprietary", "permission", r"(?:may not be|no part of this \w+ may be) (?:copied|reproduced|distributed) without (?:the )?(?:prior )?(?:written )?permission", 6, 0.8),
    ("copyright", "copyright", r"copyright (?:c )?\d{4}", 3, 0.4),
    ("mit", "above copyright", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 9, 1.0),
    ("mit", "software is", r"the software is provided as is without warranty of any kind express or implied", 7, 0.8),
    ("mit-0", "mit", r"mit no attribution(?: licen[sc]e)?", 9, 1.0),
    ("isc", "permission", r"provided that the above copyright notice and this permission notice appear in all copies", 8, 0.95),
    ("isc", "software is", r"the software is provided as is and the author disclaims all warranties with regard to this software", 8, 0.95),
    ("bsd", "redistributions", r"redistributions of source code must retain the (?:above|accompanying) copyright notice", 8, 0.95),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the (?:above|accompanying) copyright notice", 8, 0.95),
    ("bsd-3-clause", "neither", r"neither the names? of (?:the )?(?:\w+ ){1,8}nor the names of its contributors may be used to endorse or promote products", 9, 1.0),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledg\w+", 9, 1.0),
    ("bsd", "this software is provided", r"this software is provided by the (?:copyright holders? and contributors|regents and contributors|author) as is", 8, 0.95),
    ("apache-2.0", "licensed", r"licensed to the apache software foundation asf under one or more contributor licen[sc]e agreements", 9, 1.0),
    ("apache-2.0", "unless", r"unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis", 9, 1.0),
    ("apache-2.0", "apache", r"(?:https? )?(?:www )?apache org licenses license 2 0", 9, 1.0),
    ("gpl", "this program|this library|this file", r"this (?:program|library|file) is free software", 8, 0.9),
    ("gpl", "you should", r"you should have received a copy of the gnu general public licen[sc]e", 9, 1.0),
    ("lgpl", "you should", r"you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e", 9, 1.0),
    ("agpl", "you should", r"you should have received a copy of the gnu affero general public licen[sc]e", 9, 1.0),
    ("gpl", "everyone", r"everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document but changing it is not allowed", 8, 0.95),
    ("gpl-3.0", "gplv3", r"gplv3(?: or later)?(?: licen[sc]ed?)?", 7, 0.95),
    ("gpl-2.0", "gplv2", r"gplv2(?: or later)?(?: licen[sc]ed?)?", 7, 0.95),
    ("lgpl-3.0", "lgplv3", r"lgplv3(?: or later)?(?: licen[sc]ed?)?", 7, 0.95),
    ("lgpl-2.1", "lgplv2", r"lgplv2 1(?: or later)?(?: licen[sc]ed?)?", 7, 0.95),
    ("agpl-3.0", "agplv3", r"agplv3(?: or later)?(?: licen[sc]ed?)?", 7, 0.95),
    ("gpl-classpath", "classpath", r"gpl(?:v2)? with (?:the )?classpath exception", 9, 1.0),
    ("gpl-linking", "special exception", r"as a special exception (?:the copyright holders? )?(?:gives? )?you permission to link", 9, 0.95),
    ("gfdl", "permission is granted", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e", 9, 1.0),
    ("mpl-1.1", "contents of this file", r"the contents of this file are subject to the mozilla public licen[sc]e(?: version 1 1)?", 9, 1.0),
    ("mpl-2.0", "if a copy", r"if a copy of the mpl was not distributed with this file you can obtain one at", 9, 1.0),
    ("epl", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e", 9, 1.0),
    ("cddl", "contents of this file", r"the contents of this file are subject to the terms of the common development and distribution licen[sc]e", 9, 1.0),
    ("zlib", "permission is granted", r"permission is granted to anyone to use this software for any purpose including commercial applications", 9, 1.0),
    ("zlib", "origin of", r"the origin of this software must not be misrepresented", 8, 0.95),
    ("libpng", "libpng", r"(?:the )?libpng licen[sc]e", 8, 0.95),
    ("boost", "boost", r"distributed under the boost software licen[sc]e version 1 0", 9, 1.0),
    ("unlicense", "anyone is free", r"anyone is free to copy modify publish use compile sell or distribute this software", 9, 1.0),
    ("wtfpl", "everyone", r"everyone is permitted to copy and distribute verbatim or modified copies of this licen[sc]e document", 8, 0.95),
    ("python", "psf", r"psf is making python available to licensee on an as is basis", 9, 1.0),
    ("php", "this product includes php", r"this product includes php software freely available from", 9, 1.0),
    ("openssl", "this product includes", r"this product includes software developed by the openssl project", 9, 1.0),
    ("apache-1.1", "this product includes", r"this product includes software developed by the apache software foundation", 8, 0.9),
    ("postgresql", "permission to use", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement", 9, 1.0),
    ("hpnd", "permission to use", r"permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee", 9, 1.0),
    ("ofl", "font software", r"(?:this|the) font software is licensed under the sil open font licen[sc]e", 9, 1.0),
    ("odbl", "database is", r"this database is made available under the open database licen[sc]e", 9, 1.0),
    ("pddl", "public domain dedication", r"public domain dedication and licen[sc]e", 9, 1.0),
    ("cc0", "to the extent", r"to the extent possible under law (?:\w+ ){1,8}(?:has|have) waived all copyright", 9, 1.0),
    ("cc-by", "creativecommons", r"(?:https? )?creativecommons org licenses by(?: \d \d)?(?! (?:sa|nd|nc))", 8, 0.95),
    ("cc-by-sa", "creativecommons", r"(?:https? )?creativecommons org licenses by sa(?: \d \d)?", 9, 1.0),
    ("cc-by-nd", "creativecommons", r"(?:https? )?creativecommons org licenses by nd(?: \d \d)?", 9, 1.0),
    ("cc-by-nc", "creativecommons", r"(?:https? )?creativecommons org licenses by nc(?: \d \d)?(?! (?:sa|nd))", 8, 0.95),
    ("cc-by-nc-sa", "creativecommons", r"(?:https? )?creativecommons org licenses by nc sa(?: \d \d)?", 9, 1.0),
    ("cc-by-nc-nd", "creativecommons", r"(?:https? )?creativecommons org licenses by nc nd(?: \d \d)?", 9, 1.0),
    ("cc0", "creativecommons", r"(?:https? )?creativecommons org publicdomain zero(?: 1 0)?", 9, 1.0),
    ("cc-by", "this work is", r"this work is licensed under a creative commons attribution(?: \d \d)? (?:international|unported|generic) licen[sc]e", 9, 1.0),
    ("ms-rl", "microsoft reciprocal|ms rl", r"(?:microsoft reciprocal|ms rl) licen[sc]e", 8, 0.95),
    ("eula", "end user", r"end user licen[sc]e agreement", 7, 0.9),
    ("eula", "by installing", r"by installing (?:copying )?(?:or otherwise )?using (?:this|the) software you agree to (?:be bound by )?the terms of this licen[sc]e", 8, 0.95),
    ("proprietary", "unauthorized|unauthorised", r"unauthori[sz]ed (?:copying|use|reproduction|distribution) (?:or distribution )?of this (?:file|software|work|material|document)(?: via any medium)? is strictly prohibited", 8, 0.95),
    ("proprietary", "confidential", r"confidential and proprietary (?:information|to)", 6, 0.8),
    ("all-rights-reserved", "alle rechte", r"alle rechte vorbehalten", 6, 0.9),
    ("all-rights-reserved", "tous droits", r"tous droits r\S{1,2}serv\S{1,2}s", 6, 0.9),
    ("all-rights-reserved", "todos los derechos", r"todos los derechos reservados", 6, 0.9),
]


def rules() -> list[dict]:
    """Every family in every form, and the sentences: over 400 patterns, highest priority first."""
    found = [
        # a longer name outranks a shorter one in the same form, so "cc by nc" is not also "cc by"
        {"label": label, "key": key, "regex": rf"(?<!\S){form.format(name=name)}(?!\S)", "rank": 100 * rank + min(len(name), 99), "conf": conf}
        for label, (key, name) in FAMILIES.items()
        for form, rank, conf in FORMS + VERSIONED * bool(re.search(r"-\d", label))
    ] + [{"label": a, "key": k, "regex": rf"(?<!\S){r}(?!\S)", "rank": 100 * p + 50, "conf": c} for a, k, r, p, c in SENTENCES]
    return sorted(found, key=lambda r: (-r["rank"], r["label"], r["regex"]))


RULE_TYPE = "array<struct<keys:array<string>,rules:array<struct<label:string,regex:string,rank:int,conf:double>>>>"
#: Every match of a rule or base phrase has one of these in its lower-cased text: a word or part of one, never two words,
#: between which a text may have anything. Of words in one entry all must be there.
GATES = [
    "licen", "spdx", "copyright", "permission", "redistribut", "proprietary", "domain", "reserved", "compliance", "encumbered", "warrant",
    "released", "distributed", "available", "published", "terms", "governed", "covered", "protected", "permitted", "prohibited",
    "gpl", "mpl", "apache", "bsd", "mozilla", "mit attribution", "general public", "free software", "advertising acknowledg", "endorse contributors",
    "copyright holders", "misrepresented", "anyone free", "openssl", "php", "vorbehalten", "droits", "derechos", "provided is",
]


def _gated(text: Column) -> Column:
    low = F.lower(text)
    found = F.lit(False)
    for words in GATES:
        each = [F.contains(low, F.lit(word)) for word in words.split()]
        found = found | reduce(lambda a, b: a & b, each)
    return found


def _by_key() -> list[dict]:
    """The rules under their keywords."""
    found: dict[str, list[dict]] = {}
    for rule in rules():
        found.setdefault(rule["key"], []).append({k: rule[k] for k in ("label", "regex", "rank", "conf")})
    return [{"keys": [f" {k}" for k in key.split("|")], "rules": mine} for key, mine in found.items()]


def _detections(joined: Column) -> Column:
    """array<struct<start, over, rank, label, conf, stop>> of every rule whose keyword begins a word of ``joined``."""
    table = F.from_json(F.lit(json.dumps(_by_key())), RULE_TYPE)

    def places(rule):
        hits = F.regexp_extract_all(joined, rule["regex"], F.lit(0))
        gaps = F.split(joined, rule["regex"], -1)
        step = F.transform(
            F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit")),
            lambda x: F.struct(F.length(x["gap"]).alias("skip"), F.length(x["hit"]).alias("size")),
        )
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("found"))
        return F.aggregate(
            step,
            zero,
            lambda acc, x: F.struct(
                (acc["at"] + x["skip"] + x["size"]).alias("at"),
                F.concat(
                    acc["found"],
                    F.array(F.struct((acc["at"] + x["skip"]).alias("start"), (acc["at"] + x["skip"] + x["size"]).alias("stop"))),
                ).alias("found"),
            ),
            lambda acc: F.transform(
                acc["found"],
                lambda p: F.struct(
                    p["start"].alias("start"), (-p["stop"]).alias("over"), (-rule["rank"]).alias("rank"), rule["label"].alias("label"), rule["conf"].alias("conf"), p["stop"].alias("stop")
                ),
            ),
        )

    begun = F.concat(F.lit(" "), joined)
    opened = F.filter(table, lambda group: F.exists(group["keys"], lambda key: F.contains(begun, key)))
    met = F.filter(F.flatten(F.transform(opened, lambda group: group["rules"])), lambda rule: F.regexp_like(joined, rule["regex"]))
    return F.array_sort(F.flatten(F.transform(met, places)))


def _resolved(joined: Column) -> Column:
    """Fold the detections in order of start (longest first): keep what no interval of its rank or more contains."""
    kept = "struct<spans:array<struct<stop:int,rank:int>>,labels:array<string>,score:double,n:bigint>"
    zero = F.struct(
        F.array().cast("array<struct<stop:int,rank:int>>").alias("spans"),
        F.array().cast("array<string>").alias("labels"),
        F.lit(0.0).alias("score"),
        F.lit(0).cast("bigint").alias("n"),
    ).cast(kept)

    def step(acc, d):
        # spans still open at this start: few, as they all cover one place
        open_spans = F.filter(acc["spans"], lambda s: s["stop"] > d["start"])
        inside = F.exists(open_spans, lambda s: (s["stop"] >= d["stop"]) & (s["rank"] >= -d["rank"]))
        grown = F.struct(
            F.concat(open_spans, F.array(F.struct(d["stop"].alias("stop"), (-d["rank"]).alias("rank")))).alias("spans"),
            F.array_union(acc["labels"], F.array(d["label"])).alias("labels"),
            F.greatest(acc["score"], d["conf"]).alias("score"),
            (acc["n"] + 1).alias("n"),
        )
        return F.when(inside, acc).otherwise(grown).cast(kept)

    return F.aggregate(_detections(joined), zero, step)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words, base phrases and rule detections of every text.

    Returns one row per input row: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, n_detections``.

    * Null text counts as empty: 0 words, no labels (empty strings), score 0.
    * ``n_base`` counts every place where the words of a base phrase stand consecutively, whatever
      separates them; ``first_word`` and ``last_word`` are null without one.
    * ``labels`` joins the base labels and those of the detections that are not suppressed;
      ``score`` is the highest confidence among them (1.0 for a base phrase), 0 if there are none.
    * Repeated rows and ids are scanned each for itself; further columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    edge = r"(?<![^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])", r"(?![^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])"
    phrase = "|".join(edge[0] + GAP.join(p.split()) + edge[1] for p, _ in BASE)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.regexp_count(text, F.lit(RAW_WORD)).cast("long").alias("n_words"),
        F.when(_gated(text), text).alias("_text"),
    )
    words = F.transform(F.regexp_extract_all("_text", F.lit(RAW_WORD), F.lit(0)), lambda w: F.translate(w, UPPER, LOWER))
    rows = rows.withColumn("_words", F.when(F.col("_text").isNotNull(), words)).withColumn("_joined", F.array_join("_words", " "))
    rows = rows.withColumn("_based", F.coalesce(F.col("_text").rlike("(?i)" + phrase), F.lit(False)))

    def starts(p):
        parts = p.split()
        at = lambda i: F.sequence(F.lit(0), F.size("_words") - len(parts))
        hit = lambda i: F.array_join(F.slice("_words", i + 1, len(parts)), " ") == p
        return F.when(F.col("_based") & (F.size("_words") >= len(parts)), F.filter(at(0), hit)).otherwise(F.array().cast("array<int>"))

    rows = rows.withColumn("_starts", F.array(*[starts(p) for p, _ in BASE]))
    rows = rows.withColumn("_all", F.flatten("_starts"))
    base_labels = F.array_compact(F.array(*[F.when(F.size(F.col("_starts")[i]) > 0, F.lit(a)) for i, (_, a) in enumerate(BASE)]))
    rows = rows.withColumn("_base_labels", base_labels)
    rows = rows.withColumn("_found", F.when(F.col("_text").isNotNull(), _resolved(F.col("_joined"))))
    every = F.array_sort(F.array_union("_base_labels", F.coalesce(F.col("_found.labels"), F.array().cast("array<string>"))))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("_all").cast("long").alias("n_base"),
        F.array_min("_all").cast("long").alias("first_word"),
        F.array_max("_all").cast("long").alias("last_word"),
        F.array_join(F.array_sort("_base_labels"), ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.size("_all") > 0, 1.0).otherwise(F.coalesce(F.col("_found.score"), F.lit(0.0))).alias("score"),
        F.coalesce(F.col("_found.n"), F.lit(0)).cast("long").alias("n_detections"),
    )
