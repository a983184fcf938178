"""License scans: ordered signature rules behind a keyword prefilter, in native column expressions.

A rule is a hand-written regular expression with a label, keywords and a priority: license names in the forms in which
texts refer to them, and sentences of the licenses themselves.  Only texts that pass a gate of single words, one of which
any match holds, are looked at, and of the rules only those of whose keywords the text holds one.  Overlapping detections
are resolved by priority, then length, then place: taken in that order, one stays unless it lies within one that stays
or contains one.  Their places are code points of the document.  The work grows with the square of the number of
detections in one document.

Defined cases: a null or empty text has no words, labels or places and a score of 0; only A-Z are lower-cased, so that
places are those of the text; repeated rows are scanned alike; an empty table gives an empty result; other columns are
left alone.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from tamarack.llm.common import documents, free_name, text_of

#: The base phrases with their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: License families as (label, regular expression of the name, keywords of which any such name holds one;
#: of a keyword of several words the text holds each).  A space stands for any white space.
FAMILIES = (
    ("gpl", r"(?:gnu )?(?:general public license|gpl)", "gpl|general public"),
    ("lgpl", r"(?:gnu )?(?:lesser|library) (?:general public license|gpl)|\blgpl", "lgpl|lesser|library"),
    ("agpl", r"(?:gnu )?affero (?:general public license|gpl)|\bagpl", "agpl|affero"),
    ("gfdl", r"gnu free documentation license|\bgfdl", "gfdl|documentation"),
    ("apache", r"apache (?:software )?license|\bapache[- ]\d", "apache"),
    ("mit", r"\bmit[- ]licen[cs]e\b", "mit"),
    ("x11", r"\bx11 license", "x11"),
    ("bsd", r"\bbsd(?: license)?\b|berkeley software distribution", "bsd|berkeley"),
    ("isc", r"\bisc license", "isc"),
    ("mpl", r"mozilla public license|\bmpl\b", "mozilla|mpl"),
    ("epl", r"eclipse public license|\bepl\b", "eclipse|epl"),
    ("edl", r"eclipse distribution license", "eclipse"),
    ("cddl", r"common development and distribution license|\bcddl\b", "common development|cddl"),
    ("cpl", r"common public license", "common public"),
    ("eupl", r"european union public licen[cs]e|\beupl\b", "european union|eupl"),
    ("cecill", r"\bcecill\b", "cecill"),
    ("artistic", r"artistic license", "artistic"),
    ("perl", r"same terms as perl", "perl"),
    ("zlib", r"\bzlib(?: license)?\b", "zlib"),
    ("libpng", r"\blibpng license", "libpng"),
    ("boost", r"boost software license|\bbsl 1\.0", "boost|bsl"),
    ("unlicense", r"\bunlicense\b", "unlicense"),
    ("wtfpl", r"\bwtfpl\b", "wtfpl"),
    ("openssl", r"openssl license", "openssl"),
    ("php", r"php license", "php"),
    ("python", r"python software foundation license|\bpsf license", "python|psf"),
    ("ruby", r"ruby license", "ruby"),
    ("postgresql", r"postgresql license", "postgresql"),
    ("ncsa", r"\bncsa\b", "ncsa"),
    ("ms-pl", r"microsoft public license|\bms-pl\b", "microsoft|ms-pl"),
    ("ms-rl", r"microsoft reciprocal license|\bms-rl\b", "microsoft|ms-rl"),
    ("osl", r"open software license", "open software"),
    ("afl", r"academic free license", "academic"),
    ("upl", r"universal permissive license", "universal permissive"),
    ("ofl", r"open font license|\bofl\b", "font|ofl"),
    ("odbl", r"open database license|\bodbl\b", "open database|odbl"),
    ("pddl", r"public domain dedication and license|\bpddl\b", "dedication|pddl"),
    ("odc-by", r"open data commons attribution", "open data commons"),
    ("cc0", r"\bcc0\b|creative commons zero", "cc0|creative commons"),
    ("cc-by", r"(?:\bcc[ -]by\b|creative commons attribution)(?![ -](?:nc|nd|sa|non|no|share))", "cc|creative commons"),
    ("cc-by-sa", r"\bcc[ -]by-sa\b|creative commons attribution[ -]share ?alike", "cc|creative commons"),
    ("cc-by-nd", r"\bcc[ -]by-nd\b|creative commons attribution[ -]no ?deriv\w+", "cc|creative commons"),
    ("cc-by-nc", r"(?:\bcc[ -]by-nc\b|creative commons attribution[ -]non ?commercial)(?!-(?:sa|nd|share|no))", "cc|creative commons"),
    ("cc-by-nc-sa", r"\bcc[ -]by-nc-sa\b|creative commons attribution[ -]non ?commercial[ -]share ?alike", "cc|creative commons"),
    ("cc-by-nc-nd", r"\bcc[ -]by-nc-nd\b|creative commons attribution[ -]non ?commercial[ -]no ?deriv\w+", "cc|creative commons"),
    ("ogl", r"open government licen[cs]e", "open government"),
    ("sspl", r"server side public license|\bsspl\b", "server side|sspl"),
    ("busl", r"business source license|\bbusl\b", "business source|busl"),
    ("elastic", r"elastic license", "elastic"),
    ("vim", r"vim license", "vim"),
    ("tex", r"latex project public license|\blppl\b", "latex|lppl"),
    ("beerware", r"beer-?ware", "beer"),
)
#: What a rule of a family looks for, as (regular expression around the name, suffix of the label, priority, weight).
FORMS = (
    (r"spdx-license-identifier: ?(?:{0})[\w.+-]*", "", 9, 1.0),
    (r"(?:licen[sc]ed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:{0})(?:,? (?:version |v\.? ?)?\d(?:\.\d)*)?", "", 8, 0.95),
    (r"(?:{0}),? (?:version |v\.? ?)?\d(?:\.\d)*(?: or (?:any )?later)?", "-versioned", 6, 0.9),
    (r"(?:terms|conditions) of (?:the )?(?:{0})", "", 5, 0.85),
    (r"(?:subject to|governed by|see|under) (?:the )?(?:{0})", "", 4, 0.8),
    (r"(?:{0})", "", 2, 0.6),
)
#: Notices without a family, as (label, regular expression, keyword, priority, weight).
NOTICES = (
    ("copyright-notice", r"copyright (?:\(c\) |© )?\d{4}", "copyright", 3, 0.4),
    ("all-rights-reserved", r"all rights reserved", "all rights", 3, 0.5),
    ("mit", r"spdx-license-identifier: ?mit\b", "spdx", 9, 1.0),
    ("public-domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain|public domain", "public domain", 4, 0.6),
    ("no-warranty", r"without warrant(?:y|ies) of any kind|without any warranty", "warrant", 1, 0.3),
    ("permission-grant", r"permission is hereby granted,? free of charge", "permission", 7, 0.8),
    ("redistribution", r"redistribution and use in source and binary forms", "redistribution", 7, 0.8),
    ("proprietary", r"proprietary and confidential|unauthori[sz]ed (?:copying|reproduction|distribution)", "propriet|unauthori", 6, 0.7),
    ("no-derivatives", r"no derivative works", "derivative", 3, 0.5),
    ("non-commercial", r"(?:for )?non-?commercial use only|not for commercial use", "commercial", 4, 0.6),
    ("terms-of-use", r"terms of (?:use|service)", "terms", 1, 0.2),
    ("mit", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software", "permission", 8, 0.95),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies", "permission", 7, 0.9),
    ("mit-no-attribution", r"mit no attribution|\bmit-0\b", "mit", 8, 0.9),
    ("isc", r"permission to use, copy, modify,? (?:and/or|and) distribute this software for any purpose", "permission", 8, 0.9),
    ("hpnd", r"permission to use, copy, modify,? and distribute this software and its documentation", "permission", 8, 0.8),
    ("bsd", r"redistributions of source code must retain the above copyright notice", "redistributions", 8, 0.9),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice", "redistributions", 8, 0.9),
    ("bsd-3-clause", r"neither the name of (?:\w+ ){1,9}nor the names of its contributors", "neither", 8, 0.9),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software", "advertising", 8, 0.9),
    ("bsd-2-clause", r"\b(?:simplified bsd|bsd[- ]2[- ]clause)\b", "bsd", 8, 0.9),
    ("bsd-3-clause", r"\b(?:(?:new|modified|revised) bsd|bsd[- ]3[- ]clause)\b", "bsd", 8, 0.9),
    ("bsd-0-clause", r"\b(?:zero[- ]clause bsd|bsd[- ]0[- ]clause|0bsd)\b", "bsd", 8, 0.9),
    ("apache", r"unless required by applicable law or agreed to in writing, software distributed under the license", "applicable law", 8, 0.95),
    ("apache", r"you may not use this file except in compliance with the license", "compliance", 8, 0.9),
    ("apache", r"see the license for the specific language governing permissions and limitations", "permissions", 7, 0.9),
    ("apache", r"\bapl ?v?2(?:\.0)?\b|\basl ?2(?:\.0)?\b", "apl|asl", 5, 0.5),
    ("gpl", r"this program is free software[:;,]? you can redistribute it", "redistribute", 8, 0.95),
    ("gpl", r"you should have received a copy of the gnu general public license", "received", 8, 0.95),
    ("gpl-later", r"either version \d(?:\.\d)? of the license, or \(?at your option\)? any later version", "either version", 7, 0.9),
    ("gpl", r"without even the implied warranty of merchantability or fitness for a particular purpose", "implied warranty", 6, 0.7),
    ("gpl-classpath", r"classpath exception", "classpath", 6, 0.7),
    ("copyleft", r"\bcopyleft\b", "copyleft", 2, 0.4),
    ("lgpl", r"this library is free software[:;,]? you can redistribute it", "library", 8, 0.95),
    ("agpl", r"network server is intended specifically|interacting with it remotely through a computer network", "network", 7, 0.7),
    ("mpl", r"this source code form is subject to the terms of the mozilla public license", "source code form", 9, 0.95),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse public license", "accompanying", 9, 0.95),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution license", "contents", 9, 0.95),
    ("zlib", r"this software is provided 'as-is', without any express or implied warranty", "as-is", 8, 0.9),
    ("zlib", r"the origin of this software must not be misrepresented", "misrepresented", 8, 0.9),
    ("as-is", r"provided (?:by the copyright holders and contributors )?[\"']as is[\"'],? (?:and|without)", "as is", 2, 0.4),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered", 9, 0.95),
    ("cc0", r"has waived all copyright and related or neighboring rights|no rights reserved", "waived|no rights", 8, 0.9),
    ("cc-by", r"\bcc-by-\d(?:\.\d)?\b", "cc-by", 8, 0.9),
    ("cc-by-sa", r"creative commons share ?alike|\bcc-by-sa-\d(?:\.\d)?\b", "commons|cc-by-sa", 8, 0.9),
    ("public-domain-mark", r"no known copyright restrictions", "restrictions", 5, 0.7),
    ("ofl", r"reserved font name", "font", 7, 0.8),
    ("wtfpl", r"do what the fuck you want to public license", "what", 9, 0.95),
    ("artistic", r"the intent of this document is to state the conditions under which a package may be copied", "conditions", 8, 0.9),
    ("json", r"the software shall be used for good, not evil", "evil", 8, 0.9),
    ("fair-use", r"\bfair use\b", "fair", 1, 0.2),
    ("shareware", r"\b(?:shareware|freeware)\b", "shareware|freeware", 3, 0.5),
    ("dual-license", r"(?:dual|multi)[- ]licen[cs]ed", "licen", 5, 0.6),
    ("no-license", r"no license,? (?:express or implied|is granted)", "no license", 5, 0.5),
    ("evaluation", r"for (?:evaluation|internal use|personal use) (?:purposes )?only", "only", 4, 0.5),
    ("trademark", r"registered trademarks? of", "trademark", 1, 0.2),
    ("redistribution-prohibited", r"may not be (?:reproduced|redistributed|copied)(?: or \w+)? without", "may not", 6, 0.7),
    ("written-permission", r"without (?:the )?(?:express|prior)(?: prior)? written (?:permission|consent)", "written", 5, 0.6),
    ("eula", r"\beula\b|end[- ]user licen[cs]e agreement", "eula|agreement", 6, 0.8),
    ("patent-grant", r"(?:perpetual|worldwide|royalty-free),? (?:\w+[-,]? ?){0,3}patent license", "patent", 6, 0.8),
    ("mit", r"in no event shall the authors or copyright holders be liable for any claim, damages or other liability", "copyright holders", 8, 0.9),
    ("mit", r"the warranties of merchantability, fitness for a particular purpose and noninfringement", "noninfringement", 7, 0.8),
    ("bsd", r"in no event shall the copyright (?:owner|holder)s? or contributors be liable", "contributors", 8, 0.9),
    ("bsd", r"\bbsd[- ]style licen[cs]e", "bsd", 7, 0.7),
    ("apache", r"licensed to the apache software foundation \(asf\) under one or more contributor license agreements", "apache", 9, 0.95),
    ("apache", r"this product includes software developed (?:at|by) the apache software foundation", "apache", 8, 0.9),
    ("apache", r"grant of (?:patent|copyright) license", "grant", 6, 0.6),
    ("gpl", r"the licenses for most software are designed to take away your freedom", "freedom", 8, 0.9),
    ("gpl", r"\bgplv[123]\b", "gplv", 7, 0.8),
    ("gpl-only", r"\bgpl-[123]\.0-only\b", "gpl-", 8, 0.9),
    ("gpl-later", r"\bgpl-[123]\.0(?:-or-later|\+)", "gpl-", 8, 0.9),
    ("gpl", r"\bgpl[- ]compatible\b", "gpl", 5, 0.4),
    ("gpl-linking-exception", r"gives? (?:you )?permission to link", "permission link", 7, 0.8),
    ("mpl", r"if a copy of the mpl was not distributed with this file", "mpl", 9, 0.95),
    ("mpl", r"incompatible with secondary licenses", "secondary", 7, 0.8),
    ("epl", r"made available under the following secondary licenses when the conditions", "secondary", 8, 0.8),
    ("cddl", r"you can obtain a copy of the license at usr/src/opensolaris\.license", "opensolaris", 9, 0.9),
    ("cddl", r"include this cddl header", "cddl", 8, 0.9),
    ("isc", r"\bisc[- ]style licen[cs]e", "isc", 7, 0.7),
    ("zlib", r"permission is granted to anyone to use this software for any purpose, including commercial applications", "anyone", 9, 0.95),
    ("zlib", r"this notice may not be removed or altered from any source distribution", "altered", 8, 0.9),
    ("libpng", r"this copyright notice may not be removed or altered from any source or altered source distribution", "altered", 9, 0.9),
    ("boost", r"granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "organization", 9, 0.95),
    ("ssleay", r"original ssleay license", "ssleay", 8, 0.9),
    ("php", r"this source file is subject to version \d\.\d of the php license", "php", 9, 0.95),
    ("python", r"\bpsf license agreement", "psf", 8, 0.9),
    ("python", r"beopen\.com (?:open source )?license agreement", "beopen", 8, 0.9),
    ("python", r"hereby grants licensee a nonexclusive, royalty-free, world-?wide license", "licensee", 8, 0.8),
    ("ncsa", r"university of illinois/ncsa open source license", "illinois", 9, 0.95),
    ("ms-pl", r"if you use the software, you accept this license", "accept", 8, 0.8),
    ("ms-pl", r"if you bring a patent claim against any contributor", "patent claim", 8, 0.8),
    ("ofl", r"this font software is licensed under the sil open font license", "font", 9, 0.95),
    ("dbcl", r"database contents license", "database", 7, 0.8),
    ("odbl", r"any rights in individual contents of the database are licensed under", "database", 8, 0.9),
    ("creative-commons", r"this work is licensed under a creative commons", "commons", 4, 0.7),
    ("creative-commons", r"you must give appropriate credit, provide a link to the license", "appropriate credit", 7, 0.7),
    ("share-alike", r"you must distribute your contributions under the same license", "contributions", 7, 0.7),
    ("commons-clause", r"commons clause (?:license condition|restriction)", "commons clause", 8, 0.9),
    ("public-domain", r"the authors? disclaims? copyright to this source code", "disclaim", 8, 0.9),
    ("proprietary", r"this software is the confidential and proprietary information", "propriet", 8, 0.9),
    ("proprietary", r"used only (?:in accordance with|under) the terms of (?:the|your) license agreement", "license agreement", 7, 0.7),
    ("no-warranty", r"disclaims? all warranties", "warranties", 4, 0.4),
    ("no-warranty", r"makes? no (?:representations or )?warrant(?:y|ies)", "warrant", 4, 0.4),
    ("copyright-notice", r"protected by copyright(?: law)?", "protected", 4, 0.4),
    ("copyright-notice", r"portions copyright", "portions", 4, 0.4),
    ("patent-pending", r"patents? pending", "pending", 4, 0.4),
    ("cla", r"contributor license agreement", "contributor", 5, 0.5),
    ("open-source", r"\b(?:osi[- ]approved|open[- ]source|permissive) licen[cs]e", "licen", 4, 0.5),
    ("non-commercial", r"licen[cs]ed for (?:non-?commercial|academic|research|educational) use", "licen", 6, 0.7),
    ("grant", r"\b(?:perpetual|royalty-free|non-?exclusive|worldwide|irrevocable),? licen[cs]e", "licen", 4, 0.5),
    ("sublicense", r"\bsub-?licen[cs](?:e|ing|able)\b", "licen", 3, 0.4),
    ("site-license", r"\b(?:site|volume|enterprise|commercial|per-seat) licen[cs]e", "licen", 5, 0.5),
    ("license-file", r"see (?:the )?(?:file )?(?:licen[cs]e|copying)(?:\.txt|\.md)? (?:file )?for (?:the )?(?:full )?(?:licen[cs]e|copyright) (?:text|details|terms)", "see", 6, 0.6),
)
#: Any match of a rule or base phrase holds "licen", one of SIGNS, all words of one of PAIRS, or one of NAMES as a word.
#: Each is a single word, as the words of a name may stand on two lines.
SIGNS = ("licen", "copyright", "warrant", "redistribution", "propriet", "unauthori", "derivative", "gpl", "apache", "commons", "berkeley", "beerware", "beer-ware",
    "permission", "contributors", "advertising", "redistribut", "classpath", "copyleft", "unencumbered", "as-is", "misrepresented", "shareware", "freeware", "trademark", "patent")
PAIRS = (("mit", "attribution"), ("network", "intended"), ("computer", "network"), ("waived", "rights"), ("no", "rights", "reserved"), ("font", "name"), ("package", "copied"), ("good", "evil"), ("fair", "use"), ("use", "only"), ("evaluation", "only"), ("may", "not", "be"), ("written", "consent"), ("as is", "provided"), ("as", "is'"), ("as", 'is"'), ("all", "rights", "reserved"), ("public", "domain"), ("permission", "hereby"), ("terms", "use"), ("terms", "service"), ("terms", "perl"), ("commercial", "use"))
NAMES = ("bsd", "mpl", "epl", "cddl", "eupl", "cecill", "zlib", "bsl", "wtfpl", "ncsa", "ms-pl", "ms-rl", "ofl", "odbl", "pddl", "cc0", "sspl", "busl", "lppl", "eula", "0bsd", "mit-0")
#: Of these the rules ask no word's end.
PREFIXES = ("gfdl", r"apl\s?v?2", r"asl\s?2", r"cc-by-\d", "cc-by-sa-")


def _loose(pattern: str) -> str:
    """The pattern with any white space for a space."""
    pattern = re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(" ", r"\s"), pattern)
    return pattern.replace(" ?", r"\s*").replace(" ", r"\s+")


def rules() -> list[dict]:
    """All rules, ordered by priority: every form of every family, then the notices."""
    out = [(label + suffix, label, form.format(name), keys, priority, weight) for form, suffix, priority, weight in FORMS for label, name, keys in FAMILIES]
    out += [(label, label, *rest) for label, *rest in NOTICES]
    names = ("label", "family", "pattern", "keys", "priority", "weight")
    return [dict(zip(names, r)) | {"pattern": _loose(r[2]), "keys": [k.split() for k in r[3].split("|")]} for r in sorted(out, key=lambda r: -r[4])]


def _gate(x: str) -> str:
    """Whether a text in small letters may hold a name or notice."""
    parts = [f"contains({x}, '{w}')" for w in SIGNS]
    quoted = lambda w: "'" + w.replace("'", "\\'") + "'"
    parts += ["(" + " AND ".join(f"contains({x}, {quoted(w)})" for w in words) + ")" for words in PAIRS]
    parts.append(rf"{x} rlike r'\b(?:(?:{'|'.join(NAMES)})\b|{'|'.join(PREFIXES)})'")
    return " OR ".join(parts)


def _spaces(x: str) -> str:
    return f"(length({x}) - length(replace({x}, ' ', '')))"


def license_scans(docs: DataFrame, text: str = "text", into: str = "licenses") -> DataFrame:
    """``docs`` with a struct column ``into``: word count, base places, base labels, all labels, detections and a score."""
    import json

    t, small, low, norm, pieces, place, found = (free_name(docs, n) for n in ("_t", "_small", "_low", "_norm", "_pieces", "_place", "_found"))
    d = docs.withColumn(t, text_of(text)).withColumn(small, F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    has = f"{_gate(small)} OR (contains({small}, 'by') AND {small} rlike '(^|[^a-z])cc[^a-z]')"
    d = d.withColumn(low, F.when(F.expr(has), F.col(small)))
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(small, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" "))
    d = d.withColumn(norm, F.when(F.col(low).isNotNull(), words))
    # per phrase the text cut at its places
    cuts = F.array(*(F.split(norm, f"(?<= ){p}(?= )") for p, _ in PHRASES))
    d = d.withColumn(pieces, F.when(F.col(norm).isNotNull(), cuts))
    parts = ", ".join(
        f"struct(get({pieces}, {i}) AS x, '{label}' AS label, {len(p.split())} AS len)" for i, (p, label) in enumerate(PHRASES)
    )
    d = d.withColumn(
        place,
        F.expr(f"""transform(filter(array({parts}), p -> size(p.x) > 1), p -> struct(CAST(size(p.x) - 1 AS long) AS n, p.label AS label,
            CAST({_spaces('get(p.x, 0)')} - 1 AS long) AS first, CAST({_spaces(norm)} - 1 - ({_spaces('get(p.x, size(p.x) - 1)')} - 1) - p.len AS long) AS last))"""),
    )
    schema = "array<struct<label: string, family: string, pattern: string, keys: array<array<string>>, priority: int, weight: double>>"
    known = F.from_json(F.lit(json.dumps(rules())), schema)
    d = d.withColumn(rule_at := free_name(d, "_rules"), known)
    # texts of a rule and of what lies between give the intervals
    spans = f"""transform(array(struct(regexp_extract_all({low}, r.pattern, 0) AS m, split({low}, r.pattern) AS s)), p ->
        transform(p.m, (x, i) -> struct(aggregate(slice(p.s, 1, i + 1), 0, (a, y) -> a + length(y)) + aggregate(slice(p.m, 1, i), 0, (a, y) -> a + length(y)) AS b,
            length(x) AS n, r.priority AS priority, r.label AS label, r.family AS family, r.weight AS weight)))[0]"""
    every = f"flatten(transform(filter({rule_at}, r -> exists(r.keys, k -> forall(k, w -> contains({low}, w)))), r -> {spans}))"
    ordered = f"array_sort({every}, (x, y) -> CASE WHEN x.priority != y.priority THEN y.priority - x.priority WHEN x.n != y.n THEN y.n - x.n WHEN x.b != y.b THEN x.b - y.b WHEN x.label < y.label THEN -1 WHEN x.label > y.label THEN 1 ELSE 0 END)"
    kind = "array<struct<b: int, n: int, priority: int, label: string, family: string, weight: double>>"
    nested = "(x.b >= k.b AND x.b + x.n <= k.b + k.n) OR (x.b <= k.b AND x.b + x.n >= k.b + k.n)"
    kept = f"aggregate({ordered}, CAST(array() AS {kind}), (a, x) -> CASE WHEN exists(a, k -> {nested}) THEN a ELSE array_append(a, x) END)"
    sweep = f"array_sort({kept}, (x, y) -> CASE WHEN x.b != y.b THEN x.b - y.b ELSE x.n - y.n END)"
    d = d.withColumn(found, F.expr(f"CASE WHEN {norm} IS NOT NULL THEN {sweep} END"))
    total = lambda f, field: F.expr(f"{f}(transform({place}, p -> p.{field}))")
    base = F.expr(f"coalesce(array_sort(transform({place}, p -> p.label)), array())")
    own = F.expr(f"coalesce(flatten(transform({found}, x -> array(x.label, x.family))), array())")
    result = F.struct(
        F.regexp_count(t, F.lit(r"[0-9A-Za-z\x{80}-\x{10ffff}]+")).cast("long").alias("n_words"),
        F.expr(f"coalesce(aggregate({place}, 0L, (a, p) -> a + p.n), 0L)").alias("n_base"),
        total("array_min", "first").alias("first_word"),
        total("array_max", "last").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        F.expr(f"greatest(CASE WHEN size({place}) > 0 THEN 0.6D ELSE 0D END, coalesce(array_max(transform({found}, x -> x.weight)), 0D))").alias("score"),
        F.expr(f"coalesce(transform({found}, x -> concat_ws(':', x.b, x.b + x.n, x.label)), array())").alias("detections"),
    )
    # behind a generator, filters on the result don't repeat the expressions below
    return d.select(*docs.columns, F.explode(F.array(result)).alias(free_name(docs, into)))


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = license_scans(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "licenses.*")
    return d.withColumn("detections", F.array_join("detections", ";"))


