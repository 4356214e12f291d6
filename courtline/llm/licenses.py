"""License detection by ordered signature rules over the words of a text.

Words are compared, not characters: a text becomes its words with one blank around each, and rules are regular
expressions over that line. A gate on the raw text keeps every step but the word count to texts that can match at all,
and a rule is tried only where its keyword stands. Each detection is an interval of words with the rule's priority; one
that lies within another of higher priority (or of the same, if longer or listed first) is suppressed. Everything is
array functions on one row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases whose every place counts, and their labels.
BASE = (
    ("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"),
)

# Hand-written signatures: label | priority | keyword | regular expression over words parted by one blank.
# Priority 9: an identifier tag; 8: a grant that names the license; 6: name with version; 4: name; 2: a general clause.
SIGNATURES = """
mit | 8 | mit license | (?:released|licensed|distributed|available|provided) under (?:the )?(?:terms of the )?mit license
mit | 6 | mit license | the mit license mit
mit | 4 | mit license | mit license
mit | 4 | expat license | expat license
mit | 8 | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software
x11 | 4 | x11 license | x11 license
isc | 8 | permission to use copy modify | permission to use copy modify and or distribute this software for any purpose
isc | 4 | isc license | isc license
0bsd | 6 | zero clause bsd | zero clause bsd(?: license)?
bsd | 4 | bsd license | bsd license
bsd-2-clause | 6 | 2 clause bsd | 2 clause bsd(?: license)?
bsd-2-clause | 6 | simplified bsd | simplified bsd license
bsd-3-clause | 6 | 3 clause bsd | 3 clause bsd(?: license)?
bsd-3-clause | 6 | new bsd | new bsd license
bsd-3-clause | 6 | modified bsd | modified bsd license
bsd-4-clause | 6 | 4 clause bsd | 4 clause bsd(?: license)?
bsd | 8 | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | 8 | neither the name | neither the name of .{1,80}? may be used to endorse or promote products
apache | 4 | apache license | apache license
apache | 4 | apache software license | apache software license
apache-1.1 | 6 | version 1 1 | apache (?:software )?license version 1 1
apache-2.0 | 6 | version 2 0 | apache (?:software )?license version 2 0
apache-2.0 | 8 | apache license version 2 0 | (?:released|licensed|distributed|available|provided) under (?:the )?(?:terms of the )?apache license version 2 0
apache-2.0 | 8 | you may not use this file except | you may not use this file except in compliance with the license
apache-2.0 | 6 | licenses license 2 0 | apache org licenses license 2 0
gpl | 4 | gnu general public license | gnu general public license
gpl | 4 | gnu gpl | gnu gpl
lgpl | 4 | lesser general public license | gnu lesser general public license
lgpl | 4 | library general public license | gnu library general public license
agpl | 4 | affero general public license | gnu affero general public license
gpl | 8 | redistribute it and or modify it | you can redistribute it and or modify it under the terms of the gnu general public license
gfdl | 4 | free documentation license | gnu free documentation license
gpl | 6 | general public license | (?:released|licensed|distributed) under (?:the )?(?:terms of the )?gnu general public license
mpl | 4 | mozilla public license | mozilla public license
mpl | 8 | subject to the terms of the mozilla | subject to the terms of the mozilla public license v(?:ersion)? \\d(?: \\d)?
epl | 4 | eclipse public license | eclipse public license
cddl | 4 | common development and distribution | common development and distribution license
cpl | 4 | common public license | common public license
ipl | 4 | ibm public license | ibm public license
eupl | 4 | european union public | european union public licen[cs]e
eupl | 4 | eupl | licensed under the eupl
artistic | 4 | artistic license | (?:the )?artistic license
artistic-2.0 | 6 | artistic license 2 0 | artistic license 2 0
perl | 6 | same terms as perl | (?:under )?the same terms as perl itself
zlib | 4 | zlib license | zlib license
zlib | 6 | zlib libpng | zlib libpng license
zlib | 8 | altered source versions | altered source versions must be plainly marked as such
libpng | 4 | libpng license | libpng license
bsl-1.0 | 4 | boost software license | boost software license
bsl-1.0 | 6 | boost software license version 1 0 | boost software license version 1 0
bsl-1.1 | 4 | business source license | business source license
unlicense | 4 | the unlicense | the unlicense
unlicense | 8 | released into the public domain | this is free and unencumbered software released into the public domain
wtfpl | 6 | what the fuck you want | do what the fuck you want to public license
psf-2.0 | 4 | python software foundation license | python software foundation license
php | 4 | php license | php license
ruby | 4 | ruby license | ruby license
openssl | 4 | openssl license | openssl license
ofl-1.1 | 4 | open font license | (?:sil )?open font license
ofl-1.1 | 6 | open font license version 1 1 | sil open font license version 1 1
afl | 4 | academic free license | academic free license
osl | 4 | open software license | open software license
ecl-2.0 | 4 | educational community license | educational community license
ncsa | 4 | university of illinois | university of illinois ncsa open source license
ms-pl | 4 | microsoft public license | microsoft public license
ms-rl | 4 | microsoft reciprocal license | microsoft reciprocal license
apsl | 4 | apple public source license | apple public source license
cecill | 4 | cecill | (?:licen[cs]e )?cecill(?: [bc])?
qpl | 4 | q public license | q public license
sleepycat | 4 | sleepycat license | sleepycat license
postgresql | 4 | postgresql license | postgresql license
upl | 4 | universal permissive license | universal permissive license
vim | 4 | vim license | vim license
w3c | 4 | w3c software | w3c software (?:notice|license)
unicode | 4 | unicode license | unicode license agreement
elastic-2.0 | 4 | elastic license | elastic license(?: 2 0)?
sspl-1.0 | 4 | server side public license | server side public license
odbl | 4 | open database license | open database license
odc-by | 4 | open data commons attribution | open data commons attribution license
pddl | 4 | public domain dedication and license | public domain dedication and license
cc0 | 4 | cc0 | cc0(?: 1 0)?(?: universal)?
cc-by | 4 | cc by | cc by
cc-by | 4 | creative commons attribution | creative commons attribution(?: license)?
cc | 2 | creative commons | creative commons license
proprietary | 2 | all rights reserved | all rights reserved
proprietary | 4 | proprietary and confidential | proprietary and confidential
public-domain | 4 | public domain | (?:is|are|placed|released) (?:in|into|to) the public domain
copyleft | 2 | copyleft | copyleft
warranty | 2 | without warranty | without warranty of any kind
warranty | 2 | without warranties | without warranties or conditions of any kind
"""

Rule = tuple[str, int, str, str]

# Versions that the families of rules below are made for.
GNU = (("gpl", "", ("1", "2", "3")), ("lgpl", "lesser ", ("2 1", "3")), ("lgpl", "library ", ("2",)), ("agpl", "affero ", ("3",)))
CC_PARTS = (
    ("by", "attribution"), ("by sa", "attribution share ?alike"), ("by nc", "attribution non ?commercial"),
    ("by nd", "attribution no ?deriv(?:ative|ative work)?s"), ("by nc sa", "attribution non ?commercial share ?alike"),
    ("by nc nd", "attribution non ?commercial no ?deriv(?:ative|ative work)?s"),
)
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
DOTTED = (("mpl", "mozilla", ("1 0", "1 1", "2 0")), ("epl", "eclipse", ("1 0", "2 0")), ("afl", "academic free", ("2 1", "3 0")),
          ("osl", "open software", ("2 1", "3 0")), ("eupl", "european union public", ("1 1", "1 2")))
TAGGED = (
    "mit", "isc", "0bsd", "bsd 2 clause", "bsd 3 clause", "bsd 4 clause", "apache 1 1", "apache 2 0", "zlib", "bsl 1 0",
    "unlicense", "wtfpl", "psf 2 0", "ofl 1 1", "ecl 2 0", "ncsa", "ms pl", "ms rl", "cddl 1 0", "cddl 1 1", "cc0 1 0",
    "artistic 2 0", "postgresql", "upl 1 0", "vim", "python 2 0", "openssl", "ruby", "x11", "curl", "json", "sspl 1 0",
)


def _made_rules() -> list[Rule]:
    """Rules for families that differ by version only."""
    out: list[Rule] = []
    for name, kind, versions in GNU:
        for v in versions:
            label = f"{name}-{v.replace(' ', '.')}{'' if ' ' in v else '.0'}"
            said = f"gnu {kind}general public license (?:v|version |v )?{v}(?: 0)?"
            out.append((label, 6, f"{kind}general public license", said))
            out.append((f"{label}-or-later", 7, f"{kind}general public license", f"{said} or (?:at your option )?(?:any )?later(?: version)?"))
            out.append((label, 5, f"{name}v{v}", f"(?:gnu )?{name}v{v}"))
            out.append((label, 9, f"identifier {name} {v}", f"spdx license identifier {name} {v}(?: 0)?(?: only)?"))
            out.append((f"{label}-or-later", 9, f"identifier {name} {v}", f"spdx license identifier {name} {v}(?: 0)? or later"))
    for short, long in CC_PARTS:
        label = "cc-" + short.replace(" ", "-")
        out.append((label, 5, f"cc {short}", f"cc {short}"))
        out.append((label, 5, "creative commons attribution", f"creative commons {long}"))
        out.append((label, 6, "creativecommons", f"creativecommons org licenses {short}"))
        for v in CC_VERSIONS:
            dotted = f"{label}-{v.replace(' ', '.')}"
            out.append((dotted, 6, f"cc {short} {v}", f"cc {short} {v}"))
            out.append((dotted, 6, "creative commons attribution", f"creative commons {long} {v}"))
            out.append((dotted, 7, "creativecommons", f"creativecommons org licenses {short} {v}"))
            out.append((dotted, 9, f"identifier cc {short} {v}", f"spdx license identifier cc {short} {v}"))
    for name, long, versions in DOTTED:
        for v in versions:
            out.append((f"{name}-{v.replace(' ', '.')}", 6, long, f"{long} licen[cs]e (?:v|version |v )?{v}" if "public" in long or "free" in long or "software" in long else f"{long} public license (?:v|version |v )?{v}"))
            out.append((f"{name}-{v.replace(' ', '.')}", 9, f"identifier {name} {v}", f"spdx license identifier {name} {v}"))
    for words in TAGGED:
        out.append((words.replace(" ", "-"), 9, f"identifier {words}", f"spdx license identifier {words}"))
    return out


def rules() -> list[Rule]:
    """All rules in order: (label, priority, keyword, regular expression)."""
    lines = [tuple(part.strip() for part in line.split("|", 3)) for line in SIGNATURES.strip().splitlines()]
    return [(a, int(b), c, d) for a, b, c, d in lines] + _made_rules()


# One of these stands in every text that any rule or phrase can match, whatever parts the words.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = _GAP.replace("[", "[^", 1)
GATE = (
    r"(?i)licen[cs]e|gpl|gnu|cc" + _GAP + r"by|cc0|creative|spdx|permission|redistribut|all" + _GAP + r"rights|public" + _GAP
    + r"domain|propriet|copyleft|warrant|perl|bsd|eupl|cecill|endorse|altered" + _GAP + r"source|w3c" + _GAP + "software"
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST_PRIORITY = 9
_FOUND = "array<struct<first:int,last:int,rule:int,priority:int,label:string>>"


def word_line(text: Column) -> Column:
    """The words of a text, A-Z in lower case, with one blank before, between and after them."""
    spaced = F.regexp_replace(F.concat(F.lit(" "), F.translate(text, _UPPER, _LOWER), F.lit(" ")), _GAP, " ")
    return F.when(spaced == " ", F.lit("")).otherwise(spaced)


def _blanks(piece: Column) -> Column:
    return F.length(piece) - F.length(F.translate(piece, " ", ""))


def _places(line: Column, pattern: Column, rule: Column, priority: Column, label: Column) -> Column:
    """Every match of one pattern as an interval of words (first, beyond the last), in order."""
    matches = F.regexp_extract_all(line, pattern, F.lit(0))
    pieces = F.slice(F.split(line, pattern, -1), F.lit(1), F.size(matches))
    nothing = F.struct(F.lit(-1).alias("at"), F.array().cast(_FOUND).alias("found"))

    def step(state: Column, pair: Column) -> Column:
        first = state["at"] + _blanks(pair["piece"])
        last = first + _blanks(pair["match"])
        here = F.struct(
            first.alias("first"), (last + 1).alias("last"), rule.alias("rule"), priority.alias("priority"), label.alias("label")
        )
        return F.struct(last.alias("at"), F.array_append(state["found"], here).alias("found"))

    zipped = F.arrays_zip(pieces.alias("piece"), matches.alias("match"))
    return F.aggregate(zipped, nothing, step, lambda s: s["found"])


def _detections(line: Column, table: list[Rule]) -> Column:
    own = F.array(*[
        F.struct(
            F.lit(n).alias("rule"), F.lit(priority).alias("priority"), F.lit(f" {keyword}").alias("keyword"),
            F.lit(f"(?<= ){pattern}(?= )").alias("pattern"), F.lit(label).alias("label"),
        )
        for n, (label, priority, keyword, pattern) in enumerate(table)
    ])
    tried = F.filter(own, lambda r: F.contains(line, r["keyword"]))
    return F.flatten(F.transform(tried, lambda r: _places(line, r["pattern"], r["rule"], r["priority"], r["label"])))


def _standing(found: Column, levels: int) -> Column:
    """Labels and highest priority of the detections that do not lie inside one that outranks them.

    One sweep: in order of start, the longest first, then the higher priority, then the rule, whatever may outrank a
    detection stands before it, and the furthest end so far of each priority tells whether one of those holds it.
    """
    ordered = F.array_sort(F.transform(found, lambda d: F.struct(
        d["first"].alias("first"), (-d["last"]).alias("gone"), (-d["priority"]).alias("rank"), d["rule"].alias("rule"),
        d["label"].alias("label"),
    )))
    start = F.struct(
        F.array_repeat(F.lit(-1), levels).alias("ends"), F.array().cast("array<string>").alias("labels"), F.lit(0).alias("most")
    )

    def step(state: Column, d: Column) -> Column:
        last, priority = -d["gone"], -d["rank"]
        held = F.array_max(F.slice(state["ends"], priority + 1, F.lit(levels))) >= last
        return F.struct(
            F.transform(state["ends"], lambda e, n: F.when((n == priority) & (e < last), last).otherwise(e)).alias("ends"),
            F.when(held | F.array_contains(state["labels"], d["label"]), state["labels"])
            .otherwise(F.array_append(state["labels"], d["label"])).alias("labels"),
            F.when(held, state["most"]).otherwise(F.greatest(state["most"], priority)).alias("most"),
        )

    return F.aggregate(ordered, start, step)


def detect(docs: DataFrame, table: list[Rule] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row per row of ``docs``.

    ``docs`` has doc_id and text; others are ignored. Null, empty and wordless texts have no words, no places and empty
    labels. ``score`` is the highest priority of a detection that stands, from 0 (none) to 1. Repeated rows, null ids
    and empty tables pass through as they are.
    """
    table = table or rules()
    text = F.col("text")
    gated = F.coalesce(text.rlike(GATE), F.lit(False))
    n_words = F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", n_words.alias("n_words"), F.when(gated, word_line(text)).alias("line"))
    phrases = F.flatten(F.array(*[
        F.when(F.contains("line", F.lit(f" {phrase} ")), _places(
            F.col("line"), F.lit(f"(?<= ){phrase}(?= )"), F.lit(n), F.lit(0), F.lit(label)
        )).otherwise(F.array().cast(_FOUND))
        for n, (phrase, label) in enumerate(BASE)
    ]))
    none = F.array().cast(_FOUND)
    rows = rows.select(
        "doc_id", "n_words", F.when(F.col("line").isNull(), none).otherwise(phrases).alias("base"),
        F.when(F.col("line").isNull(), none).otherwise(_detections(F.col("line"), table)).alias("found"),
    )
    levels = max((r[1] for r in table), default=0) + 1
    rows = rows.withColumn("standing", _standing(F.col("found"), levels))
    names = lambda c: F.transform(c, lambda d: d["label"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda d: d["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda d: d["first"])).cast("long").alias("last_word"),
        joined(names(F.col("base"))).alias("base_labels"),
        joined(F.concat(names(F.col("base")), F.col("standing.labels"))).alias("labels"),
        (F.col("standing.most") / MOST_PRIORITY).alias("score"),
    )
