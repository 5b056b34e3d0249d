"""License scans: ordered signature rules on a text's words, gated by keywords; contained detections are suppressed."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of words: ASCII letters and digits, and all of letters beyond ASCII; capitals become small, the rest is space.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: The phrases that always count, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Licenses by SPDX name in small letters: label | word that must occur | name as a pattern over words with one space between.
#: Longer names come before shorter ones of the same family.
NAMES = """
0bsd | bsd | (?:0|zero) ?clause bsd
afl-3.0 | academic | academic free licen[cs]e(?: v| version)? 3 0
agpl-1.0 | affero | affero general public licen[cs]e(?: v| version)? ?1(?: 0)?
agpl-3.0 | affero | (?:gnu )?affero general public licen[cs]e(?: v| version)? ?3(?: 0)?
agpl-3.0 | agpl | (?:gnu )?agpl ?v?3(?: 0)?
agpl | affero | (?:gnu )?affero general public licen[cs]e
apache-1.0 | apache | apache(?: software)?(?: licen[cs]e)?(?: v| version)? ?1 0
apache-1.1 | apache | apache(?: software)?(?: licen[cs]e)?(?: v| version)? ?1 1
apache-2.0 | apache | apache(?: software)?(?: licen[cs]e)?(?: v| version)? ?2(?: 0)?
apache-2.0 | asl | asl ?v?2(?: 0)?
apache | apache | apache(?: software)? licen[cs]e
artistic-1.0 | artistic | (?:perl )?artistic licen[cs]e(?: v| version)? 1 0
artistic-2.0 | artistic | artistic licen[cs]e(?: v| version)? 2(?: 0)?
artistic | artistic | artistic licen[cs]e
blueoak-1.0.0 | oak | blue oak model licen[cs]e(?: 1 0 0)?
bsd-1-clause | bsd | (?:bsd 1 clause|(?:1|one) clause bsd)(?: licen[cs]e)?
bsd-2-clause | bsd | (?:bsd 2 clause|(?:2|two) clause bsd|simplified bsd|freebsd)(?: licen[cs]e)?
bsd-3-clause | bsd | (?:bsd 3 clause|(?:3|three) clause bsd|(?:new|modified|revised) bsd)(?: licen[cs]e)?
bsd-4-clause | bsd | (?:bsd 4 clause|(?:4|four) clause bsd|original bsd)(?: licen[cs]e)?
bsd | bsd | bsd(?: style)? licen[cs]e
bsl-1.0 | boost | boost software licen[cs]e(?: v| version)?(?: 1(?: 0)?)?
bsl-1.1 | business | business source licen[cs]e(?: v| version)?(?: 1 1)?
cc0-1.0 | cc | cc ?0(?: 1 0)?(?: universal)?
cc0-1.0 | zero | (?:creative commons |cc )zero(?: v1 0| 1 0)?(?: universal)?
cc-by-nc-nd-3.0 | cc | cc by nc nd 3 0
cc-by-nc-nd-4.0 | cc | cc by nc nd 4 0
cc-by-nc-nd | cc | cc by nc nd
cc-by-nc-sa-2.0 | cc | cc by nc sa 2 0
cc-by-nc-sa-3.0 | cc | cc by nc sa 3 0
cc-by-nc-sa-4.0 | cc | cc by nc sa 4 0
cc-by-nc-sa | cc | cc by nc sa
cc-by-nc-3.0 | cc | cc by nc 3 0
cc-by-nc-4.0 | cc | cc by nc 4 0
cc-by-nc | cc | cc by nc
cc-by-nd-4.0 | cc | cc by nd 4 0
cc-by-nd | cc | cc by nd
cc-by-sa-2.5 | cc | cc by sa 2 5
cc-by-sa-3.0 | cc | cc by sa 3 0
cc-by-sa-4.0 | cc | cc by sa 4 0
cc-by-sa | cc | cc by sa
cc-by-2.0 | cc | cc by 2 0
cc-by-2.5 | cc | cc by 2 5
cc-by-3.0 | cc | cc by 3 0
cc-by-4.0 | cc | cc by 4 0
cc-by-nc-nd | commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?
cc-by-nc-sa-4.0 | commons | creative commons attribution non ?commercial share ?alike 4 0(?: international)?
cc-by-nc-sa | commons | creative commons attribution non ?commercial share ?alike
cc-by-nc-4.0 | commons | creative commons attribution non ?commercial 4 0(?: international)?
cc-by-nc | commons | creative commons attribution non ?commercial
cc-by-nd | commons | creative commons attribution no ?deriv(?:ative)?s?(?: works)?
cc-by-sa-4.0 | commons | creative commons attribution share ?alike 4 0(?: international)?
cc-by-sa-3.0 | commons | creative commons attribution share ?alike 3 0(?: unported)?
cc-by-sa | commons | creative commons attribution share ?alike
cc-by-4.0 | commons | creative commons attribution 4 0(?: international)?
cc-by | commons | creative commons attribution
cddl-1.0 | cddl | cddl(?: v| version)? ?1 0
cddl-1.1 | cddl | cddl(?: v| version)? ?1 1
cddl | distribution | common development and distribution licen[cs]e
cecill-2.1 | cecill | cecill(?: v| version)? ?2 1
cecill | cecill | cecill(?: b| c)?
cpl-1.0 | common | common public licen[cs]e(?: v| version)? ?(?:1 0)?
ecl-2.0 | educational | educational community licen[cs]e(?: v| version)? ?2(?: 0)?
epl-1.0 | eclipse | eclipse public licen[cs]e(?: v| version)? ?1(?: 0)?
epl-2.0 | eclipse | eclipse public licen[cs]e(?: v| version)? ?2(?: 0)?
epl | eclipse | eclipse public licen[cs]e
eupl-1.1 | eupl | eupl(?: v| version)? ?1 1
eupl-1.2 | eupl | eupl(?: v| version)? ?1 2
eupl | union | european union public licen[cs]e
gfdl-1.2 | documentation | (?:gnu )?free documentation licen[cs]e(?: v| version)? ?1 2
gfdl-1.3 | documentation | (?:gnu )?free documentation licen[cs]e(?: v| version)? ?1 3
gfdl | documentation | (?:gnu )?free documentation licen[cs]e
gpl-1.0 | general | (?:gnu )?general public licen[cs]e(?: v| version)? ?1(?: 0)?
gpl-2.0 | general | (?:gnu )?general public licen[cs]e(?: v| version)? ?2(?: 0)?
gpl-3.0 | general | (?:gnu )?general public licen[cs]e(?: v| version)? ?3(?: 0)?
gpl-1.0 | gpl | (?:gnu )?gpl(?: v| version)? ?1(?: 0)?
gpl-2.0 | gplv2 | (?:gnu )?gplv2(?: 0)?
gpl-2.0 | gpl | (?:gnu )?gpl(?: v| version)? ?2(?: 0)?
gpl-3.0 | gplv3 | (?:gnu )?gplv3(?: 0)?
gpl-3.0 | gpl | (?:gnu )?gpl(?: v| version)? ?3(?: 0)?
isc | isc | isc licen[cs]e
lgpl-2.0 | library | (?:gnu )?library general public licen[cs]e(?: v| version)?(?: 2(?: 0)?)?
lgpl-2.1 | lesser | (?:gnu )?lesser general public licen[cs]e(?: v| version)? ?2 1
lgpl-3.0 | lesser | (?:gnu )?lesser general public licen[cs]e(?: v| version)? ?3(?: 0)?
lgpl | lesser | (?:gnu )?lesser general public licen[cs]e
lgpl-2.1 | lgpl | (?:gnu )?lgpl(?: v| version)? ?2 1
lgpl-3.0 | lgpl | (?:gnu )?lgpl(?: v| version)? ?3(?: 0)?
mit-0 | mit | mit (?:0|no attribution)(?: licen[cs]e)?
mit | mit | (?:the )?mit(?: x11| expat)?(?: style)? licen[cs]e
mit | expat | expat licen[cs]e
mpl-1.0 | mozilla | mozilla public licen[cs]e(?: v| version)? ?1 0
mpl-1.1 | mozilla | mozilla public licen[cs]e(?: v| version)? ?1 1
mpl-2.0 | mozilla | mozilla public licen[cs]e(?: v| version)? ?2(?: 0)?
mpl-2.0 | mpl | mpl(?: v| version)? ?2(?: 0)?
mpl | mozilla | mozilla public licen[cs]e
ms-pl | microsoft | microsoft public licen[cs]e
ms-rl | microsoft | microsoft reciprocal licen[cs]e
ncsa | illinois | university of illinois(?: ncsa)? open source licen[cs]e
odbl-1.0 | odbl | odbl(?: v| version)?(?: 1 0)?
odbl-1.0 | database | open (?:data commons open )?database licen[cs]e
odc-by-1.0 | odc | odc by(?: 1 0)?
ofl-1.1 | font | (?:sil )?open font licen[cs]e(?: v| version)?(?: 1 1)?
osl-3.0 | open | open software licen[cs]e(?: v| version)? ?3(?: 0)?
pddl-1.0 | pddl | pddl(?: v| version)?(?: 1 0)?
php-3.01 | php | php licen[cs]e(?: v| version)?(?: 3 0 ?1)?
postgresql | postgresql | postgresql licen[cs]e
psf-2.0 | python | python software foundation licen[cs]e(?: v| version)?(?: 2(?: 0)?)?
unlicense | unlicense | (?:the )?unlicense
upl-1.0 | universal | universal permissive licen[cs]e(?: v| version)?(?: 1 0)?
wtfpl | wtfpl | wtfpl
w3c | w3c | w3c software(?: notice)?(?: and)? licen[cs]e
zlib | zlib | zlib(?: libpng)? licen[cs]e
zpl-2.1 | zope | zope public licen[cs]e(?: v| version)?(?: 2 1)?
"""

#: Sentences that stand in the texts of licenses themselves: label | word that must occur | pattern.
TEXTS = """
afl | academic | licensed under the academic free license
agpl-3.0 | affero | this is free software licensed under the gnu affero general public license
apache-2.0 | compliance | you may not use this file except in compliance with the license
apache-2.0 | applicable | unless required by applicable law or agreed to in writing software distributed under the (?:apache )?license
bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | endorse | neither the name of [^ ]+(?: [^ ]+){0,8} nor the names of (?:its|their) contributors may be used to endorse
bsl-1.0 | accompanying | obtaining a copy of the software and accompanying documentation covered by this license
cc0-1.0 | waive | waive all copyright and related or neighboring rights
gpl | redistribute | you can redistribute it and or modify it under the terms of the gnu general public license
gpl-or-later | either | either version [23] of the license or (?:at your option )?any later version
isc | fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
lgpl | redistribute | you can redistribute it and or modify it under the terms of the gnu lesser general public license
mit | hereby | permission is hereby granted free of charge to any person obtaining a copy
mit | sublicense | to use copy modify merge publish distribute sublicense and or sell copies
mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public license
no-warranty | warranty | without warranty of any kind (?:express|either expressed?) or implied
no-warranty | merchantability | without even the implied warranty of merchantability
ofl-1.1 | font | this font software is licensed under the sil open font license
proprietary | proprietary | (?:this (?:software|work|document) is )?(?:strictly )?(?:confidential and proprietary|proprietary and confidential)
proprietary | reproduced | no part of this (?:work|book|publication|document) may be reproduced
proprietary | permission | (?:may not be|unauthori[sz]ed) (?:copied|reproduced|redistributed|copying|reproduction)(?: [^ ]+){0,6} without (?:the )?(?:prior )?(?:express )?(?:written )?permission
public-domain | domain | (?:released|dedicated|placed) (?:in|into|to) the public domain
public-domain | domain | (?:is|are) in the public domain
unlicense | unencumbered | this is free and unencumbered software released into the public domain
zlib | misrepresented | the origin of this software must not be misrepresented
"""

#: How names are used: form, its priority, its confidence, and the pattern round a name (``{n}``) or a label's words (``{i}``).
FORMS = (
    ("tag", 4, 0.99, "spdx license identifier {i}(?: only| or later| plus)?"),
    ("address", 3, 0.95, "(?:opensource|spdx|creativecommons|gnu|apache|mozilla) org (?:licen[cs]es? )?{i}"),
    ("notice", 2, 0.9, "(?:dual )?(?:licen[cs]ed|released|distributed|published|available|provided|covered|shared|redistributed)(?: only| solely| freely)? (?:under|by)(?: an?| the)?(?: terms(?: and conditions)? of(?: the)?)? {n}(?: licen[cs]e)?(?: or(?: \\(?at your option\\)?)?(?: any)? later(?: version)?)?"),
    ("mention", 1, 0.6, "{n}"),
)
TEXT_FORM, BASE_FORM = ("text", 5, 0.97), ("base", 6, 0.5)


@dataclass(frozen=True)
class Rule:
    """``pattern`` matches words with one space between; it runs only on texts in which ``keyword`` is a part of some word."""

    name: str
    label: str
    priority: int
    confidence: float
    keyword: str
    pattern: str


@cache
def rules() -> tuple[Rule, ...]:
    """All rules in order: of two that match the same words with the same priority the earlier counts."""
    made = [Rule(f"base:{phrase}", label, *BASE_FORM[1:], max(phrase.split(), key=len), phrase) for phrase, label in BASE.items()]
    lines = lambda text: [[part.strip() for part in line.split("|", 2)] for line in text.strip().splitlines()]
    made += [Rule(f"text:{label}:{n}", label, *TEXT_FORM[1:], word, pattern) for n, (label, word, pattern) in enumerate(lines(TEXTS))]
    names = lines(NAMES)
    for form, priority, confidence, around in FORMS:
        for n, (label, word, pattern) in enumerate(names):
            if "{i}" in around:
                if label in [x[0] for x in names[:n]]:
                    continue
                spelt, shared = re.sub(r"[^a-z0-9]+", " ", label), form == "address" and label.startswith("cc-")
                # The label alone names the license here, so its first word is the one to look for; addresses of shared ones leave out "cc".
                made.append(Rule(f"{form}:{label}", label, priority, confidence, "creativecommons" if shared else spelt.split()[0], around.format(i=spelt.removeprefix("cc ") if shared else spelt)))
            else:
                made.append(Rule(f"{form}:{label}:{n}", label, priority, confidence, word, around.format(n=pattern)))
    return tuple(made)


@dataclass(frozen=True)
class Found:
    start: int  #: the first word
    end: int  #: the word behind the last
    order: int  #: of the rule


def surviving(found: list[Found], known: tuple[Rule, ...]) -> list[Found]:
    """Detections in order of place, without those inside another of a higher priority, or of the same priority that is longer or earlier in the list of rules.

    Base detections stay. One pass: sorted by start, whatever contains a detection
    comes before it, so the farthest end of each priority so far decides.
    """
    kept, reach = [], {}
    for x in sorted(found, key=lambda x: (x.start, -x.end, -known[x.order].priority, x.order)):
        own = known[x.order].priority
        if own == BASE_FORM[1] or all(end < x.end for priority, end in reach.items() if own <= priority < BASE_FORM[1]):
            kept.append(x)
        reach[own] = max(reach.get(own, 0), x.end)
    return kept


@cache
def _compiled() -> dict[bytes, list[tuple[int, re.Pattern]]]:
    gates: dict[bytes, list[tuple[int, re.Pattern]]] = {}
    for order, rule in enumerate(rules()):
        gates.setdefault(rule.keyword.encode(), []).append((order, re.compile(b" (?:" + rule.pattern.encode() + b")(?= )")))
    return gates


def detect(text: bytes | None) -> tuple[int, list[Found]]:
    """How many words a text has, and all places where a rule matches."""
    words = (text or b"").translate(WORDS).split()
    line = b" " + b" ".join(words) + b" "
    found = []
    for keyword, patterns in _compiled().items():
        if keyword not in line:
            continue
        for order, pattern in patterns:
            at, before = 0, 0  # a place in the line, and the words before it
            for m in pattern.finditer(line):
                before += line.count(b" ", at, m.start())
                at = m.start()
                found.append(Found(before, before + line.count(b" ", m.start(), m.end()), order))
    return len(words), found


FOUND = T.StructType([T.StructField("label", T.StringType()), T.StructField("rule", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("confidence", T.DoubleType())])
SCAN = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("found", T.ArrayType(FOUND))])


def scanned(text: str | Column) -> Column:
    """A struct of a text's number of words and its detections: label, rule, first word, word behind the last, confidence.

    Whole texts are read, in time linear in their length; words are those of ``WORDS``, and
    a rule's words stand with anything but word letters between. Null counts as empty: no
    word, no detection. Repeated rows are scanned each. The column depends on nothing but the text.
    """

    @F.arrow_udf(SCAN)
    def scan(texts: pa.Array) -> pa.Array:
        known, rows = rules(), []
        for value in texts:  # one text at a time is a Python object
            n, found = detect(value.as_py())
            rows.append({"n_words": n, "found": [{"label": known[x.order].label, "rule": known[x.order].name, "start": x.start, "end": x.end, "confidence": known[x.order].confidence} for x in surviving(found, known)]})
        from pyspark.sql.pandas.types import to_arrow_type

        return pa.array(rows, to_arrow_type(SCAN))

    return scan((F.col(text) if isinstance(text, str) else text).cast("binary"))


def base_only(found: str | Column) -> Column:
    return F.filter(found, lambda x: x["rule"].startswith("base:"))


def labels_of(found: str | Column) -> Column:
    """The distinct labels, sorted, with commas between."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: x["label"]))), ",")


def score_of(found: str | Column) -> Column:
    """How sure it is that a text carries a license, 0 to 1: one less the chance that each label's surest detection is wrong."""
    labels = F.array_distinct(F.transform(found, lambda x: x["label"]))
    wrong = F.transform(labels, lambda name: 1 - F.array_max(F.transform(F.filter(found, lambda x: x["label"] == name), lambda x: x["confidence"])))
    return 1 - F.aggregate(wrong, F.lit(1.0), lambda a, b: a * b)
