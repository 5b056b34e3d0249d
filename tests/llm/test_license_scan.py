"""Scans against a plain reading: all rules on all texts without gates, and each pair of detections compared."""

import re

import pytest

from quarrylight.llm import license_scan, queries
from quarrylight.llm.common import table

DIR = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    base = [(i, label) for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")) for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    line, found = f" {' '.join(words)} ", []
    for order, rule in enumerate(license_scan.rules()):
        for m in re.finditer(f" (?:{rule.pattern})(?= )", line):
            found.append((line[: m.start()].count(" "), line[: m.start()].count(" ") + m.group().count(" "), rule, order))

    def inside(x, y):
        (a, b, rule, order), (c, d, other, earlier) = x, y
        higher = other.priority > rule.priority or other.priority == rule.priority and (d - c > b - a or (d - c == b - a and earlier < order))
        return x is not y and c <= a and b <= d and higher and not other.name.startswith("base:")

    kept = [x for x in found if x[2].name.startswith("base:") or not any(inside(x, y) for y in found)]
    score = 1.0
    for label in {x[2].label for x in kept}:
        score *= 1 - max(x[2].confidence for x in kept if x[2].label == label)
    starts = [i for i, _ in base]
    labels = {x[2].label for x in kept} | {label for _, label in base}
    return (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), 1 - score)


def assert_same(got, texts):
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        want = plain(text)
        assert tuple(got[i])[1:-1] == want[:-1] and got[i]["score"] == pytest.approx(want[-1], abs=1e-12), i


def test_rules():
    known = license_scan.rules()
    assert len(known) > 400 and len({r.name for r in known}) == len(known)
    assert all("," not in r.label for r in known)
    for r in known:  # a gate passes whatever its pattern matches
        assert r.keyword in r.pattern, r
    assert [r.label for r in known[:3]] == ["cc-by", "gpl", "reserved"]


@pytest.mark.parametrize("text, labels", [
    ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
    ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"),
    ("Released under the MIT License.", "mit"),
    ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
    ("SPDX-License-Identifier: LGPL-2.1", "lgpl-2.1"),
    ("see https://creativecommons.org/licenses/by-sa/4.0/", "cc-by-sa-4.0"),
    ("© 2020. All RIGHTS reserved!", "reserved"),
    ("You may redistribute it under the terms of the 3-clause BSD license", "bsd-3-clause"),
    ("the general public, license in hand, all rights.reserved", "gpl,reserved"),
    ("A commit to the mit campus by cc and general public licenses", ""),
])
def test_labels(text, labels):
    known = license_scan.rules()
    _, found = license_scan.detect(text.encode())
    assert ",".join(sorted({known[x.order].label for x in license_scan.surviving(found, known)})) == labels


def test_query_against_plain_reading(spark):
    texts = {r["doc_id"]: r["text"] for r in table(spark, DIR, "documents").collect()}
    out = queries.op13_license_scan(spark, DIR)
    assert out.columns == COLUMNS
    got = {r["doc_id"]: r for r in out.collect()}
    assert_same(got, texts)
    assert sum(r["n_base"] > 0 for r in got.values()) > 3


def test_odd_texts(spark, tmp_path):
    """Null, empty and long texts, letters beyond ASCII, overlapping and repeated phrases, repeated rows, other columns."""
    texts = {
        1: None, 2: "", 3: " \x00\t", 4: "cc by cc by-nc 4.0 cc by", 5: "ÉCC BY ccby CC BY cc—by", 6: "all rights reserved " * 3000, 7: "x" * 300_000 + " general public license",
        8: "gnu lesser general public license version 2.1 or any later version. licensed under the gnu affero general public license v3", 9: "ＣＣ ＢＹ cc,,,by", 10: "Permission is hereby granted, free of charge, to any person obtaining a copy … sublicense",
    }
    rows = [(i, t, "x", 1, 2) for i, t in texts.items()] + [(4, texts[4], None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, scan string, found int, base int").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op13_license_scan(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    assert_same({r["doc_id"]: r for r in out}, texts)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op13_license_scan(spark, f"{tmp_path}/none").count() == 0
