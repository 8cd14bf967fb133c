"""License scans against a plain restatement of base phrases and rules."""

import re

import pytest

from acervo.llm.license_rules import BODIES, GRANT, rules
from acervo.llm.license_scan import GATE, PHRASES, scan

RULES = rules()
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    text = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    words = WORDS.findall(text)
    flat = f" {' '.join(words)} " if words else ""
    starts, base = [], set()
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i : i + len(parts)] == parts:
                starts.append(i)
                base.add(label)
    found = [(r.label, r.priority, r.score, m.start(), m.end()) for r in RULES for m in re.finditer(r.pattern, flat)]
    longer = lambda e, d: e[4] - e[3] > d[4] - d[3]
    left = [d for d in found if not any(e[3] <= d[3] and e[4] >= d[4] and (e[1] < d[1] or (e[1] == d[1] and longer(e, d))) for e in found)]
    score = 1.0 if starts else max((d[2] for d in left), default=0.0)
    labels = base | {d[0] for d in left}
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


TEXTS = [
    None,
    "",
    " .,;\n",
    "plain words only",
    "Released under the MIT License. Under the MIT license, again; under the mit license",
    "Licensed under the Apache License, Version 2.0.",
    "CC BY-NC 4.0 and cc by nc cc by nc",
    "cc_by_nc-sa 4.0",
    "This work is licensed under the GNU General Public License, version 3.",
    "SPDX-License-Identifier: GPL-3.0-or-later",
    "see https://creativecommons.org/licenses/by-nc-nd/4.0/",
    "UNDER THE MİT LICENSE, under the mıt license, under the mít license, apache license version 20",
    "K under the mit license",
    "all rights reserved " * 40,
    "x" * 50_000 + " gplv3 " + "y " * 20_000,
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the “Software”), to deal",
    "Redistribution and use in source and binary forms, with or without modification, are permitted. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Neither the name of X nor of Y may be used to endorse or promote products derived from this software",
    "THIS SOFTWARE IS PROVIDED BY US ''AS IS'' AND ANY EXPRESS OR IMPLIED WARRANTIES; the software is provided 'as is', without warranty of any kind",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3",
    "mit licence and gplv2 under the mit license licensed under the gplv2 license cc0 " * 30,
]


def test_against_plain(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = scan(df).drop("detections").collect()
    assert len(got) == len(rows)
    for row in got:
        assert tuple(row)[1:] == plain(TEXTS[row.doc_id]), TEXTS[row.doc_id] and TEXTS[row.doc_id][:80]


def test_rules_are_many_and_pass_the_gate():
    assert len(RULES) > 300
    flat = lambda body: re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)*\)\??|\[(.)[^\]]*\]\??", lambda m: m[1] if m[1] is not None else m[2], body)
    for rule in RULES:
        body = rule.pattern[len("(?<= )(?:") : -len(")(?= )")]
        for _ in range(4):
            body = flat(body)
        body = body.replace(".{0,900}?", "").replace(".{0,120}?", "")
        body = body.replace(" ?", " ").replace(",?", "").replace("?", "").replace("\\w+", "xx")
        text = f" {body} "
        assert re.search(rule.pattern, text), (rule, text)
        assert rule.keyword in text, rule
        assert re.search(GATE, text), (rule, text)


def test_priority_and_containment(spark):
    df = spark.createDataFrame([(1, "Distributed under the GNU General Public License version 3")], "doc_id long, text string")
    row = scan(df).first()
    assert row.labels == "gpl-3" and len(row.detections) == 1 and row.score == pytest.approx(0.9)


def test_many_mentions(spark):
    """A text of 100,000 mentions takes seconds; what is found is what a shorter text of the kind has."""
    import time

    unit = "licensed under the mit license and gplv3 or apache license version 2 "
    df = spark.createDataFrame([(1, unit * 33_334), (2, unit * 20)], "doc_id long, text string")
    scan(df.where("doc_id = 2")).collect()
    began = time.perf_counter()
    row = scan(df.where("doc_id = 1")).selectExpr("n_words", "n_base", "labels", "size(detections) AS n").first()
    few = scan(df.where("doc_id = 2")).selectExpr("labels", "size(detections) AS n").first()
    assert (row.n_words, row.n_base, row.labels) == (12 * 33_334, 2 * 33_334, few.labels)
    assert row.n // 33_334 == few.n // 20 and time.perf_counter() - began < 120


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "gplv3", "a", 5)], "doc_id long, text string, labels string, start int")
    row = scan(df, keep=("doc_id", "labels", "start")).first()
    assert row.__fields__[:3] == ["doc_id", "start", "n_words"] and (row.labels, row.start) == ("gpl-3", 5)
    with pytest.raises(ValueError, match="begin with _"):
        scan(df, keep=("_flat",))


def test_empty_table(spark):
    assert scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_grant_verb(spark):
    verbs = re.match(r"\(\?:([^()]*)\) under ", GRANT)[1].replace("licen[sc]ed", "licensed|licenced").split("|")
    assert "available" in verbs
    names = ["GNU General Public License", "LGPL", "ISC"]  # neither a title nor, but for LGPL, a bare name
    texts = [f"It is {verb} under {the}{name}." for verb in verbs for the in ("", "the ", "the terms of the ") for name in names]
    for row in scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).drop("detections").collect():
        assert tuple(row)[1:] == plain(texts[row.doc_id]), texts[row.doc_id]
        assert row.labels and row.score == pytest.approx(0.9), texts[row.doc_id]
