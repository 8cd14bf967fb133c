"""License scans with DataFrame functions alone: ordered signature rules behind a keyword gate.

A text is cut to words once. Only texts that have one of the gate's words go on to the rules; there each rule
is tried if its keyword occurs, matches get their place in words, and a match inside a match of higher priority (or
inside a longer one of the same priority) is dropped: in order of their starts, a match is inside an earlier one if
that one ends behind it, so one pass that remembers the furthest end of each priority finds them all.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.functions.folds import scan as fold
from acervo.llm.common import kept, read, whole_text
from acervo.llm.license_rules import KINDS, Rule, rules

#: What separates words: every ASCII character but digits and letters. A-Z are lower-cased afterwards.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: A text without any of these has no match of any rule or phrase; case of A-Z is ignored.
GATE = (
    r"(?i) (?:licen[sc]|spdx |(?:released|distributed|redistributed|available|published|provided|covered|shared) under |gnu |[al]?gplv?[0-9]? |gfdl "
    r"|(?:mpl|epl|cddl|eupl|wtfpl|cc|cc0) |creative commons |creativecommons |(?:the )?public domain |all rights reserved |proprietary and |unauthorized copying "
    r"|same terms as perl |(?:common|mozilla|eclipse) (?:public|development) |european union |artistic license |do what the |wikipedia org |joinup ec |mit license |dev perl |mozilla org |eclipse org |(?:opensource|apache|opendatacommons|boost|unlicense|wtfpl|perlfoundation"
    r"|python|lang|php|postgresql|openssl|libpng|zlib|openldap|sil) (?:org|net|com) |mariadb com |curl (?:se|haxx) |cecill info "
    r"|hereby granted |redistributions? (?:and use|in binary|of source) |permission to use |is provided as is |without warrant(?:y|ies) |without any warranty |express(?:ed)? or implied |free and unencumbered |free software |altered source )"
)
#: Rules of one keyword that are first tried as one pattern.
TOGETHER = 12
RULE = "array<struct<label:string,priority:int,score:double,pattern:string>>"
#: start and end count words.
DETECTION = "struct<label:string,priority:int,score:double,start:int,end:int>"
RESULTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")
#: Marks before and behind a match; separators, so no word has them.
OPEN, CLOSE = "\x01", "\x02"
_FAR = (1 << 31) - 1


def _spans(text: Column, rule: Column) -> Column:
    """The matches of a rule with the places of their words: marks are set around matches, and marked words counted off."""
    marked = F.split(F.trim(F.regexp_replace(text, rule["pattern"], F.lit(f"{OPEN}$0{CLOSE}"))), " ", -1)
    first = F.array_compact(F.transform(marked, lambda w, i: F.when(F.startswith(w, F.lit(OPEN)), i)))
    last = F.array_compact(F.transform(marked, lambda w, i: F.when(F.endswith(w, F.lit(CLOSE)), i)))

    def one(a: Column, b: Column) -> Column:
        return F.struct(rule["label"].alias("label"), rule["priority"].alias("priority"), rule["score"].alias("score"), a.alias("start"), (b + 1).alias("end"))

    return F.zip_with(first, last, one)


def detections(text: Column) -> Column:
    """All matches of all rules in a text of words, before suppression."""
    by_keyword: dict[str, list[Rule]] = {}
    for r in rules():
        by_keyword.setdefault(r.keyword, []).append(r)
    groups = []
    for keyword, members in by_keyword.items():
        for start in range(0, len(members), TOGETHER):
            some = members[start : start + TOGETHER]
            listed = json.dumps([{"label": r.label, "priority": r.priority, "score": r.score, "pattern": r.pattern} for r in some])
            any_of = "|".join(r.pattern for r in some)
            known = F.from_json(F.lit(listed), RULE)
            groups.append(F.when(F.contains(text, F.lit(keyword)) & text.rlike(any_of), known).otherwise(F.array().cast(RULE)))
    gated = F.flatten(F.array(*groups))
    tried = F.filter(gated, lambda r: F.rlike(text, r["pattern"]))
    return F.flatten(F.transform(tried, lambda r: _spans(text, r)))


def suppressed(found: Column) -> Column:
    """Without what lies inside a match of higher priority, or inside a longer one of the same priority.

    The state has, for each priority, the furthest end so far and the earliest start with it, as one number.
    """
    levels = max(p for p, _ in KINDS.values())
    place = lambda d: d["end"].cast("long") * (1 << 32) + (_FAR - d["start"])

    def step(state: Column, d: Column) -> tuple[Column, Column]:
        higher = F.coalesce(F.array_max(F.slice(state, F.lit(1), d["priority"] - 1)), F.lit(-1).cast("long"))
        inside = (higher >= d["end"].cast("long") * (1 << 32)) | (F.get(state, d["priority"] - 1) > place(d))
        reached = F.transform(state, lambda x, i: F.when(i == d["priority"] - 1, F.greatest(x, place(d))).otherwise(x))
        return reached, F.when(inside, F.array().cast(f"array<{DETECTION}>")).otherwise(F.array(d))

    order = lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("less"), d["priority"].alias("priority"), d.alias("d"))
    ordered = F.transform(F.array_sort(F.transform(found, order)), lambda o: o["d"])
    return fold(ordered, F.array_repeat(F.lit(-1).cast("long"), levels), step, f"array<{DETECTION}>")


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns with n_words, n_base, first_word, last_word, base_labels, labels, score and detections.

    The label of a base phrase is always among labels. score is that of the best match left, 1 for a base
    phrase and 0 without any. A null or empty text has no words and no labels (''). Clashing names follow common.kept.
    Work grows with the words of a text and the matches in it, not with their square.
    """
    keep = kept(keep, RESULTS)
    body = F.trim(F.regexp_replace(whole_text(text), SEPARATORS, " "))
    rows = docs.select(*keep, body.alias("_body"))
    rows = rows.select(*keep, F.when(F.col("_body") == "", "").otherwise(F.concat(F.lit(" "), "_body", F.lit(" "))).alias("_flat"))
    blanks = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    rows = rows.select(
        *keep,
        F.greatest(blanks(F.col("_flat")) - 1, F.lit(0)).cast("long").alias("n_words"),
        F.when(F.col("_flat").rlike(GATE), F.translate("_flat", UPPER, LOWER)).otherwise("").alias("_gated"),
    )
    gated = F.col("_gated")
    either = "(?<= )(?:" + "|".join(PHRASES) + ")(?= )"
    labels = F.array(*[F.when(F.contains(gated, F.lit(f" {p} ")), F.lit(v)) for p, v in PHRASES.items()])
    rows = rows.select(
        "*",
        F.regexp_count(gated, F.lit(either)).cast("long").alias("n_base"),
        F.array_sort(F.array_distinct(F.filter(labels, lambda x: x.isNotNull()))).alias("_base"),
        F.when(gated != "", detections(gated)).otherwise(F.array().cast(f"array<{DETECTION}>")).alias("_found"),
    )
    rows = rows.withColumn("detections", suppressed(F.col("_found")))
    before_first = F.left(gated, F.regexp_instr(gated, F.lit(either)) - 1)
    before_last = F.regexp_extract(gated, f"(?s)^.*(?={either})", 0)
    best = F.array_max(F.transform("detections", lambda d: d["score"]))
    return rows.select(
        *keep,
        "n_words",
        "n_base",
        F.when(F.col("n_base") > 0, blanks(before_first) - 1).cast("long").alias("first_word"),
        F.when(F.col("n_base") > 0, blanks(before_last) - 1).cast("long").alias("last_word"),
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", F.transform("detections", lambda d: d["label"]))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
        "detections",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents")).drop("detections")
