"""Typed entities with exact offsets, themes, masking, cross references and counts.

Every row's patterns are applied in one projection over one scan; nothing is shuffled until a summary asks for it.
Whole columns of texts go through scanning, texts inside arrays through the expressions here; both give the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.functions.lexicons import CROSS_REFERENCE, ENTITY_PATTERNS, THEMES
from acervo.functions.folds import let, scan
from acervo.functions.regexes import bounded, render
from acervo.functions.spans import folded, matches, placed
from acervo.functions.text import mask, title
from acervo.operators import scanning

ENTITY = "struct<ini:int,ord:int,pos:int,fim:int,tipo:string,valor:string,texto_original:string,confianca:double,area:string>"


MATCH = "array<struct<ord:int,pos:int,gap:int,width:int,tipo:string,valor:string,texto_original:string>>"


def _entity(number: int, kind: str, masked: bool, mask_original: bool):
    """A match as an entity of pattern `number`."""
    tipo = F.lit(kind)
    sensitive = masked and kind in ("cpf", "cnpj")

    def row(m: Column, i: Column) -> Column:
        return F.struct(
            F.lit(number).alias("ord"),
            i.alias("pos"),
            m["gap"].alias("gap"),
            m["width"].alias("width"),
            tipo.alias("tipo"),
            (mask(m["valor"], tipo) if sensitive else m["valor"]).alias("valor"),
            (mask(m["original"], tipo) if sensitive and mask_original else m["original"]).alias("texto_original"),
        )

    return row


def pattern_entities(text: Column, masked: bool = True, mask_original: bool = False, kinds: tuple[str, ...] | None = None) -> Column:
    """All matches of all patterns; ord is the pattern's place and pos the match's, which decide ties.

    Masking covers valor; the matched text stays as it is unless mask_original asks for more.
    """
    parts = []
    for number, (kind, pattern, ignore_case, borders) in enumerate(ENTITY_PATTERNS):
        if kinds and kind not in kinds:
            continue
        java = render(bounded(pattern) if borders else pattern, ignore_case)
        grouped = "(" in pattern.replace("(?:", "")
        found = F.transform(matches(text, java, 1 if grouped else None), _entity(number, kind, masked, mask_original)).cast(MATCH)
        start = _beginning(pattern)
        parts.append(F.when(F.contains(folded(text), F.lit(start)), found).otherwise(F.array().cast(MATCH)) if start else found)
    names = ("ord", "pos", "tipo", "valor", "texto_original")
    found = placed(F.flatten(F.array(*parts)), names, "array<struct<ini:int,fim:int,ord:int,pos:int,tipo:string,valor:string,texto_original:string>>")
    none = F.lit(None).cast("string").alias("area")
    return F.transform(found, lambda e: F.struct(*[e[n].alias(n) for n in ("ini", "ord", "pos", "fim", *names[2:])], F.lit(0.95).alias("confianca"), none))


def _beginning(pattern: str) -> str:
    """The letters, in lower case, that all matches of a pattern begin with; texts without them need no search."""
    first, rest = re.match(r"(?:\[(\w)\w\])?([^\W\d_]*|§)", pattern).groups()
    return (first or "").lower() + rest.lower()


def themes(text: Column) -> Column:
    """For each theme with a term in the lower-cased text, its first term by the list's order, where that first occurs."""
    lower = F.lower(text)
    rows = []
    for number, (area, terms) in enumerate(THEMES.items()):
        listed = F.array(*[F.lit(t) for t in terms])
        term = F.get(F.filter(listed, lambda t: F.contains(lower, t)), F.lit(0))
        start = F.position(term, lower) - 1
        rows.append(
            F.when(
                term.isNotNull(),
                F.struct(
                    start.alias("ini"),
                    F.lit(len(ENTITY_PATTERNS) + number).alias("ord"),
                    F.lit(0).alias("pos"),
                    (start + F.length(term)).alias("fim"),
                    F.lit("tema_juridico").alias("tipo"),
                    title(F.lit(area)).alias("valor"),
                    term.alias("texto_original"),
                    F.lit(0.85).alias("confianca"),
                    F.lit(area).alias("area"),
                ),
            )
        )
    return F.filter(F.array(*rows), lambda r: r.isNotNull())


def deduplicated(found: Column) -> Column:
    """Of entities with one (start, end, type) the first by pattern order."""
    kind = f"array<{ENTITY}>"
    ordered = F.array_sort(found.cast(kind))

    def step(state: Column, r: Column) -> tuple[Column, Column]:
        """The state has the start of the last entity and the ends and types met at it."""
        key = F.concat_ws(" ", r["fim"].cast("string"), r["tipo"])
        same = state["ini"] == r["ini"]
        known = same & F.array_contains(state["met"], key)
        met = F.when(same, F.concat(state["met"], F.array(key))).otherwise(F.array(key))
        return F.struct(r["ini"].alias("ini"), met.alias("met")), F.when(known, F.array().cast(kind)).otherwise(F.array(r))

    return scan(ordered, F.struct(F.lit(-1).alias("ini"), F.array().cast("array<string>").alias("met")), step, kind)


def entities(text: Column, masked: bool = True, kinds: tuple[str, ...] | None = None) -> Column:
    """Pattern entities and themes without duplicates, in order of start; kinds names the only types to look for."""
    parts = [pattern_entities(text, masked, kinds=kinds)] if not kinds or set(kinds) != {"tema_juridico"} else []
    if not kinds or "tema_juridico" in kinds:
        parts.append(themes(text))
    return deduplicated(F.concat(*[p.cast(f"array<{ENTITY}>") for p in parts]))


def extract(docs: DataFrame, masked: bool = True, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """A row for each entity of docs (doc_id, text), with its number in the document."""
    found = docs.select("doc_id", F.posexplode(scanning.entities(F.col("text"), masked, kinds)).alias("n", "e"))
    return found.select("doc_id", F.col("n").cast("long").alias("n"), "e.tipo", "e.valor", "e.texto_original", F.col("e.ini").cast("long").alias("ini"), F.col("e.fim").cast("long").alias("fim"), "e.confianca", "e.area")


def types(docs: DataFrame) -> DataFrame:
    """The types that entities of docs (text) have, without making the entities."""
    return scanning.kinds(docs)


def summary(found: DataFrame) -> DataFrame:
    """How many entities of each type a document has, most first, ties in order of appearance."""
    counted = found.groupBy("doc_id", "tipo").agg(F.count("*").alias("n"), F.min("n").alias("first"))
    return counted


def _pairs(text: Column) -> Column:
    """Article and law of each cross reference, in order."""
    pattern = render(CROSS_REFERENCE, ignore_case=True)
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (1, 2)]
    return F.transform(F.arrays_zip(found[0].alias("a"), found[1].alias("l")), lambda p: F.struct(F.concat(F.lit("Lei "), p["l"]).alias("lei"), F.concat(F.lit("Art. "), p["a"]).alias("artigo")))


def references(text: Column) -> Column:
    """Law to its articles, distinct and both in order of appearance; null where a text cites none together."""

    def of(pairs: Column) -> Column:
        laws = F.array_distinct(F.transform(pairs, lambda p: p["lei"]))
        articles = lambda law: F.array_distinct(F.transform(F.filter(pairs, lambda p: p["lei"] == law), lambda p: p["artigo"]))
        return F.when(F.size(laws) > 0, F.map_from_entries(F.transform(laws, lambda law: F.struct(law, articles(law)))))

    return let(_pairs(text), of)


def cross_references(docs: DataFrame) -> DataFrame:
    """doc_id, lei, artigo and ord: which articles of which laws are cited together, distinct, in order."""
    pairs = docs.select("doc_id", F.posexplode(_pairs(F.coalesce("text", F.lit("")))).alias("ord", "p"))
    pairs = pairs.select("doc_id", "p.lei", "p.artigo", F.col("ord").cast("long").alias("ord"))
    return pairs.groupBy("doc_id", "lei", "artigo").agg(F.min("ord").alias("ord"))


def reference_map(references: DataFrame) -> DataFrame:
    """doc_id and referencias: law to its articles, both in order of appearance."""
    laws = references.groupBy("doc_id", "lei").agg(F.min("ord").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "artigo"))), lambda x: x["artigo"]).alias("artigos"))
    ordered = F.array_sort(F.collect_list(F.struct("first", "lei", "artigos")))
    return laws.groupBy("doc_id").agg(F.map_from_entries(F.transform(ordered, lambda x: F.struct(x["lei"], x["artigos"]))).alias("referencias"))
