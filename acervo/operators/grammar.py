"""Rule-based corrections with exact offsets, the edited text and summaries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.functions.lexicons import ABBREVIATIONS, LATIN, REDUNDANCIES, SPELLING, STYLE
from acervo.functions.folds import scan
from acervo.functions.regexes import S, bounded, literal, render
from acervo.functions.spans import folded, matches, placed
from acervo.functions.text import strip
from acervo.operators import scanning

PUNCTUATION = ".,;:!?"
SPACED = rf"{S}+([{PUNCTUATION}])"
DOUBLED = rf"([{PUNCTUATION}])\1+"
ARTICLE = rf"Art\.?{S}*(\p{{Nd}}+){S}"

SEVERITIES = ("erro", "aviso", "info", "critico")

NAMES = ("ord", "pos", "tipo", "severidade", "texto_original", "sugestao", "explicacao", "regra")
MATCH = "array<struct<ord:int,pos:int,gap:int,width:int,stays:boolean,tipo:string,severidade:string,texto_original:string,sugestao:string,explicacao:string,regra:string>>"
PLACED = "array<struct<ini:int,fim:int,ord:int,pos:int,tipo:string,severidade:string,texto_original:string,sugestao:string,explicacao:string,regra:string,stays:boolean>>"


def _rows(found: Column, order: int, tipo: str, severidade: str, regra: str, sugestao, explicacao, changed: bool = False, gate: Column | None = None) -> Column:
    """Corrections of matches; sugestao and explicacao are values or functions of the match (and suggestion).

    Only where gate holds is anything searched; with `changed`, a suggestion like the match does not stay.
    """

    def row(m: Column, i: Column) -> Column:
        new = sugestao(m) if callable(sugestao) else F.lit(sugestao)
        why = explicacao(m, new) if callable(explicacao) else F.lit(explicacao)
        return F.struct(
            F.lit(order).alias("ord"),
            i.alias("pos"),
            m["gap"].alias("gap"),
            m["width"].alias("width"),
            (new != m["original"] if changed else F.lit(True)).alias("stays"),
            F.lit(tipo).alias("tipo"),
            F.lit(severidade).alias("severidade"),
            m["original"].alias("texto_original"),
            new.alias("sugestao"),
            why.alias("explicacao"),
            F.lit(regra).alias("regra"),
        )

    rows = F.transform(found, row).cast(MATCH)
    return F.when(gate, rows).otherwise(F.array().cast(MATCH)) if gate is not None else rows


def _has(text: Column, phrase: str) -> Column:
    return F.contains(folded(text), F.lit(phrase.lower()))


def spelling(text: Column, words: dict[str, str] = SPELLING) -> list[Column]:
    return [_rows(matches(text, f"(?iu){literal(a)}"), i, "ortografia", "erro", "ORTOGRAFIA_JURIDICA", b, f"Grafia correta: '{b}'", gate=_has(text, a)) for i, (a, b) in enumerate(words.items())]


def abbreviations(text: Column) -> list[Column]:
    """Suggestions come from replacing in the match alone; rows that change nothing are dropped."""
    out = []
    for i, (word, rest, new) in enumerate(ABBREVIATIONS):
        # ° is no word character: a border behind it needs a letter next, and then the match alone does not change
        java = render(bounded(word.replace("[°º]", "º")) + rest, ignore_case=True)
        change = lambda m, java=java, new=new: F.regexp_replace(m["original"], java, new)
        why = lambda m, s: F.concat(F.lit("Abreviação padronizada: '"), s, F.lit("'"))
        out.append(_rows(matches(text, java), 100 + i, "abreviacao", "aviso", "ABREVIACAO_PADRAO", change, why, True, _has(text, re.match("[a-z]+", word)[0])))
    return out


def redundancies(text: Column, phrases=REDUNDANCIES) -> list[Column]:
    return [_rows(matches(text, f"(?iu){literal(a)}"), 200 + i, "redundancia", "aviso", "REDUNDANCIA", b, c, gate=_has(text, a)) for i, (a, b, c) in enumerate(phrases)]


def style(text: Column, terms=STYLE) -> list[Column]:
    return [_rows(matches(text, f"(?iu){bounded(literal(a))}"), 300 + i, "estilo", "info", "ESTILO_JURIDICO", b, c, gate=_has(text, a)) for i, (a, b, c) in enumerate(terms)]


def punctuation(text: Column) -> list[Column]:
    sign = lambda m: F.right(m["original"], F.lit(1))
    return [
        _rows(matches(text, SPACED), 400, "pontuacao", "aviso", "ESPACO_PONTUACAO", sign, "Remover espaço antes da pontuação"),
        _rows(matches(text, DOUBLED), 401, "pontuacao", "erro", "DUPLICATA_PONTUACAO", sign, "Remover pontuação duplicada"),
    ]


def article_format(text: Column) -> list[Column]:
    def expected(m: Column) -> Column:
        # the group is in the match's digits; numbers of one digit (leading zeros aside) take the sign
        small = F.length(F.regexp_replace(m["valor"], r"^0+(?=\p{Nd})", "")) == 1
        return F.concat(F.lit("Art. "), m["valor"], F.when(small, F.lit("º ")).otherwise(" "))

    why = lambda m, s: F.concat(F.lit("Formatação padrão: '"), strip(s), F.lit("'"))
    return [_rows(matches(text, ARTICLE, 1), 500, "formatacao", "info", "FORMATO_ARTIGO", expected, why, True, F.contains(text, F.lit("Art")))]


def latin(text: Column, phrases: dict[str, str] = LATIN) -> list[Column]:
    return [_rows(matches(text, f"(?iu){literal(a)}"), 600 + i, "latinismo", "info", "LATINISMO", lambda m: m["original"], f"Latinismo: '{a}' = {b}", gate=_has(text, a)) for i, (a, b) in enumerate(phrases.items())]


FAMILIES = {"spelling": spelling, "abbreviations": abbreviations, "redundancies": redundancies, "style": style, "punctuation": punctuation, "article_format": article_format, "latin": latin}


def corrections(text: Column, families=tuple(FAMILIES)) -> Column:
    """All corrections by start; ties by rule family, rule and match."""
    found = placed(F.flatten(F.array(*[c for f in families for c in FAMILIES[f](text)])), (*NAMES, "stays"), PLACED)
    row = lambda c: F.struct(*[c[n].alias(n) for n in ("ini", "ord", "pos", "fim", *NAMES[2:])])
    return F.array_sort(F.transform(F.filter(found, lambda c: c["stays"]), row))


def edited(text: Column, found: Column) -> Column:
    """The text with the corrections of severity erro applied.

    Edits are disjoint, so the text between them and their suggestions are joined. Of two that overlap the later
    one stays whole.
    """
    edits = F.filter(found, lambda c: c["severidade"] == "erro")

    def step(at: Column, c: Column) -> tuple[Column, Column]:
        gap = F.substring(text, at + 1, F.greatest(c["ini"] - at, F.lit(0)))
        return F.greatest(c["fim"], at), F.array(F.concat(gap, c["sugestao"]))

    return scan(edits, F.lit(0), step, "array<string>", lambda at, parts: F.concat(F.array_join(parts, ""), F.substring(text, at + 1, F.length(text))))


def correct(docs: DataFrame) -> DataFrame:
    """doc_id, texto_corrigido and correcoes of docs (doc_id, text); a null text is empty."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    text, families = F.col("_text"), tuple(FAMILIES)
    return rows.select("doc_id", scanning.corrected(text, families).alias("texto_corrigido"), scanning.corrections(text, families).alias("correcoes"))


def correction_rows(docs: DataFrame, families=tuple(FAMILIES)) -> DataFrame:
    """A row for each correction, with its number in the document."""
    found = docs.select("doc_id", F.posexplode(scanning.corrections(F.col("text"), families)).alias("n", "c"))
    names = ("tipo", "severidade", "texto_original", "sugestao", "explicacao", "regra")
    return found.select("doc_id", F.col("n").cast("long").alias("n"), *[f"c.{x}" for x in names], F.col("c.ini").cast("long").alias("ini"), F.col("c.fim").cast("long").alias("fim"))


def correction_totals(docs: DataFrame, families=tuple(FAMILIES)) -> DataFrame:
    """correction_summary of correction_rows, without making the rows: they are counted in each text."""
    found = docs.select("doc_id", F.explode(scanning.correction_totals(F.col("text"), families)).alias("c")).select("doc_id", "c.*")
    return found.groupBy("doc_id", "tipo", "severidade").agg(F.sum("n").alias("n"))


def severity_totals(docs: DataFrame, families=tuple(FAMILIES)) -> DataFrame:
    """severity_counts of correction_rows, without making the rows."""
    found = docs.select("doc_id", F.explode(scanning.correction_totals(F.col("text"), families)).alias("c")).where("c.severidade IS NOT NULL")
    return found.groupBy("doc_id").agg(*[F.coalesce(F.sum(F.when(F.col("c.severidade") == s, F.col("c.n"))), F.lit(0)).cast("long").alias(s) for s in SEVERITIES])


def correction_summary(rows: DataFrame) -> DataFrame:
    """Counts by type, by severity and in all, a row each."""
    cubed = rows.groupingSets([["doc_id", "tipo"], ["doc_id", "severidade"], ["doc_id"]], "doc_id", "tipo", "severidade")
    return cubed.agg(F.count("*").alias("n"))


def severity_counts(rows: DataFrame) -> DataFrame:
    """The counts of the four severities, zero where there is none."""
    return rows.groupBy("doc_id").agg(*[F.count_if(F.col("severidade") == s).alias(s) for s in SEVERITIES])
