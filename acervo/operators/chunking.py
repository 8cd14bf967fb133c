"""Segmentation of structured texts, without a shuffle: lines, boundaries and hierarchy are arrays of their row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.functions.folds import let, scan
from acervo.functions.lexicons import STRUCTURE
from acervo.functions.regexes import S, render
from acervo.functions.text import context, strip
from acervo.operators import scanning

LEVELS = ("titulo", "capitulo", "secao", "artigo")
MAX_CHARS, OVERLAP_WORDS = 512, 50
ARTICLE_START = rf"Art\.{S}*\p{{Nd}}+"


def line_type(line: Column) -> Column:
    """What a line (stripped here) begins, by the first pattern that fits; null for running text."""
    line = strip(line)
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(STRUCTURE.items()):
        out = F.when(line.rlike(rf"\A{render(pattern)}"), F.lit(kind)).otherwise(out)
    return out


def line_reference(line: Column, kind: Column) -> Column:
    """The number or letter of a structural line, "único" where it has none."""
    line = strip(line)
    out = F.lit("")
    for name, pattern in STRUCTURE.items():
        found = F.regexp_extract(line, rf"\A{render(pattern)}", 1)
        out = F.when(kind == name, F.when(found == "", "único").otherwise(found)).otherwise(out)
    return out


SEGMENT = "array<struct<seg:int,tipo:string,conteudo:string,hierarquia:array<string>,linha:int>>"


def _segments(text: Column, source: Column) -> Column:
    """The segments of a text, in order; seg counts boundaries, so it has gaps where blank ones are left out."""
    names = F.array(*[F.lit(x) for x in LEVELS])
    level = lambda line: F.array_position(names, F.coalesce(line_type(line), F.lit(""))).cast("int")
    first = F.struct(F.lit(0).alias("line"), F.lit(0).alias("level"), F.lit("").alias("text"))
    none = F.lit(None).cast("string")
    start = F.struct(*[none.alias(x) for x in LEVELS])

    def of_lines(lines: Column) -> Column:
        marked = F.filter(F.transform(lines, lambda line, i: F.struct(i.alias("line"), level(line).alias("level"), line.alias("text"))), lambda m: m["level"] > 0)
        return let(F.concat(F.array(first), marked), lambda opened: of_marks(lines, opened))

    def of_marks(lines: Column, opened: Column) -> Column:
        def row(m: Column, k: Column) -> Column:
            kind = F.get(names, m["level"] - 1)
            label = F.when(m["level"] > 0, F.concat(F.initcap(kind), F.lit(" "), line_reference(m["text"], kind)))
            stop = F.coalesce(F.get(opened, k + 1)["line"], F.size(lines))
            body = strip(F.array_join(F.slice(lines, m["line"] + 1, stop - m["line"]), "\n"))
            return F.struct(k.alias("seg"), m["level"].alias("level"), label.alias("label"), F.coalesce(kind, F.lit("texto_livre")).alias("tipo"), body.alias("conteudo"), m["line"].alias("linha"))

        def step(above: Column, s: Column) -> tuple[Column, Column]:
            labels = [F.when(s["level"] == n, s["label"]).when((s["level"] == 0) | (s["level"] > n), above[x]) for n, x in enumerate(LEVELS, 1)]
            path = F.filter(F.array(F.nullif(source, F.lit("")), *labels), lambda x: x.isNotNull())
            out = F.struct(s["seg"].alias("seg"), s["tipo"].alias("tipo"), s["conteudo"].alias("conteudo"), path.alias("hierarquia"), s["linha"].alias("linha"))
            return F.struct(*[c.alias(x) for c, x in zip(labels, LEVELS, strict=True)]), F.array(out)

        return scan(F.transform(opened, row), start, step, SEGMENT)

    return F.filter(let(F.split(text, "\n", -1), of_lines), lambda s: s["conteudo"] != "")


def _named(docs: DataFrame, source: Column | None) -> DataFrame:
    """doc_id, _text and fonte, nulls as empty; a step of its own, as docs may have a column fonte that source reads."""
    source = F.lit("") if source is None else source
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"), F.coalesce(source, F.lit("")).alias("fonte"))


def segments(docs: DataFrame, source: Column | None = None) -> DataFrame:
    """doc_id, seg, tipo, conteudo, hierarquia, linha of every segment between structural lines.

    Texts are split at line feeds. A boundary line opens a segment of its type; what precedes the first is
    texto_livre. The hierarchy holds the last label of each level that no higher level has cleared since. Blank
    segments are left out.
    """
    rows = _named(docs, source).select("doc_id", "fonte", F.explode(_segments(F.col("_text"), F.col("fonte"))).alias("s"))
    return rows.select("doc_id", "s.seg", "s.tipo", "s.conteudo", "s.hierarquia", "s.linha", "fonte")


def packed(text: Column, most: int = MAX_CHARS, overlap: int = OVERLAP_WORDS) -> Column:
    """Sentences of a long text filled greedily into pieces; structs of conteudo (stripped) and tamanho (not)."""
    sentences = F.split(text, rf"(?<=[.;:]){S}+", -1)
    words = lambda t: F.filter(F.split(t, S + "+", -1), lambda w: w != "")

    def step(buf: Column, sentence: Column) -> tuple[Column, Column]:
        full = (F.length(buf) + F.length(sentence) > most) & (buf != "")
        tail = F.when(F.size(words(buf)) > overlap, F.array_join(F.slice(words(buf), -overlap, overlap), " ")).otherwise("")
        added = F.concat(buf, F.when(buf == "", F.lit("")).otherwise(F.lit(" ")), sentence)
        return F.when(full, F.concat(tail, F.lit(" "), sentence)).otherwise(added), F.when(full, F.array(buf)).otherwise(F.array().cast("array<string>"))

    def close(buf: Column, out: Column) -> Column:
        return F.when(strip(buf) != "", F.concat(out, F.array(buf))).otherwise(out)

    pieces = scan(sentences, F.lit(""), step, "array<string>", close)
    return F.transform(pieces, lambda p: F.struct(strip(p).alias("conteudo"), F.length(p).alias("tamanho")))


CHUNK = "array<struct<tipo:string,conteudo:string,hierarquia:array<string>,tamanho:bigint,lin_ini:bigint,lin_fim:bigint>>"


def chunk_array(text: Column, source: Column, most: int = MAX_CHARS, overlap: int = OVERLAP_WORDS) -> Column:
    """The chunks of a text, in order: its segments, and pieces of those over `most` characters."""

    def of(s: Column) -> Column:
        body = s["conteudo"]
        small = F.length(body) <= most
        whole = F.array(F.struct(body.alias("conteudo"), F.length(body).alias("tamanho")))
        lines = F.when(small, F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit("")))).otherwise(0)
        last = (s["linha"] + lines).alias("lin_fim")
        row = lambda p: F.struct(s["tipo"].alias("tipo"), p["conteudo"].alias("conteudo"), s["hierarquia"].alias("hierarquia"), p["tamanho"].alias("tamanho"), s["linha"].alias("lin_ini"), last)
        return F.transform(F.when(small, whole).otherwise(packed(body, most, overlap)), row)

    return F.flatten(F.transform(_segments(text, source), of)).cast(CHUNK)


def chunk_id(number: Column) -> Column:
    return F.format_string("chunk_%06d", number + 1)


def structural_chunks(docs: DataFrame, source: Column | None = None, most: int = MAX_CHARS, overlap: int = OVERLAP_WORDS) -> DataFrame:
    """Chunks of docs (doc_id, text): segments, and pieces of those over `most` characters, numbered in each row of docs."""
    rows = _named(docs, source).select("doc_id", "fonte", F.posexplode(chunk_array(F.col("_text"), F.col("fonte"), most, overlap)).alias("_n", "c"))
    return rows.select("doc_id", chunk_id(F.col("_n")).alias("chunk_id"), "c.tipo", "c.conteudo", "c.hierarquia", "fonte", "c.tamanho", "c.lin_ini", "c.lin_fim")


def scanned_chunks(docs: DataFrame, source: Column | None = None, most: int = MAX_CHARS, overlap: int = OVERLAP_WORDS) -> DataFrame:
    """As structural_chunks, by the scanner. Where only rows are counted, chunks are cut but not made."""
    rows = _named(docs, source).select("doc_id", "fonte", scanning.chunks(F.col("_text"), most, overlap).alias("_c"), scanning.chunk_counts(F.col("_text"), most, overlap).alias("_many"))
    numbers = F.when(F.col("_many") > 0, F.sequence(F.lit(0), F.col("_many").cast("int") - 1))
    rows = rows.select("doc_id", "fonte", "_c", F.explode_outer(numbers).alias("_n")).where("_n IS NOT NULL")  # a filter on _many would be moved to where texts are made, and cut them twice
    rows = rows.select("doc_id", "fonte", "_n", F.get("_c", F.col("_n")).alias("c"))
    above = F.filter(F.array("fonte"), lambda x: x != "")
    return rows.select("doc_id", chunk_id(F.col("_n")).alias("chunk_id"), "c.tipo", "c.conteudo", F.concat(above, "c.hierarquia").alias("hierarquia"), "fonte", "c.tamanho", "c.lin_ini", "c.lin_fim")


def with_context(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("contexto_completo", context(F.col("hierarquia"), F.col("conteudo")))


def article_chunks(docs: DataFrame) -> DataFrame:
    """A chunk for each article of docs (doc_id, text), and one for what precedes the first."""
    pieces = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), rf"(?={ARTICLE_START})", -1), strip), lambda p: p != "")
    rows = docs.select("doc_id", F.posexplode(pieces).alias("_n", "conteudo"))
    number = F.regexp_extract("conteudo", rf"\AArt\.{S}*(\p{{Nd}}+)", 1)
    return rows.select(
        "doc_id",
        F.format_string("chunk_%06d", F.col("_n") + 1).alias("chunk_id"),
        F.when(number != "", "artigo").otherwise("preambulo").alias("tipo"),
        "conteudo",
        F.when(number != "", F.concat(F.lit("Art. "), number)).otherwise("Preâmbulo").alias("referencia"),
    )


def simple_pieces(text: Column) -> Column:
    """The light engine's chunks as an array of type and content: as article_chunks, and the whole text where nothing remains."""
    pieces = F.filter(F.transform(F.split(text, rf"(?={ARTICLE_START})", -1), strip), lambda p: p != "")
    number = lambda p: F.regexp_extract(p, rf"\AArt\.{S}*([0-9]+)", 1)
    row = lambda p: F.struct(F.when(number(p) != "", F.concat(F.lit("Artigo "), number(p))).otherwise("Texto").alias("type"), p.alias("content"))
    return F.transform(F.when(F.size(pieces) > 0, pieces).otherwise(F.array(text)), row)


def simple_chunks(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.posexplode(simple_pieces(F.coalesce("text", F.lit("")))).alias("n", "c"))
    return rows.select("doc_id", F.col("n").cast("long").alias("n"), "c.type", "c.content")
