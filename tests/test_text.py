"""Text functions, spans, chunks, entities and corrections on cases worked out by hand."""

import random
import re

import pytest
from pyspark.sql import functions as F

from acervo.functions import lexicons as lx
from acervo.functions import text as tx
from acervo.functions.regexes import W, bounded, literal, render
from acervo.functions.spans import find_all
from acervo.operators import assistant, chunking, client, entities, grammar, scanning


def table(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def one(spark, text, column):
    return table(spark, text).select(column.alias("x")).first().x


def test_render():
    assert render(r"[.\s]?\d\s", java=False) == r"[.\t-\r\x1c-\x20\x{85}\p{Z}]?\p{Nd}[\t-\r\x1c-\x20\x{85}\p{Z}]"
    assert bounded("a") == f"(?<!{W})(?:a)(?!{W})" and literal("a-b.") == r"a\-b\."


def test_tokens(spark):
    assert one(spark, "A reforma agrária, e a função social!", tx.tokenize(F.col("text"))) == ["reforma", "agrária", "função", "social"]
    assert one(spark, None, tx.tokenize(F.col("text"))) == []
    assert one(spark, "ñandú über straße", tx.client_tokens(F.col("text"))) == ["andú", "über", "stra"]
    assert one(spark, "um dois dois três", tx.bigrams(F.split("text", " "))) == ["um dois", "dois dois", "dois três"]
    assert one(spark, "um", tx.bigrams(F.split("text", " "))) == []


def test_small_functions(spark):
    assert one(spark, "123.456.789-00", tx.mask(F.col("text"), F.lit("cpf"))) == "***.***.789-**"
    assert one(spark, "12.345.678/0001-90", tx.mask(F.col("text"), F.lit("cnpj"))) == "**.***.***/0001-**"
    assert one(spark, "1", tx.mask(F.col("text"), F.lit("cpf"))) == "***MASCARADO***"
    assert one(spark, "direito_agrario", tx.title(F.col("text"))) == "Direito Agrario"
    assert one(spark, "0.125", tx.percent(F.col("text").cast("double"))) == "12%"
    assert one(spark, "a<b & 'c'", tx.escape_html(F.col("text"))) == "a&lt;b &amp; 'c'"
    assert one(spark, "**a** *b*", tx.markdown_to_html(F.col("text"))) == "<p><strong>a</strong> <em>b</em></p>"
    assert one(spark, "- x\n- y", tx.markdown_to_html(F.col("text"))) == "<p><ul><li>x</li><br><li>y</li></ul></p>"
    assert one(spark, "lei", tx.entity_class(F.col("text"))) == "lei" and one(spark, "cpf", tx.entity_class(F.col("text"))) == "default"
    assert len(one(spark, "t", tx.session_id(F.col("text")))) == 12
    assert one(spark, "x" * 301, tx.clipped(F.col("text"), 300)) == "x" * 300 + "..."


@pytest.mark.parametrize("pattern", [r"a+", r"([.,])\1+", r"(?iu)é"])
def test_spans_are_pythons(spark, pattern):
    texts = ["", "aa b aaa", ",, .. ,.", "É😀é a,,a", "a" * 50, "x,," * 300]
    for row in table(spark, *texts).select("text", find_all(F.col("text"), pattern).alias("m")).collect():
        expected = [(m.start(), m.end(), m[0]) for m in re.finditer(pattern.replace("(?iu)", "(?i)"), row.text)]
        assert [(m.ini, m.fim, m.original) for m in row.m] == expected


def rows(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def test_entities(spark):
    found = entities.extract(table(spark, "Conforme o Art. 1° da Lei 4.504/64", "sobre 5 anos", "12345678000190", "contrato de FGTS e posse", None))
    assert sorted(rows(found, "doc_id", "tipo", "valor", "ini", "fim")) == [
        (0, "artigo", "1", 11, 18),
        (0, "lei", "4.504/64", 22, 34),
        (1, "jurisprudencia", "re", 3, 7),
        (1, "prazo", "5", 6, 12),
        (2, "cnpj", "**.***.***/0001-**", 0, 14),
        (2, "cpf", "***.***.780-**", 0, 11),
        (3, "tema_juridico", "Direito Civil", 0, 8),
    ]
    assert rows(found.where("tipo = 'cpf'"), "texto_original") == [("12345678000",)]
    refs = entities.reference_map(entities.cross_references(table(spark, "art. 1 da Lei 5, Art. 2 do Lei 5, art 1 da lei 5; Art. 9 da lei 7")))
    assert refs.first().referencias == {"Lei 5": ["Art. 1", "Art. 2"], "Lei 7": ["Art. 9"]}
    assert rows(entities.extract(table(spark, "o STF, STFx e TJSP")).where("tipo = 'tribunal'"), "valor") == [("STF",), ("TJSP",)]


def test_corrections(spark):
    docs = table(spark, "O revel ,, peticao")
    assert rows(grammar.correction_rows(docs), "tipo", "severidade", "ini", "fim", "sugestao") == [
        ("ortografia", "erro", 2, 7, "revel"),
        ("pontuacao", "aviso", 7, 9, ","),
        ("pontuacao", "erro", 8, 10, ","),
        ("ortografia", "erro", 11, 18, "petição"),
    ]
    assert grammar.correct(docs).first().texto_corrigido == "O revel , petição"
    found = grammar.correction_rows(table(spark, "art 5 e n° 3 e Nº 4, fls. 2"), ("abbreviations",))
    assert rows(found, "texto_original", "sugestao") == [("art 5", "Art. 5"), ("Nº", "nº")]
    found = grammar.correction_rows(table(spark, "Art. 9 x Art. 10 y Art.11 z"), ("article_format",))
    assert rows(found, "texto_original", "sugestao") == [("Art. 9 ", "Art. 9º "), ("Art.11 ", "Art. 11 ")]
    assert grammar.correct(table(spark, None, "")).count() == 2
    counts = grammar.severity_counts(grammar.correction_rows(docs)).first()
    assert (counts.erro, counts.aviso, counts.info, counts.critico) == (3, 1, 0, 0)


def test_structural_chunks(spark):
    text = "Preâmbulo\nTÍTULO I - A\nArt. 1º x\nArt. 2º y\nTÍTULO II\nArt. 3º z"
    found = chunking.structural_chunks(table(spark, text), F.lit("F")).orderBy("chunk_id")
    assert rows(found, "chunk_id", "hierarquia", "lin_ini") == [
        ("chunk_000001", ["F"], 0),
        ("chunk_000002", ["F", "Titulo I"], 1),
        ("chunk_000003", ["F", "Titulo I", "Artigo 1"], 2),
        ("chunk_000004", ["F", "Titulo I", "Artigo 2"], 3),
        ("chunk_000005", ["F", "Titulo II"], 4),
        ("chunk_000006", ["F", "Titulo II", "Artigo 3"], 5),
    ]
    assert chunking.structural_chunks(table(spark, None, " \n ")).count() == 0


def plain_pack(text, most=512, overlap=50):
    out, buf = [], ""
    for s in re.split(r"(?<=[.;:])\s+", text):
        if buf and len(buf) + len(s) > most:
            out.append(buf)
            w = buf.split()
            buf = (" ".join(w[-overlap:]) if len(w) > overlap else "") + " " + s
        else:
            buf += (" " if buf else "") + s
    return [(b.strip(), len(b)) for b in [*out, buf] if b.strip()]


def test_long_chunks(spark):
    text = " ".join(f"palavra{i}{'.' if i % 13 == 0 else ''}" for i in range(600)) + ". " + "y" * 700 + "; fim."
    found = chunking.structural_chunks(table(spark, text)).orderBy("chunk_id")
    assert rows(found, "conteudo", "tamanho") == plain_pack(text)


def test_article_chunks(spark):
    assert rows(chunking.article_chunks(table(spark, "Pre Art. 1 a Art. 2 b")), "tipo", "conteudo", "referencia") == [("preambulo", "Pre", "Preâmbulo"), ("artigo", "Art. 1 a", "Art. 1"), ("artigo", "Art. 2 b", "Art. 2")]
    assert rows(chunking.simple_chunks(table(spark, " ")), "type", "content") == [("Texto", " ")]


def test_light_engine(spark):
    found = client.extract(table(spark, "CPF 123.456.789-00, CF/88 e CF, art. 5, ART. 5; contrato"))
    assert rows(found, "tipo", "valor") == [("constituicao", "88"), ("artigo", "5"), ("cpf", "***.***. 789-**"), ("tema_juridico", "Direito Civil")]
    assert client.correct(table(spark, "peticao,, e Peticao.. fim ,,")).first().corrected == "petição, e petição. fim ,"


def test_analysis(spark):
    row = assistant.analyze(table(spark, "TÍTULO I\nArt. 1º da Lei 4,, da Lei 5")).first()
    assert row.num_chunks == 2 and row.resumo_entidades == {"lei": 2, "artigo": 1} and row.por_severidade == {"erro": 1}
    with pytest.raises(ValueError, match="vazio"):
        assistant.require_text("  ")


def test_light_analysis(spark):
    rows = [(1, "Preâmbulo Art. 5 da Lei 8.629/93 através do STF."), (2, None), (2, "x")]
    found = client.analyze(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", "texto_original").collect()
    one, empty, other = found
    assert [c["tipo"] for c in one["chunks"]] == ["Texto", "Artigo 5"] and one["total_chunks"] == 2
    assert one["total_entidades"] == len(one["entidades"]) and {e["tipo"] for e in one["referencias"]} == {"lei", "artigo"}
    assert one["total_correcoes"] == len(one["correcoes"]) and one["fonte"] == "Texto Colado"
    assert [tuple(c) for c in empty["chunks"]] == [("Texto", "")] and empty["total_entidades"] == empty["total_correcoes"] == 0
    assert other["texto_corrigido"] == "x" and not other["referencias"]


def test_many_matches_in_one_text(spark):
    """Places, duplicates, edits and pieces of a long text are found in one pass over blocks."""
    unit = "Art. 5 da Lei 8.629/93 e peticao ,, no STF. "
    text = unit * 1500
    row = table(spark, text).select(entities.entities(F.col("text")).alias("e"), grammar.corrections(F.col("text")).alias("c")).first()
    few = table(spark, unit * 3).select(entities.entities(F.col("text")).alias("e"), grammar.corrections(F.col("text")).alias("c")).first()
    assert len(row.e) == 1500 * (len(few.e) // 3) and len(row.c) == 500 * len(few.c)
    assert all(text[e.ini : e.fim] == e.texto_original for e in row.e) and all(text[c.ini : c.fim] == c.texto_original for c in row.c)
    fixed = grammar.correct(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().texto_corrigido
    assert fixed == unit.replace("peticao", "petição").replace(",,", ",") * 1500


def test_repeated_ids_are_chunked_apart(spark):
    docs = spark.createDataFrame([(1, "Art. 1 a\nArt. 2 b"), (1, "Art. 9 z"), (2, None)], "doc_id long, text string")
    got = chunking.structural_chunks(docs).collect()
    assert sorted((r.chunk_id, r.conteudo) for r in got) == [("chunk_000001", "Art. 1 a"), ("chunk_000001", "Art. 9 z"), ("chunk_000002", "Art. 2 b")]
    assert "Exchange" not in chunking.structural_chunks(spark.range(1).selectExpr("id AS doc_id", "'x' AS text"))._jdf.queryExecution().executedPlan().toString()


ODD = ["", None, "İnciso IV ſúmula 3 LEİ 5 CF/88 ﬁm", "a . , ;; !!?? art 5 x ART. 007 Art 07 x", "12345678000190 CPF 123.456.789-01 𝟙𝟚𝟛.456.789-01 \U0001f600 Lei 1", "revel n° 3 nº 4 par. 3 al. a) inc. IV MIN. ﻿. \x1c, contrato de FGTS e posse a nível de onde² Kmesmo", "Lei\x85 12.3/99 Art 12 da Art. ١٢ x Art. ٣ y"]


def test_scanned_columns_are_as_the_expressions(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    t = F.coalesce("text", F.lit(""))
    pairs = [(entities.entities(t), scanning.entities(F.col("text"))), (grammar.corrections(t), scanning.corrections(F.col("text"), tuple(grammar.FAMILIES))), (client.entities(t), scanning.client_entities(F.col("text")))]
    for by_expression, scanned in pairs:
        shown = lambda c: [list(map(tuple, r.x)) for r in docs.select("doc_id", c.alias("x")).orderBy("doc_id").collect()]
        expected = shown(by_expression)
        assert shown(scanned) == expected and any(expected)


def test_whole_columns_are_scanned_in_batches(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    for found in (entities.extract(docs), grammar.correction_rows(docs), grammar.correct(docs), client.extract(docs), client.analyze(docs).select("doc_id", "total_entidades"), assistant.analyze(docs)):
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert "ArrowEvalPython" in plan


def odd_texts(n):
    """Strings of what patterns begin with, hold and end with, in all orders."""
    parts = "art Art ART. § Lei lei n° nº 5 12 1234 ٣ 𝟙 3/4/2021 1/22/20245/6/77 . - / , ;; de janeiro março dias anos 12345678901 12.345.678/0001-90 0001234-56.2020.8.26.0001 CF/88 MP RE resp ADI STF STFx TRF1 TRT12 TJSP ICMBio alínea a) İ ſ K ΑΣ 😀 mesmo através".split()
    draw = random.Random(5)
    pick = lambda: draw.choice([*parts, " ", "  ", "\n", "﻿", "\0", "\x85"]) + draw.choice(["", " "])
    return ["".join(pick() for _ in range(draw.choice([0, 1, 5, 60]))) for _ in range(n)]


def test_joined_texts_are_searched_as_each_alone():
    texts = [*odd_texts(3000), "3 de março de 20245 de maio de 2024", "art 1 alíneart 5", " ﻿ . ,"]
    joined = scanning.Texts(texts)
    searched = [(s, rf"(?<!\w)(?:{p})(?!\w)" if b else p, i) for (_, p, i, b), (_, _, _, s, _) in zip(lx.ENTITY_PATTERNS, scanning._entity_patterns(None), strict=True)]
    searched += [(r[2], {400: r"\s+([.,;:!?])", 401: r"([.,;:!?])\1+"}[r[0]], False) for r in scanning._rules(("punctuation",))]
    for search, pattern, ignore in searched:
        plain = re.compile(pattern.lower() if ignore else pattern)
        fold = lambda t: t.translate({0x130: "i", 0x131: "i", 0x17F: "s", 0x212A: "k"}).lower()
        expected = [(h, *m.span()) for h, t in enumerate(texts) for m in plain.finditer(fold(t) if ignore else t)]
        found = search(joined)
        holder = joined.holders([m.start() for m in found]).tolist()
        assert [(h, m.start() - joined.starts[h], m.end() - joined.starts[h]) for h, m in zip(holder, found)] == expected, pattern


def test_counted_corrections_and_types_are_those_of_the_rows(spark):
    docs = spark.createDataFrame([(i % 5, t) for i, t in enumerate([*ODD, "art 5 ,, e peticao ;; através de. art 5"])], "doc_id long, text string")
    rows = grammar.correction_rows(docs)
    shown = lambda df: sorted(map(repr, df.collect()))
    assert shown(grammar.correction_totals(docs)) == shown(grammar.correction_summary(rows)) and rows.count()
    assert shown(grammar.severity_totals(docs)) == shown(grammar.severity_counts(rows))
    assert shown(entities.types(docs)) == shown(entities.extract(docs).select("tipo").distinct())
    plan = grammar.correction_totals(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "explicacao" not in plan and "Expand" not in plan


def test_scanned_chunks_references_and_edits_are_as_the_expressions(spark):
    long = "Art. 9º " + " ".join(f"palavra{i}{'.' if i % 13 == 0 else ''}" for i in range(300)) + ". " + "y" * 700 + "; fim."
    texts = [*ODD, "Pre\nTÍTULO I - A\n Art. 1º x\n\nSubseção 4\nArtigo x\nCAPÍTULO II\n \nArt. 3º z", long, " \n\nTítulo V", "art. 1 da Lei 5, Art. 2 do Lei 5, ART 1 da lei 5; Art. 9 dE lei n° 7/90", "peticao ,,,, revel peticao"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    t, families = F.coalesce("text", F.lit("")), tuple(grammar.FAMILIES)
    laws = F.when(F.size(scanning.references(F.col("text"))) > 0, F.map_from_entries(scanning.references(F.col("text"))))
    rows = docs.select("doc_id", t.alias("text"), scanning.corrections(F.col("text"), families).alias("c"))
    edited = rows.select("doc_id", grammar.edited(F.col("text"), F.col("c")).alias("x"))
    pairs = [
        (docs.select("doc_id", chunking.chunk_array(t, F.lit("")).alias("x")), scanning.chunks(F.col("text"), chunking.MAX_CHARS, chunking.OVERLAP_WORDS)),
        (docs.select("doc_id", entities.references(t).alias("x")), laws),
        (edited, scanning.corrected(F.col("text"), families)),
    ]
    shown = lambda df: [repr(r.x) for r in df.orderBy("doc_id").collect()]
    for by_expression, scanned in pairs:
        assert shown(docs.select("doc_id", scanned.alias("x"))) == shown(by_expression)
    above = assistant.analyze(docs.where("doc_id = 7"), F.lit("F")).select("chunks", "num_chunks").first()
    assert above.chunks[1].hierarquia == ["F", "Titulo I"] and above.num_chunks == len(above.chunks)


def test_values_grouped_in_their_texts_are_those_of_the_rows(spark):
    docs = spark.createDataFrame([(i % 5, t) for i, t in enumerate([*ODD, "Lei 5, lei 7, Lei 5 e CPF 123.456.789-00", "lei 9 e Lei 5", "nada"])], "doc_id long, text string")
    shown = lambda df: sorted(repr(tuple(r)) for r in df.collect())
    assert shown(client.grouped_values(docs)) == shown(client.grouped(client.extract(docs))) != []
    plan = client.grouped_values(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "texto_original" not in plan


def test_counted_chunks_and_entities_are_those_that_are_listed(spark):
    texts = [*ODD, *odd_texts(200), "Art. 1 a\n\0Art. 2\n TÍTULO I\n", "\n \nTítulo\nV", "x" * 512 + ". " + "y" * 512 + "\nArt. 5 " + "z; " * 400, " " * 600]
    docs = spark.createDataFrame([(i, t, f"f{i % 3}" * (i % 2)) for i, t in enumerate(texts)], "doc_id long, text string, fonte string")
    got = {r.doc_id: (r.num_chunks, r.num_entidades) for r in assistant.tallies(docs).collect()}
    listed = assistant.analyze(docs).select("doc_id", F.size("chunks").alias("c"), F.size("entidades").alias("e")).collect()
    assert got == {r.doc_id: (r.c, r.e) for r in listed} and max(got.values()) > (3, 0)
    shown = lambda df: sorted(repr(tuple(r)) for r in df.collect())
    assert shown(chunking.scanned_chunks(docs, F.col("fonte"))) == shown(chunking.structural_chunks(docs, F.col("fonte"))) != []
