"""Question answering and document analysis, composed of the other operators, for whole tables of questions or texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.functions.text import clipped, percent, session_id, title
from acervo.operators import chunking, entities, grammar, index, rerank, scanning, search
from acervo.sources import files as file_source
from acervo.sources import knowledge

TOP_K = 5
ANSWER_DOCS, EXCERPT, SHOWN_ENTITIES, SHOWN_HISTORY = 3, 300, 20, 20
CITED = ("lei", "artigo", "sumula", "jurisprudencia", "tribunal")
NOTHING = "Não foram encontrados documentos relevantes para sua consulta. Tente reformular a pergunta com termos jurídicos mais específicos."


def confidence(scores: Column) -> Column:
    """Five times the mean score, 1 at most; 0 without scores."""
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)
    return F.when(F.size(scores) > 0, F.least(F.lit(1.0), mean * 5)).otherwise(0.0)


def level(value: Column) -> Column:
    return F.when(value > 0.7, "alta").when(value > 0.4, "média").otherwise("baixa")


def answer(hits: Column, found: Column, value: Column) -> Column:
    """The answer's text from reranked hits (rank, texto, fonte, score), entities and confidence.

    Themes are listed in order of appearance.
    """
    docs = F.transform(
        F.slice(hits, 1, ANSWER_DOCS),
        lambda h: F.concat(F.lit("\n**"), h["rank"].cast("string"), F.lit(". "), F.coalesce(h["fonte"], F.lit("Fonte não identificada")), F.lit("** (relevância: "), percent(h["score"]), F.lit(")\n\n> "), clipped(h["texto"], EXCERPT), F.lit("\n")),
    )
    cited = F.filter(found, lambda e: e["tipo"].isin(*CITED))
    lines = F.array_distinct(F.transform(cited, lambda e: F.concat(F.lit("- "), title(e["tipo"]), F.lit(": "), e["valor"])))
    themes = F.array_distinct(F.transform(F.filter(found, lambda e: e["tipo"] == "tema_juridico"), lambda e: e["valor"]))
    none = F.array().cast("array<string>")
    parts = F.concat(
        F.array(
            F.lit("📋 **Análise Jurídica**\n"),
            F.lit("Com base na análise dos documentos recuperados, apresentamos os seguintes resultados para sua consulta:\n"),
            F.lit("\n📚 **Fundamentos Legais Encontrados:**\n"),
        ),
        docs,
        F.when(F.size(lines) > 0, F.concat(F.array(F.lit("\n🏛️ **Referências Normativas Identificadas:**\n")), lines)).otherwise(none),
        F.when(F.size(themes) > 0, F.array(F.concat(F.lit("\n📎 **Temas Jurídicos:** "), F.array_join(themes, ", ")))).otherwise(none),
        F.array(
            F.concat(F.lit("\n\n⚖️ **Confiança da análise:** "), percent(value), F.lit(" ("), level(value), F.lit(")")),
            F.lit("\n\n⚠️ *Esta análise é gerada automaticamente e não substitui a consulta a um profissional jurídico qualificado.*"),
        ),
    )
    return F.when(F.size(hits) > 0, F.array_join(parts, "\n")).otherwise(NOTHING)


def require_text(text: str) -> str:
    """The text; a blank one is an error."""
    if not text or not text.strip():
        raise ValueError("Texto não pode ser vazio")
    return text


def hits(found_index: index.Index, corpus: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """The k best documents of each query after fusion of twice as many and reranking; queries has query_id and query."""
    fused = search.search_hybrid(found_index, queries, 2 * k)
    small = search.few(queries.select("query_id"))
    pairs = search.met(corpus.select("doc_idx", "text", "fonte"), fused, "doc_idx", small)
    pairs = search.met(pairs, queries.select("query_id", "query"), "query_id", small)
    return rerank.rerank(pairs.select("query_id", "query", "doc_idx", "text", "fonte", F.col("score_combinado").alias("score_original"), F.col("rank").alias("in_rank")), k)


def consult(corpus: DataFrame, queries: DataFrame, k: int = TOP_K, found_index: index.Index | None = None) -> DataFrame:
    """A record for each question of queries (query_id, query); corpus has doc_idx, text and fonte."""
    raw = F.coalesce("query", F.lit(""))
    asked = queries.select("query_id", F.col("query").alias("query_original"), raw.alias("_raw"))
    asked = asked.withColumn("correcoes_gramaticais", grammar.corrections(F.col("_raw")))
    asked = asked.withColumn("query", grammar.edited(F.col("_raw"), F.col("correcoes_gramaticais"))).drop("_raw")
    best = hits(found_index or index.build(corpus), corpus, asked, k)
    listed = F.array_sort(F.collect_list(F.struct("rank", "doc_idx", F.col("text").alias("texto"), "fonte", F.col("score_reranked").alias("score"), "score_original")))
    best = best.groupBy("query_id").agg(listed.alias("documentos"))
    empty = F.array().cast("array<struct<rank:bigint,doc_idx:bigint,texto:string,fonte:string,score:double,score_original:double>>")
    rows = asked.join(best, "query_id", "left").withColumn("documentos", F.coalesce("documentos", empty))
    of_docs = F.flatten(F.transform("documentos", lambda h: entities.entities(h["texto"])))
    rows = rows.withColumn("_e", F.concat(entities.entities(F.col("query")), of_docs))
    rows = rows.withColumn("score_confianca", confidence(F.transform("documentos", lambda h: h["score"])))
    rows = rows.withColumn("_answer", answer(F.col("documentos"), F.col("_e"), F.col("score_confianca")))
    rows = rows.withColumn("resposta", grammar.edited(F.col("_answer"), grammar.corrections(F.col("_answer"))))
    themes = F.array_sort(F.array_distinct(F.transform(F.filter("_e", lambda e: e["tipo"] == "tema_juridico"), lambda e: e["valor"])))
    texts = F.concat_ws(" ", F.array(F.col("query")), F.transform("documentos", lambda h: h["texto"]))
    rows = rows.withColumn("temas", themes).withColumn("entidades", F.slice("_e", 1, SHOWN_ENTITIES)).withColumn("_texts", texts)
    references = entities.reference_map(entities.cross_references(rows.select(F.col("query_id").alias("doc_id"), F.col("_texts").alias("text"))))
    rows = rows.join(references.withColumnRenamed("doc_id", "query_id"), "query_id", "left").drop("_e", "_answer", "_texts")
    return rows.withColumnRenamed("query", "query_corrigida").withColumnRenamed("referencias", "referencias_normativas")


def stamped(records: DataFrame) -> DataFrame:
    """Records with timestamp and session_id of now."""
    return records.withColumn("timestamp", F.current_timestamp()).withColumn("session_id", session_id(F.current_timestamp()))


def analyze(docs: DataFrame, source: Column | None = None) -> DataFrame:
    """One record for each text of docs (doc_id, text): chunks, entities, corrections, references and summaries."""
    text = F.coalesce("text", F.lit(""))
    fonte = F.coalesce(F.lit("") if source is None else source, F.lit(""))
    above = F.filter(F.array("fonte"), lambda x: x != "")
    chunk = lambda c, i: F.struct(chunking.chunk_id(i).alias("chunk_id"), c["tipo"].alias("tipo"), c["conteudo"].alias("conteudo"), F.concat(above, c["hierarquia"]).alias("hierarquia"), c["tamanho"].alias("tamanho"))
    t, families = F.col("_t"), tuple(grammar.FAMILIES)
    rows = docs.select("doc_id", text.alias("_t"), fonte.alias("fonte"))
    found = {"_chunks": scanning.chunks(t, chunking.MAX_CHARS, chunking.OVERLAP_WORDS), "_laws": scanning.references(t), "entidades": scanning.entities(t), "correcoes": scanning.corrections(t, families), "texto_corrigido": scanning.corrected(t, families)}
    rows = rows.withColumns(found)
    laws = F.when(F.size("_laws") > 0, F.map_from_entries("_laws"))
    rows = rows.select("doc_id", "_t", "fonte", F.size("_chunks").cast("long").alias("num_chunks"), F.transform("_chunks", chunk).alias("chunks"), laws.alias("referencias_cruzadas"), "entidades", "correcoes", "texto_corrigido")
    rows = rows.withColumn("resumo_entidades", counted(F.transform("entidades", lambda e: e["tipo"]))).withColumn("por_tipo", counted(F.transform("correcoes", lambda c: c["tipo"]))).withColumn("por_severidade", counted(F.transform("correcoes", lambda c: c["severidade"]))).drop("_t")
    return rows


def tallies(docs: DataFrame, source: Column | None = None) -> DataFrame:
    """How many chunks and entities the record of each text of docs has; nothing is listed."""
    t, fonte = F.coalesce("text", F.lit("")), F.coalesce(F.lit("") if source is None else source, F.lit(""))
    rows = docs.select("doc_id", t.alias("_t"), fonte.alias("fonte"))
    rows = rows.withColumns({"num_chunks": scanning.chunk_counts(F.col("_t"), chunking.MAX_CHARS, chunking.OVERLAP_WORDS), "num_entidades": scanning.entity_counts(F.col("_t"))})
    return rows.drop("_t")


def counted(names: Column) -> Column:
    """How often each name comes, as a map in order of counts, most first, ties by first appearance."""
    distinct = F.array_distinct(names)
    pairs = F.transform(distinct, lambda n, i: F.struct((-F.size(F.filter(names, lambda x: x == n))).alias("less"), i.alias("first"), n.alias("name")))
    return F.map_from_entries(F.transform(F.array_sort(pairs), lambda p: F.struct(p["name"], (-p["less"]).cast("long"))))


# --- additions -------------------------------------------------------------------------------------------------
def add_texts(docs: DataFrame, base: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """The corpus after the chunks of docs (doc_id, text, fonte) are added to the base.

    As with documents, earlier additions go. Where docs give no chunk, the current corpus (the base, if none is
    given) stays as it is.
    """
    chunks = chunking.scanned_chunks(docs, F.col("fonte"))
    if current is not None and chunks.isEmpty():
        return current
    return knowledge.add_documents(base, knowledge.chunks_as_documents(chunks))


def upload(files: DataFrame, base: DataFrame, current: DataFrame | None = None, record: Callable[[DataFrame, Column], DataFrame] = analyze, **readers) -> tuple[DataFrame, DataFrame]:
    """Files (path, content) as records of their analysis, and the corpus with their chunks.

    A record has path, error and, where the text could be read, what `analyze` (or `tallies`) finds, with
    chunks_adicionados. A file's source is its name. Files with an error add nothing.
    """
    texts = file_source.extract_text(files, **readers)
    docs = texts.where("error IS NULL").select(F.col("path").alias("doc_id"), "text", F.substring_index("path", "/", -1).alias("fonte"))
    records = record(docs, F.col("fonte")).withColumnRenamed("doc_id", "path").withColumn("chunks_adicionados", F.col("num_chunks"))
    failed = texts.where("error IS NOT NULL").select("path", "error")
    return records.unionByName(failed, allowMissingColumns=True), add_texts(docs, base, current)


# --- history ---------------------------------------------------------------------------------------------------
def append_history(records: DataFrame, path: str) -> None:
    """Appends records (with seq) to the history."""
    records.write.mode("append").parquet(path)


def last_records(history: DataFrame, shown: int = SHOWN_HISTORY) -> DataFrame:
    """The newest records in order of seq."""
    return history.orderBy(F.desc("seq")).limit(shown).orderBy("seq")


def statistics(spark: SparkSession, history: DataFrame, found_index: index.Index, base: int = 10) -> DataFrame:
    """One row on questions asked, index and base."""
    asked = history.agg(F.count("*").alias("total_consultas"), F.max_by("query_original", "seq").alias("ultimo_query"))
    return asked.crossJoin(index.statistics(found_index)).withColumn("base_conhecimento", F.lit(base).cast("long"))
