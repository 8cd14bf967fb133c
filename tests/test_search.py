"""Index, search, reranking, answers, sources and history."""

import io
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from acervo.operators import assistant, client, index, rerank, search
from acervo.plans import registry
from acervo.sources import files, knowledge
from acervo.streaming import ingest


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([(0, "terra rural"), (1, "terra terra"), (2, "direito"), (3, None)][:3], "doc_idx long, text string")


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "terra")], "query_id long, query string")


def values(df, *names):
    return [tuple(round(v, 6) if isinstance(v, float) else v for v in (r[n] for n in names)) for r in df.orderBy("rank").collect()]


def test_ranking(small, asked):
    found = index.build(small)
    assert values(search.ranked(search.bm25_scores(found, asked), found, asked, 3), "doc_idx", "score") == [(1, 0.630877), (0, 0.431196), (2, 0.0)]
    assert values(search.search(found, asked, 10, "semantico"), "doc_idx", "score") == [(1, 1.0), (0, 0.605349)]
    assert values(search.search(found, asked, 10, "bm25"), "doc_idx") == [(1,), (0,)]
    fused = values(search.search(found, asked, 3), "doc_idx", "score_combinado")
    assert fused == [(1, round(1 / 61, 6)), (0, round(1 / 62, 6)), (2, round(1 / 63, 6))]


def test_saved_index(spark, small, asked, tmp_path):
    found = index.build(small)
    index.save(found, str(tmp_path))
    again = index.load(spark, str(tmp_path))
    assert values(search.search_hybrid(again, asked, 3), "doc_idx", "score_combinado") == values(search.search_hybrid(found, asked, 3), "doc_idx", "score_combinado")
    row = index.statistics(again).first()
    assert (row.total_documentos, row.vocabulario_bm25, row.indexado) == (3, 3, True)


def test_empty_corpus(spark, asked):
    found = index.build(spark.createDataFrame([], "doc_idx long, text string"))
    assert search.search_hybrid(found, asked).count() == 0 and index.statistics(found).first().indexado is False


def test_rerank(spark):
    pairs = spark.createDataFrame([(1, "função social", "função social da terra", 1 / 61, 1), (1, "função social", None, 2.0, 2)], "query_id long, query string, text string, score_original double, in_rank long")
    first, last = rerank.rerank(pairs).orderBy("rank").collect()
    assert (round(first.score_reranked, 6), round(first.doc_quality, 6), first.exact_match) == (0.785153, 0.676667, 0.5)
    assert last.original_score == 1.0 and 0 <= last.score_reranked < first.score_reranked
    assert "term_overlap         = 0.667" in rerank.rerank(pairs).where("rank = 1").select(rerank.explain(F.lit("d")).alias("t")).first().t


def test_consult(spark):
    base = knowledge.base_documents(spark).select("doc_idx", F.col("conteudo").alias("text"), F.col("metadata")["fonte"].alias("fonte"))
    asked = spark.createDataFrame([(1, "reforma agrária ,, na Lei 4.504/64?"), (2, None)], "query_id long, query string")
    first, empty = assistant.consult(base, asked).orderBy("query_id").collect()
    assert first.query_corrigida == "reforma agrária , na Lei 4.504/64?" and first.score_confianca == 1.0
    assert first.documentos[0].doc_idx == 0 and len(first.documentos) == 5 and "..." not in first.resposta
    assert "Direito Agrario" in first.temas and len(first.entidades) <= assistant.SHOWN_ENTITIES
    assert len(empty.documentos) == 5
    none = assistant.consult(base.limit(0), asked.limit(1)).first()
    assert none.resposta == assistant.NOTHING and none.score_confianca == 0


def test_light_search(spark):
    base = spark.createDataFrame([(i, t, s) for i, (_, t, s, _) in enumerate(knowledge.CLIENT_BASE)], "doc_idx long, text string, source string")
    asked = spark.createDataFrame([(1, "função social da propriedade"), (2, "zzz")], "query_id long, query string")
    found = client.search(base, asked).collect()
    assert {r.query_id for r in found} == {1} and 1 <= len(found) <= 5 and all(r.score > 0.01 for r in found)
    answers = {r.query_id: r for r in client.process_queries(base, asked).collect()}
    assert answers[2].score_confianca == 0.2 and "(baixa)" in answers[2].resposta


def docx(paragraphs):
    out = io.BytesIO()
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    return out.getvalue()


def test_files(spark, tmp_path):
    for name, content in {"a.TXT": b"caf\xe9", "b.md": "é".encode(), "c.docx": docx(["um", "dois"]), "d.docx": b"no zip", "e.pdf": b"long", "f.pdf": b"short", "g.xyz": b"x", "h": b"x"}.items():
        (tmp_path / name).write_bytes(content)
    pages = lambda content: ["p" * 60, None] if content == b"long" else [None]
    found = {r.path.rpartition("/")[2]: r for r in files.read_files(spark, str(tmp_path), pages=pages).collect()}
    assert found["a.TXT"].text == "caf�" and found["b.md"].text == "é" and found["c.docx"].text == "um\ndois\n"
    assert found["d.docx"].error.startswith("Erro ao processar DOCX") and found["e.pdf"].text == "p" * 60 + "\n"
    assert found["f.pdf"].text == files.SCANNED_EMPTY and found["g.xyz"].error == "Formato não suportado: xyz" and found["h"].error == "Formato não suportado: "
    raw = spark.read.format("binaryFile").load(str(tmp_path / "*.*")).select("path", "content")
    assert "a.TXT" not in {r.path.rpartition("/")[2] for r in files.strict_utf8(raw).collect()}


def test_added_documents(spark):
    base = knowledge.base_documents(spark).select("doc_idx", "id", "conteudo", "metadata")
    docs = spark.createDataFrame([(f"d{i}", "t", {"fonte": "f"}) for i in (3, 1, 2)], knowledge.SCHEMA)
    assert [r.id for r in knowledge.add_documents(base, docs).where("doc_idx >= 10").orderBy("doc_idx").collect()] == ["d1", "d2", "d3"]
    assert knowledge.add_documents(base, docs, replace=False, earlier=docs).count() == 16
    assert knowledge.add_documents(base, docs.limit(0)).count() == 10


def test_upload(spark, tmp_path):
    (tmp_path / "lei.txt").write_text("Art. 1 A posse.\nArt. 2 O prazo.", encoding="utf-8")
    (tmp_path / "vazio.txt").write_text(" \n", encoding="utf-8")
    (tmp_path / "foto.png").write_bytes(b"x")
    files_ = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    base = knowledge.base_documents(spark).select("doc_idx", "id", "conteudo", "metadata")
    records, corpus = assistant.upload(files_, base)
    got = {r["path"].rpartition("/")[2]: r for r in records.collect()}
    assert {k: r["chunks_adicionados"] for k, r in got.items()} == {"lei.txt": 2, "vazio.txt": 0, "foto.png": None}
    assert got["foto.png"]["error"] == "Formato não suportado: png" and got["lei.txt"]["error"] is None
    assert [c["tipo"] for c in got["lei.txt"]["chunks"]] == ["artigo", "artigo"] and got["lei.txt"]["fonte"] == "lei.txt"
    added = corpus.where("doc_idx >= 10").orderBy("doc_idx").collect()
    assert [(r["doc_idx"], r["id"], r["conteudo"]) for r in added] == [(10, "lei.txt/chunk_000001", "Art. 1 A posse."), (11, "lei.txt/chunk_000002", "Art. 2 O prazo.")]
    # nothing to add: the corpus that was there stays; otherwise the new chunks take the place of earlier ones
    _, same = assistant.upload(files_.where("path LIKE '%vazio.txt'"), base, corpus)
    assert same.count() == 12
    _, other = assistant.upload(files_.where("path LIKE '%foto.png'"), base)
    assert other.count() == 10
    docs = spark.createDataFrame([("z", "Art. 9 Outra coisa.", "z")], "doc_id string, text string, fonte string")
    assert [r["conteudo"] for r in assistant.add_texts(docs, base, corpus).where("doc_idx >= 10").collect()] == ["Art. 9 Outra coisa."]


def test_corpus_after_upload_is_counted_without_its_numbers(spark):
    sent = spark.createDataFrame([(f"in/{i}.{x}", f"Art. {i} A posse.\nArt. 2 O prazo.".encode()) for i in range(40) for x in ("txt", "MD", "png")], "path string, content binary")
    base = knowledge.base_documents(spark).select("doc_idx", "id", "conteudo", "metadata")
    records, corpus = assistant.upload(sent, base, record=assistant.tallies)
    got = records.collect()
    assert sorted((r.path.rpartition(".")[2], r.chunks_adicionados, r.num_entidades) for r in got) == sorted([("MD", 2, 3)] * 40 + [("png", None, None)] * 40 + [("txt", 2, 3)] * 40)
    held = corpus.groupBy(F.col("metadata")["fonte"].alias("fonte")).count()
    assert sum(r["count"] for r in held.collect() if r.fonte.endswith(("txt", "MD"))) == 160
    plan = held._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "explode" in plan and "conteudo:" not in plan
    rows = corpus.orderBy("doc_idx").select("doc_idx", "id").collect()
    assert [r.doc_idx for r in rows] == list(range(170)) and [r.id for r in rows[10:]] == sorted(r.id for r in rows[10:])


def test_history(spark, tmp_path):
    records = spark.createDataFrame([(i, f"q{i}") for i in range(30)], "seq long, query_original string")
    assistant.append_history(records.where("seq < 20"), str(tmp_path / "h"))
    assistant.append_history(records.where("seq >= 20"), str(tmp_path / "h"))
    history = spark.read.parquet(str(tmp_path / "h"))
    assert [r.seq for r in assistant.last_records(history).collect()] == list(range(10, 30))
    row = assistant.statistics(spark, history, index.build(spark.createDataFrame([(0, "terra")], "doc_idx long, text string"))).first()
    assert (row.total_consultas, row.ultimo_query, row.base_conhecimento) == (30, "q29", 10)


def test_arriving_files(spark, tmp_path):
    from acervo.operators import grammar

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("peticao,,")
    ingest.write_analyzed(ingest.arriving_texts(spark, str(tmp_path / "in")), grammar.correct, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert [r.texto_corrigido for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["petição,"]


@pytest.mark.parametrize(("vectors", "queries"), [(4096, 1024), (37, 5)])
def test_every_asked_vector(spark, monkeypatch, vectors, queries):
    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(search, "VECTORS", vectors)
    monkeypatch.setattr(search, "QUERIES", queries)
    got = registry.queries()["embedding_knn_many"](spark, sf).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    result = con.execute(registry.oracle_sql()["embedding_knn_many"])
    names = [d[0] for d in result.description]
    expected = [tuple(r[names.index(n)] for n in ("query_id", "vec_id", "score", "rank")) for r in result.fetchall()]
    assert sorted((r.query_id, r.vec_id, r.score, r["rank"]) for r in got) == sorted(expected)
    assert {r.query_id for r in got} == set(range(0, 500, 20)) and len(got) == 250


def test_nearest_of_many_ties_and_gaps(spark):
    rows = [(9, [1.0, 0.0]), (4, [2.0, 0.0]), (7, [0.0, 0.0]), (5, None), (1, [-1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    got = search.nearest_of_many(vectors, asked.where("vec_id IN (9, 5)"), 3).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(9, 1, 4, 1.0), (9, 2, 9, 1.0), (9, 3, 7, 0.0)]
    assert search.nearest_of_many(vectors, asked.limit(0), 3).count() == 0


@pytest.mark.parametrize("parts", [8, 200])
def test_added_documents_lose_nothing(spark, tmp_path, parts):
    """Written whole, at any number of partitions, every doc_idx is there once and in order of the key."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
        docs = docs.select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("id"), F.col("text").alias("conteudo"), F.create_map(F.lit("fonte"), F.lit("d")).alias("metadata"))
        docs = docs.unionByName(docs.limit(1)).unionByName(docs.limit(1).withColumn("id", F.lit(None).cast("string")))
        base = knowledge.base_documents(spark).select("doc_idx", "id", "conteudo", "metadata")
        knowledge.add_documents(base, docs).write.parquet(str(tmp_path / "all"))
        rows = spark.read.parquet(str(tmp_path / "all")).select("doc_idx", "id").orderBy("doc_idx").collect()
        assert [r.doc_idx for r in rows] == list(range(10_012))
        ids = [r.id or "" for r in rows[10:]]
        assert ids == sorted(ids)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_corpus_is_not_gathered(spark, asked):
    """Queries made in Python have no estimated size; the corpus must not be taken for the smaller side."""
    corpus = spark.range(1000).selectExpr("id AS doc_idx", "concat('terra ', id) AS text")
    fused = search.search_hybrid(index.build(corpus), asked)
    hits = assistant.hits(index.build(corpus), corpus.withColumn("fonte", F.lit("f")), asked)
    for found in (client.jaccard(corpus, asked), client.search(corpus, asked), fused, hits):
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan and "BuildLeft" not in plan


def test_texts_are_tokenized_above_the_shuffle(spark, asked):
    corpus = spark.range(10).selectExpr("id AS k").repartition(2, "k").selectExpr("k AS doc_idx", "concat('terra ', k) AS text")
    plan = client.jaccard(corpus, asked)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("concat(terra") == 1 and client.jaccard(corpus, asked).count() == 10


def test_many_queries_are_shuffled(spark, small, asked, monkeypatch):
    rows = lambda: [client.search(small, asked).orderBy("rank").collect(), search.search_hybrid(index.build(small), asked).orderBy("rank").collect()]
    expected = rows()
    monkeypatch.setattr(search, "FEW", 0)
    assert rows() == expected
