"""Every registered query against its SQL twin on the smallest tables, and the entry point without its optional parts."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from acervo.plans import registry

SF = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHEAP = ("bm25_topk", "rrf_hybrid_legal", "rerank_topk", "entities_all", "grammar_all", "corrected_text", "chunk_segments", "chunk_by_article", "client_linear_fusion", "client_entities", "client_analysis", "tfidf_vectors", "embedding_knn", "cross_references")


def test_every_twin_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", CHEAP)
def test_twin(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = registry.queries()[name](spark, SF)
    names = sorted(df.columns)
    result = con.execute(registry.oracle_sql()[name])
    found = [d[0] for d in result.description]
    assert sorted(found) == names
    shown = lambda rows: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)
    expected = shown([tuple(r[found.index(n)] for n in names) for r in result.fetchall()])
    got = shown(map(tuple, df.select(*names).collect()))
    assert got == expected and got


def test_without_the_optional_parts(tmp_path):
    for item in ("acervo", "__spark_entry__.py"):
        source = REPO / item
        shutil.copytree(source, tmp_path / item) if source.is_dir() else shutil.copy(source, tmp_path)
    shutil.rmtree(tmp_path / "acervo" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
