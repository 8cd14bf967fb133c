"""The light engine: smaller lists, ASCII word characters, Jaccard instead of cosine, no offsets for entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from acervo.functions.lexicons import CLIENT_LATIN, CLIENT_PATTERNS, CLIENT_REDUNDANCIES, CLIENT_SPELLING, CLIENT_STYLE, CLIENT_THEMES
from acervo.functions.regexes import literal
from acervo.functions.folds import let, scan
from acervo.functions.spans import matches, placed
from acervo.functions.text import client_tokens
from acervo.operators import chunking, scanning
from acervo.operators.index import exploded
from acervo.operators.search import few, met, only

K1, B, ALPHA = 1.5, 0.75, 0.5
MIN_SCORE, TOP = 0.01, 5
#: White space of ECMAScript.
JS_S = r"[\t-\r\x20\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def js(pattern: str, ignore_case: bool) -> str:
    """An ECMAScript pattern for Java: ASCII digits and word borders, its own white space."""
    inside, out, i = False, [], 0
    while i < len(pattern):
        pair = pattern[i : i + 2]
        if pair in (r"\s", r"\d", r"\b"):
            out.append({r"\s": JS_S[1:-1] if inside else JS_S, r"\d": "0-9" if inside else "[0-9]", r"\b": r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"}[pair])
            i += 2
            continue
        if pattern[i] == "\\":
            out.append(pair)
            i += 2
            continue
        inside = (inside or pattern[i] == "[") and pattern[i] != "]"
        out.append(pattern[i])
        i += 1
    return ("(?iu)" if ignore_case else "") + "".join(out)


# --- search ----------------------------------------------------------------------------------------------------
def bm25(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, doc_idx and bm25 of the pairs that share a term; statistics are the corpus's own."""
    tokens = corpus.select("doc_idx", client_tokens(F.col("text")).alias("tokens"))
    stats = tokens.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avg_dl"))
    asked = queries.select("query_id", F.explode(client_tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qn"))
    small = few(asked)
    found = only(exploded(tokens.select("doc_idx", F.size("tokens").alias("dl"), "tokens")), asked, small).groupBy("doc_idx", "dl", "term").agg(F.count("*").alias("tf"))
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    pairs = met(found, met(df, asked, "term", small), "term", small).crossJoin(F.broadcast(stats))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = F.col("qn") * idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    return pairs.groupBy("query_id", "doc_idx").agg(F.sum(weight).alias("bm25"))


def jaccard(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, doc_idx and semantic (shared over all distinct tokens) of the pairs that share a token."""
    docs = corpus.select("doc_idx", F.array_distinct(client_tokens(F.col("text"))).alias("tokens")).select("doc_idx", F.size("tokens").alias("d"), "tokens")
    asked = queries.select("query_id", F.array_distinct(client_tokens(F.col("query"))).alias("asked"))
    asked = asked.select("query_id", F.size("asked").alias("q"), F.explode("asked").alias("term"))
    counted = met(exploded(docs), asked, "term", few(asked)).groupBy("query_id", "doc_idx", "q", "d").agg(F.count("*").alias("both"))
    return counted.select("query_id", "doc_idx", (F.col("both") / (F.col("q") + F.col("d") - F.col("both"))).alias("semantic"))


def search(corpus: DataFrame, queries: DataFrame, method: str = "hibrido", alpha: float = ALPHA, digits: int = 15) -> DataFrame:
    """The five best documents over MIN_SCORE, ordered by the score clipped to 1; bm25 comes out over 10."""
    both = bm25(corpus, queries).join(jaccard(corpus, queries), ["query_id", "doc_idx"], "full").na.fill(0.0, ["bm25", "semantic"])
    fused = (1 - alpha) * (F.col("bm25") / 10) + alpha * F.col("semantic")
    score = F.col(method == "bm25" and "bm25" or "semantic") if method in ("bm25", "semantico") else fused
    found = both.withColumn("_raw", F.round(score, digits)).where(F.col("_raw") > MIN_SCORE).withColumn("score", F.least(F.lit(1.0), "_raw"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_idx")
    found = found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= TOP)
    return found.select("query_id", "doc_idx", "score", (F.col("bm25") / 10).alias("bm25"), "semantic", "rank")


# --- entities --------------------------------------------------------------------------------------------------
CLIENT_ENTITY = "struct<ord:int,pos:int,tipo:string,valor:string,texto_original:string,confianca:double,key:string>"


def _entity(number: int, kind: str):
    def row(m: Column, i: Column) -> Column:
        digits = F.regexp_replace(m["valor"], "[^0-9]", "")
        shown = F.when(F.length(digits) == 11, F.concat(F.lit("***.***. "), F.substring(digits, 7, 3), F.lit("-**"))).otherwise(m["valor"]) if kind == "cpf" else m["valor"]
        return F.struct(F.lit(number).alias("ord"), i.alias("pos"), F.lit(kind).alias("tipo"), shown.alias("valor"), m["original"].alias("texto_original"), F.lit(0.95).alias("confianca"), m["valor"].alias("key"))

    return row


def first_of_each(found: Column, key: str) -> Column:
    """The first entity of each (type, key)."""

    kind = f"array<{CLIENT_ENTITY}>"
    found = found.cast(kind)
    # sorted by type and key, an entity is the first of its kind where its neighbour before differs
    order = lambda r: F.struct(r["tipo"].alias("tipo"), r[key].alias("key"), r["ord"].alias("ord"), r["pos"].alias("pos"), r.alias("r"))

    def step(last: Column, o: Column) -> tuple[Column, Column]:
        same = last["tipo"].eqNullSafe(o["tipo"]) & last["key"].eqNullSafe(o["key"])
        return F.struct(o["tipo"].alias("tipo"), o["key"].alias("key")), F.when(same, F.array().cast(kind)).otherwise(F.array(o["r"]))

    none = F.lit(None).cast("string")
    firsts = scan(F.array_sort(F.transform(found, order)), F.struct(none.alias("tipo"), none.alias("key")), step, kind)
    return F.array_sort(firsts)  # by pattern and match


def entities(text: Column) -> Column:
    """Entities and themes by pattern order, the first of each (type, value before masking)."""
    parts = [F.transform(matches(text, js(p, ignore), 1), _entity(n, kind)) for n, (kind, p, ignore) in enumerate(CLIENT_PATTERNS)]
    lower = F.lower(text)
    for n, (theme, terms) in enumerate(CLIENT_THEMES.items()):
        term = F.get(F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(lower, t)), F.lit(0))
        row = F.struct(F.lit(len(CLIENT_PATTERNS) + n).alias("ord"), F.lit(0).alias("pos"), F.lit("tema_juridico").alias("tipo"), F.lit(theme).alias("valor"), term.alias("texto_original"), F.lit(0.85).alias("confianca"), F.lit(theme).alias("key"))
        parts.append(F.filter(F.array(row), lambda r: r["texto_original"].isNotNull()))
    return first_of_each(F.flatten(F.array(*parts)), "key")


def extract(docs: DataFrame) -> DataFrame:
    found = docs.select("doc_id", F.posexplode(scanning.client_entities(F.col("text"))).alias("n", "e"))
    return found.select("doc_id", F.col("n").cast("long").alias("n"), "e.tipo", "e.valor", "e.texto_original", "e.confianca")


def grouped(found: DataFrame) -> DataFrame:
    """Each type's distinct values in order of appearance."""
    listed = F.array_sort(F.collect_list(F.struct("n", "valor")))
    return found.groupBy("doc_id", "tipo").agg(F.array_distinct(F.transform(listed, lambda x: x["valor"])).alias("valores"))


def grouped_values(docs: DataFrame) -> DataFrame:
    """grouped of extract, grouped in each text first; texts of one doc_id are put together."""
    parts = docs.select("doc_id", scanning.client_groups(F.col("text")).alias("g")).groupBy("doc_id").agg(F.collect_list("g").alias("g"))
    of_type = lambda every, k: F.array_sort(F.flatten(F.transform(F.filter(every, lambda x: x["tipo"] == k), lambda x: x["valores"])))
    merged = lambda every: F.transform(F.array_distinct(F.transform(every, lambda x: x["tipo"])), lambda k: F.struct(k.alias("tipo"), of_type(every, k).alias("valores")))
    found = parts.select("doc_id", F.explode(F.when(F.size("g") == 1, F.get("g", F.lit(0))).otherwise(let(F.flatten("g"), merged))).alias("s"))
    return found.select("doc_id", "s.tipo", F.array_distinct(F.transform("s.valores", lambda v: v["valor"])).alias("valores"))


# --- corrections -----------------------------------------------------------------------------------------------
def _correction(order: int, tipo: str, severidade: str, sugestao, explicacao: str):
    def row(m: Column, i: Column) -> Column:
        new = sugestao(m) if callable(sugestao) else F.lit(sugestao)
        return F.struct(F.lit(order).alias("ord"), i.alias("pos"), m["gap"].alias("gap"), m["width"].alias("width"), F.lit(tipo).alias("tipo"), F.lit(severidade).alias("severidade"), m["original"].alias("texto_original"), new.alias("sugestao"), F.lit(explicacao).alias("explicacao"))

    return row


def _original(m: Column) -> Column:
    return m["original"]


def _sign(m: Column) -> Column:
    return F.right(m["original"], F.lit(1))


DOUBLED = r"([.,;:!?])\1+"


def corrections(text: Column) -> Column:
    """Corrections by start; offsets are code points."""
    rules = []
    for i, (a, b) in enumerate(CLIENT_SPELLING.items()):
        rules.append((f"(?iu){literal(a)}", _correction(i, "ortografia", "erro", b, f"Grafia correta: '{b}'")))
    for i, (a, b, c) in enumerate(CLIENT_REDUNDANCIES):
        rules.append((f"(?iu){literal(a)}", _correction(100 + i, "redundancia", "aviso", b, c)))
    for i, (a, b, c) in enumerate(CLIENT_STYLE):
        rules.append((js(rf"\b{literal(a)}\b", True), _correction(200 + i, "estilo", "info", b, c)))
    rules.append((DOUBLED, _correction(300, "pontuacao", "erro", _sign, "Remover pontuação duplicada")))
    rules.append((rf"{JS_S}+([.,;:!?])", _correction(400, "pontuacao", "aviso", _sign, "Remover espaço antes da pontuação")))
    for i, (a, b) in enumerate(CLIENT_LATIN.items()):
        rules.append((f"(?iu){literal(a)}", _correction(500 + i, "latinismo", "info", _original, f"Latinismo: '{a}' = {b}")))
    names = ("ord", "pos", "tipo", "severidade", "texto_original", "sugestao", "explicacao")
    kind = "tipo:string,severidade:string,texto_original:string,sugestao:string,explicacao:string>>"
    rows = F.flatten(F.array(*[F.transform(matches(text, p), row).cast(f"array<struct<ord:int,pos:int,gap:int,width:int,{kind}") for p, row in rules]))
    found = placed(rows, names, f"array<struct<ini:int,fim:int,ord:int,pos:int,{kind}")
    return F.array_sort(F.transform(found, lambda c: F.struct(*[c[n].alias(n) for n in ("ini", "ord", "pos", "fim", *names[2:])])))


def corrected(text: Column) -> Column:
    """Spelling replaced everywhere, then for each doubled sign of the text its first occurrence in what results."""
    out = text
    for a, b in CLIENT_SPELLING.items():
        out = F.regexp_replace(out, f"(?iu){literal(a)}", b)
    doubled = F.regexp_extract_all(text, F.lit(DOUBLED), F.lit(0))

    def first_replaced(state: Column, run: Column) -> Column:
        at = F.position(run, state)
        return F.when(at > 0, F.concat(F.left(state, at - 1), F.right(run, F.lit(1)), F.substring(state, at + F.length(run), F.length(state)))).otherwise(state)

    return F.aggregate(doubled, out, first_replaced)


def correct(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", corrected(text).alias("corrected"), corrections(text).alias("corrections"))


def correction_rows(docs: DataFrame) -> DataFrame:
    found = docs.select("doc_id", F.posexplode(corrections(F.coalesce("text", F.lit("")))).alias("n", "c"))
    return found.select("doc_id", F.col("n").cast("long").alias("n"), "c.tipo", "c.severidade", "c.texto_original", "c.sugestao", "c.explicacao", F.col("c.ini").cast("long").alias("ini"), F.col("c.fim").cast("long").alias("fim"))


# --- analysis --------------------------------------------------------------------------------------------------
#: Types of entities that an analysis lists as references.
REFERENCES = ("lei", "artigo", "sumula", "jurisprudencia")


def analyze(docs: DataFrame, source: Column | None = None) -> DataFrame:
    """One record for each text of docs (doc_id, text), without a shuffle: chunks, entities, corrections, references.

    A null text is empty: one empty chunk and nothing else. Repeated doc_ids have a record each.
    """
    fonte = F.lit("Texto Colado") if source is None else source
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("texto_original"), fonte.alias("fonte"))
    text = F.col("texto_original")
    chunks = F.transform(chunking.simple_pieces(text), lambda c: F.struct(c["type"].alias("tipo"), c["content"].alias("conteudo")))
    found = F.transform(scanning.client_entities(text), lambda e: F.struct(*[e[x].alias(x) for x in ("tipo", "valor", "texto_original", "confianca")]))
    rows = rows.withColumns({"chunks": chunks, "entidades": found, "texto_corrigido": corrected(text), "correcoes": corrections(text)})
    rows = rows.withColumn("referencias", F.filter("entidades", lambda e: e["tipo"].isin(*REFERENCES)))
    return rows.withColumns({f"total_{x}": F.size(x).cast("long") for x in ("chunks", "entidades", "correcoes")})


# --- answers and counters --------------------------------------------------------------------------------------
def confidence(scores: Column) -> Column:
    """0.2 without results, else twice the mean score, 0.95 at most."""
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)
    return F.when(F.size(scores) > 0, F.least(F.lit(0.95), mean * 2)).otherwise(0.2)


def process_queries(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """An answer record for each query (query_id, query); corpus has doc_idx, text and source."""
    found = search(corpus, queries).join(corpus.select("doc_idx", "text", "source"), "doc_idx")
    hits = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_idx", "score", "text", "source"))).alias("hits"))
    empty = F.array().cast("array<struct<rank:bigint,doc_idx:bigint,score:double,text:string,source:string>>")
    rows = queries.select("query_id", "query").join(hits, "query_id", "left").withColumn("hits", F.coalesce("hits", empty))
    own = F.concat(F.array(entities(F.col("query"))), F.transform("hits", lambda h: entities(h["text"])))
    rows = rows.withColumn("_e", F.flatten(own))
    rows = rows.withColumn("_unique", first_of_each(F.col("_e"), "valor"))
    themes = F.transform(F.filter("_unique", lambda e: e["tipo"] == "tema_juridico"), lambda e: e["valor"])
    rows = rows.withColumn("temas", themes).withColumn("score_confianca", confidence(F.transform("hits", lambda h: h["score"])))
    whole = lambda x: F.floor(x * 100 + 0.5).cast("int").cast("string")
    quote = lambda h: F.concat(F.left(h["text"], F.lit(250)), F.when(F.length(h["text"]) > 250, F.lit("...")).otherwise(""))
    parts = F.transform(F.slice("hits", 1, 3), lambda h: F.concat(F.lit("**"), h["rank"].cast("string"), F.lit(". "), h["source"], F.lit("** (relevância: "), whole(h["score"]), F.lit("%)\n\n> "), quote(h), F.lit("\n\n")))
    level = F.when(F.col("score_confianca") > 0.7, "alta").when(F.col("score_confianca") > 0.4, "média").otherwise("baixa")
    answer = F.concat(
        F.lit("📋 **Análise Jurídica**\n\nCom base na análise dos documentos recuperados:\n\n📚 **Fundamentos Legais Encontrados:**\n\n"),
        F.array_join(parts, ""),
        F.when(F.size("temas") > 0, F.concat(F.lit("📎 **Temas Jurídicos:** "), F.array_join("temas", ", "), F.lit("\n\n"))).otherwise(""),
        F.concat(F.lit("\n⚖️ **Confiança:** "), whole(F.col("score_confianca")), F.lit("% ("), level, F.lit(")\n\n")),
        F.lit("⚠️ *Esta análise é gerada automaticamente e não substitui a consulta a um profissional jurídico qualificado.*"),
    )
    return rows.select(
        "query_id",
        F.col("query").alias("query_original"),
        corrected(F.col("query")).alias("query_corrigida"),
        answer.alias("resposta"),
        "score_confianca",
        "temas",
        F.transform(F.slice("_unique", 1, 15), lambda e: F.struct(e["tipo"].alias("tipo"), e["valor"].alias("valor"), e["confianca"].alias("confianca"))).alias("entidades"),
        F.transform("hits", lambda h: F.struct(h["doc_idx"].alias("doc_idx"), h["score"].alias("score_combinado"), h["source"].alias("fonte"))).alias("documentos_relevantes"),
        corrections(F.col("query")).alias("correcoes_gramaticais"),
    )


def session_counters(events: DataFrame) -> DataFrame:
    """Totals of an event log (kind, amount); documents start at the ten of the base."""
    total = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("amount"))), F.lit(0)).cast("long")
    return events.agg(total("queries").alias("queries"), total("entities").alias("entities"), total("corrections").alias("corrections"), (total("documents") + 10).alias("documents"))


def recent_activity(events: DataFrame, order_by: str, shown: int = 10) -> DataFrame:
    """The newest entries of an activity log, newest first."""
    return events.orderBy(F.desc(order_by)).limit(shown)
