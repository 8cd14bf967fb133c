"""DuckDB twins of the queries, written from the definitions and not from the Spark plans; only word lists are shared."""

from __future__ import annotations

from acervo.functions import lexicons as lx
from acervo.functions.regexes import S, W, literal, render, sql
from acervo.plans.fixtures import LEGAL_SQL, QUESTIONS_SQL

LEGAL = f"legal AS ({LEGAL_SQL})"
NOT_WORD = r"[^\p{L}\p{N}_]"
CLIENT_RUN = "[A-Za-z0-9_áàâãéèêíìîóòôõúùûçü]+"


def words(values: list[str]) -> str:
    return "[" + ", ".join(sql(v) for v in values) + "]"


def tokens(text: str, stop: list[str] = lx.STOPWORDS, run: str = W + "+") -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), {sql(run)}), lambda t: length(t) > 1 AND NOT list_contains({words(stop)}, t))"


def counted(parts: str) -> str:
    return f"CAST(coalesce(list_sum(list_transform({parts}, lambda z: length(z))), 0) AS BIGINT)"


def spans(table: str, pattern: str, group: int = 0, lead: bool = False, tail: bool = False, where: str = "true") -> str:
    """doc_id, pos, ini, original, valor of all matches; lead and tail: the pattern has a non-word character there that does not count."""
    value = "CASE WHEN coalesce(v[i], '') = '' THEN m[i] ELSE v[i] END" if group else "m[i]"
    inner = (
        f"SELECT doc_id, unnest(range(1, len(m) + 1)) AS i, m, v, gaps FROM (SELECT doc_id, regexp_extract_all(text, {sql(pattern)}, 0) AS m, "
        f"regexp_extract_all(text, {sql(pattern)}, {group}) AS v, regexp_split_to_array(text, {sql(pattern)}) AS gaps FROM {table} WHERE regexp_matches(text, {sql(pattern)}))"
    )
    raw = f"SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, m[i] AS original, {value} AS valor, {counted('gaps[1:i]')} + {counted('m[1:i-1]')} AS ini FROM ({inner})"
    if lead:
        raw = f"SELECT doc_id, pos, regexp_replace(original, {sql('^' + NOT_WORD)}, '') AS original, valor, ini + length(original) - length(regexp_replace(original, {sql('^' + NOT_WORD)}, '')) AS ini FROM ({raw})"
    if tail:
        raw = f"SELECT doc_id, pos, regexp_replace(original, {sql(NOT_WORD + '$')}, '') AS original, valor, ini FROM ({raw})"
    return f"SELECT doc_id, pos, CAST(ini AS BIGINT) AS ini, CAST(ini + length(original) AS BIGINT) AS fim, original, valor FROM ({raw}) WHERE {where}"


# --- index and search ------------------------------------------------------------------------------------------
def index_ctes(docs: str, dims: int = 128) -> str:
    return f"""corpus AS (SELECT doc_id AS doc_idx, text FROM {docs}),
toks AS MATERIALIZED (SELECT doc_idx, {tokens('text')} AS t FROM corpus),
lens AS (SELECT doc_idx, CAST(len(t) AS BIGINT) AS dl FROM toks),
post AS MATERIALIZED (SELECT doc_idx, term, count(*) AS tf FROM (SELECT doc_idx, unnest(t) AS term FROM toks) GROUP BY ALL),
stat AS (SELECT count(*) AS n_docs, avg(dl) AS avg_dl FROM lens),
terms AS MATERIALIZED (SELECT term, count(*) AS df, ln((any_value(n_docs) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf, min(doc_idx) AS first_doc, any_value(n_docs) AS n_docs FROM post, stat GROUP BY term),
vocab AS MATERIALIZED (SELECT term, row_number() OVER (ORDER BY df DESC, first_doc, encode(term)) - 1 AS slot, ln((n_docs + 1) / (df + 1)) + 1 AS widf FROM terms QUALIFY slot < {dims}),
vect AS MATERIALIZED (SELECT doc_idx, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_idx)) AS weight FROM (SELECT doc_idx, term, tf * widf AS w FROM post JOIN vocab USING (term)))"""


def search_ctes(queries: str) -> str:
    return f"""qs AS ({queries}),
qterm AS (SELECT query_id, term, count(*) AS qn FROM (SELECT query_id, unnest({tokens('query')}) AS term FROM qs) GROUP BY ALL),
bm AS (SELECT query_id, doc_idx, sum(qn * idf * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avg_dl))) AS score FROM post JOIN qterm USING (term) JOIN terms USING (term) JOIN lens USING (doc_idx), stat GROUP BY ALL),
qv AS (SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS q FROM (SELECT query_id, term, qn * widf AS w FROM qterm JOIN vocab USING (term))),
co AS (SELECT query_id, doc_idx, sum(q * weight) AS score FROM vect JOIN qv USING (term) GROUP BY ALL),
bmall AS (SELECT query_id, doc_idx, round(coalesce(score, 0), 9) AS score FROM qs CROSS JOIN lens LEFT JOIN bm USING (query_id, doc_idx)),
coall AS (SELECT query_id, doc_idx, round(coalesce(score, 0), 9) AS score FROM qs CROSS JOIN lens LEFT JOIN co USING (query_id, doc_idx))"""


def ranked(table: str, k: int) -> str:
    return f"SELECT query_id, doc_idx, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_idx) AS rank FROM {table} QUALIFY rank <= {k}"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c for c in ctes if c) + "\n"


def hybrid(k: int, alpha: float) -> str:
    """Fusion CTEs ending in fused(query_id, doc_idx, score_bm25, score_semantico, score_combinado, rank)."""
    return f"""lex AS ({ranked('bmall', 2 * k)}), den AS ({ranked('coall', 2 * k)}),
fused AS (SELECT query_id, doc_idx, coalesce(l.score, 0) AS score_bm25, coalesce(d.score, 0) AS score_semantico,
  coalesce(CAST({1 - alpha} AS DOUBLE) / (60 + l.rank), 0) + coalesce(CAST({alpha} AS DOUBLE) / (60 + d.rank), 0) AS score_combinado,
  row_number() OVER (PARTITION BY query_id ORDER BY coalesce(CAST({1 - alpha} AS DOUBLE) / (60 + l.rank), 0) + coalesce(CAST({alpha} AS DOUBLE) / (60 + d.rank), 0) DESC, l.rank NULLS LAST, d.rank) AS place
  FROM lex l FULL JOIN den d USING (query_id, doc_idx) QUALIFY place <= {k})"""


def rerank_ctes() -> str:
    stop = lx.RERANK_STOPWORDS
    boost = " + ".join(f"CASE WHEN contains(ql, {sql(t)}) AND contains(dl, {sql(t)}) THEN {w} ELSE 0 END" for t, w in lx.BOOSTS.items())
    most = " + ".join(f"CASE WHEN contains(ql, {sql(t)}) THEN {w} ELSE 0 END" for t, w in lx.BOOSTS.items())
    ref = sql(render(lx.RERANK_REFERENCE, True, java=False))
    pairs = lambda t: f"list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1])"
    total = " + ".join(f"{n} * CAST({w} AS DOUBLE)" for n, w in lx.FEATURE_WEIGHTS.items())
    return f"""pairs AS (SELECT f.query_id, f.doc_idx, f.score_combinado AS score_original, f.place AS in_rank, lower(query) AS ql, lower(text) AS dl, {tokens('query', stop)} AS q, {tokens('text', stop)} AS d FROM fused f JOIN qs USING (query_id) JOIN corpus USING (doc_idx)),
sets AS (SELECT *, len(list_intersect(list_distinct(q), list_distinct(d))) AS both_, len(list_distinct(list_concat(q, d))) AS either_, {pairs('q')} AS qb, {pairs('d')} AS db, list_distinct(regexp_extract_all(ql, {ref})) AS qr, list_distinct(regexp_extract_all(dl, {ref})) AS dr FROM pairs),
feats AS (SELECT *, CASE WHEN either_ > 0 THEN both_ / either_ ELSE 0 END AS term_overlap, CASE WHEN len(q) > 0 THEN both_ / len(list_distinct(q)) ELSE 0 END AS query_coverage,
  CASE WHEN len(qb) > 0 THEN len(list_intersect(list_distinct(qb), list_distinct(db))) / len(qb) ELSE 0 END AS term_proximity,
  CASE WHEN ({most}) > 0 THEN CAST({boost} AS DOUBLE) / CAST({most} AS DOUBLE) ELSE 0 END AS juridic_terms,
  CASE WHEN len(qr) > 0 THEN len(list_intersect(qr, dr)) / len(qr) ELSE 0.5 END AS exact_match,
  greatest(0, least(1, 1 - abs(len(d) - 100) / 300)) AS doc_quality, least(1, score_original) AS original_score FROM sets),
scored AS (SELECT *, {total} AS score_reranked FROM feats)"""


# --- entities --------------------------------------------------------------------------------------------------
def mask(value: str, kind: str) -> str:
    digits = f"regexp_replace({value}, '\\P{{Nd}}', '', 'g')"
    return f"'***.***.' || substr({digits}, 7, 3) || '-**'" if kind == "cpf" else f"'**.***.***/' || substr({digits}, 9, 4) || '-**'"


def entity_rows(table: str = "legal", kinds: tuple[str, ...] | None = None, themes: bool = True) -> str:
    """doc_id, ord, pos, ini, fim, tipo, valor, texto_original, confianca, area before duplicates go."""
    parts = []
    for n, (kind, pattern, ignore, borders) in enumerate(lx.ENTITY_PATTERNS):
        if kinds and kind not in kinds:
            continue
        if borders:  # whole runs of word characters
            found = spans(table, W + "+", where=f"regexp_full_match(original, {sql(render(pattern, ignore, java=False))})")
        else:
            found = spans(table, render(pattern, ignore, java=False), 1 if "(" in pattern.replace("(?:", "") else 0)
        value = mask("valor", kind) if kind in ("cpf", "cnpj") else "valor"
        parts.append(f"SELECT doc_id, {n} AS ord, pos, ini, fim, {sql(kind)} AS tipo, {value} AS valor, original AS texto_original, CAST(0.95 AS DOUBLE) AS confianca, CAST(NULL AS VARCHAR) AS area FROM ({found})")
    if themes:
        for n, (area, terms) in enumerate(lx.THEMES.items()):
            first = f"list_filter({words(terms)}, lambda t: contains(lower(text), t))[1]"
            name = " ".join(w.capitalize() for w in area.split("_"))
            parts.append(
                f"SELECT doc_id, {100 + n} AS ord, 0 AS pos, strpos(lower(text), term) - 1 AS ini, strpos(lower(text), term) - 1 + length(term) AS fim, 'tema_juridico' AS tipo, {sql(name)} AS valor, term AS texto_original, CAST(0.85 AS DOUBLE) AS confianca, {sql(area)} AS area "
                f"FROM (SELECT doc_id, text, {first} AS term FROM {table}) WHERE term IS NOT NULL"
            )
    return "\nUNION ALL ".join(parts)


def entity_ctes(table: str = "legal") -> str:
    return f"""found AS MATERIALIZED ({entity_rows(table)}),
kept AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY doc_id, ini, fim, tipo ORDER BY ord, pos) = 1),
ents AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ini, ord, pos) - 1 AS BIGINT) AS n, tipo, valor, texto_original, CAST(ini AS BIGINT) AS ini, CAST(fim AS BIGINT) AS fim, confianca, area FROM kept)"""


def cross_reference_rows(table: str = "legal") -> str:
    p = sql(render(lx.CROSS_REFERENCE, True, java=False))
    return f"SELECT doc_id, 'Lei ' || l[i] AS lei, 'Art. ' || a[i] AS artigo, CAST(min(i) - 1 AS BIGINT) AS ord FROM (SELECT doc_id, a, l, unnest(range(1, len(a) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, {p}, 1) AS a, regexp_extract_all(text, {p}, 2) AS l FROM {table})) GROUP BY ALL"


# --- corrections -----------------------------------------------------------------------------------------------
def _fix(found: str, order: int, tipo: str, severity: str, rule: str, new: str, why: str) -> str:
    return f"SELECT doc_id, {order} AS ord, pos, ini, fim, {sql(tipo)} AS tipo, {sql(severity)} AS severidade, original AS texto_original, {new} AS sugestao, {why} AS explicacao, {sql(rule)} AS regra FROM ({found})"


def correction_parts(family: str, table: str = "legal") -> list[str]:
    out = []
    if family == "spelling":
        for i, (a, b) in enumerate(lx.SPELLING.items()):
            out.append(_fix(spans(table, f"(?i){literal(a)}"), i, "ortografia", "erro", "ORTOGRAFIA_JURIDICA", sql(b), sql(f"Grafia correta: '{b}'")))
    if family == "abbreviations":
        after = {r"\.?\s*(\d)": rf"(?:\.{S}*|{S}+)(\p{{Nd}})", r"\.?\s": rf"\.?{S}", r"\.?\s+([IVXLCDM]+)": rf"\.?{S}+([IVXLCDM]+)", r"\.?\s+([a-z])\)": rf"\.?{S}+([a-z])\)", r"\.": r"\.", "": ""}
        for i, (word, rest, new) in enumerate(lx.ABBREVIATIONS):
            core = f"(?:{render(word)}){after[rest]}"
            if word == "n[°º]":
                core = "(?:nº)"
            closed = rest == ""
            p = f"(?i)(?:^|{NOT_WORD}){core}" + (f"(?:{NOT_WORD}|$)" if closed else "")
            change = f"regexp_replace(original, {sql('(?i)' + core)}, {sql(new.replace('$1', chr(92) + '1'))})"
            rows = _fix(spans(table, p, lead=True, tail=closed), 100 + i, "abreviacao", "aviso", "ABREVIACAO_PADRAO", change, f"'Abreviação padronizada: ''' || {change} || ''''")
            out.append(f"SELECT * FROM ({rows}) WHERE sugestao <> texto_original")
    if family == "redundancies":
        for i, (a, b, c) in enumerate(lx.REDUNDANCIES):
            out.append(_fix(spans(table, f"(?i){literal(a)}"), 200 + i, "redundancia", "aviso", "REDUNDANCIA", sql(b), sql(c)))
    if family == "style":
        for i, (a, b, c) in enumerate(lx.STYLE):
            out.append(_fix(spans(table, f"(?i)(?:^|{NOT_WORD}){literal(a)}(?:{NOT_WORD}|$)", lead=True, tail=True), 300 + i, "estilo", "info", "ESTILO_JURIDICO", sql(b), sql(c)))
    if family == "punctuation":
        doubled = "|".join(f"[{c}]{{2,}}" for c in ".,;:!?")
        out.append(_fix(spans(table, f"{S}+[.,;:!?]"), 400, "pontuacao", "aviso", "ESPACO_PONTUACAO", "right(original, 1)", sql("Remover espaço antes da pontuação")))
        out.append(_fix(spans(table, doubled), 401, "pontuacao", "erro", "DUPLICATA_PONTUACAO", "right(original, 1)", sql("Remover pontuação duplicada")))
    if family == "article_format":
        new = "'Art. ' || valor || CASE WHEN CAST(valor AS BIGINT) <= 9 THEN 'º ' ELSE ' ' END"
        why = "'Formatação padrão: ''' || 'Art. ' || valor || CASE WHEN CAST(valor AS BIGINT) <= 9 THEN 'º' ELSE '' END || ''''"
        rows = _fix(spans(table, rf"Art\.?{S}*(\p{{Nd}}+){S}", 1), 500, "formatacao", "info", "FORMATO_ARTIGO", new, why)
        out.append(f"SELECT * FROM ({rows}) WHERE sugestao <> texto_original")
    if family == "latin":
        for i, (a, b) in enumerate(lx.LATIN.items()):
            out.append(_fix(spans(table, f"(?i){literal(a)}"), 600 + i, "latinismo", "info", "LATINISMO", "original", sql(f"Latinismo: '{a}' = {b}")))
    return out


FAMILIES = ("spelling", "abbreviations", "redundancies", "style", "punctuation", "article_format", "latin")


def correction_ctes(families=FAMILIES, table: str = "legal") -> str:
    parts = "\nUNION ALL ".join(p for f in families for p in correction_parts(f, table))
    return f"""raw AS MATERIALIZED ({parts}),
fixes AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ini, ord, pos) - 1 AS BIGINT) AS n, tipo, severidade, texto_original, sugestao, explicacao, regra, ini, fim FROM raw)"""


EDITED = """edits AS (SELECT doc_id, list(sugestao ORDER BY ini) AS s, list(ini ORDER BY ini) AS a, list(fim ORDER BY ini) AS b FROM raw WHERE severidade = 'erro' GROUP BY doc_id),
edited AS (SELECT l.doc_id, CASE WHEN s IS NULL THEN text ELSE list_aggregate(list_transform(range(1, len(s) + 1), lambda i: substr(text, CASE WHEN i = 1 THEN 1 ELSE b[i - 1] + 1 END, a[i] - CASE WHEN i = 1 THEN 0 ELSE b[i - 1] END) || s[i]), 'string_agg', '') || substr(text, b[len(b)] + 1) END AS texto_corrigido FROM legal l LEFT JOIN edits USING (doc_id))"""


# --- chunks ----------------------------------------------------------------------------------------------------
def _strip(x: str) -> str:
    return f"regexp_replace({x}, {sql(f'^{S}+|{S}+$')}, '', 'g')"


def _typed(line: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({_strip(line)}, {sql('^(?:' + render(p) + ')')}) THEN {sql(k)}" for k, p in lx.STRUCTURE.items())
    return f"CASE {cases} END"


def _reference(line: str, kind: str) -> str:
    cases = " ".join(f"WHEN {sql(k)} THEN regexp_extract({_strip(line)}, {sql('^(?:' + render(p) + ')')}, 1)" for k, p in lx.STRUCTURE.items())
    return f"(CASE {kind} {cases} END)"


def segment_ctes(table: str = "legal") -> str:
    levels = "CASE tipo WHEN 'titulo' THEN 1 WHEN 'capitulo' THEN 2 WHEN 'secao' THEN 3 WHEN 'artigo' THEN 4 END"
    last = "\n".join(f", max(CASE WHEN lv = {n} THEN i END) OVER w AS l{n}, last_value(CASE WHEN lv = {n} THEN label END IGNORE NULLS) OVER w AS t{n}" for n in range(1, 5))
    valid = ", ".join(f"CASE WHEN l{n} IS NOT NULL AND l{n} > coalesce(greatest({', '.join(['-1'] + [f'coalesce(l{m}, -1)' for m in range(1, n)])}), -1) THEN t{n} END" for n in range(1, 5))
    return f"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM {table}),
typed AS (SELECT *, {_typed('line')} AS kind FROM lines),
marked AS (SELECT doc_id, i, line, CASE WHEN kind IN ('titulo', 'capitulo', 'secao', 'artigo') THEN kind END AS tipo FROM typed),
labelled AS (SELECT *, {levels} AS lv, upper(tipo[1]) || tipo[2:] || ' ' || {_reference('line', 'tipo')} AS label FROM marked),
state AS (SELECT *, count(lv) OVER w AS seg {last} FROM labelled WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
segs AS (SELECT doc_id, seg, coalesce(arg_min(tipo, i) FILTER (WHERE lv IS NOT NULL), 'texto_livre') AS tipo, {_strip("string_agg(line, chr(10) ORDER BY i)")} AS conteudo, min(i) AS linha,
  arg_min(list_filter([{valid}], lambda x: x IS NOT NULL), i) AS hierarquia FROM state GROUP BY doc_id, seg HAVING conteudo <> '')"""


# --- light engine ----------------------------------------------------------------------------------------------
def js_pattern(pattern: str, ignore: bool) -> str:
    blank = r"\t-\r\x20\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
    return ("(?i)" if ignore else "") + pattern.replace(r"[.\s]?", f"[.{blank}]?").replace(r"[.\s-]?", f"[.{blank}-]?").replace(r"[\d.", "[0-9.").replace(r"\d", "[0-9]").replace(r"\s", f"[{blank}]")


def client_entity_rows(table: str = "legal") -> str:
    parts = []
    for n, (kind, p, ignore) in enumerate(lx.CLIENT_PATTERNS):
        value = "CASE WHEN length(regexp_replace(valor, '[^0-9]', '', 'g')) = 11 THEN '***.***. ' || substr(regexp_replace(valor, '[^0-9]', '', 'g'), 7, 3) || '-**' ELSE valor END" if kind == "cpf" else "valor"
        parts.append(f"SELECT doc_id, {n} AS ord, pos, {sql(kind)} AS tipo, {value} AS valor, original AS texto_original, CAST(0.95 AS DOUBLE) AS confianca, valor AS k FROM ({spans(table, js_pattern(p, ignore), 1)})")
    for n, (theme, terms) in enumerate(lx.CLIENT_THEMES.items()):
        parts.append(f"SELECT doc_id, {100 + n} AS ord, 0 AS pos, 'tema_juridico' AS tipo, {sql(theme)} AS valor, term AS texto_original, CAST(0.85 AS DOUBLE) AS confianca, {sql(theme)} AS k FROM (SELECT doc_id, list_filter({words(terms)}, lambda t: contains(lower(text), t))[1] AS term FROM {table}) WHERE term IS NOT NULL")
    return "\nUNION ALL ".join(parts)


CLIENT_INDEX = f"""toks AS MATERIALIZED (SELECT doc_id AS doc_idx, {tokens('text', lx.CLIENT_STOPWORDS, CLIENT_RUN)} AS t FROM legal),
lens AS (SELECT doc_idx, len(t) AS dl, list_distinct(t) AS s FROM toks),
post AS (SELECT doc_idx, term, count(*) AS tf FROM (SELECT doc_idx, unnest(t) AS term FROM toks) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
stat AS (SELECT count(*) AS n, avg(dl) AS avg_dl FROM lens),
qs AS ({QUESTIONS_SQL}),
qtok AS (SELECT query_id, {tokens('query', lx.CLIENT_STOPWORDS, CLIENT_RUN)} AS t FROM qs),
bm AS (SELECT query_id, doc_idx, sum(qn * ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avg_dl))) AS bm25
  FROM (SELECT query_id, term, count(*) AS qn FROM (SELECT query_id, unnest(t) AS term FROM qtok) GROUP BY ALL) JOIN post USING (term) JOIN df USING (term) JOIN lens USING (doc_idx), stat GROUP BY ALL),
ja AS (SELECT query_id, doc_idx, len(list_intersect(list_distinct(q.t), s)) / len(list_distinct(list_concat(q.t, s))) AS semantic FROM qtok q, lens WHERE len(list_intersect(list_distinct(q.t), s)) > 0)"""
