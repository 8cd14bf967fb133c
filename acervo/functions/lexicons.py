"""Word lists, patterns and weights that results depend on. All of them are fixed values."""

from __future__ import annotations

# Stopwords of the lexical index.
STOPWORDS = [
    "a", "o", "e", "é", "de", "do", "da", "dos", "das", "em", "no", "na",
    "nos", "nas", "um", "uma", "uns", "umas", "por", "para", "com", "sem",
    "sob", "sobre", "entre", "contra", "após", "até", "desde", "que",
    "se", "ao", "aos", "à", "às", "ou", "como", "mais", "menos", "muito",
    "já", "ainda", "também", "mas", "porém", "contudo", "todavia",
    "não", "nem", "ser", "ter", "haver", "estar", "ir", "vir", "fazer",
    "este", "esta", "esse", "essa", "aquele", "aquela", "isto", "isso",
    "aquilo", "seu", "sua", "seus", "suas", "meu", "minha", "nosso", "nossa",
    "foi", "são", "será", "seria", "pode", "deve", "deverá", "poderá",
]

# Stopwords of the reranker.
RERANK_STOPWORDS = [
    "a", "o", "e", "de", "do", "da", "dos", "das", "em", "no", "na",
    "um", "uma", "por", "para", "com", "que", "se", "ao", "à", "ou",
    "como", "mais", "não", "seu", "sua", "foi", "são", "ser", "ter",
]

# Stopwords of the light engine.
CLIENT_STOPWORDS = [
    "a", "o", "e", "é", "de", "do", "da", "dos", "das", "em", "no", "na", "nos", "nas", "um", "uma", "por", "para", "com",
    "que", "se", "ao", "à", "ou", "como", "mais", "não", "seu", "sua", "foi", "são", "ser", "ter",
]

# Entity types and their patterns, in evaluation order: (type, pattern, ignore case, word borders).
NUMBER = r"(\d[\d.]*(?:/\d{2,4})?)"
NTH = r"(?:n[°º]?\s*)?"
MONTHS = "janeiro|fevereiro|março|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro"
ENTITY_PATTERNS = [
    ("lei", rf"Lei\s+{NTH}{NUMBER}", True, False),
    ("lei", rf"Lei\s+Complementar\s+{NTH}{NUMBER}", True, False),
    ("lei", rf"Lei\s+Federal\s+{NTH}{NUMBER}", True, False),
    ("lei", rf"Lei\s+Estadual\s+{NTH}{NUMBER}", True, False),
    ("decreto", rf"Decreto(?:-[Ll]ei)?\s+{NTH}{NUMBER}", True, False),
    ("medida_provisoria", rf"Medida\s+Provisória\s+{NTH}{NUMBER}", True, False),
    ("medida_provisoria", rf"MP\s+{NTH}{NUMBER}", True, False),
    ("constituicao", r"Constituição\s+Federal(?:\s+de\s+(\d{4}))?", True, False),
    ("constituicao", r"CF(?:/(\d{2,4}))?", True, False),
    ("artigo", r"[Aa]rt(?:igo)?\.?\s*(\d+)[°º]?(?:\s*,?\s*(?:caput|§|inciso|alínea))?", False, False),
    ("paragrafo", r"§\s*(\d+)[°º]?", False, False),
    ("paragrafo", r"[Pp]arágrafo\s+único", False, False),
    ("inciso", r"[Ii]nciso\s+([IVXLCDM]+)", False, False),
    ("alinea", r"""[Aa]línea\s+["']?([a-z])["']?\)?\s""", False, False),
    ("sumula", rf"Súmula\s+(?:Vinculante\s+)?{NTH}(\d+)(?:\s+do\s+(STF|STJ|TST))?", True, False),
    ("jurisprudencia", rf"(RE|REsp|HC|MS|ADI|ADPF|ADC)\s+{NTH}(\d[\d./-]*)", True, False),
    ("jurisprudencia", rf"Acórdão\s+{NTH}(\d[\d./-]*)", True, False),
    ("tribunal", r"(STF|STJ|TST|TSE|STM|TRF\d?|TJ[A-Z]{2}|TRT\d{1,2}|TRE[A-Z]{2}|CNJ)", False, True),
    ("orgao", r"(IBAMA|MAPA|INCRA|FUNAI|ICMBio|ANVISA|CADE|TCU|CGU|MPF|MPT|MPE|DPU|AGU|OAB|CRM|CRO|CREA)", False, True),
    ("data", rf"(\d{{1,2}})\s+de\s+({MONTHS})\s+de\s+(\d{{4}})", True, False),
    ("data", r"(\d{1,2}/\d{1,2}/\d{2,4})", False, False),
    ("prazo", r"(\d+)\s+(dias?|meses?|anos?|horas?)(?:\s+(?:úteis|corridos|contados))?", True, False),
    ("valor_monetario", r"R\$\s*(\d[\d.,]*)", True, False),
    ("cpf", r"(\d{3}[.\s]?\d{3}[.\s]?\d{3}[.\s-]?\d{2})", False, False),
    ("cnpj", r"(\d{2}[.\s]?\d{3}[.\s]?\d{3}[/\s]?\d{4}[.\s-]?\d{2})", False, False),
    ("numero_processo", r"(\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4})", False, False),
]
CROSS_REFERENCE = rf"[Aa]rt\.?\s*(\d+)[°º]?\s+d[oae]\s+Lei\s+{NTH}{NUMBER}"

# Themes and their terms; the first term of the list that occurs decides.
THEMES = {
    "direito_agrario": [
        "reforma agrária", "propriedade rural", "função social da terra", "desapropriação", "assentamento",
        "estatuto da terra", "imóvel rural", "módulo rural", "produtividade", "colonização",
    ],
    "direito_ambiental": [
        "licenciamento ambiental", "área de preservação", "reserva legal", "desmatamento", "fauna", "flora",
        "poluição", "impacto ambiental", "crimes ambientais", "unidade de conservação",
    ],
    "direito_civil": [
        "contrato", "propriedade", "posse", "usucapião", "herança", "testamento", "responsabilidade civil",
        "dano moral", "obrigações",
    ],
    "direito_constitucional": [
        "direitos fundamentais", "habeas corpus", "mandado de segurança", "ação civil pública",
        "controle de constitucionalidade",
    ],
    "direito_trabalhista": [
        "CLT", "trabalho rural", "contrato de trabalho", "rescisão", "férias", "FGTS", "adicional", "insalubridade",
    ],
    "direito_penal": [
        "crime", "pena", "prisão", "dolo", "culpa", "legítima defesa", "prescrição", "inquérito", "ação penal",
    ],
}

# Spelling.
SPELLING = {
    "mandado de seguranca": "mandado de segurança",
    "habeas-corpus": "habeas corpus",
    "habes corpus": "habeas corpus",
    "excecao": "exceção",
    "exceçao": "exceção",
    "peticao": "petição",
    "petiçao": "petição",
    "acordao": "acórdão",
    "acordão": "acórdão",
    "revel": "revel",
    "prescriçao": "prescrição",
    "prescricao": "prescrição",
    "constituiçao": "constituição",
    "constituicao": "constituição",
    "jurisdiçao": "jurisdição",
    "jurisdicao": "jurisdição",
    "usucapiao": "usucapião",
    "indenisação": "indenização",
    "indenisacao": "indenização",
    "restituiçao": "restituição",
    "apreençao": "apreensão",
    "apreensao": "apreensão",
    "desapropriaçao": "desapropriação",
    "desapropriacao": "desapropriação",
}

# Abbreviations as (pattern with a border before it, pattern after the letters, replacement).
ABBREVIATIONS = [
    ("art", r"\.?\s*(\d)", "Art. $1"),
    ("arts", r"\.?\s", "Arts. "),
    ("par", r"\.?\s*(\d)", "§ $1"),
    (r"paragrafo\s+unico", "", "Parágrafo único"),
    ("inc", r"\.?\s+([IVXLCDM]+)", "Inciso $1"),
    ("al", r"\.?\s+([a-z])\)", "Alínea $1)"),
    ("n[°º]", "", "nº"),
    ("min", r"\.", "Min."),
    ("des", r"\.", "Des."),
    ("proc", r"\.", "Proc."),
    ("fl", r"\.", "fl."),
    ("fls", r"\.", "fls."),
    ("vol", r"\.", "vol."),
]

# Redundancies as (phrase, suggestion, explanation).
REDUNDANCIES = [
    ("elo de ligação", "elo", "A palavra 'elo' já significa ligação"),
    ("há anos atrás", "há anos", "'Há' já indica passado, dispensando 'atrás'"),
    ("a grande maioria", "a maioria", "'Maioria' já indica a maior parte"),
    ("todos foram unânimes", "foram unânimes", "'Unânimes' já significa todos"),
    ("juntada aos autos do processo", "juntada aos autos", "'Autos' já refere-se ao processo"),
    ("comparecer pessoalmente", "comparecer", "'Comparecer' já implica presença pessoal"),
    ("cada um dos réus", "cada réu", "Simplicação sem perda de sentido"),
    ("em face de tudo o que foi exposto", "ante o exposto", "Expressão jurídica mais concisa"),
    ("tendo em vista que", "considerando que", "Expressão jurídica mais adequada"),
]

# Style as (term, suggestion, explanation).
STYLE = [
    ("mesmo", "este/este último", "Evite usar 'mesmo' como pronome — use 'este' ou 'este último'"),
    ("onde", "em que/no qual", "Use 'onde' apenas para lugar físico — para referências normativas, use 'em que' ou 'no qual'"),
    ("através de", "por meio de/mediante", "Em linguagem jurídica formal, prefira 'por meio de' ou 'mediante'"),
    ("face ao exposto", "ante o exposto", "A forma mais aceita é 'ante o exposto'"),
    ("enquanto que", "enquanto/ao passo que", "'Enquanto que' é considerado inadequado — use 'enquanto' ou 'ao passo que'"),
    ("a nível de", "no âmbito de/em termos de", "'A nível de' é inadequado na linguagem formal"),
]

# Latin phrases and what they mean.
LATIN = {
    "ad hoc": "para este fim",
    "ad referendum": "para referendo/aprovação",
    "data venia": "com a devida permissão",
    "de cujus": "falecido/autor da herança",
    "ex nunc": "a partir de agora (sem retroatividade)",
    "ex tunc": "desde então (com retroatividade)",
    "fumus boni iuris": "aparência do bom direito",
    "habeas corpus": "tenhas o corpo (garantia de liberdade)",
    "in dubio pro reo": "na dúvida, a favor do réu",
    "inter partes": "entre as partes",
    "jus postulandi": "direito de postular em juízo",
    "lato sensu": "em sentido amplo",
    "lex specialis": "lei especial",
    "mandamus": "mandamos (ordem judicial)",
    "periculum in mora": "perigo na demora",
    "stricto sensu": "em sentido estrito",
    "sub judice": "sob julgamento",
    "sui generis": "de espécie própria/único",
}

# Terms that the reranker weighs, the weights of its features, and its references.
BOOSTS = {
    "reforma agrária": 2.0, "função social": 2.0, "propriedade rural": 1.8, "estatuto da terra": 1.8,
    "desapropriação": 1.5, "assentamento": 1.5, "imóvel rural": 1.5, "módulo rural": 1.5, "produtividade": 1.3,
    "licenciamento ambiental": 2.0, "preservação permanente": 1.8, "reserva legal": 1.8, "desmatamento": 1.5,
    "crime ambiental": 1.5, "jurisprudência": 1.5, "súmula": 1.8, "acórdão": 1.5, "sentença": 1.3, "decisão": 1.2,
    "recurso": 1.2, "artigo": 1.2, "parágrafo": 1.2, "inciso": 1.2, "alínea": 1.2,
}
FEATURE_WEIGHTS = {
    "term_overlap": 0.25,
    "query_coverage": 0.20,
    "term_proximity": 0.15,
    "juridic_terms": 0.15,
    "exact_match": 0.10,
    "doc_quality": 0.10,
    "original_score": 0.05,
}
RERANK_REFERENCE = r"(?:Art\.\s*\d+|Lei\s+[\d./]+|§\s*\d+|Súmula\s+\d+)"

# What begins a structural element of a text, in the order of levels.
STRUCTURE = {
    "titulo": r"(?:TÍTULO|Título)\s+([IVXLCDM]+|[0-9]+)",
    "capitulo": r"(?:CAPÍTULO|Capítulo)\s+([IVXLCDM]+|[0-9]+)",
    "secao": r"(?:SEÇÃO|Seção|SUBSEÇÃO|Subseção)\s+([IVXLCDM]+|[0-9]+)",
    "artigo": r"(?:Art\.|Artigo)\s*(\d+)",
    "paragrafo": r"(?:§\s*(\d+)[°º]?|Parágrafo\s+único)",
    "inciso": r"([IVXLCDM]+)\s*[-–—]",
    "alinea": r"([a-z])\)",
}

# The light engine's patterns, themes and corrections.
CLIENT_PATTERNS = [
    ("lei", rf"Lei\s+{NTH}{NUMBER}", True),
    ("lei", rf"Lei\s+Complementar\s+{NTH}{NUMBER}", True),
    ("decreto", rf"Decreto(?:-[Ll]ei)?\s+{NTH}{NUMBER}", True),
    ("constituicao", r"Constituição\s+Federal(?:\s+de\s+(\d{4}))?", True),
    ("constituicao", r"CF/(\d{2,4})", True),
    ("artigo", r"Art\.?\s*(\d+)[°º]?", True),
    ("paragrafo", r"§\s*(\d+)[°º]?", True),
    ("sumula", rf"Súmula\s+(?:Vinculante\s+)?{NTH}(\d+)", True),
    ("jurisprudencia", rf"(RE|REsp|HC|MS|ADI|ADPF|ADC)\s+{NTH}([\d./-]+)", True),
    ("tribunal", r"\b(STF|STJ|TST|TSE|STM|TRF\d?|TJ[A-Z]{2}|CNJ)\b", False),
    ("orgao", r"\b(IBAMA|MAPA|INCRA|FUNAI|ICMBio|ANVISA|CADE|TCU|MPF|OAB|AGU)\b", False),
    ("data", rf"(\d{{1,2}})\s+de\s+({MONTHS})\s+de\s+(\d{{4}})", True),
    ("prazo", r"(\d+)\s+(dias?|meses?|anos?)\s*(?:úteis|corridos)?", True),
    ("valor_monetario", r"R\$\s*([\d.,]+)", False),
    ("numero_processo", r"(\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4})", False),
    ("cpf", r"(\d{3}[.\s]?\d{3}[.\s]?\d{3}[.\s-]?\d{2})", False),
]
CLIENT_THEMES = {
    "Direito Agrário": ["reforma agrária", "propriedade rural", "função social da terra", "desapropriação", "estatuto da terra", "imóvel rural"],
    "Direito Ambiental": ["licenciamento ambiental", "preservação permanente", "reserva legal", "desmatamento", "crime ambiental", "código florestal"],
    "Direito Constitucional": ["direitos fundamentais", "constituição federal", "mandado de segurança", "habeas corpus"],
    "Direito Civil": ["contrato", "propriedade", "posse", "usucapião", "responsabilidade civil"],
}
CLIENT_SPELLING = {k: v for k, v in SPELLING.items() if k not in ("habes corpus", "revel", "restituiçao", "apreençao", "apreensao")}
CLIENT_REDUNDANCIES = [
    ("elo de ligação", "elo", "'Elo' já significa ligação"),
    ("há anos atrás", "há anos", "'Há' já indica passado"),
    ("a grande maioria", "a maioria", "'Maioria' já indica a maior parte"),
    ("comparecer pessoalmente", "comparecer", "Já implica presença pessoal"),
]
CLIENT_STYLE = [
    ("através de", "por meio de", "Prefira 'por meio de' na linguagem jurídica formal"),
    ("face ao exposto", "ante o exposto", "A forma mais aceita é 'ante o exposto'"),
    ("tendo em vista que", "considerando que", "Expressão mais adequada"),
]
CLIENT_LATIN = {
    "fumus boni iuris": "aparência do bom direito",
    "periculum in mora": "perigo na demora",
    "habeas corpus": "garantia de liberdade",
    "ad hoc": "para este fim",
    "data venia": "com a devida permissão",
    "ex nunc": "a partir de agora",
    "ex tunc": "desde então",
    "in dubio pro reo": "na dúvida, a favor do réu",
    "sub judice": "sob julgamento",
}
ENTITY_CLASSES = {
    "lei": "lei", "decreto": "lei", "medida_provisoria": "lei", "constituicao": "lei",
    "artigo": "artigo", "paragrafo": "artigo", "inciso": "artigo", "alinea": "artigo",
    "tribunal": "tribunal", "sumula": "tribunal", "jurisprudencia": "tribunal",
    "orgao": "orgao", "tema_juridico": "tema", "data": "data", "prazo": "data", "numero_processo": "processo",
}
