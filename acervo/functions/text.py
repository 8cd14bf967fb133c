"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from acervo.functions.lexicons import CLIENT_STOPWORDS, ENTITY_CLASSES, RERANK_STOPWORDS, STOPWORDS
from acervo.functions.regexes import STRIP, WORDS

#: Word characters of the light engine: ASCII and the accented letters that it names.
CLIENT_WORDS = "[A-Za-z0-9_áàâãéèêíìîóòôõúùûçü]+"
FIRST_LETTER_OF_WORD = r"(^|[^\p{L}])(\p{Ll})"


def tokenize(text: Column, stopwords: list[str] = STOPWORDS, words: str = WORDS) -> Column:
    """Lower-cased runs of word characters without stopwords and single characters; order and repeats stay.

    Replacing what is neither a word character nor blank by blanks and splitting at blanks gives just these runs.
    """
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(words), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(stopwords))


def rerank_tokens(text: Column) -> Column:
    return tokenize(text, RERANK_STOPWORDS)


def client_tokens(text: Column) -> Column:
    return tokenize(text, CLIENT_STOPWORDS, CLIENT_WORDS)


def bigrams(tokens: Column) -> Column:
    """Neighbouring tokens joined by a blank; none of fewer than two."""
    n = F.size(tokens)
    pairs = F.zip_with(F.slice(tokens, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(tokens, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(n >= 2, pairs).otherwise(F.array().cast("array<string>"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, STRIP, "")


def mask(value: Column, kind: Column) -> Column:
    """Personal numbers but for their middle digits."""
    digits = F.regexp_replace(value, r"\P{Nd}", "")
    cpf = F.concat(F.lit("***.***."), F.substring(digits, 7, 3), F.lit("-**"))
    cnpj = F.concat(F.lit("**.***.***/"), F.substring(digits, 9, 4), F.lit("-**"))
    return F.when((kind == "cpf") & (F.length(digits) == 11), cpf).when((kind == "cnpj") & (F.length(digits) == 14), cnpj).otherwise("***MASCARADO***")


def context(path: Column, text: Column) -> Column:
    """The hierarchy and the text's first 80 characters as one line."""
    return F.array_join(F.concat(path, F.array(F.left(text, F.lit(80)))), " > ")


def title(name: Column) -> Column:
    """direito_agrario as Direito Agrario."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def clipped(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def percent(share: Column) -> Column:
    """A share as a whole percentage, half to even."""
    return F.concat(F.bround(share * 100, 0).cast("int").cast("string"), F.lit("%"))


def session_id(stamp: Column) -> Column:
    return F.left(F.md5(stamp.cast("string")), F.lit(12))


def escape_html(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def markdown_to_html(text: Column) -> Column:
    """Bold, emphasis, quotes, lists and line ends of a small Markdown."""
    rules = [
        (r"\*\*([^\n\r\x{2028}\x{2029}]*?)\*\*", "<strong>$1</strong>"),
        (r"\*([^\n\r\x{2028}\x{2029}]*?)\*", "<em>$1</em>"),
        (r"(?m)^> ([^\n\r\x{2028}\x{2029}]*)", "<blockquote>$1</blockquote>"),
        (r"(?m)^- ([^\n\r\x{2028}\x{2029}]*)", "<li>$1</li>"),
        (r"(?s)(<li>.*</li>)", "<ul>$1</ul>"),
        (r"\n\n", "</p><p>"),
        (r"\n", "<br>"),
        (r"\A([^\n\r\x{2028}\x{2029}]*)\z", "<p>$1</p>"),
    ]
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def entity_class(kind: Column) -> Column:
    """The display class of an entity type."""
    known = F.create_map(*[F.lit(x) for pair in ENTITY_CLASSES.items() for x in pair])
    return F.coalesce(F.element_at(known, kind), F.lit("default"))
