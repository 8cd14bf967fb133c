"""Entities, corrections and chunks of whole columns of texts: compiled patterns over Arrow batches.

The rules are those of the expressions in entities, grammar, client and chunking, which serve texts inside arrays; there
every pattern is searched three times and every row is built by interpreted lambdas. Here some thousand texts are joined
by NULs, which no pattern meets and which bound a word as the end of a text does, so that a pattern is searched once in
all of them, and rows are built column by column. Patterns that begin with letters are found by these; where one begins
with digits or spaces, numpy names the places where it can match, and only those are tried. `\\s`, `\\d` and `\\w` of
Python are the classes that `render` spells out.
"""

from __future__ import annotations

import gc
import re
import sys
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import cache, cached_property, lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.functions import lexicons as lx

#: Bytes of an Arrow batch, and code points of the texts that are searched as one.
BATCH, JOINED = 8 << 20, 1 << 20
_INT, _LONG, _TEXT = pa.int32(), pa.int64(), pa.string()
_PLACES = [("ini", _INT), ("ord", _INT), ("pos", _INT), ("fim", _INT)]
ENTITY = [*_PLACES, ("tipo", _TEXT), ("valor", _TEXT), ("texto_original", _TEXT), ("confianca", pa.float64()), ("area", _TEXT)]
CORRECTION = [*_PLACES, *((x, _TEXT) for x in ("tipo", "severidade", "texto_original", "sugestao", "explicacao", "regra"))]
CLIENT_ENTITY = [("ord", _INT), ("pos", _INT), *((x, _TEXT) for x in ("tipo", "valor", "texto_original")), ("confianca", pa.float64()), ("key", _TEXT)]
_VALUES = pa.list_(pa.struct([("n", _INT), ("valor", _TEXT)]))
CLIENT_GROUP = [("tipo", _TEXT), ("valores", _VALUES)]
TOTAL = [("tipo", _TEXT), ("severidade", _TEXT), ("n", _LONG)]
CHUNK = [("tipo", _TEXT), ("conteudo", _TEXT), ("hierarquia", pa.list_(_TEXT)), ("tamanho", _LONG), ("lin_ini", _LONG), ("lin_fim", _LONG)]
REFERENCE = [("lei", _TEXT), ("artigos", pa.list_(_TEXT))]
_DDL = {_INT: "int", _LONG: "bigint", _TEXT: "string", pa.float64(): "double", pa.list_(_TEXT): "array<string>", _VALUES: "array<struct<n:int,valor:string>>"}


# --- texts as one ----------------------------------------------------------------------------------------------
@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every code point: its lower case (place for place; whatever a pattern finds without regard to case is in it in
    lower case), whether it is a digit, whether it is a space."""
    low = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    every = "".join(map(chr, range(sys.maxunicode + 1)))
    for i, c in enumerate(every[:0x20000]):
        if c != (to := c.lower()) and len(to) == 1:
            low[i] = ord(to)
    for c, to in zip("İıſ\u212a", "iisk"):
        low[ord(c)] = ord(to)
    digit, space = np.zeros(len(low), bool), np.zeros(len(low), bool)
    digit[[m.start() for m in re.finditer(r"\d", every)]] = True
    space[[m.start() for m in re.finditer(r"\s", every)]] = True
    return low, digit, space


class Texts:
    """Texts joined by NULs. `starts` has where each begins, `low` is in lower case, place for place."""

    def __init__(self, texts: list[str]):
        self.texts, self.text = texts, "\0".join(texts)
        self.starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])

    @cached_property
    def codes(self) -> np.ndarray:
        codes = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        return np.concatenate([codes, np.zeros(16, np.uint32)])  # room to look ahead

    @cached_property
    def _at(self) -> np.ndarray:
        return self.codes.astype(np.intp)

    @cached_property
    def folded(self) -> np.ndarray:
        return _tables()[0].take(self._at)

    @cached_property
    def digit(self) -> np.ndarray:
        return _tables()[1].take(self._at)

    @cached_property
    def space(self) -> np.ndarray:
        return _tables()[2].take(self._at)

    @cached_property
    def low(self) -> str:
        return self.folded[:-16].tobytes().decode("utf-32-le")

    @cached_property
    def blank(self) -> np.ndarray:
        return self.space | (self.codes == 0xFEFF)  # ECMAScript has this one more

    @cached_property
    def last_digits(self) -> np.ndarray:
        return np.flatnonzero(self.digit[:-16] & self.blank[1:-15])

    def holders(self, at: np.ndarray) -> np.ndarray:
        """Which text each place is in."""
        return np.searchsorted(self.starts, at, "right") - 1

    def lowered(self) -> tuple[str, np.ndarray]:
        """The texts in plain lower case, which may be longer, joined, and where each begins."""
        if not any(c in self.text for c in "İıſ\u212a"):
            return self.low, self.starts
        texts = [t.lower() for t in self.texts]
        return "\0".join(texts), np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])


def joined(texts: pa.Array) -> Iterator[Texts]:
    """A column of texts in groups; a null text is empty."""
    group, size = [], 0
    for t in texts.to_pylist():
        group.append(t or "")
        size += len(group[-1]) + 1
        if size >= JOINED:
            yield Texts(group)
            group, size = [], 0
    if group:
        yield Texts(group)


# --- columns ---------------------------------------------------------------------------------------------------
Rows = tuple[np.ndarray, list[pa.Array]]


def _evaluated(text: Column, kind: str, of: Callable[[Texts], pa.Array], empty: pa.DataType) -> Column:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        small_batches(spark)

    def run(texts: pa.Array) -> pa.Array:
        collects = gc.isenabled()
        gc.disable()  # matches hold no cycles, and looking for some costs as much as making them
        try:
            return pa.concat_arrays([of(t) for t in joined(texts)] or [pa.array([], empty)])
        finally:
            if collects:
                gc.enable()

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind)(text)


def small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(re.sub(r"\D.*", "", spark.conf.get(name)) or 0) <= BATCH:
        spark.conf.set(name, str(BATCH))


def column(text: Column, fields: list[tuple[str, pa.DataType]], of: Callable[[Texts], Rows]) -> Column:
    """of(texts), rows of these fields and how many each text has, as an array of structs."""

    def lists(texts: Texts) -> pa.Array:
        counts, columns = of(texts)
        values = pa.StructArray.from_arrays(columns, [n for n, _ in fields])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), _INT), values)

    ddl = "array<struct<" + ",".join(f"{n}:{_DDL[k]}" for n, k in fields) + ">>"
    return _evaluated(text, ddl, lists, pa.list_(pa.struct(fields)))


def amount(text: Column, of: Callable[[Texts], np.ndarray]) -> Column:
    """of(texts), a number for each text."""
    return _evaluated(text, "bigint", lambda texts: pa.array(of(texts), _LONG), _LONG)


# --- patterns --------------------------------------------------------------------------------------------------
def _bordered(pattern: str, word: str = r"\w") -> str:
    """The pattern with word borders on both sides; its first letters come first, as these are found quickly."""
    head = re.match(r"(?:(?:\\ |[^\W\d_])+(?![?*+{]))?", pattern)[0]
    return f"{head}(?<!{word}{head}){pattern[len(head):]}(?!{word})" if head else f"(?<!{word})(?:{pattern})(?!{word})"


def _alternatives(pattern: str) -> list[tuple[str, str]]:
    """(A|B)rest as (A)rest and (B)rest, the first part apart; in these patterns no two of them match in one place, nor into each other."""
    several = re.match(r"\(([^()\\]\w[^()]*\|[^()]*)\)", pattern)
    return [(a, pattern[several.end() :]) for a in several[1].split("|")] if several else []


def _or_before(t: Texts, at: np.ndarray) -> np.ndarray:
    """These places, no two of them neighbours, and those before them that are digits too."""
    before = at[at > 0] - 1
    return np.sort(np.concatenate([at, before[t.digit[before]]]))


def _last_digits(t: Texts, *words: str) -> np.ndarray:
    """Last digits before a space, behind which a word of these two letters begins or a further space comes."""
    last = t.last_digits
    one, two = t.folded[last + 2], t.folded[last + 3]
    found = t.blank[last + 2]
    for a, b in words:
        found |= (one == ord(a)) & (two == ord(b))
    return last[found]


def _dates(t: Texts) -> np.ndarray:
    return _or_before(t, _last_digits(t, "de"))


def _slashes(t: Texts) -> np.ndarray:
    sign = t.codes == ord("/")
    at = np.flatnonzero(sign)
    at = at[(at > 0) & t.digit[at - 1] & t.digit[at + 1] & (sign[at + 2] | sign[at + 3])]
    return _or_before(t, at - 1)


def _terms(ascii_digits: bool) -> Callable[[Texts], np.ndarray]:
    def starts(t: Texts) -> np.ndarray:
        last = _last_digits(t, "di", "me", "an", "ho")
        digit = (t.codes >= 48) & (t.codes < 58) if ascii_digits else t.digit
        first = np.flatnonzero(digit & ~np.concatenate([[False], digit[:-1]]))
        run = np.searchsorted(first, last, "right") - 1
        return np.unique(first[run[run >= 0]])

    return starts


def _fixed(digits: tuple[int, ...], signs: dict[int, str] = {}) -> Callable[[Texts], np.ndarray]:
    """Where digits and signs stand at these distances, as in every match."""

    def starts(t: Texts) -> np.ndarray:
        n = len(t.codes) - 16
        found = t.digit[:n].copy()
        for i in digits:
            found &= t.digit[i : n + i]
        for i, c in signs.items():
            found &= t.codes[i : n + i] == ord(c)
        return np.flatnonzero(found)

    return starts


def _doubled(t: Texts) -> np.ndarray:
    at = np.flatnonzero(t.codes[:-1] == t.codes[1:])
    return at[np.isin(t.codes[at], [ord(c) for c in ".,;:!?"])]


def _spaced(t: Texts) -> np.ndarray:
    sign = np.flatnonzero(t.space[:-1] & np.isin(t.codes[1:], [ord(c) for c in ".,;:!?"]))
    first = np.flatnonzero(t.space & ~np.concatenate([[False], t.space[:-1]]))
    return first[np.searchsorted(first, sign, "right") - 1]


def _names(pattern: str) -> Callable[[Texts], np.ndarray] | None:
    """Where two capitals stand that one of (A|B) begins with; None for other patterns."""
    names = re.match(r"\(((?:[A-Z]{2}[^|()]*\|)+[A-Z]{2}[^|()]*)\)$", pattern)
    pairs = np.unique([ord(x[0]) << 8 | ord(x[1]) for x in names[1].split("|")]) if names else []

    def starts(t: Texts) -> np.ndarray:
        n = len(t.codes) - 16
        capital = (t.codes >= 65) & (t.codes <= 90)
        at = np.flatnonzero(capital[:n] & capital[1 : n + 1])
        return at[np.isin(t.codes[at] << 8 | t.codes[at + 1], pairs)]

    return starts if names else None


#: By the beginning of a pattern, where it can match.
_WHERE = {
    r"(\d{1,2})\s+de": _dates,
    r"(\d{1,2}/": _slashes,
    r"(\d{3}[.\s]?\d{3}[.\s]?\d{3}[.\s-]?\d{2})": _fixed((1, 2, 4, 5, 8)),
    r"(\d{2}[.\s]?\d{3}[.\s]?\d{3}[/\s]?\d{4}": _fixed((1, 3, 4, 7, 11)),
    r"(\d{7}-\d{2}\.": _fixed((1, 6, 8, 9), {7: "-", 10: "."}),
}


class Search:
    """A pattern's matches in joined texts, as re.finditer would find them in each."""

    def __init__(self, patterns: list[str], ignore_case: bool, where: Callable[[Texts], Iterable[int]] | None = None):
        self.patterns = [re.compile(p.lower() if ignore_case else p) for p in patterns]
        self.ignore_case, self.where = ignore_case, where

    def __call__(self, t: Texts) -> list[re.Match]:
        text = t.low if self.ignore_case else t.text
        if self.where is None:
            found = [m for p in self.patterns for m in p.finditer(text)]
            if len(self.patterns) > 1:
                found.sort(key=re.Match.start)
            return found
        found, end = [], 0
        at, match = self.where(t), self.patterns[0].match
        for i in at.tolist() if isinstance(at, np.ndarray) else at:
            if i >= end and (m := match(text, i)):
                found.append(m)
                end = m.end()
        return found


def _letters(beginning: str) -> Callable[[Texts], list[int]]:
    search = re.compile(re.escape(beginning)).finditer
    return lambda t: [m.start() for m in search(t.low)]


def _search(pattern: str, ignore_case: bool, borders: bool, render: Callable[[str], str] = str, word: str = r"\w", ascii_digits: bool = False) -> Search:
    from acervo.operators.entities import _beginning

    if not ignore_case and borders and (names := _names(pattern)):
        return Search([_bordered(render(pattern), word)], False, names)
    if parts := _alternatives(pattern):
        return Search([f"({_bordered(render(a), word)}){render(rest)}" if borders else f"({a}){render(rest)}" for a, rest in parts], ignore_case)
    where = next((w for p, w in _WHERE.items() if pattern.startswith(p)), None)
    if pattern.startswith(r"(\d+)\s+(dias?|"):
        where = _terms(ascii_digits)
    elif not where and pattern.startswith("[") and not ignore_case:
        where = _letters(_beginning(pattern))
    return Search([_bordered(render(pattern), word) if borders else render(pattern)], ignore_case, where)


class Found:
    """Rows of matches: where (start and end in the joined texts), of which search, and the matches themselves."""

    def __init__(self, t: Texts):
        self.t, self.places, self.numbers, self.positions = t, [], [], []

    def add(self, number: int, starts: list[int], ends: list[int]) -> None:
        ini, fim = np.array(starts, np.int64), np.array(ends, np.int64)
        holder = self.t.holders(ini)
        self.places.append((holder, ini - self.t.starts[holder], fim - self.t.starts[holder]))
        self.numbers.append(np.full(len(ini), number))
        self.positions.append(np.arange(len(ini)) - np.searchsorted(holder, holder))

    def add_first(self, number: int, rows: list[tuple[int, int, str]]) -> None:
        """One row a text: (text, start, term)."""
        self.places.append(tuple(np.array(x, np.int64) for x in zip(*((h, i, i + len(term)) for h, i, term in rows))))
        self.numbers.append(np.full(len(rows), number))
        self.positions.append(np.zeros(len(rows), np.int64))

    def sorted(self, by_place: bool = True) -> tuple[np.ndarray, ...]:
        """The order of rows by text, start (if by_place), search and match; and, in this order, text, start, end, search and match."""
        if not self.places:
            return (np.zeros(0, np.int64),) * 6
        holder, ini, fim = (np.concatenate(x) for x in zip(*self.places))
        number, pos = np.concatenate(self.numbers), np.concatenate(self.positions)
        # rows of one search are in order as they are, and searches come in order
        order = np.lexsort((ini, holder) if by_place else (holder,))
        return (order, *(x[order] for x in (holder, ini, fim, number, pos)))


def _first_terms(t: Texts, themes: dict[str, list[str]]) -> Iterator[list[tuple[int, int, str]]]:
    """For each theme (text, start, term): the first term of its list that a text has, where that first occurs."""
    low, starts = t.lowered()
    begin = starts.tolist()
    for terms in themes.values():
        met: dict[int, tuple[int, str]] = {}
        for term in terms:
            at = low.find(term)
            while at >= 0:
                h = bisect_right(begin, at) - 1
                met.setdefault(h, (at - begin[h], term))
                at = low.find(term, begin[h + 1])
        yield [(h, *met[h]) for h in sorted(met)]


def _dictionary(values: list, of: np.ndarray, kind: pa.DataType = _TEXT) -> pa.Array:
    """values[of]."""
    return pa.array(values, kind).take(pa.array(of))


# --- entities --------------------------------------------------------------------------------------------------
def _masked(value: str, kind: str) -> str:
    digits = re.sub(r"\D", "", value)
    if kind == "cpf" and len(digits) == 11:
        return f"***.***.{digits[6:9]}-**"
    if kind == "cnpj" and len(digits) == 14:
        return f"**.***.***/{digits[8:12]}-**"
    return "***MASCARADO***"


@cache
def _entity_patterns(kinds: tuple[str, ...] | None) -> list[tuple[int, str, str, Search, int]]:
    from acervo.operators.entities import _beginning

    out = []
    for number, (kind, pattern, ignore, borders) in enumerate(lx.ENTITY_PATTERNS):
        if not kinds or kind in kinds:
            out.append((number, kind, _beginning(pattern), _search(pattern, ignore, borders), 1 if "(" in pattern.replace("(?:", "") else 0))
    return out


def _places(matches: list[re.Match]) -> tuple[list[int], list[int]]:
    return [m.start() for m in matches], [m.end() for m in matches]


def _strings(text: str, matches: list[re.Match], group: int, starts: list[int], ends: list[int]) -> tuple[list[str], list[str]]:
    """Values (the group where it is set, else the match) and matched texts."""
    wholes = [text[a:b] for a, b in zip(starts, ends)]
    if not group:
        return wholes, wholes
    return [text[a:b] if a < b else whole for (a, b), whole in zip([m.span(1) for m in matches], wholes)], wholes


def entities(text: Column, masked: bool = True, kinds: tuple[str, ...] | None = None) -> Column:
    """As entities.entities, for a column of texts."""
    kinds = tuple(kinds) if kinds else None

    def of(t: Texts) -> Rows:
        found, values, wholes = Found(t), [], []
        for number, kind, start, search, group in _entity_patterns(kinds):
            if start in t.low and (matches := search(t)):
                value, whole = _strings(t.text, matches, group, *(places := _places(matches)))
                found.add(number, *places)
                values += [_masked(v, kind) for v in value] if masked and kind in ("cpf", "cnpj") else value
                wholes += whole
        names, areas = _entity_names(), [None] * len(lx.ENTITY_PATTERNS) + list(lx.THEMES)
        if not kinds or "tema_juridico" in kinds:
            for number, rows in enumerate(_first_terms(t, lx.THEMES), len(lx.ENTITY_PATTERNS)):
                if rows:
                    found.add_first(number, rows)
                    values += [areas[number].replace("_", " ").title()] * len(rows)
                    wholes += [term for _, _, term in rows]
        order, holder, ini, fim, number, pos = found.sorted()
        stays = _first_of_each(holder, ini, fim, number, names)
        if not stays.all():
            order, holder, ini, fim, number, pos = (x[stays] for x in (order, holder, ini, fim, number, pos))
        places = [pa.array(x, _INT) for x in (ini, number, pos, fim)]
        sure = _dictionary([0.95] * len(lx.ENTITY_PATTERNS) + [0.85] * len(lx.THEMES), number, pa.float64())
        columns = [*places, _dictionary(names, number), _dictionary(values, order), _dictionary(wholes, order), sure, _dictionary(areas, number)]
        return np.bincount(holder, minlength=len(t.texts)), columns

    return column(text, ENTITY, of)


def entity_counts(text: Column) -> Column:
    """How many entities each text has: all are found, and what `entities` takes as one counts once."""

    def of(t: Texts) -> np.ndarray:
        found = Found(t)
        for number, _, start, search, _ in _entity_patterns(None):
            if start in t.low and (matches := search(t)):
                found.add(number, *_places(matches))
        for number, rows in enumerate(_first_terms(t, lx.THEMES), len(lx.ENTITY_PATTERNS)):
            if rows:
                found.add_first(number, rows)
        _, holder, ini, fim, number, _ = found.sorted()
        return np.bincount(holder[_first_of_each(holder, ini, fim, number, _entity_names())], minlength=len(t.texts))

    return amount(text, of)


@cache
def _entity_names() -> list[str]:
    """The type of each search, themes last."""
    return [kind for kind, *_ in lx.ENTITY_PATTERNS] + ["tema_juridico"] * len(lx.THEMES)


def _first_of_each(holder: np.ndarray, ini: np.ndarray, fim: np.ndarray, number: np.ndarray, names: list[str]) -> np.ndarray:
    """Which rows are the first of their text, start, end and type."""
    stays = np.ones(len(holder), bool)
    like = (holder[1:] == holder[:-1]) & (ini[1:] == ini[:-1])  # the row before
    met: set = set()
    for i in (np.flatnonzero(like) + 1).tolist():
        if i < 2 or not like[i - 2]:
            met = {(fim[i - 1], names[number[i - 1]])}
        key = (fim[i], names[number[i]])
        stays[i] = key not in met
        met.add(key)
    return stays


def kinds(docs: DataFrame) -> DataFrame:
    """The entity types that occur in docs (text), each once a task: a type is no longer searched for once it is met."""
    small_batches(docs.sparkSession)

    def run(batches):
        met = set()
        for batch in batches:
            for t in joined(batch.column(0)):
                new = []
                for _, kind, start, search, _ in _entity_patterns(None):
                    if kind not in met and start in t.low and search(t):
                        met.add(kind)
                        new.append(kind)
                if "tema_juridico" not in met:
                    low, _ = t.lowered()
                    if any(term in low for terms in lx.THEMES.values() for term in terms):
                        met.add("tema_juridico")
                        new.append("tema_juridico")
                yield pa.RecordBatch.from_arrays([pa.array(new, _TEXT)], ["tipo"])

    return docs.select("text").mapInArrow(run, "tipo string").distinct()


# --- corrections -----------------------------------------------------------------------------------------------
_SIGNS = r"([.,;:!?])"
_ZEROS = re.compile(r"^0+(?=\d)")


_ARTICLE = r"Art\.?\s*(\d+)\s"


def _article(match: str) -> str:
    number = re.match(_ARTICLE, match)[1]
    return f"Art. {number}º " if len(_ZEROS.sub("", number)) == 1 else f"Art. {number} "


@cache
def _rules(families: tuple[str, ...]):
    """order, what the folded text must have, search, suggestion (or a function of the match), explanation (or a function of the suggestion), fixed values, whether a suggestion like the match goes."""
    phrase = lambda a: Search([re.escape(a)], True)
    whole, sign = (lambda m: m), (lambda m: m[-1])
    rules = []
    for family in families:
        if family == "spelling":
            rules += [(i, a.lower(), phrase(a), b, f"Grafia correta: '{b}'", "ortografia", "erro", "ORTOGRAFIA_JURIDICA", False) for i, (a, b) in enumerate(lx.SPELLING.items())]
        elif family == "abbreviations":
            for i, (word, rest, new) in enumerate(lx.ABBREVIATIONS):
                word = word.replace("[°º]", "º")
                change = lambda m, p=re.compile(rf"(?<!\w)(?:{word})(?!\w){rest}", re.I), new=new.replace("$1", r"\1"): p.sub(new, m)
                search = Search([_bordered(word) + rest], True)
                rules.append((100 + i, re.match("[a-z]+", word)[0], search, lru_cache(4096)(change), lambda s: f"Abreviação padronizada: '{s}'", "abreviacao", "aviso", "ABREVIACAO_PADRAO", True))
        elif family == "redundancies":
            rules += [(200 + i, a.lower(), phrase(a), b, c, "redundancia", "aviso", "REDUNDANCIA", False) for i, (a, b, c) in enumerate(lx.REDUNDANCIES)]
        elif family == "style":
            rules += [(300 + i, a.lower(), Search([_bordered(re.escape(a))], True), b, c, "estilo", "info", "ESTILO_JURIDICO", False) for i, (a, b, c) in enumerate(lx.STYLE)]
        elif family == "punctuation":
            rules.append((400, "", Search([rf"\s+{_SIGNS}"], False, _spaced), sign, "Remover espaço antes da pontuação", "pontuacao", "aviso", "ESPACO_PONTUACAO", False))
            rules.append((401, "", Search([rf"{_SIGNS}\1+"], False, _doubled), sign, "Remover pontuação duplicada", "pontuacao", "erro", "DUPLICATA_PONTUACAO", False))
        elif family == "article_format":
            rules.append((500, "art", Search([_ARTICLE], False), lru_cache(4096)(_article), lambda s: f"Formatação padrão: '{s.strip()}'", "formatacao", "info", "FORMATO_ARTIGO", True))
        elif family == "latin":
            rules += [(600 + i, a.lower(), phrase(a), whole, f"Latinismo: '{a}' = {b}", "latinismo", "info", "LATINISMO", False) for i, (a, b) in enumerate(lx.LATIN.items())]
        else:
            raise KeyError(family)
    return sorted(rules, key=lambda r: r[0])


def _corrected(t: Texts, families: tuple[str, ...], severity: str | None = None) -> Iterator[tuple[int, tuple, tuple[list[int], list[int]], list[str], list[str], list[bool]]]:
    """For each rule that finds something its place in the list, the rule, starts and ends, matched texts, suggestions, and which stay."""
    for k, rule in enumerate(_rules(families)):
        _, gate, search, suggest, _, _, its, _, changed = rule
        if severity in (None, its) and gate in t.low and (matches := search(t)):
            starts, ends = _places(matches)
            wholes = [t.text[a:b] for a, b in zip(starts, ends)]
            new = [suggest] * len(wholes) if isinstance(suggest, str) else list(map(suggest, wholes))
            yield k, rule, (starts, ends), wholes, new, [not changed or a != b for a, b in zip(wholes, new)]


def corrections(text: Column, families: tuple[str, ...]) -> Column:
    """As grammar.corrections, for a column of texts."""
    families = tuple(families)

    def of(t: Texts) -> Rows:
        rules = _rules(families)
        found, wholes, news, whys, stay = Found(t), [], [], [], []
        for k, rule, places, whole, new, stays in _corrected(t, families):
            found.add(k, *places)
            why = rule[4]
            wholes += whole
            news += new
            whys += [why] * len(new) if isinstance(why, str) else list(map(why, new))
            stay += stays
        order, holder, ini, fim, number, pos = found.sorted()
        kept = np.array(stay, bool)[order]
        order, holder, ini, fim, number, pos = (x[kept] for x in (order, holder, ini, fim, number, pos))
        fixed = lambda i: _dictionary([r[i] for r in rules], number)
        places = [pa.array(ini, _INT), _dictionary([r[0] for r in rules], number, _INT), pa.array(pos, _INT), pa.array(fim, _INT)]
        columns = [*places, fixed(5), fixed(6), *(_dictionary(x, order) for x in (wholes, news, whys)), fixed(7)]
        return np.bincount(holder, minlength=len(t.texts)), columns

    return column(text, CORRECTION, of)


def corrected(text: Column, families: tuple[str, ...]) -> Column:
    """As grammar.edited with these corrections, for a column of texts."""
    families = tuple(families)

    def of(t: Texts) -> pa.Array:
        out, found, news = list(t.texts), Found(t), []
        for k, _, (starts, ends), _, new, stays in _corrected(t, families, "erro"):
            found.add(k, list(compress(starts, stays)), list(compress(ends, stays)))
            news += compress(new, stays)
        order, holder, ini, fim, _, _ = found.sorted()
        last, at, parts = -1, 0, []
        for i, h, a, b in zip(order.tolist(), holder.tolist(), ini.tolist(), fim.tolist()):
            if h != last:
                if parts:
                    out[last] = "".join(parts) + t.texts[last][at:]
                last, at, parts = h, 0, []
            parts += (t.texts[h][at:a], news[i])
            at = max(at, b)
        if parts:
            out[last] = "".join(parts) + t.texts[last][at:]
        return pa.array(out, _TEXT)

    return _evaluated(text, "string", of, _TEXT)


def correction_totals(text: Column, families: tuple[str, ...]) -> Column:
    """How many corrections of each type, of each severity and in all each text has; null is what a row does not tell apart."""
    families = tuple(families)

    def of(t: Texts) -> Rows:
        rules = _rules(families)
        sets = list(dict.fromkeys(x for r in rules for x in ((r[5], None), (None, r[6]), (None, None))))
        counts = np.zeros((len(t.texts), len(sets)), np.int64)
        for _, rule, (starts, _), _, _, stays in _corrected(t, families):
            many = np.bincount(t.holders(np.array(starts, np.int64)[np.array(stays, bool)]), minlength=len(t.texts))
            for x in ((rule[5], None), (None, rule[6]), (None, None)):
                counts[:, sets.index(x)] += many
        text, k = np.nonzero(counts)
        columns = [_dictionary([x[0] for x in sets], k), _dictionary([x[1] for x in sets], k), pa.array(counts[text, k], _LONG)]
        return np.bincount(text, minlength=len(t.texts)), columns

    return column(text, TOTAL, of)


# --- light engine ----------------------------------------------------------------------------------------------
@cache
def _client_patterns() -> list[tuple[int, str, Search, int]]:
    from acervo.operators.client import js

    python = lambda p, ignore: re.sub(r"\\x\{(\w+)\}", lambda m: f"\\u{m[1]}", js(p, ignore).removeprefix("(?iu)"))
    out = []
    for n, (kind, p, ignore) in enumerate(lx.CLIENT_PATTERNS):
        borders = p.startswith(r"\b") and p.endswith(r"\b")
        search = _search(p[2:-2] if borders else p, ignore, borders, lambda x, ignore=ignore: python(x, ignore), "[A-Za-z0-9_]", True)
        out.append((n, kind, search, search.patterns[0].groups))
    return out


def _shown(key: str) -> str:
    digits = re.sub("[^0-9]", "", key)
    return f"***.***. {digits[6:9]}-**" if len(digits) == 11 else key


def _client_rows(t: Texts) -> Rows:
    found, keys, values, wholes = Found(t), [], [], []
    for number, kind, search, group in _client_patterns():
        if matches := search(t):
            key, whole = _strings(t.text, matches, group, *(places := _places(matches)))
            found.add(number, *places)
            keys += key
            values += [_shown(k) for k in key] if kind == "cpf" else key
            wholes += whole
    names = [kind for kind, *_ in lx.CLIENT_PATTERNS] + ["tema_juridico"] * len(lx.CLIENT_THEMES)
    for number, (theme, rows) in enumerate(zip(lx.CLIENT_THEMES, _first_terms(t, lx.CLIENT_THEMES)), len(lx.CLIENT_PATTERNS)):
        if rows:
            found.add_first(number, rows)
            keys += [theme] * len(rows)
            values += [theme] * len(rows)
            wholes += [term for _, _, term in rows]
    order, holder, _, _, number, pos = found.sorted(by_place=False)
    ids: dict[tuple[str, str], int] = {}
    kind = [names[n] for n in number.tolist()]
    each = np.fromiter((ids.setdefault((n, keys[i]), len(ids)) for n, i in zip(kind, order.tolist())), np.int64, len(order))
    first = np.sort(np.unique(holder * (len(ids) + 1) + each, return_index=True)[1])
    order, holder, number, pos = (x[first] for x in (order, holder, number, pos))
    sure = _dictionary([0.95] * len(lx.CLIENT_PATTERNS) + [0.85] * len(lx.CLIENT_THEMES), number, pa.float64())
    columns = [pa.array(number, _INT), pa.array(pos, _INT), _dictionary(names, number), _dictionary(values, order), _dictionary(wholes, order), sure, _dictionary(keys, order)]
    return np.bincount(holder, minlength=len(t.texts)), columns


def client_entities(text: Column) -> Column:
    """As client.entities, for a column of texts."""
    return column(text, CLIENT_ENTITY, _client_rows)


def client_groups(text: Column) -> Column:
    """The entities of client_entities by type: structs of tipo and valores, which are structs of the entity's number and valor."""

    def of(t: Texts) -> Rows:
        counts, columns = _client_rows(t)
        kinds, values, tipos, many, order, numbers = columns[2].to_pylist(), columns[3], [], [], [], []
        groups, begin = [], 0
        for count in counts.tolist():
            one: dict[str, list[int]] = {}
            for n, kind in enumerate(kinds[begin : begin + count]):
                one.setdefault(kind, []).append(n)
            groups.append(len(one))
            for kind, its in one.items():
                tipos.append(kind)
                many.append(len(its))
                numbers += its
                order += [begin + n for n in its]
            begin += count
        rows = pa.StructArray.from_arrays([pa.array(numbers, _INT), values.take(pa.array(order, _LONG))], ["n", "valor"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.array(many, np.int64))]), _INT), rows)
        return np.array(groups, np.int64), [pa.array(tipos, _TEXT), lists]

    return column(text, CLIENT_GROUP, of)


# --- chunks and references -------------------------------------------------------------------------------------
_LEVELS = ("titulo", "capitulo", "secao", "artigo")
_SENTENCE = re.compile(r"(?<=[.;:])\s+")


@cache
def _opens() -> tuple[re.Pattern, re.Pattern]:
    """What begins a boundary line, its group the level's number; and the blanks before it."""
    return re.compile("|".join(lx.STRUCTURE[x].replace(r"\s", r"[^\S\n]") for x in _LEVELS)), re.compile(r"[^\S\n]*")


class Segments:
    """The segments of joined texts, blank ones too: text, start and end in the joined texts, level (-1 for running text), number, line."""

    def __init__(self, t: Texts):
        opens, blanks = _opens()
        begin, feeds = t.starts[:-1], np.flatnonzero(t.codes[:-16] == 10)
        lines = np.sort(np.concatenate([begin, feeds + 1]), kind="stable")
        first = lines.copy()
        sign = t.codes[lines]
        for i in np.flatnonzero(_tables()[2][sign] & (sign != 10)).tolist():
            first[i] = blanks.match(t.text, first[i]).end()
        some = np.flatnonzero(np.isin(t.codes[first], [ord(c) for c in "TCSA"]))
        found = [(i, m.lastindex - 1, m[m.lastindex]) for i, at in zip(lines[some].tolist(), first[some].tolist()) if (m := opens.match(t.text, at))]
        at, level, number = zip(*found) if found else ((), (), ())
        start = np.concatenate([begin, np.array(at, np.int64)])
        order = np.argsort(start, kind="stable")  # running text comes before a boundary in its first line
        self.start, self.level = start[order], np.concatenate([np.full(len(begin), -1), np.array(level, np.int64)])[order]
        self.number = np.array([None] * len(begin) + list(number), object)[order]
        self.holder = t.holders(self.start)
        self.end = np.append(np.maximum(self.start[:-1], self.start[1:] - 1), t.starts[-1] - 1)
        self.line = np.searchsorted(feeds, self.start) - np.searchsorted(feeds, begin)[self.holder]


def _packed(text: str, most: int, overlap: int) -> list[str]:
    out, parts, size = [], [], 0  # what the buffer is made of, a blank between
    for sentence in _SENTENCE.split(text):
        if size and size + len(sentence) > most:
            out.append(" ".join(parts))
            words = out[-1].split()
            parts = [" ".join(words[-overlap:]) if len(words) > overlap else "", sentence]
            size = len(parts[0]) + 1 + len(sentence)
        elif size:
            parts.append(sentence)
            size += 1 + len(sentence)
        else:
            parts, size = [sentence], len(sentence)
    last = " ".join(parts)
    return [*out, last] if last.strip() else out


def chunks(text: Column, most: int, overlap: int) -> Column:
    """As chunking.chunk_array without a source, for a column of texts."""

    def of(t: Texts) -> Rows:
        found = Segments(t)
        paths: dict[tuple, int] = {}
        of_segment, bodies, path_numbers, sizes, breaks = [], [], [], [], []
        path = none = (None,) * len(_LEVELS)
        for i, (a, b, level, number) in enumerate(zip(*(x.tolist() for x in (found.start, found.end, found.level, found.number)))):
            path = none if level < 0 else (*path[:level], f"{_LEVELS[level].title()} {number or 'único'}", *none[level + 1 :])
            if body := t.text[a:b].strip():
                whole = len(body) <= most
                for piece in [body] if whole else _packed(body, most, overlap):
                    of_segment.append(i)
                    bodies.append(piece.strip())
                    path_numbers.append(paths.setdefault(path, len(paths)))
                    sizes.append(len(piece))
                    breaks.append(body.count("\n") if whole else 0)
        held = np.array(of_segment, np.int64)
        line = found.line[held]
        kinds = _dictionary(["texto_livre", *_LEVELS], found.level[held] + 1)
        hierarchy = _dictionary([[x for x in p if x is not None] for p in paths], np.array(path_numbers, np.int64), pa.list_(_TEXT))
        columns = [kinds, pa.array(bodies, _TEXT), hierarchy, pa.array(sizes, _LONG), pa.array(line, _LONG), pa.array(line + np.array(breaks, np.int64), _LONG)]
        return np.bincount(found.holder[held], minlength=len(t.texts)), columns

    return column(text, CHUNK, of)


def chunk_counts(text: Column, most: int, overlap: int) -> Column:
    """How many chunks each text has: all are cut, as in `chunks`."""

    def of(t: Texts) -> np.ndarray:
        found = Segments(t)
        many = np.ones(len(found.start), np.int64)
        some = np.flatnonzero((found.level < 0) | (found.end - found.start > most))  # those that may be blank or long
        for i, a, b in zip(some.tolist(), found.start[some].tolist(), found.end[some].tolist()):
            body = t.text[a:b].strip()
            many[i] = len(_packed(body, most, overlap)) if len(body) > most else bool(body)
        return np.bincount(found.holder, many, len(t.texts)).astype(np.int64)

    return amount(text, of)


@cache
def _reference() -> re.Pattern:
    return re.compile(lx.CROSS_REFERENCE.lower().replace("[aa]", "a"))


def references(text: Column) -> Column:
    """Laws with their articles as in entities.references, an array, for a column of texts."""

    def of(t: Texts) -> Rows:
        cited: list[dict[str, dict[str, None]]] = [{} for _ in t.texts]
        found = list(_reference().finditer(t.low))
        for h, m in zip(t.holders(np.array([m.start() for m in found], np.int64)).tolist(), found):
            cited[h].setdefault(f"Lei {t.text[slice(*m.span(2))]}", {})[f"Art. {t.text[slice(*m.span(1))]}"] = None
        laws = [(law, list(articles)) for one in cited for law, articles in one.items()]
        columns = [pa.array([x[i] for x in laws], kind) for i, (_, kind) in enumerate(REFERENCE)]
        return np.fromiter(map(len, cited), np.int64, len(cited)), columns

    return column(text, REFERENCE, of)
