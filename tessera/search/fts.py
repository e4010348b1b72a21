"""Full-text search: documents as sorted lexemes with positions, queries as trees compiled to columns."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

TSVECTOR = "array<struct<word:string,positions:array<int>>>"
#: Limits of positions.
MOST_POSITION, MOST_POSITIONS = 16383, 256
#: Words whose stems a worker remembers, and the longest of these.
REMEMBERED, LONGEST_REMEMBERED = 65536, 64

# English words that are not indexed.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs
    themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because
    as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further
    then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don
    should now""".split()
)

_TOKEN = re.compile(
    r"(?P<url>(?:https?|ftp)://[^\s<>]+|(?:[a-z0-9-]+\.)+[a-z]{2,}/[^\s<>]*)"
    r"|(?P<email>[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+)"
    r"|(?P<num>[+-]?\d+(?:\.\d+)?(?:e[+-]?\d+)?(?![\w]))"
    r"|(?P<hyphen>[^\W_]+(?:-[^\W_]+)+)"
    r"|(?P<word>\w+)",
    re.I,
)


def tokens(text: str) -> list[tuple[str, int]]:
    """``(token, position)``; a hyphenated word comes whole and in parts."""
    out, at = [], 0
    for m in _TOKEN.finditer(text):
        at = min(at + 1, MOST_POSITION)
        out.append((m[0], at))
        if m.lastgroup == "hyphen":
            out += [(p, at) for p in m[0].split("-")]
    return out


_VOWELS = "aeiou"


def _shape(word: str) -> str:
    """c and v for each letter; y after a consonant is a vowel."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in _VOWELS or (c == "y" and i and out[i - 1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short(stem: str) -> bool:
    """Whether a stem ends in a short syllable: consonant, vowel, consonant, or is a vowel and a consonant."""
    shape = _shape(stem)
    return shape == "vc" or (shape[-3:] == "cvc" and stem[-1] not in "wxy")


# Words with stems of their own, and words that are their stems.
_IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_INVARIANT = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
# Suffixes of the second, third and fourth step of Porter's algorithm.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _longest(word: str, suffixes) -> str | None:
    return next((s for s in sorted(suffixes, key=len, reverse=True) if word.endswith(s)), None)


@lru_cache(REMEMBERED)
def porter(word: str) -> str:
    """The stem of a lower-case English word by Porter's algorithm (Porter, An algorithm for suffix stripping), with his later exceptions."""
    if word in _INVARIANT or len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    if word in _IRREGULAR:
        return _IRREGULAR[word]
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ies", "ied")):
        word = word[:-1] if len(word) == 4 else word[:-2]
    elif word.endswith("s") and not word.endswith("ss") and "v" in _shape(word[:-2]):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    elif (end := _longest(word, ("ed", "ing"))) and "v" in _shape(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short(word):
            word += "e"
    if word.endswith("y") and len(word) > 2 and _shape(word)[-2] == "c":
        word = word[:-1] + "i"
    for table in (_STEP2, _STEP3):
        if (end := _longest(word, table)) and _measure(word[: -len(end)]):
            word = word[: -len(end)] + table[end]
    if (end := _longest(word, _STEP4)) and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[: -len(end)].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def lexeme(token: str, config: str = "english") -> str | None:
    """A token as it is indexed; None for a stop word. Configurations other than English fold case only."""
    token = token.lower()
    if config != "english":
        return token
    return None if token in STOP_WORDS else (porter if len(token) <= LONGEST_REMEMBERED else porter.__wrapped__)(token)


def vector(text: str, config: str = "english", synonyms: dict[str, list[str]] | None = None, thesaurus: dict[str, list[str]] | None = None) -> list[tuple[str, list[int]]]:
    """Sorted lexemes with their positions; stop words leave gaps. Dictionaries come after: phrases first, then words."""
    found: dict[str, list[int]] = {}
    for token, at in tokens(text):
        if (word := lexeme(token, config)) is not None:
            _place(found, word, [at])
    if thesaurus:
        found = _rephrased(sorted(found.items()), thesaurus)
    for word, places in list(found.items()):
        for other in (synonyms or {}).get(word, ()):
            if (new := lexeme(other, config)) is not None:
                _place(found, new, places)
    return sorted((w, sorted(p)) for w, p in found.items())


def _place(found: dict[str, list[int]], word: str, at: list[int]) -> None:
    places = found.setdefault(word, [])
    places += [p for p in at if p not in places][: MOST_POSITIONS - len(places)]


def _rephrased(lexemes: list[tuple[str, list[int]]], thesaurus: dict[str, list[str]]) -> dict[str, list[int]]:
    """Runs of neighbours in the alphabet that make up a phrase become its canonical words, at the first one's first position."""
    words, longest = [w for w, _ in lexemes], max(len(p.split()) for p in thesaurus)
    out: dict[str, list[int]] = {}
    i = 0
    while i < len(words):
        n = next((n for n in range(min(longest, len(words) - i), 0, -1) if " ".join(words[i : i + n]) in thesaurus), 0)
        for word in thesaurus[" ".join(words[i : i + n])] if n else [words[i]]:
            _place(out, word, lexemes[i][1][:1] or [1] if n else lexemes[i][1])
        i += n or 1
    return out


def parse_dictionary(text: str) -> dict[str, list[str]]:
    """A synonym or thesaurus dictionary as written: ``phrase:word other;...``."""
    pairs = (p.split(":", 1) for p in text.split(";") if ":" in p)
    return {k.strip().lower(): v.split() for k, v in pairs}


def _of_each_text(kind: str, convert: Callable[[list[str]], pa.Array]):
    """A function of a text column by one of lists of texts, which gets the different texts of a batch."""

    @F.arrow_udf(kind)
    def column(text: pa.Array) -> pa.Array:
        found = (text.cast(pa.string()) if pa.types.is_null(text.type) else text).dictionary_encode()
        return convert(found.dictionary.to_pylist()).take(found.indices)

    return column


def _arrow(vectors: list[list[tuple[str, list[int]]]]) -> pa.Array:
    """Vectors as the arrays of a batch."""
    words, places = pa.array([w for v in vectors for w, _ in v], pa.string()), pa.array([p for v in vectors for _, p in v], pa.list_(pa.int32()))
    ends = pa.array(accumulate(map(len, vectors), initial=0), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([words, places], ["word", "positions"]))


def to_tsvector(config: str = "english", synonyms: dict[str, list[str]] | None = None, thesaurus: dict[str, list[str]] | None = None):
    """A function from a text column to its vector."""
    return _of_each_text(TSVECTOR, lambda texts: _arrow([vector(t, config, synonyms, thesaurus) for t in texts]))


def raw_tsvector():
    """A function from a text to ``text::tsvector``: lexemes as written, with positions if they are given."""
    return _of_each_text(TSVECTOR, lambda texts: _arrow([parse_tsvector(t) for t in texts]))


def raw_tsquery(text: str) -> Query | None:
    """``text::tsquery``: operands as written."""
    return to_tsquery(text, normalise=False)


def format_tsvector(tsvector: Column) -> Column:
    """A vector in text form: ``'word':1,3 'other':2``."""
    places = lambda x: F.when(F.size(x["positions"]) > 0, F.concat(F.lit(":"), F.array_join(x["positions"].cast("array<string>"), ","))).otherwise("")
    return F.array_join(F.transform(tsvector, lambda x: F.concat(F.lit("'"), F.replace(x["word"], F.lit("'"), F.lit("''")), F.lit("'"), places(x))), " ")


@dataclass(frozen=True)
class Query:
    """A lexeme, or ``!``, ``&`` or ``|`` of queries; None stands for one of stop words only."""

    op: str
    parts: tuple = ()

    def lexemes(self) -> list[str]:
        if self.op == "lexeme":
            return [self.parts[0]]
        return list(dict.fromkeys(w for p in self.parts for w in p.lexemes()))

    def nodes(self) -> int:
        return 1 if self.op == "lexeme" else 1 + sum(p.nodes() for p in self.parts)

    def __str__(self) -> str:
        if self.op == "lexeme":
            return f"'{self.parts[0]}'"
        text = [f"( {p} )" if p.op == "|" and self.op != "|" else str(p) for p in self.parts]
        return f"!{text[0]}" if self.op == "!" else f" {self.op} ".join(text)


def to_tsquery(text: str, config: str = "english", normalise: bool = True) -> Query | None:
    """Parses ``&``, ``|``, ``!`` and parentheses; operands are normalised and stop words drop out."""
    parts = re.findall(r"'(?:[^']|'')*'|[&|!()]|[^\s&|!()]+", text)
    if not parts:
        raise ValueError("syntax error in tsquery")
    at = 0

    def peek() -> str | None:
        return parts[at] if at < len(parts) else None

    def both(op: str, below):
        nonlocal at
        found = [below()]
        while peek() == op:
            at += 1
            found.append(below())
        kept = [q for q in found if q]
        return kept[0] if len(kept) == 1 else _chain(op, kept) if kept else None

    def one():
        nonlocal at
        part = peek()
        if part is None or part in "&|)":
            raise ValueError("syntax error in tsquery")
        at += 1
        if part == "!":
            inner = one()
            return inner and Query("!", (inner,))
        if part == "(":
            inner = both("|", lambda: both("&", one))
            if peek() != ")":
                raise ValueError("syntax error in tsquery")
            at += 1
            return inner
        word = part[1:-1].replace("''", "'") if part.startswith("'") else part
        if not normalise:
            return Query("lexeme", (word,))
        words = list(dict.fromkeys(w for t, _ in tokens(word) if (w := lexeme(t, config)) is not None))
        if len(words) > 1:
            raise NotImplementedError("an operand of several lexemes")
        return Query("lexeme", (words[0],)) if words else None

    out = both("|", lambda: both("&", one))
    if peek() is not None:
        raise ValueError("syntax error in tsquery")
    return out


def _chain(op: str, parts: list[Query]) -> Query:
    out = parts[0]
    for p in parts[1:]:
        out = Query(op, (out, p))
    return out


def plainto_tsquery(text: str, config: str = "english") -> Query | None:
    """All lexemes of a text."""
    words = [Query("lexeme", (w,)) for t, _ in tokens(text) if (w := lexeme(t, config)) is not None]
    return _chain("&", words) if words else None


def matches(tsvector: Column, query: Query | None) -> Column:
    """``vector @@ query``; a query of nothing matches nothing."""
    if query is None:
        return F.lit(False)
    if query.op == "lexeme":
        return F.exists(tsvector, lambda x: x["word"] == query.parts[0])
    found = [matches(tsvector, p) for p in query.parts]
    return ~found[0] if query.op == "!" else found[0] & found[1] if query.op == "&" else found[0] | found[1]


def _is(word: Column):
    return lambda x: x["word"] == word


def ts_rank(tsvector: Column, query: Query | None, weight: float = 0.1) -> Column:
    """For each lexeme of the query the weight by the squares of 1 to its number of places, added up by 1.644934, averaged."""
    words = query.lexemes() if query else []
    if not words:
        return F.lit(0.0).cast("float")
    total = F.lit(0.0)
    for w in words:
        word = F.lit(w)
        places = F.coalesce(F.size(F.try_element_at(F.filter(tsvector, _is(word)), F.lit(1))["positions"]), F.lit(0))
        squares = F.aggregate(F.sequence(F.lit(1), F.greatest(places, F.lit(1))), F.lit(0.0), lambda s, j: s + F.lit(weight) / (j * j))
        total = total + F.when(places > 0, squares / 1.644934).otherwise(0.0)
    return (total / len(words)).cast("float")


def numnode(query: Query | None) -> int:
    return query.nodes() if query else 0


def strip(tsvector: Column) -> Column:
    return F.transform(tsvector, lambda x: F.struct(x["word"].alias("word"), F.array().cast("array<int>").alias("positions")))


def length(tsvector: Column) -> Column:
    return F.size(tsvector)


def ts_headline(query: Query | None, config: str = "english", start: str = "<b>", stop: str = "</b>", most: int = 35, everything: bool = False):
    """A function from a text to the first stretch of at most ``most`` words with the most distinct lexemes of the query, marked."""
    wanted = set(query.lexemes()) if query else set()

    def one(text: str) -> str:
        words = [(m.start(), m.end(), lexeme(m[0], config)) for m in _TOKEN.finditer(text)]
        if not words:
            return text
        first, last = 0, len(words)
        if not everything and len(words) > most:
            score = [len({w for _, _, w in words[i : i + most]} & wanted) for i in range(len(words) - most + 1)]
            first = score.index(max(score))
            last = first + most
        out, at = "", 0 if first == 0 and last == len(words) else words[first][0]
        for a, b, w in words[first:last]:
            out += text[at:a] + (start + text[a:b] + stop if w in wanted else text[a:b])
            at = b
        return out + (text[at:] if last == len(words) and first == 0 else "")

    return _of_each_text("string", lambda texts: pa.array(map(one, texts), pa.string()))


def parse_tsvector(text: str) -> list[tuple[str, list[int]]]:
    """A vector as written: ``'word':1,3 other:2``."""
    found: dict[str, set[int]] = {}
    for quoted, bare, places in re.findall(r"(?:'((?:[^']|'')*)'|([^\s:']+))(?::([\d,]+))?", text):
        word = quoted.replace("''", "'") or bare
        found.setdefault(word, set()).update(int(p) for p in places.split(",") if p)
    return sorted((w, sorted(p)) for w, p in found.items())
