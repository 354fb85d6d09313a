"""Text functions as column expressions: tokens, folded words, stems, terms, answer normalisation, citations."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns, word lists and phrases that results depend on.
TOKEN = r"(?U)\w+(?:[-'’.]\w+)*|[^\w\s]"
WORD = r"[a-z0-9]+(?:[.,][0-9]+)*"
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing "
    "down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more "
    "most my myself no nor not now of off on once only or other our ours ourselves out over own same she should so some such than that the their theirs "
    "them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with "
    "would you your yours yourself yourselves s t don shall may might must also per via"
).split()
ABSTENTIONS = ("i don't know", "i do not know", "not enough information", "do not contain the answer", "does not contain the answer", "don't contain the answer", "no information about", "not mentioned in the provided", "cannot be determined from the provided")
CITATION = r"(?i)\[\s*(S\d+(?:\s*[,;]\s*S?\d+)*)\s*\]"
INJECTIONS = {
    "ignore_instructions": r"(?i)\b(ignore|disregard|forget|override)\b[^.\n]{0,40}\b(previous|prior|above|earlier|all|any|your|the)\b[^.\n]{0,25}\b(instructions?|rules|prompts?|directions|guidelines)\b",
    "role_override": r"(?i)\byou are now\b|\bact as (an?|the) \w+|\bpretend (to be|you are)\b",
    "system_prompt": r"(?i)\b(system prompt|developer message|hidden instructions?)\b",
    "ai_directive": r"(?i)\b(note|message|instructions?)\s+(to|for)\s+(any\s+)?(ai|llms?|language models?|(ai\s+)?assistants?|chatbots?)\b|\b(ai|llm)\s+(assistants?|models?|systems?)\s+(reading|processing|summari[sz]ing)\s+this\b",
    "special_tokens": r"(?i)<\|(im_start|im_end|system|endoftext)\|>|\[/?INST\]|<<SYS>>",
    "exfiltration": r"(?i)\b(reveal|print|output|leak|send)\b[^.\n]{0,30}\b(api key|password|secret|credentials|system prompt)\b",
}


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def count_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0))


#: Characters that compatibility form may change: all but ASCII, plain Latin letters of one code point, and the signs folded by name.
COMPOSED = r"[^\x00-\x7F\u00C0-\u0130\u0134-\u013E\u0141-\u0148\u014A-\u017E\u2013\u2014\u2018\u2019\u201C\u201D\u20AC]"


@F.pandas_udf(StringType())
def _compatible(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def compatible(text: Column) -> Column:
    """Compatibility form. SQL has no normaliser: rows that may change go through Arrow batches, the others as null."""
    return F.coalesce(_compatible(F.when(F.regexp_like(text, F.lit(COMPOSED)), text)), text)


def fold(text: Column) -> Column:
    """Compatibility form in lower case, with plain dashes, quotes and the euro's name."""
    return F.lower(F.replace(F.translate(compatible(text), "–—’‘“”", "--''\"\""), F.lit("€"), F.lit(" eur ")))


def words(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(WORD), F.lit(0))


def stem(word: Column) -> Column:
    """A light suffix stripper."""
    n = F.length(word)
    ends, cut = (lambda s: word.endswith(s)), (lambda k: F.substring(word, F.lit(1), n - k))
    first = (
        F.when(ends("ies") & (n >= 5), F.concat(cut(3), F.lit("y"))).when(ends("sses") & (n >= 6), cut(2)).when(ends("ing") & (n >= 6), cut(3)).when(ends("edly") & (n >= 7), cut(4))
        .when(ends("ed") & (n >= 5), cut(2)).when(ends("es") & (n >= 6), cut(2)).when(ends("s") & (n >= 4) & ~(ends("ss") | ends("us") | ends("is")), cut(1)).otherwise(word)
    )
    last = lambda w: F.when((F.length(w) >= 5) & w.endswith("e"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)
    return F.when((n <= 3) | word.substr(1, 1).between("0", "9"), word).otherwise(F.element_at(F.transform(F.array(first), last), 1))


def content_words(text: Column) -> Column:
    return F.filter(words(text), lambda w: ~w.isin(*STOP_WORDS))


def terms(text: Column) -> Column:
    """Stemmed content words: what lexical retrieval and coverage are about."""
    return F.transform(content_words(text), stem)


def normalized_answer(text: Column) -> Column:
    joined = F.regexp_replace(fold(text), r"(?U)(?<=\d)[.,](?=\d)", "")
    plain = F.regexp_replace(joined, r"[!-/:-@\[-`{-~]", " ")
    return squeezed(F.regexp_replace(plain, r"(?U)\b(a|an|the)\b", " "))


def trimmed(text: Column) -> Column:
    """Without white space of any kind at the edges."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeezed(text: Column) -> Column:
    """Trimmed, with one space for each run of white space."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def numbers(text: Column) -> Column:
    """The different words with a digit, without the commas between digits."""
    plain = lambda w: F.regexp_replace(w, r"(?<=\d),(?=\d)", "")
    return F.array_distinct(F.transform(F.filter(words(text), lambda w: F.regexp_like(w, F.lit("[0-9]"))), plain))


def occurs_twice(text: Column, part: Column) -> Column:
    """Whether a part is in a text at two places or more (that may overlap)."""
    first = F.instr(text, part)
    return (first > 0) & (F.call_function("locate", part, text, first + 1) > 0)


def citations(text: Column) -> Column:
    """Labels S1, S2, ... in order of first mention."""
    groups = F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))
    numbers = F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(r"\d+"), F.lit(0))))
    return F.array_distinct(F.transform(numbers, lambda n: F.concat(F.lit("S"), n)))


def without_citations(text: Column) -> Column:
    return trimmed(F.regexp_replace(F.regexp_replace(text, CITATION, ""), r"(?U)\s+([.,;:!?])", "$1"))


def is_abstention(text: Column) -> Column:
    said = lambda t: (trimmed(t) == "") | F.exists(F.array(*map(F.lit, ABSTENTIONS)), lambda p: F.contains(F.left(t, F.lit(200)), p))
    return F.element_at(F.transform(F.array(fold(text)), said), 1)


def injections(text: Column) -> Column:
    """Names of the injection patterns that a text shows."""
    return F.array_compact(F.array(*[F.when(F.regexp_like(text, F.lit(p.replace("(?i)", "(?iuU)", 1))), F.lit(k)) for k, p in INJECTIONS.items()]))


def slug(value: Column) -> Column:
    base = F.regexp_replace(value, r"\.[A-Za-z0-9]+$", "")
    out = F.lower(F.regexp_replace(F.regexp_replace(base, r"[^A-Za-z0-9]+", "-"), r"^-+|-+$", ""))
    return F.when(out == "", F.lit("document")).otherwise(out)


def title_of(name: Column) -> Column:
    """A file's name as a title: its stem with spaces for dashes, each word capitalised; Untitled if nothing is left."""
    stem = F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    said = F.initcap(F.trim(F.regexp_replace(stem, r"[-_]+", " ")))
    return F.when(said == "", F.lit("Untitled")).otherwise(said)


def passage_numbers(said: Column, n: Column) -> Column:
    """An order of 1 .. n from a model's words: the numbers named, in range, first mention first, then those left out."""
    named = F.filter(F.transform(F.regexp_extract_all(said, F.lit(r"\d+"), F.lit(0)), lambda x: F.try_to_number(F.right(F.concat(F.lit("00000000"), x), F.lit(9)), F.lit("999999999")).cast("int")), lambda x: (x >= 1) & (x <= n))
    return F.when(n < 1, F.array().cast("array<int>")).otherwise(F.array_distinct(F.concat(named, F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")))))


def rewrites(said: Column, question: Column, most: int) -> Column:
    """A model's rewritten questions, a line each: without bullets and numbers, different from one another and from the question in any case, at most ``most``."""
    bare = F.transform(F.split(said, "\n"), lambda x: trimmed(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])?\s*", "")))
    new = F.filter(F.array_distinct(bare), lambda x: (x != "") & (F.lower(x) != F.lower(trimmed(question))))
    return F.slice(new, F.lit(1), F.lit(most))


def first_json(said: Column, schema: str) -> Column:
    """The JSON object in noisy text, from the first brace to the last; null where it can't be read."""
    return F.from_json(F.nullif(F.regexp_extract(said, r"(?s)\{.*\}", 0), F.lit("")), schema)


def cost_usd(prices, model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """Dollars for tokens by a table {model: (in, out) for a million}; an unknown model costs nothing."""
    rate = lambda i: F.coalesce(*[F.when(model == m, F.lit(float(p[i]))) for m, p in prices.items()], F.lit(0.0))
    return (tokens_in * rate(0) + tokens_out * rate(1)) / 1_000_000
