"""Text functions from Column to Column. Patterns are Unicode-aware unless a definition is ASCII by itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on them.
NEGATIONS = ["not", "no", "never", "none", "nothing", "nobody", "nowhere", "neither", "nor", "cannot", "without"]
STOP_WORDS = ["a", "an", "the", "is", "are", "was", "were", "be", "been", "to", "of", "in", "on", "at", "for", "and", "or", "it", "its", "this", "that", "as", "by", "with", "from", "can", "do"]
CONNECTIVES = ["but", "or", "and", "instead", "unless", "if", "while", "although", "already", "still"]
NUMBER = r"[$€£]?[A-Za-z0-9]*\d[A-Za-z0-9.,:/-]*"
TOKENS_PER_WORD = 1.3


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def tokens_of_words(n: Column) -> Column:
    """A token estimate, rounded half to even."""
    return F.rint(n * F.lit(TOKENS_PER_WORD)).cast("int")


def approx_tokens(text: Column) -> Column:
    return tokens_of_words(word_count(text))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean(text: Column) -> Column:
    """White space collapsed to single blanks."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def sentences(text: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` and white space; empty ones are left out."""
    return F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?])\s+"), strip), lambda s: s != "")


def numbers(text: Column) -> Column:
    """The multiset of tokens with a digit, as a sorted array."""
    return F.array_sort(F.transform(F.regexp_extract_all(text, F.lit(NUMBER), 0), lambda x: F.regexp_replace(x, r"[.,:/-]+$", "")))


def numbers_match(a: Column, b: Column) -> Column:
    return numbers(a) == numbers(b)


def negations(text: Column) -> Column:
    """The negation words of a text, repeats kept."""
    low = F.replace(F.lower(text), F.lit("’"), F.lit("'"))
    return F.filter(F.regexp_extract_all(low, F.lit(r"[a-z]+(?:'[a-z]+)?"), 0), lambda w: w.isin(NEGATIONS) | w.endswith("n't"))


def negation_match(a: Column, b: Column) -> Column:
    """As many negations among the words that only one text has as among those of the other. Shared ones cancel out, so
    the texts have equally many in all."""
    return F.size(negations(a)) == F.size(negations(b))


def guard_signs(text: Column) -> Column:
    """What guards compare of a text: a digest of its numbers and how many negations it has. Taken once a row, so that pairs
    of rows carry no texts."""
    return F.struct(F.sha2(F.array_join(numbers(text), "\n"), 256).alias("numbers"), F.size(negations(text)).alias("negations"))


def content_words(text: Column) -> Column:
    """Words without stop words, or all of them where nothing else is left."""
    every = fact_words(text)
    told = F.filter(every, lambda w: ~w.isin(STOP_WORDS))
    return F.when(F.size(told) > 0, told).otherwise(every)


def fact_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9$]+"), 0)


def fact_kept(fact: Column, text: Column) -> Column:
    return F.contains(F.lower(text), F.lower(fact))


def fact_kept_loose(fact: Column, text: Column) -> Column:
    """The fact's content words occur in the text in their order, others between them."""
    return facts_kept_loose([fact], text)[0]


def facts_kept_loose(facts: list[Column], text: Column) -> Column:
    """The same of each fact, as an array. Words are taken once: what a function of words names is evaluated for each."""
    need = F.array(*(content_words(fact) for fact in facts))
    met = lambda n, words: F.aggregate(words, F.lit(0), lambda i, w: i + F.when(F.get(n, i) == w, 1).otherwise(0)) == F.size(n)
    return F.transform(F.array(fact_words(text)), lambda words: F.transform(need, lambda n: met(n, words)))[0]


def facts_in(facts: Column, text: Column) -> Column:
    return F.filter(facts, lambda f: fact_kept(f, text))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of the sets of ASCII words; 0 if either is empty."""
    x, y = (F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9]+"), 0)) for t in (a, b))
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(both / (F.size(x) + F.size(y) - both))


def ends_right(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"(?U)\s+$", "").endswith("right?")


def route_features(query: Column) -> dict[str, Column]:
    """The router's features of a query text."""
    return {
        "n_words": word_count(query),
        "n_sentences": F.regexp_count(query, F.lit("[.!?]+")),
        "n_questions": F.regexp_count(query, F.lit(r"\?")),
        "n_numbers": F.regexp_count(query, F.lit(r"(?U)\d+")),
        "n_connectives": F.regexp_count(query, F.lit(rf"(?i)\b({'|'.join(CONNECTIVES)})\b")),
        "ends_right": ends_right(query).cast("int"),
    }


def tenant_slug(tenant: Column) -> Column:
    return F.left(F.regexp_replace(F.lower(F.coalesce(F.nullif(tenant, F.lit("")), F.lit("default"))), "[^a-z0-9_]", "_"), F.lit(64))


def verdict_of(reply: Column, allowed: list[str]) -> Column:
    """The verdict in the JSON object that a reply holds, from its first ``{`` to its last ``}``; ``unparsed`` otherwise."""
    said = F.get_json_object(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "$.verdict")
    return F.when(said.isin(allowed), said).otherwise("unparsed")


def says_same(reply: Column) -> Column:
    return F.upper(strip(reply)).startswith("SAME")
