"""Text functions as Column expressions: tokens, stripping, quality, language, citations, sentences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.settings import Quality

#: White space as Python's str has it, in Java's regular expressions.
SPACE = r"\s\x1c-\x1f"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once a row however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(text: Column) -> Column:
    """Runs without white space, lower-cased; punctuation stays."""
    return F.filter(F.split(F.lower(text), rf"(?U)[{SPACE}]+"), lambda t: t != "")


def strip(text: Column) -> Column:
    """Without white space at both ends; trim() knows only the space."""
    return F.regexp_replace(text, rf"(?U)^[{SPACE}]+|[{SPACE}]+$", "")


def quality_flags(text: Column, limits: Quality = Quality()) -> Column:
    """no_text, sparse, many_replacement: those that hold, in this order."""
    bare = F.length(strip(text))
    odd = F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))
    flags = F.array(
        F.when(bare == 0, F.lit("no_text")),
        F.when((bare > 0) & (bare < limits.sparse_chars), F.lit("sparse")),
        F.when((F.length(text) > 0) & (odd > limits.replacement_share * F.length(text)), F.lit("many_replacement")),
    )
    return F.filter(flags, lambda f: f.isNotNull())


def ocr_route(flags: Column, image_ratio: Column, limits: Quality = Quality()) -> Column:
    """ocr, skip or reuse: what to do with a page of these flags and that share of images."""
    empty = F.array_contains(flags, "no_text") | F.array_contains(flags, "sparse")
    return (
        F.when(F.array_contains(flags, "many_replacement"), F.lit("ocr"))
        .when(empty, F.when(image_ratio >= limits.image_area, F.lit("ocr")).otherwise(F.lit("skip")))
        .otherwise(F.lit("reuse"))
    )


def image_area_ratio(boxes: Column, width: Column, height: Column) -> Column:
    """The share of a page that boxes (array of [x0, y0, x1, y1]) cover, at most 1; overlaps count twice."""
    total = F.aggregate(boxes, F.lit(0.0), lambda acc, b: acc + F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1]))
    return F.when(width * height > 0, F.least(F.lit(1.0), total / (width * height))).otherwise(F.lit(0.0))


#: Function words by language, and letters by script.
STOPWORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "that", "is", "was", "for", "on", "with", "he", "she", "it", "they", "had", "not", "but", "as", "are", "his", "her"],
    "fr": ["le", "la", "les", "de", "des", "et", "à", "a", "un", "une", "est", "que", "qui", "dans", "pour", "avec", "pas", "sur", "au", "aux", "par", "ne", "ce"],
    "de": ["der", "die", "das", "und", "in", "ein", "eine", "ist", "nicht", "mit", "sie", "er", "es", "auf", "an", "von", "zu", "dem", "den", "des", "so"],
    "es": ["el", "la", "los", "las", "de", "del", "en", "un", "una", "que", "por", "con", "para", "se", "no", "es", "y", "o", "su"],
    "it": ["il", "lo", "la", "le", "di", "e", "in", "un", "una", "che", "per", "con", "non", "su", "si", "ma", "è", "da", "del"],
    "pt": ["o", "a", "os", "as", "de", "da", "e", "em", "um", "uma", "que", "por", "com", "para", "não", "são", "ser", "se"],
    "nl": ["de", "het", "en", "een", "is", "in", "dat", "te", "voor", "met", "op", "aan", "der", "van"],
    "pl": ["i", "w", "nie", "jest", "to", "co", "jak", "się", "po", "na", "ze", "od", "dla", "tym"],
}
SCRIPTS = {
    "lat": r"A-Za-zÀ-ɏḀ-ỿ",
    "cyr": r"Ѐ-ӿ",
    "cjk": r"一-鿿぀-ヿ",
    "ar": r"؀-ۿ",
    "gr": r"Ͱ-Ͽ",
    "he": r"֐-׿",
}
LANGUAGE_CHARS = 4000
WORDS = "[a-zà-ÿ]+"


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def _first_best(scores: dict[str, Column], none: str) -> Column:
    """The name with the highest score, the first by name among equals; none if all are zero."""
    ranked = F.array_max(F.array(*(F.struct(scores[k].cast("int").alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(sorted(scores)))))
    return let(ranked, lambda r: F.when(r["n"] > 0, r["k"]).otherwise(F.lit(none)))


def language(text: Column) -> Column:
    """A script, or for Latin letters the language with most function words; other and unknown if there is none."""
    every = F.array(*map(F.lit, sorted({w for v in STOPWORDS.values() for w in v})))

    def by_words(head: Column) -> Column:
        seen = F.array_intersect(F.regexp_extract_all(F.lower(head), F.lit(f"({WORDS})"), F.lit(1)), every)
        return let(seen, lambda w: _first_best({k: F.size(F.array_intersect(w, F.array(*map(F.lit, v)))) for k, v in STOPWORDS.items()}, "other"))

    def by_script(head: Column) -> Column:
        script = _first_best({k: F.length(F.regexp_replace(head, f"[^{v}]+", "")) for k, v in SCRIPTS.items()}, "unknown")
        return let(script, lambda s: F.when(s == "lat", by_words(head)).otherwise(s))

    return let(F.substring(F.coalesce(text, F.lit("")), 1, LANGUAGE_CHARS), by_script)


def ocr_class(share: Column) -> Column:
    """Of the share of sampled pages with text."""
    return F.when(share.isNull(), "unknown").when(share >= 0.75, "native").when(share <= 0.25, "scanned").otherwise("mixed")


def sample_pages(n: Column, most: int = 16) -> Column:
    """Evenly spread page numbers, the first and the last among them."""
    k = F.least(n, F.lit(most))
    spread = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.bround(i * (n - 1) / (k - 1), 0).cast("int"))
    return F.when(n <= 0, F.array().cast("array<int>")).when(k == 1, F.array(F.lit(0))).otherwise(spread)


def citations(answer: Column) -> Column:
    """[E1]-like marks, each once, by first appearance."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[(E[0-9]{1,4})\]"), F.lit(1)))


def unknown_citations(answer: Column, known: Column) -> Column:
    return F.array_except(citations(answer), known)


def abstention(answer: Column, default: str = "evidence insufficient") -> Column:
    """The reason if the first line says ABSTAIN, else null."""
    lines = F.split(strip(answer), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085  ]")
    reason = strip(F.array_join(F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1))), lambda x: strip(x)), " "))
    return F.when(F.upper(strip(lines[0])) == "ABSTAIN", F.when(reason == "", F.lit(default)).otherwise(reason))


def verdict(answer: Column, known: Column) -> Column:
    """abstain, missing (no citation), unknown (one that isn't known) or ok."""
    return (
        F.when(abstention(answer).isNotNull(), F.lit("abstain"))
        .when(F.size(citations(answer)) == 0, F.lit("missing"))
        .when(F.size(unknown_citations(answer, known)) > 0, F.lit("unknown"))
        .otherwise(F.lit("ok"))
    )


def longest_sentence(text: Column, most: int, least: int = 40) -> Column:
    """The first of the longest sentences of at least that many characters, cut at a word; null if there is none."""
    parts = F.filter(F.transform(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), r"\. "), lambda s: strip(s)), lambda s: F.length(s) >= least)
    ranked = F.array_sort(F.transform(parts, lambda s, i: F.struct((-F.length(s)).alias("n"), i.alias("i"), s.alias("s"))))
    best = F.try_element_at(ranked, F.lit(1))["s"]
    head = F.substring(best, 1, most)
    cut = F.when(F.instr(head, " ") > 0, F.regexp_extract(head, r"(?s)^(.*) ", 1)).otherwise(head)
    return F.when(F.length(best) > most, F.concat(cut, F.lit("..."))).otherwise(best)


def longest_term(text: Column) -> Column:
    """The first of the longest words of letters only, over five characters; null if there is none."""
    words = F.filter(tokens(text), lambda t: (F.length(t) > 5) & t.rlike(r"^\p{L}+$"))
    ranked = F.array_sort(F.transform(words, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t"))))
    return F.try_element_at(ranked, F.lit(1))["t"]
