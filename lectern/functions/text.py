"""Scalar text functions as Column expressions; only letter_tokens needs Python (Arrow batches)."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words dropped from queries, folded (lower case, no accents, sigma).
QUERY_STOPWORDS = (
    # of Greek
    "ο", "η", "το", "οι", "τα", "του", "τησ", "των", "τον", "την", "τουσ", "τισ", "ενασ", "μια", "ενα", "και", "να", "με",
    "σε", "απο", "για", "στο", "στη", "στην", "στον", "στουσ", "στισ", "στα", "δεν", "οτι", "ειναι", "ηταν", "ειχε", "εχει",
    "εχουν", "τι", "πωσ", "γιατι", "ποτε", "που", "ποιοσ", "ποια", "ποιο", "ποιοι", "ποιεσ", "ποιων", "ποιον", "ποιουσ",
    # of English
    "who", "what", "when", "where", "why", "how", "which", "whom", "is", "are", "was", "were", "be", "been", "do", "does",
    "did", "the", "a", "an", "of", "in", "on", "and", "or", "to", "for", "about",
)

#: Code points whose marks the fold takes off: Latin, Greek and their extensions.
_FOLDED = ((0xC0, 0x250), (0x370, 0x400), (0x1E00, 0x2000))


@functools.cache
def _fold_table() -> tuple[str, str]:
    """Single characters and what decomposition, mark removal and composition leave of them."""
    source, target = [], []
    for lo, hi in _FOLDED:
        for code in range(lo, hi):
            char = chr(code)
            bare = "".join(c for c in unicodedata.normalize("NFD", char) if not 0x300 <= ord(c) <= 0x36F)
            bare = unicodedata.normalize("NFC", bare)
            if len(bare) == 1 and bare != char:
                source.append(char)
                target.append(bare)
    marks = "".join(map(chr, range(0x300, 0x370)))  # without a counterpart, translate() drops them
    return "".join(source) + "ς" + marks, "".join(target) + "σ"


def strip_marks(text: Column) -> Column:
    """Letters without accents; case is kept and final sigma becomes sigma.

    translate() looks up every character; texts that are all ASCII skip it.
    """
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.translate(text, *_fold_table()))


def fold(text: Column) -> Column:
    """Lower case, accents off, final sigma as sigma; one character for one in precomposed text."""
    return strip_marks(F.lower(text))


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores of the folded text; [] for null."""
    return F.coalesce(F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), F.array().cast("array<string>"))


def token_count(text: Column) -> Column:
    """Number of tokens, without making them; 0 for null."""
    return F.coalesce(F.regexp_count(fold(text), F.lit(r"[\p{L}\p{N}_]+")), F.lit(0))


def query_tokens(text: Column) -> Column:
    """Tokens of a query: a bag without stopwords, or all tokens if nothing else is left."""
    every = tokens(text)
    kept = F.filter(every, lambda t: ~t.isin(*QUERY_STOPWORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(every)


def runs_of(original: str | None, folded: str | None) -> Iterator[tuple[str, int, int, str, str]]:
    """(token, start, end, surface, before) of the letter runs of one folded text; for Python workers."""
    at, before = 0, ""
    for m in regex.finditer(r"\p{L}+", folded or ""):
        start, end = m.span()
        between = original[at:start].rstrip()
        before = between[-1] if between else before
        yield m[0], start, end, original[start:end], before
        at, before = end, original[end - 1 : end]


def letter_tokens(text: Column) -> Column:
    """array<struct<token, start, end, surface, before>> of the letter runs of the folded text.

    Offsets are 0-based and half-open; surface is the run in the original text
    (the fold is one to one in precomposed text), before the last character that
    is no blank in front of it ('' at the beginning).  Spark has no expression
    for the places of matches; an Arrow batch at a time goes through one compiled
    pattern, linear in the text.
    """

    @F.pandas_udf("array<struct<token:string,start:int,end:int,surface:string,before:string>>")
    def runs(original: pd.Series, folded: pd.Series) -> pd.Series:
        names = "token", "start", "end", "surface", "before"
        return pd.Series([[dict(zip(names, r, strict=True)) for r in runs_of(o, f)] for o, f in zip(original, folded, strict=True)])

    return runs(text, fold(text))


def words_with_letters(text: Column) -> Column:
    """Number of white-space words that hold a letter."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w.rlike(r"\p{L}")))


def slug(text: Column) -> Column:
    """Lower case; runs of anything but a-z and 0-9 become one dash; none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def unicode_slug(text: Column) -> Column:
    """As slug, keeping letters and digits of any script."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), "^-|-$", "")


def _camel_parts(label: Column) -> Column:
    return F.filter(F.split(strip_marks(label), "[^A-Za-z0-9]+"), lambda w: w != "")


def upper_camel(label: Column) -> Column:
    """Words joined, each with a capital; the rest of a word keeps its case."""
    return F.array_join(F.transform(_camel_parts(label), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "")


def lower_camel(label: Column) -> Column:
    """As upper_camel with a small first letter."""
    joined = upper_camel(label)
    return F.concat(F.lower(F.substring(joined, 1, 1)), F.substring(joined, F.lit(2), F.length(joined)))


def camel_words(name: Column) -> Column:
    """camelCase as lower-case words."""
    return F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"))


def local_name(iri: Column) -> Column:
    """What follows the last # or /."""
    return F.regexp_extract(iri, "[^#/]*$", 0)


def clip(text: Column, cap: int) -> Column:
    """Texts above cap characters are cut there, then at the last blank if there is one, and end in ' …'."""
    cut = F.substring(text, 1, cap)
    last = F.length(cut) - F.locate(" ", F.reverse(cut))  # 0-based place of the last blank
    body = F.when((F.locate(" ", cut) > 0) & (last > 0), F.substring(cut, F.lit(1), last)).otherwise(cut)
    return F.when(F.length(text) <= cap, text).otherwise(F.concat(body, F.lit(" …")))


def excerpt(text: Column) -> Column:
    return clip(text, 420)


def snippet(text: Column, start: Column, end: Column, radius: int = 90) -> Column:
    """struct<snippet, start, end> round a hit: ends snap to blanks, … where cut, offsets re-based.

    Without a hit (null start) the opening of the text, without offsets; null without text.
    """
    n = F.length(text)
    low, high = start - radius, end + radius
    before = F.substring(text, F.lit(1), low + 1)
    blank = F.when(F.locate(" ", before) > 0, F.length(before) - F.locate(" ", F.reverse(before))).otherwise(-1)
    a = F.when(low <= 0, 0).when(blank > 0, blank + 1).otherwise(low)
    after = F.locate(" ", F.substring(text, high + 1, n))  # 1-based from position high
    b = F.when(high >= n, n).when((after > 0) & (high + after - 1 > 0), high + after - 1).otherwise(high)
    prefix = F.when(a > 0, F.lit("…")).otherwise(F.lit(""))
    body = F.concat(prefix, F.substring(text, a + 1, b - a), F.when(b < n, F.lit("…")).otherwise(F.lit("")))
    hit = F.struct(body.alias("snippet"), (F.length(prefix) + start - a).alias("start"), (F.length(prefix) + end - a).alias("end"))
    two = 2 * radius
    head = F.substring(text, 1, two + 1)
    last = F.when(F.locate(" ", head) > 0, F.length(head) - F.locate(" ", F.reverse(head))).otherwise(-1)
    cut = F.when(last < radius, two).otherwise(last)
    opening = F.when(n <= two, text).otherwise(F.concat(F.rtrim(F.substring(text, F.lit(1), cut)), F.lit("…")))
    none = F.lit(None).cast("int")
    plain = F.struct(opening.alias("snippet"), none.alias("start"), none.alias("end"))
    return F.when(text.isNull() | (n == 0), None).when(start.isNull(), plain).otherwise(hit)


def short_snippet(text: Column, cap: int = 220) -> Column:
    return F.when(F.length(text) <= cap, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, cap)), F.lit("…")))


def bce_year(text: Column) -> Column:
    """struct<year, end_year> of the first '(N BCE)' or '(N/M BCE)' gloss, negative; nulls without one."""
    gloss = r"\((?:c\.\s*)?(\d{2,4})(?:[/–-](\d{2,4}))?\s*BCE\)"
    year = -F.nullif(F.regexp_extract(text, gloss, 1), F.lit("")).cast("int")
    end = -F.nullif(F.regexp_extract(text, gloss, 2), F.lit("")).cast("int")
    return F.struct(year.alias("year"), F.when(end != year, end).alias("end_year"))


def century(year: Column) -> Column:
    """Negative years round down to a century, others up."""
    return F.when(year < 0, F.floor(year / 100)).otherwise(F.ceil(year / 100)).cast("int")


def citation_refs(citation: Column, prefix: str = r"^[^0-9]*") -> Column:
    """References of a literal 'Prefix a; b; c': prefix off, split at semicolons, trimmed, empties out."""
    bare = F.regexp_replace(citation, prefix, "")
    return F.filter(F.transform(F.split(bare, ";"), lambda x: F.trim(x)), lambda x: x != "")


def dotted_refs(citation: Column) -> Column:
    """Every book.section reference in a literal, with an optional letter."""
    return F.regexp_extract_all(citation, F.lit(r"\d+\.\d+[a-z]?"), F.lit(0))


def match_form(label: Column) -> Column:
    """Label without a trailing '(?)', trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(label, r"\s*\(\?\)\s*$", "")))


def sentence_initial(text: Column, offset: Column) -> Column:
    """Whether what stands before the 0-based offset ends a sentence, or nothing does."""
    before = F.regexp_replace(F.substring(text, F.lit(1), offset), r"\s+$", "")
    return ends_sentence(F.substring(before, -1, 1))


def ends_sentence(char: Column) -> Column:
    """Whether a character ('' for none) ends a sentence."""
    return char.isin("", ".", "!", "?", ";", "—")


def edit_distance(a: Column, b: Column, most: int = 2) -> Column:
    """Edits between a and b, or -1 above the bound."""
    return F.levenshtein(a, b, most)


def shared_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    n = F.least(F.length(a), F.length(b))
    at = F.transform(F.sequence(F.lit(0), n), lambda i: F.when(F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i), i))
    return F.array_max(at)


def stem(word: Column, endings: tuple[str, ...], least: int = 4) -> Column:
    """word without its longest listed ending that leaves at least so many letters."""
    hits = [F.when(word.endswith(e) & (F.length(word) - len(e) >= least), F.lit(e)) for e in sorted(endings, key=lambda e: (-len(e), e))]
    ending = F.coalesce(*hits, F.lit(""))
    return F.substring(word, F.lit(1), F.length(word) - F.length(ending))


def declined_forms(base: Column, nominative: str, endings: tuple[str, ...]) -> Column:
    """All forms of a class: the folded stem (nominative ending off) with each ending; an error without that ending."""
    folded = fold(base)
    bare = F.substring(folded, F.lit(1), F.length(folded) - len(nominative))
    forms = F.array(*[F.concat(bare, F.lit(e)) for e in endings])
    return F.when(folded.endswith(nominative), forms).otherwise(
        F.raise_error(F.concat(F.lit("no such nominative ending: "), base)).cast("array<string>")
    )


def taggable_title(label: Column, single_words: tuple[str, ...] = ()) -> Column:
    """Titles worth looking for: 4-40 characters, a capital first, no brackets, digits or book counts."""
    single = ~label.contains(" ")
    return (
        F.length(label).between(4, 40) & label.rlike(r"^\p{Lu}") & ~label.rlike(r"[()\[\]0-9]")
        & ~F.lower(label).rlike(r"\bbooks?\b") & (~single | label.isin(*single_words) if single_words else ~single)
    )


def xml_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def turtle_escape(text: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


# Fixed value: how an answer cites a section.
CITATION = r"\[\s*D\.?L\.?\s+([0-9]+(?:\.[0-9a-zA-Z-]+)+)\s*\]"


def guarded_citations(text: Column, allowed: Column, pattern: str = CITATION) -> Column:
    """struct<text, cited, dropped>: citations whose id is not allowed are taken out of the text.

    cited holds the allowed ids in order of first use; blanks before punctuation and double blanks go.
    """
    ids = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    bad = F.filter(F.arrays_zip(ids.alias("i"), whole.alias("w")), lambda z: ~F.array_contains(allowed, z["i"]))
    clean = F.aggregate(bad, text, lambda t, z: F.replace(t, z["w"], F.lit("")))
    tidy = F.trim(F.regexp_replace(F.regexp_replace(clean, r"[ \t]+([.,;:!?])", "$1"), r"[ \t]{2,}", " "))
    return F.struct(
        tidy.alias("text"),
        F.array_distinct(F.filter(ids, lambda i: F.array_contains(allowed, i))).alias("cited"),
        F.transform(bad, lambda z: z["i"]).alias("dropped"),
    )


# Number words.
UNITS = (
    "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen",
    "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen",
)
ORDINALS = (
    "first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth",
)
TENS = ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
# How a text states an age; the first form that gives a number counts.
AGE_FORMS = (
    r"\bage of\s+(?:about\s+|nearly\s+|more than\s+)?([a-z0-9\- ,.;]+)",
    r"\baged\s+(?:about\s+|nearly\s+|more than\s+)?([a-z0-9\- ,.;]+)",
    r"\bin his\s+([a-z0-9\- ,.;]+)",
    r"^lived\s+(?:to be\s+)?(?:about\s+|nearly\s+)?([a-z0-9\- ,.;]+)",
    r"^died at\s+(?:about\s+|nearly\s+)?([a-z0-9\- ,.;]+)",
    r"^was\s+([a-z0-9\- ,.;]+)",
)


def _number_words() -> dict[str, int]:
    out = {w: i + 1 for i, w in enumerate(UNITS)} | {w: i + 1 for i, w in enumerate(ORDINALS)}
    for i, w in enumerate(TENS):
        out[w] = out[w[:-1] + "ieth"] = 10 * (i + 2)
    for i, w in enumerate(TENS):
        for j in range(1, 10):
            out[f"{w}-{UNITS[j - 1]}"] = out[f"{w}-{ORDINALS[j - 1]}"] = 10 * (i + 2) + j
    return out


def age(text: Column) -> Column:
    """The age a text states in figures or words ('aged 72', 'in his fifty-third year'); null without one."""
    table = F.create_map(*[F.lit(x) for kv in sorted(_number_words().items()) for x in kv])
    zero = lambda: F.struct(F.lit(0).alias("n"), F.lit(False).alias("any"), F.lit(False).alias("done"))

    def step(acc: Column, raw: Column) -> Column:
        word = F.regexp_replace(raw, "[.,;]+$", "")
        value = F.when(word.rlike(r"^\d{1,3}$"), word.cast("int")).otherwise(F.try_element_at(table, word))
        known = (word == "and") | (word == "hundred") | value.isNotNull()
        n = (
            F.when(word == "hundred", F.when(acc["n"] == 0, 1).otherwise(acc["n"]) * 100)
            .when(word == "and", acc["n"]).otherwise(acc["n"] + value)
        )
        more = F.struct(n.alias("n"), (acc["any"] | (word != "and")).alias("any"), raw.rlike("[.,;]$").alias("done"))
        stop = F.struct(acc["n"].alias("n"), acc["any"].alias("any"), F.lit(True).alias("done"))
        return F.when(acc["done"], acc).when(known, more).otherwise(stop)

    found = []
    for form in AGE_FORMS:
        rest = F.regexp_extract(F.lower(text), form, 1)
        end = F.aggregate(F.split(rest, r"\s+"), zero(), step)
        found.append(F.when((rest != "") & end["any"], end["n"]))
    return F.coalesce(*found)
