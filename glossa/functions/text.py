"""Scalar text functions as columns. Offsets count code points, from 0, ends exclusive."""

from __future__ import annotations

import os
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _folds() -> tuple[str, str]:
    """Letters that are one letter with marks, what is left without them, and at the end the marks themselves, which go."""
    letters, plain, marks = [], [], []
    for c in map(chr, (x for x in range(0x80, 0x30000) if not 0xD800 <= x < 0xE000)):
        if unicodedata.category(c) == "Mn":
            marks.append(c)
            continue
        rest = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if rest != c and len(rest) == 1:
            letters.append(c)
            plain.append(rest)
    return "".join(letters + marks), "".join(plain)


ACCENTED, FOLDED = _folds()

NOT_WORD = r"[^\p{L}\p{N}]+"


def fold(text: Column) -> Column:
    """Case and accents folded, character by character."""
    return F.translate(F.lower(text), ACCENTED, FOLDED)


def normalise(text: Column) -> Column:
    """Case and accents folded, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), ACCENTED, FOLDED), r"\s+", " "))


def normalise_space(text: Column) -> Column:
    """Case folded and white space collapsed; accents stay. Not the same as `normalise`."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def normalise_marks(text: Column) -> Column:
    """Case folded, runs of white space and punctuation to one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\s\p{P}]+", " "))


def normalise_content(text: Column) -> Column:
    """Line ends unified, lines trimmed on the right, the whole trimmed: the input of content hashes."""
    # each run of blanks is tried once, from its start
    lines = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"(?<![ \t])[ \t]++(?=\n|$)", "")
    return F.regexp_replace(lines, r"^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Letters-and-digits tokens of the normalised text, in order, repeats kept; white space only parts them, so it isn't collapsed first."""
    return F.filter(F.split(fold(text), NOT_WORD), lambda t: t != "")


def content_hash(text: Column) -> Column:
    return F.sha2(normalise_content(text), 256)


def stable_id(*parts: Column) -> Column:
    """24 hex digits over the parts."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24)


def strip_prefix(definition: Column, term: Column, connectors: tuple[str, ...]) -> Column:
    """A definition without a leading `term connector`, if one of the connectors follows the term."""
    out = definition
    for word in connectors:
        lead = F.concat(normalise_space(term), F.lit(f" {word} "))
        out = F.when(normalise_space(definition).startswith(lead), F.trim(F.substring(definition, F.length(lead) + 1, F.length(definition)))).otherwise(out)
    return out


def holds_sequence(inside: Column, wanted: Column) -> Column:
    """Whether token array `wanted` stands in token array `inside` without gaps."""
    def line(x: Column) -> Column:
        return F.concat(F.lit(" "), F.array_join(x, " "), F.lit(" "))

    return (F.size(wanted) > 0) & line(inside).contains(line(wanted))


def literal_bonus(term: Column, definition: Column, query: Column) -> Column:
    """1000 for the term itself, 300 for its start, 150 for a part of it; 100 more if the definition holds the query.

    All three are normalised texts.
    """
    exact = F.when(term == query, 1000.0).when(term.startswith(query), 300.0).when(term.contains(query), 150.0).otherwise(0.0)
    return exact + F.when(definition.contains(query), 100.0).otherwise(0.0)


def term_bonus(term: Column, query: Column, query_tokens: Column, term_tokens: Column) -> Column:
    """The smaller catalogue's scale, 40 more where the query holds the term's tokens in order."""
    exact = F.when(term == query, 1000.0).when(term.startswith(query), 300.0).when(term.contains(query), 150.0).otherwise(0.0)
    return exact + F.when(holds_sequence(query_tokens, term_tokens), 40.0).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit_vector(v: Column) -> Column:
    """v over its norm; as it is where the norm is at most 1e-6."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 1e-6, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def rrf(*ranks: Column, k: int = 60) -> Column:
    """Reciprocal rank fusion with the fixed constant 60; a null rank adds nothing."""
    return sum((F.coalesce(1.0 / (k + r), F.lit(0.0)) for r in ranks), F.lit(0.0))


def single_edit(a: Column, b: Column) -> Column:
    """One insertion, deletion, substitution or swap of neighbours apart (not equal)."""
    swapped = F.exists(
        F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))),
        lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))) == b,
    )
    return (a != b) & ((F.levenshtein(a, b) == 1) | ((F.length(a) == F.length(b)) & (F.length(a) > 1) & swapped))


def match_case(replacement: Column, original: Column) -> Column:
    """The replacement with an upper-case first letter where the original has one."""
    first = F.substring(original, 1, 1)
    upper = (first == F.upper(first)) & (first != F.lower(first))
    return F.when(upper, F.concat(F.upper(F.substring(replacement, 1, 1)), F.substring(replacement, F.lit(2), F.length(replacement)))).otherwise(replacement)


def occurrences(text: Column, needle: Column) -> Column:
    """Number of non-overlapping occurrences; 0 for an empty needle."""
    return F.when(F.length(needle) > 0, ((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("int")).otherwise(0)


def _ends(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    out = []
    for a, b in zip(old, new):
        if a is None or b is None:
            out.append((None, None))
            continue
        prefix = len(os.path.commonprefix((a, b)))
        most = min(len(a), len(b)) - prefix
        out.append((prefix, len(os.path.commonprefix((a[len(a) - most :][::-1], b[len(b) - most :][::-1])))))
    return pd.DataFrame(out, columns=["prefix", "suffix"]).astype("Int32")


def change_range(old: Column, new: Column) -> Column:
    """Common prefix and suffix lengths of two texts, as a struct (prefix, suffix); an Arrow pass, linear in the texts."""
    return F.pandas_udf(_ends, "prefix int, suffix int")(old, new)


#: The families of literals that a rewrite must keep, as patterns.
MARKERS = {
    "numbers": r"\d+(?:[.,]\d+)*",
    "percent": r"\d+(?:[.,]\d+)?\s?%",
    "dates": r"\b\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}\b",
    "emails": r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+",
    "acronyms": r"\b[A-Z]{2,}\b",
    "quoted": '"[^"]*"',
    "references": r"(?i)\b(?:article|section|pasal|ayat|bab) \d+\b",
}


def markers(text: Column, family: str) -> Column:
    """The sorted literals of a family in a text."""
    return F.array_sort(F.regexp_extract_all(text, F.lit(MARKERS[family]), F.lit(0)))


def lost_markers(old: Column, new: Column) -> Column:
    """Families whose literals differ between two texts."""
    return F.filter(F.array(*[F.when(markers(old, f) != markers(new, f), F.lit(f)) for f in MARKERS]), lambda x: x.isNotNull())


def masked_numbers(text: Column) -> Column:
    """The text with every number as #: its shell, for comparing parameters."""
    return F.regexp_replace(normalise_space(text), MARKERS["numbers"], "#")


def capitalised_heading(text: Column) -> Column:
    """A line of at most 120 characters with letters, none of them lower-case."""
    return (F.length(text) <= 120) & text.rlike(r"\p{L}") & (text == F.upper(text))


def heading_level(text: Column) -> Column:
    """1 for a chapter heading, 2 for an article heading, else null."""
    return F.when(text.rlike(r"(?i)^(chapter|bab|kapitel|chapitre|capítulo)\b") | capitalised_heading(text), 1).when(text.rlike(r"(?i)^(article|pasal|artikel|artículo|section)\s+\d+"), 2)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, for editors that count so."""
    return F.length(text) + F.length(F.regexp_replace(text, "[^\U00010000-\U0010ffff]", ""))


def word_context(text: Column, start: Column, end: Column, reach: int = 40) -> Column:
    """(prefix, suffix): the last word within `reach` characters before a place, and the first within as many after it, with "..." behind it; null where there is none."""
    before = F.substring(text, F.greatest(start - reach, F.lit(0)) + 1, F.least(start, F.lit(reach)))
    after = F.substring(text, end + 1, F.lit(reach))
    words = [F.filter(F.split(x, r"\s+"), lambda w: w != "") for x in (before, after)]
    inside = (start >= 0) & (end <= F.length(text))
    prefix, suffix = F.when(inside, F.try_element_at(words[0], F.lit(-1))), F.when(inside, F.concat(F.get(words[1], F.lit(0)), F.lit("...")))
    return F.struct(prefix.alias("prefix"), suffix.alias("suffix"))
