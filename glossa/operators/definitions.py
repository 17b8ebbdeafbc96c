"""Definitions in text: found, compared with a source, and what may be done about a mismatch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions import text as t

#: Words that open a definition after its term, those that "as" may follow, words that change a meaning, and parties that count as such.
CONNECTORS = ("adalah", "ialah", "merupakan", "berarti", "didefinisikan", "diartikan")
WITH_AS = ("didefinisikan", "diartikan")
OPERATORS = ("tidak", "bukan", "tanpa", "wajib", "harus", "dapat", "boleh", "dilarang", "akan", "jika", "apabila", "kecuali", "sepanjang", "hanya", "dan", "atau")
PARTIES = r"(?i)\bpihak\s+(?:pertama|kedua|ketiga|keempat|kesatu|a|b)\b"


def detect(segments: DataFrame, terms: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Segments that define a known term: (segment_id, term, body, strength).

    explicit where a connector follows the term at the segment's start; retrieved where the segment only
    begins with the term. Aliases (alias, term) stand for their term. Terms meet segments by their first token.
    """
    names = terms.select(t.normalise(F.col("term")).alias("name"), "term")
    if aliases is not None:
        names = names.union(aliases.select(t.normalise(F.col("alias")), "term"))
    names = names.where("name <> ''").distinct().withColumn("head", F.element_at(t.tokens(F.col("name")), 1))
    s = segments.withColumn("n", t.normalise(F.col("text"))).withColumn("head", F.try_element_at(t.tokens(F.col("text")), F.lit(1)))
    met = s.join(names, "head").where(F.col("n").startswith(F.concat("name", F.lit(" "))))
    rest = F.trim(F.substring("n", F.length("name") + F.lit(2), F.length("n")))
    word = F.substring_index(rest, " ", 1)
    explicit = word.isin(*CONNECTORS)
    said = F.trim(F.substring(rest, F.length(word) + 2, F.length(rest)))
    said = F.when(word.isin(*WITH_AS) & said.startswith("sebagai "), F.trim(F.substring(said, F.lit(9), F.length(said)))).otherwise(said)
    body = F.when(explicit, said).otherwise(rest)
    found = met.select("segment_id", "term", "name", body.alias("body"), F.when(explicit, "explicit").otherwise("retrieved").alias("strength"))
    longest = found.groupBy("segment_id").agg(F.max_by(F.struct("term", "body", "strength"), F.struct(F.length("name"), "name")).alias("x"))
    return longest.select("segment_id", "x.*")


def content_tokens(text: Column, term: Column | None = None) -> Column:
    """Tokens of a text, without a leading `term connector` where a term is given."""
    words = t.tokens(text)
    if term is None:
        return words
    lead = t.tokens(term)
    n = F.size(lead)
    rest = F.when(F.slice(words, F.lit(1), n) == lead, F.slice(words, n + 1, F.size(words))).otherwise(words)
    cue = F.coalesce(F.get(rest, F.lit(0)).isin(*CONNECTORS), F.lit(False)) & (rest != words)
    follows = F.coalesce(F.get(rest, F.lit(0)).isin(*WITH_AS) & (F.get(rest, F.lit(1)) == "sebagai"), F.lit(False))
    return F.when(cue, F.slice(rest, F.when(follows, 3).otherwise(2), F.size(words))).otherwise(rest)


def operators(text: Column) -> Column:
    """The meaning-changing words and numbers of a text in order, then the parties it names."""
    words = F.filter(t.tokens(text), lambda w: w.isin(*OPERATORS) | w.rlike(r"\p{N}"))
    return F.concat(words, F.transform(F.regexp_extract_all(text, F.lit(PARTIES), F.lit(0)), lambda x: F.lower(x)))


def narrow_negation(a: Column, b: Column) -> Column:
    """Texts that differ by one "tidak" before "dapat" alone."""

    def spaced(x: Column) -> Column:
        return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))

    def without_one(x: Column, y: Column) -> Column:
        parts = F.split(x, r"\btidak (?=dapat\b)", -1)
        joined = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "tidak "), F.array_join(F.slice(parts, i + 1, F.size(parts)), "tidak ")))
        return (F.size(parts) > 1) & F.exists(joined, lambda z: z == y)

    x, y = spaced(a), spaced(b)
    return (x != y) & (without_one(x, y) | without_one(y, x))


def alignment(body: Column, source: Column, term: Column | None = None) -> Column:
    """match: equal content tokens in order; mismatch: a narrow negation, or other operators on otherwise equal words; review: anything else."""
    a, b = content_tokens(body, term), content_tokens(source, term)
    plain = [F.filter(x, lambda w: ~w.isin(*OPERATORS)) for x in (a, b)]
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    other = narrow_negation(body, source) | ((operators(body) != operators(source)) & (plain[0] == plain[1]))
    return F.when(empty, "review").when(a == b, "match").when(other, "mismatch").otherwise("review")


def covers(text: Column, definition: Column, share: float = 0.7, least: int = 4) -> Column:
    """Whether a text holds enough of a definition's distinct content tokens."""
    wanted = F.array_distinct(content_tokens(definition))
    return (F.size(wanted) >= least) & (F.size(F.array_intersect(wanted, t.tokens(text))) >= share * F.size(wanted))


def ambiguous_free(aliases: DataFrame) -> DataFrame:
    """(alias, term) of aliases that stand for one term only."""
    n = aliases.select(t.normalise(F.col("alias")).alias("alias"), "term").groupBy("alias").agg(F.count_distinct("term").alias("terms"), F.min("term").alias("term"))
    return n.where("terms = 1").drop("terms")


def resolution_options(assessed: DataFrame) -> DataFrame:
    """(id, option, status) for assessed definitions: id, strength, alignment, source, term_matches, narrow_negation, eligible.

    A mismatch offers the source's definition, a better term where the body belongs to another one, and rejection;
    a narrow negation offers nothing. Only eligible sources of explicit definitions are actionable.
    """
    able = assessed.where((F.col("alignment") != "match") & ~F.coalesce("narrow_negation", F.lit(False)))
    use = able.where("source is not null").select("id", F.lit("use-definition").alias("option"), "eligible", "strength")
    other = able.where("not term_matches").select("id", F.lit("replace-term").alias("option"), "eligible", "strength")
    reject = able.select("id", F.lit("reject").alias("option"), F.lit(True).alias("eligible"), "strength")
    status = F.when(F.col("option") == "reject", "informational").when(F.col("eligible") & (F.col("strength") == "explicit"), "actionable").otherwise("needs-review")
    return use.union(other).union(reject).select("id", "option", status.alias("status"))


#: Marks that an edit keeps at its end, the versions whose entries are no sources, and what is said of a source that may not be applied.
END_MARKS = ".;:!?"
LEGACY = ("legacyKamusV1", "legacyRAGExportV1")
SOURCE_MESSAGES = {
    "unverified": "Sumber ini belum ditandai sebagai sumber terverifikasi yang dapat diterapkan.",
    "notInForce": "Sumber ini tercatat tidak berlaku.",
    "unknown": "Status keberlakuan sumber belum diketahui.",
    "other": "Sumber ini belum memenuhi syarat penerapan.",
}
LEAD = r"(?is)^\s*[,;:]?\s*(?:adalah|ialah|merupakan|berarti|didefinisikan\s+sebagai|diartikan\s+sebagai)\s+(.+)$"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def source_body(source: Column, term: Column) -> Column:
    """A source's definition without a leading term (whatever its case and accents) and connector; as it is where they don't stand there."""
    whole = stripped(source)
    rest = F.substring(whole, F.length(term) + 1, F.length(whole))
    found = F.regexp_extract(rest, LEAD, 1)
    named = t.fold(F.substring(whole, F.lit(1), F.length(term))) == t.fold(term)
    return F.when(named & (found != ""), stripped(found)).otherwise(whole)


def mismatch_text(original: Column, source: Column, term: Column, alignment: Column, strength: Column) -> Column:
    """What a mismatched definition would read by its source: only for a mismatch of an explicit or implicit definition, else null.

    The original's mark at its end stays unless the source ends in one. An empty source gives none. Such a text is shown, never offered as an edit.
    """
    body, last = source_body(source, term), F.substring(stripped(original), -1, 1)
    marked = F.lit(END_MARKS).contains(last) & (last != "")
    closed = F.lit(END_MARKS).contains(F.substring(body, -1, 1))
    text = F.when(body != "", F.when(marked & ~closed, F.concat(body, last)).otherwise(body))
    return F.when((alignment == "mismatch") & strength.isin("explicit", "implicit"), text)


def source_message(verified: Column, actionable: Column, applicability: Column, version: Column) -> Column:
    """Why a source may not be applied; null for an eligible one: verified, actionable, in force and of no legacy version. Nulls are not."""
    fine = F.coalesce(verified & actionable, F.lit(False))
    state = F.coalesce(applicability, F.lit("unknown"))
    why = F.when(~fine, SOURCE_MESSAGES["unverified"]).when(state == "notInForce", SOURCE_MESSAGES["notInForce"]).when(state != "inForce", SOURCE_MESSAGES["unknown"])
    return why.when(F.coalesce(version.isin(*LEGACY), F.lit(False)), SOURCE_MESSAGES["other"])
