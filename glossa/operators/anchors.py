"""Places in text: anchors, unique ranges, blocks that hold or touch them, clause windows, protection, conflicts of edits."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossa.functions import text as t
from glossa.operators.spans import BLOCK, greedy, touched

#: Clause signatures, as patterns of a normalised text.
SIGNATURE = {
    "numbers": r"[0-9]+(?:[.,][0-9]+)*",
    "units": r"\b(?:hari kerja|hari kalender|hari|jam|menit|minggu|bulan|tahun|harian|mingguan|bulanan|tahunan|rupiah|persen)\b",
    "actors": r"\b(?:pemberi kerja|pemberi|penerima|penyedia|pelanggan|pekerja|pengguna|penasihat)\b",
    "modality": r"\b(?:wajib|harus|dapat|boleh|dilarang)\b",
    "negation": r"\b(?:tidak|bukan|tanpa)\b",
    "triggers": r"\b(?:sejak|setelah|sebelum)\b[^.;!?]*",
    "conditions": r"\b(?:kecuali|jika|apabila|sepanjang|asalkan)\b[^.;!?]*",
}
#: Texts that an edit must leave alone.
PROTECTED = (r"[“\"]([^”\"\n]+)[”\"]", r"\b[A-Z][A-Z0-9]{1,}\b", r"\b[A-Za-z0-9]+(?:[-/_][A-Za-z0-9]+)+\b")
NAMES = r"\b(?:Pihak\s+[A-Z][\w]+(?:\s+[A-Z][\w]+){0,2}|Para\s+Pihak|Borrower|Lender)\b|\b(?:PT\.?|CV\.?)\s+[A-Z][\w]+(?:\s+[A-Z][\w]+){0,4}"
#: Quotes and their ends, shortenings with a full stop, and who begins a clause of its own.
QUOTES = {"'": "'", '"': '"', "“": "”", "‘": "’", "«": "»"}
SHORT = ("pt", "cv", "no", "dr", "prof", "sdr", "jl")
CLAUSE_ACTORS = ("pihak ", "pembeli ", "penjual ", "perusahaan ")
SCOPE = r"(?i)\b(jika|apabila|kecuali|sepanjang|asalkan|hanya|tanpa)\b"
WINDOW_TOKENS, WINDOWS = 512, 16
#: The order in which edits win, by who made them and of what kind.
ORIGINS = {"deterministic": 0, "deterministicFallback": 10, "repaired": 20, "model": 21}
CATEGORIES = {"spelling": 0, "grammar": 1, "clarity": 1, "terminology": 2}


def anchor_holds(text: Column, start: Column, end: Column, original: Column, digest: Column) -> Column:
    """Whether the original, told by its place and SHA-256, still stands there."""
    at = F.substring(text, start + 1, end - start)
    return F.coalesce((start >= 0) & (end <= F.length(text)) & (at == original) & (F.sha2(original, 256) == digest), F.lit(False))


def snapshots_usable(snapshots: DataFrame, anchors: DataFrame, version: str, profile: str) -> DataFrame:
    """Snapshots (doc_id, version, profile, digest, text) that fit: version, profile, content hash, and every anchor (doc_id, start, end, original, digest)."""
    own = snapshots.where((F.col("version") == version) & (F.col("profile") == profile) & (F.col("digest") == t.content_hash(F.col("text"))))
    bad = anchors.withColumnRenamed("digest", "sha").join(own.select("doc_id", "text"), "doc_id").where(~anchor_holds(F.col("text"), F.col("start"), F.col("end"), F.col("original"), F.col("sha")))
    return own.join(bad.select("doc_id").distinct(), "doc_id", "left_anti")


def unique_range(text: str, needle: str) -> Column:
    """(start, end) of columns' only occurrence, overlapping ones counted; null if there are none or several."""
    start = F.expr(f"locate({needle}, {text})")
    again = F.expr(f"locate({needle}, {text}, locate({needle}, {text}) + 1)")
    only = (F.length(needle) > 0) & (start > 0) & (again == 0)
    return F.when(only, F.struct((start - 1).alias("start"), (start - 1 + F.length(needle)).alias("end")))


def too_wide(original: Column, replacement: Column) -> Column:
    """An edit that restates what it keeps: three fifths of the longer text are a common prefix and suffix, in texts of 32 and 20 characters or more."""
    ends = t.change_range(original, replacement)
    share = (ends["prefix"] + ends["suffix"]) / F.greatest(F.length(original), F.length(replacement))
    return (F.length(original) >= 32) & (F.length(replacement) >= 20) & (share >= 0.6)


def signature(text: Column) -> Column:
    """Families of a clause to what a normalised text holds of each, in order."""
    value = t.normalise(text)
    return F.create_map(*[x for name, pattern in SIGNATURE.items() for x in (F.lit(name), F.regexp_extract_all(value, F.lit(pattern), F.lit(0)))])


def compatible_key(text: Column) -> Column:
    """A key for equal texts: compatibility forms folded, white space collapsed, case folded. An Arrow pass, as SQL has no such form."""

    def fold(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else re.sub(r"\s+", " ", unicodedata.normalize("NFKC", v)).strip().casefold())

    return F.pandas_udf(fold, "string")(text)


def containing_block(segments: DataFrame, blocks: DataFrame) -> DataFrame:
    """Segments (doc_id, segment_id, start, end) with the first block (doc_id, block_id, start, end) that holds them whole, null if none.

    A segment that ends before it begins is held where a block begins by its start and ends from its end on.
    """
    # a block that holds a segment touches the stretch of text in which the segment begins; one that ends there too, for empty segments
    b = touched(blocks.select("doc_id", "block_id", "start", (F.col("end") + 1).alias("end"))).select("doc_id", "_block", "block_id", F.col("start").alias("b_start"), (F.col("end") - 1).alias("b_end"))
    # where the end comes first, such a block may touch any stretch from there to the start
    first_at, last_at = (F.floor(c / BLOCK) for c in (F.least("start", "end"), F.col("start")))
    at = segments.select("doc_id", "segment_id", "start", "end", F.explode(F.sequence(first_at, last_at)).alias("_block"))
    held = at.join(b, ["doc_id", "_block"]).where((F.col("start") >= F.col("b_start")) & (F.col("end") <= F.col("b_end")))
    first = held.groupBy("doc_id", "segment_id").agg(F.min_by("block_id", F.struct("b_start", "block_id")).alias("block_id"))
    return segments.join(first, ["doc_id", "segment_id"], "left")


def changed_blocks(blocks: DataFrame, ranges: DataFrame) -> DataFrame:
    """Blocks that a changed range (doc_id, r_start, r_end) overlaps; an empty range touches blocks whose ends it stands at, too."""
    empty = F.col("r_start") == F.col("r_end")
    hits = F.when(empty, (F.col("r_start") >= F.col("start")) & (F.col("r_start") <= F.col("end"))).otherwise((F.col("r_start") < F.col("end")) & (F.col("start") < F.col("r_end")))
    # both by the stretches of text that they touch, one place wider, so that ends that meet share one
    wide = touched(blocks.select("doc_id", "block_id", "start", (F.col("end") + 1).alias("end"))).withColumn("end", F.col("end") - 1)
    r = touched(ranges.select("doc_id", F.col("r_start").alias("start"), (F.col("r_end") + 1).alias("end"))).select("doc_id", "_block", F.col("start").alias("r_start"), (F.col("end") - 1).alias("r_end"))
    hit = wide.join(r, ["doc_id", "_block"]).where(hits).select("doc_id", "block_id").distinct()
    return blocks.join(hit, ["doc_id", "block_id"], "left_semi")


#: Stands in no text (a noncharacter): borders are marked with it.
MARK = "\uffff"


def _quoted_runs() -> str:
    """A pattern that parts a text into quoted runs, which may lack their end, and runs without quotes."""
    quoted = [rf"{opens}[^{closes}]*(?:{closes}|\z)" for opens, closes in QUOTES.items()]
    return "|".join([*quoted, f"[^{''.join(QUOTES)}]+"])


def _borders() -> str:
    """What ends a clause outside quotes: a semicolon or line end; a comma or closing mark before an actor, unless the mark belongs to a shortening."""
    actor = "(?=\\s+(?:" + "|".join(CLAUSE_ACTORS) + "))"
    shortened = "(?<!(?<!\\S)(?:" + "|".join(SHORT) + "))"
    return rf"(?i)([;\n]|[,!?]{actor}|{shortened}\.{actor})"


def clause_ranges(docs: DataFrame) -> DataFrame:
    """(doc_id, n, start, end) of clauses that stand alone in docs (doc_id, text); marks within quotes don't count.

    Runs of quotes are told apart, borders are marked in the other runs, and the text is split at the marks; places are
    running sums of the parts' lengths. A null or empty text has no clauses.
    """
    runs = F.regexp_extract_all("text", F.lit(_quoted_runs()), F.lit(0))
    quote = F.array(*map(F.lit, QUOTES))
    marked = F.transform(runs, lambda r: F.when(F.array_contains(quote, F.substring(r, 1, 1)), r).otherwise(F.regexp_replace(r, _borders(), f"$1{MARK}")))
    parts = F.filter(F.split(F.array_join(marked, ""), MARK), lambda x: x != "")
    flat = docs.select("doc_id", F.posexplode(parts).alias("n", "part"))
    end = F.sum(F.length("part")).over(W.partitionBy("doc_id").orderBy("n")).cast("int")
    return flat.select("doc_id", "n", (end - F.length("part")).alias("start"), end.alias("end"))


def window_clauses(units: DataFrame) -> DataFrame:
    """Clauses as `clause_ranges` of units (doc_id, text), but a unit with a condition or exception is one clause: no window may cut its scope."""
    whole = units.where(conditional(F.col("text"))).select("doc_id", F.lit(0).alias("n"), F.lit(0).alias("start"), F.length("text").alias("end"))
    return clause_ranges(units.where(~conditional(F.col("text")))).union(whole)


def pack_windows(clauses: DataFrame, tokens: int = WINDOW_TOKENS, windows: int = WINDOWS) -> DataFrame:
    """(doc_id, window, start, end, tokens) of clauses (doc_id, n, start, end, tokens) joined while they fit; `window` is null for what is left out.

    A clause over the budget is left out, and so is what comes after the last window. An ordered fold over
    each document's sizes numbers the windows: a clause opens one where it doesn't fit into the open one.
    """
    sizes = F.transform(F.array_sort(F.collect_list(F.struct("n", "tokens"))), lambda c: c["tokens"])
    rows = F.array_sort(F.collect_list(F.struct("n", "start", "end", "tokens")))
    gathered = clauses.groupBy("doc_id").agg(rows.alias("rows"), sizes.alias("sizes"))

    def step(acc: Column, size: Column) -> Column:
        over, fits = size > tokens, (acc["used"] > 0) & (acc["used"] + size <= tokens)
        opened = acc["opened"] + F.when(over | fits, 0).otherwise(1)
        used = F.when(over, 0).when(fits, acc["used"] + size).otherwise(size)
        return F.struct(opened.cast("long").alias("opened"), used.cast("long").alias("used"), F.concat(acc["held"], F.array(F.when(over, 0).otherwise(opened).cast("long"))).alias("held"))

    start = F.struct(F.lit(0).cast("long").alias("opened"), F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("held"))
    held = F.aggregate("sizes", start, step, lambda acc: acc["held"])
    flat = gathered.select("doc_id", F.explode(F.arrays_zip("rows", held.alias("held"))).alias("x")).select("doc_id", "x.held", "x.rows.*")
    # what is over the budget stands by itself
    group = F.when(F.col("held") > 0, F.col("held")).otherwise(-F.col("n") - 1)
    found = flat.groupBy("doc_id", group.alias("held")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("tokens").cast("int").alias("tokens"))
    window = F.when(F.col("held").between(1, windows), F.col("held") - 1)
    return found.select("doc_id", window.alias("window"), "start", "end", "tokens")


def conditional(text: Column) -> Column:
    """Texts with a condition or an exception, whose scope no window may cut."""
    return text.rlike(SCOPE)


def protected_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, value) that edits must leave alone: quotes, acronyms, joined identifiers, and every mention of a party or company named in the text."""
    hard, names = [re.compile(p) for p in PROTECTED], re.compile(NAMES)

    def of(text: str) -> set[tuple[int, int]]:
        found = {m.span() for p in hard for m in p.finditer(text)}
        low = text.lower()
        for name in {m[0].lower() for m in names.finditer(text)}:
            at = low.find(name)
            while at >= 0:
                found.add((at, at + len(name)))
                at = low.find(name, at + len(name))
        return found

    def run(batches):
        for rows in batches:
            flat = [(d, a, b, text[a:b]) for d, text in zip(rows["doc_id"], rows["text"]) if text for a, b in sorted(of(text))]
            yield pd.DataFrame(flat, columns=["doc_id", "start", "end", "value"])

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start int, end int, value string")


def resolve_conflicts(reviews: DataFrame) -> DataFrame:
    """Reviews (segment_id, review_id, status, origin, category, start, end) of which no two suggestions of a segment overlap.

    Who made an edit and of what kind decides, then the shorter, the earlier, the id; suggestions without a
    place go, other states stay.
    """
    group = F.coalesce(*[F.when(F.col("category") == k, v) for k, v in CATEGORIES.items()], F.lit(5))
    base = F.coalesce(*[F.when(F.col("origin") == k, v) for k, v in ORIGINS.items()], F.lit(99))
    priority = base + F.when(base < 20, group).otherwise(0)
    placed = reviews.where("status = 'suggestion' and start is not null and end is not null")
    ranked = placed.withColumn("rank", F.row_number().over(W.partitionBy("segment_id").orderBy(priority, F.col("end") - F.col("start"), "start", "review_id")))
    return reviews.where("status <> 'suggestion'").union(greedy(ranked, ["segment_id"]).select(*reviews.columns))


def survive_silence(model: DataFrame, deterministic: DataFrame) -> DataFrame:
    """The model's reviews and, where it found nothing in a segment, the deterministic ones; then conflicts are resolved."""
    silent = model.where("status = 'no-suggestion'").select("segment_id").distinct()
    kept = deterministic.join(silent, "segment_id", "left_semi")
    quiet = model.join(kept.select("segment_id").distinct(), "segment_id", "left_semi").where("status = 'no-suggestion'").select("segment_id", "review_id")
    return resolve_conflicts(model.join(quiet, ["segment_id", "review_id"], "left_anti").unionByName(kept))


def alias_in_scope(terms: DataFrame, aliases: DataFrame) -> DataFrame:
    """Terms (doc_id, pos, term) with the name they are an alias of: aliases (doc_id, alias, canonical, from_pos, to_pos) hold within their range of places."""
    a = aliases.select("doc_id", t.normalise(F.col("alias")).alias("key"), "canonical", "from_pos", "to_pos")
    met = terms.withColumn("key", t.normalise(F.col("term"))).join(a, ["doc_id", "key"]).where((F.col("pos") >= F.col("from_pos")) & (F.col("pos") < F.col("to_pos")))
    first = met.groupBy("doc_id", "pos", "term").agg(F.min("canonical").alias("canonical"))
    return terms.join(first, ["doc_id", "pos", "term"], "left")


def term_scope(terms: DataFrame, sections: DataFrame, size: DataFrame) -> DataFrame:
    """Declared terms (doc_id, term, section) with their range: the whole document for those outside sections and in sections on definitions, else their section.

    sections: doc_id, section, heading, start, end. size: doc_id, length.
    """
    general = F.col("heading").rlike(r"(?i)definisi|pengertian|ketentuan\s+umum")
    met = terms.join(sections, ["doc_id", "section"], "left").join(size, "doc_id")
    whole = F.col("start").isNull() | general
    return met.select("doc_id", "term", F.when(whole, 0).otherwise(F.col("start")).alias("from_pos"), F.when(whole, F.col("length")).otherwise(F.col("end")).alias("to_pos"))


def conflicting_elsewhere(definitions: DataFrame) -> DataFrame:
    """Definitions (doc_id, term, pos, body) that another place of the document gives another body for the same term."""
    key = definitions.select("doc_id", t.normalise(F.col("term")).alias("key"), t.normalise_marks(F.col("body")).alias("said"))
    many = key.groupBy("doc_id", "key").agg(F.count_distinct("said").alias("n")).where("n > 1").drop("n")
    return definitions.withColumn("key", t.normalise(F.col("term"))).join(many, ["doc_id", "key"], "left_semi").drop("key")


def stride_sample(blocks: DataFrame, about: int = 8, budget: int = 7000) -> DataFrame:
    """About `about` blocks of each document at even strides, in order, of which those stay that fit the budget of characters; the limits are the feature."""
    w = W.partitionBy("doc_id")
    n = blocks.withColumns({"_n": F.row_number().over(w.orderBy("pos")) - 1, "_all": F.count("*").over(w)})
    some = n.where(F.pmod(F.col("_n"), F.greatest(F.ceil(F.col("_all") / about), F.lit(1))) == 0).drop("_n", "_all")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        left, keep = budget, []
        rows = rows.sort_values("pos")
        for text in rows["text"]:
            keep.append(len(text) <= left)
            left -= len(text) if keep[-1] else 0
        return rows[keep]

    return some.groupBy("doc_id").applyInPandas(fit, some.schema)


def reuse_key(*parts: Column) -> Column:
    """One key over everything that a kept result depends on."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
