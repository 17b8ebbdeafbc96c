"""From corpus rows to what a dictionary serves: evidence, what may be acted on, primary entries, details, review packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossa.functions import text as t
from glossa.operators.corpus import first_filled

#: Verification states and link types that evidence may have, and what they mean.
ACTIONABLE_STATUSES = ("machine_exact_unreviewed", "machine_ocr_tolerant_unreviewed", "human_verified")
SERVING_STATUSES = ("machine_exact_unreviewed", "human_verified")
LINK_TYPES = ("normalized_exact_text", "local_passage_ocr_tolerant")
EXACT_METHOD = "nfkc_casefold_punctuation_insensitive_substring"
IN_FORCE = "in_force"


def filled(x: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(x != "", F.lit(False))


def source_evidence() -> Column:
    """The evidence of a joined link, passage and regulation row; optional keys are null unless filled.

    Columns: the link's passage_id, reference_id, article_locator, evidence_page_start and _end, matched_definition_text,
    verification_status, evidence_id, edge_id, match_method; the passage's article_number, pdf_page_start and _end;
    the regulation's official_detail_url, official_document_url, official_title. A page 0 counts as missing.
    """

    def page(own: str, other: str) -> Column:
        return F.coalesce(F.nullif(F.col(own), F.lit(0)), F.col(other))

    optional = [F.nullif(F.col(k), F.lit("")).alias(k) for k in ("evidence_id", "edge_id", "match_method")]
    return F.struct(
        "passage_id",
        "reference_id",
        first_filled(F.col("article_number"), F.col("article_locator")).alias("article_locator"),
        page("evidence_page_start", "pdf_page_start").alias("page_start"),
        page("evidence_page_end", "pdf_page_end").alias("page_end"),
        F.coalesce("matched_definition_text", F.lit("")).alias("matched_definition_text"),
        "official_detail_url",
        "official_document_url",
        F.coalesce("official_title", F.lit("")).alias("regulation_title"),
        F.coalesce("verification_status", F.lit("")).alias("verification_status"),
        *optional,
    )


def link_of_evidence(evidence: DataFrame) -> DataFrame:
    """Serving evidence in the shape of a link; its type follows from the match method."""
    return evidence.withColumns(
        {
            "link_id": first_filled(F.col("evidence_id"), F.col("passage_id")),
            "reference_id": F.col("regulation_id"),
            "link_type": F.when(F.coalesce(F.col("match_method") == EXACT_METHOD, F.lit(False)), LINK_TYPES[0]).otherwise(LINK_TYPES[1]),
        }
    )


def is_actionable() -> Column:
    """Whether a link with its passage, regulation and document may be acted on: eleven conditions, of which any null fails.

    Columns: passage_id_found, regulation_id_found, document_id_found (keys of the joined rows, null where missing), link_type,
    verification_status, official_status_code, official_detail_url, official_document_url, download_status, requires_ocr,
    text_extraction_status, matched_definition_text, text_clean.
    """
    conditions = [
        F.col("passage_id_found").isNotNull() & F.col("regulation_id_found").isNotNull() & F.col("document_id_found").isNotNull(),
        F.col("link_type").isin(*LINK_TYPES),
        F.col("verification_status").isin(*ACTIONABLE_STATUSES),
        F.col("official_status_code") == IN_FORCE,
        filled(F.col("official_detail_url")),
        filled(F.col("official_document_url")),
        F.col("download_status") == "success",
        F.col("requires_ocr").eqNullSafe(False),
        F.col("text_extraction_status") == "success",
        filled(F.col("matched_definition_text")),
        F.coalesce(F.trim("text_clean") != "", F.lit(False)),
    ]
    out = F.lit(True)
    for c in conditions:
        out = out & F.coalesce(c, F.lit(False))
    return out


def is_serving_actionable() -> Column:
    """The stricter rule of the serving view: the primary itself is actionable, and nothing was matched in spite of bad scanning."""
    rule = F.col("primary_is_actionable").eqNullSafe(True) & F.col("official_status_code").eqNullSafe(IN_FORCE) & filled(F.col("official_detail_url")) & filled(F.col("official_document_url"))
    return rule & F.coalesce(F.col("verification_status").isin(*SERVING_STATUSES), F.lit(False))


def source_record_ids(records: Column, single: Column, own: Column) -> Column:
    """Distinct sorted ids of the source records, else the single source's id, else the row's own."""
    ids = F.array_sort(F.array_distinct(F.filter(records, lambda x: filled(x))))
    return F.when(F.coalesce(F.size(ids) > 0, F.lit(False)), ids).otherwise(F.array(first_filled(single, own)))


def links_of_definitions(definitions: DataFrame, links: DataFrame, *, keep: str = "last") -> DataFrame:
    """(record_id, link row) over each definition's exploded source ids, a link once a definition.

    definitions: record_id, source_ids. links: source_id, link_id, position, further columns. The first or
    the last row of a link counts; without one, ties would be open.
    """
    flat = definitions.select("record_id", F.posexplode("source_ids").alias("place", "source_id"))
    met = flat.join(links, "source_id")
    order = [F.col("place"), F.col("position")] if keep == "first" else [F.desc("place"), F.desc("position")]
    return met.withColumn("_n", F.row_number().over(W.partitionBy("record_id", "link_id").orderBy(*order))).where("_n = 1").drop("_n", "place")


def primary_entries(primary: DataFrame, definitions: DataFrame, regulations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Primary rows as entries, and (term_group_id, error) of what they name and nothing has.

    primary: term_group_id, available, definition_id, definition, term, reference_ids. Only available ones
    are kept, under their group's id; a missing definition is an error unless the text stands inline.
    """
    kept = primary.where(F.col("available").eqNullSafe(True))
    source = definitions.select("definition_id", F.col("term").alias("source_term"), F.col("definition").alias("source_definition"), F.lit(True).alias("found"))
    met = kept.join(source, "definition_id", "left")
    refs = kept.select("term_group_id", F.posexplode(F.coalesce("reference_ids", F.array().cast("array<string>"))).alias("place", "reference_id"))
    named = refs.join(regulations.select("reference_id", "reference_name", F.lit(True).alias("known")), "reference_id", "left")
    lacks = met.where(F.col("found").isNull() & ~filled(F.trim("definition"))).select("term_group_id", F.concat(F.lit("missing definition "), F.coalesce("definition_id", F.lit(""))).alias("error"))
    unknown = named.where("known is null").select("term_group_id", F.concat(F.lit("missing regulation "), "reference_id").alias("error"))
    listed = named.groupBy("term_group_id").agg(F.array_sort(F.collect_list(F.struct("place", "reference_id", "reference_name"))).alias("references"))
    entries = met.join(listed, "term_group_id", "left").select(
        F.col("term_group_id").alias("record_id"),
        F.coalesce(first_filled(F.col("term"), F.col("source_term")), F.lit("")).alias("term"),
        F.coalesce(first_filled(F.col("definition"), F.col("source_definition")), F.lit("")).alias("definition"),
        F.coalesce(F.transform("references", lambda x: F.struct(x["reference_id"].alias("reference_id"), x["reference_name"].alias("name"))), F.array().cast("array<struct<reference_id:string,name:string>>")).alias("references"),
    )
    return entries, lacks.union(unknown)


ACCEPTED = ("machine_exact_unreviewed", "human_verified")


def accepted_evidence(status: Column) -> Column:
    return F.coalesce(status.isin(*ACCEPTED), F.lit(False))


def dictionary_entries(concepts: DataFrame, regulations: DataFrame) -> DataFrame:
    """Serving rows of concepts (record_id, term, definition, actionable, references, evidence).

    The first actionable evidence is chosen, else the first; the reference is the chosen evidence's, else the
    first; shown texts fall from the regulation to the evidence to the reference.
    """
    chosen = F.coalesce(F.get(F.filter("evidence", lambda e: e["is_actionable"]), F.lit(0)), F.get("evidence", F.lit(0)))
    e = concepts.withColumn("e", chosen)
    e = e.withColumn("r", F.coalesce(F.get(F.filter("references", lambda r: r["reference_id"] == F.col("e.reference_id")), F.lit(0)), F.get("references", F.lit(0))))
    e = e.withColumn("reference_id", F.coalesce("e.reference_id", "r.reference_id"))
    law = regulations.select("reference_id", "reference_name", "title", "status", F.col("document_url").alias("law_url"))
    met = e.join(law, "reference_id", "left")
    status = F.coalesce(F.col("status"), F.col("r.status"), F.lit("unknown"))
    able = F.col("actionable") & (status == IN_FORCE) & F.col("e.detail_url").isNotNull() & F.col("e.document_url").isNotNull()
    verified = F.exists("evidence", lambda x: accepted_evidence(x["verification_status"]))
    return met.select(
        "record_id",
        "term",
        "definition",
        F.coalesce("reference_name", "r.name", F.lit("")).alias("regulation"),
        F.coalesce("title", "e.title", "r.title", F.lit("")).alias("regulation_title"),
        F.coalesce("e.document_url", "law_url", "r.document_url").alias("document_url"),
        "reference_id",
        F.when(verified, "verified").otherwise("legacy").alias("authority"),
        status.alias("status"),
        F.coalesce(able, F.lit(False)).alias("is_actionable"),
    )


def usable(authority: Column, actionable: Column) -> Column:
    """Evidence that a definition may be compared with."""
    return (authority == "verified") & F.coalesce(actionable, F.lit(False))


def verified_match(authority: Column, actionable: Column, status: Column) -> Column:
    return usable(authority, actionable) & (status == IN_FORCE)


def provenance_leaks(entries: DataFrame, *columns: str) -> DataFrame:
    """Rows of the official view that still tell where they were discovered: any of the columns filled."""
    def told(c: str) -> Column:
        return F.size(c) > 0 if entries.schema[c].dataType.typeName() == "array" else filled(F.col(c).cast("string"))

    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(told(c), F.lit(False))
    return entries.where(out)


def lookup(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """The rows of the asked keys, each once."""
    return rows.join(wanted.select(F.col(wanted_key).alias(key)).distinct(), key, "left_semi")


def term_pool(entries: DataFrame, term: str, order: str, longest: int = 25) -> DataFrame:
    """(key, term) of short terms without semicolons; of equal ones the last counts."""
    trimmed = entries.select(F.trim(term).alias("term"), F.col(order).alias("_o")).where((F.length("term") > 0) & (F.length("term") <= longest) & ~F.col("term").contains(";"))
    return trimmed.groupBy(F.lower("term").alias("key")).agg(F.max_by("term", "_o").alias("term"))


def alternative_references(alternatives: DataFrame) -> DataFrame:
    """Alternatives with `reference_ids`: the ordered union of their four id lists, and their authority's place in it."""
    union = F.array_distinct(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("authority_ids", "evidence_ids", "context_ids", "source_ids")]))
    attribution = F.when(F.size("authority_ids") > 0, "definition").when(F.size("evidence_ids") > 0, "evidence").when(F.size("context_ids") > 0, "context").when(F.size("source_ids") > 0, "source").otherwise("none")
    return alternatives.withColumns({"reference_ids": union, "attribution": attribution})


def rehydrate(ids: DataFrame, regulations: DataFrame, evidence: DataFrame, passages: DataFrame) -> DataFrame:
    """(record_id, place, reference_id, name, passage_id, text) of a concept's ordered reference ids; unknown regulations are left out."""
    flat = ids.select("record_id", F.posexplode("reference_ids").alias("place", "reference_id"))
    proof = evidence.groupBy("record_id", "reference_id").agg(F.min_by("passage_id", "position").alias("passage_id"))
    return (
        flat.join(regulations.select("reference_id", F.col("reference_name").alias("name")), "reference_id")
        .join(proof, ["record_id", "reference_id"], "left")
        .join(passages.select("passage_id", "text"), "passage_id", "left")
        .select("record_id", "place", "reference_id", "name", "passage_id", "text")
    )


def detail(entries: DataFrame, alternatives: DataFrame, relations: DataFrame, related: DataFrame) -> DataFrame:
    """One row a term: its definitions, alternatives, authority, state, relations of its references, and related terms.

    entries: term, entry_id, definition, authority, status, is_actionable, reference_id. alternatives: term,
    definition_id, definition. relations: relation_id, source_id, target_id. related: term, rank, other.
    """
    key = t.normalise(F.col("term"))
    own = entries.withColumn("key", key)
    state = F.when(F.max((F.col("status") == IN_FORCE).cast("int")) == 1, IN_FORCE).when(F.max((F.col("status") == "not_in_force").cast("int")) == 1, "not_in_force").otherwise("unknown")
    base = own.groupBy("key").agg(
        F.min_by("term", "entry_id").alias("term"),
        F.transform(F.array_sort(F.collect_list(F.struct("entry_id", "definition"))), lambda x: x["definition"]).alias("definitions"),
        F.when(F.max((F.col("authority") == "verified").cast("int")) == 1, "verified").otherwise("legacy").alias("authority"),
        state.alias("status"),
        F.max("is_actionable").alias("is_actionable"),
    )
    other = alternatives.withColumn("key", key).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("definition_id", "definition"))), lambda x: x["definition"]).alias("alternatives"))
    ends = relations.select("relation_id", F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("reference_id"))
    linked = own.select("key", "reference_id").distinct().join(ends, "reference_id").groupBy("key").agg(F.array_sort(F.collect_set("relation_id")).alias("relation_ids"))
    also = related.withColumn("key", key).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "other"))), lambda x: x["other"]).alias("see_also"))
    return base.join(other, "key", "left").join(linked, "key", "left").join(also, "key", "left")


def review_errors(reviews: DataFrame, fixtures: DataFrame) -> DataFrame:
    """(fixture_id, error) of reviews (fixture_id, revision, digest) against fixtures: duplicate, unknown, stale, in this order."""
    known = fixtures.select("fixture_id", F.col("revision").alias("own_revision"), F.col("digest").alias("own_digest"), F.lit(True).alias("known"))
    n = reviews.withColumn("_n", F.count("*").over(W.partitionBy("fixture_id")))
    met = n.join(known, "fixture_id", "left")
    stale = ~(F.col("revision").eqNullSafe(F.col("own_revision")) & F.col("digest").eqNullSafe(F.col("own_digest")))
    error = F.when(F.col("_n") > 1, "duplicate").when(F.col("known").isNull(), "unknown").when(stale, "stale")
    return met.withColumn("error", error).where("error is not null").select("fixture_id", "error").distinct()


def evidence_consistency(concepts: DataFrame) -> DataFrame:
    """(check, bad) over concepts (actionable, references, evidence): an actionable concept without actionable evidence, and evidence of a reference the concept doesn't name."""
    first = F.count_if(F.col("actionable") & ~F.exists("evidence", lambda e: e["is_actionable"])).alias("actionable-without-evidence")
    named = F.transform("references", lambda r: r["reference_id"])
    second = F.count_if(F.exists("evidence", lambda e: ~F.array_contains(named, e["reference_id"]))).alias("evidence-of-unnamed-reference")
    return concepts.agg(first, second).select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(f"`{c}`").alias("bad")) for c in ("actionable-without-evidence", "evidence-of-unnamed-reference")])).alias("x")).select("x.*")


def without_corpus_terms(supplement: DataFrame, corpus: DataFrame, term: str) -> DataFrame:
    """Supplemental entries whose term the corpus lacks."""
    have = corpus.select(t.normalise(F.col(term)).alias("_key")).distinct()
    return supplement.withColumn("_key", t.normalise(F.col(term))).join(have, "_key", "left_anti").drop("_key")
