"""Sources and sinks: tables of the driver are written in each format, read back and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import text as t
from glossa.operators.serving import review_errors
from glossa.plans.registry import query
from glossa.session import Scratch, table
from glossa.sources import tables as s

PART = "p_partkey long, p_name string, p_size int"


@query("SELECT p_partkey, p_name, p_size FROM part")
def jsonl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines with blank lines between them, by a declared schema."""
    at = Scratch(spark, "jsonl").path("part")
    lines = table(spark, sf_dir, "part").select(F.explode(F.array(F.to_json(F.struct("p_partkey", "p_name", "p_size")), F.lit(""))).alias("value"))
    lines.write.mode("overwrite").text(at)
    return s.read_jsonl(spark, at, PART)


@query("SELECT n_nationkey, n_name FROM nation")
def json_array_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = Scratch(spark, "array").path("nation")
    rows = table(spark, sf_dir, "nation").select(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("value"))  # 25 rows, as many as there are nations
    rows.write.mode("overwrite").text(at)
    return s.read_json_array(spark, at, "n_nationkey int, n_name string")


@query("""
SELECT p_partkey::VARCHAR AS id, 'a "' || p_name || '",' || chr(10) || 'b' AS term, CASE WHEN p_size % 4 = 0 THEN 'verified' ELSE 'legacy' END AS authority FROM part WHERE p_size % 4 <> 3
""")
def glossary_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A glossary CSV with doubled quotes, commas and line breaks in fields; unknown states are dropped."""
    at = Scratch(spark, "csv").path("glossary")
    n = F.col("p_size") % 4
    status = F.when(n == 0, "verified").when(n == 1, "OK").when(n == 3, "draft").otherwise("")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ID"), F.concat(F.lit('a "'), "p_name", F.lit('",\nb')).alias("Term"), status.alias("Status"))
    rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", True).csv(at)
    return s.read_glossary_csv(spark, at).select("id", "term", "authority")


@query("SELECT vec_id, true AS close, len(embedding) AS n FROM embeddings")
def half_float_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written in half precision and read back are within a 1024th of the originals."""
    scratch = Scratch(spark, "half")
    e = table(spark, sf_dir, "embeddings")
    s.write_half_floats(e, scratch.path("matrix"), "vec_id", "embedding")
    back = spark.read.parquet(scratch.path("matrix")).select("vec_id", F.col("embedding").alias("v"))
    near = F.forall(F.zip_with("embedding", "v", lambda a, b: F.abs(a - b) <= F.abs(a) / 1024 + 1e-6), lambda x: x)
    return e.join(back, "vec_id").select("vec_id", near.alias("close"), F.size("v").cast("long").alias("n"))


@query("SELECT p_partkey, p_name, p_size FROM part")
def json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted JSON lines with fields in the order of their names, twice over the same folder."""
    at = Scratch(spark, "sink").path("part")
    part = table(spark, sf_dir, "part").select("p_size", "p_partkey", "p_name")
    s.write_json(part.limit(1), at, "p_partkey")
    s.write_json(part, at, "p_partkey")
    return s.read_jsonl(spark, at, PART)


@query("SELECT * FROM (VALUES ('same', ''), ('schema', 'schema version 1 is not 2'), ('rows', 'nation has 0 rows, not 25'), ('parameters', 'rrf_k is 60, not 61')) AS x(\"case\", wrong)")
def manifest_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a manifest says of a pack that fits, of another schema, of other rows, and of another parameter."""
    pack = {"nation": table(spark, sf_dir, "nation"), "region": table(spark, sf_dir, "region")}
    told = s.manifest(pack, 1)
    cases = [
        ("same", s.check_manifest(told, pack, 1)),
        ("schema", s.check_manifest(told, pack, 2)),
        ("rows", s.check_manifest(told, pack | {"nation": pack["nation"].limit(0)}, 1)),
        ("parameters", s.check_parameters({"rrf_k": 60, "dimension": 384}, {"rrf_k": 61, "dimension": 384})),
    ]
    return spark.createDataFrame([(k, "; ".join(v)) for k, v in cases], "case string, wrong string")


@query("""
SELECT * FROM (VALUES ('combined', 'combined_definitions', 'combined_regulations'), ('combined-deduplicated', 'combined_definitions_deduplicated', 'combined_regulations'), ('dictionary-official', 'dictionary_official_primary', 'dictionary_regulations'),
  ('dictionary-primary', 'dictionary_primary', 'dictionary_regulations'), ('dictionary-serving', 'dictionary_primary', 'dictionary_regulations'), ('single', 'definitions', 'regulations')) AS x("view", definitions, regulations)
""")
def dataset_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of each dataset view and of the view with a second name."""
    rows = [(v, f["definitions"], f["regulations"]) for v in [*s.VIEWS, *s.ALIASES] for f in [s.view_files(v)]]
    return spark.createDataFrame(rows, "view string, definitions string, regulations string")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'changed' ELSE p_name END AS p_name FROM part WHERE p_partkey % 5 <> 0")
def workspace_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed store after changes and deletions."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    changed = part.where("p_partkey % 3 = 0").withColumn("p_name", F.lit("changed"))
    return s.upsert(spark, part, changed, part.where("p_partkey % 5 = 0"), "p_partkey")


@query("SELECT DISTINCT p_partkey AS id, 'no vector' AS problem FROM part WHERE p_partkey NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 7 <> 0) UNION ALL SELECT vec_id, 'no definition' FROM embeddings WHERE vec_id % 7 <> 0 AND vec_id NOT IN (SELECT p_partkey FROM part)")
def vector_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions without a vector and vectors without a definition."""
    e = table(spark, sf_dir, "embeddings").where("vec_id % 7 <> 0").select(F.col("vec_id").alias("id"), "embedding")
    length = table(spark, sf_dir, "embeddings").select(F.max(F.size("embedding"))).first()[0]
    return s.vector_gaps(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), e, "id", "embedding", length)


@query("SELECT 'OK' AS package, (SELECT count(*) FROM nation) AS fixtures, (SELECT count(*) FROM nation WHERE n_nationkey % 4 = 0) AS stale")
def review_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review package written, loaded and validated against its manifest, and its stale reviews."""
    scratch = Scratch(spark, "package")
    kinds = "fixture_id long, revision int, digest string"
    fixtures = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("fixture_id"), F.lit(1).alias("revision"), F.col("n_name").alias("digest"))
    reviews = fixtures.withColumn("revision", F.when(F.col("fixture_id") % 4 == 0, 2).otherwise(1))
    s.export_package(fixtures, reviews, scratch.path("package"), "fixture_id")
    f, r = s.load_package(spark, scratch.path("package"), kinds, kinds)
    stale = review_errors(r, f).where("error = 'stale'").count()
    return f.agg(F.lit("OK").alias("package"), F.count("*").alias("fixtures"), F.lit(stale).cast("long").alias("stale"))


@query("SELECT page_id, regexp_matches(html, '(?m)^#{1,6} |^[-*+] |^\\d+\\. |^```|\\*\\*[^*]+\\*\\*|\\[[^\\]]+\\]\\([^)]+\\)') AS looks FROM pages UNION ALL SELECT -p_partkey, p_size % 2 = 0 FROM part")
def markdown_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose source looks like Markdown."""
    from glossa.sources.documents import looks_like_markdown

    made = table(spark, sf_dir, "part").select((-F.col("p_partkey")).alias("page_id"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("x\n## "), "p_name")).otherwise(F.concat(F.lit("#"), "p_name")).alias("html"))
    pages = table(spark, sf_dir, "pages").select("page_id", "html").union(made)
    return pages.select("page_id", looks_like_markdown(F.col("html")).alias("looks"))


@query("SELECT 'rules' AS source, 2::BIGINT AS rules UNION ALL SELECT 'none', 1")
def rule_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule pack that is there, and the built-in rules where there is none."""
    at = Scratch(spark, "rules").path("pack")
    own = spark.createDataFrame([("a", "teh", "the", True, []), ("b", "adn", "and", True, ["band"])], s.RULE_SCHEMA)
    own.write.mode("overwrite").json(at)
    built_in = own.limit(1)
    found = s.read_rules(spark, at, built_in).agg(F.count("*").alias("rules")).select(F.lit("rules").alias("source"), "rules")
    return found.union(s.read_rules(spark, at + "/missing", built_in).agg(F.count("*")).select(F.lit("none"), "count(1)"))


@query("SELECT lang AS stage, count(*) AS n, max(n_chars) AS longest, 'quality' AS report FROM documents GROUP BY 1")
def report_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report written and read back."""
    at = Scratch(spark, "report").path("report")
    s.write_report(table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("stage")).agg(F.count("*").alias("n"), F.max("n_chars").alias("longest")), at, "quality")
    return s.read_jsonl(spark, at, "stage string, n long, longest long, report string")


@query("SELECT item_id, sha256(text) AS sha256 FROM benchmark")
def file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of each file of a folder that holds one file an item."""
    at = Scratch(spark, "digests").path("items")
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("value"))
    b.write.mode("overwrite").partitionBy("item_id").option("lineSep", "\x00").text(at)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(at)
    named = files.select(F.regexp_extract("path", r"item_id=(\d+)", 1).cast("long").alias("item_id"), F.expr("substring(content, 1, length(content) - 1)").alias("content"))
    return named.select("item_id", F.sha2("content", 256).alias("sha256"))


@query("SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS spaced FROM documents")
def space_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space collapsed, accents kept."""
    return table(spark, sf_dir, "documents").select("doc_id", t.normalise_space(F.col("text")).alias("spaced"))
