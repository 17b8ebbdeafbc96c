"""Corpus tables from and to files: declared schemas, checks, deterministic sinks, manifests."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a glossary row's review status means; other statuses are dropped.
STATUS = {"VERIFIED": "verified", "OK": "legacy", "": "legacy"}

SCHEMAS = {
    "definitions": "definition_id string, term string, definition string, source_record_ids array<string>",
    "links": "link_id string, definition_id string, passage_id string, regulation_id string, position int, verified boolean",
    "passages": "passage_id string, regulation_id string, text string, page_start int, requires_ocr boolean",
    "regulations": "regulation_id string, name string, in_force boolean, year int",
    "relations": "relation_id string, source_id string, target_id string, relation_type string",
}

#: Dataset views and the files that hold each one's definitions, regulations and relations; one view has a second name.
VIEWS = {
    "single": ("definitions", "regulations", "regulation_relations"),
    "combined": ("combined_definitions", "combined_regulations", "combined_regulation_relations"),
    "combined-deduplicated": ("combined_definitions_deduplicated", "combined_regulations", "combined_regulation_relations"),
    "dictionary-serving": ("dictionary_primary", "dictionary_regulations", "dictionary_regulation_relations"),
    "dictionary-official": ("dictionary_official_primary", "dictionary_regulations", "dictionary_regulation_relations"),
}
ALIASES = {"dictionary-primary": "dictionary-serving"}
#: Every view reads these too.
SHARED_FILES = {"links": "definition_passage_links", "passages": "regulation_passages"}


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by a declared schema; blank lines are skipped, malformed ones fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)


def read_glossary_csv(spark: SparkSession, path: str) -> DataFrame:
    """A glossary CSV with doubled quotes and line breaks in fields; header names in lower case, `authority` from status."""
    raw = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    rows = raw.toDF(*[c.removeprefix("﻿").strip().lower() for c in raw.columns])
    status = F.upper(F.trim(F.coalesce(F.col("status"), F.lit("")))) if "status" in rows.columns else F.lit("")
    known = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    return rows.withColumn("authority", F.try_element_at(known, status)).where("authority is not null")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def view_files(view: str) -> dict[str, str]:
    """The file of each table of a dataset view."""
    view = ALIASES.get(view, view)
    if view not in VIEWS:
        raise ValueError(f"unknown dataset view {view}")
    return dict(zip(("definitions", "regulations", "relations"), VIEWS[view])) | SHARED_FILES


def read_view(spark: SparkSession, folder: str, view: str) -> dict[str, DataFrame]:
    """The tables of a dataset view; all inputs are looked for before anything is read."""
    paths = {name: f"{folder.rstrip('/')}/{file}.jsonl" for name, file in view_files(view).items()}
    if missing := sorted(name for name, p in paths.items() if not exists(spark, p)):
        raise FileNotFoundError(f"missing inputs: {', '.join(missing)}")
    return {name: read_jsonl(spark, p, SCHEMAS[name]) for name, p in paths.items()}


def read_half_floats(spark: SparkSession, path: str, dimension: int) -> DataFrame:
    """(row, v) of files of little-endian float16 rows; a length that is no whole number of rows fails.

    Rows are numbered within a file; positions beyond one file need a key of their own.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for rows in batches:
            for p, c in zip(rows["path"], rows["content"]):
                if len(c) % (2 * dimension):
                    raise ValueError(f"{p}: {len(c)} bytes are no rows of {dimension}")
                x = np.frombuffer(c, "<f2").astype(np.float32).reshape(-1, dimension)
                for at in range(0, len(x), 10_000):
                    part = x[at : at + 10_000]
                    yield pd.DataFrame({"path": p, "row": np.arange(at, at + len(part)), "v": list(part)})

    return files.mapInPandas(run, "path string, row long, v array<float>")


def write_json(df: DataFrame, path: str, *keys: str) -> None:
    """Rows sorted by `keys`, fields in name order; Spark's committer makes the change at once."""
    df.select(*sorted(df.columns)).repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").json(path)


def table_digest(df: DataFrame) -> tuple[int, str]:
    """Row count and an order-independent digest of a table: the sum of row hashes."""
    row = df.select(F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256), 1, 12), 16, 10).cast("decimal(38,0)").alias("h")).agg(F.count("*"), F.sum("h")).first()
    return row[0], hashlib.sha256(str(row[1] or 0).encode()).hexdigest()


def manifest(tables: dict[str, DataFrame], schema_version: int) -> dict:
    """Counts and digests of a pack, and a revision over both."""
    files = {name: dict(zip(("rows", "digest"), table_digest(df))) for name, df in sorted(tables.items())}
    return {"schema_version": schema_version, "tables": files, "revision": hashlib.sha256(repr(sorted(files.items())).encode()).hexdigest()[:16]}


def check_manifest(found: dict, tables: dict[str, DataFrame], schema_version: int) -> list[str]:
    """What doesn't fit: the schema version first, then missing tables, counts and digests."""
    if found.get("schema_version") != schema_version:
        return [f"schema version {found.get('schema_version')} is not {schema_version}"]
    wrong = [f"{name} is missing" for name in found["tables"] if name not in tables]
    for name, df in tables.items():
        rows, digest = table_digest(df)
        want = found["tables"].get(name, {})
        if want.get("rows") != rows:
            wrong.append(f"{name} has {rows} rows, not {want.get('rows')}")
        elif want.get("digest") != digest:
            wrong.append(f"{name} has other content")
    return wrong


def upsert(spark: SparkSession, current: DataFrame, changed: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """A keyed table after changes and deletions; write it to a new folder and switch."""
    kept = current.join(changed.select(key), key, "left_anti").unionByName(changed)
    return kept.join(removed.select(key), key, "left_anti")


def declared(df: DataFrame, schema: str) -> DataFrame:
    """Columns of a declared schema, in its order; missing ones null, types cast."""
    fields = T._parse_datatype_string(schema).fields
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def write_half_floats(df: DataFrame, path: str, key: str, vector: str) -> None:
    """(key, vector) rows as Parquet, sorted by key, the vectors rounded to half precision."""

    def half(batches):
        for rows in batches:
            yield pd.DataFrame({"key": rows["key"], "v": [None if v is None else np.asarray(v, np.float16).astype(np.float32) for v in rows["v"]]})

    rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("v"))
    kind = rows.schema["key"].dataType.simpleString()
    rounded = rows.mapInPandas(half, f"key {kind}, v array<float>").select(F.col("key").alias(key), F.col("v").alias(vector))
    rounded.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def vector_gaps(definitions: DataFrame, vectors: DataFrame, key: str, vector: str, dimension: int) -> DataFrame:
    """(key, problem): definitions without a vector, vectors without a definition, and vectors of another length."""
    d, v = definitions.select(key).distinct(), vectors.select(key, F.size(vector).alias("n"))
    lacking = d.join(v.select(key), key, "left_anti").select(key, F.lit("no vector").alias("problem"))
    extra = v.join(d, key, "left_anti").select(key, F.lit("no definition"))
    return lacking.union(extra).union(v.where(F.col("n") != dimension).select(key, F.lit("length")))


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(file, bytes, sha256) of a folder's files, by the tasks that read them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def choose_revision(pinned: str | None, sidecar: dict | None, content: str) -> tuple[str, str]:
    """The build's revision and where it is from: pinned by the caller, told by the coverage sidecar, or of the content."""
    if pinned:
        return pinned, "pinned"
    told = (sidecar or {}).get("dataset_revision")
    return (str(told), "sidecar") if told else (content[:16], "content")


def check_parameters(found: dict, wanted: dict) -> list[str]:
    """Manifest parameters (as embedding dimension or fusion constant) that differ from what the reader supports."""
    return [f"{k} is {found.get(k)}, not {v}" for k, v in sorted(wanted.items()) if found.get(k) != v]


def read_bundle(spark: SparkSession, path: str, metadata_path: str, schema: str, key: str) -> DataFrame:
    """Bundled documents, whose number must be that of their metadata and whose keys must be filled."""
    docs = read_json_array(spark, path, schema)
    told = spark.read.option("multiLine", True).json(metadata_path).first().asDict().get("count")
    n, blank = docs.agg(F.count("*"), F.count_if(F.coalesce(F.trim(key), F.lit("")) == "")).first()
    if not n or n != told or blank:
        raise ValueError(f"{path}: {n} documents, {told} told, {blank} without {key}")
    return docs


#: A rule pack's columns.
RULE_SCHEMA = "rule_id string, literal string, replacement string, active boolean, exceptions array<string>"


def read_rules(spark: SparkSession, path: str | None, built_in: DataFrame) -> DataFrame:
    """A rule pack, or the built-in rules where there is none or it can't be read."""
    if path is None or not exists(spark, path):
        return built_in
    rules = spark.read.schema(RULE_SCHEMA).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return rules if rules.where("rule_id is not null").limit(1).count() else built_in


def write_report(metrics: DataFrame, path: str, kind: str) -> None:
    """A report of one kind (observation, comparison, quality) as JSON lines, deterministic."""
    write_json(metrics.withColumn("report", F.lit(kind)), path, *[c for c in metrics.columns if metrics.schema[c].dataType.typeName() not in ("array", "struct", "map")])


def export_package(fixtures: DataFrame, reviews: DataFrame, folder: str, key: str) -> dict:
    """A review package: both tables and a manifest with their counts and digests."""
    write_json(fixtures, f"{folder}/fixtures", key)
    write_json(reviews, f"{folder}/reviews", key)
    found = manifest({"fixtures": fixtures, "reviews": reviews}, schema_version=1)
    fixtures.sparkSession.createDataFrame([(json.dumps(found, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
    return found


def load_package(spark: SparkSession, folder: str, fixture_schema: str, review_schema: str) -> tuple[DataFrame, DataFrame]:
    """The tables of a review package, whose manifest must fit them."""
    tables = {"fixtures": read_jsonl(spark, f"{folder}/fixtures", fixture_schema), "reviews": read_jsonl(spark, f"{folder}/reviews", review_schema)}
    told = json.loads(spark.read.text(f"{folder}/manifest").first().value)
    if wrong := check_manifest(told, tables, schema_version=1):
        raise ValueError("; ".join(wrong))
    return tables["fixtures"], tables["reviews"]
