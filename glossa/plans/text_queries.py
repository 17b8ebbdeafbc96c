"""Scalar text functions, contracts of outputs, places and conflicts, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import parsing as p
from glossa.functions import text as t
from glossa.operators import anchors as a
from glossa.operators import candidates as c
from glossa.operators import definitions as d
from glossa.operators import evaluate as e
from glossa.operators import review, spans
from glossa.plans.document_queries import PARAS, paras
from glossa.plans.registry import query
from glossa.plans.retrieval_queries import norm, toks
from glossa.plans.signal_queries import UNITS, units
from glossa.session import table


@query("SELECT item_id, trim(regexp_replace(lower(text), '[\\s\\p{P}]+', ' ', 'g')) AS marks FROM benchmark")
def marks_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space and punctuation to single spaces."""
    return table(spark, sf_dir, "benchmark").select("item_id", t.normalise_marks(F.col("text")).alias("marks"))


@query("SELECT doc_id, lower(trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g'))) AS key FROM documents WHERE NOT regexp_matches(text, '[^\\x00-\\x7F]')")
def compatible_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded keys of the texts in plain letters (DuckDB has no compatibility form for others)."""
    docs = table(spark, sf_dir, "documents").where(~F.col("text").rlike(r"[^\x00-\x7F]"))
    return docs.select("doc_id", a.compatible_key(F.col("text")).alias("key"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_type WHEN p_size % 3 = 1 THEN 'x ' || p_type ELSE p_name || ' or ' || p_type END AS body FROM part")
def stripped_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions without their leading term and connector."""
    n = F.col("p_size") % 3
    said = F.when(n == 0, F.concat("p_name", F.lit(" adalah "), "p_type")).when(n == 1, F.concat(F.lit("x "), "p_type")).otherwise(F.concat("p_name", F.lit(" or "), "p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", t.strip_prefix(said, F.col("p_name"), d.CONNECTORS).alias("body"))


@query("SELECT vec_id, round(sqrt(list_inner_product(u, u)), 6) AS norm FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings)")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The norm of each vector over its norm."""
    u = t.unit_vector(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(t.dot(u, u)), 6).alias("norm"))


@query("SELECT item_id, CASE WHEN text[1:1] <> lower(text[1:1]) THEN 'Word' ELSE 'word' END AS new FROM benchmark UNION ALL SELECT 1000 + p_partkey, CASE WHEN p_size % 2 = 0 THEN 'New ' || p_type ELSE 'new ' || p_type END FROM part")
def cased_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replacements that begin as the original does."""
    b = table(spark, sf_dir, "benchmark").select("item_id", t.match_case(F.lit("word"), F.col("text")).alias("new"))
    name = F.when(F.col("p_size") % 2 == 0, F.initcap("p_name")).otherwise(F.col("p_name"))
    return b.union(table(spark, sf_dir, "part").select(F.col("p_partkey") + 1000, t.match_case(F.concat(F.lit("new "), "p_type"), name)))


FAMILIES = {"numbers": "\\d+(?:[.,]\\d+)*", "percent": "\\d+(?:[.,]\\d+)?\\s?%", "quoted": '"[^"]*"'}


@query("WITH m AS (SELECT doc_id, unnest(['numbers', 'percent', 'quoted']) AS family, unnest([" + ", ".join(f"list_sort(regexp_extract_all(text, '{x}'))" for x in FAMILIES.values()) + "]) AS found FROM documents) SELECT doc_id, family, len(found) AS n, sha256(array_to_string(found, '|')) AS digest FROM m WHERE len(found) > 0")
def marker_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, percentages and quotes of each document."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), t.markers(F.col("text"), f).alias("found")) for f in FAMILIES]))
    rows = table(spark, sf_dir, "documents").select("doc_id", each.alias("m")).where("size(m.found) > 0")
    return rows.select("doc_id", "m.family", F.size("m.found").cast("long").alias("n"), F.sha2(F.array_join("m.found", "|"), 256).alias("digest"))


@query(f"WITH {UNITS} SELECT doc_id, pos, CASE WHEN len(string_split(text, ' barang')) = 2 THEN strpos(text, ' barang') - 1 END AS start FROM u")
def unique_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a word stands, if it stands there once."""
    u = units(spark, sf_dir).withColumn("needle", F.lit(" barang"))
    return u.select("doc_id", "pos", a.unique_range("text", "needle")["start"].alias("start"))


@query(f"""
WITH {UNITS}, x AS (SELECT doc_id, pos, text AS a, replace(replace(text, 'wajib', 'harus'), 'dapat', 'boleh') AS b FROM u),
n AS (SELECT *, (SELECT max(i) FROM unnest(range(0, least(length(a), length(b)) + 1)) q(i) WHERE a[1:i] = b[1:i]) AS p FROM x),
s AS (SELECT *, (SELECT max(i) FROM unnest(range(0, least(length(a), length(b)) - p + 1)) q(i) WHERE right(a, i) = right(b, i)) AS s FROM n)
SELECT doc_id, pos, length(a) >= 32 AND length(b) >= 20 AND (p + s)::DOUBLE / greatest(length(a), length(b)) >= 0.6 AS wide FROM s
""")
def wide_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits that restate most of what they keep."""
    new = F.replace(F.replace("text", F.lit("wajib"), F.lit("harus")), F.lit("dapat"), F.lit("boleh"))
    return units(spark, sf_dir).select("doc_id", "pos", a.too_wide(F.col("text"), new).alias("wide"))


@query(f"""
WITH {UNITS}, n AS (SELECT doc_id, pos, {norm("text")} AS x FROM u)
SELECT doc_id, pos, array_to_string(regexp_extract_all(x, '[0-9]+(?:[.,][0-9]+)*'), ',') AS numbers, array_to_string(regexp_extract_all(x, '\\b(?:wajib|harus|dapat|boleh|dilarang)\\b'), ',') AS modality,
  array_to_string(regexp_extract_all(x, '\\b(?:tidak|bukan|tanpa)\\b'), ',') AS negation, array_to_string(regexp_extract_all(x, '\\b(?:kecuali|jika|apabila|sepanjang|asalkan)\\b[^.;!?]*'), ',') AS conditions FROM n
""")
def clause_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a clause holds of numbers, modality, negation and conditions."""
    s = units(spark, sf_dir).select("doc_id", "pos", a.signature(F.col("text")).alias("s"))
    return s.select("doc_id", "pos", *[F.array_join(F.col("s")[k], ",").alias(k) for k in ("numbers", "modality", "negation", "conditions")])


@query(f"""
WITH {UNITS}, w AS (SELECT doc_id, pos, {toks("text")} AS ws FROM u)
SELECT doc_id, pos, array_to_string(list_filter(ws, lambda x: list_contains(['tidak', 'bukan', 'tanpa', 'wajib', 'harus', 'dapat', 'boleh', 'dilarang', 'akan', 'jika', 'apabila', 'kecuali', 'sepanjang', 'hanya', 'dan', 'atau'], x) OR regexp_matches(x, '\\d')), ',')
  || CASE WHEN pos >= 0 AND contains(array_to_string(ws, ' '), 'pihak pertama') THEN ';pihak pertama' ELSE '' END AS operators FROM w
""")
def meaning_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of a clause that change its meaning, in order, and the parties it names."""
    o = units(spark, sf_dir).select("doc_id", "pos", d.operators(F.col("text")).alias("o"))
    words, named = F.filter("o", lambda x: ~x.contains(" ")), F.filter("o", lambda x: x.contains(" "))
    return o.select("doc_id", "pos", F.concat(F.array_join(words, ","), F.when(F.size(named) > 0, F.concat(F.lit(";"), F.array_join(named, ";"))).otherwise("")).alias("operators"))


@query("""
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'match' WHEN 1 THEN 'mismatch' WHEN 2 THEN 'mismatch' ELSE 'review' END AS alignment, p_size % 4 = 1 AS narrow FROM part
""")
def definition_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A definition against its source: the same, one negation apart, another modality, other words."""
    n = F.col("p_size") % 4
    source = F.concat("p_name", F.lit(" adalah barang yang dapat dijual sebagai "), F.lower("p_type"))
    body = F.when(n == 0, F.concat(F.upper("p_name"), F.lit(" ialah barang, yang dapat dijual sebagai "), "p_type")).when(n == 1, F.replace(source, F.lit("dapat"), F.lit("tidak dapat"))).when(n == 2, F.replace(source, F.lit("dapat"), F.lit("wajib"))).otherwise(F.concat(source, F.lit(" lama")))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", source.alias("source"), body.alias("body"))
    return rows.select("p_partkey", d.alignment(F.col("body"), F.col("source"), F.col("p_name")).alias("alignment"), d.narrow_negation(F.col("body"), F.col("source")).alias("narrow"))


@query(f"""
WITH {UNITS}, s AS (SELECT doc_id, pos, lower(regexp_extract(text, '^"([^"]+)" (adalah|berarti) ', 1)) AS name, regexp_extract(text, '^"[^"]+" (?:adalah|berarti) (.*)$', 1) AS body FROM u)
SELECT doc_id * 100 + pos AS segment_id, name AS term, body, 'explicit' AS strength FROM s WHERE name <> ''
""")
def definition_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that define a known term."""
    segments = units(spark, sf_dir).select((F.col("doc_id") * 100 + F.col("pos")).alias("segment_id"), F.regexp_replace("text", '"', "").alias("text")).where(F.col("text").rlike(" (adalah|berarti) "))
    return d.detect(segments, table(spark, sf_dir, "part").select(F.lower("p_name").alias("term")).distinct())


@query("SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN NULL WHEN 1 THEN 'reasoning' WHEN 2 THEN 'line-count' WHEN 3 THEN 'invalid-value' WHEN 4 THEN 'reason-too-long' ELSE 'unexpected-key' END AS error, CASE WHEN p_size % 6 = 0 THEN p_name END AS original FROM part")
def review_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-line outputs and what is wrong with those that break the contract."""
    n = F.col("p_size") % 6
    status = F.when(n == 3, "maybe").otherwise("suggestion")
    reason = F.when(n == 4, F.repeat(F.lit("r"), F.lit(241))).otherwise("fits")
    text = F.concat(F.lit("STATUS: "), status, F.lit("\nCATEGORY: spelling\nORIGINAL: "), "p_name", F.lit("\nREPLACEMENT: x\nREASON: "), reason, F.when(n == 5, "\nENTRY: -").otherwise("\nGLOSSARY_ID: -"), F.when(n == 1, "</think>").when(n == 2, "\nmore: x").otherwise(""))
    rows = table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))
    return rows.select("p_partkey", p.review_error(F.col("text")).alias("error"), p.review_fields(F.col("text"))["original"].alias("original"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 1 THEN 'repeated a' WHEN 2 THEN 'no-object' WHEN 3 THEN 'malformed' END AS error, CASE WHEN p_size % 4 = 0 THEN '{\"a\":' || p_size || ',\"b\":\"' || p_name || '\"}' END AS canonical FROM part")
def strict_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON objects in canonical form; repeated keys, other values and broken ones are errors."""
    n = F.col("p_size") % 4
    whole = F.concat(F.lit('{ "b": "'), "p_name", F.lit('", "a": '), F.col("p_size").cast("string"), F.lit("}"))
    text = F.when(n == 0, whole).when(n == 1, F.lit('{"a":1,"a":2}')).when(n == 2, F.lit("[1]")).otherwise(F.lit("{"))
    return p.strict_json(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "p_partkey", "text")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '[redacted]' ELSE p_name END AS shown, p_size % 2 = 0 AS grounded FROM part")
def reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons without traces of reasoning, and whether what they quote stands in the source."""
    text = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("<think>"), "p_name")).otherwise(F.col("p_name"))
    quoted = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('as "'), "p_name", F.lit('" says'))).otherwise(F.lit('as "nothing here" says'))
    return table(spark, sf_dir, "part").select("p_partkey", p.redacted(text).alias("shown"), p.grounded(quoted, F.concat(F.lit("the "), "p_name")).alias("grounded"))


@query(f"""
WITH {UNITS} SELECT doc_id, pos, CASE WHEN contains(text, ' barang') AND len(string_split(text, ' barang')) > 2 THEN 'ambiguous-range' WHEN NOT contains(text, 'barang') THEN 'not-in-context' WHEN pos % 3 = 1 THEN 'no-change' WHEN pos % 3 = 2 THEN 'too-long' END AS error FROM u
""")
def edit_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that a replacement of one word breaks."""
    n = F.col("pos") % 3
    new = F.when(n == 1, "barang").when(n == 2, F.repeat(F.lit("x"), F.lit(40))).otherwise("benda")
    checked = review.validate(F.lit("barang"), new, F.col("text"))
    order = F.when(~F.col("text").contains("barang"), "not-in-context").otherwise(checked)
    return units(spark, sf_dir).select("doc_id", "pos", order.alias("error"))


@query(f"""
WITH {PARAS}, s AS (SELECT doc_id, pos, start + 2 AS start, "end" - 1 AS "end" FROM paras), b AS (SELECT doc_id, pos AS block, start AS b_start, CASE WHEN pos % 2 = 0 THEN "end" ELSE "end" - 1 END AS b_end FROM paras)
SELECT s.doc_id, s.pos, min(block) AS block_id FROM s LEFT JOIN b ON b.doc_id = s.doc_id AND s.start >= b_start AND s."end" <= b_end GROUP BY 1, 2
""")
def containing_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block that holds each segment whole."""
    q = paras(spark, sf_dir)
    segments = q.select("doc_id", F.col("pos").alias("segment_id"), (F.col("start") + 2).alias("start"), (F.col("end") - 1).alias("end"))
    blocks = q.select("doc_id", F.col("pos").alias("block_id"), "start", F.when(F.col("pos") % 2 == 0, F.col("end")).otherwise(F.col("end") - 1).alias("end"))
    return a.containing_block(segments, blocks).select("doc_id", F.col("segment_id").alias("pos"), "block_id")


@query(f"""
WITH {PARAS}, r AS (SELECT doc_id, "end" AS r_start, "end" AS r_end FROM paras WHERE pos = 1 UNION ALL SELECT doc_id, start + 1, start + 4 FROM paras WHERE pos % 5 = 3)
SELECT doc_id, pos FROM paras p WHERE EXISTS (SELECT 1 FROM r WHERE r.doc_id = p.doc_id AND CASE WHEN r_start = r_end THEN r_start >= start AND r_start <= "end" ELSE r_start < "end" AND start < r_end END)
""")
def changed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that an edit or an insertion touches."""
    q = paras(spark, sf_dir)
    ranges = q.where("pos = 1").select("doc_id", F.col("end").alias("r_start"), F.col("end").alias("r_end")).union(q.where("pos % 5 = 3").select("doc_id", F.col("start") + 1, F.col("start") + 4))
    return a.changed_blocks(q.select("doc_id", F.col("pos").alias("block_id"), "start", "end"), ranges).select("doc_id", F.col("block_id").alias("pos"))


@query(f"WITH {PARAS} SELECT doc_id, pos, pos % 4 <> 3 AS holds FROM paras")
def anchor_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an anchored text still stands at its place; every fourth one has another digest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("whole"))
    q = paras(spark, sf_dir).join(docs, "doc_id")
    digest = F.when(F.col("pos") % 4 == 3, F.sha2(F.lit("x"), 256)).otherwise(F.sha2("text", 256))
    return q.select("doc_id", "pos", a.anchor_holds(F.col("whole"), F.col("start"), F.col("end"), F.col("text"), digest).alias("holds"))


@query(f"""
WITH {UNITS}, k AS (SELECT doc_id, pos, text, doc_id * 100 + pos AS id FROM u), p AS (SELECT *, CASE pos % 3 WHEN 0 THEN 0 WHEN 1 THEN 11 ELSE 21 END AS pr, pos // 4 * 10 + pos % 4 * 3 AS s FROM k), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pos // 4 ORDER BY pr, s, id) AS r FROM p)
SELECT x.doc_id, count(*) AS kept FROM o x WHERE r = 1 OR (r = 2 AND NOT EXISTS (SELECT 1 FROM o y WHERE y.doc_id = x.doc_id AND y.pos // 4 = x.pos // 4 AND y.r = 1 AND abs(y.s - x.s) < 5))
  OR (r > 2 AND NOT EXISTS (SELECT 1 FROM o y WHERE y.doc_id = x.doc_id AND y.pos // 4 = x.pos // 4 AND y.r < x.r AND abs(y.s - x.s) < 5 AND (y.r = 1 OR NOT EXISTS (SELECT 1 FROM o z WHERE z.doc_id = y.doc_id AND z.pos // 4 = y.pos // 4 AND z.r < y.r AND abs(z.s - y.s) < 5
    AND (z.r = 1 OR NOT EXISTS (SELECT 1 FROM o v WHERE v.doc_id = z.doc_id AND v.pos // 4 = z.pos // 4 AND v.r < z.r AND abs(v.s - z.s) < 5)))))) GROUP BY 1
""")
def edit_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of which no two overlap: by who made them, then the shorter, then the earlier."""
    n = F.col("pos") % 3
    start = F.expr("pos div 4 * 10 + pos % 4 * 3")
    rows = units(spark, sf_dir).select(
        "doc_id", F.expr("doc_id * 10 + pos div 4").alias("segment_id"), (F.col("doc_id") * 100 + F.col("pos")).alias("review_id"), F.lit("suggestion").alias("status"),
        F.when(n == 0, "deterministic").when(n == 1, "deterministicFallback").otherwise("model").alias("origin"), F.when(n == 1, "grammar").otherwise("spelling").alias("category"), start.alias("start"), (start + 5).alias("end"),
    )
    return a.resolve_conflicts(rows.drop("doc_id")).groupBy(F.expr("review_id div 100").alias("doc_id")).agg(F.count("*").alias("kept"))


@query(f"""
WITH {UNITS}, l AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY pos) AS text, count(*) + count(*) FILTER (pos > 0 AND regexp_matches(text, '^(Pihak|Pembeli) ')) AS n FROM u GROUP BY 1) SELECT doc_id, n AS clauses, length(text) AS covered FROM l
""")
def clause_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses that stand alone: one a line, and the line's end by itself where an actor begins the next; together the whole text."""
    from glossa.plans.signal_queries import contracts

    found = a.clause_ranges(contracts(spark, sf_dir))
    return found.groupBy("doc_id").agg(F.count("*").alias("clauses"), F.sum(F.col("end") - F.col("start")).alias("covered"))


@query(f"""
WITH {UNITS}, t AS (SELECT doc_id, pos, 100 + pos * 37 % 300 AS tokens FROM u), r AS (SELECT doc_id, sum(tokens) AS tokens, count(*) AS clauses FROM t GROUP BY 1) SELECT doc_id, tokens, true AS within, clauses FROM r
""")
def window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses packed to windows of 512 tokens: each once, none over the budget."""
    clauses = units(spark, sf_dir).select("doc_id", F.col("pos").alias("n"), F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), (100 + F.col("pos") * 37 % 300).alias("tokens"))
    w = a.pack_windows(clauses, windows=100)
    return w.groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.min((F.col("tokens") <= 512) & F.col("window").isNotNull()).alias("within"), F.sum(F.col("end") - F.col("start")).alias("clauses"))


@query(f"WITH {UNITS}, l AS (SELECT doc_id, pos, regexp_extract_all(text, '\"[^\"]+\"|\\[NOMOR [A-Z]+\\]|Pihak Pertama|Para Pihak') AS f, text FROM u) SELECT doc_id, pos, len(list_filter(f, lambda x: x[1:1] = '\"')) AS quotes, contains(text, 'Para Pihak') AS party FROM l")
def protected_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes, and mentions of parties, that edits must leave alone."""
    u = units(spark, sf_dir)
    found = a.protected_spans(u.select((F.col("doc_id") * 100 + F.col("pos")).alias("doc_id"), "text"))
    per = found.groupBy(F.col("doc_id").alias("k")).agg(F.count_if(F.col("value").startswith('"')).alias("quotes"), F.max(F.col("value") == "Para Pihak").alias("party"))
    return u.withColumn("k", F.col("doc_id") * 100 + F.col("pos")).join(per, "k", "left").select("doc_id", "pos", F.coalesce("quotes", F.lit(0)).alias("quotes"), F.coalesce("party", F.lit(False)).alias("party"))


@query(f"WITH {UNITS} SELECT doc_id, pos, regexp_extract(text, ' (\\S+)', 1) AS word, length(regexp_extract(text, '^(\\S+) ', 1)) + 1 AS start FROM u WHERE text LIKE 'P%'")
def pattern_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second words with their places."""
    u = units(spark, sf_dir).where(F.col("text").startswith("P")).select((F.col("doc_id") * 100 + F.col("pos")).alias("k"), "text")
    found = review.matches(u, "k", "text", r"^\S+ (\S+)", group=1)
    return found.select(F.expr("doc_id div 100").alias("doc_id"), F.expr("cast(doc_id % 100 as int)").alias("pos"), F.col("value").alias("word"), "start")


@query(f'WITH {PARAS} SELECT doc_id, pos, start, "end" FROM (SELECT *, lead(start - 3) OVER (PARTITION BY doc_id ORDER BY start, "end") AS n FROM paras) WHERE n < "end"')
def range_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph ranges, begun three characters early, that run into the next one."""
    q = paras(spark, sf_dir).select("doc_id", "pos", (F.col("start") - 3).alias("start"), "end")
    return spans.conflicts(q).select("doc_id", "pos", (F.col("start") + 3).alias("start"), "end")


@query(f"""
WITH {PARAS} SELECT doc_id, pos, start + CASE WHEN start >= 60 THEN -7 ELSE 0 END AS start, "end" + CASE WHEN start >= 60 THEN -7 ELSE 0 END AS "end" FROM paras WHERE "end" <= 50 OR start >= 60
""")
def accepted_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges after characters 50 to 60 were replaced by three: overlapping ones go, later ones move."""
    return spans.after_accept(paras(spark, sf_dir).select("doc_id", "pos", "start", "end"), 50, 60, 3)


@query("SELECT event_type, count(value) AS n, min(value) AS low, max(value) AS high, round(median(value), 6) AS mid FROM events GROUP BY 1")
def value_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, least, largest and middle value of each type, nulls left out."""
    return e.value_stats(table(spark, sf_dir, "events"), "value", "event_type")


@query("SELECT lang, CASE WHEN n_chars < 100 THEN 'short' WHEN n_chars > 5000 THEN 'long' WHEN source LIKE '%a%' THEN 'source' END AS reason, count(*) AS n FROM documents GROUP BY 1, 2")
def filter_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each reason leaves out; those without one stay."""
    reasons_ = [(F.col("n_chars") < 100, "short"), (F.col("n_chars") > 5000, "long"), (F.col("source").like("%a%"), "source")]
    return e.filter_reasons(table(spark, sf_dir, "documents"), reasons_, "lang")


@query("""
WITH e AS (SELECT o_orderkey AS id, o_orderstatus AS k, o_custkey % 5 <> 0 AS expected FROM orders), o AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_quantity > 45)
SELECT k, count(*) FILTER (expected AND o.id IS NOT NULL) AS tp, count(*) FILTER (NOT expected AND o.id IS NOT NULL) AS fp, count(*) FILTER (expected AND o.id IS NULL) AS fn,
  coalesce(array_to_string((list(e.id ORDER BY e.id) FILTER (expected AND o.id IS NULL))[1:3], ','), '') AS first_misses FROM e LEFT JOIN o USING (id) GROUP BY 1
""")
def correction_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected and observed corrections of each kind, and those missed."""
    hit = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("id")).distinct().withColumn("observed", F.lit(True))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("k"), (F.col("o_custkey") % 5 != 0).alias("expected")).join(hit, "id", "left")
    out = e.corrections(rows, F.col("expected"), F.col("observed"), "id", "k")
    return out.select("k", "tp", "fp", "fn", F.array_join(F.slice("misses", 1, 3), ",").alias("first_misses"))


@query("SELECT count_if(p_size % 3 = 0) AS reused, count_if(p_size % 3 <> 0) AS reprocessed, count_if(p_size % 3 = 0 AND p_size % 5 <> 0) AS equal FROM part")
def incremental_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an incremental run reused, did again, and got as a fresh run does."""
    rows = table(spark, sf_dir, "part").select(F.when(F.col("p_size") % 3 == 0, "reuse").otherwise("reprocess").alias("action"), F.col("p_size").alias("incremental"), F.when(F.col("p_size") % 5 == 0, -1).otherwise(F.col("p_size")).alias("fresh"))
    return e.incremental_counters(rows)


@query(f"WITH {PARAS}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS c FROM paras) SELECT doc_id, count(*) AS sampled FROM n WHERE k % greatest(ceil(c / 8)::BIGINT, 1) = 0 GROUP BY 1")
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About eight blocks of each document at even strides."""
    return a.stride_sample(paras(spark, sf_dir).select("doc_id", "pos", "text"), budget=10**9).groupBy("doc_id").agg(F.count("*").alias("sampled"))


@query("SELECT doc_id, sha256(doc_id || chr(31) || lang || chr(31) || coalesce(source, '')) AS key FROM documents")
def reuse_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key over everything that a kept result depends on."""
    return table(spark, sf_dir, "documents").select("doc_id", a.reuse_key(F.col("doc_id"), F.col("lang"), F.col("source")).alias("key"))


@query(f"WITH {UNITS}, s AS (SELECT doc_id, lower(regexp_extract(text, '^\"([^\"]+)\" (?:adalah|berarti) ', 1)) AS term, regexp_extract(text, '^\"[^\"]+\" (?:adalah|berarti) (.*)$', 1) AS body, pos FROM u), k AS (SELECT *, trim(regexp_replace(lower(body), '[\\s\\p{{P}}]+', ' ', 'g')) AS said FROM s WHERE term <> '') SELECT doc_id, pos FROM k WHERE (doc_id, term) IN (SELECT (doc_id, term) FROM k GROUP BY doc_id, term HAVING count(DISTINCT said) > 1)")
def conflicting_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions that another sentence of the document gives another body."""
    lead = r'^"([^"]+)" (?:adalah|berarti) (.*)$'
    u = units(spark, sf_dir).where(F.col("text").rlike(lead)).select("doc_id", "pos", F.regexp_extract("text", lead, 1).alias("term"), F.regexp_extract("text", lead, 2).alias("body"))
    return a.conflicting_elsewhere(u).select("doc_id", "pos")


@query(f"WITH {UNITS} SELECT doc_id, pos, CASE WHEN pos % 4 < 2 THEN 'canon ' || (pos % 7) END AS canonical FROM u")
def scoped_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that are an alias of another where they stand."""
    u = units(spark, sf_dir)
    terms = u.select("doc_id", "pos", F.concat(F.lit("T "), F.col("pos") % 7).alias("term"))
    aliases = u.where("pos % 4 < 2").select("doc_id", F.concat(F.lit("t  "), F.col("pos") % 7).alias("alias"), F.concat(F.lit("canon "), F.col("pos") % 7).alias("canonical"), F.col("pos").alias("from_pos"), (F.col("pos") + 1).alias("to_pos"))
    return a.alias_in_scope(terms, aliases).select("doc_id", "pos", "canonical")


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k <= 3")
def cap_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns that a cap of three a conversation keeps."""
    return c.capped(table(spark, sf_dir, "conversations"), "conv_id", 3, F.col("turn"))[0].select("conv_id", "turn")
