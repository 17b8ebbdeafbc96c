"""Review signals over contract sentences made from the driver's parts: forty parts are one document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators import signals as s
from glossa.plans.registry import query
from glossa.session import Scratch, table

#: The same in both dialects.
SENTENCE = """CASE p_partkey % 11
  WHEN 0 THEN '"' || p_name || '" adalah ' || lower(p_type) || ' barang.'
  WHEN 1 THEN 'Pihak Pertama wajib membayar ' || p_name || ' dalam ' || p_size || ' hari.'
  WHEN 2 THEN 'Pihak Pertama tidak wajib membayar ' || p_name || ' dalam ' || p_size || ' hari.'
  WHEN 3 THEN 'Penyedia dapat mengakhiri ' || p_name || ' tanpa pemberitahuan.'
  WHEN 4 THEN 'Barang yang selanjutnya disebut "' || upper(p_name) || '".'
  WHEN 5 THEN 'Pelanggan harus harus menjaga ' || p_name || ' jika ' || lower(p_type) || '.'
  WHEN 6 THEN 'Pembeli menyerahkan biaya ' || p_name || ' bulanan.'
  WHEN 7 THEN 'Pembeli menyerahkan biaya ' || p_name || ' tahunan kecuali.'
  WHEN 8 THEN 'Para Pihak menyampaikan [NOMOR ' || upper(p_type) || '] sesuai Pasal ' || p_size || '.'
  WHEN 9 THEN 'Penerima dapat menggunakan ' || p_name || ' apabila ' || lower(p_type) || '.'
  ELSE '"' || p_name || '" berarti ' || lower(p_type) || '.' END"""

UNITS = f"u AS (SELECT p_partkey // 40 AS doc_id, (p_partkey % 40)::INT AS pos, {SENTENCE} AS text FROM part)"


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.expr("p_partkey div 40").alias("doc_id"), F.expr("cast(p_partkey % 40 as int)").alias("pos"), F.expr(SENTENCE).alias("text"))


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    return units(spark, sf_dir).groupBy("doc_id").agg(F.array_join(lines, "\n").alias("text"))


PLAIN = "trim(regexp_replace(lower(strip_accents({0})), '[\\s\\p{{P}}]+', ' ', 'g'))"


def plain(x: str) -> str:
    return PLAIN.format(x)


DECLARED = f"""
{UNITS}, e AS (SELECT doc_id, pos, 0 AS pass, regexp_extract(text, '"([^"\\n]{{2,100}})"\\s+(?:adalah|berarti|merupakan)\\b', 1) AS term, regexp_extract(text, '(?:adalah|berarti|merupakan) ([^.]*)', 1) AS body FROM u
  UNION ALL SELECT doc_id, pos, 1, regexp_extract(text, 'selanjutnya disebut "([^"\\n]{{2,100}})"', 1), '' FROM u),
d AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pass, pos) AS ord, term, {plain("term")} AS key, {plain("body")} AS body FROM e WHERE term <> '')
"""


@query(f"WITH {DECLARED} SELECT doc_id, key, count(*) AS declarations, count(DISTINCT nullif(body, '')) AS bodies FROM d GROUP BY 1, 2")
def term_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared terms of each contract, how often and with how many bodies."""
    said = s.plain(F.col("body"))
    found = s.declarations(contracts(spark, sf_dir))
    return found.groupBy("doc_id", "key").agg(F.count("*").alias("declarations"), F.count_distinct(F.when(said != "", said)).alias("bodies"))


@query(f"""
WITH {DECLARED}, f AS (SELECT *, first_value(term) OVER (PARTITION BY doc_id, key ORDER BY ord) AS first_term, row_number() OVER (PARTITION BY doc_id, key ORDER BY ord) AS n FROM d),
x AS (SELECT doc_id, CASE WHEN count(DISTINCT nullif(body, '')) > 1 THEN 'defined-term-conflicting-definition' ELSE 'defined-term-duplicate-definition' END AS rule_id FROM d GROUP BY doc_id, key HAVING count(*) > 1
  UNION ALL SELECT doc_id, 'defined-term-case-inconsistency' FROM f WHERE n > 1 AND term <> first_term)
SELECT doc_id, rule_id, count(*) AS findings FROM x GROUP BY 1, 2
""")
def defined_term_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated, conflicting and unevenly spelled declarations of each contract."""
    return s.term_findings(s.declarations(contracts(spark, sf_dir))).groupBy("doc_id", "rule_id").agg(F.count("*").alias("findings"))


FACTS = f"""
{UNITS}, a AS (SELECT *, regexp_extract(text, '{s.PARTY}', 0) AS party, regexp_extract(text, '{s.ACTION}', 0) AS action FROM u),
b AS (SELECT *, CASE WHEN action = '' THEN '' ELSE {plain("array_to_string(list_filter(regexp_split_to_array(regexp_replace(substr(text, strpos(lower(text), lower(action)) + length(action)), '" + s.MODAL_LEAD + "', ''), '[\\s\\p{P}]+'), lambda x: x <> '')[1:8], ' ')")} END AS object,
  CASE WHEN regexp_matches(text, '{s.NEGATIVE}') THEN 'negative' WHEN regexp_matches(text, '{s.PERMISSION}') THEN 'permission' WHEN regexp_matches(text, '{s.MANDATORY}') THEN 'mandatory' ELSE 'neutral' END AS polarity,
  regexp_extract(text, '{s.CONDITION}', 0) AS condition, regexp_matches(text, '{s.DANGLING}') AS dangling, regexp_matches(text, '{s.EXPLAINED}') AS explained,
  regexp_matches(text, '{s.TERMINATION}') AND regexp_matches(text, '{s.NO_NOTICE}') AS no_notice FROM a)
"""


@query(f"WITH {FACTS} SELECT doc_id, pos, party, action, object, polarity, condition, dangling, no_notice FROM b")
def clause_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Party, action, object, polarity and condition of every sentence."""
    return s.clause_facts(units(spark, sf_dir)).drop("text", "explained")


RISKS = f"""
{FACTS}, k AS (SELECT doc_id, pos, {plain("party")} || '|' || {plain("action")} || '|' || object AS key, polarity, {plain("condition")} AS c, explained FROM b WHERE party <> '' AND action <> '' AND object <> ''),
p AS (SELECT x.doc_id, CASE WHEN x.polarity <> y.polarity THEN 'legal-risk-modal-negation-conflict' WHEN x.c <> '' AND y.c <> '' AND x.c <> y.c AND NOT x.explained THEN 'legal-risk-condition-exception-conflict' END AS rule_id, x.pos, y.pos AS other_pos
  FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.key = y.key AND y.pos < x.pos),
r AS (SELECT doc_id, 'legal-risk-unilateral-termination-no-notice' AS rule_id, pos, NULL::INT AS other_pos FROM b WHERE no_notice UNION ALL SELECT doc_id, 'legal-risk-dangling-condition', pos, NULL FROM b WHERE dangling UNION ALL SELECT * FROM p WHERE rule_id IS NOT NULL)
"""


@query(f"WITH {RISKS} SELECT * FROM r")
def risk_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.risk_findings(s.clause_facts(units(spark, sf_dir)))


@query(f"""
WITH {RISKS}, o AS (SELECT *, CASE rule_id WHEN 'defined-term-conflicting-definition' THEN 0 WHEN 'legal-risk-modal-negation-conflict' THEN 1 WHEN 'legal-risk-condition-exception-conflict' THEN 2 WHEN 'legal-risk-unilateral-termination-no-notice' THEN 3 ELSE 4 END AS priority FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY priority, pos, coalesce(other_pos, -1)) AS k FROM o)
SELECT doc_id, rule_id, pos, priority FROM n WHERE k <= 8
""")
def model_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight findings of a contract that go to a model first."""
    found = s.risk_findings(s.clause_facts(units(spark, sf_dir)))
    return s.model_candidates(found)[0].select("doc_id", "rule_id", "pos", "priority")


def listed(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


SIGNALS = f"""
{UNITS}, w AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS words FROM u),
f AS (SELECT *, list_filter(words, lambda x: NOT list_contains({listed([*s.STOP, *s.ACTORS, *s.OPERATORS, *s.FREQUENCY])}, x) AND length(x) > 2 AND NOT regexp_full_match(x, '[0-9]+')) AS content,
  list_sort(list_distinct(list_transform(regexp_extract_all(text, '{s.VALUES}'), lambda x: lower(x)))) AS vals, list_sort(list_intersect(words, {listed(s.FREQUENCY)})) AS freq, list_sort(list_intersect(words, {listed(s.OPERATORS)})) AS ops,
  nullif(lower(regexp_extract(text, '"([^"\\n]{{2,100}})"\\s+(?:adalah|berarti|merupakan)\\b', 1)), '') AS term FROM w),
m AS (SELECT a.doc_id, a.pos, b.pos AS other_pos, a.term AS ta, b.term AS tb, len(list_intersect(a.content, b.content)) AS shared, a.vals AS va, b.vals AS vb, a.freq AS fa, b.freq AS fb, a.ops AS oa, b.ops AS ob, a.text AS xa, b.text AS xb
  FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.pos < b.pos AND a.text <> b.text AND (len(list_intersect(a.content, b.content)) > 0 OR a.term = b.term)),
c AS (SELECT *, CASE WHEN ta IS NOT NULL AND ta = tb THEN 'definition' WHEN shared = 0 THEN NULL WHEN len(va) > 0 AND len(vb) > 0 AND va <> vb THEN 'value' WHEN len(fa) > 0 AND len(fb) > 0 AND fa <> fb THEN 'frequency' WHEN oa <> ob THEN 'operator' END AS kind FROM m
  WHERE NOT ((ta IS NOT NULL AND len(oa) = 0 AND len(va) = 0 AND len(fa) = 0 AND tb IS NULL) OR (tb IS NOT NULL AND len(ob) = 0 AND len(vb) = 0 AND len(fb) = 0 AND ta IS NULL))),
q AS (SELECT doc_id, pos, other_pos, kind, CASE kind WHEN 'value' THEN regexp_replace(xa, '[0-9]+ hari', '#', 'g') = regexp_replace(xb, '[0-9]+ hari', '#', 'g')
  WHEN 'frequency' THEN regexp_replace(xa, 'bulanan|tahunan', '#', 'g') = regexp_replace(xb, 'bulanan|tahunan', '#', 'g') ELSE false END AS same FROM c WHERE kind IS NOT NULL)
"""


@query(f"WITH {SIGNALS} SELECT doc_id, pos, other_pos, kind, same AS parameter_difference FROM q")
def unit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of a contract that share a word or a term and differ in what they say about it."""
    return s.unit_pairs(s.unit_facts(units(spark, sf_dir)))


@query(f"""
WITH {SIGNALS}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, other_pos) AS k FROM q WHERE NOT same)
SELECT doc_id, least(count(*), 12) AS asked, greatest(count(*) - 12, 0) AS overflow, sum(CASE WHEN k <= 12 THEN pos * 100 + other_pos ELSE 0 END)::BIGINT AS chosen FROM n GROUP BY 1
""")
def signal_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that a model is asked about, twelve a contract, and how many the limit leaves out."""
    plan = s.signal_plan(units(spark, sf_dir))
    asked = plan["pairs"].groupBy("doc_id").agg(F.count("*").alias("asked"), F.sum(F.col("pos").cast("long") * 100 + F.col("other_pos")).alias("chosen"))
    return asked.join(plan["pair_overflow"], "doc_id")


@query(f"""
WITH {UNITS}, d AS (SELECT doc_id, pos, 'grammar' AS category, 'harus harus' AS original, 'harus' AS replacement FROM u WHERE contains(text, 'harus harus')),
p AS (SELECT doc_id, pos, 'missing' AS category, unnest(regexp_extract_all(text, '\\[[A-Z][A-Z0-9_ /-]{{2,60}}\\]')) AS original, NULL AS replacement FROM u)
SELECT * FROM d UNION ALL SELECT * FROM p
""")
def local_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated words and open parameters, found without a model."""
    return s.local_findings(units(spark, sf_dir))


@query(f"WITH {RISKS} SELECT doc_id, 'legalRisk' AS kind, count(*) AS findings FROM r GROUP BY 1")
def findings_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = s.risk_findings(s.clause_facts(units(spark, sf_dir)))
    return s.counts_by_kind(found.withColumn("kind", F.lit("legalRisk")))


@query(f"""
WITH {UNITS}, b AS (SELECT doc_id, pos, 'Pasal ' || pos || CASE WHEN pos % 3 = 0 THEN '. ' ELSE ' ' END || text AS text, pos % 2 = 0 AS heading FROM u)
SELECT doc_id, 's' || (pos // 8) AS section, 'pasal ' || pos AS label, count(*) AS n FROM b GROUP BY ALL
""")
def internal_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that headings and numbered blocks begin with."""
    lead = F.concat(F.lit("Pasal "), F.col("pos").cast("string"), F.when(F.col("pos") % 3 == 0, ". ").otherwise(" "), F.col("text"))
    blocks = units(spark, sf_dir).select("doc_id", F.expr("'s' || (pos div 8)").alias("section"), F.when(F.col("pos") % 2 == 0, "heading").otherwise("numbered").alias("kind"), lead.alias("text"))
    return s.internal_targets(blocks).groupBy("doc_id", "section", "label").agg(F.count("*").alias("n"))


#: The same in both dialects: a line for each order; all of a customer's orders are one document.
CLAUSE = """CASE o_orderkey % 7
  WHEN 0 THEN '"Harga ' || (o_orderkey % 9) || '" berarti ' || lower(o_orderpriority) || '.'
  WHEN 1 THEN 'Istilah "Harga ' || (o_custkey % 9) || '" tersebut berlaku; "Toko" buka.'
  WHEN 2 THEN 'Pembeli menjaga "data ' || (o_orderkey % 5) || '" harian, juga "Barang" yang dapat rusak.'
  WHEN 3 THEN 'Barang yang selanjutnya disebut "' || c_mktsegment || '".'
  WHEN 4 THEN 'Jumlah harga ' || (o_orderkey % 9) || ' ini oleh ' || lower(c_mktsegment) || ' dicatat, HARGA ' || (o_custkey % 9) || ' tetap.'
  WHEN 5 THEN '"Harga ' || (o_orderkey % 3) || '" atau "Biaya ' || (o_orderkey % 4) || '" tetap.'
  ELSE 'Para biaya ' || (o_orderkey % 4) || ' dan BIAYA ' || (o_custkey % 4) || ' dibayar kepada ' || c_mktsegment || '.' END"""

def term_ctes(lines: str) -> str:
    """Declared terms of the lines (doc_id, pos, line) of documents, with their places."""
    return f"""
cl AS ({lines}),
lo AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS off FROM cl),
tx AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM cl GROUP BY 1),
m AS (SELECT doc_id, off, line, regexp_extract(line, '"([^"\\n]{{2,100}})"\\s+(?:adalah|berarti|merupakan) ([^.]+)', ['a', 'b']) AS e, regexp_extract(line, 'selanjutnya disebut "([^"\\n]{{2,100}})"', 1) AS c, regexp_extract(line, '"([^"]{{2,100}})" atau "([^"]{{2,100}})"', ['a', 'b']) AS al FROM lo),
allq AS (SELECT doc_id, 0 AS rank, off AS seat, 0 AS part, e.a AS term, off + instr(line, '"') AS start, NULL AS alias_of FROM m WHERE e.a <> ''
  UNION ALL SELECT doc_id, 1, off, 0, c, off + instr(line, '"'), NULL FROM m WHERE c <> ''
  UNION ALL SELECT doc_id, 2, off, 0, al.a, off, NULL FROM m WHERE al.a <> '' UNION ALL SELECT doc_id, 2, off, 1, al.b, off + instr(line, '"' || al.b || '"'), al.a FROM m WHERE al.a <> ''),
first_alias AS (SELECT * FROM allq WHERE alias_of IS NULL OR true QUALIFY alias_of IS NULL OR row_number() OVER (PARTITION BY doc_id, lower(term), alias_of IS NULL ORDER BY rank, seat, part) = 1),
dec AS (SELECT * FROM first_alias QUALIFY rank <> 2 OR alias_of IS NOT NULL OR row_number() OVER (PARTITION BY doc_id, lower(term), alias_of IS NULL ORDER BY rank, seat, part) = 1),
dp AS (SELECT doc_id, term, start + CASE WHEN rank = 2 AND alias_of IS NULL THEN 1 ELSE 0 END AS start FROM dec),
known AS (SELECT doc_id, lower(term) AS key FROM dec UNION SELECT doc_id, lower(alias_of) FROM dec WHERE alias_of IS NOT NULL)"""


CLAUSE_LINES = term_ctes(f"SELECT o_custkey AS doc_id, o_orderkey AS pos, {CLAUSE} AS line FROM orders JOIN customer ON c_custkey = o_custkey")


def clause_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each customer with orders."""
    customer = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    rows = table(spark, sf_dir, "orders").join(customer, "o_custkey").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("pos"), F.expr(CLAUSE).alias("line"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))


@query(f"""
WITH {CLAUSE_LINES}, q AS (SELECT doc_id, off, line, unnest(regexp_extract_all(line, '"([^"\\n]{{2,100}})"', 1)) AS term FROM lo),
p AS (SELECT DISTINCT q.doc_id, term, off + instr(line, '"' || term || '"') AS start FROM q WHERE lower(term) NOT IN (SELECT key FROM known WHERE known.doc_id = q.doc_id)),
n AS (SELECT p.*, text[greatest(start - 50, 0) + 1:start] AS before, text[start + length(term) + 1:start + length(term) + 50] AS after FROM p JOIN tx USING (doc_id))
SELECT doc_id, 'defined-term-undeclared-quoted-term' AS rule_id, start::INT AS start, (start + length(term))::INT AS "end", term AS original FROM n
WHERE (regexp_matches(term, '^[A-Z]') OR regexp_matches(term, '(?i)\\b(Pihak|Perjanjian|Informasi|Data)\\b'))
  AND (contains(term, ' ') OR regexp_matches(before, '(?i)(disebut|istilah|sebagaimana|yang dimaksud|didefinisikan)') OR regexp_matches(after, '(?i)(tersebut|berikut|ini|dimaksud|wajib|dapat)'))
""")
def undeclared_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted names that a document uses like declared terms but declares nowhere."""
    docs = Scratch(spark, "terms").cut(clause_documents(spark, sf_dir), "docs")
    said = s.sayings(docs)
    return s.undeclared_terms(s.declarations(docs, said=said), said)


UNEVEN = """w AS (SELECT d.doc_id, d.term, off, line, off + i - 1 AS start, line[i:i + length(d.term) - 1] AS original, line[i - 1:i - 1] AS l, line[i + length(d.term):i + length(d.term)] AS r
  FROM (SELECT DISTINCT doc_id, term FROM dec) d JOIN lo ON lo.doc_id = d.doc_id AND contains(lower(line), lower(d.term)), unnest(range(1, length(line) + 1)) AS u(i) WHERE lower(line[i:i + length(d.term) - 1]) = lower(d.term)),
v AS (SELECT * FROM w WHERE original <> term AND (start = off OR NOT regexp_matches(l, '\\w')) AND NOT regexp_matches(r, '\\w') AND EXISTS (SELECT 1 FROM dp WHERE dp.doc_id = w.doc_id AND dp.term = w.term AND (w.start >= dp.start + length(dp.term) OR dp.start >= w.start + length(w.term)))),
n AS (SELECT v.*, text[greatest(start - 40, 0) + 1:start] AS before, text[start + length(term) + 1:start + length(term) + 40] AS after FROM v JOIN tx USING (doc_id))"""
UNEVEN_ROWS = """SELECT DISTINCT doc_id, 'defined-term-case-inconsistency' AS rule_id, start::INT AS start, (start + length(term))::INT AS "end", original, term FROM n
WHERE right(before, 1) = '"' OR after[1:1] = '"' OR regexp_matches(before, '(?i)(disebut|istilah|sebagaimana|yang dimaksud)') OR regexp_matches(after, '(?i)(tersebut|ini|dimaksud)') OR regexp_matches(original, '^[A-Z]') OR contains(term, ' ')"""


@query(f"WITH {CLAUSE_LINES}, {UNEVEN} {UNEVEN_ROWS}")
def uneven_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places that write a declared term in other letters than its declaration and clearly mean it."""
    docs = Scratch(spark, "terms").cut(clause_documents(spark, sf_dir), "docs")
    return s.uneven_usages(docs, s.declarations(docs))


def _review_sql() -> str:
    risks = RISKS.split("u AS (", 1)[1].split(" FROM part)", 1)[1]  # what follows the units
    terms = term_ctes("SELECT doc_id, pos, text AS line FROM u")
    return f"""
WITH {UNITS}{risks}, {terms}, {UNEVEN},
dn AS (SELECT d.doc_id, d.term, lower(d.term) AS key, d.start, e.b AS body, row_number() OVER (PARTITION BY d.doc_id, lower(d.term) ORDER BY d.rank, d.seat, d.part) AS n, first_value(d.term) OVER (PARTITION BY d.doc_id, lower(d.term) ORDER BY d.rank, d.seat, d.part) AS first_term
  FROM dec d LEFT JOIN (SELECT doc_id, off, e FROM m WHERE e.a <> '') x ON x.doc_id = d.doc_id AND x.off = d.seat AND d.rank = 0),
ft AS (SELECT doc_id, CASE WHEN count(DISTINCT nullif({plain("body")}, '')) > 1 THEN 'defined-term-conflicting-definition' ELSE 'defined-term-duplicate-definition' END AS rule_id, 'definedTerm' AS kind, arg_min(start, n) AS start, arg_min(start, n) + arg_min(length(term), n) AS "end", arg_min(term, n) AS original, NULL AS replacement FROM dn GROUP BY doc_id, key HAVING count(*) > 1
  UNION SELECT doc_id, 'defined-term-case-inconsistency', 'definedTerm', start, start + length(term), term, NULL FROM dn WHERE n > 1 AND term <> first_term
  UNION SELECT doc_id, rule_id, 'definedTerm', start, "end", original, NULL FROM ({UNEVEN_ROWS})),
fr AS (SELECT DISTINCT r.doc_id, rule_id, 'legalRisk' AS kind, off AS start, off + length(line) AS "end", line AS original, NULL AS replacement FROM r JOIN lo ON lo.doc_id = r.doc_id AND lo.pos = r.pos),
fl AS (SELECT doc_id, 'local-grammar' AS rule_id, 'local' AS kind, off + instr(line, 'harus harus') - 1 AS start, off + instr(line, 'harus harus') + 10 AS "end", 'harus harus' AS original, 'harus' AS replacement FROM lo WHERE contains(line, 'harus harus')
  UNION ALL SELECT doc_id, 'local-missing', 'local', off + instr(line, '[') - 1, off + instr(line, ']'), regexp_extract(line, '\\[[A-Z][A-Z0-9_ /-]{{2,60}}\\]', 0), NULL FROM lo WHERE regexp_matches(line, '\\[[A-Z][A-Z0-9_ /-]{{2,60}}\\]')),
al AS (SELECT * FROM ft UNION ALL SELECT * FROM fr UNION ALL SELECT * FROM fl),
oo AS (SELECT *, coalesce(list_position(['defined-term-conflicting-definition', 'legal-risk-modal-negation-conflict', 'legal-risk-condition-exception-conflict', 'legal-risk-unilateral-termination-no-notice'], rule_id), 0) AS prio FROM al),
ok AS (SELECT *, row_number() OVER (PARTITION BY doc_id, prio > 0 ORDER BY prio, start, "end") AS k FROM oo)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start, "end" - start, rule_id) AS number, rule_id, kind, start::INT AS start, "end"::INT AS "end", original, replacement,
  CASE WHEN prio = 0 THEN 'flagged' WHEN k <= 8 THEN CASE WHEN length(original) % 2 = 0 THEN 'flagged' ELSE 'dismissed' END ELSE 'uncertain' END AS disposition, CASE WHEN prio > 0 AND k <= 8 THEN 'model' ELSE 'deterministic' END AS origin FROM ok
"""


@query(_review_sql())
def document_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole review of every contract: terms, risks and local findings by place; a stand-in reviewer decides on the first eight risks."""
    from glossa.operators import document_review as review

    def stand_in(asked: DataFrame) -> DataFrame:
        return asked.select("doc_id", "finding", F.when(F.length("original") % 2 == 0, "flag").otherwise("dismiss").alias("decision"))

    return review.review(contracts(spark, sf_dir), Scratch(spark, "review"), stand_in)
