"""Queries opN_<name> of this subpackage with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import common
from glossa.session import Query, Scratch, table


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm import secrets as s

    scratch = Scratch(spark, "op1")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = scratch.cut(s.update_ledger(docs), "ledger")
    found = s.join_back(docs, ledger, scratch)

    def count(kind: str) -> F.Column:
        return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base, spans = s.span_list(F.col("findings"), True), s.span_list(F.col("findings"), False)
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm import packing

    return packing.pack_documents(table(spark, sf_dir, "documents"), common.public_path("word_bpe_49k.json"), end_id=2, window=4096)


def op7_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from glossa.llm import prefix_bpe

    docs = table(spark, sf_dir, "documents")
    return prefix_bpe.encode_documents(docs, common.public_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


QUERIES: dict[str, Query] = {
    "op1_secret_scans": op1_secret_scans,
    "op3_packing": op3_packing,
    "op7_prefix_bpe": op7_prefix_bpe,
}

ORACLES: dict[str, str] = {}


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm import sketch_join

    return sketch_join.jaccard_join(table(spark, sf_dir, "documents"), words=5, percent=75)


QUERIES["op10_jaccard_join"] = op10_jaccard_join


def op9_neural_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm import neural_lm

    return neural_lm.score_documents(table(spark, sf_dir, "documents"))


QUERIES["op9_neural_lm"] = op9_neural_lm


def op5_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm import nn_descent

    return nn_descent.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


QUERIES["op5_nn_descent"] = op5_nn_descent


#: A document is rejected below this posterior: clean documents come before a few more rejections.
KEEP_FROM = 0.3


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm import quality

    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=KEEP_FROM)


QUERIES["op2_quality"] = op2_quality


def op6_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm import posting_lists

    return posting_lists.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


QUERIES["op6_posting_lists"] = op6_posting_lists


#: For reports and tests; a deployment passes its own secret.
PSEUDONYM_KEY = "glossa-demo-key"


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm import pseudonyms as p

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return p.pseudonymise(docs, key=PSEUDONYM_KEY)


QUERIES["op4_pseudonyms"] = op4_pseudonyms


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm import tool_calls

    return tool_calls.link(tool_calls.events_of(table(spark, sf_dir, "conversations")), tool_calls.TURN_SCHEMAS)


QUERIES["op8_tool_calls"] = op8_tool_calls


#: SQL that compares all pairs or follows links: for small tables, as oracles are run.
ORACLES["op5_nn_descent"] = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e)) / sqrt(list_inner_product(b.e, b.e)) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""

ORACLES["op8_tool_calls"] = """
WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, CASE WHEN role = 'assistant' AND turn >= 1 THEN 'result' WHEN role = 'assistant' THEN 'message' ELSE 'call' END AS kind FROM conversations),
e AS (SELECT *, CASE kind WHEN 'result' THEN 't' || (turn - 1) WHEN 'call' THEN 't' || turn END AS call_id FROM m),
i AS (SELECT conv_id, call_id, count_if(kind = 'call') AS calls, count_if(kind = 'result') AS results, min(CASE WHEN kind = 'call' THEN turn END) AS call_turn, min(CASE WHEN kind = 'result' THEN turn END) AS result_turn FROM e GROUP BY 1, 2)
SELECT conv_id, turn, kind, call_id, turn AS place, '' AS errors,
  CASE kind WHEN 'call' THEN CASE WHEN calls > 1 THEN 'duplicate' WHEN results = 0 THEN 'unanswered' ELSE 'ok' END WHEN 'result' THEN CASE WHEN calls = 0 THEN 'orphan' WHEN results > 1 THEN 'duplicate' ELSE 'ok' END ELSE 'ok' END AS status,
  CASE kind
    WHEN 'call' THEN '{"arguments":{"role":' || to_json(role) || ',"text":' || to_json(text) || ',"turn":' || turn || '},' || CASE WHEN turn >= 2 THEN '"depends_on":"t' || (turn - 2) || '",' ELSE '' END
      || '"id":"' || call_id || '","name":"respond",' || coalesce('"result_turn":' || result_turn || ',', '') || '"turn":' || turn || ',"type":"call"}'
    WHEN 'result' THEN '{' || coalesce('"call_turn":' || call_turn || ',', '') || '"content":' || to_json(text) || ',"id":"' || call_id || '","turn":' || turn || ',"type":"result"}'
    ELSE '{"content":' || to_json(text) || ',"turn":' || turn || ',"type":"message"}' END AS json
FROM e LEFT JOIN i USING (conv_id, call_id)
"""

ORACLES["op10_jaccard_join"] = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS x FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) AS u(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) LEFT JOIN n USING (doc_id)
"""


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm import importance

    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES["op13_importance"] = op13_importance

#: crc32 has no function here: a table of its 256 steps, then one step a byte over the distinct words.
ORACLES["op13_importance"] = r"""
WITH steps AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) AS r(i)),
d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
dw AS (SELECT k, unnest(ws) AS w FROM d), bw AS (SELECT unnest(ws) AS w FROM b),
v AS (SELECT DISTINCT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
c AS (SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda i: ('0x' || h[i:i + 1])::BIGINT)), lambda a, x: xor(t[xor(a % 256, x) + 1], a // 256))) % 10000 AS bucket FROM v, steps),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN c USING (w) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM bw JOIN c USING (w) GROUP BY 1),
n AS (SELECT (SELECT count(*) FROM dw) AS S_all, (SELECT count(*) FROM bw) AS T_all),
g AS (SELECT s.bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (S_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (T_all + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), n),
q AS (SELECT k, floor(sum(gain) / count(*)::DOUBLE)::BIGINT AS weight FROM dw JOIN c USING (w) JOIN g USING (bucket) GROUP BY 1),
f AS (SELECT k, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN q USING (k)),
r AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id, k) AS rank, count(*) OVER () AS able FROM f WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * able // 100 THEN rank END AS rank FROM f LEFT JOIN r USING (k)
"""


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm import alignment

    docs = table(spark, sf_dir, "documents")
    return alignment.align_documents(docs, common.public_path("byte_bpe_50k.json"), common.public_path("piece_bpe_32k.model"), with_groups=False)


QUERIES["op11_alignment"] = op11_alignment


def op12_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm import html_consensus

    return html_consensus.main_texts(table(spark, sf_dir, "pages"))


QUERIES["op12_html_consensus"] = op12_html_consensus
