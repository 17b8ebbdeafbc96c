import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.operators import corpus as c
from glossa.sources import documents as d
from glossa.sources import tables as s
from glossa.streaming import review as r


def test_jsonl_views_and_manifest(spark, tmp_path):
    (tmp_path / "dictionary_primary.jsonl").write_text('{"definition_id":"d1","term":"T"}\n\n{"definition_id":"d2","term":"U","source_record_ids":["a"]}\n')
    with pytest.raises(FileNotFoundError, match="regulations"):
        s.read_view(spark, f"file://{tmp_path}", "dictionary-serving")
    for name in ("dictionary_regulation_relations", "definition_passage_links", "regulation_passages"):
        (tmp_path / f"{name}.jsonl").write_text("")
    (tmp_path / "dictionary_regulations.jsonl").write_text('{"regulation_id":"r1","in_force":true}\n')
    tables = s.read_view(spark, f"file://{tmp_path}", "dictionary-primary")
    assert tables["definitions"].count() == 2
    found = s.manifest(tables, 3)
    assert s.check_manifest(found, tables, 3) == []
    assert s.check_manifest(found, tables, 4) == ["schema version 3 is not 4"]
    other = dict(tables, regulations=tables["regulations"].withColumn("year", F.lit(1)))
    assert s.check_manifest(found, other, 3) == ["regulations has other content"]
    with pytest.raises(ValueError):
        s.read_view(spark, str(tmp_path), "nothing")


def test_csv_keeps_quotes_and_line_breaks_and_filters_status(spark, tmp_path):
    (tmp_path / "g.csv").write_bytes('﻿Term,Definition,Status\r\n"a ""b""","x\ny",verified\r\nc,d,OK\r\ne,f,\r\ng,h,REJECTED\r\n'.encode())
    rows = {x.term: (x.definition, x.authority) for x in s.read_glossary_csv(spark, str(tmp_path / "g.csv")).collect()}
    assert rows == {'a "b"': ("x\ny", "verified"), "c": ("d", "legacy"), "e": ("f", "legacy")}


def test_half_floats(spark, tmp_path):
    x = np.array([[0.5, -2.0], [np.inf, 6e-8]], "<f2")
    (tmp_path / "v.bin").write_bytes(x.tobytes())
    rows = s.read_half_floats(spark, str(tmp_path / "v.bin"), 2).orderBy("row").collect()
    assert [list(np.float32(r.v)) for r in rows] == x.astype(np.float32).tolist()
    with pytest.raises(Exception, match="rows of 3"):
        s.read_half_floats(spark, str(tmp_path / "v.bin"), 3).count()


def test_sorted_json_sink_and_upsert(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "id int, a string")
    s.write_json(df, str(tmp_path / "out"), "id")
    lines = [json.loads(x) for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == [{"a": "a", "id": 1}, {"a": "b", "id": 2}]
    after = s.upsert(spark, df, spark.createDataFrame([(2, "c"), (3, "d")], df.schema), spark.createDataFrame([(1,)], "id int"), "id")
    assert sorted(map(tuple, after.collect())) == [(2, "c"), (3, "d")]


def test_html_and_files(spark, tmp_path):
    html = "<html><head><title>t</title></head><body><h1>A  b</h1><p>x &amp; <b>y</b><br>z</p><ul><li>one<li>two</ul><script>no()</script></body></html>"
    assert d.to_markdown(html) == "# A b\nx & y\nz\n- one\n- two"
    (tmp_path / "a.html").write_text(html)
    (tmp_path / "b.txt").write_bytes("﻿déjà\xff".encode("utf-8")[:-2] + b"\xff")
    rows = {x.path[-6:]: x.text for x in d.read_documents(spark, str(tmp_path)).collect()}
    assert rows["a.html"].startswith("# A b") and rows["/b.txt"] == "déjà�"


def test_pack_build(spark):
    definitions = spark.createDataFrame([("d1", "T"), ("d2", "U")], "definition_id string, term string")
    links = spark.createDataFrame(
        [("l1", "d1", "p1", "r1", 1, True), ("l1", "d1", "p2", "r1", 2, True), ("l2", "d1", "p9", "r1", 3, True), ("l3", "d2", "p2", "r2", 1, None)],
        "link_id string, definition_id string, passage_id string, regulation_id string, position int, verified boolean",
    )
    passages = spark.createDataFrame([("p1", "text", 1, False), ("p2", " ", 2, None)], "passage_id string, text string, page_start int, requires_ocr boolean")
    regulations = spark.createDataFrame([("r1", True), ("r2", True), ("r3", False), ("r4", True)], "regulation_id string, in_force boolean")
    relations = spark.createDataFrame([("e1", "r1", "r3"), ("e2", "r3", "r4"), ("e3", "r1", "r1")], "relation_id string, source_id string, target_id string")
    pack = c.build_pack(definitions, links, passages, regulations, relations)
    concepts = {r.definition_id: r for r in pack["concepts"].collect()}
    assert concepts["d1"].actionable and not concepts["d2"].actionable and [e.passage_id for e in concepts["d1"].evidence] == ["p1"]
    assert sorted(r.regulation_id for r in pack["regulations"].collect()) == ["r1", "r2", "r3"]
    assert sorted(r.relation_id for r in pack["relations"].collect()) == ["e1", "e3"]
    old = spark.createDataFrame([("T", "x", [1.0]), ("T", "y", [2.0]), ("U", "z", [3.0])], "term string, definition string, v array<double>")
    now = spark.createDataFrame([("1", "T", "y"), ("2", "T", "n"), ("3", "U", "n")], "definition_id string, term string, definition string")
    assert {r.definition_id: r.v for r in c.reuse_vectors(now, old).collect()} == {"1": [2.0], "2": None, "3": [3.0]}


def test_streams(spark, tmp_path):
    schema = "run long, seg long, failed boolean, v double"
    source = tmp_path / "in"
    rows = [(k % 2, k, k < 8 and k % 2 == 0, float(k)) for k in range(20)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source))
    stream = r.segment_stream(spark, str(source), schema)
    q = r.publish(stream, lambda b: b.select("seg", (F.col("v")).alias("r")), lambda b: b.where("seg % 2 = 0").select("seg", (F.col("v") + 100).alias("r")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {x.seg: x.r for x in r.settled(spark, str(tmp_path / "out"), "seg").collect()}
    assert got == {k: float(k) + (100 if k % 2 == 0 else 0) for k in range(20)}
    q = r.breaker(stream, "run", "seg", "failed").writeStream.format("memory").queryName("plain").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    plain = {(x.run, x.seg): x.deterministic for x in spark.table("plain").collect()}
    assert plain == {(k % 2, k): k % 2 == 0 and k >= 8 for k in range(20)}
    q = r.save_latest(stream, "run", "seg", str(tmp_path / "draft"), str(tmp_path / "cp3"))
    q.awaitTermination(120)
    assert sorted(x.seg for x in spark.read.parquet(str(tmp_path / "draft")).collect()) == [18, 19]


def test_bundles_revisions_and_packages(spark, tmp_path):
    (tmp_path / "docs.json").write_text('[{"term":"a"},{"term":"b"}]')
    (tmp_path / "meta.json").write_text('{"count": 2}')
    assert s.read_bundle(spark, str(tmp_path / "docs.json"), str(tmp_path / "meta.json"), "term string", "term").count() == 2
    (tmp_path / "meta.json").write_text('{"count": 3}')
    with pytest.raises(ValueError, match="3 told"):
        s.read_bundle(spark, str(tmp_path / "docs.json"), str(tmp_path / "meta.json"), "term string", "term")
    assert s.choose_revision("p", {"dataset_revision": "s"}, "c") == ("p", "pinned")
    assert s.choose_revision(None, {"dataset_revision": "s"}, "c") == ("s", "sidecar")
    assert s.choose_revision(None, None, "c" * 64) == ("c" * 16, "content")
    kinds = "fixture_id long, revision int"
    f = spark.createDataFrame([(1, 1)], kinds)
    s.export_package(f, f, f"file://{tmp_path}/p", "fixture_id")
    f.union(f).write.mode("overwrite").json(f"file://{tmp_path}/p/reviews")
    with pytest.raises(ValueError, match="reviews has 2 rows"):
        s.load_package(spark, f"file://{tmp_path}/p", kinds, kinds)
