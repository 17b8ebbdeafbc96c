import corpus_pipeline
from glossa.llm import registry
from glossa.llm.registry import KEEP_FROM
from glossa.llm import quality, secrets


def test_registry_has_the_thirteen():
    assert sorted({int(k[2:].split("_")[0]) for k in registry.QUERIES}) == list(range(1, 14))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "secret scans", "packing"]


def test_stages_hand_on_the_columns_and_decide(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    one = corpus_pipeline.keep_good(spark, docs, sf)
    assert one.schema == docs.schema
    judged = {r.doc_id for r in quality.judge(docs, labels, threshold=KEEP_FROM).where("keep").collect()}
    assert {r.doc_id for r in one.collect()} == judged
    masked = corpus_pipeline.mask_secrets(spark, docs, sf)
    assert masked.schema == docs.schema and masked.count() == docs.count()
    scanner = secrets.Scanner(secrets.RULES)
    texts = {r.doc_id: r for r in masked.collect()}
    for r in docs.collect():
        if scanner.scan(r.text or ""):
            assert "[secret]" in texts[r.doc_id].text and texts[r.doc_id].n_chars == len(texts[r.doc_id].text)
        else:
            assert texts[r.doc_id].text == r.text
    run = corpus_pipeline.run(spark, sf)
    assert run.count() > 0 and {r.doc_id for r in run.select("doc_id").distinct().collect()} <= judged
