"""The pipeline against a plain version of its stages, on the smallest tables."""

import corpus_pipeline
from corrolink.llm import common, pii, quality, sentencepiece_codec

from .test_operators import brute_clusters, brute_contamination


def test_pipeline_equals_plain_version(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    model = quality.train(docs, common.table(spark, sf_dir, "labels"))
    rows = [(r["doc_id"], r["text"]) for r in quality.scored(docs, model, ["doc_id", "text"]).where(f"_score >= {quality.CUT}").collect()]
    clusters = brute_clusters(rows)
    rows = [(i, t) for i, t in rows if clusters[i][1] == i]
    items = [(r["item_id"], r["text"]) for r in common.table(spark, sf_dir, "benchmark").collect()]
    found = brute_contamination(rows, items)
    rows = [(i, pii.redact(t, pii.find(t))) for i, t in rows if not found[i][4]]
    codec = sentencepiece_codec.Codec(sentencepiece_codec.Vocabulary.load(sentencepiece_codec.MODEL))
    want = {i: codec.encode(t).ids for i, t in rows}
    got = {r["doc_id"]: r["nbest_ids"][0] for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want and 0 < len(got) < docs.count()


def test_stages_keep_the_columns(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").limit(20)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name
