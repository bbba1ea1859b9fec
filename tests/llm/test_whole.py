"""Corpus operators beyond the sizes of the given tables."""

import gzip
import io

import pytest

import __spark_entry__
from corrolink.llm import chat, common, sentencepiece_codec, warc

from . import cases


def test_warc_reads_headers_of_any_length(spark):
    urls = ["u", "é" * 30_000, "data:," + "x" * 3_000_000, "v"]
    data = b"".join(warc.record_bytes(i, u, b"p%d" % i, None) for i, u in enumerate(urls))
    for step in (1000, len(data)):
        got = [r for s in range(0, len(data), step) for r in warc.records_in(io.BytesIO(data), s, min(s + step, len(data)))]
        assert [(r.headers["warc-record-id"], r.payload) for r in got] == [(f"<urn:page:{i}>", b"p%d" % i) for i in range(4)]
        assert [r.headers["warc-target-uri"] for r in got] == [warc._target(u, i) for i, u in enumerate(urls)]
    pages = spark.createDataFrame([(i, u, f"p{i}") for i, u in enumerate(urls)], "page_id long, url string, html string")
    manifest = warc.write_archives(pages, common.scratch(spark, "warc"))
    read = warc.read_archives(warc.splits(manifest, 500), 3)
    assert warc.checked_count(read, manifest).count() == 4
    with pytest.raises(ValueError, match="3 records were read of 4"):
        warc.checked_count(read.where("record_id <> 'urn:page:1'"), manifest)


def test_warc_reader_skips_heads_that_do_not_end():
    good = warc.record_bytes(1, "u", b"p", None)
    data = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\n" + b"a: b\r\n" * 50_000) + gzip.compress(b"WA") + gzip.compress(b"") + good
    assert [r.payload for r in warc.records_in(io.BytesIO(data), 0, len(data))] == [b"p"]
    cut = good + gzip.compress(b"WARC/1.1\r\n" + b"a: b\r\n" * 50_000)[:-9]
    assert [r.payload for r in warc.records_in(io.BytesIO(cut), 0, len(cut))] == [b"p"]


def test_chat_renders_true_prefixes_of_black_boxes():
    turns = [("assistant" if i % 2 else "user", f"t{i}") for i in range(601)]

    def numbered(said):
        if said and said[0] != turns[0]:
            raise ValueError("the first turn is missing")
        return "".join(f"{k} {role}: {text}\n" for k, (role, text) in enumerate(said))

    out = chat.render(numbered, turns)
    assert out.rewritten_at is None
    assert [out.text[s:e] for s, e in out.spans] == [f"{k} {role}: {text}\n" for k, (role, text) in enumerate(turns)]
    assert chat.render(chat.chatml, turns) == chat.render(lambda said: chat.chatml(said), turns)


def test_encoding_gives_ids_of_all_segmentations(spark, sf_dir):
    codec = sentencepiece_codec.Codec(sentencepiece_codec.Vocabulary.load(sentencepiece_codec.MODEL))
    docs = cases.documents(spark)
    for rows in (sentencepiece_codec.encoded(docs).collect(), sentencepiece_codec.encode_stage(spark, docs, sf_dir).collect()):
        texts = {r["doc_id"]: r["text"] for r in docs.collect()}
        for r in rows:
            t = texts[r["doc_id"]]
            if t is None:
                assert r["nbest_ids"] is None
                continue
            assert len(r["nbest_ids"][0]) == r["n_pieces"] and len(r["nbest_ids"]) == len(r["nbest_scores"])
            assert len(set(map(tuple, r["nbest_ids"]))) == len(r["nbest_ids"]) and all(codec.decode(s) == t for s in r["nbest_ids"])
        assert max(len(r["nbest_ids"] or []) for r in rows) == sentencepiece_codec.N_BEST


def test_near_passages_are_reported_over_the_whole_table(spark, tmp_path):
    said = [f"word{i}" for i in range(40)]
    near = " ".join(w + (" zz" if i % 5 == 4 else "") for i, w in enumerate(said))
    docs = [(1, near), (2, "nothing of it"), (3, " ".join(said)), (4, None), (1, near)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, " ".join(said))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    run = lambda q: __spark_entry__.queries()[q](spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["contaminated"]) for r in run("op10_decontam")) == [(1, False), (1, False), (2, False), (3, True), (4, False)]
    got = sorted((r["doc_id"], r["n_near"], r["near_items"] or []) for r in run("op10_proximity"))
    assert got == [(1, 1, [7]), (1, 1, [7]), (2, 0, []), (3, 1, [7]), (4, 0, [])]
