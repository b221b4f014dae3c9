import sys

import numpy as np
import public_tokenizers
from test_minhash import brute
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from turfline.llm import quality, toxicity

D = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    labels = spark.read.parquet(f"{D}/labels.parquet")
    bad = {x.doc_id for x in toxicity.classify(docs, labels).where("predicted = 1").collect()}
    clean = docs.where(~docs.doc_id.isin(list(bad))) if bad else docs
    good = {x.doc_id for x in quality.classify(clean, labels).where("kept").collect()}
    left = sorted((x.doc_id, x.text) for x in clean.collect() if x.doc_id in good)
    kept = {doc for doc, _, _, stays in brute(left) if stays}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {doc: np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4").tobytes() for doc, text in left if doc in kept}
    pieces = {}
    for x in corpus_pipeline.run(spark, D).collect():
        pieces.setdefault(x.doc_id, []).append((x.start, bytes(x.ids)))
    assert {doc: b"".join(ids for _, ids in sorted(x)) for doc, x in pieces.items()} == want
    assert 0 < len(want) < docs.count()


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(60)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, D)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs.limit(0), D).collect()


def test_entry_works_without_the_subpackage(monkeypatch):
    assert "pipeline" in __spark_entry__.queries()
    monkeypatch.setitem(sys.modules, "turfline.llm.queries", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert not any(x.startswith("op") or x == "pipeline" for x in __spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_odd_tables_go_through_all_stages(spark, tmp_path):
    kinds = "doc_id long, text string, lang string, source string, n_chars long, __x string, component long, class int"
    words = " ".join(f"word{k}" for k in range(80))
    rows = [(None, None), (None, "only words of its own " * 2), (None, words), (1, ""), (1, words), (2, words + " more"), (2, words + " more"), (3, " \n "), (3, "another text under a shared id, long enough to be read"), (4, "x" * 200_000)]
    docs = spark.createDataFrame([(d, t, None, None, None, "clash", 5, 6) for d, t in rows], kinds)
    for name, table in (("odd", docs), ("empty", docs.limit(0))):
        table.repartition(2).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int").limit(2 if name == "odd" else 0).write.parquet(f"{tmp_path}/{name}/labels.parquet")
    packed = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    whole = {(x.doc_id, x.doc_tokens) for x in packed}
    assert sum(x.doc_tokens for x in {(x.doc_id, x.doc_tokens): x for x in packed}.values()) > 0
    assert [d for d, n in whole if n == 1].count(1) == 1 and (None, 1) in whole  # blank texts stay, as the end token
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    size = lambda text: 1 + len(tokenizer.encode(text, add_special_tokens=False).ids)
    kept = [t for d, t in rows if t and (d, size(t)) in whole]
    assert sum(words in t for t in kept) >= 1 and sum((d, size(t)) in whole for d, t in {(1, words), (2, words + " more"), (None, words)}) == 1  # one of the near copies
    assert (3, size(rows[8][1])) in whole and (None, size(rows[1][1])) in whole and (4, size(rows[9][1])) in whole
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
