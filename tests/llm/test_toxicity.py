import itertools
import random
import zlib

import numpy as np

from turfline.llm import queries, toxicity


def slow_segments(scores):
    """All maximal scoring segments by their definition: positive, no better part, in no larger one like it."""
    n = len(scores)
    sums = [0, *itertools.accumulate(scores)]

    def fine(a, z):
        return all(sums[k] > sums[a] for k in range(a + 1, z + 1)) and all(sums[k] < sums[z] for k in range(a, z))

    good = [(a, z) for a in range(n) for z in range(a + 1, n + 1) if fine(a, z)]
    return sorted((a, z) for a, z in good if not any((b, y) != (a, z) and b <= a and z <= y for b, y in good))


def test_segments_against_their_definition():
    r = random.Random(2)
    for _ in range(300):
        scores = np.array([r.choice([-3, -2, -1, -1, 1, 2, 3]) for _ in range(r.randint(0, 25))], float)
        got = toxicity.maximal_segments(scores)
        assert [(a, z) for a, z, _ in got] == slow_segments(scores.tolist())
        assert all(s == scores[a:z].sum() for a, z, s in got)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = queries.op7_toxic_segments(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic, clean = [x for x in got if x.toxic == 1], [x for x in got if x.toxic == 0]
    assert sum(x.predicted for x in toxic) >= 0.9 * len(toxic)
    assert sum(x.predicted for x in clean) <= 0.01 * len(clean)


def test_contract_columns(spark):
    d = "/root/testdata/sf0.001"
    got = queries.op7_toxic_segments(spark, d).collect()
    assert len(got) == 200
    for x in got:
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0)
        assert 0 <= x.score <= 1 and x.predicted == (x.score >= 0.5)


def test_odd_rows_and_segments(spark):
    r = random.Random(3)
    plain = lambda: " ".join(r.choices([f"w{k}" for k in range(50)], k=40))
    rows = [(k, plain() + (" Vile, vile wretch " if k % 4 == 0 else " ") + plain(), 0.5) for k in range(200)] + [(None, "vile vile wretch", 0.1), (300, None, 0.1), (301, "", 0.1), (7, plain(), 1.0), (7, plain(), 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)] + [(None, 1), (5, None), (9999, 1)], "doc_id long, toxic int")
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == len(rows)
    for x in got:
        if x.doc_id is not None and x.doc_id < 200 and x.doc_id != 7:
            assert x.predicted == (x.doc_id % 4 == 0)
            text = rows[x.doc_id][1].encode()
            assert [text[s.start : s.end] for s in x.segments] == ([b"Vile, vile wretch"] if x.predicted else [])
    assert [x.predicted for x in got if x.doc_id is None] == [1]
    assert [x.predicted for x in got if x.doc_id in (300, 301)] == [0, 0]
    assert toxicity.classify(docs, labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.classify(docs.limit(0), labels).count() == 0
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(str(x.doc_id) for x in kept.collect()) == sorted(str(x[0]) for x in rows if x[0] is not None and (x[0] >= 200 or x[0] % 4))


def test_labels_without_signal_drop_nothing(spark):
    words = [f"word{k}" for k in range(30)]
    for toxic in (20, 30, 39):
        rows = [(k, " ".join(words[(k * j) % 30] for j in range(1, 12)) if k else "") for k in range(40)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        labels = spark.createDataFrame([(k, int((k * 7) % 40 < toxic)) for k in range(40)], "doc_id long, toxic int")
        assert toxicity.drop_toxic(docs, labels).count() == 40
        model = toxicity.fit(toxicity.training_rows(docs, labels))
        assert model.judge(b"")[0] < 0.5 and model.judge(b"nothing known here")[0] < 0.5


def test_a_toxic_majority_leaves_clean_texts(spark):
    clean = [(k, f"a quiet text number {k} about gardens and rain") for k in range(90)]
    bad = [(100 + k, f"a text number {k} you vile wretched swine vile wretch swine about rain") for k in range(180)]
    docs = spark.createDataFrame(clean + bad + [(500, ""), (501, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(d, int(d >= 100)) for d, _ in clean + bad], "doc_id long, toxic int")
    assert {x.doc_id for x in toxicity.drop_toxic(docs, labels).collect()} == {d for d, _ in clean} | {500, 501}
