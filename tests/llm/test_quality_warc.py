import random

from compare import compare

from turfline.llm import quality, queries, warc


def test_held_out_quality(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality.classify(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good, bad = [x for x in got if x.quality == 1], [x for x in got if x.quality == 0]
    assert sum(x.kept for x in good) >= 0.98 * len(good)
    assert sum(not x.kept for x in bad) >= 0.9 * len(bad)


def test_posterior_against_brute_force(spark):
    r = random.Random(6)
    rows = [(k, f"h{r.randrange(4)}", f"p{r.randrange(3)}", r.random()) for k in range(300)] + [(300, "alone", "p0", 0.5)]
    frame = spark.createDataFrame(rows, "doc_id long, __host string, __path string, __evidence double")
    sites = quality.sites_of(frame)
    got = {x.doc_id: x for x in quality._posterior(frame, sites).collect()}
    mean = sum(x[3] for x in rows) / len(rows)
    for doc, host, path, p in rows:
        h = [x[3] for x in rows if x[1] == host]
        q = [x[3] for x in rows if x[1:3] == (host, path)]
        hm = (sum(h) - p + sites.host_strength * mean) / (len(h) - 1 + sites.host_strength)
        pm = (sum(q) - p + sites.path_strength * hm) / (len(q) - 1 + sites.path_strength)
        odds = p / (1 - p) * pm / (1 - pm) / mean * (1 - mean)
        assert abs(got[doc]["__score"] - odds / (1 + odds)) < 1e-9


def test_odd_documents(spark):
    rows = [(1, None, None, None), (1, None, None, None), (None, "a b c", "s", "x"), (2, "#" * 5000, "s", "y"), (3, "w " * 30000, "t", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, kept string")
    labels = spark.createDataFrame([(2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    assert quality.classify(docs, labels).where("kept").count() == 5  # labels of one kind only
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.keep_good(docs, labels).count() == 5
    assert quality.classify(docs.limit(0), labels).count() == 0
    d = "/root/testdata/sf0.001"
    whole, known = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    kept = {x.doc_id for x in quality.classify(whole, known).where("kept").collect()}
    assert {x.doc_id for x in quality.keep_good(whole, known).collect()} == kept


def test_warc_sql_agrees(spark):
    d = "/root/testdata/sf0.01"
    assert compare(spark, queries.op3_warc_revisits, queries.SQL["op3_warc_revisits"], d) > 0
    outcomes = {x.outcome for x in queries.op3_warc_revisits(spark, d).select("outcome").distinct().collect()}
    assert outcomes == {"resolved", "changed", "unverified", "no_response"}


def test_revisits_against_brute_force(spark):
    r = random.Random(8)
    urls = [("http://A.com", "http://a.com/"), ("http://a.com:80/#f", "http://a.com/"), ("HTTPS://u@b.org:443/x?y=1", "https://b.org/x?y=1"), ("https://b.org/X", "https://b.org/X"), ("http://c.net?q", "http://c.net/?q")]
    rows = []
    for k in range(400):
        kind = r.choice(["response", "revisit"])
        url, canonical = r.choice(urls + [urls[0]] * 6)
        rows.append((f"{k:04}", kind, url, canonical, float(r.randrange(60)), r.choice(['"a"', '"b"', None])))
    frame = spark.createDataFrame([(a, b, c, t, {"ETag": e, "X-New": a} if e else {"X-New": a}, 1) for a, b, c, _, t, e in rows], "record_id string, kind string, url string, ts double, headers map<string,string>, outcome int")
    got = {x.record_id: x for x in warc.resolve_revisits(frame.repartition(3)).collect()}
    assert len(got) == sum(x[1] == "revisit" for x in rows)
    for a, kind, _, canonical, t, e in rows:
        if kind == "revisit":
            earlier = max(((x[4], x[0], x[5]) for x in rows if x[1] == "response" and x[3] == canonical and x[4] < t), default=None)
            want = "no_response" if not earlier else "unverified" if not e or not earlier[2] else "resolved" if e == earlier[2] else "changed"
            x = got[a]
            assert (x.canonical_url, x.response_id, x.outcome) == (canonical, earlier and earlier[1], want)
            assert x.headers["x-new"] == a


def test_odd_captures(spark):
    kinds = "record_id string, kind string, url string, ts double, headers map<string,string>"
    rows = [
        ("1", "response", "http://a/", 1.0, {"ETag": "W/x", "CONTENT-type": "t", "content-Type": "last", "Old": "1"}),
        ("2", "revisit", "http://a/", 2.0, {"etag": "x", "Content-Type": "no", "New": "2"}),
        ("3", "revisit", None, 2.0, None), ("4", "revisit", "no url", 2.0, {}), ("5", "revisit", "http://a/", None, None), ("6", "other", "http://a/", 1.5, None),
        (None, "revisit", "http://a/", 1.0, None), ("2", "revisit", "http://a/", 2.0, {"etag": "x", "Content-Type": "no", "New": "2"}), ("7", "response", None, 1.9, None),
    ]
    got = warc.resolve_revisits(spark.createDataFrame(rows, kinds)).collect()
    assert sorted((x.record_id or "", x.outcome) for x in got) == [("", "no_response"), ("2", "resolved"), ("2", "resolved"), ("3", "no_response"), ("4", "no_response"), ("5", "no_response")]
    merged = next(x.headers for x in got if x.record_id == "2")
    assert merged.pop("content-type") in ("t", "last")  # a map has no order to tell which is last
    assert merged == {"etag": "x", "old": "1", "new": "2"}
    assert warc.resolve_revisits(spark.createDataFrame([], kinds)).count() == 0
