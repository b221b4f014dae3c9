import random
import zlib

from compare import compare

from turfline.llm import queries, sharding, urls

SMALL = "/root/testdata/sf0.001"


def test_sql_agrees(spark):
    for name in ("op4_rendezvous_sharding", "op10_url_rules"):
        assert compare(spark, queries.QUERIES[name], queries.SQL[name], SMALL) > 0


def test_shards_of_odd_rows(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "é"), (None, None), (2, ""), *[(7, "copy")] * 50]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, slot string")
    got = sharding.shard_documents(docs, 3).collect()
    assert sorted((x.doc_id or 0, x.size, x.text_crc32) for x in got) == sorted((d or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    for shard in range(3):
        mine = [x.slot for x in got if x.shard == shard]
        assert sorted(mine) == list(range(len(mine)))
    assert all(x.grown_shard in (x.shard, 3) for x in got)
    assert len({x.shard for x in got if x.doc_id == 7}) == 1
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_weights_share_the_keys(spark, monkeypatch):
    monkeypatch.setattr(sharding, "_BLOCK", 3)
    docs = spark.range(4000).selectExpr("id AS doc_id", "'t' AS text")
    counts = {x["shard"]: x["count"] for x in sharding.shard_documents(docs, 2, [1.0, 3.0]).groupBy("shard").count().collect()}
    assert abs(counts[1] / 4000 - 0.75) < 0.03


def expected(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host) :].split("?", 1)[0].split("#", 1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def test_nested_rules_against_brute_force(spark):
    r = random.Random(9)
    label = lambda: r.choice(["a", "b", "c", "com", "net", "aa"])
    host = lambda n: ".".join(label() for _ in range(r.randint(1, n)))
    rules = sorted({(host(3), r.choice(["", "/", "/x", "/x/y", "/z"])): r.choice(["allow", "block"]) for _ in range(60)}.items())
    rules = [(v, h, p) for (h, p), v in rules]
    pages = [(k, f"{r.choice(['http', 'HTTPS'])}://{host(5).upper()}{r.choice(['', '/', '/x/y/w?q#f', '/z#/x', '?x=/y', '/xé'])}") for k in range(300)]
    pages += [(900, None), (901, ""), (902, "no scheme/x"), (903, "http://"), (904, "x://a://com/x"), (905, "http://.com/x"), (906, "http://com./x"), (3, pages[3][1]), (None, "http://a.com/")]
    frame = spark.createDataFrame([(k, u, "z") for k, u in pages], "page_id long, url string, host string")
    got = sorted(((x.page_id is None, x.page_id or 0), x.host, x.path, x.rule or "", x.verdict) for x in urls.judge(frame.repartition(3), rules).collect())
    want = sorted(((k is None, k or 0), h, p, rule or "", v) for k, u in pages for h, p, rule, v in [expected(u, rules)])
    assert got == want
    assert urls.judge(frame, []).where("verdict != 'allow'").count() == 0
    assert urls.judge(frame.limit(0)).count() == 0
