"""Search, URL filter, archives and the pipeline."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import brute_components

import corpus_pipeline
from skysieve.llm import topk_search, url_filter, warc
from skysieve.llm.common import Scratch


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.normal(size=8) / 4], k) for k in range(700)]
    rows[50] = (50, None, 0)
    rows[51] = (51, [float("nan")] * 8, 0)
    rows[52] = (52, [None] + [0.5] * 7, 0)
    rows[60] = rows[61][:0] + (60, rows[61][1], 0)
    rows += [(None, [1.0] * 8, 0), (701, [], 0), (702, [5.0, 5.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(5)
    ok = {i: np.floor(256 * np.asarray(v, np.float32).astype(float)).astype(int) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all()}
    wide = {i: np.pad(v, (0, 8 - len(v))) for i, v in ok.items()}
    want = []
    for q in wide:
        if q % 50 == 0:
            best = sorted((-int(wide[q] @ v), i) for i, v in wide.items() if i != q)[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    for cells in (60_000, 100):
        got = topk_search.top_k(df, df.filter("vec_id % 50 = 0"), cell_vectors=cells, cell_queries=4)
        assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == sorted(want)
    none = df.limit(0)
    assert topk_search.top_k(none, none).count() == 0 and topk_search.top_k(df, none).count() == 0


def test_shard_prunes_exactly():
    rng = np.random.default_rng(2)
    m = rng.integers(-60, 60, (3000, 16))
    shard = topk_search.Shard(np.arange(3000), m, 60)
    for q in rng.integers(-60, 60, (20, 16)):
        ids, scores = shard.search(q, 7, 5)
        all_scores = m @ q
        want = [i for i in np.lexsort((np.arange(3000), -all_scores)) if i != 7][:5]
        assert ids.tolist() == want and scores.tolist() == all_scores[want].tolist()


def test_shard_with_more_results_than_a_lot():
    """The first lot holds the best, and k is larger than a lot."""
    m = np.r_[np.full((256, 1), 9), np.arange(344).reshape(-1, 1) % 8]
    ids, scores = topk_search.Shard(np.arange(600), m, 1).search(np.array([1]), -1, 300)
    want = np.lexsort((np.arange(600), -m[:, 0]))[:300]
    assert ids.tolist() == want.tolist() and scores.tolist() == m[want, 0].tolist()


URLS = [
    ("http://A.Example.ORG/es/x?q#f", "example.org/es/", "block"), ("http://example.org/en/12", "example.org/en/1", "block"), ("https://example.org/en/2", "org/", "allow"), ("https://org/", "org/", "allow"),
    ("https://x.org", None, "allow"), ("https://notexample.org/es/", "org/", "allow"), ("ftp://shop.com/de/a", "com/de/", "block"), ("ftp://shop.com/fr/a#x", "com/fr/", "allow"), ("shop.com/de/a", None, "allow"),
    ("http://com?/de/", None, "allow"), (None, None, "allow"), ("", None, "allow"), ("http://.org/a", "org/", "allow"),
]


def test_url_filter(spark):
    from skysieve.llm.queries import URL_RULES

    rules = spark.createDataFrame([*URL_RULES, ("block", None, "/"), ("block", "", "/"), URL_RULES[0]], url_filter.RULES)
    pages = spark.createDataFrame([(k, u, "x") for k, (u, _, _) in enumerate(URLS)] + [(0, URLS[0][0], "x")], "page_id long, url string, rule string")
    got = url_filter.filter_urls(pages, rules).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        assert (r.rule, r.verdict) == URLS[r.page_id][1:], URLS[r.page_id]
    assert {r.verdict for r in url_filter.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0


def test_url_filter_ties_and_long_urls(spark):
    """Of rules of one length the longer host wins, then block; long URLs, repeated and null ones are all judged."""
    rules = spark.createDataFrame([("allow", "b.org", "/a"), ("block", "org", "/abcd"[:4]), ("allow", "c.org", "/x"), ("block", "c.org", "/x"), ("block", "d.org", "/" + "p" * 3000)], url_filter.RULES)
    long = "http://" + "s." * 500 + "d.org/" + "p" * 100_000
    urls = ["http://b.org/abc", "http://c.org/x", long, "http://d.org/" + "p" * 2999, None, None, None, "http://c.org/x"]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    assert len(got) == len(urls) and got[4] == got[5] == got[6] == (None, "allow")
    assert got[0] == ("b.org/a", "allow") and got[1] == got[7] == ("c.org/x", "block")
    assert got[2] == ("d.org/" + "p" * 3000, "block") and got[3] == (None, "allow")


def test_bloom_that_is_too_small_still_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_FILTER_BYTES", 64)
    keys = [f"host{k}.org\n/p{k}" for k in range(500)]
    words = url_filter.build_filter(spark.createDataFrame([(k,) for k in keys], "key string"), len(keys))
    block, mask = url_filter._places(keys, len(words))
    assert words.nbytes == 64 and ((words[block] & mask) == mask).all()


def test_bloom_has_no_false_negatives(spark):
    keys = [f"host{k}.org\n/p{k}" for k in range(2000)]
    words = url_filter.build_filter(spark.createDataFrame([(k,) for k in keys], "key string"), len(keys))
    hit = lambda ks: ((words[(p := url_filter._places(ks, len(words)))[0]] & p[1]) == p[1]).all(axis=1)
    assert hit(keys).all() and hit([f"other{k}" for k in range(2000)]).mean() < 0.02


INNER = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Type: text/html\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


@pytest.mark.parametrize("split", ["128m", "700"])
def test_warc_round_trip(spark, split):
    rows = [(k, f"http://a/{k} x\n", f"p{k} " * (k * 7 % 50)) for k in range(20)]
    rows += [(100, "http://b", f"start {INNER} mid WARC/1.1\r\nnot a header\r\n\r\n tail"), (101, None, None), (None, "u", "same" * 40), (102, "u", "same" * 40), (103, "u", "same" * 40), (104, "z", INNER)]
    rows += [(105, "z", ""), (106, "z", "x" * 100), (107, "z", "x" * 100), (108, "z", "x" * 99), (109, "z", "x" * 99), (110, "z", "WARC/1.1\r\n" * 60 + "é")]
    first = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    want = set()
    for i, _, h in rows:
        b = (h or "").encode()
        f = first.get(h)
        again = f is not None and f != i
        want.add((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", f if again else None))
    path = Scratch(spark, "test").path("warc")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0" if split == "700" else "4m")
        got = warc.read_warc(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert len(got) == len(rows)
    assert {(int(r.id) if r.id else None, r.payload_bytes, r.payload_digest, r.type, int(r.refers_to) if r.refers_to else None) for r in got} == want
    kept = {r.id: bytes(r.payload) for r in got if r.payload is not None}
    assert kept["100"].decode() == rows[20][2]


def test_warc_takes_clashing_names_and_long_payloads(spark):
    long = "é" * 2_000_000
    rows = [(1, "u", long, "x", 1), (2, "u", long, "x", 2), (3, None, "b", "x", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, bytes int").withColumnsRenamed({"digest": "first"})
    got = {r.id: r for r in warc.round_trip(pages.withColumn("id", F.lit(7))).collect()}
    assert got[1].payload_bytes == 4_000_000 and got[2].type == "revisit" and got[2].refers_to == 1 and got[3].payload_bytes == 1
    assert got[2].payload_digest == got[1].payload_digest == hashlib.sha256(long.encode()).hexdigest()


def test_warc_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline_stages(spark, documents, tmp_path):
    spark.createDataFrame([(k, int(k % 2), 0) for k in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    text = documents.filter("doc_id = 5").first().text
    spark.createDataFrame([(1, " ".join(text.split()[:20]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    secret = spark.createDataFrame([(500, "my password: abcdefghijklmnop here and nothing else", "en", "s0", 50, "y", 1, 1)], documents.schema)
    documents.unionByName(secret).write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, Scratch(spark, "test").keep(stage(spark, docs, str(tmp_path)), "stage")
        kept[name] = docs
        if name != "mixing":
            assert docs.columns == before.columns
    ids = lambda name: {r.doc_id for r in kept[name].select("doc_id").collect()}
    assert kept["toxicity"].count() == documents.count() + 1
    near = kept["near duplicates"]
    rows = [(r.doc_id, r.text) for r in kept["toxicity"].collect()]
    first = {i for i, n, c in brute_components(rows) if n and i == c and i is not None}
    assert {r.doc_id for r in near.filter("text IS NOT NULL AND trim(text) <> ''").collect()} == first and len(first) < len({i for i, _ in rows})
    assert near.filter(F.col("text").isNull()).count() == 2
    assert 5 not in ids("decontamination") and 4 in ids("decontamination")
    row = kept["secrets"].filter("doc_id = 500").first()
    assert row.text == "my [secret] here and nothing else" and row.n_chars == len(row.text) and row.spans == "y"
    assert kept["mixing"].count() == kept["secrets"].count()


def test_pipeline_drops_toxic_rows(spark, tmp_path):
    """Rows that the stage calls toxic go, whatever else they hold; clean ones stay with all their columns."""
    import random

    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice(["tree", "house", "river", "stone"]) for _ in range(30)) + (" vilest" if k % 4 == 0 else ""), "en", "s", 1, k) for k in range(400)]
    docs = spark.createDataFrame([*rows, (None, None, None, None, None, None), rows[1]], "doc_id long, text string, lang string, source string, n_chars long, score long")
    spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == sorted([k for k in range(400) if k % 4] + [1])
    assert out.filter("doc_id IS NULL").count() == 1


def test_pipeline_on_empty_tables(spark, empty, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
