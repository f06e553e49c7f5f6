"""Quality classifier, URL filter, sharding, top-k and license scans against brute force, with edge rows."""

import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from statgate.llm import licenses, quality, queries, shards, topk, urls

# ----- quality -----------------------------------------------------------------


@pytest.fixture(scope="module")
def net():
    rng = random.Random(1)
    good = [" ".join("".join(rng.choice("aeinrst") for _ in range(rng.randint(2, 8))) for _ in range(80)).encode() for _ in range(80)]
    shouted = [t.upper() + b"!!" for t in good[:40]]
    mixed = [a + b + c for a, b, c in zip(good[40:], shouted, good, strict=False)]
    return quality.fit([*good, *shouted, *mixed], [1] * 80 + [0] * 80, [1.0] * 160, passes=40)


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = quality.fresh(3)
    for a in net.arrays():
        a[:] = a + rng.normal(0, 0.05, a.shape)
    texts, labels, weights = [b"some text here " * 30, b"x", b"OTHER! text?" * 50], np.array([1, 0, 1]), np.array([0.2, 0.5, 0.3])
    gradients, _ = quality._gradients(net, texts, labels, weights)
    for array, gradient in zip(net.arrays(), gradients, strict=True):
        place = np.unravel_index(np.abs(gradient).argmax(), gradient.shape)
        old, losses = array[place], []
        for sign in (1, -1):
            array[place] = old + sign * 1e-3
            losses.append(quality._gradients(net, texts, labels, weights)[1])
        array[place] = old
        assert (losses[0] - losses[1]) / 2e-3 == pytest.approx(gradient[place], rel=0.15, abs=2e-3)


def test_score_covers_whole_texts(net):
    clean = b"reinst trense aria stin sean rit " * 6000
    spoiled = clean + b"REINST!! TRENSE!! ARIA!! " * 20
    assert quality.probabilities(net, [clean])[0] > 0.7 > 0.3 > quality.probabilities(net, [spoiled])[0]
    texts = [clean, b"", b"a", spoiled, clean[:70_000]]
    together = quality.probabilities(net, texts)
    assert np.allclose(together, [quality.probabilities(net, [t])[0] for t in texts], atol=1e-5)


def test_score_frame(spark, net):
    rows = [(1, "reinst trense"), (1, "reinst trense"), (None, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    got = quality.score(docs, net).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "4", "None"] and all(0 <= r.score <= 1 for r in got)
    assert quality.score(docs.limit(0), net).count() == 0
    passed = quality.accepted(docs, net, 0.0)
    assert passed.columns == docs.columns and passed.count() == 4
    assert quality.accepted(docs, net, 1.1).count() == 0


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    net = quality.fit_on(docs, labels)
    scored = quality.score(docs, net).join(labels, "doc_id").where(quality.held_out())
    rows = scored.select("score", "quality").collect()
    assert len(rows) > 500
    right = sum((r.score >= 0.7) == (r.quality == 1) for r in rows)
    assert right / len(rows) > 0.97
    lost = sum(r.score < 0.7 for r in rows if r.quality == 1) / sum(r.quality == 1 for r in rows)
    assert lost < 0.01


def test_held_out_labels_are_never_read(spark):
    rows = [(i, f"text {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 == 2]
    labels = spark.createDataFrame([(i, 0) for i in held] + [(None, 0), (99, None)], "doc_id long, quality int")
    net = quality.fit_on(docs, labels)
    assert not net.out.any()  # nothing to learn from


# ----- urls ----------------------------------------------------------------------

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/es/", "block"), (None, "/", "block"), ("a.b", "", "block")]


def brute_verdict(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_judge(spark):
    found = [
        None, "", "no scheme", "http://", "http://COM", "http://Example.COM/en/1?x=http://a", "https://www.example.com/en/", "http://notexample.com/en/x",
        "ftp://m.www.example.com/en/a#b", "http://x.net/es/", "http://x.net/es", "http://net/es/\nnew", "http://a.b?q", "http://ÄÖ.net/es/ü", "x://y://net/es/",
        "http://.com/", "http://" + "a." * 3000 + "com/" + "b" * 50_000, "http://x.net/es/", "http://x.net/es/",
    ]
    pages = spark.createDataFrame([(i if i % 5 else None, u) for i, u in enumerate(found)], "page_id long, url string").withColumn("host", F.lit("clash"))
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = urls.judge(pages, rules).collect()
    expected = [(str(i if i % 5 else None), *map(str, brute_verdict(u))) for i, u in enumerate(found)]
    assert sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in got) == sorted(expected)
    assert urls.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_filter_has_no_false_negatives_and_few_positives(spark):
    listed = [f"host{i}.org\t/p{i}" for i in range(3000)]
    words = urls.build_filter(spark.createDataFrame([(k,) for k in listed], "key string"))
    assert urls.maybe_listed(words, [k.encode() for k in listed]).all()
    assert urls.maybe_listed(words, [f"other{i}".encode() for i in range(3000)]).mean() < 0.02


def test_url_candidates_are_bounded_by_the_list():
    assert sorted(urls.candidates("a.b.example.com", "/en/x", [1, 4, 9], [0, 1])) == sorted(
        f"{h}\t{p}" for h in ("com", "example.com") for p in ("/", "/en/")
    )
    assert urls.candidates("", "", [0], [0]) == urls.candidates("com", "/", [1], []) == []
    assert len(urls.candidates("." * 1_000_000 + "com", "/" * 1_000_000, [1], [0, 1])) == 2


def test_false_positives_are_removed_by_the_join(spark, monkeypatch):
    monkeypatch.setattr(urls, "build_filter", lambda keys: np.full((1, urls.WORDS), 2**64 - 1, dtype=np.uint64))
    monkeypatch.setattr(urls, "BROADCAST_KEYS", 0)  # a shuffled list gives the same
    pages = spark.createDataFrame([(1, "http://x.org/es/"), (2, "http://x.net/es/1")], "page_id long, url string")
    got = urls.judge(pages, spark.createDataFrame(RULES, "host string, path string, verdict string")).collect()
    assert sorted((r.page_id, r.rule, r.verdict) for r in got) == [(1, None, "allow"), (2, "net/es/", "block")]


# ----- shards --------------------------------------------------------------------


def check_shards(rows, sizes, n):
    assert Counter(r["size"] for r in rows) == Counter(sizes)
    by_shard = defaultdict(list)
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < n
        by_shard[r.shard].append(r)
    for shard in by_shard.values():
        assert sorted(r.slot for r in shard) == list(range(len(shard)))
    return [sum(r["size"] for r in by_shard[s]) for s in range(n)]


def test_shards_are_near_equal(spark):
    rng = random.Random(8)
    hot = "the same text for a third of all rows"
    rows = [(i, hot if i % 3 == 0 else "w" * rng.randint(0, 400), rng.choice(["en", "de", None]), "src0" if i % 3 else f"src{i % 7}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("size", F.lit("clash"))
    got = shards.shard(docs, 7).collect()
    totals = check_shards(got, [len(t) + 16 for _, t, _, _ in rows], 7)
    assert max(totals) - min(totals) < 0.05 * sum(totals) / 7
    crc = {i: zlib.crc32(t.encode()) for i, t, _, _ in rows}
    assert all(r.text_crc32 == crc[r.doc_id] for r in got)
    again = shards.shard(docs, 7).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_shards_of_edge_rows(spark):
    same = spark.createDataFrame([(None, None, None, None)] * 90 + [(1, "é", "", "s")] * 10, "doc_id long, text string, lang string, source string")
    totals = check_shards(shards.shard(same, 4).collect(), [16] * 90 + [18] * 10, 4)
    assert max(totals) - min(totals) <= 40
    assert shards.shard(same.limit(0), 4).count() == 0
    check_shards(shards.shard(same.limit(2), 5).collect(), [16, 16], 5)
    assert len({r.shard for r in shards.shard(same, target_bytes=324).collect()}) == 5


# ----- top-k ---------------------------------------------------------------------


def brute_top(rows, k, every):
    fine = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for i, q in sorted({(i, tuple(v)) for i, v in fine if i % every == 0}):
        found = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in fine if j != i)[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return sorted(out)


def test_top_k(spark):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(1400)]
    rows += [(5000 + i, rows[7][1]) for i in range(700)] + [(50, rows[50][1]), (51, rows[51][1])]  # a hot vector, repeated rows
    rows += [(60_000, None), (60_050, [1.0, None]), (60_100, [float("nan")]), (60_150, [float("inf")] * 8), (None, rows[3][1]), (60_200, []), (60_201, [0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"score": F.lit("x"), "id": F.lit(1)})
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df).collect())
    assert got == brute_top(rows, 5, 50)
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(df.where("vec_id = 50").limit(1)).count() == 0


def test_blocks_below_the_kth_score_are_skipped():
    rng = np.random.default_rng(2)
    blocks = [(np.arange(i * 100, i * 100 + 100), rng.integers(-10, 10, (100, 6)) + 100.0 * (i == 3)) for i in range(20)]
    query = [(np.array([-1]), np.full((1, 6), 5.0))]
    ((_, _, scores, ids),), scored = topk.search_cell(query, blocks, 5)
    everything = sorted((-float(s), int(i)) for b, x in blocks for i, s in zip(b, x @ np.full(6, 5.0), strict=True))[:5]
    assert [(-s, i) for s, i in zip(scores, ids, strict=True)] == everything and scored == 1


def test_large_products_stay_exact():
    big = 2.0**40
    assert topk._scores(np.array([[big, 1.0]]), np.array([[big / 2**20, 3.0]])).tolist() == [[2**60 + 3]]


# ----- licenses --------------------------------------------------------------------


def test_license_scan(spark):
    apache, mit = licenses.TEMPLATES["Apache-2.0"], licenses.TEMPLATES["MIT"]
    filler = "\n".join(f"word{i} other{i} text{i}" for i in range(30))
    rows = [
        (1, "repo/LICENSE.txt", f"{mit}\n{filler}"), (2, "repo/src/a.py", filler), (3, "repo/src/deep/er/b.py", None), (4, "repo/third/COPYING", f"Header\n{apache.upper()}"),
        (5, "repo/third/x/c.py", filler), (6, "repo/third/x/d.py", f"{filler}\n  {mit}"), (7, "other/e.py", filler), (8, None, ""), (9, "repothird/f.py", "x"),
        (10, "repo/third/z/g.py", f"{filler}\n{mit}"), (10, "repo/third/z/g.py", f"{filler}\n{mit}"),
    ]
    files = spark.createDataFrame(rows, "id long, path string, text string").withColumns({"score": F.lit("x"), "dir": F.lit("y")})
    got = sorted((r.id, str(r.license), r.how, str(r.from_dir)) for r in licenses.scan(files, keep=("id",)).collect())
    assert got == [
        (1, "MIT", "own", "None"), (2, "MIT", "inherited", "repo"), (3, "MIT", "inherited", "repo"), (4, "Apache-2.0", "own", "None"),
        (5, "Apache-2.0", "inherited", "repo/third"), (6, "MIT", "own", "None"), (7, "None", "none", "None"), (8, "None", "none", "None"), (9, "None", "none", "None"),
        (10, "MIT", "own", "None"), (10, "MIT", "own", "None"),
    ]
    assert licenses.scan(files.limit(0)).count() == 0


def test_licenses_are_inherited_along_empty_segments(spark):
    mit, apache = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["Apache-2.0"]
    rows = [
        (1, "/src/LICENSE", mit), (2, "/src/a.py", "x"), (3, "/src/deep/b.py", "x"), (4, "src/c.py", "x"), (5, "src0//0/LICENSE", apache),
        (6, "src0//0/5", "x"), (7, "src0//5", "x"), (8, "/", "x"), (9, "a/LICENSE", mit), (10, "a//b/c.py", "x"), (11, "a//c.py", "x"),
    ]
    files = spark.createDataFrame(rows, "id long, path string, text string")
    got = {r.id: (r.license, r.how, r.from_dir) for r in licenses.scan(files, keep=("id",)).collect()}
    none, from_src, from_a = (None, "none", None), ("MIT", "inherited", "/src"), ("MIT", "inherited", "a")
    assert [got[i] for i in (2, 3, 4, 6, 7, 8, 10, 11)] == [from_src, from_src, none, ("Apache-2.0", "inherited", "src0//0"), none, none, from_a, from_a]


def test_documents_without_source_or_lang_match_the_oracle(spark, tmp_path):
    rows = [(i, s, g, licenses.TEMPLATES["MIT"] if i in (101, 203) else "x") for i in (5, 101, 102, 203, 204) for s, g in ((None, "en"), ("src0", None), ("", ""), ("src0", "en"))]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = con.execute(queries.OP9_SQL).fetchall()
    got = [tuple(r) for r in queries.op9_license_scan(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected)) and {"inherited", "own"} <= {r[3] for r in got}


def test_cosine():
    m = licenses.Matcher({"A": "one two two", "B": "three"}, {"one": 3, "two": 0, "three": 1}, 9)
    idf = {t: math.log(10 / (1 + n)) + 1 for t, n in (("one", 3), ("two", 0), ("three", 1), ("new", 0))}
    a = {"one": idf["one"], "two": 2 * idf["two"]}
    p = {"one": 2 * idf["one"], "new": idf["new"]}
    expected = p["one"] * a["one"] / math.hypot(*p.values()) / math.hypot(*a.values())
    score, name = m.best(["one", "one", "new"])
    assert name == "A" and score == pytest.approx(expected, abs=1e-8)
    assert m.best(["none"]) == (0.0, None) and m.best([]) == (0.0, None)
