"""One registered query per operator, over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statgate.llm import bpe, centroids, dedup, html_text, licenses, merkle, packing, quality, quality_rules, shards, simhash, topk, urls
from statgate.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

SEQUENCE_TOKENS = 2048
QUALITY_THRESHOLD = 0.7
SHARDS = 40
SIMHASH_SHINGLE, SIMHASH_BITS = 4, 4


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, by a network fitted on labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    net = quality.fit_on(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, net).select(
        "doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted")
    )


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), word_bpe(), SEQUENCE_TOKENS)


URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages"), rules)


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(url, '') AS u, row_number() OVER () AS r FROM pages),
q AS (SELECT page_id, r, CASE WHEN contains(u, '://') THEN substr(u, strpos(u, '://') + 3) END AS rest FROM p),
h AS (SELECT page_id, r,
             coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM q),
rules(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                            ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
b AS (SELECT h.r, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
      FROM h JOIN rules ON (h.host = rh OR ends_with(h.host, '.' || rh)) AND starts_with(h.path, rp) GROUP BY h.r)
SELECT h.page_id, h.host, h.path, b.rule, coalesce(b.v, 'allow') AS verdict FROM h LEFT JOIN b ON h.r = b.r
"""


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded ids of every document."""
    return bpe.digests(table(spark, sf_dir, "documents"), word_bpe())


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group, size and fate of every document; equal texts are one group, the largest doc_id stays."""
    groups = dedup.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP5_SQL = """
WITH d AS (SELECT doc_id, coalesce("text", '') AS t, row_number() OVER () AS r FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t),
m AS (SELECT d.doc_id, g.keep_id, g.group_size, d.t, row_number() OVER (PARTITION BY d.t ORDER BY d.doc_id DESC NULLS LAST, d.r) AS n
      FROM d JOIN g ON d.t = g.t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, n = 1 AS kept, sha256(t) AS text_sha256 FROM m
"""


def op6_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, 40 shards of near equal bytes."""
    return shards.shard(table(spark, sf_dir, "documents"), SHARDS)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, with weights counted on pages that mark theirs."""
    pages = table(spark, sf_dir, "pages")
    found = html_text.extract(pages, html_text.fit(pages))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best other vectors for every vector whose id is divisible by 50."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


OP8_SQL = """
WITH e AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)),
q AS (SELECT DISTINCT vec_id, x FROM e WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS query_id, q.x AS qx, e.vec_id, CAST(list_inner_product(q.x, e.x) AS BIGINT) AS score, e.r FROM q JOIN e ON e.vec_id <> q.vec_id),
k AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id, qx ORDER BY score DESC, vec_id, r) AS "rank" FROM s)
SELECT query_id, CAST("rank" AS INTEGER) AS "rank", vec_id, score FROM k WHERE "rank" <= 5
"""


def _document_path() -> Column:
    """source/lang, then the hundreds of the id below those of ten thousands, then the id."""
    doc = F.coalesce(F.col("doc_id"), F.lit(0))
    return F.concat_ws(
        "/",
        F.coalesce("source", F.lit("")),
        F.coalesce("lang", F.lit("")),
        F.when(doc >= 10_000, F.expr("doc_id div 10000").cast("string")),
        F.when(doc >= 100, F.expr("doc_id div 100").cast("string")),
        doc.cast("string"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License of every document, its own or inherited; documents lie in directories by source, language and id."""
    docs = table(spark, sf_dir, "documents").withColumn("path", _document_path())
    return licenses.scan(docs, keep=("doc_id",))


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce("text", '') AS t,
                  concat_ws('/', coalesce(source, ''), coalesce(lang, ''),
                            CASE WHEN doc_id >= 10000 THEN CAST(doc_id // 10000 AS VARCHAR) END,
                            CASE WHEN doc_id >= 100 THEN CAST(doc_id // 100 AS VARCHAR) END,
                            CAST(coalesce(doc_id, 0) AS VARCHAR)) AS path FROM documents),
templates(license, notice) AS (VALUES {templates}),
tt AS (SELECT license, lower(w) AS w, count(*) AS n FROM (SELECT license, unnest(regexp_extract_all(notice, '[A-Za-z0-9]+')) AS w FROM templates) GROUP BY ALL),
words AS (SELECT r, l, lower(unnest(regexp_extract_all(line, '[A-Za-z0-9]+'))) AS w
          FROM (SELECT r, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS l FROM d)),
lw AS (SELECT r, l, w, count(*) AS n FROM words GROUP BY ALL),
docs AS (SELECT count(*) AS n FROM d),
idf AS (SELECT v.w, ln((1 + any_value(docs.n)) / (1 + count(DISTINCT lw.r))) + 1 AS idf
        FROM (SELECT DISTINCT w FROM tt) v CROSS JOIN docs LEFT JOIN lw ON lw.w = v.w GROUP BY v.w),
tv AS (SELECT license, tt.w, tt.n * idf AS x FROM tt JOIN idf USING (w)),
tn AS (SELECT license, sqrt(sum(x * x)) AS size FROM tv GROUP BY license),
passages AS (SELECT r, l, w, n FROM lw UNION ALL SELECT r, 0, w, sum(n) FROM lw GROUP BY r, w),
pv AS (SELECT r, l, w, n * coalesce(idf, (SELECT ln(1 + n) + 1 FROM docs)) AS x, n FROM passages LEFT JOIN idf USING (w)),
pn AS (SELECT r, l, sqrt(sum(x * x)) AS size, sum(n) AS words FROM pv GROUP BY r, l),
cosines AS (SELECT r, l, license, round(sum(pv.x * tv.x) / (any_value(pn.size) * any_value(tn.size)), 9) AS score
            FROM pv JOIN tv USING (w) JOIN pn USING (r, l) JOIN tn USING (license) GROUP BY r, l, license),
line_best AS (SELECT r, l, min(struct_pack(s := -score, license := license)) AS b FROM cosines GROUP BY r, l),
notices AS (SELECT r, l, -b.s AS score, b.license AS license FROM line_best WHERE -b.s >= {threshold}),
own_line AS (SELECT r, min(struct_pack(s := -score, license := license)) AS b, sum(words) AS words FROM notices JOIN pn USING (r, l) WHERE l > 0 GROUP BY r),
own AS (SELECT n.r, coalesce(-o.b.s, n0.score) AS score, coalesce(o.b.license, n0.license) AS license,
               CASE WHEN o.r IS NULL THEN 1.0 ELSE o.words / p.words END AS share
        FROM (SELECT DISTINCT r FROM notices) n LEFT JOIN own_line o USING (r)
        LEFT JOIN (SELECT r, score, license FROM notices WHERE l = 0) n0 USING (r) JOIN (SELECT r, words FROM pn WHERE l = 0) p USING (r)),
f AS (SELECT d.r, doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir, own.score, own.license, share FROM d LEFT JOIN own USING (r)),
dirs AS (SELECT dir AS ancestor, min(struct_pack(s := -score, license := license)) AS b FROM f
         WHERE share >= {share} OR (share IS NOT NULL AND lower(regexp_extract(path, '([^/.]*)[^/]*$', 1)) IN ({names})) GROUP BY dir),
near AS (SELECT dir, max(struct_pack(n := length(ancestor), ancestor := ancestor)) AS m
         FROM (SELECT DISTINCT dir FROM f) x JOIN dirs ON ancestor = '' OR dir = ancestor OR starts_with(dir, ancestor || '/') GROUP BY dir)
SELECT doc_id, path, coalesce(f.license, dirs.b.license) AS license,
       CASE WHEN f.license IS NOT NULL THEN 'own' WHEN dirs.b.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
       CASE WHEN f.license IS NOT NULL THEN f.score ELSE -dirs.b.s END AS score,
       CASE WHEN f.license IS NULL THEN dirs.ancestor END AS from_dir
FROM f LEFT JOIN near ON near.dir = f.dir LEFT JOIN dirs ON dirs.ancestor = near.m.ancestor
""".format(
    templates=", ".join(f"('{k}', '{v}')" for k, v in licenses.TEMPLATES.items()),
    threshold=licenses.THRESHOLD,
    share=licenses.FILE_SHARE,
    names=", ".join(f"'{n}'" for n in licenses.FILE_NAMES),
)


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: 4-word shingles, links at 4 or fewer differing bits."""
    groups = simhash.near_groups(table(spark, sf_dir, "documents"), SIMHASH_SHINGLE, SIMHASH_BITS)
    return groups.select("doc_id", simhash.hex_of().alias("fingerprint"), "component_id")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document, by rules in the order that a sample suggests."""
    judged = quality_rules.apply(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality_rules.REPORTED, "base_failed", "kept")


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce("text", '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
m AS (SELECT r, doc_id, lines, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
             len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) AS n_letter_words,
             len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09\x0B-\x0D]*[-*•●▪‣]'))) AS n_bullet_lines,
             len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09\x0B-\x0D]*$'))) AS n_ellipsis_lines,
             len(regexp_extract_all(t, '[A-Z]')) AS n_upper, len(regexp_extract_all(t, '[A-Za-z]')) AS n_letters FROM w),
one AS (SELECT r, unnest(words) AS word, unnest(range(len(words))) AS place FROM w),
top AS (SELECT r, max(n) AS top_word FROM (SELECT r, word, count(*) AS n FROM one GROUP BY ALL) GROUP BY r),
windows AS (SELECT r, place, word AS a, lead(word, 1) OVER (PARTITION BY r ORDER BY place) AS b, lead(word, 2) OVER (PARTITION BY r ORDER BY place) AS c FROM one),
often AS (SELECT r, place FROM (SELECT r, place, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM windows WHERE c IS NOT NULL) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT place + j) AS n_repeat_words FROM often, (VALUES (0), (1), (2)) x(j) GROUP BY r),
f AS (SELECT m.*, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(top_word, 0) AS top_word,
             n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed FROM m LEFT JOIN covered USING (r) LEFT JOIN top USING (r))
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 12 * n_words OR 2 * n_dup_lines > len(lines)
            OR 10 * n_letter_words < 8 * n_words OR 4 * top_word > n_words OR 10 * n_bullet_lines > 9 * len(lines)
            OR 10 * n_ellipsis_lines > 3 * len(lines) OR 2 * n_upper > n_letters) AS kept
FROM f
"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and whether its present content still folds to the root."""
    return merkle.audit(table(spark, sf_dir, "documents"))


# crc32 has no function in DuckDB: eight shifts a byte over the reflected polynomial, which is a fixed value.
OP12_SQL = """
WITH RECURSIVE f AS (
  SELECT row_number() OVER () AS r, doc_id, lang, n_chars,
         CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END
         || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
         || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS head,
         CASE WHEN "text" IS NULL THEN '-' ELSE strlen("text") || ':' || "text" END AS tail FROM documents),
g AS (SELECT *, CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END AS n0,
             CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) END AS n1,
             xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
                 lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
                     lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END)), 4294967295::BIGINT) AS crc FROM f),
h AS (SELECT r, doc_id, lang, sha256(head || n0 || tail) AS leaf, CASE WHEN crc % 7 = 0 THEN sha256(head || n1 || tail) END AS changed FROM g),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos FROM h),
up AS (
  SELECT lang, 0 AS height, list(leaf ORDER BY pos) AS nodes FROM p GROUP BY lang
  UNION ALL
  SELECT lang, height + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], ''))) FROM up WHERE len(nodes) > 1),
sub AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM up WHERE len(nodes) = 1),
top AS (
  SELECT 0 AS height, list(subroot ORDER BY pos) AS nodes FROM sub
  UNION ALL
  SELECT height + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], ''))) FROM top WHERE len(nodes) > 1),
steps AS (
  SELECT p.r, up.height AS k, p.pos // CAST(pow(2, up.height) AS BIGINT) AS place, nodes FROM p JOIN up ON p.lang IS NOT DISTINCT FROM up.lang WHERE len(nodes) > 1
  UNION ALL
  SELECT p.r, 1000 + top.height, sub.pos // CAST(pow(2, top.height) AS BIGINT), nodes
  FROM p JOIN sub ON p.lang IS NOT DISTINCT FROM sub.lang, top WHERE len(nodes) > 1),
sided AS (SELECT r, k, CASE WHEN place % 2 = 1 THEN 'L' || nodes[place] WHEN place + 1 < len(nodes) THEN 'R' || nodes[place + 2] ELSE 'S' END AS step FROM steps),
paths AS (SELECT r, list(step ORDER BY k) AS path FROM sided GROUP BY r),
w AS (SELECT p.*, subroot, (SELECT nodes[1] FROM top WHERE len(nodes) = 1) AS root, coalesce(path, []) AS path
      FROM p JOIN sub ON p.lang IS NOT DISTINCT FROM sub.lang LEFT JOIN paths USING (r)),
v AS (SELECT *, list_reduce(list_prepend(coalesce(changed, leaf), path),
             lambda acc, s: sha256(CASE WHEN s[1] = 'L' THEN s[2:] || acc WHEN s[1] = 'R' THEN acc || s[2:] ELSE acc END)) AS folded_root FROM w)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM v
"""


CLUSTERS, CLUSTER_ROUNDS, CLUSTER_SEED = 40, 5, 2


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and squared distance of every vector of 64 finite components, after five rounds from hashed seeds."""
    return centroids.cluster(table(spark, sf_dir, "embeddings"), k=CLUSTERS, dims=64, scale=256, rounds=CLUSTER_ROUNDS, seed=CLUSTER_SEED)


def _op13_sql() -> str:
    rounds = "".join(
        f"""
a{n} AS MATERIALIZED (SELECT r, c, d FROM (
    SELECT r, c, xx - 2 * list_inner_product(e.x, k.x) + list_inner_product(k.x, k.x) AS d,
           row_number() OVER (PARTITION BY r ORDER BY xx - 2 * list_inner_product(e.x, k.x) + list_inner_product(k.x, k.x), c) AS n
    FROM e CROSS JOIN c{n} k) WHERE n = 1),
m{n} AS (SELECT c, i, CAST(sum(v) AS BIGINT) AS s, count(*) AS n
         FROM (SELECT a.c, unnest(e.x) AS v, unnest(range(64)) AS i FROM a{n} a JOIN e USING (r)) GROUP BY c, i),
c{n + 1} AS MATERIALIZED (SELECT k.c, coalesce(z.x, k.x) AS x FROM c{n} k LEFT JOIN
    (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS x FROM m{n} GROUP BY c) z USING (c)),"""
        for n in range(CLUSTER_ROUNDS)
    )
    return f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings),
e AS MATERIALIZED (SELECT r, vec_id, x, list_inner_product(x, x) AS xx FROM
  (SELECT r, vec_id, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM v
   WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = 64)),
c0 AS MATERIALIZED (SELECT n - 1 AS c, x FROM (SELECT x, row_number() OVER (ORDER BY sha256('{CLUSTER_SEED}:' || vec_id) NULLS LAST, x) AS n FROM e)
                    WHERE n <= {CLUSTERS}),{rounds}
a AS (SELECT r, c, d FROM (
    SELECT r, c, xx - 2 * list_inner_product(e.x, k.x) + list_inner_product(k.x, k.x) AS d,
           row_number() OVER (PARTITION BY r ORDER BY xx - 2 * list_inner_product(e.x, k.x) + list_inner_product(k.x, k.x), c) AS n
    FROM e CROSS JOIN c{CLUSTER_ROUNDS} k) WHERE n = 1)
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(k.x, lambda t: CAST(CAST(t AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a JOIN e USING (r) JOIN c{CLUSTER_ROUNDS} k ON k.c = a.c
"""


OP13_SQL = _op13_sql()


QUERIES: dict[str, Query] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_url_filter": op3_url_filter,
    "op4_bpe": op4_bpe,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_kd_sharding": op6_kd_sharding,
    "op7_html_extraction": op7_html_extraction,
    "op8_exact_topk": op8_exact_topk,
    "op9_license_scan": op9_license_scan,
    "op10_simhash_dedup": op10_simhash_dedup,
    "op11_quality_rules": op11_quality_rules,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_centroid_clustering": op13_centroid_clustering,
}

ORACLES: dict[str, str] = {
    "op3_url_filter": OP3_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op8_exact_topk": OP8_SQL,
    "op9_license_scan": OP9_SQL,
    "op11_quality_rules": OP11_SQL,
    "op12_merkle_manifest": OP12_SQL,
    "op13_centroid_clustering": OP13_SQL,
}
