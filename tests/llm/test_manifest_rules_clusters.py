"""Merkle manifest, quality rule cascade and centroid clustering against brute force on small tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from statgate.llm import centroids, merkle, quality_rules

DOC = "doc_id long, text string, lang string, source string, n_chars long, tree string, node string, path string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, n_chars):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], n_chars, row[1])]
    return sha("".join(parts))


def reduce_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    return levels


def steps(levels, at):
    out = []
    for nodes in levels[:-1]:
        sibling = at ^ 1
        out.append("S" if sibling >= len(nodes) else ("L" if at % 2 else "R") + nodes[sibling])
        at //= 2
    return out


def fold(value, path):
    for s in path:
        value = sha({"L": s[1:] + value, "R": value + s[1:], "S": value}[s[0]])
    return value


def brute_audit(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g, members in groups.items():
        members.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[g] = reduce_levels([leaf(r, r[4]) for r in members])
    top = reduce_levels([trees[g][-1][0] for g in order])
    out = []
    for i, g in enumerate(order):
        for at, r in enumerate(groups[g]):
            path = steps(trees[g], at) + steps(top, i)
            changed = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            root = fold(leaf(r, r[4] + 1 if changed else r[4]), path)
            proof = sha("".join(s[1:] for s in path if s != "S"))
            out.append((r[0], leaf(r, r[4]), trees[g][-1][0], top[-1][0], proof, root, root == top[-1][0]))
    return sorted(out, key=repr)


def manifest_rows(n, langs, seed=1):
    rnd = random.Random(seed)
    rows = [(i, f"text {i % 11} é", rnd.choice(langs), f"s{i % 3}", i % 50, "t", "n", "p") for i in range(n)]
    return rows


@pytest.mark.parametrize("levels", [1, 2, 12])
@pytest.mark.parametrize("rows", [
    manifest_rows(1, ["a"]),
    manifest_rows(77, ["a", "a", "é", None, ""]),
    [(None, None, None, None, None, None, None, None)] * 5 + [(7, "", "a", None, None, "", "", "")] * 6 + [(7, "x", "a", "s", 1, "", "", "")],
    [(i, "word " * 20_000, "l%d" % i, None, 1, None, None, None) for i in range(9)],
], ids=["one", "mixed", "nulls_and_ties", "lone_leaves"])
def test_manifest_is_the_tree_by_levels(spark, rows, levels):
    made = merkle.audit(spark.createDataFrame(rows, DOC), levels=levels).collect()
    assert sorted((tuple(r) for r in made), key=repr) == brute_audit(rows)


def test_manifest_of_an_empty_table(spark):
    made = merkle.audit(spark.createDataFrame([], DOC))
    assert made.collect() == [] and made.columns[0] == "doc_id" and made.columns[-1] == "verified"


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 70))
def test_append_equals_levels_and_every_witness_folds(n):
    run = merkle.Append()
    leaves = [sha(str(i)) for i in range(n)]
    nodes = [run.add(v) for v in leaves]
    assert len(run.open) <= n.bit_length()  # open subtrees: one for each bit at most
    root = run.close(None).digest
    assert root == reduce_levels(leaves)[-1][0]
    assert all(fold(v, w) == root for v, w in zip(leaves, merkle.witnesses(nodes, []), strict=True))


def test_a_witness_grows_only_by_later_siblings():
    run = merkle.Append()
    first = run.add(sha("0"))
    assert first.step is None
    run.add(sha("1"))
    known = (first.step, first.parent.digest)
    run.add(sha("2"))
    assert first.parent.step is None  # its subtree of two waits for the next two
    run.add(sha("3"))
    assert first.parent.step[0] == "R" and (first.step, first.parent.digest) == known


# --- quality rules -----------------------------------------------------------------------------------


def brute_measures(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(len(w) for w in words), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


TEXTS = ["", " \t\n", None, "a", "a b c", "a b c a b c", "a a a a", "x\ny\nx\n \n \nx ", "é b # | <\x85z w", "😀 😀 😀 😀 " * 30,
         "one two three four five " * 12, " ".join(f"w{i}" for i in range(300)), "\r\na\r\na\x0bb", "SHOUT " + " ".join(f"WORD{i}" for i in range(80))]


def test_measures_equal_brute_force(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(None, "a b c a b c", None, None), (3, "a", "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int")
    got = quality_rules.apply(df, keep=("doc_id", "kept", "n_words")).collect()
    assert got[0].__fields__[:3] == ["doc_id", "_kept", "_n_words"]
    by = {(r.doc_id, r._kept): r for r in got}
    assert len(got) == len(rows)
    for i, text, other, _ in rows:
        r = by[i, other]
        n, chars, symbols, dup, repeat = brute_measures(text or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat), text
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert not (r.base_failed and r.kept) and (r.rejected_by is None) == r.kept


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=40))
def test_repeated_words_equal_brute_force(words):
    assert quality_rules.repeated_words(words) == brute_measures(" ".join(words))[4]


def test_rules_of_an_empty_table(spark):
    made = quality_rules.apply(spark.createDataFrame([], "doc_id long, text string"))
    assert made.collect() == [] and {"kept", "base_failed"} <= set(made.columns)


def test_the_order_is_by_rejections_per_second_among_what_is_left():
    rule = lambda name, *needs: quality_rules.Rule(name, needs, lambda d: False)
    rules = [rule("dear", "n_repeat_words"), rule("cheap", "n_symbols"), rule("covered", "n_symbols"), rule("idle", "lines")]
    seconds = {"words": 5.0, "n_repeat_words": 10.0, "n_symbols": 1.0, "lines": 2.0}
    tests = dict.fromkeys(["dear", "cheap", "covered", "idle"], 0.1)
    found = quality_rules.Estimates(seconds, tests, [0b0001] * 5 + [0b0110] * 4 + [0b0100])
    # "covered" alone rejects the most for its time; what "cheap" rejects is gone then, so "dear" comes before it
    assert [r.name for r in quality_rules.plan(found, rules)] == ["covered", "dear", "cheap", "idle"]
    # measures that are wanted anyway cost a rule nothing
    assert [r.name for r in quality_rules.plan(found, rules, ["n_repeat_words"])][:2] == ["dear", "covered"]


def test_the_cascade_stops_at_the_first_rejection_and_no_order_changes_the_verdict(spark):
    asked = []
    spy = quality_rules.Rule("spy", (), lambda d: asked.append(1) or False)
    few = quality_rules.BASE_RULES[0]
    doc = quality_rules.Document("short text")
    assert few.rejects(doc) and "n_repeat_words" not in doc.made
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    forward, backward = (quality_rules.judge(df, o).collect() for o in (quality_rules.RULES, quality_rules.RULES[::-1]))
    assert [(r.doc_id, r.kept, r.base_failed) for r in forward] == [(r.doc_id, r.kept, r.base_failed) for r in backward]
    tested = quality_rules.judge(df, [few, spy], base=()).collect()
    assert {r.n_tests for r in tested if r.rejected_by == "few_words"} == {1} and {r.n_tests for r in tested if r.kept} == {2}


def test_a_hot_or_long_text_is_measured_whole(spark):
    long = "alpha beta gamma delta " * 200_000
    df = spark.createDataFrame([(1, long), (2, long + "omega")], "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules.apply(df).collect()}
    assert got[1].n_words == 800_000 == got[1].n_repeat_words and got[2].n_words == 800_001 and got[2].n_repeat_words == 800_000


# --- centroid clustering -----------------------------------------------------------------------------


def brute_clusters(rows, k, dims, scale, rounds):
    kept = [(i, [int(np.floor(scale * float(c))) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and np.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, sha(f"2:{r[0]}"), r[1]))
    centers = [list(x) for _, x in order[:k]]
    for step in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centers)) for _, x in kept]
        if step < rounds:
            for j in range(len(centers)):
                mine = [x for (_, x), (_, c) in zip(kept, near, strict=True) if c == j]
                if mine:
                    centers[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    total = sum(d for d, _ in near)
    per = {j: sum(d for d, c in near if c == j) for j in range(len(centers))}
    return sorted(((i, c, d, per[c], total, sha(",".join(map(str, centers[c])))) for (i, _), (d, c) in zip(kept, near, strict=True)), key=repr)


def vectors(kind):
    rnd = np.random.default_rng(3)
    if kind == "spread":
        return [(i, rnd.normal(size=8).tolist()) for i in range(300)]
    if kind == "lumps":
        middles = rnd.normal(size=(5, 8)) * 4
        return [(i, (middles[i % 5] + rnd.normal(size=8) * 0.05).tolist()) for i in range(300)]
    same = [0.5] * 8
    return [(i % 4, same) for i in range(40)] + [(None, [-1.0] * 8), (None, same), (9, None), (10, [1.0] * 7), (11, [None] + same[1:]),
                                                 (12, [float("nan")] + same[1:]), (13, [float("inf")] + same[1:]), (14, [])]


@pytest.mark.parametrize("kind", ["spread", "lumps", "ties"])
@pytest.mark.parametrize("k", [1, 6, 400])
def test_clusters_equal_brute_force(spark, kind, k):
    rows = vectors(kind)
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, id string")
    made = centroids.cluster(df, k=k, dims=8, rounds=3)
    assert sorted((tuple(r) for r in made.collect()), key=repr) == brute_clusters(rows, k, 8, 256, 3)


def test_clusters_of_an_empty_table(spark):
    made = centroids.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert made.collect() == [] and made.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**31), st.integers(1, 9), st.integers(1, 7), st.integers(1, 8))
def test_intervals_never_lose_the_nearest(seed, k, dims, bits):
    rnd = np.random.default_rng(seed)
    x = rnd.integers(-1000, 1000, size=(50, dims)) // rnd.integers(1, 400)
    centers = x[rnd.integers(0, 50, size=k)]
    cells = centroids.Cells(x.min(axis=0), x.max(axis=0), bits)
    packed = cells.pack(x)
    assert packed.shape[1] == -(-dims * bits // 8)
    assert (cells.unpack(packed) == (x - cells.least) // cells.width).all()
    found, _ = centroids.nearest(packed, lambda rows: x[rows], cells, centers)
    exact = ((x[:, None, :] - centers[None]) ** 2).sum(axis=2)
    assert (found == exact.argmin(axis=1)).all()


def test_full_vectors_are_fetched_only_where_intervals_overlap(spark):
    x = np.array([[int(256 * c) for c in v] for _, v in vectors("lumps")])
    cells = centroids.Cells(x.min(axis=0), x.max(axis=0))
    read = []
    found, fetched = centroids.nearest(cells.pack(x), lambda rows: read.extend(rows) or x[rows], cells, x[:5])
    assert len(read) == fetched == 0  # lumps lie far apart: the approximations decide
    df = spark.createDataFrame(vectors("lumps"), "vec_id long, embedding array<double>")
    rows = centroids.integer_vectors(df, "vec_id", "embedding", 8, 256)
    _, shares = centroids.fit(rows, centroids.approximate(rows, cells), cells, 5, 2, 2)
    assert all(0 <= s <= 1 for s in shares)
