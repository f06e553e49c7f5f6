"""BPE, packing, exact dedup, SimHash and HTML extraction against brute force, with edge rows."""

import hashlib
import html
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from statgate.llm import bpe, components, dedup, html_text, packing, simhash

PATH = public_tokenizers.path("word_bpe_49k.json")
LONG = "wort " * 40_000 + "x" * 30_000
EDGE = [(1, "Das ist gut."), (2, None), (3, ""), (3, ""), (None, "Das ist gut."), (5, "Das ist gut."), (5, "Das ist gut."), (7, LONG), (8, "\x00é中 ")]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe.load(PATH)


@pytest.fixture()
def edge(spark):
    return spark.createDataFrame(EDGE, "doc_id long, text string").withColumns({"ids": F.lit("a"), "digest": F.lit("b"), "fp": F.lit("c")})


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


# ----- BPE ------------------------------------------------------------------


def test_encode_equals_library(library, encoder):
    rng = random.Random(3)
    alphabet = "abcdeéßİΣσς'sştдтܐ中文0123 \n\t!?\x1c̀Ᲊ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    texts += [t + "<|endoftext|>" + t for t in texts[:40]] + ["", " ", "a" * 3000, "the" * 999, "don't we'll I'M", LONG]
    for text, found in zip(texts, encoder.encode_many(texts), strict=True):
        assert found.tolist() == ids_of(library, text), text[:80]


def test_long_words_stream_with_bounded_lookahead(encoder):
    rng = random.Random(4)
    for _ in range(20):
        letters = rng.choice(["ab", "the", "ingthanre", "aaab"])
        data = "".join(rng.choice(letters) for _ in range(rng.randint(1, 4000))).encode()
        symbols = encoder.inner[np.frombuffer(data, dtype=np.uint8)]
        symbols[-1] = encoder.last[data[-1]]
        cuts = sorted(rng.sample(range(symbols.size), min(5, symbols.size)))
        ends = np.zeros(symbols.size, dtype=bool)
        ends[-1] = True
        parts = list(zip(np.split(symbols, cuts), np.split(ends, cuts), strict=True))
        assert [t for some, _ in encoder.stream(parts) for t in some.tolist()] == encoder.merge_symbols(symbols.tolist())


def _counted(monkeypatch):
    """The tokens that leave the window from now on, and the most symbols that it held."""
    seen, plain = {"tokens": 0, "held": 0}, bpe.Bpe.stream

    def stream(self, portions):
        def noted():
            for symbols, ends in portions:
                seen["held"] = max(seen["held"], symbols.size)
                yield symbols, ends

        for tokens, closes in plain(self, noted()):
            seen["tokens"] += tokens.size
            yield tokens, closes

    monkeypatch.setattr(bpe.Bpe, "stream", stream)
    return seen


def test_every_token_leaves_the_window(library, monkeypatch):
    seen, encoder = _counted(monkeypatch), bpe.Bpe(PATH)
    words = [f"{a}{b}{c}" for a in ("bra", "Kö", "新", "don't") for b in ("ing", "tion", "é") for c in ("", "!", "42", "x" * 700)]
    text = " ".join(words)  # no chunk comes twice
    assert encoder.encode_many([text])[0].tolist() == ids_of(library, text)
    assert seen["tokens"] == len(ids_of(library, text)) and seen["held"] <= bpe.PORTION


@pytest.mark.parametrize("segment", [8, 61, 500])
def test_text_without_spaces_is_cut_inside_words(library, monkeypatch, segment):
    monkeypatch.setattr(bpe, "SEGMENT", segment)
    monkeypatch.setattr(bpe, "PORTION", 37)
    encoder, rng = bpe.Bpe(PATH), random.Random(segment)
    odd = ["abcdefgh" * 4, "it's", "'story", "!!'s", "''re", "日本語" * 5, "한국어", "привет" * 3, "e\u0301\u0327", "\u0130stanbul", "ΟΔΟΣ", "12345", "#$%&" * 5, "กขค", "\t", "q\u0301", "<|endoftext|>", "ſ'K"]
    for _ in range(150):
        text = "".join(rng.choice(odd) for _ in range(rng.randint(1, 40)))
        assert encoder.encode_many([text])[0].tolist() == ids_of(library, text), text


def test_one_long_word_needs_no_memory_of_its_length(library, monkeypatch):
    import tracemalloc

    monkeypatch.setattr(bpe, "SEGMENT", 1 << 13)
    monkeypatch.setattr(bpe, "PORTION", 1 << 12)
    encoder, rng, peaks = bpe.Bpe(PATH), random.Random(1), []
    for size in (50_000, 200_000):
        text = "".join(rng.choices("etaoinshr", k=size))
        tracemalloc.start()
        total = sum(ids.size for _, ids in encoder.encode_stream([text]))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        if size == 50_000:
            assert total == len(ids_of(library, text))
    assert peaks[1] < 1.1 * peaks[0], peaks


def test_boundaries_beyond_the_lookahead_are_stable():
    """On a small merge list, every boundary that far from the end survives every continuation."""
    merges, left_of, length = [(0, 1), (1, 2), (3, 2), (2, 4), (0, 4)], {3: 0, 4: 1, 5: 3, 6: 2, 7: 0}, [1, 1, 1, 2, 2, 3, 3, 3]
    made = [3, 4, 5, 6, 7]
    reach = bpe.sufficient_lookahead(merges, left_of, length)
    ranks = {p: r for r, p in enumerate(merges)}

    def tokens(s):
        s = list(s)
        while True:
            found = [(ranks[p], i) for i, p in enumerate(zip(s, s[1:])) if p in ranks]
            if not found:
                return s
            r, i = min(found)
            s[i : i + 2] = [made[r]]

    def ends(s):
        out, at = [], 0
        for t in tokens(s):
            at += length[t]
            out.append(at)
        return out

    rng = random.Random(1)
    for _ in range(300):
        prefix = [rng.randrange(3) for _ in range(12)]
        stable = [e for e in ends(prefix + [0]) if e <= len(prefix) - reach]
        for _ in range(6):
            other = [e for e in ends(prefix + [rng.randrange(3) for _ in range(4)]) if e <= len(prefix) - reach]
            assert other == stable


def test_decode_in_portions(library, encoder):
    ids = ids_of(library, "Grüße aus 北京, and the rest!")
    decoder = encoder.decoder()
    text = "".join(decoder.feed([i]) for i in ids) + decoder.close()
    assert text == library.decode(ids, skip_special_tokens=False)
    split = bpe.Decoder([b"\xe5\x8c", b"\x97", b"\xe4"], b"")
    assert [split.feed([0]), split.feed([1]), split.feed([2]), split.close()] == ["", "北", "", "�"]


def test_encode_frame(spark, library, edge):
    rows = bpe.encode(edge, PATH, decoded_col="fp").collect()
    assert sorted((str(r.doc_id), r.ids, r.fp, r.digest) for r in rows) == sorted(
        (str(i), ids_of(library, t), library.decode(ids_of(library, t), skip_special_tokens=False), "b") for i, t in EDGE
    )
    assert bpe.encode(edge.limit(0), PATH).count() == 0


def test_digests(library, edge):
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(edge, PATH).collect())
    expected = []
    for i, t in EDGE:
        ids = ids_of(library, t)
        text = library.decode(ids, skip_special_tokens=False)
        expected.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(expected)


# ----- packing ----------------------------------------------------------------


def test_packer_is_best_fit():
    rng = random.Random(2)
    packer, free, closed = packing.Packer(20, open_bins=5), {}, set()
    fill = defaultdict(int)
    for _ in range(2000):
        n = rng.randint(1, 20)
        fitting = [f for f in free.values() if f >= n]
        number, offset = packer.put(n)
        assert number not in closed and offset == fill[number]
        fill[number] += n
        if fitting:
            assert 20 - offset == min(fitting)
        else:
            assert offset == 0
            if len(free) == 5:
                fullest = min(free.values())
                gone = [b for b in free if b not in {x for bins in packer.by_free for x in bins}]
                assert len(gone) == 1 and free[gone[0]] == fullest
                closed.add(gone[0])
                del free[gone[0]]
        free[number] = 20 - fill[number]
        if not free[number]:
            closed.add(number)
            del free[number]


def check_packed(rows, docs, library, capacity):
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    expected = []
    for i, t in docs:
        ids = np.array([*ids_of(library, t), 0], dtype="<u4")
        for n, s in enumerate(range(0, ids.size, capacity)):
            part = ids[s : s + capacity]
            expected.append((str(i), n, s, part.size, zlib.crc32(part.tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(expected)
    return len(by_sequence)


def test_pack_documents(library, edge):
    rows = packing.pack_documents(edge, PATH, 64).collect()
    check_packed(rows, EDGE, library, 64)
    assert packing.pack_documents(edge.limit(0), PATH).count() == 0


def test_pack_keeps_columns_and_few_sequences(spark):
    items = spark.range(3000).select(F.col("id").alias("_row"), (F.col("id") % 97 + 1).alias("length"), F.lit(5).alias("offset"))
    rows = packing.pack(items, 100, share=700).collect()
    total = sum(r.length for r in rows)
    assert len(rows) == 3000 and {r["_row"] for r in rows} == set(range(3000))
    assert len({r.sequence_id for r in rows}) <= total / 100 * 1.06


def test_long_pieces_leave_room_for_the_short_ones():
    """Longest first, with as many open bins as long pieces: none of their bins closes before the pieces that fill it come."""
    packer = packing.Packer(2048, open_bins=10_000)
    for n in [1200] * 10_000 + [848] * 10_000:
        packer.put(n)
    assert packer.made == 10_000


def test_sequences_join_the_ids(spark):
    docs = spark.createDataFrame([(1, "ein Haus"), (2, "zwei")], "doc_id long, text string")
    packed = packing.pack(packing.pieces(docs, PATH, 32, ids=True), 32)
    (row,) = packing.sequences(packed).collect()
    parts = {r.offset: r.ids for r in packed.collect()}
    assert row.ids == [i for k in sorted(parts) for i in parts[k]]


# ----- exact dedup --------------------------------------------------------------


def brute_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        kept = False
        for i in ids:
            out.append((str(i), str(keep), len(ids), i == keep and not kept, hashlib.sha256(text.encode()).hexdigest()))
            kept = kept or i == keep
    return sorted(out)


def groups_of(df, **more):
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.digest) for r in dedup.exact_groups(df, **more).collect())


def test_exact_groups(spark, edge):
    assert groups_of(edge) == brute_groups(EDGE)
    nulls = [(None, "a"), (None, "a"), (4, "b")]
    assert groups_of(spark.createDataFrame(nulls, "doc_id long, text string")) == brute_groups(nulls)
    assert dedup.exact_groups(edge.limit(0)).count() == 0


def test_clashing_digests_compare_contents(spark):
    rng = random.Random(5)
    rows = [(i, f"text {rng.randrange(25)}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = groups_of(df, salts=3, digest=lambda t: F.substring(F.sha2(t.cast("binary"), 256), 1, 1))
    assert [g[:4] for g in got] == [g[:4] for g in brute_groups(rows)]


def test_dedup_keep_one(edge):
    rows = dedup.keep_one(edge).collect()
    assert sorted((r.doc_id, r.text, r.ids) for r in rows) == [(3, "", "a"), (5, "Das ist gut.", "a"), (7, LONG, "a"), (8, "\x00é中 ", "a")]
    assert dedup.keep_one(edge).columns == edge.columns
    clashing = edge.withColumns({"_digest": F.lit(1), "_id": F.lit(2), "_kept": F.lit(3), "_row": F.lit(4)})
    assert dedup.keep_one(clashing).columns == clashing.columns and dedup.keep_one(clashing).count() == 4
    assert simhash.keep_one(clashing, 4, 4).columns == clashing.columns


# ----- SimHash ------------------------------------------------------------------


def brute_fingerprint(text, shingle):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, max_bits):
    values = [int(v) for v in values]
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= max_bits:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("max_bits", [0, 3, 4])
def test_links_connect_what_is_near(spark, max_bits):
    rng = random.Random(max_bits)
    centres = [rng.getrandbits(64) for _ in range(30)] + [0]
    values = set(centres)
    for c in [*centres, *[centres[0]] * 12]:  # one dense group, chains at the limit
        for _ in range(12):
            c ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, max_bits + 1)))
            values.add(c)
    for bits in range(200):  # a bucket beyond the small ones
        values.add(centres[1] ^ (bits & 7) ^ (bits >> 3) << 40)
    values = sorted(values)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long"), max_bits)
    for r in links.collect():
        assert ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= max_bits
    found = {r.node: r.root for r in components.components(links).collect()}
    expected = defaultdict(set)
    for s, c in zip(signed, brute_components(values, max_bits), strict=True):
        expected[c].add(s[0])
    for group in expected.values():
        assert {found.get(s, s) for s in group} == {min(group)}


def test_near_groups_of_edge_rows(spark, edge):
    texts = {str(i) + str(t): t for i, t in EDGE}
    got = simhash.near_groups(edge, 4, 4).select("doc_id", simhash.hex_of().alias("h"), "component_id").collect()
    assert sorted(r.h for r in got) == sorted(format(brute_fingerprint(t, 4), "016x") for _, t in EDGE)
    by_id = {r.doc_id: r.component_id for r in got}
    assert by_id[5] == by_id[None] == 1 and by_id[3] == by_id[2] == 2 and by_id[7] == 7 and len(texts) == 7
    assert simhash.near_groups(edge.limit(0), 4, 4).count() == 0


def test_simhash_keep_one(spark, edge):
    rows = simhash.keep_one(edge, 4, 4)
    assert rows.columns == edge.columns
    assert sorted(r.doc_id for r in rows.collect()) == [1, 2, 7, 8]
    repeated = spark.createDataFrame([(5, "a b c d"), (5, "x y z w"), (3, "x y z w"), (None, "q r s t"), (None, "q r s t")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in simhash.keep_one(repeated, 4, 4).collect()) == [("3", "x y z w"), ("5", "a b c d"), ("None", "q r s t")]


def test_simhash_keep_one_of_each_component_of_an_id(spark):
    """Null ids, and an id that is repeated, name several components; each keeps a row."""
    texts = ["a b c d", "x y z w", "q r s t", "e f g h"]
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3]), (None, texts[1])]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), 4, 4).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("7", texts[3]), ("7", texts[2]), ("None", texts[0]), ("None", texts[1])]


# ----- HTML ---------------------------------------------------------------------


def test_extraction_of_marked_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    weight = html_text.fit(pages)
    for r in html_text.extract(pages, weight).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.sub(r"</?b>", "", re.search(r"<article>(.*?)</article>", r.html, re.S)[1])
        blocks = (" ".join(html.unescape(b).split()) for b in re.split(r"<[^>]*>", article))
        assert r.text == "\n".join(b for b in blocks if b)


@pytest.mark.parametrize("mark", ["article", 'div id="content"'])
def test_lists_links_and_sections_belong_to_the_text(spark, mark):
    """Weights come from pages whose only links and lists stand in menus."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    weight = html_text.fit(pages)
    before, rest = pages.orderBy("page_id").first().html.split("<article>")
    after = rest.split("</article>")[1]
    body = "<div><p>By line.</p></div><p>We <a href='x'>link</a> <em>much</em>.</p><ul><li>one</li><li><a>two</a> three</li></ul><section><h2>End</h2><div><p>Last.</p></div></section>"
    expected = "By line.\nWe link much.\none\ntwo three\nEnd\nLast."
    assert html_text.main_text(f"{before}<{mark}>{body}</{mark.split()[0]}>{after}", weight) == expected


def test_deep_nesting_takes_linear_time():
    assert html_text.main_text("<div>" * 100_000 + "</q>" * 100_000 + "<b>x " * 100_000, {}) == " ".join(["x"] * 100_000)


@pytest.mark.parametrize(
    "page, expected",
    [
        (None, ""),
        ("", ""),
        ("<html></html>", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<nav>a b c</nav><div><p>One <b>t</b>wo<br>three</p><div class='cookie-notice'>no</div><p>four\n five six seven</p></div>", "One two\nthree\nfour five six seven"),
        ("<p>good words here</p><section id=comments><p>a reader said a lot of things here</p></section>", "good words here"),
        ("<script>var t='</p>';</script><p>text<!-- no --> more</p><form><p>your name</p></form>", "text more"),
        ("<p>open <i>never closed<p>next", "open never closed\nnext"),
        ("<p>" + "lang " * 200_000 + "</p>", " ".join(["lang"] * 200_000)),
    ],
)
def test_main_text(page, expected):
    assert html_text.main_text(page, {}) == expected


@pytest.mark.parametrize(
    "page, expected",
    [
        ('<div class="layout no-sidebar"><p>All of the text.</p></div>', "All of the text."),
        ('<div id="page" class="has-sidebar"><p>One two.</p><div class="sidebar">x</div></div>', "One two."),
        ('<section class="post share-enabled"><p>Three four.</p></section>', "Three four."),
        ('<div class="entry related-posts-on"><p>Five six.</p><div class="related-posts">x</div></div>', "Five six."),
        ('<div class="widget"><article><p>In a widget.</p></article><p>x</p></div>', "In a widget."),
        ('<div class="widget"><p>' + "long text " * 60 + "</p></div><p>short</p>", "long text " * 60),
        ('<article><p>The text.</p></article><div class="related"><article><p>Another page.</p></article></div>', "The text."),
        ("<p>The short text.</p><div class='comments'><p>" + "much said " * 60 + "</p></div>", "The short text."),
        ("<div class='sidebar'><p>All there is.</p></div>", "All there is."),
        ('<nav><main>menu</main></nav><p>The text.</p>', "The text."),
        ('<p>The text.</p><div class="site-footer"><p>x</p></div><div class="cookieNotice">x</div>', "The text."),
    ],
)
def test_layout_classes_do_not_delete_text(page, expected):
    assert html_text.main_text(page, {}) == expected.strip()


def test_best_region_is_the_maximum_sum():
    rng = random.Random(6)
    for _ in range(300):
        scores = [rng.randint(-5, 5) for _ in range(rng.randint(0, 30))]
        a, b = html_text.best_region(scores)
        best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1)), default=0)
        assert sum(scores[a:b]) == best


def test_extract_frame(spark):
    pages = spark.createDataFrame([(1, None, None), (1, None, None), (None, "u", "<p>a</p>")], "page_id long, url string, html string").withColumn("text", F.lit("old"))
    assert sorted((str(r.page_id), r.url, r.text) for r in html_text.extract(pages, {}).collect()) == [("1", None, ""), ("1", None, ""), ("None", "u", "a")]
    assert html_text.extract(pages.limit(0), html_text.fit(pages.limit(0))).count() == 0
