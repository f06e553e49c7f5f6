"""Articles kept whole, clashing kept columns, sources of one prefix, hot fingerprints, bins that close."""

import random
from collections import Counter, defaultdict

import pytest

from statgate.llm import html_text, licenses, packing, shards, simhash, urls
from test_text_operators import brute_components, brute_fingerprint

WEIGHTS = {"p": 3.0, "h1": 3.0, "<p": -0.1, "</p": -0.1, "<h1": -0.1, "</h1": -0.1, "<article": -7.7, "</article": -7.7, "<html": -7.7, "<body": -7.7}
FIRST, LAST = "<h1>Title of it</h1><p>" + "first words " * 20 + "</p>", "<p>" + "last words " * 20 + "</p>"
MENU = "<nav><ul>" + "<li><a href='#'>menu</a></li>" * 30 + "</ul></nav>"
ENDS = "Title of it\n" + ("first words " * 20).strip(), ("last words " * 20).strip()


def page(body):
    return f"<html><head><title>t</title></head><body>{MENU}{body}<footer><p>foot words here</p></footer></body></html>"


def rows_of(n):
    return "".join(f"<tr><td>{i}</td><td>cell {i}</td></tr>" for i in range(n))


@pytest.mark.parametrize("between, text", [
    (f"<table><thead><tr><th>n</th></tr></thead><tbody>{rows_of(60)}</tbody></table>", "\n".join(["n", *(x for i in range(60) for x in (str(i), f"cell {i}"))])),
    ("<aside><ul>" + "<li><a href=x>linked item</a></li>" * 100 + "</ul></aside>", None),
    ("<figure><img src=a><figcaption>under it</figcaption></figure>" * 5, "\n".join(["under it"] * 5)),
    ("<ul>" + "<li>an item</li>" * 80 + "</ul>", "\n".join(["an item"] * 80)),
    ("<video controls><source src=a><track></video><div class='ad'>buy this now please</div>" * 20, None),
    ("<form><label>Vote</label><input><button>Send</button></form>" * 8, None),
    ("<dl>" + "<dt>term</dt><dd>meaning of it</dd>" * 30 + "</dl>", "\n".join(["term", "meaning of it"] * 30)),
], ids=["table", "aside", "figures", "list", "video", "forms", "definitions"])
def test_what_stands_amid_an_article_does_not_part_it(between, text):
    want = "\n".join([ENDS[0], *([text] if text else []), ENDS[1]])
    assert html_text.main_text(page(f"<article>{FIRST}{between}{LAST}</article>"), WEIGHTS) == want
    assert html_text.main_text(page(f"<article>{FIRST}{between}{LAST}</article>"), {}) == want  # no labelled pages


@pytest.mark.parametrize("wrap", ["<form id=f action=x><input type=hidden>{}</form>", "<fieldset>{}</fieldset>", "<dialog open><form>{}</form></dialog>"])
def test_a_form_around_the_whole_page_keeps_it(wrap):
    want = "\n".join(ENDS)
    assert html_text.main_text("<html><body>" + wrap.format(f"{MENU}<article>{FIRST}{LAST}</article>") + "</body></html>", WEIGHTS) == want
    assert html_text.main_text("<html><body>" + wrap.format(f"{MENU}<div>{FIRST}{LAST}</div>") + "</body></html>", WEIGHTS) == want


@pytest.mark.parametrize("form", ["<form class=search><label>Search</label><input></form>", "<form><p>please sign up for our letter</p><input></form>",
                                  "<form><select><option>one<option>two</select></form>"])
def test_other_forms_go(form):
    for body in (f"{form}<article>{FIRST}{LAST}</article>", f"<article>{FIRST}{form}{LAST}</article>", f"<article>{FIRST}{LAST}</article>{form}"):
        assert html_text.main_text(page(body), WEIGHTS) == "\n".join(ENDS)


def test_kept_columns_of_clashing_names(spark):
    pages = spark.createDataFrame([(1, "https://x.com/en/a", "<p>words here</p>", "mine", "k", "h", 5, "p", "r", "v")],
                                  "page_id long, url string, html string, text string, key string, host string, hits int, path string, rule string, verdict string")
    (found,) = html_text.extract(pages, {}, keep=("page_id", "text")).collect()
    assert found.asDict() == {"page_id": 1, "_text": "mine", "text": "words here"}
    rules = spark.createDataFrame([("com", "/en/", "block")], "host string, path string, verdict string")
    (judged,) = urls.judge(pages, rules, keep=("page_id", "key", "host", "hits", "path", "rule", "verdict")).collect()
    assert judged.asDict() == {"page_id": 1, "key": "k", "_host": "h", "hits": 5, "_path": "p", "_rule": "r", "_verdict": "v",
                               "host": "x.com", "path": "/en/a", "rule": "com/en/", "verdict": "block"}
    files = spark.createDataFrame([("a/b.py", "x", 9.0, "mine", "o", 1, "n")], "path string, text string, score double, dir string, own string, share int, license string")
    (scanned,) = licenses.scan(files, keep=("score", "dir", "own", "share", "license")).collect()
    assert scanned.asDict() == {"_score": 9.0, "dir": "mine", "own": "o", "share": 1, "_license": "n", "path": "a/b.py", "license": None, "how": "none", "score": None, "from_dir": None}


@pytest.mark.parametrize("prefix", ["", "https://a-long-and-common-prefix.example.com/"])
def test_sources_of_one_prefix_are_split_like_others(spark, prefix):
    rnd = random.Random(5)
    rows = [(i, f"{prefix}s{i % 9}", "en", "x" * 100) for i in range(900)]
    rnd.shuffle(rows)
    made = shards.shard(spark.createDataFrame(rows, "doc_id long, source string, lang string, text string"), 9).collect()
    source = {i: s for i, s, _, _ in rows}
    held = defaultdict(set)
    for r in made:
        held[r.shard].add(source[r.doc_id])
    assert all(len(s) == 1 for s in held.values()) and len(held) == 9


def brute_shards(rows, k, span=None):
    """Plain recursion: bytes of each leaf, left to right, splitting at the weighted median of the widest dimension."""
    if k == 1:
        return [[r["size"] for r in rows]]
    names = ("size", "source", "lang")
    span = span or {d: max(1, max(r[d] for r in rows) - min(r[d] for r in rows)) for d in names}
    wide = max(names, key=lambda d: ((max(r[d] for r in rows) - min(r[d] for r in rows)) / span[d] if rows else 0, -names.index(d)))
    rows = sorted(rows, key=lambda r: (r[wide], r["crc"], r["hash"], r["row"]))
    total = sum(r["size"] for r in rows)
    wanted, below, cut = total * (k // 2) // k, 0, 0
    while cut < len(rows) and abs(below + rows[cut]["size"] - wanted) <= abs(below - wanted):
        below += rows[cut]["size"]
        cut += 1
    return brute_shards(rows[:cut], k // 2, span) + brute_shards(rows[cut:], k - k // 2, span)


def test_shards_equal_a_plain_recursion(spark):
    import zlib

    rnd = random.Random(8)
    rows = [(i, f"src{rnd.randrange(6)}", rnd.choice(["de", "en", "fr"]), "y" * rnd.randrange(1, 400) + str(i)) for i in range(600)]
    made = shards.shard(spark.createDataFrame(rows, "doc_id long, source string, lang string, text string"), 7).collect()
    ranks = {v: n for values in ({r[1] for r in rows}, {r[2] for r in rows}) for n, v in enumerate(sorted(values))}
    plain = [{"size": len(t) + 16, "source": ranks[s], "lang": ranks[g], "crc": zlib.crc32(t.encode()), "hash": 0, "row": i} for i, s, g, t in rows]
    sizes = defaultdict(list)
    for r in made:
        sizes[r.shard].append(r.size)
    want = brute_shards(plain, 7)
    leaf = sum(r["size"] for r in plain) / 7
    for shard, held in enumerate(want):  # a split may be off by a row or a thousandth of a leaf
        assert abs(sum(sizes[shard]) - sum(held)) <= 3 * (416 + leaf / shards.EXACTNESS)
        common = sum((Counter(sizes[shard]) & Counter(held)).values())
        assert common >= 0.93 * len(held)
    for shard in sizes:
        assert sorted(r.slot for r in made if r.shard == shard) == list(range(len(sizes[shard])))


def test_slots_of_rows_of_one_id_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(shards, "SLOT_GROUP", 50)
    rows = [(None, "s", "en", f"text {i}") for i in range(500)]
    made = shards.shard(spark.createDataFrame(rows, "doc_id long, source string, lang string, text string"), 2)
    by_shard = defaultdict(list)
    for r in made.collect():
        by_shard[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values()) and sum(map(len, by_shard.values())) == 500


@pytest.mark.parametrize("hot", [1, 4, 4096])
def test_hot_fingerprints_are_grouped_like_others(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rnd = random.Random(2)
    base = [" ".join(rnd.choice("abcdefgh") * 3 for _ in range(40)) for _ in range(12)]
    texts = [base[0]] * 60 + [rnd.choice(base) + rnd.choice(["", " tail"]) for _ in range(80)] + [""] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_groups(docs, 4, 4).collect()}
    groups = defaultdict(list)
    for i, c in enumerate(brute_components([brute_fingerprint(t, 4) for t in texts], 4)):
        groups[c].append(i)
    assert got == {i: min(g) for g in groups.values() for i in g}


def test_bins_close_fullest_first_and_cost_little():
    rnd = random.Random(9)
    lengths = [min(2048, int(rnd.lognormvariate(5.5, 1.2)) + 1) for _ in range(20_000)]
    bound = -(-sum(lengths) // 2048)
    closed = []

    class Watched(packing.Packer):
        def _take(self, free):
            full = (self.free_bits & -self.free_bits).bit_length() - 1
            if self.open == self.open_bins and free == full:
                closed.append(free)
            return super()._take(free)

    packer = Watched(2048, 64)
    for n in lengths:
        packer.put(n)
    assert len(closed) > 100 and packer.made <= 1.02 * bound + 64  # bins do close, and the bound costs little
    assert packing.OPEN_BINS * 8 <= packing.SHARE
