"""The training-data operators against brute force on small fixtures with nulls, empty and repeated rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomlight.llm import common, embeddings, languages, licenses, mixing, near_copies, packing, pages, quality, queries, simhash, substrings, urls
from loomlight.llm.common import Scratch, components, forest

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
random.seed(7)
VOCABULARY = ["alpha", "beta", "Gamma", "δέλτα", "née", "x1", "##", "yes!", "of", "the"]


def prose(n):
    return " ".join(random.choice(VOCABULARY) + random.choice(["", "", "s", "\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = [prose(random.choice([1, 5, 30, 80, 300])) for _ in range(40)]
    texts = [*base, None, "", "   \n\t ", base[3], base[3], base[7] + " " + base[8], base[9] * 3, "word " * 3000, "tail", base[5] + " end"]
    rows = [(i * 3, t, random.choice(["en", "fr", None]), random.choice(["s1", "s2", "s3", None]), None if t is None else len(t), "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string").repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# ---- helpers
def test_forest_finds_components():
    for n, m in ((10, 5), (50, 40), (200, 400)):
        a, b = np.random.default_rng(n).integers(0, n, (2, m))
        label = forest(a, b, n)
        want = list(range(n))
        for _ in range(n):
            for x, y in zip(a, b, strict=True):
                want[x] = want[y] = min(want[x], want[y])
        assert label.tolist() == want


@pytest.mark.parametrize("few", [common.FEW, 0])
def test_components_of_a_long_path_and_a_star(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW", few)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(5000, 5000)]
    random.shuffle(edges)
    with Scratch(spark) as scratch:
        got = {r.node: r.component_id for r in components(spark.createDataFrame(edges, "u long, v long"), scratch).collect()}
        assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(40)}
        assert components(spark.createDataFrame([], "u long, v long"), scratch).count() == 0


def test_operators_leave_one_table_at_most(spark, docs):
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(folder.iterdir())
    assert near_copies.near_copies(docs).count() == simhash.near_duplicates(docs).count() == docs.count()
    assert {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before} == {"near-copies", "simhash"}


# ---- 1
def _check_pieces(df, texts, encode, length=2048):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in df.collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for doc_id, own in pieces.items():
        ids, at = np.array([*encode(texts[doc_id] or ""), 1], "<u4"), 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    padding = total = 0
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
        total += at
    return padding, total


def test_packing_round_trip(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    encode = lambda x: t.encode(x, add_special_tokens=False).ids
    texts = {r.doc_id: r.text for r in docs.collect()}
    padding, total = _check_pieces(packing.pack(docs, path), texts, encode)
    assert padding <= 0.01 * total
    _check_pieces(packing.pack(docs, path, length=64, limit=4), texts, encode, 64)
    assert packing.pack(empty, path).count() == 0
    for text in ("", "<|endoftext|> a", "tab\t\tand  spaces \n\n", "naïve 日本語 🎉", "1234567 don't"):
        assert packing.encoder(path)(text) == encode(text)


# ---- 2
@pytest.mark.parametrize("levels", [embeddings.LEVELS, {100: 1, 120: 0, 1 << 62: 2}])
def test_near_vectors_against_all_pairs(spark, monkeypatch, levels):
    monkeypatch.setattr(embeddings, "SMALL", 100)
    r = np.random.default_rng(3)
    base = r.standard_normal((60, 16))
    rows = []
    for i in range(400):
        v = base[r.integers(60)] * r.uniform(0.5, 3) + r.standard_normal(16) * r.choice([0, 0.05, 0.3])
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(r.integers(3))))
    rows += [(400 + i, rows[5][1], rows[5][2]) for i in range(30)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, rows[5][1], None), (504, [None] * 16, 1), (505, [1.0], 1), (506, [2.0], 1), (507, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("clash")).repartition(3)
    sound = [(i, np.array(v, np.float64), k) for i, v, k in rows if k is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = defaultdict(set)
    for (i, v, k), (j, w, m) in itertools.combinations(sound, 2):
        if k == m and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98:
            links[i].add(j)
            links[j].add(i)
    least = {i: i for i, _, _ in rows}
    for _ in range(30):
        for i in least:
            least[i] = min([least[i], *(least[j] for j in links[i])])
    got = by_id(embeddings.near_vectors(df, levels=levels), "vec_id")
    assert {i: (x.n_links, x.component_id, x.kept) for i, x in got.items()} == {i: (len(links[i]), least[i], least[i] == i) for i in least}
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_no_table_of_vectors_or_links_goes_through_the_driver(spark, monkeypatch):
    monkeypatch.setattr(common, "SENT", 0, raising=False)  # no table counts as few rows
    monkeypatch.setattr(common, "FEW", 0)
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()

    def run() -> dict[int, str]:
        bus.waitUntilEmpty()
        return {e.executionId(): e.physicalPlanDescription() for e in map(store.executionsList().apply, range(store.executionsList().size()))}

    r = np.random.default_rng(11)
    rows = [(i, [float(x) for x in r.standard_normal(4)], i % 2) for i in range(60)]
    rows += [(100 + i, rows[i][1][:3] + [rows[i][1][3] * 1.001], i % 2) for i in range(60)]
    df, before = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), run()
    got = [embeddings.near_vectors(df, levels=levels).where("n_links > 0").count() for levels in (embeddings.LEVELS, {1 << 62: 2})]
    plans = [p for i, p in run().items() if i not in before]
    assert got[0] == got[1] >= 120 and plans and not [p for p in plans if "BroadcastExchange" in p]


def test_dense_cells_are_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CHUNK", 16)
    r = np.random.default_rng(5)
    v = r.standard_normal(16)
    rows = [(i, [float(x) for x in v + 0.01 * r.standard_normal(16)], 1) for i in range(120)]
    got = by_id(embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")), "vec_id")
    assert all(x.n_links == 119 and x.component_id == 0 for x in got.values())


def test_comparisons_grow_slower_than_all_pairs():
    radius, made = embeddings._radius(0.04, 8, 64), []
    for n in (4096, 16384):
        y = embeddings._blocks(embeddings._unit(np.random.default_rng(n).standard_normal((n, 64))), 8)[0]
        y[n // 2 : n // 2 + 50] = y[:50] + 0.6 * radius / np.sqrt(8)  # near ones
        every = np.arange(n)
        pairs = [np.stack(c) for c in embeddings.candidates(y, every, every, radius)]
        made.append(sum(c.shape[1] for c in pairs) / n**2)
        p, q = np.concatenate(pairs, axis=1)
        assert {(k, n // 2 + k) for k in range(50)} <= set(zip(p.tolist(), q.tolist(), strict=True))
    assert max(made) < 0.02  # of all pairs, in each of eight blocks


def test_vectors_of_huge_components(spark):
    rows = [(1, [1e200, 1e199], 1), (2, [1e200, 1.001e199], 1), (3, [-1e200, 1e199], 1)]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert {r.vec_id: r.component_id for r in got.collect()} == {1: 1, 2: 1, 3: 3}


# ---- 3
def test_url_filters(spark):
    entries = spark.createDataFrame([("2024-01-01", "block", "a.com"), ("2024-02-01", "allow", "ok.a.com"), ("2024-03-01", "remove", "a.com"), ("2024-01-01", "block", "b.com/x"), (None, "block", "c.com")], "since string, action string, key string").withColumn("since", F.col("since").cast("date"))
    seen = [(1, "http://www.a.com/p", "2024-01-01"), (2, "http://a.com", "2023-12-31"), (3, "http://www.a.com/p", "2024-03-01"), (4, "https://ok.a.com:80/", "2024-02-02"), (5, "http://b.com/x/y?q", "2024-05-01"), (6, "http://b.com/xy", "2024-05-01"), (7, None, "2024-01-01"), (8, "http://c.com", "2024-05-01"), (9, "http://a.com", None), (10, "nota.com", "2024-01-01")]
    captures = spark.createDataFrame(seen, "id long, url string, fetched string").withColumn("fetched", F.col("fetched").cast("date")).withColumn("key", F.lit("clash"))
    for limit in (urls.BROADCAST, 0):  # the shuffled way as well
        urls.BROADCAST, held = limit, urls.BROADCAST
        got = {r.id: r.kept for r in urls.judge(captures, entries).collect()}
        urls.BROADCAST = held
        assert got == {1: False, 2: True, 3: True, 4: True, 5: False, 6: True, 7: True, 8: True, 9: True, 10: True}
    assert urls.judge(captures, entries.limit(0)).where("NOT kept").count() == 0


def test_url_query_agrees_with_its_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = c.execute(f"SELECT page_id, url, fetched, entry, action, kept FROM ({urls.OP3_SQL}) ORDER BY 1").fetchall()
    got = [tuple(r) for r in urls.op3_url_filters(spark, SF).select("page_id", "url", "fetched", "entry", "action", "kept").orderBy("page_id").collect()]
    assert got == want


def test_captures_without_id_are_judged(spark):
    entries = spark.createDataFrame([("2024-01-01", "block", "a.com")], "since string, action string, key string").withColumn("since", F.col("since").cast("date"))
    captures = spark.createDataFrame([(None, "http://a.com/x"), (None, "http://b.com"), (1, "http://a.com/"), (1, "http://a.com/")], "id long, url string").withColumn("fetched", F.lit("2024-02-01").cast("date"))
    assert sorted((r.url, r.kept) for r in urls.judge(captures, entries).collect()) == [("http://a.com/", False), ("http://a.com/", False), ("http://a.com/x", False), ("http://b.com", True)]


# ---- 4
def _removed(texts, width):
    seen, out = set(), {}
    for i in sorted(texts):
        w = WORD.findall(texts[i] or "")
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            x = tuple(w[k : k + width])
            if x in seen:
                gone[k : k + width] = [True] * width
            seen.add(x)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), kept, hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("width", [3, 20])
def test_substring_dedup_against_all_windows(docs, empty, width):
    got = by_id(substrings.substring_dedup(docs, width, log2_cells=16))
    want = _removed({r.doc_id: r.text for r in docs.collect()}, width)
    assert {i: (r.n_words, r.n_removed, r.kept_text, r.kept_sha256) for i, r in got.items()} == want
    assert sum(w[1] for w in want.values())
    assert substrings.substring_dedup(empty, width, log2_cells=16).count() == 0


def test_windows_that_cancel_in_polynomials_stay(spark):
    """A Thue-Morse word and its complement agree in every polynomial modulo 2 ** 64 with an odd base."""
    word = ["a"]
    while len(word) < 2048:
        word += ["b" if x == "a" else "a" for x in word]
    first = "".join(word)
    other = first.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(19))
    docs = spark.createDataFrame([(1, f"{first} {rest}"), (2, f"{other} {rest}"), (3, f"  {first}\t{rest}\n")], "doc_id long, text string")
    assert {i: r.n_removed for i, r in by_id(substrings.substring_dedup(docs)).items()} == {1: 0, 2: 0, 3: 20}


def test_substring_dedup_with_repeated_ids(spark):
    a, b, c = prose(60), prose(70), prose(80)
    rows = [(1, a), (1, a), (2, b), (2, f"{b} {c}"), (2, None), (3, c), (None, a)]
    got = substrings.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    n = lambda t: len(t.split())
    assert sorted(r.n_removed for r in got if r.doc_id == 1) == [0, 0]
    assert [r.n_removed for r in got if r.doc_id is None] == [0]
    # whichever version of 2 comes first keeps b; c starts in 2
    two = {r.n_words: r.n_removed for r in got if r.doc_id == 2}
    assert two in ({n(b): 0, n(b) + n(c): n(b), 0: 0}, {n(b): n(b), n(b) + n(c): 0, 0: 0})
    assert [r.n_removed for r in got if r.doc_id == 3] == [n(c)]


def test_substring_dedup_of_a_very_long_text(spark):
    long = prose(150_000)
    docs = spark.createDataFrame([(1, long), (2, "x " + long[-50_000:])], "doc_id long, text string")
    got = {i: (r.n_words, r.n_removed, r.kept_text, r.kept_sha256) for i, r in by_id(substrings.substring_dedup(docs)).items()}
    assert got == _removed({r.doc_id: r.text for r in docs.collect()}, 20)


def test_substring_dedup_carries_columns(spark):
    a, b = prose(60), prose(30)
    rows = [(1, a, "x", ["p"], 7), (2, f" {b}\n\n{a}", None, None, 8), (3, f"  {b[:9]}\t tail ", "z", [], 9), (4, None, "n", ["q"], None), (None, f" {a}", "y", ["r", None], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, version string, firsts array<string>, h1 int")
    got = {r.doc_id: (r.kept_text, r.version, r.firsts, r.h1) for r in substrings.substring_dedup(docs, log2_cells=16, verbatim=True, carry=("version", "firsts", "h1")).collect()}
    assert got == {i: (" ".join(b.split()) if i == 2 else text, *rest) for i, text, *rest in rows}


# ---- 5
PAGE = "<html><head><title>t</title><style>x</style></head><body><header>top</header><nav><a>menu</a></nav>{0}<footer>&copy; foot</footer></body></html>"


def test_pages(spark):
    rows = [
        (1, "http://h.com/a/1", PAGE.format("<div class='ad'>buy</div><article><h1>One &amp; two</h1><p>first<br>line <b>bo</b>ld<p>x &lt; y</article><div id=comments><p>me too</div>")),
        (2, "http://h.com/b/1", PAGE.format("<div>shared line</div><div>own two</div>")),
        (3, "http://h.com/b/2", PAGE.format("<div>shared line</div><div>own three</div><form>f<button>b</button></form><script>if (a<b) x()</script>")),
        (4, "http://h.com/b/2", None),
        (5, None, "plain  text\n here"),
        (6, "http://solo.com/", PAGE.format("<main><header>kept</header><p>body<aside>side</aside></main><p class=notice>cookies")),
        (7, "http://c.com/1", "<p>copy</p><p>of it</p>"),
        (8, "http://c.com/2", "<p>copy</p><p>of it</p>"),
        (9, "http://h.com/a/2", ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("lines", F.lit("clash"))
    got = by_id(pages.extract(df), "page_id")
    want = {1: "One & two first line bold x < y", 2: "own two", 3: "own three", 4: "", 5: "plain text here", 6: "kept body", 7: "copy of it", 8: "copy of it", 9: ""}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())
    # the line, the header, the menu and the footer that pages 2 and 3 have in common; the form is page 3's own
    assert (got[2].n_differenced, got[2].n_structural) == (4, 0) and (got[3].n_differenced, got[3].n_structural) == (4, 2)
    assert (got[7].n_differenced, got[6].n_differenced, got[6].n_structural) == (0, 0, 5)
    assert pages.extract(df.limit(0)).count() == 0


def test_pages_pair_with_the_nearest_path(spark):
    menu = lambda m, own: f"<div>menu {m}</div><div>{own}</div>"
    rows = [
        (1, "http://d.com/docs/a.html", menu("top", "one")),
        (2, "http://d.com/docs/v1/10", menu("v1", "two")),
        (3, "http://d.com/docs/v1/9", menu("v1", "three")),
        (3, "http://d.com/docs/v1/9", menu("v1", "three")),
        (4, "http://d.com/docs/v2/x.html", menu("v2", "four")),
        (5, "http://d.com/docs/v2/y.html", menu("v2", "five")),
        (6, "http://d.com/docs/v10/deep/z", menu("v10", "six")),
        (7, "http://d.com/docs/v10/deep/y1", menu("v10", "seven")),
        (8, "http://e.com/docs/v1/9", menu("v1", "eight")),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = [(r.page_id, r.text) for r in pages.extract(df).collect()]
    assert sorted(got) == [(1, "menu top one"), (2, "two"), (3, "three"), (3, "three"), (4, "four"), (5, "five"), (6, "six"), (7, "seven"), (8, "menu v1 eight")]


def test_page_partners_across_ranges(spark):
    r = random.Random(33)
    rows = [(f"h{r.randint(0, 3)}" if i % 3 else "big", "/" + "/".join(r.choice("ab") + str(r.randint(0, 12)) for _ in range(r.randint(1, 3))), i) for i in range(300)] + [("alone", "/x", 300)]
    with Scratch(spark) as scratch:
        got = {x.page_id: x.mate for x in pages._partners(spark.createDataFrame(rows, "host string, path string, page_id long").repartition(5), scratch).collect()}
    shared = lambda a, b: len(pages.commonprefix((a, b)))
    at = {i: (h, p) for h, p, i in rows}
    assert set(got) == set(at) - {300}
    for i, mate in got.items():
        others = [shared(p, at[i][1]) for h, p, j in rows if h == at[i][0] and j != i]
        assert at[mate][0] == at[i][0] and mate != i and shared(at[mate][1], at[i][1]) == max(others)


def _common(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, j in itertools.product(range(len(a)), range(len(b))):
        table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
    return table[-1, -1]


def test_pages_against_brute_force(spark, monkeypatch):
    """Plain pages: everything but what the nearest page shares, by a table of all subsequences."""
    r = random.Random(8)
    own = {i: (f"h{i % 3}", "/" + "/".join(r.choice("abc") for _ in range(r.randint(1, 3))) + f"/{i}", [f"line {r.randint(0, 9)}" for _ in range(r.randint(1, 12))]) for i in range(120)}
    df = spark.createDataFrame([(i, f"http://{h}{p}", "".join(f"<div>{x}</div>" for x in t)) for i, (h, p, t) in own.items()], "page_id long, url string, html string").repartition(4)
    got = {x.page_id: x.text for x in pages.extract(df).collect()}
    order = sorted(own, key=lambda i: (own[i][0], own[i][1], i))
    changed = 0
    for k, i in enumerate(order):
        beside = [order[n] for n in (k - 1, k + 1) if 0 <= n < len(order) and own[order[n]][0] == own[i][0]]
        same = lambda j: pages.commonprefix((own[i][1], own[j][1]))
        mate = max(beside, key=lambda j: (same(j).count("/"), len(same(j))))
        lines = own[i][2]
        n = len(lines) - _common(lines, own[mate][2])
        kept = re.findall(r"line \d", got[i])
        rest = iter(lines)
        assert len(kept) == (n or len(lines)) and all(x in rest for x in kept)
        changed += 0 < n < len(lines)
    assert changed > 40
    # without differencing, these pages keep every line
    monkeypatch.setattr(pages, "common_lines", lambda a, b: set())
    page = [(x, pages.UNDECIDED) for x in own[0][2]]
    assert pages.main_text(page, pages._hashes(page), pages._hashes(page[1:])) == " ".join(own[0][2])


def test_longest_common_subsequence():
    r = random.Random(2)
    for _ in range(100):
        a, b = ([r.randrange(4) for _ in range(r.randrange(9))] for _ in range(2))
        assert len(pages.common_lines(a, b)) == _common(a, b)


# ---- 6
def _statistics(text):
    w = WORD.findall(text or "")
    g = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + d for k in range(len(w) - 2) if g[tuple(w[k : k + 3])] > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_statistics_against_plain_counts(spark, docs, empty):
    long = spark.createDataFrame([(1001, prose(200_000)), (1002, "a b c " + " ".join(map(str, range(100_000))) + " a b c")], "doc_id long, text string")
    some = docs.select("doc_id", "text", F.lit("clash").alias("_words")).unionByName(long.withColumn("_words", F.lit("clash")))
    got = by_id(quality.with_statistics(some))
    want = {r.doc_id: _statistics(r.text) for r in some.collect()}
    assert {i: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for i, r in got.items()} == want
    assert quality.judge(empty, []).count() == 0


def test_learned_rules(spark):
    r = np.random.default_rng(1)
    n = 900
    x = {f: r.random(n) for f in quality.FEATURES} | {"fold": np.arange(n) % 3}
    x["bad"] = ((x["symbols"] > 0.7) & (x["capitals"] > 0.5)) | (x["repeats"] > 0.9)
    rules = quality.learn(x)
    judged = np.zeros(n, bool)
    for rule in rules:
        judged |= quality._holds(rule, x)
    assert (judged & x["bad"]).sum() > 0.9 * x["bad"].sum() and (judged & ~x["bad"]).sum() < 0.02 * n
    assert quality.learn(x | {"bad": np.zeros(n, bool)}) == []
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    kept = queries.QUERIES["op6_quality_rules"](spark, SF).where("NOT base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    right = sum(k["count"] for k in kept if k.kept == (k.quality == 1))
    assert right >= 0.9 * sum(k["count"] for k in kept)
    assert quality.fit(docs, labels.limit(0)) == []


def test_the_fit_sees_one_row_an_id(spark, monkeypatch):
    """An id that twenty thousand rows repeat is one labelled row, and as many rows as labels reach the driver."""
    seen = []
    monkeypatch.setattr(quality, "learn", lambda x: seen.append(len(x["bad"])) or [])
    docs = spark.range(20_300).select(F.expr("if(id < 20000, 7, id)").alias("doc_id"), F.expr("concat_ws(' ', transform(sequence(1, 60), i -> concat('w', i * (id % 5 + 1))))").alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    quality.fit(docs, labels, max_labelled=100)
    quality.fit(docs, labels.where("doc_id = 7"), max_labelled=100)
    assert seen == [100, 1]


# ---- 7
def _fingerprint(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def _groups(ids, linked):
    least = {i: i for i in ids}
    for _ in range(len(ids)):
        for i, j in linked:
            least[i] = least[j] = min(least[i], least[j])
    return least


def test_simhash_tally_drops_pairs_unseen():
    """Pairs that share the three bytes of a list and no fourth are dropped before their bits are looked at."""
    r = np.random.default_rng(3)
    fp = r.integers(0, 1 << 63, 400, dtype=np.uint64) & np.uint64(0x0000000303030303) | np.uint64(0xAABBCC0000000000)
    i, j = np.triu_indices(len(fp), 1)
    x = fp[i] ^ fp[j]
    hit, let_through = simhash.close(x, 4)
    assert hit.tolist() == [k for k, v in enumerate(x.tolist()) if v.bit_count() <= 4]
    assert len(hit) <= let_through == sum(v.to_bytes(8, "big").count(0) >= 4 for v in x.tolist())
    fp = r.integers(0, 1 << 40, 2000, dtype=np.uint64) | np.uint64(0xAABBCC0000000000)
    x = fp[:-1] ^ fp[1:]
    assert simhash.close(x, 4)[1] < len(x) / 20


@pytest.mark.parametrize("chunk", [2048, 2])
def test_simhash_against_all_pairs(docs, empty, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    fps = {r.doc_id: _fingerprint(r.text) for r in docs.collect()}
    for bits in (4, 7):
        got = by_id(simhash.near_duplicates(docs, bits))
        least = _groups(fps, [(i, j) for i, j in itertools.combinations(fps, 2) if (fps[i] ^ fps[j]).bit_count() <= bits])
        assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{f:016x}", least[i]) for i, f in fps.items()}
    assert simhash.near_duplicates(empty).count() == 0


def test_index_links_all_near_fingerprints(spark):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = list({b ^ sum(1 << x for x in r.sample(range(64), k)) for b in base for k in (0, 1, 3, 4, 5)})
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "node long, fp long")
    got = {r.node: r.component_id for r in components(simhash.links(df, 4), Scratch(spark)).collect()}
    least = _groups(range(len(fps)), [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 4])
    assert {i: got.get(i, i) for i in least} == least


def test_position_sets_cover():
    for least in range(1, 9):
        sets = simhash.position_sets(least)
        assert all(any(set(s) <= set(c) for s in sets) for c in itertools.combinations(range(8), least))
    assert len(simhash.position_sets(4)) == 20


def test_near_copies(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    rows, want, n = [], {}, 0
    for _ in range(12):
        w = [word() for _ in range(300)]
        first = n
        for k in range(4):
            v = list(w)
            for at in r.sample(range(300), k):
                v[at] = word()
            rows.append((n, " ".join(v)))
            want[n] = first
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "a b"), (n + 3, "a  b"), (n + 4, "b a")]
    want |= {n: n, n + 1: n, n + 2: n + 2, n + 3: n + 2, n + 4: n + 4}
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cluster", F.lit(1))
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(df).collect()} == want
    assert near_copies.near_copies(df.limit(0)).count() == 0


def _exact_groups(texts):
    """Components of all pairs whose sets of five-word shingles have a Jaccard similarity of at least 4 / 5."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    least = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if least[i] != least[j] and (a or b) and 5 * len(a & b) >= 4 * len(a | b) or not (a or b):
            lo, hi = sorted((least[i], least[j]))
            least = [lo if x == hi else x for x in least]
    return dict(enumerate(least))


def test_near_copies_finds_appended_and_cut_texts(spark):
    r = random.Random(31)
    words = lambda n: ["".join(r.choice("abcdefghijkl") for _ in range(6)) for _ in range(n)]
    texts = []
    for similarity in (0.8, 0.83, 0.87, 0.91, 0.95):
        for _ in range(20):
            own = words(r.randint(80, 250))
            more = int((len(own) - 4) / similarity) - (len(own) - 4)
            texts += [" ".join(own), " ".join(own + words(more))]
            cut = words(r.randint(80, 250))
            texts += [" ".join(cut), " ".join(cut[: len(cut) - int((len(cut) - 4) * (1 - similarity))])]
    want = _exact_groups(texts)
    assert len(set(want.values())) == len(texts) // 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {x.doc_id: x.component_id for x in near_copies.near_copies(df).collect()} == want


@pytest.mark.parametrize("few", [common.FEW, 0])
def test_near_copies_links_by_exact_similarity(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW", few)
    monkeypatch.setattr(near_copies, "CHUNK", 8)
    r = random.Random(32)
    words = lambda n: ["".join(r.choice("abcdefghijkl") for _ in range(6)) for _ in range(n)]
    texts, passage = [], words(60)
    for k in range(60):  # shares 74 to 84 in a hundred shingles with its twin
        own = [*passage[: r.randint(0, 60)], *words(300)]
        at = len(own) * (84 - k % 11) // 100
        texts += [" ".join(own), " ".join([*own[:at], *words(r.randint(0, 12))])]
    hub = words(200)
    texts += [" ".join([*hub[: r.randint(150, 200)], *words(r.randint(0, 30))]) for _ in range(40)]
    want = _exact_groups(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {x.doc_id: x.component_id for x in near_copies.near_copies(df).collect()} == want


# ---- 8
def test_mixing_meets_targets(spark, docs, empty):
    got = mixing.mix(docs).collect()
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    names = sorted({s for s in source.values() if s}) + [None]
    sizes = [sum(size[i] for i in size if source[i] == s) for s in names]
    goal = dict(zip(names, mixing.targets(sizes, sum(sizes)), strict=True))
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == sizes[names.index(source[r.doc_id])] and r.target == pytest.approx(goal[source[r.doc_id]])
        assert 0 <= r.taken <= 3 * r["size"]
    for s in names:
        assert sum(r.taken for r in got if source[r.doc_id] == s) == pytest.approx(goal[s], abs=1)
    assert sorted(map(tuple, mixing.mix(docs.repartition(3)).drop("sources").collect())) == sorted(tuple(r[c] for c in ("doc_id", "size", "source_size", "target", "taken")) for r in got)
    assert mixing.mix(empty).count() == 0


def test_targets_and_flow():
    assert mixing.targets([100, 100, 100], 300) == pytest.approx([187.5, 75, 37.5])
    assert mixing.targets([10, 1000, 1000], 2010) == pytest.approx([30, 1320, 660])
    # a document of both sources serves either; nothing is repeated while another is unused
    assert mixing.route([((0,), 10), ((0, 1), 10), ((1,), 10)], [15, 15]) == [10, 10, 10]
    assert mixing.route([((0,), 10), ((0, 1), 10)], [25, 5]) in ([20, 10], [15, 15], [10, 20])  # one more pass over either costs the same
    assert mixing.route([((0,), 10)], [30]) == [30]


def _least_cost(patterns, quotas, most):
    """Cheapest words of each pattern that fill all quotas, by trying every split: (cost, words taken)."""
    price = lambda taken, size: sum(k * k * min(size, max(0, taken - k * size)) for k in range(most))
    best = None
    for split in itertools.product(*[[c for c in itertools.product(*[range(most * size + 1) if s in members else [0] for s in range(len(quotas))]) if sum(c) <= most * size] for members, size in patterns]):
        if tuple(map(sum, zip(*split, strict=True))) == tuple(quotas):
            cost = sum(price(sum(c), size) for c, (_, size) in zip(split, patterns, strict=True))
            best = min(best, cost) if best is not None else cost
    return best, price


def test_flow_is_optimal_for_overlapping_sources():
    for patterns, quotas in [
        ([((0,), 2), ((0, 1), 2), ((1,), 1)], [4, 3]),
        ([((0, 1), 3), ((1, 2), 1), ((2,), 2)], [3, 3, 2]),
        ([((0,), 1), ((0, 1, 2), 2), ((2,), 1)], [3, 2, 3]),
        ([((0, 1), 2), ((0, 1), 1)], [4, 4]),
    ]:
        cost, price = _least_cost(patterns, quotas, 3)
        flow = mixing.route(patterns, quotas, 3)
        assert sum(flow) == sum(quotas)
        assert sum(price(f, size) for f, (_, size) in zip(flow, patterns, strict=True)) == cost


def test_mixing_overlapping_sources(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), i % 4) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind int").withColumn("source", F.lit("clash"))
    members = F.expr("CASE kind WHEN 0 THEN array('a') WHEN 1 THEN array('a', 'b') WHEN 2 THEN array('b', 'c') ELSE array('c') END")
    got = mixing.mix(df, members).collect()
    size = {i: 1 + i % 7 for i, _, _ in rows}
    of = {0: "a", 1: "ab", 2: "bc", 3: "c"}
    sizes = [sum(size[i] for i, _, k in rows if s in of[k]) for s in "abc"]
    goal = mixing.targets(sizes, sum(size.values()))
    taken = {k: sum(r.taken for r in got if tuple(r.sources) == tuple(of[k])) for k in of}
    assert all(0 <= r.taken <= 3 * size[r.doc_id] for r in got)
    assert sum(taken.values()) == pytest.approx(sum(goal), abs=3)
    # a fills from its own documents and the shared ones, no pattern is repeated while another that serves is unused
    patterns = [(tuple("abc".index(x) for x in of[k]), sum(size[i] for i, _, m in rows if m == k)) for k in of]
    assert list(taken.values()) == mixing.route(patterns, [round(g) for g in goal])


# ---- 9
def test_license_scans(spark):
    rows = [
        (1, "Released under the MIT License. The mit-license again: MIT LICENSE"),
        (2, "nothing here"),
        (3, None),
        (4, "x " * 30 + "Permission is hereby granted, free of charge, to any person obtaining a COPY of this software and associated documentation files (the"),
        (5, "This work is licensed under the GNU General Public License, version 3."),
        (6, "Licensed under CC BY-NC 4.0."),
        (7, "permission is hereby granted free of the charge to any person obtaining a copy of this software and associated documentation files"),
        (8, "general public licenses; apache licenſe"),
        (9, ""),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hits", F.lit("clash"))
    got = by_id(licenses.scan(df))
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].labels) == (11, 3, 3, 9, "mit", "mit")
    assert {i: r.labels for i, r in got.items()} == {1: "mit", 2: "", 3: "", 4: "mit", 5: "gpl", 6: "cc-by-nc", 7: "mit", 8: "", 9: ""}
    assert got[4].base_labels == "" and got[4].n_base == 0 and got[4].first_word is None and got[4].spans[0].start == 30
    assert got[3].n_words == 0 and all(0 <= r.score <= 1 for r in got.values())
    assert licenses.scan(df.limit(0)).count() == 0


def test_license_words_fold_ascii_only(spark):
    df = spark.createDataFrame([(1, "MIT License \u212a"), (None, "the mit license"), (None, "Licensed under CC BY-NC 4.0."), (1, "released under the \u212ait license")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.labels) for r in licenses.scan(df).collect())
    assert got == [(0, 3, "mit"), (0, 7, "cc-by-nc"), (1, 3, "mit"), (1, 5, "")]


def test_license_query_against_its_sql(spark):
    """On the given documents, and on whole licenses with words put in, left out and changed."""
    r = random.Random(6)
    made = []
    for n, (_, text) in enumerate(licenses.TEMPLATES):
        w = text.split()
        for change in range(4):
            v = [x for x in w if r.random() > 0.03 * change]
            for _ in range(change):
                v.insert(r.randrange(len(v) + 1), "extra")
            made.append((100_000 + 10 * n + change, "Intro, " + " ".join(v).title() + ". " + prose(5)))
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    df = given.unionByName(spark.createDataFrame(made, given.schema))
    c = duckdb.connect()
    c.register("documents", df.toArrow())
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    want = c.execute(f"SELECT {', '.join(columns)} FROM ({licenses.OP9_SQL}) ORDER BY 1").fetchall()
    got = [tuple(x) for x in licenses.scan(df).select(*columns).orderBy("doc_id").collect()]
    assert got == want
    assert all(labels for i, *_, labels, _ in got if i >= 100_000 and i % 10 == 0)


# ---- 10
def test_automaton_holds_all_substrings():
    text = "abcbcabacb"
    code = [ord(c) - 96 for c in text]
    steps = languages.automaton(code)
    inside = {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
    for n in range(1, 6):
        for t in itertools.product("abc", repeat=n):
            s = 1
            for c in t:
                s = steps[s].get(ord(c) - 96, 0) if s else 0
            assert bool(s) == ("".join(t) in inside)


def test_automata_of_large_alphabets_stay_small():
    """Two languages of thousands of letters: what is broadcast grows with the sample, not with letters times states."""
    r = random.Random(4)
    samples = {k: ["".join(chr(r.randrange(0x4E00, 0x4E00 + 4000)) for _ in range(1500)) for _ in range(16)] for k in "xy"}
    m = languages.Model(samples)
    assert m.symbols > 3500 and m.moves.table.nbytes + m.moves.base.nbytes < 40 * 3 * 2 * 24_000
    text = samples["x"][3][100:900] + samples["y"][5][:300]
    joined = {k: "".join(map(chr, languages.codes(" ".join(v) + " "))) for k, v in samples.items()}
    assert m.phrases([languages.codes(text)], m.lookup())[0].tolist() == [_phrases(text, joined[k]) for k in m.languages]


def _phrases(text, sample):
    n, at = 1, ""
    for c in text:
        if at + c in sample:
            at += c
        else:
            n, at = n + 1, c if c in sample else ""
    return n


def test_phrases_against_plain_parsing():
    samples = {"a": ["the cat sat on the mat with a hat"], "b": ["le chat est sur la table et dort"]}
    m = languages.Model(samples)
    texts = ["the chat sat", "sur la mat éé", "x", "the table on the hat " * 60]
    got = m.phrases([languages.codes(t) for t in texts], m.lookup())
    joined = {k: "".join(map(chr, languages.codes(v[0] + " "))) for k, v in samples.items()}
    for t, row in zip(texts, got, strict=True):
        c = "".join(map(chr, languages.codes(t)))
        assert row.tolist() == [_phrases(c, joined[k]) for k in m.languages]


def test_phrases_longer_than_segments(monkeypatch):
    monkeypatch.setattr(languages, "SEGMENT", 8)
    r = random.Random(1)
    samples = {k: ["".join(r.choice("abc ") for _ in range(200))] for k in "xyz"}
    m = languages.Model(samples)
    joined = {k: "".join(map(chr, languages.codes(v[0] + " "))) for k, v in samples.items()}
    texts = [joined["x"], joined["y"][50:] + joined["x"], "", "a", joined["z"] * 2, "".join(r.choice("abcd ") for _ in range(500))]
    got = m.phrases([languages.codes(t) for t in texts], m.lookup())
    for t, row in zip(texts, got, strict=True):
        c = "".join(map(chr, languages.codes(t)))
        assert not c or row.tolist() == [_phrases(c, joined[k]) for k in m.languages]


def test_language_sample_is_the_same_for_any_order(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    twice = d.unionAll(d).repartition(7)
    assert (languages.fit(d).moves.table == languages.fit(twice).moves.table).all()


def test_languages_held_out(spark, docs, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = languages.identify(d, languages.fit(d)).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    some = by_id(languages.identify(docs, languages.fit(d)))
    blank = [r.doc_id for r in docs.collect() if not any(c.isalpha() for c in r.text or "")]
    assert blank and all((some[i].lang_pred == "und") == (i in blank) for i in some)
    assert languages.identify(empty, languages.fit(empty)).count() == 0
    assert {r.lang_pred for r in languages.identify(docs, languages.fit(empty)).collect()} == {"und"}


# ---- all
def test_very_long_texts(spark):
    """A text of a million characters and more goes through every operator whole."""
    import public_tokenizers

    long = prose(220_000)
    tail = "released under the MIT License"
    docs = spark.createDataFrame([(1, f"{long} {tail}", "en", "s"), (2, long, "en", "s")], "doc_id long, text string, lang string, source string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    padding, total = _check_pieces(packing.pack(docs, path), {r.doc_id: r.text for r in docs.collect()}, packing.encoder(path))
    assert total > 400_000 and padding < 0.01 * total
    fps = {r.doc_id: int(r.fingerprint, 16) for r in simhash.near_duplicates(docs).collect()}
    assert fps == {r.doc_id: simhash.fingerprint(r.text.encode()) for r in docs.collect()} and fps[1] ^ fps[2] == 0 or bin(fps[1] ^ fps[2]).count("1") <= 4
    got = by_id(licenses.scan(docs))
    assert got[1].labels == "mit" and got[1].n_base == 1 and got[1].first_word == got[1].n_words - 2 and got[2].labels == ""
    m = languages.Model({"en": [long[:3000]], "xx": ["zzz qqq " * 50]})
    assert {r.lang_pred for r in languages.identify(docs, m).collect()} == {"en"}
    assert {r.component_id for r in near_copies.near_copies(docs).collect()} == {1}
    assert {r.doc_id: r["size"] for r in mixing.mix(docs).collect()} == {1: 220_005, 2: 220_000}
    web = spark.createDataFrame([(1, "http://a.b/1", "".join(f"<p>{x}</p>" for x in long.split("\n")))], "page_id long, url string, html string")
    assert pages.extract(web).first().text == " ".join(long.split())


def test_tokens_are_those_of_tokenizers():
    """Over the whole texts of a given table, whose ids the packing takes from the file's merges."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE text IS NOT NULL").fetchall()]
    encode = packing.encoder(path)
    assert len(texts) > 900
    for text, e in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert list(encode(text)) == e.ids


# ---- the pipeline
def test_pipeline(spark):
    import corpus_pipeline as c

    d = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id for r in d.collect()}
    for name, stage in c.STAGES[:-1]:
        d = stage(spark, d, SF)
        assert d.columns == c.COLUMNS, name
        d = spark.createDataFrame(d.collect(), d.schema)
        after = {r.doc_id for r in d.collect()}
        assert after and after <= before
        before = after
    packed = {r.doc_id for r in c.STAGES[-1][1](spark, d, SF).collect()}
    assert packed == before
    empty = spark.createDataFrame([], d.schema)
    for _, stage in c.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_pipeline_with_repeated_rows(spark):
    import corpus_pipeline as c

    once = spark.read.parquet(f"{SF}/documents.parquet")
    some = once.where("doc_id % 3 = 0")
    many = once.unionAll(some).unionAll(some.withColumn("text", F.lit(None).cast("string")))
    local = lambda d: spark.createDataFrame(d.collect(), d.schema)
    for name, stage in c.STAGES[:-1]:
        before, (once, many) = once, (local(stage(spark, d, SF)) for d in (once, many))
        rows = sorted((tuple(r) for r in many.collect()), key=repr)
        assert rows == sorted((tuple(r) for r in once.collect()), key=repr), name
        if name == "simhash_near_dedup":
            texts = sorted((r.doc_id, r.text) for r in before.collect())
            groups = _exact_groups([t for _, t in texts])
            assert sorted(r[0] for r in rows) == [texts[i][0] for i, k in groups.items() if i == k]


def test_null_ids(spark):
    long = prose(200)
    docs = spark.createDataFrame([(None, long, "en", None, 1), (1, long, None, "s", 1), (2, long, "en", "s", None), (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    import public_tokenizers

    assert {r.doc_id for r in packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()} == {None, 1, 2}
    assert {r.doc_id: r.n_removed > 0 for r in substrings.substring_dedup(docs, log2_cells=16).collect()} == {None: False, 1: False, 2: True}
    for f in (simhash.near_duplicates, near_copies.near_copies):
        assert sorted((r.doc_id or 0, r.component_id or 0) for r in f(docs).collect()) == [(0, 0), (0, 0), (1, 1), (2, 1)]
    assert quality.judge(docs, []).count() == mixing.mix(docs).count() == licenses.scan(docs).count() == 4
    assert {r.lang_pred for r in languages.identify(docs, languages.fit(docs)).collect()} <= {"en", "und"}
    vectors = spark.createDataFrame([(None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted((r.vec_id or 0, r.n_links, r.kept) for r in embeddings.near_vectors(vectors).collect()) == [(0, 0, True), (1, 1, True), (2, 1, False)]
    web = spark.createDataFrame([(None, "http://a.b/", "<p>x</p>"), (1, None, None)], "page_id long, url string, html string")
    assert sorted(r.text for r in pages.extract(web).collect()) == ["", "x"]
