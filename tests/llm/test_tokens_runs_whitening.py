"""Encoding, periodic runs and whitening against the tokenizers library, brute force and plain NumPy."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomlight.llm import bpe, periodic, queries, whitening

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


# ---- 11
def strings(n):
    chance, letters = random.Random(11), [*range(1, 0x250), *range(0x250, 0xD7FF, 7), *range(0xE000, 0x10FFFF, 1013)]
    pieces = ["ing", "tion", " the", "'s", "'ll", "'", "0", "12", "!!", " ", "  ", "\n", "\t", "\x1c", "\x85", "aux", "é", "<|endoftext|>", "\0"]
    for k in range(n):
        if k % 3 == 0:
            yield "".join(map(chr, chance.choices(letters, k=chance.randint(0, 60))))
        elif k % 3 == 1:
            yield "".join(chance.choices(pieces, k=chance.randint(0, 40)))
        else:
            yield chance.choice("ab-= xé") * chance.randint(0, 300) + "".join(chance.choices(pieces, k=5))


def test_ids_are_those_of_the_library(library):
    texts, memo = [*strings(3000), None, ""], bpe.Memo(bpe.vocabulary(PATH), True)
    for _ in range(2):  # the second time all words are remembered
        ids, count = memo.encode(texts)
        for got, text in zip(np.split(ids, np.cumsum(count)[:-1]), texts, strict=True):
            assert got.tolist() == library.encode(text or "", add_special_tokens=False).ids
    assert 0 < memo.failed < len(memo.codes)


def test_words_are_cut_as_the_library_does_for_every_code_point(library):
    texts = [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}1" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 17 == 0)]
    ids, count = bpe.Memo(bpe.vocabulary(PATH), True).encode(texts)
    for got, e in zip(np.split(ids, np.cumsum(count)[:-1]), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got.tolist() == e.ids


def test_slices_and_forgetting_change_nothing(library, monkeypatch):
    text = "".join(strings(300))
    want = library.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(bpe, "SLICE", 7)
    monkeypatch.setattr(bpe, "MEMO", 3)
    monkeypatch.setattr(bpe, "SHORT", 4)
    memo = bpe.Memo(bpe.vocabulary(PATH), True)
    for _ in range(2):
        assert memo.encode([text])[0].tolist() == want


def test_crossing_merges():
    """A pair is compatible just when the exact merging of its bytes gives the pair."""
    v, chance = bpe.vocabulary(PATH), np.random.default_rng(5)
    assert v.good.all()
    a, b = chance.integers(0, 50256, (2, 4000))
    short = chance.integers(0, 600, (2, 4000))
    a, b = np.concatenate([a, short[0]]), np.concatenate([b, short[1]])
    crossed = v.crossed(a, b)
    for x, y, c in zip(a.tolist(), b.tolist(), crossed.tolist(), strict=True):
        assert c == (v.merge(v.bytes[x] + v.bytes[y]) != [x, y])
    assert 0 < crossed.sum() < len(a)


def test_decoding_is_the_librarys(spark, library):
    chance = random.Random(3)
    lists = [[chance.randrange(50300) for _ in range(chance.randint(0, 20))] for _ in range(500)]
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate([*lists, None])], "doc_id long, ids array<int>, decoded string")
    got = {r.doc_id: r.text for r in bpe.decode(df, PATH).collect()}
    assert got == {i: library.decode(x, skip_special_tokens=False) for i, x in enumerate(lists)} | {500: None}


def test_bpe_query(spark, library):
    got = {r.doc_id: r for r in queries.QUERIES["op11_bpe"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_bpe_of_odd_rows(spark, library):
    long = "née word " * 60_000 + "x" * 30_000
    rows = [(1, "a b", "clash"), (1, "a b", "clash"), (None, None, None), (2, "", None), (3, long, ""), (4, "a<|endoftext|>b", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, tuple(r.ids)) for r in bpe.encode(df, PATH).collect()), key=repr)
    assert got == sorted(((i, tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows), key=repr)
    plain = bpe.encode(df.where("doc_id = 4"), PATH, specials=False).first().ids
    assert 50256 not in plain and bpe.decode(bpe.encode(df.where("doc_id = 4"), PATH, specials=False), PATH).first().text == "a<|endoftext|>b"
    assert bpe.decode(bpe.encode(df.limit(0), PATH), PATH).count() == 0


# ---- 12
def runs_by_hand(w):
    n, out = len(w), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            s = w[i : j + q]
            if j > i and len(s) >= max(6, 4 * q) and not any(s[r:] == s[:-r] for r in range(1, q)):
                out.add((i, len(s), q))
            i = max(j, i + 1)
    return sorted(out)


def collapsed_by_hand(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def numbers(chance):
    kind, n = chance.randrange(5), chance.randint(0, 90)
    if kind == 0:
        return [chance.randint(0, 1) for _ in range(n)]
    if kind == 1:
        return [x for _ in range(6) for x in [chance.randint(0, 2) for _ in range(chance.randint(1, 9))] * chance.randint(1, 7)]
    if kind == 2:
        return ([0] * chance.randint(1, 30) + [1]) * chance.randint(1, 6) + [0] * chance.randint(0, 20)
    if kind == 3:
        block = [chance.randint(0, 1) for _ in range(chance.randint(1, 4))] * chance.randint(1, 6) + [2]
        return (block * chance.randint(1, 6) + [chance.randint(0, 3) for _ in range(3)]) * chance.randint(1, 5)
    return [chance.randint(0, 20) for _ in range(n)] + [5] * chance.randint(0, 12)


def test_runs_against_all_periods():
    chance = random.Random(12)
    for _ in range(1500):
        w = numbers(chance)
        assert periodic.runs_of(np.array(w, np.int64)) == runs_by_hand(w)


def test_work_grows_with_the_document(monkeypatch):
    """Documents of one word, of one word with gaps, and of Fibonacci's: a bounded number of extensions for each word."""
    n, calls, extend = 20_000, [0], periodic.extend

    def counted(*a):
        calls[0] += 1
        return extend(*a)

    monkeypatch.setattr(periodic, "extend", counted)
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    for w in ([0] * n, ([0] * (n // 4) + [1]) * 4, [0] * (n // 3) + [1] + [0] * (n // 3) + [2] + [0] * (n // 3), b[:n]):
        calls[0] = 0
        periodic.runs_of(np.array(w))
        assert calls[0] <= 2 * n


def test_runs_of_odd_rows(spark):
    chance = random.Random(13)
    texts = [" ".join(f"w{x}" for x in numbers(chance)) for _ in range(60)]
    texts += [None, "", " \t\n", "née née " * 9, " x " * 7, "a\x1cb " * 8, "go " * 50_000, texts[0]]
    rows = [(i if i % 9 else None, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3)
    got = sorted(((r.doc_id, r.collapsed, tuple(map(tuple, r.runs))) for r in periodic.runs(df).collect()), key=repr)
    want = []
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = [(0, 50_000, 1)] if len(w) == 50_000 else runs_by_hand(w)
        want.append((i, collapsed_by_hand(w, runs), tuple(runs)))
    assert got == sorted(want, key=repr)
    assert periodic.runs(df.limit(0)).count() == 0


def test_runs_query(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op12_periodic_runs"](spark, SF).collect()}
    docs, found = spark.read.parquet(f"{SF}/documents.parquet").collect(), 0
    assert len(got) == len(docs)
    for d in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        h, n = zlib.crc32(str(d.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        elif n > 3000:
            continue  # by hand too slow
        runs, r = runs_by_hand(w), got[d.doc_id]
        found += len(runs)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{s},{m},{q}\n" for s, m, q in runs))
        assert r.collapsed_sha256 == sha(collapsed_by_hand(w, runs))
    assert found > 10


# ---- 13
def check_white(rows, vectors):
    x = np.array([[int(np.floor(1024 * c)) + 100_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(axis=0)
    centred = (x * n - s).astype(float) / n
    v = centred.T @ centred / n
    value, vector = (a[..., ::-1] for a in np.linalg.eigh(v))
    k = min(8, int((value > np.trace(v) * 1e-12).sum()))
    white = centred @ vector[:, :k] / np.sqrt(value[:k])
    deviation = ((x * n - s) ** 2).sum(axis=1)
    assert len(rows) == n * k and {r.component for r in rows} == set(range(1, k + 1))
    got = np.zeros((n, k))
    for r in rows:
        got[r.vec_id, r.component - 1] = r.whitened
        assert (r.n, int(r.deviation_exact)) == (n, deviation[r.vec_id])
        assert r.deviation == (deviation[r.vec_id] if deviation[r.vec_id] < 1 << 63 else None)
        assert r.explained == pytest.approx(value[r.component - 1] / np.trace(v), rel=1e-9) and r.identity_error <= 1e-4
    for c in range(k):
        assert min(abs(got[:, c] - white[:, c]).max(), abs(got[:, c] + white[:, c]).max()) < 1e-6
    assert abs(got.T @ got / n - np.eye(k)).max() < 1e-9


def test_whitening_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    assert [r.vec_id for r in rows] == list(range(len(rows)))
    check_white(queries.QUERIES["op13_whitening"](spark, SF).collect(), [r.embedding for r in rows])


def whitened(spark, rows, tmp_path, schema="vec_id long, embedding array<double>, key string"):
    spark.createDataFrame(rows, schema).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    return whitening.op13_whitening(spark, str(tmp_path)).collect()


def test_whitening_of_odd_rows(spark, tmp_path):
    chance = np.random.default_rng(2)
    good = [(chance.normal(size=5) * [1, 2, 3, 4, 5]).tolist() for _ in range(40)]
    good += [good[3], good[3], [0.0] * 5]
    odd = [None, [], [1.0, None, 1.0, 1.0, 1.0], [float("nan")] * 5, [float("inf"), 1.0, 1.0, 1.0, 1.0], [1e300, 1.0, 1.0, 1.0, 1.0], [1.0, 2.0]]
    rows = [(i, v, "clash") for i, v in enumerate(good)] + [(1000 + i, v, "clash") for i, v in enumerate(odd)]
    check_white(whitened(spark, rows, tmp_path), good)
    huge = [(1e12 * chance.normal(size=5)).tolist() for _ in range(12)]
    check_white(whitened(spark, [(i, v, "") for i, v in enumerate(huge)], tmp_path), huge)
    flat = [[*v[:3], 7.0, v[0]] for v in good]
    check_white(whitened(spark, [(i, v, "") for i, v in enumerate(flat)], tmp_path), flat)
    assert whitened(spark, [], tmp_path) == whitened(spark, [(1, [1.0, 2.0], "")], tmp_path) == []


def test_sums_are_exact_in_every_task(spark):
    x = spark.range(3000).select(F.lit(1).alias("key"), F.expr("array(9000000000000000000 - id % 2, -9000000000000000000 + id % 3, id)").alias("x"))
    w = whitening.fit(x)
    assert (w.n, w.sums) == (3000, [9 * 10**18 * 3000 - 1500, -9 * 10**18 * 3000 + 3000, 3000 * 2999 // 2])
