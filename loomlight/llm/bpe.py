"""Byte-level BPE, encoding by speculation and verification, and decoding.

A text is cut into words by the pre-tokenizer's pattern. For the words that a task hasn't met, greedy longest match over
all of them at once proposes tokens. Then every adjacent pair of proposed tokens is tested: the two are compatible if
no merge joins their touching ends while both ends are there. A token's end pieces are known from its own merges: the
right end of the left token and the left end of the right token are undone step by step, latest merge first, and at each
step the pair of ends that lived at the same time is looked up among the merges. Tokens that encode to themselves, each
compatible with the next, are what merging by rank gives, so only words with a failing pair are merged exactly: short
ones side by side, the least merge of each a round, long ones by a heap of ranks. Tests and pairs are NumPy arrays; words are remembered, up to MEMO of them, while a task lasts.

Texts are cut where a word must end anyway (before white space that follows something else), so a very long text is
worked off in slices; memory beyond the text itself is some bytes a word. Work is by row: no shuffle, no skew.

Defined cases: a null or empty text has no ids; repeated rows and ids are encoded each on their own; no ties arise
(equal ranks go from the left); other columns are dropped but the keys; an empty table gives no rows. A text that
spells a special token takes its id, as the library does, unless specials=False. Decoding drops ids that the file
doesn't have and puts U+FFFD for bytes that aren't UTF-8; null ids give a null text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache, partial
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import prepare, table

#: Characters of a text that are worked off at once, distinct words that a task remembers, and bytes of a word that is
#: merged with others at once.
SLICE, MEMO, SHORT = 1 << 20, 1 << 18, 64
#: Fixed value: the pattern of byte-level pre-tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = 1 << 40


class Vocabulary:
    """Tokens, merges and the trie of a tokenizers file of kind byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, pre = file["model"], file["pre_tokenizer"] or {}
        plain = not (file.get("normalizer") or pre.get("add_prefix_space") or model.get("ignore_merges") or model.get("dropout") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"))
        if not plain or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True):
            raise ValueError(f"{path} is no plain byte-level BPE")
        # byte-level vocabularies show printable Latin-1 as itself and the other bytes from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        byte = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.special}
        raw = {i: bytes(byte[c] for c in t) for t, i in vocab.items()}
        self.n = n = max([*raw, *self.special.values()]) + 1
        self.bytes = [b""] * n
        for i, t in [*raw.items(), *((i, t.encode()) for t, i in self.special.items())]:
            self.bytes[i] = t
        self.of_byte = [-1] * 256
        for i, t in raw.items():
            if len(t) == 1:
                self.of_byte[t[0]] = i
        if min(self.of_byte) < 0:
            raise ValueError(f"{path} lacks tokens of single bytes")
        self.rank, self.left, self.right = np.full(n, -1), np.full(n, -1), np.full(n, -1)
        self.made: dict[int, tuple[int, int]] = {}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        for rank, (a, b) in enumerate(pairs):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.made.setdefault(left * n + right, (rank, whole))
            if self.rank[whole] < 0:
                self.rank[whole], self.left[whole], self.right[whole] = rank, left, right
        keys = np.array(sorted(self.made))
        self.pair, self.pair_rank, self.whole = keys, *(np.array([self.made[k][n] for k in keys.tolist()]) for n in (0, 1))
        self._trie(raw)
        self._sound(len(pairs))
        self.size = np.array([len(t) for t in self.bytes])
        self.at = np.concatenate(([0], np.cumsum(self.size)))
        self.all_bytes = np.frombuffer(b"".join(self.bytes), np.uint8)

    def _trie(self, raw: dict[int, bytes]) -> None:
        """Edges as sorted keys node * 256 + byte, and the token that ends at each node."""
        edges, ends = {}, {}
        for i, t in raw.items():
            node = 0
            for b in t:
                node = edges.setdefault(node << 8 | b, len(edges) + 1)
            if len(t) == 1 or self.rank[i] >= 0:
                ends[node] = i
        self.edge = np.array(sorted(edges))
        self.to = np.array([edges[k] for k in self.edge.tolist()])
        self.ends = np.full(len(edges) + 1, -1)
        self.ends[list(ends)] = list(ends.values())

    def _sound(self, merges: int) -> None:
        """Which tokens encode to themselves: their parts do, come before them, and no earlier merge crosses the parts."""
        whole = np.flatnonzero(self.rank >= 0)
        left, right, rank = self.left[whole], self.right[whole], self.rank[whole]
        fine = (self.rank[left] < rank) & (self.rank[right] < rank) & ~self.crossed(left, right, rank)
        self.good = self.rank < 0
        for i in np.argsort(rank).tolist():
            self.good[whole[i]] = fine[i] and self.good[left[i]] and self.good[right[i]]
        if len(whole) != merges:  # two merges make one token: its history isn't known from its name
            self.good[:] = False

    def crossed(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether a merge (of a rank below `before`) joins an end piece of a to one of b while both are there."""
        out, live = np.zeros(len(a), bool), np.arange(len(a))
        x, y = a, b
        x_till = np.full(len(a), NEVER) if before is None else before  # rank at which the piece goes into a longer one
        y_till = x_till
        while len(live):
            at = self.ranks(x, y)
            rank = np.where(at < 0, NEVER, self.pair_rank[at])
            hit = (rank < x_till) & (rank <= y_till)  # of equal merges the left one comes first
            out[live[hit]] = True
            go = ~hit & ((self.rank[x] >= 0) | (self.rank[y] >= 0))
            live, x, y, x_till, y_till = live[go], x[go], y[go], x_till[go], y_till[go]
            last = self.rank[y] >= self.rank[x]
            x, x_till, y, y_till = np.where(last, x, self.right[x]), np.where(last, x_till, self.rank[x]), np.where(last, self.left[y], y), np.where(last, self.rank[y], y_till)
        return out

    def longest(self, text: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token, its bytes) of the longest token that starts at each byte and doesn't pass end."""
        token, size = np.full(len(text), -1), np.ones(len(text), np.int64)
        at, node, depth = np.arange(len(text)), np.zeros(len(text), np.int64), 0
        while len(at):
            key = node << 8 | text[at + depth]
            i = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            ok = self.edge[i] == key
            at, node, depth = at[ok], self.to[i[ok]], depth + 1
            t = self.ends[node]
            token[at[t >= 0]], size[at[t >= 0]] = t[t >= 0], depth
            more = at + depth < end[at]
            at, node = at[more], node[more]
        return token, size

    def merge(self, word: bytes) -> list[int]:
        """The exact ids of a word: the pair of least rank, leftmost first, until none is left."""
        ids = [self.of_byte[b] for b in word]
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        todo = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (m := self.made.get(ids[i] * self.n + ids[i + 1]))]
        heapify(todo)
        while todo:
            _, i, whole, a, b = heappop(todo)
            j = after[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j], after[i], k = whole, -1, after[j], after[j]
            if k >= 0:
                before[k] = i
                if m := self.made.get(whole * self.n + ids[k]):
                    heappush(todo, (m[0], i, m[1], whole, ids[k]))
            h = before[i]
            if h >= 0 and (m := self.made.get(ids[h] * self.n + whole)):
                heappush(todo, (m[0], h, m[1], ids[h], whole))
        return [i for i in ids if i >= 0]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place among the sorted merges of each pair's merge, -1 if there is none."""
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, at, -1)

    def merge_all(self, words: list[bytes]) -> list[np.ndarray]:
        """What merge gives for each of many short words: in each round every word makes its least merge, all over it.

        That is the order by rank if what a merge makes goes into later merges only, as self.good says.
        """
        size = np.array([len(w) for w in words], np.int64)
        ids = np.array(self.of_byte)[np.frombuffer(b"".join(words), np.uint8)]
        word, out = np.repeat(np.arange(len(words)), size), [np.zeros(0, np.int64)] * len(words)

        def rank_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            at = self.ranks(a, b)
            return np.where(at < 0, NEVER, self.pair_rank[at])

        rank = np.append(np.where(word[1:] == word[:-1], rank_of(ids[:-1], ids[1:]), NEVER), NEVER)
        while len(ids):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.minimum.reduceat(rank, first)
            done = least == NEVER
            for i, a, z in zip(word[first[done]].tolist(), first[done].tolist(), np.append(first[1:], len(ids))[done].tolist(), strict=True):
                out[i] = ids[a:z]
            n = np.diff(first, append=len(ids))
            on = np.repeat(~done, n)
            hit = ((rank == np.repeat(least, n)) & on)[on]
            ids, word, rank = ids[on], word[on], rank[on]
            at = np.flatnonzero(hit)
            if not len(at):
                continue
            run = np.diff(at, prepend=-2) != 1  # of pairs that overlap, every other one from the left
            at = at[(np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))) % 2 == 0]
            ids[at] = self.whole[self.ranks(ids[at], ids[at + 1])]
            stays = np.ones(len(ids), bool)
            stays[at + 1] = False
            rank[at] = rank[at + 1]  # NEVER at a word's end
            at = at - np.arange(len(at))
            ids, word, rank = ids[stays], word[stays], rank[stays]
            for left in (at, at[at > 0] - 1):
                left = left[left + 1 < len(ids)]
                left = left[word[left] == word[left + 1]]
                rank[left] = rank_of(ids[left], ids[left + 1])
        return out

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids of all words, their number by word, how many words failed and were merged exactly)."""
        size = np.array([len(w) for w in words], np.int64)
        end = np.cumsum(size)
        token, step = self.longest(np.frombuffer(b"".join(words), np.uint8), np.repeat(end, size))
        path, jump = [], step.tolist()
        for i, e in zip((end - size).tolist(), end.tolist(), strict=True):
            while i < e:
                path.append(i)
                i += jump[i]
        path = np.array(path, np.int64)
        ids, word = token[path], np.searchsorted(end, path, "right")
        pair = np.flatnonzero(word[1:] == word[:-1])
        some, which = np.unique(ids[pair] * self.n + ids[pair + 1], return_inverse=True)
        bad = np.zeros(len(words), bool)
        bad[word[pair[self.crossed(some // self.n, some % self.n)[which]]]] = True
        bad[word[~self.good[ids]]] = True
        failed = np.flatnonzero(bad).tolist()
        short = [i for i in failed if size[i] <= SHORT] if self.good.all() else []
        exact = dict(zip(short, self.merge_all([words[i] for i in short]), strict=True))
        exact = [exact[i] if i in exact else np.array(self.merge(words[i]), np.int64) for i in failed]
        stays = ~bad[word]
        ids = np.concatenate([ids[stays], *exact])
        word = np.concatenate([word[stays], np.repeat(np.array(failed, np.int64), [len(e) for e in exact])])
        order = np.argsort(word, kind="stable")
        return ids[order], np.bincount(word, minlength=len(words)), len(failed)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all ids, and how many of them each of the lists has."""
        row = np.repeat(np.arange(len(counts)), counts)
        known = (ids >= 0) & (ids < self.n)
        ids, row = ids[known], row[known]
        size = self.size[ids]
        place = np.repeat(self.at[ids] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return self.all_bytes[place].tobytes(), np.bincount(row, weights=size, minlength=len(counts)).astype(np.int64)


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Codes(dict):
    """Words by number; a new word takes the next one."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Memo:
    """The ids of the words met so far, in one array."""

    def __init__(self, v: Vocabulary, specials: bool):
        self.v, self.pattern, self.failed = v, regex.compile(PATTERN), 0
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(v.special, key=len, reverse=True))) + ")") if specials and v.special else None
        self.clear()

    def clear(self) -> None:
        self.codes, self.ids, self.count = Codes(), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def words(self, text: str) -> Iterator[list[str]]:
        """The words of a text by slices; a special token is a word by itself, marked by a leading NUL."""
        parts = self.specials.split(text) if self.specials else [text]
        for n, part in enumerate(parts):
            if n % 2:
                yield ["\0" + part]
                continue
            at = 0
            while at < len(part):
                cut = regex.compile(r"(?<=\S)\s").search(part, at + SLICE)
                end = cut.start() if cut else len(part)
                yield self.pattern.findall(part, at, end) if end < len(part) or at else self.pattern.findall(part)
                at = end

    def learn(self) -> None:
        new, self.codes.new = self.codes.new, []
        if not new:
            return
        special = {i for i, w in enumerate(new) if len(w) > 1 and w[0] == "\0" and w[1:] in self.v.special}
        ids, count, failed = self.v.encode([b"" if i in special else w.encode() for i, w in enumerate(new)])
        self.failed += failed
        if special:
            at = np.concatenate(([0], np.cumsum(count)))[sorted(special)]
            ids = np.insert(ids, at, [self.v.special[new[i][1:]] for i in sorted(special)])
            count[sorted(special)] = 1
        self.ids, self.count = np.concatenate([self.ids, ids]), np.concatenate([self.count, count])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, their number by text)."""
        if len(self.codes) > MEMO:
            self.clear()
        codes, n_words = [np.zeros(0, np.int32)], []
        for text in texts:
            n = 0
            for words in self.words(text or ""):
                codes.append(np.fromiter(map(self.codes.__getitem__, words), np.int32, len(words)))
                n += len(words)
            n_words.append(n)
        self.learn()
        code = np.concatenate(codes)
        count = self.count[code]
        start = (np.cumsum(self.count) - self.count)[code]
        till = np.cumsum(count)
        place = np.repeat(start - till + count, count) + np.arange(count.sum())
        ends = np.concatenate(([0], till))[np.cumsum(n_words, dtype=np.int64)] if n_words else np.zeros(0, np.int64)
        return self.ids[place].astype(np.int32), np.diff(ends, prepend=0)


def _encode(batches: Iterator[pa.RecordBatch], path: str, specials: bool) -> Iterator[pa.RecordBatch]:
    memo = Memo(vocabulary(path), specials)
    for b in batches:
        ids, count = memo.encode(b.column("text").to_pylist())
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), pa.array(ids))
        names = [n for n in b.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), lists], [*names, "ids"])


def encode(docs: DataFrame, tokenizer: str, keys: tuple[str, ...] = ("doc_id",), specials: bool = True) -> DataFrame:
    """The keys of docs and ids array<int> of its column text. tokenizer: a file that every executor can read."""
    prepare(docs.sparkSession)
    some = docs.select(*keys, F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{n}` {some.schema[n].dataType.simpleString()}" for n in keys)
    return some.mapInArrow(partial(_encode, path=tokenizer, specials=specials), f"{schema}, ids array<int>")


def _decode(batches: Iterator[pa.RecordBatch], path: str, name: str) -> Iterator[pa.RecordBatch]:
    v = vocabulary(path)
    for b in batches:
        lists = b.column("ids")
        count = np.asarray(lists.value_lengths().fill_null(0), np.int64)
        flat = lists.flatten()
        raw, size = v.decode(np.asarray(flat.fill_null(-1), np.int64), count)
        end, there, texts = np.cumsum(size).tolist(), lists.is_valid().to_pylist(), []
        for a, z, ok in zip((np.cumsum(size) - size).tolist(), end, there, strict=True):
            texts.append(raw[a:z].decode("utf-8", "replace") if ok else None)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, name])


def decode(encoded: DataFrame, tokenizer: str, name: str = "text") -> DataFrame:
    """encoded, which has a column ids array<int>, with the text of the ids added under the name given."""
    prepare(encoded.sparkSession)
    return encoded.mapInArrow(partial(_decode, path=tokenizer, name=name), StructType([*encoded.schema, StructField(name, StringType())]))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    both = decode(encode(table(spark, sf_dir, "documents"), path), path)
    decimal = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
