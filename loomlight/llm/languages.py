"""Language identification by cross-parsing entropy.

A suffix automaton per language holds a bounded sample of its labelled text. A text is cross-parsed against each: the
longest match from where the last one ended is a phrase. The language whose automaton needs the fewest phrases per
character wins. Texts are lower-cased and anything but letters becomes one space. Whole texts are parsed, each in one
go: so that a block of documents advances together by table look-ups, segments of SEGMENT characters are first parsed
as if a phrase began at each; then each is parsed again from the state in which the one before ends, until the states
agree, which they do from there on. Segments whose last state has changed pass it on, until none has.

Bounds: labelled texts are cut into pieces of PIECE characters, all through. The sample takes PIECES of them (those
with the smallest hash), shared evenly by the languages, at least one for each and at most MOST. So the automata that
are broadcast have fewer than 2 * PIECE * PIECES states in all, as long as there are no more languages than PIECES.

Defined cases: a null text and one without letters are `und` with score 0; ties fall to the language first by code
point; without labelled text all is `und`; repeated rows are judged alike and count once in the sample; texts of any
length are parsed whole, one at a time if they exceed BLOCK; other columns are ignored; an empty table gives no rows.
Documents whose crc32(doc_id) mod 3 is 1 are held out of learning.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare, table

PIECE, PIECES, MOST, SEGMENT, BLOCK = 1500, 1024, 16, 512, 1 << 22


@lru_cache(1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text; runs of anything but letters are one space."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[c]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.where(letter, c, 32)[keep]


def automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a text of symbols 1, 2, ... by state; the root is 1, 0 is none."""
    step: list[dict[int, int]] = [{}, {}]
    link, length, last = [0, 0], [0, 0], 1
    for c in text:
        step.append({})
        length.append(length[last] + 1)
        link.append(1)
        new, p = len(step) - 1, last
        while p and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                clone = len(step) - 1
                while p and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return step


class Moves:
    """Transitions (state, symbol) -> state as rows laid over each other: the place of a transition is its state's base
    plus its symbol, and says whose it is. Rows with several transitions look for free places, longest rows first and
    rows of a length from where the last one fitted; single ones fill the gaps. So the table grows with the
    transitions, whatever the alphabet.
    """

    def __init__(self, rows: list[dict[int, int]], symbols: int):
        self.base = np.zeros(len(rows), np.int64)
        taken, tried = bytearray(2 * (sum(map(len, rows)) + symbols) + 1), {}
        free = 0
        held: list[tuple[int, int, int]] = []
        for s in sorted(range(len(rows)), key=lambda s: -len(rows[s])):
            row = rows[s]
            if not row:
                break
            first, *rest = sorted(row)
            if rest:
                at = max(tried.get(len(row), 0), first)
                while True:
                    at = taken.find(0, at)
                    if at < 0:
                        at = len(taken)
                    if at + symbols >= len(taken):
                        taken.extend(bytes(len(taken)))
                    base = at - first
                    if not any(taken[base + c] for c in rest):
                        break
                    at += 1
                tried[len(row)] = at
            else:
                at = free = taken.find(0, max(free, first)) if taken.find(0, max(free, first)) >= 0 else len(taken)
                if at + symbols >= len(taken):
                    taken.extend(bytes(len(taken)))
                base = at - first
            self.base[s] = base
            for c, t in row.items():
                taken[base + c] = 1
                held.append((base + c, s, t))
        place = np.array(held, np.int64).reshape(-1, 3)
        self.table = np.full(max([*(self.base + symbols).tolist(), 1]), -1)
        self.table[place[:, 0]] = place[:, 1] << 32 | place[:, 2]  # whose place it is, and where it leads
        self.first, self.second = (1, 0) if np.little_endian else (0, 1)

    def __call__(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Where each state goes with each symbol; 0 if nowhere."""
        met = self.table.take(self.base.take(state) + symbol)
        halves = met.view(np.int32).reshape(*met.shape, 2)
        return (halves[..., self.first] == state) * halves[..., self.second]


class Model:
    def __init__(self, samples: dict[str, list[str]]):
        joined = {lang: np.concatenate([codes(t + " ") for t in texts]) for lang, texts in samples.items()}
        self.languages = sorted((lang for lang, c in joined.items() if len(c)), key=lambda s: s.encode())
        known = np.unique(np.concatenate([joined[lang] for lang in self.languages])) if self.languages else np.zeros(0, np.uint32)
        self.known, self.symbols = known, len(known) + 1
        steps = [automaton((np.searchsorted(known, joined[lang]) + 1).tolist()) for lang in self.languages]
        sizes = [len(step) for step in steps]
        self.root = np.cumsum([0, *sizes])[:-1] + 1
        rows = [{c: t + r - 1 for c, t in row.items()} for step, r in zip(steps, self.root.tolist(), strict=True) for row in step]
        self.moves = Moves(rows, self.symbols)
        # where a phrase begins: by language and symbol, the root where the sample doesn't have the symbol
        self.roots = np.repeat(self.root, self.symbols).astype(np.int32)
        for n, r in enumerate(self.root.tolist()):
            self.roots[[n * self.symbols + c for c in rows[r]]] = list(rows[r].values())

    def lookup(self) -> np.ndarray:
        """Symbol of each code point; 0 where the sample doesn't have it."""
        out = np.zeros(0x110000, np.int32)
        out[self.known] = np.arange(1, self.symbols)
        return out

    def phrases(self, texts: list[np.ndarray], symbol: np.ndarray) -> np.ndarray:
        """Number of phrases of each text under each language."""
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        if not self.languages or not texts:
            return out
        data = symbol[np.concatenate(texts)]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        if not len(data):
            return out
        n = -(-lengths // SEGMENT)
        doc = np.repeat(np.arange(len(texts)), n)
        nth = np.arange(len(doc)) - (np.cumsum(n) - n)[doc]
        start = (np.cumsum(lengths) - lengths)[doc] + nth * SEGMENT
        size = np.minimum(SEGMENT, np.cumsum(lengths)[doc] - start)
        order = np.argsort(-size, kind="stable")  # segments by falling size: those that go on are the first ones
        start, size = start[order], size[order]
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        after = np.where(np.append(nth[1:], 0) > 0, np.append(rank[1:], 0), -1)[order]  # the text's next segment
        every = np.arange(len(self.root))[:, None]

        def step(state: np.ndarray, lang: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            to = self.moves(state, c)
            new = to == 0
            return np.where(new, self.roots.take(lang * self.symbols + c), to), new

        # by place in the segment, language and segment: the state after it, and whether a phrase began there
        states, begins = (np.zeros((size[0], len(every), len(size)), kind) for kind in (np.int32, bool))
        state = np.broadcast_to(self.root[:, None], states.shape[1:])
        for t in range(size[0]):
            live = len(size) - np.searchsorted(size[::-1], t, side="right")
            state, begins[t, :, :live] = step(state[:, :live], every, data[start[:live] + t])
            states[t, :, :live] = state

        # again from the state in which the segment before ends
        b = np.flatnonzero(after >= 0)
        a, b = (x.ravel() for x in np.meshgrid(np.arange(len(every)), b, indexing="ij"))
        while len(b):
            a, b, state = a, after[b], states[size[b] - 1, a, b]
            reached, t = [], 0
            while len(b):
                state, new = step(state, a, data[start[b] + t])
                differs = states[t, a, b] != state
                states[t, a, b], begins[t, a, b] = state, new
                t += 1
                ended = differs & (size[b] == t)
                reached.append(np.stack((a[ended], b[ended])))
                goes = differs & ~ended
                a, b, state = a[goes], b[goes], state[goes]
            a, b = np.concatenate(reached, axis=1)
            a, b = a[after[b] >= 0], b[after[b] >= 0]
        np.add.at(out, doc[order], begins.sum(axis=0, dtype=np.int64).T)
        return out + (lengths > 0)[:, None]


def fit(docs: DataFrame) -> Model:
    """Learn from docs(doc_id, text, lang): the numbers of the chosen pieces first, then the texts of these few."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3, F.lit(0)) != 1))
    known = known.select("lang", "doc_id", "text", F.xxhash64("text").alias("digest"))
    pieces = known.where("text <> ''").select("lang", "doc_id", "digest", F.explode(F.expr(f"sequence(0, CAST((length(text) - 1) div {PIECE} AS INT))")).alias("piece"))
    key = ["lang", "doc_id", "digest", "piece"]
    by = Window.partitionBy("lang").orderBy("h", *key[1:])
    ranked = pieces.withColumn("h", F.xxhash64(*key[1:])).withColumn("n", F.dense_rank().over(by)).where(F.col("n") <= MOST)
    chosen = ranked.select("n", *key).distinct()  # at most MOST a language
    languages = max(1, chosen.select("lang").distinct().count())
    chosen = chosen.where(F.col("n") <= max(1, min(MOST, PIECES // languages)))
    rows = known.join(F.broadcast(chosen), ["lang", "doc_id", "digest"]).select(*key, "n", F.expr(f"substring(text, piece * {PIECE} + 1, {PIECE})").alias("text")).distinct().collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.lang.encode(), r.n, r.doc_id, r.digest, r.piece, r.text)):
        samples.setdefault(r.lang, []).append(r.text)
    return Model(samples)


def _predict(batches: Iterator[pa.RecordBatch], model: Broadcast) -> Iterator[pa.RecordBatch]:
    m, symbol = model.value, None
    for b in batches:
        symbol = m.lookup() if symbol is None else symbol
        texts = [codes(t or "") for t in b.column("text").to_pylist()]
        count, at, size = [], 0, 0
        for i, t in enumerate(texts):
            size += -(-len(t) // SEGMENT) * SEGMENT * len(m.languages)
            if size >= BLOCK or i == len(texts) - 1:
                count.append(m.phrases(texts[at : i + 1], symbol))
                at, size = i + 1, 0
        count = np.concatenate(count) if count else np.zeros((0, len(m.languages)), np.int64)
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        if m.languages:
            best = count.argmin(axis=1)
            for i, t in enumerate(texts):
                if len(t):
                    lang[i] = m.languages[best[i]]
            two = np.sort(count, axis=1)[:, :2]
            sound = np.fromiter(map(len, texts), np.int64, len(texts)) > 0
            score[sound] = (1 - two[:, 0] / np.maximum(two[:, -1], 1))[sound] if len(m.languages) > 1 else 1.0
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out).mapInArrow(lambda it: _predict(it, shared), "doc_id long, held_out boolean, lang_pred string, score double")


def op10_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
