"""A keyed store in a folder, of which a change rewrites only the buckets that it touches.

Rows belong to buckets by their key's hash. A change (rows put, hits recorded, keys deleted) names its buckets by its
own keys, reads those of the store, and writes them anew beside the old ones; a manifest then says for each bucket
which folder holds it, and how many rows and characters that is. The manifest is the switch: one file a version,
created and never overwritten. Of two writers that start from one version the second fails and leaves nothing behind;
readers keep the version that they opened, since the last KEPT versions stay. A manifest that a dying writer left
unfinished is skipped.

Totals, and whether a cap is exceeded, are read off the manifest; only then are times, keys and lengths looked at.
The driver sees as many bucket numbers as there are buckets, never keys or rows, but for few keys that a join sends to all tasks.

Defined cases: rows without a key are refused; of several new rows of a key the newest is stored; a change without rows
makes no version; keys that the store doesn't hold are ignored by hits and deletions.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut, sent, shuffled
from . import cache as C

BUCKETS, KEPT = 64, 2


class Conflict(RuntimeError):
    """Another writer has made the next version."""


@dataclass(frozen=True)
class Version:
    """number, buckets of the store, and (folder, rows, characters) of each bucket that holds rows."""

    number: int
    buckets: int
    held: dict[int, tuple[str, int, int]] = field(default_factory=dict)

    @property
    def rows(self) -> int:
        return sum(n for _, n, _ in self.held.values())

    @property
    def chars(self) -> int:
        return sum(n for _, _, n in self.held.values())


class KeyedStore:
    """The store in a folder: rows of a schema with a string key, a text column that caps measure, and updated_at.

    buckets counts for a new folder only; later on the manifest knows it.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str = "file_path", content: str = "content", buckets: int = BUCKETS):
        self.spark, self.folder, self.schema, self.key, self.content = spark, folder.rstrip("/"), schema, key, content
        self.version = self._newest() or Version(0, buckets)

    # ---- files
    def _at(self, path: str):  # noqa: ANN202
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _names(self, path: str) -> list[str]:
        fs, at = self._at(path)
        return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []

    def _delete(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)

    def _manifest(self, name: str) -> Version | None:
        fs, at = self._at(f"{self.folder}/manifests/{name}")
        stream = fs.open(at)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            m = json.loads(text)
        except json.JSONDecodeError:  # its writer died
            return None
        return Version(m["number"], m["buckets"], {int(b): tuple(v) for b, v in m["held"].items()})

    def _versions(self) -> list[Version]:
        """The last versions, newest first."""
        out: list[Version] = []
        for name in reversed(self._names(f"{self.folder}/manifests")):
            if (v := self._manifest(name)) is not None:
                out.append(v)
            if len(out) == KEPT:
                break
        return out

    def _newest(self) -> Version | None:
        return next(iter(self._versions()), None)

    # ---- versions
    def refresh(self) -> Version:
        """Take up the newest version."""
        self.version = self._newest() or self.version
        return self.version

    def _switch(self, held: dict[int, tuple[str, int, int]]) -> Version:
        # the number after the last file, finished or not
        names = self._names(f"{self.folder}/manifests")
        newest = self._newest()
        if newest is not None and newest.number != self.version.number:
            raise Conflict(f"version {self.version.number} isn't the newest any more")
        number = int(names[-1].split("-")[1]) + 1 if names else 1
        made = Version(number, self.version.buckets, held)
        fs, at = self._at(f"{self.folder}/manifests/m-{number:012d}")
        try:
            stream = fs.create(at, False)
        except Py4JJavaError as e:
            raise Conflict(f"version {number} exists already") from e
        stream.write(bytearray(json.dumps({"number": number, "buckets": made.buckets, "held": held}).encode()))
        stream.close()
        self.version = made
        self._tidy()
        return made

    def _tidy(self) -> None:
        """Remove what none of the last versions holds."""
        last = self._versions()
        wanted = {f"{f}/bucket={b}" for v in last for b, (f, _, _) in v.held.items()}
        folders = {w.split("/")[0] for w in wanted}
        oldest = last[-1].number
        for name in self._names(f"{self.folder}/data"):
            if int(name.split("-")[1]) >= self.version.number and name not in folders:
                continue  # of a writer at work, which may yet find that it comes too late
            if name not in folders:
                self._delete(f"{self.folder}/data/{name}")
                continue
            for b in self._names(f"{self.folder}/data/{name}"):
                if b.startswith("bucket=") and f"{name}/{b}" not in wanted:
                    self._delete(f"{self.folder}/data/{name}/{b}")
        for name in self._names(f"{self.folder}/manifests"):
            if int(name.split("-")[1]) < oldest:
                self._delete(f"{self.folder}/manifests/{name}")

    # ---- reading
    def _bucket(self):  # noqa: ANN202
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.version.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of some keys: as many numbers at most as there are buckets."""
        return sorted(r.b for r in rows.where(F.col(self.key).isNotNull()).select(self._bucket().alias("b")).distinct().collect())

    def frame(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows, or those of some buckets, whose files alone are read."""
        held = self.version.held
        some = sorted(held) if buckets is None else [b for b in buckets if b in held]
        if not some:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/data/{held[b][0]}/bucket={b}" for b in some])

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys, from the buckets of these."""
        keys = cut(keys.select(self.key).where(F.col(self.key).isNotNull()).distinct(), "kept-keys")
        return self.frame(self.touched(keys)).join(sent(keys), self.key, "left_semi")

    def get(self, key: str) -> DataFrame:
        """The row of one key: one bucket, and the key reaches the scan."""
        one = self.spark.range(1).select(F.lit(key).alias(self.key))
        return self.frame(self.touched(one)).where(F.col(self.key) == key)

    # ---- changing
    def change(self, delta: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame]) -> Version:
        """Replace the buckets of delta's keys by how(their rows, delta), which leaves keys as they are."""
        delta = cut(delta.where(F.col(self.key).isNotNull()), "kept-change")
        touched = self.touched(delta)
        if not touched:
            return self.version
        rows = how(self.frame(touched), delta).select(*self.spark.createDataFrame([], self.schema).columns)
        name = f"d-{self.version.number + 1:012d}-{uuid.uuid4().hex[:8]}"
        path = f"{self.folder}/data/{name}"
        rows.withColumn("bucket", self._bucket()).repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(path)
        written = self.spark.read.schema(f"{self.schema}, bucket int").parquet(path)
        counted = written.groupBy("bucket").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(self.content)), F.lit(0)).alias("chars")).collect()
        held = {b: v for b, v in self.version.held.items() if b not in set(touched)}
        held |= {r.bucket: (name, r.n, r.chars) for r in counted}
        try:
            return self._switch(held)
        except Conflict:
            self._delete(path)
            raise

    def upsert(self, new: DataFrame) -> Version:
        """Store new rows, the newest of each key."""
        return self.change(new, lambda old, rows: C.upsert(old, rows, self.key))

    def delete(self, keys: DataFrame) -> Version:
        return self.change(keys.select(self.key).distinct(), lambda old, gone: C.delete(old, sent(gone), self.key))

    def clear(self) -> int:
        """Drop all rows; returns how many there were."""
        n = self.version.rows
        self._switch({})
        return n

    def put(self, new: DataFrame, rows: int, chars: int, batch: int = 1, batches: int | None = None) -> Version:
        """Store new rows, then hold the caps on rows and characters, whose victims alone are deleted."""
        self.upsert(new)
        if self.version.rows <= rows and self.version.chars <= chars:
            return self.version
        slim = self.frame().select(self.key, "updated_at", F.col(self.content).alias("content"))
        kept = C.keep_chars(C.keep_newest(slim, rows, self.key), chars, self.key, batch, batches)
        return self.delete(slim.select(self.key).join(shuffled(kept.select(self.key)), self.key, "left_anti"))


# ---- the two stores
CACHE = "file_path string, hash string, content string, tokens long, original_tokens long, type string, hit_count long, updated_at long"
MEMORY = "mem_key string, value string, updated_at long"


class KeptCache(KeyedStore):
    """The content-hash cache in a folder, capped in rows and characters."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS, rows: int = C.CACHE_ROWS, chars: int = C.CACHE_CHARS):
        super().__init__(spark, folder, CACHE, buckets=buckets)
        self.most_rows, self.most_chars = rows, chars

    def store(self, new: DataFrame) -> Version:
        """Store new views within the cache's caps."""
        return self.put(new, self.most_rows, self.most_chars, C.CACHE_BATCH, C.MAX_BATCHES)

    def record_hits(self, hits: DataFrame) -> Version:
        """Add hits(file_path, n, at)."""
        return self.change(hits.select("file_path", "n", "at"), lambda old, new: C.record_hits(old, sent(new)))

    def check(self, seen: DataFrame, now_ms: int) -> DataFrame:
        """The answers to seen(file_path, hash); hits are counted and entries of changed files go."""
        seen = cut(seen.select("file_path", "hash"), "kept-seen")
        answers = cut(C.checked(self.frame(self.touched(seen)), seen), "kept-answers")
        self.change(answers.where("status <> 'miss'").select("file_path", "status"), lambda old, d: C.after_answers(old, sent(d), now_ms))
        return answers


class KeptMemory(KeyedStore):
    """The key-value memory in a folder."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        super().__init__(spark, folder, MEMORY, "mem_key", "value", buckets)

    def write(self, new: DataFrame) -> Version:
        """Store new(mem_key, value, updated_at) within the memory's caps; empty values are refused."""
        return self.put(new.where("value <> ''"), C.MEMORY_ROWS, C.MEMORY_CHARS, C.MEMORY_BATCH)
