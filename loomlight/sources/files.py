"""Files of a corpus as tables: discovery by suffix and folder, whole texts, path policy, catalogs and reports."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import partial
from itertools import islice
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SUFFIXES
from .shared import cut

# Folders that are never read, caps on files and sizes, and paths that are never served.
IGNORED = ["node_modules", ".git", "dist", "build", ".next", "__pycache__", ".turbo", "coverage", ".nyc_output", ".cache", "vendor", ".venv", "venv", "env", ".env", ".tox", "target", "bin", "obj", "out", "Pods", ".gradle", ".mvn"]
# Suffixes and ignored folders where the fidelity of script files is measured.
SCRIPT_SUFFIXES = [".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".mts", ".cts"]
SCRIPT_IGNORED = ["node_modules", ".git", "dist", "build", "out", ".next", "coverage", ".cache", "__tests__", "test", "tests"]
# Suffixes and ignored folders where the benchmark measures savings.
BENCHMARK_SUFFIXES = [
    ".js", ".jsx", ".mjs", ".cjs",
    ".ts", ".tsx", ".mts", ".cts",
    ".py", ".pyi",
    ".java", ".cs",
    ".cpp", ".cc", ".cxx", ".c", ".h", ".hpp",
    ".go", ".rs",
    ".rb", ".php",
    ".kt", ".kts", ".swift", ".scala",
    ".html", ".htm", ".css", ".scss", ".sass", ".less",
    ".json", ".yaml", ".yml",
    ".sql", ".sh", ".bash",
    ".vue", ".svelte", ".md", ".markdown",
]
BENCHMARK_IGNORED = ["node_modules", ".git", "dist", "build", "out", ".next", "coverage", ".cache", ".turbo", ".parcel-cache", "__pycache__", ".pytest_cache", "venv", ".venv", "target"]
MAX_FILES, HARD_MAX_FILES, MAX_BYTES = 5000, 50_000, 10 * 1024 * 1024
SENSITIVE = [r"/\.ssh/", r"/\.gnupg/", r"/\.aws/credentials", r"/\.netrc$", r"/etc/passwd$", r"/etc/shadow$"]


def is_source(path: Column, root: str = "", suffixes: list[str] | None = None, ignored: list[str] = IGNORED, hidden: bool = False) -> Column:
    """Known suffix, and no folder below the root that is ignored or, unless asked for, hidden."""
    below = F.regexp_replace(path, "^" + re.escape(root.rstrip("/")), "") if root else path
    folders = F.slice(F.split(below, "/"), 1, F.greatest(F.size(F.split(below, "/")) - 1, F.lit(0)))
    bad = F.exists(folders, lambda f: f.isin(ignored) if hidden else f.isin(ignored) | f.startswith("."))
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)).isin(list(suffixes or SUFFIXES)) & ~bad


def is_script(path: Column, root: str = "") -> Column:
    """What the fidelity of script files is measured on: no folders of tests; hidden ones are walked."""
    return is_source(path, root, SCRIPT_SUFFIXES, SCRIPT_IGNORED, hidden=True)


def is_measured(path: Column, root: str = "") -> Column:
    """What the benchmark measures savings on; hidden folders are walked."""
    return is_source(path, root, BENCHMARK_SUFFIXES, BENCHMARK_IGNORED, hidden=True)


def capped(files: DataFrame, most: int = MAX_FILES) -> DataFrame:
    """The first files(path, ...) by path, up to the cap; `truncated` says whether there were more.

    Only paths are put in order: each task keeps its first ones before they meet. What else the rows hold, such as
    whole contents, stays where it is and is joined to the few paths.
    """
    first = files.select("path").distinct().orderBy("path").limit(most + 1)
    more = first.count() > most
    kept = first.orderBy("path").limit(most)
    return files.join(F.broadcast(kept) if most <= HARD_MAX_FILES else kept, "path", "left_semi").withColumn("truncated", F.lit(more))


_LISTED = "path string, folder boolean, size long, mtime_ms long"


def _listed(batches: Iterator[pa.RecordBatch], suffixes: list[str], ignored: list[str], hidden: bool) -> Iterator[pa.RecordBatch]:
    """The folders and the source files right below each folder. What can't be listed or looked at is left out."""
    wanted, skipped = set(suffixes), set(ignored)

    def below(path: str) -> Iterator[tuple[str, bool, int, int]]:
        try:
            with os.scandir(path) as entries:
                for e in entries:
                    try:
                        if e.is_dir(follow_symlinks=False):
                            if e.name not in skipped and (hidden or not e.name.startswith(".")):
                                yield e.path, True, 0, 0
                        elif Path(e.name).suffix.lower() in wanted and e.is_file():
                            stat = e.stat()
                            yield e.path, False, stat.st_size, stat.st_mtime_ns // 1_000_000
                    except OSError:
                        continue
        except OSError:
            return

    names = [c.split()[0] for c in _LISTED.split(", ")]
    for b in batches:
        for path in b.column("path").to_pylist():
            rows = below(path)
            while some := list(islice(rows, 10_000)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), (pa.string(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], names)


def discover(spark: SparkSession, root: str, suffixes: list[str] | None = None, ignored: list[str] = IGNORED, hidden: bool = False) -> DataFrame:
    """(path, size, mtime_ms) of the source files under a folder that driver and executors see.

    The tasks list folders, a level of the tree a round: its folders are dealt out anew for the next one, so that one
    deep or wide folder doesn't fall to one task alone. Ignored folders aren't entered. Links to folders aren't followed.
    """
    tasks, out = 4 * spark.sparkContext.defaultParallelism, None
    level = spark.createDataFrame([(os.path.normpath(root),)], "path string")
    listing = partial(_listed, suffixes=sorted(suffixes or SUFFIXES), ignored=list(ignored), hidden=hidden)
    while True:
        found = cut(level.repartition(tasks).mapInArrow(listing, _LISTED), "discovered")
        files = found.where("NOT folder").select("path", "size", "mtime_ms")
        out = files if out is None else out.unionAll(files)
        level = found.where("folder").select("path")
        if level.isEmpty():
            return out


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, path in enumerate(b.column("path").to_pylist()):
            try:
                text = Path(path).read_bytes().decode("utf-8", "replace")
            except OSError:
                text = None
            yield pa.RecordBatch.from_arrays([*b.slice(i, 1).columns, pa.array([text])], [*b.schema.names, "content"])


def read_files(spark: SparkSession, root: str, most: int | None = MAX_FILES, max_bytes: int = MAX_BYTES, script: bool = False, benchmark: bool = False) -> DataFrame:
    """(path, size, mtime_ms, truncated, content) of the source files under root, read whole and decoded as UTF-8.

    most: the first so many by path, HARD_MAX_FILES at most; None: all, however many. Files above max_bytes don't
    count. A file that can't be read has a null content. script: only what fidelity is measured on, see is_script;
    benchmark: what savings are, see is_measured. A folder that the driver can list is discovered and read by the tasks,
    a file at a time; it must be one that executors see as well. Any other root is read by Spark, whose reader leaves
    out names that begin with `_` or `.`.
    """
    own = {}
    if script:
        own = {"suffixes": SCRIPT_SUFFIXES, "ignored": SCRIPT_IGNORED, "hidden": True}
    elif benchmark:
        own = {"suffixes": BENCHMARK_SUFFIXES, "ignored": BENCHMARK_IGNORED, "hidden": True}
    first = lambda d: d.withColumn("truncated", F.lit(False)) if most is None else capped(d, min(most, HARD_MAX_FILES))
    local = root.removeprefix("file://")
    if "://" not in local:
        d = first(discover(spark, local, **own).where(F.col("size") <= max_bytes)).select("path", "size", "mtime_ms", "truncated")
        return d.repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(_contents, "path string, size long, mtime_ms long, truncated boolean, content string")
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).load(root)
    d = d.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"), "content")
    d = first(d.where(is_source(F.col("path"), root, **own) & (F.col("size") <= max_bytes)))
    return d.select("path", "size", "mtime_ms", "truncated", F.decode("content", "UTF-8").alias("content"))


def allowed(path: Column, boundary: str) -> Column:
    """Whether a path lies inside the boundary and isn't sensitive."""
    inside = (path == boundary) | path.startswith(boundary.rstrip("/") + "/")
    return inside & ~path.rlike("|".join(SENSITIVE))


def resolve(path: str, root: str, anywhere: bool = False) -> Path:
    """The absolute path of an existing file that the policy allows."""
    if not path:
        raise ValueError("a path must not be empty")
    p = (Path(root) / Path(path).expanduser()).resolve()
    base = Path(root).resolve()
    if any(re.search(s, str(p)) for s in SENSITIVE):
        raise PermissionError(f"{p} is sensitive")
    if not anywhere and p != base and base not in p.parents:
        raise PermissionError(f"{p} is outside {base}")
    if not p.is_file():
        raise FileNotFoundError(p)
    return p


def find_report(start: str, candidates: tuple[str, ...], ancestors: int = 14, named: str | None = None) -> Path | None:
    """The named file if it exists, else the first of the candidates in a folder or the ones above, `ancestors` in all."""
    if named and Path(named).is_file():
        return Path(named).resolve()
    here = Path(start).resolve()
    for folder in [here, *here.parents][:ancestors]:
        for c in candidates:
            if (folder / c).is_file():
                return folder / c
    return None


def workspace_root(report: str) -> Path:
    """The folder that holds the report's folder."""
    return Path(report).resolve().parent.parent


def code_root(given: str | None = None, configured: str | None = None) -> Path:
    """The given folder, else the configured one, else the working folder."""
    return Path(next((x.strip() for x in (given, configured) if x and x.strip()), ".")).resolve()


def catalog_servers(text: str, path: str) -> dict[str, dict]:
    """The servers of a configuration text; what is malformed is an error that names the path and the entry."""
    try:
        whole = json.loads(text)
    except ValueError as e:
        raise ValueError(f"{path} is not valid JSON: {e}") from e
    if not isinstance(whole, dict):
        raise ValueError(f"{path} must hold a JSON object")
    if not isinstance(whole.get("servers"), dict):
        raise ValueError(f"{path} must hold an object `servers`")
    for name, s in whole["servers"].items():
        if not isinstance(s, dict):
            raise ValueError(f"{path}: the entry {name} must be an object")
        if not isinstance(s.get("command"), str) or not s["command"]:
            raise ValueError(f"{path}: the entry {name} needs a `command`")
    return whole["servers"]


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(server, command, args, env, description, disabled) of a configuration file; a missing one has no servers."""
    servers: dict[str, dict] = {}
    if Path(path).exists():
        try:
            text = Path(path).read_text(encoding="utf-8")
        except OSError as e:
            raise ValueError(f"{path} can't be read: {e}") from e
        servers = catalog_servers(text, path)
    as_text = lambda x: x if isinstance(x, str) else None
    rows = [
        (
            name,
            s["command"],
            [str(a) for a in s["args"]] if isinstance(s.get("args"), list) else [],
            {k: str(v) for k, v in s["env"].items()} if isinstance(s.get("env"), dict) else None,
            as_text(s.get("description")),
            s.get("disabled") is True,
        )
        for name, s in servers.items()
    ]
    return spark.createDataFrame(rows, "server string, command string, args array<string>, env map<string,string>, description string, disabled boolean")
