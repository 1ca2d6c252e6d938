"""How much meaning a compressed view keeps: recall, usage and specificity of answers, fidelity and corpus rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import signatures as S
from ..functions import text as T
from ..sources.shared import settled
from .graph import signatures

# The prompts and their scorers, the weights and verdicts of the aggregate, and the recall buckets.
PROMPTS = [("p1-list-exports", "recall"), ("p2-write-usage", "usage"), ("p3-risk-audit", "specificity"), ("p4-test-strategy", "specificity")]
QUESTIONS = {
    "p1-list-exports": ("From the compressed view alone, list each public symbol that the module exports, one a line and nothing else.", "{n} names, one a line"),
    "p2-write-usage": ('From the compressed view alone, write a new TypeScript file that imports from "{path}" and uses three of its exports or more. Code only.', "valid code that uses three exported symbols or more"),
    "p3-risk-audit": ("Which risks does the module run: leaks, unhandled errors, races? Name the symbols of the view that each concerns; general advice does not count.", "two symbols of the view or more by name"),
    "p4-test-strategy": ("How should the module be tested? Name the functions or classes of the view that need tests, and what each test should cover.", "two symbols of the view or more by name"),
}
WEIGHTS = {"recall": 40, "usage": 35, "specificity": 25}
VERDICTS = [(90, "excellent"), (75, "good"), (60, "acceptable"), (30, "lossy")]
BUCKETS = [(1.0, "100%"), (0.95, "95-99%"), (0.9, "90-94%"), (0.75, "75-89%"), (0.5, "50-74%")]
LOWEST, MAX_BYTES = "<50%", 10 * 1024 * 1024


def ground_truth(files: DataFrame) -> DataFrame:
    """What an answer about each of files(path, content) is scored by, from the view that the reader sees of it.

    (path, language, view, symbols, raw_tokens, view_tokens, savings_percent): symbols are the sorted names of the
    signature's exports, functions and classes. A file's signature is read once, for the view and for the names.
    """
    d = signatures(files, "content").select("path", "language", M.tokens(F.col("content")).alias("raw_tokens"), T.canonical_exports(F.col("sig")).alias("symbols"), S.rendered(F.col("sig"), F.col("language")).alias("view"))
    d = d.withColumn("view_tokens", M.tokens(F.col("view")))
    return d.select("path", "language", "view", "symbols", "raw_tokens", "view_tokens", M.percent_saved(F.col("raw_tokens"), F.col("view_tokens")).alias("savings_percent"))


def recall(answer: Column, truth: Column) -> Column:
    """Share of the symbols that the answer contains, whatever the case; 1 without symbols.

    A symbol of word characters can lie in a run of such characters only. So the answer is read once, for its distinct
    runs, and these are searched, however long the answer is; other symbols are searched in the answer itself.
    """
    low = F.lower(answer)
    runs = F.array_join(F.array_distinct(F.regexp_extract_all(low, F.lit(r"([a-z0-9_$]+)"), F.lit(1))), " ")

    def found(said: Column) -> Column:
        return F.size(F.filter(truth, lambda s: F.contains(F.when(F.lower(s).rlike(r"^[a-z0-9_$]+\z"), said["runs"]).otherwise(said["low"]), F.lower(s))))

    n = F.get(F.transform(F.array(F.struct(low.alias("low"), runs.alias("runs"))), found), F.lit(0))  # evaluates both once
    return F.when(F.size(truth) == 0, F.lit(1.0)).otherwise(n / F.size(truth))


def named(answer: Column, symbol: Column) -> Column:
    """Whether the answer names the symbol between word boundaries, where a word has ASCII letters, digits and `_` only.

    A boundary is where a word character meets none: on the side of a symbol that ends in one, none may follow.
    """
    edge = lambda at, end: F.when(F.regexp_like(symbol, F.lit(at)), F.lit(end[0])).otherwise(F.lit(end[1]))
    left = edge(r"^[A-Za-z0-9_]", (r"(?<![A-Za-z0-9_])", r"(?<=[A-Za-z0-9_])"))
    right = edge(r"[A-Za-z0-9_]\z", (r"(?![A-Za-z0-9_])", r"(?=[A-Za-z0-9_])"))
    return F.regexp_like(answer, F.concat(left, T.escape_regex(symbol), right))


def usage(answer: Column, truth: Column, path: Column) -> Column:
    """A third for each symbol used, at most 1; half without an import of the file; 0 without symbols."""
    used = F.size(F.array_intersect(T.identifiers(answer), truth))
    base = T.escape_regex(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]+$", ""))
    imported = F.regexp_like(answer, F.concat(F.lit(r"""(?i)(?<![A-Za-z0-9_])(import|from|require)(?![A-Za-z0-9_])[\s\S]*?["']([^"']*"""), base, F.lit(r"""[^"']*)["']""")))
    return F.when(F.size(truth) == 0, F.lit(0.0)).otherwise(F.least(used / 3, F.lit(1.0)) * F.when(imported, 1.0).otherwise(0.5))


def specificity(answer: Column, truth: Column) -> Column:
    """Half for each symbol that the answer names as a word, at most 1; 0 without symbols."""
    said = F.filter(truth, lambda s: named(answer, s))
    return F.when(F.size(truth) == 0, F.lit(0.0)).otherwise(F.least(F.size(said) / 2, F.lit(1.0)))


def score_answers(answers: DataFrame, truth: DataFrame) -> DataFrame:
    """(path, recall, usage, specificity, score, verdict) for truth(path, symbols); a missing answer is empty."""
    spark = truth.sparkSession
    prompts = F.broadcast(spark.createDataFrame(PROMPTS, "prompt_id string, scorer string"))  # four rows
    asked = truth.withColumn("prompt_id", F.explode(F.array(*[F.lit(p) for p, _ in PROMPTS]))).join(prompts, "prompt_id")
    d = asked.join(answers.select("path", "prompt_id", "text"), ["path", "prompt_id"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    a, t = F.col("text"), F.col("symbols")
    d = d.withColumn("score", F.when(F.col("scorer") == "recall", recall(a, t)).when(F.col("scorer") == "usage", usage(a, t, F.col("path"))).otherwise(specificity(a, t)))
    d = d.groupBy("path").agg(*[F.coalesce(F.avg(F.when(F.col("scorer") == s, F.col("score"))), F.lit(0.0)).alias(s) for s in WEIGHTS])
    return d.withColumn("score", M.half_up(sum((F.col(s) * w for s, w in WEIGHTS.items()), F.lit(0.0)))).withColumn("verdict", verdict(F.col("score")))


def verdict(score: Column) -> Column:
    out = F.when(score >= VERDICTS[0][0], VERDICTS[0][1])
    for least, name in VERDICTS[1:]:
        out = out.when(score >= least, name)
    return out.otherwise("broken")


def mock_answer(symbols: Column, path: Column, prompt_id: Column, perfect: bool = True) -> Column:
    """What a perfect provider says; a faulty one names half of the symbols and says nothing else."""
    some = symbols if perfect else F.slice(symbols, 1, F.floor(F.size(symbols) / 2).cast("int"))
    listed = F.array_join(some, "\n")
    if not perfect:
        return F.when(prompt_id == PROMPTS[0][0], listed).otherwise(F.lit("Be careful and test the code."))
    used = F.concat(F.lit("import { "), F.array_join(symbols, ", "), F.lit(' } from "'), path, F.lit('";\n'), listed)
    return F.when(prompt_id == PROMPTS[1][0], used).otherwise(listed)


def fidelity(files: DataFrame) -> DataFrame:
    """files(path, content, compressed): symbols, found, missed, recall, precision of each file that exports any."""
    d = settled(files.select("path", "content", "compressed"), truth=T.truth_symbols(F.col("content")), ids=T.identifiers(F.col("compressed")))
    d = settled(d.where(F.size("truth") > 0), found=F.size(F.array_intersect("truth", "ids")).cast("long"))
    n = F.size("truth").cast("long")
    return d.select("path", n.alias("symbols"), "found", (n - F.col("found")).alias("missed"), (F.col("found") / n).alias("recall"), F.when(F.size("ids") > 0, F.col("found") / F.size("ids")).otherwise(0.0).alias("precision"))


def bucket(share: Column) -> Column:
    out = F.when(share >= BUCKETS[0][0], BUCKETS[0][1])
    for least, name in BUCKETS[1:]:
        out = out.when(share >= least, name)
    return out.otherwise(LOWEST)


def histogram(spark: SparkSession, scored: DataFrame) -> DataFrame:
    """(bucket, files) for every bucket, also empty ones."""
    names = spark.createDataFrame([(n,) for _, n in BUCKETS] + [(LOWEST,)], "bucket string")
    counted = scored.groupBy(bucket(F.col("recall")).alias("bucket")).agg(F.count("*").alias("files"))
    return names.join(counted, "bucket", "left").select("bucket", F.coalesce("files", F.lit(0)).alias("files"))


def rollup(measured: DataFrame, by: str = "language") -> DataFrame:
    """measured(language, original_tokens, optimized_tokens): files, tokens and savings of each group."""
    d = measured.groupBy(by).agg(F.count("*").alias("files"), F.sum("original_tokens").alias("original_tokens"), F.sum("optimized_tokens").alias("optimized_tokens"))
    return d.withColumn("savings_percent", M.percent_saved(F.col("original_tokens"), F.col("optimized_tokens")))


def totals(measured: DataFrame) -> DataFrame:
    """One row: files, tokens before and after, savings, and dollars saved at each price."""
    d = measured.agg(F.count("*").alias("files"), F.coalesce(F.sum("original_tokens"), F.lit(0)).alias("original_tokens"), F.coalesce(F.sum("optimized_tokens"), F.lit(0)).alias("optimized_tokens"))
    d = d.withColumn("savings_percent", M.percent_saved(F.col("original_tokens"), F.col("optimized_tokens")))
    return d.withColumns({f"saved_{p}": M.cost(F.col("original_tokens") - F.col("optimized_tokens"), p) for p in M.PRICES})


#: Providers of answers that need no network: functions of the symbols, the path and the prompt's id.
PROVIDERS = {"mock": lambda symbols, path, prompt: mock_answer(symbols, path, prompt), "faulty": lambda symbols, path, prompt: mock_answer(symbols, path, prompt, perfect=False)}


def provider(name: str):  # noqa: ANN201
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name}; known are {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[name]


def questions(truth: DataFrame) -> DataFrame:
    """(path, prompt_id, scorer, question, expected): what to ask of each file of truth(path, symbols)."""

    def filled(text: str) -> Column:
        return F.replace(F.replace(F.lit(text), F.lit("{path}"), F.col("path")), F.lit("{n}"), F.size("symbols").cast("string"))

    rows = [F.struct(F.lit(p).alias("prompt_id"), F.lit(s).alias("scorer"), filled(QUESTIONS[p][0]).alias("question"), filled(QUESTIONS[p][1]).alias("expected")) for p, s in PROMPTS]
    return truth.select("path", F.explode(F.array(*rows)).alias("p")).select("path", "p.*")


def validate(truth: DataFrame, mode: str = "run", answers: DataFrame | None = None, by: str = "mock") -> DataFrame:
    """truth(path, symbols): the prompts; the scores of given answers(path, prompt_id, text); or those of a provider's."""
    if mode == "prompts":
        return questions(truth)
    if mode == "score":
        if answers is None:
            raise ValueError("to score, answers are needed")
        return score_answers(answers, truth)
    if mode != "run":
        raise ValueError(f"unknown mode {mode}; known are prompts, score, run")
    text = provider(by)(F.col("symbols"), F.col("path"), F.col("prompt_id"))
    return score_answers(questions(truth).join(truth, "path").select("path", "prompt_id", text.alias("text")), truth)


def summary(scored: DataFrame, least: int = VERDICTS[2][0], worst: int = 10) -> dict:
    """What a check of scored files says: their number, mean score, verdict and shares, files below `least`, whether it passes.

    Only aggregates and the lowest scores reach the driver.
    """
    shares = [F.avg(s).alias(s) for s in WEIGHTS]
    a = scored.agg(F.count("*").alias("n"), F.avg("score").alias("score"), F.count_if(F.col("score") < least).alias("below"), *shares).select("*", verdict(F.coalesce(F.col("score"), F.lit(0.0))).alias("verdict")).first()
    low = scored.orderBy("score", "path").limit(worst).collect()
    mean = a.score or 0.0
    return {
        "files": a.n,
        "score": round(mean, 1),
        "verdict": a.verdict,
        **{s: a[s] or 0.0 for s in WEIGHTS},
        "below": a.below,
        "least": least,
        "passed": mean >= least,
        "lowest": [{"path": r.path, "score": r.score, "verdict": r.verdict, **{s: r[s] for s in WEIGHTS}} for r in low],
    }


def report(scored: DataFrame, least: int = VERDICTS[2][0]) -> tuple[str, int]:
    """A text of scored files and the exit status of a check: 1 if the mean score is below `least`."""
    a = summary(scored, least)
    lines = [f"files: {a['files']}", f"score: {a['score']:.1f}", *(f"{s}: {100 * a[s]:.1f}%" for s in WEIGHTS), "", *(f"{r['score']:>3} {r['verdict']} {r['path']}" for r in a["lowest"])]
    return "\n".join(lines), int(not a["passed"])
