"""Quality rules: a learned decision list as ordered Spark conditional expressions.

Statistics of a text are built from DataFrame functions only. Sequential covering learns from labelled ones: a rule is
a conjunction of thresholds, grown by information gain on two thirds of the labelled rows, pruned on the other third,
and accepted if it is precise there; what it covers is set aside and the next one is learned. The list becomes a chain
of conditions in which the first rule that holds rejects.

Labelled rows are a sample of at most MAX_LABELLED documents (those with the smallest hash of their id); the rules
judge all. Everything else covers whole texts and all documents.

Defined cases: a null or empty text has no words and fails the base; a document's labels, if several, count as their
lowest; null labels are ignored; without rows of both classes the list is empty and the base alone decides; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MAX_LABELLED, MAX_RULES, MAX_CONDITIONS, MIN_PRECISION, CUTS = 6000, 12, 4, 0.95, 32
SPACE = r"[\x20\x09-\x0D]+"
FEATURES = ["n_words", "mean_length", "symbols", "capitals", "marks", "repeats", "dup_lines", "distinct"]


def _let(name: str, value: str, body: str) -> str:
    """body with value bound to name: evaluated once, however the optimizer moves the expression."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _repeat_words(words: str) -> str:
    """Words covered by windows of three words that occur at least twice.

    Sorting by 64 bits of the words, then by place, brings equal windows together; neighbours are compared word for
    word. The windows' places, sorted, tell how many words they cover.
    """
    window = "xxhash64(get(w, i), get(w, i + 1), get(w, i + 2))"
    same = " OR ".join(f"coalesce(x.h = get(s, k {o} 1).h AND {' AND '.join(f'get(w, x.i + {d}) = get(w, get(s, k {o} 1).i + {d})' for d in range(3))}, false)" for o in "-+")
    places = _let("s", f"sort_array(transform(sequence(0, size(w) - 3), i -> struct({window} AS h, i AS i)))", f"transform(filter(s, (x, k) -> {same}), x -> CAST(x.i AS BIGINT))")
    covered = _let("p", f"sort_array({places})", "aggregate(transform(p, (x, k) -> least(3L, coalesce(get(p, k + 1) - x, 3L))), 0L, (a, x) -> a + x)")
    return _let("w", words, f"CASE WHEN size(w) < 3 THEN 0L ELSE {covered} END")


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs plus words' count and characters, symbols, repeated lines, repeated words and the features."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def chars(pattern: str) -> Column:
        """Characters that the class holds."""
        return F.length(F.regexp_replace(text, rf"[^{pattern}]+", "")).cast("long")

    trimmed = F.regexp_replace(text, rf"^{SPACE}|{SPACE}\z", "")
    d = docs.withColumn("_words", F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE)).otherwise(F.array().cast("array<string>")))
    d = d.withColumn("n_words", F.size("_words").cast("long"))
    d = d.withColumn("word_chars", F.length(F.regexp_replace(text, SPACE, "")).cast("long")).withColumn("n_symbols", chars(r"#*$%&|<>"))
    d = d.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    d = d.withColumn("n_repeat_words", F.expr(_repeat_words("_words")))
    n, c = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    d = d.withColumn("mean_length", F.col("word_chars") / n).withColumn("symbols", F.col("n_symbols") / c).withColumn("capitals", chars(r"\p{Lu}") / c).withColumn("marks", chars(r"!?|;:{}\[\]\\/=_~^") / c)
    d = d.withColumn("repeats", F.col("n_repeat_words") / n).withColumn("dup_lines", F.col("n_dup_lines") / F.greatest(F.size("_lines"), F.lit(1))).withColumn("distinct", F.size(F.array_distinct("_words")) / n)
    d = d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return d.drop("_words", "_lines")


Rule = list[tuple[str, str, float]]


def _holds(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(x["bad"]), bool)
    for f, op, t in rule:
        out &= x[f] >= t if op == ">=" else x[f] < t
    return out


def _grow(x: dict[str, np.ndarray], features: list[str]) -> Rule:
    """Add the condition of most information gain until only bad rows are covered."""
    rule: Rule = []
    while len(rule) < MAX_CONDITIONS:
        inside = _holds(rule, x)
        bad = x["bad"][inside]
        p0, n0 = int(bad.sum()), int((~bad).sum())
        if not p0 or not n0:
            break
        best, gain = None, 1e-9
        for f in features:
            v = x[f][inside]
            cuts = np.unique(np.concatenate([np.sort(u)[np.arange(CUTS) * len(u) // CUTS] for u in (v[bad], v)]))
            p, n = (len(u) - np.searchsorted(np.sort(u), cuts) for u in (v[bad], v[~bad]))  # rows at or above each cut
            for op, a, b in ((">=", p, n), ("<", p0 - p, n0 - n)):
                g = np.where(a > 0, a * (np.log2(np.maximum(a, 1) / np.maximum(a + b, 1)) - np.log2(p0 / (p0 + n0))), -1)
                if g.max() > gain:
                    best, gain = (f, op, float(cuts[g.argmax()])), float(g.max())
        if best is None:
            break
        rule.append(best)
    return rule


def learn(x: dict[str, np.ndarray], features: list[str] = FEATURES) -> list[Rule]:
    """Sequential covering of the bad rows. x: a column per feature, `bad`, and `fold` 0, 1 or 2 (2: for pruning)."""
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        grow, prune = ({k: v[x["fold"] != 2] for k, v in x.items()}, {k: v[x["fold"] == 2] for k, v in x.items()})

        def worth(rule: Rule, prune: dict = prune) -> tuple[float, int]:
            judged = prune["bad"][_holds(rule, prune)]
            return (2 * judged.sum() - len(judged)) / (len(judged) + 1), -len(rule)

        rule = _grow(grow, features)
        if not rule:
            break
        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=worth)
        inside = _holds(rule, x)
        all_, judged = x["bad"][inside], prune["bad"][_holds(rule, prune)]
        if not len(judged) or all_.mean() < MIN_PRECISION or judged.mean() < MIN_PRECISION:
            break
        rules.append(rule)
        x = {k: v[~inside] for k, v in x.items()}
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional expression: the first rule that holds rejects, else the document is kept."""
    out = None
    for rule in rules:
        test = reduce(lambda a, b: a & b, [F.col(f) >= t if op == ">=" else F.col(f) < t for f, op, t in rule])
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """The decision list for labels(doc_id, quality), 0 meaning bad. Of rows that repeat a doc_id one counts.

    At most max_labelled rows reach the driver.
    """
    marked = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    sample = F.broadcast(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))  # at most max_labelled rows of 12 bytes
    seen = with_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample, "doc_id"))
    row = F.struct(F.xxhash64("text").alias("digest"), "base_failed", *FEATURES, (F.col("quality") == 0).alias("bad"), F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("fold"))
    rows = seen.groupBy("doc_id").agg(F.min(row).alias("row")).select("doc_id", "row.*").collect()
    rows = sorted((r for r in rows if not r.base_failed), key=lambda r: r.doc_id)
    return learn({f: np.array([r[f] for r in rows], bool if f == "bad" else float) for f in [*FEATURES, "bad", "fold"]})


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """docs plus the statistics, base_failed and kept."""
    return with_statistics(docs).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = fit(docs, table(spark, sf_dir, "labels"))
    return judge(docs.select("doc_id", "text"), rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
