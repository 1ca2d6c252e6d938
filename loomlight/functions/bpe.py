"""Token counts by a byte-pair encoding: the exact counter that may stand for the estimate.

A text is split into pieces by the vocabulary's pattern, in the JVM; a piece is encoded on its own, whatever surrounds
it, so its length is a function of the piece. Texts use the same pieces again and again: the lengths of all pieces that
the vocabulary itself spells come from it (a broadcast of as many rows as the vocabulary has), of all other pieces each
distinct one is encoded once, wherever and however often it stands. A row adds up its known pieces; only the others
travel, counted per row and piece first, to the table of lengths, and their sums back to the row.

The vocabulary is a file of the `tokenizers` library that every executor can read; it is loaded once a worker.

Defined cases: a null text and a blank one have no tokens; text that spells a special token is ordinary text; a text of
any length is split whole. Letters that this JVM's Unicode version doesn't know yet are split as signs.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..sources.shared import cut

BATCH = 256
# Fixed value: the pattern by which byte-level vocabularies split a text; white space is Unicode's, as they mean it.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"


@lru_cache(4)
def _tokenizer(path: str):  # noqa: ANN202
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # text that spells one is ordinary text
    return t


def _lengths(pieces: list[str], path: str) -> list[int]:
    t, out = _tokenizer(path), []
    for at in range(0, len(pieces), BATCH):
        out += [len(e.ids) for e in t.encode_batch(pieces[at : at + BATCH], add_special_tokens=False)]
    return out


def counter(path: str) -> Callable[[Column], Column]:
    """A function from a text column to its number of tokens, for expressions over few rows; null and blank texts have none."""

    @F.pandas_udf(LongType())
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series(_lengths([x if x and not x.isspace() else "" for x in texts], path), dtype="int64")

    return lambda text: count(text)


def pieces(text: Column) -> Column:
    """The pieces of a text, in order; blank text has none."""
    whole = F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))
    return F.when(text.isNull() | ~text.rlike(r"\P{IsWhite_Space}"), F.array().cast("array<string>")).otherwise(whole)


@lru_cache(4)
def _own(path: str) -> tuple[tuple[str, int], ...]:
    """The vocabulary's entries that are whole pieces of readable text, each with the number of tokens that it takes."""
    t = _tokenizer(path)
    with open(path, encoding="utf-8") as f:
        if json.load(f)["pre_tokenizer"].get("type") != "ByteLevel":
            raise ValueError("the vocabulary isn't a byte-level one")
    texts = sorted({x for i in range(t.get_vocab_size(with_added_tokens=False)) if (x := t.decode([i], skip_special_tokens=False)) and "�" not in x})
    return tuple(zip(texts, _lengths(texts, path), strict=True))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(piece, n) of the vocabulary's own entries: one row an entry, so its size is the vocabulary's."""
    return spark.createDataFrame(pd.DataFrame(_own(path), columns=["piece", "n"]), "piece string, n long")


def piece_lengths(found: DataFrame, path: str) -> DataFrame:
    """(piece, n) of the distinct pieces of found(piece), each encoded once."""

    def encoded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"piece": f["piece"], "n": pd.Series(_lengths(f["piece"].tolist(), path), dtype="int64")})

    return found.select("piece").distinct().mapInPandas(encoded, "piece string, n long")


def token_counts(texts: DataFrame, path: str) -> DataFrame:
    """(id, tokens) of texts(id, text): the tokens of each id's texts together; ids may repeat, a null id is one too."""
    spark = texts.sparkSession
    known = F.broadcast(vocabulary(spark, path).withColumnRenamed("n", "own"))  # bounded by the vocabulary
    ids = texts.select("id", F.explode_outer(pieces(F.col("text"))).alias("piece")).join(known, "piece", "left")
    # rows of one text are neighbours, so its known pieces are nearly added up before anything travels
    other = F.when(F.col("own").isNull(), F.col("piece"))
    split = cut(ids.groupBy("id", other.alias("piece")).agg(F.coalesce(F.sum("own"), F.lit(0)).alias("n"), F.count("*").alias("times")), "pieces")
    rest = split.where("piece IS NOT NULL").select("id", "piece", "times")
    others = rest.join(piece_lengths(rest, path), "piece").select("id", (F.col("times") * F.col("n")).alias("n"))
    return split.where("piece IS NULL").select("id", "n").unionByName(others).groupBy("id").agg(F.sum("n").alias("tokens"))
