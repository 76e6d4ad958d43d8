"""Byte-pair tokenizers over public vocabulary files (U4; A2, A9 and A10 with real tokens).

A column of texts becomes one struct column of token ids and their character offsets, in
Arrow batches; counts and cuts are built-in functions of that struct. The vocabulary file's
path is a parameter; each worker loads it once.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from searchlane.functions.text import _c
from searchlane.operators.common import worker_object


def _load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task a core
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return tokenizer


def token_spans(col, path: str) -> Column:
    """struct<ids, starts, ends>: token ids and the characters (from 0) each covers. Tokens that
    share a character of several bytes all cover it. A null text has no tokens."""
    @F.pandas_udf("struct<ids: array<int>, starts: array<int>, ends: array<int>>")
    def spans(texts: pd.Series) -> pd.DataFrame:
        tokenizer = worker_object(f"tokenizer:{path}", lambda: _load(path))
        found = tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
        return pd.DataFrame({"ids": [e.ids for e in found], "starts": [[a for a, _ in e.offsets] for e in found],
                             "ends": [[b for _, b in e.offsets] for e in found]})

    return spans(_c(col).cast("string"))


def count_tokens(col, path: str) -> Column:
    return F.size(token_spans(col, path)["ids"]).cast("long")


def first_tokens(col, n: int, path: str) -> Column:
    """A2: the text of the first ``n`` tokens, layout kept; a character that the next token shares
    is left out. A text of at most ``n`` tokens stays as it is."""
    s, c = token_spans(col, path), _c(col)
    return F.when(F.size(s["ids"]) <= n, c).otherwise(F.substring(c, F.lit(1), F.get(s["starts"], F.lit(n))))


def last_tokens(col, n: int, path: str) -> Column:
    """The text of the last ``n`` tokens, cut in the same way."""
    s, c = token_spans(col, path), _c(col)
    end = F.get(s["ends"], F.size(s["ids"]) - n - 1)
    return F.when(F.size(s["ids"]) <= n, c).otherwise(F.substring(c, end + 1, F.length(c)))


def truncate_messages_by_tokens(messages: DataFrame, budget: int, path: str, sample: str = "sample_id",
                                order: str = "msg_idx", content: str = "content") -> DataFrame:
    """A9 with a tokenizer: whole oldest messages go until the rest fits ``budget`` tokens; only the
    last message, when it alone is too long, is cut to the text of its last ``budget`` tokens.
    Adds token_len, the tokens of what stays (of a cut message: ``budget``)."""
    newest = Window.partitionBy(sample).orderBy(F.col(order).desc())
    m = (messages.withColumn("_n", count_tokens(content, path))
         .withColumn("_suffix", F.sum("_n").over(newest.rowsBetween(Window.unboundedPreceding, 0)))
         .withColumn("_last", F.row_number().over(newest) == 1).where((F.col("_suffix") <= budget) | F.col("_last")))
    fits = F.col("_suffix") <= budget
    cut = last_tokens(content, budget, path) if budget > 0 else F.lit("")
    return (m.withColumn(content, F.when(fits, F.col(content)).otherwise(cut))
            .withColumn("token_len", F.least(F.col("_n"), F.lit(max(budget, 0))).cast("long"))
            .drop("_n", "_suffix", "_last"))
