"""Passage blocks that will be cut: whole documents don't travel for them."""
from pyspark.sql import functions as F

from searchlane.functions.text import truncate_tokens_text
from searchlane.operators.observe import passages_to_string


def test_lines_are_cut_before_they_are_sent(spark):
    texts = ["", "a", "a  b c \n d", "w " * 6, "w " * 7 + "\n\n", " x" * 8, "long " * 500, None, " 　 "]
    rows = [(q, r, f'"t {q}"\n{t}' if t is not None else None)
            for q, (a, b) in enumerate((a, b) for a in texts for b in texts) for r, t in ((1, a), (2, b))]
    docs = spark.createDataFrame(rows, "query_id long, rank int, contents string")
    for n in (0, 1, 4, 11, 12, 13, 30):
        cut = lambda d: {r.query_id: r.x for r in d.select("query_id", truncate_tokens_text("result", n).alias("x")).collect()}
        short = passages_to_string(docs, max_tokens=n)
        assert cut(short) == cut(passages_to_string(docs))
        assert short.agg(F.max(F.length("result"))).first()[0] < 400
