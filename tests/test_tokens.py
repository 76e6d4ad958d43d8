"""Counts and cuts by a byte-pair vocabulary, and GAE in bounded blocks."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from searchlane.functions import rl, tokens

PATH = "/opt/tokenizers/byte_bpe_50k.json"
TEXTS = ["", "one", "Hello  world,\n\nthis is   a text.", "naïve Straße 日本語 🙂🙂 end", "<|endoftext|> is text here", "a" * 300]


@pytest.fixture(scope="module")
def tokenizer():
    return tokens._load(PATH)


def test_spans_and_counts(spark, tokenizer):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(99, None)], "i int, t string")
    for r in df.select("t", tokens.token_spans("t", PATH).alias("s"), tokens.count_tokens("t", PATH).alias("n")).collect():
        want = tokenizer.encode(r.t or "", add_special_tokens=False)
        assert (r.s.ids, r.n, list(zip(r.s.starts, r.s.ends))) == (want.ids, len(want.ids), want.offsets)


@pytest.mark.parametrize("n", [1, 2, 5, 9])
def test_cuts_are_at_token_borders(spark, tokenizer, n):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for r in df.select("t", tokens.first_tokens("t", n, PATH).alias("a"), tokens.last_tokens("t", n, PATH).alias("b")).collect():
        e = tokenizer.encode(r.t, add_special_tokens=False)
        if len(e.ids) <= n:
            assert r.a == r.b == r.t
            continue
        head, tail = (tokenizer.decode(x, skip_special_tokens=False) for x in (e.ids[:n], e.ids[-n:]))
        # the decoded ids, without a character of which only some bytes were kept
        assert r.t.startswith(r.a) and r.a == head.rstrip("\ufffd") and r.t.endswith(r.b) and r.b == tail.lstrip("\ufffd")


@pytest.mark.parametrize("budget", [0, 1, 6, 14, 400])
def test_message_budget_equals_a_loop(spark, tokenizer, budget):
    count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    rows = [(s, i, TEXTS[(s + i) % 6]) for s in range(6) for i in range(s + 1)]
    got = {}
    out = tokens.truncate_messages_by_tokens(spark.createDataFrame(rows, "sample_id int, msg_idx int, content string"), budget, PATH)
    for r in out.orderBy("sample_id", "msg_idx").collect():
        got.setdefault(r.sample_id, []).append((r.content, r.token_len))
    for s in range(6):
        kept = [t for x, _, t in rows if x == s]
        while len(kept) > 1 and sum(map(count, kept)) > budget:
            kept.pop(0)
        if sum(map(count, kept)) <= budget:
            assert got[s] == [(t, count(t)) for t in kept]
        else:
            ids = tokenizer.encode(kept[0], add_special_tokens=False).ids
            text = tokenizer.decode(ids[-budget:], skip_special_tokens=False).lstrip("\ufffd") if budget else ""
            assert got[s] == [(text, budget)]


def test_gae_in_small_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=n).tolist(), rng.normal(size=n).tolist()) for i, n in enumerate([5, 0, 3, 40, 1, 2, 7])] + [(9, None, None)]
    df = spark.createDataFrame(rows, "i int, r array<double>, v array<double>")
    monkeypatch.setattr(rl, "GAE_CELLS", 12)
    fn = rl.gae("r", "v", 0.9, 0.8)
    for row in df.select("i", "r", "v", fn.alias("g")).collect():
        if row.r is None:
            assert row.g.advantages is None and row.g.returns is None
            continue
        adv, last = [], 0.0
        for t in range(len(row.r) - 1, -1, -1):
            after = row.v[t + 1] if t + 1 < len(row.v) else 0.0
            last = row.r[t] + 0.9 * after - row.v[t] + 0.9 * 0.8 * last
            adv.insert(0, last)
        assert np.allclose(row.g.advantages, adv) and np.allclose(row.g.returns, np.add(adv, row.v))
