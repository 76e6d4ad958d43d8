"""Rollout tables: turn replay, message building, truncation, diffs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from searchlane.functions.text import token_count
from searchlane.session import materialise


def prompt_lengths(df: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Running character and whitespace-token length of a growing
    prompt, per key in turn order (window partitioned by key, never global)."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (df.withColumn("cum_chars", F.sum(F.length(text)).over(w).cast("long"))
            .withColumn("cum_tokens", F.sum(token_count(text)).over(w).cast("long")))


from searchlane.functions.actions import parse_action  # noqa: E402,F401
from searchlane.functions.text import strip, truncate_tokens_text, whitespace_tokens  # noqa: E402
from searchlane.operators.observe import (INVALID_ACTION_HINT, format_observation,  # noqa: E402
                                          information_block, passages_to_string)



def search_requests(steps: DataFrame, keys: list[str], parsed: str = "act") -> DataFrame:
    """J4 fan-out: one row per (step, query position, query) of search actions."""
    return (steps.filter(F.col(f"{parsed}.action") == "search")
            .select(*keys, F.posexplode(f"{parsed}.queries").alias("qpos", "query")))


def search_observations(requests: DataFrame, keys: list[str], retrieve_fn, corpus: DataFrame,
                        max_obs_tokens: int = 500, k: int = 3) -> DataFrame:
    """Distinct queries -> retrieval -> passage block truncated to the token
    budget -> regrouped per step (J4 + V11 dedupe + A1-A3). ``k`` is the retriever's
    number of results a query."""
    from searchlane.operators.observe import attach_docs
    # distinct queries get a 64-bit hash id, so that scoring groups by a long; texts that
    # share a hash are told apart by their rank among them, so the id is exact
    uniq = (requests.select("query").distinct().withColumn("_hash", F.xxhash64("query"))
            .withColumn("_of_hash", F.row_number().over(Window.partitionBy("_hash").orderBy("query")) - 1)
            .withColumn("query_id", F.when(F.col("_of_hash") == 0, F.col("_hash"))
                        .otherwise(F.xxhash64("_hash", "_of_hash")))
            .select("query", "query_id"))
    uniq = materialise(uniq, "distinct_queries")  # read by the search and by both joins
    hits = retrieve_fn(uniq)
    block = passages_to_string(attach_docs(hits, corpus, queries=uniq, k=k), key="query_id", max_tokens=max_obs_tokens)
    res = uniq.join(block.select("query_id", truncate_tokens_text("result", max_obs_tokens).alias("result")), "query_id")
    per_q = (requests.join(res.drop("query_id"), "query", "left")
             .withColumn("result", F.coalesce("result", F.lit(""))))
    key = F.struct(*[F.col(k) for k in keys])
    return (format_observation(per_q.withColumn("_k", key), "_k", "qpos", "query", "result")
            .select(*[F.col(f"_k.{k}").alias(k) for k in keys], "observation"))


def env_step(steps: DataFrame, keys: list[str], text_col: str = "response", active_col: str | None = None,
             do_search: bool = True, retrieve_fn=None, corpus: DataFrame | None = None,
             max_obs_tokens: int = 500, ignore_case: bool = False, k: int = 3) -> DataFrame:
    """A4: one environment step for every row.

    next_obs: search -> ``<information>`` block, answer -> '', invalid -> hint,
    inactive -> ''. Flags: done, valid_action, is_search, obs_budget (null for
    search observations: each query result is already capped).
    """
    s = steps.withColumn("act", parse_action(text_col, ignore_case))
    active = F.col(active_col) if active_col else F.lit(True)
    a = F.col("act.action")
    asked = search_requests(s.filter(active), keys)  # inactive rows retrieve nothing
    if do_search and retrieve_fn is not None:
        obs = search_observations(asked, keys, retrieve_fn, corpus, max_obs_tokens, k)
    else:  # every result is empty; several queries still get their headings
        key = F.struct(*[F.col(c) for c in keys])
        obs = (format_observation(asked.withColumn("result", F.lit("")).withColumn("_k", key), "_k", "qpos", "query", "result")
               .select(*[F.col(f"_k.{c}").alias(c) for c in keys], "observation"))
    s = s.join(obs, keys, "left")
    search_obs = information_block(F.coalesce("observation", F.lit("")))
    next_obs = (F.when(~active, F.lit("")).when(a == "answer", F.lit(""))
                .when(a == "search", search_obs).otherwise(F.lit(INVALID_ACTION_HINT)))
    out = s.select(
        "*", next_obs.alias("next_obs"),
        F.when(~active | (a == "answer"), 1).otherwise(0).alias("done"),
        F.when(active & a.isin("answer", "search"), 1).otherwise(0).alias("valid_action"),
        F.when(active & (a == "search"), 1).otherwise(0).alias("is_search"),
        F.when(active & (a == "search"), F.lit(None).cast("int"))
        .otherwise(F.lit(max_obs_tokens)).alias("obs_budget"))
    return out.drop("observation") if "observation" in out.columns else out


def cap_observation(obs_col, budget_col) -> F.Column:
    """A5: cap only observations that carry a budget (non-search ones)."""
    return F.when(F.col(budget_col).isNull(), F.col(obs_col)) \
        .otherwise(truncate_tokens_text(obs_col, F.col(budget_col)))


def replay_rollouts(responses: DataFrame, max_turns: int, sample: str = "sample_id",
                    turn: str = "turn_idx", text: str = "response") -> DataFrame:
    """Windowed replay of the multi-turn loop from a (sample, turn, text) table.

    Step s of a sample is its s-th response (s = 0..max_turns, the last one
    being the final step without search). With a = first answer step:
    turns = 1 + min(a, max_turns); valid actions / searches count steps up to
    a; still-active = no answer at all. One partial aggregate per sample; no
    group is collected.
    """
    w = Window.partitionBy(sample).orderBy(turn)
    # filter on the row number itself: Spark plans a partial WindowGroupLimit, so
    # at most max_turns + 1 rows of any sample leave a map partition
    s = (responses.withColumn("_rn", F.row_number().over(w))
         .filter(F.col("_rn") <= max_turns + 1)
         .withColumn("step", F.col("_rn") - 1).drop("_rn")
         .withColumn("action", parse_action(text)["action"]))
    # first answer step per sample as a window over the (limited) rows: the data
    # is already partitioned by sample, so no self-join and no second exchange
    j = s.withColumn("answer_step", F.min(F.when(F.col("action") == "answer", F.col("step")))
                     .over(Window.partitionBy(sample)))
    upto = F.col("step") <= F.coalesce(F.col("answer_step"), F.lit(max_turns))
    agg = j.groupBy(sample).agg(
        F.first("answer_step").alias("answer_step"),
        F.sum(F.when(upto & F.col("action").isin("answer", "search"), 1).otherwise(0)).cast("long")
        .alias("valid_actions"),
        F.sum(F.when(upto & (F.col("action") == "search"), 1).otherwise(0)).cast("long").alias("valid_searches"))
    return agg.select(
        sample,
        (1 + F.least(F.coalesce("answer_step", F.lit(max_turns)), F.lit(max_turns))).cast("long").alias("turns"),
        "valid_actions", "valid_searches", F.col("answer_step").isNull().alias("active"))


def collect_status(replay: DataFrame, errors: DataFrame | None = None, sample: str = "sample_id") -> DataFrame:
    """Collector status: completed when an answer exists, failed when still
    no answer after the forced final turn or when the sample errored."""
    st = F.when(~F.col("active"), F.lit("completed")).otherwise(F.lit("failed"))
    out = replay.withColumn("collector_status", st)
    if errors is not None:
        out = out.join(errors.select(sample, "error"), sample, "left") \
            .withColumn("collector_status", F.when(F.col("error").isNotNull(), F.lit("failed"))
                        .otherwise(F.col("collector_status")))
    return out


def collect_rollouts(prompts: DataFrame, model_fn, retrieve_fn=None, corpus: DataFrame | None = None,
                     max_turns: int = 3, max_obs_tokens: int = 500, k: int = 3,
                     sample: str = "sample_id") -> DataFrame:
    """The rollout loop as one DataFrame step a turn, up to ``max_turns`` and a final
    one without search.

    ``prompts`` holds (sample, prompt_text). ``model_fn`` maps (sample, step, prompt_text) to
    the same rows with ``text`` and ``error`` (:func:`generate` does); a row with an error
    or without a text ends its sample as failed. Every turn's model output and log are
    written before they are used, so a lost executor repeats no finished model call.
    Returns the typed turn log: sample, step, prompt_text, text, action, next_obs,
    valid_action, is_search, done, error.
    """
    state, log = prompts.select(sample, "prompt_text"), None
    for step in range(max_turns + 1):
        last = step == max_turns
        said = materialise(model_fn(state.withColumn("step", F.lit(step).cast("long")))
                           .select(sample, "step", "prompt_text", "text", "error"), "rollout_said")
        fine = F.col("error").isNull() & F.col("text").isNotNull()
        acted = env_step(said.filter(fine), [sample], "text", do_search=not last, retrieve_fn=retrieve_fn,
                         corpus=corpus, max_obs_tokens=max_obs_tokens, k=k)
        lost = said.filter(~fine).select(
            sample, "step", "prompt_text", "text", F.lit(None).cast("string").alias("action"),
            F.lit("").alias("next_obs"), F.lit(0).alias("valid_action"), F.lit(0).alias("is_search"), F.lit(0).alias("done"),
            F.coalesce("error", F.lit("no text")).alias("error"))
        turn = materialise(acted.select(
            sample, "step", "prompt_text", "text", F.col("act.action").alias("action"),
            # nothing follows the final answer attempt
            (F.lit("") if last else F.col("next_obs")).alias("next_obs"),
            "valid_action", "is_search", "done", "error").unionByName(lost), "rollout_turn")
        log = turn if log is None else log.unionByName(turn)
        state = (turn.filter(F.col("error").isNull() & (F.col("done") == 0))
                 .select(sample, F.concat("prompt_text", "text", "next_obs").alias("prompt_text")))
        if not last and state.limit(1).count() == 0:
            break
    return log


def rollout_samples(log: DataFrame, sample: str = "sample_id") -> DataFrame:
    """One row a sample of a turn log: status, its turns by kind, its error and
    the largest prompt it reached (whitespace tokens)."""
    answered = F.max("done") == 1
    return log.groupBy(sample).agg(
        F.when(answered, "completed").otherwise("failed").alias("collector_status"),
        F.count("text").alias("assistant_turns"), F.sum("valid_action").cast("long").alias("valid_actions"),
        F.sum("is_search").cast("long").alias("valid_searches"), F.max("error").alias("error"),
        F.max(token_count("prompt_text")).cast("long").alias("max_prompt_tokens"))


def response_segments(log: DataFrame, sample: str = "sample_id") -> DataFrame:
    """What follows the prompt, in order: model texts and environment texts."""
    parts = F.array(F.struct(F.lit(0).alias("part"), F.lit("response").alias("kind"), F.col("text").alias("text")),
                    F.struct(F.lit(1).alias("part"), F.lit("information").alias("kind"), F.col("next_obs").alias("text")))
    return (log.filter(F.col("error").isNull()).select(sample, "step", F.explode(parts).alias("p"))
            .select(sample, "step", "p.*").filter(F.length("text") > 0))


def info_mask(segments: DataFrame, sample: str = "sample_id") -> DataFrame:
    """M4: per sample the response's token mask, 1 on model tokens and 0 on environment
    tokens. A sample's segments are bounded by its turns."""
    runs = F.array_sort(F.collect_list(F.struct("step", "part", token_count("text").alias("n"),
                                                (F.col("kind") == "response").cast("int").alias("own"))))
    return segments.groupBy(sample).agg(F.flatten(F.transform(
        runs, lambda r: F.array_repeat(r["own"], r["n"].cast("int")))).alias("info_mask"))


def build_messages(steps: DataFrame, sample: str = "sample_id", order: str = "turn_idx",
                   text: str = "response", obs: str = "next_obs", ignore_case: bool = True) -> DataFrame:
    """Long message table (sample, msg_idx, role, content): each assistant
    text, then an ``<information>`` user message for a search or the invalid
    hint for an invalid action; nothing after an answer."""
    a = parse_action(text, ignore_case)["action"]
    base = steps.select(sample, order, text, obs, a.alias("_a"))
    asst = base.select(sample, order, F.lit(0).alias("_sub"), F.lit("assistant").alias("role"),
                       F.col(text).alias("content"))
    usr = (base.filter(F.col("_a").isNull() | (F.col("_a") == "search"))
           .select(sample, order, F.lit(1).alias("_sub"), F.lit("user").alias("role"),
                   F.when(F.col("_a") == "search", F.col(obs))
                   .otherwise(F.concat(F.lit("\n"), F.lit(INVALID_ACTION_HINT.strip()), F.lit("\n")))
                   .alias("content")))
    allm = asst.unionByName(usr)
    w = Window.partitionBy(sample).orderBy(order, "_sub")
    return allm.withColumn("msg_idx", (F.row_number().over(w) - 1).cast("long")).drop("_sub")


def truncate_messages(messages: DataFrame, budget: int, sample: str = "sample_id",
                      order: str = "msg_idx", content: str = "content") -> DataFrame:
    """Whole oldest messages go until the rest fits the budget; only the last message,
    when it alone is too long, is cut to its longest fitting token suffix. Whitespace
    tokens by default."""
    toks = whitespace_tokens(content)
    newest = Window.partitionBy(sample).orderBy(F.col(order).desc())
    m = (messages.withColumn("_n", F.size(toks))
         .withColumn("_suffix", F.sum("_n").over(newest.rowsBetween(Window.unboundedPreceding, 0)))
         .withColumn("_last", F.row_number().over(newest) == 1))
    fits = F.col("_suffix") <= budget
    cut = F.array_join(F.slice(toks, F.lit(-budget), F.lit(budget)), " ") if budget > 0 else F.lit("")
    return (m.filter(fits | F.col("_last"))
            .withColumn(content, F.when(fits, F.col(content)).otherwise(cut))
            .withColumn("token_len", F.least(F.col("_n"), F.lit(max(budget, 0))).cast("long"))
            .drop("_n", "_suffix", "_last"))


def max_prompt_tokens(prompts: DataFrame, length_col: str = "token_len", sample: str | None = None) -> DataFrame:
    """A10: largest prompt length over turns, nulls ignored (per sample when given)."""
    grouped = prompts.groupBy(sample) if sample else prompts.groupBy()
    return grouped.agg(F.max(length_col).cast("long").alias("max_prompt_tokens"))


def turn_stats(steps: DataFrame, sample: str = "sample_id", text: str = "response") -> DataFrame:
    """Per sample counts of assistant, search and invalid turns."""
    a = parse_action(text, True)["action"]
    return steps.groupBy(sample).agg(
        F.count(F.lit(1)).alias("assistant_turns"),
        F.sum(F.when(a == "search", 1).otherwise(0)).cast("long").alias("search_turn_count"),
        F.sum(F.when(a.isNull(), 1).otherwise(0)).cast("long").alias("invalid_action_count"))


def observation_diff(retrieval_turns: DataFrame, info_messages: DataFrame, keys: list[str],
                     left_col: str = "expected", right_col: str = "actual") -> DataFrame:
    """Full outer join of expected observations and information messages
    on (sample, turn) with a match / mismatch / missing status."""
    j = retrieval_turns.join(info_messages, keys, "full")
    st = (F.when(F.col(left_col).isNull(), F.lit("missing_expected"))
          .when(F.col(right_col).isNull(), F.lit("missing_actual"))
          .when(strip(F.col(left_col)) == strip(F.col(right_col)), F.lit("match"))
          .otherwise(F.lit("mismatch")))
    return j.withColumn("status", st)


def gather_samples(samples: DataFrame, prompt_key: str, sample_idx: str, text: str) -> DataFrame:
    """N samples per prompt regrouped as an ordered ``responses`` array
    (n is the sampling parameter, so groups are bounded)."""
    return samples.groupBy(prompt_key).agg(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(sample_idx).alias("i"), F.col(text).alias("t")))),
        lambda x: x["t"]).alias("responses"))


def resume_pending(prompts: DataFrame, done_log: DataFrame, key: str = "sample_key") -> DataFrame:
    """Rows not yet completed (left anti join). A null key never matches,
    so it is always kept (re-run), as the reference does."""
    return prompts.join(done_log.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def zip_batches(left: DataFrame, right: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Column-wise union of two batches of the same rows. Shared columns must be
    equal and every row must have its partner; otherwise the job fails."""
    shared = [c for c in left.columns if c in right.columns and c != row_id]
    lft = left.withColumn("_in_l", F.lit(True))
    r = right.select(F.col(row_id).alias("_r_id"), F.lit(True).alias("_in_r"),
                     *[F.col(c).alias(f"_r_{c}") for c in right.columns if c != row_id])
    j = lft.join(r, F.col(row_id) == F.col("_r_id"), "full")
    j = j.withColumn(row_id, F.when(F.col("_in_l") & F.col("_in_r"), F.col(row_id)).otherwise(
        F.raise_error(F.lit("a row of one batch is missing from the other")).cast(dict(left.dtypes)[row_id])))
    for c in shared:
        j = j.withColumn(c, F.when(F.col(c).eqNullSafe(F.col(f"_r_{c}")), F.col(c))
                         .otherwise(F.raise_error(F.lit(f"column {c} differs between batches"))))
    extra = [F.col(f"_r_{c}").alias(c) for c in right.columns if c != row_id and c not in shared]
    return j.select(*left.columns, *extra)


def sample_key(uid_col: str = "uid", index_col: str = "index") -> F.Column:
    """Section 1.3 key: ``uid:<uid>`` else ``index:<index>`` else null; blank,
    'none', 'nan' (any case) count as missing."""
    def clean(c):
        s = strip(F.col(c).cast("string"))
        return F.when(s.isNull() | (s == "") | F.lower(s).isin("none", "nan"), F.lit(None)).otherwise(s)
    u, i = clean(uid_col), clean(index_col)
    return F.when(u.isNotNull(), F.concat(F.lit("uid:"), u)) \
        .when(i.isNotNull(), F.concat(F.lit("index:"), i))


def preference_pairs(pairs: DataFrame, max_length: int, prompt: str = "prompt", chosen: str = "chosen",
                     rejected: str = "rejected", eos: str = "<eos>", pad: str = "<pad>") -> DataFrame:
    """prompt+chosen+eos and prompt+rejected+eos token sequences, right
    padded / truncated to ``max_length`` (whitespace tokens by default). The
    reference's quirk (the returned mask stacks rejected ids) is not copied:
    ``chosen_mask`` is the chosen sequence's own mask."""
    def seq(c):
        s = F.concat(whitespace_tokens(prompt), whitespace_tokens(c), F.array(F.lit(eos)))
        cut = F.slice(s, 1, max_length)
        return F.concat(cut, F.array_repeat(F.lit(pad), F.greatest(F.lit(max_length) - F.size(cut), F.lit(0))))
    out = pairs.withColumn("chosen_ids", seq(chosen)).withColumn("rejected_ids", seq(rejected))
    return (out.withColumn("chosen_mask", F.transform("chosen_ids", lambda x: F.when(x != pad, 1).otherwise(0)))
            .withColumn("rejected_mask", F.transform("rejected_ids", lambda x: F.when(x != pad, 1).otherwise(0))))


def generate(prompts: DataFrame, model_factory, text_col: str = "prompt_text", batch_size: int = 16) -> DataFrame:
    """Pluggable language-model call in Arrow batches with per-row error
    capture: ``model.generate(list[str]) -> list[dict(text, finish_reason, usage)]``;
    a failing batch is retried row by row and failures become ``error`` values
    instead of failing the task. The model is loaded once per Python worker."""
    import pandas as pd

    from searchlane.operators.common import object_key, worker_object
    key = object_key(model_factory)
    from pyspark.sql import types as T
    # a new StructType: DataFrame.schema may be cached, never mutate it
    schema = T.StructType(list(prompts.schema.fields) + [
        T.StructField("text", T.StringType()), T.StructField("finish_reason", T.StringType()),
        T.StructField("usage", T.LongType()), T.StructField("error", T.StringType())])

    def run(it):
        m = worker_object(key, model_factory)
        for pdf in it:
            out = []
            for s in range(0, len(pdf), batch_size):
                part = pdf[text_col].iloc[s:s + batch_size].tolist()
                try:
                    out.extend([(r.get("text"), r.get("finish_reason"), r.get("usage"), None)
                                for r in m.generate(part)])
                except Exception:
                    for p in part:
                        try:
                            r = m.generate([p])[0]
                            out.append((r.get("text"), r.get("finish_reason"), r.get("usage"), None))
                        except Exception as e:  # noqa: BLE001
                            out.append((None, None, None, f"{type(e).__name__}: {e}"))
            cols = list(zip(*out)) if out else [[], [], [], []]
            yield pdf.assign(text=pd.Series(cols[0], dtype="object").values,
                             finish_reason=pd.Series(cols[1], dtype="object").values,
                             usage=pd.Series(cols[2], dtype="Int64").values,
                             error=pd.Series(cols[3], dtype="object").values)

    return prompts.mapInPandas(run, schema)


def sample_id(split, index, row_pos, data_source=None, compat: bool = True) -> F.Column:
    """Section 1.3: ``split-<extra_info.index or row position>``. The
    reference's index restarts per data source, so these ids collide across
    sources; ``compat=False`` adds the data source to make them unique."""
    idx = F.coalesce(F.col(index).cast("string"), F.col(row_pos).cast("string"))
    if compat or data_source is None:
        return F.concat(F.col(split), F.lit("-"), idx)
    return F.concat(F.col(split), F.lit("-"), F.col(data_source), F.lit("-"), idx)


class WhitespaceTokenizer:
    """Default tokenizer: whitespace tokens, no chat template."""
    chat_template = None

    def encode(self, text: str) -> list[str]:
        return (text or "").split()


def render_messages(messages_col, tokenizer=None) -> F.Column:
    """U4 fallback rendering when the tokenizer has no chat template:
    ``role: content`` lines joined by newlines (JVM-side)."""
    return F.array_join(F.transform(messages_col, lambda m: F.concat(
        F.coalesce(m["role"], F.lit("user")), F.lit(": "), F.coalesce(m["content"], F.lit("")))), "\n")


def token_counts(col, tokenizer_factory=WhitespaceTokenizer) -> F.Column:
    """U4: pluggable tokenizer as an Arrow-batched pandas UDF (token count per
    text); the tokenizer is built once per Python worker."""
    import pandas as pd

    from searchlane.operators.common import object_key, worker_object
    key = object_key(tokenizer_factory)

    @F.pandas_udf("long")
    def count(s: pd.Series) -> pd.Series:
        tok = worker_object(key, tokenizer_factory)
        return s.map(lambda x: len(tok.encode(x)) if x is not None else 0).astype("int64")

    return count(F.col(col) if isinstance(col, str) else col)
