"""Dataset building jobs: QA -> prompt rows, prompt rewriting, SFT projection,
slicing and deterministic sampling (P1-P14, W12, W14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from searchlane.functions.text import _c, strip

# The three prompt templates (direct, search, RAG) of the
# reference's dataset builders, stated in natural order.
TEMPLATE_DIRECT = (
    "Answer the given question. You should first have a reasoning process in mind and then provides "
    "the answer. Show your reasoning in <think> </think> tags and return the final answer in <answer> "
    "</answer> tags, for example <answer> Beijing </answer>. Question: {question}\n")
TEMPLATE_SEARCH = (
    "Answer the given question. You must conduct reasoning inside <think> and </think> first every "
    "time you get new information. After reasoning, if you find you lack some knowledge, you can call "
    "a search engine by <search> query </search> and it will return the top searched results between "
    "<information> and </information>. You can search as many times as your want. If you find no "
    "further external knowledge needed, you can directly provide the answer inside <answer> and "
    "</answer>, without detailed illustrations. For example, <answer> Beijing </answer>. "
    "Question: {question}\n")
TEMPLATE_RAG = (
    "Answer the given question with some potentially useful context. You should analyze the question "
    "carefully, evaluate the given context (which may or may not be useful), and then generate an "
    "accurate and well-reasoned response. You should first have a reasoning process in mind and then "
    "provides the answer. Show your reasoning in <think> </think> tags and return the final answer in "
    "<answer> </answer> tags, for example <answer> Beijing </answer>. "
    "Question: {question} Context: {context} \n")
TEMPLATE_DECISION = """Answer the given question.

You must follow this format strictly:
<decision> brief action-oriented decision </decision>
<search> query </search>

or

<decision> brief action-oriented decision </decision>
<searches> <search> query1 </search> <search> query2 </search> </searches>

or

<decision> brief action-oriented decision </decision>
<answer> final answer </answer>

Rules:
- Before every action, you must output exactly one <decision> block.
- The <decision> block must be brief and action-oriented.
- Use the <decision> block only to state:
  1) what needs to be verified or concluded, and
  2) whether to use a single search, parallel searches, or answer directly.
- Do not include long reasoning, background knowledge, or detailed explanation in <decision>.
- Keep each <decision> short, usually one sentence and at most two sentences.

Search policy:
- For questions involving factual world knowledge, named entities, biographies, occupations, dates, places, organizations, events, records, rankings, relationships, or other external facts, verify the needed facts with search before answering, even if you believe you already know the answer.
- Do not answer factual verification questions directly from memory without first retrieving evidence.
- If one focused query is sufficient, prefer a single <search>.
- If multiple independent pieces of information need to be verified simultaneously, you may issue parallel searches in one turn by wrapping them together:
  <searches> <search> query1 </search> <search> query2 </search> </searches>
- Use parallel searches only when the sub-queries are complementary and do not depend on each other's results.
- Do not issue parallel searches that are merely different rephrasings of the same information need.
- If the next query depends on the result of the current query, use sequential search instead.
- Try to resolve the question in as few search turns as possible.

Answer policy:
- Only when the question can be answered without any external factual knowledge, such as pure reasoning or calculation, may you answer directly without search.
- Once enough evidence has been gathered, provide the final answer inside <answer> and </answer>, without detailed illustrations.

Use the <decision> block to briefly state:
1) what information needs to be verified or concluded, and
2) why the next action should be a single search, parallel searches, sequential search, or a direct answer.

Examples of good <decision> blocks:
<decision> Only one factual attribute needs to be verified, so use a single search. </decision>
<decision> The same attribute needs to be verified for multiple independent entities, so use parallel searches. </decision>
<decision> Multiple independent pieces of information need to be verified, so use parallel searches. </decision>
<decision> The next fact depends on the result of the first search, so use a single search sequentially. </decision>
<decision> The retrieved evidence is sufficient to answer the question, so answer now. </decision> Question: {question}\n"""
TEMPLATES = {"nq": TEMPLATE_DIRECT, "nq_search": TEMPLATE_SEARCH, "nq_rag": TEMPLATE_RAG, "decision": TEMPLATE_DECISION}


def normalize_question(col) -> Column:
    """Strip; append '?' when missing (empty questions stay empty and are
    flagged by ``empty_question``)."""
    s = strip(_c(col))
    return F.when(s == "", s).when(~s.endswith("?"), F.concat(s, F.lit("?"))).otherwise(s)


def _fill(template: str, cols: dict[str, Column]) -> Column:
    """Render a ``{name}`` template with Column values (JVM-side concat)."""
    import re
    parts, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        parts.append(F.lit(template[pos:m.start()]))
        parts.append(cols[m.group(1)])
        pos = m.end()
    parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


def make_prompt(question, template: str, context=None) -> Column:
    """Render one of the prompt templates; unknown template is an error."""
    if template not in TEMPLATES:
        raise NotImplementedError(template)
    cols = {"question": _c(question)}
    if template == "nq_rag":
        if context is None:
            raise ValueError("RAG template needs a context column")
        cols["context"] = _c(context)
    return _fill(TEMPLATES[template], cols)


def build_prompt_rows(df: DataFrame, data_source: str, split: str, template: str,
                      index_col: str = "index", question_col: str = "question",
                      golden_col: str = "golden_answers", context_col: str | None = None) -> DataFrame:
    """Nested prompt rows (data_source, prompt[{role, content}], ability,
    reward_model{style, ground_truth{target}}, extra_info{split, index}).
    The per-source ``index`` is a supplied id column (never a gapped
    monotonically-increasing id)."""
    q = normalize_question(question_col)
    content = make_prompt(q, template, context_col)
    return df.select(
        F.lit(data_source).alias("data_source"),
        F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))).alias("prompt"),
        F.lit("fact-reasoning").alias("ability"),
        F.struct(F.lit("rule").alias("style"),
                 F.struct(F.col(golden_col).alias("target")).alias("ground_truth")).alias("reward_model"),
        F.struct(F.lit(split).alias("split"), F.col(index_col).cast("long").alias("index")).alias("extra_info"),
        (q == "").alias("empty_question"))


def extract_question(col, marker: str = "Question: ") -> Column:
    """Text after the last marker; a missing marker raises."""
    c = _c(col)
    return F.when(F.instr(c, marker) > 0, F.substring_index(c, marker, -1)) \
        .otherwise(F.raise_error(F.lit("question marker not found")))


def rewrite_prompts(df: DataFrame, template: str, prompt_col: str = "prompt") -> DataFrame:
    """P5: replace the content of message 0 by ``template`` rendered with the
    question extracted from it (newline-trimmed, '?' normalised)."""
    first = F.element_at(prompt_col, 1)
    q = normalize_question(strip(extract_question(first["content"])))
    new_first = F.struct(first["role"].alias("role"), _fill(template, {"question": q}).alias("content"))
    return df.withColumn(prompt_col, F.concat(F.array(new_first), F.slice(prompt_col, F.lit(2), F.greatest(F.size(prompt_col) - 1, F.lit(0)))))


def to_sft(df: DataFrame, keep: tuple[str, ...] = ("data_source", "ability", "extra_info", "rollout_turns")) -> DataFrame:
    """``messages`` if non-empty else ``prompt`` if non-empty else error;
    optional columns kept when present."""
    msgs = F.col("messages") if "messages" in df.columns else F.lit(None)
    prm = F.col("prompt") if "prompt" in df.columns else F.lit(None)
    chosen = (F.when(F.size(msgs) > 0, msgs).when(F.size(prm) > 0, prm)
              .otherwise(F.raise_error(F.lit("row has neither messages nor prompt"))))
    return df.select(chosen.alias("messages"), *[c for c in keep if c in df.columns])


def completed_only(df: DataFrame, status_col: str = "collector_status") -> DataFrame:
    """P7."""
    return df.filter(F.col(status_col) == "completed")


def slice_rows(df: DataFrame, order_by: list[str], offset: int = 0, limit: int | None = None) -> DataFrame:
    """offset/limit over an explicit order: a range filter on the dense row index,
    so no task gathers the rows before the slice."""
    from searchlane.operators.batching import with_row_index
    idx = with_row_index(df, order_by, "_row")
    keep = F.col("_row") >= offset
    if limit is not None:
        keep &= F.col("_row") < offset + limit
    return idx.filter(keep).drop("_row")


def seeded_order(key: str, seed: int) -> Column:
    """Deterministic pseudo-random order key: md5 of the key and the seed
    (identical in every engine, unlike Spark's native hash functions)."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}")))


def sample_exact(df: DataFrame, n: int, key: str, seed: int = 42, by: str | None = None) -> DataFrame:
    """Deterministic random subset of exactly n rows (per ``by`` group when
    given): order by md5(key, seed), keep n; fewer rows is an error."""
    h = seeded_order(key, seed)
    if by is None:
        cnt = df.count()
        if cnt < n:
            raise ValueError(f"only {cnt} rows, {n} requested")
        return slice_rows(df.withColumn("_h", h), ["_h", key], 0, n).drop("_h")
    short = df.groupBy(by).count().filter(F.col("count") < n)   # partial aggregate, no window
    if short.limit(1).count():
        raise ValueError("a group has fewer rows than requested")
    # row_number <= n plans a partial WindowGroupLimit: a hot group ships at most
    # n rows per map partition
    w = Window.partitionBy(by).orderBy(h, F.col(key))
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def sample_at_most(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """P10: as P9 but keeps every row (with a warning) when there are too few."""
    if df.count() <= n:
        import warnings
        warnings.warn("fewer rows than train_data_num; keeping all")
        return df
    return sample_exact(df, n, key, seed)


def shuffle_batches(df: DataFrame, batch_size: int, key: str, seed: int = 42,
                    drop_last: bool = True) -> DataFrame:
    """Seeded shuffle order (md5 of key and seed) and fixed-size batch ids; the
    short last batch is dropped when ``drop_last``."""
    from searchlane.operators.batching import with_row_index
    h = df.withColumn("_h", seeded_order(key, seed))
    idx = with_row_index(h, ["_h", key], "_i")
    out = idx.withColumn("batch_id", F.floor(F.col("_i") / batch_size).cast("long"))
    if drop_last:
        total = idx.count()
        full = (total // batch_size) * batch_size
        out = out.filter(F.col("_i") < full)
    return out.drop("_h", "_i")


def merge_sources(frames: dict[str, dict[str, DataFrame]], priority=("test", "dev", "train")) -> DataFrame:
    """Union per-source splits, each source using the first available split
    in ``priority`` order (test -> dev -> train)."""
    out = None
    for source, splits in frames.items():
        chosen = next((s for s in priority if s in splits), None)
        if chosen is None:
            continue
        part = splits[chosen].withColumn("data_source", F.lit(source)).withColumn("split", F.lit(chosen))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
