"""Composite jobs: triage of a log, analysis of representatives, code-aware analysis."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.functions import events, scoring, text
from faultline.operators import clean, code_index, context, grouping, kb as kb_ops, neardup, vectors
from faultline.schemas import RESULT_COLUMNS
from faultline.session import cut, dense_number, saved


def score_with_callable(df: DataFrame, fn: Callable[[list[str]], list[str]], prompt: str, out: str = "raw_answer") -> DataFrame:
    """Add the answers of a user function to a column of prompts, batch by batch.

    A batch that fails, or gets more or fewer answers than prompts, is asked again prompt by prompt; a prompt
    that fails keeps its row: the answer is null and `error` says why.
    """
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.StringType()), T.StructField("error", T.StringType())])

    def ask(prompts: list[str]) -> list[str]:
        answers = list(fn(prompts))
        if len(answers) != len(prompts):
            raise ValueError(f"{len(answers)} answers to {len(prompts)} prompts")
        return answers

    def ask_each(prompts: list[str]) -> Iterator[tuple[str | None, str | None]]:
        for p in prompts:
            try:
                yield ask([p])[0], None
            except Exception as e:
                yield None, str(e)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            prompts = pdf[prompt].tolist()
            try:
                pairs = [(a, None) for a in ask(prompts)]
            except Exception:
                pairs = list(ask_each(prompts))
            yield pdf.assign(**{out: pd.Series([a for a, _ in pairs], index=pdf.index, dtype=object), "error": pd.Series([e for _, e in pairs], index=pdf.index, dtype=object)})

    return df.mapInPandas(run, schema)


def rule_answers(prompts: list[str]) -> list[str]:
    """Stand-in for a model: a fixed, modest answer. Real models come in through `answer_fn`."""
    return ['{"Resolution": "INVESTIGATE", "Confidence": 60}'] * len(prompts)


def result_columns(row: dict[str, Column], best: dict[str, Column], answer: Column, error: Column, module: str) -> dict[str, Column]:
    """The result row of one representative.

    `row`: identity, payload details and defaults; `best`: best case (resolution, root_cause, action,
    similarity) and `n_cases`; `answer`: checked model answer; `error`: why the model gave none, or null.
    """
    merged = scoring.merged(answer, best["resolution"], best["root_cause"], best["action"], best["similarity"])
    n_cases = F.coalesce(best["n_cases"], F.lit(0))
    kb_conf = scoring.kb_confidence(F.when(n_cases > 0, best["similarity"]))
    confidence = scoring.blended_confidence(answer["confidence"], kb_conf, n_cases > 0)
    failed = error.isNotNull()

    def unless_failed(value: Column, instead: Column | object) -> Column:
        return F.when(failed, instead if isinstance(instead, Column) else F.lit(instead)).otherwise(value)

    cases = F.concat(n_cases.cast("string"), F.lit(" cases - KB confidence: "), kb_conf.cast("string"), F.lit("%"))
    return {
        "Exception_ID": row["id"],
        "Selected_Module": F.lit(module),
        "Exception_Type": row["exception_type"],
        "Exception_Message": row["message"],
        "Original_Error": row["full_error"],
        "Stack_Trace": row["stack_trace"],
        "Resolution": unless_failed(merged["resolution"], "INVESTIGATE"),
        "Root_Cause": unless_failed(merged["root_cause"], "Error during analysis"),
        "Confidence_Score": unless_failed(confidence, 0).cast("int"),
        "Reasoning": unless_failed(merged["reasoning"], F.concat(F.lit("Analysis error: "), error)),
        "Similar_Past_Cases": unless_failed(cases, "0 cases"),
        "Suggested_Action": unless_failed(merged["suggested_action"], "Review manually"),
        "Severity": unless_failed(row["severity"], "HIGH"),
        "Machine_Name": row["machine"],
        "Process_Name": row["process"],
        "Timestamp": row["timestamp"],
        "Analysis_Type": unless_failed(scoring.analysis_type(kb_conf), "error"),
        "Requires_Review": unless_failed(scoring.requires_review(confidence), True),
    }


def with_row_order(df: DataFrame) -> DataFrame:
    """`row_ord`, the order in which rows count as first: the log's own sequence number, else a numbering
    by time and id."""
    if "row_ord" in df.columns:
        return df
    if "LOG_SEQ_NO" in df.columns:
        return df.withColumn("row_ord", F.col("LOG_SEQ_NO").cast("bigint"))
    return dense_number(df, ["Timestamp", "Exception_ID"], "row_ord")


def grouped_log(log: DataFrame, run_ts: str, module: str, leaders: DataFrame | None = None) -> DataFrame:
    """A raw log cleaned and grouped, by itself or after known `leaders`."""
    cleaned = saved(with_row_order(clean.clean_exceptions(log, run_ts, module)))
    return saved(neardup.near_dup_groups(cleaned) if leaders is None else neardup.follow_leaders(cleaned, leaders))


def classify(reps: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Add `Classified_Type`: the label a model gave the representative (`labels`: row_ord, label), else its own type."""
    if labels is None:
        return reps.withColumn("Classified_Type", F.col("Exception_Type"))
    given = reps.join(labels.select("row_ord", "label"), "row_ord", "left")
    return given.withColumn("Classified_Type", scoring.classified_type("label", "Exception_Type")).drop("label")


def analyze(reps: DataFrame, kb: DataFrame, embedder, module: str, answer_fn: Callable | None = None, answers: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """Result rows of the representatives: class, case search, model answer, merge.

    Search and model run on representatives only. `answers` (row_ord, raw_answer) and `labels` (row_ord,
    label) replace the model's when given; `kb` holds entries with `kb_id` and `embedding`.
    """
    featured = clean.features(classify(reps, labels))
    parsed = events.with_payload(featured, "EVENT_INFORMATION")
    good = events.details(F.col("_v"))
    own = {
        "exception_type": F.col("Features.exception_type"), "message": F.col("Features.message"), "stack_trace": F.col("Features.stack_trace"),
        "inner_exception_type": F.lit(""), "inner_exception_message": F.lit(""), "error_code": F.col("Features.error_code"),
    }
    ok = events.is_record(F.col("_v"))
    base = parsed.withColumn("d", F.struct(*[F.when(ok, good[n]).otherwise(own[n]).alias(n) for n in events.DETAIL_FIELDS])).drop("_v")
    base = saved(text.once(base, "_search", kb_ops.search_text(F.col("d"))))
    wanted = base.filter(F.col("_search").isNotNull()).select(F.col("row_ord").alias("q_id"), F.lit(module).alias("module"), "_search")
    queries = saved(embedder.transform(wanted, "_search", "vec").select("q_id", "module", "vec"))
    hits = cut(vectors.cross_module(queries, kb))
    about = kb.select("kb_id", F.col("resolution").alias("b_resolution"), F.col("root_cause").alias("b_root_cause"), F.col("action").alias("b_action"))
    top = vectors.best_match(hits).select("q_id", "kb_id", F.col("similarity").alias("b_similarity")).join(about, "kb_id").drop("kb_id")
    counts = hits.groupBy("q_id").agg(F.count(F.lit(1)).alias("n_cases"))
    found = counts.join(top, "q_id").withColumnRenamed("q_id", "row_ord")
    texts = context.kb_context(base.select(F.col("row_ord").alias("q_id")), hits, kb).withColumnRenamed("q_id", "row_ord")
    ready = base.join(found, "row_ord", "left").join(texts, "row_ord")
    if answers is not None:
        scored = ready.join(answers.select("row_ord", "raw_answer"), "row_ord", "left").withColumn("error", F.lit(None).cast("string"))
    else:
        asked = ready.select("row_ord", context.analysis_prompt(F.col("d"), F.col("kb_context")).alias("prompt"))
        said = cut(score_with_callable(asked, answer_fn or rule_answers, "prompt").drop("prompt"))
        scored = ready.join(said, "row_ord")
    usable = scoring.kb_usable(F.col("b_similarity"), F.col("b_resolution"))
    checked = text.once(scored, "_a", events.strict_json(F.col("raw_answer"))).withColumn("answer", scoring.validated(F.col("_a"), usable, F.col("b_similarity"))).drop("_a")
    d = F.col("d")
    row = {
        "id": F.col("Exception_ID"), "exception_type": d["exception_type"], "message": d["message"], "stack_trace": d["stack_trace"],
        "full_error": clean.full_error(d["message"], d["inner_exception_type"], d["inner_exception_message"], d["error_code"], F.col("Exception_Message")),
        "severity": F.col("Features.severity"), "machine": F.col("Features.machine_name"), "process": F.col("Features.process_name"), "timestamp": F.col("Features.timestamp"),
    }
    best = {
        "resolution": F.col("b_resolution"), "root_cause": F.col("b_root_cause"), "action": F.col("b_action"), "similarity": F.col("b_similarity"), "n_cases": F.col("n_cases"),
    }
    cols = result_columns(row, best, F.col("answer"), F.col("error"), module)
    return checked.select(
        F.col("group_ord").alias("row_ord"), *[c.alias(n) for n, c in cols.items()], "Classified_Type", "Dedup_Group_ID", "Dedup_Count", "Original_Exception_IDs"
    )


def triage(log: DataFrame, kb: DataFrame, embedder, module: str, run_ts: str, answer_fn: Callable | None = None, answers: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """Raw exception log in, one result row per original exception out.

    `answers` and `labels` are recorded answers of a model by row order; without them `answer_fn` is asked.
    """
    return triage_groups(grouped_log(log, run_ts, module), kb, embedder, module, answer_fn, answers, labels)


def triage_groups(grouped: DataFrame, kb: DataFrame, embedder, module: str, answer_fn: Callable | None = None, answers: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """Result rows of a grouped log: representatives are analysed, their results given to all rows of the group."""
    reps = cut(grouping.representatives(grouped))
    results = cut(analyze(reps, kb, embedder, module, answer_fn, answers, labels))
    return grouping.expand_groups(results, grouping.id_table(grouped, "Dedup_Group_ID")).select(*RESULT_COLUMNS, "Classified_Type")


def triage_batch(log: DataFrame, leaders: DataFrame, kb: DataFrame, embedder, module: str, run_ts: str, **recorded) -> tuple[DataFrame, DataFrame]:
    """(results, new leaders) of a part of a log that arrives after the given leaders."""
    grouped = grouped_log(log, run_ts, module, leaders)
    return triage_groups(grouped, kb, embedder, module, **recorded), neardup.leaders_of(grouped)


def code_analysis(exceptions: DataFrame, files: DataFrame, chunks: DataFrame, embedder, answer_fn: Callable | None = None, answers: DataFrame | None = None, top_k: int = 5) -> DataFrame:
    """Code-aware analysis: snippets for every distinct trace, prompt, checked answer, boosted confidence, review flag.

    `files` = (file_path, file_ord); `chunks` come from `code_index.indexed`.
    """
    keyed, found = code_index.retrieved(exceptions, files, chunks, embedder, top_k)
    by_trace = found.withColumnRenamed("trace_id", "Exception_ID")
    listed = context.snippet_list(by_trace, top_k).join(by_trace.groupBy("Exception_ID").agg(F.count(F.lit(1)).alias("n_snippets")), "Exception_ID")
    rows = keyed.join(listed.withColumnRenamed("Exception_ID", "trace_id"), "trace_id", "left")
    d = F.struct(F.col("Exception_Type").alias("exception_type"), F.col("Exception_Message").alias("message"), F.col("Stack_Trace").alias("stack_trace"))
    parts = context.code_prompt(d, F.col("snippets"), F.lit(None).cast("string"))
    asked = rows.select("Exception_ID", F.coalesce("n_snippets", F.lit(0)).alias("n_snippets"), context.within_budget(parts["essential"], parts["code"]).alias("prompt"))
    if answers is not None:
        said = asked.drop("prompt").join(answers, "Exception_ID")
    else:
        said = score_with_callable(asked, answer_fn or rule_answers, "prompt").drop("prompt")
    checked = text.once(said, "_a", events.strict_json(F.col("raw_answer")))
    fields = scoring.code_fields("raw_answer", F.col("_a"))
    checked = checked.withColumns({"answer": scoring.validated(F.col("_a"), F.lit(None).cast("string"), F.lit(0.0)), **fields}).drop("_a")
    confidence = scoring.code_confidence(F.col("answer.confidence"), "code_issue_found", "n_snippets", "suggested_fix")
    return checked.select(
        "Exception_ID", F.col("answer.resolution").alias("resolution"), confidence.alias("confidence"), "n_snippets", *fields,
        F.when(F.col("n_snippets") > 0, "code_based").otherwise("standard").alias("analysis_type"),
        scoring.code_review_rule(confidence, "code_issue_found", F.col("answer.resolution")).alias("requires_review"),
    )

