"""Texts built from found cases and snippets: KB context, prompts, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import text
from faultline.functions.text import SPACE, percent_text
from faultline.schemas import GOOD_MATCH, NO_CASES_TEXT

MAX_PROMPT_WORDS, KEPT_WORDS = 30000, 25000
SNIPPETS_SHOWN, SUMMARY_SHOWN = 5, 3


def _case(x: Column, full: bool) -> Column:
    inner = F.concat_ws("\n", text.text(x["inner_exception_type"]),
                        F.when(text.text(x["inner_exception_message"]) != "", F.concat(F.lit("Inner Message: "), x["inner_exception_message"])) if full else F.lit(None).cast("string"),
                        F.when(text.text(x["error_code"]) != "", F.concat(F.lit("Error Code: "), x["error_code"])))
    return F.concat_ws(
        "\n", F.concat(F.lit("Exception Type: "), text.text(x["exception_type"])), F.concat(F.lit("Stack Trace Match: "), text.text(x["stack_trace"])),
        F.concat(F.lit("Inner Exception: "), inner), F.concat(F.lit("Resolution: "), text.text(x["resolution"])),
        F.concat(F.lit("Root Cause: "), text.text(x["root_cause"])), F.concat(F.lit("Recommended Action: "), text.text(x["action"])),
    )


def kb_context(queries: DataFrame, hits: DataFrame, kb: DataFrame) -> DataFrame:
    """(q_id, kb_context): the best case alone when it is good enough, otherwise all cases found.

    `hits` hold at most five rows per query, so the list gathered per query is small.
    """
    about = kb.select("kb_id", "exception_type", "stack_trace", "inner_exception_type", "inner_exception_message", "error_code", "resolution", "root_cause", "action")
    cases = hits.join(about, "kb_id").groupBy("q_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "similarity", *about.columns[1:]))).alias("cases")
    )
    count = F.size("cases").cast("string")
    best = F.get("cases", F.lit(0))
    one = F.concat(
        F.lit("Found "), count, F.lit(" similar case(s) in knowledge base. Best match (similarity: "), percent_text(best["similarity"]), F.lit("):\n"), _case(best, True)
    )
    every = F.concat(
        F.lit("Found "), count, F.lit(" similar case(s) in knowledge base (similarity < 70%):\n"),
        F.array_join(F.transform("cases", lambda x: F.concat(
            F.lit("Case "), x["rank"].cast("string"), F.lit(" (similarity: "), percent_text(x["similarity"]), F.lit(")\n"), _case(x, False))), "\n\n"),
    )
    return queries.select("q_id").join(cases, "q_id", "left").select(
        "q_id", F.when(F.col("cases").isNull(), NO_CASES_TEXT).when(best["similarity"] >= GOOD_MATCH, one).otherwise(every).alias("kb_context")
    )


def analysis_prompt(d: Column, context: Column) -> Column:
    """Question to an external model about one exception."""
    return F.concat_ws(
        "\n",
        F.lit("Decide how to resolve this exception. Answer with one JSON object holding the keys Resolution, Root_Cause, "
              "Reasoning, Suggested_Action, Confidence and Similar_Patterns. Resolution is PURGE, REPROCESS or INVESTIGATE; "
              "Confidence is a whole number from 0 to 100. A knowledge-base match of 70% or more decides the Resolution."),
        F.concat(F.lit("Type: "), text.text(d["exception_type"])), F.concat(F.lit("Message: "), text.text(d["message"])),
        F.concat(F.lit("Inner type: "), text.text(d["inner_exception_type"])), F.concat(F.lit("Inner message: "), text.text(d["inner_exception_message"])),
        F.concat(F.lit("Error code: "), text.text(d["error_code"])), F.concat(F.lit("Stack trace: "), text.text(d["stack_trace"])),
        F.lit("Knowledge base:"), context,
    )


def snippet_list(found: DataFrame, shown: int = SNIPPETS_SHOWN) -> DataFrame:
    """(Exception_ID, snippets): the first `shown` structs per exception, in order."""
    cols = ["snippet_no", "match_type", "file_path", "line_start", "line_end", "target_line", "content"]
    return found.filter(F.col("snippet_no") <= shown).groupBy("Exception_ID").agg(
        F.array_sort(F.collect_list(F.struct(*cols))).alias("snippets")
    )


def code_prompt(d: Column, snippets: Column, context: Column, caps: dict[str, int] | None = None) -> dict[str, Column]:
    """The prompt of a code-aware analysis in two parts: the essential text and the code.

    Whole texts; `caps` (keys content, stack_trace, context) shortens them. The one limit of a model's
    input is `within_budget`.
    """
    caps = caps or {}

    def short(value: Column, name: str) -> Column:
        return F.substring(value, 1, caps[name]) if name in caps else value

    shown = F.transform(snippets, lambda s: F.concat_ws(
        "\n", F.concat(F.lit("File: "), s["file_path"], F.lit(" lines "), s["line_start"].cast("string"), F.lit("-"), s["line_end"].cast("string"), F.lit(" ("), s["match_type"], F.lit(")")),
        F.when(s["target_line"].isNotNull(), F.concat(F.lit("Error at line "), s["target_line"].cast("string"))),
        short(s["content"], "content"),
    ))
    essential = F.concat_ws(
        "\n", F.lit("Find the cause of this exception in the code below. Answer with one JSON object: Resolution, Root_Cause, Reasoning, "
                    "Suggested_Action, Code_Issue_Found (Yes/No), Affected_Code_File, Suggested_Fix, Confidence, Similar_Patterns."),
        F.concat(F.lit("Type: "), text.text(d["exception_type"])), F.concat(F.lit("Message: "), text.text(d["message"])),
        F.when(text.text(d["stack_trace"]) != "", F.concat(F.lit("Stack trace: "), short(d["stack_trace"], "stack_trace"))),
        F.when(F.coalesce(context, F.lit(NO_CASES_TEXT)) != NO_CASES_TEXT, F.concat(F.lit("Knowledge base: "), short(context, "context"))),
    )
    return {"essential": essential, "code": F.array_join(F.coalesce(shown, F.array().cast("array<string>")), "\n\n")}


def words(c: Column) -> Column:
    return F.filter(F.split(text.text(c), SPACE + "+"), lambda w: w != "")


def within_budget(essential: Column, code: Column, limit: int = MAX_PROMPT_WORDS, kept: int = KEPT_WORDS) -> Column:
    """Whole prompt when it is short enough; otherwise the essential part and as much code as fits.

    This is the input limit of a model, in words; a model that reads more takes a larger `limit` and `kept`.
    """
    n_essential, code_words = F.size(words(essential)), words(code)
    room = F.lit(kept) - n_essential
    trimmed = F.when(room > 0, F.concat(essential, F.lit("\n\n"), F.array_join(F.slice(code_words, F.lit(1), F.greatest(room, F.lit(1))), " "))).otherwise(essential)
    return F.when(n_essential + F.size(code_words) > limit, trimmed).otherwise(F.concat_ws("\n", essential, code))


def code_summary(found: DataFrame, shown: int = SUMMARY_SHOWN) -> DataFrame:
    """Short text per exception about the snippets used: the first ones, and how many more."""
    total = found.groupBy("Exception_ID").agg(F.count(F.lit(1)).alias("n"))
    top = found.filter(F.col("snippet_no") <= shown).groupBy("Exception_ID").agg(
        F.array_sort(F.collect_list(F.struct("snippet_no", "file_path", "line_start", "line_end", "match_type"))).alias("s")
    )
    line = F.transform("s", lambda x: F.concat(
        F.lit("  "), x["snippet_no"].cast("string"), F.lit(". "), text.basename(x["file_path"]), F.lit(" (lines "), x["line_start"].cast("string"), F.lit("-"),
        x["line_end"].cast("string"), F.lit(") - "), x["match_type"], F.lit(" match")))
    more = F.when(F.col("n") > shown, F.concat(F.lit("  ... and "), (F.col("n") - shown).cast("string"), F.lit(" more")))
    head = F.concat(F.lit("Analyzed "), F.col("n").cast("string"), F.lit(" code file(s):"))
    return total.join(top, "Exception_ID").select("Exception_ID", F.concat_ws("\n", head, F.array_join(line, "\n"), more).alias("summary"))
