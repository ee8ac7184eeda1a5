"""Resolutions, confidences and the merge of knowledge-base evidence with a model's answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.text import SPACE, col, percent_text, present, strip, text
from faultline.schemas import CLASS_LABELS, GOOD_MATCH, HIGH_CONFIDENCE, REVIEW_THRESHOLD

# --- fixed values --------------------------------------------------------------------------------
NOT_PROVIDED = "Not provided"
NO_PATTERNS = "None identified"
KEYWORDS = [
    ("PURGE", "PURGE|DELETE|REMOVE|DISCARD"),
    ("REPROCESS", "REPROCESS|RETRY|RESEND|RE-PROCESS"),
    ("INVESTIGATE", "INVESTIGATE|ESCALATE|REVIEW|ANALYZE|CHECK"),
]
FILLER_WORDS = ["THE", "MESSAGE", "TO", "DEV", "TEAM", "FOR", "ANALYSIS"]
FINAL = ["PURGE", "REPROCESS", "INVESTIGATE"]
DEFAULT_ACTIONS = {
    "PURGE": "Message Can be purged",
    "REPROCESS": "Reprocess the message with corrected data",
    "INVESTIGATE": "Escalate to dev team for investigation",
}
LAST_ACTION = "Review and determine appropriate action"
KB_BANDS = [(0.95, 95), (0.90, 88), (0.85, 78), (0.80, 68), (0.75, 58)]
KB_FLOORS = [(0.95, 90), (0.85, 80), (0.70, 70)]
WITH_KB, WITHOUT_KB = (0.4, 0.6), (0.8, 0.2)
WITH_CODE = (0.3, 0.4, 0.3)
# --- end of fixed values --------------------------------------------------------------------------


def normalize_resolution(c: Column | str) -> Column:
    up = F.upper(text(c))
    out = F.when(up.rlike(KEYWORDS[0][1]), KEYWORDS[0][0])
    for name, words in KEYWORDS[1:]:
        out = out.when(up.rlike(words), name)
    return out.otherwise("UNDEFINED")


def _either(v: Column, *names: str) -> Column:
    """First of several spellings of a top-level key."""
    return F.coalesce(*[F.try_variant_get(v, f"$['{n}']", "string") for n in names])


def _as_int(v: Column) -> Column:
    """Whole number from a JSON number (truncated) or from text holding a whole number."""
    def one(name: str) -> Column:
        s = F.try_variant_get(v, f"$['{name}']", "string")
        kind = F.schema_of_variant(F.try_variant_get(v, f"$['{name}']", "variant"))
        number = F.try_variant_get(v, f"$['{name}']", "double")
        typed = F.when(kind == "STRING", F.when(strip(s).rlike(r"^[+-]?\p{Nd}+$"), strip(s).try_cast("bigint")))
        return typed.otherwise(number.try_cast("bigint"))

    given = F.try_variant_get(v, "$['Confidence']", "string").isNotNull()
    return F.when(given, one("Confidence")).otherwise(one("confidence"))


def one_resolution(said: Column) -> Column:
    """Single valid resolution out of free model text, before any KB override."""
    up = strip(F.upper(said))
    kept = F.replace(up, F.lit("|"), F.lit(" "))
    for filler in FILLER_WORDS:
        kept = F.replace(kept, F.lit(filler), F.lit(""))
    words = F.filter(
        F.split(kept, SPACE + "+"),
        lambda w: w.isin(*FINAL, "ESCALATE"),
    )
    several = up.contains("|") | up.contains(" ")
    one = F.when(several, F.get(words, F.lit(0))).otherwise(up)
    mapped = F.when(one == "ESCALATE", "INVESTIGATE").otherwise(one)
    return F.when(mapped.isin(*FINAL), mapped).otherwise("UNDEFINED")


def validated(v: Column, kb_resolution: Column | str, kb_similarity: Column | str) -> Column:
    """Checked model answer as a struct; `v` is the answer parsed as VARIANT.

    A standard KB resolution replaces the model's and lifts the confidence to the floor of its similarity.
    """
    kb, sim = col(kb_resolution), F.coalesce(col(kb_similarity), F.lit(0.0))
    ok = F.coalesce(F.size(F.try_variant_get(v, "$", "map<string,variant>")) >= 0, F.lit(False))
    override = F.coalesce(kb.isin(*FINAL), F.lit(False))
    said = one_resolution(text(_either(v, "Resolution", "resolution")))
    stated = F.coalesce(_as_int(v), F.lit(65)).cast("int")
    floor = F.when(sim >= KB_FLOORS[0][0], KB_FLOORS[0][1])
    for limit, value in KB_FLOORS[1:]:
        floor = floor.when(sim >= limit, value)
    lifted = F.greatest(stated, floor.otherwise(None))

    def or_default(default: str, *names: str) -> Column:
        return F.coalesce(present(_either(v, *names)), F.lit(default))

    good = F.struct(
        F.when(override, kb).otherwise(said).alias("resolution"),
        or_default(NOT_PROVIDED, "Root_Cause", "root_cause").alias("root_cause"),
        or_default(NOT_PROVIDED, "Reasoning", "reasoning").alias("reasoning"),
        or_default(NOT_PROVIDED, "Suggested_Action", "suggested_action").alias("suggested_action"),
        F.when(override, lifted).otherwise(stated).alias("confidence"),
        or_default(NO_PATTERNS, "Similar_Patterns", "similar_patterns").alias("similar_patterns"),
        F.lit(True).alias("valid"),
    )
    failed = F.struct(
        F.coalesce(present(kb), F.lit("UNDEFINED")).alias("resolution"),
        F.lit(NOT_PROVIDED).alias("root_cause"),
        F.lit(NOT_PROVIDED).alias("reasoning"),
        F.lit(NOT_PROVIDED).alias("suggested_action"),
        F.lit(65).alias("confidence"),
        F.lit(NO_PATTERNS).alias("similar_patterns"),
        F.lit(False).alias("valid"),
    )
    return F.when(ok, good).otherwise(failed)


def code_fields(raw: Column | str, v: Column) -> dict[str, Column]:
    """Extra fields of a code-aware answer; only text that starts with a brace is looked at."""
    looked_at = text(raw).startswith("{")

    def get(name: str, default: str) -> Column:
        return F.coalesce(F.when(looked_at, F.try_variant_get(v, f"$['{name}']", "string")), F.lit(default))

    return {
        "code_issue_found": get("Code_Issue_Found", "Unknown"),
        "affected_code_file": get("Affected_Code_File", "Unknown"),
        "suggested_fix": get("Suggested_Fix", NOT_PROVIDED),
    }


def kb_usable(similarity: Column | str, resolution: Column | str) -> Column:
    """KB resolution when the best match is good enough and standard, otherwise null."""
    r = col(resolution)
    return F.when((F.coalesce(col(similarity), F.lit(0.0)) >= GOOD_MATCH) & r.isin(*FINAL), r)


def merged(answer: Column, kb_resolution: Column, kb_root_cause: Column, kb_action: Column, similarity: Column) -> dict[str, Column]:
    """Final resolution, root cause, reasoning and action from a checked answer and the best KB match.

    `kb_resolution`, `kb_root_cause` and `kb_action` belong to the best match and count only from
    similarity 0.70 on.
    """
    sim = F.coalesce(similarity, F.lit(0.0))
    good = sim >= GOOD_MATCH
    usable = kb_usable(sim, kb_resolution)
    cause = F.when(good, text(kb_root_cause)).otherwise("")
    action = F.when(good, text(kb_action)).otherwise("")
    said_cause, said_action = answer["root_cause"], answer["suggested_action"]

    def laid_out(c: Column, second: str) -> Column:
        return c.contains("\n") & c.contains(second) & c.contains("Action:")

    from_kb = (
        F.when(laid_out(cause, "Explanation:"), cause)
        .when(laid_out(said_cause, "Summary:") & (F.length(said_cause) > F.length(cause)), said_cause)
        .otherwise(cause)
    )
    final_cause = F.when(good & (cause != ""), from_kb).when(said_cause != NOT_PROVIDED, said_cause).otherwise(NOT_PROVIDED)
    resolution = answer["resolution"]
    default_action = F.when(resolution == "PURGE", DEFAULT_ACTIONS["PURGE"])
    for name in FINAL[1:]:
        default_action = default_action.when(resolution == name, DEFAULT_ACTIONS[name])
    return {
        "resolution": resolution,
        "root_cause": final_cause,
        "reasoning": F.when(usable.isNotNull(), F.concat(F.lit("KB Match (similarity: "), percent_text(sim), F.lit(")"))).otherwise(answer["reasoning"]),
        "suggested_action": F.when(action != "", action).when(said_action != NOT_PROVIDED, said_action).otherwise(default_action.otherwise(LAST_ACTION)),
    }


def coherence(root_cause: Column | str, resolution: Column | str) -> dict[str, Column]:
    """Flags for a root cause that talks about another resolution than the one chosen."""
    c, r = F.lower(text(root_cause)), text(resolution)
    return {
        "coherence_purge": c.contains("purge") & (r != "PURGE"),
        "coherence_reprocess": c.contains("reprocess") & (r != "REPROCESS"),
    }


def kb_confidence(similarity: Column | str) -> Column:
    """Confidence band of the best similarity; 0 when nothing was found."""
    s = col(similarity).cast("double")
    out = F.when(s.isNull(), 0)
    for limit, value in KB_BANDS:
        out = out.when(s > limit, value)
    return out.otherwise((s * 60).cast("int"))


def blended_confidence(model: Column | str, kb: Column | str, has_cases: Column) -> Column:
    m, k = col(model).cast("double"), col(kb).cast("double")
    with_kb = m * WITH_KB[0] + k * WITH_KB[1]
    without = m * WITHOUT_KB[0] + k * WITHOUT_KB[1]
    return F.when(has_cases, with_kb).otherwise(without).cast("int")


def blended_with_code(model: Column | str, kb: Column | str, code: Column | str) -> Column:
    """Optional blend of model, knowledge-base and code confidence."""
    parts = [col(c).cast("double") * w for c, w in zip((model, kb, code), WITH_CODE)]
    return (parts[0] + parts[1] + parts[2]).cast("int")


def analysis_type(kb_conf: Column | str) -> Column:
    return F.when(col(kb_conf) < HIGH_CONFIDENCE, "deep_constructive").otherwise("constructive")


def requires_review(confidence: Column | str) -> Column:
    return col(confidence) < HIGH_CONFIDENCE


def code_confidence(base: Column | str, issue_found: Column | str, snippets: Column | str, fix: Column | str) -> Column:
    n = F.coalesce(col(snippets), F.lit(0))
    boosted = (
        col(base)
        + F.when(col(issue_found) == "Yes", 10).otherwise(0)
        + F.when(n > 0, F.least(n * 3, F.lit(15))).otherwise(0)
        + F.when((text(fix) != "") & (text(fix) != NOT_PROVIDED), 5).otherwise(0)
    )
    return F.least(boosted, F.lit(95)).cast("int")


def code_review_rule(confidence: Column | str, issue_found: Column | str, resolution: Column | str, threshold: int = REVIEW_THRESHOLD) -> Column:
    c = col(confidence)
    return (c < threshold) | ((text(issue_found) == "No") & (c < 85)) | (text(resolution) == "INVESTIGATE")


def inferred_confidence(context: Column | str, resolution: Column | str, root_cause: Column | str, code: Column | str, frequency: Column | str) -> Column:
    def points(test: Column, n: int) -> Column:
        return F.when(test, n).otherwise(0)

    total = (
        F.lit(65)
        + points(F.length(text(context)) > 100, 15)
        + points(F.coalesce(col(resolution).isin(*FINAL), F.lit(False)), 10)
        + points(F.length(text(root_cause)) > 100, 8)
        + points(strip(text(code)) != "", 7)
        + points(F.coalesce(col(frequency), F.lit(1)) > 2, 5)
    )
    return F.least(F.lit(98), F.greatest(F.lit(40), total)).cast("int")


def classified_type(label: Column | str, etype: Column | str) -> Column:
    """Trimmed model label, else the exception type itself."""
    return F.coalesce(present(strip(text(label))), col(etype))


def known_label(label: Column) -> Column:
    return F.coalesce(label.isin(*CLASS_LABELS), F.lit(False))
