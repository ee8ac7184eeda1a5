"""The nested event payload: tolerant JSON parsing and field extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.text import CONTROL, SPACE, col, let, once, present, strip, text
from faultline.schemas import PROCESS_NAME_KEYS

# --- fixed values: fallback patterns for payloads that are not JSON -------------------------------
FALLBACK_PATTERNS = {
    "exception_type": rf'"Exception Type":{SPACE}*"([^"]+)"',
    "message": rf'"Message":{SPACE}*"([^"]+)"',
    "stack_trace": rf'"StackTrace":{SPACE}*"([^"]+)"',
    "inner_exception_type": rf'(?s)"InnerException".*?"Exception Type":{SPACE}*"([^"]+)"',
    "inner_exception_message": rf'(?s)"InnerException".*?"Message":{SPACE}*"([^"]+)"',
    "error_code": rf'"(?:Code|ErrorCode)":{SPACE}*"([^"]+)"',
}
# --- end of fixed values --------------------------------------------------------------------------

DETAIL_FIELDS = list(FALLBACK_PATTERNS)


def scrubbed(raw: Column | str) -> Column:
    """Payload without byte-order mark and control characters."""
    return F.regexp_replace(F.replace(strip(col(raw)), F.lit("﻿"), F.lit("")), CONTROL, "")


def repaired(raw: Column | str) -> Column:
    """Scrubbed payload with a missing opening brace and missing closing braces put back."""
    def close(s: Column) -> Column:
        opened = F.concat(F.lit("{"), s)
        missing = F.regexp_count(opened, F.lit("[{]")) - F.regexp_count(opened, F.lit("[}]"))
        return F.when(s.startswith('"Exception":'), F.concat(opened, F.repeat(F.lit("}"), F.greatest(F.lit(0), missing))))

    return let(strip(scrubbed(raw)), close)


def strict_json(c: Column) -> Column:
    """Text as VARIANT, null unless all of it is one JSON value (the parser alone ignores what follows)."""
    def only(v: Column) -> Column:
        return F.when(F.try_variant_get(v, "$[1]", "variant").isNull(), F.try_variant_get(v, "$[0]", "variant"))

    return let(F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))), only)


def parse(raw: Column | str, repair: bool = False) -> Column:
    """Payload as VARIANT; null when it is not JSON even after scrubbing (and, if asked, repairing)."""
    steps = [strict_json(strip(col(raw))), strict_json(scrubbed(raw))]
    if repair:
        steps.append(strict_json(repaired(raw)))
    return F.coalesce(*steps)


def with_payload(df: DataFrame, raw: str, out: str = "_v", repair: bool = False) -> DataFrame:
    """Add the parsed payload, parsed once per row."""
    return once(df, out, parse(raw, repair))


def is_record(v: Column) -> Column:
    """True for a non-empty JSON object."""
    return F.coalesce(F.size(F.try_variant_get(v, "$", "map<string,variant>")) > 0, F.lit(False))


def field(v: Column, *keys: str) -> Column:
    path = "$" + "".join(f"['{k}']" for k in keys)
    return F.try_variant_get(v, path, "string")


def has_inner(v: Column) -> Column:
    inner = F.try_variant_get(v, "$['Exception']['InnerException']", "map<string,variant>")
    return F.coalesce(F.size(inner) > 0, F.lit(False))


def first_of_keys(v: Column, keys: list[str] = PROCESS_NAME_KEYS) -> Column:
    """First non-blank value among top-level keys, else `Unknown`."""
    return F.coalesce(*[present(strip(field(v, k))) for k in keys], F.lit("Unknown"))


def inner_code(v: Column) -> Column:
    return F.coalesce(
        field(v, "Exception", "InnerException", "Code"),
        field(v, "Exception", "InnerException", "ErrorCode"),
        F.lit(""),
    )


def flat_columns(raw: Column | str, v: Column) -> dict[str, Column]:
    """Columns of the cleaned table for a parsed payload `v` of text `raw`."""
    ok, inner = is_record(v), has_inner(v)
    inner_text = F.concat(
        F.coalesce(field(v, "Exception", "InnerException", "Exception Type"), F.lit("")),
        F.lit(": "),
        F.coalesce(field(v, "Exception", "InnerException", "Message"), F.lit("")),
    )
    return {
        "Exception_Type": F.when(ok, F.coalesce(field(v, "Exception", "Exception Type"), F.lit("Unknown"))).otherwise("ParseError"),
        "Exception_Message": F.when(ok, F.coalesce(field(v, "Exception", "Message"), F.lit(""))).otherwise(text(raw)),
        "Stack_Trace": F.when(ok, F.coalesce(field(v, "Exception", "StackTrace"), F.lit(""))).otherwise(""),
        "Inner_Exception": F.when(ok & inner, inner_text).otherwise(""),
        "Error_Code": F.when(ok & inner, inner_code(v)).otherwise(""),
    }


def details(v: Column) -> dict[str, Column]:
    """Six search fields of a parsed payload, empty text where absent."""
    def get(*keys: str) -> Column:
        return F.coalesce(field(v, *keys), F.lit(""))

    return {
        "exception_type": get("Exception", "Exception Type"),
        "message": get("Exception", "Message"),
        "stack_trace": get("Exception", "StackTrace"),
        "inner_exception_type": get("Exception", "InnerException", "Exception Type"),
        "inner_exception_message": get("Exception", "InnerException", "Message"),
        "error_code": inner_code(v),
    }


def fallback_details(raw: Column | str) -> dict[str, Column]:
    """The same six fields picked out of damaged text by pattern."""
    return {name: F.regexp_extract(text(raw), pattern, 1) for name, pattern in FALLBACK_PATTERNS.items()}


def details_or_fallback(raw: Column | str, v: Column) -> Column:
    """Struct of the six fields: from the record if there is one, otherwise by pattern."""
    good, rough = details(v), fallback_details(raw)
    return F.when(is_record(v), F.struct(*[good[n].alias(n) for n in DETAIL_FIELDS])).otherwise(
        F.struct(*[rough[n].alias(n) for n in DETAIL_FIELDS])
    )
