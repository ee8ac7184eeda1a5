"""Message cleaning, signatures and small text features, all as JVM column expressions.

`\\d`, `\\w`, `\\s` are spelled as Unicode classes: the documented behaviour is Unicode-aware, while the
JVM shorthands are ASCII-only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: the documented patterns -------------------------------------------------------
SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
SPACE_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CONTROL = r"[\x00-\x1f\x7f-\x{9f}]"
ERROR_INDICATOR = r"(?i)(ORA-\p{Nd}+|ERROR[:\t-\r\x1c-\x20\x{85}\p{Z}]*\p{Nd}+|Code[:\t-\r\x1c-\x20\x{85}\p{Z}]*\p{Nd}+)"
HEX_ID = r"(?U)\b[0-9a-f]{8,}\b"
EMAIL = WORD + "+@" + WORD + r"+\." + WORD + "+"
TIMESTAMP = r"\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}[\t-\r\x1c-\x20\x{85}\p{Z}T]\p{Nd}{2}:\p{Nd}{2}:\p{Nd}{2}"
TIMESTAMP_STRICT = r"\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}[\t-\r\x1c-\x20\x{85}\p{Z}Tt]\p{Nd}{2}:\p{Nd}{2}:\p{Nd}{2}"
MACHINE = r"(?i)machine[:\t-\r\x1c-\x20\x{85}\p{Z}]+[^\t-\r\x1c-\x20\x{85}\p{Z}]+"
SERVER = r"(?i)server[:\t-\r\x1c-\x20\x{85}\p{Z}]+[^\t-\r\x1c-\x20\x{85}\p{Z}]+"
NUMBER = r"(?U)\b\p{Nd}+\b"
GUID = r"(?iU)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"
LONG_HEX = r"(?iU)\b[0-9a-f]{32,}\b"
TERM_PATTERNS = [
    r"(?U)\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b",
    r"(?U)\b[a-z]+_[a-z_]+\b",
    r"(?U)\b[A-Z]{2,}\b",
    r"(?U)\b" + WORD + r"+Exception\b",
    r"(?U)\b" + WORD + r"+Error\b",
]
# --- end of fixed values --------------------------------------------------------------------------


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once, however often `body` uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters and projections must not compute again.

    A generator is a boundary for the optimizer: a filter on the column stays above it, whereas a filter
    on a projected expression would be pushed down with the whole expression copied into it.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def unroll(df: DataFrame, keep: list, array: Column, pos: str, item: str) -> DataFrame:
    """One row per array element. For a plain explode the optimizer adds a filter that computes the whole
    array a second time; the outer form followed by a filter on the position computes it once."""
    return df.select(*keep, F.posexplode_outer(array).alias(pos, item)).filter(F.col(pos).isNotNull())


def text(c: Column | str) -> Column:
    """Null-safe text."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def present(c: Column | str) -> Column:
    """The value, or null when it is empty."""
    return F.nullif(col(c).cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Trim all leading and trailing white space, not only blanks."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def clean_text(c: Column | str) -> Column:
    flat = F.regexp_replace(text(c), SPACE + "+", " ")
    return F.trim(F.regexp_replace(flat, CONTROL, ""))


def message_signature(message: Column | str, code: Column | str) -> Column:
    """Message with its variable parts replaced, plus the error code.

    Digits are replaced first, so a date never survives to be recognised; that order is kept.
    """
    s = F.regexp_replace(F.lower(text(message)), r"\p{Nd}+", "N")
    s = F.regexp_replace(s, HEX_ID, "ID")
    s = F.regexp_replace(s, EMAIL, "EMAIL")
    c = text(code)
    return strip(F.when(strip(c) != "", F.concat(s, F.lit("|CODE:"), c)).otherwise(s))


def normalize_message(message: Column | str, machines: bool = True, strict: bool = False) -> Column:
    """Message prepared for near-duplicate comparison.

    `strict` recognises identifiers and timestamps before plain numbers swallow their digits.
    """
    s = F.lower(text(message))
    if strict:
        s = F.regexp_replace(s, GUID, "GUID")
        s = F.regexp_replace(s, TIMESTAMP_STRICT, "TIMESTAMP")
    else:
        s = F.regexp_replace(s, TIMESTAMP, "TIMESTAMP")
    if machines:
        s = F.regexp_replace(s, MACHINE, "MACHINE")
        s = F.regexp_replace(s, SERVER, "SERVER")
    s = F.regexp_replace(s, NUMBER, "NUM")
    if not strict:
        s = F.regexp_replace(s, GUID, "GUID")
    s = F.regexp_replace(s, LONG_HEX, "ID")
    return F.trim(F.regexp_replace(s, SPACE + "+", " "))


def normalize_code(code: Column | str) -> Column:
    return F.upper(strip(text(code)))


#: Digits of a comparison signature that are shown; rows are compared by the whole digest.
SHOWN_DIGITS = 16


def dedup_key(etype: Column | str, normalized: Column | str, code: Column | str) -> Column:
    """Whole digest of what makes two exceptions the same."""
    return F.md5(F.concat(text(etype), F.lit("|"), text(normalized), F.lit("|"), text(code)))


def dedup_signature(etype: Column | str, normalized: Column | str, code: Column | str) -> Column:
    """The short form of `dedup_key`, for display."""
    return F.substring(dedup_key(etype, normalized, code), 1, SHOWN_DIGITS)


def row_id(columns: list[str]) -> Column:
    """Id of a row without a number of its own: digest of all its columns, so that distinct rows keep distinct ids."""
    return F.concat(F.lit("EX_"), F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(columns)]))))


def exception_id(module: Column | str, etype: Column | str, message: Column | str) -> Column:
    """Short id of an exception's kind; rows of one kind share it."""
    return F.concat(F.lit("EX_"), F.substring(F.md5(F.concat(text(module), text(etype), text(message))), 1, 12))


def error_indicators(message: Column | str) -> Column:
    """First three code-like tokens of the message, null when there is none."""
    found = F.regexp_extract_all(text(message), F.lit(ERROR_INDICATOR), F.lit(1))
    return present(F.array_join(F.slice(found, 1, 3), ", "))


def is_constraint_violation(message: Column | str) -> Column:
    return F.lower(text(message)).rlike("constraint|violated")


def is_null_issue(message: Column | str) -> Column:
    return F.lower(text(message)).rlike("null|no elements")


def module_from_title(title: Column | str) -> Column:
    t = F.lower(col(title))

    def has(*words: str) -> Column:
        return t.rlike("|".join(words))

    return (
        F.when(t.isNull(), "Unknown")
        .when(has("claim", "billing"), "ClaimGeneration")
        .when(has("auth"), "Authentication")
        .when(has("payment"), "Payment")
        .when(has("database", "db"), "Database")
        .when(has("api", "service"), "API")
        .otherwise("General")
    )


def title_case(c: Column) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the rest (`foo.exe` -> `Foo.Exe`)."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, 2, 1 << 30))), "")


def module_from_process(process: Column | str) -> Column:
    p = F.lower(col(process).cast("string"))
    segment = F.get(F.filter(F.split(p, r"\\"), lambda s: (F.length(s) > 3) & ~s.contains("windows")), F.lit(0))
    return (
        F.when(p.isNull(), "Unknown")
        .when(p.contains("claimgeneration"), "ClaimGeneration")
        .when(p.contains("auth"), "Authentication")
        .when(p.contains("payment"), "Payment")
        .when(p.contains("billing"), "Billing")
        .otherwise(F.coalesce(title_case(segment), F.lit("General")))
    )


def short_label(etype: Column | str) -> Column:
    """Last dotted part of a type name, or its last word."""
    t = col(etype)
    last_word = F.element_at(F.split(strip(t), SPACE + "+"), -1)
    return F.when(text(t) == "", "Unknown").when(t.contains("."), F.element_at(F.split(t, r"\."), -1)).otherwise(last_word)


def percent_text(share: Column | str, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", col(share).cast("double") * F.lit(100.0))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^\\/]*)$", 1)


def technical_terms(message: Column | str) -> Column:
    """Type-like and identifier-like words, in pattern order, first spelling kept."""
    t = text(message)
    found = F.flatten(F.array(*[F.regexp_extract_all(t, F.lit(f"({p})"), F.lit(1)) for p in TERM_PATTERNS]))

    def distinct(words: Column) -> Column:
        keyed = F.struct(words.alias("w"), F.transform(words, lambda w: F.lower(w)).alias("k"))
        return let(keyed, lambda p: F.filter(p["w"], lambda w, i: F.array_position(p["k"], F.lower(w)) == (i + 1).cast("long")))

    return let(F.filter(found, lambda w: F.length(w) > 3), distinct)
