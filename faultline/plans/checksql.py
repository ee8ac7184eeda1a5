"""SQL fragments for the check queries, written for the checking engine's own functions.

Its `\\b` and `\\w` are ASCII-only, so word boundaries are spelled out with classes.
"""

SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
CONTROL = r"[\x00-\x1f\x7f-\x{9f}]"


def rx(value: str, pattern: str, by: str) -> str:
    return f"regexp_replace({value}, '{pattern}', '{by}', 'g')"


def strip(value: str) -> str:
    return rx(value, f"^{SPACE}+|{SPACE}+$", "")


def scrub(value: str) -> str:
    return rx(f"replace({strip(value)}, '﻿', '')", CONTROL, "")


def word(value: str, pattern: str, by: str) -> str:
    """Replace whole words; twice, because neighbours share their separator."""
    p = f"(^|{NOT_WORD}){pattern}($|{NOT_WORD})"
    return rx(rx(value, p, rf"\1{by}\2"), p, rf"\1{by}\2")


def signature(message: str, code: str) -> str:
    s = rx(f"lower(coalesce({message}, ''))", r"\p{Nd}+", "N")
    s = word(s, "[0-9a-f]{8,}", "ID")
    s = rx(s, f"{WORD}+@{WORD}+\\.{WORD}+", "EMAIL")
    return strip(f"({s} || CASE WHEN {strip(f'coalesce({code}, chr(32))')} <> '' THEN '|CODE:' || {code} ELSE '' END)")


def normalized(message: str) -> str:
    nd = r"\p{Nd}"
    s = rx(f"lower(coalesce({message}, ''))", nd + "{4}-" + nd + "{2}-" + nd + r"{2}[\t-\r\x1c-\x20\x{85}\p{Z}T]" + nd + "{2}:" + nd + "{2}:" + nd + "{2}", "TIMESTAMP")
    gap = r"[:\t-\r\x1c-\x20\x{85}\p{Z}]+[^\t-\r\x1c-\x20\x{85}\p{Z}]+"
    s = rx(s, "(?i)machine" + gap, "MACHINE")
    s = rx(s, "(?i)server" + gap, "SERVER")
    s = word(s, nd + "+", "NUM")
    s = word(s, "(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})", "GUID")
    s = word(s, "(?i:[0-9a-f]{32,})", "ID")
    return f"trim({rx(s, SPACE + '+', ' ')})"


def compare_signature(etype: str, message: str, code: str) -> str:
    return f"substr(md5(coalesce({etype}, '') || '|' || {normalized(message)} || '|' || coalesce({code}, '')), 1, 16)"


def js(doc: str, *keys: str) -> str:
    path = "$" + "".join(f'."{k}"' for k in keys)
    return f"json_extract_string({doc}, '{path}')"


def parsed(source: str, payload: str, repair: bool) -> str:
    """CTEs `p0`, `p`: the rows of `source` with `j` = readable JSON text or null, `ok` = a non-empty record."""
    s, c = strip(payload), scrub(payload)
    fixed = "CASE WHEN starts_with(c, '\"Exception\":') THEN '{' || c || repeat('}', greatest(0, 1 + len(c) - len(replace(c, '{', '')) - (len(c) - len(replace(c, '}', ''))))) END"
    tail = f"WHEN json_valid({fixed}) THEN {fixed} " if repair else ""
    return (
        f"p0 AS (SELECT *, {s} AS s, {c} AS c FROM {source}), "
        f"p1 AS (SELECT *, CASE WHEN json_valid(s) THEN s WHEN json_valid(c) THEN c {tail}END AS j FROM p0), "
        "p AS (SELECT *, coalesce(json_type(j) = 'OBJECT' AND len(json_keys(j)) > 0, false) AS ok FROM p1)"
    )


DETAILS = {
    "exception_type": ("Exception", "Exception Type"), "message": ("Exception", "Message"), "stack_trace": ("Exception", "StackTrace"),
    "inner_exception_type": ("Exception", "InnerException", "Exception Type"), "inner_exception_message": ("Exception", "InnerException", "Message"),
}
CODE = f"coalesce({js('j', 'Exception', 'InnerException', 'Code')}, {js('j', 'Exception', 'InnerException', 'ErrorCode')}, '')"

FALLBACK = {
    "exception_type": f'"Exception Type":{SPACE}*"([^"]+)"', "message": f'"Message":{SPACE}*"([^"]+)"', "stack_trace": f'"StackTrace":{SPACE}*"([^"]+)"',
    "inner_exception_type": f'(?s)"InnerException".*?"Exception Type":{SPACE}*"([^"]+)"',
    "inner_exception_message": f'(?s)"InnerException".*?"Message":{SPACE}*"([^"]+)"', "error_code": f'"(?:Code|ErrorCode)":{SPACE}*"([^"]+)"',
}


def fallback(name: str, payload: str) -> str:
    hit = f"regexp_extract(coalesce({payload}, ''), '{FALLBACK[name]}', 1)"
    return hit


def detail(name: str) -> str:
    return CODE if name == "error_code" else f"coalesce({js('j', *DETAILS[name])}, '')"


def detail_or_fallback(name: str, payload: str) -> str:
    return f"CASE WHEN ok THEN {detail(name)} ELSE {fallback(name, payload)} END"


#: A vector `v` as text, in hundred-thousandths.
VECTOR_TEXT = "array_to_string(list_transform(v, lambda x: CAST(round(x::DOUBLE * 100000) AS BIGINT)), ',')"


def embedded(tag: str, source: str, fitted: str, n_fitted: str, dimensions: int = 256) -> str:
    """CTEs of the default embedder: `{tag}b` (buckets of `source` (id, txt)), `{tag}v` (id, v); weights come from CTE `{fitted}b`."""
    return f"""{tag}b AS MATERIALIZED (SELECT id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {dimensions} AS b, count(*) AS tf
  FROM (SELECT id, unnest(regexp_extract_all(lower(txt), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM {source}) GROUP BY ALL),
{tag}x AS (SELECT t.id, t.b, t.tf * ln(({n_fitted} + 1.0::DOUBLE) / (coalesce(i.df, 0) + 1)) AS x FROM {tag}b t LEFT JOIN (SELECT b, count(*) AS df FROM {fitted}b GROUP BY b) i ON i.b = t.b),
{tag}n AS (SELECT id, sqrt(sum(x * x)) AS n FROM {tag}x GROUP BY id),
{tag}v AS MATERIALIZED (SELECT s.id, list(coalesce(x.x / nullif(n.n, 0), 0)::FLOAT ORDER BY g.b) AS v FROM {source} s CROSS JOIN range({dimensions}) AS g(b)
  LEFT JOIN {tag}x x ON x.id = s.id AND x.b = g.b LEFT JOIN {tag}n n ON n.id = s.id GROUP BY s.id)"""
