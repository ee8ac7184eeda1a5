"""Stack traces: frames, header, retrieval and search queries, error signature."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.text import SPACE, basename, col, let, present, strip, technical_terms, text

# --- fixed values: frame patterns (language, pattern, group of file, line, method, namespace, package)
_S = SPACE
_DRIVE = r"(?:[A-Za-z]:)?"
_GENERIC = r"(?i)([A-Za-z]:[^\t-\r\x1c-\x20\x{85}\p{Z}:()]+\.(?:cs|py|java|js|ts|cpp|c|h|vb|php|rb|go))\(?:(\p{Nd}+)\)?"


def frame_patterns(compat: bool = False) -> list[tuple]:
    """The five trace formats. Unless `compat`, C# and JavaScript paths may carry a drive letter."""
    drive = "" if compat else _DRIVE
    return [
        ("csharp", rf"at{_S}+([\p{{L}}\p{{N}}_.]+)\.([\p{{L}}\p{{N}}_<>]+)\([^)]*\){_S}+in{_S}+({drive}[^:]+):line{_S}+(\p{{Nd}}+)", 3, 4, 2, 1, None),
        ("python", rf'File{_S}+"([^"]+)",{_S}+line{_S}+(\p{{Nd}}+),{_S}+in{_S}+([\p{{L}}\p{{N}}_]+)', 1, 2, 3, None, None),
        ("java", rf"at{_S}+([\p{{L}}\p{{N}}_.]+)\.([\p{{L}}\p{{N}}_]+)\(([\p{{L}}\p{{N}}_.]+):(\p{{Nd}}+)\)", 3, 4, 2, None, 1),
        ("javascript", rf"at{_S}+([\p{{L}}\p{{N}}_]+){_S}+\(({drive}[^:]+):(\p{{Nd}}+):(\p{{Nd}}+)\)", 2, 3, 1, None, None),
        ("generic", _GENERIC, 1, 2, None, None, None),
    ]
# --- end of fixed values --------------------------------------------------------------------------


def _frame(language: str, pattern: str, file_g: int, line_g: int, method_g: int | None, ns_g: int | None, pkg_g: int | None):
    """Frame struct out of the text of one match."""
    def group(hit: Column, n: int | None) -> Column:
        return F.lit(None).cast("string") if n is None else F.regexp_extract(hit, pattern, n)

    return lambda hit: F.struct(
        group(hit, file_g).alias("file_path"), group(hit, line_g).try_cast("int").alias("line_number"),
        group(hit, method_g).alias("method_name"), group(hit, ns_g).alias("namespace"),
        group(hit, pkg_g).alias("package"), F.lit(language).alias("language"),
    )


def stack_frames(trace: Column | str, compat: bool = False) -> Column:
    """Frames of a trace as ARRAY<STRUCT>: all formats, in format order, then in text order."""
    t = text(trace)
    per_format = []
    for language, pattern, file_g, line_g, method_g, ns_g, pkg_g in frame_patterns(compat):
        hits = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))

        per_format.append(F.transform(hits, _frame(language, pattern, file_g, line_g, method_g, ns_g, pkg_g)))
    return F.concat(*per_format)


def unique_frames(frames: Column | str) -> Column:
    """Frames with the first of every (file, line) kept."""
    def key(f: Column) -> Column:
        return F.concat(text(f["file_path"]), F.lit(":"), F.coalesce(f["line_number"].cast("string"), F.lit("None")))

    def distinct(fr: Column) -> Column:
        keyed = F.struct(fr.alias("f"), F.transform(fr, key).alias("k"))
        return let(keyed, lambda p: F.filter(p["f"], lambda f, i: F.array_position(p["k"], key(f)) == (i + 1).cast("long")))

    return let(col(frames), distinct)


def language(frames: Column | str) -> Column:
    return F.get(col(frames), F.lit(0))["language"]


def trace_header(trace: Column | str) -> Column:
    """(exception_type, error_message) from the first five lines.

    Either `Type: message` with `Exception` on the left, or a line ending in Error/Exception whose next
    line, unless it is a frame, is the message. The line's own position is used to find the next line.
    """
    def kind(line: Column) -> Column:
        s = strip(line)
        left = F.substring_index(s, ": ", 1)
        return F.when(s.contains(": ") & left.contains("Exception"), 1).when(
            s.endswith("Error") | s.endswith("Exception"), 2
        ).otherwise(0)

    def read(lines: Column) -> Column:
        return let(F.transform(F.slice(lines, 1, 5), kind), lambda kinds: header(lines, kinds))

    def header(lines: Column, kinds: Column) -> Column:
        pos = F.array_position(F.transform(kinds, lambda k: k > 0), F.lit(True)).cast("int")
        hit, following, first_kind = strip(F.get(lines, pos - 1)), strip(F.get(lines, pos)), F.get(kinds, pos - 1)
        usable = (following != "") & ~following.startswith("at ") & ~following.startswith("File ")
        after = F.substring(hit, F.instr(hit, ": ") + 2, F.length(hit))
        return F.struct(
            F.when(first_kind == 1, strip(F.substring_index(hit, ": ", 1))).when(first_kind == 2, hit).alias("exception_type"),
            F.when(first_kind == 1, strip(after)).when((first_kind == 2) & usable, following).alias("error_message"),
        )

    return let(F.split(text(trace), "\n"), read)


def retrieval_query(frames: Column | str, header: Column | str) -> Column:
    """Type, message, and method and namespace of the first three frames."""
    h, top = col(header), F.slice(col(frames), 1, 3)
    words = F.flatten(F.transform(top, lambda f: F.array(present(f["method_name"]), present(f["namespace"]))))
    return F.array_join(F.concat(F.array(present(h["exception_type"]), present(h["error_message"])), words), " ")


def search_query(etype: Column | str, message: Column | str, inner_type: Column | str, frames: Column | str) -> Column:
    """Type, first method, class name, three technical terms of the message, inner type."""
    first = F.get(col(frames), F.lit(0))
    namespace = first["namespace"]
    class_name = F.when(namespace.contains("."), F.element_at(F.split(namespace, r"\."), -1))
    words = F.concat(
        F.array(present(etype), present(first["method_name"]), class_name),
        F.slice(technical_terms(message), 1, 3),
        F.array(present(inner_type)),
    )
    return F.array_join(words, " ")


def error_signature(etype: Column | str, frames: Column | str) -> Column:
    """16 hex digits over type, file name and method of the first frame; absent parts are left out."""
    first = F.get(col(frames), F.lit(0))
    file_name = F.when(text(first["file_path"]) != "", basename(first["file_path"]))
    return F.substring(F.md5(F.concat_ws("|", text(etype), file_name, present(first["method_name"]))), 1, 16)


def error_context(etype: Column | str, message: Column | str, inner_type: Column | str, frames: Column | str) -> Column:
    """Primary frame, up to three related frames, search query, signature, language, count.

    `frames` must already be unique.
    """
    fr = col(frames)
    return F.struct(
        F.get(fr, F.lit(0)).alias("primary_location"),
        F.slice(fr, 2, 3).alias("related_locations"),
        search_query(etype, message, inner_type, fr).alias("search_query"),
        error_signature(etype, fr).alias("error_signature"),
        language(fr).alias("language"),
        F.size(fr).alias("total_frames"),
    )
