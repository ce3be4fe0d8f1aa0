"""Column functions: text, code and formatting scalars as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions import fixed


def text_of(c: Column | str) -> Column:
    """Null counts as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space of any script at either end (``trim`` drops U+0020 alone)."""
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def keywords(c: Column, most: int = 5) -> Column:
    """The first words of a-z that are no stop words and longer than three letters; repeats stay."""
    found = F.regexp_extract_all(F.lower(text_of(c)), F.lit(r"(?<![\p{L}\p{N}_])[a-z]+(?![\p{L}\p{N}_])"), F.lit(0))
    stop = F.array(*(F.lit(w) for w in fixed.STOP_WORDS))
    return F.slice(F.filter(found, lambda w: (F.length(w) > 3) & ~F.array_contains(stop, w)), 1, most)


def core_question(c: Column) -> Column:
    return strip(F.substring_index(strip(F.lower(text_of(c))), "(variant", 1))


def _cases(pairs: list[tuple[Column, Column]], other: Column) -> Column:
    out = other
    for test, value in reversed(pairs):
        out = F.when(test, value).otherwise(out)
    return out


def language_of_extension(path: Column) -> Column:
    ending = F.regexp_extract(text_of(path), r"[^/](\.[^./]+)$", 1)
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in fixed.LANGUAGES.items() for x in kv)), ending), F.lit("unknown"))


def language_of_path(path: Column) -> Column:
    p = text_of(path)
    return _cases([(F.endswith(p, F.lit("." + e)), F.lit(n)) for e, n in (("py", "python"), ("java", "java"), ("js", "javascript"), ("ts", "typescript"))], F.lit("unknown"))


def first_function(code: Column) -> Column:
    return F.regexp_extract(text_of(code), r"(?U)def\s+(\w+)", 1)


def first_class(code: Column) -> Column:
    return F.regexp_extract(text_of(code), r"(?U)class\s+(\w+)", 1)


def first_condition(code: Column) -> Column:
    return strip(F.regexp_extract(text_of(code), r"(?U)if\s+([^:]+):", 1))


def lines(code: Column) -> Column:
    return F.split(text_of(code), "\n")


def head(code: Column, n_lines: int = 20, n_chars: int = 500) -> Column:
    return F.substring(F.array_join(F.slice(lines(code), 1, n_lines), "\n"), 1, n_chars)


def line_slice(code: Column, first: Column, last: Column) -> Column:
    return F.array_join(F.slice(lines(code), first, last - first + 1), "\n")


def complexity(code: Column) -> Column:
    n = F.size(lines(code))
    return _cases([(n < 20, F.lit("simple")), (n < 100, F.lit("medium"))], F.lit("complex"))


def question_class(c: Column) -> Column:
    q = F.lower(text_of(c))
    return _cases([(F.contains(q, F.lit(w)), F.lit(w)) for w in ("what", "how", "why")], F.lit(None).cast("string"))


def occurrences(c: Column, part: str) -> Column:
    t = text_of(c)
    return ((F.length(t) - F.length(F.replace(t, F.lit(part), F.lit("")))) / len(part)).cast("long")


def tokens(c: Column) -> Column:
    return F.array_remove(F.split(text_of(c), r"[\s\p{Z}]+"), "")


def basename(path: Column) -> Column:
    return F.substring_index(text_of(path), "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(text_of(path), r"/?[^/]*$", "")


def dataset_name(stem: Column) -> Column:
    return F.regexp_replace(stem, "_(train|val)$", "")


def rule_id(file_path: Column, line_start: Column) -> Column:
    return F.concat_ws("_", text_of(file_path), F.coalesce(line_start, F.lit(0)).cast("string"))


def duration(seconds: Column) -> Column:
    """Seconds in the fixed format of hours, minutes and seconds."""
    whole = F.floor(seconds).cast("int")
    return _cases(
        [(seconds < 60, F.format_string("%.1f秒", F.bround(seconds, 1))), (seconds < 3600, F.format_string("%d分%d秒", (whole / 60).cast("int"), whole % 60))],
        F.format_string("%d小时%d分%d秒", (whole / 3600).cast("int"), ((whole % 3600) / 60).cast("int"), whole % 60),
    )


def shown(x: Column, digits: int) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit("N/A")).otherwise(F.format_string(f"%.{digits}f", x))


def order_key(seed: int, *ids: Column | str) -> Column:
    """The order of every seeded choice: alike on any engine and at any partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(i).cast("string") if isinstance(i, str) else i for i in ids)))


def fenced(snippets: Column, header: str) -> Column:
    """The first three snippets with code, fenced under a header; empty where there are no snippets."""
    before, between, after = fixed.SNIPPET_FORMAT
    some = F.filter(F.slice(snippets, 1, 3), lambda s: F.coalesce(s["code"], F.lit("")) != "")
    body = F.array_join(F.transform(some, lambda s: F.concat(F.lit(before), text_of(s["file_path"]), F.lit(between), s["code"], F.lit(after))), "")
    return F.when(F.coalesce(F.size(snippets), F.lit(0)) > 0, F.concat(F.lit(header), body)).otherwise(F.lit(""))
