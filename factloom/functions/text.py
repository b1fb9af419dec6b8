"""Column expressions over paths, names and text.

Patterns are Java patterns; ``PY`` makes ``\\w``, ``\\b`` and ``\\s`` follow
Unicode and ``.`` stop at ``\\n`` only, which is how Python reads a pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PY = "(?Ud)"
MARK = "\u0001"


def find_all(text: Column, pattern: str, group: int = 1) -> Column:
    """All values of one group, in text order."""
    return F.regexp_extract_all(text, F.lit(PY + pattern), F.lit(group))


def find_first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, PY + pattern, group)


def count_of(text: Column, piece: str) -> Column:
    """How often a one-character text occurs."""
    return F.length(text) - F.length(F.translate(text, piece, ""))


def match_lines(text: Column, pattern: str) -> Column:
    """Line number of every match, in text order.

    Marks the match starts, cuts the text at line ends and repeats each line
    number by the marks on it: linear in the text, whatever the match count.
    """
    marked = F.regexp_replace(
        F.translate(text, MARK, "\u0002"), F.lit(PY + pattern), F.lit(MARK + "$0")
    )
    per_line = F.transform(
        F.split(marked, "\n"),
        lambda line, i: F.array_repeat((i + 1).cast("int"), count_of(line, MARK)),
    )
    return F.flatten(per_line)


def line_count(text: Column) -> Column:
    """Lines as a text iterator yields them: no extra line after a final newline."""
    newlines = F.when(text.endswith("\n"), 0).otherwise(1) + count_of(text, "\n")
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(newlines).cast("bigint")


def decode_utf8(content: Column) -> Column:
    """Bytes to text, invalid bytes dropped.

    ``make_valid_utf8`` puts U+FFFD for them, so that character is dropped too,
    and so is a byte order mark at the start.
    """
    return F.regexp_replace(F.translate(F.make_valid_utf8(content.cast("string")), "�", ""), "^\ufeff", "")


# paths ------------------------------------------------------------------

def segments(path: Column) -> Column:
    return F.split(F.translate(path, "\\", "/"), "/")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def module_of(path: Column) -> Column:
    folder = dir_name(path)
    return F.when(folder == "", F.lit("<root>")).otherwise(folder)


def extension(path: Column) -> Column:
    """Lower-cased text from the last dot; leading dots start no extension."""
    return F.lower(F.regexp_extract(base_name(path), r"^\.*[^.].*?(\.[^.]*)$", 1))


def depth(path: Column) -> Column:
    return F.size(segments(path)) - 1


def lookup(key: Column, table: dict[str, str], default: str | None = None) -> Column:
    """Value of a small fixed table."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    value = F.try_element_at(pairs, key)
    return F.coalesce(value, F.lit(default)) if default is not None else value


# names ------------------------------------------------------------------

def qualified(parent: Column, name: Column, separator: str = ".") -> Column:
    return F.when(parent == "", name).otherwise(F.concat(parent, F.lit(separator), name))


def safe_name(name: Column) -> Column:
    return F.translate(name, "/\\.", "___")


def display_name(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("src_"), F.lit("")), F.lit("_"), F.lit("/"))


def identifier_tokens(name: Column) -> Column:
    """Lower-cased words of a snake_case or camelCase name; digits are dropped."""
    words = F.regexp_extract_all(
        name, F.lit(r"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|[_.]|$)"), F.lit(0)
    )
    return F.transform(words, F.lower)


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two word lists as sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


# Character ranges a link target keeps besides word characters.
_CJK = (
    r"\u4e00-\u9fff\u3400-\u4dbf\u2e80-\u2eff\u3000-\u303f\uff00-\uffef"
    r"\uac00-\ud7af\u3040-\u309f\u30a0-\u30ff"
)


def anchor(heading: Column) -> Column:
    """Link target of a heading."""
    text = F.translate(F.lower(F.translate(heading, "`", "")), " .", "--")
    text = F.regexp_replace(text, PY + "[^\\w" + _CJK + "-]", "")
    return F.regexp_replace(F.regexp_replace(text, "-{2,}", "-"), "^-|-$", "")


def is_upper(text: Column) -> Column:
    return (F.upper(text) == text) & (F.lower(text) != text)


def one_line(text: Column) -> Column:
    return F.trim(F.translate(text, "\n", " "))


def ellipsis(text: Column, limit: int = 48) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit - 2)), F.lit("…"))).otherwise(text)


def escape_html(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def percent(ratio: Column) -> Column:
    return F.concat(F.bround(ratio * 100).cast("int").cast("string"), F.lit("%"))


def icon(confidence: Column) -> Column:
    from factloom.fixed_values import CONFIDENCE_ICON_OTHER, CONFIDENCE_ICONS

    return lookup(confidence, CONFIDENCE_ICONS, CONFIDENCE_ICON_OTHER)


def first_label(text: Column, labels: list[tuple[str, str]], other: str, ignore_case: tuple = ()) -> Column:
    """Label of the first listed piece the text contains."""
    result = F.lit(other)
    for piece, label in reversed(labels):
        hay = F.lower(text) if piece in ignore_case else text
        result = F.when(hay.contains(piece), F.lit(label)).otherwise(result)
    return result
