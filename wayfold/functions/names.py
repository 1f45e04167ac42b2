"""Column functions: names, roles, multiplicities, paths and text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_name(uri: Column) -> Column:
    """After the last '#', else after the last '/'."""
    return F.when(F.contains(uri, F.lit("#")), F.substring_index(uri, "#", -1)).otherwise(F.substring_index(uri, "/", -1))


def lower_first(x: Column) -> Column:
    return F.concat(F.lower(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))


def default_role(object_: Column) -> Column:
    """The rolename a tuple has without one: the last segment, its first letter small."""
    last = F.regexp_extract(object_, r"([A-Za-z_]\w*)(?:\[\w*\])?\s*$", 1)
    return lower_first(last)


def multiplicities(predicate: Column, spec: Column) -> Column:
    """All numbers in brackets as one array of tokens; the predicate's defaults without brackets."""
    found = F.filter(F.flatten(F.transform(F.regexp_extract_all(spec, F.lit(r"\[(.*?)\]"), F.lit(1)), lambda g: F.transform(F.split(g, ","), lambda x: F.trim(x)))), lambda x: x != "")
    default = F.when(predicate == "composes", F.array(F.lit("1"), F.lit("1"))).when(predicate == "associates", F.array_repeat(F.lit("-1"), 4))
    return F.when(F.size(found) > 0, found).otherwise(default)


def upper_bound(token: Column) -> Column:
    """A multiplicity as a number; null for none (-1, * and anything else)."""
    n = token.try_cast("int")
    return F.when(n >= 0, n)


def path_steps(path: Column) -> Column:
    """The steps of a path's text, as texts."""
    return F.regexp_extract_all(path, F.lit(r"(\.\w+|->\w+\[\w+\])"), F.lit(1))


def path_start(path: Column) -> Column:
    return F.regexp_extract(path, r"^\s*([A-Za-z_]\w*)", 1)


def hop_property(owner: Column, kind: Column, role: Column) -> Column:
    """The property's name for a hop from (kind C) or by participation in (kind P) an owner."""
    return F.concat(F.lit("has"), owner, F.when(kind == "P", "Participant_").otherwise("Composition_"), role)


def union_text(paths: Column) -> Column:
    """{a | b}, or a alone."""
    return F.when(F.size(paths) == 1, paths[0]).otherwise(F.concat(F.lit("{"), F.array_join(paths, " | "), F.lit("}")))


# LaTeX's special characters and their escapes. One pass over the text, so no escape is escaped again.
LATEX = {"{": r"\{", "}": r"\}", "_": r"\_", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "^": r"\textasciicircum{}", "~": r"\textasciitilde{}"}
BACKSLASH = r"\textbackslash\{\}"


def latex_escape(x: Column) -> Column:
    """x with LaTeX's special characters escaped; a backslash's own braces are escaped as all others are."""
    out = F.replace(x, F.lit("\\"), F.lit("\x00"))
    for a in ("{", "}", "_", "&", "%", "$", "#"):
        out = F.replace(out, F.lit(a), F.lit(LATEX[a]))
    out = F.replace(out, F.lit("\x00"), F.lit(BACKSLASH))
    for a in ("^", "~"):
        out = F.replace(out, F.lit(a), F.lit(LATEX[a]))
    return out


def truncated(items: Column, most: int) -> Column:
    """items, or the first most - 1 of them and an ellipsis."""
    return F.when(F.size(items) <= most, items).otherwise(F.concat(F.slice(items, 1, most - 1), F.array(F.lit("..."))))


def latex_query(text: Column, most: int = 8, size: str = r"\scriptsize") -> Column:
    """A query as LaTeX: its lines escaped and trimmed, empty ones left out, cut to so many."""
    lines = F.filter(F.transform(F.split(latex_escape(text), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    body = F.array_join(F.transform(truncated(lines, most), lambda x: F.concat(F.lit(r"\texttt{"), x, F.lit("}"))), r" \\ ")
    return F.concat(F.lit(rf"\begin{{minipage}}{{\linewidth}}\raggedright{size} "), body, F.lit(r" \end{minipage}"))
