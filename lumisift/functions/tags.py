"""Tag and caption expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def raw_tags(raw: Column) -> Column:
    """Blank-separated raw tag string -> array of tags."""
    return F.filter(F.split(raw, r"\s+"), lambda t: t != "")


def format_caption(raw: Column, add_comma: bool = True, remove_underscore: bool = True,
                   use_escape: bool = True) -> Column:
    """Raw tags -> caption text. Apply once, to raw tags only: escaping does not repeat."""
    # Each step works on the joined string: no character it changes occurs in a
    # separator, so one pass over the string replaces one pass per tag.
    text = F.trim(F.regexp_replace(raw, r"\s+", " "))
    if add_comma:
        text = F.replace(text, F.lit(" "), F.lit(", "))
    if remove_underscore:
        text = F.replace(text, F.lit("_"), F.lit(" "))
    if use_escape:
        text = F.replace(F.replace(text, F.lit("("), F.lit("\\(")), F.lit(")"), F.lit("\\)"))
    return text


def parse_caption(caption: Column) -> Column:
    """Comma-separated caption -> array of tags, in order, repeats kept."""
    flat = F.regexp_replace(caption, r"\s+", " ")
    plain = F.replace(F.replace(flat, F.lit("\\("), F.lit("(")), F.lit("\\)"), F.lit(")"))
    trimmed = F.transform(F.split(plain, ","), lambda t: F.trim(t))
    return F.filter(trimmed, lambda t: t != "")


def tags_match(tags: Column, all_of: Sequence[str] = (), any_of: Sequence[str] = (),
               none_of: Sequence[str] = ()) -> Column:
    """Exact, case-sensitive tag test. An empty list adds no constraint; null tags are none."""
    have = F.coalesce(tags, F.array().cast("array<string>"))
    test = F.lit(True)
    for tag in dict.fromkeys(all_of):
        test = test & F.array_contains(have, tag)
    if any_of:
        test = test & F.arrays_overlap(have, _literals(any_of))
    if none_of:
        test = test & ~F.arrays_overlap(have, _literals(none_of))
    return test


def edit_tag_array(tags: Column, remove: Sequence[str] = (), replace: Mapping[str, str] | None = None,
                   add: Sequence[str] = (), dedupe: bool = False, sort: bool = False) -> Column:
    """Literal bulk edit: remove, replace (one pass), add if absent, dedupe, sort."""
    out = F.coalesce(tags, F.array().cast("array<string>"))
    if remove:
        gone = _literals(remove)
        out = F.filter(out, lambda t: ~F.array_contains(gone, t))
    if replace:
        new = F.create_map(*[F.lit(v) for pair in replace.items() for v in pair])
        out = F.transform(out, lambda t: F.coalesce(F.try_element_at(new, t), t))
    if add:
        out = F.concat(out, F.array_except(_literals(add), out))
    if dedupe:
        out = F.array_distinct(out)
    return F.sort_array(out) if sort else out


def stem(path: Column) -> Column:
    """Last path segment without its extension (a leading dot is not an extension)."""
    return F.regexp_replace(last_segment(path), r"(?<=.)\.[^.]*$", "")


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder(path: Column) -> Column:
    """Everything before the last path segment, without the closing slash."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def words_of_stem(path: Column, regex: str = "") -> Column:
    """Tags from a file name: every match of `regex`, or the whole stem when it is empty."""
    name = stem(path)
    found = F.regexp_extract_all(name, F.lit(regex), F.lit(0)) if regex else F.array(name)
    return F.filter(found, lambda t: F.trim(t) != "")


def _literals(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])
