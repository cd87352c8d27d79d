"""Text rules as Column expressions; all of them stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, plus the four separator controls that Java's \s leaves out.
_BLANK = r"[\s\x1c-\x1f]"


def filled(c: Column) -> Column:
    """Null and missing read as the empty string."""
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Cut white space of any script from both ends; null becomes ''."""
    return F.regexp_replace(filled(c), f"(?U)^{_BLANK}+|{_BLANK}+$", "")


def norm_key(c: Column) -> Column:
    """Match key for names: lower case, only a-z and 0-9 kept."""
    return F.regexp_replace(F.lower(filled(c)), "[^a-z0-9]", "")


def norm_alnum(c: Column) -> Column:
    """Match key that keeps letters and digits of every script."""
    return F.regexp_replace(F.lower(filled(c)), r"[^\p{L}\p{N}]", "")


def squeeze(c: Column) -> Column:
    """Collapse white space to single blanks and strip the ends."""
    return F.btrim(F.regexp_replace(filled(c), f"(?U){_BLANK}+", " "))


def tidy_text(c: Column) -> Column:
    """One line of text ending in exactly one period; empty stays empty."""
    return F.when(filled(c) == "", "").otherwise(F.concat(F.rtrim(squeeze(c), F.lit(".")), F.lit(".")))


def first_filled(*cols: Column) -> Column:
    """First value that is neither null nor empty, else ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def fk_usage(child_table: Column, child_column: Column, parent_table: Column, parent_column: Column) -> Column:
    return F.concat(F.lit("Foreign key linking "), child_table, F.lit("."), child_column,
                    F.lit(" to "), parent_table, F.lit("."), parent_column)


def fk_summary(child_table: Column, child_column: Column, parent_table: Column, parent_column: Column,
               child_text: Column, parent_text: Column) -> Column:
    """Who references whom, followed by at most one of the two descriptions.

    The child's text is used only if it adds to the parent's: the parent key must not occur in the
    child key. An empty parent key occurs in every child key, so it never lets the child's text through.
    """
    child, parent = strip(child_text), strip(parent_text)
    extra = (F.when((child != "") & ~F.contains(norm_key(child), norm_key(parent)), child)
             .when(parent != "", parent))
    head = F.concat(child_table, F.lit("."), child_column, F.lit(" references "),
                    parent_table, F.lit("."), parent_column, F.lit("."))
    return tidy_text(F.concat_ws(" ", head, extra))


def labelled(name: Column, text: Column, before: str = ": ", after: str = "") -> Column:
    """``name: text``, or just the name where there is no text."""
    return F.when(filled(text) == "", filled(name)).otherwise(
        F.concat(filled(name), F.lit(before), text, F.lit(after)))


def edge_line(child_table: Column, child_column: Column, parent_table: Column, parent_column: Column,
              text: Column) -> Column:
    ends = F.concat(child_table, F.lit("."), child_column, F.lit(" → "), parent_table, F.lit("."), parent_column)
    return labelled(ends, text, " (", ")")


def contains_term(term: str, *cols: Column) -> Column:
    """Case-insensitive substring search over the columns joined by blanks; a blank term matches all."""
    needle = term.strip().lower()
    if not needle:
        return F.lit(True)
    return F.contains(F.lower(F.concat_ws(" ", *[filled(c) for c in cols])), F.lit(needle))


def whole_word(haystack: Column, name: Column) -> Column:
    """Does `name` stand in `haystack` between word boundaries? The name is taken literally."""
    literal = F.regexp_replace(name, r"(?U)([^\w])", r"\\$1")
    return F.regexp_like(haystack, F.concat(F.lit(r"(?U)\b"), literal, F.lit(r"\b")))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
