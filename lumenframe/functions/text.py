"""Text functions with Unicode-aware white space and null for no match."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# All white space, with the four separators U+001C to U+001F.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Trim all white space, not only spaces, in one pass."""
    return F.btrim(c, F.lit(WHITE))


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def extract(c: Column, pattern: str, group: int) -> Column:
    """First match of a group; null where there is none."""
    return F.when(F.regexp_like(c, F.lit(pattern)), F.regexp_extract(c, pattern, group))


def extract_all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def replace_first(c: Column, pattern: str, to: str) -> Column:
    """Replace the first match of a pattern without groups of its own."""
    return F.regexp_replace(c, f"(?s)^(.*?)(?:{pattern})", "$1" + to)


def strip_prefix(c: Column, prefix: str) -> Column:
    return F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, 2_147_483_647)).otherwise(c)


def strip_suffix(c: Column, suffix: str) -> Column:
    return F.when(c.endswith(suffix), F.substring(c, F.lit(1), F.char_length(c) - len(suffix))).otherwise(c)


def head(c: Column, n: Column) -> Column:
    """First n characters; a negative n leaves out the last -n."""
    keep = F.when(n >= 0, n).otherwise(F.greatest(F.char_length(c) + n, F.lit(0)))
    return F.substring(c, F.lit(1), keep)


def tail(c: Column, n: Column) -> Column:
    """Last n characters; a negative n leaves out the first -n."""
    size = F.char_length(c)
    keep = F.when(n >= 0, F.least(n, size)).otherwise(F.greatest(size + n, F.lit(0)))
    return F.substring(c, size - keep + 1, keep)


def slice_text(c: Column, offset: Column, length: Column) -> Column:
    """Characters from an offset, counted from the end when negative."""
    size = F.char_length(c)
    start = F.when(offset >= 0, offset).otherwise(size + offset)
    first = F.greatest(start, F.lit(0))
    return F.substring(c, first + 1, F.greatest(start + length - first, F.lit(0)))


def words(c: Column) -> Column:
    return F.split(c, " ")


def slug(c: Column) -> Column:
    """Any name as a lower-case identifier; nothing left gives `value`."""
    broken = F.regexp_replace(strip(c), "(.)([A-Z][a-z]+)", "$1_$2")
    broken = F.regexp_replace(broken, "([a-z0-9])([A-Z])", "$1_$2")
    made = F.btrim(F.regexp_replace(F.lower(broken), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(made, F.lit("")), F.lit("value"))


def slug_label(c: Column) -> Column:
    """A slug as a title; an empty one is `Root`."""
    made = title_case(strip(F.translate(c, "-_", "  ")))
    return F.coalesce(F.nullif(made, F.lit("")), F.lit("Root"))


def title_case(c: Column) -> Column:
    """Upper case after any character that is not a letter, lower case elsewhere."""
    parts = F.regexp_extract_all(c, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(parts, F.initcap), "")


def safe_key(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9_.-]+", "_")


def strip_code_fence(c: Column) -> Column:
    """Text inside a code fence, with or without the language name."""
    text = strip(c)
    opened = (F.when(text.startswith("```python"), strip(strip_prefix(text, "```python")))
              .when(text.startswith("```"), strip(strip_prefix(text, "```"))).otherwise(text))
    return F.when(opened.endswith("```"), strip(strip_suffix(opened, "```"))).otherwise(opened)
