"""Functions of strings, and of rows as strings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How a NULL is written where values become text.
NULL_TEXT = "NULL"


def as_text(column: Column) -> Column:
    """The value as mined text; NULL is a value of its own."""
    return F.coalesce(column.cast("string"), F.lit(NULL_TEXT))


def trimmed(text: Column, side: str = "both") -> Column:
    return {"left": F.ltrim, "right": F.rtrim, "both": F.trim}[side](text)


def trimmed_list(text: Column, separator: str = ",") -> Column:
    """Parts of a separated list, without the blanks around them."""
    return F.transform(F.split(text, f"[{separator}]"), lambda x: F.trim(x))


def row_sentence(columns: Sequence[str]) -> Column:
    """A row's cells, joined by spaces."""
    return F.concat_ws(" ", *[as_text(F.col(c)) for c in columns])


def weighted_sentence(columns: Sequence[str], weights: dict[str, int]) -> Column:
    """A row's cells, each as often as its column's weight says (0: left out)."""
    return F.concat_ws(" ", *[F.array_repeat(as_text(F.col(c)), weights.get(c, 0)) for c in columns])


def short_number(number: Column) -> Column:
    """Two decimals, without trailing zeros: 10, 1.5, 0.25."""
    return F.regexp_replace(F.format_string("%.2f", number.cast("double")), r"\.?0+$", "")


def canonical_items(items: Column) -> Column:
    """An attribute set or itemset in its one order, without repeats."""
    return F.array_sort(F.array_distinct(items))


def escaped(value: Column) -> Column:
    """The value with a backslash before what has a meaning in rule text, and before blanks at its ends. A `_`
    has one only where it stands alone."""
    out = F.regexp_replace(value, r"([\\,=|()\[\]]|^\s|\s$)", r"\\$1")
    return F.when(value == "_", F.lit("\\_")).otherwise(out)


def unescaped(text: Column) -> Column:
    """The value that `escaped` gave the text of."""
    return F.regexp_replace(text, r"(?s)\\(.?)", "$1")


def stripped(text: Column) -> Column:
    """Escaped text without the blanks around it; one with a backslash before it stays."""
    return F.regexp_replace(text, r"(?s)^\s*((?:[^\\]|\\.)*?)\s*$", "$1")


def escaped_parts(text: Column, separator: str = ",") -> Column:
    """Parts of a list of escaped values, still escaped, without the blanks around them."""
    ended = F.regexp_replace(text, rf"\G((?:[^\\{separator}]|\\.)*+){separator}", "$1\u0001")
    return F.transform(F.split(ended, "\u0001"), stripped)


def value_hash(*columns: Column) -> Column:
    """64 bits of values as text, in order; equal values have equal hashes."""
    return F.xxhash64(*[as_text(c) for c in columns])


def list_distance(a: Column, b: Column, vocabulary: Sequence[str]) -> Column:
    """The edit distance of two arrays of names, each name a letter of its own. NULL where a name isn't in the
    vocabulary, which holds up to 20,000 names."""
    letters = {name: chr(0x4E00 + k) for k, name in enumerate(sorted(set(vocabulary)))}
    if len(letters) > 20_000:
        raise ValueError(f"{len(letters)} names, at most 20000 have letters")
    code = F.create_map(*[F.lit(x) for pair in letters.items() for x in pair])
    spelled = lambda v: F.when(F.forall(v, lambda n: F.map_contains_key(code, n)), F.array_join(F.transform(v, lambda n: code[n]), ""))
    return F.levenshtein(spelled(a), spelled(b))
