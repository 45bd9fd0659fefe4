"""Scalar text expressions; all of them stay inside Catalyst."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Line that separates the user part of a template.
USER_MARKER = "[user turn]"
#: Longest instruction surface that identity looks at.
IDENTITY_CHARS = 200_000
SYSTEM_ROLES = ("system", "developer")


def tokens(chars: Column) -> Column:
    """Estimated tokens of so many characters."""
    return F.floor(chars / 4).cast("long")


def strip(text: Column) -> Column:
    """Without white space (any Unicode white space) at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def lines(text: Column) -> Column:
    """Stripped lines of a text, empty ones left out; repeats and order stay."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip), lambda x: x != "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two distinct arrays; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(template: Column, request: Column) -> Column:
    """Share of the template's distinct lines that the request holds; 0 for an empty template."""
    return F.when(F.size(template) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(template, request)) / F.size(F.array_distinct(template)))


def line_delta(old: Column, new: Column) -> tuple[Column, Column]:
    """(lines added, lines removed), as sets."""
    return F.size(F.array_except(new, old)).cast("long"), F.size(F.array_except(old, new)).cast("long")


def role_letter(role: Column) -> Column:
    return F.when(role.isin(*SYSTEM_ROLES), "S").when(role == "user", "U").when(role == "assistant", "A").when(role == "tool", "T").otherwise("?")


def role_sequence(messages: Column) -> Column:
    """One letter for each message."""
    return F.array_join(F.transform(messages, lambda m: role_letter(m["role"])), "")


def role_shape(sequence: Column) -> Column:
    """Loops of a role sequence folded: (AT)+, then (UA)+, then runs of A and of T."""
    for pattern, folded in (("(?:AT)+", "(AT)"), ("(?:UA)+", "(UA)"), ("A{2,}", "A"), ("T{2,}", "T")):
        sequence = F.regexp_replace(sequence, pattern, folded)
    return sequence


def of_roles(messages: Column, *roles: str) -> Column:
    """Texts of the messages with one of the roles, in order."""
    return F.transform(F.filter(messages, lambda m: m["role"].isin(*roles)), lambda m: F.coalesce(m["content"], F.lit("")))


def has_system(messages: Column) -> Column:
    return F.exists(messages, lambda m: m["role"].isin(*SYSTEM_ROLES))


def first_user_text(messages: Column) -> Column:
    return F.coalesce(F.try_element_at(of_roles(messages, "user"), F.lit(1)), F.lit(""))


def prompt_text(messages: Column) -> Column:
    """The instruction surface: system and developer texts, or the opening user turn if they are blank."""
    own = strip(F.array_join(of_roles(messages, *SYSTEM_ROLES), "\n"))
    return F.substring(F.when(own != "", own).otherwise(first_user_text(messages)), 1, IDENTITY_CHARS)


def user_template_text(messages: Column) -> Column:
    """The opening user turn of a request that has a system message, else nothing."""
    return F.when(has_system(messages), F.substring(first_user_text(messages), 1, IDENTITY_CHARS)).otherwise(F.lit(""))


def spaced_json(compact: Column) -> Column:
    """JSON text without spaces as the common writer spaces it: one after each comma and colon that is no part of a string."""
    marked = F.regexp_replace(compact, r'("(?:[^"\\\\]|\\\\.)*+"|[^",:]++)([,:]?)', "$1$2\x01")
    return F.regexp_replace(F.regexp_replace(marked, "([,:])\x01", "$1 "), "\x01", "")


def dumped_length(compact: Column) -> Column:
    """Characters of JSON text once it is spaced and all but ASCII is escaped (six characters, twelve beyond the first plane)."""
    count = lambda pattern: F.length(compact) - F.length(F.regexp_replace(compact, pattern, ""))
    return F.length(spaced_json(compact)) + 5 * count(r"[\x{80}-\x{FFFF}]") + 11 * count(r"[\x{10000}-\x{10FFFF}]")


def common_prefix_length(a: Column, b: Column) -> Column:
    """Characters that two strings begin alike. With the least and the greatest of a set, that of the whole set."""
    low, high = F.split(a, ""), F.split(b, "")
    differs = F.array_position(F.zip_with(low, high, lambda x, y: x.eqNullSafe(y)), False)
    return F.when((a == "") | (b == ""), F.lit(0)).when(differs > 0, differs - 1).otherwise(F.least(F.length(a), F.length(b))).cast("long")


def nearest_rank(values: Column, q: float) -> Column:
    """Percentile of an array at index round-half-even(q * (n - 1))."""
    ordered = F.sort_array(values)
    return F.when(F.size(values) > 0, F.try_element_at(ordered, (F.bround(F.lit(q) * (F.size(values) - 1)) + 1).cast("int")))


def upper_median(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.try_element_at(F.sort_array(values), F.floor(F.size(values) / 2).cast("int") + 1))


def rank_at(q: float) -> Callable[[Column], Column]:
    """The place of a percentile among n ordered values, as nearest_rank has it."""
    return lambda n: F.bround(F.lit(q) * (n - 1))


def counted_ranks(rows: DataFrame, keys: list[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(keys, one column for each place): order statistics of a group by its counted values, so no group's rows become one array.

    A place maps the number of values to an index from 0. Nulls don't count; groups without values have no row.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    group = Window.partitionBy(*keys)
    counted = counted.withColumns({"_upto": F.sum("_c").over(group.orderBy(value)), "_all": F.sum("_c").over(group)})
    return counted.groupBy(*keys).agg(*(F.min(F.when(F.col("_upto") > at(F.col("_all")), F.col(value))).alias(name) for name, at in places.items()))


def bucket(value: Column, bins: int) -> Column:
    """Histogram bin of a share in [0, 1]."""
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(value * bins).cast("int")))
