"""Array, map and JSON scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import text as tx


def clean_distinct(items: Column) -> Column:
    """Trimmed, non-empty elements, each once, in order; NULL gives an empty array."""
    trimmed = F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit(""))))
    return F.array_distinct(F.array_remove(trimmed, ""))


def flag(flags: Column, key: str, default: bool = False) -> Column:
    """A flag of a map, the default where it is missing."""
    return F.coalesce(F.try_element_at(flags, F.lit(key)), F.lit(default))


def set_flags(flags: Column) -> Column:
    """P10: the names of the flags that are set, sorted."""
    return F.array_sort(F.map_keys(F.map_filter(flags, lambda k, v: F.coalesce(v, F.lit(False)))))


def phrases_for(tokens: Column, table: dict[str, list[str]]) -> Column:
    """The phrases of all tokens, each once, in order of the tokens."""
    known = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.array_distinct(F.flatten(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(known, tx.canonical_token(t)), F.array().cast("array<string>")))))


def any_term(tokens: Column) -> Column:
    """Distinct terms joined by OR, terms of several words in quotes."""
    quoted = F.transform(F.array_distinct(tokens), lambda t: F.when(t.contains(" "), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(t))
    return F.array_join(quoted, " OR ")


def json_text(c: Column, *paths: str) -> Column:
    """The first of the JSON paths that holds a text; malformed JSON gives NULL."""
    v = F.try_parse_json(c)
    return F.coalesce(*[F.try_variant_get(v, p, "string") for p in paths])


def json_numbers(c: Column, path: str) -> Column:
    """An array of numbers inside JSON, such as a stored vector; NULL where there is none."""
    return F.try_variant_get(F.try_parse_json(c), path, "array<float>")


def swap_prefix(c: Column, old: str, new: str) -> Column:
    """an id with another prefix; ids without the old one stay."""
    return F.when(c.startswith(old), F.concat(F.lit(new), F.substring(c, F.lit(len(old) + 1), F.length(c)))).otherwise(c)


def named(c: Column, table: dict[str, str], otherwise: str | None = None) -> Column:
    """A value by its lower-case name."""
    return F.coalesce(tx.lookup(table, F.lower(F.trim(tx.text_or_empty(c)))), F.lit(otherwise))


def step(c: Column, steps: list[tuple[float, float]], otherwise: float) -> Column:
    """A piecewise constant: the value of the first step whose bound is reached, bounds descending."""
    out = F.lit(otherwise)
    for bound, value in reversed(steps):
        out = F.when(c >= bound, value).otherwise(out)
    return out


def iso_time(c: Column) -> Column:
    """A time as ISO text in UTC (the session's zone is UTC)."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
