"""SQL texts of the scalar functions, for the oracles."""

from __future__ import annotations

from quillon.functions import text as tx


def norm(c: str) -> str:
    """Normalized search text."""
    folded = f"replace(translate(lower(coalesce({c}, '')), '_ς', ' σ'), 'ß', 'ss')"
    return rf"trim(regexp_replace(regexp_replace({folded}, '[^\p{{L}}\p{{N}}\s:]+', ' ', 'g'), '\s+', ' ', 'g'))"


def words(c: str) -> str:
    """Words between single spaces."""
    return f"list_filter(string_split({c}, ' '), lambda t: t <> '')"


def match_words(c: str) -> str:
    """All words of the normalized text."""
    return words(norm(c))


def strings(items) -> str:
    """A list literal."""
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"


def search_words(c: str) -> str:
    """Search words: canonical, without stopwords unless there are only such."""
    stops = strings(tx.STOPWORDS)
    kept = f"list_filter({match_words(c)}, lambda t: NOT list_contains({stops}, t))"
    one = "CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.CANONICAL_TOKENS.items()) + " ELSE t END"
    return f"list_transform(CASE WHEN len({kept}) > 0 THEN {kept} ELSE {match_words(c)} END, lambda t: {one})"


def grams(c: str, n: int = 3) -> str:
    """Distinct character n-grams."""
    return f"list_distinct(list_transform(range(1, length({c}) - {n - 2}), lambda i: substr({c}, i, {n})))"


def same(items: str, w: str) -> str:
    """How often a word stands in a list."""
    return f"len(list_filter({items}, lambda z: z = '{w}'))"
