"""Token counts under an existing byte-pair tokenizer, rolled up by slice.

Text is cut into the pieces of the tokenizer's pattern. Pieces repeat a lot, so each batch first counts how often each piece stands in each text; the merges run once per distinct piece of
the batch, over a linked list of symbols with a priority queue of merges, and the surviving symbols are weighted by the piece's frequency. Counts are exact.

The vocabulary is read once, on the driver, and broadcast: its size is that of the tokenizer, whatever the corpus.
"""

from __future__ import annotations

import base64
import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabularies and the file that is used unless another is named.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that goes with the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_ranks(path: str) -> dict[bytes, int]:
    """Merge ranks of a rank file: one line per token, its base64 form and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PieceCounter:
    """Counts tokens; remembers the counts of pieces up to a fixed number."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, remember: int = 400_000) -> None:
        self.ranks, self.pattern, self.remember = ranks, regex.compile(pattern), remember
        self.known: dict[str, int] = {}

    def symbols(self, piece: bytes) -> int:
        """How many symbols of ``piece`` survive all merges."""
        n = len(piece)
        if n < 2 or piece in self.ranks:
            return min(n, 1)
        end, nxt, prev, alive = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        queue = [(r, i, i + 2) for i in range(n - 1) if (r := self.ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(queue)
        left = n
        while queue:
            _, i, stop = heapq.heappop(queue)
            j = nxt[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue  # one of the two symbols has merged since
            end[i], nxt[i], alive[j] = stop, nxt[j], False
            if nxt[i] < n:
                prev[nxt[i]] = i
                if (r := self.ranks.get(piece[i : end[nxt[i]]])) is not None:
                    heapq.heappush(queue, (r, i, end[nxt[i]]))
            if (p := prev[i]) >= 0 and (r := self.ranks.get(piece[p:stop])) is not None:
                heapq.heappush(queue, (r, p, stop))
            left -= 1
        return left

    def of_piece(self, piece: str) -> int:
        """Tokens of one piece."""
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= self.remember:
                self.known.clear()
            n = self.symbols(piece.encode("utf-8", "replace"))
            if len(piece) < 64:
                self.known[piece] = n
        return n

    def of_texts(self, texts: list[str | None], at_once: int = 500) -> np.ndarray:
        """Tokens of each text: the distinct pieces of some texts are merged once each and weighted by how often each text has them."""
        out = np.zeros(len(texts), np.int64)
        for at in range(0, len(texts), at_once):
            index: dict[str, int] = {}
            piece, often, owner = [], [], []
            for i, text in enumerate(texts[at : at + at_once], at):
                counted = Counter(self.pattern.findall(text)) if text else {}
                piece += [index.setdefault(p, len(index)) for p in counted]
                often += counted.values()
                owner += [i] * len(counted)
            symbols = np.fromiter(map(self.of_piece, index), np.int64, len(index))
            np.add.at(out, np.array(owner, np.int64), symbols[np.array(piece, np.int64)] * np.array(often, np.int64))
        return out


def _counter(shared, pattern: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = PieceCounter(shared.value, pattern)
        for pdf in batches:
            yield pdf.drop(columns="text").assign(n_tokens=counter.of_texts(pdf["text"].tolist()))

    return run


def row_tokens(df: DataFrame, text: str, keep: list[Column], path: str = f"{TOKENIZERS}/{VOCABULARY}", pattern: str = PATTERN) -> DataFrame:
    """``keep`` plus ``n_tokens``, the tokens of the text; NULL and empty texts have none. Only the kept columns and the text reach Python."""
    rows = df.select(*keep, F.col(f"`{text}`").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    shared = df.sparkSession.sparkContext.broadcast(load_ranks(path))
    return rows.mapInPandas(_counter(shared, pattern), f"{schema}, n_tokens long")


def clean_source(source: Column) -> Column:
    """A source id without case, blanks around it or after its colon; NULL stays NULL."""
    return F.lower(F.regexp_replace(F.trim(source), r"\s*:\s*", ":"))


# Three-letter and retired codes of the languages at hand.
LANGUAGE_CODES = {"eng": "en", "ara": "ar", "urd": "ur", "ind": "id", "in": "id", "tur": "tr", "fra": "fr", "fre": "fr", "rus": "ru", "": "und"}


def clean_language(code: Column) -> Column:
    """A language code as two letters: lower case, without region, three-letter codes shortened; missing is 'und'."""
    base = F.lower(F.regexp_extract(F.coalesce(code, F.lit("")), r"^\s*([A-Za-z]*)", 1))
    table = F.create_map(*[F.lit(x) for kv in LANGUAGE_CODES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, base), base)


def token_budget(rows: DataFrame, by: list[str], item: str) -> DataFrame:
    """Exact totals per slice of ``rows`` (with ``n_tokens``): rows, rows with text, tokens, and the same counting each ``item`` once.

    An item that was delivered several times counts with its largest size. Partial sums are made before the shuffle, so a hot slice costs no more than any other.
    """
    once = rows.groupBy(*by, item).agg(F.count("*").alias("n"), F.sum(F.when(F.col("n_tokens") > 0, 1).otherwise(0)).alias("with_text"), F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("one"))
    return once.groupBy(*by).agg(
        F.sum("n").alias("n_rows"), F.sum("with_text").alias("n_with_text"), F.sum("tokens").alias("n_tokens"), F.count("*").alias("n_distinct"), F.sum("one").alias("n_distinct_tokens")
    )
