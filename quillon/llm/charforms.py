"""One consistent character form for texts that look alike.

The operator follows the quick-check idea of Unicode normalization. One look-up table holds the properties of every character; a batch of texts is looked up at once and the properties are joined
word by word. A word is *unstable* if it holds a character whose quick-check property is not "yes", a form variant, an odd space, an invisible character, marks out of order, or look-alike letters that
do not all belong to the script of the word. Only unstable words are rewritten, and in them only the segments around the unstable places, with the base letter before them as boundary context and a look
at the letter after them; all else is spliced through untouched. A text in ASCII without control characters or odd blanks is done after that one test.

What counts as the same: canonically equivalent spellings, full-width and presentation forms, ligatures drawn as their letters,
look-alike letters of other scripts, Arabic letters drawn alike at their place in the word, any space. Invisible characters
vanish. Superscripts, circled and styled letters stay, since they look different.
"""

from __future__ import annotations

import re
import sys
import unicodedata as ud
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.plans.materialize import cut, keep_where

# Letters of other scripts that are drawn like a Latin letter, each with that letter (Cyrillic, Greek, Armenian, small capitals, Cherokee, Lisu).
LIKE_LATIN = {
    "а": "a", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ѕ": "s", "х": "x", "у": "y", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "Ԍ": "G",
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "ɡ": "g", "ɑ": "a", "օ": "o", "ս": "u", "Օ": "O", "κ": "ĸ", "к": "ĸ",
    "ᴄ": "c", "ᴋ": "ĸ", "ᴏ": "o", "ꜱ": "s", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮟ": "b", "Ꮤ": "W", "Ꮥ": "S", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
}
# Signs drawn alike.
LIKE_SIGN = {"‐": "-", "‑": "-", "µ": "μ", "Ω": "Ω", "۰": "٠", "۱": "١", "۲": "٢", "۳": "٣", "۷": "٧", "۸": "٨", "۹": "٩"}
# Decomposition tags whose letters look like their decomposition.
SAME_LOOK_TAGS = {"<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>"}
KEHEH, KAF, FARSI_YEH, YEH, ALEF_MAKSURA, HAMZA = "ک", "ك", "ی", "ي", "ى", "ء"
# Invisible characters that are not of category Cf.
INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
# Format characters that are drawn.
DRAWN_FORMAT = {*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD}


def _invisible(ch: str) -> bool:
    cp, cat = ord(ch), ud.category(ch)
    return cp in INVISIBLE or (cat == "Cf" and cp not in DRAWN_FORMAT) or (cat == "Cc" and not ch.isspace())


def _form(ch: str) -> str | None:
    """What a form variant is drawn like, or None."""
    d = ud.decomposition(ch)
    if not d.startswith("<"):
        return None
    tag, *cps = d.split()
    to = "".join(chr(int(x, 16)) for x in cps)
    if tag in SAME_LOOK_TAGS:
        return None if to[0] == " " and len(to) > 1 else to
    if tag == "<compat>" and len(to) > 1 and to[0] != " " and ud.category(ch) in ("Ll", "Lu", "Lt", "Lo", "Nl", "Po"):
        return to
    return None


#: Codes that can have a property: all but ideographs, Hangul syllables (stable as they are), surrogates, private use and unused planes.
_CODES = [*range(0x80, 0x3400), *range(0xA000, 0xAC00), *range(0xD7A4, 0xD800), *range(0xF900, 0x1FC00), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)]
#: Properties of a character, as bits.
HARD, CYR_ALIKE, CYR_OWN, GREEK_ALIKE, GREEK_OWN, LATIN_ALIKE, LATIN_OWN = 1, 2, 4, 8, 16, 32, 64


class _Tables:
    """Built once per process from the Unicode database."""

    def __init__(self) -> None:
        one: dict[int, str | None] = {}
        unstable, marks = [], []
        maybe = self._second_of_pairs()
        for cp in _CODES:
            ch = chr(cp)
            cat = ud.category(ch)
            if cat in ("Cn", "Co"):
                continue
            if ud.combining(ch):
                marks.append(cp)
            if _invisible(ch):
                one[cp] = None
            elif ch.isspace():
                one[cp] = " "
            elif ch in LIKE_LATIN or ch in LIKE_SIGN:
                one[cp] = LIKE_LATIN.get(ch) or LIKE_SIGN[ch]
            elif form := _form(ch):
                one[cp] = form
            elif cp in maybe or ch in (KEHEH, FARSI_YEH) or not ud.is_normalized("NFC", ch) or self._hides_alike(ch):
                pass
            else:
                continue
            unstable.append(cp)
        for cp in (*range(0x20), 0x7F):
            one[cp] = " " if chr(cp).isspace() else None
            unstable.append(cp)
        self.one = one
        self.like = str.maketrans(LIKE_LATIN | LIKE_SIGN)
        self._properties(unstable, marks)
        m, u = self._class(marks), self._class(unstable)
        self.segment = re.compile(f"[^{m}{u}]?[{m}]*[{u}][{u}{m}]*|[^{m}{u}]?[{m}]{{2,}}")
        self.spaces = re.compile("  +")

    def _properties(self, unstable: list[int], marks: list[int]) -> None:
        """``bits`` of each character, its combining class, and how many letters of one script only it stands for (Cyrillic, Greek, Latin)."""
        self.bits = np.zeros(sys.maxunicode + 1, np.uint8)
        self.order = np.zeros(sys.maxunicode + 1, np.uint8)
        self.counts = np.zeros((3, sys.maxunicode + 1), np.int8)
        self.bits[unstable] = HARD
        for cp in marks:
            self.order[cp] = ud.combining(chr(cp))
        for cp in {*range(0x41, 0x530), *range(0x1D00, 0x2200), *unstable}:  # no other character is or hides a letter of the three scripts
            ch = chr(cp)
            stands_for = self.one.get(cp, ch)
            d = ud.normalize("NFD", stands_for or "").translate(self.like)
            letters = _script(d)
            for k in range(3):
                self.counts[k, cp] = letters[k]
            bare = ud.normalize("NFD", ch)
            own = CYR_OWN * (letters[0] > 0) | GREEK_OWN * (letters[1] > 0) | LATIN_OWN * (letters[2] > 0)
            if bare[0] in LIKE_LATIN:
                like = LIKE_LATIN[bare[0]]
                composed = ud.is_normalized("NFC", ch)
                if composed and _CYRILLIC.get(like) == bare[0]:
                    self.bits[cp] = CYR_ALIKE
                elif composed and _GREEK.get(like) == bare[0]:
                    self.bits[cp] = GREEK_ALIKE
            elif bare[0] in _ALIKE:
                self.bits[cp] |= LATIN_ALIKE
            else:
                self.bits[cp] |= own

    @staticmethod
    def _second_of_pairs() -> set[int]:
        """Characters whose quick-check property is "maybe": they can compose with what stands before them."""
        found = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
        for cp in range(0xC0, 0x1FFFF):
            d = ud.decomposition(chr(cp))
            if d and d[0] != "<" and len(d.split()) == 2:
                found.add(int(d.split()[1], 16))
        return found

    @staticmethod
    def _hides_alike(ch: str) -> bool:
        """An accented letter whose base letter is a look-alike."""
        d = ud.normalize("NFD", ch)
        return len(d) > 1 and d[0] in LIKE_LATIN

    @staticmethod
    def _class(cps: list[int]) -> str:
        parts, cps = [], sorted(cps)
        i = 0
        while i < len(cps):
            j = i
            while j + 1 < len(cps) and cps[j + 1] == cps[j] + 1:
                j += 1
            parts.append(f"\\U{cps[i]:08x}" + (f"-\\U{cps[j]:08x}" if j > i else ""))
            i = j + 1
        return "".join(parts)


@lru_cache(1)
def _tables() -> _Tables:
    return _Tables()


def _joins(nxt: str) -> bool:
    """Whether an Arabic letter before ``nxt`` is drawn joined to it."""
    return bool(nxt) and nxt != HAMZA and ud.category(nxt)[0] == "L" and ud.bidirectional(nxt) == "AL"


def _positional(s: str, following: str) -> str:
    """Kaf and yeh variants by the way they are drawn at their place."""
    out = []
    for i, ch in enumerate(s):
        if ch in (KEHEH, FARSI_YEH):
            nxt = next((c for c in s[i + 1 :] if not ud.combining(c)), following)
            ch = (KAF if ch == KEHEH else YEH) if _joins(nxt) else (KEHEH if ch == KEHEH else ALEF_MAKSURA)
        out.append(ch)
    return "".join(out)


def skeleton(text: str) -> str:
    """The form under which texts that look alike are equal: look-alikes as Latin letters, composed, single spaces."""
    t = _tables()

    def fix(m: re.Match) -> str:
        s = ud.normalize("NFD", m.group().translate(t.one)).translate(t.like)
        if KEHEH in s or FARSI_YEH in s:
            end = m.end()
            while end < len(text) and ud.combining(text[end]):
                end += 1
            s = _positional(s, text[end : end + 1])
        return ud.normalize("NFC", s)

    out = t.segment.sub(fix, text)
    if not ud.is_normalized("NFC", out):  # a segment that lost its base to an invisible character
        out = ud.normalize("NFC", out)
    return t.spaces.sub(" ", out).strip(" ")


# The letter that a look-alike is written with in a word of that script: the first one named above.
_CYRILLIC = {v: k for k, v in reversed(list(LIKE_LATIN.items())) if "CYRILLIC" in ud.name(k)}
_GREEK = {v: k for k, v in reversed(list(LIKE_LATIN.items())) if "GREEK" in ud.name(k)}
_TO = {"CYRILLIC": str.maketrans(_CYRILLIC), "GREEK": str.maketrans(_GREEK)}
_ALIKE = set(LIKE_LATIN.values())
_OTHER = re.compile("[Ͱ-ԯ]")


def _script(word: str) -> tuple[int, int, int]:
    """Letters that belong to one script only: Cyrillic, Greek, Latin."""
    cyr = greek = latin = 0
    for ch in ud.normalize("NFD", word):
        if "Ѐ" <= ch <= "ԯ":
            cyr += 1
        elif "Ͱ" <= ch <= "Ͽ":
            greek += 1
        elif ch.isalpha() and ch < "ɐ" and ch not in _ALIKE:
            latin += 1
    return cyr, greek, latin


def canonical(text: str) -> str:
    """The consistent form of a text: :func:`skeleton`, with look-alikes written in the script of their word.

    A word that has a letter of one script only is written in that script; a word of look-alikes only takes the script that
    most such letters of the text belong to, Latin where there are none. The result depends on the skeleton alone, so texts that look
    alike get the same form.
    """
    s = skeleton(text)
    if not _OTHER.search(s):
        return s
    cyr, greek, latin = _script(s)
    default = "CYRILLIC" if cyr > max(latin, greek) else "GREEK" if greek > max(latin, cyr) else ""
    return " ".join(_in_script(word, default) for word in s.split(" "))


def _in_script(word: str, default: str) -> str:
    """A word of the skeleton with its look-alikes in the script of its other letters, or in the default one."""
    c, g, n = _script(word)
    to = "CYRILLIC" if c > max(g, n) else "GREEK" if g > max(c, n) else "" if n else default
    return ud.normalize("NFC", ud.normalize("NFD", word).translate(_TO[to])) if to else word


def _unstable(t: _Tables, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the unstable words of the joined texts, the text each is in, and for each text the script of its words of look-alikes only (0 Latin, 1 Cyrillic, 2 Greek). ``starts`` are those of the texts, none of which is empty."""
    blank = codes == 0x20
    head = np.zeros(len(codes), bool)
    head[starts[starts < len(codes)]] = True
    first = ~blank
    first[1:] &= blank[:-1] | head[1:]
    words = np.flatnonzero(first)
    if not len(words):
        return words, words, np.zeros(len(starts), np.int8)
    bits = np.bitwise_or.reduceat(t.bits[codes], words)
    rank = t.order[codes]
    wrong = np.flatnonzero((rank[1:] > 0) & (rank[:-1] > rank[1:]) & ~head[1:])
    bits[np.searchsorted(words, wrong + 1, "right") - 1] |= HARD
    owner = np.searchsorted(starts, words, "right") - 1
    cyr, greek, latin = (np.add.reduceat(c[codes], starts, dtype=np.int64) for c in t.counts)
    mostly_cyr, mostly_greek = cyr > np.maximum(latin, greek), greek > np.maximum(latin, cyr)
    c_own, g_own, l_own = ((bits & b) > 0 for b in (CYR_OWN, GREEK_OWN, LATIN_OWN))
    alike = bits & (CYR_ALIKE | GREEK_ALIKE | LATIN_ALIKE)
    no_own = ~(c_own | g_own | l_own)
    to_cyr = (c_own & ~g_own & ~l_own) | (no_own & mostly_cyr[owner])
    to_greek = (g_own & ~c_own & ~l_own) | (no_own & mostly_greek[owner])
    to_latin = (l_own & ~c_own & ~g_own) | (no_own & ~(mostly_cyr | mostly_greek)[owner])
    fits = (alike == 0) | ((alike == CYR_ALIKE) & to_cyr) | ((alike == GREEK_ALIKE) & to_greek) | ((alike == LATIN_ALIKE) & to_latin)
    unstable = ((bits & HARD) > 0) | ~fits
    return words[unstable], owner[unstable], mostly_cyr + np.int8(2) * mostly_greek


_PLAIN = re.compile(r"[!-~]+(?: [!-~]+)*")


def canonical_batch(texts: list[str | None], known: dict[tuple[str, str], str] | None = None, chars: int = 1_000_000) -> list[str | None]:
    """:func:`canonical` of many texts: quick check of all words at once, then only unstable words are rewritten and spliced in. ``known`` remembers rewritten words, up to a fixed number."""
    t, out = _tables(), list(texts)
    known = {} if known is None else known
    todo = [i for i, x in enumerate(texts) if x and not (x.isascii() and _PLAIN.fullmatch(x))]
    at = 0
    while at < len(todo):
        end, n = at, 0
        while end < len(todo) and (end == at or n + len(texts[todo[end]]) <= chars):
            n += len(texts[todo[end]])
            end += 1
        part = todo[at:end]
        at = end
        lengths = np.array([len(texts[i]) for i in part])
        starts = np.cumsum(lengths) - lengths
        codes = np.frombuffer("".join(texts[i] for i in part).encode("utf-32-le", "surrogatepass"), np.uint32)
        words, owner, scripts = _unstable(t, codes, starts)
        for k, group in _by_owner(owner, words):
            text, default = texts[part[k]], ("", "CYRILLIC", "GREEK")[scripts[k]]
            done, pieces = 0, []
            for s in (group - starts[k]).tolist():
                e = text.find(" ", s)
                e = len(text) if e < 0 else e
                word = text[s:e]
                new = known.get((word, default))
                if new is None:
                    if len(known) > 200_000:
                        known.clear()
                    new = _rewritten(word, default)
                    if len(word) < 64:
                        known[word, default] = new
                pieces += [text[done:s], new]
                done = e
            out[part[k]] = "".join([*pieces, text[done:]])
        for i in part:
            out[i] = (t.spaces.sub(" ", out[i]) if "  " in out[i] else out[i]).strip(" ")
    return out


def _by_owner(owner: np.ndarray, words: np.ndarray):
    if len(owner):
        cuts = np.flatnonzero(np.diff(owner)) + 1
        yield from zip(owner[np.concatenate([[0], cuts])].tolist(), np.split(words, cuts))


def _rewritten(word: str, default: str) -> str:
    """An unstable word in its consistent form; it may hold odd spaces."""
    return " ".join(_in_script(w, default) for w in skeleton(word).split(" "))


@F.pandas_udf(T.StringType())
def _canonical_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    known: dict[tuple[str, str], str] = {}
    for texts in batches:
        yield pd.Series(canonical_batch(texts.tolist(), known), dtype=object)


def canonical_form(text: Column) -> Column:
    """Column form of :func:`canonical`. NULL stays NULL, a text without visible characters gives ''."""
    return _canonical_udf(text)


def with_canonical(df: DataFrame, fields: list[str], suffix: str = "_canonical") -> DataFrame:
    """``df`` with one further column per field that holds its consistent form.

    Other columns, repeated rows and ties are kept as they are. A field named ``x`` gives ``x_canonical``; a column of that name that is
    already there is replaced.
    """
    return df.withColumns({f"{f}{suffix}": canonical_form(F.col(f"`{f}`")) for f in fields})


def alike_pairs(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Pairs of rows whose field looks the same but is stored differently: ``(id_a, id_b, field_name)``, smaller id first.

    Texts are first reduced to their distinct stored strings, and strings whose look nobody else shares are dropped, so copies of
    one string cause no work among themselves. The hashes of look and string are written to the shared folder once, so each text passes through Python once. What remains is joined on the look; only then are strings expanded to rows. NULL
    texts and texts without visible characters are no cases; a row is never paired with itself.
    """
    k = F.col(f"`{key}`")
    long = df.where(k.isNotNull()).select(k.alias("id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("text")) for f in fields])).alias("x"))
    long = long.select("id", "x.field", "x.text").where(F.col("text") != "")
    rows = keep_where(long.withColumn("form", canonical_form(F.col("text"))), F.col("form") != "")
    rows = cut(rows.select("id", "field", F.md5(F.concat_ws("\u0000", "field", "form")).alias("look"), F.md5(F.concat_ws("\u0000", "field", "text")).alias("stored")))
    stored = rows.groupBy("look", "stored", "field").agg(F.lit(1).alias("one"))
    several = stored.groupBy("look").agg(F.count("*").alias("n")).where("n > 1").select("look")
    kinds = stored.join(several, "look", "left_semi").select("look", "stored", "field")
    a = kinds.select("look", "field", F.col("stored").alias("stored_a"))
    b = kinds.select("look", F.col("stored").alias("stored_b"))
    both = a.join(b, "look").where(F.col("stored_a") < F.col("stored_b")).select("field", "stored_a", "stored_b")
    ra = rows.select(F.col("stored").alias("stored_a"), F.col("id").alias("x"))
    rb = rows.select(F.col("stored").alias("stored_b"), F.col("id").alias("y"))
    out = both.join(ra, "stored_a").join(rb, "stored_b").where(F.col("x") != F.col("y"))
    return out.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), F.col("field").alias("field_name"))
