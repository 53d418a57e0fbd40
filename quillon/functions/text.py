"""Text scalars as Column functions. All of them run in the JVM; NULL input counts as an empty text unless said otherwise.

Regular expressions name their Unicode classes, since ``\\w`` differs between Python, Java and SQL engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a search.
STOPWORDS = [
    "a", "an", "the", "and", "or", "but", "of", "in", "on", "to", "for", "from", "with", "what", "which", "who", "whom", "whose", "is", "are", "was", "were", "be", "been", "about", "show", "tell", "me",
    "does", "do", "did", "there", "any", "this", "that", "these", "those", "it", "its", "can", "could", "would", "should", "explain", "please",
]
# Search words with the word they stand for.
CANONICAL_TOKENS = {"angry": "anger", "provision": "rizq", "provisions": "rizq", "sustenance": "rizq", "livelihood": "rizq", "rizk": "rizq", "رزق": "rizq"}
# Synonyms that widen a search.
SYNONYMS = {
    "sabr": ["patience"], "patience": ["sabr"], "niyyah": ["intention", "intentions"], "intention": ["niyyah", "intentions"], "intentions": ["niyyah", "intention"],
    "taqwa": ["piety", "godconsciousness", "god-consciousness"], "piety": ["taqwa"], "rizq": ["provision", "provisions", "sustenance", "livelihood"], "provision": ["rizq", "sustenance", "livelihood"],
    "sustenance": ["rizq", "provision", "livelihood"], "livelihood": ["rizq", "provision", "sustenance"], "tawakkul": ["reliance", "trust"], "reliance": ["tawakkul"], "iman": ["faith"], "faith": ["iman"],
    "mercy": ["rahmah"], "rahmah": ["mercy"], "hardship": ["difficulty"], "difficulty": ["hardship"], "anger": ["angry", "do not get angry", "don't get angry"], "angry": ["anger", "do not get angry", "don't get angry"],
}
# Letters folded in the light and the further letters folded in the aggressive Arabic form.
ARABIC_LIGHT_FROM, ARABIC_LIGHT_TO = "أإآٱٲٳٵؤئىء", "اااااااويي"
ARABIC_FURTHER_FROM, ARABIC_FURTHER_TO = "ىة", "اه"
# Vowel marks and annotation signs, direction and format controls, punctuation, verse ornaments (as regular-expression classes).
ARABIC_MARKS = r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}]"
FORMAT_CONTROLS = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{FEFF}]"
ARABIC_PUNCTUATION = r"[،؛؟۔,;?!:.…﴿﴾]"
VERSE_NUMBER = r"(^|\s)[(\[{]*[0-9٠-٩۰-۹]+[)\]}]*(\s|$)"


def text_or_empty(c: Column) -> Column:
    """NULL as ''."""
    return F.coalesce(c, F.lit(""))


def lookup(table: dict[str, str], c: Column) -> Column:
    """``table[c]`` or NULL; the table is a literal of the plan."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def collapse(c: Column) -> Column:
    """runs of whitespace as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_search(c: Column) -> Column:
    """case-folded words of letters, digits and colons, separated by single spaces."""
    folded = F.replace(F.replace(F.lower(text_or_empty(c)), F.lit("ς"), F.lit("σ")), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}:]+", " "))


def words(c: Column) -> Column:
    """the parts between single spaces, without empty ones."""
    return F.array_remove(F.split(text_or_empty(c), " "), "")


def canonical_token(c: Column) -> Column:
    """the word a search word stands for."""
    return F.coalesce(lookup(CANONICAL_TOKENS, c), c)


def search_tokens(c: Column) -> Column:
    """canonical search words without stopwords; if only stopwords are there, these."""
    return normalized_tokens(normalize_search(c))


def normalized_tokens(c: Column) -> Column:
    """F2 for a text that is normalized already."""
    every = words(c)
    kept = F.filter(every, lambda t: ~t.isin(*STOPWORDS))
    return F.transform(F.when(F.size(kept) > 0, kept).otherwise(every), canonical_token)


def expand_tokens(tokens: Column) -> Column:
    """Each token followed by its synonyms, each once, in order."""
    table = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.array_distinct(F.flatten(F.transform(tokens, lambda t: F.concat(F.array(t), F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>"))))))


def _grams(c: Column, q: int) -> Column:
    """All character q-grams in order: the list of characters beside itself, shifted; a shorter text has none. The work follows the length of the text."""
    chars = F.split(c, "")
    joined = chars
    for k in range(1, q):
        joined = F.zip_with(joined, F.slice(chars, k + 1, 2_000_000_000), lambda x, y: F.concat(x, y))
    return F.array_compact(joined)


def trigrams(c: Column) -> Column:
    """distinct trigrams of the text between two spaces on each side."""
    return F.array_distinct(_grams(F.concat(F.lit("  "), c, F.lit("  ")), 3))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the trigrams of two normalized texts; 0 if either is empty, 1 if they are equal."""
    x, y = normalize_search(a), normalize_search(b)
    both, either = F.size(F.array_intersect(trigrams(x), trigrams(y))), F.size(F.array_union(trigrams(x), trigrams(y)))
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).otherwise(both / either)


def qgrams(c: Column, q: int = 3) -> Column:
    """all character q-grams in order; a shorter text is its own only one."""
    t = F.trim(text_or_empty(c))
    return F.when(t == "", F.array().cast("array<string>")).when(F.length(t) <= q, F.array(t)).otherwise(_grams(t, q))


def sanitize_arabic(c: Column) -> Column:
    """without format controls, tatweel, ornaments, standalone verse numbers, annotation signs and punctuation."""
    t = F.regexp_replace(F.regexp_replace(text_or_empty(c), FORMAT_CONTROLS, ""), "ـ", "")
    t = F.regexp_replace(F.regexp_replace(t, "[﴾﴿]", " "), VERSE_NUMBER, " ")
    return collapse(F.regexp_replace(F.regexp_replace(t, r"[\x{06D6}-\x{06ED}]", ""), ARABIC_PUNCTUATION, " "))


def arabic_light(c: Column) -> Column:
    """F8: hamza carriers folded to their letter, vowel marks removed."""
    return collapse(F.regexp_replace(F.translate(sanitize_arabic(c), ARABIC_LIGHT_FROM, ARABIC_LIGHT_TO), ARABIC_MARKS, ""))


def arabic_aggressive(c: Column) -> Column:
    """the light form with the final letters folded too."""
    return collapse(F.regexp_replace(F.translate(arabic_light(c), ARABIC_FURTHER_FROM, ARABIC_FURTHER_TO), ARABIC_PUNCTUATION, " "))


# The character references that markup of the corpora uses.
ENTITIES = {"&nbsp;": " ", "&quot;": '"', "&#39;": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&"}


def html_to_text(c: Column) -> Column:
    """text of simple markup; block ends become line breaks, tags go, common entities are resolved, at most one blank line stays."""
    t = F.regexp_replace(text_or_empty(c), r"(?i)<\s*br\s*/?>|</\s*(p|div|li|h[1-6]|tr)\s*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for entity, char in ENTITIES.items():
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def text_hash(c: Column) -> Column:
    """SHA-256 in hex."""
    return F.sha2(text_or_empty(c), 256)


def inline_notes(c: Column, opening: str = "[[", closing: str = "]]") -> Column:
    """the texts between note marks, in order."""
    return F.regexp_extract_all(text_or_empty(c), F.lit(f"{_quoted(opening)}(.*?){_quoted(closing)}"), 1)


def without_inline_notes(c: Column, opening: str = "[[", closing: str = "]]") -> Column:
    """F16: the text without notes and their marks."""
    return collapse(F.regexp_replace(text_or_empty(c), f"{_quoted(opening)}.*?{_quoted(closing)}", ""))


def _quoted(s: str) -> str:
    return "".join("\\" + x if not x.isalnum() else x for x in s)


def phrase_pattern(phrase: str) -> str:
    """pattern of a phrase at word boundaries with any whitespace between its words."""
    return r"(?i)\b" + r"\s+".join(_quoted(w) for w in phrase.split()) + r"\b"


def has_phrase(c: Column, phrase: str) -> Column:
    """Whether the phrase stands in the text at word boundaries."""
    return text_or_empty(c).rlike(phrase_pattern(phrase))


def matched_phrases(c: Column, phrases: list[str], most: int = 6) -> Column:
    """which phrases stand in the text, in the order given, at most ``most``."""
    found = F.array_compact(F.array(*[F.when(has_phrase(c, p), F.lit(p.lower().strip())) for p in phrases]))
    return F.slice(F.array_distinct(found), 1, most)


def compact(c: Column) -> Column:
    """only ASCII letters and digits, lower case."""
    return F.regexp_replace(F.lower(text_or_empty(c)), "[^a-z0-9]+", "")


def match_tokens(c: Column) -> Column:
    """distinct words in order."""
    return F.array_distinct(words(normalize_search(c)))


def clean_attribution(c: Column) -> Column:
    """without embedded attributions such as ``Narrated X:``."""
    return collapse(F.regexp_replace(text_or_empty(c), r"(?i)narrated\s+[^:]{2,80}:", " "))


def sentences(c: Column) -> Column:
    """the sentences of a text; a sentence ends with ``. ! ?`` before whitespace."""
    return F.filter(F.split(collapse(text_or_empty(c)), r"(?<=[.!?])\s+"), lambda s: s != "")


def take_sentences(c: Column, most: int, chars: int) -> Column:
    """the longest prefix of whole sentences within both limits; the first sentence always stays."""
    def grow(acc: Column, s: Column) -> Column:
        longer = F.when(acc["t"] == "", s).otherwise(F.concat(acc["t"], F.lit(" "), s))
        fits = ~acc["stop"] & (acc["n"] < most) & ((acc["n"] == 0) | (F.length(longer) <= chars))
        return F.struct(F.when(fits, longer).otherwise(acc["t"]).alias("t"), (acc["n"] + fits.cast("int")).alias("n"), (~fits).alias("stop"))

    return F.aggregate(sentences(c), F.struct(F.lit("").alias("t"), F.lit(0).alias("n"), F.lit(False).alias("stop")), grow)["t"]


def truncate(c: Column, limit: int, ellipsis: str = "…") -> Column:
    """at most ``limit`` characters, the last one an ellipsis if something was cut."""
    t = F.trim(text_or_empty(c))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit - len(ellipsis))), F.lit(ellipsis)))


def excerpt(c: Column, target: int = 450, most: int = 700) -> Column:
    """cut after the first sentence end between ``target`` and ``most`` characters, else at ``most``."""
    t = collapse(text_or_empty(c))
    cut = F.regexp_extract(t, rf"^(.{{{target},{most}}}?[.!?;،؛])(\s|$)", 1)
    return F.when(F.length(t) <= most, t).when(cut != "", cut).otherwise(F.concat(F.rtrim(F.substring(t, 1, most)), F.lit("…")))


def snippet(c: Column, query: str, most: int = 220, before: int = 60) -> Column:
    """the text around the first place of the query, or of its first word that occurs; ellipses mark what was cut."""
    t = F.trim(text_or_empty(c))
    low = normalize_search(t)
    q = " ".join("".join(x if x.isalnum() or x in ":" else " " for x in query.lower()).split())
    at = F.coalesce(*[F.when(F.locate(w, low) > 0, F.locate(w, low)) for w in dict.fromkeys([q, *[w for w in q.split() if w not in STOPWORDS]]) if w], F.lit(0))
    start = F.greatest(F.lit(0), at - 1 - before)
    end = F.least(F.length(t), start + most)
    part = F.trim(F.substring(t, start + 1, end - start))
    shown = F.concat(F.when(start > 0, "…").otherwise(""), F.when(end < F.length(t), F.concat(F.rtrim(part), F.lit("…"))).otherwise(part))
    return F.when(F.length(t) <= most, t).when(at == 0, F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…"))).otherwise(shown)


def name_skeleton(c: Column) -> Column:
    """consonant skeleton of a romanized name: doubled letters and digraphs folded, vowels dropped after the first letter."""
    t = compact(c)
    for digraph, letter in (("sh", "s"), ("th", "t"), ("dh", "d"), ("kh", "k"), ("gh", "g"), ("ph", "f"), ("q", "k"), ("z", "s"), ("w", "u")):
        t = F.regexp_replace(t, digraph, letter)
    return F.concat(F.substring(t, 1, 1), F.regexp_replace(F.regexp_replace(F.substring(t, F.lit(2), F.length(t)), "[aeiouy]", ""), r"(.)\1+", "$1"))


def allowed_distance(length: Column) -> Column:
    """how many edits a name of this length may differ by."""
    return F.when(length <= 4, 0).when(length <= 7, 1).when(length <= 11, 2).otherwise(3)


# The grammars of a verse reference, tried in order; the groups are chapter, first and last verse.
VERSE_REFERENCE = [
    r"(?i)\bquran[: ]+(\d{1,3}):(\d{1,3})(?:\s*[-–]\s*(\d{1,3}))?",
    r"(?i)\bsurah\s+(\d{1,3})\D{1,12}(?:ayah|verse)s?\s+(\d{1,3})(?:\s*(?:-|–|to)\s*(\d{1,3}))?",
    r"\b(\d{1,3})\s*:\s*(\d{1,3})(?:\s*[-–]\s*(\d{1,3}))?",
]


def verse_reference(c: Column) -> Column:
    """the first reference in the text as ``(surah, ayah_start, ayah_end)``, ends swapped if reversed; NULL if there is none."""
    t, out = text_or_empty(c), None
    for p in VERSE_REFERENCE:
        a, b, e = (F.regexp_extract(t, p, i) for i in (1, 2, 3))
        last = F.when(e == "", b).otherwise(e).cast("int")
        ref = F.when(a != "", F.struct(a.cast("int").alias("surah"), F.least(b.cast("int"), last).alias("ayah_start"), F.greatest(b.cast("int"), last).alias("ayah_end")))
        out = ref if out is None else F.coalesce(out, ref)
    return out


def format_reference(surah: Column, start: Column, end: Column, prefix: str = "quran:") -> Column:
    """``prefix`` and ``S:A`` or ``S:A-B``."""
    return F.concat(F.lit(prefix), surah.cast("string"), F.lit(":"), start.cast("string"), F.when(end > start, F.concat(F.lit("-"), end.cast("string"))).otherwise(""))


def collection_number(c: Column) -> Column:
    """the number at the end of a reference or address; NULL if there is none."""
    n = F.regexp_extract(text_or_empty(c), r"(\d+)\D*$", 1)
    return F.when(n != "", n.cast("int"))


def book_and_number(c: Column) -> Column:
    """the two numbers of ``Book B, Hadith H``; NULL if either is missing."""
    p = r"(?i)book\s+(\d+)\D+hadith\s+(\d+)"
    return F.when(text_or_empty(c).rlike(p), F.struct(F.regexp_extract(c, p, 1).cast("int").alias("book"), F.regexp_extract(c, p, 2).cast("int").alias("number")))


def narrator_and_body(c: Column) -> Column:
    """``(narrator, body)`` of ``Narrated X: ...``; without that form the narrator is NULL."""
    p = r"(?is)^\s*narrated\s+([^:]{2,120}):\s*(.*)$"
    t = text_or_empty(c)
    return F.struct(F.when(t.rlike(p), F.trim(F.regexp_extract(t, p, 1))).alias("narrator"), F.when(t.rlike(p), F.regexp_extract(t, p, 2)).otherwise(F.trim(t)).alias("body"))


def grade_label(c: Column) -> Column:
    """one of four labels by keyword."""
    t = F.lower(text_or_empty(c))
    return F.when(t.contains("sahih"), "sahih").when(t.contains("hasan"), "hasan").when(t.contains("da'if") | t.contains("daif") | t.contains("weak"), "daif").otherwise("unknown")


def client_key(*parts: Column) -> Column:
    """the first 24 hex digits of the SHA-1 of the parts."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 24)


def analysis_tokens(c: Column, stopwords: list[str] | None = None) -> Column:
    """lower-case ASCII words of at least three letters without stopwords."""
    found = F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit("([a-z]{3,})"), 1)
    return F.filter(found, lambda t: ~t.isin(*(stopwords or STOPWORDS)))


def without_lead(c: Column, leads: list[str]) -> Column:
    """without the first matching lead phrase and without fillers around it."""
    p = "|".join(_quoted(x) for x in sorted(leads, key=len, reverse=True))
    return F.trim(F.regexp_replace(normalize_search(c), f"^(?:{p})\\b\\s*", ""))


def longest_alias(c: Column, aliases: dict[str, str], most_words: int = 4) -> Column:
    """what the longest alias of at most ``most_words`` words in the text stands for; NULL if none is there."""
    w = words(normalize_search(c))
    grams = F.flatten(F.transform(F.sequence(F.lit(most_words), F.lit(1), F.lit(-1)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - n + 1)), lambda i: F.array_join(F.slice(w, i, n), " "))))
    hits = F.filter(F.transform(grams, lambda g: lookup(aliases, g)), lambda x: x.isNotNull())
    return F.try_element_at(hits, F.lit(1))


# The grammars of a narration reference after the collection's name, tried in order; groups are book and number.
NARRATION_REFERENCE = [r"book\s+(\d+)\D{1,12}(?:hadith|number|no)\s*(\d+)", r"(\d+)\s*:\s*(\d+)", r"()(?:hadith|number|no)\s*(\d+)", r"()\b(\d+)\b"]


def narration_reference(c: Column, aliases: dict[str, str]) -> Column:
    """``(collection, book, number)`` of a citation; NULL without a known collection and a number."""
    norm = normalize_search(c)
    collection, out = longest_alias(c, aliases), None
    for p in NARRATION_REFERENCE:
        book, number = F.regexp_extract(norm, p, 1), F.regexp_extract(norm, p, 2)
        ref = F.when(number != "", F.struct(collection.alias("collection"), F.when(book != "", book.cast("int")).alias("book"), number.cast("int").alias("number")))
        out = ref if out is None else F.coalesce(out, ref)
    return F.when(collection.isNotNull(), out)


def contextual_summary(titles: list[Column], body: Column, tags: Column, most: int = 420) -> Column:
    """the first sentence of titles and body together, with the tags in front, at most ``most`` characters."""
    whole = collapse(F.concat_ws(" ", *titles, body))
    first = F.coalesce(F.try_element_at(sentences(whole), F.lit(1)), F.lit(""))
    return F.substring(F.when(F.size(tags) > 0, F.concat(F.lit("[topics="), F.array_join(tags, ", "), F.lit("] "), first)).otherwise(first), 1, most)


def significant_tokens(c: Column, generic: list[str]) -> Column:
    """Search tokens with their synonyms, without generic ones, each once."""
    return F.filter(expand_tokens(search_tokens(c)), lambda t: ~t.isin(*generic))


def canonical_reference(c: Column, fillers: list[str]) -> Column:
    """A reference query without fillers, chapter and verse words in one form."""
    t = normalize_search(c)
    for f in sorted(fillers, key=len, reverse=True):
        t = F.regexp_replace(t, r"\b" + _quoted(f) + r"\b", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"\b(?:chapter|sura|surat|surah)\b", "surah"), r"\b(?:ayat|ayah|aya|verses|verse)\b", "verse")
    return collapse(F.regexp_replace(t, r"(\d)\s*:\s*(\d)", "$1:$2"))
