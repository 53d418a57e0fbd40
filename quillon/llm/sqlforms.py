"""SQL of the look-alike comparison, written apart from the operator: a chain of replacements whose tables come from Unicode data, the look-alike letters typed out."""

from __future__ import annotations

import unicodedata as ud

# Letters drawn alike, pair by pair (the letter, then the one it is compared as).
_PAIRS = (
    "аaсcеeһhіiјjоoрpѕsхxуyԁdԛqԝwѵvӏl АAВBСCЕEНHІIЈJКKМMОOРPЅSТTХXУYԚQԜWӀIԌG οoνvϲcϳj ΑAΒBΕEΖZΗHΙIΚKΜMΝNΟOΡPΤTΥYΧXϹCͿJ ɡgɑaօoսuՕO κĸкĸ".replace(" ", "")
)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _forms() -> tuple[dict[str, str], dict[str, str]]:
    """Presentation and width variants by what they are drawn like: single characters, and ligatures of several."""
    one, several = {}, {}
    for cp in (*range(0xFB00, 0xFB07), *range(0xFB50, 0xFE00), *range(0xFE70, 0xFEFD), *range(0xFF01, 0xFFEF)):
        tag, *parts = ud.decomposition(chr(cp)).split() or [""]
        to = "".join(chr(int(x, 16)) for x in parts)
        if tag in ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>", "<compat>") and to and to[0] != " ":
            (one if len(to) == 1 else several)[chr(cp)] = to
    return one, several


def _letters() -> dict[str, str]:
    like = dict(zip(_PAIRS[::2], _PAIRS[1::2]))
    out = dict(like)
    for cp in (*range(0x370, 0x530), *range(0x1F00, 0x2000)):
        d = ud.normalize("NFD", chr(cp))
        if len(d) > 1 and d[0] in like:
            composed = ud.normalize("NFC", like[d[0]] + d[1:])
            if len(composed) == 1:
                out[chr(cp)] = composed
    return out


def look(c: str) -> str:
    """The SQL of what a text looks like."""
    one, several = _forms()
    t = rf"regexp_replace({c}, '[\p{{Cf}}\x{{034F}}\x{{180B}}-\x{{180F}}\x{{FE00}}-\x{{FE0F}}]', '', 'g')"
    t = f"translate({t}, {_quoted(''.join(one))}, {_quoted(''.join(one.values()))})"
    for ligature, letters in several.items():
        if ligature in "ﬀﬁﬂﬃﬄﬅﬆﻵﻶﻷﻸﻹﻺﻻﻼ":
            t = f"replace({t}, '{ligature}', '{letters}')"
    letters = _letters()
    t = f"translate(nfc_normalize({t}), {_quoted(''.join(letters))}, {_quoted(''.join(letters.values()))})"
    after = r"([\x{064B}-\x{065F}\x{0670}]*[\x{0620}\x{0622}-\x{064A}\x{0671}-\x{06D3}])"
    for _ in range(2):  # neighbours overlap
        t = f"regexp_replace(regexp_replace({t}, 'ک{after}', 'ك\\1', 'g'), 'ی{after}', 'ي\\1', 'g')"
    t = f"translate({t}, 'ی۰۱۲۳۷۸۹‐‑µ', 'ى٠١٢٣٧٨٩--μ')"
    return rf"trim(regexp_replace(nfc_normalize({t}), '[\s\p{{Z}}\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}]+', ' ', 'g'))"


def alike_pairs() -> str:
    """The SQL of ``p1_found``."""
    parts = []
    for field in ("text_display", "text_normalized"):
        parts.append(f"SELECT id, {field} AS t, {look(field)} AS l, '{field}' AS field_name FROM quran_ayahs WHERE {field} <> ''")
    return f"""WITH v AS MATERIALIZED ({' UNION ALL '.join(parts)})
SELECT a.id AS ayah_id_a, b.id AS ayah_id_b, a.field_name FROM v a JOIN v b ON a.field_name = b.field_name AND a.l = b.l AND a.id < b.id AND a.t <> b.t WHERE a.l <> ''"""
