"""Text functions as Spark columns; each takes and returns a Column and passes null on unless it says otherwise."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Sequence
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F


def stages(c: Column, *steps: Callable[[Column], Column]) -> Column:
    """The last step of the one before, from ``c`` on. Each step's value is bound before the next one uses it, however
    often that is, so expressions don't multiply."""
    rows = F.array(c)
    for step in steps:
        rows = F.transform(rows, step)
    return rows[0]


def _accent_table() -> tuple[str, str]:
    """Latin letters with diacritics and their base letters, one for one."""
    pairs = []
    for block in (range(0xC0, 0x250), range(0x1E00, 0x1F00)):
        for code in block:
            parts = unicodedata.normalize("NFD", chr(code))
            if len(parts) > 1 and all(unicodedata.combining(c) for c in parts[1:]):
                pairs.append((chr(code), parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTS = _FROM, _TO = _accent_table()


def strip_accents(c: Column) -> Column:
    """Latin letters without their diacritics; combining marks go. Stays within generated code."""
    return F.translate(F.regexp_replace(c, "\\p{Mn}+", ""), _FROM, _TO)


def fold(c: Column) -> Column:
    """Upper case without accents, trimmed; null gives the empty string, so that it is equal to nothing known."""
    return F.coalesce(F.trim(F.upper(strip_accents(c))), F.lit(""))


def normalize_spaces(c: Column) -> Column:
    """Every run of white space, no-break spaces included, as one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, "(?U)\\s+", " "))


def _table(entries: dict[str, str]) -> Column:
    """A map of constants, from one literal that the optimizer folds."""
    return F.from_json(F.lit(json.dumps(entries)), "map<string,string>")


@cache
def _compatible() -> tuple[str, str, dict[str, str]]:
    """Signs beyond ASCII whose compatibility decomposition has ASCII in it: those with one such sign, one for one, and
    those with several, by their replacement."""
    one, many = {}, {}
    for i in range(0x80, 0x1FBFA):
        if 0xAC00 <= i < 0xE000 or 0x3400 <= i < 0xA000:  # Hangul, ideographs and surrogates have none
            continue
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(i)) if c.isascii())
        if len(plain) == 1:
            one[chr(i)] = plain
        elif plain:
            many[chr(i)] = plain
    return "".join(one), "".join(one.values()), many


def normalize_name_exact(c: Column) -> Column:
    """Compatibility decomposition, ASCII only, upper case, single blanks; null gives the empty string. Covers what
    ``normalize_name`` drops: ligatures, ordinals, full-width and styled letters. Signs that decompose into several
    are looked up in texts that have any of them only."""
    source, target, many = _compatible()

    def expanded(x: Column) -> Column:
        table = _table(many)
        one = F.transform(F.split(x, ""), lambda s: F.coalesce(F.try_element_at(table, s), s))
        return F.when(x.rlike(f"[{''.join(many)}]"), F.array_join(one, "")).otherwise(x)

    return F.coalesce(stages(c, expanded, lambda x: F.regexp_replace(F.translate(x, source, target), "[^\\x00-\\x7F]+", ""), lambda x: F.upper(normalize_spaces(x))), F.lit(""))


def normalize_name(c: Column) -> Column:
    """Upper-case ASCII with single blanks; null gives the empty string. What has no Latin base letter is dropped."""
    ascii_only = F.regexp_replace(strip_accents(c), "[^\\x00-\\x7F\\s\\u00A0]", "")
    return F.coalesce(F.upper(normalize_spaces(ascii_only)), F.lit(""))


PARTICLES = ("DA", "DAS", "DE", "DO", "DOS", "E")


def surname_key(c: Column) -> Column:
    """Last word of the normalised name that is no particle, else its last word, else the empty string."""
    words = F.filter(F.split(normalize_name(c), " "), lambda w: w != "")
    real = F.filter(words, lambda w: ~w.isin(*PARTICLES))
    return F.coalesce(F.try_element_at(real, F.lit(-1)), F.try_element_at(words, F.lit(-1)), F.lit(""))


def split_list(c: Column) -> Column:
    """Comma-separated items, trimmed, without empty ones; null gives no items."""
    return F.coalesce(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def numero_origem(c: Column) -> Column:
    """As ``split_list``, but null where there is no item."""
    items = split_list(c)
    return F.when(F.size(items) > 0, items)


# dates

_DAY = "(\\d{2})/(\\d{2})/(\\d{4})"


def _int(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit("")).cast("int")


def _in_range(d: Column, m: Column, y: Column) -> Column:
    return m.between(1, 12) & d.between(1, 31) & y.between(1900, 2100)


def to_iso(c: Column) -> Column:
    """The first DD/MM/YYYY anywhere as YYYY-MM-DD; ranges are checked, not the calendar; else null."""
    day = F.regexp_extract(c, f"\\b{_DAY}\\b", 0)
    return F.when(day.rlike("^(0[1-9]|[12][0-9]|3[01])/(0[1-9]|1[0-2])/(19[0-9]{2}|20[0-9]{2}|2100)$"), F.concat_ws("-", F.substring(day, 7, 4), F.substring(day, 4, 2), F.substring(day, 1, 2)))


def to_iso_datetime(c: Column) -> Column:
    """The first DD/MM/YYYY followed by HH:MM[:SS] (after a blank, a T or ``às``) as ISO date and time; without a time
    the date by ``to_iso``; null if a part is out of range."""
    p = f"\\b{_DAY}(?:[ T]|,?\\s+às\\s+)(\\d{{2}}):(\\d{{2}})(?::(\\d{{2}}))?"
    d, m, y, hour, minute = (_int(c, p, i) for i in range(1, 6))
    second = F.coalesce(_int(c, p, 6), F.lit(0))
    good = _in_range(d, m, y) & hour.between(0, 23) & minute.between(0, 59) & second.between(0, 59)
    made = F.format_string("%04d-%02d-%02dT%02d:%02d:%02d", y, m, d, hour, minute, second)
    return F.when(c.rlike(p), F.when(good, made)).otherwise(to_iso(c))


def looks_iso(c: Column) -> Column:
    return c.rlike("(?s)^[0-9]{4}-..-")


def date_to_iso(c: Column) -> Column:
    """ISO-shaped text as it is, a whole DD/MM/YYYY turned round, anything else null."""
    p = f"^{_DAY}$"
    return F.when(looks_iso(c), c).when(c.rlike(p), F.regexp_replace(c, p, "$3-$2-$1"))


def datetime_to_iso(c: Column) -> Column:
    """ISO date and time as it is, a whole DD/MM/YYYY HH:MM:SS turned round, else as ``date_to_iso``."""
    p = f"^{_DAY} (\\d{{2}}:\\d{{2}}:\\d{{2}})$"
    return F.when(looks_iso(c) & c.contains("T"), c).when(c.rlike(p), F.regexp_replace(c, p, "$3-$2-$1T$4")).otherwise(date_to_iso(c))


def flexible_date(iso: Column, raw: Column) -> Column:
    """The ISO sibling, else the raw field if it has that shape, else the day found in it."""
    return F.coalesce(F.nullif(iso, F.lit("")), F.when(raw.rlike("(?s)^.{4}-.{5}$"), raw), to_iso(raw))


# portal texts


def clean_nome(c: Column) -> Column:
    """Single blanks, without a trailing ``, GUIA N...``."""
    return F.trim(F.regexp_replace(normalize_spaces(c), "(?iu),\\s*GUIA\\s*N[ºO0]?[^,]*$", ""))


def strip_actor(c: Column, prefix: str) -> Column:
    """Without a leading ``prefix`` and a trailing `` em DD/MM/YYYY``."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, f"^{prefix} ", ""), " em \\d{2}/\\d{2}/\\d{4}$", ""))


def join_lines(c: Column) -> Column:
    """Lines trimmed, empty ones dropped, joined by blanks."""
    return F.array_join(F.filter(F.transform(F.split(c, "\\R"), lambda x: normalize_spaces(x)), lambda x: x != ""), " ")


_SPLIT_CODES = {"N º": "Nº", "N °": "Nº", "H C": "HC", "A R E": "ARE", "R E": "RE", "A D I": "ADI", "A D P F": "ADPF", "R H C": "RHC"}
_CAPS = "A-ZÀÁÂÃÇÉÊÍÓÔÕÚ"


def clean_pdf_text(c: Column) -> Column:
    """Repairs of extracted text: in lines that are capitals for the most part a letter split from its word is put back
    (but for the words A, E, O, À); split case codes are joined everywhere; runs of blanks become one; more than two
    line ends become two. Applying it twice changes nothing more."""

    def line(x: Column) -> Column:
        letters = F.length(F.regexp_replace(x, "[^\\p{L}]", ""))
        capitals = F.length(F.regexp_replace(x, "[^\\p{Lu}]", ""))
        joined = F.regexp_replace(x, f"(?U)\\b(?![AEOÀ] )([{_CAPS}]) ([{_CAPS}]{{2,}})\\b", "$1$2")
        x = F.when((letters >= 5) & (capitals / letters > 0.8), joined).otherwise(x)
        for split, whole in _SPLIT_CODES.items():
            x = F.regexp_replace(x, f"(?U)\\b{split}{'' if split[-1] in 'º°' else chr(92) + 'b'}", whole)
        return F.regexp_replace(x, "  +", " ")

    return F.regexp_replace(F.array_join(F.transform(F.split(c, "\n"), line), "\n"), "\n{3,}", "\n\n")


def _entity(e: Column) -> Column:
    """The sign of an entity &...; by name or number; an unknown one as it is."""
    names = _table({k: sign for k, sign in html5.items() if k.endswith(";")})
    code = F.when(e.rlike("^&#[xX]"), F.conv(F.regexp_extract(e, "^&#[xX]([0-9a-fA-F]{1,6});", 1), 16, 10)).when(e.rlike("^&#"), F.regexp_extract(e, "^&#([0-9]{1,7});", 1)).try_cast("int")
    # a code point as UTF-32
    sign = F.when(code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    return F.coalesce(F.when(e.startswith("&#"), sign).otherwise(F.try_element_at(names, F.substring(e, 2, 40))), e)


def strip_html(c: Column) -> Column:
    """Text of an HTML fragment: tags become blanks, entities that end in a semicolon characters, white space single
    blanks. Texts without entities are spared the look-up."""
    entity = "&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"

    def unescaped(x: Column) -> Column:
        pieces = F.split(F.regexp_replace(x, f"({entity})", "\u0000$1\u0000"), "\u0000")
        return F.when(x.rlike(entity), F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(f"^{entity}$"), _entity(p)).otherwise(p)), "")).otherwise(x)

    return stages(c, lambda x: F.regexp_replace(x, "<[^>]*>", " "), unescaped, normalize_spaces)


# keys and similarity


def url_sha1(c: Column) -> Column:
    """Hexadecimal SHA-1 of a URL; null for null and empty ones."""
    return F.when(c != "", F.sha1(c))


def url_host(c: Column) -> Column:
    return F.parse_url(c, F.lit("HOST"))


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; 1 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def character_error_rate(hypothesis: Column, reference: Column) -> Column:
    """Edit distance over the reference's length; null without a reference."""
    return F.when(F.length(reference) > 0, F.levenshtein(hypothesis, reference) / F.length(reference))


def compact_id(classe: Column, pid: Column) -> Column:
    return F.format_string("%s-%d", classe, pid)


def duration(seconds: Column) -> Column:
    """12s, 3m04s, 2h05m."""
    s = F.floor(seconds).cast("int")
    h, m = (s / 3600).cast("int"), ((s % 3600) / 60).cast("int")
    return F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm%02ds", m, s % 60)).otherwise(F.format_string("%dh%02dm", h, m))


def redact_credentials(c: Column) -> Column:
    """User and password of a URL as ***."""
    return F.regexp_replace(c, "://[^/@\\s]+@", "://***@")


def contains_any(c: Column, needles: Sequence[str]) -> Column:
    """Whether the text, case aside, has any of the needles; null has none."""
    low = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit(False)
    for n in needles:
        out = out | low.contains(n.lower())
    return out


def matches_fold(c: Column, needle: str) -> Column:
    """Whether the folded text has the folded needle in it."""
    plain = "".join(filter(lambda c: unicodedata.category(c) != "Mn", unicodedata.normalize("NFD", needle)))
    return fold(c).contains(plain.upper().strip())
