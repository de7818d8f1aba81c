"""Text expressions; all run in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folds() -> tuple[str, str, dict[str, str]]:
    """Letters whose compatibility decomposition has ASCII in it: one for one, and one for several."""
    one, to, many = [], [], {}
    for point in range(0x80, 0x2FFFF):
        if 0xD800 <= point < 0xE000:
            continue
        c = chr(point)
        plain = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            one.append(c)
            to.append(plain)
        elif plain:
            many[c] = plain
    return "".join(one), "".join(to), many


_ONE, _TO, _MANY = _folds()


def normalize(text: Column) -> Column:
    """Compatibility decomposition, ASCII only, lower case, runs of other than a-z0-9 as one blank, trimmed; null is ''.

    Letters that decompose to several ASCII letters (ligatures and the like) are rare; they
    are replaced only where a text has any.
    """
    t = F.coalesce(text.cast("string"), F.lit(""))
    t = F.translate(t, _ONE, _TO)
    several = F.array_join(F.transform(F.split(t, "(?<=.)|(?=.)"), lambda c: F.coalesce(F.element_at(_many(), c), c)), "")
    # A character class of hundreds is slow to match; a translation that removes the letters is a table lookup.
    t = F.when(F.translate(t, "".join(_MANY), "") != t, several).otherwise(t)
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(t, r"[^\x00-\x7F]", "")), "[^a-z0-9]+", " "))


def _many() -> Column:
    return F.create_map(*(F.lit(x) for pair in _MANY.items() for x in pair))


def any_contains(items: Column, *needles: str) -> Column:
    """Whether an item, lower-cased, contains one of the needles."""
    return F.exists(items, lambda c: _or(F.lower(c).contains(n) for n in needles))


def _or(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def whole_word(text: Column, word: str) -> Column:
    """Whether a normalised text holds a word or phrase between word boundaries."""
    return text.rlike(rf"\b{word}\b")


def words_longer(text: Column, least: int, without: Sequence[str] = ()) -> Column:
    """White-space separated words of over ``least`` characters, less some."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: (F.length(w) > least) & (~w.isin(list(without)) if without else F.lit(True)))


def hits(words: Column, text: Column) -> Column:
    """How many of the words a text contains."""
    return F.size(F.filter(words, lambda w: F.contains(text, w)))


def comma_parts(text: Column) -> Column:
    """Trimmed parts between commas, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")


def clean_clues(items: Column) -> Column:
    """Trimmed texts of over three characters; repeats stay."""
    return F.filter(F.transform(items, lambda c: F.trim(c)), lambda c: F.length(c) > 3)


def game_token(url: Column) -> Column:
    """The id in an address of a match, else the trimmed input."""
    found = [F.nullif(F.regexp_extract(url, rf"{kind}/([a-zA-Z0-9\-]+)", 1), F.lit("")) for kind in ("duels", "game", "results")]
    return F.coalesce(*found, F.trim(url))


def url_quoted(text: Column) -> Column:
    """Percent-encoded UTF-8; letters, digits and _ . - ~ / stay."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def url_value(url: Column, name: str) -> Column:
    """The first value of a parameter of an address's query, decoded; null without one or for what isn't an address."""
    return F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(name)))


def unhexed(text: Column) -> Column:
    """UTF-8 text written in hexadecimal, or the text as it stands if it isn't that."""
    raw = F.unhex(text)
    return F.coalesce(F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")), text)


def image_type(path: Column) -> Column:
    """MIME type by suffix; JPEG unless it is another known one."""
    low = F.lower(path)
    return F.when(low.endswith(".png"), "image/png").when(low.endswith(".webp"), "image/webp").otherwise("image/jpeg")


def absolute(url: Column, base: str) -> Column:
    return F.when(url.startswith("/"), F.concat(F.lit(base), url)).otherwise(url)


def plain_label(text: Column) -> Column:
    """A label without its translation prefix and outer quotes."""
    return F.btrim(F.replace(text, F.lit("i18n:"), F.lit("")), F.lit('"'))


def utc_stamp(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
