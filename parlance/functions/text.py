"""Column expressions over text.  All of them run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The name-cleaning patterns (leading quotes; trailing quotes with spaces between).
LEADING_QUOTES = r'^"*'
TRAILING_QUOTES = r'"* *"*$'

WORD = r"[\p{L}\p{N}]+"

# The five predefined XML entities and the non-breaking space.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")]
_ENTITY = "&#[0-9]{1,7};|&#[xX][0-9a-fA-F]{1,6};|" + "|".join(name for name, _ in ENTITIES)

# The rest of a tag: a quote counts after "=" only, and what it encloses may hold ">".  Possessive, so it never backtracks.
_ATTRIBUTES = r"""(?:[^=>]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>"""
_MARKUP = (
    r"(?is)<!--.*?(?:-->|\z)"
    rf"|<(script|style)(?=[\s/>]){_ATTRIBUTES}.*?(?:</\1(?=[\s/>])[^>]*>|\z)"
    rf"|<head(?=[\s/>]){_ATTRIBUTES}.*?</head\s*>"
    rf"|<[a-z/!?]{_ATTRIBUTES}"
)


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def clean_name(name: Column) -> Column:
    """Quotes off both ends, then trailing spaces; leading spaces stay."""
    without = F.regexp_replace(F.regexp_replace(name, LEADING_QUOTES, ""), TRAILING_QUOTES, "")
    return F.rtrim(without)


def html_title(html: Column) -> Column:
    return F.trim(unescape(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def html_text(html: Column) -> Column:
    """Visible text of a page: no scripts, styles, head, comments or tags; spaces collapsed.

    One pass from left to right, so that what stands inside a comment, a script or a quoted attribute begins nothing.  Comments,
    scripts and styles that do not end reach to the end of the page; ``<`` before anything but a name is text.
    """
    body = unescape(F.regexp_replace(html, _MARKUP, " "))
    return F.trim(F.regexp_replace(body, r"[ \t\r\n]+", " "))


def _character(entity: Column) -> Column:
    """The character of an entity; numbers that are none give the replacement character."""
    digits = F.regexp_extract(entity, "[0-9a-fA-F]+", 0)
    code = F.when(F.lower(entity).startswith("&#x"), F.conv(digits, 16, 10)).otherwise(digits).cast("int")
    valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
    numeric = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")
    named = reduce(lambda c, pair: c.when(entity == pair[0], pair[1]), ENTITIES[1:], F.when(entity == ENTITIES[0][0], ENTITIES[0][1]))
    return F.when(F.substring(entity, 2, 1) == "#", numeric).otherwise(named)


def unescape(text: Column) -> Column:
    """Named and numeric entities as characters, each once: ``&amp;lt;`` becomes ``&lt;``."""
    between, found = F.split(text, _ENTITY), F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(0))
    whole = F.array_join(F.zip_with(between, F.transform(found, _character), lambda t, c: F.concat(t, F.coalesce(c, F.lit("")))), "")
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]+)", 1)


def count_in(tokens: Column, members: list[str]) -> Column:
    """How many of the tokens belong to a word list."""
    return F.size(F.filter(tokens, lambda t: t.isin(*members)))


def has_any(tokens: Column, members: list[str]) -> Column:
    return F.arrays_overlap(tokens, F.array(*[F.lit(m) for m in members]))


def contains_any(text: Column, markers: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in markers])


def sentiment_label(text: Column, positive: list[str], negative: list[str]) -> Column:
    """``positive``, ``negative``, ``mixed`` or ``neutral`` by word lists; NULL text gives NULL.

    A stand-in for a hosted classifier: its labels are those of the lists given, no more.
    """
    def label(tokens: Column) -> Column:
        up, down = count_in(tokens, positive), count_in(tokens, negative)
        return F.when((up > 0) & (up == down), "mixed").when(up > down, "positive").when(down > up, "negative").otherwise("neutral")

    # The one-element array binds the token list to a name, so the text is split once.
    return F.when(text.isNotNull(), F.element_at(F.transform(F.array(words(text)), label), 1))


def fill_template(templates: list[str], number: Column, **fields: Column) -> Column:
    """Template ``number`` modulo the list length, with ``{field}`` replaced by the field's value."""
    picked = F.element_at(F.array(*[F.lit(t) for t in templates]), (number % len(templates) + 1).cast("int"))
    return reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), kv[1]), fields.items(), picked)
