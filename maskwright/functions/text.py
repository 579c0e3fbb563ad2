"""Scalar expressions over text columns; all of them stay in the JVM.

Patterns begin with ``(?U)`` where word characters, digits or boundaries of any
script count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits below which a number without letters is short.
SHORT_DIGITS = 7


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    """Whether the digits of the text pass Luhn's check; separators don't count."""
    return F.call_function("luhn_check", digits(text))


def digit_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\d"))


def is_plain_amount(text: Column) -> Column:
    """A sum of money, a percentage, or a bare number of under seven digits."""
    t = strip(text)
    # fixed values: the two patterns of an amount
    whole = t.rlike(r"(?U)^[$€£¥]?\s?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d{1,2})?\s?%?\z")
    marked = t.rlike(r"(?U)[$€£¥%]|\.\d{1,2}\z")
    return whole & (marked | (digit_count(t) < SHORT_DIGITS))


def is_short_number(text: Column) -> Column:
    """No letter, under seven digits, a digit first or last."""
    return (F.length(text) > 0) & ~text.rlike(r"\p{L}") & (digit_count(text) < SHORT_DIGITS) & text.rlike(r"(?U)^\d|\d\z")


def is_version(text: Column) -> Column:
    """Four single digits read as a version, not as an address."""
    return text.rlike(r"^\d(\.\d){3}\z")


def is_valid_id(text: Column) -> Column:
    """Twelve upper-case hex digits with a digit and a letter, not a number in scientific notation."""
    return text.rlike(r"^[0-9A-F]{12}\z") & text.rlike("[0-9]") & text.rlike("[A-F]") & ~text.rlike(r"^\d+E\d+\z")


def html_to_text(html: Column) -> Column:
    """Text of an HTML page: entities stay as they are."""
    # fixed values: these patterns, in this order
    x = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", " ")
    x = F.regexp_replace(x, r"(?is)<style[^>]*>.*?</style>", " ")
    x = F.regexp_replace(x, r"(?i)<br\s*/?>", "\n")
    x = F.regexp_replace(x, r"(?i)</p>", "\n\n")
    x = F.regexp_replace(x, r"<[^>]+>", " ")
    x = F.regexp_replace(x, r"[ \t\r\f\x0B]+", " ")
    return strip(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def rtf_to_text(rtf: Column) -> Column:
    # fixed value
    return F.regexp_replace(rtf, r"\\[a-zA-Z]+-?\d* ?|\\'[0-9a-fA-F]{2}|[{}]", "")


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 where valid, else as Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def token_count(text: Column) -> Column:
    """About four characters a token, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def chunks(text: Column, tokens: int, overlap: int) -> Column:
    """Overlapping windows of the text; the last covers its end."""
    size, step = tokens * 4, max(1, (tokens - overlap) * 4)
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(size)))


def without_placeholders(text: Column) -> Column:
    """Every placeholder, of 12 digits or the 4 of old keys, as a line break, so nothing joins across it."""
    return F.regexp_replace(text, r"\[[A-Z]+_(?:[0-9A-F]{12}|[0-9A-F]{4})\]|\b[A-Z]+_[0-9A-F]{12}\b", "\n")


def placeholder(tag: Column, hex_id: Column) -> Column:
    return F.concat(F.lit("["), tag, F.lit("_"), hex_id, F.lit("]"))


def tag_of(text: Column) -> Column:
    return F.regexp_extract(text, r"^\[?([A-Z]+)_[0-9A-F]+\]?\z", 1)


# The named references of XML.
XML_NAMES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))


def xml_escape(text: Column) -> Column:
    for raw, escaped in XML_NAMES:
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def xml_unescape(text: Column, not_ascii_only: bool = False) -> Column:
    """The five named references and numeric ones as characters, in one pass; others stay as they are.

    With ``not_ascii_only`` the numeric ones of characters beyond ASCII alone: in raw
    markup the others can carry meaning.
    """

    def read(part: Column) -> Column:
        decimal, hexes = F.regexp_extract(part, r"^&#0*([0-9]{1,7});$", 1), F.regexp_extract(part, r"^&#[xX]0*([0-9A-Fa-f]{1,6});$", 1)
        code = F.when(decimal != "", decimal.cast("int")).when(hexes != "", F.conv(hexes, 16, 10).cast("int"))
        is_char = code.between(0x80 if not_ascii_only else 1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        out = F.when(is_char, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        for raw, escaped in () if not_ascii_only else XML_NAMES:
            out = out.when(part == escaped, F.lit(raw))
        return out.otherwise(part)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"&#?\w+;|[^&]+|&"), F.lit(0)), read), "")


def utc_stamp(time: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def safe_name(name: Column) -> Column:
    """A file name without path parts or odd characters."""
    last = F.regexp_replace(name, r"^.*[/\\]", "")
    return F.regexp_replace(last, r"[^A-Za-z0-9._-]", "_")


def copy_note(text: Column) -> Column:
    """The text with a sentence that asks an assistant to leave placeholders alone."""
    return F.concat(F.lit("Tokens in square brackets stand for private values; keep each exactly as written.\n\n"), text)


def canonical_hash(*columns: Column) -> Column:
    """A key that equal requests share, whatever their field order was."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)
