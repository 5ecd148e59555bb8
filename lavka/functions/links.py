"""Flat links of stored pages by built-in expressions, no Python worker.

A link begins at its start tag and ends at the next one, at its end tag or with
the page, as a parser reads it; attribute values may stand without quotes, and
all references of text and addresses are resolved.
"""

from __future__ import annotations

from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

HIDDEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
LINK_START = r"(?i)(?=<a[\s/>])"
LINK_END = r"(?i)</a[\s/>]"
#: A start tag; quoted values may hold an angle bracket.
TAG = r"""^<[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*>?"""
REFERENCE = r"(&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);)"


def character(point: Column) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")


def named_once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def resolved(c: Column) -> Column:
    """Named and numeric references resolved, each once; unknown ones stay."""
    pairs = {n: chr(p) for n, p in name2codepoint.items()} | {"apos": "'"}
    named = F.str_to_map(F.lit("\1".join(f"{n}\2{c}" for n, c in pairs.items())), F.lit("\1"), F.lit("\2"))  # folded while planning

    def value(reference: Column) -> Column:
        name = F.substring(reference, 2, F.length(reference) - 2)
        hexadecimal = F.conv(F.regexp_extract(name, "^#[xX](.*)", 1), 16, 10).try_cast("bigint")
        decimal = F.regexp_extract(name, "^#([0-9]+)", 1).try_cast("bigint")
        point = F.coalesce(F.when(F.rlike(name, F.lit("^#[xX]")), hexadecimal), decimal)
        allowed = point.between(1, 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
        return F.coalesce(F.when(allowed, character(point)), F.try_element_at(named, name), reference)

    parts = F.split(c, r"(?=&)")
    whole = F.transform(
        parts,
        lambda p: F.when(F.rlike(p, F.lit("^" + REFERENCE)), F.concat(
            value(F.regexp_extract(p, "^" + REFERENCE, 1)), F.regexp_replace(p, "^" + REFERENCE, "")
        )).otherwise(p),
    )
    return F.when(F.contains(c, F.lit("&")), F.array_join(whole, "")).otherwise(c)


def plain_text(c: Column) -> Column:
    """Markup dropped and references resolved."""
    return named_once(F.regexp_replace(F.regexp_replace(c, TAG, ""), r"<[^>]*>", ""), resolved)


def unquoted(value: Column) -> Column:
    return F.when(F.rlike(value, F.lit("^[\"']")), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def attribute(fragment: Column, name: str) -> Column:
    """Value of an attribute of the fragment's first tag, '' if absent."""
    tag = F.regexp_extract(fragment, TAG, 0)
    pattern = rf"""(?is)^<[^\s>/]+(?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|=\s*[^\s"'>]+)*?\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    value = named_once(F.regexp_extract(tag, pattern, 1), unquoted)
    return named_once(value, resolved)


def fragments(html: Column, link_class: str | None = None, within: str | None = None) -> Column:
    """array<string> of the page's links, each from its start tag on, in document order, only
    those of a class, or only those within the first element of a tag."""
    clean = F.regexp_replace(html, HIDDEN, "")
    if within:
        clean = F.regexp_extract(clean, rf"(?is)<{within}\b[^>]*>(.*?)</{within}>", 1)
    found = F.filter(F.split(clean, LINK_START), lambda part: F.rlike(part, F.lit(r"(?i)^<a[\s/>]")))
    found = F.transform(found, lambda part: F.get(F.split(part, LINK_END, 2), F.lit(0)))
    if link_class:
        # A link without the class's name in its own text has it only by references.
        found = F.filter(found, lambda a: F.contains(a, F.lit(link_class)) | F.contains(a, F.lit("&")))
        found = F.filter(found, lambda a: F.array_contains(F.split(attribute(a, "class"), r"\s+"), link_class))
    return found


def addresses(html: Column, link_class: str | None = None, within: str | None = None) -> Column:
    """array<string> of the links' addresses, without their texts."""
    return F.transform(fragments(html, link_class, within), lambda a: attribute(a, "href"))


def anchors(html: Column, link_class: str | None = None, within: str | None = None) -> Column:
    """array<struct<href, text>> of the links."""
    found = fragments(html, link_class, within)
    return F.transform(found, lambda a: F.struct(attribute(a, "href").alias("href"), plain_text(a).alias("text")))
