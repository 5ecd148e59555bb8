"""Text, number, list and JSON helpers as Column expressions.

All of them are built-in expressions, so they run inside code generation and
never start a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels and marks that result texts must carry literally.
UNIT_LABEL = "Единица (измерения) хранения остатков: "
PRICE_LABEL = "Цена за единицу в рублях:"
CODE_LABEL = "Артикул: "
RUB_LABEL = "Цена в рублях: "
PATH_LABEL = "Путь в каталоге: "
ID_PREFIX = "ID "
TRUNCATION_MARK = " … [truncated]"

# The characters that count as whitespace at the ends of a text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# What float() accepts, without nan, inf and digit separators.
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def fn_concat(*cols: Column) -> Column:
    return F.concat(*cols)


def fn_join_space(*cols: Column) -> Column:
    """Join by one space; a missing part still contributes its space."""
    return F.concat_ws(" ", *[null_to_text(c) for c in cols])


def fn_join_newline(parts: Column) -> Column:
    return F.array_join(parts, "\n")


def fn_number_to_text(c: Column) -> Column:
    """A double as the shortest decimal text: plain from 1e-4 up to 1e16,
    with an exponent outside, ``nan`` for a missing number."""
    d = c.cast("double")
    s = d.cast("string")
    size = F.abs(d)
    plain = F.regexp_replace(s.try_cast("decimal(38,20)").cast("string"), r"(\.\d+?)0+$", "$1")
    digits = F.regexp_replace(F.substring_index(s, "E", 1), r"\.0$", "")
    power = F.substring_index(s, "E", -1).try_cast("int")
    sign = F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+"))
    exponent = F.concat(digits, sign, F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
    return (
        F.when(d.isNull() | F.isnan(d), F.lit("nan"))
        .when(s.endswith("Infinity"), F.replace(s, F.lit("Infinity"), F.lit("inf")))
        .when(~s.contains("E"), s)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(exponent)
    )


def fn_regex_first(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without a match."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def fn_remove_spaces(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def fn_strip(c: Column) -> Column:
    """Without outer whitespace of any kind; a plain ``trim`` would take spaces
    only, and a pattern would walk through the whole text."""
    return F.btrim(c, F.lit(WHITESPACE))


def fn_rstrip_colon(c: Column) -> Column:
    return F.rtrim(c, F.lit(":"))


def fn_prefix_cut(c: Column, n: int) -> Column:
    """Text behind the first n characters."""
    return F.substring(c, F.lit(n + 1), F.length(c))


def fn_head(c: Column, n: int | Column) -> Column:
    """The first n characters."""
    return F.left(c, F.lit(n) if isinstance(n, int) else n)


def fn_length(c: Column, of_list: bool = False) -> Column:
    return F.size(c) if of_list else F.length(c)


def fn_to_int(c: Column) -> Column:
    return c.try_cast("bigint")


def fn_to_int_via_float(c: Column) -> Column:
    """Cut toward zero; words, nan, inf and values beyond 64 bits give null."""
    return F.when(c.rlike(_NUMBER), c.try_cast("double").try_cast("bigint"))


def fn_unique_in_order(items: Column) -> Column:
    return F.array_distinct(items)


def fn_floor_div(a: Column, b: Column) -> Column:
    """Division rounded down, also for a negative dividend (b > 0)."""
    return F.call_function("div", a - F.pmod(a, b), b)


def slice_bound(x: Column, n: Column) -> Column:
    """One list-slice bound over n items: a negative one counts from the end."""
    return F.when(x < 0, F.greatest(F.lit(0), x + n)).otherwise(F.least(x, n))


def fn_slice(pos: Column, n: Column, start: Column, end: Column) -> Column:
    """True where the 0-based position lies in the list slice ``[start:end]``."""
    return (pos >= slice_bound(start, n)) & (pos < slice_bound(end, n))


def without_dots(path: Column) -> Column:
    """An absolute path with its ``.`` and ``..`` segments carried out."""
    parts = F.slice(F.split(path, "/"), 2, F.size(F.split(path, "/")))
    empty = F.slice(parts, 1, 0)
    kept = F.aggregate(
        parts,
        empty,
        lambda done, part: F.when(part == ".", done)
        .when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(part))),
    )
    folder = F.when(path.rlike(r"/\.{1,2}$") & (F.size(kept) > 0), "/").otherwise("")
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"), folder)).otherwise(path)


def fn_abs_url(base: Column, href: Column) -> Column:
    """Absolute form of a link found at ``base``, dot segments carried out and
    outer white space dropped."""
    href = F.regexp_replace(href, r"^\s+|\s+$", "")
    scheme = F.regexp_extract(base, r"^([^:/?#]+):", 1)
    authority = F.regexp_extract(base, r"^[^:/?#]+://([^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    origin = F.concat(scheme, F.lit("://"), authority)
    own = F.regexp_extract(href, r"^[^?#]*", 0)
    rest = F.regexp_replace(href, r"^[^?#]*", "")
    folder = F.regexp_replace(path, r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(href == "", base)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, without_dots(own), rest))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), href))
        .when(href.startswith("?"), F.concat(origin, path, href))
        .otherwise(F.concat(origin, without_dots(F.concat(folder, own)), rest))
    )


def fn_to_json(struct: Column) -> Column:
    return F.to_json(struct)


def fn_args_from_json(args: Column, schema: str) -> Column:
    """Tool arguments; unreadable text gives null fields, mixed list items read as text."""
    return F.from_json(args, schema)


def fn_json_map(m: Column) -> Column:
    return F.to_json(m)


def null_to_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def clamp_text(c: Column, n: int | Column) -> Column:
    """Text of at most n characters; a longer one is cut and marked."""
    limit = F.lit(n) if isinstance(n, int) else n
    return (
        F.when(c.isNull(), F.lit(""))
        .when(F.length(c) <= limit, c)
        .otherwise(F.concat(fn_head(c, limit), F.lit(TRUNCATION_MARK)))
    )


def product_code_trim(c: Column, n: int = 12, keep_short: bool = True) -> Column:
    """Code without its n leading label characters; shorter codes stay whole
    unless ``keep_short`` is off, then they become empty."""
    cut = fn_prefix_cut(c, n)
    return F.when(F.length(c) >= n, cut).otherwise(c) if keep_short else cut


def url_site_path(c: Column) -> Column:
    return F.try_parse_url(c, F.lit("PATH"))


def request_id_cap(ids: Column, n: int = 2) -> Column:
    """The first n ids of a request."""
    return F.slice(ids, 1, n)


def sanitize_ids(ids: Column) -> Column:
    """Whole-number ids from mixed texts, each once, in the given order."""
    return fn_unique_in_order(F.filter(F.transform(ids, fn_to_int_via_float), lambda x: x.isNotNull()))


def search_pad(limit: Column, rule: str = "plus3") -> Column:
    """How many hits to fetch before a price band is cut: limit + 3, or by the
    older rule 5 more per full hundred."""
    if rule == "plus3":
        return limit + 3
    if rule == "per_hundred":
        return limit + fn_floor_div(limit, F.lit(100)) * 5
    raise ValueError(f"unknown padding rule {rule!r}")
