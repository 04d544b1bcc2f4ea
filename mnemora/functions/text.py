"""Text expressions: normalisation, tokens, categories, rendering."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S

#: Characters with a meaning in keyword queries.
QUERY_SYNTAX = '+-!(){}[]^"~*?:\\/'
#: Words that mark a decision, then those that mark a preference.
DECISION_MARKERS = ("we decided", "we chose", "we're going with", "we went with")
PREFERENCE_MARKERS = ("i prefer", "i always", "i never", "always use", "never use", "always write", "never write", "don't use", "do not use", "make sure to", "from now on")


def ascii_lower(x: Column) -> Column:
    return F.translate(x, string.ascii_uppercase, string.ascii_lowercase)


def tidy(x: Column) -> Column:
    """Trimmed of white space."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def tokens(x: Column) -> Column:
    """Lower-case runs of letters and digits under 40 bytes."""
    return F.filter(F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda t: F.octet_length(t) < 40)


def escape_query(x: Column) -> Column:
    """Query syntax becomes spaces; white space collapses."""
    return tidy(F.regexp_replace(F.translate(x, QUERY_SYNTAX, " " * len(QUERY_SYNTAX)), r"\s+", " "))


def normalise_tags(tags: Column) -> Column:
    """Trimmed, ASCII-lowered, without blanks and repeats, first occurrence kept."""
    lowered = F.transform(F.filter(tags, lambda t: t.isNotNull()), lambda t: ascii_lower(tidy(t)))
    return F.array_distinct(F.filter(lowered, lambda t: t != ""))


def normalise_subcategory(x: Column) -> Column:
    return F.nullif(ascii_lower(tidy(x)), F.lit(""))


def unit_interval(x: Column, if_nan: float) -> Column:
    """Clamped to 0..1; NaN becomes ``if_nan``."""
    return F.when(F.isnan(x), F.lit(if_nan)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def reject_reason(content: Column, tags: Column | None = None) -> Column:
    """Why a row cannot be stored; null if it can."""
    n = F.char_length(tidy(F.coalesce(content, F.lit(""))))
    out = F.when(n == 0, "content is empty").when(n > S.MAX_CONTENT, "content is too long")
    if tags is not None:
        out = out.when(F.size(tags) > S.MAX_TAGS, "too many tags").when(F.exists(tags, lambda t: F.char_length(t) > S.MAX_TAG), "tag is too long")
    return out


def infer_category(content: Column) -> Column:
    """A category from wording alone: decision markers, then preference markers, else the default."""
    low = ascii_lower(content)
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: low.contains(w))
    return F.when(has(DECISION_MARKERS), "decision").when(has(PREFERENCE_MARKERS), "preference.coding").otherwise(S.DEFAULT_CATEGORY)


def resolve_category(raw: Column, extras: tuple[str, ...] = ()) -> Column:
    """struct(category, exact): the named category, else the first built-in of its dotted family, else the default."""
    name = ascii_lower(tidy(F.coalesce(raw, F.lit(""))))
    exact = name.isin(*S.CATEGORIES, *extras)
    family = F.substring_index(name, ".", 1)
    found = F.lit(S.DEFAULT_CATEGORY)
    for c in reversed(S.CATEGORIES):
        found = F.when(family == c.split(".")[0], c).otherwise(found)
    return F.struct(F.when(exact, name).otherwise(found).alias("category"), exact.alias("exact"))


def category_error(raw: Column, extras: tuple[str, ...] = ()) -> Column:
    """Why a category that a caller names is refused; null if it is a built-in or configured one, however it is written."""
    name = ascii_lower(tidy(F.coalesce(raw, F.lit(""))))
    return F.when(~name.isin(*S.CATEGORIES, *extras), F.concat(F.lit("unknown category "), name))


def domain(category: Column) -> Column:
    return F.when(category.isin(*S.PERSONAL), "personal").otherwise("coding")


def one_line(x: Column) -> Column:
    return F.regexp_replace(x, r"[\r\n]", " ")


def tag_suffix(tags: Column) -> Column:
    return F.when(F.size(tags) > 0, F.concat(F.lit(" _("), F.array_join(tags, ", "), F.lit(")_"))).otherwise("")


def scopes(x: Column) -> Column:
    """A comma-separated scope list in canonical order, each once; unknown names dropped."""
    known = ("read", "write", "admin")
    got = F.transform(F.split(x, ","), lambda s: ascii_lower(tidy(s)))
    return F.filter(F.array(*map(F.lit, known)), lambda k: F.array_contains(got, k))


def allows(granted: Column, wanted: str) -> Column:
    """Admin may all; write does not imply read."""
    return F.array_contains(granted, "admin") | F.array_contains(granted, wanted)


def api_key_parts(token: Column, scheme: str) -> Column:
    """struct(prefix, redacted) of a well-formed key token (scheme, 8 and 32 hex digits), else null."""
    body = F.when(token.startswith(scheme), F.substring(token, len(scheme) + 1, 1000))
    good, prefix = body.rlike(r"^[0-9a-f]{40}$"), F.substring(body, 1, 8)
    return F.when(good, F.struct(prefix.alias("prefix"), F.concat(prefix, F.lit("…")).alias("redacted")))


def valid_handle(x: Column) -> Column:
    return ascii_lower(tidy(x)).rlike(r"^[a-z0-9._-]{1,64}$")


def valid_email(x: Column) -> Column:
    return x.rlike(r"^[^@].*@.*[^@]$|^[^@]@[^@]$")
