"""Text expressions: tokens, comparison text, timestamps, markers and parsed model output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Zone names found in feed dates, as offsets.
_ZONES = {
    "GMT": "+0000", "UTC": "+0000", "UT": "+0000", "Z": "+0000",
    "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500",
    "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}

_DATE_FORMATS = (
    "d MMM yyyy HH:mm:ss Z",
    "d MMM yyyy HH:mm Z",
    "d MMM yyyy HH:mm:ss",
    "d MMM yy HH:mm:ss Z",
    "MMM d, yyyy HH:mm:ss",
    "MMM d, yyyy",
    "d MMM yyyy",
    "yyyy/MM/dd HH:mm:ss",
    "MM/dd/yyyy HH:mm:ss",
    "MM/dd/yyyy",
)


# Every white-space character of Unicode, as a set to trim and as a pattern class.
_SPACES = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)
_SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{_SPACE}+", " "))


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only the blank."""
    return F.btrim(text, F.lit(_SPACES))


def compare_text(title: Column, description: Column, limit: int | None = None) -> Column:
    whole = F.concat_ws("\n", title, description)
    return whole if limit is None else F.substring(whole, 1, limit)


def word_tokens(text: Column) -> Column:
    """Distinct lower-case runs of letters a-z and apostrophes."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z']+"), F.lit(0)))


def published_utc(published: Column, updated: Column, as_of: Column) -> Column:
    """Publish time, else update time; naive times are UTC; unreadable ones count as now."""
    return F.coalesce(_timestamp(published), _timestamp(updated), as_of)


def _timestamp(raw: Column) -> Column:
    """Read a date in any of the known forms. Each step is bound once, so the expression stays small."""
    offsets = F.create_map(*[F.lit(x) for pair in _ZONES.items() for x in pair])
    text = F.regexp_replace(strip(raw), r"^[A-Za-z]{3,9},?\s+(?=\d)", "")
    offset = lambda t: F.try_element_at(offsets, F.regexp_extract(t, r"\s([A-Z]{1,3})$", 1))
    named = lambda t: F.coalesce(
        F.concat(F.regexp_replace(t, r"\s[A-Z]{1,3}$", " "), offset(t)), t
    )
    iso = lambda t: F.try_to_timestamp(F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), t))
    read = lambda t: F.coalesce(iso(t), *[F.try_to_timestamp(t, F.lit(f)) for f in _DATE_FORMATS])
    return F.transform(F.transform(F.array(text), named), read)[0]


def age_hours(as_of: Column, at: Column) -> Column:
    """Age in hours with one decimal."""
    micros = F.unix_micros(as_of) - F.unix_micros(at)
    return F.bround(micros / F.lit(3_600_000_000.0), 1)


def is_weekday(as_of: Column, zone: str) -> Column:
    return F.weekday(F.from_utc_timestamp(as_of, zone)) < 5


def post_text(generated: Column, url: Column) -> Column:
    return F.concat(generated, F.lit("\n\n"), url)


def post_text_without_url(post: Column, url: Column) -> Column:
    """Undo `post_text`: remove exactly that suffix, nothing else."""
    suffix = F.concat(F.lit("\n\n"), url)
    return F.when(
        F.endswith(post, suffix), F.substring(post, F.lit(1), F.length(post) - F.length(suffix))
    ).otherwise(post)


def is_declined(generated: Column) -> Column:
    """Nothing but "no comment", whatever marks it up and ends it. Anchored, so a longer text is left at once."""
    bare = F.translate(generated, "*_`#", "")
    return bare.rlike(rf"\A(?i:{_SPACE}*no comment{_SPACE}*[.!]*{_SPACE}*)\z")


def contains_any(text: Column, phrases: tuple[str, ...]) -> Column:
    listed = F.array(*[F.lit(p) for p in phrases]).cast("array<string>")
    # The text is lower-cased once per row and the search ends at the first phrase found.
    return F.exists(F.array(F.lower(text)), lambda t: F.exists(listed, lambda p: F.contains(t, p)))


def usable_text(text: Column, fallback: Column, min_chars: int, phrases: tuple[str, ...]) -> Column:
    """Body text when it is long enough and no subscription notice, else the fallback."""
    good = (F.length(text) >= min_chars) & ~contains_any(text, phrases)
    return F.when(good, text).otherwise(fallback)


def labelled_field(raw: Column, name: str) -> Column:
    """Value of the first `NAME...: value` line, upper-cased."""
    return F.upper(strip(F.regexp_extract(raw, rf"(?im)^{name}[^:\r\n]*:(.*)$", 1)))


def says_same(raw: Column) -> Column:
    return F.coalesce(F.startswith(labelled_field(raw, "VERDICT"), F.lit("SAME")), F.lit(False))


def json_score(raw: Column) -> Column:
    """`{llm_score, llm_comment}` as a struct; NULL when either field is missing or of a wrong kind."""
    doc = F.try_parse_json(raw)
    kind = F.schema_of_variant(F.try_variant_get(doc, "$.llm_comment", "variant"))
    text = F.lower(strip(F.try_variant_get(doc, "$.llm_score", "string")))
    number = F.when(text == "true", 1.0).when(text == "false", 0.0).otherwise(text.try_cast("double"))
    comment = F.try_variant_get(doc, "$.llm_comment", "string")
    return F.when(
        number.isNotNull() & (kind == "STRING"),
        F.struct(number.alias("llm_score"), comment.alias("llm_comment")),
    )


def json_ranks(raw: Column) -> Column:
    """`[{id, priority_score}, ..]` as an array; NULL unless every entry is well formed."""
    cleaned = strip(F.regexp_replace(F.regexp_replace(raw, "```json|```", ""), "[“”]", '"'))
    items = F.try_variant_get(
        F.try_parse_json(cleaned), "$", "array<struct<id:variant,priority_score:variant>>"
    )
    parsed = F.transform(
        items,
        lambda x: F.struct(
            F.when(F.schema_of_variant(x["id"]) == "STRING", F.try_variant_get(x["id"], "$", "string")).alias("id"),
            F.try_variant_get(x["priority_score"], "$", "string").try_cast("double").alias("priority_score"),
        ),
    )
    whole = F.forall(parsed, lambda x: x["id"].isNotNull() & x["priority_score"].isNotNull())
    return F.when(whole, parsed)
