"""Column functions on names, identifiers, titles, dates and numbers as publishers write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters and their base letters.
ACCENTED = "áàâäãåāéèêëēíìîïīóòôöõōúùûüūçñýÿÁÀÂÄÃÅĀÉÈÊËĒÍÌÎÏĪÓÒÔÖÕŌÚÙÛÜŪÇÑÝ"
PLAIN = "aaaaaaaeeeeeiiiiioooooouuuuucnyyAAAAAAAEEEEEIIIIIOOOOOOUUUUUCNY"


def without_accents(text: Column) -> Column:
    """Base letters of accented Latin ones, whole or as letter and combining mark."""
    return F.regexp_replace(F.translate(text, ACCENTED, PLAIN), r"\p{M}+", "")


def normal_doi(doi: Column) -> Column:
    """Trimmed, lower-cased, without a resolver's address; null if nothing is left."""
    bare = F.regexp_replace(F.trim(doi), r"(?i)^https?://(dx\.)?doi\.org/", "")
    return F.nullif(F.lower(F.trim(bare)), F.lit(""))


def normal_title(title: Column) -> Column:
    """Lower-cased, everything but a-z and 0-9 as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " "))


def normal_text(text: Column) -> Column:
    """Without accents, white space collapsed, lower-cased; null as empty."""
    return F.lower(F.trim(F.regexp_replace(without_accents(F.coalesce(text, F.lit(""))), r"\s+", " ")))


def whole_number(text: Column) -> Column:
    """The integer part of a number in text ("12.0" is 12), else null."""
    return text.try_cast("double").try_cast("int")


def online_date(text: Column) -> Column:
    """A date such as 05 Mar 2021, else null."""
    return F.try_to_date(F.trim(text), "d MMM yyyy") if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(F.trim(text), F.lit("d MMM yyyy")))


def listed(text: Column, separator: str) -> Column:
    """Trimmed, non-blank parts of a separated list, braces removed; null as an empty list."""
    parts = F.transform(F.split(F.translate(F.coalesce(text, F.lit("")), "{}", ""), separator), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def countries(affiliations: Column) -> Column:
    """The last comma-separated part of each semicolon-separated affiliation, without blanks and "na", once each."""
    last = F.transform(listed(affiliations, ";"), lambda a: F.trim(F.element_at(F.split(a, ","), -1)))
    return F.array_distinct(F.filter(last, lambda x: ~F.lower(x).isin("", "na", "n/a", "-")))


def author_key(name: Column) -> Column:
    """initial and surname, lower-case without accents. "Last, First" keeps the whole last part as surname, other names
    their last word; one word alone is a surname. Outer dots are trimmed."""
    bare = F.lower(without_accents(F.trim(F.regexp_replace(F.trim(name), r"^[.\s]+|[.\s]+$", ""))))
    last = F.trim(F.split_part(bare, F.lit(","), F.lit(1)))
    first = F.trim(F.split_part(bare, F.lit(","), F.lit(2)))
    words = F.split(bare, r"\s+")
    inverted = F.when(first == "", last).otherwise(F.concat_ws(" ", F.substring(first, 1, 1), last))
    plain = F.when(F.size(words) < 2, bare).otherwise(F.concat_ws(" ", F.substring(bare, 1, 1), F.element_at(words, -1)))
    return F.when(bare.contains(","), inverted).otherwise(plain)


def haystack(title: Column, abstract: Column) -> Column:
    """What the taxonomies search: title and abstract, lower-cased."""
    return F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit(""))))


def abstract_text(title: Column, keywords: Column, abstract: Column) -> Column:
    """Title, keywords and abstract joined by empty lines, blank parts left out."""
    said = F.when(F.size(keywords) > 0, F.concat(F.lit("Keywords: "), F.array_join(keywords, ", ")))
    return F.trim(F.concat_ws("\n\n", F.nullif(title, F.lit("")), said, F.nullif(abstract, F.lit(""))))


def preview(text: Column, limit: int = 700) -> Column:
    """White space collapsed; longer texts cut with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.rtrim(F.substring(flat, 1, limit)), F.lit("…"))).otherwise(flat)


def short_id(address: Column) -> Column:
    """The last part of an address's path."""
    return F.substring_index(F.regexp_replace(address, "/+$", ""), "/", -1)


def registrant(doi: Column) -> Column:
    return F.split_part(doi, F.lit("/"), F.lit(1))


def plausible_year(text: Column) -> Column:
    """The first year from 1600 to 2100 in free text."""
    return F.regexp_extract(text, r"(1[6-9]\d\d|20\d\d|2100)", 1).try_cast("int")


def valid_year(year: Column, low: int, high: int) -> Column:
    """The year where it is a number within the bounds, else null."""
    y = year.try_cast("double")
    return F.when(y.between(low, high), y.cast("int"))


def ordered_pair(a: Column, b: Column) -> Column:
    """The two normalised identifiers in order; null if one is missing or they are the same."""
    x, y = normal_doi(a), normal_doi(b)
    return F.when(x.isNotNull() & y.isNotNull() & (x != y), F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")))


def token(path: Column) -> Column:
    """The first 12 hex digits of a path's digest."""
    return F.substring(F.sha2(path, 256), 1, 12)


def non_article(record_type: Column, abstract: Column) -> Column:
    """A book or chapter with less than 50 characters of abstract."""
    return record_type.isin("incollection", "book", "inbook") & (F.length(F.trim(F.coalesce(abstract, F.lit("")))) < 50)
