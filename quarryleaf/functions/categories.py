"""Publication categories by ordered rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarryleaf.functions.names import normal_text

# Categories, their precedence, that of the deciding rules, and the rules' patterns.
CATEGORIES = ("journal", "conference", "review", "other")
CATEGORY_RANK = {"other": 0, "journal": 1, "conference": 2, "review": 3}
BASIS_RANK = {"other_record_type": 0, "journal_record_type": 10, "journal_metadata": 11, "conference_venue_metadata": 20, "conference_record_type": 21, "review_metadata": 30, "title_review": 31}
REVIEW = r"\b(review|survey|overview)\b|state[- ]of[- ]the[- ]art|systematic mapping"
CONFERENCE = r"\b(conference|proceedings|symposium|congress|workshop)\b|\bprocedia\b|\bifac[- ]?papersonline\b"
JOURNAL = r"\b(journal|magazine|early access)\b"
CONFERENCE_TYPES = ("conference", "inproceedings", "proceedings")


def classify(record_type: Column, title: Column, venue: Column, document_type: Column, note: Column) -> Column:
    """struct(category, basis): the first rule that fits decides."""
    kind, name = normal_text(record_type), normal_text(title)
    about = F.concat_ws(" ", F.nullif(normal_text(document_type), F.lit("")), F.nullif(normal_text(note), F.lit("")))
    place = F.concat_ws(" ", F.nullif(normal_text(venue), F.lit("")), F.nullif(about, F.lit("")))

    def is_(category: str, basis: str) -> Column:
        return F.struct(F.lit(category).alias("category"), F.lit(basis).alias("basis"))

    return (
        F.when(name.rlike(REVIEW), is_("review", "title_review"))
        .when(about.rlike(REVIEW), is_("review", "review_metadata"))
        .when(kind.isin(*CONFERENCE_TYPES), is_("conference", "conference_record_type"))
        .when(place.rlike(CONFERENCE), is_("conference", "conference_venue_metadata"))
        .when(kind == "article", is_("journal", "journal_record_type"))
        .when(about.rlike(JOURNAL), is_("journal", "journal_metadata"))
        .otherwise(is_("other", "other_record_type"))
    )


def _rank(column: Column, ranks: dict[str, int]) -> Column:
    out = F.lit(-1)
    for name, rank in ranks.items():
        out = F.when(column == name, rank).otherwise(out)
    return out


def preferred(category: Column, basis: Column) -> Column:
    """Aggregate: the classification of the highest category, then basis, then basis name; other if there is none."""
    best = F.max(F.when(category.isNotNull(), F.struct(_rank(category, CATEGORY_RANK).alias("c"), _rank(basis, BASIS_RANK).alias("b"), basis.alias("basis"), category.alias("category"))))
    return F.struct(F.coalesce(best["category"], F.lit("other")).alias("category"), F.coalesce(best["basis"], F.lit("other_record_type")).alias("basis"))
