"""How well a record serves an exhibition: age, completeness, subjects and pictures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import title_case

#: The weights of the parts.
WEIGHTS = {"temporal": 0.25, "enrichment": 0.20, "diversity": 0.20, "subject_richness": 0.15, "visual": 0.20}


# fixed values: the steps and slopes of the four parts


def temporal(y: Column) -> Column:
    """1 before 1500, then less with every year, down to 0.15; 0.3 without a date."""
    late = F.greatest(F.lit(0.15), 0.4 - 0.1 * (y - 1800) / 100)
    return F.when(y.isNull(), 0.3).when(y < 1500, 1.0).when(y < 1600, 1.0 - 0.15 * (y - 1500) / 100).when(y < 1800, 0.85 - 0.45 * (y - 1600) / 200).otherwise(late)


def enrichment(n_subjects: Column, publisher: Column, author: Column, description: Column, title: Column) -> Column:
    has = lambda c: F.when(F.coalesce(c, F.lit("")) != "", 1.0).otherwise(0.0)
    subjects = F.when(n_subjects >= 2, 1.5).when(n_subjects == 1, 1.0).otherwise(0.0)
    return F.least(F.lit(1.0), (subjects + has(publisher) + has(author) + has(description) + F.when(F.length(title) > 10, 0.5).otherwise(0.0)) / 5)


def subject_richness(n: Column) -> Column:
    return F.when(n >= 4, 1.0).when(n == 3, 0.8).when(n == 2, 0.6).when(n == 1, 0.3).otherwise(0.0)


#: What an extent says of pictures.
PICTURES, ILLUSTRATED = r"(?i)map|plate|facsim|port\.", r"(?i)\bill|engrav|woodcut|diagr"


def visual(extent: Column) -> Column:
    text = F.coalesce(extent, F.lit(""))
    return F.when(text.rlike(PICTURES), 1.0).when(text.rlike(ILLUSTRATED), 0.6).otherwise(0.0)


def base_score(parts: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    """The weighted sum of the parts other than diversity, which depends on what was chosen before."""
    total = F.lit(0.0)
    for name, c in parts.items():
        total = total + weights[name] * c
    return F.round(total, 6)


def significance(date_start: Column, place: Column, subjects: Column, author: Column, extent: Column) -> Column:
    """A line that tells why a record was chosen, in fixed phrases."""
    year = date_start.cast("string")
    when = F.when(date_start < 1500, F.concat(F.lit("Incunabulum ("), year, F.lit(") -- exceptionally rare early printed work"))).when(date_start < 1600, F.concat(F.lit("Early modern imprint ("), year, F.lit(")"))).when(date_start.isNotNull(), F.concat(F.lit("Published "), year))
    some = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    about = F.when(F.size(subjects) > 0, F.concat(F.lit("subjects: "), F.array_join(F.slice(subjects, 1, 3), ", ")))
    look = F.coalesce(extent, F.lit(""))
    shown = F.when(look.rlike(PICTURES), "with maps/plates — strong visual teaching material").when(look.rlike(ILLUSTRATED), "illustrated")
    line = F.concat_ws("; ", when, F.concat(F.lit("printed in "), title_case(some(place))), about, F.concat(F.lit("by "), some(author)), shown)
    return F.when(line == "", "Selected for collection diversity").otherwise(line)
