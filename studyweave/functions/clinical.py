"""Column expressions that know the clinical vocabulary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as voc
from .text import trim_all


def cohort_of(study_id: Column, patterns=voc.COHORT_PATTERNS) -> Column:
    """Label of the cohort a study republishes; the first matching pattern wins."""
    labels = [F.when(study_id.rlike(pattern), F.lit(label)) for pattern, label in patterns]
    return F.coalesce(*labels, study_id)


def read_value(concept: Column, value: Column, text: Column, first_match) -> Column:
    """The rule of each concept, on `text` = the upper-cased, trimmed value.

    Concepts without a rule keep the value as recorded. `first_match(text, pattern)` decides what
    stands for no match.
    """
    receptor = F.when(text.rlike(voc.POSITIVE_PATTERN), F.lit("POSITIVE")).when(
        text.rlike(voc.NEGATIVE_PATTERN), F.lit("NEGATIVE")
    )
    rules = F.when(concept.isin(*voc.RECEPTOR_CONCEPTS), receptor)
    for name, pattern in voc.CONCEPT_PATTERNS:
        source = F.regexp_replace(text, voc.STAGE_PREFIX, "") if name == "TUMOR_STAGE" else text
        rules = rules.when(concept == name, first_match(source, pattern))
    return rules.otherwise(value)


def normalise_value(concept: Column, value: Column) -> Column:
    """One vocabulary per concept; NULL where the text fits none of its forms."""
    text = F.upper(trim_all(value))
    return read_value(concept, value, text, lambda t, pattern: F.regexp_substr(t, F.lit(pattern)))


def os_event(status: Column) -> Column:
    """'1' for a recorded death, '0' for any other recorded status, NULL for none."""
    died = F.upper(status).rlike(voc.EVENT_PATTERN)
    return F.when(died, F.lit("1")).when(status.isNotNull(), F.lit("0"))


def entity_key(study_id: Column, local_id: Column) -> Column:
    """Key that is unique over all studies; ids are unique only within one."""
    return F.concat(study_id, F.lit(":"), local_id)
