"""The closed list of tags, and the formats of files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Tags in display order; those from MEDICAL on, and SID to GRADE's
# neighbours below, are the sensitive tier.
TAGS = [
    "PERSON", "EMAIL", "PHONE", "ADDRESS", "ID", "ORG",
    "FINANCIAL", "DOB", "SID", "IP", "USERNAME",
    "GRADE", "MEDICAL", "IMMIGRATION", "DEMO", "RELIGION", "GENDER",
]
STANDARD = 11
#: Tags of which a bare number can be a value.
NUMERIC_TAGS = ["SID", "GRADE"]

#: What a model is told about each tag.
HELP = {
    "PERSON": "name of a person",
    "EMAIL": "email address",
    "PHONE": "telephone number, with its extension",
    "ADDRESS": "where somebody lives: street, unit, town, region, postcode",
    "ID": "number that a state issues to a person or firm: tax, social security, passport",
    "ORG": "name of a firm, school, church or charity",
    "FINANCIAL": "number of an account, a bank or a card",
    "DOB": "date of birth",
    "SID": "number of a student, an employee or a badge",
    "IP": "internet address",
    "USERNAME": "login or handle",
    "GRADE": "one person's mark, average or test result",
    "MEDICAL": "illness, treatment, medicine or support plan of a person",
    "IMMIGRATION": "visa or citizenship of a person",
    "DEMO": "ethnic origin of a person",
    "RELIGION": "faith of a person",
    "GENDER": "gender or pronouns of a named person",
}

# Suffix, output suffix, note.
FORMATS = [
    ("pdf", ".txt", "text only"),
    ("xlsx", ".xlsx", "formatting preserved"),
    ("xls", ".xlsx", "formatting preserved (converted to xlsx)"),
    ("csv", ".csv", "format preserved"),
    ("docx", ".docx", "formatting preserved"),
    ("doc", ".docx", "formatting preserved (converted to docx)"),
    ("pptx", ".txt", "text only"),
    ("ppt", ".txt", "text only"),
    ("odt", ".docx", "formatting preserved (converted to docx)"),
    ("ods", ".xlsx", "formatting preserved (converted to xlsx)"),
    ("odp", ".txt", "text only (converted)"),
    ("txt", ".txt", "format preserved"),
    ("md", ".md", "format preserved"),
    ("rtf", ".txt", "text only"),
    ("html", ".txt", "text only"),
    ("htm", ".txt", "text only"),
]


def tag_table(spark: SparkSession) -> DataFrame:
    """tag, rank and tier of each of the 17 tags."""
    rows = F.array(*(F.struct(F.lit(t).alias("tag"), F.lit(i).alias("rank"), F.lit("standard" if i < STANDARD else "sensitive").alias("tier")) for i, t in enumerate(TAGS)))
    return spark.range(1).select(F.inline(rows))


def format_table(spark: SparkSession) -> DataFrame:
    """suffix, output_ext and output_note of each supported format."""
    rows = F.array(*(F.struct(F.lit(a).alias("suffix"), F.lit(b).alias("output_ext"), F.lit(c).alias("output_note")) for a, b, c in FORMATS))
    return spark.range(1).select(F.inline(rows))


def allowed_tags(requested: Iterable[str]) -> list[str]:
    """The valid ones of the requested tags in display order; none is an error."""
    wanted = {str(t).strip().upper() for t in requested}
    found = [t for t in TAGS if t in wanted]
    if not found:
        raise ValueError("no valid tag is selected")
    return found


def tag_rank(tag: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, TAGS)), tag)
