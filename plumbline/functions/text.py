"""String expressions: identifiers, paths, truthy values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats that identifiers follow.
FIGURE_NAME = r"(?i)^([A-Z]{2}\w+?)_(SHR|OPN)_([A-Z0-9]+)_p(\d{3})_c(\d{2})$"
ARCH_SUFFIX = r"^(.+?)_arch(\d+)$"
IMAGE_NAME = r"(?i)\.(png|jpg|jpeg|tif|tiff|bmp|webp)$"
SAMPLE_NAME = r"(?i)\.(png|jpg|jpeg)$"
TRUE_WORDS = ("true", "1", "yes")


def none_if_blank(c: Column) -> Column:
    return F.when(c != "", c)


def figure_name_fields(stem: Column) -> dict[str, Column]:
    """patent_id keeps its case, category and CPC are upper-cased; no match gives (stem, null, null, null)."""
    hit = stem.rlike(FIGURE_NAME)
    part = lambda i: F.when(hit, F.regexp_extract(stem, FIGURE_NAME, i))
    return {
        "patent_id": F.coalesce(part(1), stem),
        "shrouded_open": F.upper(part(2)),
        "cpc": F.upper(part(3)),
        "figure_type": F.when(hit, F.concat(F.lit("p"), part(4), F.lit("_c"), part(5))),
    }


def arch_base(pid: Column) -> Column:
    """the id without its last ``_archN``."""
    return F.when(pid.rlike(ARCH_SUFFIX), F.regexp_extract(pid, ARCH_SUFFIX, 1)).otherwise(pid)


def arch_number(pid: Column) -> Column:
    return F.when(pid.rlike(ARCH_SUFFIX), F.regexp_extract(pid, ARCH_SUFFIX, 2).try_cast("int")).otherwise(F.lit(1))


def arch_index(arch: Column, pid: Column) -> Column:
    """numeric ``arch`` truncated towards zero, else the id's suffix."""
    return F.coalesce(F.trim(arch).try_cast("double").cast("int"), arch_number(pid))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def truthy(c: Column, extra: tuple[str, ...] = ()) -> Column:
    """P10: lower-cased text is one of the true words, blanks around it not stripped; null is false."""
    return F.coalesce(F.lower(c.cast("string")).isin(*TRUE_WORDS, *extra), F.lit(False))


def first_listed(c: Column, sep: str = ";") -> Column:
    """F8: first entry of a separated list, trimmed; blank or the text ``nan`` is null."""
    head = F.trim(F.element_at(F.split(c, sep), 1))
    return F.when((head != "") & (head != "nan"), head)
