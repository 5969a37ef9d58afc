"""Column expressions on literature records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank(x: Column) -> Column:
    """Null for a missing or empty value."""
    return F.when(F.trim(x) != "", x)


def doi(x: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.trim(x)), r"^(https?://(dx\.)?doi\.org/|doi:\s*)", "")
    return F.regexp_replace(bare, r"[.,;]+$", "")


def title(x: Column) -> Column:
    """Lower case, tags and everything but letters, digits and _ to single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"<[^>]+>", " "), r"[^\p{L}\p{N}_]+", " "))


def stable_id(id_: Column, pmid: Column, arxiv: Column, doi_: Column, title_: Column, year: Column) -> Column:
    """The first identifier there is, or a hash of title and year (a missing year reads None)."""
    hashed = F.substring(F.sha2(F.concat_ws("|", F.coalesce(title(title_), F.lit("")), F.coalesce(year.cast("string"), F.lit("None"))), 256), 1, 16)
    return F.coalesce(blank(id_), F.concat(F.lit("PMID:"), blank(pmid)), F.concat(F.lit("ARXIV:"), blank(arxiv)), F.concat(F.lit("DOI:"), blank(doi(doi_))), F.concat(F.lit("HASH:"), hashed))


def authors(x: Column) -> Column:
    """An author list from text: split at semicolons if there are any, else at commas."""
    parts = F.when(F.contains(x, F.lit(";")), F.split(x, ";")).otherwise(F.split(x, ","))
    return F.filter(F.transform(parts, lambda a: F.trim(a)), lambda a: a != "")


def journal_key(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def number(x: Column) -> Column:
    """A nullable number: thousands separators go; '', N/A and dashes are null."""
    return F.replace(F.trim(x), F.lit(","), F.lit("")).try_cast("double")
