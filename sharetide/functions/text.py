"""Text cleaning as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sharetide.config import NULL_TOKENS, REGION_ALIASES, UNKNOWN

_BLANKS = " \t\n\r\x0b\x0c"


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANKS))


def clean_string(c: Column, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    """Trim; a spelled-out missing value becomes NULL."""
    t = trimmed(c.cast("string"))
    return F.when(~F.lower(t).isin(*tokens), t)


def title_case(c: Column) -> Column:
    """Capital after every non-letter, lower case elsewhere (``o'neil b2b`` -> ``O'Neil B2B``).

    ``initcap`` breaks words on spaces only, which is enough for text made of letters and
    spaces; other text is cut into letter and non-letter runs.
    """
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    words = F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.substr(r, F.lit(2))))
    plain = ~c.rlike(r"[^\p{L} ]")
    return F.when(plain, F.initcap(c)).otherwise(F.array_join(words, ""))


def lookup(c: Column, mapping: Mapping[str, str]) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), c)


def region_or_null(c: Column, aliases: Mapping[str, str] = REGION_ALIASES) -> Column:
    """Alias or title case of trimmed text; a missing region stays missing."""
    return F.coalesce(lookup(F.lower(c), aliases), title_case(c)) if aliases else title_case(c)


def normalise_region(text: Column, aliases: Mapping[str, str] = REGION_ALIASES) -> Column:
    """Cleaned text: alias lookup on its lower case, else title case; missing -> ``Unknown``."""
    return F.coalesce(region_or_null(text, aliases), F.lit(UNKNOWN))


def normalise_label(text: Column) -> Column:
    """Cleaned text in title case; missing -> ``Unknown``."""
    return F.coalesce(title_case(text), F.lit(UNKNOWN))
