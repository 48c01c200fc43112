"""Identifier slugs and name cleaning as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import as_col

# Bracketed municipal suffixes stripped before matching.
TOWN_SUFFIX = (
    r"(?i)\s*\((M\.?\s*Corp\.?|M\s*Cl\.?|M\.?|CT|CB|R|NP|Cantt\.?"
    r"|Nagar\s*Panchayat|Census\s*Town|Cantonment\s*Board)\)\s*\.?\s*$"
)
QUERY_SUFFIX = (
    r"(?i)\s*\((M\.?\s*Corp\.?|M\s*Cl\.?|M\.?|Ct|Cb|R|NP|Mc|Og"
    r"|M\s*Corp\.?\s*\+\s*Og|M\s*Cl\s*\+\s*Og)\)\s*\.?\s*$"
)
PART_SUFFIX = r"(?i)\s*\(Part\)\s*$"
RURAL_SUFFIX = r"(?i)\s*\(Rural\)\s*$"
EMPTY_BRACKETS = r"\s*\(\s*\)\s*$"
LAST_BRACKETS = r"\s*\([^)]*\)\s*$"
ROMAN_PREFIX = r"^[IiVvXx]+\)"
CANTONMENT = r"(?i)\s*Cantt\.?\s*$"
RAILWAY = r"(?i)\s*Ry\.?\s*$"
WARD_PREFIX = r"^[a-z]\)"
WARD_SUFFIX = r"(?i)\s*Ward\s*No\.\s*[-]?\s*\d+.*$"

# Census spellings and the search terms that replace them.
NAME_CORRECTIONS = {
    "Ichalkarnji": "Ichalkaranji",
    "Pethumri": "Pathri",
    "Yevla": "Yeola",
    "Manjlegaon": "Manjlegaon",
    "Kurundvad": "Kurundwad",
    "Pandharkaoda": "Pandharkaoda",
    "Roha Ashtami": "Roha",
    "Dapoli Camp": "Dapoli",
    "Kanhan (Pipri)": "Kanhan",
    "Shivatkar (Nira)": "Nira",
    "Vadgaon Sheri": "Vadgaon Sheri",
    "Koregaon Bhima": "Koregaon Bhima",
    "Khadakvasla": "Khadakwasla",
    "Kirkee": "Khadki",
    "Sironcha Ry.": "Sironcha",
    "Sawangi (Meghe)": "Sawangi Meghe",
    "Sonegaon (Nipani)": "Sonegaon",
    "Vanvadi (Sadashivgad)": "Sadashivgad",
    "Sindi Turf Hindnagar": "Sindhi Meghe",
}

# Names that are worth several search attempts, in this order.
ALTERNATIVE_NAMES = {
    "Pandharkaoda": ["Pandharkawada", "Pandharkaoda"],
    "Ichalkarnji": ["Ichalkaranji", "Ichalkarnji"],
    "Pethumri": ["Pathri", "Pethumri"],
    "Yevla": ["Yeola", "Yevla"],
    "Kurundvad": ["Kurundwad", "Kurundvad"],
    "Kirkee": ["Khadki", "Kirkee Cantonment", "Kirkee"],
    "Kamptee": ["Kamptee", "Kamthi"],
    "Nawapur": ["Navapur", "Nawapur"],
    "Talode": ["Taloda", "Talode"],
    "Shirpur-Warwade": ["Shirpur", "Shirpur Warwade"],
    "Dondaicha-Warwade": ["Dondaicha", "Dondaicha Warwade"],
    "Murgad": ["Murgud", "Murgad"],
    "Roha Ashtami": ["Roha"],
    "Dapoli Camp": ["Dapoli"],
    "Alore": ["Alorye", "Alore", "Aare Ware"],
    "Kanhan (Pipri)": ["Kanhan", "Pipri"],
    "Khadakvasla": ["Khadakwasla", "Khadakvasla"],
    "Dehu Road": ["Dehu Road", "Dehuroad"],
    "Vadgaon Sheri": ["Vadgaon Sheri", "Vadgaonsheri"],
    "Sironcha Ry.": ["Sironcha"],
    "Sawangi (Meghe)": ["Sawangi Meghe", "Sawangi"],
    "Sonegaon (Nipani)": ["Sonegaon Nipani", "Sonegaon"],
    "Vashind": ["Vasind", "Vashind"],
    "Kasara Budruk": ["Kasara", "Kasara Budruk"],
}

# District spellings; None marks a district with no modern match.
DISTRICT_ALIASES = {"Mumbai (Suburban)": "Mumbai Suburban", "Greater Bombay": None}

# Boundary spelling -> census spelling, both normalised.
DISTRICT_OVERRIDES = {
    "bid": "beed",
    "gondiya": "gondia",
    "raigarh": "raigad",
    "mumbai suburban": "mumbai (suburban)",
}


def strip_chars(x: Column, chars: str) -> Column:
    return F.trim(x, F.lit(chars))


def url_slug(x: str | Column) -> Column:
    return strip_chars(F.regexp_replace(F.lower(as_col(x)), "[^a-z0-9]+", "-"), "-")


def safe_file_name(x: str | Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(as_col(x)), " ", "_"), "[^a-z0-9_]", "")


def state_key(x: str | Column) -> Column:
    return F.regexp_replace(F.translate(F.trim(F.lower(as_col(x))), " ", "_"), "[^a-z0-9_-]", "")


def district_key(x: str | Column) -> Column:
    return F.translate(F.lower(as_col(x)), " ", "_")


def title_case(x: str | Column) -> Column:
    """Upper case after every non-letter, lower case elsewhere."""
    x = as_col(x)

    def letter(i):
        ch = F.substring(x, i, F.lit(1))
        starts = (i == 1) | ~F.substring(x, i - 1, F.lit(1)).rlike(r"\p{L}")
        return F.when(starts, F.upper(ch)).otherwise(F.lower(ch))

    made = F.array_join(F.transform(F.sequence(F.lit(1), F.length(x)), letter), "")
    return F.when(F.length(x) > 0, made).otherwise(x)


def capitalise_words(x: str | Column) -> Column:
    """Words split on white space, first letter upper and the rest lower."""
    return F.initcap(F.regexp_replace(F.trim(as_col(x)), r"\s+", " "))


@F.pandas_udf(T.StringType())
def _strip_marks(s: pd.Series) -> pd.Series:
    def plain(v):
        if not isinstance(v, str):
            return ""
        return "".join(ch for ch in unicodedata.normalize("NFKD", v) if not unicodedata.combining(ch))

    return s.map(plain)


def normal_name(x: str | Column) -> Column:
    """Name without diacritics, lower case, single spaces; NULL gives ''.

    Only names with other letters than ASCII ones go through the Arrow function
    (it gets NULL for the others), so apply this to distinct names, not to fact
    rows.
    """
    name = as_col(x)
    other = name.rlike(r"[^\x00-\x7F]")
    plain = F.when(other, _strip_marks(F.when(other, name))).otherwise(F.coalesce(name, F.lit("")))
    return strip_chars(F.regexp_replace(F.lower(plain), r"\s+", " "), " ")


def town_key(x: str | Column) -> Column:
    """Town name for cross-period matching: no municipal suffix, lower case."""
    y = F.regexp_replace(F.trim(as_col(x)), TOWN_SUFFIX, "")
    return F.lower(strip_chars(F.regexp_replace(y, PART_SUFFIX, ""), "* "))


def basic_query_name(x: str | Column) -> Column:
    y = F.trim(as_col(x))
    for pattern in (QUERY_SUFFIX, PART_SUFFIX, RURAL_SUFFIX, EMPTY_BRACKETS):
        y = F.regexp_replace(y, pattern, "")
    return strip_chars(y, "* ")


def mapped(x: Column, table: Mapping[str, str | None], keep: bool = True) -> Column:
    """Replace through a short fixed table; other names stay (or give NULL)."""
    pairs = [F.lit(v) for kv in table.items() for v in kv]
    found = F.element_at(F.create_map(*pairs), x)
    return F.coalesce(found, x) if keep else found


def strict_query_name(x: str | Column) -> Column:
    y = F.trim(as_col(x))
    y = F.regexp_replace(F.regexp_replace(y, LAST_BRACKETS, ""), LAST_BRACKETS, "")
    y = F.trim(F.regexp_replace(y, ROMAN_PREFIX, ""))
    y = F.regexp_replace(F.regexp_replace(y, CANTONMENT, ""), RAILWAY, "")
    return strip_chars(mapped(y, NAME_CORRECTIONS), "* .\t")


def query_variants(name: str | Column, district: str | Column, state: str, country: str) -> Column:
    """Ordered, de-duplicated search strings for one place."""
    name, district = as_col(name), as_col(district)
    pairs = []
    for key, alts in ALTERNATIVE_NAMES.items():
        pairs += [F.lit(key), F.array(*[F.lit(a) for a in alts])]
    alts = F.coalesce(F.element_at(F.create_map(*pairs), name), F.array(name))

    def forms(alt):
        tail = F.lit(f", {state}, {country}")
        return F.array(
            F.concat(alt, F.lit(", "), district, F.lit(" district"), tail),
            F.concat(alt, F.lit(", "), district, tail),
            F.concat(alt, tail),
        )

    return F.array_distinct(F.flatten(F.transform(alts, forms)))


def fallback_queries(name: str | Column, district: str | Column, state: str, country: str) -> Column:
    """Three search strings, from most to least specific."""
    name, district = as_col(name), as_col(district)
    return F.array(
        F.concat(name, F.lit(", "), district, F.lit(f" district, {state}, {country}")),
        F.concat(name, F.lit(", "), district, F.lit(f", {state}")),
        F.concat(name, F.lit(f", {state}, {country}")),
    )


def town_of_ward(x: str | Column) -> Column:
    """'a)NAME (M) Ward No. 01' -> 'Name (M)'."""
    y = F.trim(F.regexp_replace(as_col(x), WARD_PREFIX, ""))
    y = F.trim(F.regexp_replace(y, WARD_SUFFIX, ""))
    return title_case(F.trim(F.rtrim(y, F.lit("*"))))


def district_name(x: str | Column, aliases: Mapping[str, str | None] = DISTRICT_ALIASES) -> Column:
    """Strip quotes, blanks and stars, then apply spelling aliases."""
    known = {k: v for k, v in aliases.items() if v is not None}
    return mapped(strip_chars(as_col(x), "' *"), known)


def unmapped_districts(aliases: Mapping[str, str | None] = DISTRICT_ALIASES) -> Sequence[str]:
    return [k for k, v in aliases.items() if v is None]
