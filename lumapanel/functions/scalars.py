"""Row-level classes and physical conversions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import as_col, over

# Class limits, sky-brightness constants and sky classes.
ALAN_LOW, ALAN_MEDIUM = 1.0, 5.0
CV_STABLE, CV_ERRATIC = 0.2, 0.5
NATURAL_SKY_MAG = 22.0
RADIANCE_TO_MCD = 0.177
REFERENCE_MCD = 108_000_000.0
SCALE_HEIGHT_M = 8500.0
BORTLE = [
    (1, 21.75, "Excellent dark-sky site"),
    (2, 21.50, "Typical dark-sky site"),
    (3, 21.25, "Rural sky"),
    (4, 20.50, "Rural/suburban transition"),
    (5, 19.50, "Suburban sky"),
    (6, 18.50, "Bright suburban sky"),
    (7, 18.00, "Suburban/urban transition"),
    (8, 17.00, "City sky"),
    (9, 0.00, "Inner-city sky"),
]

# Derived census ratios, numerator columns over denominator.
CENSUS_RATIOS = {
    "literacy_rate": (("P_LIT",), "TOT_P"),
    "workforce_rate": (("TOT_WORK_P",), "TOT_P"),
    "dependency_ratio": (("NON_WORK_P",), "TOT_WORK_P"),
    "child_ratio": (("P_06",), "TOT_P"),
    "sc_st_share": (("P_SC", "P_ST"), "TOT_P"),
    "household_size": (("TOT_P",), "No_HH"),
    "sex_ratio": (("TOT_F",), "TOT_M"),
}


def alan_class(x: str | Column, unknown: str | None = "unknown") -> Column:
    """Low / medium / high light class; NULL gives ``unknown`` (or stays NULL)."""
    x = as_col(x)
    known = F.when(x < ALAN_LOW, "low").when(x < ALAN_MEDIUM, "medium").when(x.isNotNull(), "high")
    return known.otherwise(F.lit(unknown)) if unknown is not None else known


def stability_class(cv: str | Column) -> Column:
    cv = as_col(cv)
    return (
        F.when(cv.isNull(), "unknown")
        .when(cv < CV_STABLE, "stable")
        .when(cv < CV_ERRATIC, "moderate")
        .otherwise("erratic")
    )


def sky_magnitude(radiance: str | Column) -> Column:
    """Sky brightness in mag/arcsec2 from radiance, over the natural background."""
    background = REFERENCE_MCD * 10.0 ** (-0.4 * NATURAL_SKY_MAG)
    total = as_col(radiance) * RADIANCE_TO_MCD + background
    return -2.5 * F.log10(total / REFERENCE_MCD)


def bortle(mag: str | Column) -> tuple[Column, Column]:
    """Sky class and description; half-open ranges, 9 by default, NULL stays NULL."""
    mag = as_col(mag)
    cls, text = F.when(mag.isNull(), F.lit(None).cast("int")), F.when(mag.isNull(), "")
    for number, low, label in BORTLE[:-1]:
        cls, text = cls.when(mag >= low, number), text.when(mag >= low, label)
    last = BORTLE[-1]
    return cls.otherwise(last[0]), text.otherwise(last[2])


def add_sky_brightness(df: DataFrame, radiance: str) -> DataFrame:
    """Magnitude (rounded after classification), class and description."""
    mag = sky_magnitude(radiance)
    cls, text = bortle(mag)
    return df.withColumns(
        {"sky_magnitude": F.round(mag, 2), "bortle_class": cls, "bortle_description": text}
    )


def elevation_factor(metres: str | Column) -> Column:
    return F.exp(-as_col(metres) / SCALE_HEIGHT_M)


def projected_10yr(latest: str | Column, annual_pct: str | Column) -> Column:
    return as_col(latest) * F.pow(1.0 + as_col(annual_pct) / 100.0, F.lit(10.0))


def first_present(names: Sequence[str], df: DataFrame, digits: int = 3) -> Column:
    """Rounded first non-NULL of those named columns that the table has."""
    have = [F.col(n) for n in names if n in df.columns]
    picked = F.coalesce(*have) if have else F.lit(None).cast("double")
    return F.round(picked, digits)


def suitability(latest: str | Column, limit: float = ALAN_LOW) -> Column:
    return F.when(as_col(latest) < limit, "SUITABLE").otherwise("NOT SUITABLE")


def add_census_ratios(df: DataFrame, ratios=CENSUS_RATIOS) -> DataFrame:
    """Derived ratios whose inputs are all present; zero denominators give NULL."""
    names = {c.lower(): c for c in df.columns}
    made = {}
    for name, (parts, den) in ratios.items():
        if all(p.lower() in names for p in (*parts, den)):
            num = sum((F.col(names[p.lower()]) for p in parts[1:]), F.col(names[parts[0].lower()]))
            made[name] = over(num, F.col(names[den.lower()]))
    return df.withColumns(made) if made else df


def prefix_columns(df: DataFrame, label: str, keep: Sequence[str]) -> DataFrame:
    """Prefix every column but the keys with the dataset label."""
    return df.select(*[F.col(n) if n in keep else F.col(n).alias(f"{label}_{n}") for n in df.columns])


def log_display(x: str | Column, floor: float = 0.01) -> Column:
    x = as_col(x)
    return F.when(x.isNotNull(), F.log10(F.greatest(x, F.lit(floor))))


def power_display(x: str | Column, top: str | Column, gamma: float = 0.35) -> Column:
    """Share of ``top`` clipped to [0,1], raised to gamma."""
    share = over(x, top)
    return F.when(share.isNotNull(), F.pow(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)), F.lit(gamma)))


def symmetric_display(x: str | Column, limit: float) -> Column:
    """Change mapped from [-limit, limit] to [0, 1]."""
    x = as_col(x)
    clipped = F.least(F.greatest(x, F.lit(-limit)), F.lit(limit))
    return F.when(x.isNotNull(), (clipped + limit) / (2.0 * limit))


def alpha(a: str | Column, mode: str, floor: float, ceiling: float, gamma: float) -> Column:
    """Opacity from a normalised value: its size, its distance from the middle, or full."""
    a = as_col(a)
    strength = {"diverging": F.abs(a - 0.5) * 2.0, "solid": F.when(a.isNotNull(), F.lit(1.0))}.get(mode, a)
    return F.lit(floor) + (ceiling - floor) * F.pow(strength, F.lit(gamma))


def round_coords(coords: str | Column, depth: int, digits: int = 5) -> Column:
    """Round coordinates nested ``depth`` arrays deep."""
    if depth == 0:
        return F.round(as_col(coords), digits)
    return F.transform(as_col(coords), lambda x: round_coords(x, depth - 1, digits))
