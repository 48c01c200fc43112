"""Name resolution and record linkage.

Similar names are found without comparing all pairs. The threshold says how many
characters of two names may stay unmatched. Where those are few, both names
meet by what is left when so many characters are taken out: the candidates are
exactly the pairs with a common subsequence of the wanted length, however often
a part like ``district `` is shared. Otherwise a name is cut into more pieces
than that, so a partner that is similar enough must contain one of them
unchanged and near its place; with pieces to spare, the most frequent ones are
left out. Both are joined by equality; only the candidates get the exact ratio.
"""

from __future__ import annotations

import difflib
from collections.abc import Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import DISTRICT_OVERRIDES, mapped, normal_name
from ..session import saved

MIN_THRESHOLD = 0.7
# Longest name from which none, one, two or three characters are taken out: 300 variants at most.
TAKEN_OUT = (1 << 30, 300, 25, 12)
SPARE_LENGTH = 3  # characters per piece from which one piece more than needed is cut


@F.pandas_udf(T.DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the length of the matching blocks over both lengths."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def _slack(lx: Column, ly: Column, threshold: float) -> tuple[Column, Column, Column]:
    """Allowed unmatched characters in total, in the first and in the second name."""
    least = F.ceil((lx + ly) * (threshold / 2.0) - 1e-9).cast("int")
    return lx + ly - 2 * least, lx - least, ly - least


def _partner_lengths(n: Column, threshold: float) -> Column:
    low = F.greatest(F.ceil(n * (threshold / (2.0 - threshold)) - 1e-9), F.lit(1)).cast("int")
    return F.sequence(low, F.floor(n * ((2.0 - threshold) / threshold) + 1e-9).cast("int"))


def _letters(name: Column) -> Column:
    """The letters of a name as a set: a letter's second occurrence is another member than its first."""
    chars = F.filter(F.split(name, ""), lambda c: c != "")
    return F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, F.lit(1), i), lambda d: d == c)).cast("string")))


def _taken_out(name: Column, k: Column) -> Column:
    """All distinct strings left when ``k`` characters, 3 at most, are taken out of the name."""
    levels = [F.array(name)]
    for _ in TAKEN_OUT[1:]:
        one = lambda v: F.transform(
            F.sequence(F.lit(1), F.length(v)), lambda i: F.concat(F.substring(v, F.lit(1), i - 1), F.substring(v, i + 1, F.length(v)))
        )
        levels.append(F.array_distinct(F.flatten(F.transform(levels[-1], one))))
    out = levels[-1]
    for n, level in reversed(list(enumerate(levels[:-1]))):
        out = F.when(k == n, level).otherwise(out)  # only the level that is asked for is computed
    return out


def _few_taken_out(lx: Column, ly: Column, threshold: float) -> Column:
    """Whether both names of these lengths have few enough variants."""
    _, in_x, in_y = _slack(lx, ly, threshold)
    fits = F.lit(True)
    for n, k in ((lx, in_x), (ly, in_y)):
        longest = F.element_at(F.array(*[F.lit(v) for v in TAKEN_OUT]), F.least(F.greatest(k, F.lit(0)), F.lit(len(TAKEN_OUT) - 1)) + 1)
        fits &= (k < len(TAKEN_OUT)) & (n <= longest)
    return fits


def _variant_keys(name: Column, other: Column, threshold: float, first: bool) -> Column:
    """(lx, ly, key) of a name for a partner of length ``other``; ``first``: the name is the first of the two."""
    own = F.length(name)
    lx, ly = (own, other) if first else (other, own)
    _, in_x, in_y = _slack(lx, ly, threshold)
    return F.transform(_taken_out(name, in_x if first else in_y), lambda v: F.struct(lx.alias("lx"), ly.alias("ly"), v.alias("key")))


def _pieces(n: Column, other: Column, threshold: float) -> Column:
    """Pieces that are cut: one more than characters may stay unmatched, and one to spare in long names."""
    needed = _slack(n, other, threshold)[0] + 1
    return needed + (n >= SPARE_LENGTH * (needed + 1)).cast("int")


def candidate_rows(left: DataFrame, right: DataFrame, a: str, b: str, threshold: float, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, a, b) of the pairs to compare, once for each way they meet; no pair of at least ``threshold`` is missing."""
    keys = list(keys)
    x, y = F.col(a), F.col(b)
    lx, ly = F.length(x), F.length(y)

    def plans(n: Column, found: Column, first: bool) -> Column:
        """For each partner's length: the pieces of the first name, how far they may shift and how many are to spare."""

        def plan(o: Column) -> Column:
            one, two = (n, o) if first else (o, n)
            total, in_x, in_y = _slack(one, two, threshold)
            parts = _pieces(one, two, threshold)
            fields = {"lx": one, "ly": two, "parts": parts, "back": in_x, "on": in_y, "spare": parts - total - 1}
            return F.struct(*[v.cast("int").alias(k) for k, v in fields.items()])

        return F.transform(found, plan)

    def spans(p: Column) -> Column:
        at = lambda i: F.floor(i * p["lx"] / p["parts"]).cast("int")
        return F.transform(F.sequence(F.lit(0), p["parts"] - 1), lambda i: F.struct(i.alias("i"), at(i).alias("at"), (at(i + 1) - at(i)).alias("size")))

    def pieces(p: Column) -> Column:
        piece = lambda s: F.substring(x, s["at"] + 1, s["size"]).alias("piece")
        return F.transform(spans(p), lambda s: F.struct(p["lx"].alias("lx"), p["ly"].alias("ly"), s["i"].alias("i"), piece(s), p["spare"].alias("spare")))

    def probes(p: Column) -> Column:
        def at(s: Column) -> Column:
            low, high = F.greatest(s["at"] - p["back"], F.lit(0)), F.least(s["at"] + p["on"], p["ly"] - s["size"])
            spots = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
            piece = lambda q: F.substring(y, q + 1, s["size"]).alias("piece")
            return F.transform(spots, lambda q: F.struct(p["lx"].alias("lx"), p["ly"].alias("ly"), s["i"].alias("i"), piece(q)))

        return F.flatten(F.transform(spans(p), at))

    def lengths(n: Column, few: bool, first: bool) -> Column:
        def fits(o: Column) -> Column:
            found = _few_taken_out(n, o, threshold) if first else _few_taken_out(o, n, threshold)
            return found if few else ~found

        return F.filter(_partner_lengths(n, threshold), fits)

    def exploded(df: DataFrame, name: str, found: Column) -> DataFrame:
        return df.filter(F.length(name) > 0).select(*keys, name, F.explode(found).alias("p")).select(*keys, name, "p.*")

    mine = exploded(left, a, F.flatten(F.transform(lengths(lx, True, True), lambda o: _variant_keys(x, o, threshold, True))))
    yours = exploded(right, b, F.flatten(F.transform(lengths(ly, True, False), lambda o: _variant_keys(y, o, threshold, False))))
    close = mine.join(yours, [*keys, "lx", "ly", "key"]).filter(x != y).select(*keys, a, b)
    same = left.filter(lx > 0).select(*keys, a).join(right.select(*keys, b, y.alias(a)), [*keys, a]).select(*keys, a, b)

    index = exploded(left, a, F.flatten(F.transform(plans(lx, lengths(lx, False, True), True), pieces)))
    probe = exploded(right, b, F.array_distinct(F.flatten(F.transform(plans(ly, lengths(ly, False, False), False), probes))))
    cols = [*keys, "lx", "ly", "i", "piece"]
    # A name's rarest pieces are kept; as many as may be spared go, so one of the kept ones is unchanged.
    index = index.withColumn("_often", F.count(F.lit(1)).over(Window.partitionBy(*cols)))
    rarest = Window.partitionBy(*keys, a, "ly").orderBy(F.desc("_often"), "i")
    index = index.withColumn("_at", F.row_number().over(rarest)).filter(F.col("_at") > F.col("spare"))
    return same.unionByName(close).unionByName(index.join(probe, cols).select(*keys, a, b))


def similar_pairs(
    left: DataFrame, right: DataFrame, a: str, b: str, threshold: float, keys: Sequence[str] = ()
) -> DataFrame:
    """Distinct (keys, a, b) with matching ratio of at least ``threshold``, plus the ratio.

    Exact for thresholds from 0.7 on; both sides must be distinct on (keys, name).
    """
    if threshold < MIN_THRESHOLD:
        raise ValueError(f"threshold below {MIN_THRESHOLD} would need all pairs")
    pairs = candidate_rows(left, right, a, b, threshold, keys).distinct()
    x, y = F.col(a), F.col(b)
    # The matching blocks can't hold more letters than the names share: most candidates never reach Python.
    shared = F.size(F.array_intersect(_letters(x), _letters(y)))
    pairs = pairs.filter(2.0 * shared >= threshold * (F.length(x) + F.length(y)) - 1e-9)
    return pairs.withColumn("ratio", matching_ratio(x, y)).filter(F.col("ratio") >= threshold)


def resolve_names(
    names: DataFrame,
    known: DataFrame,
    name: str,
    known_name: str,
    overrides: Mapping[str, str] = DISTRICT_OVERRIDES,
    threshold: float = 0.8,
) -> DataFrame:
    """Map each distinct name: exact, then override, then most similar, else itself.

    ``overrides`` maps the known spelling to the other one, both normalised.
    """
    asked = names.filter(F.col(name).isNotNull()).select(name).distinct().withColumn("_norm", normal_name(name))
    base = known.filter(F.col(known_name).isNotNull()).select(known_name).distinct()
    base = base.withColumn("_knorm", normal_name(known_name)).groupBy("_knorm").agg(F.max(known_name).alias("_known"))
    asked, base = saved(asked, "names"), saved(base, "names")
    reverse = {v: k for k, v in overrides.items()}
    swapped = asked.withColumn("_alias", mapped(F.col("_norm"), reverse, keep=False) if reverse else F.lit(None).cast("string"))
    exact = base.select(F.col("_knorm").alias("_norm"), F.col("_known").alias("_exact"))
    alias = base.select(F.col("_knorm").alias("_alias"), F.col("_known").alias("_override"))
    step = swapped.join(exact, "_norm", "left").join(alias, "_alias", "left")
    open_names = step.filter(F.col("_exact").isNull() & F.col("_override").isNull()).select("_norm").distinct()
    # The ratio is taken with the known name first, and the largest name wins a tie.
    close = similar_pairs(base.select("_knorm"), open_names, "_knorm", "_norm", threshold)
    best = close.groupBy("_norm").agg(F.max(F.struct("ratio", "_knorm")).alias("_best"))
    best = best.select("_norm", F.col("_best._knorm").alias("_knorm")).join(base, "_knorm").select(
        "_norm", F.col("_known").alias("_fuzzy")
    )
    out = step.join(best, "_norm", "left")
    method = (
        F.when(F.col("_exact").isNotNull(), "exact")
        .when(F.col("_override").isNotNull(), "override")
        .when(F.col("_fuzzy").isNotNull(), "fuzzy")
        .otherwise("unmatched")
    )
    return out.select(
        name, F.coalesce("_exact", "_override", "_fuzzy", name).alias("resolved"), method.alias("method")
    )


def apply_resolution(df: DataFrame, mapping: DataFrame, name: str) -> DataFrame:
    """Replace a name column through a mapping; unmapped names stay."""
    pairs = mapping.select(F.col(mapping.columns[0]).alias("_n"), "resolved")
    out = df.join(pairs, F.col(name) == F.col("_n"), "left")
    return out.withColumn(name, F.coalesce("resolved", name)).select(*df.columns)


def _by_turns(found: pa.Table) -> pa.Table:
    """The partner of each single of one district and year: in their order, each takes the best place still open."""
    rows = found.select(["_ord", "single", "ratio", "_mord", "multi"]).to_pylist()
    rows.sort(key=lambda r: (r["_ord"], r["single"], -r["ratio"], r["_mord"], r["multi"]))
    placed, taken = {}, set()
    for r in rows:
        if r["single"] not in placed and r["multi"] not in taken:
            placed[r["single"]] = r["multi"]
            taken.add(r["multi"])
    district = pa.repeat(found[0][0], len(placed))
    return pa.table([district, pa.array(placed.keys(), pa.string()), pa.array(placed.values(), pa.string())], names=["_d", "single", "multi"])


def match_across_years(
    rows: DataFrame, district: str, norm: str, year: str, order: str, threshold: float = 0.85
) -> DataFrame:
    """Town key of every (district, name, year).

    Names seen in one year join the most similar name of the district that was
    seen in several years but not in that one. Earlier rows choose first, and a
    (name, year) place is taken once. All places rank the names alike, so a name
    whose best place no earlier name could want has it at once; only names in
    conflict, with the places that are left, go by district and year to a task
    that lets them choose in turn, however long their chain is.
    """
    seen = saved(
        rows.groupBy(district, norm, year).agg(F.min(order).alias("_ord")), "towns"
    )
    per = seen.groupBy(district, norm).agg(
        F.count(F.lit(1)).alias("_n"), F.collect_set(year).alias("_years"), F.min("_ord").alias("_first")
    )
    single = seen.join(per.filter(F.col("_n") == 1).select(district, norm), [district, norm]).select(
        district, F.col(norm).alias("single"), F.col(year).alias("_y"), "_ord"
    )
    multi = per.filter(F.col("_n") >= 2).select(district, F.col(norm).alias("multi"), "_years", F.col("_first").alias("_mord"))
    close = similar_pairs(single.select(district, "single"), multi.select(district, "multi"), "single", "multi", threshold, [district])
    cand = close.join(single, [district, "single"]).join(multi, [district, "multi"])
    cand = cand.filter(~F.array_contains("_years", F.col("_y"))).drop("_years")
    mine = Window.partitionBy(district, "single").orderBy(F.desc("ratio"), "_mord", "multi")
    place = Window.partitionBy(district, "multi", "_y")
    claim = F.struct("_ord", "single")
    marked = cand.withColumn("_k", F.row_number().over(mine)).withColumn("_open", (F.col("_k") == 1) & (F.min(claim).over(place) == claim))
    # Whether the single, or the place, is settled by one of its pairs.
    marked = marked.withColumn("_settled", F.max("_open").over(Window.partitionBy(district, "single")) | F.max("_open").over(place))
    marked = saved(marked, "pairs")
    at_once = marked.filter("_open").select(F.col(district).alias("_d"), "single", "multi")
    kind = rows.schema[district].dataType.simpleString()
    in_turn = marked.filter(~F.col("_settled")).select(district, "_y", "_ord", "single", "ratio", "_mord", "multi")
    in_turn = in_turn.groupBy(district, "_y").applyInArrow(_by_turns, f"_d {kind}, single string, multi string")
    merged = at_once.unionByName(in_turn).select(F.col("_d").alias(district), F.col("single").alias(norm), F.col("multi").alias("_to"))
    out = seen.drop("_ord").join(merged, [district, norm], "left")
    return out.select(district, norm, year, F.coalesce("_to", norm).alias("town_key"))


def town_master(rows: DataFrame, district: str, norm: str, year: str, name: str, metrics: Sequence[str], years: Sequence[int]) -> DataFrame:
    """One row per exact (district, name) key with its years and metric_year columns."""
    at = [F.max(F.when(F.col(year) == y, F.col(m))).alias(f"{m}_{y}") for m in metrics for y in years]
    return rows.groupBy(district, norm).agg(
        F.min_by(name, year).alias("display_name"),
        F.min(year).alias("first_census"),
        F.count(F.lit(1)).alias("census_count"),
        F.array_join(F.array_sort(F.collect_list(year)).cast("array<string>"), ",").alias("census_years"),
        *at,
    )


def cross_check(a: DataFrame, b: DataFrame, a_name: str, b_name: str) -> DataFrame:
    """Names on one side only or differing in case; (name, status, similar).

    A name that only ``b`` has comes once with every name of ``a`` that starts
    with its first four letters (all of them, if it is shorter), or once with NULL.
    """
    left = a.select(F.col(a_name).alias("a")).distinct().withColumn("k", F.lower(F.trim("a")))
    right = b.select(F.col(b_name).alias("b")).distinct().withColumn("k", F.lower(F.trim("b")))
    both = left.join(right, "k", "full_outer")
    status = (
        F.when(F.col("b").isNull(), "missing")
        .when(F.col("a").isNull(), "extra")
        .when(F.col("a") != F.col("b"), "case_only")
    )
    odd = both.withColumn("status", status).filter(F.col("status").isNotNull())
    starts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda n: F.substring("k", F.lit(1), n)))
    hints = left.select(F.col("a").alias("similar"), F.explode(starts).alias("_p")).distinct()
    odd = odd.withColumn("_p", F.when(F.col("status") == "extra", F.substring("k", 1, 4)))
    return odd.join(hints, "_p", "left").select(F.coalesce("b", "a").alias("name"), "status", "similar")
