"""Boundaries, points of interest and geocoding candidates."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import number
from ..functions.geo import in_box
from ..functions.names import title_case
from ..session import saved
from .files import blocks, dealt, listed, located, pieces

# Property keys that may hold a region's or a zone's name.
REGION_KEYS = ("stname", "STNAME", "NAME_1", "name", "ST_NM", "state")
ZONE_KEYS = {
    "dtname": "district",
    "stname": "state",
    "dtcode11": "district_code",
    "stcode11": "state_code",
    "Dist_LGD": "district_lgd",
    "State_LGD": "state_lgd",
}

FEATURE = "type STRING, properties MAP<STRING, STRING>, geometry STRUCT<type: STRING, coordinates: STRING>"
RANGE_BYTES = 8 << 20

_QUOTE, _BACKSLASH = ord('"'), ord("\\")
_STEP = np.zeros(256, np.int8)  # how a byte outside a string changes the depth
_STEP[[ord("{"), ord("[")]], _STEP[[ord("}"), ord("]")]] = 1, -1
_FEATURE_DEPTH = 2  # inside the collection and its array of features


def _outside(data: np.ndarray, inside: bool, escaped: bool) -> tuple[np.ndarray, bool]:
    """Which bytes lie outside strings, and whether the stretch ends inside one."""
    quotes = np.flatnonzero(data == _QUOTE)
    slashes = data == _BACKSLASH
    if slashes.any() or escaped:
        # A quote after an odd run of backslashes is a character of its string.
        at = np.arange(len(data))
        plain = np.maximum.accumulate(np.where(~slashes, at, -1))
        run = np.where(quotes > 0, (quotes - 1) - plain[quotes - 1], 0)
        reaches = run == quotes  # the run goes back to the first byte
        quotes = quotes[(run + (reaches & escaped)) % 2 == 0]
    flips = np.zeros(len(data) + 1, np.int8)
    flips[quotes] = 1
    within = (np.cumsum(flips[:-1]) + inside) % 2 == 1  # the closing quote counts as outside
    return ~within, bool((len(quotes) + inside) % 2)


def _escaped(file: pa.NativeFile, start: int) -> bool:
    """Whether an odd number of backslashes stands before a place."""
    at, n = start, 0
    while at > 0:
        low = max(0, at - 64)
        file.seek(low)
        part = file.read(at - low)
        kept = len(part.rstrip(b"\\"))
        n += len(part) - kept
        if kept:
            break
        at = low
    return n % 2 == 1


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each range does to quotes and depth, both if it begins outside and inside a string."""
    for batch in batches:
        rows = []
        for path, start, size in zip(*(batch[c].to_pylist() for c in ("path", "start", "size")), strict=True):
            fs, name = located(path)
            with fs.open_input_file(name) as file:
                escaped = _escaped(file, start)
                data = np.frombuffer(b"".join(pieces(file, start, size)), np.uint8)
            ends = [_outside(data, inside, escaped) for inside in (False, True)]
            depth = [int(_STEP[data[out]].sum(dtype=np.int64)) for out, _ in ends]
            rows.append((ends[0][1], depth[0], depth[1]))
        flips, plain, within = zip(*rows, strict=True) if rows else ((), (), ())
        columns = {"path": batch["path"], "block": batch["block"], "start": batch["start"], "size": batch["size"], "length": batch["length"]}
        yield pa.RecordBatch.from_pydict(columns | {"flips": pa.array(flips, pa.bool_()), "plain": pa.array(plain, pa.int64()), "within": pa.array(within, pa.int64())})


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The objects at the features' depth that begin in each range, whole: the last one is read on to its end."""
    for batch in batches:
        for path, start, size, inside, depth in zip(*(batch[c].to_pylist() for c in ("path", "start", "size", "inside", "depth")), strict=True):
            fs, name = located(path)
            with fs.open_input_file(name) as file:
                escaped = _escaped(file, start)
                file.seek(start)
                data, more = file.read(size), size
                while True:
                    codes = np.frombuffer(data, np.uint8)
                    out, _ = _outside(codes, inside, escaped)
                    step = np.where(out, _STEP[codes], 0)
                    level = depth + np.cumsum(step, dtype=np.int64)
                    begins = np.flatnonzero((step == 1) & (level == _FEATURE_DEPTH + 1) & (codes == ord("{")))
                    ends = np.flatnonzero((step == -1) & (level == _FEATURE_DEPTH) & (codes == ord("}")))
                    begins = begins[begins < size]
                    last = np.searchsorted(ends, begins[-1]) if len(begins) else 0
                    if not len(begins) or last < len(ends):
                        break
                    further = file.read(more)  # twice as much every time
                    if not further:
                        raise ValueError(f"{path} ends inside a feature")
                    data, more = data + further, more * 2
            stops = ends[np.searchsorted(ends, begins)] + 1 if len(begins) else begins
            for low in range(0, len(begins), 256):
                cut = [data[a:b].decode() for a, b in zip(begins[low : low + 256], stops[low : low + 256], strict=True)]
                yield pa.RecordBatch.from_pydict({"value": pa.array(cut, pa.string())})


def feature_texts(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The text of every object in the arrays of GeoJSON collections, whatever the order of their members.

    A file is cut into byte ranges. One pass finds for each range what it does
    to open quotes and brackets; summed up in order, this says for every range
    whether it begins inside a string and how deep, so a second pass reads the
    features that begin in it. One large file is read by many tasks.
    """
    ranges, number = blocks(saved(listed(spark, path), "files"), range_bytes)
    schema = "path string, block long, start long, size long, length long, flips boolean, plain long, within long"
    found = saved(ranges.mapInArrow(_summaries, schema), "ranges")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    opened = found.withColumn("inside", F.coalesce(F.sum(F.col("flips").cast("int")).over(before), F.lit(0)) % 2 == 1)
    change = F.when(F.col("inside"), F.col("within")).otherwise(F.col("plain"))
    placed = opened.withColumn("_change", change).withColumn("depth", F.coalesce(F.sum("_change").over(before), F.lit(0)))
    return dealt(placed.select("path", "start", "size", "inside", "depth", "block"), number).mapInArrow(_texts, "value string")


def read_features(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per GeoJSON feature: properties and coordinate text."""
    feature = F.from_json("value", FEATURE).alias("f")
    rows = feature_texts(spark, path, range_bytes).select(feature).filter("f.type = 'Feature'")
    return rows.select(
        F.col("f.properties").alias("properties"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("text")
    )


def _polygons() -> Column:
    """Coordinates of both kinds as array<polygon<ring<point<double>>>>."""
    one = F.from_json("text", "array<array<array<double>>>")
    many = F.from_json("text", "array<array<array<array<double>>>>")
    return F.when(F.col("kind") == "Polygon", F.array(one)).otherwise(many)


def read_boundaries(spark: SparkSession, path: str, columns: Mapping[str, str] = ZONE_KEYS, zone: str = "district") -> DataFrame:
    """Rings of every zone: (zone, part, ring, vertices) and the other mapped properties; names are trimmed and title-cased."""
    feats = read_features(spark, path)
    sources = [k for k, v in columns.items() if v == zone] + [zone]
    name = F.coalesce(*[F.element_at("properties", F.lit(k)) for k in sources])
    feats = feats.withColumn("zone", title_case(F.trim(name)))
    if feats.filter(F.col("zone").isNotNull()).isEmpty():
        raise ValueError(f"no property among {sources} names the zones")
    others = list(dict.fromkeys(v for v in columns.values() if v != zone))
    held = {o: [F.element_at("properties", F.lit(k)) for k, v in columns.items() if v == o] for o in others}
    feats = feats.select("*", *[F.coalesce(*found).alias(o) for o, found in held.items()])
    parts = feats.select("zone", *others, F.posexplode(_polygons()).alias("part", "poly"))
    rings = parts.select("zone", *others, "part", F.posexplode("poly").alias("ring", "pts"))
    vertex = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    return rings.select("zone", *others, "part", "ring", F.transform("pts", vertex).alias("vertices"))


def region_name(keys: Sequence[str] = REGION_KEYS) -> Column:
    return F.coalesce(*[F.element_at("properties", F.lit(k)) for k in keys])


def extract_region(features: DataFrame, states: Sequence[str], keys: Sequence[str] = REGION_KEYS) -> DataFrame:
    """Features of the listed states, whatever their letter case."""
    wanted = [s.upper() for s in states]
    return features.withColumn("state_name", region_name(keys)).filter(F.upper("state_name").isin(wanted))


def missing_states(region: DataFrame, states: Sequence[str]) -> DataFrame:
    asked = region.sparkSession.createDataFrame([(s,) for s in states], "state string")
    return asked.join(region.select(F.upper("state_name").alias("_u")).distinct(), F.upper("state") == F.col("_u"), "left_anti")


def read_places(spark: SparkSession, folder: str) -> DataFrame:
    """All CSV files of a folder; rows without coordinates are dropped."""
    raw = spark.read.option("header", True).csv(folder)
    return raw.withColumns({"lat": number("lat"), "lon": number("lon")}).dropna(subset=["lat", "lon"])


def first_inside(items: DataFrame, candidates: DataFrame, key: str, ordinal: str, box: Mapping[str, float], margin: float = 0.0):
    """Per item the first candidate inside the box: status ok, fallback or failed."""
    good = candidates.filter(in_box(F.col("lat"), F.col("lon"), box, margin))
    best = good.groupBy(key).agg(F.min(F.struct(F.col(ordinal).alias("o"), "lat", "lon")).alias("b"))
    status = F.when(F.col("b").isNull(), "failed").when(F.col("b.o") == 0, "ok").otherwise("fallback")
    return items.select(key).distinct().join(best, key, "left").select(
        key, F.round("b.lat", 6).alias("lat"), F.round("b.lon", 6).alias("lon"), status.alias("geocode_status")
    )


def geocode_summary(places: DataFrame, district: str = "district") -> DataFrame:
    """Totals, coordinates, failures and success rate per district and overall (NULL district)."""
    n = F.count(F.lit(1))
    rows = places.rollup(district).agg(
        n.alias("total"), F.count("lat").alias("with_coords"), F.count_if(F.col("geocode_status") == "failed").alias("failed"),
        (F.count("lat") / n * 100.0).alias("success_pct"),
    )
    return rows


def projection_summary(master: DataFrame) -> DataFrame:
    """Towns by number of anchors."""
    return master.groupBy("census_count").agg(F.count(F.lit(1)).alias("towns"))
