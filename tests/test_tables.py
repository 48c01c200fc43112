import hashlib
import json
import math
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumapanel.operators import checks as Q
from lumapanel.operators import observations as O
from lumapanel.operators import pixels as P
from lumapanel.session import saved, scratch_path, shared_dir
from lumapanel.sources import census as C
from lumapanel.sources import layers as Y
from lumapanel.sources import places as Z
from lumapanel.sources import sinks as K
from lumapanel.streaming.profiles import stream_monthly_sums


def test_quality_filters(spark):
    rows = [(-1.0, 1, 10), (2.0, 0, 10), (3.0, 1, 4), (4.0, 1, 5), (None, 1, 9), (5.0, None, 9)]
    px = spark.createDataFrame(rows, "med double, lit int, cf int")
    assert sorted(r.med for r in P.quality_filter(px).collect()) == [0.0, 4.0]
    assert sorted(r.med for r in P.site_quality_filter(px).collect()) == [-1.0, 4.0]
    assert P.quality_filter(px.select("med")).count() == 5
    with pytest.raises(ValueError):
        P.site_quality_filter(px.select("med"))


def test_nan_is_missing_after_alignment(spark):
    a = spark.createDataFrame([(2020, 0, 0, float("nan")), (2020, 0, 1, 3.0)], "yr int, r int, c int, med double")
    out = Y.align_layers({"med": a})
    assert sorted((r.med for r in out.collect()), key=str) == [3.0, None]


def test_empty_zone_stays(spark):
    px = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "zone string, med double")
    spine = spark.createDataFrame([("a",), ("b",)], "zone string")
    got = {r.zone: r for r in P.zonal_stats(px, ["zone"], "med", spine).collect()}
    assert (got["a"].mean_value, got["a"].median_value, got["a"].std_value, got["a"].pixel_count) == (2.0, 2.0, 1.0, 2)
    assert got["b"].pixel_count == 0 and got["b"].mean_value is None


def test_layer_files(spark):
    files = ["g/vcmslcfg.median_masked.tif", "a/vcmcfg.median_masked.tif", "x.avg_rade9h.tif", "x.cf_cvg.tif", "readme"]
    df = spark.createDataFrame([(2013, f) for f in files], "yr int, path string")
    got = {r.layer: r.path for r in Y.identify_layers(df).collect()}
    assert got == {"median": "a/vcmcfg.median_masked.tif", "average": "x.avg_rade9h.tif", "cf_cvg": "x.cf_cvg.tif"}


def test_pixel_table_round_trip_prunes_years(spark):
    path = scratch_path(spark, "px")
    px = spark.range(100).select((F.col("id") % 3 + 2010).cast("int").alias("yr"), F.col("id").cast("int").alias("r"), F.lit(0).alias("c"), F.lit(1.0).alias("med"))
    Y.write_pixels(px, path)
    got = Y.read_pixels(spark, path, [2011], box=(10, 40, 0, 5))
    assert sorted(r["r"] for r in got.collect()) == list(range(10, 41, 3))
    scan = next(line for line in got._jdf.queryExecution().toString().split("\n") if "FileScan" in line)
    assert re.search(r"PartitionFilters: \[[^]]*yr[^]]*2011", scan)
    assert "GreaterThanOrEqual(r,10)" in scan and "LessThanOrEqual(r,40)" in scan


def test_schema_checks(spark):
    rows = [("a", 2012, 1.0, 1.0, 5), (None, 1990, -1.0, 600.0, 0)]
    df = spark.createDataFrame(rows, "district string, year int, mean_radiance double, median_radiance double, pixel_count int")
    bad = Q.check_schema(df, Q.YEARLY, "s").collect()
    assert {b.column for b in bad} == {"district", "year", "mean_radiance", "median_radiance", "pixel_count"} and len(bad) == 5
    assert Q.check_schema(df.limit(0), Q.YEARLY, "s").first().check == "table is empty"
    assert Q.check_schema(None, Q.YEARLY, "s", spark).first().check == "table is missing"
    assert Q.check_schema(df.drop("year"), Q.YEARLY, "s").filter("check = 'column is missing'").count() == 1
    with pytest.raises(ValueError):
        Q.require_schema(df, Q.YEARLY, "s")
    assert Q.require_schema(df.limit(1), Q.YEARLY, "s").count() == 1


def obs(spark, rows):
    return spark.createDataFrame(rows, "species_key string, month int, lat double, lon double, individuals double")


def test_species_wrap_around(spark):
    rows = []
    for m in (11, 12, 1, 2, 3):
        rows += [("winter", m, 18.0, 73.0, None)] * 5
    for m in (4, 5):
        rows += [("spring", m, 18.0, 75.0, 2.0)] * 6
    for m in range(1, 13):
        rows += [("all", m, 19.0, 75.0, 1.0)] * 5
    rows += [("rare", 6, 18.0, 75.0, 1.0)] * 4
    prof = O.monthly_profiles(obs(spark, rows))
    got = {r.species_key: r for r in O.classify_species(prof).collect()}
    assert (got["winter"].migration_class, got["winter"].arrival_month, got["winter"].departure_month) == ("migratory", 11, 3)
    assert (got["spring"].migration_class, got["spring"].arrival_month, got["spring"].departure_month) == ("passage", 4, 5)
    assert got["all"].migration_class == "resident" and got["all"].arrival_month is None
    assert got["winter"].is_coastal and "rare" not in got and got["winter"].peak_month == 1
    winter = prof.filter("species_key = 'winter' and month = 11").first()
    assert winter.individual_sum == 5 and winter.norm_frequency == 0.5


def test_density_close_to_exact_kernel(spark):
    rng = np.random.default_rng(0)
    xy = rng.multivariate_normal([75, 18], [[1.0, 0.4], [0.4, 0.8]], 400)
    df = spark.createDataFrame([(1, float(y), float(x)) for x, y in xy] + [(2, 18.0, float(x)) for x in range(12)] + [(3, 1.0, 1.0)], "m int, lat double, lon double")
    box = {"west": 72.0, "east": 78.0, "south": 15.0, "north": 21.0}
    got = O.density_surface(df, "m", box, 13, 13).collect()
    cov = np.cov(xy.T) * 0.15**2
    inv, norm = np.linalg.inv(cov), 400 * 2 * math.pi * math.sqrt(np.linalg.det(cov))
    for r in got:
        if r.m == 1:
            d = np.array([72 + r.ix * 0.5, 15 + r.iy * 0.5]) - xy
            want = np.exp(-0.5 * np.einsum("ij,jk,ik->i", d, inv, d)).sum() / norm
            assert r.density == pytest.approx(want, rel=1e-9)
    assert all(r.density is None for r in got if r.m == 2) and not [r for r in got if r.m == 3]


def test_stream_equals_batch_and_resumes(spark):
    rows = [(f"s{i % 3}", i % 4 + 1, float(i % 7), float(i % 5), None if i % 6 == 0 else 2.0) for i in range(200)]
    df = obs(spark, rows)
    folder, state = scratch_path(spark, "in"), scratch_path(spark, "state")
    df.limit(120).coalesce(1).write.parquet(folder)
    run = lambda: stream_monthly_sums(spark, folder, df.schema, ["species_key", "month"], state)
    run()
    df.exceptAll(df.limit(120)).coalesce(1).write.mode("append").parquet(folder)
    got = {(r.species_key, r.month): tuple(r)[2:] for r in run().collect()}
    whole = spark.read.parquet(folder)
    want = {(r.species_key, r.month): tuple(r)[2:] for r in O.monthly_sums(whole, ["species_key", "month"]).collect()}
    assert got == want and whole.count() == 200
    again = {(r.species_key, r.month): tuple(r)[2:] for r in run().collect()}  # nothing new has arrived
    assert again == want


def test_batches_hold_changed_keys_and_repeat_safely(spark):
    folder, state = scratch_path(spark, "in"), scratch_path(spark, "state")
    parts = [obs(spark, [(f"s{i % 5}", 1, 1.0, 2.0, 1.0) for i in range(50)])]
    parts += [obs(spark, [(f"s{k}", 1, 3.0, 4.0, None)]) for k in (1, 1, 7)]
    run = lambda: stream_monthly_sums(spark, folder, parts[0].schema, ["species_key", "month"], state, compact_every=3)
    table = f"{state}-monthly_sums"
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(folder)
        got = sorted(map(tuple, run().collect()))
    want = sorted(map(tuple, O.monthly_sums(spark.read.parquet(folder), ["species_key", "month"]).collect()))
    assert got == want
    sizes = [spark.read.parquet(f"{table}/batch={n}").count() for n in range(4)]
    assert sizes == [5, 1, 1, 1] and spark.read.parquet(f"{table}/whole=2").count() == 5
    # The last batch is run again if its commit was lost.
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(state).getFileSystem(spark._jsc.hadoopConfiguration())
    assert fs.delete(jvm.Path(f"{state}/commits/3"), False)
    assert sorted(map(tuple, run().collect())) == want
    # A batch that broke off is not seen.
    spark.range(1).write.parquet(f"{table}/batch=9")
    fs.delete(jvm.Path(f"{table}/batch=9/_SUCCESS"), False)
    assert sorted(map(tuple, run().collect())) == want


def test_large_and_unchanged_files(spark, tmp_path):
    small, big = tmp_path / "a" / "small.bin", tmp_path / "a" / "big.tif"
    small.parent.mkdir()
    small.write_bytes(b"x" * 1000)
    with open(big, "wb") as f:  # a sparse file over the 2 GB that one value may have
        f.truncate((2 << 30) + 12_345)
    state = lambda known=None, block=256 << 20: {r["path"].rsplit("/", 1)[1]: r for r in Q.file_states(spark, str(tmp_path / "a"), known, block).collect()}
    first = state()
    assert first["big.tif"]["length"] == (2 << 30) + 12_345 and len({r["hash"] for r in first.values()}) == 2
    leaf = hashlib.sha256(b"x" * 1000).hexdigest()
    assert first["small.bin"]["hash"] == hashlib.sha256(f"{leaf}:1000".encode()).hexdigest()
    known = spark.createDataFrame(list(first.values()), "path string, length long, mtime timestamp, hash string")
    stat = os.stat(small)
    small.write_bytes(b"y" * 1000)
    os.utime(small, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    assert state(known)["small.bin"]["hash"] == first["small.bin"]["hash"]  # same size and time: not read
    os.utime(small, ns=(stat.st_atime_ns, stat.st_mtime_ns + 10**9))
    second = state(known)
    assert second["small.bin"]["hash"] != first["small.bin"]["hash"] and second["big.tif"]["hash"] == first["big.tif"]["hash"]
    # The last byte of the last block counts.
    with open(big, "r+b") as f:
        f.seek(-1, 2)
        f.write(b"z")
    assert state(known)["big.tif"]["hash"] != first["big.tif"]["hash"]


@pytest.mark.parametrize("range_bytes", [7, 64, 1000, 1 << 20])
def test_one_geojson_file_is_read_in_ranges(spark, tmp_path, range_bytes):
    n = 6 if range_bytes == 7 else 60
    names = [f'Zone {k} "x" {chr(92) * (k % 4)} {{[}}] é漢' for k in range(n)]
    ring = [[70.0, 10.0], [71.5, 10.0], [71.5, 11.25], [70.0, 10.0]]
    feats = []
    for k, name in enumerate(names):
        members = [("type", "Feature"), ("properties", {"dtname": name, "stname": "S", "note": [{"type": "Feature"}]})]
        members.append(("geometry", {"type": "Polygon", "coordinates": [[[x + k, y] for x, y in ring]]}))
        feats.append(dict(members[:: -1 if k % 2 else 1]))
    doc = {"name": 'a "b" {', "crs": {"type": "name", "properties": {"name": "x"}}, "features": feats, "bbox": [1, 2], "type": "FeatureCollection"}
    (tmp_path / "one.geojson").write_text(json.dumps(doc, indent=1 if range_bytes == 64 else None, ensure_ascii=range_bytes > 64), encoding="utf-8")
    (tmp_path / "two.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": feats[:1]}))
    got = Z.read_features(spark, str(tmp_path), range_bytes).collect()
    assert sorted(r["properties"]["dtname"] for r in got) == sorted(names + names[:1])
    first = json.loads(next(r["text"] for r in got if r["properties"]["dtname"] == names[3]))
    assert first == [[[x + 3, y] for x, y in ring]]
    if range_bytes == 1000:  # many tasks hold features of the one file
        parts = Z.feature_texts(spark, str(tmp_path / "one.geojson"), range_bytes).groupBy(F.spark_partition_id()).count()
        assert parts.count() >= 4


def test_documents_come_in_ordered_parts(spark, tmp_path):
    rows = spark.range(5000).selectExpr("CAST((id * 7919) % 5000 AS INT) AS rank", "concat('{\"k\":', (id * 7919) % 5000, '}') AS value").repartition(7)
    path = f"file://{tmp_path}/parts"
    K.write_document(spark, ['{"a":[', rows, '],"b":[', rows.filter("rank < 1"), '],"none":[', rows.filter("false"), "]}"], path)
    parts = sorted(p for p in (tmp_path / "parts").iterdir() if p.name.startswith("part-"))
    doc = json.loads("".join(p.read_text() for p in parts))
    assert [r["k"] for r in doc["a"]] == list(range(5000)) and doc["b"] == [{"k": 0}] and doc["none"] == []
    assert (tmp_path / "parts" / "_SUCCESS").exists()
    whole = K.join_document(spark, path, f"file://{tmp_path}/out/whole.json")
    assert whole.endswith("whole.json") and json.loads((tmp_path / "out" / "whole.json").read_text()) == doc
    assert [p.name for p in (tmp_path / "out").iterdir() if "crc" not in p.name] == ["whole.json"]


def test_large_keys_get_more_files(spark, tmp_path):
    rows = spark.range(2000).selectExpr("concat('n', id) AS name", "CASE WHEN id < 1500 THEN 'Big' WHEN id < 1510 THEN 'Small' WHEN id < 1990 THEN 'Copies' END AS district")
    rows = rows.withColumn("name", F.when(F.col("district") == "Copies", "same").otherwise(F.col("name")))
    dealt = K.in_sized_files(rows, ["district"], 100)
    assert dealt.exceptAll(rows).count() == 0 and dealt.count() == 2000
    K.write_places(rows.filter("district IS NOT NULL"), "district", str(tmp_path / "p"), rows_per_file=100)
    files = {d.name.split("=")[1]: len(list(d.glob("*.csv"))) for d in (tmp_path / "p").iterdir() if d.is_dir()}
    assert files["big"] >= 15 and files["small"] == 1 and files["copies"] == 5


def test_broken_dataset_is_reported(spark):
    good = spark.createDataFrame([("Pune", 10.0, 5.0)], "district string, TOT_P double, P_LIT double")
    loaded, failed = C.load_all({"census_2011": good, "census_2001": good.drop("district")}, spark.createDataFrame([("Pune",)], "district string"))
    df, messages = loaded["census_2011"]
    assert set(df.columns) == {"district", "c2011_TOT_P", "c2011_P_LIT", "c2011_literacy_rate"}
    assert messages.filter("message like 'Only 1 districts%'").count() == 1 and "census_2001" in failed


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == (named or shared_dir(spark))  # the same folder every time
    assert saved(spark.range(3)).count() == 3
