"""Dumps in parts, tables by day, small tables, exports, text functions, streams."""

import gzip
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from waymark.functions import tables as table_functions
from waymark.functions import text
from waymark.operators import cohort, norm
from waymark.sources import days, dimensions, traces
from waymark.streaming import jobs


def tar(n: int) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for i in range(n):
            data = gzip.compress(json.dumps({"icao": f"a{i}", "trace": [[0, 1.0, 2.0, 3]] * 50}).encode())
            info = tarfile.TarInfo(f"x/trace_full_{i}.json")
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_parts_are_one_stream(spark, tmp_path):
    data = tar(40)
    for k, a in enumerate(range(0, len(data), 7_777)):
        (tmp_path / f"day1.tar.a{chr(97 + k)}").write_bytes(data[a : a + 7_777])
    (tmp_path / "day2.tar").write_bytes(tar(3))
    (tmp_path / "day3.tar").write_bytes(tar(5)[:2_000])
    rows = traces.members(spark, str(tmp_path)).collect()
    assert sum(not r["damaged"] for r in rows if "day1" in r["member"]) == 40 and sum("day2" in r["member"] for r in rows) == 3
    assert any(r["damaged"] and r["member"].endswith("day3.tar") for r in rows)
    spark.dataSource.register(traces.TraceFormat)
    paths = ",".join(f"file://{p}" for p in sorted(tmp_path.iterdir()) if "day3" not in p.name)
    again = spark.read.format("traces").option("paths", paths).load()
    assert again.count() == 43 and again.where("damaged").count() == 0
    stream = traces.Stream([f"file://{p}" for p in sorted(tmp_path.glob("day1*"))])
    assert stream.read() == data and stream.read_bytes == len(data)


def test_two_tables_share_their_numbers(spark, tmp_path):
    f = spark.createDataFrame([("d1", "b", 2), ("d1", "a", 1), ("d2", "c", 1)], "day string, icao string, n long")
    p = spark.createDataFrame([("d1", "a", 5.0), ("d1", "b", 2.0), ("d1", "b", 1.0), ("d2", "c", 3.0)], "day string, icao string, t double")
    schemas = StructType.fromDDL("day string, flight_id int, icao string, n long"), StructType.fromDDL("day string, flight_id int, t double")
    for _ in range(2):
        days.write_two(f, p, schemas, str(tmp_path / "out"), ["day", "icao"], "icao")
    flights, points = spark.read.parquet(str(tmp_path / "out/flights")), spark.read.parquet(str(tmp_path / "out/points"))
    assert sorted((r["day"], r["flight_id"], r["icao"]) for r in flights.collect()) == [("d1", 1, "a"), ("d1", 2, "b"), ("d2", 1, "c")]
    assert sorted((r["day"], r["flight_id"], r["t"]) for r in points.collect()) == [("d1", 1, 5.0), ("d1", 2, 1.0), ("d1", 2, 2.0), ("d2", 1, 3.0)]


def test_probe_reads_footers_and_names_bad_days(spark, tmp_path):
    spark.createDataFrame([("d1", 1), ("d2", 2), ("d3", 3)], "day string, x long").write.partitionBy("day").parquet(str(tmp_path / "t"))
    next((tmp_path / "t/day=d2").glob("*.parquet")).write_bytes(b"PAR1 not really")
    (tmp_path / "t/day=d4").mkdir()
    assert days.sound_days(spark, str(tmp_path / "t")) == (["d1", "d3"], ["d2", "d4"])
    rows, bad = days.read_days(spark, str(tmp_path / "t"))
    assert rows.count() == 2 and bad == ["d2", "d4"]


def test_exports_and_manifest(spark, tmp_path):
    days.bundle({"rows": spark.createDataFrame([(1, "x")], "a long, b string")}, str(tmp_path), "what this is")
    days.manifest(spark, str(tmp_path), {"levels": 11})
    assert spark.read.option("header", True).csv(str(tmp_path / "rows.csv.gz")).head()["b"] == "x" and spark.read.parquet(str(tmp_path / "rows.parquet")).count() == 1
    assert spark.read.text(str(tmp_path / "README")).head()[0] == "what this is" and json.loads((tmp_path / "_manifest.json").read_text()) == {"levels": 11}


def test_small_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("icao,lat,lon,name\nlimc,45.6,8.7,Milan\nbad,x,8\n,1,2,none\nLIRF,41.8,12.2\n")
    assert sorted(r["place"] for r in dimensions.airports(spark, str(tmp_path / "a.csv")).collect()) == ["LIMC", "LIRF"]
    for body in ({"factors": {"A320": 1.1, "B738": "x"}}, {"A320": 1.1}):
        (tmp_path / "f.json").write_text(json.dumps(body))
        assert [tuple(r) for r in dimensions.factors(spark, str(tmp_path / "f.json")).collect()] == [("A320", 1.1)]
    (tmp_path / "c.json").write_text(json.dumps({"types": {"A320": {"points": {"500": 10.0, "1500": 30.0, "2000": 45.0}}, "E170": {"points": {"250": 5.0, "750": 12.0}}}}))
    slopes = dimensions.consumption(spark, str(tmp_path / "c.json")).select("typecode", text.piecewise_slope(F.col("table")).alias("s")).collect()
    assert {r["typecode"]: r["s"] for r in slopes} == {"A320": 0.03, "E170": 0.014}
    docs = {"u1": b"[1, 2]", "u2": b"{broken", "u3": json.dumps([{"lat": 1.0, "x": 2}]).encode()}
    assert [tuple(r) for r in dimensions.fetched(spark, list(docs), "lat double, name string", docs.__getitem__).collect()] == [(1.0, None)]
    with pytest.raises(OSError):
        dimensions.fetched(spark, ["u1"], "lat double", docs.__getitem__)
    got = dimensions.downloaded("u", str(tmp_path / "d.bin"), lambda _: io.BytesIO(b"abc"))
    assert open(got, "rb").read() == b"abc" and not (tmp_path / "d.bin.part").exists()


def test_text_functions(spark):
    df = spark.createDataFrame([("<p>Caf&eacute; &amp; <b>ﬁn</b></p><script>x<y</script>", "HTTPS://WWW.Site.org/a/index.html?q=1#z", "Milan Malpensa International Airport", -0.3)], "m string, u string, n string, v double")
    r = df.select(text.plain(F.col("m")).alias("m"), text.canonical_url(F.col("u")).alias("u"), text.slug(F.col("n")).alias("s"), text.place_name(F.col("n")).alias("n"), text.signed(F.col("v")).alias("v"), text.escaped(F.lit("a<b & 'c'")).alias("e")).head()
    assert tuple(r) == ("Café & fin", "site.org/a", "milan-malpensa-international-airport", "Milan Malpensa", "0", "a&lt;b &amp; &#x27;c&#x27;")
    p = spark.createDataFrame([([(0.0, 1.0), (2.5, 3.04)],)], "p array<struct<x:double,y:double>>").select(text.polyline(F.col("p"))).head()[0]
    assert p == "0.0,1.0 2.5,3.0" and spark.range(1).select(text.scaled(F.lit(5.0), 0, 10, 100, 0)).head()[0] == 50


def test_table_functions(spark):
    table_functions.register(spark)
    r = spark.sql("SELECT * FROM gc_points(0.0D, 0.0D, 0.0D, 90.0D, 4)").orderBy("i").collect()
    assert [round(x["lon"], 6) for x in r] == [0, 30, 60, 90]
    assert spark.sql("SELECT count(*) AS n, sum(burn) AS kg FROM profile(800.0D, 34000.0D, 0.0D)").head()["kg"] > 0


def test_catching_up_repeats_to_the_same_days(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "day string, x long"
    for k in range(2):
        spark.createDataFrame([(f"d{k}", k), (f"d{k}", k + 10)], schema).coalesce(1).write.mode("append").parquet(source)
        jobs.catch_up(spark, source, StructType.fromDDL(schema), target, str(tmp_path / "mark")).awaitTermination(120)
    assert spark.read.parquet(target).count() == 4
    jobs.catch_up(spark, source, StructType.fromDDL(schema), target, str(tmp_path / "mark2")).awaitTermination(120)
    assert spark.read.parquet(target).count() == 4


def test_backfill_tries_again_and_leaves_known_days(spark):
    seen = []

    def run(day):
        seen.append(day)
        if day == "d2" and seen.count("d2") < 2 or day == "d1":
            raise OSError("no")

    assert jobs.backfill(["d1", "d2", "d3", "d4"], ["d3"], run) == {"d4": "done", "d3": "missing", "d2": "done", "d1": "failed: no"}
    assert seen == ["d4", "d2", "d2", "d1", "d1", "d1"]


def test_a_stream_keeps_the_points_that_it_should(spark, tmp_path):
    rows = [(1, i, i * 4.0, 40.0 + i * 0.004, 9.0, 0.0) for i in range(60)]
    rows[20] = (1, 20, 80.0, 80.0, 9.0, 0.0)
    for k in range(3):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], jobs.POINT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(jobs.POINT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.kept_points(stream, 1400.0, 10.0).writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = sorted(r["t"] for r in spark.table("kept").collect())
    last, want = None, []
    for r in rows:
        if r[3] < 79 and (last is None or r[2] - last >= 10):
            want.append(r[2])
            last = r[2]
    assert got == want


def test_days_wait_until_they_are_whole(spark):
    rows = [(d * 86400.0 + h * 3600,) for d, hours in ((0, 24), (1, 10), (2, 24), (3, 24)) for h in range(hours)]
    got = jobs.whole_days(spark.createDataFrame(rows, "t double"), 20).select(F.col("day").cast("string")).distinct().collect()
    assert sorted(r[0] for r in got) == ["1970-01-01", "1970-01-03"]


def test_guards_of_the_analysis_table(spark):
    rows = spark.createDataFrame([("d1", 1, 100.0, "A", 120.0, 100.0, 110.0), ("d2", 1, 100.0, "A", 130.0, 100.0, 110.0)], "day string, flight_id long, gc_km double, typecode string, real double, ideal double, hybrid double").withColumns({"total": F.lit(0.0), "lateral": F.lit(10.0), "vertical": F.lit(0.0)})
    none = spark.createDataFrame([], "typecode string, factor double")
    share = lambda *x: spark.createDataFrame([(d, 1, 0.1) for d in x], "day string, flight_id long, share double")
    got = {r["day"]: round(r["total"], 9) for r in norm.analysed(rows, share("d1", "d2"), none, 1).collect()}
    assert got == {"d1": 8.0, "d2": 17.0}
    with pytest.raises(ValueError):
        norm.analysed(rows, share("d1"), none, 1)
    with pytest.raises(ValueError):
        norm.one_to_one(rows, rows.union(rows), ["day", "flight_id"])
    assert not cohort.first_of(rows, "typecode", "day").where("day <> 'd1'").count()
