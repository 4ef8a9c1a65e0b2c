"""XML, flattening and layouts against counts and rows worked out by hand."""

import gzip
import json
from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeweave.functions import scalars
from lodeweave.operators import flatten, geo, layout, metrics, ml
from lodeweave.sources import config, generate, tables, xml
from lodeweave.sources.schemas import CAR, FLAT10, FLAT31, FLAT_DATE31, NESTED


def parsed(spark, text, **k):
    return xml.parse_xml(spark.createDataFrame([(text,)], "x string"), "x", **k)


def test_repeated_ids_and_wrappers(spark):
    r = parsed(spark, "<record><id>1</id><id>x</id><id>2</id><tags><tag>t1</tag></tags><tags><tag> t2 </tag></tags></record>")
    row = r.first()
    assert row.id == [1, 2] and row.tags == ["t1", "t2"] and row.readings is None
    flat = flatten.partial_cartesian(r).collect()
    assert len(flat) == 4 and {f.id for f in flat} == {1, 2} and {f.tag for f in flat} == {"t1", "t2"}


def test_bad_numbers_vanish_and_last_good_reading_value_wins(spark):
    r = parsed(spark, "<record><id>5.7</id><name>n</name><value>5d</value><value>2.5</value><readings><reading><timestamp>a</timestamp><timestamp>b</timestamp><value>1</value><value>bad</value></reading><reading></reading></readings></record>").first()
    assert r.id is None and r.name == ["n"] and r.value == [2.5]
    assert [tuple(x) for x in r.readings] == [("b", None, 1.0)]


def test_entities_cdata_and_empty_records(spark):
    r = parsed(spark, "<record><name>a &amp; b</name><category><![CDATA[c<d]]></category></record>").first()
    assert r.name == ["a & b"] and r.category == ["c<d"]
    assert parsed(spark, "<record></record>").count() == 0 and parsed(spark, "<record></record>", keep_empty=True).count() == 1


def test_missing_parts_have_their_defaults(spark):
    row = flatten.partial_cartesian(parsed(spark, "<record><name>n</name></record>")).first()
    assert (row.id, row.tag, row.name, row.reading_value) == (0, "", "n", None)


def test_xml_files_and_gzip(spark, tmp_path):
    body = "<records>" + "".join(f"<record><id>{i}</id></record>" for i in range(5)) + "</records>"
    (tmp_path / "a.xml").write_text(body)
    with gzip.open(tmp_path / "b.xml.gz", "wt") as f:
        f.write(body)
    assert xml.read_xml(spark, str(tmp_path)).count() == 10
    (tmp_path / "a.xml").write_text("<records><record><id>1</id><name></record></records>")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        xml.read_xml(spark, str(tmp_path / "a.xml"), mode="FAILFAST").collect()


def test_union_gives_168_rows_of_the_generated_record(spark):
    assert flatten.union(generate.nested(spark, 3)).count() == 3 * 168
    assert flatten.union(generate.nested(spark, 1)).columns == list(FLAT31)


def nested_rows(spark, counts):
    """One record with so many ids, tags, readings; measurements of m methods; regions per location; leaves per statistic."""
    ids, tags, readings, methods, regions, stats = counts
    row = {
        "id": list(range(ids)) or None, "name": ["n"], "value": [1.5], "category": None, "tags": [f"t{i}" for i in range(tags)], "meta_created": None, "meta_updated": ["u"],
        "readings": [{"timestamp": "t", "sensor": "s", "value": 1.0}] * readings,
        "measurements": [{"type": "a", "data": "b", "method": [{"max": 1, "min": 0, "hash": 0.5}] * m} for m in methods],
        "locations": [{"lat": 1.0, "lon": 2.0, "region": [{"h3_cell": "c", "country_code": "US", "region_ID": [{"region_hash": "h", "region_id": "i"}] * k} for k in r]} for r in regions],
        "statistics": [{"mean": 1, "mode": 2, "range": 3, "physics": [{"velocity": 1.0, "acceleration": 1.0, "mass": 1.0}] * p, "history": [{"previous": "p", "trend": "t"}] * h, "business": [{"revenue": 1.0, "outlook": "o"}] * b} for p, h, b in stats],
    }
    return spark.createDataFrame([row], NESTED)


few = st.integers(0, 2)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.tuples(few, few, few, st.lists(few, max_size=2), st.lists(st.lists(few, max_size=2), max_size=2), st.lists(st.tuples(few, few, few), max_size=2)))
def test_row_counts_follow_the_formulas(spark, counts):
    ids, tags, readings, methods, regions, stats = counts
    df = nested_rows(spark, counts)
    one = lambda n: max(1, n)
    places = sum(sum(one(k) for k in r) if r else 1 for r in regions)
    assert flatten.partial_cartesian(df).count() == one(ids) * one(tags) * one(readings)
    assert flatten.union(df).count() == one(readings + sum(map(one, methods)) + places + sum(map(sum, stats)) + tags)
    assert flatten.cartesian(df).count() == one(ids) * one(tags) * one(readings) * one(sum(map(one, methods))) * one(places) * one(sum(one(p) * one(h) * one(b) for p, h, b in stats))


def test_childless_statistic_gives_one_row_of_scalars(spark):
    df = nested_rows(spark, (1, 0, 0, [], [], [(0, 0, 0)]))
    row = flatten.union(df).collect()
    assert len(row) == 1 and row[0].stat_mean is None and row[0].value == 1.5
    assert flatten.union(df, strict=True).first().value is None
    assert flatten.cartesian(df).first().stat_mean == 1


def test_cars(spark):
    rows = [("red", 1, 1.0, [(1, 2, 3.0)] * 2, None, [(1, True)] * 3), ("blue", 1, 1.0, None, None, None)]
    out = flatten.cars(spark.createDataFrame(rows, CAR))
    assert out.groupBy("color").count().collect().__len__() == 2 and out.count() == 7


def test_schemas_have_31_columns():
    assert len(FLAT31) == len(FLAT_DATE31) == 31 and len(FLAT10) == 10


def test_morton_of_low_bits_is_constant_and_of_high_bits_is_not(spark):
    cells = ["831c6ffffffffff", "831c0ffffffffff", "831c5ffffffffff"]
    df = spark.createDataFrame([(c, 20250505) for c in cells], "c string, d int").withColumn("day", F.lit("2025-05-05").cast("date"))
    rows = df.select(layout.morton_ref(F.col("c"), F.col("d")).alias("r"), layout.morton_cell(F.col("c"), F.col("day")).alias("k")).collect()
    assert {r.r for r in rows} == {4294961899} and len({r.k for r in rows}) == 3
    bad = spark.createDataFrame([("zz",), ("no hex",)], "c string").select(layout.cell_bits(F.col("c")).alias("b")).collect()
    assert all(0 <= r.b < 1 << 16 for r in bad)


def test_partitioned_files_manifest_and_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None, 5.0), (None, "a", None, 6.0), (1, None, "x", 7.0)] * 3, "id int, name string, category string, v double")
    path = str(tmp_path / "t")
    layout.write_partitioned(df, path, {"id": "unknown", "name": "unknown", "category": "unknown"}, max_rows=2, salts=2)
    found = layout.files(spark, path).collect()
    assert {tuple(sorted(f.partition_values.items())) for f in found} >= {(("category", "unknown"), ("id", "1"), ("name", "a"))}
    assert all(f.size > 0 and not f.data_change for f in found) and spark.read.parquet(path).count() == 9
    layout.create_table(spark, "made", path, ("id", "name", "category"))
    assert spark.table("made").where("category = 'x'").count() == 3
    spark.sql("DROP TABLE made")
    row = spark.createDataFrame([(None, "a", None, None)], "id int, name string, category string, value int").select(layout.partition_path(layout.FILE_KEYS).alias("p")).first()
    assert row.p == "id=unknown/name=a/category=unknown/value=unknown.parquet"


def test_zorder_rewrite_and_cells(spark, tmp_path):
    df = spark.range(200).select(F.concat(F.lit("831c"), F.lower(F.hex(F.col("id") % 16)), F.lit("ffffffffff")).alias("h3_res3"), F.date_add(F.lit("2025-01-01").cast("date"), (F.col("id") % 30).cast("int")).alias("date_id"), "id")
    layout.write_parquet(df, str(tmp_path / "a"), version="v2")
    done = layout.zorder_rewrite(spark, str(tmp_path / "a"), str(tmp_path / "b"), partitions=4)
    assert done["files_removed"] >= 1 and done["files_added"] >= 2 and spark.read.parquet(str(tmp_path / "b")).count() == 200
    layout.write_cells(df, str(tmp_path / "c"))
    one = tables.cell(spark, str(tmp_path / "c"), "831c0ffffffffff")
    assert one.count() == 13 and "PartitionFilters: [isnotnull(h3" in one._jdf.queryExecution().toString()
    assert tables.scan(spark, str(tmp_path / "c")).count() == 200


def test_average_precision_and_auc(spark):
    df = spark.createDataFrame([(0.9 - 0.1 * i, y) for i, y in enumerate([1, 0, 1, 0, 1, 0])], "s double, y int")
    for bins in (1, 3, 1024):
        r = metrics.ranking(df, "s", "y", bins).first()
        assert round(r.average_precision, 5) == 0.75556 and round(r.roc_auc, 5) == 0.66667 and r.event_rate == 0.5
    tied = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.5, 0)], "s double, y int")
    r = metrics.ranking(tied, "s", "y").first()
    assert r.roc_auc == 0.5 and round(r.average_precision, 6) == 0.333333


def test_top_fraction_is_rounded_up(spark):
    df = spark.createDataFrame([("t", f"c{i}", float(i), i % 2) for i in range(6)], "timestamp string, h3_cell string, s double, y int")
    rows = {r.frac: r for r in metrics.topk_metrics(df, "s", "y", (0.05, 0.5)).collect()}
    assert rows[0.05].k_count == 1 and rows[0.5].k_count == 3 and rows[0.5].tp_at_k == 2
    for bad in ((0.0,), (1.5,), ()):
        with pytest.raises(ValueError, match="fractions"):
            metrics.topk_metrics(df, "s", "y", bad)


def test_required_columns(spark):
    with pytest.raises(ValueError, match="missing columns: label"):
        tables.as_predictions(spark.createDataFrame([("c", "t", 1.0)], "h3_cell string, timestamp string, prediction double"))


def test_k_ring(spark):
    edges = spark.createDataFrame([(i, (i + 1) % 8) for i in range(8)] + [((i + 1) % 8, i) for i in range(8)], "src long, dst long")
    start = spark.createDataFrame([(0,)], "cell long")
    assert {r.cell for r in geo.k_ring(start, edges).collect()} == {7, 0, 1}
    assert {r.cell for r in geo.restrict(geo.k_ring(start, edges, 2), spark.createDataFrame([(2,), (5,)], "cell long")).collect()} == {2}


def test_experiments():
    runs = ml.experiments()
    assert len(runs) == 34 and len({r["name"] for r in runs}) == 34
    shared = [n for n in ml.distinct_runs(runs).values() if "baseline" in n]
    assert len(ml.distinct_runs(runs)) < 34 and {"depth_8", "eta_0.05", "spw_1", "mcw_1", "maxbin_256", "colsample_0.5"} <= set(shared[0])


def test_training_and_evaluation(spark, tmp_path):
    rows = spark.range(400).select((F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("id") % 180).cast("int"))).cast("timestamp_ntz").alias("timestamp"), F.lit("c").alias("h3_res3"), ((F.col("id") * 37 % 100) / 100.0).alias("a__sum_1h"), (F.col("id") % 3).alias("a__count_1h"))
    rows = rows.withColumn(ml.LABEL, (F.col("a__sum_1h") > 0.5).cast("int"))
    data = ml.dataset(rows)
    assert {r.split for r in data.select("split").distinct().collect()} == {"train", "val", "test"}
    model = ml.train(data, {"max_depth": 2, "max_bin": 32}, rounds=3, path=str(tmp_path / "m"))
    found = ml.evaluate(model, data, ml.feature_names(rows.columns), str(tmp_path / "run"), {"max_depth": 2})
    assert found["roc_auc"] > 0.95 and found["importances"][0][0] == "a__sum_1h"
    assert json.loads((tmp_path / "run" / "metrics.json").read_text())["n"] == found["n"]
    with pytest.raises(RuntimeError, match="no rows"):
        ml.dataset(rows.where("false"))


def test_config_store_and_log(tmp_path):
    (tmp_path / "c.toml").write_text('data_dirs = ["a", "b"]\nnum_threads = 4\n')
    assert config.load_config(str(tmp_path / "c.toml")) == config.EtlConfig(["a", "b"], 4, None)
    (tmp_path / "d.toml").write_text("num_threads = 4\n")
    with pytest.raises(ValueError, match="data_dirs"):
        config.load_config(str(tmp_path / "d.toml"))
    env = {"AWS_ENDPOINT_URL": "http://h:9000", "AWS_ACCESS_KEY_ID": "k", "AWS_SECRET_ACCESS_KEY": "s", "MINIO_BUCKET": "b"}
    store = config.ObjectStore.from_env(env)
    assert store.hadoop()["spark.hadoop.fs.s3a.connection.ssl.enabled"] == "false" and "'s'" not in repr(store)
    with pytest.raises(ValueError, match="AWS_ACCESS_KEY_ID"):
        config.ObjectStore.from_env({"AWS_ENDPOINT_URL": "x"})
    log = config.logger(str(tmp_path / "logs"), "lodeweave.test", {"LOG_LEVEL": "debug"})
    log.debug("line")
    assert "line" in (tmp_path / "logs" / "lodeweave.test.log").read_text()


def test_scalars(spark):
    row = spark.createDataFrame([(" 12 ", "1e3", "5d", "ff", "-3.7")], "a string, b string, c string, d string, e string").select(
        scalars.to_int(F.col("a")), scalars.to_double(F.col("b")), scalars.to_double(F.col("c")), scalars.hex_to_long(F.col("d")), scalars.to_int(F.col("e")), scalars.ratio(F.lit(1), F.lit(0)), scalars.clip(F.lit(None).cast("double"), -1.0, 1.0), scalars.hex_to_long(F.lit("ffffffffffffffff")))
    assert tuple(row.first()) == (12, 1000.0, None, 255, None, None, None, -1)


def test_scores_and_metric_files(spark, tmp_path):
    from lodeweave.operators import opscore
    from lodeweave.plans.roles import horizons

    scored = opscore.run(horizons(spark, "/root/testdata/sf0.001"))
    paths = opscore.write(scored, str(tmp_path / "out.parquet"), (0.05, 0.5))
    assert paths[1].endswith("out.metrics_top0.0500.parquet") and spark.read.parquet(paths[2]).count() > 0
    assert {"ewma_1hr", "ewma_long_1hr", "z_long_1hr", "seg_len", "ops_score"} <= set(scored.columns)


def test_sources_do_not_need_the_text_part():
    import subprocess
    import sys

    code = "import sys; sys.modules['lodeweave.llm'] = None; import lodeweave.plans.registry as r; assert len(r.QUERIES) > 60"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])


def test_a_record_is_parsed_once(spark):
    frame = spark.createDataFrame([("<record><id>1</id></record>",)], "x string")
    plan = flatten.partial_cartesian(xml.parse_xml(frame, "x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml") == 1


def test_key_files_and_log(spark, tmp_path):
    rows = [(1, "a b", None, 5), (1, "a b", None, 5), (2, None, "c", None)]
    df = spark.createDataFrame(rows, "id int, name string, category string, value int")
    listed = {r.path: r.rows for r in layout.write_key_files(df, str(tmp_path / "k"), layout.FILE_KEYS).collect()}
    assert listed == {"id=1/name=a b/category=unknown/value=5.parquet": 2, "id=2/name=unknown/category=c/value=unknown.parquet": 1}
    import pyarrow.parquet as pq

    held = pq.ParquetFile(tmp_path / "k" / "id=1/name=a b/category=unknown/value=5.parquet")
    assert held.metadata.num_rows == 2 and held.metadata.row_group(0).column(0).statistics is not None and held.metadata.row_group(0).column(0).compression == "SNAPPY"
    layout.write_partitioned(df, str(tmp_path / "t"), {"category": "unknown"})
    adds = layout.create_log(spark, str(tmp_path / "t"), ("category",), "made").collect()
    lines = [json.loads(x) for x in (tmp_path / "t/_delta_log/00000000000000000000.json").read_text().splitlines()]
    assert [next(iter(x)) for x in lines] == ["protocol", "metaData"] + ["add"] * len(adds)
    assert lines[1]["metaData"]["partitionColumns"] == ["category"]
    assert all((tmp_path / "t" / a.path).stat().st_size == a.size and a.partitionValues["category"] in a.path and a.dataChange is False for a in adds)
    with pytest.raises(FileExistsError):
        layout.create_log(spark, str(tmp_path / "t"))


def test_run_over_all_folders(spark, tmp_path):
    from lodeweave.plans import etl

    for k in range(2):
        (tmp_path / f"day{k}").mkdir()
        with gzip.open(tmp_path / f"day{k}" / "x.xml.gz", "wt") as f:
            f.write(f"<records><record><id>{k}</id><category>c{k}</category></record></records>")
    (tmp_path / "c.toml").write_text(f'data_dirs = ["{tmp_path}/day0", "{tmp_path}/day1"]')
    adds = etl.run(spark, config.load_config(str(tmp_path / "c.toml")), str(tmp_path / "out")).collect()
    assert {a.partitionValues["category"] for a in adds} == {"c0", "c1"}
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1]


def test_schema_of_a_sample(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "s"))
    assert tables.schema_of(spark, str(tmp_path / "s")).simpleString() == "struct<id:bigint>"


def test_quantiles_and_ranking_of_crowded_values(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = np.concatenate([np.exp(-rng.exponential(8, 3000)), np.zeros(1500), [1e9]])
    frame = spark.createDataFrame([(float(v), int(v > 0.1)) for v in x], "x double, y int")
    r = metrics.quantiles(frame, ["x"], bins=16).first()
    assert np.allclose([r["min"], r.p01, r.p50, r.p99, r["max"]], [x.min(), *np.quantile(x, [0.01, 0.5, 0.99]), x.max()], rtol=1e-12)
    assert metrics.ranking(frame, "x", "y", bins=16).first().roc_auc == 1.0
