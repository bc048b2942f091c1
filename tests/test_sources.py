import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from samewise.operators import images as IM
from samewise.operators import vectors as V
from samewise.operators.images import describe
from samewise.plans.pipeline import Config
from samewise.session import cut, forget
from samewise.sources import io, xlsx
from samewise.sources import records as R
from samewise.streaming import incremental


def test_xlsx_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("k2", " 皂 & <b> ", None), ("k1", "", "x"), ("k3", None, None)], "sku_id string, name string, more string")
    path = str(tmp_path / "a.xlsx")
    assert xlsx.write(df, path, ["sku_id"]) == 3
    got = io.read_listings(spark, path)
    assert got.columns == ["row_ord", "sku_id", "name", "more"]
    assert [(r.sku_id, r.name, r.more) for r in got.orderBy("row_ord").collect()] == [("k1", None, "x"), ("k2", "皂 & <b>", None), ("k3", None, None)]
    with pytest.raises(ValueError):
        xlsx.write(df, path, ["sku_id"], most=2)


def test_tables(spark, tmp_path):
    assert io.read_previous(spark, None).count() == 0 and io.read_previous(spark, str(tmp_path / "none")).count() == 0
    g = spark.createDataFrame([("a", "g"), ("b", "g")], "sku_id string, group_id string")
    io.write_table(g, str(tmp_path / "g.csv"), one_file=True)
    assert io.read_previous(spark, str(tmp_path / "g.csv")).count() == 2
    listings = spark.createDataFrame([("a",), ("b",)], "sku_id string")
    io.validate_mapping(g, listings)
    with pytest.raises(ValueError, match="repeated"):
        io.validate_mapping(g.unionAll(g), listings)
    with pytest.raises(ValueError, match="1 missing"):
        io.validate_mapping(g.filter("sku_id = 'a'"), listings)
    assert io.content_hash(g) == io.content_hash(g.orderBy(F.desc("sku_id"))) != io.content_hash(g.unionAll(g))
    assert io.write_manifest(str(tmp_path / "m.json"), {"g": g})["g"]["rows"] == 2
    (tmp_path / "r.json").write_text(json.dumps({"metrics": {"recall": 1}}))
    assert io.read_report(spark, str(tmp_path / "r.json")).first().metrics.recall == 1
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(ValueError):
        io.read_report(spark, str(tmp_path / "bad.json"))
    s = spark.createDataFrame([("a", "b", 0.5, False, ["y", "x"], None), ("a", "c", None, True, ["x"], 0.1)], "sku_a string, sku_b string, score double, vetoed boolean, sources array<string>, embedding_cosine double")
    assert [(r.score, r.sources) for r in io.candidate_scores_table(s).collect()] == [("0.50000000", "x;y"), ("", "x")]
    assert io.Paths("r", "m").folder == "r/m" and io.Paths("r", "m", use_form=False).of("x") == "r/experiments/m-no-form/x"
    assert io.review_method(str(tmp_path / "none"), "f") == "f"
    (tmp_path / "l.csv").write_text("sku_a,sku_b,label,evidence\nb,a,1,e\na,b,1,e\n")
    assert [tuple(r) for r in io.read_label_pairs(spark, str(tmp_path / "l.csv")).collect()] == [("a", "b", 1, "e")]


def test_digests_export_and_order(spark, tmp_path):
    import hashlib

    (tmp_path / "in.csv").write_text("sku_id,sku_name_chi\na,x\nb,y\n")
    want = hashlib.sha256((tmp_path / "in.csv").read_bytes()).hexdigest()
    assert io.dataset_sha256(spark, str(tmp_path / "in.csv")) == want
    g = spark.createDataFrame([("b", "g2", "B"), ("a", "g1", "A")], "sku_id string, group_id string, group_name string")
    assert io.write_manifest(str(tmp_path / "m.json"), {"g": g}, {"input": str(tmp_path / "in.csv")})["input"]["sha256"] == want
    listings = io.read_listings(spark, str(tmp_path / "in.csv"))
    assert io.export_workbook(listings, g, str(tmp_path / "out.xlsx")) == 2
    rows = list(xlsx.rows(str(tmp_path / "out.xlsx")))
    assert rows[0][-2:] == ["group_id", "group_name"] and [r[-2] for r in rows[1:]] == ["g1", "g2"]
    with pytest.raises(ValueError, match="missing"):
        io.export_workbook(listings, g.limit(1), str(tmp_path / "out.xlsx"))
    io.check_order(listings, listings)
    with pytest.raises(ValueError, match="another place"):
        io.check_order(listings, listings.withColumn("sku_id", F.lit("a")))


def test_vector_cache_table(spark, tmp_path):
    class Fake(V.Embedder):
        name = "fake"

        def embed(self, texts):
            return [[float(len(t)), 1.0] for t in texts]

    df, path = spark.createDataFrame([("a", "x"), ("b", "yy")], "k string, t string"), str(tmp_path / "cache")
    with pytest.raises(ValueError, match="missing"):
        V.embed_cached(df, "k", "t", Fake(), path, offline=True)
    assert V.embed_cached(df.limit(1), "k", "t", Fake(), path).count() == 1 and V.embed_cached(df, "k", "t", Fake(), path).count() == 2
    assert spark.read.parquet(path).count() == 2 and V.embed_cached(df, "k", "t", Fake(), path, offline=True).count() == 2


def test_downloads(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x")
    (tmp_path / "cache").mkdir()
    urls = spark.createDataFrame([(f"file://{tmp_path}/a.bin",), (f"file://{tmp_path}/a.bin",), (f"file://{tmp_path}/none",), (None,), (" ",)], "url string")
    count = lambda **k: {(r.state, r.message): r.n for r in IM.download_counts(IM.download(urls, str(tmp_path / "cache"), **k)).collect()}
    assert count(allow=False) == {("failed", "download not allowed"): 2}
    assert count() == {("fetched", None): 1, ("failed", "URLError"): 1} and count() == {("hit", None): 1, ("failed", "URLError"): 1}


def test_a_broken_index_is_no_empty_index(spark, tmp_path):
    (tmp_path / "index").mkdir()
    (tmp_path / "index" / "part.parquet").write_text("no parquet")
    spark.createDataFrame([("a", "皂")], "sku_id string, sku_name_chi string").withColumn("loaded_at", F.current_timestamp()).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("sku_id string, sku_name_chi string, loaded_at timestamp").parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="(?i)parquet"):
        incremental.start(stream, str(tmp_path / "index"), str(tmp_path / "checkpoint")).awaitTermination()


def test_cut_keeps_rows_and_forgets(spark):
    t = cut(spark.range(3))
    assert t.count() == 3
    forget(t)
    with pytest.raises(Exception):
        spark.read.parquet(t._samewise_table).count()


def record(**x):
    return json.dumps({"unit": None, "pack_count": None, "formulation": None, "bundle_components": None} | x)


def test_records(spark):
    text = "玫瑰皂 125g 兩件裝 含12%月桂油 A皂 B皂"
    good = record(unit={"value": 125, "uom": "g", "evidence": "125 g"}, pack_count={"value": 2, "evidence": "兩件裝"}, formulation=[{"name": "月桂油", "pct": 12, "evidence": "12%月桂油"}, {"name": "x", "pct": 200, "evidence": "12%"}], bundle_components=[{"name": "A皂", "count": 4}, {"name": "B皂", "count": 2}])
    bad = record(unit={"value": 99, "uom": "g", "evidence": "125g"}, pack_count={"value": 3, "evidence": "三件"}, bundle_components=[{"name": "A皂", "count": 1}])
    clear = record(unit={"value": None, "uom": None, "evidence": None}, pack_count={"value": 2, "evidence": "兩件裝"})
    rows = spark.createDataFrame([("a", text, good), ("b", text, bad), ("c", text, clear), ("d", text, None)], "sku_id string, text string, json string")
    v = {r.sku_id: r for r in R.validate(R.parse(rows)).collect()}
    assert (v["a"].v_unit.value, v["a"].v_pack, v["a"].v_formulation) == (125.0, 2, {"月桂油": 12.0}) and [tuple(x) for x in v["a"].v_bundle] == [("A皂", 2), ("B皂", 1)]
    assert (v["b"].v_unit, v["b"].v_pack, v["b"].v_formulation, v["b"].v_bundle) == (None, None, None, None) and v["c"].v_unit_null and not v["d"].v_unit_null
    attrs = spark.createDataFrame([(k, 2.0, "pc", "name", 1) for k in "abcd"], "sku_id string, unit_value double, unit_uom string, unit_source string, pack_count int")
    after = R.apply_overrides(attrs, R.validate(R.parse(rows)))
    got = {r.sku_id: (r.unit_value, r.unit_source, r.pack_count) for r in after.collect()}
    assert got == {"a": (125.0, "record", 2), "b": (2.0, "name", 1), "c": (None, "record_cleared", 2), "d": (2.0, "name", 1)}
    n = R.override_counts(attrs, after).first()
    assert (n.units_changed, n.units_cleared, n.counts_changed, n.formulations, n.bundles) == (1, 1, 2, 1, 1)
    assert {tuple(r.t) for r in after.select(R.formulation_terms().alias("t")).collect()} == {("12%月桂油",), ()}


def test_extraction_cache_and_retries(spark):
    def call(text):
        if text == "bad":
            raise OSError("busy")
        return {"t": text}

    texts = spark.createDataFrame([("x",), ("x",), ("bad",), (None,)], "text string")
    first = R.extract(texts, call, "m", tries=2, wait=0.0).collect()
    assert sorted(r.json or "" for r in first) == ["", '{"t": "x"}']
    assert R.transient(OSError()) and not R.transient(ValueError())
    for status, again in ((429, True), (503, True), (400, False)):
        assert R.transient(type("E", (Exception,), {"status": status})()) is again
    cache = spark.createDataFrame([r for r in first if r.json], "text_hash string, json string")
    assert R.extract(texts, call, "m", cache, offline=True).count() == 1


def test_images_source(spark, tmp_path):
    import struct
    import zlib

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    pixels = np.zeros((16, 16, 3), np.uint8)
    pixels[:, 8:, 0] = 255
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 16, 16, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    got = describe(spark.read.format("image").load(str(tmp_path))).collect()
    assert len(got) == 1 and len(got[0].hue) == 32 and abs(got[0].hue[0] - 1) < 1e-6


def test_increments(spark, tmp_path):
    source, index = tmp_path / "in", str(tmp_path / "index")
    schema = "sku_id string, sku_name_chi string, loaded_at timestamp"
    for n, rows in enumerate([[("a", "玫瑰皂 90g"), ("b", "檸檬皂")], [("c", "玫瑰皂 100g"), ("a", "玫瑰皂 90g"), ("d", None)]]):
        spark.createDataFrame([(k, t) for k, t in rows], "sku_id string, sku_name_chi string").withColumn("loaded_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        incremental.start(incremental.first_deliveries(stream), index, str(tmp_path / "checkpoint")).awaitTermination()
    got = {r.sku_id: r.group_id for r in spark.read.parquet(index).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"] == got["c"] != got["b"]


def test_config_refuses_what_cannot_run(spark):
    for bad in (Config(method="x"), Config(method="lexical", records=spark.range(1)), Config(method="semantic")):
        with pytest.raises(ValueError):
            bad.check()
