from quillon.sources import avro, iceberg


def test_avro_round_trip(tmp_path):
    schema = {"type": "record", "name": "r", "fields": [{"name": "a", "type": "long"}, {"name": "b", "type": ["null", "string"]}, {"name": "c", "type": {"type": "array", "items": "double"}}, {"name": "m", "type": {"type": "map", "values": "boolean"}}]}
    rows = [{"a": -(2**40), "b": None, "c": [], "m": {}}, {"a": 7, "b": "é", "c": [1.5, -2.0], "m": {"k": True}}]
    for codec in ("null", "deflate"):
        avro.write_file(str(tmp_path / "f"), schema, rows, codec=codec)
        assert list(avro.read_file(str(tmp_path / "f"))) == rows
    assert avro.decode(avro.encode(rows[1], schema, 9), schema) == rows[1]


def test_murmur3():
    # values that the format's specification gives for its bucket hash
    assert iceberg.murmur3(b"iceberg") == 1210000089 and iceberg.murmur3((34).to_bytes(8, "little")) == 2017239379


def test_iceberg(spark, tmp_path):
    at = str(tmp_path / "t")
    rows = [("sp", 2024, "a", 1), ("sp", 2024, "b", 2), ("sp", 2023, "c", 3), ("mg", 2024, "d", 4)]
    first = iceberg.write(spark.createDataFrame(rows, "s string, y int, c string, v long"), at, ["s", "bucket[4](v)"])
    iceberg.append(spark.createDataFrame([("ba", 2024, "e", 5, True)], "s string, y int, c string, v long, ok boolean"), at)
    assert iceberg.read(spark, at).count() == 5 and iceberg.read(spark, at, snapshot=first).count() == 4
    assert iceberg.read(spark, at, {"s": "sp", "y": 2024}).count() == 2
    assert [r["c"] for r in iceberg.read(spark, at, {"v": 4}).collect()] == ["d"]
    assert iceberg.delete(spark, at, {"s": "sp", "y": 2024}) == 2 and iceberg.delete(spark, at, {"s": "zz"}) == 0
    assert sorted(r["c"] for r in iceberg.read(spark, at).collect()) == ["c", "d", "e"]
    iceberg.optimize(spark, at)
    assert sorted((r["c"], r["ok"]) for r in iceberg.read(spark, at).collect()) == [("c", None), ("d", None), ("e", True)]
    assert iceberg.vacuum(at) == 1  # the delete file of the deletion that found nothing
    assert iceberg.read(spark, at).count() == 3


def test_equality_deletes(spark, tmp_path):
    at = str(tmp_path / "t")
    iceberg.write(spark.createDataFrame([(1, "a", None), (2, "b", 1.5), (3, "a", None), (4, None, 2.0)], "n int, k string, v double"), at, ["truncate[2](n)"])
    assert iceberg.delete(spark, at, {"k": "a", "v": None}, "equality") == 2 and iceberg.delete(spark, at, {"k": "zz"}, "equality") == 0
    iceberg.append(spark.createDataFrame([(5, "a", None), (6, "b", 0.0)], "n int, k string, v double"), at)  # later rows aren't deleted
    assert iceberg.delete(spark, at, {"n": 6}) == 1 and iceberg.delete(spark, at, {"k": None}, "equality") == 1
    assert sorted(r["n"] for r in iceberg.read(spark, at).collect()) == [2, 5] and iceberg.read(spark, at, {"n": 5}).count() == 1 and iceberg.read(spark, at, {"n": 4}).count() == 0
    iceberg.optimize(spark, at)
    assert sorted(r["n"] for r in iceberg.read(spark, at).collect()) == [2, 5]


def test_metadata_of_other_writers(spark, tmp_path):
    """No hint file, URIs, a second spec whose fields are known by source id only, no private keys."""
    import json

    import pyarrow.parquet as pq

    at = str(tmp_path / "t")
    iceberg.write(spark.createDataFrame([(1, "a b"), (2, "c")], "n int, k string"), at, ["k"])
    meta = json.loads((tmp_path / "t/metadata/v1.metadata.json").read_text())
    assert all(not key.startswith("_") for spec in meta["partition-specs"] for f in spec["fields"] for key in f)
    file = next((tmp_path / "t/data").rglob("*.parquet"))
    assert {f.metadata[b"PARQUET:field_id"] for f in pq.read_schema(file)} == {b"1", b"2"}
    meta["partition-specs"].insert(0, {"spec-id": 7, "fields": []})
    for s in meta["snapshots"]:
        s["manifest-list"] = "file://" + s["manifest-list"]
    (tmp_path / "t/metadata/00002-x.metadata.json").write_text(json.dumps(meta))
    for old in ("version-hint.text", "v1.metadata.json"):
        (tmp_path / "t/metadata" / old).unlink()
    assert [r["n"] for r in iceberg.read(spark, at, {"k": "a b"}).collect()] == [1] and iceberg.exists(at)
