"""Readers on small files of the same shapes."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lenscube.sources import binary, documents
from lenscube.streaming import share as stream


def put(path, value):
    path.write_text(json.dumps(value))
    return str(path)


def test_json_documents(spark, tmp_path):
    align = {"AAA": {"overall": {"top": [["BBB", 97, 0.91], ["CCC", 50, 0.5]], "groups": [["g1", 12, 0.1]]}, "unodc": None}}
    got = documents.alignment(spark, put(tmp_path / "1999.json", align)).collect()
    assert sorted((r.period, r.mode, r.unit, r.target_type, r.ord, r.target, r.pct, r.cos) for r in got) == [
        ("1999", "overall", "AAA", "groups", 0, "g1", 12, 0.1), ("1999", "overall", "AAA", "top", 0, "BBB", 97, 0.91), ("1999", "overall", "AAA", "top", 1, "CCC", 50, 0.5),
    ]
    key = {"g1": {"all": {"words": [["w", 3.5, 9]], "bigrams": []}}}
    assert [tuple(r) for r in documents.keyness(spark, put(tmp_path / "lens.json", key)).collect()] == [("lens", "g1", "all", "words", 1, "w", 3.5, 9)]
    cards = {"who": {"1990": "X"}, "frags": {"4": [[2, 0], [7, 0], [0], "text"]}}
    path = put(tmp_path / "AAA.json", cards)
    assert [(r.unit, r.idx, r.lens_ids, r.conf, r.read, r.text) for r in documents.cards(spark, path).collect()] == [("AAA", 4, [2, 0], [7, 0], [0], "text")]
    assert [tuple(r) for r in documents.speakers(spark, path).collect()] == [("AAA", 1990, "X")]
    labels = {"fragments": [{"t": 1, "x": 0.5, "y": 0.25, "n": 9, "alt": [[0.1, 0.2]]}], "speeches": []}
    assert [(r.layer, r.topic, r.n) for r in documents.map_labels(spark, put(tmp_path / "l.json", labels)).collect()] == [("fragments", 1, 9)]
    parts = {"AAA": {"1990": [[3, 0.5], [1, 0.25]]}}
    assert [(r.unit, r.period, r.ord, r.item) for r in documents.nested(spark, put(tmp_path / "c.json", parts), "array<double>").collect()] == [("AAA", 1990, 0, [3.0, 0.5]), ("AAA", 1990, 1, [1.0, 0.25])]
    assert documents.strings(spark, put(tmp_path / "en.json", {"a": "b"})).first().texts == {"a": "b"}


def test_binary_tables(spark, tmp_path):
    cube = np.full((2, 3, 2), np.nan, "<f4")
    cube[1, 2, 0], cube[1, 2, 1] = 0.5, 0.75
    (tmp_path / "s.bin").write_bytes(cube.tobytes())
    assert sorted(tuple(r) for r in binary.shares(spark, str(tmp_path / "s.bin"), 2, 3, 1, 1946).collect()) == [(1, 1948, 0, 0.5), (1, 1948, 1, 0.75)]
    (tmp_path / "n.bin").write_bytes(np.array([[0, 65535, 0], [1, 0, 0]], "<u2").tobytes())
    assert sorted(tuple(r) for r in binary.counts(spark, str(tmp_path / "n.bin"), 2, 3, 1946).collect()) == [(0, 1947, 65535), (1, 1946, 1)]
    columns = [("c", "uint8"), ("lensmask", "uint16"), ("yr", "uint8"), ("topic", "uint8"), ("x", "uint16"), ("y", "uint16")]
    data = [np.array(v, binary.TYPES[k]) for (_, k), v in zip(columns, ([3, 4], [513, 0], [1, 2], [7, 8], [0, 65535], [0, 65535]))]
    (tmp_path / "p.bin").write_bytes(b"".join(x.tobytes() for x in data))
    got = sorted(tuple(r) for r in binary.points(spark, str(tmp_path / "p.bin"), 2, columns, 1946).collect())
    assert got == [(0, 3, 513, 1947, 7, 0.0, 1.0), (1, 4, 0, 1948, 8, 1.0, 0.0)]


def test_lazy_reads_once_and_never_again_after_a_failure(spark, tmp_path):
    asked = []

    def read(path):
        asked.append(path)
        return spark.read.parquet(path)

    lazy = binary.Lazy(read)
    assert lazy.want(str(tmp_path / "none")) is None and lazy.want(str(tmp_path / "none")) is None and len(asked) == 1


def test_lazy_finds_a_file_that_breaks_off_at_load(spark, tmp_path):
    (tmp_path / "short.bin").write_bytes(b"123")
    lazy = binary.Lazy(lambda path: binary.counts(spark, path, 2, 2, 1946))
    assert lazy.want(str(tmp_path / "short.bin")) is None and list(lazy.failed) == [str(tmp_path / "short.bin")]
    (tmp_path / "whole.bin").write_bytes(bytes([1, 0, 0, 0, 2, 0, 0, 0]))
    assert lazy.want(str(tmp_path / "whole.bin")).count() == 2


def test_load_all_raises_if_one_fails(spark, tmp_path):
    got = binary.load_all({"a": lambda: spark.range(3), "b": lambda: spark.range(2)})
    assert {k: v.count() for k, v in got.items()} == {"a": 3, "b": 2}
    with pytest.raises(Exception, match="none"):
        binary.load_all({"a": lambda: spark.range(3), "b": lambda: spark.read.parquet(str(tmp_path / "none"))})


def test_partitioned_lookup_reads_one_folder(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "v int, lens string")
    binary.by_lens(df, str(tmp_path / "t"), "lens")
    back = spark.read.parquet(str(tmp_path / "t")).where("lens = 'a'")
    assert sorted(r.v for r in back.collect()) == [1, 3] and "PartitionFilters: [isnotnull(lens" in back._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("late", ["1 day"])
def test_stream_gives_the_batch_cube(spark, tmp_path, late):
    from lenscube import queries

    sf = "/root/testdata/sf0.001"
    src = spark.read.parquet(f"{sf}/events.parquet")
    kind = F.col("event_type")
    rows = src.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("unit"), F.when(kind == "purchase", 1).when(kind == "signup", 2).when(kind == "error", 4).otherwise(0).alias("mask"))
    rows.write.parquet(str(tmp_path / "in"))
    live = stream.stream_cells(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), 3, late)
    q = live.writeStream.outputMode("complete").format("memory").queryName("cells").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.unit, r.period, r.lens): round(r.share, 6) for r in stream.shares_of(spark.table("cells")).collect()}
    assert got == {(r.unit, r.period, r.lens): r.share for r in queries.QUERIES["q_share_cube"](spark, sf).collect()}
