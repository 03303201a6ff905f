"""JSON documents with explicit schemas; each file is one line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The documents' schemas.
_ALIGN = "struct<top:array<array<string>>,groups:array<array<string>>>"
ALIGNMENT = f"map<string,struct<overall:{_ALIGN},unodc:{_ALIGN}>>"
KEYNESS = "map<string,map<string,struct<words:array<array<string>>,bigrams:array<array<string>>>>>"
CARDS = "struct<who:map<string,string>,frags:map<string,array<string>>>"
_LABEL = "array<struct<t:int,x:double,y:double,n:bigint,alt:array<array<double>>>>"
LABELS = f"struct<fragments:{_LABEL},speeches:{_LABEL}>"


def read_json(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """(key, doc): one row a file; key is its name without ending."""
    name = F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1)
    return spark.read.text(path, wholetext=True).select(name.alias("key"), F.from_json("value", ddl).alias("doc"))


def alignment(spark: SparkSession, path: str) -> DataFrame:
    """(period, mode, unit, target_type, ord, target, pct, cos)."""
    each = read_json(spark, path, ALIGNMENT).select(F.col("key").alias("period"), F.explode("doc").alias("unit", "v"))
    modes = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(f"v.{m}").alias("r")) for m in ("overall", "unodc")])).alias("m")
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("target_type"), F.col(f"m.r.{k}").alias("rows")) for k in ("top", "groups")])).alias("k")
    rows = each.select("period", "unit", modes).select("period", "unit", "m.mode", kinds).select("period", "unit", "mode", "k.target_type", F.posexplode("k.rows").alias("ord", "t"))
    return rows.select("period", "mode", "unit", "target_type", "ord", F.col("t")[0].alias("target"), F.col("t")[1].cast("int").alias("pct"), F.col("t")[2].cast("double").alias("cos"))


def keyness(spark: SparkSession, path: str) -> DataFrame:
    """(lens, sel, period, kind, rank, term, z, n)."""
    each = read_json(spark, path, KEYNESS).select(F.col("key").alias("lens"), F.explode("doc").alias("sel", "v")).select("lens", "sel", F.explode("v").alias("period", "v"))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"v.{k}").alias("rows")) for k in ("words", "bigrams")])).alias("k")
    rows = each.select("lens", "sel", "period", kinds).select("lens", "sel", "period", "k.kind", F.posexplode("k.rows").alias("rank", "t"))
    return rows.select("lens", "sel", "period", "kind", (F.col("rank") + 1).alias("rank"), F.col("t")[0].alias("term"), F.col("t")[1].cast("double").alias("z"), F.col("t")[2].cast("int").alias("n"))


def cards(spark: SparkSession, path: str) -> DataFrame:
    """(unit, idx, lens_ids, conf, read, text)."""
    each = read_json(spark, path, CARDS).select(F.col("key").alias("unit"), F.explode("doc.frags").alias("idx", "f"))
    numbers = [F.from_json(F.col("f")[k], "array<int>").alias(n) for k, n in enumerate(("lens_ids", "conf", "read"))]
    return each.select("unit", F.col("idx").cast("int").alias("idx"), *numbers, F.col("f")[3].alias("text"))


def speakers(spark: SparkSession, path: str) -> DataFrame:
    """(unit, period, who)."""
    each = read_json(spark, path, CARDS).select(F.col("key").alias("unit"), F.explode("doc.who").alias("period", "who"))
    return each.select("unit", F.col("period").cast("int").alias("period"), "who")


def map_labels(spark: SparkSession, path: str) -> DataFrame:
    """(layer, topic, x, y, n, alt)."""
    doc = read_json(spark, path, LABELS)
    layers = [doc.select(F.lit(layer).alias("layer"), F.inline(f"doc.{layer}")) for layer in ("fragments", "speeches")]
    return layers[0].unionByName(layers[1]).withColumnRenamed("t", "topic")


def strings(spark: SparkSession, path: str) -> DataFrame:
    """(lang, texts map)."""
    return read_json(spark, path, "map<string,string>").select(F.col("key").alias("lang"), F.col("doc").alias("texts"))


def nested(spark: SparkSession, path: str, item: str) -> DataFrame:
    """(unit, period, ord, item) of documents {unit: {period: [item, ...]}}, as compositions and excerpts are."""
    each = read_json(spark, path, f"map<string,map<string,array<{item}>>>").select(F.explode("doc").alias("unit", "v"))
    rows = each.select("unit", F.explode("v").alias("period", "v"))
    return rows.select("unit", F.col("period").cast("int").alias("period"), F.posexplode("v").alias("ord", "item"))
