"""The registered queries of the text cube on the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lenscube.functions import scalars
from lenscube.operators import align, clusters, cube, evaluate, names, points, quotes, text, windows
from lenscube.plans import params
from lenscube.sources import binary, documents, shared

LENSES = ("purchase", "signup", "error")
TOPICS = ("purchase", "signup", "error", "ALL", "view", "click")
P = params.QueryParams(5, 12, (1, 30))

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Shared pieces of the SQL.
_E = """e AS (SELECT event_id, user_id AS unit, CAST(day(ts) AS INT) AS period, event_type, value,
  CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'error' THEN 4 ELSE 0 END AS mask FROM events)"""
_SHARE = f"""{_E}, share AS (
  SELECT unit, period, 0 AS lens, avg(CASE WHEN mask & 1 <> 0 THEN 1.0 ELSE 0 END) AS share FROM e GROUP BY 1, 2
  UNION ALL SELECT unit, period, 1, avg(CASE WHEN mask & 2 <> 0 THEN 1.0 ELSE 0 END) FROM e GROUP BY 1, 2
  UNION ALL SELECT unit, period, 2, avg(CASE WHEN mask & 4 <> 0 THEN 1.0 ELSE 0 END) FROM e GROUP BY 1, 2
  UNION ALL SELECT unit, period, 3, avg(CASE WHEN mask <> 0 THEN 1.0 ELSE 0 END) FROM e GROUP BY 1, 2)"""
_MEMBERS = """members AS (
  SELECT DISTINCT 'div3' AS sel, 0 AS slot, user_id AS unit FROM events WHERE user_id % 3 = 0
  UNION ALL SELECT DISTINCT 'div5', 1, user_id FROM events WHERE user_id % 5 = 0
  UNION ALL SELECT DISTINCT 'div10', 2, user_id FROM events WHERE user_id % 10 = 0)"""
_MEANS = f"""{_SHARE}, {_MEMBERS},
  means AS (SELECT unit, lens, avg(share) AS v FROM share WHERE period BETWEEN 5 AND 12 GROUP BY 1, 2),
  grp AS (SELECT sel, slot, lens, avg(v) AS v FROM means JOIN members USING (unit) GROUP BY 1, 2, 3),
  world AS (SELECT lens, avg(v) AS world FROM means GROUP BY 1)"""


def query(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    mask = F.when(kind == "purchase", 1).when(kind == "signup", 2).when(kind == "error", 4).otherwise(0)
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("unit"), F.dayofmonth("ts").alias("period"), "event_type", "value", mask.alias("mask"))


def share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.share_cube(events(spark, sf_dir), len(LENSES))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "events").select(F.col("user_id").alias("unit")).distinct()
    u = F.col("unit")
    return params.bridge(units, {"div3": u % 3 == 0, "div5": u % 5 == 0, "div10": u % 10 == 0})


def means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.unit_mean(share(spark, sf_dir), P.within("period"))


def r6(c: str, places: int = 6) -> F.Column:
    return F.round(c, places).alias(c)


@query("q_share_cube", f"WITH {_SHARE} SELECT unit, period, lens, round(share, 6) AS share FROM share")
def share_cube(spark, d):
    return share(spark, d).select("unit", "period", "lens", r6("share"))


@query("q_partition_lookup", f"WITH {_SHARE} SELECT unit, period, round(share, 6) AS share FROM share WHERE lens = 3")
def partition_lookup(spark, d):
    path = shared.folder(spark, "shares")
    binary.by_lens(share(spark, d), path, "lens")
    return spark.read.parquet(path).where("lens = 3").select("unit", "period", r6("share"))


@query("q_share_probability", f"WITH {_E} SELECT unit, period, event_type AS lens, round(avg(value), 6) AS share FROM e GROUP BY 1, 2, 3")
def share_probability(spark, d):
    p = events(spark, d).withColumnRenamed("event_type", "lens")
    return cube.share_from_probability(p, "value").select("unit", "period", "lens", r6("share"))


@query("q_unit_mean", f"WITH {_MEANS} SELECT unit, lens, round(v, 6) AS v FROM means")
def unit_mean(spark, d):
    return means(spark, d).select("unit", "lens", r6("v"))


@query("q_group_mean", f"WITH {_MEANS} SELECT sel, lens, round(v, 6) AS v FROM grp")
def group_mean(spark, d):
    return cube.group_mean(means(spark, d), members(spark, d)).select("sel", "lens", r6("v"))


@query("q_world_mean", f"WITH {_MEANS} SELECT lens, round(world, 6) AS world FROM world")
def world_mean(spark, d):
    return cube.world_mean(means(spark, d)).select("lens", r6("world"))


@query("q_ratio_world", f"WITH {_MEANS} SELECT sel, lens, round(v, 6) AS v, round(world, 6) AS world, round(CASE WHEN v >= 0.0005 AND world > 0 THEN v / world END, 6) AS ratio FROM grp JOIN world USING (lens)")
def ratio_world(spark, d):
    m = means(spark, d)
    return cube.ratio_to_world(cube.group_mean(m, members(spark, d)), cube.world_mean(m)).select("sel", "lens", r6("v"), r6("world"), r6("ratio"))


@query("q_scaled_max", f"WITH {_MEANS} SELECT lens, round(CASE WHEN greatest(max(world), max(v)) > 0 THEN greatest(max(world), max(v)) * 1.15 ELSE 1 END, 6) AS top FROM grp JOIN world USING (lens) GROUP BY 1")
def scaled_max(spark, d):
    m = means(spark, d)
    both = cube.ratio_to_world(cube.group_mean(m, members(spark, d)), cube.world_mean(m))
    top = F.greatest(F.max("world"), F.max("v"))
    return both.groupBy("lens").agg(F.round(F.when(top > 0, top * 1.15).otherwise(1.0), 6).alias("top"))


@query("q_trend", f"""WITH {_SHARE}, {_MEMBERS}, own AS (SELECT unit, period, share FROM share WHERE lens = 3),
  s AS (SELECT sel AS series, period, share FROM own JOIN members USING (unit) UNION ALL SELECT 'world', period, share FROM own),
  grid AS (SELECT series, period FROM (SELECT DISTINCT sel AS series FROM members UNION ALL SELECT 'world') CROSS JOIN (SELECT CAST(range AS INT) AS period FROM range(1, 31)))
  SELECT g.series, g.period, round(avg(s.share), 6) AS v FROM grid g LEFT JOIN s USING (series, period) GROUP BY 1, 2""")
def trend(spark, d):
    days = params.periods(spark, params.QueryParams(1, 30, (1, 30)))
    return cube.trend(share(spark, d), members(spark, d), days, 3).select("series", "period", r6("v"))


_PARTS = f"""{_E}, cell AS (SELECT unit, period, count(*) AS n FROM e GROUP BY 1, 2),
  parts AS (SELECT e.unit, e.period, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'error' THEN 2 WHEN 'view' THEN 4 ELSE 5 END AS topic, count(*) / max(n) AS share
    FROM e JOIN cell USING (unit, period) GROUP BY 1, 2, 3),
  comp AS (SELECT unit, topic, sum(share) / max(k) AS share, min(period * 10 + topic) AS seen FROM parts JOIN (SELECT unit, count(*) AS k FROM cell GROUP BY 1) USING (unit) GROUP BY 1, 2)"""


def composition_of(spark, d):
    e = events(spark, d)
    topic = F.array_position(F.array(*[F.lit(t) for t in TOPICS]), F.col("event_type")) - 1
    each = e.groupBy("unit", "period", topic.alias("topic")).agg(F.count("*").alias("k"))
    cells = each.groupBy("unit", "period").agg(F.sum("k").alias("n"))
    parts = each.join(cells, ["unit", "period"]).withColumn("share", F.col("k") / F.col("n")).withColumn("ord", F.col("topic"))
    return cube.composition(parts, cells)


@query("q_composition", f"WITH {_PARTS} SELECT unit, topic, round(share, 6) AS share FROM comp")
def composition(spark, d):
    return composition_of(spark, d).select("unit", "topic", r6("share"))


@query("q_json_composition", f"""WITH {_PARTS} SELECT unit, period, row_number() OVER (PARTITION BY unit, period ORDER BY topic) - 1 AS ord, topic, round(share, 6) AS share FROM parts""")
def json_composition(spark, d):
    """Compositions written as JSON documents {unit: {period: [[topic, share], ...]}} and read back."""
    e = events(spark, d)
    topic = (F.array_position(F.array(*[F.lit(t) for t in TOPICS]), F.col("event_type")) - 1).alias("topic")
    each = e.groupBy("unit", "period", topic).agg(F.count("*").alias("k"))
    item = F.struct("topic", (F.col("k") / F.sum("k").over(Window.partitionBy("unit", "period"))).alias("share"))
    cells = each.select("unit", "period", item.alias("i")).groupBy("unit", "period").agg(F.array_sort(F.collect_list("i")).alias("v"))
    items = F.transform("v", lambda i: F.array(i["topic"].cast("string"), i["share"].cast("string")))
    unit = cells.groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct(F.col("period").cast("string"), items))).alias("v"))
    entries = F.map_from_entries(F.collect_list(F.struct(F.col("unit").cast("string"), F.col("v"))))
    doc = unit.groupBy(F.floor(F.col("unit") / 64)).agg(F.to_json(entries).alias("value")).select("value")  # a document has 64 units
    path = shared.folder(spark, "composition")
    doc.write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)
    back = documents.nested(spark, path, "array<string>")
    return back.select(F.col("unit").cast("long").alias("unit"), "period", "ord", F.col("item")[0].cast("int").alias("topic"), F.round(F.col("item")[1].cast("double"), 6).alias("share"))


@query("q_topn_others", f"""WITH {_PARTS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY round(share, 9) DESC, seen) AS ord FROM comp),
  top AS (SELECT * FROM ranked WHERE ord <= 3), shaded AS (SELECT unit, ord, topic, share, (row_number() OVER (PARTITION BY unit, topic < 3 ORDER BY ord) - 1) % 2 AS shade FROM top),
  rest AS (SELECT unit, 1 - sum(share) AS share FROM top GROUP BY 1)
  SELECT unit, ord, topic, round(share, 6) AS share, shade FROM shaded UNION ALL SELECT unit, 4, -1, round(share, 6), NULL FROM rest WHERE share > 0.0005""")
def topn_others(spark, d):
    return cube.top_and_others(composition_of(spark, d), 3, 3).select("unit", "ord", "topic", r6("share"), "shade")


def excerpts(spark, d):
    e = events(spark, d)
    return e.select("unit", "period", F.col("value").alias("p"), F.col("event_id").alias("ord"), F.col("event_id").alias("key"), "event_type", "mask")


_RANKED = f"""{_E}, {_MEMBERS}, c AS (SELECT sel, slot, unit, period, event_id, value, row_number() OVER (PARTITION BY sel ORDER BY value DESC, period DESC, event_id) AS rank
  FROM e JOIN members USING (unit) WHERE event_type = 'purchase')"""


@query("q_candidates", f"WITH {_RANKED} SELECT sel, rank, event_id, period, round(value, 6) AS p FROM c WHERE rank <= 20")
def candidates(spark, d):
    found = quotes.candidates(excerpts(spark, d).where("event_type = 'purchase'"), members(spark, d), 20)
    return found.select("sel", "rank", F.col("key").alias("event_id"), "period", r6("p"))


@query("q_round_robin", f"""WITH {_RANKED},
  a AS (SELECT * FROM c WHERE slot = 0 ORDER BY rank LIMIT 1),
  b AS (SELECT * FROM c WHERE slot = 1 AND event_id NOT IN (SELECT event_id FROM a) ORDER BY rank LIMIT 1),
  f AS (SELECT * FROM c WHERE slot = 2 AND event_id NOT IN (SELECT event_id FROM a UNION ALL SELECT event_id FROM b) ORDER BY rank LIMIT 1)
  SELECT 1 AS pick, sel, event_id FROM a UNION ALL SELECT 2, sel, event_id FROM b UNION ALL SELECT 3, sel, event_id FROM f""")
def round_robin(spark, d):
    pools = quotes.pools(excerpts(spark, d).where("event_type = 'purchase'"), members(spark, d))
    return quotes.round_robin(pools, 3).select("pick", "sel", F.col("key").alias("event_id"))


@query("q_first_per_lens", f"""WITH {_MEANS}, lensed AS (SELECT *, CASE mask WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS lens FROM e WHERE mask <> 0),
  best AS (SELECT *, row_number() OVER (PARTITION BY unit, lens ORDER BY value DESC, period DESC, event_id) AS n FROM lensed),
  o AS (SELECT b.unit, b.lens, b.event_id, row_number() OVER (PARTITION BY b.unit ORDER BY round(coalesce(m.v, 0), 9) DESC, b.lens) AS rank
    FROM best b LEFT JOIN means m ON m.unit = b.unit AND m.lens = b.lens WHERE b.n = 1)
  SELECT unit, lens, event_id, rank FROM o WHERE rank <= 3""")
def first_per_lens(spark, d):
    lens = F.when(F.col("mask") == 1, 0).when(F.col("mask") == 2, 1).otherwise(2)
    own = excerpts(spark, d).where("mask <> 0").withColumn("lens", lens)
    m = means(spark, d).withColumn("lens", F.col("lens").cast("int"))
    return quotes.best_per_lens(own, m).select("unit", "lens", F.col("key").alias("event_id"), "rank")


@query("q_chosen_first", f"""WITH {_E}, l AS (SELECT DISTINCT unit, period, CASE mask WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS lens FROM e WHERE mask <> 0)
  SELECT unit, period, lens, row_number() OVER (PARTITION BY unit, period ORDER BY lens = 1 DESC, lens) AS rank FROM l""")
def chosen_first(spark, d):
    lens = F.when(F.col("mask") == 1, 0).when(F.col("mask") == 2, 1).otherwise(2)
    rows = events(spark, d).where("mask <> 0").select("unit", F.col("period").alias("idx"), lens.alias("lens")).distinct().withColumn("pos", F.col("lens"))
    return quotes.chosen_first(rows, 1).select("unit", F.col("idx").alias("period"), "lens", "rank")


_SMALL = f"""{_MEMBERS}, small AS (SELECT unit, arg_min(slot, n * 10 + slot) AS slot FROM members JOIN (SELECT slot, count(*) AS n FROM members GROUP BY 1) USING (slot) GROUP BY 1)"""


@query("q_smallest_selection", f"WITH {_SMALL} SELECT unit, slot FROM small")
def smallest_selection(spark, d):
    return points.smallest_selection(members(spark, d))


@query("q_outline", f"""WITH {_MEMBERS}, s AS (SELECT slot, count(*) AS n FROM members GROUP BY 1), t AS (SELECT slot, n, row_number() OVER (ORDER BY n DESC, slot) AS layer FROM s)
  SELECT slot, unit, n, layer FROM members JOIN t USING (slot)""")
def outline(spark, d):
    return points.outline(members(spark, d)).select("slot", "unit", "n", "layer")


@query("q_layer_class", f"""WITH {_E}, {_SMALL} SELECT layer, count(*) AS n FROM (SELECT CASE WHEN period NOT BETWEEN 5 AND 12 THEN -1 WHEN slot IS NULL THEN 0
  WHEN mask & 1 <> 0 THEN 4 - slot ELSE 1 END AS layer FROM e LEFT JOIN small USING (unit)) GROUP BY 1""")
def layer_class(spark, d):
    placed = events(spark, d).join(points.smallest_selection(members(spark, d)), "unit", "left")
    layer = points.layer_of_regions(P.within("period"), F.col("slot"), F.col("mask"), 0)
    return placed.groupBy(layer.alias("layer")).agg(F.count("*").alias("n"))


@query("q_layer_unit", f"""WITH {_E} SELECT CASE WHEN period NOT BETWEEN 5 AND 12 THEN -1 WHEN unit <> 7 THEN 0 WHEN mask <> 0 THEN 2 ELSE 1 END AS layer, count(*) AS n FROM e GROUP BY 1""")
def layer_unit(spark, d):
    layer = points.layer_of_unit(P.within("period"), F.col("unit") == 7, F.col("mask"))
    return events(spark, d).groupBy(layer.alias("layer")).agg(F.count("*").alias("n"))


@query("q_speech_mask", f"WITH {_E} SELECT unit, period, bit_or(mask) AS mask FROM e GROUP BY 1, 2")
def speech_mask(spark, d):
    e = events(spark, d).withColumn("x", F.col("value")).withColumn("y", F.col("value"))
    return points.speeches(e).select("unit", "period", "mask")


@query("q_mask_names", f"""WITH {_E}, m AS (SELECT unit, period, bit_or(mask) AS mask FROM e GROUP BY 1, 2)
  SELECT unit, period, array_to_string(list_slice(list_filter([CASE WHEN mask & 1 <> 0 THEN 'purchase' END, CASE WHEN mask & 2 <> 0 THEN 'signup' END, CASE WHEN mask & 4 <> 0 THEN 'error' END], lambda x: x IS NOT NULL), 1, 2), ' · ') AS names FROM m""")
def mask_names(spark, d):
    return speech_mask(spark, d).select("unit", "period", F.array_join(scalars.lens_names(F.col("mask"), list(LENSES)), " · ").alias("names"))


@query("q_parent_mask", f"WITH {_E} SELECT CASE WHEN mask & 2 <> 0 THEN mask | 1 ELSE mask END AS mask, count(*) AS n FROM e GROUP BY 1")
def parent_mask(spark, d):
    return events(spark, d).groupBy(scalars.with_parents(F.col("mask"), {1: 0}).alias("mask")).agg(F.count("*").alias("n"))


@query("q_local_index", """SELECT event_id, user_id AS unit, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS local, min(event_id) OVER (PARTITION BY user_id) AS start FROM events""")
def local_index(spark, d):
    e = events(spark, d).withColumnRenamed("event_id", "idx")
    starts = points.unit_starts(e, e.select("unit").distinct())
    return points.local_index(e).join(starts, "unit").select(F.col("idx").alias("event_id"), "unit", "local", "start")


_HISTORY = [(0, 0, 1995, 1996, "OLD_A"), (0, 1, 1996, 1998, "OLD_B"), (3, 0, 1990, 1997, "OLD_C"), (7, 0, 1998, 1998, "OLD_D"), (7, 1, 1995, 2001, "OLD_E")]


@query("q_hist_name", f"""WITH h(unit, ord, first, last, old) AS (VALUES {", ".join(str(x) for x in _HISTORY)}),
  o AS (SELECT c_nationkey AS unit, year(o_orderdate) AS period, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
  f AS (SELECT o.unit, o.period, arg_min(old, ord) AS old FROM o JOIN h ON h.unit = o.unit AND o.period BETWEEN first AND last GROUP BY 1, 2)
  SELECT o.unit, o.period, coalesce(old, n_name) AS label, n FROM o JOIN nation ON n_nationkey = o.unit LEFT JOIN f ON f.unit = o.unit AND f.period = o.period""")
def hist_name(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = o.groupBy(F.col("c_nationkey").alias("unit"), F.year("o_orderdate").alias("period")).agg(F.count("*").alias("n"))
    named = rows.join(table(spark, d, "nation").select(F.col("n_nationkey").alias("unit"), F.col("n_name").alias("name")), "unit")
    history = spark.createDataFrame(_HISTORY, "unit int, ord int, first int, last int, old string")
    return names.name_at(named, history).select("unit", "period", "label", "n")


@query("q_two_key", """SELECT s_suppkey AS id, coalesce(a.n_nationkey, b.n_nationkey) AS unit FROM supplier
  LEFT JOIN nation a ON a.n_nationkey = s_suppkey LEFT JOIN nation b ON b.n_name = 'NATION_' || CAST(s_nationkey AS VARCHAR)""")
def two_key(spark, d):
    features = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")).alias("name"))
    dim = table(spark, d, "nation").select(F.col("n_nationkey").alias("unit"), F.col("n_nationkey").cast("long").alias("map_id"), F.array("n_name").alias("names"))
    return names.by_id_or_name(features, dim).select("id", "unit")


@query("q_anti_undrawn", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_undrawn(spark, d):
    drawn = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return names.undrawn(table(spark, d, "orders").select("o_orderkey"), drawn, "o_orderkey")


@query("q_known_groups", """WITH g(slug, label) AS (VALUES ('src1', 'one'), ('src2', 'two'), ('none', 'x')) SELECT slug, label, count(*) AS n FROM documents JOIN g ON slug = source GROUP BY 1, 2""")
def known_groups(spark, d):
    g = spark.createDataFrame([("src1", "one"), ("src2", "two"), ("none", "x")], "slug string, label string")
    return names.known_groups(table(spark, d, "documents").select(F.col("source").alias("slug")), g).groupBy("slug", "label").agg(F.count("*").alias("n"))


@query("q_left_default", "SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def left_default(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return names.with_default(table(spark, d, "customer").select("c_custkey"), n, ["c_custkey"], {"n": 0})


@query("q_best_fragment", """WITH l AS (SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey, l_suppkey) - 1 AS local FROM lineitem),
  k AS (SELECT l_orderkey, arg_max(local, l_extendedprice * 1000000 - local) AS k FROM l GROUP BY 1)
  SELECT k.l_orderkey AS o_orderkey, k.k AS best, round(l.l_extendedprice, 2) AS price FROM k JOIN l ON l.l_orderkey = k.l_orderkey AND l.local = k.k""")
def best_fragment(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("unit"), "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey")
    local = lines.withColumn("local", F.expr("row_number() over (partition by unit order by l_linenumber, l_extendedprice, l_partkey, l_suppkey) - 1"))
    speech = local.groupBy("unit").agg(F.max_by("local", F.struct("l_extendedprice", -F.col("local"))).alias("k"))
    return points.best_fragment(speech, local).select(F.col("unit").alias("o_orderkey"), F.col("k").alias("best"), F.round("l_extendedprice", 2).alias("price"))


def plane(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"), "label")
    low = e.agg(F.min("a").alias("la"), F.max("a").alias("ha"), F.min("b").alias("lb"), F.max("b").alias("hb")).first()  # one row
    return e.select("idx", ((F.col("a") - low.la) / (low.ha - low.la)).alias("x"), ((F.col("b") - low.lb) / (low.hb - low.lb)).alias("y"), "label")


_PLANE = """e AS (SELECT vec_id AS idx, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, label FROM embeddings),
  s AS (SELECT min(a) AS la, max(a) AS ha, min(b) AS lb, max(b) AS hb FROM e), p AS (SELECT idx, (a - la) / (ha - la) AS x, (b - lb) / (hb - lb) AS y, label FROM e, s)"""


@query("q_knn_radius", f"""WITH {_PLANE}, c AS (SELECT q.idx AS probe, r.idx, CASE WHEN q.label = r.label THEN 0 ELSE 1 END AS tier,
  (r.x - q.x) * (r.x - q.x) + (r.y - q.y) * (r.y - q.y) AS d2 FROM p q, p r WHERE q.idx % 100 = 0 AND q.idx <> r.idx),
  n AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY tier, d2, idx) AS k FROM c WHERE d2 < 0.1 * 0.1)
  SELECT probe, idx, tier, round(d2, 9) AS d2 FROM n WHERE k = 1""")
def knn_radius(spark, d):
    p = plane(spark, d)
    probes = p.where("idx % 100 = 0").select(F.col("idx").alias("probe"), F.col("x").alias("px"), F.col("y").alias("py"), "label")
    return points.nearest_in_radius(probes, p, 0.1).select("probe", "idx", "tier", r6("d2", 9))


@query("q_label_anchors", f"""WITH {_PLANE}, g AS (SELECT label AS topic, least(floor(x * 20), 19) AS cx, least(floor(y * 20), 19) AS cy, count(*) AS k FROM p GROUP BY 1, 2, 3),
  b AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY k DESC, cx, cy) - 1 AS place, sum(k) OVER (PARTITION BY topic) AS n FROM g)
  SELECT topic, place, round((cx + 0.5) / 20, 6) AS x, round((cy + 0.5) / 20, 6) AS y, CAST(n AS BIGINT) AS n FROM b WHERE place <= 4""")
def label_anchors(spark, d):
    return points.label_anchors(plane(spark, d).withColumnRenamed("label", "topic")).select("topic", "place", r6("x"), r6("y"), "n")


@query("q_label_order", """WITH t AS (SELECT event_type AS topic, event_type IN ('purchase', 'signup', 'error') AS is_lens, count(*) AS n FROM events GROUP BY 1, 2)
  SELECT topic, n, row_number() OVER (ORDER BY is_lens DESC, n DESC, topic) AS rank FROM t""")
def label_order(spark, d):
    t = table(spark, d, "events").groupBy(F.col("event_type").alias("topic"), F.col("event_type").isin(*LENSES).alias("is_lens")).agg(F.count("*").alias("n"))
    return points.label_order(t).select("topic", "n", "rank")


@query("q_bucket", """SELECT (l_discount >= 0.01)::BIGINT + (l_discount >= 0.05)::BIGINT + (l_discount >= 0.1)::BIGINT + (l_discount >= 0.2)::BIGINT AS class, count(*) AS n FROM lineitem GROUP BY 1""")
def bucket(spark, d):
    return table(spark, d, "lineitem").groupBy(scalars.bucket(F.col("l_discount")).alias("class")).agg(F.count("*").alias("n"))


_CASES = (0.0, 0.0004, 0.0005, 0.0025, 0.0125, 1.0, 12.345, 99.99951, 123.456, 12345.678)
_V = f"v(k, v) AS (SELECT sel || CAST(lens AS VARCHAR), v FROM grp UNION ALL SELECT * FROM (VALUES {', '.join(f"('case{k}', {v})" for k, v in enumerate(_CASES))}) UNION ALL SELECT 'none', NULL UNION ALL SELECT 'nan', 'nan'::DOUBLE)"


def _number_sql(v: str) -> dict[str, str]:
    """One decimal, half up: grouped by threes, in Spanish only from five digits on."""
    en = f"format('{{:,.1f}}', floor({v} * 10 + 0.5 + 1e-9) / 10)"
    return {"en": en, "es": f"CASE WHEN {v} < 9999.95 THEN translate({en}, '.,', ',') ELSE translate({en}, ',.', '.,') END"}


_PCT, _RATIO = _number_sql("v * 100"), _number_sql("v")


def figures(spark, d):
    g = cube.group_mean(means(spark, d), members(spark, d)).select(F.concat("sel", F.col("lens").cast("string")).alias("k"), "v")
    cases = [(f"case{k}", v) for k, v in enumerate(_CASES)] + [("none", None), ("nan", float("nan"))]
    return g.unionByName(spark.createDataFrame(cases, "k string, v double"))


@query("q_pct_text", f"""WITH {_MEANS}, {_V} SELECT k, CASE WHEN v IS NULL OR isnan(v) THEN '–' WHEN v > 0 AND v < 0.0005 THEN '<0.1%' ELSE {_PCT["en"]} || '%' END AS txt,
  CASE WHEN v IS NULL OR isnan(v) THEN '–' WHEN v > 0 AND v < 0.0005 THEN '<0,1' || chr(160) || '%' ELSE {_PCT["es"]} || chr(160) || '%' END AS txt_es FROM v""")
def pct_text(spark, d):
    return figures(spark, d).select("k", scalars.percent_text(F.col("v")).alias("txt"), scalars.percent_text(F.col("v"), "es").alias("txt_es"))


@query("q_ratio_text", f"""WITH {_MEANS}, {_V} SELECT k, CASE WHEN v IS NULL OR isnan(v) THEN '–' ELSE {_RATIO["en"]} || '×' END AS txt, CASE WHEN v IS NULL OR isnan(v) THEN '–' ELSE {_RATIO["es"]} || '×' END AS txt_es FROM v""")
def ratio_text(spark, d):
    return figures(spark, d).select("k", scalars.ratio_text(F.col("v")).alias("txt"), scalars.ratio_text(F.col("v"), "es").alias("txt_es"))


@query("q_formats", """WITH n AS (SELECT n_nationkey AS k, n_name AS a, CASE WHEN n_nationkey % 2 = 0 THEN 'x{y}' ELSE 'Irene' END AS b FROM nation)
  SELECT k, CAST(floor(k / 7.0 * 100 + 0.5) AS BIGINT) AS whole, least(1.0, greatest(0.0, k / 10.0 - 0.5)) AS clamped,
  'a ' || a || ' b' || b || '' AS filled, '&lt;' || a || '&gt;&amp;&quot;' AS escaped,
  CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN a WHEN 2 THEN a || ' and ' || b ELSE a || ', c, and ' || b END AS listed,
  CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN a WHEN 2 THEN a || ' or ' || b ELSE a || ', c, or ' || b END AS listed_or,
  CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN a WHEN 2 THEN a || CASE WHEN b = 'Irene' THEN ' e ' ELSE ' y ' END || b ELSE a || ', c' || CASE WHEN b = 'Irene' THEN ' e ' ELSE ' y ' END || b END AS listed_es FROM n""")
def formats(spark, d):
    k, a = F.col("n_nationkey"), F.col("n_name")
    b = F.when(k % 2 == 0, "x{y}").otherwise("Irene")
    items = F.when(k % 4 == 0, F.array().cast("array<string>")).when(k % 4 == 1, F.array(a)).when(k % 4 == 2, F.array(a, b)).otherwise(F.array(a, F.lit("c"), b))
    return table(spark, d, "nation").select(
        k.alias("k"), scalars.whole_percent(k / 7.0).alias("whole"), scalars.clamp01(k / 10.0 - 0.5).alias("clamped"),
        scalars.fill_template(F.lit("a {x} b{y}{z}"), {"x": a, "y": b}).alias("filled"),
        scalars.html_escaped(F.concat(F.lit("<"), a, F.lit('>&"'))).alias("escaped"), scalars.listed(items).alias("listed"),
        scalars.listed(items, kind="disjunction").alias("listed_or"), scalars.listed(items, "es").alias("listed_es"),
    )


@query("q_period_forms", """WITH d AS (SELECT DISTINCT CAST(day(ts) AS INT) AS d FROM events), p AS (SELECT a.d AS a, b.d AS b, least(a.d, b.d) AS f, greatest(a.d, b.d) AS l FROM d a, d b)
  SELECT a, b, CASE WHEN f = 1 AND l = 30 THEN 'all' WHEN f = l THEN CAST(f AS VARCHAR) END AS period_key, CASE WHEN f = l THEN CAST(f AS VARCHAR) ELSE f || '–' || l END AS label,
  f = 1 AND l = 30 AS is_all, CASE WHEN f = l THEN f END AS single, CASE WHEN f = 1 AND l = 30 THEN a END AS next FROM p""")
def period_forms(spark, d):
    days = events(spark, d).select("period").distinct()
    handles = days.select(F.col("period").alias("a")).join(F.broadcast(days.select(F.col("period").alias("b"))))  # 30 days each
    forms = params.period_forms(F.col("a"), F.col("b"), (1, 30))
    return handles.select("a", "b", *[forms[k].alias(k) for k in ("period_key", "label", "is_all", "single", "next")])


@query("q_links", """WITH l AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '#' || upper(source) WHEN 1 THEN '%53RC' || substr(source, 4) WHEN 2 THEN '#Anexo' ELSE '#none' END AS h FROM documents),
  u AS (SELECT doc_id, lower(url_decode(CASE WHEN h LIKE '#%' THEN substr(h, 2) ELSE h END)) AS h FROM l)
  SELECT doc_id, CASE WHEN h IN ('src1', 'src2', 'src3') THEN h WHEN h IN ('anexo', 'annex') THEN 'annex' END AS link FROM u""")
def links(spark, d):
    kind, source = F.col("doc_id") % 4, F.col("source")
    h = F.when(kind == 0, F.concat(F.lit("#"), F.upper(source))).when(kind == 1, F.concat(F.lit("%53RC"), F.substr(source, F.lit(4)))).when(kind == 2, "#Anexo").otherwise("#none")
    return table(spark, d, "documents").select("doc_id", params.link_of(h, F.array(*[F.lit(f"src{k}") for k in (1, 2, 3)])).alias("link"))


@query("q_active_slots", """WITH s AS (SELECT user_id AS unit, [CASE WHEN user_id % 2 = 0 THEN 'a' ELSE '' END, CASE WHEN user_id % 3 = 0 THEN 'b' ELSE 'gone' END, 'c'] AS s FROM (SELECT DISTINCT user_id FROM events))
  SELECT unit, CAST(k - 1 AS INT) AS slot, s[k] AS sel FROM (SELECT unit, s, unnest(range(1, 4)) AS k FROM s) WHERE s[k] IN ('a', 'b', 'c')""")
def active_slots(spark, d):
    units = events(spark, d).select("unit").distinct()
    slots = F.array(F.when(F.col("unit") % 2 == 0, "a").otherwise(""), F.when(F.col("unit") % 3 == 0, "b").otherwise("gone"), F.lit("c"))
    known = F.array(*[F.lit(x) for x in "abc"])
    return units.select("unit", F.inline(params.active_slots(slots, known))).select("unit", F.col("slot").cast("int").alias("slot"), "sel")


@query("q_spoken", f"WITH {_E} SELECT unit, count(DISTINCT period) AS periods, min(period) AS first, max(period) AS last FROM e GROUP BY 1")
def spoken(spark, d):
    counts = events(spark, d).groupBy("unit", "period").agg(F.count("*").alias("n"))
    return counts.where("n > 0").groupBy("unit").agg(F.count("*").alias("periods"), F.min("period").alias("first"), F.max("period").alias("last"))


@query("q_approximate", f"""WITH {_E}, b AS (SELECT event_type, CASE WHEN avg(value) IS NULL THEN NULL ELSE avg(value) >= 50 END AS passed FROM e WHERE event_type <> 'click' GROUP BY 1 UNION ALL SELECT 'click', NULL)
  SELECT event_type, event_type <> 'view' AND coalesce(NOT passed, false) AS approximate FROM b""")
def approximate(spark, d):
    bar = events(spark, d).groupBy("event_type").agg(F.when(F.col("event_type") != "click", F.avg("value") >= 50).alias("passed"))
    return bar.select("event_type", scalars.is_approximate(F.col("event_type") == "view", F.col("passed")).alias("approximate"))


@query("q_in_sentence", """SELECT 'd' || CAST(doc_id AS VARCHAR) AS k, CASE WHEN regexp_matches(text, '^\\p{Lu}\\p{Ll}') THEN lower(substr(text, 1, 1)) || substr(text, 2) ELSE text END AS t FROM documents
  UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), n_name FROM nation UNION ALL SELECT 'p' || CAST(p_partkey AS VARCHAR), CASE WHEN regexp_matches(p_name, '^\\p{Lu}\\p{Ll}') THEN lower(substr(p_name, 1, 1)) || substr(p_name, 2) ELSE p_name END FROM part""")
def in_sentence(spark, d):
    rows = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("k"), F.col("text").alias("t"))
    rows = rows.unionByName(table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("k"), F.col("n_name").alias("t")))
    rows = rows.unionByName(table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("k"), F.col("p_name").alias("t")))
    return rows.select("k", scalars.in_sentence(F.col("t")).alias("t"))


@query("q_collation", """SELECT word, row_number() OVER (ORDER BY word COLLATE es, word) AS rank FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]+')) AS word FROM documents WHERE lang = 'es')""")
def collation(spark, d):
    words = table(spark, d, "documents").where("lang = 'es'").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿ]+"), F.lit(0))).alias("word")).distinct()
    return windows.rank_of(words, "word", "es").select(F.collate("word", "UTF8_BINARY").alias("word"), "rank")


@query("q_last_non_null", f"""WITH {_SHARE} SELECT u.unit, round(coalesce(arg_max(s.share, s.period), 0), 6) AS v FROM (SELECT DISTINCT unit FROM e) u LEFT JOIN share s ON s.unit = u.unit AND s.lens = 0 GROUP BY 1""")
def last_non_null(spark, d):
    return windows.last_non_null(share(spark, d).where("lens = 0"), "unit", "period", "share").select("unit", F.round("share", 6).alias("v"))


@query("q_declutter", f"""WITH {_PLANE}, m AS (SELECT label, avg(y) * 100 AS y FROM p GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY y, label) AS k FROM m),
  q AS (SELECT label, y, max(y - 15 * k) OVER (ORDER BY k) + 15 * k AS p FROM r) SELECT label, round(y, 6) AS y, round(p - greatest(max(p) OVER () - 120, 0), 6) AS placed FROM q""")
def declutter(spark, d):
    m = plane(spark, d).groupBy("label").agg((F.avg("y") * 100).alias("y"))
    return windows.declutter(m, "y", 15.0, 120.0, "label").select("label", r6("y"), r6("placed"))


def _keyness_sql(terms: str) -> str:
    return f"""WITH w AS (SELECT CASE WHEN source = 'src1' THEN 1 ELSE 0 END AS i, regexp_extract_all(lower(text), '[a-z]+(?:-[a-z]+)*') AS t FROM documents WHERE lang = 'en'),
  x AS (SELECT i, unnest({terms}) AS term FROM w), c AS (SELECT term, sum(i) AS a, sum(1 - i) AS b FROM x GROUP BY 1), n AS (SELECT sum(a) AS na, sum(b) AS nb, 0.01 * count(*) AS prior FROM c),
  z AS (SELECT term, CAST(a AS BIGINT) AS n, round((ln((a + 0.01) / (na + prior - a - 0.01)) - ln((b + 0.01) / (nb + prior - b - 0.01))) / sqrt(1 / (a + 0.01) + 1 / (b + 0.01)), 6) AS z FROM c, n)
  SELECT row_number() OVER (ORDER BY z DESC, term) AS rank, term, round(z, 4) AS z, n FROM z WHERE z >= 2 AND n >= 3 ORDER BY z DESC, term LIMIT 12"""


def _keyness(spark, d, phrases: bool):
    docs = table(spark, d, "documents").where("lang = 'en'").select("source", text.tokens(F.col("text")).alias("t"))
    terms = text.bigrams(F.col("t")) if phrases else F.col("t")
    return text.keyness(docs, F.col("source") == "src1", terms).select("rank", "term", r6("z", 4), "n")


@query("q_keyness", _keyness_sql("t"))
def keyness(spark, d):
    return _keyness(spark, d, False)


@query("q_keyness_bigrams", _keyness_sql("list_transform(list_zip(t[:-2], t[2:]), lambda p: p[1] || ' ' || p[2])"))
def keyness_bigrams(spark, d):
    return _keyness(spark, d, True)


@query("q_fragment", """WITH RECURSIVE l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: len(regexp_extract_all(x, '\\S+'))) AS n FROM documents),
  p AS (SELECT doc_id, flatten(list_transform(n, lambda k: list_concat(list_transform(range(k // 200), lambda i: 200), CASE WHEN k % 200 > 0 THEN [k % 200] ELSE [] END))) AS n FROM l),
  s AS (SELECT doc_id, n, 0 AS k, 1 AS first, 0 AS words, 0 AS frag, 0 AS done_first, 0 AS done_words FROM p
    UNION ALL SELECT doc_id, n, k + 1, CASE WHEN words + n[k + 1] >= 60 THEN k + 2 ELSE first END, CASE WHEN words + n[k + 1] >= 60 THEN 0 ELSE words + n[k + 1] END,
      CASE WHEN words + n[k + 1] >= 60 THEN frag + 1 ELSE frag END, CASE WHEN words + n[k + 1] >= 60 THEN first ELSE 0 END, CASE WHEN words + n[k + 1] >= 60 THEN words + n[k + 1] ELSE 0 END FROM s WHERE k < len(n))
  SELECT doc_id, frag - 1 AS fragment, done_first AS first, k AS last, done_words AS words FROM s WHERE done_words > 0""")
def fragment(spark, d):
    return text.fragments(table(spark, d, "documents"))


_CENTROID = "cells AS (SELECT label AS unit, unnest(range(64)) AS dim, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings), cen AS (SELECT unit, dim, avg(x) AS v FROM cells GROUP BY 1, 2)"


@query("q_centroid", f"WITH {_CENTROID} SELECT unit, dim, round(v, 6) AS v FROM cen")
def centroid(spark, d):
    return align.centroids(table(spark, d, "embeddings"), "label", "embedding").select("unit", "dim", r6("v"))


@query("q_alignment", f"""WITH {_CENTROID}, c AS (SELECT a.unit AS a, b.unit AS b, round(sum(a.v * b.v) / sqrt(sum(a.v * a.v) * sum(b.v * b.v)), 9) AS cos FROM cen a JOIN cen b ON a.dim = b.dim AND a.unit < b.unit GROUP BY 1, 2),
  q AS (SELECT *, CAST(round_even(100 * cume_dist() OVER (ORDER BY cos), 0) AS BIGINT) AS pct FROM c), m AS (SELECT a AS unit, b AS target, pct, cos FROM q UNION ALL SELECT b, a, pct, cos FROM q),
  r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY cos DESC, target) AS rank FROM m) SELECT unit, rank, target, pct, round(cos, 5) AS cos FROM r WHERE rank <= 5""")
def alignment(spark, d):
    vectors = align.as_vectors(align.centroids(table(spark, d, "embeddings"), "label", "embedding"))
    return align.pairs(vectors).select("unit", "rank", "target", "pct", r6("cos", 5))


@query("q_alignment_groups", f"""WITH {_CENTROID}, mem AS (SELECT DISTINCT CASE WHEN unit % 2 = 0 THEN 'even' ELSE 'odd' END AS sel, unit FROM cen),
  s AS (SELECT sel, dim, sum(v) AS s, count(*) AS n FROM cen JOIN mem USING (unit) GROUP BY 1, 2),
  g AS (SELECT c.unit, s.sel, c.v, (s.s - CASE WHEN m.unit IS NULL THEN 0 ELSE c.v END) / (s.n - CASE WHEN m.unit IS NULL THEN 0 ELSE 1 END) AS g FROM cen c JOIN s USING (dim) LEFT JOIN mem m ON m.sel = s.sel AND m.unit = c.unit WHERE s.n > CASE WHEN m.unit IS NULL THEN 0 ELSE 1 END),
  k AS (SELECT unit, sel, round(sum(v * g) / sqrt(sum(v * v) * sum(g * g)), 9) AS cos FROM g GROUP BY 1, 2),
  q AS (SELECT *, CAST(round_even(100 * cume_dist() OVER (ORDER BY cos), 0) AS BIGINT) AS pct FROM k)
  SELECT unit, row_number() OVER (PARTITION BY unit ORDER BY pct DESC, sel) AS rank, sel, pct, round(cos, 5) AS cos FROM q""")
def alignment_groups(spark, d):
    cells = align.centroids(table(spark, d, "embeddings"), "label", "embedding")
    groups = cells.select(F.when(F.col("unit") % 2 == 0, "even").otherwise("odd").alias("sel"), "unit").distinct()
    return align.to_groups(cells, groups).select("unit", "rank", "sel", "pct", r6("cos", 5))


@query("q_alignment_modes", f"""WITH u AS (SELECT DISTINCT label AS unit FROM embeddings),
  cells AS (SELECT 'overall' AS mode, label AS unit, unnest(range(64)) AS dim, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings
    UNION ALL SELECT 'lens', label, unnest(range(64)), unnest(CAST(embedding AS DOUBLE[])) FROM embeddings WHERE label < 7 AND vec_id % 2 = 0), cen AS (SELECT mode, unit, dim, avg(x) AS v FROM cells GROUP BY 1, 2, 3),
  c AS (SELECT a.mode, a.unit AS a, b.unit AS b, round(sum(a.v * b.v) / sqrt(sum(a.v * a.v) * sum(b.v * b.v)), 9) AS cos FROM cen a JOIN cen b ON a.mode = b.mode AND a.dim = b.dim AND a.unit < b.unit GROUP BY 1, 2, 3),
  q AS (SELECT *, CAST(round_even(100 * cume_dist() OVER (PARTITION BY mode ORDER BY cos), 0) AS BIGINT) AS pct FROM c), m AS (SELECT mode, a AS unit, b AS target, pct, cos FROM q UNION ALL SELECT mode, b, a, pct, cos FROM q),
  r AS (SELECT *, row_number() OVER (PARTITION BY mode, unit ORDER BY cos DESC, target) AS rank FROM m), t AS (SELECT mode, unit, rank, target, pct, round(cos, 5) AS cos FROM r WHERE rank <= 5)
  SELECT * FROM t UNION ALL SELECT 'lens', unit, NULL, NULL, NULL, NULL FROM u WHERE unit NOT IN (SELECT unit FROM t WHERE mode = 'lens')""")
def alignment_modes(spark, d):
    on = (F.col("label") < 7) & (F.col("vec_id") % 2 == 0)
    return align.modes(table(spark, d, "embeddings"), "label", "embedding", on).select("mode", "unit", "rank", "target", "pct", r6("cos", 5))


_JUDGED = "j AS (SELECT d.doc_id, d.n_chars, l.quality = 0 AS truth FROM documents d JOIN labels l USING (doc_id))"


def judged(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return rows.select("doc_id", "n_chars", (F.col("quality") == 0).alias("truth"))


_SWEEP = f"""{_JUDGED}, c AS (SELECT n_chars AS threshold, sum(truth::INT) AS t, count(*) AS n FROM j GROUP BY 1),
  s AS (SELECT threshold, sum(t) OVER o AS tp, sum(n) OVER o AS predicted, (SELECT sum(t) FROM c) AS actual FROM c WINDOW o AS (ORDER BY threshold)),
  r AS (SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(predicted AS BIGINT) AS predicted, round(tp / predicted, 6) AS precision, round(tp / actual, 6) AS recall, round(2 * tp / (predicted + actual), 6) AS f1, round(2 * tp / (predicted + actual), 9) AS f FROM s)"""


@query("q_prf", f"WITH {_SWEEP} SELECT threshold, tp, predicted, precision, recall, f1 FROM r")
def prf(spark, d):
    return evaluate.sweep(judged(spark, d), F.col("truth"), "n_chars").select("threshold", "tp", "predicted", r6("precision"), r6("recall"), r6("f1"))


@query("q_best_f1", f"WITH {_SWEEP} SELECT threshold, f1 FROM r ORDER BY f DESC, threshold LIMIT 1")
def best_f1(spark, d):
    return evaluate.best_threshold(evaluate.sweep(judged(spark, d), F.col("truth"), "n_chars")).select("threshold", r6("f1"))


@query("q_weighted_prf", f"""WITH {_JUDGED}, w AS (SELECT doc_id % 4 AS part, truth::INT AS t, (n_chars <= 1439)::INT AS p, 1.0 + doc_id % 3 AS w FROM j),
  s AS (SELECT part, sum(w * t * p) AS tp, sum(w * p) AS pp, sum(w * t) AS t FROM w GROUP BY 1)
  SELECT part, round(CASE WHEN pp > 0 THEN tp / pp END, 6) AS precision, round(CASE WHEN t > 0 THEN tp / t END, 6) AS recall, round(CASE WHEN pp + t > 0 THEN 2 * tp / (pp + t) END, 6) AS f1 FROM s""")
def weighted_prf(spark, d):
    rows = judged(spark, d).withColumn("part", F.col("doc_id") % 4)
    return evaluate.scores(rows, F.col("truth"), F.col("n_chars") <= 1439, 1.0 + F.col("doc_id") % 3, ["part"]).select("part", r6("precision"), r6("recall"), r6("f1"))


@query("q_pass_bar", f"""WITH {_JUDGED}, w AS (SELECT CAST(doc_id % 4 AS VARCHAR) AS period, truth::INT AS t, (n_chars <= 1439)::INT AS p FROM j),
  f AS (SELECT period, sum(t * p) AS tp, sum(p) AS pp, sum(t) AS t FROM w GROUP BY 1), o AS (SELECT 'overall' AS period, sum(tp) AS tp, sum(pp) AS pp, sum(t) AS t FROM f),
  a AS (SELECT period, 2 * tp / (pp + t) AS f1 FROM f WHERE t >= 1 UNION ALL SELECT period, 2 * tp / (pp + t) FROM o)
  SELECT period, round(f1, 6) AS f1, CASE WHEN period = 'overall' THEN (SELECT bool_and(f1 >= 0.25) FROM a) ELSE f1 >= 0.25 END AS passed FROM a""")
def pass_bar(spark, d):
    rows = judged(spark, d).withColumn("part", F.col("doc_id") % 4)
    return evaluate.passes(rows, F.col("truth"), F.col("n_chars") <= 1439, "part", 0.25).select("period", r6("f1"), "passed")


@query("q_calibration", f"""WITH {_JUDGED}, b AS (SELECT quantile_disc(n_chars, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS b FROM j),
  k AS (SELECT 1 + len(list_filter(b, lambda x: x < n_chars)) AS bin, truth FROM j, b)
  SELECT bin, count(*) AS n, CAST(sum(truth::INT) AS BIGINT) AS hits, CAST(floor(10.0 * sum(truth::INT) / count(*) + 0.5) AS BIGINT) AS of_ten FROM k GROUP BY 1""")
def calibration(spark, d):
    return evaluate.calibration(judged(spark, d), F.col("truth"), "n_chars")


@query("q_topic_counts", f"SELECT count_if(event_type NOT IN ('purchase', 'signup', 'error')) AS general, count_if(event_type IN ('purchase', 'signup', 'error')) AS lenses, bool_or(event_type IS NULL) AS preliminary FROM events")
def topic_counts(spark, d):
    general = ~F.col("event_type").isin(*LENSES)
    return table(spark, d, "events").agg(F.count_if(general).alias("general"), F.count_if(~general).alias("lenses"), F.bool_or(F.col("event_type").isNull()).alias("preliminary"))


@query("q_adjudicate", """SELECT doc_id, CASE WHEN quality = toxic THEN quality ELSE CAST(doc_id % 2 AS INT) END AS answer FROM labels""")
def adjudicate(spark, d):
    return table(spark, d, "labels").select("doc_id", scalars.adjudicated(F.col("quality"), F.col("toxic"), (F.col("doc_id") % 2).cast("int")).alias("answer"))


@query("q_options", f"""WITH {_MEMBERS} SELECT sel, count(*) AS n FROM (SELECT 'g:' || sel AS sel, unit FROM members UNION ALL SELECT DISTINCT 'c:' || CAST(user_id AS VARCHAR), user_id FROM events) GROUP BY 1""")
def options(spark, d):
    m = members(spark, d)
    units = table(spark, d, "events").select(F.col("user_id").alias("unit")).distinct()
    return params.options(m.select(F.col("sel").alias("slug"), "unit"), units).groupBy("sel").agg(F.count("*").alias("n"))


def _chance_sql(key: str, seed: int) -> str:
    return f"CAST(('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0"


@query("q_folds", f"WITH {_E} SELECT CAST(floor({_chance_sql('unit', 0)} * 5) AS BIGINT) AS fold, count(*) AS n FROM e GROUP BY 1")
def folds(spark, d):
    return events(spark, d).groupBy(evaluate.fold(F.col("unit"), 5).alias("fold")).agg(F.count("*").alias("n"))


@query("q_sample", f"""WITH {_E}, r AS (SELECT *, CASE WHEN event_type IN ('view', 'click') THEN 0.1 ELSE 0.5 END AS rate FROM e)
  SELECT event_id, event_type, round(1.0 / rate, 6) AS weight FROM r WHERE {_chance_sql('event_id', 7)} < rate""")
def sample(spark, d):
    rates = {"purchase": 0.5, "signup": 0.5, "error": 0.5, "view": 0.1, "click": 0.1}
    return evaluate.stratified(events(spark, d), "event_type", rates, "event_id").select("event_id", "event_type", r6("weight"))


@query("q_cluster")
def cluster(spark, d):
    return clusters.cluster(table(spark, d, "embeddings"), "vec_id", "embedding", 10)


@query("q_project")
def project(spark, d):
    return clusters.project(table(spark, d, "embeddings"), "vec_id", "embedding")


@query("q_classifier")
def classifier(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("f"), (F.col("label") == 0).cast("int").alias("y"))
    own = evaluate.fold(F.col("vec_id"), 5)
    model, threshold = evaluate.with_threshold(rows.where(own != 0), "f", "y")
    scored = evaluate.scored_by(model, rows, "f")
    return scored.select("vec_id", (own == 0).alias("held_out"), "p", (F.col("p") >= threshold).cast("int").alias("predicted"))
