"""Edge cases and closed forms against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lenscube.functions import scalars
from lenscube.operators import align, clusters, cube, evaluate, names, points, quotes, text, windows
from lenscube.plans import params


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) else 'double'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("v")).first().v


@pytest.mark.parametrize(("v", "en", "es"), [(0.0, "0.0%", "0,0\u00a0%"), (0.0004, "<0.1%", "<0,1\u00a0%"), (0.0005, "0.1%", "0,1\u00a0%"), (0.0025, "0.3%", "0,3\u00a0%"), (0.0015, "0.2%", "0,2\u00a0%"), (12.345, "1,234.5%", "1234,5\u00a0%"), (123.45678, "12,345.7%", "12.345,7\u00a0%"), (-0.0001, "-0.0%", "-0,0\u00a0%"), (None, "–", "–"), (float("nan"), "–", "–"), (float("inf"), "–", "–")])
def test_percent_text(spark, v, en, es):
    row = spark.createDataFrame([(v,)], "v double").select(scalars.percent_text(F.col("v")), scalars.percent_text(F.col("v"), "es")).first()
    assert tuple(row) == (en, es)


@pytest.mark.parametrize(("v", "k"), [(0.0, 0), (0.0099, 0), (0.01, 1), (0.05, 2), (0.1, 3), (0.2, 4), (5.0, 4)])
def test_bucket_is_closed_below(spark, v, k):
    assert one(spark, scalars.bucket(F.col("v")), v=v) == k


def test_text_scalars(spark):
    assert [one(spark, scalars.in_sentence(F.col("v")), v=x) for x in ("Drug use", "UN reform", "", "Éa")] == ["drug use", "UN reform", "", "éa"]
    assert one(spark, scalars.html_escaped(F.col("v")), v='<a&"b">') == "&lt;a&amp;&quot;b&quot;&gt;"
    strings = F.create_map(F.lit("hello"), F.lit("hi {n} {gone}!"))
    assert one(spark, scalars.message(strings, "hello", {"n": F.lit(3)}), v="") == "hi 3 !"
    assert one(spark, scalars.message(strings, "absent"), v="") == "absent"
    assert one(spark, scalars.message(strings, "hello", {"n": F.lit("a{gone}{n}$1")}), v="") == "hi a{gone}{n}$1 !"
    assert one(spark, scalars.ratio_text(F.col("v")), v=1.25) == "1.3×"


def test_lists(spark):
    def shown(items, *how):
        return spark.createDataFrame([(items,)], "v array<string>").select(scalars.listed(F.col("v"), *how)).first()[0]

    assert [shown(list("abcd"[:n])) for n in range(5)] == ["", "a", "a and b", "a, b, and c", "a, b, c, and d"]
    assert shown(["a", "b"], "en", "disjunction") == "a or b" and shown(["a", "b", "c"], "es", "disjunction") == "a, b o c"
    assert [shown(["a", "b", x], "es") for x in ("c", "Irán", "hilo", "hielo", "hiato")] == ["a, b y c", "a, b e Irán", "a, b e hilo", "a, b y hielo", "a, b y hiato"]
    assert [shown(["a", x], "es", "disjunction") for x in ("b", "otro", "hoy", "8", "11", "110")] == ["a o b", "a u otro", "a u hoy", "a u 8", "a u 11", "a o 110"]


def test_ranks_in_ranges_equal_a_single_window(spark):
    words = ["ñu", "nube", "oso", "árbol", "arco", "zeta", "Zeta", "él", "el", "eco"] + [f"w{k % 97}{k}" for k in range(60)]
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    ranks = [{r.w: r["rank"] for r in windows.rank_of(rows, "w", c, per_range=n).select(F.collate("w", "UTF8_BINARY").alias("w"), "rank").collect()} for c in ("es", None) for n in (7, 10**6)]
    assert ranks[0] == ranks[1] and ranks[2] == ranks[3] and sorted(ranks[0].values()) == list(range(1, 71))
    assert ranks[0]["arco"] < ranks[0]["eco"] < ranks[0]["nube"] < ranks[0]["ñu"] < ranks[0]["oso"]


def test_units_without_vectors_on_a_lens_have_a_row_of_nulls(spark):
    v = spark.createDataFrame([(u, [float(u), float(u * u % 5), 1.0], u < 3) for u in range(4)], "u int, v array<double>, held boolean")
    got = align.modes(v, "u", "v", F.col("held")).where("mode = 'lens'").collect()
    assert {r.unit for r in got if r.target is None} == {3} and {r.unit for r in got if r.target is not None} == {0, 1, 2}


def test_ties_of_a_composition_are_first_seen_first(spark):
    parts = spark.createDataFrame([(1, 2, 0, 7, 0.3), (1, 2, 1, 3, 0.3), (1, 3, 0, 3, 0.1), (1, 3, 1, 7, 0.1), (1, 3, 2, 1, 0.2)], "unit int, period int, ord int, topic int, share double")
    got = cube.top_and_others(cube.composition(parts, parts.select("unit", "period")), 3, 2).orderBy("ord").collect()
    assert [r.topic for r in got] == [7, 3, 1, -1]

def test_approximate_needs_a_failed_bar(spark):
    rows = spark.createDataFrame([(False, True), (False, False), (False, None), (True, False)], "every boolean, passed boolean")
    assert [r[0] for r in rows.select(scalars.is_approximate(F.col("every"), F.col("passed"))).collect()] == [False, True, False, False]


def test_means_weigh_units_not_periods(spark):
    share = spark.createDataFrame([(1, 1, 0, 0.2), (1, 2, 0, 0.4), (2, 1, 0, 0.9), (3, 1, 0, None), (3, 2, 0, float("nan"))], "unit int, period int, lens int, share double")
    means = cube.unit_mean(share)
    assert {r.unit: round(r.v, 9) for r in means.collect()} == {1: 0.3, 2: 0.9}
    assert round(cube.world_mean(means).first().world, 9) == 0.6
    members = spark.createDataFrame([("a", 0, 1), ("a", 0, 3), ("empty", 1, 3)], "sel string, slot int, unit int")
    assert [(r.sel, round(r.v, 9)) for r in cube.group_mean(means, members).collect()] == [("a", 0.3)]
    tiny = spark.createDataFrame([("a", 0, 0, 0.0004)], "sel string, slot int, lens int, v double")
    assert cube.ratio_to_world(tiny, cube.world_mean(means)).first().ratio is None


def test_composition_counts_unnamed_topics_as_zero(spark):
    parts = spark.createDataFrame([(1, 1, 0, 7, 0.5), (1, 2, 0, 8, 0.9)], "unit int, period int, ord int, topic int, share double")
    spoken = spark.createDataFrame([(1, 1), (1, 2)], "unit int, period int")
    assert {r.topic: r.share for r in cube.composition(parts, spoken).collect()} == {7: 0.25, 8: 0.45}


def test_declutter_equals_the_recurrence(spark):
    r = random.Random(1)
    rows = [(plot, k, float(r.randint(0, 100))) for plot in range(40) for k in range(r.randint(1, 7))]
    got = windows.declutter(spark.createDataFrame(rows, "plot int, k int, y double"), "y", 15.0, 110.0, "k", ["plot"]).collect()
    for plot in range(40):
        ends = sorted([y, k] for p, k, y in rows if p == plot)
        for a, b in zip(ends, ends[1:]):
            b[0] = max(b[0], a[0] + 15)
        over = max(0, ends[-1][0] - 110)
        assert {x.k: x.placed for x in got if x.plot == plot} == {k: y - over for y, k in ends}


def test_round_robin_equals_the_loop(spark):
    r = random.Random(2)
    for _ in range(6):
        pools = [[r.randint(0, 4) for _ in range(r.randint(0, 6))] for _ in range(3)]
        rows = [(s, f"s{s}", k + 1, key) for s, p in enumerate(pools) for k, key in enumerate(p)]
        out, used = [], set()
        for _ in range(3):
            for s, p in enumerate(pools):
                q = next((x for x in p if x not in used), None)
                if len(out) < 3 and q is not None:
                    used.add(q)
                    out.append((s, q))
        got = quotes.round_robin(spark.createDataFrame(rows, "slot int, sel string, rank int, key int"), 3).orderBy("pick").collect()
        assert [(x.slot, x.key) for x in got] == out


def test_smallest_selection_and_ties(spark):
    members = spark.createDataFrame([("a", 0, 1), ("a", 0, 2), ("b", 1, 2), ("b", 1, 3), ("c", 2, 3)], "sel string, slot int, unit int")
    assert {r.unit: r.slot for r in points.smallest_selection(members).collect()} == {1: 0, 2: 0, 3: 2}


def test_nearest_prefers_the_tier(spark):
    p = spark.createDataFrame([(1, 0.50, 0.5, 9), (2, 0.56, 0.5, 1), (3, 0.60, 0.5, 1)], "idx long, x double, y double, label int")
    q = spark.createDataFrame([(99, 0.51, 0.5, 1), (98, 0.0, 0.0, 1)], "probe long, px double, py double, label int")
    assert [(r.probe, r.idx, r.tier) for r in points.nearest_in_radius(q, p, 0.1).collect()] == [(99, 2, 0)]


def nearest_by_all_pairs(q, p, r):
    best = {}
    for probe, px, py, own in q:
        for idx, x, y, label in p:
            if idx != probe and None not in (x, y, px, py) and (d2 := (x - px) * (x - px) + (y - py) * (y - py)) < r * r:
                best[probe] = min(best.get(probe, (9,)), (int(own is None or label != own), d2, idx))
    return sorted((probe, idx, tier, d2) for probe, (tier, d2, idx) in best.items())


def nearest_of(spark, q, p, r):
    return points.nearest_in_radius(spark.createDataFrame(q, "probe long, px double, py double, label int"), spark.createDataFrame(p, "idx long, x double, y double, label int"), r)


def rows_of_joins(plan):
    kind = plan.nodeName()
    inner = plan.executedPlan() if kind == "AdaptiveSparkPlan" else plan.plan() if "QueryStage" in kind else None
    below = [inner] if inner else [plan.children().apply(k) for k in range(plan.children().size())]
    own = [plan.metrics().apply("numOutputRows").value()] if "Join" in kind else []
    return own + [n for x in below for n in rows_of_joins(x)]


_R = random.Random(5)
SCENES = [  # each a square of its own
    [(k, _R.randrange(20) / 20, _R.randrange(20) / 20, _R.choice([1, 2, None])) for k in range(600)],
    [(k, 0.5, 0.5, k % 3) for k in range(300)],
    [(k, 1e-5 * _R.random(), 1e-5 * _R.random(), _R.choice([1, 2])) for k in range(500)] + [(500 + k, _R.random(), _R.random(), 3 + k % 60) for k in range(60)],
    [(k, 0.5 + 0.05 * math.cos(k), 0.5 + 0.05 * math.sin(k), 2) for k in range(1, 400)] + [(0, 0.5, 0.5, 1), (400, 0.52, 0.5, 3)],
    [(k % 90, _R.random(), _R.random(), k % 3) for k in range(200)] + [(5, 0.2, 0.2, 1), (7, 0.2, 0.2, 1), (300, None, 0.5, 1), (301, 0.5, float("nan"), 1)],
]


def test_nearest_equals_all_pairs(spark):
    p = [(1000 * k + idx, None if x is None else x + 2 * k, y, label) for k, scene in enumerate(SCENES) for idx, x, y, label in scene]
    q = [x for x in p if x[0] % 3 == 0] + [(9999, 8.2, 0.2, 1)]
    assert sorted(map(tuple, nearest_of(spark, q, p, 0.1).collect())) == nearest_by_all_pairs(q, p, 0.1)


def test_nearest_of_nothing(spark):
    assert nearest_of(spark, [(1, 0.5, 0.5, 1)], [], 0.1).collect() == []


def test_nearest_compares_few_pairs_in_a_crowd(spark):
    p = [(k, 0.05 * _R.random(), 0.05 * _R.random(), k % 2) for k in range(2000)]
    got = nearest_of(spark, p, p, 0.1)
    assert len(got.collect()) == 2000
    assert 2000 <= max(rows_of_joins(got._jdf.queryExecution().executedPlan())) < 200 * 2000  # all pairs are 4,000,000


def test_first_covering_interval_wins(spark):
    rows = spark.createDataFrame([(1, y, "New") for y in (1989, 1990, 1991, 1995)], "unit int, period int, name string")
    history = spark.createDataFrame([(1, 0, 1980, 1990, "A"), (1, 1, 1990, 1991, "B")], "unit int, ord int, first int, last int, old string")
    assert {r.period: r.label for r in names.name_at(rows, history).collect()} == {1989: "A", 1990: "A", 1991: "B", 1995: "New"}


def test_running_totals_equal_a_single_window(spark):
    rows = [(k * 3 % 101, k) for k in range(101)]
    got = windows.running_totals(spark.createDataFrame(rows, "o int, v int"), "o", ["v"], per_range=15).collect()
    total, want = 0, {}
    for o, v in sorted(rows):
        total += v
        want[o] = total
    assert {r.o: r.sum_v for r in got} == want and {r.total_v for r in got} == {total}


def test_fragments_hold_60_to_260_words(spark):
    r = random.Random(3)
    docs = [(k, "\n".join(" ".join(["w"] * r.choice([0, 5, 30, 59, 60, 200, 450])) for _ in range(9))) for k in range(30)] + [(99, None), (98, "")]
    got = text.fragments(spark.createDataFrame(docs, "doc_id int, text string")).collect()
    assert got and all(60 <= x.words <= 260 for x in got) and {98, 99}.isdisjoint(x.doc_id for x in got)


def test_lone_member_has_no_own_group(spark):
    cells = spark.createDataFrame([(u, k, float(u + k * k)) for u in (1, 2, 3) for k in range(3)], "unit int, dim int, v double")
    members = spark.createDataFrame([("solo", 1), ("duo", 2), ("duo", 3)], "sel string, unit int")
    got = {(r.sel, r.unit): r for r in align.to_groups(cells, members).collect()}
    assert set(got) == {("solo", 2), ("solo", 3), ("duo", 1), ("duo", 2), ("duo", 3)}
    assert max(r.pct for r in got.values()) == 100


def test_percent_scale_gives_ties_the_upper_rank(spark):
    got = align.percent_scale(spark.createDataFrame([(0.1,), (0.5,), (0.5,), (0.9,)], "cos double")).collect()
    assert sorted((r.cos, r.pct) for r in got) == [(0.1, 25), (0.5, 75), (0.5, 75), (0.9, 100)]


def test_folds_keep_groups_whole(spark):
    rows = spark.range(300).select((F.col("id") % 40).alias("speech"))
    assert rows.groupBy("speech").agg(F.count_distinct(evaluate.fold(F.col("speech"), 5)).alias("k")).where("k > 1").count() == 0


def test_params():
    p = params.QueryParams(1, 30, (1, 30), slots=("x", "", "y"), known=frozenset({"x", "y"}))
    assert p.is_all and p.period_key == "all" and p.active() == [(0, "x"), (2, "y")]
    assert p.moved(9, 4).label == "4–9" and p.moved(9, 4).period_key is None and p.moved(1, 30, handle=7).period_key == "7"
    assert params.from_link("#X%C3%89", frozenset({"xé"})) == ("selection", "xé") and params.from_link("#Annex", frozenset()) == ("annex", "")
    assert params.from_link("#z", frozenset()) is None


def test_project_and_cluster_have_a_row_each(spark):
    v = spark.createDataFrame([(k, [float(k), float(k * k % 7), 1.0]) for k in range(30)], "k int, v array<double>")
    assert clusters.cluster(v, "k", "v", 3).count() == clusters.project(v, "k", "v").count() == 30
