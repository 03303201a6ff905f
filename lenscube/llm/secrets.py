"""Secret scans with a randomness test battery, in DataFrame functions only.

Three base patterns are found as given. Besides, long tokens with a letter and a digit are tested: the encoding
is inferred from the letters that occur, and over its alphabet three statistics are taken: chi-squared against
uniformity, runs of the alphabet's classes (capitals, small letters, digits) and the serial correlation of the
letters' codes. The hypothesis is that the token is ordinary: built of words, numbers and marks, with letters that repeat,
classes that change seldom and codes that hang together. Each statistic gives a z under it, low where the
token looks random, and their sum a p-value. Benjamini-Hochberg within each class of lengths, over every
tested token of all documents, bounds the share of false discoveries. The counts for that are a histogram of fixed size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lenscube.llm.common import columns_of, cut, docs_of, whole_row

# The patterns of the contract, the shortest match (of group 1 where there is one) and the order of kinds.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "random")
#: Tokens that the battery looks at.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
# Alphabets in the order of their codes.
ALPHABETS = (
    ("^[0-9a-f]+$", "0123456789abcdef"),
    ("^[0-9A-F]+$", "0123456789ABCDEF"),
    ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)
SPANS = "array<struct<start:int,kind_no:int,end:int,kind:string>>"
#: Ordinary tokens: chance that two letters are equal and that the class changes from one letter to the next, and
#: serial correlation. Variance of the runs over a binomial's, correlation of the three z; the false-discovery rate.
SAME, CHANGE, ALONG, SPREAD, TIED, RATE = 0.05, 0.16, 0.15, 1.5, 0.3, 0.01
#: Characters of a class of lengths, and classes at most.
CLASS, CLASSES = 8, 16
#: Hits whose spans are gathered in one array.
RUN = 128
#: Buckets of a p-value: a twentieth of a power of ten each, this many at most.
PER_TEN, BUCKETS = 20, 200


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _none() -> Column:
    return F.array().cast(SPANS)


def _found(text: Column, kind: str, pattern: str, group: int = 0, least: int = 1) -> Column:
    """Spans of leftmost non-overlapping matches whose ``group`` has ``least`` characters, in code points."""
    value = F.struct(
        F.split(text, pattern, -1).alias("between"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("groups") if group else F.lit(None).cast("array<string>").alias("groups"),
    )

    def spans(x: Column) -> Column:
        def chunk(acc: Column, k: Column) -> Column:  # arrays of RUN hits, so that no long array is copied for every hit
            last = F.least((k + 1) * RUN, F.size(x["hits"])) - 1
            one = F.aggregate(F.sequence(k * RUN, last), F.struct(acc["at"].alias("at"), _none().alias("out")), step)
            return _let(one, lambda o: F.struct(o["at"].alias("at"), F.concat(acc["out"], F.array(o["out"])).alias("out")))

        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(x["between"][i])
            end = start + F.length(x["hits"][i])
            one = F.array(F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), end.alias("end"), F.lit(kind).alias("kind")))
            kept = F.when(F.length(x["groups"][i]) >= least, one).otherwise(_none()) if group else one
            return F.struct(end.alias("at"), F.concat(acc["out"], kept).alias("out"))

        chunks = F.sequence(F.lit(0), F.floor((F.size(x["hits"]) - 1) / RUN).cast("int"))
        return F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("out")), chunk, lambda a: F.flatten(a["out"]))

    return F.when(text.rlike(pattern), _let(value, spans)).otherwise(_none())


def base_spans(text: Column) -> Column:
    """The base patterns' spans, by start and kind."""
    return F.array_sort(F.concat(_found(text, "assign", ASSIGN, 1, ASSIGN_LEAST), _found(text, "access", ACCESS), _found(text, "hex", HEX)))


def _classes(x: Column) -> Column:
    """The class of each letter: 0 capital, 1 small letter, 2 digit, 3 mark."""
    return F.transform(x, lambda c: F.when(c.between("A", "Z"), 0).when(c.between("a", "z"), 1).when(c.between("0", "9"), 2).otherwise(3))


def _following(values: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of each value and the next."""
    return F.zip_with(F.slice(values, 1, F.size(values) - 1), F.slice(values, 2, F.size(values) - 1), body)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _battery(token: Column) -> Column:
    """struct(size class, bucket of the combined p-value) of a token."""
    alphabet = F.when(token.rlike(ALPHABETS[0][0]), F.lit(ALPHABETS[0][1]))
    for pattern, letters in ALPHABETS[1:]:
        alphabet = alphabet.when(token.rlike(pattern), F.lit(letters)) if pattern else alphabet.otherwise(F.lit(letters))

    def tests(x: Column) -> Column:
        n, k, codes = F.size(x["codes"]).cast("double"), x["k"], x["codes"]
        changes = _total(_following(_classes(x["letters"]), lambda a, b: (a != b).cast("double")))
        values = F.struct(
            n.alias("n"), k.alias("k"), codes.alias("codes"), (_total(codes) / n).alias("mean"), changes.alias("changes"),
            (_total(F.transform(x["counts"], lambda c: c * c)) * k / n - n).alias("chi"),
        )
        return _let(values, verdict)

    def verdict(y: Column) -> Column:
        n, k, mean = y["n"], y["k"], y["mean"]
        around = _total(F.transform(y["codes"], lambda c: (c - mean) * (c - mean)))
        along = _total(_following(y["codes"], lambda a, b: (a - mean) * (b - mean)))
        excess = n * F.greatest(k * SAME - 1, F.lit(0.6))  # what ordinary letters add to chi-squared
        z_chi = (y["chi"] - (k - 1) - excess) / F.sqrt(2 * (k - 1) + 4 * excess)
        # classes that change at nearly every letter are no more random than ones that seldom do
        often = F.when(y["changes"] > 0.85 * (n - 1), (n - 1) - y["changes"]).otherwise(y["changes"])
        z_runs = ((n - 1) * CHANGE - often + 0.5) / F.sqrt((n - 1) * (CHANGE * (1 - CHANGE) * SPREAD))
        z_serial = (F.abs(along / F.greatest(around, F.lit(1e-9))) - ALONG) * F.sqrt(n)
        z = (z_chi + z_runs + z_serial) / (3 + 6 * TIED) ** 0.5
        z = F.greatest(F.least(z, F.lit(6.0)), F.lit(-6.0))
        log_p = -F.log1p(F.exp(-(1.5976 * z + 0.07056 * z * z * z))) / F.log(F.lit(10.0))
        bucket = F.least(F.floor(-log_p * PER_TEN).cast("int"), F.lit(BUCKETS))
        return F.struct(F.least(F.floor(n / CLASS), F.lit(CLASSES)).cast("int").alias("size"), bucket.alias("bucket"))

    letters = F.filter(F.split(token, ""), lambda c: c != "")
    value = F.struct(letters.alias("letters"), alphabet.alias("alphabet"))
    return _let(
        value,
        lambda x: _let(
            F.struct(
                x["letters"].alias("letters"),
                F.transform(x["letters"], lambda c: (F.position(c, x["alphabet"]) - 1).cast("double")).alias("codes"),
                F.transform(F.array_distinct(x["letters"]), lambda d: F.size(F.filter(x["letters"], lambda c: c == d)).cast("double")).alias("counts"),
                F.length(x["alphabet"]).cast("double").alias("k"),
            ),
            tests,
        ),
    )


def candidates(text: Column) -> Column:
    """array<struct<span, test>> of every token that has a letter and a digit, whatever its tests say."""
    spans = _found(text, "random", TOKEN)
    mixed = F.filter(
        F.transform(spans, lambda s: F.struct(s.alias("span"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("token"))),
        lambda c: c["token"].rlike("[0-9]") & c["token"].rlike("[A-Za-z]"),
    )
    return F.transform(mixed, lambda c: F.struct(c["span"].alias("span"), _battery(c["token"]).alias("test")))


def cuts(tested: DataFrame, rate: float = RATE) -> dict[int, int]:
    """The least bucket that counts as a discovery, by size class, from (candidates) of all documents."""
    each = tested.select(F.explode("candidates.test").alias("t")).groupBy("t.size", "t.bucket").agg(F.count("*").alias("n"))
    down = Window.partitionBy("size").orderBy(F.desc("bucket"))  # over at most BUCKETS + 1 rows a class
    ranked = each.withColumn("least", F.sum("n").over(down)).withColumn("all", F.sum("n").over(Window.partitionBy("size")))
    passing = ranked.where(F.pow(F.lit(10.0), -F.col("bucket") / PER_TEN) * F.col("all") <= rate * F.col("least"))
    return {r["size"]: r["bucket"] for r in passing.groupBy("size").agg(F.min("bucket").alias("bucket")).collect()}


def _added(base: Column, tested: Column, least: dict[int, int]) -> Column:
    """Spans of discoveries that overlap no base span."""
    if not least:
        return _none()
    limit = F.create_map(*[F.lit(x) for pair in least.items() for x in pair])
    found = F.filter(tested, lambda c: c["test"]["bucket"] >= F.coalesce(F.element_at(limit, c["test"]["size"]), F.lit(BUCKETS + 1)))
    spans = F.transform(found, lambda c: c["span"])
    return F.filter(spans, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, base and spans (arrays of start, kind_no, end, kind) of every row; nulls are empty texts.

    Rows that repeat a doc_id are scanned each by itself; a null doc_id stays null; an empty table gives no rows;
    other columns, of whatever name, are not read. A text of any length is scanned whole. One pass over the texts; its spans are kept in the
    shared folder while the false-discovery cuts are drawn from all of them.
    """
    text = F.coalesce("text", F.lit(""))
    first = cut(docs_of(docs).select("doc_id", base_spans(text).alias("base"), candidates(text).alias("candidates")))
    least = cuts(first, rate)
    return first.select("doc_id", "base", F.array_sort(F.concat("base", _added(F.col("base"), F.col("candidates"), least))).alias("spans"))


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """Counts and digests of the spans."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]", rate: float = RATE) -> DataFrame:
    """The documents with every found span replaced by ``mark``; all columns, of whatever name, and all other text stay.

    Null texts stay null; rows that repeat are each by itself; an empty table gives no rows. One pass over the
    texts, which are kept with their spans in the shared folder while the false-discovery cuts are drawn.
    """
    of = F.coalesce(F.col("text").cast("string"), F.lit(""))
    first = cut(docs.select(whole_row(docs).alias("row"), base_spans(of).alias("base"), candidates(of).alias("candidates")))
    least = cuts(first, rate)
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    spans = F.array_sort(F.concat("base", _added(F.col("base"), F.col("candidates"), least)))

    def rebuilt(found: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            fresh = s["start"] >= acc["at"]
            gap = F.when(fresh, F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(F.lit(""))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.array(gap)).alias("out"))

        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(found, none, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))

    cleared = _let(spans, lambda s: F.when(F.size(s) > 0, rebuilt(s)).otherwise(F.col("row.text")))
    columns = dict(zip(docs.columns, columns_of("row", docs.columns), strict=True))
    return first.select(*(columns | {"text": F.when(F.col("row.text").isNotNull(), cleared).alias("text")}).values())
