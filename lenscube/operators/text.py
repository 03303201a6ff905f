"""Text: tokens, distinctive words and phrases, fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = "[a-z]+(-[a-z]+)*"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def bigrams(words: Column) -> Column:
    n = F.size(words)
    return F.when(n > 1, F.zip_with(F.slice(words, 1, n - 1), F.slice(words, 2, n - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))


def keyness(docs: DataFrame, inside: Column, terms: Column, alpha: float = 0.01, least_z: float = 2.0, least_n: int = 3, top: int = 12) -> DataFrame:
    """(rank, term, z, n): terms that tell the documents inside from the others, by log-odds with a Dirichlet prior.

    The prior is ``alpha`` for every term (our choice; it is not published). Counts are aggregated by term
    before anything else; the totals are one row.
    """
    each = docs.select(inside.cast("int").alias("i"), F.explode(terms).alias("term"))
    counts = each.groupBy("term").agg(F.sum("i").alias("a"), F.sum(1 - F.col("i")).alias("b"))
    total = counts.agg(F.sum("a").cast("double").alias("na"), F.sum("b").cast("double").alias("nb"), (F.count("*") * alpha).alias("prior"))
    counts = counts.join(F.broadcast(total))  # one row; both sides read the same exchange
    a, b, na, nb, prior = F.col("a") + alpha, F.col("b") + alpha, F.col("na"), F.col("nb"), F.col("prior")
    delta = F.ln(a / (na + prior - a)) - F.ln(b / (nb + prior - b))
    z = F.round(delta / F.sqrt(1 / a + 1 / b), 6)
    kept = counts.select("term", z.alias("z"), F.col("a").alias("n")).where((F.col("z") >= least_z) & (F.col("n") >= least_n))
    first = kept.orderBy(F.desc("z"), "term").limit(top)
    return first.select(F.row_number().over(Window.orderBy(F.desc("z"), "term")).alias("rank"), "term", "z", "n")


def fragments(docs: DataFrame, least: int = 60, most: int = 260) -> DataFrame:
    """(doc_id, fragment, first, last, words): lines packed in order until ``least`` words are reached.

    Lines are taken in pieces of ``most`` - ``least`` words, so that no fragment has more than ``most``; what is
    left under ``least`` at a document's end is dropped. (The packing rule is our choice.) first and last count
    a document's pieces from 1. The recurrence is a fold over each document's own array.
    """
    step = most - least
    counts = F.transform(F.split("text", "\n"), lambda line: F.size(F.regexp_extract_all(line, F.lit(r"\S+"), F.lit(0))))
    pieces = F.flatten(F.transform(counts, lambda n: F.concat(F.array_repeat(F.lit(step), F.floor(n / step).cast("int")), F.when(n % step > 0, F.array(n % step)).otherwise(F.array().cast("array<int>")))))
    empty = F.array().cast("array<struct<first:int,last:int,words:int>>")
    zero = F.struct(F.lit(0).alias("k"), F.lit(1).alias("first"), F.lit(0).alias("words"), empty.alias("out"))

    def pack(acc: Column, n: Column) -> Column:
        k, words = acc["k"] + 1, acc["words"] + n
        full = words >= least
        done = F.struct(acc["first"].alias("first"), k.alias("last"), words.alias("words"))
        return F.struct(k.alias("k"), F.when(full, k + 1).otherwise(acc["first"]).alias("first"), F.when(full, 0).otherwise(words).alias("words"), F.when(full, F.concat(acc["out"], F.array(done))).otherwise(acc["out"]).alias("out"))

    packed = docs.select("doc_id", F.aggregate(pieces, zero, pack, lambda acc: acc["out"]).alias("f"))
    return packed.select("doc_id", F.posexplode("f").alias("fragment", "f")).select("doc_id", "fragment", "f.first", "f.last", "f.words")
