"""Quality rules whose cutoffs are chosen with a guarantee: few good documents of any stratum are rejected.

A rule rejects documents whose feature lies at or beyond a cutoff.  On labelled rows of a stratum the rejections
among good documents are binomial, so a cutoff is admitted if the exact (Clopper-Pearson) upper bound of their rate
is at most the rule's share of the risk, at a confidence that is divided by the number of all tests.  Of the
admitted cutoffs of a rule the one that rejects most bad documents, less PRICE times the good ones, is used, if
that is above 0; otherwise the rule is idle in that stratum.  DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairlead.llm.stage import stage

#: Largest rate of good documents that all rules of a stratum together may reject, and the chance of exceeding it.
RISK, DELTA = 0.05, 0.05
PRICE = 10
#: Cutoffs tried for each rule; a document at or beyond one is rejected.
CUTOFFS = {
    "symbol_rate": [0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3],
    "caps_rate": [0.08, 0.12, 0.2, 0.3, 0.4, 0.5],
    "dup_line_rate": [0.1, 0.2, 0.3, 0.5, 0.7],
    "repeat_rate": [0.02, 0.05, 0.08, 0.12, 0.16],
    "word_length": [9.0, 10.0, 11.0, 12.0, 14.0],
}


def base_columns(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, lang, ...)`` -> doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, caps."""
    text = F.coalesce(F.col("text"), F.lit(""))
    few = docs.select("doc_id", "lang", text.alias("text")).select("*", F.translate("text", "\t\n\v\f\r", "     ").alias("plain"))
    few = few.select(
        "*", F.array_remove(F.split("plain", " "), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.trim(F.translate(x, "\t\v\f\r", "    ")) != "").alias("lines"))
    window = F.transform(
        F.sequence(F.lit(0), F.size("words") - 5), lambda i: F.xxhash64(*[F.get(F.col("words"), i + k) for k in range(5)]))
    hashed = few.select(
        "doc_id", "lang", F.size("words").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"),
        F.length(F.translate("plain", " ", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        (F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("caps"),
        F.when(F.size("words") > 5, window).alias("h"))
    # only texts with some window twice go on: windows sorted by hash, those equal to a neighbour, and their places
    twice = F.when(F.size("h") != F.size(F.array_distinct("h")), F.col("h"))
    tied = hashed.withColumn("h", twice).withColumn("h", F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    tied = tied.withColumn("at", F.transform("h", lambda x: x["h"])).withColumn("at", F.zip_with(
        F.zip_with("at", F.slice("at", F.lit(2), F.size("at")), lambda a, b: F.coalesce(a == b, F.lit(False))),
        F.col("h"), lambda t, x: F.struct(t.alias("t"), x["i"].alias("i"))))
    last = F.lit(False).alias("t"), F.lit(-1).alias("i")
    tied = tied.withColumn("at", F.zip_with(
        "at", F.concat(F.array(F.struct(*last)), F.col("at")),
        lambda a, b: F.when(F.coalesce(a["t"], F.lit(False)) | b["t"], a["i"])))
    tied = tied.withColumn("at", F.sort_array(F.filter("at", lambda i: i.isNotNull())))
    covered = F.aggregate(
        F.col("at"), F.struct(F.lit(0).alias("n"), F.lit(-5).alias("end")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(5), i - s["end"])).alias("n"), i.alias("end")), lambda s: s["n"])
    return tied.select(
        "doc_id", "lang", "n_words", "n_lines", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "caps")


def features() -> dict[str, Column]:
    """The feature of each rule, higher being worse; null where it has no value."""
    per = lambda x, n: F.col(x) / F.nullif(F.col(n), F.lit(0).cast("long"))
    return {
        "symbol_rate": per("n_symbols", "word_chars"), "caps_rate": per("caps", "word_chars"),
        "dup_line_rate": per("n_dup_lines", "n_lines"), "repeat_rate": per("n_repeat_words", "n_words"),
        "word_length": per("word_chars", "n_words"),
    }


def binomial_at_most(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial (n, p), summed term by term in logarithms, so that no term underflows."""
    none = n * F.log(F.lit(1 - p))

    def add(s: Column, i: Column) -> Column:
        term = s["term"] + F.log((n - i + 1) / i) + F.log(F.lit(p / (1 - p)))
        return F.struct(term.alias("term"), (F.greatest(s["sum"], term) + F.log1p(F.exp(-F.abs(s["sum"] - term)))).alias("sum"))

    places = F.when(k > 0, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.exp(F.aggregate(places, F.struct(none.alias("term"), none.alias("sum")), add, lambda s: s["sum"]))


def cutoffs(base: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """stratum, rule, cutoff, n_good, good_rejected, bad_rejected: the cutoffs chosen from labelled rows.

    ``base`` has the columns of ``base_columns`` and base_failed; rows that fail it are decided already and are no
    evidence.  ``labels(doc_id, quality)``: 1 is good, 0 bad, other values are left out.  A null stratum is one of
    its own.  At most one row for each stratum and rule.
    """
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = base.where(~F.col("base_failed")).join(known, "doc_id")
    rows = rows.select(F.col("lang").alias("stratum"), "quality", *[f.alias(r) for r, f in features().items()])
    tests = [(r, c) for r, cs in CUTOFFS.items() for c in cs]
    good, counts = F.col("quality") == 1, []
    for i, (r, c) in enumerate(tests):
        hit = F.coalesce(F.col(r) >= c, F.lit(False))
        counts += [F.count_if(hit & good).alias(f"g{i}"), F.count_if(hit & ~good).alias(f"b{i}")]
    table = rows.groupBy("stratum").agg(F.count_if(good).alias("n_good"), *counts)
    table = table.withColumn("strata", F.count("*").over(Window.partitionBy(F.lit(1))))  # one row for each stratum
    cells = F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"g{i}").alias("good_rejected"), F.col(f"b{i}").alias("bad_rejected"))
        for i, (r, c) in enumerate(tests)])
    tried = table.select("stratum", "n_good", "strata", F.explode(cells).alias("t")).select("stratum", "n_good", "strata", "t.*")
    chance = binomial_at_most(F.col("good_rejected"), F.col("n_good"), risk / len(CUTOFFS))
    gain = F.col("bad_rejected") - PRICE * F.col("good_rejected")
    admitted = tried.where((gain > 0) & (chance <= F.lit(delta) / (len(tests) * F.col("strata"))))
    best = Window.partitionBy("stratum", "rule").orderBy(gain.desc(), F.col("cutoff").desc())
    return admitted.withColumn("place", F.row_number().over(best)).where("place = 1").select(
        "stratum", "rule", "cutoff", "n_good", "good_rejected", "bad_rejected")


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """``docs(doc_id, text, lang, ...)`` -> doc_id, the base columns, base_failed, kept, failed_rules; one row for each row.

    Null text has no words, and fails.  A null lang is a stratum of its own.  Without labels, or with too few to admit
    a cutoff, only base_failed rejects.  Rows alike are judged alike; other columns are not read.
    """
    n, repeats = F.col("n_words"), F.col("n_repeat_words")
    base = stage(base_columns(docs).withColumn("base_failed", (n < 10) | (100 * repeats > 20 * n)), "base")
    chosen = cutoffs(base, labels, risk, delta).groupBy("stratum").agg(
        *[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in CUTOFFS])
    ruled = base.join(F.broadcast(chosen), F.col("lang").eqNullSafe(F.col("stratum")), "left")  # one row for each stratum
    failed = F.array_compact(F.array(*[F.when(f >= F.col(f"cut_{r}"), F.lit(r)) for r, f in features().items()]))
    return ruled.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size(failed) == 0)).alias("kept"), failed.alias("failed_rules"))
