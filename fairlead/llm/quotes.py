"""Quotation linking: nested quotes parsed, hashed and joined to the messages they come from; replies in order.

A line that begins with ">" is a quote, its level the number of such marks.  Each run of lines of one level is a
passage; it and each of its lines are hashed after normalising.  Bodies without their quotes are hashed alike.  A
quote is linked to the latest earlier message of its conversation whose body has it, and a message replies to the
message that most of its outermost linked quotes come from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairlead.llm.stage import drop, stage

#: Normalised passages of fewer characters are no evidence.
MIN_CHARS = 8
_MARK = r"^[ \t]*((?:>[ \t]*)+)"
#: A line that introduces a quote, such as "On Monday A wrote:", is taken off with the quote below it.
_LEAD = r"(?i)^[ \t]*(on|le|am|el)\b.*(wrote|a écrit|schrieb|escribió):[ \t]*$"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def parse(messages: DataFrame) -> DataFrame:
    """``messages`` with ``_lines``: (level, text) of each line, level 0 being the body.  Null text has no lines."""
    marks = F.transform(F.split("text", "\n"), lambda x: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(x, _MARK, 1), r"[^>]", "")).alias("level"),
        F.regexp_replace(x, _MARK, "").alias("text")))
    rows = messages.withColumn("_marks", marks)
    lead = F.transform("_marks", lambda x, i: F.struct(
        F.when((x["level"] == 0) & x["text"].rlike(_LEAD) & (F.coalesce(F.get("_marks", i + 1)["level"], F.lit(0)) > 0), F.lit(1))
        .otherwise(x["level"]).alias("level"),
        F.when((x["level"] == 0) & x["text"].rlike(_LEAD) & (F.coalesce(F.get("_marks", i + 1)["level"], F.lit(0)) > 0), F.lit(""))
        .otherwise(x["text"]).alias("text")))
    return rows.withColumn("_lines", lead).drop("_marks")


def body(lines: str = "_lines") -> Column:
    """Text of level 0, without the empty lines that quotes leave at its ends."""
    kept = F.array_join(F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["text"]), "\n")
    return F.when(F.exists(lines, lambda x: x["level"] > 0), F.trim(kept, F.lit("\n"))).otherwise(kept)


def passages(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, level, hash, weight of every line and every run of lines of one level."""
    lines = parsed.select("conv_id", "turn", F.posexplode("_lines").alias("at", "x")).select(
        "conv_id", "turn", "at", F.col("x.level").alias("level"), F.col("x.text").alias("text"))
    # lines of a run are joined by a space; a new run, or an empty line, begins with its level between two marks
    clean = F.transform("_lines", lambda x: F.struct(x["level"].alias("level"), F.translate(x["text"], "\x01\x02", "  ").alias("text")))
    before = F.concat(F.array(F.struct(F.lit(-1).alias("level"), F.lit("").alias("text"))), clean)
    joined = F.array_join(F.zip_with(clean, before, lambda x, p: F.concat(
        F.when((x["level"] == p["level"]) & (F.trim(x["text"]) != ""), F.lit(" ")).otherwise(
            F.concat(F.lit("\x01"), x["level"].cast("string"), F.lit("\x02"))), x["text"])), "")
    whole = parsed.where(F.size("_lines") > 1).select("conv_id", "turn", F.explode(F.split(joined, "\x01")).alias("x")).where("x <> ''").select(
        "conv_id", "turn", F.substring_index("x", "\x02", 1).cast("int").alias("level"), F.substring_index("x", "\x02", -1).alias("text"))
    both = lines.select("conv_id", "turn", "level", "text").unionByName(whole).withColumn("norm", normalised(F.col("text")))
    return both.where(F.length("norm") >= MIN_CHARS).select(
        "conv_id", "turn", "level", F.md5("norm").alias("hash"), F.length("norm").alias("weight")).distinct()


def reply_links(found: DataFrame) -> DataFrame:
    """``passages`` -> conv_id, turn, reply_to, n_linked: each message's best earlier message.

    One sorted pass over the rows of a passage finds the latest earlier original, so a line that a conversation
    repeats any number of times is never paired with itself.  Quotes of the lowest linked level decide, by the
    characters they share; ties go to the later message.
    """
    order = Window.partitionBy("conv_id", "hash").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    origin = F.max(F.when(F.col("level") == 0, F.col("turn"))).over(order)
    linked = found.withColumn("origin", origin).where((F.col("level") > 0) & F.col("origin").isNotNull())
    votes = linked.groupBy("conv_id", "turn", "level", "origin").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))
    best = F.min(F.struct("level", (-F.col("weight")).alias("w"), (-F.col("origin")).alias("o")))
    return votes.groupBy("conv_id", "turn").agg(best.alias("best"), F.sum("n").alias("n_linked")).select(
        "conv_id", "turn", (-F.col("best.o")).alias("reply_to"), "n_linked")


def thread_roots(links: DataFrame) -> DataFrame:
    """``links(conv_id, turn, reply_to)`` -> conv_id, turn, root, depth, by pointer doubling: each round halves the paths."""
    cur = stage(links.select("conv_id", "turn", F.col("reply_to").alias("up"), F.lit(1).cast("long").alias("depth")), "threads")
    while True:
        above = cur.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"))
        nxt = stage(cur.join(above, ["conv_id", "up"], "left").select(
            "conv_id", "turn", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"),
            F.col("up2").isNotNull().alias("moved")), "threads")
        drop(cur)
        cur = nxt.drop("moved")
        if not nxt.where("moved").head(1):
            return cur.withColumnRenamed("up", "root")


def link_conversations(messages: DataFrame) -> DataFrame:
    """``messages(conv_id, turn, role, text, ...)`` -> one row for each, ordered within a conversation by
    (thread_root, reply_depth, turn): conv_id, turn, role, text (without quotes), n_quoted_lines, quote_depth,
    n_linked, reply_to, thread_root, reply_depth.

    A message without a linked quote replies to nothing and begins a thread.  A null text stays null; an empty one
    stays empty.  Rows repeated with one (conv_id, turn) share what is found for that turn; a quote is never linked
    to its own turn.  Rows with a null conv_id or turn are not linked.  Other columns are not read.
    """
    parsed = stage(parse(messages.select("conv_id", "turn", "role", "text")), "parsed")
    usable = parsed.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    links = stage(reply_links(passages(usable)), "links")
    threads = thread_roots(links)
    known = links.join(threads, ["conv_id", "turn"])
    quoted = F.filter("_lines", lambda x: x["level"] > 0)
    return parsed.select(
        "conv_id", "turn", "role", F.when(F.col("text").isNotNull(), body()).alias("text"),
        F.coalesce(F.size(quoted), F.lit(0)).cast("long").alias("n_quoted_lines"),
        F.coalesce(F.array_max(F.transform("_lines", lambda x: x["level"])), F.lit(0)).cast("long").alias("quote_depth"),
    ).join(known, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "text", "n_quoted_lines", "quote_depth", F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"),
        "reply_to", F.coalesce("root", "turn").alias("thread_root"), F.coalesce("depth", F.lit(0).cast("long")).alias("reply_depth"))
