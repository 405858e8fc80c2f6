"""Quotation linking of conversations, with DataFrame functions only.

Lines that begin with `>` quote an earlier message, `>>` one that it quoted itself, and
so on. A message falls into passages, runs of lines of one quote level. Quoted passages
of every level and their lines are hashed in normalised form and looked up among the
original texts of the same conversation. The message that explains most of the quotes of
the first level is what a message replies to; if none does, that of the next level with
a known original. Roots of threads come from pointer doubling over the replies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hallmark.llm.tables import step

_MARK = "^(?:[ \\t]{0,3}>)+"
#: Shorter normalised lines are too common to tell which message they are from, beside
#: longer ones of their passage.
LEAST_CHARS = 4
LINKS = "array<struct<passage int, level int, original bigint, chars bigint>>"


def normalised(text: Column) -> Column:
    """Lower case, white space as single spaces, without any at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), "[\\s\\p{Z}]+", " "))


def passages(text: Column) -> Column:
    """array<struct<level int, text string>>: runs of lines of one quote level."""
    return _runs(_lines(text))


def _lines(text: Column) -> Column:
    return F.transform(
        F.split(text, "\r\n|\n|\r", -1),
        lambda line: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(line, _MARK, 0), "[^>]", "")).alias("level"),
            F.regexp_replace(line, _MARK + " ?", "").alias("body"),
        ),
    )


def _runs(lines: Column) -> Column:
    starts = F.filter(
        F.sequence(F.lit(0), F.size(lines) - 1),
        lambda k: (k == 0) | (F.get(lines, k)["level"] != F.get(lines, k - 1)["level"]),
    )
    return F.transform(
        starts,
        lambda s, k: F.struct(
            F.get(lines, s)["level"].alias("level"),
            F.array_join(
                F.slice(lines, s + 1, F.coalesce(F.get(starts, k + 1), F.size(lines)) - s)["body"], "\n"
            ).alias("text"),
        ),
    )


def parsed(messages: DataFrame) -> DataFrame:
    """Adds `parts`, the passages, `own`, those without quotes, and `said`, these as one text.

    A line that ends in `wrote:` right before a quote goes with the quote. Messages that
    quote nothing keep their text as it is. Null texts are empty.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    quoting = text.rlike("(?m)" + _MARK)
    rows = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), text.alias("text"), F.when(quoting, _lines(text)).alias("lines"),
    )
    rows = rows.withColumn("parts", F.when(F.col("lines").isNotNull(), _runs(F.col("lines")))).drop("lines")
    own = F.transform(
        F.filter(
            F.transform("parts", lambda p, k: F.struct(p.alias("p"), F.get(F.col("parts"), k + 1)["level"].alias("then"))),
            lambda x: x["p"]["level"] == 0,
        ),
        lambda x: F.when(x["then"] > 0, F.regexp_replace(x["p"]["text"], "(?:^|\\n)[^\\n]*wrote:\\s*$", "")).otherwise(x["p"]["text"]),
    )
    kept = F.filter(F.transform(own, lambda x: F.regexp_replace(x, "^\\s+|\\s+$", "")), lambda x: x != "")
    rows = rows.withColumn("own", F.when(F.col("parts").isNull(), F.array("text")).otherwise(kept))
    return rows.withColumn("said", F.array_join("own", "\n"))


def _normal_lines(text: Column) -> Column:
    return F.transform(F.split(text, "\r\n|\n|\r", -1), normalised)


def _quoted_keys(text: Column) -> Column:
    """Normalised passage and its lines, each once. Lines too short to name a message are
    left out, unless the passage has no others."""
    lines = _normal_lines(text)
    long = F.filter(lines, lambda x: F.length(x) >= LEAST_CHARS)
    keys = F.concat(F.array(normalised(text)), F.when(F.size(long) > 0, long).otherwise(lines))
    return F.filter(F.array_distinct(keys), lambda x: x != "")


def _said_keys(said: Column, own: Column) -> Column:
    """Normalised text, passages and lines of what a message says itself, each once."""
    keys = F.concat(F.array(normalised(said)), F.transform(own, normalised), _normal_lines(said))
    return F.filter(F.array_distinct(keys), lambda x: x != "")


def _hash(text: Column) -> Column:
    return F.sha2(text, 256)


def quoted(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, body, passage, level, hash, chars, original): the known originals of
    quoted passages and their lines.

    An original is the earliest message of a conversation that says the text itself; it
    must be earlier than the quoting message. `body` is the digest of the quoting text,
    `passage` counts its quoted passages from 1.
    """
    able = rows.where("conv_id is not null and turn is not null")
    quotes = (
        able.where("parts is not null")
        .select("conv_id", "turn", _hash(F.col("text")).alias("body"), F.posexplode(F.filter("parts", lambda p: p["level"] > 0)).alias("nth", "part"))
        .select("conv_id", "turn", "body", (F.col("nth") + 1).alias("passage"), "part.level", F.explode(_quoted_keys(F.col("part.text"))).alias("key"))
        .select("conv_id", "turn", "body", "passage", "level", _hash(F.col("key")).alias("hash"), F.length("key").alias("chars"))
        .distinct()
    )
    quotes = step(quotes)
    quoting = quotes.select("conv_id").distinct()
    said = (
        able.join(quoting, "conv_id", "left_semi")
        .select("conv_id", "turn", F.explode(_said_keys(F.col("said"), F.col("own"))).alias("key"))
        .groupBy("conv_id", _hash(F.col("key")).alias("hash"))
        .agg(F.min("turn").alias("original"))
    )
    return step(quotes.join(said, ["conv_id", "hash"]).where("original < turn"))


def passage_links(met: DataFrame) -> DataFrame:
    """(conv_id, turn, body, links): the originals of each quoted passage.

    `links` has the passage, its level, an original and the characters found there, for
    each original of each passage; those of most characters first.
    """
    each = met.groupBy("conv_id", "turn", "body", "passage", "level", "original").agg(F.sum("chars").alias("chars"))
    entry = F.struct("passage", (-F.col("chars")).alias("less"), "original", "level")
    return each.groupBy("conv_id", "turn", "body").agg(
        F.transform(
            F.sort_array(F.collect_list(entry)),
            lambda x: F.struct(x["passage"].alias("passage"), x["level"].alias("level"), x["original"].alias("original"), (-x["less"]).alias("chars")),
        ).alias("links")
    )


def replies(met: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to): the message that each quoting message replies to.

    Quotes of the lowest level that have an original decide: those of deeper levels quote
    what the original quoted. The original of most quoted characters wins, then the later
    one. Messages whose quotes have no earlier original are left out.
    """
    once = met.select("conv_id", "turn", "level", "hash", "chars", "original").distinct()
    votes = once.groupBy("conv_id", "turn", "level", "original").agg(F.sum("chars").alias("chars"))
    return votes.groupBy("conv_id", "turn").agg(
        F.max_by("original", F.struct((-F.col("level")).alias("near"), "chars", "original")).alias("reply_to")
    )


def threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, root, depth) of each reply; pointers double each round."""
    links = step(links)
    paths = links.select("conv_id", "turn", "reply_to", F.col("reply_to").alias("root"), F.lit(1).alias("depth"))
    while True:
        on = paths.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("up"), F.col("depth").alias("more"))
        paths = step(
            paths.join(on, ["conv_id", "root"], "left").select(
                "conv_id", "turn", "reply_to", F.coalesce("up", "root").alias("root"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("up").isNotNull().alias("open"),
            )
        )
        if paths.where("open").isEmpty():
            return paths.drop("open")
        paths = paths.drop("open")


def reply_ordered(messages: DataFrame) -> DataFrame:
    """One row a message: (conv_id, position, turn, role, text, n_quoted, reply_to, root, depth, links).

    `text` is the message without its quotes, `n_quoted` the number of quoted passages,
    `reply_to` the turn it replies to (null if none), `root` the turn that began its
    thread and `depth` the replies from there. `position` counts a conversation's
    messages from 1 in reply order: threads by their root, messages of a thread by turn,
    so that each stands behind the one it replies to. `links` lists the originals of the
    quoted passages of every level, as (passage, level, original, chars); it is empty if
    none is known. Rows without a turn come first;
    repeated rows are returned as often, side by side; rows without a conv_id are
    numbered together under the null. Only conv_id, turn, role and text are read.
    """
    rows = parsed(messages)
    met = quoted(rows)
    threaded = threads(replies(met))
    linked = rows.withColumn("body", F.when(F.col("parts").isNotNull(), _hash(F.col("text")))).join(
        passage_links(met), ["conv_id", "turn", "body"], "left"
    )
    joined = linked.join(threaded, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", F.col("said").alias("text"),
        F.coalesce(F.size(F.filter("parts", lambda p: p["level"] > 0)), F.lit(0)).alias("n_quoted"),
        "reply_to", F.coalesce("root", "turn").alias("root"), F.coalesce("depth", F.lit(0)).alias("depth"),
        F.coalesce("links", F.array().cast(LINKS)).alias("links"),
    )
    order = ["conv_id", "root", "turn", "role", "text"]
    # A conversation of any size is numbered piece by piece, in ranges of the order.
    ranged = joined.repartitionByRange(*order).withColumn("piece", F.spark_partition_id())
    ranged = step(ranged)
    within = Window.partitionBy("conv_id", "piece").orderBy(*order[1:])
    pieces = ranged.groupBy("conv_id", "piece").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0))).drop("rows")
    numbered = ranged.withColumn("nth", F.row_number().over(within)).alias("r")
    same = F.col("r.conv_id").eqNullSafe(F.col("p.conv_id")) & (F.col("r.piece") == F.col("p.piece"))
    return numbered.join(pieces.alias("p"), same).select(
        "r.conv_id", (F.col("nth") + F.col("before")).alias("position"),
        *[F.col(f"r.{c}") for c in ("turn", "role", "text", "n_quoted", "reply_to", "root", "depth", "links")],
    )
