"""Quotation linking: replies found by what they quote, conversations in reply order without the quotes.

A line that begins with > is quoted, once for each further >. Consecutive quoted
lines of one level, up to an empty one, are a passage; its lines are joined and
normalised (marks off, lower case, white space collapsed, line breaks too), so that
it does not matter where they were wrapped. A passage is looked for in the messages of
its conversation by 64-bit hash: among their own lines, else anywhere in the words of
their own text, where windows of its first words say at which places all of it is
hashed. If it is nowhere as a whole its lines are looked for one by one, whole own
lines before parts, longer parts before shorter. A passage links to the latest such
message before the reply. A message's parent is the latest message that its least
deeply quoted linked passages link to. A thread is what hangs together by parents;
threads stand in the order of their first messages, and a thread's messages in the
order of their turns, so that a reply comes after what it replies to.

Own and quoted text meet as one ordered stream for each hash and conversation,
so no pairs arise. Streams are parted by spans of turns; what a span needs from those
before it is one turn. A conversation of any length is so never in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from psephos.llm import cluster

#: Turns of a span.
SPAN = 512
#: Words of the windows that a passage is looked for by: as many as its first words fill.
WINDOWS = (8, 4, 2, 1)

MARK = r"^\s*>"
#: The line before a quote that says whose it is.
ATTRIBUTION = r"^\s*(?:On|Am|Le|El)\b.{0,300}(?:wrote|schrieb|a écrit|escribió)\s*:\s*$"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\r\n|\n|\r")


def level(line: Column) -> Column:
    """How deep a line is quoted."""
    return F.length(F.regexp_replace(F.regexp_extract(line, r"^(\s*>[>\s]*)", 1), r"\s", ""))


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, r"^\s*>[>\s]*", "")), r"\s+", " "))


def own_lines(all_lines: Column) -> Column:
    """The lines that are not quoted, nor say whose the next, quoted one is."""
    after = lambda i: F.coalesce(F.try_element_at(all_lines, i + 2), F.lit(""))
    return F.filter(all_lines, lambda x, i: ~x.rlike(MARK) & ~(x.rlike(ATTRIBUTION) & after(i).rlike(MARK)))


def passages(split: DataFrame) -> DataFrame:
    """(conv_id, turn, m, p, line, level, s): the quoted passages p of every message m, line null, and the lines of those with several.

    split are messages (conv_id, turn, l) with their lines. A quoted line that says whose the more deeply quoted next one is counts as none.
    """
    marked = F.transform("l", lambda x, i: F.struct(i.alias("line"), x.alias("x"), F.coalesce(F.try_element_at("l", i + 2), F.lit("")).alias("after")))
    q = split.where(F.exists("l", lambda x: x.rlike(MARK))).select("conv_id", "turn", F.monotonically_increasing_id().alias("m"), F.explode(F.filter(marked, lambda y: y["x"].rlike(MARK))).alias("y"))
    q = q.select("conv_id", "turn", "m", "y.line", level(F.col("y.x")).alias("level"), normalised(F.col("y.x")).alias("s"), (F.regexp_replace("y.x", r"^\s*>[>\s]*", "").rlike(ATTRIBUTION) & (level(F.col("y.after")) > level(F.col("y.x")))).alias("says"))
    q = q.where("s <> '' and not says").drop("says")
    by = Window.partitionBy("conv_id", "turn", "m").orderBy("line")
    begins = F.coalesce((F.col("line") - F.lag("line").over(by) != 1) | (F.col("level") != F.lag("level").over(by)), F.lit(True))
    q = q.withColumn("p", F.sum(begins.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    group = ["conv_id", "turn", "m", "p", "level"]
    whole = q.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("line", "s"))).alias("of"))
    whole = whole.withColumn("units", F.concat(F.array(F.struct(F.lit(None).cast("int").alias("line"), F.array_join("of.s", " ").alias("s"))), F.when(F.size("of") > 1, F.col("of")).otherwise(F.slice("of", 1, 0))))
    return whole.select(*group, F.explode("units").alias("u")).select("conv_id", "turn", "m", "p", "u.line", "level", "u.s")


def _as_line(s: Column) -> Column:
    return F.xxhash64(F.lit("line"), s)


def _as_words(s: Column) -> Column:
    return F.xxhash64(F.lit("words"), s)


def _holders(own: DataFrame, wanted: DataFrame) -> DataFrame:
    """(conv_id, turn, h) of the messages own (conv_id, turn, m, words) in whose words stand passages wanted (conv_id, s), some others with them."""
    n = F.size("q")
    w = wanted.withColumn("q", F.split("s", " ")).withColumn("n", n).withColumn("w", F.coalesce(*[F.when(n >= k, k) for k in WINDOWS]))
    w = w.select("conv_id", "n", "w", F.xxhash64(F.array_join(F.slice("q", F.lit(1), F.col("w")), " ")).alias("first")).distinct()
    some = own.join(w.groupBy("conv_id").agg(F.collect_set("w").alias("ws")), "conv_id").withColumn("w", F.explode("ws")).where(F.size("words") >= F.col("w"))
    hashes = F.transform(F.sequence(F.lit(1), F.size("words") - F.col("w") + 1), lambda i: F.xxhash64(F.array_join(F.slice("words", i, F.col("w")), " ")))
    places = some.select("conv_id", "turn", "m", "w", F.posexplode(hashes).alias("at", "first")).join(w, ["conv_id", "w", "first"])
    places = places.groupBy("conv_id", "turn", "m").agg(F.collect_set(F.struct("at", "n")).alias("places"))
    held = own.join(places, ["conv_id", "turn", "m"])
    found = F.transform("places", lambda x: _as_words(F.array_join(F.slice("words", x["at"] + 1, x["n"]), " ")))
    return held.select("conv_id", "turn", F.explode(F.array_distinct(found)).alias("h"))


def links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn) of messages (conv_id, turn, text) that quote an earlier one."""
    split = messages.withColumn("l", lines(F.col("text")))
    units = cluster.cut(passages(split))
    asked = units.select("*", F.explode(F.array(F.struct(F.lit(0).alias("part"), _as_line(F.col("s")).alias("h")), F.struct(F.lit(1).alias("part"), _as_words(F.col("s")).alias("h")))).alias("k")).select("*", "k.part", "k.h").drop("k")
    quoted = cluster.cut(asked.select("conv_id", "turn", "h").distinct())
    # only text that is quoted somewhere in the conversation goes on
    own = split.join(quoted.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "turn", F.filter(F.transform(own_lines(F.col("l")), normalised), lambda x: x != "").alias("o"))
    own = cluster.cut(own.where(F.size("o") > 0).select("conv_id", "turn", F.monotonically_increasing_id().alias("m"), "o", F.split(F.array_join("o", " "), " ").alias("words")))
    whole = own.select("conv_id", "turn", F.explode("o").alias("x")).select("conv_id", "turn", _as_line(F.col("x")).alias("h"))
    own = whole.unionByName(_holders(own, units.select("conv_id", "s").distinct())).distinct()
    own = own.join(quoted.select("conv_id", "h").distinct(), ["conv_id", "h"], "left_semi")

    both = quoted.select("conv_id", "h", "turn", F.lit(True).alias("asks"), F.lit(None).cast("long").alias("own")).unionByName(own.select("conv_id", "h", "turn", F.lit(False).alias("asks"), F.col("turn").alias("own")))
    both = cluster.cut(both.withColumn("span", F.floor(F.col("turn") / SPAN)))
    spans = both.groupBy("conv_id", "h", "span").agg(F.max("own").alias("last"))
    carried = spans.withColumn("carried", F.max("last").over(Window.partitionBy("conv_id", "h").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))).drop("last")
    within = F.max("own").over(Window.partitionBy("conv_id", "h", "span").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1))
    linked = both.withColumn("within", within).where("asks").join(carried, ["conv_id", "h", "span"])
    linked = linked.select("conv_id", "turn", "h", F.coalesce("within", "carried").alias("to")).where("to is not null")
    hits = asked.join(linked, ["conv_id", "turn", "h"])
    best = F.struct(F.col("line").isNotNull(), "part", F.when(F.col("part") == 1, -F.size(F.split("s", " "))).otherwise(0), -F.col("to"))
    linked = hits.groupBy("conv_id", "turn", "m", "p", "level").agg(F.min_by("to", best).alias("to"))
    return linked.groupBy("conv_id", "turn").agg(F.min_by(F.col("to"), F.struct("level", -F.col("to"))).alias("parent_turn"))


def thread_roots(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn) of the messages that have a parent, by doubling pointers."""
    at = cluster.cut(parents.select("conv_id", "turn", F.col("parent_turn").alias("root_turn")))
    while True:
        up = at.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("further"))
        joined = cluster.cut(at.join(up, ["conv_id", "root_turn"], "left"))
        if not joined.where("further is not null").head(1):
            return at
        at = joined.select("conv_id", "turn", F.coalesce("further", "root_turn").alias("root_turn"))


def link(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, parent_turn, root_turn, position, n_quoted, text) of every message.

    conversations are (conv_id, turn, role, text). position is gapless from 0 in a
    conversation. A message without a quote that is found earlier has no parent and
    begins a thread. Null texts stay null, empty ones have no lines to quote; repeated
    rows are messages of their own, at one turn. A message without conv_id or turn links
    with nothing and has no position. Other columns are ignored.
    """
    c = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    placed = c.where("conv_id is not null and turn is not null")
    parents = cluster.cut(links(placed))
    roots = thread_roots(parents)
    all_lines = lines(F.col("text"))
    own = F.when(F.col("text").isNull(), None).otherwise(F.regexp_replace(F.array_join(own_lines(all_lines), "\n"), r"^\n+|\n+$", ""))
    shaped = c.select("conv_id", "turn", "role", F.size(F.filter(all_lines, lambda x: x.rlike(MARK))).cast("long").alias("n_quoted"), own.alias("text"))
    rows = shaped.where("conv_id is not null and turn is not null").join(parents, ["conv_id", "turn"], "left").join(roots, ["conv_id", "turn"], "left")
    rows = cluster.cut(rows.withColumn("root_turn", F.coalesce("root_turn", "turn")).withColumn("_s", F.floor(F.col("turn") / SPAN)).withColumn("_r", F.floor(F.col("root_turn") / SPAN)))

    runs = rows.groupBy("conv_id", "_r", "root_turn", "_s").agg(F.count("*").alias("_n"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inner = runs.withColumn("_p", F.coalesce(F.sum("_n").over(before(Window.partitionBy("conv_id", "_r").orderBy("root_turn", "_s"))), F.lit(0)))
    outer = runs.groupBy("conv_id", "_r").agg(F.sum("_n").alias("_n")).withColumn("_q", F.coalesce(F.sum("_n").over(before(Window.partitionBy("conv_id").orderBy("_r"))), F.lit(0))).drop("_n")
    starts = inner.join(outer, ["conv_id", "_r"]).select("conv_id", "_r", "root_turn", "_s", (F.col("_p") + F.col("_q")).alias("_at"))
    number = F.row_number().over(Window.partitionBy("conv_id", "_r", "root_turn", "_s").orderBy("turn", "role", "text")) - 1
    out = rows.withColumn("_i", number).join(starts, ["conv_id", "_r", "root_turn", "_s"])
    names = ["conv_id", "turn", "role", "parent_turn", "root_turn", "position", "n_quoted", "text"]
    lost = shaped.where("conv_id is null or turn is null").select("*", *[F.lit(None).cast("long").alias(x) for x in ("parent_turn", "root_turn", "position")])
    return out.withColumn("position", (F.col("_at") + F.col("_i")).cast("long")).select(*names).unionByName(lost.select(*names))
