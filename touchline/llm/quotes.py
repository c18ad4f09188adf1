"""Chat formatting by quotation linking, in DataFrame functions alone.

Lines that open with '>' marks are quoted, their level is the number of marks. Adjacent quoted lines of one level are a passage. A
passage is normalised (lower case, all white space as single blanks), hashed and joined to what earlier messages of its conversation
wrote themselves, treated alike: whole messages, paragraphs, lines and sentences. It leads to the latest earlier message that wrote
it as one of these. A passage that none wrote so, as parts of a text do, is cut into its runs of `RUN` words: if each of them was
written before, it leads to the earliest of the messages that wrote them last, later than which none can hold the passage.

A message replies to the latest message that one of its least-quoted passages leads to. Replies join the thread of what they reply
to, and a conversation reads by thread (the turn that it began with), then by position, each message without quotes and
attribution lines.

No conversation is ever gathered, so one of any length is as good as many: the latest earlier writing is found by windows over
`SPAN` turns of one hash, with one row for each span before. Passages are put together inside their message's row.

Defined results: null text counts as empty, a null role as 'unknown'; messages of an equal conversation and turn each give a row
and share their links; messages without a conversation or turn take part without links; blank quoted lines part passages; an
empty table gives no rows; texts of any length are read whole; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import settle

QUOTED = r"^[ \t]*>"
MARKS = r"^[ \t]*(>[ \t]*)+"
ATTRIBUTION = r"^On .*wrote:[ \t\r]*$"
RUN = 5
SPAN = 4096


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"[\x01-\x20]+", " ")))


def _plain(lines: Column) -> Column:
    """Lines that a message wrote itself."""
    return F.filter(lines, lambda x: ~x.rlike(QUOTED) & ~x.rlike(ATTRIBUTION))


def _passages(lines: Column) -> Column:
    """Array of (level, text) of the quoted passages of a message's lines."""
    said = lambda x: normalised(F.regexp_replace(x, MARKS, ""))
    marks = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", ""))
    each = F.transform(lines, lambda x: F.when(x.rlike(QUOTED) & (said(x) != ""), F.struct(marks(x).alias("level"), said(x).alias("said"))).otherwise(F.struct(F.lit(0).alias("level"), F.lit("").alias("said"))))

    def joined(rows: Column) -> Column:
        """Lines of one level follow each other after a blank; where the level changes, U+0001 and the level open a passage."""
        opens = lambda x: F.concat(F.lit("\x01"), x["level"].cast("string"), F.lit("\x02"), x["said"])
        same = lambda x, i: (i > 0) & (F.get(rows, i - 1)["level"] == x["level"])
        return F.array_join(F.transform(rows, lambda x, i: F.when(same(x, i), F.concat(F.lit(" "), x["said"])).otherwise(opens(x))), "")

    parts = F.filter(F.split(_let(each, joined), "\x01"), lambda x: (x != "") & ~x.startswith("0"))
    return F.transform(parts, lambda x: F.struct(F.substring_index(x, "\x02", 1).cast("int").alias("level"), F.substring_index(x, "\x02", -1).alias("text")))


def _let(value: Column, body) -> Column:
    """body(value) with the value worked out once; inside a lambda an expression is worked out again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _runs(text: Column) -> Column:
    """Hashes of the runs of RUN words of a normalised text; none of fewer words."""

    def cut(words: Column) -> Column:
        n = F.size(words)
        at = F.when(n >= RUN, F.sequence(F.lit(1), n - (RUN - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(F.lit("run"), F.array_join(F.slice(words, i, RUN), " ")))

    return _let(F.split(text, " "), cut)


def _unit(text: Column) -> Column:
    return F.xxhash64(F.lit("unit"), text)


def _written(own: Column) -> Column:
    """Hashes of what a text holds: itself, its paragraphs, lines and sentences, and its runs of words."""

    def of(whole: Column) -> Column:
        sentences = F.split(F.regexp_replace(whole, r"([.!?]) ", "$1\x01"), "\x01")
        units = F.concat(F.array(whole), F.transform(F.split(own, r"\n[ \t\r]*\n"), normalised), F.transform(F.split(own, "\n"), normalised), sentences)
        units = F.transform(F.filter(F.array_distinct(units), lambda u: u != ""), _unit)
        return F.array_distinct(F.concat(units, _runs(whole)))

    return _let(normalised(own), of)


def _latest(asked: DataFrame, written: DataFrame) -> DataFrame:
    """The asked (conv_id, turn, hash, ...) with `origin`, the latest earlier turn that wrote the hash."""
    span = F.floor(F.col("turn") / SPAN)
    rows = asked.withColumn("wrote", F.lit(None).cast("long")).unionByName(written.withColumn("wrote", F.col("turn")), True).withColumn("span", span)
    key = ["conv_id", "hash"]
    here = F.max("wrote").over(Window.partitionBy(*key, "span").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1))
    spans = rows.groupBy(*key, "span").agg(F.max("wrote").alias("last"))
    before = F.max("last").over(Window.partitionBy(*key).orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("before", before).where("span > 0 and before is not null").drop("last")
    found = rows.withColumn("here", here).where("wrote is null").join(spans, [*key, "span"], "left")
    return found.withColumn("origin", F.coalesce("here", "before")).drop("here", "before", "span", "wrote")


def replies(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to): the message that each quoting message replies to."""
    rows = messages.where("conv_id is not null and turn is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), F.split("text", "\n").alias("lines"))
    quoting = rows.where(F.exists("lines", lambda x: x.rlike(QUOTED)))
    passages = quoting.select("conv_id", "turn", F.explode(F.array_distinct(_passages(F.col("lines")))).alias("p")).select("conv_id", "turn", "p.level", "p.text")
    runs = F.array_distinct(_runs(F.col("text")))
    asked = passages.select("conv_id", "turn", "level", _unit(F.col("text")).alias("unit"), F.explode(F.concat(F.array(_unit(F.col("text"))), runs)).alias("hash"))
    concerned = quoting.select("conv_id").distinct()
    own = rows.join(concerned, "conv_id", "left_semi").select("conv_id", "turn", F.array_join(_plain(F.col("lines")), "\n").alias("own"))
    written = own.select("conv_id", "turn", F.explode(_written(F.col("own"))).alias("hash")).distinct()
    found = _latest(asked.distinct(), written)
    whole, run = F.col("hash") == F.col("unit"), F.col("hash") != F.col("unit")
    by_passage = found.groupBy("conv_id", "turn", "level", "unit").agg(
        F.max(F.when(whole, F.col("origin"))).alias("one"), F.count_if(run).alias("runs"), F.count_if(run & F.col("origin").isNotNull()).alias("known"),
        F.min(F.when(run, F.col("origin"))).alias("parts"),
    )
    origin = F.coalesce("one", F.when((F.col("runs") > 0) & (F.col("known") == F.col("runs")), F.col("parts")))
    by_level = by_passage.withColumn("origin", origin).where("origin is not null").groupBy("conv_id", "turn", "level").agg(F.max("origin").alias("origin"))
    return by_level.groupBy("conv_id", "turn").agg(F.min_by("origin", "level").alias("reply_to"))


def threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, thread, depth, position) of the replies, by pointer doubling: log2(depth) joins on the message.

    Replies whose thread has no reply itself have arrived and sit out further rounds. A reply's position is its place in its thread
    by turn, after the message that began it.
    """
    key = ["conv_id", "thread"]
    links = settle(links)
    now, done = links.select("conv_id", "turn", "reply_to", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth")), None
    steps = now.select("conv_id", "turn", "thread", "depth")
    while True:
        up = steps.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("up"), F.col("depth").alias("more"))
        both = settle(now.join(up, key, "left"))
        there = both.where("up is null").drop("up", "more")
        done = there if done is None else done.union(there)
        now = both.where("up is not null").select("conv_id", F.col("up").alias("thread"), "turn", "reply_to", (F.col("depth") + F.col("more")).alias("depth"))
        if not now.limit(1).count():
            break
        moved = now.select("conv_id", "turn", "thread", "depth")  # steps of those that have arrived stay as they are
        steps = settle(moved.union(done.select("conv_id", "turn", "thread", "depth")))
    done = done.withColumn("span", F.floor(F.col("turn") / SPAN))
    spans = done.groupBy(*key, "span").agg(F.count("*").alias("n"))
    spans = spans.select(*key, "span", F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.rank().over(Window.partitionBy(*key, "span").orderBy("turn"))
    placed = done.withColumn("place", place).join(spans, [*key, "span"])
    return placed.select("conv_id", "turn", "reply_to", "thread", "depth", (F.col("place") + F.col("before")).cast("long").alias("position"))


def conversations(messages: DataFrame) -> DataFrame:
    """One row per message, to be read by conv_id, thread, position: who replies to whom, and the message in chat format."""
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    linked = threads(replies(rows)).withColumnRenamed("conv_id", "c").withColumnRenamed("turn", "t")
    lines = F.split("text", "\n")
    quoted = F.size(F.filter(lines, lambda x: x.rlike(QUOTED)))
    content = F.regexp_replace(F.array_join(_plain(lines), "\n"), r"^\n+|\n+$", "")
    out = rows.select(
        "conv_id", "turn", "role", quoted.cast("long").alias("n_quoted"), content.alias("content")
    ).join(linked, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "conv_id", F.coalesce("thread", "turn").alias("thread"), F.coalesce("position", zero).alias("position"), "turn", F.coalesce("depth", zero).alias("depth"),
        "reply_to", "role", "n_quoted", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "content").alias("chat"),
    )


#: The same in DuckDB.
ORACLE = r"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, string_split(coalesce(text, ''), chr(10)) AS lines FROM conversations
), lines AS (
  SELECT row_number() OVER () AS m, conv_id, turn, lines FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), said AS (
  SELECT m, conv_id, turn, pos, regexp_matches(line, '^[ \t]*>') AS quoted, line,
    length(regexp_replace(regexp_extract(line, '^[ \t]*(>[ \t]*)+', 0), '[^>]', '', 'g')) AS marks,
    lower(trim(regexp_replace(regexp_replace(line, '^[ \t]*(>[ \t]*)+', ''), '[\x01-\x20]+', ' ', 'g'))) AS said
  FROM (SELECT m, conv_id, turn, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM lines)
), levels AS (
  SELECT *, CASE WHEN quoted AND said <> '' THEN marks ELSE 0 END AS level FROM said
), changes AS (
  SELECT *, CASE WHEN level = lag(level) OVER (PARTITION BY m ORDER BY pos) THEN 0 ELSE 1 END AS fresh FROM levels
), numbered AS (
  SELECT *, sum(fresh) OVER (PARTITION BY m ORDER BY pos) AS passage FROM changes
), passages AS (
  SELECT DISTINCT conv_id, turn, level, text FROM (SELECT conv_id, turn, level, string_agg(said, ' ' ORDER BY pos) AS text FROM numbered WHERE level > 0 GROUP BY m, conv_id, turn, passage, level)
), own AS (
  SELECT conv_id, turn, array_to_string(list_filter(lines, lambda x: NOT regexp_matches(x, '^[ \t]*>') AND NOT regexp_matches(x, '^On .*wrote:[ \t\r]*$')), chr(10)) AS own
  FROM lines WHERE conv_id IN (SELECT conv_id FROM passages)
), normal AS (
  SELECT *, lower(trim(regexp_replace(own, '[\x01-\x20]+', ' ', 'g'))) AS whole FROM own
), units AS (
  SELECT DISTINCT conv_id, turn, lower(trim(regexp_replace(u, '[\x01-\x20]+', ' ', 'g'))) AS unit FROM (
    SELECT conv_id, turn, unnest(list_concat([whole], string_split_regex(own, '\n[ \t\r]*\n'), string_split(own, chr(10)), string_split(regexp_replace(whole, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)))) AS u FROM normal)
), written AS (
  SELECT DISTINCT conv_id, turn, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS run FROM (SELECT conv_id, turn, string_split(whole, ' ') AS w FROM normal)
), ones AS (
  SELECT p.conv_id, p.turn, p.level, p.text, max(u.turn) AS origin FROM passages p JOIN units u ON u.conv_id = p.conv_id AND u.unit = p.text AND u.turn < p.turn AND p.text <> '' GROUP BY ALL
), asked AS (
  SELECT DISTINCT conv_id, turn, level, text, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS run FROM (SELECT *, string_split(text, ' ') AS w FROM passages)
), latest AS (
  SELECT a.conv_id, a.turn, a.level, a.text, a.run, max(w.turn) AS origin FROM asked a LEFT JOIN written w ON w.conv_id = a.conv_id AND w.run = a.run AND w.turn < a.turn GROUP BY ALL
), parts AS (
  SELECT conv_id, turn, level, text, min(origin) AS origin FROM latest GROUP BY ALL HAVING count(*) = count(origin)
), origins AS (
  SELECT p.conv_id, p.turn, p.level, coalesce(o.origin, r.origin) AS origin FROM passages p LEFT JOIN ones o ON o.conv_id = p.conv_id AND o.turn = p.turn AND o.level = p.level AND o.text = p.text
  LEFT JOIN parts r ON r.conv_id = p.conv_id AND r.turn = p.turn AND r.level = p.level AND r.text = p.text
), by_level AS (
  SELECT conv_id, turn, level, max(origin) AS origin FROM origins WHERE origin IS NOT NULL GROUP BY ALL
), links AS (
  SELECT conv_id, turn, arg_min(origin, level) AS reply_to FROM by_level GROUP BY conv_id, turn
), up AS (
  SELECT conv_id, turn, reply_to AS above, 1 AS depth FROM links
  UNION ALL
  SELECT u.conv_id, u.turn, l.reply_to, u.depth + 1 FROM up u JOIN links l ON u.conv_id = l.conv_id AND u.above = l.turn
), roots AS (
  SELECT conv_id, turn, thread, depth, rank() OVER (PARTITION BY conv_id, thread ORDER BY turn) AS position FROM (SELECT conv_id, turn, arg_max(above, depth) AS thread, max(depth) AS depth FROM up GROUP BY conv_id, turn)
)
SELECT m.conv_id, coalesce(r.thread, m.turn) AS thread, coalesce(r.position, 0) AS position, m.turn, CAST(coalesce(r.depth, 0) AS BIGINT) AS depth, l.reply_to, m.role,
  CAST(len(list_filter(m.lines, lambda x: regexp_matches(x, '^[ \t]*>'))) AS BIGINT) AS n_quoted,
  concat('<|', m.role, '|>', chr(10), regexp_replace(array_to_string(list_filter(m.lines,
    lambda x: NOT regexp_matches(x, '^[ \t]*>') AND NOT regexp_matches(x, '^On .*wrote:[ \t\r]*$')), chr(10)), '^\n+|\n+$', '', 'g')) AS chat
FROM m LEFT JOIN links l ON m.conv_id = l.conv_id AND m.turn = l.turn LEFT JOIN roots r ON m.conv_id = r.conv_id AND m.turn = r.turn
"""
