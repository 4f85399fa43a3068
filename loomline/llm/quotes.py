"""Quotation linking in conversations (operator 1), with DataFrame functions only.

The lines of a message are cut into passages of one quote level (the number of leading ">"). A quoted passage is
normalised (letters and digits, lower case, single spaces) and hashed, whole and by sentence. Unquoted text is hashed
whole, by paragraph, by line and by sentence. A passage links to the latest earlier message of its conversation that
holds it whole. If none does, each of its sentences votes for the latest earlier message that holds it; the message
with most votes is taken, of several the latest. A message replies to the link of its outermost linked passage (of
several, the last). Threads are found by pointer doubling over the links alone. The result numbers the messages in
reply order: threads by their first message, within them by turn, so that each message follows what it answers.

Repeated rows are folded first and unfolded last. Messages are parsed once, into a table; whole texts are shuffled for
the fold and for the result only. A hash may be very common in a long conversation. Only hashes that are quoted are
looked at, and the latest earlier message is found in blocks of turns: within the block by a window, before it by the
maxima of blocks. Nothing is joined to all messages with the same hash. Reply order is counted in blocks in the same way.

Defined results: a null or empty text has an empty body and no passages; a row with a null conv_id or turn is never
linked and is its own thread; repeated rows are all kept, with equal links and successive places; quotes of later or
unknown text do not link; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, stash

#: Turns in a block.
BLOCK = 1024
#: The marks before a quoted line. A run of one class, so that no length of it is matched by recursion.
MARK = r"^[ \t>]*>[ \t]?"
#: A line that only introduces a quotation ("... wrote:").
INTRODUCES = r"(?i)\b(?:wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$"
SENTENCES = r"(?<=[.!?])\s+|\n+"
BLANK = " \t\n\r\f"
ROW = ["conv", "turn", "role", "digest"]


def normal(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def hashed(c: Column) -> Column:
    """A digest of normalised text; of no letters or digits, null."""
    return F.when(c.rlike(r"[\p{L}\p{N}]"), F.unhex(F.md5(normal(c))))


def parsed(messages: DataFrame) -> DataFrame:
    """conv, turn, role, digest, n (how often the row comes) and passages, an array of (level, text), of each message."""
    folded = messages.groupBy(F.col("conv_id").alias("conv"), "turn", "role", F.coalesce("text", F.lit("")).alias("text")).agg(F.count("*").alias("n"))
    # A text without a mark is one passage as it is.
    lines = F.when(F.contains("text", F.lit(">")), F.split("text", r"\r?\n")).otherwise(F.array(F.replace("text", F.lit("\r\n"), F.lit("\n"))))
    mark = lambda x: F.regexp_extract(x, MARK, 0)
    levelled = F.transform(
        lines,
        lambda x: F.when(x.contains(">"), F.struct(F.length(F.regexp_replace(mark(x), "[^>]", "")).alias("level"), F.substring(x, F.length(mark(x)) + 1, F.length(x)).alias("text"))).otherwise(F.struct(F.lit(0).alias("level"), x.alias("text"))),
    )
    out = folded.withColumn("lines", levelled)
    out = out.withColumn("lines", F.filter("lines", lambda x, i: ~((x.level == 0) & F.coalesce(F.get("lines", i + 1).level > 0, F.lit(False)) & x.text.rlike(INTRODUCES))))
    out = out.withColumn("starts", F.filter(F.transform("lines", lambda x, i: F.when((i == 0) | (x.level != F.get("lines", i - 1).level), i)), lambda i: i.isNotNull()))
    passages = F.transform(
        "starts",
        lambda s, k: F.struct(
            F.get("lines", s).level.alias("level"),
            F.array_join(F.transform(F.slice("lines", s + 1, F.coalesce(F.get("starts", k + 1), F.size("lines")) - s), lambda x: x.text), "\n").alias("text"),
        ),
    )
    return out.select("conv", "turn", "role", F.unhex(F.md5("text")).alias("digest"), "n", passages.alias("passages"))


def split_up(messages: DataFrame) -> DataFrame:
    """parsed() with the own text (level 0) apart from the quoted passages, the only ones that keep an array."""
    at = F.transform("passages", lambda p, i: F.struct(i.alias("at"), p.level.alias("level"), p.text.alias("text")))
    own = F.array_join(F.transform(F.filter("passages", lambda p: p.level == 0), lambda p: p.text), "\n")
    return parsed(messages).select(*ROW, "n", own.alias("own"), F.filter(at, lambda p: p.level > 0).alias("quoted"))


def _latest(asked: DataFrame, held: DataFrame) -> DataFrame:
    """asked (conv, turn, h, ...) with target: the greatest turn below its own at which held (conv, turn, h) has h."""
    keyed = lambda d: d.withColumn("block", F.floor(F.col("turn") / BLOCK))
    asked, held = keyed(asked), keyed(held)
    before = Window.partitionBy("conv", "h").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    points = asked.select("conv", "h", "block").distinct().withColumn("m", F.lit(None).cast("long"))
    maxima = held.groupBy("conv", "h", "block").agg(F.max("turn").alias("m")).unionByName(points).groupBy("conv", "h", "block").agg(F.max("m").alias("m"))
    earlier = maxima.withColumn("earlier", F.max("m").over(before)).select("conv", "h", "block", "earlier")
    turns = asked.select("conv", "h", "block", "turn").distinct().withColumn("own", F.lit(None).cast("long"))
    within = Window.partitionBy("conv", "h", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = held.select("conv", "h", "block", "turn", F.col("turn").alias("own")).unionByName(turns).withColumn("near", F.max("own").over(within)).where("own IS NULL")
    found = near.join(earlier, ["conv", "h", "block"]).select("conv", "h", "turn", F.coalesce("near", "earlier").alias("target"))
    return asked.drop("block").join(found, ["conv", "h", "turn"], "left")


def links(messages: DataFrame, spark: SparkSession) -> DataFrame:
    """conv, turn, linked (passages) and reply_to of the messages that quote an earlier one. messages: of split_up()."""
    keyed = messages.where("conv IS NOT NULL AND turn IS NOT NULL")
    quoted = keyed.where(F.size("quoted") > 0).select("conv", "turn", F.explode("quoted").alias("p")).select("conv", "turn", "p.*")
    whole = quoted.select("conv", "turn", "at", "level", F.lit(1).alias("whole"), hashed(F.col("text")).alias("h"))
    parts = quoted.select("conv", "turn", "at", "level", F.lit(0).alias("whole"), F.explode(F.array_distinct(F.transform(F.split("text", SENTENCES), hashed))).alias("h"))
    asked, path = stash(whole.union(parts).where("h IS NOT NULL").distinct(), spark)
    unit = F.array_distinct(F.concat(F.array("own"), F.split("own", r"\n[ \t]*\n"), F.split("own", r"\n"), F.split("own", SENTENCES)))
    units = keyed.where("own <> ''").select("conv", "turn", F.explode(F.array_distinct(F.transform(unit, hashed))).alias("h")).where("h IS NOT NULL")
    held, other = stash(units.join(asked.select("conv", "h").distinct(), ["conv", "h"], "left_semi").distinct(), spark)  # read twice
    found = _latest(asked, held).where("target IS NOT NULL")
    votes = found.groupBy("conv", "turn", "at", "level", "whole", "target").agg(F.count("*").alias("n"))
    passage = votes.groupBy("conv", "turn", "at", "level").agg(F.max(F.struct("whole", "n", "target")).alias("best"))
    linked, _ = stash(passage.groupBy("conv", "turn").agg(F.count("*").alias("linked"), F.max_by("best.target", F.struct(-F.col("level"), "at")).alias("reply_to")), spark)
    for p in (path, other):
        discard(spark, p)
    return linked


def roots(linked: DataFrame, spark: SparkSession) -> DataFrame:
    """Adds thread and depth to links (conv, turn, reply_to), by pointer doubling; a table is written each round."""
    now, path = stash(linked.withColumn("up", F.col("reply_to")).withColumn("depth", F.lit(1).cast("long")), spark)
    while True:
        above = now.select("conv", F.col("turn").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"))
        step = now.join(above, ["conv", "up"], "left")
        further, new = stash(step.select("conv", "turn", "linked", "reply_to", F.coalesce("further", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("further").isNotNull().alias("moved")), spark)
        discard(spark, path)
        now, path = further.drop("moved"), new
        if further.where("moved").isEmpty():
            return now.withColumnRenamed("up", "thread")


def placed(rows: DataFrame) -> DataFrame:
    """Adds first, the place within conv of a row's first copy by (thread, turn, role, digest), in blocks of threads and turns."""
    keys = ["conv", "upper", "thread", "block"]
    rows = rows.withColumn("upper", F.floor(F.col("thread") / BLOCK)).withColumn("block", F.floor(F.col("turn") / BLOCK))
    blocks = rows.groupBy(*keys).agg(F.sum("n").alias("n"))
    prior = lambda *part: Window.partitionBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    uppers = blocks.groupBy("conv", "upper").agg(F.sum("n").alias("n")).withColumn("base", F.sum("n").over(prior("conv").orderBy("upper"))).drop("n")
    inner = blocks.withColumn("inner", F.sum("n").over(prior("conv", "upper").orderBy("thread", "block"))).drop("n")
    same = lambda a, b, cols: [a[c].eqNullSafe(b[c]) for c in cols]
    base = inner.join(uppers, same(inner, uppers, ["conv", "upper"])).select(*[inner[c] for c in keys], (F.coalesce("base", F.lit(0)) + F.coalesce("inner", F.lit(0))).alias("base"))
    ranked = rows.withColumn("rank", F.coalesce(F.sum("n").over(prior(*keys).orderBy("turn", "role", "digest")), F.lit(0)))
    return ranked.join(base, same(ranked, base, keys)).select(*[ranked[c] for c in rows.columns if c not in ("upper", "block", "n")], (F.col("base") + F.col("rank") + 1).alias("first"))


def conversations(messages: DataFrame, spark: SparkSession) -> DataFrame:
    """Messages without quotes in reply order, with their links."""
    found, _ = stash(split_up(messages.select("conv_id", "turn", "role", "text")), spark)
    tied = roots(links(found, spark), spark)
    rows = found.select(*ROW, "n").join(tied, ["conv", "turn"], "left")
    rows = rows.withColumn("thread", F.coalesce("thread", "turn")).fillna(0, ["linked", "depth"])
    order, _ = stash(placed(rows), spark)
    levels = F.coalesce(F.array_max(F.transform("quoted", lambda p: p.level)), F.lit(0))
    texts = found.select(*[F.col(c).alias(f"{c}_") for c in ROW], "n", F.btrim("own", F.lit(BLANK)).alias("body"), levels.alias("quote_levels"), F.size("quoted").alias("quoted_passages"))
    both = texts.join(order, [texts[f"{c}_"].eqNullSafe(order[c]) for c in ROW])
    copies = F.explode(F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda k: F.col("first") + k - 1))
    return both.select(F.col("conv").alias("conv_id"), "turn", "role", "body", "quote_levels", "quoted_passages", F.col("linked").alias("linked_passages"), "reply_to", "thread", "depth", copies.alias("reply_order"))


def quoting(messages: DataFrame) -> DataFrame:
    """Messages that quote, made from messages without quotes: the kind follows from conv_id and turn.

    Of six kinds one quotes the message before it, one that message and, a level deeper, the one before that, one a first
    sentence of two turns back, one words that nobody wrote, and two are left as they are.
    """
    at = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    prior = [at.select(F.col("conv_id").alias(f"c{k}"), (F.col("turn") + k).alias(f"t{k}"), F.col("text").alias(f"x{k}")) for k in (1, 2)]
    rows = messages.select("conv_id", "turn", "role", "text", F.pmod(F.col("conv_id") + 3 * F.col("turn"), F.lit(6)).alias("kind"))
    for k, p in enumerate(prior, 1):
        rows = rows.join(p, (rows.conv_id == p[f"c{k}"]) & (rows.turn == p[f"t{k}"]), "left")
    quote = lambda c, mark: F.concat(F.lit(mark), F.replace(F.col(c), F.lit("\n"), F.lit("\n" + mark)))
    own = F.concat(F.lit("\n"), F.coalesce("text", F.lit("")))
    text = (
        F.when((F.col("kind") == 1) & F.col("x1").isNotNull(), F.concat(F.lit("They wrote:\n"), quote("x1", "> "), own))
        .when((F.col("kind") == 2) & F.col("x2").isNotNull(), F.concat(quote("x1", "> "), F.lit("\n"), quote("x2", ">> "), own))
        .when((F.col("kind") == 3) & F.col("x2").isNotNull(), F.concat(F.lit("> "), F.regexp_extract("x2", r"^[^.!?\n]*[.!?]?", 0), own))
        .when(F.col("kind") == 4, F.concat(F.lit("> Nobody wrote line "), F.col("turn").cast("string"), F.lit(".\n"), own))
        .otherwise(F.col("text"))
    )
    return rows.select("conv_id", "turn", "role", text.alias("text"))


#: What the query makes of the table, then what the operator makes of that.
QUOTING_SQL = r"""
a AS (SELECT conv_id, turn, min(coalesce(text, '')) AS x FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
k AS (SELECT c.conv_id, c.turn, c.role, c.text, chr(10) || coalesce(c.text, '') AS own, ((c.conv_id + 3 * c.turn) % 6 + 6) % 6 AS kind, p.x AS x1, q.x AS x2
  FROM conversations c LEFT JOIN a p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1 LEFT JOIN a q ON q.conv_id = c.conv_id AND q.turn = c.turn - 2),
messages AS (SELECT conv_id, turn, role, CASE
  WHEN kind = 1 AND x1 IS NOT NULL THEN 'They wrote:' || chr(10) || '> ' || replace(x1, chr(10), chr(10) || '> ') || own
  WHEN kind = 2 AND x2 IS NOT NULL THEN '> ' || replace(x1, chr(10), chr(10) || '> ') || chr(10) || '>> ' || replace(x2, chr(10), chr(10) || '>> ') || own
  WHEN kind = 3 AND x2 IS NOT NULL THEN '> ' || regexp_extract(x2, '^[^.!?\n]*[.!?]?') || own
  WHEN kind = 4 THEN '> Nobody wrote line ' || turn || '.' || chr(10) || own
  ELSE text END AS text FROM k),"""
LINKING_SQL = r"""
m AS (SELECT row_number() OVER () AS id, conv_id, turn, role, md5(coalesce(text, '')) AS digest, string_split_regex(coalesce(text, ''), '\r?\n') AS ls FROM messages),
l0 AS (SELECT id, conv_id, turn, role, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM m),
l1 AS (SELECT *, length(regexp_replace(regexp_extract(line, '^[ \t>]*>[ \t]?'), '[^>]', '', 'g')) AS level, regexp_replace(line, '^[ \t>]*>[ \t]?', '') AS t FROM l0),
l2 AS (SELECT *, lead(level) OVER (PARTITION BY id ORDER BY pos) AS after FROM l1),
l3 AS (SELECT * FROM l2 WHERE NOT (level = 0 AND regexp_matches(t, '(?i)\b(?:wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$') AND coalesce(after > 0, false))),
l4 AS (SELECT *, CASE WHEN level IS DISTINCT FROM lag(level) OVER (PARTITION BY id ORDER BY pos) THEN 1 ELSE 0 END AS start FROM l3),
l5 AS (SELECT *, sum(start) OVER (PARTITION BY id ORDER BY pos) AS p FROM l4),
passages AS (SELECT id, any_value(conv_id) AS conv_id, any_value(turn) AS turn, p, any_value(level) AS level, string_agg(t, chr(10) ORDER BY pos) AS t FROM l5 GROUP BY id, p),
bodies AS (SELECT id, coalesce(string_agg(t, chr(10) ORDER BY p) FILTER (level = 0), '') AS own, max(level) AS quote_levels, count(*) FILTER (level > 0) AS quoted_passages FROM passages GROUP BY id),
units AS (SELECT conv_id, turn, unnest([own] || string_split_regex(own, '\n[ \t]*\n') || string_split_regex(own, '\n') || string_split_regex(own, '[.!?]+\s+|\n+')) AS u FROM bodies JOIN m USING (id)),
held AS (SELECT DISTINCT conv_id, turn, trim(regexp_replace(lower(u), '[^\p{L}\p{N}]+', ' ', 'g')) AS h FROM units WHERE h <> ''),
asked0 AS (SELECT conv_id, turn, p, level, 1 AS whole, t AS u FROM passages WHERE level > 0 UNION ALL SELECT conv_id, turn, p, level, 0, unnest(string_split_regex(t, '[.!?]+\s+|\n+')) FROM passages WHERE level > 0),
asked AS (SELECT DISTINCT conv_id, turn, p, level, whole, trim(regexp_replace(lower(u), '[^\p{L}\p{N}]+', ' ', 'g')) AS h FROM asked0 WHERE h <> ''),
hit AS (SELECT a.conv_id, a.turn, a.p, a.level, a.whole, a.h, max(h.turn) AS target FROM asked a JOIN held h ON a.conv_id = h.conv_id AND a.h = h.h AND h.turn < a.turn GROUP BY ALL),
votes AS (SELECT conv_id, turn, p, level, whole, target, count(*) AS n FROM hit GROUP BY ALL),
passage AS (SELECT conv_id, turn, p, level, max_by(target, (whole, n, target)) AS target FROM votes GROUP BY ALL),
link AS (SELECT conv_id, turn, count(*) AS linked, max_by(target, (10000000 - level) * 1000000 + p) AS reply_to FROM passage GROUP BY ALL),
up AS (SELECT conv_id, turn, reply_to AS thread, 1 AS depth FROM link UNION ALL SELECT up.conv_id, up.turn, link.reply_to, up.depth + 1 FROM up JOIN link ON link.conv_id = up.conv_id AND link.turn = up.thread),
root AS (SELECT conv_id, turn, min(thread) AS thread, max(depth) AS depth FROM up GROUP BY ALL),
o AS (SELECT m.conv_id, m.turn, m.role, digest, trim(own, ' ' || chr(9) || chr(10) || chr(13) || chr(12)) AS body, coalesce(quote_levels, 0) AS quote_levels, quoted_passages, coalesce(linked, 0) AS linked_passages, reply_to, coalesce(root.thread, m.turn) AS thread, coalesce(root.depth, 0) AS depth
  FROM m JOIN bodies USING (id) LEFT JOIN link ON link.conv_id = m.conv_id AND link.turn = m.turn LEFT JOIN root ON root.conv_id = m.conv_id AND root.turn = m.turn)
SELECT * EXCLUDE (digest), row_number() OVER (PARTITION BY conv_id ORDER BY thread, turn, role, digest) AS reply_order FROM o"""
SQL = f"WITH RECURSIVE {QUOTING_SQL}{LINKING_SQL}"
