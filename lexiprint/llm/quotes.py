"""Quotation linking: reply threads rebuilt from quoted passages.

Lines of a message are parted by their depth of quote marks into passages.
Hashes of normalised quoted passages are joined to the messages that first
wrote them; the links give each message the one it answers, the threads of the
conversation and a reading order, and the text is left without its quotes.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiprint.llm.common import attach, attach_any, cut, key_of

#: Words that a single line must have to count as a passage of its own.
LINE_WORDS = 4
MARK = r"^[ \t]*(?:>[ \t]?)+"
SAID = r"(?i)^[ \t]*(?:on\b.{1,200}\bwrote|[^\n]{1,80} (?:wrote|writes|said))[ \t]*:[ \t]*$"


def quote_lines(text: Column) -> Column:
    """``array<struct<level, body>>``: quote depth and bare text of each line."""
    lines = F.split(F.coalesce(text.cast("string"), F.lit("")), "\r?\n")
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARK, 0), "[^>]", ""))
    return F.transform(lines, lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, MARK, "").alias("body")))


def passages(lines: Column) -> Column:
    """Runs of neighbouring lines of one depth without a blank line: ``array<struct<level, lines>>``.

    A message is read once: runs start where the depth changes or a blank line
    ends, and each is a slice up to the next start.
    """
    blank = lambda x: F.trim(x["body"]) == ""
    n = F.size(lines)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(lines, i)["level"] != F.get(lines, i - 1)["level"]) | blank(F.get(lines, i)) | blank(F.get(lines, i - 1)))
    runs = F.zip_with(starts, F.concat(F.slice(starts, 2, F.size(starts)), F.array(n)), lambda a, b: F.struct(F.get(lines, a)["level"].alias("level"), F.transform(F.slice(lines, a + 1, F.coalesce(b, n) - a), lambda x: x["body"]).alias("lines")))
    return F.filter(runs, lambda r: r["lines"].isNotNull() & (F.trim(F.array_join(r["lines"], " ")) != ""))


def _hash(text: Column) -> Column:
    """Hash of a passage without case, quote marks, punctuation and line ends."""
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")))


def _own_hashes(runs: Column) -> Column:
    """Hashes by which others may quote a message: its own text, passages and longer lines."""
    own = F.filter(runs, lambda r: r["level"] == 0)
    whole = F.array(_hash(F.array_join(F.flatten(F.transform(own, lambda r: r["lines"])), " ")))
    blocks = F.transform(own, lambda r: _hash(F.array_join(r["lines"], " ")))
    lines = F.transform(F.filter(F.flatten(F.transform(own, lambda r: r["lines"])), lambda x: F.size(F.split(F.trim(x), r"\s+")) >= LINE_WORDS), _hash)
    return F.array_distinct(F.when(F.size(own) > 0, F.concat(whole, blocks, lines)).otherwise(F.array().cast("array<bigint>")))


def _quoted_hashes(runs: Column) -> Column:
    """``array<struct<level, hash>>`` of quoted passages, of longer lines in them, and of all lines of a level."""
    quoted = F.filter(runs, lambda r: r["level"] > 0)
    blocks = F.transform(quoted, lambda r: F.struct(r["level"].alias("level"), _hash(F.array_join(r["lines"], " ")).alias("hash")))
    lines = F.flatten(F.transform(quoted, lambda r: F.transform(F.filter(r["lines"], lambda x: F.size(F.split(F.trim(x), r"\s+")) >= LINE_WORDS), lambda x: F.struct(r["level"].alias("level"), _hash(x).alias("hash")))))
    levels = F.array_distinct(F.transform(quoted, lambda r: r["level"]))
    whole = F.transform(levels, lambda d: F.struct(d.alias("level"), _hash(F.array_join(F.flatten(F.transform(F.filter(quoted, lambda r: r["level"] == d), lambda r: r["lines"])), " ")).alias("hash")))
    return F.array_distinct(F.concat(blocks, lines, whole))


def own_text(lines: Column) -> Column:
    """The message without quoted lines and the lines that announce them."""
    numbered = F.transform(lines, lambda x, i: F.struct(x["level"].alias("level"), x["body"].alias("body"), F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)).alias("next")))
    kept = F.filter(numbered, lambda x: (x["level"] == 0) & ~((x["next"] > 0) & x["body"].rlike(SAID)))
    joined = F.regexp_replace(F.array_join(F.transform(kept, lambda x: x["body"]), "\n"), r"\n{3,}", "\n\n")
    return F.btrim(joined, F.lit(" \n"))


def _threads(parents: DataFrame) -> DataFrame:
    """``conv_id, turn, thread, depth`` of answering turns: the first turn of the chain of answers, and its length.

    Pointers double each round, so rounds grow with the logarithm of the
    longest chain.
    """
    at = cut(parents.select("conv_id", "turn", F.col("reply_to").alias("up"), F.lit(1).cast("long").alias("depth")))
    while True:
        # many turns of a thread point to one message
        above = at.select(F.struct("conv_id", "turn").alias("k"), F.col("up").alias("up2"), F.col("depth").alias("depth2"))
        joined = attach_any(at.withColumn("k", F.struct("conv_id", F.col("up").alias("turn"))), above, "k")
        moved = cut(joined.select("conv_id", "turn", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), F.col("up2").isNotNull().alias("moved")))
        at = moved.drop("moved")
        if not moved.filter("moved").limit(1).count():
            return at.withColumnRenamed("up", "thread")


def link_quotes(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, role, reply_to, thread, depth, position, levels, quoted, linked, text`` of each message.

    ``messages`` has ``conv_id, turn, role, text``.  A quoted passage is linked
    to the earliest turn of its conversation that wrote it, if that is an
    earlier one; ``reply_to`` is the latest turn linked at the first level of
    quotes, or else at the least deep level with a link.  ``thread`` is the
    turn at which the chain of answers began (its own turn without one) and
    ``depth`` the answers since.  ``position`` counts a conversation's
    messages in reply order: by thread, then turn.  ``levels`` is the deepest
    quote, ``quoted`` and ``linked`` count distinct quoted hashes and those
    with an original.  Rows equal in all four columns are one message; a null
    conversation or turn has no links, and rows of a null conversation stand
    in a conversation of their own.  Null texts are ''.
    """
    lines = quote_lines(F.col("text"))
    base = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    keyed = base.withColumn("message", key_of(*(F.col(c) for c in ("conv_id", "turn", "role", "text"))))
    parsed = keyed.withColumn("lines", lines).withColumn("runs", passages(F.col("lines")))
    slim = parsed.select("message", "conv_id", "turn", "role", F.coalesce(F.array_max(F.transform("lines", lambda x: x["level"])), F.lit(0)).alias("levels"), _own_hashes(F.col("runs")).alias("own"), _quoted_hashes(F.col("runs")).alias("quotes"), own_text(F.col("lines")).alias("text"))
    # partial sums first: a row repeated many times leaves each task once
    once = cut(slim.groupBy("message").agg(*(F.first(c).alias(c) for c in ("conv_id", "turn", "role", "levels", "own", "quotes", "text"))))
    placed = once.filter("conv_id is not null and turn is not null")
    asked = cut(placed.filter(F.size("quotes") > 0).select("message", "conv_id", "turn", F.explode("quotes").alias("q")).select("message", "conv_id", "turn", F.col("q.level").alias("level"), F.struct("conv_id", "q.hash").alias("key")))
    wanted = asked.groupBy("key").agg(F.count(F.lit(1)).alias("asks"))
    written = placed.select("turn", "conv_id", F.explode("own").alias("hash")).groupBy("conv_id", "hash").agg(F.min("turn").alias("origin")).select(F.struct("conv_id", "hash").alias("key"), "origin")
    origins = cut(written.join(wanted, "key"))
    found = attach(asked, origins, "key", "asks", asked.count()).withColumn("origin", F.when(F.col("origin") < F.col("turn"), F.col("origin")))
    levels = found.groupBy("message").agg(F.count_distinct("key").alias("quoted"), F.count_distinct(F.when(F.col("origin").isNotNull(), F.col("key"))).alias("linked"), F.min(F.when(F.col("origin").isNotNull(), F.struct("level", (-F.col("origin")).alias("neg")))).alias("best"))
    linked = cut(levels.select("message", "quoted", "linked", (-F.col("best.neg")).alias("reply_to")))
    with_parent = once.join(linked, "message", "left")
    parents = with_parent.filter("reply_to is not null").groupBy("conv_id", "turn").agg(F.max("reply_to").alias("reply_to"))
    threads = _threads(parents).select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), "thread", "depth")
    joined = with_parent.join(threads, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")) & F.col("reply_to").isNotNull(), "left")
    out = joined.select("conv_id", "turn", "role", "message", "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "levels", F.coalesce("quoted", F.lit(0)).cast("long").alias("quoted"), F.coalesce("linked", F.lit(0)).cast("long").alias("linked"), "text")
    return _positions(out).select("conv_id", "turn", "role", "reply_to", "thread", "depth", "position", F.col("levels").cast("int"), "quoted", "linked", "text")


def _positions(rows: DataFrame) -> DataFrame:
    """Gapless ``position`` in each conversation, by thread, turn, role and message.

    Rows are sorted over all tasks by ranges; a conversation longer than a
    range is counted on from range to range, over one row per range.
    """
    ordered = cut(rows.repartitionByRange("conv_id", "thread", "turn", "role", "message").sortWithinPartitions("conv_id", "thread", "turn", "role", "message").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).alias("part")
    counts = ordered.groupBy("conv_id", part).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    # one row per conversation and range, and only conversations of several ranges have several
    before = counts.selectExpr("conv_id as c", "part as p", "first", "sum(n) over (partition by conv_id order by part) - n as before")
    joined = ordered.join(before, F.col("conv_id").eqNullSafe(F.col("c")) & (F.shiftright("at", 33) == F.col("p")))
    return joined.withColumn("position", F.col("before") + F.col("at") - F.col("first"))


def reply_mail(messages: DataFrame) -> DataFrame:
    """The whole table as mail: turns quote the turns before them, in seven styles by conversation and turn.

    Nothing is quoted; the turn before under a line that announces it; the
    same with the turn before that a level deeper; with marks without a space
    and wider spaces; below the answer; with a word put in front, so that only
    single lines can be linked; or the turn before the last alone.  A turn
    without the quoted one is left as it is.  Of several messages of one turn
    the least text is quoted.
    """
    base = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    said = cut(base.groupBy("conv_id", "turn").agg(F.min("text").alias("said"), F.min("role").alias("who")))
    for back in (1, 2):
        earlier = said.select(F.struct("conv_id", (F.col("turn") + back).alias("turn")).alias("k"), F.col("said").alias(f"said{back}"), F.concat(F.lit("On turn "), F.col("turn").cast("string"), F.lit(", "), F.coalesce("who", F.lit("someone")), F.lit(" wrote:")).alias(f"line{back}"))
        base = attach_any(cut(base.withColumn("k", F.struct("conv_id", "turn"))), earlier, "k").drop("k")
    quote = lambda c, mark: F.concat(F.lit(mark), F.replace(F.col(c) if isinstance(c, str) else c, F.lit("\n"), F.lit("\n" + mark)))
    one, two, own, style = F.col("said1").isNotNull(), F.col("said2").isNotNull(), F.col("text"), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(7))
    plain = F.concat_ws("\n", "line1", quote("said1", "> "), F.lit(""), own)
    mail = (
        F.when(one & two & (style == 2), F.concat_ws("\n", "line1", quote("line2", "> "), quote("said2", ">> "), quote("said1", "> "), F.lit(""), own))
        .when(one & (style == 3), F.concat_ws("\n", "line1", quote(F.replace("said1", F.lit(" "), F.lit("  ")), ">"), F.lit(""), own))
        .when(one & (style == 4), F.concat_ws("\n", own, F.lit(""), "line1", quote("said1", "> ")))
        .when(one & (style == 5), F.concat_ws("\n", "line1", quote(F.concat(F.lit("indeed "), "said1"), "> "), F.lit(""), own))
        .when(two & (style == 6), F.concat_ws("\n", "line2", quote("said2", "> "), F.lit(""), own))
        .when(one & style.isin(1, 2), plain)
        .otherwise(own)
    )
    return base.select("conv_id", "turn", "role", mail.alias("text"))


def link_replies(messages: DataFrame) -> DataFrame:
    """``link_quotes`` over the mail that ``reply_mail`` makes of the messages."""
    return link_quotes(reply_mail(messages))


def _sql_quote(text: str, mark: str) -> str:
    return f"'{mark}' || replace({text}, chr(10), chr(10) || '{mark}')"


_BREAK = "|| chr(10) ||"
_PLAIN = f"line1 {_BREAK} {_sql_quote('said1', '> ')} {_BREAK} chr(10) || text"

#: DuckDB SQL of ``reply_mail``, as two common tables.
MAIL = rf"""
said as (select conv_id, turn, min(coalesce(text, '')) as said, min(role) as who from conversations group by conv_id, turn),
mail as (
    select conv_id, turn, role, case
        when said1 is not null and said2 is not null and style = 2 then line1 {_BREAK} {_sql_quote("line2", "> ")} {_BREAK} {_sql_quote("said2", ">> ")} {_BREAK} {_sql_quote("said1", "> ")} {_BREAK} chr(10) || text
        when said1 is not null and style = 3 then line1 {_BREAK} {_sql_quote("replace(said1, ' ', '  ')", ">")} {_BREAK} chr(10) || text
        when said1 is not null and style = 4 then text {_BREAK} chr(10) || line1 {_BREAK} {_sql_quote("said1", "> ")}
        when said1 is not null and style = 5 then line1 {_BREAK} {_sql_quote("('indeed ' || said1)", "> ")} {_BREAK} chr(10) || text
        when said2 is not null and style = 6 then line2 {_BREAK} {_sql_quote("said2", "> ")} {_BREAK} chr(10) || text
        when said1 is not null and style in (1, 2) then {_PLAIN}
        else text end as text
    from (
        select m.conv_id, m.turn, m.role, coalesce(m.text, '') as text, a.said as said1, b.said as said2, (m.conv_id + m.turn) % 7 as style,
            'On turn ' || a.turn || ', ' || coalesce(a.who, 'someone') || ' wrote:' as line1, 'On turn ' || b.turn || ', ' || coalesce(b.who, 'someone') || ' wrote:' as line2
        from conversations m left join said a on a.conv_id = m.conv_id and a.turn = m.turn - 1 left join said b on b.conv_id = m.conv_id and b.turn = m.turn - 2))
"""

_NORM = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_LONG = rf"len(regexp_split_to_array(trim(body, ' '), '\s+')) >= {LINE_WORDS}"

#: DuckDB SQL of ``link_quotes`` over a table ``mail``, without its first word; texts stand where hashes do.
_LINKS = rf"""
m as (select conv_id, turn, role, text, row_number() over () as id from (select distinct conv_id, turn, role, text from mail)),
l0 as (select id, unnest(a) as line, generate_subscripts(a, 1) as i from (select id, regexp_split_to_array(coalesce(text, ''), '\r?\n') as a from m)),
l as (select id, i, len(regexp_replace(regexp_extract(line, '{MARK}', 0), '[^>]', '', 'g')) as level, regexp_replace(line, '{MARK}', '') as body from l0),
f as (select *, (lag(level) over w is null or level <> lag(level) over w or trim(body, ' ') = '' or trim(lag(body) over w, ' ') = '')::int as starts, lead(level) over w as next_level from l window w as (partition by id order by i)),
r as (select *, sum(starts) over (partition by id order by i) as run from f),
runs as (select id, run, level, string_agg(body, ' ' order by i) as body from r group by id, run, level having trim(string_agg(body, ' ' order by i), ' ') <> ''),
kept as (select r.* from r join runs using (id, run)),
own as (
    select id, {_NORM.format("body")} as h from runs where level = 0
    union select id, {_NORM.format("body")} from kept where level = 0 and {_LONG}
    union select id, {_NORM.format("string_agg(body, ' ' order by i)")} from kept where level = 0 group by id),
asks as (
    select id, level, {_NORM.format("body")} as h from runs where level > 0
    union select id, level, {_NORM.format("body")} from kept where level > 0 and {_LONG}
    union select id, level, {_NORM.format("string_agg(body, ' ' order by i)")} from kept where level > 0 group by id, level),
written as (select conv_id, h, min(turn) as origin from own join m using (id) where conv_id is not null and turn is not null group by conv_id, h),
found as (select asks.id, asks.level, asks.h, case when origin < turn then origin end as origin from asks join m using (id) left join written on written.conv_id = m.conv_id and written.h = asks.h where m.conv_id is not null and turn is not null),
links as (select id, count(distinct h) as quoted, count(distinct h) filter (origin is not null) as linked, arg_min(origin, level * 1000000000 - origin) filter (origin is not null) as reply_to from found group by id),
parents as (select conv_id, turn, max(reply_to) as up from links join m using (id) where reply_to is not null group by conv_id, turn),
chain as (
    select conv_id, turn, up, 1 as depth from parents
    union all select c.conv_id, c.turn, p.up, c.depth + 1 from chain c join parents p on p.conv_id = c.conv_id and p.turn = c.up),
threads as (select conv_id, turn, arg_max(up, depth) as thread, max(depth) as depth from chain group by conv_id, turn),
body as (
    select id, trim(regexp_replace(string_agg(body, chr(10) order by i), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10)) as text
    from f where level = 0 and not (coalesce(next_level, 0) > 0 and regexp_matches(body, '{SAID}')) group by id),
deepest as (select id, max(level)::int as levels from l group by id),
out as (
    select m.conv_id, m.turn, m.role, reply_to, case when reply_to is null then m.turn else thread end as thread, case when reply_to is null then 0 else t.depth end as depth, levels, coalesce(quoted, 0) as quoted, coalesce(linked, 0) as linked, coalesce(body.text, '') as text
    from m left join links using (id) left join threads t on t.conv_id = m.conv_id and t.turn = m.turn left join body using (id) left join deepest using (id))
select *, row_number() over (partition by conv_id order by thread nulls first, turn nulls first, role nulls first, text) - 1 as position from out
"""

#: DuckDB SQL of ``link_quotes`` over ``conversations``, and of ``link_replies``.
SQL_AS_WRITTEN = f"with recursive mail as (select * from conversations),{_LINKS}"
SQL = f"with recursive {MAIL.strip()},{_LINKS}"
