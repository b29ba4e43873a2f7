"""Chat formatting by event-sourced reconstruction.

A log holds events of conversations, each with a sequence number:

``message``     a message at a place (``message_id``) with a role and a text; several
                with one sequence number are messages of their own
``delta``       more text for the message at that place
``edit``        a new text for the message at that place
``regenerate``  drops the message at that place and all later places, as far as
                events before this one made them

Events are folded into final messages by place, messages are rendered, and
the rendered messages of a conversation are joined in the order of places.
Folding groups by (conversation, place) and joining goes through runs of
``RUN`` places, so a conversation that holds a third of the log is worked on by
many tasks until its one text is put together.

The template of a message is ``<turn>### `` role, line feed, text, ``</turn>``, line
feed.  Inside roles and texts the backslash, ``<`` and ``#`` become ``\\b``, ``\\l`` and
``\\h`` (and a line feed in a role ``\\n``), so no text can hold a mark, and turning
``\\l``, ``\\h`` and then ``\\b`` back gives the text.

Defined results: null texts and roles are empty; a null conversation is one of
its own; events without place or sequence number come first; of equal (place,
sequence) the text that sorts first is earlier, and equal rows are messages of
their own; an event without a kind is a message; an empty log gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn>### ", "</turn>\n"
RUN = 64
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def message_events(conversations: DataFrame) -> DataFrame:
    """Events of a table of whole messages (conv_id, turn, role, text)."""
    turn = F.col("turn").cast("long")
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), turn.alias("message_id"), "role", turn.alias("seq"), F.lit("message").alias("kind"), "text"
    )


def fold_messages(events: DataFrame) -> DataFrame:
    """conv_id, message_id, copy, role, text: the final messages of a log
    (conv_id, message_id, role, seq, kind, text)."""
    events = events.withColumn("kind", F.coalesce("kind", F.lit("message")))
    regenerated = events.filter(F.col("kind") == "regenerate").groupBy("conv_id", "message_id").agg(F.max("seq").alias("from_seq"))
    # Places from a regenerated one on lose what came before it: the latest
    # such number over all places up to the own one, on thin rows of the
    # conversations that have any: over earlier runs of places by the runs'
    # maxima, and inside each run.
    held, own = events.select("conv_id", "message_id").alias("e"), regenerated.select("conv_id").distinct().alias("c")
    places = held.join(own, F.col("e.conv_id").eqNullSafe(F.col("c.conv_id")), "left_semi").distinct()
    marks = places.withColumn("from_seq", F.lit(None).cast("long")).unionByName(
        regenerated.select("conv_id", "message_id", F.col("from_seq").cast("long"))
    )
    marks = marks.withColumn("run", F.floor(F.col("message_id") / RUN))
    earlier = Window.partitionBy("conv_id").orderBy(F.col("run").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    runs = marks.groupBy("conv_id", "run").agg(F.max("from_seq").alias("most")).select("conv_id", "run", F.max("most").over(earlier).alias("before"))
    upto = Window.partitionBy("conv_id", "run").orderBy(F.col("message_id").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = marks.select("conv_id", "message_id", "run", F.max("from_seq").over(upto).alias("own")).distinct().alias("i")
    in_run = F.col("i.conv_id").eqNullSafe(F.col("r.conv_id")) & F.col("i.run").eqNullSafe(F.col("r.run"))
    cut = inside.join(runs.filter("before is not null").alias("r"), in_run, "left").select(
        "i.conv_id", "i.message_id", F.greatest("i.own", "r.before").alias("after")
    )
    cut = cut.filter("after is not null")
    e, c = events.filter(F.col("kind") != "regenerate").alias("e"), cut.alias("c")
    same = F.col("e.conv_id").eqNullSafe(F.col("c.conv_id")) & F.col("e.message_id").eqNullSafe(F.col("c.message_id"))
    valid = e.join(c, same, "left").filter("c.after is null or e.seq > c.after").select("e.*")
    seq = F.coalesce(F.col("seq").cast("long"), F.lit(-(1 << 62)))
    item = F.struct(seq.alias("seq"), F.col("kind"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role"))
    folded = valid.groupBy("conv_id", "message_id").agg(F.sort_array(F.collect_list(item)).alias("log"))
    # The text starts anew at the last message or edit; later deltas follow.
    last = F.array_max(F.transform("log", lambda x: F.when(x["kind"] != "delta", x["seq"])))
    folded = folded.withColumn("last", last)
    opening = F.filter("log", lambda x: (x["kind"] != "delta") & (x["seq"] == F.col("last")))
    nothing = F.array(F.struct(F.col("last").alias("seq"), F.lit("").alias("kind"), F.lit("").alias("text"), F.lit("").alias("role")))
    folded = folded.withColumn("opening", F.when(F.col("last").isNull(), nothing).otherwise(opening))
    later = F.filter("log", lambda x: (x["kind"] == "delta") & (F.col("last").isNull() | (x["seq"] > F.col("last"))))
    roles = F.filter(F.transform("log", lambda x: x["role"]), lambda r: r != "")
    folded = folded.withColumn("tail", F.array_join(F.transform(later, lambda x: x["text"]), ""))
    folded = folded.withColumn("any_role", F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")))
    each = folded.select("conv_id", "message_id", "tail", "any_role", F.size("opening").alias("n"), F.posexplode("opening").alias("copy", "x"))
    own = F.when(F.col("x.role") != "", F.col("x.role")).otherwise(F.col("any_role"))
    text = F.concat(F.col("x.text"), F.when(F.col("copy") == F.col("n") - 1, F.col("tail")).otherwise(""))
    return each.select("conv_id", "message_id", "copy", own.alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (start and end, in code points, of each
    assistant text in ``formatted``)."""
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    parts = messages.select(
        "conv_id",
        F.floor(F.col("message_id") / RUN).alias("run"),
        "message_id",
        "copy",
        F.concat(head, body, F.lit(CLOSE)).alias("text"),
        F.when(F.col("role") == ASSISTANT, F.length(head).cast("long")).alias("from"),
        F.length(body).cast("long").alias("n"),
    )
    # Places are sums over the messages before, inside a run and then over runs,
    # so nothing is built up message by message.
    earlier = Window.partitionBy("conv_id", "run").orderBy("message_id", "copy").rowsBetween(Window.unboundedPreceding, -1)
    own = F.col("from") + F.coalesce(F.sum(F.length("text").cast("long")).over(earlier), F.lit(0).cast("long"))
    message = F.struct("message_id", "copy", "text", own.alias("start"), (own + F.col("n")).alias("end"))
    runs = parts.select("conv_id", "run", message.alias("m")).groupBy("conv_id", "run").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    spans = F.transform(F.filter("ms", lambda m: m["start"].isNotNull()), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))
    runs = runs.select("conv_id", "run", F.array_join(F.transform("ms", lambda m: m["text"]), "").alias("text"), spans.alias("spans"))
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    moved = F.coalesce(F.sum(F.length("text").cast("long")).over(before), F.lit(0).cast("long"))
    whole = runs.select("conv_id", F.struct("run", "text", moved.alias("at"), "spans").alias("r")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list("r")).alias("rs")
    )
    shifted = F.transform(
        "rs", lambda r: F.transform(r["spans"], lambda s: F.struct((s["start"] + r["at"]).alias("start"), (s["end"] + r["at"]).alias("end")))
    )
    return whole.select("conv_id", F.array_join(F.transform("rs", lambda r: r["text"]), "").alias("formatted"), F.flatten(shifted).alias("loss_spans"))


def format_chats(events: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans of an event log."""
    return render(fold_messages(events))


def parse(formatted: Column) -> Column:
    """The marked turns of a formatted conversation, still escaped."""
    return F.filter(F.split(formatted, CLOSE), lambda t: t != "")


def digests(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and
    formatted_chars, all read back from ``formatted`` and ``loss_spans``."""

    turns = chats.select("conv_id", F.posexplode(parse(F.col("formatted"))).alias("pos", "t"))
    earlier = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("t").cast("long") + len(CLOSE)).over(earlier), F.lit(0).cast("long"))
    nl = F.instr("t", "\n")
    # A turn's text starts behind its first line; so does the span of it, if it has one.
    turns = turns.select("conv_id", "pos", "t", (at + nl).alias("start")).alias("t")
    spans = chats.select("conv_id", F.explode("loss_spans").alias("s")).select("conv_id", "s.start", "s.end").alias("s")
    met = turns.join(spans, F.col("t.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("t.start") == F.col("s.start")), "left")
    role = F.substring(F.col("t"), F.lit(len(OPEN) + 1), nl - len(OPEN) - 1)
    told = F.concat(unescape_role(role), F.lit("\n"), unescape(F.substring(F.col("t"), nl + 1, F.length("t"))), F.lit("\n"))
    lost = unescape(F.substring(F.col("t"), nl + 1, (F.col("s.end") - F.col("t.start")).cast("int")))
    part = F.struct("pos", told.alias("told"), F.coalesce(lost, F.lit("")).alias("lost"), (F.length("t") + len(CLOSE)).cast("long").alias("n"))
    read = met.select(F.col("t.conv_id").alias("conv_id"), part.alias("p")).groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    read = read.select(
        "conv_id",
        F.size("ps").cast("long").alias("n_turns"),
        F.aggregate("ps", F.lit(0).cast("long"), lambda n, p: n + p["n"]).alias("formatted_chars"),
        F.array_join(F.transform("ps", lambda p: p["told"]), "").alias("told"),
        F.array_join(F.transform("ps", lambda p: p["lost"]), "").alias("lost"),
    )
    return read.select(
        "conv_id",
        "n_turns",
        F.sha2(F.col("told").cast("binary"), 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"),
        F.sha2(F.col("lost").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
