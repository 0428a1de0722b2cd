"""Operator 10: event-sourced chat reconstruction and rendering (DataFrame functions only).

An event log has one row per event: ``conv_id``, ``seq`` (any type that has an
order), ``msg`` (which message the event is about), ``kind``, ``role`` and
``text``.  Kinds:

* ``message``     a whole message;
* ``delta``       a streamed piece, appended to the message's text;
* ``edit``        replaces the text that the message had so far;
* ``regenerate``  throws the text away; later deltas start afresh.

The fold of a message is the last ``message``/``edit``/``regenerate`` event's
text followed by the later deltas in order of ``seq``.  A conversation's
messages stand in the order of their first event.

Template, one turn: ``<s>`` role ``[INST]`` text ``</s>``.  In roles and texts
every ``[``, ``<`` and backslash gets a backslash after it, so no control
string can arise from a text, and the reading back is unique.

Defined results: null text and null role are empty; an unknown kind counts as
``message``; a null ``seq`` or turn comes first; ties in ``seq`` go by kind,
role and text; a null conversation id
is a conversation of its own; an empty log gives no rows; extra columns are
ignored.  A conversation is one value in the output, so its rendered text has
to fit into one row; rows are escaped before they are brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TURN, SEP, END = "<s>", "[INST]", "</s>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([\[<\\])", r"$1\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"([\[<\\])\\", "$1")


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, pos (of the first event), role, text.

    One shuffle on the conversation and message; a message of many deltas is
    one row in the end, so its deltas meet in one task.
    """
    e = events.select(
        "conv_id",
        "msg",
        "seq",
        F.when(F.col("kind").isin("delta", "edit", "regenerate"), F.col("kind")).otherwise("message").alias("kind"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    got = e.groupBy("conv_id", "msg").agg(F.sort_array(F.collect_list(F.struct("seq", "kind", "role", "text"))).alias("log"))
    base = F.array_max(F.transform("log", lambda x, i: F.when(x["kind"] != "delta", i).otherwise(-1)))
    role = F.filter("log", lambda x: x["role"] != "")
    return got.withColumn("base", base).select(
        "conv_id",
        F.col("log")[0]["seq"].alias("pos"),
        "msg",
        F.coalesce(F.try_element_at(role, F.lit(1))["role"], F.lit("")).alias("role"),
        F.concat_ws(
            "",
            F.transform(
                F.filter("log", lambda x, i: i >= F.col("base")),
                lambda x: F.when(x["kind"] == "regenerate", "").otherwise(x["text"]),
            ),
        ).alias("text"),
    )


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Rendered conversations: conv_id, formatted, loss.

    ``loss`` has one entry a turn: the span of the turn's text in ``formatted``
    (start, end in code points, end exclusive) or null where no loss is taken.
    """
    turns = messages.select(
        "conv_id",
        "pos",
        "msg",
        F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SEP)).alias("head"),
        escape(F.col("text")).alias("body"),
        (F.col("role") == loss_role).alias("loss"),
    )
    order = W.partitionBy("conv_id").orderBy("pos", "msg", "head", "body")
    end = F.sum(F.length("head") + F.length("body") + len(END)).over(order.rowsBetween(W.unboundedPreceding, 0))
    placed = turns.withColumn("i", F.row_number().over(order)).withColumn("end", end - len(END))
    start = F.col("end") - F.length("body")
    span = F.when(F.col("loss"), F.struct(start.alias("start"), F.col("end").alias("end")))
    return (
        placed.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("i", F.concat("head", "body", F.lit(END)).alias("t"), span.alias("s")))).alias("turns"))
        .select("conv_id", F.concat_ws("", F.col("turns.t")).alias("formatted"), F.col("turns.s").alias("loss"))
    )


def format_chats(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Fold an event log and render every conversation."""
    return render(fold(events), loss_role)


def read_back(chats: DataFrame) -> DataFrame:
    """Turns of rendered conversations: conv_id, i, role, text, loss_text.

    ``loss_text`` is what lies under the turn's loss span (null without one),
    cut out of the rendered text by position.
    """
    pieces = chats.select("conv_id", F.length("formatted").alias("formatted_chars"), "loss", F.posexplode(F.split("formatted", END)).alias("i", "piece"))
    order = W.partitionBy("conv_id").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    at = F.sum(F.length("piece") + len(END)).over(order) - F.length("piece") - len(END)
    placed = pieces.withColumn("at", at).filter(F.col("piece") != "").withColumn("span", F.get("loss", F.col("i")))
    body = F.substring_index("piece", SEP, -1)
    head = F.substring_index("piece", SEP, 1)
    return placed.select(
        "conv_id",
        "formatted_chars",
        "i",
        unescape(head.substr(F.lit(len(TURN) + 1), F.length(head))).alias("role"),
        unescape(body).alias("text"),
        F.when(
            F.col("span").isNotNull(),
            unescape(F.col("piece").substr((F.col("span.start") - F.col("at") + 1).cast("int"), (F.col("span.end") - F.col("span.start")).cast("int"))),
        ).alias("loss_text"),
    )


def chat_digests(chats: DataFrame) -> DataFrame:
    """One row per conversation, from the text that was read back."""
    turns = read_back(chats)
    line = F.concat("role", F.lit("\n"), "text", F.lit("\n"))
    got = turns.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.max("formatted_chars").cast("long").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("i", line.alias("line"), F.coalesce("loss_text", F.lit("")).alias("loss")))).alias("t"),
    )
    joined = got.select("conv_id", "n_turns", "formatted_chars", F.concat_ws("", F.col("t.line")).alias("lines"), F.concat_ws("", F.col("t.loss")).alias("loss"))
    return joined.select(
        "conv_id",
        "n_turns",
        F.sha2("lines", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def turns_as_log(turns: DataFrame, piece: int = 256) -> DataFrame:
    """A table of final turns as the event log of a chat that ends with them.

    By a hash of its place a turn is a whole message, a stream of deltas of
    ``piece`` code points, a draft that an edit replaces, or a streamed draft
    that is thrown away and streamed anew.  ``seq`` is (turn, step).  Repeated
    turns are messages of their own; null turns come first.
    """
    order = W.partitionBy("conv_id", "turn").orderBy("role", "text")
    text = F.coalesce("text", F.lit(""))
    draft = F.reverse(F.substring(text, 1, 64))
    none = F.lit(None).cast("string")

    def event(kind: str, body: Column, named: bool = False) -> Column:
        return F.struct(F.lit(kind).alias("kind"), (F.col("role") if named else none).alias("role"), body.alias("text"))

    streamed = F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{piece}}}"), F.lit(0)), lambda x: event("delta", x))
    whole, edited = F.array(event("message", text, True)), F.array(event("message", draft, True), event("edit", text))
    plain, again = F.concat(F.array(event("delta", F.lit(""), True)), streamed), F.concat(F.array(event("delta", draft, True), event("regenerate", none)), streamed)
    numbered = turns.select("conv_id", "turn", "role", "text", F.row_number().over(order).alias("copy"))
    way = F.pmod(F.xxhash64("conv_id", "turn", "copy"), F.lit(4))
    log = F.when(way == 0, whole).when(way == 1, plain).when(way == 2, edited).otherwise(again)
    events = numbered.select("conv_id", "turn", F.struct("turn", "copy").alias("msg"), F.posexplode(log).alias("step", "e"))
    return events.select("conv_id", F.struct("turn", "step").alias("seq"), "msg", "e.kind", "e.role", "e.text")
