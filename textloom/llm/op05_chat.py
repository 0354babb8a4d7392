"""Chat formatting from event logs, in DataFrame expressions only.

A conversation is a log of events (conv_id, seq, op, msg_id, role, text):

    message     a whole message
    start       opens message msg_id with a role (and maybe text)
    delta       appends text to message msg_id
    edit        replaces the text of msg_id; later deltas append to the new text
    regenerate  empties msg_id (text, if any, is its new beginning)
    delete      removes msg_id; a later start or edit brings it back

The log is partitioned by conversation once. Events of a message, sorted by seq, are folded to its
final text; messages, sorted by the seq of their first event, are rendered:

    <turn role>\\ntext\\n</turn>\\n

Inside roles and texts, backslash, < and > are written \\b, \\l, \\g, so no text can hold a control
string, and unescaping restores it exactly. The loss mask is a list of character ranges of the
output, one for each assistant text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "\n</turn>\n"
RESET = ("edit", "regenerate", "delete")


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def reconstruct(events: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<seq, role, text>>): the final messages of each conversation.

    Events of equal seq are ordered by op, role and text; equal messages all stay. A null text is
    empty, a null role is written empty. Deltas for a message that nothing opened make one with
    an empty role. Both aggregations use the partitioning by conversation, so a log is shuffled once.
    """
    whole = F.col("op") == "message"
    key = F.when(whole, F.concat(F.lit("#"), F.coalesce(F.col("seq").cast("string"), F.lit("")))).otherwise(F.concat(F.lit("m"), F.coalesce(F.col("msg_id").cast("string"), F.lit(""))))
    event = F.struct("seq", "op", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = events.select("conv_id", key.alias("key"), event.alias("e")).repartition("conv_id")
    logs = dealt.groupBy("conv_id", "key").agg(F.array_sort(F.collect_list("e")).alias("log"))
    turn = lambda seq, role, text: F.struct(seq.alias("seq"), role.alias("role"), text.alias("text"))
    whole_ones = F.transform("log", lambda e: turn(e["seq"], e["role"], e["text"]))
    last = F.array_max(F.transform("log", lambda e, i: F.when(e["op"].isin(*RESET), i).otherwise(-1)))
    live = F.filter("log", lambda e, i: i >= F.col("last"))
    text = F.array_join(F.transform(F.col("live"), lambda e: F.when(e["op"] == "delete", "").otherwise(e["text"])), "")
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r != "")
    folded = turn(F.col("log")[0]["seq"], F.coalesce(F.try_element_at(roles, F.lit(1)), F.lit("")), F.col("whole"))
    gone = (F.size("live") > 0) & (F.element_at("live", 1)["op"] == "delete") & (F.size("live") == 1)
    messages = logs.withColumn("last", last).withColumn("live", live).withColumn("whole", text).withColumn(
        "turns", F.when(F.col("key").startswith("#"), whole_ones).when(gone, F.array().cast("array<struct<seq:bigint,role:string,text:string>>")).otherwise(F.array(folded))
    )
    return messages.groupBy("conv_id").agg(F.array_sort(F.flatten(F.collect_list("turns"))).alias("turns"))


def render(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss array<struct<start, length>>): the template's output and its loss mask."""
    escaped = F.transform("turns", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text"), (t["role"] == "assistant").alias("loss")))
    piece = lambda t: F.concat(F.lit("<turn "), t["role"], F.lit(">\n"), t["text"], F.lit(END))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        head = F.length(t["role"]) + 8
        body = F.length(t["text"])
        span = F.struct((acc["at"] + head).alias("start"), body.alias("length"))
        return F.struct((acc["at"] + head + body + len(END)).alias("at"), F.when(t["loss"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    rows = conversations.select("conv_id", escaped.alias("x"))
    return rows.select("conv_id", F.array_join(F.transform("x", piece), "").alias("formatted"), F.aggregate("x", start, step)["spans"].alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns array<struct<role, text>>, loss_text): what the output says, unescaped."""
    parts = F.filter(F.split("formatted", END, -1), lambda p: p != "")
    cut = lambda p: F.instr(p, ">")
    turns = F.transform(parts, lambda p: F.struct(unescape(F.substring(p, F.lit(7), cut(p) - 7)).alias("role"), unescape(F.substring(p, cut(p) + 2, F.length(p))).alias("text")))
    masked = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.select("conv_id", "formatted", turns.alias("turns"), F.array_join(masked, "").alias("loss_text"))
