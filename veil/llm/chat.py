r"""Chat formatting with a grammar round trip (native).

A turn is rendered as  <s>ROLE[INST]TEXT</s>  or, where the loss applies,
<s>ROLE[/INST]TEXT</s>.  The parser finds these by one regular expression and undoes
escapes: a backslash stands for the character after it.  A role or text is first rendered
as it is; if the parser does not give back the very same turn, it is escaped: backslashes
are doubled and every control string gets a backslash behind its first character.

Defined results: null texts and null roles are empty; rows of a conversation are ordered
by turn (null first), then role, then text, repeated rows stay; a null conv_id is a
conversation of its own; an empty table gives no rows.  One conversation is one output
string, so its rows meet in one group by nature; that is the size of a conversation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
TURN = r"(?s)<s>(.*?)(\[/?INST\])(.*?)</s>"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render_turn(role: Column, text: Column, loss: Column) -> Column:
    return F.concat(F.lit("<s>"), role, F.when(loss, F.lit("[/INST]")).otherwise(F.lit("[INST]")), text, F.lit("</s>"))


def parse(rendered: Column) -> Column:
    """Array of (role, loss, text) of a rendered conversation."""
    part = lambda n: F.regexp_extract_all(rendered, F.lit(TURN), F.lit(n))
    return F.transform(
        F.arrays_zip(part(1).alias("r"), part(2).alias("m"), part(3).alias("t")),
        lambda x: F.struct(unescape(x["r"]).alias("role"), (x["m"] == "[/INST]").alias("loss"), unescape(x["t"]).alias("text")),
    )


def format_turns(rows: DataFrame, loss_roles: Sequence[str] = ("assistant",)) -> DataFrame:
    """(conv_id, turn, role, text) to (conv_id, turns, formatted).

    turns is the source, an array of (role, loss, text); formatted is the string.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    d = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), role.isin(*loss_roles).alias("loss"))
    raw = render_turn(F.col("role"), F.col("text"), F.col("loss"))
    same = parse(raw) == F.array(F.struct("role", "loss", "text"))
    safe = render_turn(escape(F.col("role")), escape(F.col("text")), F.col("loss"))
    # only texts with a control string or a backslash can conflict; the rest needs no trial
    d = d.withColumn("risk", F.concat("role", F.lit("\n"), "text").rlike(r"\\|</?s>|\[/?INST\]"))
    d = d.withColumn("out", F.when(~F.col("risk"), raw).when(same, raw).otherwise(safe))
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "loss", "out")))
    d = d.groupBy("conv_id").agg(turns.alias("all"))
    return d.select(
        "conv_id",
        F.transform("all", lambda x: F.struct(x["role"].alias("role"), x["loss"].alias("loss"), x["text"].alias("text"))).alias("turns"),
        F.array_join(F.transform("all", lambda x: x["out"]), "").alias("formatted"),
    )


def format_conversations(rows: DataFrame, loss_roles: Sequence[str] = ("assistant",)) -> DataFrame:
    """format_turns() with what the parser reads back: parsed, and whether it is identical."""
    d = format_turns(rows, loss_roles)
    d = d.withColumn("parsed", parse(F.col("formatted")))
    return d.withColumn("identical", F.col("parsed") == F.col("turns"))


def conflict_rows(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts hold the template's own marks, as literals of one row."""
    turns = [F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(n).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")) for n, role in enumerate(("user", "assistant"))]
    return spark.range(1).select(F.inline(F.array(*turns)))


def digest(conversations: DataFrame) -> DataFrame:
    """The read-back columns of formatted conversations."""
    t = F.col("parsed")
    told = F.array_join(F.transform(t, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter(t, lambda x: x["loss"]), lambda x: x["text"]), "")
    checked = F.when(F.col("identical"), F.col("conv_id")).otherwise(F.raise_error(F.lit("a conversation does not survive its round trip")).cast("long"))
    return conversations.select(
        checked.alias("conv_id"),
        F.size(t).cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
