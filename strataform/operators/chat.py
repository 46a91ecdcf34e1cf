"""Conversation operators over (conv_id, turn, role, text) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataform.functions.text import strip

ROLES = ("system", "user", "assistant")


def with_role(messages: DataFrame) -> DataFrame:
    """Role in the three known kinds, else null (names of message classes count)."""
    r = F.lower("role")
    kind = F.when(r.isin("system", "systemmessage", "developer"), "system").when(r.isin("user", "human", "humanmessage"), "user").when(r.isin("assistant", "ai", "aimessage"), "assistant")
    return messages.withColumn("role", kind)


def _joined(rows: str, blank: bool = False) -> F.Column:
    texts = F.transform(F.array_sort(rows), lambda x: x["text"])
    kept = texts if blank else F.filter(texts, lambda t: F.coalesce(t.rlike(r"(?U)\S"), F.lit(False)))
    t = strip(F.array_join(F.transform(kept, lambda x: F.coalesce(x, F.lit(""))), "\n\n"))
    return F.when(t == "", " ").otherwise(t)


def fold_system(messages: DataFrame) -> DataFrame:
    """System messages become part of the user message that follows them: a run of system messages and at most one
    user message is one user message, a run of user messages is one, assistant messages stay alone. A conversation
    of one message stays as it is."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    all_rows = Window.partitionBy("conv_id")
    m = messages.withColumn("n", F.count(F.lit(1)).over(all_rows)).withColumn("prev", F.lag("role").over(w))
    # a user right after a system run belongs to it; the next user starts anew
    m = m.withColumn("joins_system", (F.col("role") == "user") & F.coalesce(F.col("prev") == "system", F.lit(False)))
    m = m.withColumn("prev_joined", F.coalesce(F.lag("joins_system").over(w), F.lit(False)))
    same = F.when(F.col("role") == "system", F.col("prev") == "system").when(F.col("role") == "user", F.col("joins_system") | (F.col("prev") == "user") & ~F.col("prev_joined")).otherwise(False)
    m = m.withColumn("new", (~F.coalesce(same, F.lit(False)) | (F.col("n") <= 1)).cast("int"))
    m = m.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = m.groupBy("conv_id", "run").agg(F.min("turn").alias("turn"), F.first("role").alias("r"), F.max("n").alias("n"), F.collect_list(F.struct("turn", "text")).alias("rows"))
    role = F.when((F.col("n") > 1) & (F.col("r") == "system"), "user").otherwise(F.col("r"))
    text = F.when((F.col("n") <= 1) | (F.col("r") == "assistant"), F.col("rows")[0]["text"]).otherwise(_joined("rows"))
    return g.select("conv_id", "turn", role.alias("role"), text.alias("text"))


def last_user(messages: DataFrame) -> DataFrame:
    """One user message per conversation: its last one, or a blank."""
    last = F.max_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    return messages.groupBy("conv_id").agg(F.coalesce(last, F.lit(" ")).alias("text")).select("conv_id", F.lit("user").alias("role"), "text")


def merge_roles(messages: DataFrame) -> DataFrame:
    """Unknown roles dropped, neighbours of one role merged, trailing assistant messages dropped, and a blank user
    message where there is none."""
    known = messages.where(F.col("role").isin(*ROLES))
    w = Window.partitionBy("conv_id").orderBy("turn")
    m = known.withColumn("new", (F.lag("role").over(w).isNull() | (F.lag("role").over(w) != F.col("role"))).cast("int"))
    m = m.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = m.groupBy("conv_id", "run").agg(F.first("role").alias("role"), F.min("turn").alias("turn"), F.collect_list(F.struct("turn", "text")).alias("rows"))
    g = g.select("conv_id", "run", "turn", "role", _joined("rows", blank=True).alias("text"))
    last = g.groupBy("conv_id").agg(F.max(F.when(F.col("role") != "assistant", F.col("run"))).alias("keep"), F.max((F.col("role") == "user").cast("int")).alias("has_user"), F.max("turn").alias("end"))
    kept = g.join(last, "conv_id").where("run <= keep").select("conv_id", "turn", "role", "text")
    convs = messages.select("conv_id").distinct().join(last, "conv_id", "left")
    blank = convs.where("coalesce(has_user, 0) = 0").select("conv_id", (F.coalesce("end", F.lit(-1)) + 1).alias("turn"), F.lit("user").alias("role"), F.lit(" ").alias("text"))
    return kept.unionByName(blank)


def normalise(messages: DataFrame, merge_only: bool) -> DataFrame:
    """The message form a chat model takes: merged roles, or the last user message of the folded conversation."""
    if merge_only:
        return merge_roles(messages)
    return last_user(fold_system(messages))
