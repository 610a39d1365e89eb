"""State of conversations as windows over their turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vocabulary as V


def by_turn():
    return Window.partitionBy("session").orderBy("turn")


def memory_events(turns: DataFrame) -> DataFrame:
    """turns: session, turn, asked, text. (session, turn, step, slot, value, required): what each turn does to the memory, in order.

    Step -1 stores a whole reply to a question about a free-text slot; then each clause first clears the slots that it
    negates (value null, required false), then sets those it names (required true, or null: as it was)."""
    told = turns.where(F.col("asked").isin(*V.FREE_TEXT)).select("session", "turn", F.lit(-1).alias("step"), F.col("asked").alias("slot"), F.btrim("text").alias("value"), F.lit(None).cast("boolean").alias("required"))
    rows = turns.select("session", "turn", F.posexplode(T.clauses(F.col("text"))).alias("pos", "clause"))
    found = T.slots(F.col("clause"))
    must = F.when(T.is_requirement(F.lower("clause")), F.lit(True))
    ops = []
    for slot in ("color", "material", "category"):
        named, no = found[slot], found[f"{slot}_negated"]
        ops.append(F.when(named.isNotNull(), F.struct((2 * F.col("pos") + F.when(no, 0).otherwise(1)).alias("step"), F.lit(slot).alias("slot"), F.when(~no, named).alias("value"), F.when(no, F.lit(False)).otherwise(must).alias("required"))))
    for slot in ("size", "budget"):
        ops.append(F.when(found[slot].isNotNull(), F.struct((2 * F.col("pos") + 1).alias("step"), F.lit(slot).alias("slot"), found[slot].alias("value"), must.alias("required"))))
    each = rows.select("session", "turn", F.explode(F.filter(F.array(*ops), lambda o: o.isNotNull())).alias("o")).select("session", "turn", "o.*")
    return told.union(each.select("session", "turn", "step", "slot", "value", "required"))


def session_memory(turns: DataFrame) -> DataFrame:
    """session, slot, value, required after the last turn; slots that were cleared are left out."""
    order = F.struct("turn", "step")
    last = memory_events(turns).groupBy("session", "slot").agg(
        F.max_by(F.struct("value"), order).alias("last"), F.max_by(F.when(F.col("required").isNotNull(), F.struct("required")), F.when(F.col("required").isNotNull(), order)).alias("must")
    )
    return last.select("session", "slot", F.col("last.value").alias("value"), F.coalesce(F.col("must.required"), F.lit(False)).alias("required")).where("value is not null")


def next_slot(memory: DataFrame, sessions: DataFrame) -> DataFrame:
    """session, slot: the first empty one in the fixed order, or `other`."""
    held = memory.groupBy("session").agg(F.collect_set("slot").alias("held"))
    open_ = F.filter(F.array(*[F.lit(s) for s in V.SLOT_ORDER]), lambda s: ~F.array_contains(F.coalesce("held", F.array().cast("array<string>")), s))
    return sessions.select("session").distinct().join(held, "session", "left").select("session", F.coalesce(F.get(open_, F.lit(0)), F.lit("other")).alias("slot"))


def evidence(turns: DataFrame) -> DataFrame:
    """session, epoch, evidence, known, no_preference after the last turn.

    An override begins an epoch, and only the last epoch counts. A reply without preference isn't evidence and notes
    the attribute that was asked; other replies make it known, with those that they give away."""
    mode = T.rule_mode(F.col("text"))
    override, refuse = F.coalesce(mode == "intent_override", F.lit(False)), F.col("text").rlike(f"(?i){V.NO_PREFERENCE}")
    rows = turns.select("session", "turn", "asked", "text", override.alias("override"), refuse.alias("refuse"))
    rows = rows.withColumn("epoch", F.sum(F.col("override").cast("int")).over(by_turn())).withColumn("last", F.max("epoch").over(Window.partitionBy("session"))).where("epoch = last")
    asked = F.when(~F.col("override"), F.col("asked"))
    none = F.array().cast("array<string>")
    marks = F.when(F.col("refuse"), none).otherwise(F.concat(T.mark_attributes(F.col("text")), F.when(asked.isNotNull(), F.array(asked)).otherwise(none)))
    by = rows.groupBy("session", "epoch").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("refuse"), F.struct("turn", "text")))), lambda s: s["text"]), " ").alias("evidence"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(marks)))), ",").alias("known"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("refuse"), asked))), ",").alias("no_preference"),
    )
    return by


def sticky_mode(turns: DataFrame, least: float = 0.55) -> DataFrame:
    """turns with model_mode and model_p; mode: by wording, else the model's; below `least` the mode before stays, if any."""
    sure = F.coalesce(T.rule_mode(F.col("text")), F.when(F.col("model_p") >= least, F.col("model_mode")))
    held = F.last("sure", True).over(by_turn())
    first = F.first("model_mode").over(by_turn())
    return turns.withColumn("sure", sure).withColumn("mode", F.coalesce(held, first)).drop("sure")


def paging(turns: DataFrame) -> DataFrame:
    """turns: session, turn, signature. page: 0 at a new signature, one more for each repeat; a first turn that is empty
    repeats the empty query that a session begins with."""
    before = F.lag("signature", 1, "").over(by_turn())
    run = F.sum((F.col("signature") != before).cast("int")).over(by_turn())
    rows = turns.withColumn("run", run)
    nth = F.row_number().over(Window.partitionBy("session", "run").orderBy("turn"))
    return rows.withColumn("page", F.when(F.col("run") == 0, nth).otherwise(nth - 1)).drop("run")


def prefixes(turns: DataFrame) -> DataFrame:
    """turns: session, turn, scenario, text. The text so far and its label, for training the router."""
    so_far = F.array_join(F.collect_list("text").over(by_turn().rowsBetween(Window.unboundedPreceding, 0)), " ")
    nth = F.row_number().over(by_turn())
    late = F.col("scenario").isin("intent_override", "boundary")
    return turns.select("session", "turn", so_far.alias("prefix"), F.when(late & (nth == 1), "browsing").otherwise(F.col("scenario")).alias("label"))


def last_messages(turns: DataFrame) -> DataFrame:
    return turns.select("session", "turn", F.array_join(F.collect_list("text").over(by_turn().rowsBetween(-2, 0)), " ").alias("context"))
