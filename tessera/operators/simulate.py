"""The simulated customer and the evaluation loop: ten turns, each over all sessions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vocabulary as V
from tessera.operators import bm25

TURNS, TOP = 10, 10


def reply(attribute: Column, scenario: Column, constraints: Column, disclosed: Column, refused: Column) -> tuple[Column, Column, Column]:
    """(message, newly disclosed, whether the one refusal of a boundary customer is used up)."""
    refuses = (scenario == "boundary") & ~refused
    found = F.slice(F.filter(constraints, lambda v: ~F.array_contains(disclosed, v) & ((attribute == "other") | (T.classify_words(v) == attribute))), 1, 2)
    none = F.array().cast("array<string>")
    said = F.when(refuses, F.concat(F.lit("I don't have a preference for "), attribute, F.lit("; please use your judgment.")))
    said = said.when(F.size(found) == 0, F.concat(F.lit("I don't have an additional preference for "), attribute, F.lit(".")))
    said = said.otherwise(F.concat(F.lit("For that, what matters is: "), F.array_join(found, "; "), F.lit(".")))
    return said, F.when(refuses, none).otherwise(found), refused | refuses


def evaluate(sessions: DataFrame, catalog: DataFrame, keep, fields: dict[str, float] = V.FIELD_WEIGHTS, order=V.SLOT_ORDER) -> DataFrame:
    """sessions: session, scenario, target, message (the first), constraints, override_turn, override_message, new_value (null but for
    overrides). session, scenario, hit_turn, best_rank.

    The agent searches by BM25 over all that was said and asks for the slots in their fixed order, `other` at the end. A turn's
    state is written by `keep` (a function that stores a DataFrame and returns it read back), so that plans stay short;
    sessions that have hit drop out of later turns."""
    none = F.array().cast("array<string>")
    state = keep(sessions.select("*", F.col("message").alias("said"), none.alias("disclosed"), F.lit(False).alias("refused"), F.col("override_turn").isNull().alias("active"), F.lit(None).cast("int").alias("hit_turn"), F.lit(None).cast("int").alias("best_rank")))
    asked = [*order, "other"]
    for turn in range(1, TURNS + 1):
        terms = state.where("hit_turn is null").select(F.col("session").alias("query_id"), F.explode(T.first_terms(F.col("said"))).alias("term"))
        found = bm25.search(catalog, terms, fields, TOP, "id").select(F.col("query_id").alias("session"), F.col("id").alias("target"), "rank")
        hits = state.select("session", "target").join(found, ["session", "target"]).select("session", "rank")
        rows = state.join(hits, "session", "left")
        new = F.col("active") & F.col("hit_turn").isNull() & F.col("rank").isNotNull()
        rows = rows.withColumns({"hit_turn": F.when(new, F.lit(turn)).otherwise(F.col("hit_turn")), "best_rank": F.when(new, F.col("rank")).otherwise(F.col("best_rank"))}).drop("rank")
        said, told, refused = reply(F.lit(asked[min(turn, len(asked)) - 1]), F.col("scenario"), F.col("constraints"), F.col("disclosed"), F.col("refused"))
        change = ~F.col("active") & (F.col("override_turn") == turn + 1)
        changed = F.coalesce(change, F.lit(False))
        message = F.when(changed, F.col("override_message")).otherwise(said)
        told = F.when(changed, F.array("new_value")).otherwise(told)
        state = keep(rows.withColumns({"message": message, "told": told, "next_refused": F.when(changed, F.col("refused")).otherwise(refused)}).withColumns({"said": F.concat_ws(" ", "said", "message"), "disclosed": F.array_union("disclosed", "told"), "refused": F.col("next_refused"), "active": F.col("active") | changed}).drop("told", "next_refused"))
    return state.select("session", "scenario", "hit_turn", "best_rank")
