"""Queries of conversational state, simulation and training data, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vocabulary as V
from tessera.operators import metrics, models, sessions, simulate, synthesis
from tessera.plans.fixtures import MESSAGES, OUTCOMES, PRODUCTS, Fixture
from tessera.plans.text_queries import CLAUSE_ROWS, COARSE, EXTRACT, MARKS, USEFUL, fraction, last_two, pairs_sql, product_sql, q, squeeze_sql, words

QUERIES: dict = {}
SQL: dict = {}
M, P = MESSAGES.sql(), PRODUCTS.sql()
c = F.col


def add(name: str, f, sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql:
        SQL[name] = sql


def read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


FREE = words(V.FREE_TEXT)
OPS = " UNION ALL ".join([f"SELECT session, turn, -1 AS step, asked AS slot, trim(text) AS value, CAST(NULL AS BOOLEAN) AS required FROM {M} WHERE list_contains({FREE}, asked)",
    *(f"SELECT session, turn, 2 * pos + CASE WHEN {s}_negated THEN 0 ELSE 1 END, '{s}', CASE WHEN NOT {s}_negated THEN {s} END, CASE WHEN {s}_negated THEN false WHEN required THEN true END FROM x WHERE {s} IS NOT NULL" for s in ("color", "material", "category")),
    *(f"SELECT session, turn, 2 * pos + 1, '{s}', {s}, CASE WHEN required THEN true END FROM x WHERE {s} IS NOT NULL" for s in ("size", "budget"))])
MEMORY = f"WITH x AS ({EXTRACT}), o AS ({OPS}), l AS (SELECT session, slot, value FROM o QUALIFY row_number() OVER (PARTITION BY session, slot ORDER BY turn DESC, step DESC) = 1), r AS (SELECT session, slot, required FROM o WHERE required IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session, slot ORDER BY turn DESC, step DESC) = 1), mem AS (SELECT l.session, l.slot, l.value, coalesce(r.required, false) AS required FROM l LEFT JOIN r USING (session, slot) WHERE l.value IS NOT NULL) "
add("session_memory", lambda s, d: sessions.session_memory(MESSAGES.spark(s)), MEMORY + "SELECT * FROM mem")
add("next_slot", lambda s, d: sessions.next_slot(sessions.session_memory(MESSAGES.spark(s)), MESSAGES.spark(s)), MEMORY + f"SELECT session, coalesce(list_filter({words(V.SLOT_ORDER)}, lambda x: NOT list_contains(coalesce(h, []), x))[1], 'other') AS slot FROM (SELECT DISTINCT session FROM {M}) LEFT JOIN (SELECT session, list(slot) AS h FROM mem GROUP BY session) USING (session)")
OVER, REFUSE = f"regexp_matches(text, {q('(?i)' + V.OVERRIDE)})", f"regexp_matches(text, {q('(?i)' + V.NO_PREFERENCE)})"
EVIDENCE = f"""WITH r AS (SELECT *, {OVER} AS o, {REFUSE} AS f FROM {M}), e AS (SELECT *, CAST(sum(CAST(o AS INTEGER)) OVER (PARTITION BY session ORDER BY turn) AS BIGINT) AS epoch FROM r), l AS (SELECT * FROM e QUALIFY epoch = max(epoch) OVER (PARTITION BY session)),
k AS (SELECT session, unnest(CASE WHEN f THEN [] ELSE list_concat({MARKS}, CASE WHEN asked IS NOT NULL AND NOT o THEN [asked] ELSE [] END) END) AS a FROM l)
SELECT session, epoch, coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (NOT f), '') AS evidence, coalesce((SELECT string_agg(a, ',' ORDER BY a) FROM (SELECT DISTINCT a FROM k WHERE k.session = l.session)), '') AS known, coalesce(string_agg(DISTINCT asked, ',' ORDER BY asked) FILTER (f AND NOT o), '') AS no_preference FROM l GROUP BY session, epoch"""
add("evidence_epochs", lambda s, d: sessions.evidence(MESSAGES.spark(s)), EVIDENCE)
MODES = Fixture("session string, turn int, text string, model_mode string, model_p double", [
    ("r1", 1, "boots", "browsing", 0.4), ("r1", 2, "red ones", "buying", 0.9), ("r1", 3, "hm", "browsing", 0.5), ("r1", 4, "use your judgment", "buying", 0.9), ("r1", 5, "hm", "buying", 0.3),
    ("r2", 1, "actually a hat", "browsing", 0.9), ("r2", 2, "wool", "buying", 0.54), ("r2", 3, "wool", "buying", 0.55),
])
add("route_mode", lambda s, d: sessions.sticky_mode(MODES.spark(s)).select("session", "turn", "mode"),
    f"SELECT session, turn, coalesce(last_value(sure IGNORE NULLS) OVER w, first_value(model_mode) OVER w) AS mode FROM (SELECT *, CASE WHEN {OVER} THEN 'intent_override' WHEN {REFUSE} THEN 'boundary' WHEN model_p >= 0.55 THEN model_mode END AS sure FROM {MODES.sql()}) WINDOW w AS (PARTITION BY session ORDER BY turn)")
turns = lambda s, d: read(s, d, "conversations").select(c("conv_id").alias("session"), "turn", "role", "text")


def query_paging(s, d):
    rows = turns(s, d).withColumn("signature", F.coalesce("role", F.lit("")))
    return sessions.paging(rows.select("session", "turn", F.when(c("signature") == "system", "").otherwise("said").alias("signature")))


add("query_paging", query_paging, "WITH t AS (SELECT conv_id AS session, turn, CASE WHEN role = 'system' THEN '' ELSE 'said' END AS signature FROM conversations UNION ALL SELECT DISTINCT conv_id, -1, '' FROM conversations), r AS (SELECT *, sum(CASE WHEN signature <> coalesce(p, '') THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY turn) AS run FROM (SELECT *, lag(signature) OVER (PARTITION BY session ORDER BY turn) AS p FROM t)) SELECT session, turn, signature, CAST(page AS INTEGER) AS page FROM (SELECT *, row_number() OVER (PARTITION BY session, run ORDER BY turn) - 1 AS page FROM r) WHERE turn >= 0")
add("router_prefixes", lambda s, d: sessions.prefixes(MESSAGES.spark(s).withColumn("scenario", F.when(c("session") < "m3", "buying").otherwise("boundary"))), f"SELECT session, turn, string_agg(text, ' ') OVER w AS prefix, CASE WHEN session < 'm3' THEN 'buying' WHEN row_number() OVER w = 1 THEN 'browsing' ELSE 'boundary' END AS label FROM {M} WINDOW w AS (PARTITION BY session ORDER BY turn)")
add("context_window", lambda s, d: sessions.last_messages(turns(s, d)), "SELECT conv_id AS session, turn, string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS context FROM conversations")
EMPTY = "coalesce(array_to_string(%s, '|'), '')"
CORPUS = "trim(concat_ws(' ', title, array_to_string(list_transform(features, lambda e: coalesce(e, 'None')), ' '), array_to_string(list_transform(details, lambda e: e.key || ' ' || coalesce(e.value, 'None')), ' '), description, array_to_string(categories, ' '), store))"
FIRST = lambda x, r: f"lower(regexp_extract({x}, {q('(?i)' + r)}, 1))"
DISTINCT = lambda x: f"list_filter(list_transform(range(1, len({x}) + 1), lambda i: CASE WHEN list_position({x}, {x}[i]) = i THEN {x}[i] END), lambda v: v IS NOT NULL)"
CARD = f"""WITH b AS (SELECT *, {FIRST(CORPUS, V.CARD_MATERIAL)} AS m, {FIRST(CORPUS, V.CARD_COLOR)} AS k, list_concat(list_filter(coalesce(features, []), lambda e: e IS NOT NULL AND e <> ''), {pairs_sql('details')}) AS r0 FROM {P}),
b1 AS (SELECT *, CASE WHEN m <> '' THEN list_concat([m], r0) ELSE r0 END AS r1 FROM b),
b2 AS (SELECT *, CASE WHEN k = '' THEN r1 WHEN len(r1) = 0 THEN ['color: ' || k] ELSE list_concat(list_concat(r1[1:1], ['color: ' || k]), r1[2:]) END AS r2 FROM b1),
b3 AS (SELECT *, list_filter(list_transform(CASE WHEN coalesce(price, '') <> '' THEN list_concat(r2, ['budget around $' || price]) ELSE r2 END, lambda v: {squeeze_sql('v', 180)}), lambda v: v <> '') AS r3 FROM b2),
b4 AS (SELECT *, CASE WHEN len(r3) > 0 THEN {DISTINCT('r3')} ELSE [{squeeze_sql("CASE WHEN coalesce(title, '') <> '' THEN title ELSE 'product' END", 180)}] END AS r FROM b3),
card AS (SELECT *, r[1:2] AS hard, CASE WHEN len(r) > 2 THEN r[3:4] ELSE r[1:1] END AS soft FROM b4)
"""


def cards(s):
    hard, soft = synthesis.intent_card()
    return PRODUCTS.spark(s).withColumns({"hard": hard, "soft": soft})


add("intent_card", lambda s, d: cards(s).select("id", F.array_join("hard", "|").alias("hard"), F.array_join("soft", "|").alias("soft")), CARD + "SELECT id, array_to_string(hard, '|') AS hard, array_to_string(soft, '|') AS soft FROM card")
SCENARIOS = ("buying", "browsing", "intent_override", "boundary")


def initial_message(s, d):
    rows = cards(s).withColumn("scenario", F.explode(F.array(*[F.lit(x) for x in SCENARIOS])))
    category = T.coarse_category(F.coalesce("categories", F.array().cast("array<string>")))
    return rows.select("id", "scenario", synthesis.opening_message(c("scenario"), category, c("hard"), c("soft")).alias("message"))


add("initial_message", initial_message, CARD + f", u AS (SELECT *, {COARSE} AS u FROM card), n AS (SELECT *, {last_two('u')} AS cat, unnest({words(SCENARIOS)}) AS scenario FROM u) SELECT id, scenario, CASE WHEN scenario = 'buying' THEN 'I''m looking for ' || cat || '. A key requirement is: ' || hard[1] || '.' WHEN scenario = 'intent_override' THEN 'I''m looking for ' || cat || '. ' || soft[len(soft)] ELSE 'I''m looking for ' || cat || ', but I''m still exploring.' END AS message FROM n")
add("override_plan", lambda s, d: cards(s).select("id", (F.lit(3) + (T.hash_fraction(c("id")) >= 0.5).cast("int")).alias("turn"), F.element_at("soft", -1).alias("old_value"), F.get("hard", F.lit(0)).alias("new_value")), CARD + f"SELECT id, 3 + CAST({fraction('id')} >= 0.5 AS INTEGER) AS turn, soft[len(soft)] AS old_value, hard[1] AS new_value FROM card")
DENSE = f"rtrim(left({product_sql(800, 600, 800)}, 3000), ' ')"
TRAIN = f"""WITH b AS (SELECT *, {FIRST(DENSE, V.TRAIN_MATERIAL)} AS m, {FIRST(DENSE, V.TRAIN_COLOR)} AS k FROM {P}),
b1 AS (SELECT *, list_filter(flatten([CASE WHEN m <> '' THEN [m] ELSE [] END, CASE WHEN k <> '' THEN [k || ' color'] ELSE [] END, list_transform(coalesce(features, [])[1:4], lambda v: {squeeze_sql('v', 180)}), list_transform(coalesce(details, [])[1:4], lambda e: {squeeze_sql("e.key || ': ' || coalesce(e.value, 'None')", 180)}), CASE WHEN coalesce(price, '') <> '' THEN ['around $' || price] ELSE [] END]), lambda v: v <> '') AS r FROM b), tr AS (SELECT *, {DISTINCT('r')} AS values_ FROM b1)
"""
add("train_constraints", lambda s, d: PRODUCTS.spark(s).select("id", F.array_join(synthesis.train_constraints(), "|").alias("constraints")), TRAIN + "SELECT id, array_to_string(values_, '|') AS constraints FROM tr")


def emulate_query(s, d):
    rows = PRODUCTS.spark(s).withColumn("scenario", F.explode(F.array(*[F.lit(x) for x in SCENARIOS])))
    return rows.select("id", "scenario", synthesis.emulated_query(c("scenario"), T.hash_fraction(F.concat("id", F.lit("coin")))).alias("query"))


add("emulate_query", emulate_query, TRAIN + f", u AS (SELECT *, {USEFUL} AS u FROM tr), n AS (SELECT *, lower({last_two('u')}) AS cat, coalesce(values_[1], {squeeze_sql('title', 180)}) AS one, {squeeze_sql('store', 100)} AS brand, CASE WHEN {fraction(chr(105) + chr(100) + ' || ' + chr(39) + 'coin' + chr(39))} < 0.5 THEN 'Please help me find ' ELSE 'I''m looking for ' END AS hello, unnest({words(SCENARIOS)}) AS scenario FROM u) SELECT id, scenario, CASE scenario WHEN 'buying' THEN hello || cat || '. A key requirement is ' || one || '.' WHEN 'browsing' THEN 'I''m exploring options for ' || cat || '. I tend to prefer ' || one || '.' WHEN 'intent_override' THEN 'I need ' || cat || ' and was initially considering ' || CASE WHEN brand <> '' THEN brand ELSE 'a simple everyday style' END || '. Actually, ignore that earlier preference; prioritize ' || one || ' and ' || coalesce(values_[2], one) || '.' ELSE hello || cat || '. I don''t have a preference for the other details; use your judgment. The one thing that matters is ' || one || '.' END AS query FROM n")
add("training_union", lambda s, d: read(s, d, "part").select(F.concat(F.lit("catalog-"), "p_partkey").alias("example_id"), c("p_name").alias("query")).unionByName(read(s, d, "benchmark").select(F.concat(F.lit("public-"), "item_id").alias("example_id"), c("text").alias("query"), F.lit("public").alias("difficulty")), True), "SELECT 'catalog-' || p_partkey AS example_id, p_name AS query, CAST(NULL AS VARCHAR) AS difficulty FROM part UNION ALL SELECT 'public-' || item_id, text, 'public' FROM benchmark")


def valid_top10(s, d):
    lists = read(s, d, "lineitem").groupBy(c("l_orderkey").alias("query")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string")).alias("ids"))
    return synthesis.valid_top(lists, read(s, d, "part").where("p_size <= 30").select(c("p_partkey").cast("string").alias("id")))


add("valid_top10", valid_top10, "WITH o AS (SELECT l_orderkey AS query, CAST(l_partkey AS VARCHAR) AS id, min(l_linenumber) AS pos FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 30) GROUP BY ALL) SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY pos, CAST(id AS BIGINT)) AS INTEGER) AS rank, id FROM o QUALIFY rank <= 10")


def first_hit(s, d):
    """Users as samples, their events as turns, purchases as hits; the rank is made of the value."""
    rows = read(s, d, "events").select(c("user_id").alias("sample"), c("event_id").alias("turn"), F.when(c("event_type") == "purchase", (F.floor(F.abs("value")) % 20 + 1).cast("int")).alias("rank"), (c("event_id") >= 50).alias("active"))
    return synthesis.first_hit(rows)


add("first_hit", first_hit, "WITH t AS (SELECT user_id AS sample, event_id AS turn, CASE WHEN event_type = 'purchase' THEN CAST(CAST(floor(abs(value)) AS BIGINT) % 20 + 1 AS INTEGER) END AS rank, event_id >= 50 AS active FROM events) SELECT sample, min(turn) FILTER (active AND rank <= 10) AS hit_turn, arg_min(rank, turn) FILTER (active AND rank <= 10) AS best_rank FROM t GROUP BY sample")
add("grouped_folds", lambda s, d: synthesis.even_folds(read(s, d, "part").select(c("p_partkey").alias("sample"), c("p_type").alias("scenario"), c("p_size").alias("difficulty"))), "SELECT p_partkey AS sample, CAST((row_number() OVER (ORDER BY p_type, p_size, md5('2026:' || p_partkey)) - 1) % 5 AS INTEGER) AS fold FROM part")


def outcomes(s, d):
    """Sessions of the literal products in all scenarios, simulated. State is cut by checkpoint() in the cluster's folder."""
    hard, soft = synthesis.intent_card()
    catalog = PRODUCTS.spark(s).select("id", "title", F.array_join("categories", " ").alias("categories"), F.array_join("features", " ").alias("features"), F.array_join(T.pairs(c("details")), " ").alias("details"), "store", "description")
    rows = PRODUCTS.spark(s).withColumns({"hard": hard, "soft": soft, "scenario": F.explode(F.array(*[F.lit(x) for x in SCENARIOS]))})
    category = T.coarse_category(F.coalesce("categories", F.array().cast("array<string>")))
    over = c("scenario") == "intent_override"
    new = F.get("hard", F.lit(0))
    sample = rows.select(
        F.concat_ws("-", "id", "scenario").alias("session"), "scenario", c("id").alias("target"), synthesis.opening_message(c("scenario"), category, c("hard"), c("soft")).alias("message"), F.concat("hard", "soft").alias("constraints"),
        F.when(over, F.lit(3) + (T.hash_fraction(c("id")) >= 0.5).cast("int")).alias("override_turn"), F.when(over, new).alias("new_value"),
        F.when(over, F.concat(F.lit("Actually, ignore my earlier preference. What I need is: "), new, F.lit("."))).alias("override_message"),
    )
    if s.conf.get("spark.checkpoint.dir", None) is None and s.sparkContext.getCheckpointDir() is None:
        import tempfile

        if not s.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return simulate.evaluate(sample, catalog, lambda df: df.checkpoint())


add("simulate_sessions", outcomes)
add("evaluate_agent", lambda s, d: metrics.with_score(outcomes(s, d).groupBy("scenario").agg(*metrics.session_metrics())))


def router_modes(s, d):
    """A router fitted on the literal sessions, applied to them; labels as the training data has them."""
    rows = sessions.prefixes(MESSAGES.spark(s).withColumn("scenario", F.when(c("session") < "m3", "buying").when(c("session") < "m4", "browsing").when(c("session") == "m4", "intent_override").otherwise("boundary")))
    return models.route(models.fit_router(rows), rows).select("session", "turn", "label", "model_mode", "model_p")


add("router_modes", router_modes)
