"""Queries of text functions, over literal rows and over the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vocabulary as V
from tessera.plans.fixtures import CANDIDATES, MESSAGES, PRODUCTS

QUERIES: dict = {}
SQL: dict = {}
M, P = MESSAGES.sql(), PRODUCTS.sql()
q = lambda s: "'" + s.replace("'", "''") + "'"
words = lambda ws: "[" + ", ".join(map(q, ws)) + "]"


def rx(pattern: str) -> str:
    return q(pattern)


def squeeze_sql(x: str, n: int) -> str:
    return f"rtrim(left(trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'), ' -;,.'), {n}), ' ')"


def list_sql(x: str) -> str:
    return f"array_to_string(list_filter(coalesce({x}, []), lambda e: e IS NOT NULL AND e <> ''), '; ')"


def pairs_sql(x: str) -> str:
    return f"list_transform(list_filter(coalesce({x}, []), lambda e: e.value IS NOT NULL AND e.value <> ''), lambda e: e.key || ': ' || e.value)"


def raw_list(x: str) -> str:
    return f"coalesce(array_to_string(list_transform({x}, lambda e: coalesce(e, 'None')), ' '), '')"


def raw_pairs(x: str) -> str:
    return f"coalesce(array_to_string(list_transform({x}, lambda e: e.key || ' ' || coalesce(e.value, 'None')), ' '), '')"


def product_sql(f: int, d: int, s: int) -> str:
    parts = (("title", squeeze_sql("title", 400)), ("category", squeeze_sql(list_sql("categories"), 300)), ("brand", squeeze_sql("store", 120)), ("features", squeeze_sql(list_sql("features"), f)), ("details", squeeze_sql(f"array_to_string({pairs_sql('details')}, '; ')", d)), ("description", squeeze_sql("description", s)))
    named = ", ".join(f"CASE WHEN {v} <> '' THEN '{n}: ' || {v} END" for n, v in parts)
    return f"concat_ws(' | ', {named}, CASE WHEN coalesce(price, '') <> '' THEN 'price: $' || price END)"


def terms_sql(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({x}, '[A-Za-z0-9]+'), lambda t: lower(t)), lambda t: length(t) > 1 AND NOT list_contains({words(V.STOPWORDS)}, t))"


def case_sql(x: str, rules, test) -> str:
    return "CASE " + " ".join(f"WHEN {test(x, r)} THEN '{n}'" for n, r in rules) + " ELSE 'feature' END"


def classify_rx_sql(x: str) -> str:
    rules = (("budget", V.BUDGET_RX), ("material", V.MATERIAL_RX), ("color", V.COLOR_RX), ("size", V.SIZE_RX), ("style", V.STYLE_RX), ("use_case", V.USE_CASE_RX))
    return case_sql(f"lower({x})", rules, lambda c, r: f"regexp_matches({c}, {q(r)})")


def classify_words_sql(x: str) -> str:
    inner = case_sql(f"lower({x})", V.REPLY_WORDS, lambda c, ws: "(" + " OR ".join(f"contains({c}, {q(w)})" for w in ws) + ")")
    return f"CASE WHEN contains(lower({x}), 'budget') OR regexp_matches(lower({x}), '(?:\\$|<=|under)\\s*\\d') THEN 'budget' ELSE {inner} END"


def earliest_sql(x: str, options) -> str:
    return f"list_min(list_filter(list_transform({words(options)}, lambda o: {{'at': instr({x}, o), 'option': o}}), lambda s: s['at'] > 0)).option"


def negated_sql(x: str, word: str) -> str:
    head = r"\b(" + "|".join(V.NEGATIONS) + r")\b(?:\s+\w+){0,3}\s+"
    return f"coalesce(regexp_matches({x}, {q(head)} || {word} || '\\b'), false)"


CLAUSES = "list_filter(list_transform(string_split_regex(text, ',|\\band\\b'), lambda c: trim(c)), lambda c: c <> '')"
REQUIRED = r"\b(?:" + "|".join(V.TRIGGERS) + r")\b"


def add(name: str, f, sql: str) -> None:
    QUERIES[name], SQL[name] = f, sql


def over(fixture, *columns):
    return lambda spark, sf_dir: fixture.spark(spark).select(*[c() if callable(c) else c for c in columns])


c = F.col
PROFILE = lambda: F.array(F.lit("warm"), F.lit(""), F.lit("style"))
add("index_text", over(PRODUCTS, "id", lambda: T.index_list(c("features")).alias("features"), lambda: T.index_pairs(c("details")).alias("details"), lambda: F.coalesce("description", F.lit("")).alias("description")),
    f"SELECT id, {raw_list('features')} AS features, {raw_pairs('details')} AS details, coalesce(description, '') AS description FROM {P}")
add("clean_text", over(PRODUCTS, "id", lambda: T.squeeze(c("title"), 12).alias("title"), lambda: T.squeeze(T.list_text(c("features")), 360).alias("features"), lambda: T.squeeze(F.array_join(T.pairs(c("details")), "; "), 360).alias("details"), lambda: T.squeeze(c("description"), 1800).alias("description")),
    f"SELECT id, {squeeze_sql('title', 12)} AS title, {squeeze_sql(list_sql('features'), 360)} AS features, {squeeze_sql('array_to_string(' + pairs_sql('details') + chr(44) + chr(39) + '; ' + chr(39) + ')', 360)} AS details, {squeeze_sql('description', 1800)} AS description FROM {P}")
add("product_text", over(PRODUCTS, "id", lambda: T.product_text().alias("text"), lambda: T.product_text(800, 600, 800, 60, True).alias("dense")),
    f"SELECT id, left({product_sql(700, 450, 600)}, 1800) AS text, rtrim(left({product_sql(800, 600, 800)}, 60), ' ') AS dense FROM {P}")
add("searchable_text", over(PRODUCTS, "id", lambda: T.searchable_text().alias("text")),
    f"SELECT id, trim(concat_ws(' ', title, array_to_string(list_transform(features, lambda e: coalesce(e, 'None')), ' '), array_to_string(list_transform(details, lambda e: e.key || ' ' || coalesce(e.value, 'None')), ' '), description, array_to_string(categories, ' '), store)) AS text FROM {P}")
add("numeric_price", over(PRODUCTS, "id", lambda: T.numeric_price(c("price")).alias("price")),
    f"SELECT id, CASE WHEN NOT isnan(v) AND NOT isinf(v) AND v >= 0 THEN v END AS price FROM (SELECT id, TRY_CAST(price AS DOUBLE) AS v FROM {P})")
add("budget_bucket", over(PRODUCTS, "id", lambda: T.budget_bucket(c("price")).alias("bucket")),
    f"SELECT id, CASE WHEN v < 25 THEN 'under $25' WHEN v < 50 THEN '$25–$50' WHEN v < 100 THEN '$50–$100' WHEN v IS NOT NULL THEN '$100 or more' END AS bucket FROM (SELECT id, TRY_CAST(price AS DOUBLE) AS v FROM {P})")
add("tokenize_terms", lambda spark, d: spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.array_join(T.query_terms(c("text")), " ").alias("terms")),
    f"SELECT item_id, array_to_string({terms_sql('text')}, ' ') AS terms FROM benchmark")
add("query_terms", lambda spark, d: spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.posexplode(T.first_terms(c("text"))).alias("pos", "term")),
    f"SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY first) - 1 AS INTEGER) AS pos, term FROM (SELECT item_id, term, min(pos) AS first FROM (SELECT item_id, unnest({terms_sql('text')}) AS term, unnest(range(len({terms_sql('text')}))) AS pos FROM benchmark) GROUP BY item_id, term) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY first) <= {V.MAX_TERMS}")
add("index_tokens", lambda spark, d: spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.array_join(T.index_tokens(c("text")), " ").alias("tokens")),
    r"SELECT conv_id, turn, array_to_string(regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+'), ' ') AS tokens FROM conversations")
matched = lambda ts, x: "array_to_string(list_filter(" + words(ts) + f", lambda t: regexp_matches(lower({x}), '\\b' || t || '\\b')), ',')"
TEXTS = ("features", V.FEATURE_TERMS), ("styles", V.STYLE_TERMS), ("use_cases", V.USE_CASE_TERMS)
add("matched_terms", over(PRODUCTS, "id", *[lambda n=n, ts=ts: F.array_join(T.matched_terms(T.product_text(), ts), ",").alias(n) for n, ts in TEXTS]),
    "SELECT id, " + ", ".join(f"{matched(ts, product_sql(700, 450, 600))} AS {n}" for n, ts in TEXTS) + f" FROM {P}")
add("classify_constraint_rx", over(MESSAGES, "session", "turn", lambda: T.classify_pattern(c("text")).alias("slot")), f"SELECT session, turn, {classify_rx_sql('text')} AS slot FROM {M}")
add("classify_constraint_sub", over(MESSAGES, "session", "turn", lambda: T.classify_words(c("text")).alias("slot")), f"SELECT session, turn, {classify_words_sql('text')} AS slot FROM {M}")
GENERIC = words(V.GENERIC_CATEGORIES)
last_two = lambda x: f"CASE WHEN len({x}) > 0 THEN array_to_string(list_slice({x}, greatest(len({x}) - 1, 1), len({x})), ' ') ELSE '{V.NO_CATEGORY}' END"
COARSE = f"list_filter(list_transform(flatten(list_transform(coalesce(categories, []), lambda x: string_split(x, ','))), lambda p: trim(p)), lambda p: p <> '' AND NOT list_contains({GENERIC}, lower(p)))"
USEFUL = f"list_filter(list_transform(coalesce(categories, []), lambda x: {squeeze_sql('x', 100)}), lambda p: p <> '' AND NOT list_contains({GENERIC}, lower(p)))"
add("coarse_category", over(PRODUCTS, "id", lambda: T.coarse_category(F.coalesce("categories", F.array().cast("array<string>"))).alias("category")), f"SELECT id, {last_two('u')} AS category FROM (SELECT id, {COARSE} AS u FROM {P})")
add("leaf_category", over(PRODUCTS, "id", lambda: T.leaf_category(c("categories")).alias("leaf"), lambda: T.category_phrase(c("categories")).alias("phrase")),
    f"SELECT id, CASE WHEN len(u) > 0 THEN u[len(u)] ELSE '{V.NO_CATEGORY}' END AS leaf, lower({last_two('u')}) AS phrase FROM (SELECT id, {USEFUL} AS u FROM {P})")
add("opening_category", over(MESSAGES, "session", "turn", lambda: T.opening_category(c("text")).alias("opening")),
    rf"SELECT session, turn, string_split_regex(CASE WHEN regexp_matches(text, '[.!?]\s') THEN regexp_extract(text, '^([\s\S]*?[.!?])\s', 1) ELSE text END, '(?i)[,;]\s*(?:but\b|i am\b|i''m\b)')[1] AS opening FROM {M}")
add("compose_query", lambda spark, d: MESSAGES.spark(spark).groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]).alias("turns")).select("session", T.compose_query(c("turns"), PROFILE(), F.lit(" likes  wool "), 120).alias("query")),
    f"WITH t AS (SELECT session, turn, {squeeze_sql('text', 500)} AS s FROM {M}), n AS (SELECT session, turn, s, row_number() OVER (PARTITION BY session ORDER BY turn) AS k FROM t WHERE s <> ''), j AS (SELECT session, string_agg('turn ' || k || ': ' || s, ' ' ORDER BY k) AS said FROM n GROUP BY session) SELECT session, ltrim(right('preference tags: warm; style | profile: likes wool | ' || coalesce(said, ''), 120), ' ') AS query FROM j")
add("clause_split", over(MESSAGES, "session", "turn", lambda: F.posexplode(T.clauses(c("text"))).alias("pos", "clause")), f"SELECT session, turn, CAST(unnest(range(len(c))) AS INTEGER) AS pos, unnest(c) AS clause FROM (SELECT session, turn, {CLAUSES} AS c FROM {M})")
add("negation", over(MESSAGES, "session", "turn", *[lambda w=w: T.is_negated(F.lower("text"), F.lit(w)).alias(w) for w in ("black", "red", "suede")]), f"SELECT session, turn, " + ", ".join(f"{negated_sql('lower(text)', q(w))} AS {w}" for w in ("black", "red", "suede")) + f" FROM {M}")
add("requirement_flag", over(MESSAGES, "session", "turn", lambda: T.is_requirement(F.lower("text")).alias("required")), f"SELECT session, turn, regexp_matches(lower(text), {q(REQUIRED)}) AS required FROM {M}")
SLOTS = (("color", V.COLORS), ("material", V.MATERIALS), ("category", V.CATEGORIES))
add("earliest_match", over(MESSAGES, "session", "turn", *[lambda n=n, o=o: T.earliest(F.lower("text"), o).alias(n) for n, o in SLOTS]), "SELECT session, turn, " + ", ".join(f"{earliest_sql('lower(text)', o)} AS {n}" for n, o in SLOTS) + f" FROM {M}")
some = lambda x, r: f"CASE WHEN regexp_matches({x}, {q(r)}) THEN regexp_extract({x}, {q(r)}, 1) END"
SIZE, BUDGET = r"size\s*(\d+(\.\d+)?)", r"(?:\$|under|below|budget)\s*\$?(\d+)"
CLAUSE_ROWS = f"(SELECT session, turn, asked, text, CAST(unnest(range(len(c))) AS INTEGER) AS pos, lower(unnest(c)) AS clause FROM (SELECT *, {CLAUSES} AS c FROM {M}))"
EXTRACT = f"SELECT session, turn, asked, text, pos, regexp_matches(clause, {q(REQUIRED)}) AS required, {some('clause', SIZE)} AS size, {some('clause', BUDGET)} AS budget, " + ", ".join(f"{n}, {negated_sql('clause', n)} AS {n}_negated" for n, _ in SLOTS) + " FROM (SELECT *, " + ", ".join(f"{earliest_sql('clause', o)} AS {n}" for n, o in SLOTS) + f" FROM {CLAUSE_ROWS})"


def slot_rows(spark):
    rows = MESSAGES.spark(spark).select("session", "turn", "asked", "text", F.posexplode(T.clauses(c("text"))).alias("pos", "clause"))
    return rows.select("session", "turn", "asked", "text", "pos", T.is_requirement(F.lower("clause")).alias("required"), *[v.alias(k) for k, v in T.slots(c("clause")).items()])


add("slot_extract", lambda spark, d: slot_rows(spark).drop("asked", "text", "required"), f"SELECT session, turn, pos, size, budget, color, color_negated, material, material_negated, category, category_negated FROM ({EXTRACT})")
replaced = "text"
for old, new in V.PARAPHRASES:
    replaced = f"replace({replaced}, {q(old)}, {q(new)})"
add("paraphrase", over(MESSAGES, "session", "turn", lambda: T.paraphrase(c("text")).alias("text")), f"SELECT session, turn, {replaced} AS text FROM {M}")
fraction = lambda key: f"CAST('0x' || substr(md5('2026:' || {key}), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE)"
add("stable_split", lambda spark, d: spark.read.parquet(f"{d}/part.parquet").select("p_partkey", (T.hash_fraction(c("p_partkey").cast("string")) < 0.1).alias("validation")), f"SELECT p_partkey, {fraction('p_partkey')} < 0.1 AS validation FROM part")
add("scenario_mix", lambda spark, d: spark.read.parquet(f"{d}/part.parquet").groupBy(T.scenario(T.hash_fraction(c("p_partkey").cast("string"))).alias("scenario")).agg(F.count("*").alias("n")),
    f"SELECT CASE WHEN f < 0.4 THEN 'buying' WHEN f < 0.8 THEN 'browsing' WHEN f < 0.95 THEN 'intent_override' ELSE 'boundary' END AS scenario, count(*) AS n FROM (SELECT {fraction('p_partkey')} AS f FROM part) GROUP BY 1")
add("route_rules", over(MESSAGES, "session", "turn", lambda: T.rule_mode(c("text")).alias("mode")), f"SELECT session, turn, CASE WHEN regexp_matches(text, {q('(?i)' + V.OVERRIDE)}) THEN 'intent_override' WHEN regexp_matches(text, {q('(?i)' + V.NO_PREFERENCE)}) THEN 'boundary' END AS mode FROM {M}")
TOLD = f"regexp_extract(text, {q('(?i)' + V.DISCLOSURE)}, 1)"
MARKS = "list_sort(list_distinct(list_concat(" + ", ".join(f"CASE WHEN regexp_matches(text, {q('(?i)' + r)}) THEN ['{n}'] ELSE [] END" for n, r in (("material", V.MATERIAL_RX), ("color", V.COLOR_RX), ("budget", V.BUDGET_RX))) + f", CASE WHEN {TOLD} <> '' THEN list_transform(string_split({TOLD}, ';'), lambda x: {classify_rx_sql('x')}) ELSE [] END)))"
add("mark_attributes", over(MESSAGES, "session", "turn", lambda: F.array_join(T.mark_attributes(c("text")), ",").alias("marked")), f"SELECT session, turn, array_to_string({MARKS}, ',') AS marked FROM {M}")
BARE = "trim(regexp_replace(trim(lower(feature)), '^for that,\\s*what matters is:\\s*', ''), ' .')"
HAY = "lower(features || ' ' || details || ' ' || description)"
add("phrase_match", over(CANDIDATES, "query", "id", lambda: T.phrase_match(F.lower(F.concat_ws(" ", "features", "details", "description")), c("feature")).alias("matched")),
    f"SELECT query, id, coalesce(len(list_filter(list_transform(string_split({BARE}, ';'), lambda p: trim(p, ' .')), lambda p: p <> '' AND regexp_matches({HAY}, '\\b' || regexp_escape(p) || '\\b'))) > 0, false) AS matched FROM {CANDIDATES.sql()}")
