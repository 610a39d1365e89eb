"""URL filter: rules first, then gradient-boosted trees on lexical features. DataFrame functions only."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import saved, table

#: (rule, verdict): a host, then the start of a path.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: At most so many labelled rows are fitted, those of the smallest hashes.
TRAIN_ROWS = 20_000
TREES, DEPTH = 12, 3
#: Folds of hosts. A labelled row's suffix statistics leave out its own fold, so that no label is seen in its own features.
FOLDS = 5
FEATURES = ("f_length", "f_depth", "f_digits", "f_entropy", "f_params", "f_host", "f_hyphens", "f_suffix_share", "f_suffix_block")


def assembled(df: DataFrame) -> DataFrame:
    """df with FEATURES as one vector."""
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(df)


def split_url(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.regexp_extract(url, PARTS, 2)


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _features(df: DataFrame) -> DataFrame:
    url = F.coalesce("url", F.lit(""))
    n = F.length(url)
    count = lambda c, text=url: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    share = lambda c: (n - F.length(F.replace(url, c, F.lit("")))) / n
    entropy = F.aggregate(F.array_distinct(F.split(url, "")), F.lit(0.0), lambda acc, c: acc + F.when((c != "") & (n > 0), -share(c) * F.log2(share(c))).otherwise(F.lit(0.0)))
    return df.withColumns({
        "f_length": n.cast("double"), "f_depth": count("/", F.col("path")).cast("double"),
        "f_digits": F.when(n > 0, F.length(F.regexp_replace(url, "[^0-9]", "")) / n).otherwise(F.lit(0.0)), "f_entropy": entropy,
        "f_params": (count("=") + count("&") + count("?")).cast("double"), "f_host": F.length("host").cast("double"), "f_hyphens": count("-", F.col("host")).cast("double"),
    })


def _judged_by_rules(pages: DataFrame, rules) -> DataFrame:
    """page_id, url, host, path, rule, label (the rule's verdict), suffix, fold."""
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", F.col("url").cast("string")).withColumns({"host": host, "path": path})
    rule, label = rule_of(F.col("host"), F.col("path"), rules)
    return rows.withColumns({"rule": rule, "label": label, "suffix": F.regexp_extract("host", r"([^.]*)$", 1), "fold": F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int")})


def suffix_counts(rows: DataFrame) -> DataFrame:
    """suffix, n (rows), labelled and blocked (arrays: a count for each fold)."""
    by = lambda test: F.array(*[F.count(F.when((F.col("fold") == k) & test, 1)) for k in range(FOLDS)])
    return rows.groupBy("suffix").agg(F.count("*").alias("n"), by(F.col("label").isNotNull()).alias("labelled"), by(F.col("label") == "block").alias("blocked"))


def with_features(rows: DataFrame, stats: DataFrame, total: int, rate: float, left_out: tuple[int, ...] = ()) -> DataFrame:
    """rows with FEATURES. The share of blocked URLs of a suffix is over the labelled rows of other folds than the row's, if it is
    labelled, and never over those of the folds left out; a suffix without any has the share of all, `rate`."""
    whole = lambda name: F.aggregate(F.transform(name, lambda x, k: F.when(k.isin(*left_out), 0).otherwise(x) if left_out else x), F.lit(0).cast("long"), lambda a, x: a + x)
    own = lambda name: F.when(F.col("label").isNotNull() & ~F.col("fold").isin(*left_out, -1), F.col(name)[F.col("fold")]).otherwise(F.lit(0))
    seen = lambda name: whole(name) - own(name)
    full = rows.join(stats, "suffix", "left").withColumns({"f_suffix_share": F.log2(F.col("n") / F.lit(float(max(total, 1)))), "f_suffix_block": (seen("blocked") + F.lit(2.0 * rate)) / (seen("labelled") + 2)})
    return _features(full.drop("n", "labelled", "blocked"))


def fit(full: DataFrame, train_rows: int):
    """The trees' model of at most `train_rows` labelled rows, those of the smallest hashes of the URL; None if they have one verdict only."""
    sample = full.where("label is not null").select(*FEATURES, (F.col("label") == "block").cast("double").alias("target"), F.xxhash64("url", "page_id").alias("order")).orderBy("order", *FEATURES).limit(train_rows)
    train, _ = saved(sample, "urls")
    if train.agg(F.countDistinct("target")).first()[0] < 2:
        return None
    return GBTClassifier(labelCol="target", maxIter=TREES, maxDepth=DEPTH, seed=7).fit(assembled(train).select("features", "target"))


def filter_urls(pages: DataFrame, rules=RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score of every row.

    A rule decides the URLs that it fits, the longest first. They are also the labelled URLs: trees are fitted on at
    most `train_rows` of them (those of the smallest hashes of the URL) and decide the rest, block at a score of 0.5
    or more. If the labelled rows are of one verdict, the rest gets that; without any, allow.

    Suffix statistics (how common the last label of the host is, and how often rules block it) are counted over all
    rows; a labelled row's are of other hosts' folds than its own. They are a table of one row a suffix, joined; Spark broadcasts it below its threshold. A null URL,
    or one without "://", has empty host and path and is judged like any other, and a null or repeated page_id is kept as it is. Repeated rows each give a
    row; other columns are not read; no rows: no rows.
    """
    rows = _judged_by_rules(pages, rules)
    stats, _ = saved(suffix_counts(rows), "suffixes")
    sum_ = lambda name: F.sum(F.aggregate(name, F.lit(0).cast("long"), lambda a, x: a + x))
    total, known, bad = stats.agg(F.sum("n"), sum_("labelled"), sum_("blocked")).first()
    kept = ("page_id", "host", "path", "rule")
    if not known or bad in (0, known):
        only = "block" if known and bad else "allow"
        return rows.select(*kept, F.coalesce("label", F.lit(only)).alias("verdict"), F.lit(None).cast("double").alias("block_score"))
    full = with_features(rows, stats, total, bad / known)
    model = fit(full, train_rows)
    if model is None:  # the bound left one verdict
        score = F.lit(float(bad) / float(known))
        return full.select(*kept, F.coalesce("label", F.when(score >= 0.5, "block").otherwise("allow")).alias("verdict"), score.alias("block_score"))
    score = vector_to_array("probability")[1]
    judged = model.transform(assembled(full)).select(*kept, "label", score.alias("block_score"))
    verdict = F.coalesce("label", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return judged.select(*kept, verdict.alias("verdict"), "block_score")


def held_out_quality(pages: DataFrame, rules=RULES, train_rows: int = TRAIN_ROWS, fold: int = 0) -> tuple[float, dict[str, float]]:
    """Area under the ROC curve of the trees on labelled URLs of one fold's hosts, and the weights of the features, after fitting on other hosts."""
    rows = _judged_by_rules(pages, rules)
    stats, _ = saved(suffix_counts(rows), "suffixes")
    rate = rows.where((F.col("fold") != fold) & F.col("label").isNotNull()).agg(F.avg((F.col("label") == "block").cast("double"))).first()[0]
    full = with_features(rows, stats, stats.agg(F.sum("n")).first()[0], rate, (fold,))
    model = fit(full.where(F.col("fold") != fold), train_rows)
    judged = model.transform(assembled(full.where((F.col("fold") == fold) & F.col("label").isNotNull()))).withColumn("target", (F.col("label") == "block").cast("double"))
    return BinaryClassificationEvaluator(labelCol="target").evaluate(judged), dict(zip(FEATURES, model.featureImportances.toArray().tolist(), strict=True))


def op5_urls(spark, sf_dir: str) -> DataFrame:
    """Rules' and trees' verdicts on all pages; see filter_urls()."""
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
