"""Column functions: cleaning, serialising, tokenising and classifying text."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import vocabulary as V



def fold_table() -> tuple[str, str]:
    """Lower-case letters that are one letter and marks, and that letter, of Latin, Greek and Cyrillic script; by Unicode's decompositions."""
    pairs = []
    for c in map(chr, [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]):
        plain = [x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x)]
        if c == c.lower() and len(plain) == 1 and plain[0] != c and plain[0].isalpha():
            pairs.append((c, plain[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = fold_table()
STRIP = " -;,."
EDGE = "(^|[^a-z0-9])"


def text_array(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def squeeze(x: Column, limit: int, strip: str = STRIP) -> Column:
    """White space as single spaces, `strip` off both ends, then at most `limit` characters; null is empty."""
    return F.rtrim(F.substring(F.btrim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "), F.lit(strip)), 1, limit))


def list_text(x: Column) -> Column:
    """Elements that aren't null or empty, joined by semicolons."""
    return F.array_join(F.filter(F.coalesce(x, F.array().cast("array<string>")), lambda e: e.isNotNull() & (e != "")), "; ")


def pairs(x: Column) -> Column:
    """`key: value` of the entries (array of key, value) that have a value, in their order."""
    return F.transform(F.filter(F.coalesce(x, F.array().cast("array<struct<key:string,value:string>>")), lambda e: e["value"].isNotNull() & (e["value"] != "")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))


def index_list(x: Column) -> Column:
    """Elements as they are, null as None, joined by spaces; null is empty."""
    return F.coalesce(F.array_join(x, " ", "None"), F.lit(""))


def index_pairs(x: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(x, lambda e: F.concat(e["key"], F.lit(" "), F.coalesce(e["value"], F.lit("None")))), " "), F.lit(""))


def product_text(features: int = 700, details: int = 450, description: int = 600, limit: int = 1800, trimmed: bool = False) -> Column:
    """`name: value` sections of a product joined by bars; empty sections are left out. The dense variant has the
    limits 800, 600 and 800 and trims its end."""
    sections = (
        ("title", squeeze(F.col("title"), 400)), ("category", squeeze(list_text(F.col("categories")), 300)), ("brand", squeeze(F.col("store"), 120)),
        ("features", squeeze(list_text(F.col("features")), features)), ("details", squeeze(F.array_join(pairs(F.col("details")), "; "), details)),
        ("description", squeeze(F.col("description"), description)),
    )
    named = [F.when(value != "", F.concat(F.lit(f"{name}: "), value)) for name, value in sections]
    price = F.when(F.coalesce("price", F.lit("")) != "", F.concat(F.lit("price: $"), F.col("price")))
    out = F.substring(F.concat_ws(" | ", *named, price), 1, limit)
    return F.rtrim(out) if trimmed else out


def searchable_text() -> Column:
    return F.btrim(F.concat_ws(" ", "title", F.array_join("features", " ", "None"), F.array_join(F.transform("details", lambda e: F.concat(e["key"], F.lit(" "), F.coalesce(e["value"], F.lit("None")))), " "), "description", F.array_join("categories", " ", "None"), "store"))


def numeric_price(x: Column) -> Column:
    """A finite number of 0 or more, else null."""
    value = x.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")) & (value >= 0), value)


def budget_bucket(x: Column) -> Column:
    """NaN is in the top bucket and negative numbers in the lowest; no number: null."""
    value = x.try_cast("double")
    return F.when(value < 25, "under $25").when(value < 50, "$25–$50").when(value < 100, "$50–$100").when(value.isNotNull(), "$100 or more")


def query_terms(x: Column) -> Column:
    """ASCII words of two letters or more without stopwords, repeats kept."""
    found = F.transform(F.regexp_extract_all(x, F.lit("([A-Za-z0-9]+)"), 1), F.lower)
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*V.STOPWORDS))


def first_terms(x: Column, limit: int = V.MAX_TERMS) -> Column:
    """Distinct terms in order of appearance, the first `limit`."""
    return F.slice(F.array_distinct(query_terms(x)), 1, limit)


def folded(x: Column) -> Column:
    """Lower case without accents, whether they are part of a letter or marks that follow it."""
    return F.regexp_replace(F.translate(F.lower(x), ACCENTED, PLAIN), r"[\u0300-\u036f]", "")


def index_tokens(x: Column) -> Column:
    """Words of letters and digits, folded to lower case without accents."""
    return F.regexp_extract_all(folded(x), F.lit(r"([\p{L}\p{N}]+)"), 1)


def has_word(x: Column, word: str) -> Column:
    return x.rlike(rf"\b{_quoted(word)}\b")


def _quoted(word: str) -> str:
    return "".join(c if c.isalnum() or c in " _'" else f"\\{c}" for c in word)


def matched_terms(x: Column, terms) -> Column:
    """Those of `terms` that occur as whole words, in the order of the list."""
    return F.filter(F.array(*[F.when(has_word(F.lower(x), t), F.lit(t)) for t in terms]), lambda t: t.isNotNull())


def any_of(x: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [x.contains(w) for w in words])


def classify_pattern(x: Column) -> Column:
    """The slot of a constraint, by patterns."""
    low = F.lower(x)
    rules = (("budget", V.BUDGET_RX), ("material", V.MATERIAL_RX), ("color", V.COLOR_RX), ("size", V.SIZE_RX), ("style", V.STYLE_RX), ("use_case", V.USE_CASE_RX))
    out = F.lit("feature")
    for name, rx in reversed(rules):
        out = F.when(low.rlike(rx), name).otherwise(out)
    return out


def classify_words(x: Column) -> Column:
    """The slot of a constraint, by words that it contains (parts of words count)."""
    low = F.lower(x)
    out = F.lit("feature")
    for name, words in reversed(V.REPLY_WORDS):
        out = F.when(any_of(low, words), name).otherwise(out)
    return F.when(low.contains("budget") | low.rlike(r"(?:\$|<=|under)\s*\d"), "budget").otherwise(out)


def coarse_category(x: Column) -> Column:
    """The last two parts of the categories that aren't generic, categories being split at commas."""
    parts = F.transform(F.flatten(F.transform(x, lambda c: F.split(c, ","))), lambda p: F.btrim(p))
    useful = F.filter(parts, lambda p: (p != "") & ~F.lower(p).isin(*V.GENERIC_CATEGORIES))
    return _last_two(useful)


def _last_two(useful: Column) -> Column:
    return F.when(F.size(useful) > 0, F.array_join(F.slice(useful, F.greatest(F.size(useful) - 1, F.lit(1)), F.lit(2)), " ")).otherwise(V.NO_CATEGORY)


def _useful_categories(x: Column) -> Column:
    return F.filter(F.transform(F.coalesce(x, F.array().cast("array<string>")), lambda c: squeeze(c, 100)), lambda c: (c != "") & ~F.lower(c).isin(*V.GENERIC_CATEGORIES))


def leaf_category(x: Column) -> Column:
    useful = _useful_categories(x)
    return F.when(F.size(useful) > 0, F.element_at(useful, -1)).otherwise(V.NO_CATEGORY)


def category_phrase(x: Column) -> Column:
    return F.lower(_last_two(_useful_categories(x)))


def opening_category(x: Column) -> Column:
    first = F.split(x, r"(?<=[.!?])\s+", 2)[0]
    return F.split(first, r"(?i)[,;]\s*(?:but\b|i am\b|i'm\b)", 2)[0]


def compose_query(turns: Column, tags: Column, summary: Column, limit: int = 1400) -> Column:
    """Profile, then numbered turns; blank turns don't count, and the last characters are kept."""
    said = F.filter(F.transform(turns, lambda t: squeeze(t, 500)), lambda t: t != "")
    dialogue = F.array_join(F.transform(said, lambda t, i: F.concat(F.lit("turn "), (i + 1).cast("string"), F.lit(": "), t)), " ")
    part = lambda name, v: F.when(v != "", F.concat(F.lit(f"{name}: "), v))
    return F.ltrim(F.right(F.concat_ws(" | ", part("preference tags", squeeze(list_text(tags), 180)), part("profile", squeeze(summary, 260)), dialogue), F.lit(limit)))


def clauses(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, r",|\band\b"), lambda c: F.btrim(c)), lambda c: c != "")


def is_negated(x: Column, word: Column) -> Column:
    """A negation before the word, with three words between at most."""
    head = r"\b(" + "|".join(_quoted(n) for n in V.NEGATIONS) + r")\b(?:\s+\w+){0,3}\s+"
    return F.regexp_like(x, F.concat(F.lit(head), word, F.lit(r"\b")))


def is_requirement(x: Column) -> Column:
    return x.rlike(r"\b(?:" + "|".join(_quoted(t) for t in V.TRIGGERS) + r")\b")


def earliest(x: Column, options) -> Column:
    """The option that occurs first, as a part of words too."""
    found = F.transform(text_array(options), lambda o: F.struct(F.instr(x, o).alias("at"), o.alias("option")))
    return F.array_min(F.filter(found, lambda s: s["at"] > 0))["option"]


def slots(clause: Column) -> dict[str, Column]:
    """What a clause sets: size, budget, color, material, category; and x_negated for the last three."""
    low = F.lower(clause)
    some = lambda rx: F.when(low.rlike(rx), F.regexp_extract(low, rx, 1))
    out = {"size": some(r"size\s*(\d+(\.\d+)?)"), "budget": some(r"(?:\$|under|below|budget)\s*\$?(\d+)")}
    for name, options in (("color", V.COLORS), ("material", V.MATERIALS), ("category", V.CATEGORIES)):
        word = earliest(low, options)
        out[name] = word
        out[f"{name}_negated"] = F.coalesce(is_negated(low, word), F.lit(False))
    return out


def paraphrase(x: Column) -> Column:
    for old, new in V.PARAPHRASES:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def hash_fraction(key: Column, seed: int = 2026) -> Column:
    """A number in [0, 1) from md5 of seed and key, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def scenario(fraction: Column) -> Column:
    out = F.lit(V.SCENARIO_CUTS[-1][0])
    for name, cut in reversed(V.SCENARIO_CUTS[:-1]):
        out = F.when(fraction < cut, name).otherwise(out)
    return out


def phrase_match(text: Column, value: Column) -> Column:
    """Whether a phrase of the value (parts between semicolons, the reply's lead left out) is in the text as whole words."""
    bare = F.btrim(F.regexp_replace(F.btrim(F.lower(value)), V.REPLY_LEAD, ""), F.lit(" ."))
    phrases = F.filter(F.transform(F.split(bare, ";"), lambda p: F.btrim(p, F.lit(" ."))), lambda p: p != "")
    return F.coalesce(F.exists(phrases, lambda p: F.regexp_like(text, F.concat(F.lit(r"\b\Q"), p, F.lit(r"\E\b")))), F.lit(False))


def mark_attributes(x: Column) -> Column:
    """Attributes that a message gives away: material, color and budget by their words, others by disclosed constraints."""
    ignore = lambda rx: x.rlike(f"(?i){rx}")
    named = F.array(*[F.when(ignore(rx), F.lit(n)) for n, rx in (("material", V.MATERIAL_RX), ("color", V.COLOR_RX), ("budget", V.BUDGET_RX))])
    told = F.regexp_extract(x, f"(?i){V.DISCLOSURE}", 1)
    parts = F.when(told != "", F.transform(F.split(told, ";"), classify_pattern)).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.filter(F.concat(named, parts), lambda a: a.isNotNull())))


def rule_mode(x: Column) -> Column:
    """The mode that wording alone decides; an override wins; else null."""
    return F.when(x.rlike(f"(?i){V.OVERRIDE}"), "intent_override").when(x.rlike(f"(?i){V.NO_PREFERENCE}"), "boundary")
