"""Small literal tables, the same for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Fixture:
    def __init__(self, schema: str, rows: list[tuple]) -> None:
        self.schema, self.rows = schema, rows
        self.names = [c.strip().split(" ")[0] for c in _split(schema)]
        self.kinds = [c.strip().split(" ", 1)[1] for c in _split(schema)]

    def spark(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    def sql(self) -> str:
        """A parenthesised SELECT."""
        rows = ", ".join("(" + ", ".join(_literal(v, k) for v, k in zip(r, self.kinds, strict=True)) + ")" for r in self.rows)
        return f"(SELECT * FROM (VALUES {rows}) t({', '.join(self.names)}))"


_KINDS = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def _split(schema: str) -> list[str]:
    out, depth, at = [], 0, 0
    for k, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[at:k])
            at = k + 1
    return [*out, schema[at:]]


def _kind(kind: str) -> str:
    if kind.startswith("array<struct<"):
        return "STRUCT(key VARCHAR, value VARCHAR)[]"
    return f"{_kind(kind[6:-1])}[]" if kind.startswith("array<") else _KINDS[kind]


def _literal(v, kind: str) -> str:
    if v is None:
        text = "NULL"
    elif kind.startswith("array<struct<"):
        text = "[" + ", ".join(f"{{'key': {_plain(k)}, 'value': {_plain(x)}}}" for k, x in v) + "]"
    elif kind.startswith("array<"):
        text = "[" + ", ".join(map(_plain, v)) + "]"
    else:
        text = _plain(v)
    return f"CAST({text} AS {_kind(kind)})"


def _plain(v) -> str:
    if v is None:
        return "NULL"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


MESSAGES = Fixture("session string, turn int, asked string, text string", [
    ("m1", 1, None, "It must be leather, black color"), ("m1", 2, "feature", "actually not black anymore"), ("m1", 3, "style", "casual and must be cotton"),
    ("m2", 1, None, "I don't want it in black and white is fine"), ("m2", 2, "material", "no thank you very much red"), ("m2", 3, "color", "I need shoes under $1,299"),
    ("m3", 1, None, "budget around $29.99"), ("m3", 2, "size", "tailored earring with mustard"), ("m3", 3, "style", "For that, what matters is: cotton; slim fit; around $40."),
    ("m4", 1, None, "I'm looking for running shoes, but I'm still exploring. Anything goes!"), ("m4", 2, "color", "I don't have an additional preference for color."),
    ("m4", 3, "feature", "Actually, ignore my earlier preference. What I need is: wool."), ("m4", 4, "brand", "I don't have an additional preference for brand."),
    ("m5", 1, None, ""), ("m5", 2, "material", "size 10.5 and silk dress; required"), ("m5", 3, "size", "not suede, blue jacket"),
    ("m6", 1, None, "Those options are not quite right yet. Ask me about one specific attribute."), ("m6", 2, "use_case", "hiking in the winter; A key requirement is: warm and waterproof; wide fit"),
])
PRODUCTS = Fixture("id string, title string, features array<string>, description string, price string, categories array<string>, details array<struct<key:string,value:string>>, store string", [
    ("p1", "Red  Leather Boot", ["Waterproof leather", "Slim fit", "", None], " -A warm, durable boot. ", "49.99", ["Clothing, Shoes & Jewelry", "Men", "Boots"], [("Size", "10, 11; 12/13/14"), ("Department", "Mens")], "Acme Co"),
    ("p2", "Grey cotton shirt", ["Casual long sleeve", "Breathable"], None, "$25", ["Clothing", "Shirts"], [("Fit type", "Regular Fit"), ("Care", None)], None),
    ("p3", "Gray scarf", ["gray and blue"], "For winter travel", "nan", ["Clothing"], [], ""),
    ("p4", "Navy running shorts", [], "Quick dry, moisture wicking", "-3", ["Sports, Running"], [("Material", "Polyester")], "RunFast"),
    ("p5", "Plain thing", None, None, "0", None, None, " - "),
    ("p6", "Purple   silk gown", ["formal classic", "hand made", "soft", "long", "fifth"], "A wedding gown", "120", ["Women", "Dresses, Formal"], [("Width", "wide")], "Silk House"),
    ("p7", "Orange mug", ["for work"], "ceramic", None, ["Home"], [("Color", "orange"), ("a", "b"), ("c", "d"), ("e", "f"), ("g", "h")], "Mugs"),
])
RANKED = Fixture("query string, id string, bm25_rank int, cos_rank int", [
    ("q1", "a", 1, 2), ("q1", "b", 2, None), ("q1", "c", None, 1), ("q1", "d", 3, 3), ("q2", "a", 1, None), ("q2", "b", None, 1), ("q2", "c", None, 2), ("q3", "z", 2, 2), ("q3", "y", 1, 1),
])
OUTCOMES = Fixture("sample string, scenario string, fold int, hit_turn int, best_rank int, prompt_tokens long, completion_tokens long", [
    ("s1", "buying", 0, 1, 1, 5, 3), ("s2", "buying", 1, 3, 10, None, 2), ("s3", "buying", 2, None, None, -4, 1), ("s4", "browsing", 0, 2, 3, 7, 7), ("s5", "browsing", 1, 10, 2, 0, 0),
    ("s6", "boundary", 2, None, None, 1, 1), ("s7", "intent_override", 0, 4, 1, 2, 2), ("s8", "intent_override", 1, None, None, 3, -1),
])
CANDIDATES = Fixture("query string, id string, score double, title string, features string, details string, description string, store string, price double, color string, material string, brand string, feature string, style string, use_case string, size string, budget int, hard array<string>", [
    ("c1", "a", -9.0, "red boot", "leather sole", "", "durable", "acme", 40.0, "red", "leather", "acme", None, None, None, "10", 50, ["color", "budget"]),
    ("c1", "b", -8.0, "blue boot", "cotton", "size 10", "red lace", "acme", 60.0, "red", "leather", "acme", None, None, None, "10", 50, ["color", "budget"]),
    ("c1", "c", -5.0, "green boot", "leather", "", "", "other", None, "red", "leather", "acme", None, None, None, "10", 50, ["color", "budget"]),
    ("c2", "a", -2.0, "hat", "warm", "", "", "x", 10.0, None, None, None, "For that, what matters is: warm; soft.", None, None, None, None, []),
    ("c2", "b", -2.0, "cap", "soft lining", "", "", "x", 10.0, None, None, None, "For that, what matters is: warm; soft.", None, None, None, None, []),
    ("c3", "a", -1.0, "one", "", "", "", "", 1.0, None, None, None, None, None, None, None, None, []), ("c3", "b", -3.0, "two", "", "", "", "", 1.0, None, None, None, None, None, None, None, None, []),
    ("c4", "a", -4.0, "casual hiking shirt", "", "", "", "", 30.0, None, None, None, None, "casual", "hiking", None, 30, ["use_case"]),
])
PREDICTIONS = Fixture("id int, p double, y int", [(1, 0.9, 1), (2, 0.8, 1), (3, 0.8, 0), (4, 0.6, 1), (5, 0.55, 0), (6, 0.4, 0), (7, 0.4, 1), (8, 0.1, 0)])
POOL = Fixture("query string, rank int, attribute string, value string, known boolean, tags array<string>", [
    ("u1", 0, "color", "red", False, ["Style", "fit"]), ("u1", 0, "material", "wool", False, ["Style", "fit"]), ("u1", 0, "material", "silk", False, ["Style", "fit"]), ("u1", 1, "color", "blue", False, ["Style", "fit"]),
    ("u1", 2, "color", "red", False, ["Style", "fit"]), ("u1", 3, "size", "10", False, ["Style", "fit"]), ("u1", 4, "brand", "acme", True, ["Style", "fit"]), ("u1", 5, None, None, False, ["Style", "fit"]),
    ("u2", 0, "feature", "warm", False, []), ("u2", 1, "feature", "warm", False, []), ("u2", 2, "style", "casual", False, []), ("u2", 2, "style", "formal", False, []),
])
