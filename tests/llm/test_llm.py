"""Operators for training data: hard cases, brute force, round trips."""

import hashlib
import json
import unicodedata
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import ann, chat, decontaminate, langid, mixing, near_copies, passages, queries, simhash, tokens, urls, warc
from tessera.llm.components import connected_components
from tessera.llm.scratch import marked, new_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, copy string, rank int"
WORDS = [f"w{k}x{k * k % 97}" for k in range(400)]
LONG = " ".join(WORDS[:120])


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", 1) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, a null doc_id, repeated rows, a very long text, columns with clashing names."""
    return documents(spark, [(1, None), (2, ""), (3, " \n\t"), (4, LONG), (4, LONG), (None, LONG), (5, LONG.upper()), (6, "word " * 60_000), (7, "1 2 3 !"), (8, "x" * 100_000), (9, "ſé\U0001f600 ok")])


OPERATORS = {
    "op1": lambda d: decontaminate.find_leaks(d, d.where("doc_id < 6 or doc_id is null").select(F.col("doc_id").alias("item_id"), "text")),
    "op3": passages.repeated_passages,
    "op6": tokens.token_counts,
    "op8": simhash.near_duplicates,
    "op9": mixing.mix,
    "op10": lambda d: langid.predict(d, langid.learn(d)),
    "near": near_copies.one_of_each,
    "cut": lambda d: passages.without_passages(d, passages.repeated_passages(d)),
    "clean": lambda d: decontaminate.drop_leaked(d, d.select(F.lit(1).alias("item_id"), F.lit("nothing like this at all").alias("text"))),
    "language": lambda d: langid.keep_identified(d, langid.learn(d)),
}
IDS = [None, 1, 2, 3, 4, 4, 5, 6, 7, 8, 9]


def ids_of(rows):
    return sorted((r.doc_id for r in rows), key=lambda i: -1 if i is None else i)


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_and_empty_tables(odd, name):
    rows = OPERATORS[name](odd).collect()
    if name == "op1":  # the long text and its copies hold the item, the two rows of 4 are one item
        got = {(r.doc_id, r.item_id) for r in rows}
        assert {(i, j) for i in (4, 5, None) for j in (4, 5, None)} == got
        assert sum((r.doc_id, r.item_id) == (4, 4) for r in rows) == 2
    elif name == "op3":  # 5 repeats 4; one without doc_id, and a document's own repeats, take no part
        assert [(r.doc_id, r.word_start, r.word_end, r.kept_doc_id) for r in rows] == [(5, 0, 120, 4)]
    elif name == "op6":
        assert {r.doc_id for r in rows} == set(IDS) and all(r.n_tokens == 0 for r in rows if r.doc_id in (1, 2))
    elif name == "op8":
        assert ids_of(rows) == IDS
        by = {r.doc_id: r for r in rows}
        assert by[1].fingerprint == by[3].fingerprint == "0" * 16 and [by[k].component_id for k in (1, 2, 3)] == [1] * 3
        assert [by[k].component_id for k in (4, 5, None)] == [4] * 3
    elif name == "op9":
        assert {r.doc_id for r in rows} <= set(IDS) and len({(r.doc_id, r.copy, r.text) for r in rows}) + sum(r.doc_id == 4 for r in rows) // 2 == len(rows)
    elif name == "op10":
        assert ids_of(rows) == IDS and {r.doc_id for r in rows if r.lang_pred == "und"} == {1, 2, 3, 7} and all(0 <= r.score <= 1 for r in rows)
    elif name == "near":  # texts without words are one group
        assert ids_of(rows) == [None, 1, 4, 6, 7, 8, 9]
    elif name == "cut":
        assert ids_of(rows) == [i for i in IDS if i != 5] and {r.doc_id: r.text for r in rows}[4] == LONG
    elif name == "clean":
        assert ids_of(rows) == IDS
    elif name == "language":
        assert ids_of(rows) == [i for i in IDS if i not in (1, 2, 3, 7)]
    assert OPERATORS[name](odd.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["op9", "near", "cut", "clean", "language"])
def test_columns_of_any_name_are_kept(spark, name):
    names = ["rate", "cdf", "parts", "mix_source", "mix_count", "row", "name", "kept", "kept_id", "kept_text", "text_hash", "cuts", "owner", "passage_cuts", "passage_doc", "a.b"]
    docs = documents(spark, [(1, LONG), (2, LONG), (3, "other words")])
    docs = docs.select("*", *[F.lit(f"of {n}").alias(n) for n in names])
    rows = OPERATORS[name](docs).collect()
    assert rows and all(r[n] == f"of {n}" for r in rows for n in names)


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (101, 100), (None, 3)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {k: 1 for k in range(2, 41)} | {k: 100 for k in range(101, 160)}


def brute_simhash(text):
    w = text.encode().lower().split()
    s = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = queries.QUERIES["op8_simhash"](spark, sf_dir).collect()
    prints = {r.doc_id: brute_simhash(r.text) for r in docs.collect()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == prints
    assert {r.doc_id: r.component_id for r in rows} == components_of(prints)


def components_of(prints):
    label = dict(zip(prints, prints, strict=True))
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_simhash_links_by_rows_without_id(spark):
    texts = {}
    base = brute_simhash(LONG)
    # texts of one to three words more, until three fingerprints make a chain whose middle alone holds it together
    for k in range(3000):
        t = " ".join([*WORDS[:120], *(f"q{k}r{j}" for j in range(1 + k % 3))])
        texts[t] = brute_simhash(t)
    near = lambda a, b: (a ^ b).bit_count() <= 2
    ends = [t for t, p in texts.items() if near(p, base)]
    one, two = next((x, y) for x in ends for y in ends if not near(texts[x], texts[y]))
    rows = simhash.near_duplicates(documents(spark, [(5, one), (None, LONG), (9, two)])).collect()
    assert {r.doc_id: r.component_id for r in rows} == {5: 5, None: 5, 9: 5}
    rows = simhash.near_duplicates(documents(spark, [(5, one), (5, two), (7, two), (None, "no such text")])).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in rows) == [("5", 5), ("5", 5), ("7", 5), ("None", None)]


@pytest.mark.parametrize("cell", [1, 64])
def test_hamming_links_hold_groups_together(spark, cell):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 63, 6)]
    points = {b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 63, (20, 2))} | {0, -1}
    links = simhash.hamming_links(spark.createDataFrame([(p,) for p in points], "fingerprint long"), 2, cell)
    got = {p: p for p in points} | dict(connected_components(links.select("a", "b")).collect())
    label = components_of({p: p & (1 << 64) - 1 for p in points})
    assert {frozenset(q for q in points if got[q] == got[p]) for p in points} == {frozenset(q for q in points if label[q] == label[p]) for p in points}


def test_simhash_broadcasts_nothing_that_grows(spark, monkeypatch):
    # files of cells are small and their rows are not, so no size that Spark reads off them may choose a broadcast
    plans, saved = [], simhash.saved

    def noted(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return saved(df, label)

    monkeypatch.setattr(simhash, "saved", noted)
    monkeypatch.setattr("tessera.llm.components.saved", noted)
    rows = simhash.near_duplicates(documents(spark, [(k, " ".join(WORDS[k % 9 :])) for k in range(30)]))
    plans.append(("result", rows._jdf.queryExecution().executedPlan().toString()))
    assert {"cells", "links", "large", "named"} <= {label for label, _ in plans}
    assert [label for label, plan in plans if "Broadcast" in plan] == []


def test_warc_round_trip(spark):
    rows = [(3, "http://a/ b\r\nc", "same"), (1, None, "same"), (2, "http://b", None), (5, "x", ""), (4, "é", "é<p>" * 50_000), (1, None, "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc.write_warc(pages, new_path(spark, "warc"))
    whole = sorted(map(str, warc.read_warc(manifest).collect()))
    assert whole == sorted(map(str, warc.read_warc(manifest, 77).collect()))
    got = {r.page_id: r for r in warc.read_warc(manifest).collect()}
    assert (got[3].record_type, got[3].refers_to, got[1].record_type, got[5].refers_to) == ("revisit", 1, "response", 2)
    assert bytes(got[4].payload).decode() == "é<p>" * 50_000 and got[3].payload_bytes == 4
    assert warc.read_warc(warc.write_warc(pages.limit(0), new_path(spark, "warc"))).collect() == []


def test_decontamination_edits(spark):
    item = "The quick brown fox jumps over the lazy dog while seven wizards brew strong coffee near the old harbour wall."
    texts = {1: f"Intro here. {item.upper()} end", 2: item.replace("lazy", "hazy").replace("seven", "sevn"), 3: item[:50], 4: " ".join(reversed(item.split())), 5: item.replace(" ", "\n--\n")}
    bench = spark.createDataFrame([(10, item), (11, "tiny"), (12, None)], "item_id long, text string")
    for most in (10, 4_000_000):
        got = {r.doc_id: r for r in decontaminate.find_leaks(documents(spark, texts.items()), bench, most=most).collect()}
        assert set(got) == {1, 2, 5} and got[2].edits == 2
        assert texts[1][got[1].start : got[1].end] == item.upper().rstrip(".")
        assert {r.doc_id for r in decontaminate.drop_leaked(documents(spark, texts.items()), bench, most=most).collect()} == {3, 4}


def test_items_do_not_span_documents(spark):
    item = "The quick brown fox jumps over the lazy dog while seven wizards brew strong coffee near the old harbour wall."
    bench = spark.createDataFrame([(10, item)], "item_id long, text string")
    rows = [(0, f"intro text {item[:55]}"), (1, f"{item[55:]} more text"), (2, None), (3, item)]
    for parts in (1, 4):
        docs = documents(spark, rows).repartition(parts)
        assert [(r.doc_id, r.start, r.end, r.edits) for r in decontaminate.find_leaks(docs, bench).collect()] == [(3, 0, len(item) - 1, 0)]
        assert {r.doc_id for r in decontaminate.drop_leaked(docs, bench).collect()} == {0, 1, 2}


def plain(text):
    """Lower-case letters, digits and marks, one space for each run of others."""
    out = []
    for c in text or "":
        low = c.lower() if len(c.lower()) == 1 else c
        if unicodedata.category(c)[0] in "LNM":
            out.append(low)
        elif not out or out[-1] != " ":
            out.append(" ")
    return "".join(out)


def test_decontamination_by_brute_force(spark, sf_dir):
    """Every document against every item: the least edits of the item in any part of the text."""
    docs = [(r.doc_id, plain(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    gap = "\0" * 80  # more edits than any item may have
    whole = np.frombuffer(gap.join(t for _, t in docs).encode("utf-32-le"), np.uint32)
    bounds = np.cumsum([0, *(len(t) + len(gap) for _, t in docs)])
    want = set()
    step = np.arange(len(whole) + 1, dtype=np.int32)
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        item = plain(r.text).strip()
        k = min(int(decontaminate.EDITS * len(item)), len(item) // decontaminate.Q - 1)
        assert decontaminate.Q <= len(item) <= decontaminate.PART_CHARS and k < len(gap)
        row = np.zeros(len(whole) + 1, np.int32)
        for i, c in enumerate(item, 1):
            new = np.empty_like(row)
            new[0] = i
            new[1:] = np.minimum(row[:-1] + (whole != ord(c)), row[1:] + 1)
            row = np.minimum.accumulate(new - step) + step
        ends = np.flatnonzero(row <= k)
        want |= {(docs[n][0], r.item_id) for n in np.unique(np.searchsorted(bounds, np.maximum(ends - 1, 0), "right") - 1).tolist()}
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op1_decontaminate"](spark, sf_dir).collect()}
    assert got == want and want


def test_warc_ranges_are_read_by_many_tasks(spark):
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("http://a/").alias("url"), F.concat(F.col("id").cast("string"), F.repeat(F.md5(F.col("id").cast("string")), 40)).alias("html"))
    manifest = warc.write_warc(pages.repartition(4), new_path(spark, "warc"))
    size = max(r.bytes for r in manifest.collect()) // 15
    rows = warc.read_warc(manifest, size)
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() >= 32 and rows.count() == 400


def test_alignment_by_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(30):
        item = rng.integers(97, 100, 25).astype(np.uint32)
        region = rng.integers(97, 100, 40).astype(np.uint32)
        region[4:29] = item
        region = np.delete(region, rng.integers(5, 25, 2))
        row = [0] * (len(region) + 1)
        for i, x in enumerate(item, 1):
            new = [i]
            for j, y in enumerate(region, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        assert decontaminate.align(item, region, len(region))[0] == min(row)


def test_passages(spark):
    shared = " ".join(f"p{k}q" for k in range(55))
    other = lambda n: " ".join(f"{n}z{k}" for k in range(80))
    rows = [(1, f"{other('a')} {shared}\n{other('b')}"), (2, f"{other('c')}\n{shared.upper()} {other('d')}"), (3, shared), (4, other("e")), (5, f"{other('f')} " + " ".join(shared.split()[:40]))]
    docs = documents(spark, rows)
    spans = passages.repeated_passages(docs)
    assert {(r.doc_id, r.word_start, r.word_end, r.kept_doc_id) for r in spans.collect()} == {(2, 80, 135, 1), (3, 0, 55, 1)}
    left = {r.doc_id: r.text for r in passages.without_passages(docs, spans).collect()}
    assert left == {k: t for k, t in rows if k not in (2, 3)} | {2: f"{other('c')}\n{other('d')}"}


def test_passages_whose_paragraphs_come_first_elsewhere(spark):
    shared = [f"p{k}q" for k in range(60)]
    other = lambda n: [f"{n}z{k}" for k in range(40)]
    rows = [(1, shared[:35] + other("a") + shared[25:]), (2, other("b") + shared), (3, shared + other("c")), (4, ["no"] * 30 + other("d")), (5, ["no"] * 70), (6, ["no"] * 30 + other("e") + ["no"] * 60)]
    spans = passages.repeated_passages(documents(spark, [(k, " ".join(w)) for k, w in rows])).collect()
    assert {(r.doc_id, r.word_start, r.word_end, r.kept_doc_id) for r in spans} == {(3, 0, 60, 2), (6, 70, 130, 5)}


def test_passages_with_edits(spark):
    """One word changed, put in or left out, anywhere in passages of 52-90 words: all have paragraphs of Jaccard 0.8."""
    rng, rows, spans = np.random.default_rng(1), [], {}
    for n in range(120):
        base = [f"n{n}w{k}" for k in range(int(rng.integers(52, 90)))]
        own, at = list(base), int(rng.integers(3, len(base) - 3))
        own[at : at + (n % 3 != 1)] = [f"edit{n}"] if n % 3 < 2 else []
        filler = lambda t, k: [f"{t}{n}x{i}" for i in range(k)]  # noqa: B023, E731
        head = filler("b", int(rng.integers(5, 60)))
        rows += [(2 * n, " ".join([*filler("a", int(rng.integers(5, 60))), *base, *filler("c", 20)])), (2 * n + 1, " ".join([*head, *own, *filler("d", 20)]))]
        spans[2 * n + 1] = (len(head), len(head) + len(own), 2 * n)
    found = passages.repeated_passages(documents(spark, rows)).collect()
    print("passages with an edit found", len({r.doc_id for r in found}), "of", len(spans))
    assert len({r.doc_id for r in found}) >= 0.97 * len(spans)
    for r in found:
        a, b, kept = spans[r.doc_id]
        assert a <= r.word_start and r.word_end <= b and r.kept_doc_id == kept


def test_gap_between_equal_halves_is_kept(spark):
    rows = []
    for n in range(20):
        for k in range(2):
            rows.append((2 * n + k, " ".join([*(f"n{n}a{i}" for i in range(40)), *(f"n{n}s{k}d{i}" for i in range(12)), *(f"n{n}b{i}" for i in range(40))])))
    docs = documents(spark, rows)
    spans = passages.repeated_passages(docs)
    assert spans.collect() == [] and {r.doc_id: r.text for r in passages.without_passages(docs, spans).collect()} == dict(rows)


def test_passages_of_large_families(spark):
    """A very common line, a passage of 30 words that has no paragraph's length, and copies with edits: found, left, and
    no document of its own words is touched."""
    rng = np.random.default_rng(4)
    own = lambda n, k: [f"o{n}w{i}" for i in range(k)]
    line, common = [f"line{i}" for i in range(14)], [f"c{i}" for i in range(30)]
    texts = [own(n, 40) + line + own(n, 60)[40:] for n in range(400)] + [own(1000 + n, 30) + common + own(1000 + n, 60)[30:] for n in range(300)]
    texts = [" ".join(t) for t in texts] + edited_copies(rng, WORDS[:200], 200, 1, 3)
    spans = passages.repeated_passages(documents(spark, list(enumerate(texts)))).collect()
    assert {r.doc_id for r in spans} == set(range(701, 900))


@pytest.mark.parametrize("twice", [False, pytest.param(True, marks=pytest.mark.xfail(reason="of a document's places with one run the first alone is compared", strict=True))])
def test_passages_similar_inside_large_runs(spark, twice):
    """120 texts share a run of 30 words, but only the three of a passage of 52-70 words around it are similar, each with a word
    changed, put in or left out: all but the first of each are found, and nothing beside. Texts that have the run twice are a known limit."""
    rng, rows, spans = np.random.default_rng(11), [], {}
    core = [f"core{k}" for k in range(30)]
    for n in range(40):
        # every other passage has nothing but the common run and 22 words beyond the edit, too few for a key of their own
        left = int(rng.integers(6, 30)) if n % 2 else 0
        base = [f"l{n}w{k}" for k in range(left)] + core + [f"r{n}w{k}" for k in range(int(rng.integers(60, 71)) - 30 - left if n % 2 else 23)]
        for k in range(3):
            own, at = list(base), int(rng.integers(6, len(base) - 6)) if n % 2 else 30
            if k or not n % 2:
                own[at : at + (n % 3 != 1)] = [f"edit{n}k{k}"] if n % 3 < 2 or not n % 2 else []
            head = [f"h{n}k{k}x{i}" for i in range(int(rng.integers(5, 50)))] + (core if twice and n % 5 == 0 else []) + [f"g{n}k{k}x{i}" for i in range(9)]
            rows.append((k * 1000 + n, " ".join([*head, *own, *(f"t{n}k{k}x{i}" for i in range(30))])))
            spans[k * 1000 + n] = (len(head), len(head) + len(own))
    found = passages.repeated_passages(documents(spark, rows)).collect()
    print("similar passages of large runs found", len({r.doc_id for r in found}), "of", 80)
    assert {r.doc_id for r in found} == {k for k in spans if k >= 1000}
    for r in found:
        a, b = spans[r.doc_id]
        assert a <= r.word_start and r.word_end <= b and r.kept_doc_id % 1000 == r.doc_id % 1000 and r.kept_doc_id < r.doc_id


def test_gapped_keys_of_one_text_are_not_dealt_out(spark, monkeypatch):
    kept, marked_ = [], passages.marked
    monkeypatch.setattr(passages, "marked", lambda rows, *a: kept.append((rows, marked_(rows, *a))) or kept[0][1])
    saved = passages.saved
    monkeypatch.setattr(passages, "drop_path", lambda *a: None)
    rows = []
    for n in range(12):  # texts with a common run, of which only 0 and 1 are similar around it
        side = [f"g{max(n, 1)}a{k}" for k in range(80)]
        words = [*side[:35], *WORDS[:25], *side[35:]]
        if n == 1:
            words[60:60] = ["put"]
        rows.append((n, np.array([hash(w) & 0x7FFFFFFF | 1 for w in words], np.uint32)[: passages.LEFT + passages.RIGHT].tobytes()))
    around = spark.createDataFrame([(n, 40, w.ljust(4 * (passages.LEFT + passages.RIGHT), b"\0")) for n, w in rows], "doc_id long, place int, around binary")
    pairs, _ = passages.gapped_pairs(saved(around, "around")[0])
    pairs = {(r.doc_id, r.kept_doc_id) for r in pairs.collect()}
    every, some = (d.select("doc_id", "key").collect() for d in (kept[0][0], kept[0][1].where("shared")))
    owners = {}
    for r in every:
        owners.setdefault(r.key, set()).add(r.doc_id)
    shared = {k for k, v in owners.items() if len(v) > 1}
    assert shared and len(some) < len(every) and {r.key for r in some} >= shared and len(some) <= sum(r.key in shared for r in every) + 0.01 * len(every)
    assert pairs == {(n, min(owners[k])) for k in shared for n in owners[k] if n > min(owners[k])}


def test_keys_of_several_lengths_leave_out_no_pair(spark, monkeypatch):
    """Texts that are similar around a common run, and others that have too few words beyond it in common: pairs are those of all keys, but
    the keys of one length are made only for texts that are similar."""
    rng, rows, made, saved = np.random.default_rng(5), [], [], passages.saved
    for n in range(100):
        if n < 60:
            left, right = [f"g{n // 3}a{k}" for k in range(45)], WORDS[:25] + [f"g{n // 3}b{k}" for k in range(60)]
            if n % 3:
                side, at = (left, int(rng.integers(6, 45))) if n % 2 else (right, int(rng.integers(12, 50)))
                side[at : at + int(rng.integers(0, 2))] = [f"e{n}"] * int(rng.integers(0, 2))
        else:  # 25 words, one of its own and 12 of all
            left, right = [f"o{n}x{k}" for k in range(45)], [*WORDS[40:65], f"o{n}", *WORDS[70:82], *(f"o{n}y{k}" for k in range(60))]
        near = left[-passages.LEFT :] + right[: passages.RIGHT]
        rows.append((n, 39, np.array([zlib.crc32(w.encode()) | 1 for w in near], np.uint32).tobytes()))
    around = saved(spark.createDataFrame(rows, "doc_id long, place int, around binary"), "around")[0]
    monkeypatch.setattr(passages, "saved", lambda df, label: made.append((label, saved(df, label))) or made[-1][1])
    monkeypatch.setattr(passages, "drop_path", lambda *a: None)

    def pairs():
        made.clear()
        found = sorted(map(tuple, passages.gapped_pairs(around)[0].collect()))
        return found, [[r.doc_id for r in df.select("doc_id").collect()] for label, (df, _) in made if label == "gapped"]

    some, tables = pairs()
    assert {n for n in tables[0]} & set(range(60, 100)) and not {n for n in tables[-1]} & set(range(60, 100))
    monkeypatch.setattr(passages, "WIDTHS", (1,))
    every, (all_keys,) = pairs()
    assert len(every) > 20 and some == every and set(all_keys) & set(range(60, 100)) and len(tables[-1]) < len(all_keys)


def test_words_of_texts_without_shared_keys_are_not_kept(spark, monkeypatch):
    sizes, saved = {}, passages.saved

    def measured(df, label):
        out = saved(df, label)
        sizes[label] = sum(f.stat().st_size for f in Path(out[1].removeprefix("file://")).glob("*.parquet"))
        return out

    monkeypatch.setattr(passages, "saved", measured)
    rows = [(n, " ".join(f"o{n}w{k}" for k in range(2000))) for n in range(100)] + [(200, LONG + " a b"), (201, "c d " + LONG)]
    spans = passages.repeated_passages(documents(spark, rows)).collect()
    assert [(r.doc_id, r.word_start, r.word_end, r.kept_doc_id) for r in spans] == [(201, 2, 122, 200)]
    # a word's hash has 4 bytes; keys have 8 for some 7 words
    assert sizes["texts"] < 2 * 100 * 2000 and sizes["open"] < 20_000


def test_documents_without_passages_are_not_dealt_out(spark, monkeypatch):
    joined, map_batches = [], passages.map_batches
    monkeypatch.setattr(passages, "map_batches", lambda df, *a: joined.append(df) or map_batches(df, *a))
    rows = [(n, " ".join(f"o{n}w{k}" for k in range(60))) for n in range(300)] + [(400, LONG + " a b"), (401, "c d " + LONG), (402, None)]
    docs = documents(spark, rows).withColumn("doc_id", F.col("doc_id").cast("int"))
    left = {r.doc_id: r.text for r in passages.without_passages(docs, passages.repeated_passages(docs)).collect()}
    assert left == dict(rows) | {401: "c d "} and joined[0].count() < 10


def test_different_texts_of_one_doc_id(spark):
    other = " ".join(WORDS[150:230])
    docs = documents(spark, [(1, LONG), (2, LONG), (2, other), (3, other)])
    spans = passages.repeated_passages(docs)
    assert {(r.doc_id, r.word_end, r.kept_doc_id) for r in spans.collect()} == {(2, 120, 1), (3, 80, 2)}
    assert sorted((r.doc_id, r.text) for r in passages.without_passages(docs, spans).collect()) == [(1, LONG), (2, other)]


def test_passages_of_templates_with_a_slot(spark):
    rows = []
    for n in range(150):
        for k in range(2):
            slot = [f"n{n}s{k}d{i}" for i in range(12)]
            rows.append((2 * n + k, " ".join([f"n{n}f{k}", *(f"n{n}a{i}" for i in range(25)), *slot, *(f"n{n}b{i}" for i in range(25))])))
    whole = " ".join(f"g{i}" for i in range(90))
    rows += [(1000, whole), (1001, f"before {whole} after")]
    spans = passages.repeated_passages(documents(spark, rows)).collect()
    print("slots cut", sum(r.doc_id < 1000 for r in spans))
    assert {(r.doc_id, r.word_start, r.word_end, r.kept_doc_id) for r in spans} == {(1001, 1, 91, 1000)}


def test_passages_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    covered = {}
    for r in queries.QUERIES["op3_passages"](spark, sf_dir).collect():
        covered.setdefault(r.doc_id, set()).update(range(r.word_start, r.word_end))
    earlier, repeats = set(), 0
    for r in docs:
        w = r.text.encode().lower().split()
        own = {k: tuple(w[k : k + 50]) for k in range(len(w) - 49)}
        for k in (k for k, run in own.items() if run in earlier):
            repeats += 1
            assert covered[r.doc_id].issuperset(range(k, k + 50))
        earlier.update(own.values())
    assert repeats
    # what is taken without being an equal run is in paragraphs that are similar to one of the document kept
    grams = {r.doc_id: r.text.encode().lower().split() for r in docs}
    paragraphs = lambda w: [{tuple(w[j : j + 5]) for j in range(k, k + 46)} for k in range(len(w) - 49)]
    for r in queries.QUERIES["op3_passages"](spark, sf_dir).collect():
        w, kept = grams[r.doc_id], paragraphs(grams[r.kept_doc_id])
        assert r.kept_doc_id < r.doc_id and r.word_end - r.word_start >= 50
        alike = np.zeros(len(w), bool)
        for k in range(max(0, r.word_start - 5), min(len(w) - 50, r.word_end - 45) + 1):
            s = {tuple(w[j : j + 5]) for j in range(k, k + 46)}
            if any(len(s & t) >= 0.8 * len(s | t) for t in kept):
                alike[k : k + 50] = True
        assert alike[r.word_start : r.word_end].all()


def test_near_copies_at_jaccard(spark):
    edited = WORDS[:300]
    edited[150] = "other"
    rows = [(1, " ".join(WORDS[:300])), (2, " ".join(edited)), (3, " ".join(WORDS[:150])), (4, " ".join(reversed(WORDS[:300]))), (5, " ".join(WORDS[:300]).upper())]
    assert {r.doc_id for r in near_copies.one_of_each(documents(spark, rows)).collect()} == {1, 3, 4}


def brute_groups(texts, least=0.8):
    """The first text of each text's group, of all pairs at this Jaccard similarity."""
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    group = list(range(len(sets)))

    def top(k):
        while group[k] != k:
            k = group[k]
        return k

    for x in range(len(sets)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both >= least * (len(sets[x]) + len(sets[y]) - both):
                one, two = sorted((top(x), top(y)))
                group[two] = one
    return [top(k) for k in range(len(sets))]


def grouped(spark, texts):
    """The first text of each text's group, as the operator has it."""
    got = near_copies.copy_groups(documents(spark, list(enumerate(texts)))).collect()
    first = {}
    for r in sorted(got, key=lambda r: r.doc_id):
        first.setdefault(r.group, r.doc_id)
    return [first[r.group] for r in sorted(got, key=lambda r: r.doc_id)]


def edited_copies(rng, words, copies, low, high):
    """Texts of these words, each with from low to high of them changed."""
    out = []
    for n in range(copies):
        own = list(words)
        for k in rng.choice(len(own), rng.integers(low, high + 1), replace=False):
            own[k] = f"e{n}y{k}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("copies", "length", "edits"), [(1000, 200, 4), (400, 260, 6)])
def test_near_copies_of_a_large_family(spark, copies, length, edits):
    texts = edited_copies(np.random.default_rng(5), WORDS[:length], copies, 1, edits)
    want = brute_groups(texts)
    got = grouped(spark, texts)
    print("groups", len(set(got)), "by brute force", len(set(want)))
    assert got == want


def test_near_copies_of_short_texts(spark):
    rng, texts = np.random.default_rng(6), []
    for n in range(300):
        words = [f"s{n}t{k}" for k in range(int(rng.integers(10, 31)))]
        texts += [" ".join(words), " ".join([*words[:-1], "end"]), " ".join([*words, "two", "more"])]
    texts += [f"l{n} " + " ".join(WORDS[:20]) + f" m{n}" for n in range(200)] + [" ".join([*WORDS[:20], *(f"o{n}p{k}" for k in range(20))]) for n in range(200)]
    want = brute_groups(texts)
    got = grouped(spark, texts)
    print("groups", len(set(got)), "by brute force", len(set(want)))
    assert got == want


def test_near_copies_of_long_texts(spark):
    rng, texts = np.random.default_rng(7), []
    for n in range(60):
        words = [f"h{n}j{k}" for k in range(int(rng.integers(400, 1500)))]
        blocks = round(len(words) * (1 / (0.795 + 0.001 * (n % 20)) - 1) / 5)
        own = list(words)
        for k in range(blocks):
            own.insert(int(rng.integers(0, len(own))) if k % 2 else len(own), f"v{n}w{k}")
        texts += [" ".join(words), " ".join(own)]
    want = brute_groups(texts)
    got = grouped(spark, texts)
    print("pairs", 120 - len(set(got)), "by brute force", 120 - len(set(want)), "otherwise", sum(a != b for a, b in zip(got, want, strict=True)))
    assert 0 < 120 - len(set(want)) < 60
    assert got == want


def test_near_copies_meet_by_simhash_of_whole_texts(spark, monkeypatch):
    # without shares and prefixes only fingerprints are left, as in the SimHash operator; the exact check keeps unlike texts apart
    monkeypatch.setattr(near_copies, "text_keys", lambda h, common, similarity: np.zeros(0, np.int64))
    base = [f"z{k}" for k in range(3000)]
    rows = [(1, " ".join(base)), (2, " ".join([*base, "end"])), (3, " ".join(reversed(base))), (4, " ".join(base[:1400]))]
    prints = [near_copies.simhash(iter([h])) for _, h in near_copies.shingle_sets(near_copies.pa.array([t for _, t in rows]), 5)]
    assert (prints[0] ^ prints[1]).bit_count() <= 2 < min((prints[0] ^ p).bit_count() for p in prints[2:])
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, documents(spark, rows), "").collect()} == {1, 3, 4}
    points = [(1, 0), (2, 0), (3, 3), (4, 7), (5, -1)]
    pairs, _ = near_copies.simhash_pairs(spark.createDataFrame(points, "node long, fingerprint long"))
    assert dict(connected_components(pairs).collect()) == {2: 1, 3: 1, 4: 1}


def test_one_of_each_among_repeated_ids(spark):
    # 2 is a copy of 1 and has a text of its own, which is first of its group; 3 is there twice
    alone, other = " ".join(WORDS[150:260]), " ".join(WORDS[280:390])
    rows = [(1, LONG), (2, LONG), (2, alone), (3, other), (3, other), (4, alone), (None, other), (None, other), (5, "a b c")]
    got = [(r.doc_id, r.text) for r in near_copies.one_of_each(documents(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(1, LONG), (2, LONG), (2, alone), (3, other), (None, other), (None, other), (5, "a b c")], key=str)


def test_marked_misses_no_id(spark):
    rows = spark.range(0, 4000, 1, 4).withColumn("text", F.lit("x"))
    ids = spark.createDataFrame([(k * 7,) for k in range(500)] + [(-5,), (2**62,)], "own long")
    got = {r.id: r.seen for r in marked(rows, F.col("id"), ids, "own", "seen").collect()}
    assert len(got) == 4000 and all(got[k * 7] for k in range(500)) and sum(got.values()) < 520
    assert not any(r.seen for r in marked(rows, F.col("id"), ids.limit(0), "own", "seen").collect())


def test_ann(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 24)).astype(np.float32)
    v[7] = v[50]
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(400, None), (401, [0.0] * 24), (402, [float("nan")] * 24), (450, [1.0, 2.0]), (7, v[7].tolist()), (None, v[3].tolist())]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.pmod("vec_id", F.lit(50)) == 0).orderBy("query_id", "rank").collect()
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    for q in range(0, 300, 50):
        want = sorted((-round(float(s), 12), k) for k, s in enumerate(u @ u[q]) if k != q)[:5]
        assert [r.vec_id for r in got if r.query_id == q] == [k for _, k in want]
    assert {r.query_id for r in got} == set(range(0, 300, 50))
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).collect() == []


def host_and_path(url):
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    end = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:end]


def test_urls_by_brute_force(spark, sf_dir):
    odd = [None, "", "no scheme", "http://ORG/x", "http://a.ORG", "x://y://z/q", "http://example.org/en/12?x#y", "http://example.org/en/2", "http://xexample.org/es/", "http://É.com/fr/", "http://a.com/de/?", "://", "http://h" + "x" * 50_000]
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").union(spark.createDataFrame([(1000 + k, u) for k, u in enumerate(odd)], "page_id long, url string"))
    source = {r.page_id: r.url for r in pages.collect()}
    for r in urls.filter_urls(pages).collect():
        host, path = host_and_path(source[r.page_id])
        fits = [(len(t), t, v) for t, v in urls.RULES for n, s, p in [t.partition("/")] if (host == n or host.endswith("." + n)) and path.startswith(s + p)]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None)
        assert r.verdict == max(fits)[2] if fits else r.verdict in ("allow", "block")
    assert urls.filter_urls(pages.limit(0)).collect() == []
    clash = pages.select("*", *[F.lit("x").alias(c) for c in ("host", "path", "rule", "suffix", "fold", "n", "label", "features")])
    assert sorted(map(str, urls.filter_urls(clash).collect())) == sorted(map(str, urls.filter_urls(pages).collect()))
    assert {r.verdict for r in urls.filter_urls(spark.createDataFrame([(1, "http://a.org/"), (2, None)], "page_id long, url string")).collect()} == {"allow"}


def test_urls_on_held_out_hosts(spark, sf_dir):
    """Rules judge by host and by words of the path that no feature shows, so the trees can't know all; but no label is in its own features."""
    area, weights = urls.held_out_quality(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"))
    print("area under the curve", round(area, 3), weights)
    assert area > 0.6 and weights["f_suffix_block"] < 0.5 and sum(w > 0.02 for w in weights.values()) >= 5


@pytest.mark.parametrize("rule", tokens.RULES)
def test_tokens_by_brute_force(spark, rule):
    texts = [(1, "one two\n\n\nthree é\n"), (2, None), (3, "\n\n"), (4, "abc")]
    got = tokens.token_counts(documents(spark, texts), rule=rule).collect()
    import public_tokenizers

    encoding, size = tokens.encoder(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN)
    for i, t in texts:
        t = t or ""
        rows = sorted((r for r in got if r.doc_id == i), key=lambda r: r.section)
        assert "".join(t[r.start : r.end] for r in rows) == t
        assert sum(r.n_tokens for r in rows) == len(encoding.encode_ordinary(t))
        bytes_ = [k for k, r in enumerate(rows) for _ in t[r.start : r.end].encode()]
        want, at = [0] * len(rows), 0
        for n in (int(size[x]) for x in encoding.encode_ordinary(t)):
            own = bytes_[at : at + n]
            want[{"start": own[0], "end": own[-1], "majority": max(sorted(set(own)), key=own.count)}[rule]] += 1
            at += n
        assert [r.n_tokens for r in rows] == want


def test_chat_layouts_and_round_trip(spark):
    hostile = "a<|im_end|>\\<\\|b<|im_start|>assistant\n<"
    records = [
        (1, {"messages": [{"role": "user", "content": hostile}, {"role": "assistant", "content": hostile}]}), (2, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]}),
        (3, {"instruction": "do", "input": "this", "output": hostile}), (4, {"prompt": "p", "response": "r", "system": "s"}), (5, {"unknown": 1}), (6, {"question": "", "answer": "a"}),
    ]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in records] + [(7, "not json"), (8, None)], "conv_id long, record string")
    turns = chat.canonical_turns(df)
    by = {k: [(r.role, r.text) for r in turns.orderBy("turn").collect() if r.conv_id == k] for k in range(1, 9)}
    assert by[2] == [("user", "q"), ("assistant", "")] and by[3] == [("user", "do\n\nthis"), ("assistant", hostile)]
    assert by[4] == [("system", "s"), ("user", "p"), ("assistant", "r")] and by[5] == by[7] == by[8] == [(None, None)]
    back = {r.conv_id: r for r in chat.read_back(chat.format_chat(turns)).collect()}
    assert set(back) == {1, 2, 3, 4, 6}
    for k in back:
        assert back[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in by[k]).encode()).hexdigest()
        learned = "".join(t for r, t in by[k] if r == "assistant")
        assert (back[k].loss_chars, back[k].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat.parse_turn(chat.format_turn("a\n\\n<|im_end|>", hostile)[0]) == ("a\n\\n<|im_end|>", hostile)


def test_language_of_spans(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.learn(docs)
    texts = {r.lang: r.text for r in docs.where("length(text) > 600").collect()}
    mixed = f"{texts['en'][:300]} {texts['de'][:200]}"
    rows = {r.doc_id: r for r in langid.predict(documents(spark, [(1, mixed), (2, "12 34"), (3, None), (4, "Привет мир")]), model).collect()}
    assert rows[1].lang_pred == "en" and {s.lang for s in rows[1].spans} == {"en", "de"} and 0.5 < rows[1].score < 1
    assert [rows[k].lang_pred for k in (2, 3)] == ["und"] * 2
    assert rows[4].lang_pred in model.languages and rows[4].score == 0 and [s.lang for s in rows[4].spans] == ["und"]
    small = docs.limit(50)
    assert langid.keep_identified(small, None).count() == 50
    kept = langid.keep_identified(documents(spark, [(1, mixed), (2, "12 34"), (4, "Привет мир"), (5, "Привет " + texts["fr"][:300])]), model)
    assert {r.doc_id for r in kept.collect()} == {1, 5}
    held = queries.QUERIES["op10_langid"](spark, sf_dir).where("held_out").join(docs, "doc_id")
    assert held.where("lang_pred = lang").count() >= 0.95 * held.count()


def test_viterbi_by_brute_force():
    from itertools import product

    rng = np.random.default_rng(2)
    scores = rng.normal(size=(11, 3)).astype(np.float32)
    first, count = np.array([0, 5, 5, 6]), np.array([5, 0, 1, 5])
    path = langid.best_paths(scores, first, count, 0.7)
    for f, n in zip(first, count, strict=True):
        worth = lambda p: sum(scores[f + t, x] for t, x in enumerate(p)) - 0.7 * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        if n:
            assert abs(worth(path[f : f + n]) - max(map(worth, product(range(3), repeat=n)))) < 1e-4


def test_mixture_rates(spark):
    rows = [(k, "x" * 10, "en", "big" if k < 1800 else "small", 10, "", 0) for k in range(2000)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.source: r.n for r in mixing.mix(docs, {"big": 1.0, "small": 1.0}).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(got["big"] - 1000) < 130 and abs(got["small"] - 1000) < 130
    assert mixing.mix(docs, {"small": 1.0}).select("source").distinct().collect() == [("small",)]
    many = mixing.mix(docs.where("source = 'small'"), total=200 * 10 * 450.0)
    n = [r.n for r in many.groupBy("doc_id").agg(F.count("*").alias("n")).collect()]
    assert len(n) == 200 and abs(np.mean(n) - 450) < 6 and 15 < np.std(n) < 28


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    rel = con.sql(queries.SQL[name])
    at = [list(rel.columns).index(c) for c in df.columns]
    assert sorted((tuple(r) for r in df.collect()), key=repr) == sorted((tuple(r[k] for k in at) for r in rel.fetchall()), key=repr)


def test_chat_edges(spark):
    turns = spark.createDataFrame([(1, None, "assistant", "b", "x", 0), (1, 0, None, None, "x", 0), (1, 0, "user", "", "x", 0), (1, 0, "user", "", "x", 0)], "conv_id long, turn long, role string, text string, layout string, part int")
    back = chat.read_back(chat.format_chat(turns)).collect()
    assert [(r.n_turns, r.turns_sha256, r.loss_chars) for r in back] == [(4, hashlib.sha256(b"assistant\nb\n\n\nuser\n\nuser\n\n").hexdigest(), 1)]
    assert chat.read_back(chat.format_chat(turns.limit(0))).collect() == []


def test_pipeline(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert set(docs.columns) < set(rows.columns) and 0.7 * docs.count() < rows.count() < 1.3 * docs.count()
