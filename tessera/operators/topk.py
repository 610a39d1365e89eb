"""The best documents of each query: packed documents meet packed queries, and a task keeps only the best that it has seen."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

#: Rows and bytes of an Arrow batch. A packed row holds one batch at most.
ROWS, BYTES = 512, 8 << 20
#: Products of terms that are held at once, and rows that wait before the best are picked.
PRODUCTS, WAITING = 1 << 20, 1 << 17
#: Query terms and queries of a partition that documents meet; blocks of queries that a task keeps.
PART_TERMS, PART_QUERIES, KEPT = 500_000, 16_384, 64
#: Terms that are sent to all tasks, so that these keep no others; with more, all terms are kept.
FEW_TERMS = 200_000


def bounded(spark: SparkSession) -> None:
    """Bounds the rows and bytes of an Arrow batch for this session, unless it has smaller bounds."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows, "10000")) <= ROWS:
        spark.conf.set(rows, str(ROWS))
    held = spark.conf.get(size).rstrip("b")
    if not held.isdigit() or not 0 < int(held) <= BYTES:
        spark.conf.set(size, str(BYTES))


def few(terms: DataFrame) -> list[str] | None:
    """The distinct terms (one column) in order, or None if they are too many to be sent to all tasks."""
    found = [r[0] for r in terms.distinct().limit(FEW_TERMS + 1).collect()]
    return sorted(t for t in found if t is not None) if len(found) <= FEW_TERMS else None


def offsets(lengths: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32())


def with_lists(batch_columns: list, terms: pa.Array, w: np.ndarray, doc: np.ndarray, rows: int, names: list[str]) -> pa.RecordBatch:
    """The columns, and for each row the terms and numbers that doc (ascending) gives it."""
    at = offsets(np.bincount(doc, minlength=rows))
    lists = [pa.ListArray.from_arrays(at, terms), pa.ListArray.from_arrays(at, pa.array(w, pa.float64()))]
    return pa.RecordBatch.from_arrays([*batch_columns, *lists], names=[*names, "terms", "w"])


def listed(postings: DataFrame, *ids: str) -> DataFrame:
    """(ids, terms, w) of (ids, term, w)."""
    by = postings.groupBy(*ids).agg(F.collect_list(F.struct("term", "w")).alias("all"))
    return by.select(*ids, F.col("all.term").alias("terms"), F.col("all.w").alias("w"))


def packed(rows: DataFrame, mark: str, *ids: str) -> DataFrame:
    """(ids, terms, w) as a row for each batch: the ids as arrays, how many terms each has, and all terms and w in a row. Names begin with mark."""
    types = {f.name: f.dataType for f in rows.schema.fields}
    fields = [*[(i, types[i]) for i in ids], ("n", IntegerType()), ("terms", StringType()), ("w", DoubleType())]
    schema = StructType([StructField(mark + n, ArrayType(t)) for n, t in fields])
    whole = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                terms, w = part.column(len(ids)), part.column(len(ids) + 1)
                columns = [*[part.column(k) for k in range(len(ids))], pc.list_value_length(terms), terms.flatten(), w.flatten()]
                yield pa.RecordBatch.from_arrays([whole(c) for c in columns], names=schema.names)

    return rows.select(*ids, "terms", "w").mapInArrow(run, schema)


class Block:
    """Queries, and the best documents that they have met."""

    def __init__(self, ids: pa.Array, need: np.ndarray, n: np.ndarray, terms: pa.Array, w: np.ndarray):
        # copies, as slices would keep the whole batch
        self.ids, self.need = ids.take(pa.array(np.arange(len(ids)))), need.copy()
        found = terms.dictionary_encode()
        code = found.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        self.terms, self.q, self.w = found.dictionary, np.repeat(np.arange(len(n)), n)[order], w[order]
        self.many = np.bincount(code, minlength=len(self.terms))
        self.start = np.cumsum(self.many) - self.many
        self.least = np.full(len(n), -np.inf)
        self.q_rows, self.s_rows, self.k_rows, self.waiting, self.held = [], [], [], 0, 0

    def add(self, keys: pa.Array, n: np.ndarray, terms: pa.Array, w: np.ndarray) -> None:
        code = pc.fill_null(pc.index_in(terms, value_set=self.terms), -1).to_numpy(zero_copy_only=False)
        doc, hit = np.repeat(np.arange(len(n)), n), code >= 0
        doc, code, w = doc[hit], code[hit], w[hit]
        if not len(doc):
            return
        by_doc = np.cumsum(np.bincount(doc, weights=self.many[code], minlength=len(n)))
        first = 0
        while first < len(n):
            done = by_doc[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(by_doc, done + PRODUCTS, "right")))
            a, b = np.searchsorted(doc, [first, last])
            if a < b:
                self.some(keys.slice(first, last - first), doc[a:b] - first, code[a:b], w[a:b])
            first = last

    def some(self, keys: pa.Array, doc: np.ndarray, code: np.ndarray, w: np.ndarray) -> None:
        n, queries = self.many[code], len(self.need)
        at = np.repeat(self.start[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        cell = np.repeat(doc * queries, n) + self.q[at]
        value = np.repeat(w, n) * self.w[at]
        cells = len(keys) * queries
        total = np.bincount(cell, value, minlength=cells)
        met = (total > 0 if value.min() > 0 else np.bincount(cell, minlength=cells) > 0).reshape(-1, queries)
        # halves away from zero, as SQL rounds
        score = (np.copysign(np.floor(np.abs(total) * 1e6 + 0.5), total) / 1e6 + 0.0).reshape(-1, queries)
        chosen, most = met & (score >= self.least), int(self.need.max())
        if len(keys) > most and np.count_nonzero(chosen) > 4 * queries:
            # of these documents alone, none below the last of the best that are needed
            low = np.partition(np.where(met, score, -np.inf), len(keys) - most, axis=0)[len(keys) - most]
            chosen &= score >= low
        d, q = np.nonzero(chosen)
        if len(d):
            self.q_rows.append(q)
            self.s_rows.append(score[d, q])
            self.k_rows.append(keys.take(pa.array(d)))
            self.waiting += len(d)
            if self.waiting > max(WAITING, self.held):
                self.pick()

    def pick(self) -> None:
        """Keeps the best of each query: by score, then by key."""
        if not self.waiting:
            return
        q, s, k = np.concatenate(self.q_rows), np.concatenate(self.s_rows), pa.concat_arrays(self.k_rows)
        order = pc.sort_indices(pa.table({"q": q, "s": s, "k": k}), sort_keys=[("q", "ascending"), ("s", "descending"), ("k", "ascending")], null_placement="at_start").to_numpy()
        q, s = q[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = place < self.need[q]
        last = place == self.need[q] - 1
        self.least[q[last]] = s[last]
        self.q_rows, self.s_rows, self.k_rows = [q[kept]], [s[kept]], [k.take(pa.array(order[kept]))]
        self.held, self.waiting = int(kept.sum()), 0

    def rows(self, names: list[str]):
        self.pick()
        for q, s, k in zip(self.q_rows, self.s_rows, self.k_rows, strict=True):
            for at in range(0, len(q), ROWS * 16):
                part = slice(at, at + ROWS * 16)
                yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(q[part])), pa.array(self.need[q[part]], pa.int32()), k[part], pa.array(s[part])], names=names)


def best(docs: DataFrame, queries: DataFrame, key: str, query: str) -> DataFrame:
    """docs: key (unique), terms, w; queries: query, need, terms, w, both read from stored tables. (query, need, key, score): score is the sum of products of the weights
    of common terms, to 6 digits. Of documents that have a term of a query, the `need` best are among the rows: highest scores, ties by key.

    Documents are read once for each partition of queries. A task holds the best documents of its queries, and neither pairs nor postings are shuffled."""
    bounded(docs.sparkSession)
    asked = queries.where((F.col("need") > 0) & (F.size("terms") > 0))
    terms, count = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)), F.count("*")).first()
    parts = max(1, -(-terms // PART_TERMS), -(-count // PART_QUERIES))
    left = packed(docs.where(F.size("terms") > 0).select(F.col(key).alias("key"), "terms", "w"), "d_", "key")
    right = packed(asked.select(F.col(query).alias("query"), "need", "terms", "w").coalesce(parts), "q_", "query", "need").withColumn("q_block", F.monotonically_increasing_id())
    names = [query, "need", key, "score"]
    schema = StructType([StructField(query, queries.schema[query].dataType), StructField("need", IntegerType()), StructField(key, docs.schema[key].dataType), StructField("score", DoubleType())])

    def run(batches):
        blocks = {}
        for batch in batches:
            for at in range(batch.num_rows):
                of = lambda name: batch.column(name)[at].values  # noqa: B023, E731
                number = lambda name: of(name).to_numpy(zero_copy_only=False)  # noqa: B023, E731
                block = batch.column("q_block")[at].as_py()
                if block not in blocks:
                    if len(blocks) == KEPT:
                        yield from blocks.pop(next(iter(blocks))).rows(names)
                    blocks[block] = Block(of("q_query"), number("q_need"), number("q_n"), of("q_terms"), number("q_w"))
                blocks[block].add(of("d_key"), number("d_n"), of("d_terms"), number("d_w"))
        for block in blocks.values():
            yield from block.rows(names)

    return left.crossJoin(right.hint("shuffle_replicate_nl")).mapInArrow(run, schema)
