"""Ranked lexical search: the best documents for each of many queries, by accumulators limited term by term.

One pass over the texts leaves a row per document with its length and the counts of those of its terms
that some query has. Each query's terms are taken from the rarest on. A document gets an accumulator for a query
when it has one of the terms taken so far; more and more terms are taken until the largest scores that all
later terms can add stay together below the k-th best sum so far. No document without an accumulator
can reach the best k any more, so from there none is created. Those whose sum and the later terms'
largest scores reach the k-th best are carried on with all later terms, so their scores are exact.

A document's counts are one row, so its accumulators live inside one slice of rows, and only the best k of a task
for each query leave it. Queries are worked off in blocks of some ``TERMS_AT_ONCE`` terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.grouping import top_per
from ..session import scratch, stage_table

BEST = 50
FIRST_TERMS = 4  # of each query that create accumulators in the first round; twice as many in the next
TERMS_AT_ONCE = 200_000  # of all queries of a block: some 10 MB on the driver and in each task
SLICE_CELLS = 1 << 20  # accumulators and postings in memory together
ROWS_AT_ONCE = 500
SALTS = 64

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: By byte, what it is in a term; bytes of no term are blanks. Every byte of a character from U+0080 is 0x80 or more.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: Column) -> Column:
    """The terms of a text: runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z lower-cased."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _CAPITALS, _SMALL), F.lit(TERM), 0)


def _counted(docs: DataFrame, known: dict[bytes, int], text: str, key: str) -> DataFrame:
    """(_key, n, terms, counts) of the documents with a term; terms are the numbers of ``known`` ones."""

    def counted(batches):
        number = known.get
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(at, ROWS_AT_ONCE)
                sizes, found, counts, ends = [], [], [], [0]
                for raw in rows.column("_text"):
                    words = (raw.as_py() or b"").translate(_BYTES).split()
                    sizes.append(len(words))
                    held = Counter(map(number, words))
                    held.pop(None, None)
                    found += held.keys()
                    counts += held.values()
                    ends.append(len(found))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int32())) for v in (found, counts)]
                made = pa.RecordBatch.from_arrays([rows.column("_key"), pa.array(sizes, pa.int64()), *lists], ["_key", "n", "terms", "counts"])
                yield made.filter(pa.array(np.array(sizes) > 0))

    chosen = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).cast("binary").alias("_text"))
    return chosen.mapInArrow(counted, "_key long, n long, terms array<int>, counts array<int>")


@dataclass
class _Postings:
    """Some rows of counts as flat arrays; ``impact`` is what a count is worth before the term's weight."""

    keys: pa.Array
    row: np.ndarray
    term: np.ndarray
    impact: np.ndarray


def _postings(batches, n_docs: int, n_terms: int, rows_at_once: int) -> Iterator[_Postings]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows_at_once):
            rows = batch.slice(at, rows_at_once)
            lists = rows.column("terms")
            sizes = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(rows.num_rows), sizes)
            count = rows.column("counts").flatten().to_numpy().astype(np.int64)
            norm = 100 - 50 + 50 * rows.column("n").to_numpy() * n_docs // n_terms
            impact = 1_000_000_000 * count // (1000 * count + 20 * norm[row])
            yield _Postings(rows.column("_key"), row, lists.flatten().to_numpy(), impact)


@dataclass
class _Lists:
    """By term, the queries that have it, with its weight there."""

    begin: np.ndarray
    query: np.ndarray
    weight: np.ndarray

    @staticmethod
    def of(chosen: np.ndarray, term: np.ndarray, query: np.ndarray, weight: np.ndarray, size: int) -> _Lists:
        order = np.argsort(term[chosen], kind="stable")
        begin = np.searchsorted(term[chosen][order], np.arange(size + 1))
        return _Lists(begin, query[chosen][order], weight[chosen][order])

    def scores(self, some: _Postings, kept: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, query, score) of every pair of a posting and a query that has its term, in slices."""
        at = np.arange(len(some.term)) if kept is None else kept
        sizes = self.begin[some.term[at] + 1] - self.begin[some.term[at]]
        at, sizes = at[sizes > 0], sizes[sizes > 0]
        upto = np.cumsum(sizes)
        first = 0
        while first < len(at):
            last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + SLICE_CELLS, "right")))
            part, many = at[first:last], sizes[first:last]
            place = np.repeat(self.begin[some.term[part]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            which = np.repeat(part, many)
            yield some.row[which], self.query[place], self.weight[place] * some.impact[which]
            first = last


class _Best:
    """The k best (score, key) of each query so far, from ``least`` on; of equal scores the smaller key."""

    def __init__(self, least: np.ndarray, k: int):
        self.k, self.least = k, least.copy()
        self.query, self.score, self.key = (np.empty(0, np.int64) for _ in range(3))

    def add(self, query: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        high = score >= self.least[query]
        query, score, key = (np.concatenate(p) for p in ((self.query, query[high]), (self.score, score[high]), (self.key, key[high])))
        order = np.lexsort((key, -score, query))
        query, score, key = query[order], score[order], key[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        self.least[query[rank == self.k - 1]] = score[rank == self.k - 1]
        self.query, self.score, self.key = query[rank < self.k], score[rank < self.k], key[rank < self.k]


def _best_of(counted: DataFrame, total: tuple[int, int], kth: np.ndarray, k: int, creating: _Lists, later: _Lists | None = None, rest=None) -> DataFrame:
    """(query, score, _key): the k best accumulators of each query in each task, from the k-th best sum known
    so far on. Without ``later``, sums of the creating terms; else whole scores of those that can still reach ``kth``."""
    queries = len(kth)

    def worked(batches):
        best = _Best(kth, k)
        for some in _postings(batches, *total, max(1, min(ROWS_AT_ONCE, SLICE_CELLS // queries))):
            sums = np.zeros((len(some.keys), queries), np.int64)
            for row, query, score in creating.scores(some):
                np.add.at(sums, (row, query), score)
            if later is not None:
                sums[(sums == 0) | (sums + rest < kth)] = 0
                survives = sums > 0
                # Whether a row has a survivor at all.
                for row, query, score in later.scores(some, np.flatnonzero(survives.any(axis=1)[some.row])):
                    carried = survives[row, query]
                    np.add.at(sums, (row[carried], query[carried]), score[carried])
            row, query = np.nonzero(sums)
            named = some.keys.is_valid().to_numpy(zero_copy_only=False)[row]
            row, query = row[named], query[named]
            if len(row):
                best.add(query, sums[row, query], some.keys.fill_null(0).to_numpy()[row])
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (best.query, best.score, best.key)], ["query", "score", "_key"])

    return counted.mapInArrow(worked, "query long, score long, _key long")


def _merged(best: DataFrame, k: int) -> DataFrame:
    """The k best of each query of all tasks, with their rank."""
    order = [F.desc("score"), F.asc("_key")]
    some = top_per(best.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS))), ["query", "_salt"], order, k)
    return top_per(some.drop("rank"), ["query"], order, k)


def _statistics(counted: DataFrame, total: tuple[int, int], size: int) -> DataFrame:
    """(term, df, most): in how many documents a term is, and its largest impact."""

    def worked(batches):
        df, most = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for some in _postings(batches, *total, ROWS_AT_ONCE):
            df += np.bincount(some.term, minlength=size)
            np.maximum.at(most, some.term, some.impact)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held]), pa.array(most[held])], ["term", "df", "most"])

    made = counted.mapInArrow(worked, "term long, df long, most long")
    return made.groupBy("term").agg(F.sum("df").alias("df"), F.max("most").alias("most"))


def _search(docs: DataFrame, pairs: DataFrame, text: str, key: str, k: int) -> DataFrame:
    """(_item, rank, _key, score) for a block of queries, given as (_item, term)."""
    # Bounded by TERMS_AT_ONCE, unless a single query has more.
    rows = pairs.toArrow()
    if not rows.num_rows:
        return docs.sparkSession.createDataFrame([], "_item long, rank int, _key long, score long")
    words, term = np.unique(np.array([t.encode() for t in rows.column("term").to_pylist()], dtype=object), return_inverse=True)
    items = sorted(set(rows.column("_item").to_pylist()))
    query = np.searchsorted(np.array(items), rows.column("_item").to_numpy())
    known = {w: n for n, w in enumerate(words)}
    with scratch(docs.sparkSession) as table:
        counted = table(_counted(docs, known, text, key))
        n_docs, n_terms = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        total = n_docs, max(1, n_terms)
        df, most = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for r in _statistics(counted, total, len(words)).collect():  # a row per term of the block
            df[r["term"]], most[r["term"]] = r["df"], r["most"]
        weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        held = df[term] > 0
        term, query = term[held], query[held]
        order = np.lexsort((term, df[term], query))
        term, query = term[order], query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        bound = weights[term] * most[term]
        sizes = np.bincount(query, minlength=len(items))
        taken, kth = np.minimum(sizes, FIRST_TERMS), np.zeros(len(items), np.int64)

        def rest() -> np.ndarray:
            """What all terms not yet taken can add."""
            after = np.zeros(len(items), np.int64)
            np.add.at(after, query[rank >= taken[query]], bound[rank >= taken[query]])
            return after

        open_ = taken < sizes
        while open_.any():
            lists = _Lists.of(open_[query] & (rank < taken[query]), term, query, weights[term], len(words))
            best = _merged(_best_of(counted, total, kth, k, lists), k)
            for r in best.filter(F.col("rank") == k).collect():  # a row per query
                kth[r["query"]] = r["score"]
            open_ &= rest() >= kth
            taken[open_] = np.minimum(sizes, 2 * taken)[open_]
            open_ &= taken < sizes
        creating = rank < taken[query]
        lists = [_Lists.of(chosen, term, query, weights[term], len(words)) for chosen in (creating, ~creating)]
        found = _merged(_best_of(counted, total, kth, k, *lists, rest()), k)
        name = F.element_at(F.lit(items).cast("array<long>"), (F.col("query") + 1).cast("int"))
        return stage_table(found.select(name.alias("_item"), "rank", "_key", "score"))


def search(docs: DataFrame, items: DataFrame, k: int = BEST, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text", terms_at_once: int = TERMS_AT_ONCE) -> DataFrame:
    """Per row of ``items`` the k documents with the highest scores above 0: item, rank (from 1), key, score;
    of equal scores the smaller key first. Keys are whole numbers.

    With N documents that have a term, L terms in all of them, and a term in df of them, its weight is
    floor(1000 * ln((2N + 2) / (2df + 1))); a document of n terms that has it tf times adds that weight
    times (10^9 tf) div (1000 tf + 20 (50 + (50 n N) div L)).

    NULL and empty texts have no terms; they are no documents, and as queries they find nothing.
    Rows that repeat an item's key are one query with the terms of all; repeated documents are ranked
    each. Documents without a key count in N, L and df but are not ranked; queries without one are left
    out. Other columns are not looked at. No documents or no queries give no rows.
    """
    with scratch(docs.sparkSession) as table:
        exploded = items.filter(F.col(item).isNotNull()).select(F.col(item).cast("long").alias("_item"), F.explode(F.array_distinct(terms(F.col(item_text)))).alias("term"))
        pairs = table(exploded.distinct())
        blocks = max(1, -(-pairs.count() // terms_at_once))
        found = None
        for block in range(blocks):
            some = pairs.filter(F.pmod(F.xxhash64("_item"), F.lit(blocks)) == block) if blocks > 1 else pairs
            part = _search(docs, some, text, key, k)
            found = part if found is None else found.unionByName(part)
    return found.select(F.col("_item").alias(item), "rank", F.col("_key").alias(key), "score")


ORACLE = rf"""
WITH t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id,
    unnest(regexp_extract_all(translate(text, '{_CAPITALS}', '{_SMALL}'), '{TERM}')) AS term FROM documents) GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM t GROUP BY 1),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM lengths),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{_CAPITALS}', '{_SMALL}'), '{TERM}')) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM t, total GROUP BY term, docs),
m AS (SELECT doc_id, 100 - 50 + (50 * n * docs) // terms AS m FROM lengths, total),
s AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN t USING (term) JOIN m USING (doc_id) GROUP BY 1, 2)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50"""
