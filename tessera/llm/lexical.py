"""Ranked lexical search by branch and bound over FP-trees of documents.

A document is cut down to the terms of the queries: a vector of term and count, the
term that most documents hold first. In a task such vectors form a trie, in which
documents with the same frequent terms share a path; a subtree of at most ``LEAF``
documents, or of documents with the same terms, ends in leaves. Every node knows the
largest count of each term and the smallest length norm ``m`` below it, so it bounds the
score of all its documents for any query. Each item goes down the trie depth first, best
bound first, and leaves out every subtree that cannot reach its ten best so far; the ten
of all trees are merged by a ranked window.

Queries travel to the tasks in blocks of at most ``BLOCK_ITEMS`` items and
``BLOCK_CHARS`` characters (or one longer item), each block being one pass over the
documents.

Defined results: null and texts without a term are no documents and are never ranked;
items without a term, or none of whose terms occurs, have no rows; every distinct
``(item_id, text)`` row is an item; repeated document rows are ranked each, equal scores
by ascending id, null ids last; empty tables give no rows; other columns are not looked at.
Sums stay in 64 bits while ``75 * n * N`` does.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, UPPER, persist_table, read_table, spread_rows, text_or_empty

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 10
BLOCK_ITEMS, BLOCK_CHARS = 4096, 16 << 20
LEAF = 32
TREE_CELLS = 1 << 20
TASK_DOCUMENTS = 2048

_FOLD = str.maketrans(UPPER, LOWER)
_FIND = re.compile(TERM).findall


def terms_of(text: str | None) -> list[str]:
    return _FIND((text or "").translate(_FOLD))


# --- queries and corpus statistics -------------------------------------------


def item_blocks(items: DataFrame) -> Iterator[list]:
    """Distinct items as lists of rows, one bounded list at a time."""
    distinct = items.select("item_id", text_or_empty().alias("text")).distinct()
    total = distinct.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    blocks = max(1, math.ceil(total.n / BLOCK_ITEMS), math.ceil((total.chars or 0) / BLOCK_CHARS))
    if not total.n:
        return
    numbered = distinct.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    if blocks > 1:
        numbered = persist_table(numbered, "lexical-items")
    for block in range(blocks):
        rows = numbered.where(F.col("block") == block).drop("block").collect()
        if rows:
            yield rows


def restricted(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``(doc_id, n, terms, tfs)`` of documents with a term; ``terms`` are positions in the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            ids, sizes, held, counts = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = terms_of(text)
                if found:
                    mine = [(number[t], c) for t, c in Counter(found).items() if t in number]
                    ids.append(doc_id)
                    sizes.append(len(found))
                    held.append([t for t, _ in mine])
                    counts.append([c for _, c in mine])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(held, pa.list_(pa.int32())),
                    pa.array(counts, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n", "terms", "tfs"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(cut, "doc_id long, n long, terms array<int>, tfs array<long>")


@dataclass(frozen=True)
class Query:
    """An item as its distinct terms and their weights times occurrences in the item."""

    item_id: int
    terms: np.ndarray
    weights: np.ndarray


# --- the tree ------------------------------------------------------------------


def term_score(weight, tf, m):
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


@dataclass
class DocumentTree:
    """Trie over the documents of one batch.

    Documents are kept in the order of their rank sequences, so a node is a range
    of them. ``children[v]`` lists a node's children; a node without any is a leaf.
    """

    ids: list
    m: np.ndarray
    start: np.ndarray  # of each document's cells
    term: np.ndarray
    tf: np.ndarray
    low: list[int] = field(default_factory=list)
    high: list[int] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)

    def __post_init__(self):
        self._grow()
        self.least_m = np.array([self.m[a:b].min() for a, b in zip(self.low, self.high)])
        nothing = float("inf")
        self.least_id = [min((nothing if i is None else i) for i in self.ids[a:b]) for a, b in zip(self.low, self.high)]
        # largest count per node and term, as one list of nodes for each term
        nodes, terms, most = [], [], []
        for v, (a, b) in enumerate(zip(self.low, self.high)):
            held, place = np.unique(self.term[self.start[a] : self.start[b]], return_inverse=True)
            top = np.zeros(len(held), np.int64)
            np.maximum.at(top, place, self.tf[self.start[a] : self.start[b]])
            nodes.append(np.full(len(held), v))
            terms.append(held)
            most.append(top)
        node, term, top = np.concatenate(nodes), np.concatenate(terms), np.concatenate(most)
        order = np.argsort(term, kind="stable")
        self.node, self.node_term, self.node_tf = node[order], term[order], top[order]

    def _add(self, a: int, b: int) -> int:
        self.low.append(a)
        self.high.append(b)
        self.children.append([])
        return len(self.low) - 1

    def _grow(self) -> None:
        size = np.diff(self.start)
        open_nodes = [(self._add(0, len(self.ids)), 0)]
        while open_nodes:
            v, depth = open_nodes.pop()
            a, b = self.low[v], self.high[v]
            if b - a <= LEAF:
                continue
            # one path of terms that all share is one edge
            last = min(size[a], size[b - 1])
            first, final = self.start[a], self.start[b - 1]
            while depth < last and self.term[first + depth] == self.term[final + depth]:
                depth += 1
            # documents that end here come first in the order
            here = a + int(np.searchsorted(size[a:b] > depth, True))
            cuts = [*range(a, here, LEAF)]
            if here < b:
                at = self.term[self.start[here:b] + depth]
                cuts += [here, *(here + 1 + np.flatnonzero(np.diff(at))).tolist()]
            for lo, hi in zip(cuts, [*cuts[1:], b]):
                child = self._add(lo, hi)
                self.children[v].append(child)
                if lo >= here:
                    open_nodes.append((child, depth + 1))

    def _counts(self, sorted_terms, owner, value, terms, rows):
        """Matrix of ``value`` by owner row and query term."""
        out = np.zeros((rows, len(terms)), np.int64)
        left, right = np.searchsorted(sorted_terms, terms), np.searchsorted(sorted_terms, terms, side="right")
        for k, (x, y) in enumerate(zip(left, right)):
            out[owner[x:y], k] = value[x:y]
        return out

    def bounds(self, query: Query) -> np.ndarray:
        most = self._counts(self.node_term, self.node, self.node_tf, query.terms, len(self.low))
        return term_score(query.weights, most, self.least_m[:, None]).sum(1)

    def leaf_scores(self, v: int, query: Query) -> np.ndarray:
        a, b = self.low[v], self.high[v]
        cells = slice(self.start[a], self.start[b])
        place = np.searchsorted(query.terms, self.term[cells])
        hit = query.terms[np.minimum(place, len(query.terms) - 1)] == self.term[cells]
        row = np.repeat(np.arange(b - a), np.diff(self.start[a : b + 1]))[hit]
        part = term_score(query.weights[place[hit]], self.tf[cells][hit], self.m[a + row])
        out = np.zeros(b - a, np.int64)
        np.add.at(out, row, part)
        return out

    def search(self, query: Query, best: list[tuple[int, float, int | None]], top: int = TOP) -> list:
        """``best`` and this tree's documents as the ``top`` of ``(-score, id or infinity, id)``; also counts the leaves read."""
        bound = self.bounds(query)
        stack, self.leaves_read = [0], 0
        while stack:
            v = stack.pop()
            # a subtree that ties the last place can only enter by a smaller id
            if bound[v] <= 0 or (len(best) >= top and (-bound[v], self.least_id[v]) >= best[-1][:2]):
                continue
            if self.children[v]:
                stack += sorted(self.children[v], key=lambda c: bound[c])
                continue
            self.leaves_read += 1
            scores = self.leaf_scores(v, query)
            ids = self.ids[self.low[v] : self.high[v]]
            found = [(-int(s), math.inf if i is None else i, i) for s, i in zip(scores, ids) if s > 0]
            best = sorted([*best, *found], key=lambda x: x[:2])[:top]
        return best


def trees_of(batches: Iterator[pa.RecordBatch], rank: np.ndarray, documents: int, length: int) -> Iterator[DocumentTree]:
    """Trees of about ``TREE_CELLS`` cells each; ``rank`` orders terms, the most frequent first."""
    ids, sizes, keys, held, counts, cells = [], [], [], [], [], 0

    def tree() -> DocumentTree:
        order = sorted(range(len(ids)), key=keys.__getitem__)
        n = np.array(sizes, np.int64)[order]
        return DocumentTree(
            [ids[i] for i in order],
            25 + (75 * n * documents) // length,
            np.cumsum([0, *(len(held[i]) for i in order)]),
            np.concatenate([held[i] for i in order]),
            np.concatenate([counts[i] for i in order]),
        )

    for batch in batches:
        for doc_id, n, terms, tfs in zip(*(c.to_pylist() for c in batch.columns)):
            if not terms:
                continue
            order = np.argsort(rank[terms])
            ids.append(doc_id)
            sizes.append(n)
            held.append(np.array(terms, np.int64)[order])
            counts.append(np.array(tfs, np.int64)[order])
            keys.append(rank[held[-1]].astype(">u4").tobytes())
            cells += len(terms)
            if cells >= TREE_CELLS:
                yield tree()
                ids, sizes, keys, held, counts, cells = [], [], [], [], [], 0
    if ids:
        yield tree()


# --- the search ------------------------------------------------------------------


def _search_block(docs: DataFrame, rows: list, top: int) -> DataFrame:
    items = [(r.item_id, Counter(terms_of(r.text))) for r in rows]
    vocabulary = sorted({t for _, c in items for t in c})
    number = {t: i for i, t in enumerate(vocabulary)}
    vectors = persist_table(restricted(docs, vocabulary), "lexical-vectors")
    total = vectors.agg(F.count("*").alias("documents"), F.sum("n").alias("length")).first()
    documents, length = total.documents, total.length or 0
    held = np.zeros(len(vocabulary), np.int64)
    per_term = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    for r in per_term.collect():  # one row per term of a block of items
        held[r.term] = r.df
    weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in held]
    rank = np.empty(len(vocabulary), np.int64)
    rank[np.lexsort((np.arange(len(vocabulary)), -held))] = np.arange(len(vocabulary))

    def query(item_id, counted) -> Query:
        terms = sorted(number[t] for t in counted if held[number[t]])
        weights = [weight[t] * counted[vocabulary[t]] for t in terms]
        return Query(item_id, np.array(terms, np.int64), np.array(weights, np.int64))

    queries = [q for q in (query(*i) for i in items) if len(q.terms)]
    shared = docs.sparkSession.sparkContext.broadcast((queries, rank, documents, length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, rank, documents, length = shared.value
        best = [[] for _ in queries]
        for tree in trees_of(batches, rank, documents, length):
            best = [tree.search(q, b, top) for q, b in zip(queries, best)]
        found = [(k, q.item_id, i, -s) for k, (q, b) in enumerate(zip(queries, best)) for s, _, i in b]
        columns = list(zip(*found)) if found else [()] * 4
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["item", "item_id", "doc_id", "score"]
        )

    # vectors are few bytes but much work: tasks are made by rows
    dealt = vectors.where(F.size("terms") > 0).repartition(max(1, math.ceil(documents / TASK_DOCUMENTS)))
    hits = dealt.mapInArrow(run, "item int, item_id long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


def lexical_search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's ``top`` documents of ``docs(doc_id, text)``."""
    found = None
    for rows in item_blocks(items):
        part = _search_block(docs, rows, top)
        found = part if found is None else persist_table(found, "lexical-hits").unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return found


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_rows(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return lexical_search(docs, read_table(spark, sf_dir, "benchmark"))


_TERMS = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)
OP12_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS d, doc_id, ts, len(ts)::BIGINT AS n FROM (SELECT doc_id, {_TERMS} AS ts FROM documents) WHERE len(ts) > 0
),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM d),
tf AS (SELECT d, term, count(*)::BIGINT AS tf FROM (SELECT d, unnest(ts) AS term FROM d) GROUP BY d, term),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
i AS (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS ts FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT i, term, count(*)::BIGINT AS k FROM (SELECT i, unnest(ts) AS term FROM i) GROUP BY i, term),
w AS (SELECT i, term, k * floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM q JOIN df USING (term), c),
s AS (
  SELECT i, d, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // length))))::BIGINT AS score
  FROM w JOIN tf USING (term) JOIN d USING (d), c GROUP BY i, d
),
r AS (
  SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
  FROM s JOIN i USING (i) JOIN (SELECT d, doc_id FROM d) USING (d) WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {TOP}"""
