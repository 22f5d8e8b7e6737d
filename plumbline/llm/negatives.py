"""Hard negatives by bounds along a spanning tree of the anchors.

The score of a row with an anchor differs from its score with the anchor's parent in the tree by no more than the edge's
length times the row's norm. Every row carries an interval of possible scores down the tree; only where the interval meets
what is still wanted (the best of the same label, or the windows of the positives) is the score computed, which makes the
interval a point again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import cut
from plumbline.llm.vectors import fast, id_column, ids, products, sound, whole

#: Anchors compared with all rows in one scan, about.
BLOCK = 4096
#: Rows that carry intervals down the tree at once.
ROWS = 4096
POSITIVES = 5
NEGATIVES = 3


@dataclass
class Tree:
    """Anchors (whole vectors, ids, labels) and a minimum spanning tree of them: ``order`` is from the root down."""

    vectors: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    order: list[int] = field(default_factory=list)
    parent: np.ndarray = field(default_factory=lambda: np.empty(0, int))
    edge: np.ndarray = field(default_factory=lambda: np.empty(0))
    waiting: np.ndarray = field(default_factory=lambda: np.empty(0, int))


def spanning_tree(vectors: np.ndarray, own: np.ndarray, labels: np.ndarray) -> Tree:
    """Prim's algorithm over Euclidean distances; then an order in which each subtree's largest branch comes last.

    So a node's interval can go when its last branch is entered, and about log2(anchors) intervals are held at once.
    """
    n = len(vectors)
    points = vectors.astype(np.float64)
    nearest, parent = np.full(n, np.inf), np.full(n, -1)
    out, joined, node = np.ones(n, bool), [], 0
    for _ in range(n):
        joined.append(node)
        out[node] = False
        apart = np.sqrt(((points - points[node]) ** 2).sum(axis=1))
        closer = out & (apart < nearest)
        nearest[closer], parent[closer] = apart[closer], node
        node = int(np.argmin(np.where(out, nearest, np.inf)))
    size, children = np.ones(n, int), [[] for _ in range(n)]
    for node in reversed(joined[1:]):
        size[parent[node]] += size[node]
        children[parent[node]].append(node)
    order, stack = [], joined[:1]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += sorted(children[node], key=lambda c: -size[c])  # the last, and so the first taken, is the smallest
    return Tree(vectors, own, labels, order, parent, nearest, np.array([len(c) for c in children], int))


#: Told an anchor, the rows' labels and the intervals: which rows to score. Told an anchor, rows and scores: keeps them.
Wanted = Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
Scored = Callable[[int, np.ndarray, np.ndarray, np.ndarray], None]


def walk(tree: Tree, vectors: np.ndarray, own: np.ndarray, labels: np.ndarray, wanted: Wanted, scored: Scored) -> None:
    """Take rows down the tree. Intervals are wider than rounding could make scores differ."""
    most = int(np.abs(tree.vectors).max(initial=0))
    vectors = fast(vectors, most)
    norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
    longest = np.sqrt((tree.vectors.astype(np.float64) ** 2).sum(axis=1)).max(initial=0)
    slack = 1 + 1e-9 * longest * norms.max(initial=0)
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    waiting = tree.waiting.copy()
    for node in tree.order:
        up = tree.parent[node]
        if up < 0:
            low = products(vectors, tree.vectors[node]).astype(np.float64)
            high = low.copy()
        else:
            low, high = held[up]
            waiting[up] -= 1
            if not waiting[up]:
                del held[up]
            apart = tree.edge[node] * norms * (1 + 1e-9) + slack
            low, high = low - apart, high + apart
        chosen = np.flatnonzero(wanted(node, labels, low, high))
        if len(chosen):
            part = vectors if 2 * len(chosen) > len(vectors) else vectors[chosen]
            scores = products(part, tree.vectors[node])
            scores = scores[chosen] if len(scores) > len(chosen) else scores
            low[chosen] = high[chosen] = scores
            scored(node, chosen, scores, own)
        if waiting[node]:
            held[node] = low, high


def _batches(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in rows:
        for k in range(0, batch.num_rows, ROWS):
            part = batch.slice(k, ROWS)
            yield whole(part.column(2)), ids(part.column(0)), part.column(1).to_numpy()


def _first(scores: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """Places of the first n by descending score, then id."""
    return np.lexsort((own, -scores))[:n]


def best_alike(tree: Tree, n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of one label with the anchor: the first n of a task's rows, ``k, score, id, own`` (the anchor itself or a copy)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(tree.ids)
        scores = [np.empty(0, np.int64)] * size
        found, own = scores.copy(), [np.empty(0, bool)] * size
        floor = np.full(size, -np.inf)
        for vectors, names, labels in _batches(rows):

            def wanted(k: int, labels: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
                return (labels == tree.labels[k]) & (high >= floor[k])

            def scored(k: int, chosen: np.ndarray, values: np.ndarray, names: np.ndarray, vectors: np.ndarray = vectors) -> None:
                near = values >= floor[k]
                chosen, values = chosen[near], values[near]
                same = (names[chosen] == tree.ids[k]) & (vectors[chosen] == tree.vectors[k]).all(axis=1)
                columns = [np.concatenate(x) for x in ((scores[k], values), (found[k], names[chosen]), (own[k], same))]
                first = _first(columns[0], columns[1], n)
                scores[k], found[k], own[k] = (x[first] for x in columns)
                if len(first) == n:
                    floor[k] = scores[k][-1]

            walk(tree, vectors, names, labels, wanted, scored)
        k = np.repeat(np.arange(size), [len(x) for x in scores])
        if len(k):
            columns = [pa.array(k), pa.array(np.concatenate(scores)), id_column(np.concatenate(found)), pa.array(np.concatenate(own))]
            yield pa.RecordBatch.from_arrays(columns, ["k", "score", "id", "own"])

    return run


def best_in_windows(tree: Tree, windows: list[list[tuple[int, int]]], n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of another label whose score lies in a window: the first n of a task's rows for each, ``k, i, score, id``."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        kept = [[(none, none) for _ in own] for own in windows]
        floors = [[low for low, _ in own] for own in windows]
        least = [min(own, default=np.inf) for own in floors]
        most = [max((high for _, high in own), default=-np.inf) for own in windows]

        def wanted(k: int, labels: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            return (labels != tree.labels[k]) & (high >= least[k]) & (low <= most[k])

        def scored(k: int, chosen: np.ndarray, values: np.ndarray, names: np.ndarray) -> None:
            near = (values >= least[k]) & (values <= most[k])
            if not near.any():
                return
            values, own = values[near], names[chosen[near]]
            order = np.lexsort((own, -values))
            values, own = values[order], own[order]
            for i, (_, high) in enumerate(windows[k]):
                at = int(np.searchsorted(-values, -high))
                stop = min(at + n, int(np.searchsorted(-values, -floors[k][i], "right")))
                if at < stop:
                    both = [np.concatenate(x) for x in zip(kept[k][i], (values[at:stop], own[at:stop]), strict=True)]
                    first = _first(*both, n)
                    kept[k][i] = both[0][first], both[1][first]
                    if len(first) == n:
                        floors[k][i] = int(kept[k][i][0][-1])
            least[k] = min(floors[k])

        for vectors, names, labels in _batches(rows):
            walk(tree, vectors, names, labels, wanted, scored)
        flat = [(k, i, *own) for k, each in enumerate(kept) for i, own in enumerate(each) if len(own[0])]
        if flat:
            size = [len(x[2]) for x in flat]
            columns = [pa.array(np.repeat([x[c] for x in flat], size)) for c in (0, 1)]
            columns += [pa.array(np.concatenate([x[2] for x in flat])), id_column(np.concatenate([x[3] for x in flat]))]
            yield pa.RecordBatch.from_arrays(columns, ["k", "i", "score", "id"])

    return run


def _leading(found: DataFrame, group: list[str], n: int) -> DataFrame:
    """The first n rows of each group, numbered as ``place``; tasks hand on n rows of a group at most."""
    order = Window.partitionBy(*group).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def window(score: int) -> tuple[int, int]:
    """Whole scores from 50 to 95 percent of a positive's."""
    return -(-score // 2), 95 * score // 100


def mine(embeddings: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows where ``anchor`` is true.

    Input: ``vec_id, label, embedding`` among any columns. Rows with a null label or an unsound vector take no part; see
    ``vectors.sound``. Repeated rows count each: a copy of an anchor is an anchor, and one of its positives. Ties go to the
    smaller vec_id, a null one last; rows that agree in both give the same result. Anchors without positives, pairs without
    negatives and an empty table give no rows. Anchors come in blocks of about ``BLOCK``, which tasks hold; each block's
    windows come from one scan of all rows and its negatives from another.
    """
    rows = sound(embeddings).filter("label IS NOT NULL")
    chosen = rows.filter(anchor)
    blocks = max(1, -(-chosen.count() // BLOCK))
    staged = cut(chosen.repartition(blocks).withColumn("block", F.spark_partition_id()))
    found = []
    for block in range(blocks):
        own = staged.filter(F.col("block") == block).drop("block").toArrow().combine_chunks().to_batches()
        if not own:
            continue
        one = pa.Table.from_batches(own).combine_chunks()
        vectors = whole(one.column(2).combine_chunks())
        tree = spanning_tree(vectors, ids(one.column(0).combine_chunks()), one.column(1).to_numpy())
        alike = rows.mapInArrow(best_alike(tree, positives + 1), "k long, score long, id long, own boolean")
        pairs = [[] for _ in tree.ids]
        itself = [False] * len(pairs)
        for r in _leading(alike, ["k"], positives + 1).orderBy("k", "place").toArrow().to_pylist():
            if r["own"] and not itself[r["k"]]:
                itself[r["k"]] = True  # a row is not its own positive; a copy of it is
            elif len(pairs[r["k"]]) < positives:
                pairs[r["k"]].append((r["id"], r["score"]))
        windows = [[window(score) for _, score in own] for own in pairs]
        met = rows.mapInArrow(best_in_windows(tree, windows, negatives), "k long, i long, score long, id long")
        known = [(k, i, None if tree.ids[k] == np.iinfo(np.int64).max else int(tree.ids[k]), p, s) for k, own in enumerate(pairs) for i, (p, s) in enumerate(own)]
        names = pa.table(list(zip(*known, strict=True)) or [[]] * 5, pa.schema([(x, pa.int64()) for x in ("k", "i", "anchor_id", "positive_id", "positive_score")]))
        found.append(_leading(met, ["k", "i"], negatives).join(embeddings.sparkSession.createDataFrame(names), ["k", "i"]))
    out = ["anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")]
    if not found:
        schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return embeddings.sparkSession.createDataFrame([], schema)
    whole_result = found[0]
    for each in found[1:]:
        whole_result = whole_result.unionByName(each)
    return whole_result.select(*out)
