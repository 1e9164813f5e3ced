"""Hard negatives by threshold joins over an inverted index with suffix-norm bounds.

Rows and query anchors meet in cells of bounded size (a block of rows, a block of anchors);
Spark deals the cells out.  In a cell a search for all pairs that score at least a threshold
goes like this:

* dimensions are taken in order of weight.  Of a row only the leading ones are indexed: from
  the point on where the norm of the row's suffix times the largest norm of an anchor's
  suffix stays below the threshold, the rest can't make a match alone and is left out;
* the index gives, for each group of dimensions, the rows that hold it (rows are sorted by
  their indexed length, so a posting list is a tail of the block).  Partial scores add up
  list by list, and a pair goes as soon as its partial score plus the product of both
  remaining norms is below the threshold;
* what is left gets the omitted dimensions and is compared with its whole score.

Each anchor starts with a high threshold, which is lowered until its windows are full or
nothing below can count: first the window of its best rows of the same label (positives),
then for each positive the window of rows of other labels whose score lies between two
shares of the positive's.  Cells keep only what can be among the first of a window, and a
final ranking merges the cells.  All scores are whole numbers, so nothing is approximate.

Cases: rows with a null id, label, vector or component, or a component that isn't finite,
take no part; so do rows whose quantised norm is 2 ** 31 or more (scores would pass 64 bits);
equal rows count once; rows that repeat an id with other content count each, as candidates,
while an anchor that repeats its id is the one with the least label and vector; vectors of
other lengths are compared over their common dimensions; an empty table gives no rows.
Input columns other than the three named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import written

CELL_VALUES, LEAST_ROWS = 1 << 21, 2048  # most components of one side of a cell; rows below which a cell isn't worth a task
GROUP = 8  # dimensions whose posting lists are added up at once
LADDER = (0.7, 0.5, 0.35, 0.25)  # thresholds tried, as shares of the highest score the norms allow
SPARSE = 1 / 16  # below this share of pairs left, they are listed one by one
LIMIT = 1 << 62  # of squared norms


def quantised(rows: DataFrame, scale: int, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``id``, ``label`` and ``q`` (whole numbers ``floor(scale * component)``) of the rows that take part, each once."""
    named = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) * scale < float(1 << 31)), F.lit(False)))
    usable = named.dropna().where(finite)
    cut = usable.select("id", "label", F.transform("v", lambda c: F.floor(c * F.lit(float(scale)))).alias("q"))
    square = F.aggregate("q", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    # Equal rows fold into one on the map side, however many there are.
    return cut.where(square < float(LIMIT)).distinct()


class Block:
    """Whole-number vectors of one side of a cell, padded to a common width."""

    def __init__(self, table: pa.Table, width: int):
        self.ids = table.column("id").to_numpy()
        self.labels = table.column("label").to_numpy()
        lists = table.column("q").combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        lengths = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy()
        self.q = np.zeros((len(lengths), width))
        self.q[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat

    def __len__(self) -> int:
        return len(self.ids)


def width_of(*tables: pa.Table) -> int:
    import pyarrow.compute as pc

    return max((pc.max(pc.list_value_length(t.column("q"))).as_py() or 0 for t in tables if t.num_rows), default=0)


def suffix_norms(q: np.ndarray, edges: list[int]) -> np.ndarray:
    """Norms from each edge on, never too small."""
    tail = np.concatenate([np.cumsum((q * q)[:, ::-1], axis=1)[:, ::-1], np.zeros((len(q), 1))], axis=1)[:, edges]
    return np.sqrt(tail) * (1 + 1e-12) + 1e-9


class Index:
    """Inverted index of a block of rows for thresholds of at least ``floor`` against anchors with these suffix norms."""

    def __init__(self, q: np.ndarray, norms: np.ndarray, edges: list[int], floor: float, most: np.ndarray):
        held = norms * most >= floor  # falls from left to right
        self.depth = np.where(held.any(axis=1), held.shape[1] - np.argmax(held[:, ::-1], axis=1), 0).clip(0, len(edges) - 1)
        self.rows = np.argsort(self.depth, kind="stable")
        self.depth = self.depth[self.rows]
        self.q, self.norms, self.edges = q[self.rows], norms[self.rows], edges

    def search(self, anchors: np.ndarray, anchor_norms: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(row, anchor, score)`` of every pair with a score of at least the anchor's threshold."""
        edges, last = self.edges, len(self.edges) - 1
        partial = np.zeros((len(self.q), len(anchors)))
        listed = None
        for g in range(last):
            a, b = edges[g], edges[g + 1]
            start = int(np.searchsorted(self.depth, g, "right"))  # rows that index this group
            if listed is None:
                if start < len(self.q):
                    partial[start:] += self.q[start:, a:b] @ anchors[:, a:b].T
                # Rows before `start` stopped at their own depth, their bound no longer changes.
                left = self._open(partial, anchor_norms, np.minimum(self.depth, g + 1), thresholds)
                if np.count_nonzero(left) <= SPARSE * left.size:
                    rows, cols = np.nonzero(left)
                    listed = rows, cols, partial[rows, cols]
            else:
                rows, cols, score = listed
                live = self.depth[rows] > g
                score[live] += np.einsum("ij,ij->i", self.q[rows[live], a:b], anchors[cols[live], a:b])
                at = np.minimum(self.depth[rows], g + 1)
                keep = score + self.norms[rows, at] * anchor_norms[cols, at] >= thresholds[cols]
                listed = rows[keep], cols[keep], score[keep]
        if listed is None:
            rows, cols = np.nonzero(self._open(partial, anchor_norms, self.depth, thresholds))
            listed = rows, cols, partial[rows, cols]
        rows, cols, score = listed
        for g in range(last):  # omitted dimensions of what is left
            a, b = edges[g], edges[g + 1]
            rest = self.depth[rows] <= g
            if rest.any():
                score[rest] += np.einsum("ij,ij->i", self.q[rows[rest], a:b], anchors[cols[rest], a:b])
        keep = score >= thresholds[cols]
        return self.rows[rows[keep]], cols[keep], score[keep]

    def _open(self, partial: np.ndarray, anchor_norms: np.ndarray, at: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
        """Whether a pair may still reach its threshold, with rows that have come to edge ``at``."""
        reach = np.take_along_axis(self.norms, at[:, None], 1)
        return partial + reach * anchor_norms.T[at] >= thresholds[None, :]


def ranked(anchor: np.ndarray, score: np.ndarray, ids: np.ndarray, first: int) -> np.ndarray:
    """Positions of the first entries of each anchor by falling score, then rising id."""
    order = np.lexsort((ids, -score, anchor))
    of = anchor[order]
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(order) else np.zeros(0, np.int64)
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[place < first]


def percent_of(x: np.ndarray, percent: int) -> np.ndarray:
    """``percent * x / 100`` rounded down, without passing 64 bits on the way."""
    return percent * (x // 100) + percent * (x % 100) // 100


class Cell:
    """A block of rows against a block of anchors."""

    def __init__(self, rows: Block, anchors: Block, chunk_rows: int = 8192, chunk_anchors: int = 128):
        width = rows.q.shape[1]
        weight = (rows.q * rows.q).sum(axis=0) * (anchors.q * anchors.q).sum(axis=0)
        order = np.argsort(-weight, kind="stable")
        self.rows, self.anchors = rows, anchors
        self.edges = [*range(0, width, GROUP), width] if width else [0, 0]
        self.exact = max(float((rows.q**2).sum(1).max()), float((anchors.q**2).sum(1).max())) < 1 << 53
        self.x, self.y = rows.q[:, order], anchors.q[:, order]
        self.xn, self.yn = suffix_norms(self.x, self.edges), suffix_norms(self.y, self.edges)
        self.chunk_rows, self.chunk_anchors = chunk_rows, chunk_anchors

    def pairs(self, who: np.ndarray, thresholds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(row, anchor, score)`` with scores of at least ``thresholds[anchor]``, chunk by chunk, for the anchors ``who``."""
        for a in range(0, len(who), self.chunk_anchors):
            some = who[a : a + self.chunk_anchors]
            t, y, yn = thresholds[some], self.y[some], self.yn[some]
            for r in range(0, len(self.rows), self.chunk_rows):
                x, xn = self.x[r : r + self.chunk_rows], self.xn[r : r + self.chunk_rows]
                if self.exact:
                    row, col, score = Index(x, xn, self.edges, float(t.min()), yn.max(axis=0)).search(y, yn, t)
                else:  # norms beyond 53 bits: whole scores in whole numbers
                    full = x.astype(np.int64) @ y.astype(np.int64).T
                    row, col = np.nonzero(full >= np.maximum(t, -(2.0**63))[None, :])
                    score = full[row, col]
                yield row + r, some[col], score.astype(np.int64)

    def climb_down(self, who: np.ndarray, floors: np.ndarray, top: np.ndarray, take, full) -> list:
        """Lower the thresholds of anchors until ``full`` or at their floor; what ``take`` makes of the pairs found."""
        out = []
        cap = self.yn[:, 0] * float(self.xn[:, 0].max())
        for rung in (*LADDER, None):
            if not len(who):
                break
            at = floors if rung is None else np.maximum(floors, np.minimum(cap, top) * rung)
            found = None
            for row, col, score in self.pairs(who, at):
                part = take(row, col, score)
                found = part if found is None else {k: np.concatenate([found[k], part[k]]) for k in part}
            found = take(found["row"], found["anchor"], found["score"])
            done = full(found) | (at <= floors)
            settled = np.zeros(len(self.anchors), bool)
            settled[who[done[who]]] = True
            keep = settled[found["anchor"]]
            out.append({k: v[keep] for k, v in found.items()})
            who = who[~done[who]]
        return out


def _positives(first: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = {"anchor_id": [], "id": [], "score": []}
        if rows.num_rows and anchors.num_rows:
            width = width_of(rows, anchors)
            cell = Cell(Block(rows, width), Block(anchors, width))
            r, a = cell.rows, cell.anchors

            def take(row, col, score):
                keep = (r.labels[row] == a.labels[col]) & (r.ids[row] != a.ids[col])
                row, col, score = row[keep], col[keep], score[keep]
                best = ranked(col, score, r.ids[row], first)
                return {"row": row[best], "anchor": col[best], "score": score[best]}

            every, low = np.arange(len(a)), np.full(len(a), -np.inf)
            full = lambda found: np.bincount(found["anchor"], minlength=len(a)) >= first
            for found in cell.climb_down(every, low, np.full(len(a), np.inf), take, full):
                out["anchor_id"].append(a.ids[found["anchor"]])
                out["id"].append(r.ids[found["row"]])
                out["score"].append(found["score"])
        return pa.table({k: pa.array(np.concatenate(v) if v else [], pa.int64()) for k, v in out.items()})

    return run


def _negatives(first: int, low: int, high: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = {"anchor_id": [], "positive_id": [], "positive_score": [], "id": [], "score": []}
        if rows.num_rows and anchors.num_rows:
            width = width_of(rows, anchors)
            cell = Cell(Block(rows, width), Block(anchors, width))
            r, a = cell.rows, cell.anchors
            lists = anchors.column("positives").combine_chunks()
            lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
            ends, flat = lists.offsets.to_numpy(), lists.flatten()
            score_of, id_of = flat.field("score").to_numpy(), flat.field("id").to_numpy()
            many = int(np.diff(ends).max())
            slots = [ends[:-1] + k for k in range(many)]
            has = [np.diff(ends) > k for k in range(many)]
            p = [np.where(h, score_of[np.minimum(s, len(score_of) - 1)], 0) for s, h in zip(slots, has)]
            # Window of a positive score s: low * s <= 100 * score <= high * s, in whole numbers.
            lo = [-percent_of(-x, low) for x in p]
            hi = [percent_of(x, high) for x in p]

            def inside(k, col, score):
                return has[k][col] & (score >= lo[k][col]) & (score <= hi[k][col])

            def take(row, col, score):
                keep = r.labels[row] != a.labels[col]
                row, col, score = row[keep], col[keep], score[keep]
                kept = np.zeros(len(row), bool)
                for k in range(many):
                    at = np.flatnonzero(inside(k, col, score))
                    kept[at[ranked(col[at], score[at], r.ids[row[at]], first)]] = True
                return {"row": row[kept], "anchor": col[kept], "score": score[kept]}

            def full(found):
                done = np.ones(len(a), bool)
                for k in range(many):
                    n = np.bincount(found["anchor"][inside(k, found["anchor"], found["score"])], minlength=len(a))
                    done &= ~has[k] | (n >= first)
                return done

            floors = np.min([np.where(h, x, np.iinfo(np.int64).max) for h, x in zip(has, lo)], axis=0).astype(float)
            top = np.max([np.where(h, x, 0) for h, x in zip(has, hi)], axis=0).astype(float)
            for found in cell.climb_down(np.arange(len(a)), floors, top / LADDER[0], take, full):
                row, col, score = found["row"], found["anchor"], found["score"]
                for k in range(many):
                    at = np.flatnonzero(inside(k, col, score))
                    at = at[ranked(col[at], score[at], r.ids[row[at]], first)]
                    slot = slots[k][col[at]]
                    out["anchor_id"].append(a.ids[col[at]])
                    out["positive_id"].append(id_of[slot])
                    out["positive_score"].append(score_of[slot])
                    out["id"].append(r.ids[row[at]])
                    out["score"].append(score[at])
        return pa.table({k: pa.array(np.concatenate(v) if v else [], pa.int64()) for k, v in out.items()})

    return run


def first_of(rows: DataFrame, by: list[str], first: int, rank: str = "rank") -> DataFrame:
    """The first rows by falling score, then rising id; trimmed on the map side before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= first)


def cells(rows: DataFrame, anchors: DataFrame, grid: tuple[int, int], run, schema: str) -> DataFrame:
    """``run`` on every pair of a block of rows and a block of anchors; ``grid`` is the number of blocks of each."""
    tall, wide = grid
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("id", "label", "q"), F.lit(n)).cast("int")
    left = rows.select("id", "label", "q", dealt(tall).alias("r"), every(wide).alias("c"))
    right = anchors.select(*anchors.columns, dealt(wide).alias("c"), every(tall).alias("r"))
    return left.groupBy("r", "c").cogroup(right.groupBy("r", "c")).applyInArrow(run, schema)


def hard_negatives(
    vectors: DataFrame, every: int, positives: int, negatives: int, low_percent: int, high_percent: int, cell_values: int = CELL_VALUES
) -> DataFrame:
    """Hard negatives of each anchor (rows of ``vectors`` whose id is divisible by ``every``) and positive.

    ``vectors`` is the result of ``quantised``.  Returns ``anchor_id``, ``positive_id``, ``rank``,
    ``negative_id``, ``positive_score``, ``negative_score``: for each of the anchor's first
    ``positives`` other rows of its label, the first ``negatives`` rows of other labels whose
    score is between the two percentages of the positive's.
    """
    vectors = written(vectors, "vectors")
    queries = vectors.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("label", "q")).alias("least"))
    queries = queries.select("id", "least.label", "least.q")
    n_rows, width, n_anchors = vectors.agg(F.count("*"), F.max(F.size("q")), F.countDistinct(F.when(F.col("id") % every == 0, F.col("id")))).first()
    block = max(64, cell_values // max(width or 0, 1))
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grid = max(1, -(-n_rows // block), min(tasks, -(-n_rows // LEAST_ROWS))), max(1, -(-n_anchors // block))

    schema = "anchor_id long, id long, score long"
    near = cells(vectors, queries, grid, _positives(positives), schema)
    near = first_of(near, ["anchor_id"], positives)
    # A window over a score of 0 holds zeros only, one over a negative score nothing.
    lists = near.where("score >= 0").groupBy("anchor_id").agg(F.collect_list(F.struct("id", "score")).alias("positives"))
    asked = written(queries.join(lists.withColumnRenamed("anchor_id", "id"), "id"), "anchors")

    schema = "anchor_id long, positive_id long, positive_score long, id long, score long"
    found = cells(vectors, asked, grid, _negatives(negatives, low_percent, high_percent), schema)
    best = first_of(found, ["anchor_id", "positive_id"], negatives)
    return best.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
