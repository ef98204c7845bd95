"""Exact top-k by inner product with a paged M-tree (operator 6).

Components become integers, floor(scale * x), so scores are exact.

The tree.  Routing vectors of the top level are spread over a bounded sample by
farthest-first choice; every row belongs to its nearest one, and a routing vector
that draws more than a group of rows has several groups, dealt by hash.  Each
group is built once into pages of entries with a routing vector, its covering
radius and its distance to the page's own routing vector, and the pages are
written as a table.

The search.  With |q| a query's norm and r a radius, nothing below a routing vector
c can score over q.c + |q| r; and since |d(q, p) - d(c, p)| <= d(q, c) for the parent
p, q.c is bounded before it is computed.  Each query first goes, best first, through
the groups of the routing vector of its highest bound; then, with the k-th score
found there, through those of all others whose bounds reach it.  Entries whose
bound is below the k-th score so far are passed over.
"""

from __future__ import annotations

import heapq
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import list_array
from .shared import written

PAGE, FANOUT = 1024, 16
#: Rows of a group, and queries that meet a group in one task.
GROUP_ROWS, BLOCK_QUERIES = 16384, 16384
#: Components of all rows that the top level's routing vectors are chosen from, and of all these vectors, at most (32 and 8 MB).
SAMPLE_COMPONENTS, ROUTE_COMPONENTS = 1 << 22, 1 << 20
SAMPLE_ROWS = 16384
#: Largest integer up to which sums of products are exact in a double; size of a scaled component that takes part.
EXACT, LARGEST = float(1 << 53), 1e150
LONG = (1 << 63) - 1
#: Added to scores beyond a long, whose text is then ordered as they are.
SHIFT = 10**320


@dataclass
class Page:
    """Entries: vectors, their norms' squares and distances to the page's own routing vector; children and radii, or in a leaf ids and times."""

    vectors: np.ndarray
    squares: np.ndarray
    to_parent: np.ndarray
    radii: np.ndarray | None = None
    children: np.ndarray | None = None
    ids: np.ndarray | None = None
    times: np.ndarray | None = None


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def spread(x: np.ndarray, n: int) -> tuple[list[int], np.ndarray]:
    """Rows chosen farthest first, at most n, and each row's nearest one."""
    chosen, near, best = [0], np.zeros(len(x), np.int64), distances(x, x[0])
    while len(chosen) < n and best.max(initial=0) > 0:
        chosen.append(int(best.argmax()))
        d = distances(x, x[chosen[-1]])
        closer = d < best
        near[closer], best[closer] = len(chosen) - 1, d[closer]
    return chosen, near


def build(x: np.ndarray, ids: np.ndarray, times: np.ndarray) -> list[Page]:
    """Pages of a tree over all rows, the root first, whose own routing vector is the first row; bulk loaded, every row below its nearest routing vector."""
    pages: list[Page] = []

    def grow(rows: np.ndarray, own: np.ndarray) -> int:
        number = len(pages)
        pages.append(None)  # its place; children come after it
        part = x[rows]
        if len(rows) <= PAGE:
            pages[number] = Page(part, np.einsum("ij,ij->i", part, part), distances(part, own), ids=ids[rows], times=times[rows])
            return number
        chosen, near = spread(part, FANOUT)
        if len(chosen) == 1:  # rows alike: the pages are cut by number
            pieces = np.array_split(rows, min(FANOUT, -(-len(rows) // PAGE)))
            routes = np.repeat(part[:1], len(pieces), axis=0)
        else:
            pieces = [rows[near == k] for k in range(len(chosen))]
            routes = part[chosen]
        radii = np.array([distances(x[p], r).max() for p, r in zip(pieces, routes, strict=True)])
        children = np.array([grow(p, r) for p, r in zip(pieces, routes, strict=True)])
        pages[number] = Page(routes, np.einsum("ij,ij->i", routes, routes), distances(routes, own), radii, children)
        return number

    if len(x):
        grow(np.arange(len(x)), x[0])
    return pages


class Search:
    """Best-first search of one tree; ``computed`` counts the inner products."""

    def __init__(self, pages: list[Page], k: int):
        self.pages, self.k, self.computed = pages, k, 0
        self.own = pages[0].vectors[0] if pages else None
        self.highest = max((float(np.abs(p.vectors).max(initial=0)) for p in pages), default=0.0)

    def top(self, q: np.ndarray, own: int, least: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, id) of at least ``least``, ties to the smaller id; one row equal to the query in id and vector is the query itself."""
        square = float(q @ q)
        norm = square**0.5
        wide = self.highest * float(np.abs(q).max(initial=0)) * len(q) >= EXACT  # sums in doubles may round
        best: list[tuple[int, int]] = []  # heap of (score, -id), the worst first
        skipped, n = False, 0
        floor = -np.inf if least is None else float(least) * (1 - np.sign(least) * 1e-12)
        queue = [(-np.inf, 0, float(distances(q[None], self.own)[0]), 0)] if self.pages else []
        while queue:
            bound, _, to_parent, number = heapq.heappop(queue)
            if -bound < floor:
                break
            page = self.pages[number]
            slack = 1e-9 * (square + page.squares + 1)
            gap = np.abs(to_parent - page.to_parent)
            most = (square + page.squares - gap * gap) / 2 + slack
            if page.radii is not None:
                most = most + norm * page.radii * (1 + 1e-9)
            some = np.flatnonzero(most >= floor)
            if not len(some):
                continue
            if 2 * len(some) > len(most):  # most of a page: all of it is cheaper than a copy of what is left
                self.computed += len(most)
                product = (page.vectors @ q)[some]
            else:
                self.computed += len(some)
                product = page.vectors[some] @ q
            if page.radii is None:
                good = np.flatnonzero(product + (slack[some] if wide else 0) >= floor)
                for j, score in zip(some[good].tolist(), product[good].tolist(), strict=True):
                    if not wide and len(best) == self.k and score < best[0][0]:
                        continue
                    i, times = int(page.ids[j]), int(page.times[j])
                    if i == own and not skipped and (page.vectors[j] == q).all():
                        times, skipped = times - 1, True
                    entry = (exact_product(page.vectors[j], q) if wide else int(score), -i)
                    if least is not None and entry[0] < least:
                        continue
                    for _ in range(min(times, self.k)):
                        if len(best) < self.k:
                            heapq.heappush(best, entry)
                        elif entry > best[0]:
                            heapq.heapreplace(best, entry)
                if len(best) == self.k:
                    floor = max(floor, float(best[0][0]) * (1 - np.sign(best[0][0]) * 1e-12))
                continue
            upper = product + norm * page.radii[some] * (1 + 1e-9) + slack[some]
            away = distances(page.vectors[some], q) if wide else np.sqrt(np.maximum(square + page.squares[some] - 2 * product, 0))
            for j, u, d in zip(some.tolist(), upper.tolist(), away.tolist(), strict=True):
                if u >= floor:
                    n += 1
                    heapq.heappush(queue, (-u, n, d, int(page.children[j])))
        return [(s, -i) for s, i in sorted(best, key=lambda t: (-t[0], -t[1]))]


def exact_product(a: np.ndarray, b: np.ndarray) -> int:
    return sum(int(x) * int(y) for x, y in zip(a.tolist(), b.tolist(), strict=True))


def matrix(vectors: pa.Array, size: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def taking_part(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, size, x, times): rows that take part, equal ones once with their number.  x: the scaled integers, in doubles."""
    sound = F.col("id").isNotNull() & F.col("raw").isNotNull() & (F.size("raw") > 0) & F.forall("raw", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(LARGEST / scale)))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("raw")).where(sound)
    counted = rows.groupBy("id", "raw").agg(F.count(F.lit(1)).alias("times"))

    def run(batches):
        for batch in batches:
            raw = batch.column(1)
            size = np.diff(raw.offsets.to_numpy())
            x = np.floor(float(scale) * raw.flatten().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size.astype(np.int32)), list_array(x, size, pa.float64()), batch.column(2)], names=["id", "size", "x", "times"])

    return counted.mapInArrow(run, "id long, size int, x array<double>, times long")


def routing(rows: DataFrame) -> dict[int, np.ndarray]:
    """Routing vectors of the top level by vectors' size, from the rows of the smallest hashes."""
    n, longest = rows.agg(F.count(F.lit(1)), F.max("size")).first()
    if not n:
        return {}
    order = F.xxhash64("id", "x")
    some = rows.orderBy(order).limit(max(1, min(SAMPLE_ROWS, SAMPLE_COMPONENTS // longest))).select("size", "x").toArrow()
    sizes, out = some["size"].to_numpy(), {}
    for size in np.unique(sizes).tolist():
        x = matrix(some["x"].combine_chunks().take(pa.array(np.flatnonzero(sizes == size))), size)
        out[size] = x[spread(x, max(1, min(-(-n // GROUP_ROWS), ROUTE_COMPONENTS // longest)))[0]]
    return out


def routed(rows: DataFrame, routes: dict[int, np.ndarray]) -> DataFrame:
    """rows with ``route``, the nearest routing vector (-1 where the sample has none of that size), and ``away``, the distance to it."""
    schema = T.StructType([*rows.schema.fields, T.StructField("route", T.IntegerType()), T.StructField("away", T.DoubleType())])
    shared = rows.sparkSession.sparkContext.broadcast(routes)

    def run(batches):
        for batch in batches:
            size = batch.column(1).to_numpy()
            route, away = np.full(len(size), -1, np.int32), np.zeros(len(size))
            for s in np.unique(size).tolist():
                at = np.flatnonzero(size == s)
                x, best = matrix(batch.column(2).take(pa.array(at)), s), np.full(len(at), np.inf)
                for k, c in enumerate(shared.value.get(s, ())):
                    d = distances(x, c)
                    closer = d < best
                    route[at[closer]], best[closer] = k, d[closer]
                away[at] = np.where(np.isfinite(best), best, 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(route), pa.array(away)], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def pages_of(key: tuple, table: pa.Table) -> pa.Table:
    """The pages of one group's tree, a row each."""
    pages = build(matrix(table["x"].combine_chunks(), key[0].as_py()), table["id"].to_numpy(), table["times"].to_numpy())
    n = len(pages)
    return pa.table([pa.array([key[j].as_py()] * n, pa.int32()) for j in range(3)] + [pa.array(range(n), pa.int32()), pa.array([pickle.dumps(p) for p in pages], pa.binary())], names=["size", "route", "g", "page", "body"])


def goals(asked: DataFrame, routes: dict[int, np.ndarray], top: dict[tuple[int, int], tuple[float, int]], first: bool) -> DataFrame:
    """Queries with a row for each group that they go to: one group of the route of the highest bound, or all others whose bound reaches ``least``."""
    shared = asked.sparkSession.sparkContext.broadcast((routes, top))
    kind = pa.list_(pa.struct([("route", pa.int32()), ("g", pa.int32())]))
    schema = T.StructType([*asked.schema.fields, T.StructField("to", T.ArrayType(T.StructType([T.StructField("route", T.IntegerType()), T.StructField("g", T.IntegerType())])))])

    def run(batches):
        routes, top = shared.value
        known = {}
        for size in {s for s, _ in top}:
            of_size = sorted(r for s, r in top if s == size)
            centers = np.array([routes[size][r] if r >= 0 else np.zeros(size) for r in of_size])
            known[size] = of_size, centers, np.array([top[size, r][0] if r >= 0 else np.inf for r in of_size]), [top[size, r][1] for r in of_size], np.sqrt((centers**2).sum(axis=1))
        for batch in batches:
            out = []
            for i, x, size, least in zip(batch["id"].to_pylist(), batch["x"], batch["size"].to_pylist(), lowest(batch), strict=True):
                of_size, centers, radii, groups, norms = known[size]
                q = x.values.to_numpy()
                norm = float(np.sqrt(q @ q))
                bound = centers @ q + norm * radii * (1 + 1e-9) + 1e-9 * (1 + norm * norms)
                best = int(bound.argmax())
                start = (of_size[best], i % groups[best])
                if first:
                    out.append([{"route": start[0], "g": start[1]}])
                else:
                    floor = -np.inf if least is None else float(least) * (1 - np.sign(least) * 1e-12)
                    out.append([{"route": of_size[r], "g": g} for r in np.flatnonzero(bound >= floor).tolist() for g in range(groups[r]) if (of_size[r], g) != start])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=schema.fieldNames())

    return asked.mapInArrow(run, schema).select("*", F.explode("to").alias("goal")).select(*asked.columns, "goal.route", "goal.g")


def lowest(batch) -> list[int | None]:
    """``least`` of each row as an integer of any size."""
    return [s if w is None else int(w) - SHIFT for s, w in zip(batch["least"].to_pylist(), batch["least_wide"].to_pylist(), strict=True)]


def found(tree: DataFrame, wanted: DataFrame, blocks: int, k: int) -> DataFrame:
    """(query_id, query, vec_id, score, wide): at most k rows of each group that a query goes to.

    A group's pages go to the blocks of queries that ask for it, and to no others.
    """
    schema = "query_id long, query long, vec_id long, score long, wide string"
    wanted = written(wanted.withColumn("b", F.pmod("query", F.lit(blocks)).cast("int")), "goals")
    asked = wanted.select(*[F.col(c).alias(f"to_{c}") for c in ("size", "route", "g", "b")]).distinct()
    same = (F.col("size") == F.col("to_size")) & (F.col("route") == F.col("to_route")) & (F.col("g") == F.col("to_g"))
    spread_out = tree.join(asked, same).select(*tree.columns, F.col("to_b").alias("b"))

    def run(key: tuple, pages: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if pages.num_rows and queries.num_rows:
            bodies = dict(zip(pages["page"].to_pylist(), pages["body"], strict=True))
            search = Search([pickle.loads(bodies[j].as_py()) for j in range(len(bodies))], k)  # noqa: S301 written by pages_of
            x = matrix(queries["x"].combine_chunks(), key[0].as_py())
            for q, own, query, least in zip(x, queries["id"].to_pylist(), queries["query"].to_pylist(), lowest(queries), strict=True):
                out += [(own, query, i, max(-LONG - 1, min(s, LONG)), None if -LONG - 1 <= s <= LONG else f"{s + SHIFT:0321d}") for s, i in search.top(q, own, least)]
        return pa.table([pa.array([r[j] for r in out], t) for j, t in enumerate([pa.int64()] * 4 + [pa.string()])], names=["query_id", "query", "vec_id", "score", "wide"])

    keys = ["size", "route", "g", "b"]
    return spread_out.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInArrow(run, schema)


def ranked(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), F.desc("wide"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k highest scores of each query against every row but itself.

    Queries are the rows whose id is divisible by ``every``.  Returns ``query_id,
    rank, vec_id, score``.  Rows without id or vector, with an empty vector, or with a
    component that is null or not finite (or scales to 1e150 and more, which a column
    of floats can't) take no part; vectors of different lengths aren't compared.
    Rows that repeat are candidates and queries of their own.  Ties go to the
    smaller id.  Scores are compared as integers of any size; one beyond a long is
    given as the nearest long.  An empty table gives no rows, extra columns are
    ignored.

    The tree is built once.  A query goes only to groups that its bound reaches,
    and each returns at most k rows a query.
    """
    rows = written(taking_part(vectors, id_col, vector_col, scale), "vectors")
    routes = routing(rows)
    near = written(routed(rows, routes), "routed")
    # the top level, a bounded number of rows: radius and number of groups of every routing vector
    top = {(r["size"], r["route"]): (r["radius"], -(-r["n"] // GROUP_ROWS)) for r in near.groupBy("size", "route").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n")).collect()}
    groups = vectors.sparkSession.createDataFrame([(s, r, g) for (s, r), (_, g) in top.items()], "size int, route int, groups int")
    dealt = near.join(F.broadcast(groups), ["size", "route"]).withColumn("g", F.pmod(F.xxhash64("id", "x"), "groups").cast("int"))
    tree = written(dealt.groupBy("size", "route", "g").applyInArrow(pages_of, "size int, route int, g int, page int, body binary"), "pages")
    asked = near.where(F.pmod("id", F.lit(every)) == 0).select("id", "size", "x", "times", F.xxhash64("id", "x").alias("query"))
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    begin = asked.withColumn("least", F.lit(None).cast("long")).withColumn("least_wide", F.lit(None).cast("string"))
    first = written(ranked(found(tree, goals(begin, routes, top, True), blocks, k), k), "first-found")
    least = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), "query", F.col("score").alias("least"), F.col("wide").alias("least_wide"))
    second = found(tree, goals(asked.join(least, ["id", "query"], "left"), routes, top, False), blocks, k)
    best = ranked(first.drop("rank").unionByName(second), k)
    copies = asked.select(F.col("id").alias("query_id"), "query", F.sequence(F.lit(1).cast("long"), "times").alias("copies"))
    return best.join(copies, ["query_id", "query"]).select("query_id", "rank", "vec_id", "score", F.explode("copies").alias("copy")).drop("copy")
