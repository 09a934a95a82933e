"""Problem 4: the most similar vectors for every vector.

Method: additive quantisation. Each vector is assigned to the nearest of a set of coarse centroids and
its residual is encoded by beam search over ``BOOKS`` full-dimensional codebooks, trained stage by
stage on residuals and refitted together by least squares; codes and the norm of the reconstruction
are stored. Every vector is also a query: it visits the cells whose centroid is nearly as similar as
its own cell's (within ``MARGIN``, at most ``PROBES``), scores their codes through lookup tables, and
its best ``RERANK`` candidates of each block are ranked again by exact cosine.

Bound of the fit: centroids and codebooks are trained on at most ``SAMPLE`` vectors chosen by hash;
every vector is indexed and queried. The coarse quantiser is a hierarchy: where the sample is too small
to train a centroid for every ``CELL`` vectors, cells are paths of a centroid and of residual centroids
that all cells share, with as many levels of at most ``FAN`` as the number of rows needs, so cells stay
small at any size; each vector visits at most ``PROBES`` of them, three times as many for each level.

Cells of more than ``HOT`` rows, such as groups of nearly equal vectors, are cut by the first word of the
stored codes into as many parts as their size needs, up to 256; a query visits the ``SUBCELLS`` of them
nearest to it, so its copies stay bounded there too. What is still large is cut into blocks of about ``BLOCK`` rows on both sides, which spreads it over
many tasks. The search runs in as many partitions as its rows need. Exactly equal vectors are one row
of the index with its members; results are expanded to members at the end. ``exact=True`` compares every
vector with all others, block by block: the exact way, for tables small enough for it.

Defined results: nulls, vectors with a null, NaN or infinite component, all-zero vectors and vectors
whose dimension differs from the most frequent one take no part; a chunk is never its own neighbour;
equal similarities are ordered by id; repeated rows of a chunk id count once (the first vector in
array order); with one vector alone there are no rows. Recall is measured in the tests and the README.
"""
from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from skeinlake.llm.common import map_arrow, salted_join, written

K = 5
SAMPLE = 16_384
CELL = 512
BOOKS, WORDS, BEAM = 8, 256, 4
PROBES, MARGIN = 8, 0.12
BLOCK, RERANK = 2048, 96
#: Residual centroids of one level of the coarse quantiser.
FAN = 256
#: Rows from which a cell is cut by its codes, and parts of it that a query visits.
HOT, SUBCELLS = 16_384, 16
#: Rows, own and visiting, of one partition of the search.
PARTITION_ROWS = 16_384


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, spherical: bool = False) -> np.ndarray:
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        score = x @ c.T
        if not spherical:
            score -= 0.5 * (c * c).sum(axis=1)
        near = score.argmax(axis=1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        live = n > 0
        c[live] = sums[live] / n[live, None]
        if not live.all():
            c[~live] = x[rng.choice(len(x), int((~live).sum()))]
        if spherical:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


class Quantizer:
    """Coarse centroids and additive codebooks of one fit."""

    def __init__(self, sample: np.ndarray, cells: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        x = sample.astype(np.float32)
        self.coarse = _kmeans(x, min(cells, max(1, len(x) // 16)), 8, rng, spherical=True)
        r = x - self.coarse[(x @ self.coarse.T).argmax(axis=1)]
        self.levels, left = [], cells / len(self.coarse)
        while left >= 2:
            level = _kmeans(r, min(FAN, int(np.ceil(left))), 8, rng)
            near = np.concatenate([(part @ level.T - 0.5 * (level * level).sum(axis=1)).argmax(axis=1) for part in np.array_split(r, max(1, len(r) // 2048))])
            self.levels.append(level)
            r = r - level[near]
            left /= len(level)
        self._norms()
        r = x - self.centroid(np.concatenate([self._cells(x[s : s + 512])[0] for s in range(0, len(x), 512)]))
        words = max(1, min(WORDS, len(x) // 4))
        books, rest = [], r.copy()
        for _ in range(BOOKS):
            c = _kmeans(rest, words, 6, rng)
            if len(c) < words:
                c = np.concatenate([c, np.zeros((words - len(c), c.shape[1]), np.float32)])
            rest -= c[(rest @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)]
            books.append(c)
        self.books = np.stack(books)
        # refit all codebooks together by least squares on the codes that the beam search finds
        codes = np.concatenate([self._beam(r[s : s + 512]) for s in range(0, len(r), 512)])
        m, k, d = self.books.shape
        gram, target = np.zeros((m * k, m * k)), np.zeros((m * k, d))
        flat = codes.astype(np.int64) + np.arange(m) * k
        for a in range(m):
            np.add.at(target, flat[:, a], r)
            for b in range(m):
                np.add.at(gram, (flat[:, a], flat[:, b]), 1.0)
        # a ridge towards the stage-wise codebooks keeps words that few samples use
        ridge = 1.0
        start = self.books.reshape(m * k, d).astype(np.float64)
        self.books = np.linalg.solve(gram + ridge * np.eye(m * k), target + ridge * start).reshape(m, k, d).astype(np.float32)
        self._group_words()

    def _beam(self, r: np.ndarray) -> np.ndarray:
        n, d = r.shape
        m, k, _ = self.books.shape
        rest, codes, cost = r[:, None, :], np.zeros((n, 1, 0), dtype=np.uint8), None
        for c in self.books:
            half = 0.5 * (c * c).sum(axis=1)
            score = half - rest @ c.T  # half the change of the squared residual
            base = 0.5 * (rest * rest).sum(axis=2)
            total = (base[:, :, None] + score).reshape(n, -1)
            b = min(BEAM, total.shape[1])
            pick = np.argpartition(total, b - 1, axis=1)[:, :b]
            beam, word = pick // k, pick % k
            here = np.arange(n)[:, None]
            rest = rest[here, beam] - c[word]
            codes = np.concatenate([codes[here, beam], word[:, :, None].astype(np.uint8)], axis=2)
        best = (rest * rest).sum(axis=2).argmin(axis=1)
        return codes[np.arange(n), best]

    def _norms(self):
        """Squared norms and inner products of the words of all levels, the coarse centroids first."""
        every = [self.coarse, *self.levels]
        self.products = [[x @ y.T for x in every[:i]] for i, y in enumerate(every)]
        self.squares = [(y * y).sum(axis=1) for y in every]

    def centroid(self, cell) -> np.ndarray:
        """The centroid of each cell: the sum of the words on its path."""
        cell = np.asarray(cell, dtype=np.int64)
        out = 0.0
        for level in reversed(self.levels):
            out = out + level[cell % len(level)]
            cell = cell // len(level)
        return self.coarse[cell] + out

    def _cells(self, v: np.ndarray):
        """The cell of each vector, and the cells to probe: the best paths through the levels, ``PROBES`` of them, three times as many with each level."""
        sims = v @ self.coarse.T
        probes = PROBES * 3 ** len(self.levels)
        p = min(probes, sims.shape[1])
        near = np.argpartition(-sims, p - 1, axis=1)[:, :p]
        dot, square, paths = np.take_along_axis(sims, near, axis=1), self.squares[0][near], [near]
        value, cell = dot, near.astype(np.int64)
        for i, level in enumerate(self.levels, 1):
            n = len(level)
            d = dot[:, :, None] + (v @ level.T)[:, None, :]
            q = square[:, :, None] + self.squares[i] + 2 * sum(self.products[i][j][path] for j, path in enumerate(paths))
            score = (d / np.sqrt(np.maximum(q, 1e-12))).reshape(len(v), -1)
            k = min(probes, score.shape[1])
            top = np.argpartition(-score, k - 1, axis=1)[:, :k]
            up, word = top // n, top % n
            paths = [np.take_along_axis(path, up, axis=1) for path in paths] + [word]
            cell = np.take_along_axis(cell, up, axis=1) * n + word
            dot, square = np.take_along_axis(d.reshape(len(v), -1), top, axis=1), np.take_along_axis(q.reshape(len(v), -1), top, axis=1)
            value = np.take_along_axis(score, top, axis=1)
        best = value.argmax(axis=1)
        here = np.arange(len(v))
        close = value >= value[here, best][:, None] - MARGIN
        return cell[here, best], [cell[i, close[i]] for i in range(len(v))]

    def _group_words(self):
        """Groups of the words of the first codebook, by powers of two from 1 to 256: the group of each word, and the centres."""
        rng = np.random.default_rng(11)
        self.groups = []
        for i in range(9):
            c = _kmeans(self.books[0], 1 << i, 12, rng)
            self.groups.append(((self.books[0] @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1), c))

    def subcells(self, v: np.ndarray, cell: np.ndarray, level: np.ndarray) -> list[list[int]]:
        """The parts of its cell that each vector visits: the groups of first words nearest to its residual."""
        r = v - self.centroid(cell)
        out: list = [None] * len(v)
        for x in np.unique(level):
            at = np.flatnonzero(level == x)
            c = self.groups[x][1]
            cost = 0.5 * (c * c).sum(axis=1) - r[at] @ c.T
            m = min(SUBCELLS, len(c))
            for i, top in zip(at.tolist(), np.argpartition(cost, m - 1, axis=1)[:, :m].tolist()):
                out[i] = top
        return out

    def encode(self, x: np.ndarray):
        """Cell, codes, norm of the reconstruction, and the cells to probe, of unit vectors."""
        cells, codes, norms, probes = [], [], [], []
        for s in range(0, len(x), 512):
            v = x[s : s + 512]
            cell, probe = self._cells(v)
            code = self._beam(v - self.centroid(cell))
            cells.append(cell)
            codes.append(code)
            norms.append(np.linalg.norm(self.reconstruct(cell, code), axis=1))
            probes += probe
        return np.concatenate(cells), np.concatenate(codes), np.concatenate(norms), probes

    def reconstruct(self, cell, codes: np.ndarray) -> np.ndarray:
        out = self.centroid(cell).copy()
        for m in range(self.books.shape[0]):
            out += self.books[m][codes[:, m]]
        return out

    def search(self, queries: np.ndarray, cell: int, codes: np.ndarray, norms: np.ndarray, vectors: np.ndarray, keep: int, rerank: int | None = RERANK):
        """Positions and exact cosines of the best rows of one block for each query, best first; all rows are ranked exactly without ``rerank``."""
        n = len(codes)
        if rerank is None:
            exact = queries.astype(np.float64) @ vectors.astype(np.float64).T
            order = np.argsort(-exact, axis=1, kind="stable")[:, :keep]
            return order, np.take_along_axis(exact, order, axis=1)
        tables = np.einsum("qd,mkd->mqk", queries, self.books, optimize=True)
        first = queries @ self.centroid(cell)
        score = np.repeat(first[:, None], n, axis=1)
        for m in range(len(tables)):
            score += np.take(tables[m], codes[:, m], axis=1)
        score /= np.maximum(norms, 1e-6)
        r = min(rerank, n)
        pick = np.argpartition(-score, r - 1, axis=1)[:, :r] if r < n else np.tile(np.arange(n), (len(queries), 1))
        exact = np.einsum("qd,qrd->qr", queries.astype(np.float64), vectors[pick].astype(np.float64))
        order = np.argsort(-exact, axis=1, kind="stable")[:, :keep]
        return np.take_along_axis(pick, order, axis=1), np.take_along_axis(exact, order, axis=1)


def usable(vectors: DataFrame, key: str, embedding: str) -> DataFrame:
    """``id, v`` of the rows with a usable vector of the most frequent dimension."""
    x = vectors.select(F.col(key).cast("string").alias("id"), F.col(embedding).alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    dims = x.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not dims:
        return x.limit(0)
    finite = ~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return x.filter((F.size("v") == dims[0]["d"]) & finite & F.exists("v", lambda e: e != 0))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float32, copy=False)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def fit(index: DataFrame, sample: int = SAMPLE) -> tuple[Quantizer | None, int]:
    """A quantizer fitted on at most about ``sample`` of the rows ``id, v``, and their number."""
    n = index.count()
    if not n:
        return None, 0
    share = min(1.0, sample / n)
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    chosen = index.filter(place < int(share * (1 << 40)) + 1).select("id", "v")
    rows = chosen.orderBy(F.xxhash64("id"), "id").limit(2 * sample).toArrow()  # by hash too: a bound for the driver that chance does not exceed
    x = _unit(_matrix(rows.column("v")))[np.argsort(rows.column("id").to_numpy(zero_copy_only=False))]
    return Quantizer(x, max(1, n // CELL)), n


NEAR = "array<struct<s:double,id:string,m:boolean>>"


def neighbours(vectors: DataFrame, key: str = "chunk_id", embedding: str = "embedding", k: int = K, exact: bool = False) -> DataFrame:
    """``id, neighbour, similarity, rank``: the k most similar keys of every key by cosine; ``exact`` compares all with all."""
    spark = vectors.sparkSession
    rows = usable(vectors, key, embedding).withColumn("g", F.xxhash64("v", F.lit(1))).withColumn("h", F.xxhash64("v"))
    # equal vectors are one row of the index, named by the least id; m tells that others share it
    index = rows.groupBy("g", "h").agg(F.min(F.struct("id", "v")).alias("x"), F.max("id").alias("last")).select(F.col("x.id").alias("id"), F.col("x.v").alias("v"), "g", "h", (F.col("x.id") != F.col("last")).alias("m"))
    quantizer, _ = fit(rows.select("id", "v"))
    if quantizer is None:
        return spark.createDataFrame([], "id string, neighbour string, similarity double, rank int")
    shared = spark.sparkContext.broadcast(quantizer)

    def encode(b):
        cell, codes, norms, probes = shared.value.encode(_unit(_matrix(b.column(1))))
        if exact:
            cell, probes = np.zeros_like(cell), [np.zeros(1, np.int64)] * len(cell)
        same = {c: b.column(i) for i, c in enumerate(("id", "v", "g", "h", "m"))}
        return same | {"cell": cell, "codes": [c.tobytes() for c in codes], "norm": norms.astype(np.float32), "probes": [p.tolist() for p in probes]}

    coded = written(map_arrow(index, encode, "id string, v array<float>, g long, h long, m boolean, cell long, codes binary, norm float, probes array<long>"))
    base = coded.select("cell", F.lit(-1).alias("sub"), "id", "v", "m", "codes", "norm")
    query = coded.select(F.explode("probes").alias("cell"), F.lit(-1).alias("sub"), "id", "v", "m")
    if not exact:
        size = F.ceil(F.log2(F.col("count") * 4 / HOT))
        hot = written(coded.groupBy("cell").count().filter(F.col("count") > HOT).select("cell", F.least(size, F.lit(8)).cast("int").alias("level")))
        if not hot.isEmpty():

            def visited(b):
                cell, v, level = b.column(0).to_numpy(), _unit(_matrix(b.column(2))), b.column(4).to_numpy()
                return {"cell": b.column(0), "id": b.column(1), "v": b.column(2), "m": b.column(3), "subs": shared.value.subcells(v, cell, level)}

            group = F.from_json(F.lit(json.dumps([g.tolist() for g, _ in quantizer.groups])), "array<array<int>>")
            word = F.conv(F.hex(F.substring("codes", 1, 1)), 16, 10).cast("int")
            part = F.element_at(F.element_at(group, F.col("level") + 1), word + 1)
            base = base.join(hot, "cell", "left_anti").unionByName(base.join(hot, "cell").withColumn("sub", part).drop("level"))
            visits = map_arrow(query.join(hot, "cell").select("cell", "id", "v", "m", "level"), visited, "cell long, id string, v array<float>, m boolean, subs array<int>")
            query = query.join(hot, "cell", "left_anti").unionByName(visits.select("cell", F.explode("subs").alias("sub"), "id", "v", "m"))
    # rows of each cell and visits to it, one row per cell of the fit
    held = base.groupBy("cell", "sub").count()
    visits = query.groupBy("cell", "sub").agg(F.count("*").alias("visits"))
    plan = held.join(visits, ["cell", "sub"], "left").select("cell", "sub", "count", F.coalesce("visits", F.lit(0)).alias("visits"), F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"), F.greatest(F.ceil(F.coalesce("visits", F.lit(0)) / (8 * BLOCK)), F.lit(1)).cast("int").alias("sides"))
    plan = written(plan)
    load = plan.agg(F.sum(F.col("count") * F.col("sides") + F.col("visits") * F.col("blocks")).alias("rows")).first()["rows"]
    place = F.xxhash64("id")
    shape = plan.select("cell", "sub", "blocks", "sides")
    base = base.join(shape, ["cell", "sub"]).select(
        "cell", "sub", F.pmod(place, F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("side"), "id", "v", "m", "codes", "norm"
    )
    query = query.join(shape, ["cell", "sub"]).select(
        "cell", "sub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(place, F.col("sides")).cast("int").alias("side"), "id", "v", "m",
        F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("float").alias("norm"),
    )

    def search(t: pa.Table) -> pa.Table:
        q = shared.value
        is_base = t.column("codes").is_valid().to_numpy()
        ids, multiple = t.column("id").to_numpy(), t.column("m").to_numpy()
        vectors = _unit(_matrix(t.column("v")))
        cell = t.column("cell")[0].as_py()
        own, ask = np.flatnonzero(is_base), np.flatnonzero(~is_base)
        codes = np.frombuffer(b"".join(c for c in t.column("codes").to_pylist() if c is not None), dtype=np.uint8).reshape(len(own), -1)
        norms = t.column("norm").to_numpy()[own].astype(np.float32)
        order = np.argsort(ids[own], kind="stable")
        own, codes, norms = own[order], codes[order], norms[order]
        offsets, near, sims = [np.zeros(1, np.int64)], [], []
        for s in range(0, len(ask) if len(own) else 0, 512):
            part = ask[s : s + 512]
            at, sim = q.search(vectors[part], cell, codes, norms, vectors[own], k + 1, None if exact else RERANK)
            other = own[at]
            ok = ids[other] != ids[part][:, None]
            ok &= np.cumsum(ok, axis=1) <= k
            near.append(other[ok])
            sims.append(sim[ok])
            offsets.append(offsets[-1][-1] + np.cumsum(ok.sum(axis=1)))
        ask = ask if len(own) else ask[:0]
        near = np.concatenate([*near, np.zeros(0, np.int64)]).astype(np.int64)
        items = pa.StructArray.from_arrays([pa.array(-np.concatenate([*sims, np.zeros(0)])), pa.array(ids[near], pa.string()), pa.array(multiple[near].astype(bool))], ["s", "id", "m"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(offsets), pa.int32()), items)
        return pa.table({"id": pa.array(ids[ask], pa.string()), "m": pa.array(multiple[ask].astype(bool)), "near": lists})

    groups = ["cell", "sub", "block", "side"]
    rows_of = base.unionByName(query).repartition(max(1, -(-int(load or 0) // PARTITION_ROWS)), *groups)
    found = rows_of.groupBy(*groups).applyInArrow(search, f"id string, m boolean, near {NEAR}")
    near = found.groupBy("id").agg(F.first("m").alias("m"), F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    return _expand(near, rows.select("id", "g", "h"), coded.filter("m").select(F.col("id").alias("head"), "g", "h"), k)


def _expand(near: DataFrame, rows: DataFrame, heads: DataFrame, k: int) -> DataFrame:
    """From neighbours between distinct vectors to neighbours between all keys; equal vectors come first.

    Keys that share a vector are few in ordinary data: only they, and rows that have them as
    neighbours, take part in the joins below. Of each such vector the first ``k + 1`` keys are enough.
    """
    shared = heads.join(rows.groupBy("id").agg(F.min(F.struct("g", "h")).alias("x")).select("id", "x.g", "x.h"), ["g", "h"]).select("head", "id")
    ranked = shared.withColumn("no", F.row_number().over(Window.partitionBy("head").orderBy("id"))).filter(F.col("no") <= k + 1)
    few = ranked.groupBy("head").agg(F.array_sort(F.collect_list("id")).alias("few"))
    touched = F.exists("near", lambda x: x["m"])
    near = written(near)
    plain = near.filter(~F.col("m") & ~touched).select("id", "near")
    other = near.filter(F.col("m") | touched)
    each = other.select(F.col("id").alias("head"), F.explode("near").alias("x")).select("head", F.col("x.s").alias("s"), F.col("x.id").alias("to"))
    far = (
        each.join(few.select(F.col("head").alias("to"), "few"), "to", "left")
        .select("head", "s", F.explode(F.coalesce("few", F.array("to"))).alias("id"))
        .groupBy("head")
        .agg(F.slice(F.array_sort(F.collect_list(F.struct("s", "id"))), 1, k).alias("far"))
    )
    none = F.array().cast("array<struct<s:double,id:string>>")
    single = other.filter(~F.col("m")).select(F.col("id").alias("head")).join(far, "head").select(F.col("head").alias("id"), F.col("far").alias("all"))
    lists = few.join(far, "head", "left").select("head", F.concat(F.transform("few", lambda i: F.struct(F.lit(-1.0).alias("s"), i.alias("id"))), F.coalesce("far", none)).alias("all"))
    copies = salted_join(shared, lists, "head").select("id", F.slice(F.filter("all", lambda x: x["id"] != F.col("id")), 1, k).alias("all"))
    bare = plain.select("id", F.transform("near", lambda x: F.struct(x["s"].alias("s"), x["id"].alias("id"))).alias("all"))
    out = bare.unionByName(single).unionByName(copies).select("id", F.posexplode("all").alias("pos", "x"))
    return out.select("id", F.col("x.id").alias("neighbour"), F.least(F.lit(1.0), -F.col("x.s")).alias("similarity"), (F.col("pos") + 1).alias("rank"))


def similar_pairs(near: DataFrame, least: float) -> DataFrame:
    """``chunk_id_a, chunk_id_b, similarity`` of pairs above a cosine of which one is a neighbour of the other."""
    a, b = F.least("id", "neighbour"), F.greatest("id", "neighbour")
    return near.filter(F.col("similarity") > least).groupBy(a.alias("chunk_id_a"), b.alias("chunk_id_b")).agg(F.max("similarity").alias("similarity"))
