"""Covariances and principal components of very many series, by tiles of a matrix that no machine holds.

Keys are dealt to blocks and dates to spans by their hashes. A block's values over a span are one
dense matrix, NaN where a key has no value. A tile is a pair of blocks; its products over all spans
are matrix products, summed first per group of spans and then per tile. So there is never a row per
date and pair. Statistics use the dates that both keys of a pair have (pairwise complete).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpointed

#: Keys of a block and dates of a span, about; spans whose products are summed in one go.
BLOCK, SPAN, GROUP = 256, 512, 16
#: What is summed per pair: common dates; values of either key, their squares and the product on those dates.
SUMS = 6


def dealt(names: DataFrame, column: str, size: int, number: str, place: str, width: str) -> DataFrame:
    """names with a block number, a place in the block, and the block's width. Windows here are as small as blocks."""
    blocks = max(1, -(-names.count() // size))
    by_block = Window.partitionBy(number)
    placed = names.withColumn(number, F.pmod(F.xxhash64(column), F.lit(blocks)))
    return placed.withColumn(place, F.row_number().over(by_block.orderBy(column)) - 1).withColumn(width, F.count(F.lit(1)).over(by_block))


def blocks_of(series: DataFrame, block: int, span: int) -> tuple[DataFrame, DataFrame]:
    """Rows (b, d, x, width) of series (k, date, v): x the dense values of block b over span d, as bytes by rows of dates. And rows (b, names).

    Values are less their key's mean over all its dates, which keeps the sums of products short of digits
    lost. Of rows that repeat key and date one counts.
    """
    keys = checkpointed(dealt(series.groupBy("k").agg(F.avg("v").alias("mean")), "k", block, "b", "r", "width"))
    dates = checkpointed(dealt(series.select("date").distinct(), "date", span, "d", "s", "height"))
    placed = series.join(keys, "k").join(dates, "date").select("b", "d", "r", "s", (F.col("v") - F.col("mean")).alias("v"), "width", "height")
    gathered = placed.groupBy("b", "d", "width", "height").agg(F.collect_list("r").alias("r"), F.collect_list("s").alias("s"), F.collect_list("v").alias("v"))

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b, d, width, height = (batch.column(n)[i].as_py() for n in ("b", "d", "width", "height"))
                x = np.full((height, width), np.nan)
                x[batch.column("s")[i].values.to_numpy(), batch.column("r")[i].values.to_numpy()] = batch.column("v")[i].values.to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([d]), pa.array([x.tobytes()]), pa.array([width])], ["b", "d", "x", "width"])

    names = keys.groupBy("b").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "k"))), lambda e: e["k"]).alias("names"))
    return gathered.mapInArrow(dense, "b long, d long, x binary, width long"), names


def products(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The sums of SUMS over the dates of two dense blocks, for every pair of their keys."""
    m, n = (~np.isnan(a) for a in (one, other))
    x, y = np.where(m, one, 0.0), np.where(n, other, 0.0)
    m, n = m.astype(float), n.astype(float)
    return np.stack([m.T @ n, x.T @ n, m.T @ y, (x * x).T @ n, m.T @ (y * y), x.T @ y])


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Key and rows of each run of equal keys in batches sorted by key; a run has to be read before the next."""
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in [*keys, *columns])))
    held = next(rows, None)

    def own(key: tuple) -> Iterator[tuple]:
        nonlocal held
        while held is not None and held[: len(keys)] == key:
            yield held[len(keys) :]
            held = next(rows, None)

    while held is not None:
        yield held[: len(keys)], own(held[: len(keys)])


TILE = "lo long, hi long, width long, height long, sums binary"


def tile_row(lo: int, hi: int, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lo]), pa.array([hi]), pa.array([sums.shape[1]]), pa.array([sums.shape[2]]), pa.array([sums.tobytes()])], ["lo", "hi", "width", "height", "sums"])


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles of equal lo and hi added up."""
    for (lo, hi), rows in runs(batches, ["lo", "hi"], ["width", "height", "sums"]):
        total = None
        for width, height, data in rows:
            part = np.frombuffer(data).reshape(-1, width, height)
            total = part if total is None else total + part
        yield tile_row(lo, hi, total)


def tiles(series: DataFrame, key: str, value: str, block: int = BLOCK, span: int = SPAN, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """Rows (lo, hi, width, height, sums), lo <= hi: the sums of every pair of keys of two blocks. And rows (b, names) of the blocks.

    Each block's matrices go once to each tile they belong to; a task takes the two of a span at a time.
    """
    held = series.where(F.col(key).isNotNull() & F.col("date").isNotNull() & F.col(value).isNotNull() & ~F.isnan(value))
    made, names = blocks_of(held.select(F.col(key).alias("k"), "date", F.col(value).cast("double").alias("v")), block, span)
    made, names = checkpointed(made), checkpointed(names)
    blocks = (names.agg(F.max("b")).first()[0] or 0) + 1
    copies = made.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    sent = copies.select(F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), F.floor(F.col("d") / group).alias("g"), "d", (F.col("b") > F.col("o")).alias("second"), "x", "width")

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (lo, hi, _), rows in runs(batches, ["lo", "hi", "g"], ["d", "second", "x", "width"]):
            total, at, first = None, None, None
            for d, second, x, width in rows:
                now = np.frombuffer(x).reshape(-1, width)
                if lo == hi:
                    part = products(now, now)
                elif not second:
                    at, first = d, now
                    continue
                elif d != at:  # the other block has nothing in this span
                    continue
                else:
                    part = products(first, now)
                total = part if total is None else total + part
            if total is not None:
                yield tile_row(lo, hi, total)

    parts = sent.repartition("lo", "hi", "g").sortWithinPartitions("lo", "hi", "g", "d", "second").mapInArrow(multiplied, TILE)
    return parts.repartition("lo", "hi").sortWithinPartitions("lo", "hi").mapInArrow(summed, TILE), names


def divided(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, NaN where b is not above zero."""
    return np.divide(a, b, out=np.full(a.shape, np.nan), where=b > 0)


def covariances(sums: np.ndarray) -> np.ndarray:
    n, x, y, _, _, xy = sums
    return divided(xy - divided(x * y, n), n - 1)


def correlations(sums: np.ndarray) -> np.ndarray:
    n, x, y, xx, yy, xy = sums
    own, other = np.maximum(0, xx - divided(x * x, n)), np.maximum(0, yy - divided(y * y, n))
    return np.where(n > 1, divided(xy - divided(x * y, n), np.sqrt(own * other)), np.nan)


def pairs(series: DataFrame, key: str, value: str, statistic: Callable[[np.ndarray], np.ndarray], name: str, **sizes: int) -> DataFrame:
    """(f1, f2, n, statistic), f1 <= f2, of all pairs of keys with a common date; NULL where it is not defined."""
    made, names = tiles(series, key, value, **sizes)
    named = made.join(names.select(F.col("b").alias("lo"), F.col("names").alias("own")), "lo").join(names.select(F.col("b").alias("hi"), F.col("names").alias("others")), "hi")
    kind = names.schema["names"].dataType.elementType.simpleString()

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lo, hi, width, height = (batch.column(c)[i].as_py() for c in ("lo", "hi", "width", "height"))
                sums = np.frombuffer(batch.column("sums")[i].as_py()).reshape(SUMS, width, height)
                one, other = batch.column("own")[i].values, batch.column("others")[i].values
                a, b = np.nonzero((sums[0] > 0) & (np.triu(np.ones((width, height), bool)) if lo == hi else True))
                found = statistic(sums)[a, b]
                yield pa.RecordBatch.from_arrays([one.take(pa.array(a)), other.take(pa.array(b)), pa.array(sums[0][a, b].astype(np.int64)), pa.array(found, mask=np.isnan(found))], ["x", "y", "n", name])

    rows = named.mapInArrow(long, f"x {kind}, y {kind}, n long, {name} double")
    return rows.select(F.least("x", "y").alias("f1"), F.greatest("x", "y").alias("f2"), "n", name)


def covariance_matrix(series: DataFrame, key: str = "asset", value: str = "ret", **sizes: int) -> DataFrame:
    """(f1, f2, n, cov), f1 <= f2: sample covariances of all pairs, NULL with one common date.

    Empty tables give an empty result; NULL and NaN values count as missing.
    """
    return pairs(series, key, value, covariances, "cov", **sizes)


def correlation_matrix(series: DataFrame, key: str = "asset", value: str = "ret", **sizes: int) -> DataFrame:
    """(f1, f2, n, corr), f1 <= f2; NULL with one common date or where a key is constant on the common dates."""
    return pairs(series, key, value, correlations, "corr", **sizes)


#: Columns beside the wanted ones that the iteration carries; it stops when residuals are below CLOSE times the largest value, and then goes on for as many rounds again.
MORE, CLOSE, MOST = 20, 1e-6, 200
NARROW = "b long, w long, data binary"


def narrow_row(b: int, m: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b]), pa.array([m.shape[1]]), pa.array([m.tobytes()])], ["b", "w", "data"])


def multiplied_by(matrix: DataFrame, narrow: DataFrame) -> DataFrame:
    """The symmetric matrix of tiles (lo, hi, width, height, cov) times a narrow one of blocks (b, w, data)."""

    def times(turn: bool, to: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b, width, height, c, w, q in zip(*(batch.column(n).to_pylist() for n in (to, "width", "height", "cov", "w", "data"))):
                    c = np.frombuffer(c).reshape(width, height)
                    yield narrow_row(b, (c.T if turn else c) @ np.frombuffer(q).reshape(-1, w))

        return run

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (b, w), rows in runs(batches, ["b", "w"], ["data"]):
            total = 0
            for (data,) in rows:
                total = total + np.frombuffer(data).reshape(-1, w)
            yield narrow_row(b, total)

    right = matrix.join(narrow.withColumnRenamed("b", "hi"), "hi").mapInArrow(times(False, "lo"), NARROW)
    left = matrix.where("lo < hi").join(narrow.withColumnRenamed("b", "lo"), "lo").mapInArrow(times(True, "hi"), NARROW)
    return right.unionByName(left).repartition("b").sortWithinPartitions("b", "w").mapInArrow(added, NARROW)


def grams(q: DataFrame, y: DataFrame, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Q'Q, Q'Y, Y'Y and the column sums of Q, summed over the blocks in Spark; w columns each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3 * w + 1, w))
        for batch in batches:
            for a, c in zip(batch.column("data").to_pylist(), batch.column("y").to_pylist()):
                a, c = np.frombuffer(a).reshape(-1, w), np.frombuffer(c).reshape(-1, w)
                total += np.concatenate([a.T @ a, a.T @ c, c.T @ c, a.sum(axis=0)[None]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["i", "v"])

    both = q.join(y.select("b", F.col("data").alias("y")), "b").mapInArrow(run, "i long, v double")
    out = np.zeros((3 * w + 1) * w)
    for r in both.groupBy("i").agg(F.sum("v").alias("v")).collect():  # of w, not of the number of keys
        out[r["i"]] = r["v"]
    out = out.reshape(-1, w)
    return out[:w], out[w : 2 * w], out[2 * w : 3 * w], out[3 * w]


def turned(narrow: DataFrame, by: np.ndarray) -> DataFrame:
    """Every block of a narrow matrix times a small one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, data in zip(batch.column("b").to_pylist(), batch.column("data").to_pylist()):
                yield narrow_row(b, np.frombuffer(data).reshape(-1, len(by)) @ by)

    return narrow.mapInArrow(run, NARROW)


def whitening(gram: np.ndarray) -> np.ndarray:
    """A small matrix S with S' gram S = 1; directions of no length are left out."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    keep = values > 1e-13 * max(values.max(), 1e-300)
    return vectors[:, keep] / np.sqrt(values[keep])


def principal_components(series: DataFrame, k: int, key: str = "asset", value: str = "ret", seed: int = 1, **sizes: int) -> DataFrame:
    """(component, share, key, loading): the k leading eigenvectors of the pairwise complete covariance matrix.

    Subspace iteration from a random matrix of k + MORE columns: the tiles times its blocks, then the
    columns are made orthogonal through their small Gram matrix, the one thing that the driver sees.
    share is the eigenvalue by the sum of all variances. Loadings have length one and a sum that is not
    negative. Keys with fewer than two dates have no variance and loadings of zero. There are no more
    components than the matrix has directions; an empty table gives an empty result.
    """
    made, names = tiles(series, key, value, **sizes)

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, width, height, sums in zip(*(batch.column(c).to_pylist() for c in ("lo", "hi", "width", "height", "sums"))):
                cov = np.nan_to_num(covariances(np.frombuffer(sums).reshape(SUMS, width, height)))
                own = float(np.trace(cov)) if lo == hi else 0.0
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (lo, hi, width, height, cov.tobytes(), own)], ["lo", "hi", "width", "height", "cov", "trace"])

    matrix = checkpointed(made.mapInArrow(valued, "lo long, hi long, width long, height long, cov binary, trace double"))
    total, count = matrix.agg(F.sum("trace")).first()[0], names.agg(F.sum(F.size("names"))).first()[0] or 0
    kind = names.schema["names"].dataType.elementType.simpleString()
    shape = f"component int, share double, {key} {kind}, loading double"
    if not total:
        return series.sparkSession.createDataFrame([], shape)
    w = min(k + MORE, count)

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, n in zip(batch.column("b").to_pylist(), batch.column("n").to_pylist()):
                yield narrow_row(b, np.random.default_rng([seed, b]).normal(size=(n, w)))

    q = checkpointed(names.select("b", F.size("names").alias("n")).mapInArrow(drawn, NARROW))
    rounds, until = 0, MOST
    while True:
        y = checkpointed(multiplied_by(matrix, q))
        qq, qy, yy, ones = grams(q, y, w)
        white = whitening(qq)
        values, vectors = np.linalg.eigh(white.T @ (qy + qy.T) @ white / 2)
        best = white @ vectors[:, ::-1][:, :k]
        values = values[::-1][:k]
        left = np.sqrt(np.maximum(0, np.einsum("ij,ik,kj->j", best, yy, best) - values**2))
        rounds += 1
        if until == MOST and left.max() <= CLOSE * abs(values).max():
            until = 2 * rounds
        if rounds >= until:
            break
        step = whitening(yy)
        q, w = checkpointed(turned(y, step)), step.shape[1]

    best = best * np.where(ones @ best < 0, -1.0, 1.0)
    shares = values / total

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column("data").to_pylist()):
                own = batch.column("names")[i].values
                for c, column in enumerate((np.frombuffer(data).reshape(len(own), -1)).T):
                    n = len(own)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, c + 1, np.int32)), pa.array(np.full(n, shares[c])), own, pa.array(column)], ["component", "share", key, "loading"])

    return turned(q, best).join(names, "b").mapInArrow(long, shape)
