"""Whitening of embeddings with MLlib's distributed BlockMatrix.

1. Vectors become whole numbers ``x = floor(1024 c) + 100000``, so their count and the sums per dimension are exact.
2. The centred rows ``(n x - S) / n`` are indexed into row blocks: every task cuts its rows into blocks, the blocks are
   numbered through, and a last block that is not full ends with rows of zeros, which change no product.
3. ``Y' Y`` is a BlockMatrix product, its middle dimension split so that a task holds a few blocks; divided by n it is
   the covariance. Only that d by d matrix reaches the driver, where eigh gives the components.
4. The BlockMatrix product of the rows with the whitening matrix (components over the root of their variances)
   projects all rows; ids meet their block by its number, one row per block.

MLlib's products keep one key per block on the driver. Blocks grow with the number of vectors (4 MB at first, 64 MB at
most), and products run over slabs of at most ``SLAB`` blocks, one after the other, whose scatters add up.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import shared_table

SCALE, SHIFT = 1024, 100_000
BLOCK_BYTES, MOST_BYTES = 4 << 20, 64 << 20
SLAB = 4096  # blocks of one product; MLlib deals their rows to the root of that many tasks
HELD = 4  # blocks that a task of the scatter product holds of each side
COLUMNS = 1024  # columns of a block
# Blocks are rows of megabytes: Parquet looks at the size of a row group after every one.
ROW_GROUPS = {"parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


def whole_numbers(vector: Column) -> Column:
    """``floor(1024 c) + 100000`` of every entry as a long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)


def usable(vector: Column) -> Column:
    """Whether a vector has entries, and all are finite and give a long."""
    fits = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float(1 << 52), F.lit(False)))
    return F.coalesce(fits & (F.size(vector) > 0), F.lit(False))


def fit_list(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """``vec_id`` and ``x`` of the usable vectors, written once, and their dimension: the most frequent
    one (ties: the larger); vectors of another are left out."""
    x = embeddings.filter(usable(F.col(vector))).select(F.col(vec_id), whole_numbers(F.col(vector)).alias("x"))
    x = shared_table(x, "vectors")
    found = x.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if not found:
        return x, 0
    return x.filter(F.size("x") == found["d"]), found["d"]


def _totals(x: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and their sums per dimension, exact."""
    # partial sums first: one row per task and dimension is shuffled
    entries = x.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("v").cast("decimal(20,0)")).alias("s")).orderBy("i").collect()
    return entries[0]["n"], [int(r["s"]) for r in entries]


def _rows_per_block(n: int, d: int) -> int:
    """Rows of a block: 4 MB of doubles, more from 16 times ``SLAB`` blocks on, at most 64 MB."""
    few, most = (max(1, b // (8 * d)) for b in (BLOCK_BYTES, MOST_BYTES))
    return min(most, max(few, -(-n // (16 * SLAB))))


def row_blocks(x: DataFrame, n: int, sums: list[int], rows: int) -> DataFrame:
    """Row blocks of at most ``rows`` vectors: ``block`` (numbered from 0 without gaps), ``column`` (its columns begin at
    ``COLUMNS`` times that), ``size``, ``y`` (centred rows as doubles, row by row, filled up with zeros), and for column 0
    ``ids`` and ``deviations``."""
    d = len(sums)
    schema = T.StructType([
        T.StructField("part", T.LongType()), T.StructField("at", T.LongType()), T.StructField("column", T.LongType()),
        T.StructField("size", T.IntegerType()), T.StructField("y", T.ArrayType(T.DoubleType())),
        T.StructField("ids", T.ArrayType(x.schema[0].dataType)), T.StructField("deviations", T.ArrayType(T.LongType()))])

    def cut(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        part, at, ids, dev, ys = TaskContext.get().partitionId(), 0, [], [], []
        total = np.array(sums, dtype=object)

        def block() -> Iterator:
            y = np.zeros((rows, d))
            np.concatenate(ys, out=y[:len(ids)])
            for j in range(0, d, COLUMNS):
                flat = pa.ListArray.from_arrays([0, y[:, j:j + COLUMNS].size], y[:, j:j + COLUMNS].ravel())
                own = ([ids], [dev]) if not j else ([None], [None])
                values = [[part], [at], [j // COLUMNS], [len(ids)], flat, *own]
                yield pa.RecordBatch.from_arrays(
                    [v if f.name == "y" else pa.array(v, type=f.type) for v, f in zip(values, arrow, strict=True)],
                    schema=pa.schema([pa.field("y", flat.type) if f.name == "y" else f for f in arrow]))

        for b in batches:
            keys = b.column(0).to_pylist()
            whole = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            begin = 0
            while begin < len(keys):
                end = begin + rows - len(ids)
                y, own = centred(whole[begin:end], n, total)
                ids, dev = ids + keys[begin:end], dev + own
                ys.append(y)
                begin = end
                if len(ids) == rows:
                    yield from block()
                    at, ids, dev, ys = at + 1, [], [], []
        if ids:
            yield from block()

    blocks = shared_table(x.mapInArrow(cut, schema), "centred", **ROW_GROUPS)
    # one row per task: how many blocks lie before its own
    counts = blocks.filter("column = 0").groupBy("part").agg(F.count(F.lit(1)).alias("own"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shared_table(counts.select("part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("first")),
                           "offsets")
    return blocks.join(offsets, "part").withColumn("block", F.col("first") + F.col("at")).drop("part", "at", "first")


def centred(whole, n: int, sums) -> tuple:
    """The rows ``(n x - S) / n`` as doubles, and their exact squared length times n^2 (null where that is no long)."""
    import numpy as np

    reach = n * int(np.abs(whole).max(initial=0)) + int(max(abs(sums), default=0))
    if reach * reach * len(sums) < 1 << 62:
        z = n * whole - sums.astype(np.int64)
        return z / n, (z * z).sum(axis=1).tolist()
    z = whole.astype(object) * n - sums
    own = [int(v) for v in (z * z).sum(axis=1)]
    return (z / n).astype(float), [v if v < 1 << 63 else None for v in own]


def _matrix_schema() -> T.StructType:
    from pyspark.mllib.linalg import MatrixUDT

    index = T.StructType([T.StructField("blockRowIndex", T.LongType()), T.StructField("blockColIndex", T.LongType())])
    return T.StructType([T.StructField("index", index), T.StructField("matrix", MatrixUDT())])


def matrices(blocks: DataFrame, rows: int, d: int) -> DataFrame:
    """``blocks`` as a table of MLlib matrices, written once: MLlib reads them without Python."""
    none = F.lit(None).cast("array<int>")
    width = F.least(F.lit(COLUMNS), F.lit(d) - F.col("column") * COLUMNS).cast("int")
    index = F.struct(F.col("block").cast("long").alias("blockRowIndex"), F.col("column").alias("blockColIndex"))
    # MLlib's stored form; type 1 is a dense matrix, a transposed one has its values row by row
    matrix = F.struct(F.lit(1).cast("byte").alias("type"), F.lit(rows).alias("numRows"), width.alias("numCols"),
                      none.alias("colPtrs"), none.alias("rowIndices"), F.col("y").alias("values"),
                      F.lit(True).alias("isTransposed"))
    return shared_table(blocks.select(index.alias("index"), matrix.alias("matrix")), "matrices", _matrix_schema(),
                        **ROW_GROUPS)


def _matrix(table: DataFrame, first: int, count: int, rows: int, d: int):
    """The blocks numbered ``first`` to ``first + count - 1`` of :func:`matrices` as a BlockMatrix."""
    from pyspark.mllib.common import callMLlibFunc
    from pyspark.mllib.linalg.distributed import BlockMatrix

    row = F.col("index.blockRowIndex")
    own = table.filter((row >= first) & (row < first + count)).select(
        F.struct((row - first).alias("blockRowIndex"), F.col("index.blockColIndex")).alias("index"), "matrix")
    width = min(COLUMNS, d)
    return BlockMatrix(callMLlibFunc("createBlockMatrix", own, rows, width, count * rows, d), rows, width)


def _times(left, right, splits: int = 1):
    """``left * right``; the middle dimension is dealt to ``splits`` times as many tasks."""
    from pyspark.mllib.linalg.distributed import BlockMatrix

    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock)


def covariance(table: DataFrame, count: int, n: int, rows: int, d: int):
    """``Y' Y / n`` as a d by d array."""
    import numpy as np

    total = np.zeros((d, d))
    for first in range(0, count, SLAB):
        own = min(SLAB, count - first)
        y = _matrix(table, first, own, rows, d)
        total += _times(y.transpose(), y, -(-own // HELD)).toLocalMatrix().toArray()
    return (total + total.T) / (2 * n)


def components(v, most: int) -> tuple:
    """The greatest eigenvalues of ``v``, falling, and their unit eigenvectors as columns, the entry of the largest
    size positive."""
    import numpy as np

    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    return e, u * np.where(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])] < 0, -1.0, 1.0)


def _project(table: DataFrame, count: int, rows: int, d: int, w) -> DataFrame:
    """``block`` and ``p`` (its projected rows, one column after the other) per block."""
    from pyspark.mllib.common import callMLlibFunc
    from pyspark.mllib.linalg import DenseMatrix
    from pyspark.mllib.linalg.distributed import BlockMatrix

    sc = table.sparkSession.sparkContext
    k = w.shape[1]
    parts = [((j // COLUMNS, 0), DenseMatrix(len(w[j:j + COLUMNS]), k, w[j:j + COLUMNS].ravel(order="F")))
             for j in range(0, d, COLUMNS)]
    right = BlockMatrix(sc.parallelize(parts, 1), min(COLUMNS, d), k, d, k)
    plain = T.StructType([_matrix_schema()[0], T.StructField("matrix", _matrix_schema()[1].dataType.sqlType())])
    out = None
    for first in range(0, count, SLAB):
        product = _times(_matrix(table, first, min(SLAB, count - first), rows, d), right)
        found = callMLlibFunc("getMatrixBlocks", product._java_matrix_wrapper._java_model).toDF("index", "matrix")
        found = found.select(F.struct(F.col("index._1").cast("long").alias("blockRowIndex"),
                                      F.col("index._2").cast("long").alias("blockColIndex")).alias("index"), "matrix")
        part = shared_table(found, "projected", plain, **ROW_GROUPS).select(
            (F.col("index.blockRowIndex") + first).alias("block"), F.col("matrix.values").alias("p"))
        out = part if out is None else out.unionByName(part)
    return out


def identity_error(rows: DataFrame, n: int, used: list[int]) -> float:
    """The largest entry, by size, of the covariance of ``p`` (used components) minus the identity."""
    values = rows.select([F.get("p", F.lit(i)).alias(f"p{i}") for i in used])
    mean = values.agg(*[F.sum(c) / n for c in values.columns]).first()
    centre = [F.col(c) - F.lit(m) for c, m in zip(values.columns, mean, strict=True)]
    pairs = [(i, j) for i in range(len(used)) for j in range(i + 1)]
    found = values.agg(*[F.sum(centre[i] * centre[j]) / n for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs, strict=True))


def whiten(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", most: int = 8) -> DataFrame:
    """Per usable vector and component 1 to ``most`` (at most the dimension): vec_id, component, n, deviation, whitened,
    explained, identity_error.

    Vectors that are null, empty, or hold null or non-finite entries (or entries beyond 2^52) are left out, and so are
    vectors of another dimension than the most frequent one. A component without variance (to double precision) has
    whitened null, and identity_error looks at the others; it is null if there is none, and explained is then null too.
    A deviation beyond a long is null. Repeated rows are all returned, a null vec_id stays null; an empty table gives
    no rows; other columns are not read.
    """
    import numpy as np

    x, d = fit_list(embeddings, vec_id, vector)
    schema = T.StructType([embeddings.schema[vec_id], T.StructField("component", T.IntegerType()),
                           T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
                           T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()),
                           T.StructField("identity_error", T.DoubleType())])
    if not d:
        return embeddings.sparkSession.createDataFrame([], schema)
    n, sums = _totals(x)
    rows = _rows_per_block(n, d)
    blocks = row_blocks(x, n, sums, rows)
    table = matrices(blocks, rows, d)
    count = blocks.filter("column = 0").count()
    v = covariance(table, count, n, rows, d)
    e, u = components(v, min(most, d))
    trace = float(np.trace(v))
    used = [i for i in range(len(e)) if e[i] > trace * d * np.finfo(float).eps]
    w = np.where(e > trace * d * np.finfo(float).eps, u / np.sqrt(np.maximum(e, np.finfo(float).tiny)), 0.0)
    projected = _project(table, count, rows, d, w)
    own = blocks.filter("column = 0").select("block", "size", "ids", "deviations").join(projected, "block")
    p = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.array(
        *[F.get("p", i + c * rows) for c in range(len(e))]))
    flat = own.select(F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("deviations").alias("deviation"), p.alias("p"))))
    flat = shared_table(flat, "whitened")
    error = F.lit(identity_error(flat, n, used) if used else None).cast("double")
    share = F.array(*[F.lit(float(max(v, 0.0) / trace) if trace > 0 else None).cast("double") for v in e])
    has = F.array(*[F.lit(i in used) for i in range(len(e))])
    long = flat.select("id", "deviation", F.posexplode("p").alias("k", "value"))
    return long.select(
        F.col("id").alias(vec_id), (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"),
        "deviation", F.when(F.get(has, F.col("k")), F.col("value")).alias("whitened"),
        F.get(share, F.col("k")).alias("explained"), error.alias("identity_error"))
