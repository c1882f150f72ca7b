"""Unit vectors, cosine pairs, nearest clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.ordinals import number_rows
from tessera.plans.scratch import stage

#: Rows of a block in the all-pairs product; 4096 vectors of 768 doubles are 25 MB.
BLOCK_ROWS = 4096
#: Copies of a vector that are sent for all pairs, as far as a block stays below so many bytes of doubles; beyond that, blocks and copies grow in number.
BLOCKS, BLOCK_BYTES = 32, 16 << 20
#: Cells of a product that a task holds at once: 8 MB, and a few times that for what is found in them.
STRIP_CELLS = 1 << 20
#: Bits of a cosine by which each pass over the pairs narrows the median down; 64 together.
DIGITS = (20, 22, 22)
#: Tasks that pairs of blocks are dealt to at most.
TASKS = 1024
#: Parts in which cosines are first counted, cosines near the median that are written at most, and how many rows the driver reads at once.
BINS, MIDDLE, READ = 1 << 16, 1 << 26, 1 << 16


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(vector: Column) -> Column:
    """``vector`` divided by its length; a zero length counts as 1e-8."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x.cast("double") / F.when(norm == 0, F.lit(1e-8)).otherwise(norm))


def _blocks(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    usable = vectors.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("v"))
    n, width = usable.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    rows = max(BLOCK_ROWS, min(-(-n // BLOCKS), BLOCK_BYTES // (8 * max(1, width or 1))))
    count = max(1, -(-n // rows))
    return usable.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(count)).cast("int")), count


def strips(rows: int, across: int, cells: int) -> Iterator[slice]:
    """``rows`` in strips of at most ``cells`` cells (one row at least), where a row has ``across`` of them."""
    step = max(1, cells // max(1, across))
    return (slice(at, min(rows, at + step)) for at in range(0, rows, step))


def all_pairs(vectors: DataFrame, key: str, vector: str, keep, schema: str, combine=None, whole: bool = False) -> DataFrame:
    """``keep(left keys, left matrix, right keys, right matrix, same block)`` over each pair of blocks, strip by strip of the left one.

    Blocks have about ``BLOCK_ROWS`` rows, more where that would make over ``BLOCKS`` of
    them. A block goes to the tasks of its pairs, each of which multiplies two blocks:
    nothing is broadcast, and a task holds two blocks and what one strip gives.
    ``combine`` makes one frame of those of a pair of blocks. With ``whole``, ``keep``
    gets both blocks at once and yields frames.
    """
    cells, (blocks, count) = STRIP_CELLS, _blocks(vectors, key, vector)
    if count > 1:
        other = F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("other")
        sent = blocks.repartition(count, "block").select("*", other).select("key", "v", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        sent = sent.repartition(min(count * (count + 1) // 2, TASKS), "i", "j")  # by work, not by bytes
    else:
        sent = blocks.withColumn("i", F.lit(0)).withColumn("j", F.lit(0))

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, block, rows = [], [], []
        for part in batches:
            i, j = int(part["i"].iloc[0]), int(part["j"].iloc[0])
            keys.append(part["key"].to_numpy())
            block.append(part["block"].to_numpy())
            rows.append(np.stack(part["v"].to_numpy()).astype(float))
        keys, block, rows = np.concatenate(keys), np.concatenate(block), np.concatenate(rows)
        order = np.argsort(keys, kind="stable")  # every pass over the pairs sees the same products
        a, b = order[block[order] == i], order[block[order] == j]
        a_keys, a, b_keys, b = keys[a], rows[a], keys[b], rows[b]
        del keys, block, rows, order
        if whole:
            yield from keep(a_keys, a, b_keys, b, i == j) if len(b) else ()
            return
        found = (keep(a_keys[s], a[s], b_keys, b, i == j) for s in strips(len(a), len(b), cells) if len(b))
        if combine is not None:
            found = (combine(f) for f in [list(found)] if f)
        yield from found

    return sent.groupBy("i", "j").applyInPandas(multiply, schema)


def similar_pairs(vectors: DataFrame, threshold: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``src, dst, sim`` of all pairs src < dst of unit vectors with cosine at least ``threshold``."""

    def keep(a_keys, a, b_keys, b, same) -> pd.DataFrame:
        sims = a @ b.T
        if same:
            sims[a_keys[:, None] >= b_keys] = np.nan
        x, y = np.nonzero(sims >= threshold)
        p, q = a_keys[x], b_keys[y]
        return pd.DataFrame({"src": np.minimum(p, q), "dst": np.maximum(p, q), "sim": sims[x, y]})

    kind = vectors.schema[key].dataType.simpleString()
    return all_pairs(vectors, key, vector, keep, f"src {kind}, dst {kind}, sim double")


def cosine_matrix(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``src, dst, sim`` of all pairs src < dst."""
    return similar_pairs(vectors, -np.inf, key, vector)


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers of the same order."""
    bits = (x + 0.0).view(np.uint64)  # -0 as 0
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _double(bits: int) -> float:
    """The double that ``_ordered`` gives as ``bits``."""
    return float(np.array([bits ^ (1 << 63) if bits >> 63 else bits ^ ((1 << 64) - 1)], np.uint64).view(np.float64)[0])


def _digit_counts(vectors: DataFrame, key: str, vector: str, above: int, prefix: int) -> DataFrame:
    """``digit, n, total, least, greatest`` of the cosines whose first ``DIGITS[:above]`` are ``prefix``, by their next digit."""
    width, skip = DIGITS[above], 64 - sum(DIGITS[: above + 1])

    def keep(a_keys, a, b_keys, b, same) -> pd.DataFrame:
        sims = (a @ b.T).ravel()
        known = sims == sims
        if same:
            known &= (a_keys[:, None] < b_keys).ravel()
        if not known.all():
            sims = sims[known]
        bits = _ordered(sims) >> np.uint64(skip)
        if above:
            inside = bits >> np.uint64(width) == prefix
            sims, bits = sims[inside], bits[inside]
        digit = (bits & np.uint64((1 << width) - 1)).astype(np.int64)
        if not len(digit):
            return pd.DataFrame({"digit": [], "n": [], "total": [], "least": [], "greatest": []})
        if len(digit) > 1 << 16:
            first = int(digit.min())
            n = np.bincount(digit - first)
            at = np.nonzero(n)[0]
            digit, n = at + first, n[at]
        else:
            digit, n = np.unique(digit, return_counts=True)
        return pd.DataFrame({"digit": digit, "n": n, "total": np.where(np.arange(len(digit)) == 0, sims.sum(), 0.0), "least": sims.min(), "greatest": sims.max()})

    facts = {"n": "sum", "total": "sum", "least": "min", "greatest": "max"}
    combine = lambda frames: pd.concat(frames).groupby("digit", as_index=False).agg(facts)
    counts = all_pairs(vectors, key, vector, keep, "digit long, n long, total double, least double, greatest double", combine)
    return counts.groupBy("digit").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))


def _rough(a_keys, a, b, same: bool, cells: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """``first row, first column, product`` in single precision, strip by strip; NaN where a block with itself has no ascending keys."""
    x, y = a.astype(np.float32), b.astype(np.float32)
    later = np.searchsorted(a_keys, a_keys, "right") if same else np.zeros(len(a), int)
    for s in strips(len(a), len(b), cells):
        first = int(later[s.start])
        sims = x[s] @ y[first:].T
        if same:
            sims[np.arange(first, len(b)) < later[s][:, None]] = np.nan
        yield s.start, first, sims


def _rough_counts(vectors: DataFrame, key: str, vector: str, reach: float) -> DataFrame:
    """``digit, n, total, least, greatest``: cosines in single precision counted in ``BINS`` parts of -reach to reach, their total in double precision."""
    cells, bins, scale = STRIP_CELLS, BINS, np.float32(BINS / (2 * reach))

    def count(a_keys, a, b_keys, b, same) -> Iterator[pd.DataFrame]:
        n, least, greatest = np.zeros(bins + 2, np.int64), np.inf, -np.inf
        for _, _, sims in _rough(a_keys, a, b, same, cells):
            sims = sims[sims == sims] if same else sims.ravel()
            if len(sims):
                least, greatest = min(least, float(sims.min())), max(greatest, float(sims.max()))
                sims += np.float32(reach)
                sims *= scale
                n += np.bincount(sims.astype(np.int64), minlength=bins + 2)
        if same:  # each row times the sum of those of greater keys
            sums = np.vstack([np.cumsum(b[::-1], axis=0)[::-1], np.zeros((1, b.shape[1]))])
            total = float((a * sums[np.searchsorted(a_keys, a_keys, "right")]).sum())
        else:
            total = float(a.sum(0) @ b.sum(0))
        at = np.nonzero(n)[0]
        yield pd.DataFrame({"digit": at, "n": n[at], "total": np.where(np.arange(len(at)) == 0, total, 0.0), "least": least, "greatest": greatest})

    counts = all_pairs(vectors, key, vector, count, "digit long, n long, total double, least double, greatest double", whole=True)
    return counts.groupBy("digit").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))


def _middle(vectors: DataFrame, key: str, vector: str, low: float, high: float, small: float, large: float) -> DataFrame:
    """``value, n, below, least, greatest``: cosines from about ``low`` to ``high`` in double precision and the number below them.

    Rows without a value have the number and the extremes of those outside ``small`` to ``large``.
    """
    cells = STRIP_CELLS
    low, high, small, large = map(np.float32, (low, high, small, large))

    def exact(a, b, row, first, wanted) -> Iterator[np.ndarray]:
        across = wanted.shape[1]
        at = np.flatnonzero(wanted)
        if len(at) > wanted.size // 16:
            yield (a[row : row + len(wanted)] @ b[first:].T)[wanted]
            return
        for s in strips(len(at), a.shape[1], cells):
            yield np.einsum("ij,ij->i", a[row + at[s] // across], b[first + at[s] % across])

    def find(a_keys, a, b_keys, b, same) -> Iterator[pd.DataFrame]:
        below, least, greatest = 0, np.inf, -np.inf
        for row, first, sims in _rough(a_keys, a, b, same, cells):
            under = sims < low
            below += int(np.count_nonzero(under))
            inside = sims <= high
            inside ^= under
            if inside.any():
                found = [np.unique(part, return_counts=True) for part in exact(a, b, row, first, inside)]
                yield pd.DataFrame({"value": np.concatenate([v + 0.0 for v, _ in found]), "n": np.concatenate([n for _, n in found]), "below": 0, "least": np.nan, "greatest": np.nan})
            for ends in (sims <= small, sims >= large):
                if ends.any():
                    for part in exact(a, b, row, first, ends):
                        least, greatest = min(least, float(part.min())), max(greatest, float(part.max()))
        yield pd.DataFrame({"value": [np.nan], "n": 0, "below": below, "least": least, "greatest": greatest})

    return all_pairs(vectors, key, vector, find, "value double, n long, below long, least double, greatest double", whole=True)


def _of_rank(values: DataFrame, rank: int) -> float:
    """The value of ``rank`` (from 0) in a table of ``value, n``, whose range is narrowed until the driver can read what is left."""
    while True:
        rows, least, greatest = values.agg(F.count(F.lit(1)), F.min("value"), F.max("value")).first()
        if least == greatest:
            return least
        part = F.col("value") if rows <= READ else F.floor((F.col("value") - least) * 4096 / (greatest - least)).cast("long")
        for at, n in sorted(map(tuple, values.groupBy(part.alias("part")).agg(F.sum("n")).collect())):
            if rank < n:
                break
            rank -= n
        if rows <= READ:
            return at
        values = values.where(part == at)


def pairwise_stats(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Least, median, mean and greatest off-diagonal cosine, and the number of pairs; all exact.

    Two passes over the pairs in single precision, whose greatest error is known: the
    first counts cosines in narrow parts, the second computes in double precision those
    that may be the median or an extreme, and only those near the median leave their
    task. Where too many lie there, or values have no such bound, digits decide.
    """
    schema = "min_sim double, median_sim double, mean_sim double, max_sim double, n_pairs long"
    spark = vectors.sparkSession
    given = stage(vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, vector), "vectors")
    square = dot(F.col(vector), F.col(vector))
    known, rows, top, width = given.agg(F.count(square), F.count(F.lit(1)), F.max(square), F.max(F.size(vector))).first()
    if known < rows or not 1e-12 < (top or 1.0) < 1e12:
        return _stats_by_digits(given, key, vector)
    top = top or 1.0
    error = (width or 0) * 2.0**-24 * top + 2.0**-21 * top  # of a product of vectors in single precision, and of comparing it
    reach = top + 2 * error
    counts = sorted(map(tuple, _rough_counts(given, key, vector, reach).collect()))
    n = sum(c[1] for c in counts)
    if not n:
        return spark.createDataFrame([(None, None, None, None, 0)], schema)
    ranks, ends, before = ((n - 1) // 2, n // 2), [], 0
    for part, m, *_ in counts:
        ends += [part for r in ranks if before <= r < before + m]
        before += m
    part = 2 * reach / BINS
    margin = 2 * error + part / 8
    low, high = ends[0] * part - reach - margin, (ends[1] + 1) * part - reach + margin
    wide = int(2 * margin / part) + 2
    if sum(c[1] for c in counts if ends[0] - wide <= c[0] <= ends[1] + wide) > MIDDLE:
        return _stats_by_digits(given, key, vector)
    small, large = min(c[3] for c in counts) + 2 * error, max(c[4] for c in counts) - 2 * error
    found = stage(_middle(given, key, vector, low, high, small, large), "middle")
    below, least, greatest = found.where("n = 0").agg(F.sum("below"), F.min("least"), F.max("greatest")).first()
    values = found.where("n > 0").select("value", "n")
    left, right = (_of_rank(values, r - below) for r in ranks)
    row = (least, left + (right - left) / 2, sum(c[2] for c in counts) / n, greatest, n)
    return spark.createDataFrame([row], schema)


def _stats_by_digits(given: DataFrame, key: str, vector: str) -> DataFrame:
    """``pairwise_stats`` of a staged table for any values.

    No pair leaves its task: each pass counts cosines by a digit, and the digits of the
    two middle ones are found from the left, so the median is exact. What reaches the
    driver are counts of the digits that occur.
    """
    schema = "min_sim double, median_sim double, mean_sim double, max_sim double, n_pairs long"
    spark = given.sparkSession
    seen: dict = {}

    def counts(above: int, prefix: int) -> list:
        if (above, prefix) not in seen:
            seen[above, prefix] = sorted(_digit_counts(given, key, vector, above, prefix).collect())
        return seen[above, prefix]

    def ranked(rank: int) -> float:
        prefix = 0
        for above, width in enumerate(DIGITS):
            rows = counts(above, prefix)
            for r in rows:
                if rank < r["n"] or r is rows[-1]:
                    break
                rank -= r["n"]
            prefix = prefix << width | r["digit"]
        return _double(prefix)

    first = counts(0, 0)
    n = sum(r["n"] for r in first)
    if not n:
        return spark.createDataFrame([(None, None, None, None, 0)], schema)
    low, high = ranked((n - 1) // 2), ranked(n // 2)
    row = (min(r["least"] for r in first), low + (high - low) / 2, sum(r["total"] for r in first) / n, max(r["greatest"] for r in first), n)
    return spark.createDataFrame([row], schema)


def transform_survival(clean: DataFrame, variants: DataFrame, threshold: float, key: str, vector: str) -> DataFrame:
    """``transform, n, mean_sim, survival``: cosine of each variant with its clean vector."""
    sim = dot(F.col("_c"), F.col(vector))
    joined = variants.join(clean.select(key, F.col(vector).alias("_c")), key).withColumn("_sim", sim)
    return joined.groupBy("transform").agg(F.count(F.lit(1)).alias("n"), F.avg("_sim").alias("mean_sim"), F.avg((F.col("_sim") >= threshold).cast("double")).alias("survival"))


def best_matches(uploads: DataFrame, posts: DataFrame, key: str, vector: str, order: str) -> DataFrame:
    """``key, best_cluster, best_sim``: the nearest post of each upload, the newest (greatest ``order``) among equals; only positive cosines count.

    Blocks of uploads meet blocks of posts, ``BLOCK_ROWS`` rows of each in a task, and
    partial bests are combined. A task holds one strip of their product.
    """
    cells = STRIP_CELLS
    asked = uploads.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("v"))
    known = posts.where(F.col(vector).isNotNull()).select(F.col("similarity_cluster").alias("best_cluster"), F.col(order).alias("_at"), F.col(vector).alias("v"))
    n, m = (max(1, -(-df.count() // BLOCK_ROWS)) for df in (asked, known))
    place = lambda count, *by: F.pmod(F.xxhash64(*by), F.lit(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = asked.select("k", "v", place(n, "k").alias("i"), each(m).alias("j"))
    right = known.select("best_cluster", "_at", "v", each(n).alias("i"), place(m, "_at", "v").alias("j"))

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({c: [] for c in ("k", "best_cluster", "_at", "best_sim")})
        b = b.sort_values(["_at", "best_cluster"], ascending=False, ignore_index=True)
        x, y = np.stack(a["v"].to_numpy()).astype(float), np.stack(b["v"].to_numpy()).astype(float)
        at, best = np.zeros(len(x), int), np.zeros(len(x))
        for s in strips(len(x), len(y), cells):
            sims = np.round(x[s] @ y.T, 12)
            at[s], best[s] = sims.argmax(1), sims.max(1)
        return pd.DataFrame({"k": a["k"].to_numpy(), "best_cluster": b["best_cluster"].to_numpy()[at], "_at": b["_at"].to_numpy()[at], "best_sim": best})

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    kinds = f"k {kind(asked, 'k')}, best_cluster {kind(known, 'best_cluster')}, _at {kind(known, '_at')}, best_sim double"
    out = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(nearest, kinds)
    best = out.where("best_sim > 0").groupBy("k").agg(F.max(F.struct("best_sim", "_at", "best_cluster")).alias("b"))
    return best.select(F.col("k").alias(key), F.col("b.best_cluster").alias("best_cluster"), F.col("b.best_sim").alias("best_sim"))


def assign_cluster(uploads: DataFrame, posts: DataFrame, threshold: float, key: str = "image_id", vector: str = "embedding", order: str = "created_at") -> DataFrame:
    """``uploads`` with ``similarity_cluster`` and ``similarity_score``.

    A cosine of at least ``threshold`` with the nearest post gives its cluster; else
    new clusters follow the greatest one, in key order. Uploads of a batch do not
    see each other.
    """
    joined = uploads.join(best_matches(uploads, posts, key, vector, order), key, "left")
    matched = stage(joined.withColumn("similarity_cluster", F.when(F.col("best_sim") >= threshold, F.col("best_cluster"))).withColumn("similarity_score", F.coalesce("best_sim", F.lit(0.0))).drop("best_cluster", "best_sim"), "matched")
    top = posts.agg(F.coalesce(F.max("similarity_cluster"), F.lit(-1)).alias("top")).first()["top"]
    new = number_rows(matched.where("similarity_cluster is null"), F.col(key), name="_n")
    new = new.withColumn("similarity_cluster", (F.lit(top + 1) + F.col("_n")).cast("long")).drop("_n")
    return matched.where("similarity_cluster is not null").withColumn("similarity_cluster", F.col("similarity_cluster").cast("long")).unionByName(new)


def annotate_similarity(posts: DataFrame, key: str = "image_id", vector: str = "embedding", cluster: str = "similarity_cluster") -> DataFrame:
    """``posts`` with ``similarity_score``: the greatest cosine to another member of the cluster, 0 at least, 4 places.

    Without a vector the former score stays, or 0. Members of one cluster are
    compared in blocks: a cluster's rows are dealt into chunks of ``BLOCK_ROWS``
    and only chunk pairs meet in a task, which holds one strip of their product.
    """
    cells = STRIP_CELLS
    rows = posts.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(cluster).alias("c"), F.col(vector).alias("v"))
    sizes = rows.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("chunks"), F.count(F.lit(1)).alias("m")).where("m > 1")
    dealt = rows.join(sizes, "c").withColumn("chunk", F.pmod(F.xxhash64("k"), F.col("chunks").cast("long")).cast("int"))
    # Clusters are gathered in bins, so that a task multiplies many small ones.
    sent = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("o")).select("k", "c", "v", "chunk", F.least("chunk", "o").alias("i"), F.greatest("chunk", "o").alias("j"), F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("c"), F.lit(256))).otherwise(F.xxhash64("c")).alias("bin"))

    def nearest(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, members in part.groupby("c", sort=False):
            i, j = int(members["i"].iloc[0]), int(members["j"].iloc[0])
            a, b = members[members["chunk"] == i], members[members["chunk"] == j]
            if not len(a) or not len(b):
                continue
            x, y = np.stack(a["v"].to_numpy()).astype(float), np.stack(b["v"].to_numpy()).astype(float)
            a, b = a["k"].to_numpy(), b["k"].to_numpy()
            best, other = np.zeros(len(x)), np.full(len(y), -np.inf)
            for s in strips(len(x), len(y), cells):
                sims = x[s] @ y.T
                if i == j:  # a key lies in one chunk
                    sims[a[s][:, None] == b] = -np.inf
                best[s], other = sims.max(1), np.maximum(other, sims.max(0))
            out.append(pd.DataFrame({"k": a, "s": best}))
            if i != j:
                out.append(pd.DataFrame({"k": b, "s": other}))
        return pd.concat(out) if out else pd.DataFrame({"k": [], "s": []})

    kind = posts.schema[key].dataType.simpleString()
    best = sent.groupBy("bin", "i", "j").applyInPandas(nearest, f"k {kind}, s double").groupBy("k").agg(F.max("s").alias("_best"))
    before = F.coalesce("similarity_score", F.lit(0.0)) if "similarity_score" in posts.columns else F.lit(0.0)
    score = F.when(F.col(vector).isNull(), before).otherwise(F.round(F.greatest(F.lit(0.0), F.coalesce("_best", F.lit(0.0))), 4))
    return posts.join(best, F.col(key) == F.col("k"), "left").withColumn("similarity_score", score).drop("k", "_best")


def find_by_hash(posts: DataFrame, hashes: DataFrame, column: str = "image_sha256") -> DataFrame:
    """Posts whose content hash is among those given."""
    return posts.join(hashes.select(column).distinct(), column, "left_semi")
