"""Uploads as a stream of batches against the stored posts.

Uploads are placed as if each came alone, in the order of time and id: an upload
sees all stored posts and the earlier uploads of its own batch. What an upload is
matched with depends on contents and vectors only, never on cluster numbers, so a
batch is placed at once: each upload points at the post it follows, an earlier
upload or none, and pointers are followed by doubling.

Posts lie in buckets of clusters. Each cluster has a summary: the vector of its
first member, the greatest angle of any member to it, the greatest length, the
size and the greatest score. By the triangle inequality on angles, a summary rules
out all members of a cluster at once; only clusters that stay open are compared
member by member, and only their buckets are read. A batch writes the buckets of
the clusters that it changes. Content hashes have buckets of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.images import describe_images
from tessera.functions.scoring import ROBUST_UPLOAD, confidence, filename_heuristic, label_for, robustness
from tessera.operators.feed import recalculate_clusters
from tessera.operators.validate import first_reason
from tessera.operators.vectors import BLOCK_ROWS, STRIP_CELLS, all_pairs, annotate_similarity, dot, strips
from tessera.plans.ordinals import number_rows
from tessera.plans.running import running
from tessera.plans.scratch import new_path, stage
from tessera.streaming.store import BUCKETS, BucketStore

#: The largest upload and the media types taken.
MAX_BYTES = 10 * 1024 * 1024
MIME_TYPES = ("image/jpeg", "image/png", "image/webp", "image/gif", "image/bmp", "image/tiff")

POSTS = "image_id string, handle string, ai_probability double, similarity_cluster long, similarity_score double, repetition_score double, diversity_label string, created_at timestamp, embedding array<double>, image_sha256 string"
COLUMNS = tuple(c.split()[0] for c in POSTS.split(", "))
CLUSTERS = "similarity_cluster long, n long, top double, pivot array<double>, angle double, length double"
HASHES = "image_sha256 string, image_id string, similarity_cluster long, created_at timestamp"
#: Angles and lengths are widened by this share, so that rounding never rules a member out.
SLACK = 1e-6


def upload_reason(decoded: bool = False) -> Column:
    """Why an upload (size, mime; ``decoded``: also decoded_width, decoded_height) is refused, or null."""
    mime = F.col("mime").isNotNull() & (F.col("mime") != "") & ~F.col("mime").isin(*MIME_TYPES)
    checks = [(mime, "unsupported_type"), (F.coalesce("size", F.lit(0)) == 0, "empty"), (F.col("size") > MAX_BYTES, "too_large")]
    if decoded:
        checks += [(F.col("decoded_width").isNull() | F.col("decoded_height").isNull(), "unreadable"), ((F.col("decoded_width") < 1) | (F.col("decoded_height") < 1), "invalid_dimensions")]
    return first_reason(*checks)


def prepare_uploads(files: DataFrame) -> DataFrame:
    """Uploads from ``files`` (image_id, handle, filename, mime, content, created_at, score, embedding): size, content hash, decoded dimensions, ``analysis_mode`` and ``reason``.

    A null score stands for a model that is not there; the rule of the file name then gives one.
    """
    seen = describe_images(files.select(F.col("image_id").alias("path"), "content")).select(F.col("path").alias("image_id"), "decoded_width", "decoded_height")
    joined = files.withColumn("size", F.coalesce(F.octet_length("content"), F.lit(0)).cast("long")).withColumn("image_sha256", F.sha2("content", 256)).drop("content").join(seen.dropDuplicates(["image_id"]), "image_id", "left")
    scored = joined.withColumn("analysis_mode", F.when(F.col("score").isNull(), "mock").otherwise("model"))
    scored = scored.withColumn("ai_probability", F.coalesce("score", filename_heuristic(F.coalesce("filename", F.lit(""))))).drop("score")
    return scored.withColumn("reason", upload_reason(decoded=True))


def _length(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))


def summaries(posts: DataFrame) -> DataFrame:
    """``CLUSTERS`` of these posts; ``posts`` is read twice."""
    order = F.struct("created_at", "image_id")
    facts = posts.groupBy("similarity_cluster").agg(F.count(F.lit(1)).alias("n"), F.max("ai_probability").alias("top"))
    placed = posts.where(F.size("embedding") > 0).select("similarity_cluster", "embedding", order.alias("o"), _length(F.col("embedding")).alias("l")).where("l > 0")
    first = placed.groupBy("similarity_cluster").agg(F.min_by("embedding", "o").alias("pivot"), F.min_by("l", "o").alias("_pl"))
    cosine = dot(F.col("embedding"), F.col("pivot")) / (F.col("l") * F.col("_pl"))
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine)))
    spread = placed.join(first, "similarity_cluster").groupBy("similarity_cluster").agg(F.max(angle).alias("angle"), F.max("l").alias("length"))
    return facts.join(first.drop("_pl"), "similarity_cluster", "left").join(spread, "similarity_cluster", "left").select(*[c.split()[0] for c in CLUSTERS.split(", ")])


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def _blocks(df: DataFrame, key: str) -> tuple[DataFrame, int]:
    count = max(1, -(-df.count() // BLOCK_ROWS))
    return df.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(count)).cast("int")), count


def open_clusters(asked: DataFrame, clusters: DataFrame, threshold: float) -> DataFrame:
    """``at, similarity_cluster``: the clusters in which some member may reach ``threshold`` with the vector (``at``, ``vec``)."""
    cells, none = STRIP_CELLS, F.lit(None).cast("double")
    left, n = _blocks(asked, "at")
    right, m = _blocks(clusters.where("pivot is not null").select("similarity_cluster", "pivot", "angle", "length"), "similarity_cluster")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = left.select(F.lit(True).alias("asks"), F.col("at").alias("key"), F.col("vec").alias("v"), none.alias("angle"), none.alias("length"), F.col("_b").alias("i"), each(m).alias("j"))
    right = right.select(F.lit(False).alias("asks"), F.col("similarity_cluster").alias("key"), F.col("pivot").alias("v"), "angle", "length", each(n).alias("i"), F.col("_b").alias("j"))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = pd.concat(list(batches))
        a, b = both[both["asks"]], both[~both["asks"]]
        if not len(a) or not len(b):
            return
        x, y = _stack(a["v"]), _stack(b["v"])
        size, other = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
        keys, named, spread, length = a["key"].to_numpy(), b["key"].to_numpy(), b["angle"].to_numpy() * (1 + SLACK) + SLACK, b["length"].to_numpy()
        for s in strips(len(x), len(y), cells // 4):  # several arrays of that size
            angle = np.arccos(np.clip(x[s] @ y.T / np.maximum(size[s][:, None] * other, 1e-300), -1.0, 1.0))
            nearest = np.maximum(0.0, angle - spread)
            bound = size[s][:, None] * length * np.cos(nearest) * (1 + SLACK) + SLACK
            i, j = np.nonzero((bound >= threshold) & (nearest < np.pi / 2))
            yield pd.DataFrame({"at": keys[s][i], "similarity_cluster": named[j]})

    return left.unionByName(right).groupBy("i", "j").applyInPandas(meet, "at long, similarity_cluster long")


def nearest_members(asked: DataFrame, posts: DataFrame) -> DataFrame:
    """``at, sim, created_at, image_id, similarity_cluster``: the best member of the clusters that each row of ``asked`` (at, vec, similarity_cluster) names, the newest among equals.

    Long clusters are compared in chunks of ``BLOCK_ROWS`` on both sides; small ones
    share tasks. A task holds one strip of a product.
    """
    cells = STRIP_CELLS
    sized = lambda df, name: df.groupBy("similarity_cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias(name))
    known = posts.where(F.size("embedding") > 0).select("similarity_cluster", "embedding", "created_at", "image_id")
    facts = sized(asked, "m").join(sized(known, "n"), "similarity_cluster")
    lot = F.when((F.col("m") == 1) & (F.col("n") == 1), F.pmod(F.xxhash64("similarity_cluster"), F.lit(256))).otherwise(F.xxhash64("similarity_cluster"))
    facts = stage(facts.withColumn("lot", lot), "chunks")
    chunk = lambda key, n: F.pmod(F.xxhash64(key), F.col(n).cast("long")).cast("int")
    left = asked.join(facts, "similarity_cluster").select("at", "vec", "similarity_cluster", F.col("lot").alias("l"), chunk("at", "m").alias("i"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    right = known.join(facts, "similarity_cluster").select("similarity_cluster", "embedding", "created_at", "image_id", F.col("lot").alias("r"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("i"), chunk("image_id", "n").alias("j"))

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["created_at", "image_id"], ascending=False, ignore_index=True)
        members, out = dict(list(b.groupby("similarity_cluster", sort=False))), []
        for cluster, rows in a.groupby("similarity_cluster", sort=False):
            own = members.get(cluster)
            if own is None:
                continue
            x, y = _stack(rows["vec"]), _stack(own["embedding"])
            best, most = np.zeros(len(x), int), np.zeros(len(x))
            for s in strips(len(x), len(y), cells):
                sims = np.round(x[s] @ y.T, 12)
                best[s], most[s] = sims.argmax(1), sims.max(1)
            out.append(pd.DataFrame({"at": rows["at"].to_numpy(), "sim": most, "created_at": own["created_at"].to_numpy()[best], "image_id": own["image_id"].to_numpy()[best], "similarity_cluster": cluster}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("at", "sim", "created_at", "image_id", "similarity_cluster")})

    found = left.groupBy("l", "i", "j").cogroup(right.groupBy("r", "i", "j")).applyInPandas(compare, "at long, sim double, created_at timestamp, image_id string, similarity_cluster long")
    return found.groupBy("at").agg(F.max(F.struct("sim", "created_at", "image_id", "similarity_cluster")).alias("b")).select("at", "b.*")


def nearest_earlier(uploads: DataFrame) -> DataFrame:
    """``at, sim, other``: of uploads (at, vec) that come earlier in the batch the best, the latest among equals."""

    def keep(a_keys, a, b_keys, b, same) -> pd.DataFrame:
        out = []
        sides = [(a_keys, a, b_keys, b)] + ([] if same else [(b_keys, b, a_keys, a)])
        for keys, x, others, y in sides:
            order = np.argsort(-others)
            sims = np.where(others[order] < keys[:, None], np.round(x @ y[order].T, 12), -np.inf)
            best = sims.argmax(1)
            out.append(pd.DataFrame({"at": keys, "sim": sims[np.arange(len(keys)), best], "other": others[order][best]}))
        found = pd.concat(out)
        return found[np.isfinite(found["sim"])]

    pairs = all_pairs(uploads.select("at", "vec"), "at", "vec", keep, "at long, sim double, other long")
    return pairs.groupBy("at").agg(F.max(F.struct("sim", "other")).alias("b")).select("at", "b.*")


def follow(pointers: DataFrame) -> DataFrame:
    """``at, root, similarity_cluster`` of ``pointers`` (at, up, similarity_cluster): the end of each chain of ``up`` and the cluster there.

    Each round doubles the length of chain that a pointer spans, and writes only the pointers still open.
    """
    done = pointers.where("up is null").select("at", F.col("at").alias("root"), "similarity_cluster")
    ends = stage(done, "ends")
    open_ = stage(pointers.where("up is not null").select("at", "up"), "pointers")
    while not open_.isEmpty():
        arrived = open_.join(ends.withColumnRenamed("at", "up"), "up").select("at", "root", "similarity_cluster")
        further = open_.join(open_.select(F.col("at").alias("up"), F.col("up").alias("_next")), "up").select("at", F.col("_next").alias("up"))
        ends, open_ = stage(ends.unionByName(arrived), "ends"), stage(further, "pointers")
    return ends


class PostsStore(BucketStore):
    """The posts with their cluster summaries and content hashes; version 0 holds the posts to begin with."""

    def __init__(self, spark: SparkSession, path: str, threshold: float, buckets: int = BUCKETS):
        super().__init__(spark, path, {"posts": (POSTS, "similarity_cluster"), "clusters": (CLUSTERS, "similarity_cluster"), "hashes": (HASHES, "image_sha256")}, buckets)
        self.threshold = threshold

    def create(self, posts: DataFrame) -> None:
        kinds = [c.split() for c in POSTS.split(", ")]
        rows = stage(posts.select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds]), "posts")
        self.publish(0, {"posts": rows, "clusters": summaries(rows), "hashes": rows.where("image_sha256 is not null")})

    def posts(self, n: int) -> DataFrame:
        return self.read("posts", n)

    def place(self, uploads: DataFrame, n: int) -> DataFrame:
        """New posts for the valid uploads, in ``COLUMNS``, placed against version ``n``; uploads whose id and content are stored already, or came earlier in the batch, count once."""
        first = uploads.where(upload_reason().isNull()).groupBy("image_id").agg(F.min(F.struct("created_at", "image_sha256", "handle", "ai_probability", F.col("embedding").cast("array<double>").alias("embedding"))).alias("u")).select("image_id", "u.*")
        rows = stage(number_rows(first, F.col("created_at"), F.col("image_id"), name="at"), "uploads")
        known = self.read("hashes", n, self.touched(rows.where("image_sha256 is not null"), "hashes"))
        rows = rows.join(known.select("image_sha256", "image_id"), ["image_sha256", "image_id"], "left_anti")
        stored = known.groupBy("image_sha256").agg(F.max(F.struct("created_at", "image_id", "similarity_cluster")).alias("s")).select("image_sha256", F.col("s.image_id").alias("same_id"), F.col("s.similarity_cluster").alias("same"))
        leads = rows.where("image_sha256 is not null").groupBy("image_sha256").agg(F.min("at").alias("lead"))
        rows = stage(rows.join(stored, "image_sha256", "left").join(leads, "image_sha256", "left").withColumn("lead", F.coalesce("lead", "at")), "matched")
        # A copy takes the vector of what it copies.
        sources = self.read("posts", n, self.touched(rows.where("same is not null"), "posts", F.col("same"))).select(F.col("image_id").alias("same_id"), F.col("embedding").alias("_stored"))
        lead_vectors = rows.where("at = lead").select("lead", F.col("embedding").alias("_lead"))
        vec = F.when(F.col("same").isNotNull(), F.col("_stored")).otherwise(F.col("_lead"))
        rows = rows.join(sources, "same_id", "left").join(lead_vectors, "lead", "left").withColumn("vec", F.when(F.size(vec) > 0, vec)).drop("_stored", "_lead", "embedding")
        rows = stage(rows.withColumn("asks", F.col("same").isNull() & (F.col("at") == F.col("lead")) & F.col("vec").isNotNull()), "vectors")

        asked = rows.where("asks").select("at", "vec")
        open_ = stage(open_clusters(asked, self.read("clusters", n), self.threshold), "open")
        members = self.read("posts", n, self.touched(open_, "posts"))
        old = nearest_members(asked.join(open_, "at"), members).select("at", F.struct("sim", "created_at", "image_id", "similarity_cluster", F.lit(None).cast("long").alias("up")).alias("b"))
        times = rows.select(F.col("at").alias("other"), "created_at", "image_id")
        new = nearest_earlier(rows.where("vec is not null")).join(rows.where("asks").select("at"), "at").join(times, "other")
        new = new.select("at", F.struct("sim", "created_at", "image_id", F.lit(None).cast("long").alias("similarity_cluster"), F.col("other").alias("up")).alias("b"))
        best = old.unionByName(new).groupBy("at").agg(F.max("b").alias("b")).where((F.col("b.sim") > 0) & (F.col("b.sim") >= self.threshold))
        joined = rows.select("at", "same", "lead").join(best, "at", "left")
        cluster = F.coalesce("same", "b.similarity_cluster")
        up = F.when(F.col("same").isNull() & (F.col("at") != F.col("lead")), F.col("lead")).when(F.col("same").isNull(), F.col("b.up"))
        ends = follow(stage(joined.select("at", up.alias("up"), F.when(up.isNull(), cluster).alias("similarity_cluster")), "pointers"))

        # New clusters follow the greatest one, in the order in which their first uploads came.
        top = self.read("clusters", n).agg(F.coalesce(F.max("similarity_cluster"), F.lit(-1)).alias("top")).first()["top"]
        born = number_rows(ends.where("at = root and similarity_cluster is null").select("root"), F.col("root"), name="_n").select("root", (F.col("_n") + F.lit(top + 1)).alias("_new"))
        placed = ends.join(born, "root", "left").select("at", F.coalesce("similarity_cluster", "_new").alias("similarity_cluster"))
        copy = F.col("same").isNotNull() | (F.col("at") != F.col("lead"))
        placed = rows.join(placed, "at").join(best.select("at", F.col("b.sim").alias("_sim")), "at", "left")
        placed = stage(placed.withColumn("similarity_score", F.when(copy, F.lit(1.0)).otherwise(F.coalesce("_sim", F.lit(0.0)))), "placed")
        # The score is at least that of any member that came before.
        tops = self.read("clusters", n, self.touched(placed, "clusters")).select("similarity_cluster", F.col("top").alias("_top"))
        raised = running(placed, "similarity_cluster", "at", F.max, F.greatest, ["ai_probability"]).join(tops, "similarity_cluster", "left")
        raised = raised.withColumn("ai_probability", F.greatest("ai_probability", "_top"))
        return raised.withColumn("embedding", F.col("vec")).withColumn("repetition_score", F.lit(0.0)).withColumn("diversity_label", label_for(F.col("ai_probability"), F.lit(False))).select(*COLUMNS)

    def apply(self, uploads: DataFrame, n: int) -> None:
        """Version ``n + 1``: version ``n`` with the batch placed, and the clusters that it touched recalculated and annotated."""
        new = stage(self.place(uploads, n), "new")
        touched = stage(new.select("similarity_cluster").distinct(), "touched")
        buckets, hashed = self.touched(touched, "posts"), self.touched(new.where("image_sha256 is not null"), "hashes")
        old = self.read("posts", n, buckets)
        of_touched = old.join(touched, "similarity_cluster", "left_semi").select(*COLUMNS).unionByName(new)
        changed = stage(annotate_similarity(recalculate_clusters(of_touched).select(*COLUMNS)).select(*COLUMNS), "changed")
        rest = old.join(touched, "similarity_cluster", "left_anti").select(*COLUMNS)
        kept = self.read("clusters", n, buckets).join(touched, "similarity_cluster", "left_anti")
        hashes = self.read("hashes", n, hashed).unionByName(new.where("image_sha256 is not null").select(*[c.split()[0] for c in HASHES.split(", ")]))
        self.publish(n + 1, {"posts": rest.unionByName(changed), "clusters": summaries(changed).unionByName(kept.select(*[c.split()[0] for c in CLUSTERS.split(", ")])), "hashes": hashes}, before=n)


def apply_batch(uploads: DataFrame, posts: DataFrame, threshold: float) -> DataFrame:
    """The posts after a batch, for posts that are not in a store."""
    store = PostsStore(posts.sparkSession, new_path(posts.sparkSession, "store"), threshold, buckets=8)
    store.create(posts)
    store.apply(uploads, 0)
    return store.posts(1)


def with_public_scores(posts: DataFrame) -> DataFrame:
    return posts.withColumn("confidence", confidence(F.col("ai_probability"))).withColumn("robustness", robustness(F.col("ai_probability"), ROBUST_UPLOAD))


def run_stream(stream: DataFrame, store: PostsStore, checkpoint: str, keep: int = 2):
    """Apply each micro-batch of ``stream``; version 0 of the store must exist, and the ``keep`` versions before the last stay. Returns the started query.

    Batch n makes version n + 1 of version n, so a batch that runs again counts once.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        store.apply(batch, batch_id)
        if batch_id >= keep:
            store.forget(batch_id - keep, batch_id - keep + 1)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()


def windowed_counts(events: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Extension: events by window and type, late rows dropped after the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
