"""N-gram Jaccard join by grouped prefixes (operator 5).

Documents are sets of word shingles, held as 64-bit hashes; what two sets share
is only ever counted between the two. Sets and prefixes are told apart by 128-bit
digests. Two link when ``100 * intersection >= threshold * union``. The join is exact:

1. *Order.* A counter of ``ORDER_BUCKETS`` cells counts every shingle of every
   document. Shingles are ordered by their cell's count, then by hash. Any fixed
   order is right; this one puts shared passages last, out of the prefixes. The
   counter's size is a parameter and does not grow with the input: a task emits
   it in blocks, and the tasks that add up blocks hold one counter at most.
2. *Sets.* Equal sets form one class, which gets a number. Only classes are joined.
3. *Groups.* Classes with one prefix and one size form a group. Prefix lists,
   size, position and count filters work on groups.
4. *Stars.* In each group and in each long prefix list, all are verified against
   one leader first, and linked classes are merged into components. A hot list
   of near copies is thereby settled by as many checks as it has members; where
   long lists stay open to many pairs, three further leaders follow.
5. *Rest.* Group pairs that may still join different components are filtered by
   size, position, parity bits and number of shared prefix shingles, expanded into
   their member pairs, and verified. No candidate between two components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bitmap
from tessera.llm.columns import free_name
from tessera.operators.components import connected_components
from tessera.plans.scratch import stage

ORDER_BUCKETS, ORDER_BLOCK = 1 << 22, 1 << 15
#: Lists of more groups than this are first compared with a leader.
LONG_LIST = 16
#: Leaders of a long list: the first alone, the others together if the list stays open.
FIRST_LEADER, MORE_LEADERS = (0,), (1, 2, 3)
#: Bits of the filter that picks the texts whose sets are needed: 4 MB.
SET_BITS = 1 << 25
PAIR_BITS = 1 << 22
WORD_CACHE = 1 << 17
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)


class _Words(dict):
    """Word to 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORD_CACHE:
            self[word] = h
        return h


def _finish(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX[5]
    x = x ^ (x >> np.uint64(29))
    x = x * _MIX[6]
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, k: int, words: _Words) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text; A-Z lower-cased, words split at ASCII white space."""
    tokens = (text or "").encode().lower().split()
    n = len(tokens)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, tokens), np.uint64, n)
    if n < k:
        factors = _finish(np.arange(1, n + 1, dtype=np.uint64) * _MIX[0]) | np.uint64(1)
        return _finish((h * factors).sum(dtype=np.uint64, keepdims=True) + np.array([n], np.uint64) * _MIX[4])
    x = np.zeros(n - k + 1, np.uint64)
    for i in range(k):  # Horner's rule keeps the order of the words
        x = _finish(x * _MIX[1] + h[i : n - k + 1 + i]) if i else h[: n - k + 1] * _MIX[3]
    return np.unique(x)


def _digest(s: np.ndarray, seed: int = 0) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes(), seed=seed)


def _cell(s: np.ndarray, cells: int) -> np.ndarray:
    return (s % np.uint64(cells)).astype(np.int64)


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs; the length tells how many."""
    top = counts.max(initial=0)
    return counts.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.int64).tobytes()


def _widened(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, {1: np.uint8, 2: np.uint16, 8: np.int64}[len(data) // width]).astype(np.int64)


def count_cells(docs: DataFrame, text_col: str, k: int, cells: int) -> np.ndarray:
    """Shingles in each cell, over all documents, as a rank that fits 16 bits (256 steps a doubling)."""
    width = min(cells, ORDER_BLOCK)
    kind = "block int, counts binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total, found, n = _Words(), np.zeros(cells, np.int64), [], 0
        for batch in batches:
            for text in batch.column(0):
                found.append(_cell(shingle_set(text.as_py(), k, words), cells))
                n += len(found[-1])
                if n >= 1 << 20:
                    total += np.bincount(np.concatenate(found), minlength=cells)
                    found, n = [], 0
        if found:
            total += np.bincount(np.concatenate(found), minlength=cells)
        for i in range(0, cells, width):
            if total[i : i + width].any():
                yield pa.RecordBatch.from_arrays([pa.array([i // width], pa.int32()), pa.array([_narrow(total[i : i + width])], pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = _widened(counts.as_py(), width)
                total[block] = total[block] + part if block in total else part
        for block, part in total.items():
            rank = np.round(256 * np.log2(1 + part)).astype(np.uint16).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([rank], pa.binary())], names=["block", "counts"])

    counted = docs.select(text_col).mapInArrow(count, kind)
    out = np.zeros(cells, np.uint16)
    for block, rank in counted.repartition("block").mapInArrow(add, kind).collect():  # 2 bytes a cell
        out[block * width : (block + 1) * width] = np.frombuffer(bytes(rank), np.uint16)
    return out


def parity(s: np.ndarray) -> tuple[int, int]:
    """128 bits, each the parity of the shingles that a hash gives to it: two sets differ in no fewer shingles than bits."""
    at = s >> np.uint64(57)
    one = np.left_shift(np.uint64(1), at & np.uint64(63))
    low = at < 64
    return int(np.bitwise_xor.reduce(one[low], initial=0).astype(np.int64)), int(np.bitwise_xor.reduce(one[~low], initial=0).astype(np.int64))


def prefix_length(n, threshold: int):
    """A partner shares at least ceil(threshold * n / 100) shingles, so one of the first n less that plus 1 is shared."""
    return n - (threshold * n + 99) // 100 + 1


def describe(docs: DataFrame, id_col: str, text_col: str, k: int, threshold: int, rank: np.ndarray) -> DataFrame:
    """``id, mark, n, digest, pkey, b0, b1, prefix`` of each document, as a written table.

    mark: hash of the text; n: set size; digest: of the set; pkey: digest of prefix and size; b0, b1: parities; prefix: in order.
    """
    kept = docs.sparkSession.sparkContext.broadcast(rank)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, order = _Words(), kept.value
        for batch in batches:
            n, digest, key, prefix, bits = [], [], [], [], []
            for text in batch.column(2):
                s = shingle_set(text.as_py(), k, words)
                n.append(len(s))
                if not len(s):
                    digest.append(None), key.append(None), prefix.append(None), bits.append((None, None))
                    continue
                first = s[np.argsort(order[_cell(s, len(order))], kind="stable")[: prefix_length(len(s), threshold)]]
                digest.append(_digest(s))
                key.append(_digest(first, seed=len(s)))
                prefix.append(first.view(np.int64))
                bits.append(parity(s))
            b0, b1 = (pa.array([x[i] for x in bits], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(key, pa.binary()), b0, b1, pa.array(prefix, pa.list_(pa.int64()))],
                names=["id", "mark", "n", "digest", "pkey", "b0", "b1", "prefix"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), text_col)
    out = stage(rows.mapInArrow(sets, f"id {kind}, mark long, n long, digest binary, pkey binary, b0 long, b1 long, prefix array<long>"), "prefixes")
    kept.destroy()
    return out


def _sets_of(docs: DataFrame, id_col: str, text_col: str, k: int, wanted: DataFrame) -> DataFrame:
    """``sig, n, shingles`` of the classes in ``wanted`` (sig, digest, id of one of its documents), as a written table.

    A bitmap of fixed size decides which texts are hashed again; the exact join follows.
    """
    bits = SET_BITS
    filled = np.zeros(bits // 8, np.uint8)
    for block, data in bitmap.build(wanted, F.col("id"), bits).collect():  # at most SET_BITS / 32768 rows
        at = int(block) * bitmap.BLOCK // 8
        filled[at : at + len(data)] = np.frombuffer(bytes(data), np.uint8)
    kept = docs.sparkSession.sparkContext.broadcast(filled)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, marks = _Words(), kept.value
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False)
            hit = np.flatnonzero((at < 0) | ((marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool))
            for i in range(0, len(hit), 512):
                found = [shingle_set(batch.column(1)[int(j)].as_py(), k, words) for j in hit[i : i + 512]]
                found = [s for s in found if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_digest(s) for s in found], pa.binary()), pa.array([len(s) for s in found], pa.int64()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))],
                    names=["digest", "n", "shingles"],
                )

    # A class whose documents have no id is found among the rows without id.
    at = F.when(F.col(id_col).isNull(), F.lit(-1)).otherwise(bitmap.position(F.col(id_col), bits)).cast("long")
    found = docs.select(at.alias("at"), text_col).mapInArrow(sets, "digest binary, n long, shingles array<long>")
    out = stage(found.join(wanted.select("digest", "sig"), "digest").dropDuplicates(["sig"]).select("sig", "n", "shingles"), "sets")
    kept.destroy()
    return out


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) of classes that link."""
    pairs = stage(pairs.select("a", "b").distinct(), "pairs")
    # Only sets that a fixed-size filter of the pairs' ends lets through are shuffled.
    ends = pairs.select(F.explode(F.array("a", "b")).alias("end"))
    sets = bitmap.probe(sets, F.col("sig"), bitmap.build(ends, F.col("end"), PAIR_BITS), PAIR_BITS, "_maybe").where("_maybe")
    a = sets.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    both = pairs.select("a", "b").join(b, "b").join(a, "a")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where((100 + threshold) * common >= threshold * (F.col("na") + F.col("nb"))).select("a", "b")


def _size_fits(threshold: int) -> str:
    return f"100 * least(l.n, r.n) >= {threshold} * greatest(l.n, r.n)"


def _may_link(threshold: int) -> str:
    """SQL over l and r (n, pos): sizes fit, and the shared shingle with all that follows on both sides suffices."""
    return f"{_size_fits(threshold)} and {100 + threshold} * least(l.n - l.pos, r.n - r.pos) >= {threshold} * (l.n + r.n)"


def _near(threshold: int) -> str:
    """SQL over l and r: the parities do not differ in more bits than linked sets may in shingles."""
    differing = "(bit_count(l.b0 ^ r.b0) + bit_count(l.b1 ^ r.b1))"
    return f"(l.b0 is null or r.b0 is null or {100 + threshold} * (l.n + r.n - {differing}) >= {2 * threshold} * (l.n + r.n))"


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: int = 80, cells: int = ORDER_BUCKETS) -> DataFrame:
    """``id, mark, n_shingles, component`` of every row; ``component`` is a number that names the linked classes.

    ``mark`` is a hash of the text. A text of fewer than ``k`` words is one
    shingle; null texts and texts without words have no set and null
    ``component``, and link with nothing. Rows that repeat an id count each by
    its own text. An empty table gives an empty result; further columns are ignored.
    """
    rank = count_cells(docs, text_col, k, cells)
    described = describe(docs, id_col, text_col, k, threshold, rank)
    # The prefix is a function of the set, so any row of a class carries it.
    classes = described.where("digest is not null").groupBy("digest").agg(
        F.min("id").alias("id"), F.first("n").alias("n"), *[F.first(c).alias(c) for c in ("pkey", "b0", "b1", "prefix")]
    )
    classes = stage(classes.withColumn("sig", F.monotonically_increasing_id()), "classes")
    members = classes.select("sig", "digest", "n", "pkey", "b0", "b1", "id").join(classes.groupBy("pkey").agg(F.min("sig").alias("gid"), F.count(F.lit(1)).alias("m")), "pkey")
    members = stage(members.select("sig", "digest", "n", "gid", "m", "b0", "b1", "id"), "members")
    # Most classes lead a group: a filter of fixed size spares their prefixes a shuffle.
    others = members.where("sig <> gid").select("sig")
    marked = bitmap.probe(classes.select("sig", "n", "prefix"), F.col("sig"), bitmap.build(others, F.col("sig"), PAIR_BITS), PAIR_BITS, "maybe")
    leads = marked.where("not maybe").unionByName(marked.where("maybe").join(others, "sig", "left_anti"))
    entries = leads.select(F.col("sig").alias("gid"), "n", F.posexplode("prefix").alias("pos", "token"))
    shared = entries.groupBy("token").agg(F.count(F.lit(1)).alias("groups")).where("groups > 1")
    lists = stage(entries.join(shared, "token").select("token", "gid", "n", "pos", "groups"), "lists")

    several = members.where("m > 1")
    concerned = _candidate_groups(lists, threshold).union(lists.where(f"groups > {LONG_LIST}").select("gid")).union(several.select("gid"))
    concerned = stage(concerned.distinct(), "concerned")
    lists = stage(lists.join(concerned, "gid", "left_semi"), "lists")
    sets = _sets_of(docs, id_col, text_col, k, members.join(concerned, "gid", "left_semi").select("sig", "digest", "id"))

    inner = several.where("sig <> gid").select(F.col("gid").alias("a"), F.col("sig").alias("b"))
    hot = stage(lists.where(f"groups > {LONG_LIST}").withColumn("component", F.col("gid")), "hot")
    stars = inner.unionByName(_star_pairs(hot, FIRST_LEADER, threshold))
    links = stage(_verified(stars, sets, threshold), "links")
    components = connected_components(links, "a", "b", staged=True)
    hot = _labelled(hot.drop("component"), components, "gid")
    if _still_wide(hot):
        links = stage(links.unionByName(_verified(_star_pairs(hot, MORE_LEADERS, threshold), sets, threshold)), "links")
        components = connected_components(links, "a", "b", staged=True)

    rest = _remaining(lists, members.join(concerned, "gid", "left_semi"), classes.select("sig", "prefix"), components, threshold)
    links = stage(links.unionByName(_verified(rest, sets, threshold)), "links")
    components = connected_components(links, "a", "b", staged=True)
    named = classes.select("digest", "sig").join(components, F.col("sig") == F.col("node"), "left").select("digest", F.coalesce("component", "sig").alias("component"))
    return described.join(named, "digest", "left").select("id", "mark", F.col("n").alias("n_shingles"), "component")


def _candidate_groups(lists: DataFrame, threshold: int) -> DataFrame:
    """``gid`` of the groups that short lists alone cannot clear.

    Shared shingles are counted over the short lists; a pair may share each entry
    that both have in long ones, so these are added before the count filter. Groups
    of long lists are all concerned anyway.
    """
    short = lists.where(f"groups <= {LONG_LIST}")
    pairs = short.alias("l").join(short.alias("r"), F.expr("l.token = r.token and l.gid < r.gid and " + _size_fits(threshold)))
    counted = pairs.groupBy(F.col("l.gid").alias("g"), F.col("r.gid").alias("h")).agg(F.count(F.lit(1)).alias("common"), F.max("l.n").alias("p"), F.max("r.n").alias("q"))
    in_long = lists.where(f"groups > {LONG_LIST}").groupBy("gid").agg(F.count(F.lit(1)).alias("k"))
    counted = counted.join(in_long.select(F.col("gid").alias("g"), F.col("k").alias("kg")), "g", "left").join(in_long.select(F.col("gid").alias("h"), F.col("k").alias("kh")), "h", "left")
    most = f"common + least(coalesce(kg, 0), coalesce(kh, 0)) + {_behind(threshold)}"
    kept = counted.where(f"{100 + threshold} * ({most}) >= {threshold} * (p + q)")
    return kept.select(F.explode(F.array("g", "h")).alias("gid"))


def _behind(threshold: int) -> str:
    """SQL over p and q (set sizes): the most shingles that two groups can share behind their prefixes."""
    return f"greatest(({threshold} * p + 99) div 100 - 1, ({threshold} * q + 99) div 100 - 1)"


def _star_pairs(hot: DataFrame, turns: tuple[int, ...], threshold: int) -> DataFrame:
    """Pairs (a, b) of the leaders of each long list and the groups of other components in it; one leader for each turn.

    Edits of a copy give rare shingles, which come first in the order. In turn 0 thus leads the group with the fewest
    shingles before the list's, so that the others differ from it by their own edits only; further leaders are drawn.
    """
    drawn = [F.xxhash64("gid", F.lit(turn)) for turn in turns]
    leads = [F.min(F.struct((F.col("pos") if turn == 0 else F.lit(0)).alias("before"), d.alias("drawn"), "gid", "n", "pos", "component")) for turn, d in zip(turns, drawn)]
    lead = hot.groupBy("token").agg(F.array(*leads).alias("leads"), F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    lead = lead.select("token", F.inline("leads"))
    found = hot.alias("r").join(lead.alias("l"), F.expr("l.token = r.token and l.component <> r.component and " + _may_link(threshold)))
    return found.select(F.col("l.gid").alias("a"), F.col("r.gid").alias("b")).distinct()


def _still_wide(hot: DataFrame) -> bool:
    """Whether the long lists would still give many more pairs between components than they have entries."""
    sizes = hot.groupBy("token", "component").agg(F.count(F.lit(1)).alias("c"))
    lists = sizes.groupBy("token").agg(F.sum("c").alias("m"), F.max("c").alias("top"))
    row = lists.agg(F.sum(F.expr("(m - top) * m")).alias("pairs"), F.sum("m").alias("entries")).first()
    return (row["pairs"] or 0) > 4 * (row["entries"] or 0)


def _labelled(df: DataFrame, components: DataFrame, key: str) -> DataFrame:
    return stage(df.join(components.select(F.col("node").alias(key), "component"), key, "left").withColumn("component", F.coalesce("component", F.col(key))), "labelled")


def _remaining(lists: DataFrame, members: DataFrame, prefixes: DataFrame, components: DataFrame, threshold: int) -> DataFrame:
    """Class pairs (a, b) of different components that the filters cannot rule out.

    The first shingle that two linked sets share lies so early in the smaller one
    that twice the threshold still fits behind it. Entries are thus `early` or not,
    and those that are not only meet early ones: a passage that many documents share
    comes last in the order and gives no pairs by itself.
    """
    labelled = _labelled(members, components, "sig")
    # A group has one label if all its members have; else null, which differs from every label.
    groups = labelled.groupBy("gid").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("m"), F.min("b0").alias("b0"), F.min("b1").alias("b1"))
    # The parities of a group with one member are those of its set.
    single = F.col("m") == 1
    groups = groups.select("gid", F.when(F.col("x") == F.col("y"), F.col("x")).alias("label"), *[F.when(single, F.col(c)).alias(c) for c in ("b0", "b1")])
    entries = lists.join(groups, "gid").withColumn("early", F.expr(f"{100 + threshold} * (n - pos) >= {2 * threshold} * n"))
    sizes = entries.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"))
    largest = sizes.groupBy("token").agg(F.max(F.struct("c", F.col("label").isNotNull().alias("known"), "label")).alias("top"), F.count(F.lit(1)).alias("labels"), F.max(F.col("label").isNull()).alias("mixed"))
    largest = largest.where("labels > 1 or mixed").select("token", F.col("top.label").alias("main"))
    entries = stage(entries.join(largest, "token"), "open")
    # Of two groups with different labels one is outside the list's main label: enumerate those against the list.
    outside = entries.where("label is null or main is null or label <> main")
    outside = outside.withColumn("partner", F.explode(F.when(F.col("early"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))
    differ = "(l.label is null or r.label is null or l.label <> r.label)"
    once = "(r.label is not null and r.main is not null and r.label = r.main or l.gid < r.gid)"
    found = outside.alias("l").join(entries.alias("r"), F.expr(f"l.token = r.token and l.partner = r.early and l.gid <> r.gid and {differ} and {once} and {_near(threshold)} and " + _may_link(threshold)))
    met = found.select(
        F.least("l.gid", "r.gid").alias("g"), F.greatest("l.gid", "r.gid").alias("h"),
        F.expr("if(l.gid < r.gid, l.n, r.n)").alias("p"), F.expr("if(l.gid < r.gid, r.n, l.n)").alias("q"),
        F.expr("least(l.n - l.pos, r.n - r.pos)").alias("after"),
    )
    # Those met are the first of all shared shingles; behind the last of them no more than the shorter rest is shared.
    met = met.groupBy("g", "h").agg(F.count(F.lit(1)).alias("common"), F.min("after").alias("after"), F.max("p").alias("p"), F.max("q").alias("q"))
    need = f"{threshold} * (p + q)"
    met = stage(met.where(f"{100 + threshold} * (common + after - 1) >= {need}").select("g", "h", "p", "q"), "met")
    # Of the whole prefixes, all shared shingles count, and no more can follow than the longer rest behind a prefix.
    both = met.select(F.explode(F.array("g", "h")).alias("end"))
    prefixes = bitmap.probe(prefixes, F.col("sig"), bitmap.build(both, F.col("end"), PAIR_BITS), PAIR_BITS, "maybe").where("maybe")
    ends = prefixes.select(F.col("sig").alias("g"), F.col("prefix").alias("pg")), prefixes.select(F.col("sig").alias("h"), F.col("prefix").alias("ph"))
    whole = met.join(ends[0], "g").join(ends[1], "h").withColumn("common", F.size(F.array_intersect("pg", "ph")))
    kept = stage(whole.where(f"{100 + threshold} * (common + {_behind(threshold)}) >= {need}").select("g", "h"), "pairs")
    m = labelled.select("gid", "sig", "component")
    left, right = m.select(F.col("gid").alias("g"), F.col("sig").alias("a"), F.col("component").alias("ca")), m.select(F.col("gid").alias("h"), F.col("sig").alias("b"), F.col("component").alias("cb"))
    across = kept.join(left, "g").join(right, "h").where("ca <> cb").select("a", "b")
    mixed = labelled.join(groups.where("label is null").select("gid"), "gid", "left_semi")
    inside = mixed.alias("l").join(mixed.alias("r"), F.expr("l.gid = r.gid and l.sig < r.sig and l.component <> r.component")).select(F.col("l.sig").alias("a"), F.col("r.sig").alias("b"))
    return across.unionByName(inside)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: int = 80) -> DataFrame:
    """``id, n_shingles, component_id`` of every row: the smallest id of its component, its own id without a set."""
    linked = stage(link(docs, id_col, text_col, k, threshold), "linked")
    least = linked.where("component is not null").groupBy("component").agg(F.min("id").alias("least"))
    return linked.join(least, "component", "left").select("id", "n_shingles", F.coalesce("least", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: int = 80, keep_unknown: bool = True) -> DataFrame:
    """``docs`` with one row of each component, that with the smallest id; all columns as they were.

    Of rows that repeat the id that stays, one does: that whose text has the
    smallest hash, and one of those whose id and text are the same. Rows without an
    id stay with ``keep_unknown``; else only one of a component without any id does.
    Rows without a set all stay. An empty table gives an empty result.
    """
    linked = stage(link(docs, id_col, text_col, k, threshold), "linked")
    rows = linked.where("component is not null").groupBy("component", "id", "mark").agg(F.count(F.lit(1)).alias("n"))
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "mark")
    best = rows.groupBy("component").agg(F.min(rank).alias("best"), F.sum("n").alias("all")).where(F.col("all") > 1)
    stays = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("mark") == F.col("best.mark"))
    gone = rows.join(best, "component").withColumn("stay", stays.cast("int")).where("n > stay")
    if keep_unknown:
        gone = gone.where("id is not null")
    gone = stage(gone.select("id", "mark", "stay"), "gone")
    mark, maybe, gone_id, gone_mark = (free_name(docs, x) for x in ("_mark", "_maybe", "_gone_id", "_gone_mark"))
    marked = docs.withColumn(mark, F.xxhash64(text_col))
    marked = bitmap.probe(marked, F.col(mark), bitmap.build(gone, F.col("mark"), SET_BITS), SET_BITS, maybe)
    touched = marked.where(F.col(maybe))
    match = F.col(id_col).eqNullSafe(F.col(gone_id)) & (F.col(mark) == F.col(gone_mark))
    named = gone.select(F.col("id").alias(gone_id), F.col("mark").alias(gone_mark), "stay")
    free = marked.where(~F.col(maybe)).unionByName(touched.join(named.drop("stay"), match, "left_anti"))
    repeated = named.where("stay > 0").drop("stay")
    if not repeated.isEmpty():
        free = free.unionByName(touched.join(repeated, match, "left_semi").dropDuplicates([id_col, mark]))
    return free.drop(mark, maybe)


def op5_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Every document with its set size and component: 4-word shingles, 85 of 100."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, k=4, threshold=85).withColumnRenamed("id", "doc_id")


SQL = {
    "op5_ngram_join": r"""
    with recursive w as (
      select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws
      from documents),
    s as (
      select doc_id, list_distinct(case when len(ws) = 0 then []::varchar[] when len(ws) < 4 then [array_to_string(ws, ' ')]
        else list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) end) as sh
      from w),
    t as (select distinct doc_id, unnest(sh) as g from s),
    common as (select a.doc_id as x, b.doc_id as y, count(*) as c from t a join t b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
    n as (select doc_id, max(len(sh)) as n from s group by 1),
    e as (select x, y from common join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 85 * (a.n + b.n - c)),
    sym as (select x, y from e union select y, x from e),
    reach as (select doc_id as x, doc_id as y from documents union select r.x, b.y from reach r join sym b on r.y = b.x)
    select s.doc_id, len(s.sh) as n_shingles, (select min(r.y) from reach r where r.x = s.doc_id) as component_id from s"""
}
