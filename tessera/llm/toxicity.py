"""Toxicity by gradient-boosted trees over dense features (operator 4).

Labels teach three things, all from at most ``MAX_TRAIN`` labelled rows (those
with the smallest hash of their id, among the rows not held out):

* a lexicon: words and word beginnings of 4 to 7 letters whose document
  frequency differs between the classes beyond ``Z_STRONG`` or ``Z_MEDIUM``
  standard errors. It is cross-fitted: training rows get their features from the
  lexicon of the other half, so that chance terms do not look like evidence;
* trees on the logistic loss with Newton leaves, over lexicon densities,
  second-person proximity, capitals, punctuation and obfuscation rates;
* an isotonic calibration of out-of-fold margins, linear between its steps.

The whole text of every document is scored. Language, source and id are never
inputs of a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.scratch import stage

MAX_TRAIN, MAX_TERMS, THRESHOLD = 8192, 512, 0.7
Z_STRONG, Z_MEDIUM, PREFIXES, WINDOW, NEAR = 6.0, 4.0, (4, 5, 6, 7), 24, 4
#: Entries of a task's table of tokens, and the longest token that it holds: some 50 MB.
CACHE, CACHED_CHARS = 300_000, 40
#: Counted terms that a worker holds before it hands them on.
HELD_TERMS = 1 << 16

SEED = frozenset("idiot idiots stupid moron morons loser losers scum trash worthless pathetic disgusting dumb fool imbecile clown garbage hate hateful kill die ugly filthy vermin shut jerk creep freak".split())
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split())
LEET = str.maketrans("013457@$!", "oieastasi")
FEATURES = (
    "log_words", "strong_density", "strong_count", "medium_density", "log_odds_density", "strong_distinct", "seed_density", "second_density",
    "near_second", "capitals", "shouted", "punctuation", "repeated_marks", "obfuscated", "digits", "window_peak",
)
_EDGE = re.compile(r"^[^\w]+|[^\w]+$")
_HIDDEN = re.compile(r"[^\W\d_][\d@$!*.\-_]+[^\W\d_]")
_MARKS = re.compile(r"[!?]{2,}|([^\w\s])\1{2,}")


def terms_of(token: str) -> list[str]:
    """The word in a token, undisguised, and its beginnings."""
    word = _EDGE.sub("", token).lower()
    if _HIDDEN.search(word):
        word = word.translate(LEET).replace("*", "").replace(".", "").replace("-", "").replace("_", "")
    if not word or not word.isalpha():
        return []
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) >= k)]


class Lexicon:
    """weights: term to log-odds, of strong and medium terms."""

    def __init__(self, strong: dict[str, float], medium: dict[str, float]):
        self.strong, self.medium = strong, medium


def learn_lexicon(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> Lexicon:
    """toxic, clean: documents of each class that have a term."""
    strong, medium = [], []
    for term, a in toxic.items():
        b, n = clean.get(term, 0), n_toxic + n_clean
        if a < 3 or not n_clean:
            continue
        p = (a + b) / n
        z = (a / n_toxic - b / n_clean) / max(1e-9, (p * (1 - p) * (1 / n_toxic + 1 / n_clean)) ** 0.5)
        weight = float(np.log((a + 0.5) / (n_toxic + 1)) - np.log((b + 0.5) / (n_clean + 1)))
        if z >= Z_STRONG and weight >= 1.2:
            strong.append((-z, term, weight))
        elif z >= Z_MEDIUM and weight >= 0.5:
            medium.append((-z, term, weight))
    pick = lambda xs: {t: w for _, t, w in sorted(xs)[:MAX_TERMS]}
    return Lexicon(pick(strong), pick(medium))


class _Tokens(dict):
    """Raw token to the row of a table of token kinds; tokens of one kind share a row."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon, self.kinds, self.rows, self.table = lexicon, {}, [], np.zeros((0, 12))

    def __missing__(self, token: str) -> int:
        terms = terms_of(token)
        strong = max((self.lexicon.strong[t] for t in terms if t in self.lexicon.strong), default=0.0)
        medium = max((self.lexicon.medium[t] for t in terms if t in self.lexicon.medium), default=0.0)
        letters, word = sum(map(str.isalpha, token)), terms[0] if terms else ""
        kind = (
            float(strong > 0), float(medium > 0 and not strong), strong or medium, float(word in SEED), float(word in SECOND),
            float(sum(map(str.isupper, token))), float(letters > 1 and token.isupper()), float(len(token) - sum(map(str.isalnum, token))),
            float(bool(_MARKS.search(token))), float(bool(_HIDDEN.search(token))), float(sum(map(str.isdigit, token))), float(len(token)),
        )
        at = self.kinds.get(kind)
        if at is None:
            at = self.kinds[kind] = len(self.rows)
            self.rows.append(kind)
        if len(self) < CACHE and len(token) <= CACHED_CHARS:
            self[token] = at
        return at

    def features(self, text: str | None) -> np.ndarray:
        tokens = (text or "").split()
        n = len(tokens)
        if not n:
            return np.zeros(len(FEATURES))
        codes = np.fromiter(map(self.__getitem__, tokens), np.int64, n)
        if len(self.table) != len(self.rows):
            self.table = np.array(self.rows)
        counts = np.bincount(codes, minlength=len(self.table))
        s = counts @ self.table
        flag = self.table[:, 0] > 0
        hit = flag[codes]
        near = peak = distinct = 0
        if s[0]:
            at = np.flatnonzero(hit)
            distinct = len({_EDGE.sub("", tokens[i]).lower() for i in at})
            peak = np.max(np.arange(1, len(at) + 1) - np.searchsorted(at, at - WINDOW, side="right"))
            if s[4]:
                you = np.flatnonzero(self.table[codes, 4])
                k = np.searchsorted(you, at)
                gap = np.minimum(np.abs(at - you[np.minimum(k, len(you) - 1)]), np.abs(at - you[np.maximum(k - 1, 0)]))
                near = int((gap <= NEAR).sum())
        chars = max(1.0, s[11])
        return np.array([
            np.log1p(n), s[0] / n, np.log1p(s[0]), s[1] / n, s[2] / n, np.log1p(distinct), s[3] / n, s[4] / n,
            near / n, s[5] / chars, s[6] / n, s[7] / chars, s[8] / n, s[9] / n, s[10] / chars, peak / min(n, WINDOW),
        ])


class BoostedTrees:
    """Histogram trees on the logistic loss."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.12, bins: int = 48, l2: float = 2.0, least: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.l2, self.least = trees, depth, rate, bins, l2, least
        self.base, self.fitted = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        width, (n, features) = self.bins + 1, x.shape
        margin = np.full(n, self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            node, splits = np.zeros(n, np.int64), []
            for level in range(self.depth):
                nodes = 1 << level
                feature, cut, edge = np.zeros(nodes, np.int64), np.full(nodes, width), np.full(nodes, np.inf)
                best = np.full(nodes, 1e-6)
                for f in range(features):
                    key = node * width + binned[:, f]
                    G = np.bincount(key, g, nodes * width).reshape(nodes, width).cumsum(1)
                    H = np.bincount(key, h, nodes * width).reshape(nodes, width).cumsum(1)
                    gl, hl, gt, ht = G[:, :-1], H[:, :-1], G[:, -1:], H[:, -1:]
                    gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
                    gain = np.where((hl >= self.least) & (ht - hl >= self.least), gain, 0)[:, : len(edges[f])]
                    if not gain.shape[1]:
                        continue
                    at = gain.argmax(1)
                    top = gain[np.arange(nodes), at]
                    better = top > best
                    best[better], feature[better], cut[better], edge[better] = top[better], f, at[better], edges[f][at[better]]
                splits.append((feature, edge))
                node = node * 2 + (binned[np.arange(n), feature[node]] > cut[node])
            leaves = 1 << self.depth
            value = -self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.l2)
            margin += value[node]
            self.fitted.append((splits, value))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for splits, value in self.fitted:
            node = np.zeros(len(x), np.int64)
            for feature, edge in splits:
                node = node * 2 + (x[rows, feature[node]] > edge[node])
            out += value[node]
        return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the increasing fit by pooling adjacent violators: a block's mean margin and its rate."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # rate, rows, mean margin
    for m, v in zip(margin[order], y[order]):
        blocks.append([float(v), 1.0, float(m)])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][2] == blocks[-1][2]):
            v2, n2, m2 = blocks.pop()
            v1, n1, m1 = blocks.pop()
            n = n1 + n2
            blocks.append([(v1 * n1 + v2 * n2) / n, n, (m1 * n1 + m2 * n2) / n])
    return np.array([b[2] for b in blocks]), np.array([b[0] for b in blocks])


class Model:
    """Scores texts; with ``trees`` None (labels of one class only) it answers ``prior``."""

    def __init__(self, lexicon: Lexicon, trees: BoostedTrees | None, knots, prior: float):
        self.lexicon, self.trees, self.knots, self.prior = lexicon, trees, knots, prior

    def calibrated(self, margin: np.ndarray) -> np.ndarray:
        at, rate = self.knots
        # A trace of the margin keeps the order inside flat stretches.
        trace = 1 / (1 + np.exp(-margin))
        return np.clip(0.999 * np.interp(margin, at, rate) + 0.001 * trace, 0.0, 1.0)

    def scores(self, texts: Iterable[str | None], tokens: _Tokens) -> np.ndarray:
        if self.trees is None:
            return np.array([self.prior for _ in texts])
        rows = [tokens.features(t) for t in texts]
        return self.calibrated(self.trees.margin(np.stack(rows))) if rows else np.zeros(0)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> Model:
    """Learn from the labelled rows that are not held out, at most ``max_train`` of them.

    Null ids and labels are left out; of several labels of an id the largest
    counts. Without rows of both classes the model answers their rate.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64(F.col(id_col)), id_col).limit(max_train).select(F.col(id_col).alias("id"), "y")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # The broadcast side has max_train rows of two numbers at most.
    sample = stage(texts.join(F.broadcast(chosen), "id").withColumn("half", F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)).cast("int")), "sample")

    def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def handed_on() -> pa.RecordBatch:
            columns = zip(*found) if found else ((), (), ())
            kinds = (pa.string(), pa.int32(), pa.int32())
            out = [pa.array(c, kind) for c, kind in zip(columns, kinds)] + [pa.array(found.values(), pa.int64())]
            return pa.RecordBatch.from_arrays(out, names=["term", "y", "half", "n"])

        for batch in batches:
            for text, y, half in zip(batch["text"], batch["y"].to_pylist(), batch["half"].to_pylist()):
                found.update((t, y, half) for t in set(chain.from_iterable(map(terms_of, set((text.as_py() or "").split())))))
                if len(found) >= HELD_TERMS:
                    yield handed_on()
                    found.clear()
        yield handed_on()

    counts = sample.mapInArrow(count_terms, "term string, y int, half int, n long").groupBy("term").pivot("y", [0, 1])
    sums = [F.sum(F.when(F.col("half") == k, F.col("n"))).alias(f"h{k}") for k in (0, 1)]
    # Terms of a bounded sample; only those in three or more toxic rows can enter a lexicon.
    terms = counts.agg(*sums).fillna(0).where("`1_h0` + `1_h1` >= 3").toPandas()
    sizes = {(r["y"], r["half"]): r["n"] for r in sample.groupBy("y", "half").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = lambda y, halves: sum(sizes.get((y, k), 0) for k in halves)
    total = n(0, (0, 1)) + n(1, (0, 1))
    prior = n(1, (0, 1)) / total if total else 0.0
    if not n(1, (0, 1)) or not n(0, (0, 1)):
        return Model(Lexicon({}, {}), None, None, prior)

    def lexicon(halves) -> Lexicon:
        of = lambda y: {t: int(v) for t, v in zip(terms["term"], sum(terms[f"{y}_h{k}"] for k in halves)) if v}
        return learn_lexicon(of(1), of(0), max(1, n(1, halves)), n(0, halves))

    other = [lexicon((1,)), lexicon((0,))]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = [_Tokens(x) for x in other]
        for batch in batches:
            x = [tokens[k].features(t.as_py()) for t, k in zip(batch["text"], batch["half"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["y"], pa.array(x, pa.list_(pa.float64()))], names=["id", "y", "x"])

    rows = sample.withColumn("id", F.col("id").cast("string")).mapInArrow(extract, "id string, y int, x array<double>").toPandas().sort_values("id", ignore_index=True)
    x, y = np.array(rows["x"].tolist()), rows["y"].to_numpy(float)
    fold, out = np.arange(len(y)) % 5, np.zeros(len(y))
    for k in range(5):
        if (fold == k).any() and (fold != k).any():
            out[fold == k] = BoostedTrees().fit(x[fold != k], y[fold != k]).margin(x[fold == k])
    return Model(lexicon((0, 1)), BoostedTrees().fit(x, y), isotonic(out, y), prior)


def with_score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a score between 0 and 1; null and empty texts get that of a text without words."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = _Tokens(model.lexicon)
        for texts in batches:  # one text at a time becomes a string
            yield pa.array(model.scores((t.as_py() for t in texts), tokens))

    return docs.withColumn(out, score(F.col(text_col)))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """The score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
