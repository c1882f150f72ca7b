"""SentencePiece encoding and decoding by a streaming Viterbi search (operator 6).

For every place of the text the search keeps the piece that ends there on the
best path, and extends it by each piece that starts there. For a model of kind
"unigram" the best path has the highest sum of scores. For a model of kind "bpe"
a path is admissible if no merge would cross two neighbouring pieces, that is,
if the two encode to themselves when joined; exactly one path to each place is,
and it is what the merges give. Either way the ids equal those of the library.

Memory is a window: a place survives while a piece that starts there may still go
on, that is, while the characters since are the beginning of a longer piece; that
is at most ``longest`` - 1 characters. After each character the back-pointers of
the surviving places are followed; where all of them meet in one boundary, the ids
before it are committed and forgotten. In ordinary text that happens every few
characters, inside words too. At the end of a word nothing survives but the end
itself, since no piece crosses from a word to the space that follows or holds a line
break. So the committed ids of a word are those of all its copies, and are remembered.

Characters without a piece become byte pieces. Texts of any length are encoded
whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
WORD_CACHE = PAIR_CACHE = 600_000
#: The longest word whose ids are remembered, and characters after which committed ones are forgotten.
REMEMBERED, CHUNK = 48, 1024


def seen_as(pieces) -> dict[str, int]:
    """What a string is: a piece (1), the beginning of a longer one (2), or both (3)."""
    out = dict.fromkeys((p[:k] for p in pieces for k in range(1, len(p))), 2)
    for p in pieces:
        out[p] = out.get(p, 0) | 1
    return out


class Vocabulary:
    """Pieces and scores of a model file; small and fixed, so it travels with the task."""

    def __init__(self, path: str = MODEL):
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_file=path)
        normal = [i for i in range(m.vocab_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        self.path, self.ids = path, {m.id_to_piece(i): i for i in normal}
        self.scores = {i: m.get_score(i) for i in normal}
        self.bytes_ = {int(m.id_to_piece(i)[3:5], 16): i for i in range(m.vocab_size()) if m.is_byte(i)}
        self.unknown = m.unk_id()
        self.longest = max(map(len, self.ids))
        self.rank = {p: self.scores[i] for p, i in self.ids.items()}
        self.seen = seen_as(self.ids)
        self.prefix = bool(m.encode("a", out_type=str)[0].startswith(SPACE))
        # "bpe" scores are the negative rank of the merge.
        self.bpe = len(normal) > 1 and all(float(s).is_integer() for s in self.scores.values())
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in self.ids))
        # Where a text may be cut: before a run of spaces, and around characters of no piece.
        self.cut = None if inner else re.compile(f"[{alone}]|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.output = [m.id_to_piece(i).replace(SPACE, " ").encode() for i in range(m.vocab_size())]
        for byte, i in self.bytes_.items():
            self.output[i] = bytes([byte])
        for i in range(m.vocab_size()):
            if m.is_control(i):
                self.output[i] = b""
        self.output[self.unknown] = " ⁇ ".encode()


class StreamingViterbi:
    """push() text as it comes, finish() at its end; both return the ids that are certain by then."""

    def __init__(self, vocabulary: Vocabulary, remembered: int = PAIR_CACHE):
        self.v, self.remembered = vocabulary, remembered
        self.pairs: dict[tuple[str, str], bool] = {}
        self.commits = 0
        self.reset()

    def reset(self) -> None:
        self.text = ""  # the characters since those that are forgotten
        self.last: list[str | None] = [None]  # best last piece to each place
        self.best = [0.0]
        self.done = 0  # the place up to which ids are committed
        self.alive = [0]  # places from which a piece may go on, in order; the last is the end

    def _apart(self, a: str, b: str) -> bool:
        """Whether merging the best pair of a + b, leftmost first among equals, ends with a and b: no merge ever crosses from one to the other."""
        rank, parts, edge = self.v.rank.get, [*a, *b], len(a)
        while len(parts) > 1:
            best, at, left = None, -1, parts[0]
            for i in range(1, len(parts)):
                right = parts[i]
                k = rank(left + right)
                if k is not None and (best is None or k > best):
                    best, at = k, i
                left = right
            if at == edge:
                return False
            if at < 0:
                break
            parts[at - 1 : at + 1] = [parts[at - 1] + parts[at]]
            edge -= at < edge
        return parts == [a, b]

    def _joins(self, a: str, b: str) -> bool:
        got = self._apart(a, b)
        if len(self.pairs) < self.remembered:
            self.pairs[a, b] = got
        return got

    def _best_to(self, i: int, alive: list[int]) -> str:
        """The last piece to place i on the path of the highest score."""
        found, top = None, float("-inf")
        for at in alive:
            piece = self.text[at:i]
            k = self.v.ids.get(piece)
            score = self.v.scores[k] if k is not None else -1e6 if i - at == 1 else None
            if score is not None and self.best[at] + score > top:
                found, top = piece, self.best[at] + score
        self.best.append(top)
        return found

    def _advance(self) -> list[int]:
        """Search to the end of the text held, and commit wherever the surviving paths meet.

        In a model of kind "bpe" exactly one path to each place is admissible, so the
        single character, the last choice left, needs no look.
        """
        out, text, last, alive, pairs, bpe, seen = [], self.text, self.last, self.alive, self.pairs, self.v.bpe, self.v.seen.get
        for i in range(len(last), len(text) + 1):
            found, survivors = None if bpe else self._best_to(i, alive), []
            for at in alive:
                piece = text[at:i]
                kind = seen(piece, 0)
                if kind > 1:
                    survivors.append(at)
                if found is None and kind & 1 and at != i - 1:
                    left = last[at]
                    joins = left is None or pairs.get((left, piece))
                    if joins or joins is None and self._joins(left, piece):
                        found = piece
            last.append(found or text[i - 1])
            survivors.append(i)
            self.alive = alive = survivors
            if alive[0] != self.done:  # else the last boundary survives itself
                self._commit(out)
        return out

    def _commit(self, out: list[int]) -> None:
        """Add the ids up to the boundary in which the paths to all surviving places meet."""
        last, done, end = self.last, self.done, self.alive[0]
        for p in self.alive:
            while p != end:  # step the path that is further on back
                if p > end:
                    p -= len(last[p])
                else:
                    end -= len(last[end])
        if end == done:
            return
        self.done = end
        self.commits += 1
        pieces = []
        while end > done:
            piece = last[end]
            pieces.append(piece)
            end -= len(piece)
        for piece in reversed(pieces):
            k = self.v.ids.get(piece)
            if k is not None:
                out.append(k)
            elif self.v.bytes_:
                out.extend(self.v.bytes_[b] for b in piece.encode())
            else:
                out.append(self.v.unknown)

    def _forget(self) -> None:
        """Drop what is committed, but for the piece that ends there."""
        if self.done:
            base = self.best[self.done] if not self.v.bpe else 0.0
            self.text, self.last, self.best = self.text[self.done :], self.last[self.done :], [b - base for b in self.best[self.done :]]
            self.alive, self.done = [at - self.done for at in self.alive], 0

    def push(self, text: str) -> list[int]:
        out = []
        for at in range(0, len(text), CHUNK):
            self.text += text[at : at + CHUNK]
            out += self._advance()
            self._forget()
        return out

    def whole(self, word: str) -> list[int]:
        return self.push(word) + self.finish()

    def finish(self) -> list[int]:
        """Ids of what is left before an end that no piece crosses: it alone survives."""
        out: list[int] = []
        self.alive = self.alive[-1:]
        self._commit(out)
        self.reset()
        return out


class _Words(dict):
    """Word to its ids; those of a word that is not yet there are committed by the search."""

    def __init__(self, search: StreamingViterbi, remembered: int):
        super().__init__()
        self.search, self.remembered = search, remembered

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = tuple(self.search.whole(word))
        if len(word) <= REMEMBERED and len(self) < self.remembered:
            self[word] = ids
        return ids


class Encoder:
    """Encodes and decodes whole texts, remembering the ids of words."""

    def __init__(self, vocabulary: Vocabulary, remembered: int = WORD_CACHE):
        self.v, self.words = vocabulary, _Words(StreamingViterbi(vocabulary, remembered), remembered)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        shown = ((" " if self.v.prefix else "") + text).replace(" ", SPACE)
        return list(chain.from_iterable(map(self.words.__getitem__, self.v.cut.findall(shown) if self.v.cut else [shown])))

    def decode(self, ids) -> str:
        text = b"".join(map(self.v.output.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.v.prefix and text.startswith(" ") else text


#: One encoder in a Python worker, which serves many tasks; that of another model or memory takes its place.
_encoders: dict[tuple[str, int], Encoder] = {}


def _encoder(vocabulary: Vocabulary, remembered: int = WORD_CACHE) -> Encoder:
    key = vocabulary.path, remembered
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary, remembered)
    return _encoders[key]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, remembered: int = WORD_CACHE) -> DataFrame:
    """``id, ids, n_ids, round_trip`` of every row; null and empty texts have no ids.

    ``remembered`` bounds the words, and the pairs of pieces, that a worker keeps.

    ``round_trip`` says that the ids decode to the text. It is false only for texts
    that hold U+2581, which stands for the space in every SentencePiece model. Rows
    may repeat; an empty table gives an empty result; further columns are ignored.
    """
    kept = docs.sparkSession.sparkContext.broadcast(Vocabulary(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(kept.value, remembered)
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                texts = part.column(1).to_pylist()
                ids = [e.encode(t) for t in texts]
                same = [e.decode(k) == (t or "") for k, t in zip(ids, texts)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([len(k) for k in ids], pa.int64()), pa.array(same, pa.bool_())], names=["id", "ids", "n_ids", "round_trip"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, f"id {kind}, ids array<int>, n_ids long, round_trip boolean")


def decode(encoded: DataFrame, ids_col: str = "ids", out: str = "text", model: str = MODEL) -> DataFrame:
    """``encoded`` with the text of its ids; null ids give a null text."""
    kept = encoded.sparkSession.sparkContext.broadcast(Vocabulary(model))

    @F.pandas_udf("string")
    def text(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in ids:
            yield batch.map(lambda k: None if k is None else _encoder(kept.value).decode(k))

    return encoded.withColumn(out, text(F.col(ids_col)))


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """The ids of every document."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
