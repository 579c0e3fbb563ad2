"""Packing of tokenised documents into sequences by best-two-fit.

Texts are tokenised in one pass and only the lengths travel.  Pieces are dealt at
random to shards of a bounded number of rows; a shard packs its own, so every
shard but for its last sequences is as dense as one packing of all rows would be.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import Words, mix, signed, slices, small_batches, table, written

#: Pieces that a shard is meant to hold.
SHARD_PIECES = 50_000
#: Words whose ids a worker remembers; a full memory keeps those of several slices.
REMEMBERED = 250_000
_TAIL = ".,;:!?#$%&*()[]{}\"'-+=/<>@_~^|\\`"
_TO_TAIL = r"(?s)^.*[^.,;:!?#$%&*()\[\]{}\"'\-+=/<>@_~^|\\`]"


class WordIds:
    """Ids of white-space-separated chunks.

    The tokenizer drops white space and its pieces never cross it, so the ids of a
    text are those of its chunks in turn.  A chunk of letters with punctuation
    after it is looked up as two, as the tokenizer splits there too.  Words met in
    several slices are remembered, up to REMEMBERED.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # every core has its own task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.last[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.joins = self.last.any() and not any(t.content.isalpha() for t in self.tokenizer.get_added_tokens_decoder().values())
        self.place: dict[str, int] = {}
        self.flat, self.count, self.uses = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of words of letters: as one text, where each gives one word-ending id, as its last."""
        lines = [" ".join(words[k : k + 1000]) for k in range(0, len(words), 1000)]
        flat = np.fromiter(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)), np.uint32)
        ends = np.flatnonzero(self.last[np.minimum(flat, len(self.last) - 1)])
        if len(ends) != len(words) or (len(flat) and ends[-1] != len(flat) - 1):
            return self._each(words)  # letters that the tokenizer takes apart
        return flat, np.diff(ends, prepend=-1)

    def _forget(self) -> None:
        """Keep the words of several slices, half of the memory at most."""
        order = np.argsort(-self.uses, kind="stable")[: REMEMBERED // 2]
        kept = np.sort(order[self.uses[order] > 1])
        self.flat, self.count = self._gathered(kept)
        names = list(self.place)
        self.place = {names[k]: i for i, k in enumerate(kept.tolist())}
        self.uses = self.uses[kept] // 2

    def _gathered(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words at these places in one array, and the number of each."""
        first = np.concatenate([[0], np.cumsum(self.count)])
        length = self.count[place]
        total = np.concatenate([[0], np.cumsum(length)])
        return self.flat[np.repeat(first[place] - total[:-1], length) + np.arange(total[-1])], length

    def _places(self, names: list[str]) -> np.ndarray:
        if len(self.place) > REMEMBERED:
            self._forget()
        found = list(map(self.place.get, names))
        new = [x for x, at in zip(names, found, strict=True) if at is None]
        plain = [x for x in new if self.joins and x.isascii() and x.isalpha()]
        other = [x for x in new if self.joins and not x.isascii() and x.isalpha()]
        rest = [x for x in new if not (self.joins and x.isalpha())]
        for words, ids_of in ((plain, self._joined), (other, self._joined), (rest, self._each)):
            if words:
                flat, count = ids_of(words)
                self.place.update(zip(words, range(len(self.place), len(self.place) + len(words)), strict=True))
                self.flat, self.count = np.concatenate([self.flat, flat]), np.concatenate([self.count, count])
        place = np.fromiter(map(self.place.__getitem__, names), np.int64, len(names)) if new else np.array(found, np.int64)
        self.uses = np.concatenate([self.uses, np.zeros(len(self.count) - len(self.uses), np.int64)])
        self.uses[place] += 1  # names are distinct
        return place

    def of(self, chunks: pa.Array, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words ``chunks[index]`` in one array, and the number up to each word."""
        core = pc.utf8_rtrim(chunks, characters=_TAIL)
        letters = pc.and_(pc.utf8_is_alpha(core), pc.or_(pc.string_is_ascii(core), pc.equal(pc.utf8_normalize(core, "NFC"), core)))
        tail = pc.if_else(letters, pc.replace_substring_regex(chunks, pattern=_TO_TAIL, replacement=""), "")
        parts = pa.concat_arrays([pc.if_else(letters, core, chunks), tail.cast(chunks.type)]).dictionary_encode()
        place = self._places(parts.dictionary.to_pylist())[parts.indices.to_numpy()].reshape(2, -1)
        flat, both = self._gathered(place.T.ravel())  # each chunk's letters, then what follows them
        count = both.reshape(-1, 2).sum(1)
        first = np.concatenate([[0], np.cumsum(count)])
        length = count[index]
        total = np.concatenate([[0], np.cumsum(length)])
        return flat[np.repeat(first[index] - total[:-1], length) + np.arange(total[-1])], total


_WORKER: dict[str, WordIds] = {}


def token_ids(texts: pa.Array, tokenizer_path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, and the offsets by text."""
    if tokenizer_path not in _WORKER:
        _WORKER[tokenizer_path] = WordIds(tokenizer_path)
    words = Words(texts)  # the tokenizer lowers all letters itself
    ids, total = _WORKER[tokenizer_path].of(words.chunks, words.index)
    return ids, total[words.offsets]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document: its ids and an end id, cut only where longer than ``capacity``."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, offsets = token_ids(batch.column("text"), tokenizer_path)
                out: list[tuple] = []
                for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), offsets[:-1], offsets[1:], strict=True):
                    own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                    for k, at in enumerate(range(0, len(own), capacity)):
                        one = own[at : at + capacity]
                        out.append((doc_id, k, at, len(one), zlib.crc32(one.tobytes())))
                columns = list(zip(*out, strict=True)) or [[]] * 5
                deal = mix((np.arange(rows, rows + len(out)) + (part << 36)).astype(np.uint64))
                rows += len(out)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.record_batch([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.array(signed(deal))], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)


def best_two_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """The sequence and offset of each length.

    A sequence is filled with the largest item that fits until none does.  Then its
    smallest item gives way to the two unpacked items whose sum fits the gap plus
    that item most tightly, if that sum is larger than the item.
    """
    by: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        by.setdefault(lengths[i], []).append(i)
    present = 0  # bit n: an item of length n is left
    for n in by:
        present |= 1 << n

    def largest(most: int) -> int:
        return (present & ((1 << (most + 1)) - 1)).bit_length() - 1 if most > 0 else -1

    sequence, offset, number = [0] * len(lengths), [0] * len(lengths), 0
    while present:
        filled: list[int] = []
        gap = capacity
        while (n := largest(gap)) > 0:
            filled.append(by[n].pop())
            if not by[n]:
                present ^= 1 << n
            gap -= n
        if gap and present and filled:
            last = filled[-1]
            small = lengths[last]
            room, best, pair = gap + small, small, None
            a = largest(min(small, room - 1))
            while a > 0 and 2 * a > best:
                b = largest(min(a, room - a))
                if b == a and len(by[a]) < 2:
                    b = largest(a - 1)
                if b > 0 and a + b > best:
                    best, pair = a + b, (a, b)
                    if best == room:
                        break
                a = largest(a - 1)
            if pair:
                filled.pop()
                for n in pair:
                    filled.append(by[n].pop())
                    if not by[n]:
                        present ^= 1 << n
                by.setdefault(small, []).append(last)
                present |= 1 << small
        at = 0
        for i in filled:
            sequence[i], offset[i] = number, at
            at += lengths[i]
        number += 1
    return sequence, offset


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone.  Repeated rows and ids are packed
    each; pieces of equal length are taken in the order they were dealt.  A null id
    stays null.  An empty table gives no rows.  Special tokens' strings in a text
    are what the tokenizer file makes of them.  Only the two named columns are read.
    """
    found = written(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    shards = max(1, -(-found.count() // SHARD_PIECES))

    def run(rows: pa.Table) -> pa.Table:
        sequence, offset = best_two_fit(rows.column("length").to_pylist(), capacity)
        base = rows.column("shard")[0].as_py() << 32
        return rows.drop_columns(["deal", "shard"]).append_column("sequence_id", pa.array([base + s for s in sequence], pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    dealt = found.withColumn("shard", F.pmod("deal", F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(run, PIECES.replace(", deal long", ", sequence_id long, offset long"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
