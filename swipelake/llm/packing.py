"""Packing token pieces into sequences with bounded-space online best fit."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swipelake.columns import CARD_COLUMNS, TxnColumns
from swipelake.llm.shipping import ship
from swipelake.llm.text import BATCH_ROWS, WORDS, columns
from swipelake.scratch import written

_CACHED_WORDS = 500_000
_CACHED_PARTS = 400_000
_JOINED = 200
# The tokenizer's own division of a word, for printable ASCII in lower case.
_ASCII_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
# Letters and the punctuation behind them, which never merge.
_LETTERS = re.compile(r"([^\W\d_]+)([.,;:!?]*)")
# White space to str.split, but part of a word here.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def split_words(text: str) -> list[str]:
    return WORDS.findall(text) if _OTHER_SPACE.search(text) else text.split()


class Encoder:
    """Token ids of whole texts as little-endian bytes, from remembered words.

    The tokenizer joins nothing across ASCII white space, nor across the parts it divides a word into,
    so a text's ids are those of its words and a word's those of its parts. What is remembered is
    bounded; anything else is tokenized anew.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.vocabulary = vocabulary
        self.tokenizer = Tokenizer.from_str(vocabulary)
        # The same model for words that need neither normalizing nor dividing.
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        held = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(held.values(), default=0) + 1, dtype=bool)
        self.ends[[i for token, i in held.items() if token.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _ids(self, text: str) -> list[int]:
        plain = text.isascii() and text.islower() and text.replace(" ", "").isalpha()
        # The only way that leaves out offsets.
        return (self.letters if plain else self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return np.array(ids, dtype="<u4").tobytes()

    @staticmethod
    def divide(word: str) -> list[str]:
        """The parts of a word that are tokenized alone; the word itself where in doubt."""
        if word.isascii():
            if word.isalpha():
                return [word.lower()]
            if "<|" in word or not word.isprintable():
                return [word]
            return _ASCII_PARTS.findall(word.lower())
        if "<|" in word:
            return [word]
        hit = _LETTERS.fullmatch(word)
        if hit and hit[1].isalpha():
            return [hit[1], hit[2]] if hit[2] else [hit[1]]
        return [word]

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words not yet remembered."""
        whole = {word: word.lower() for word in words if word.isascii() and word.isalpha()}
        divided = {word: self.divide(word) for word in words.difference(whole)}
        parts = set(whole.values()).union(*divided.values())
        unknown = parts.difference(self.parts)
        fresh: dict[str, bytes] = {}
        letters = [p for p in unknown if p.isalpha()]
        # Those of ASCII first, so that few groups are mixed.
        letters.sort(key=str.isascii, reverse=True)
        for at in range(0, len(letters), _JOINED):
            # Each part of letters ends with the only token that ends a word.
            group = letters[at : at + _JOINED]
            ids = np.array(self._ids(" ".join(group)), dtype="<u4")
            raw, stops = ids.tobytes(), (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) == len(group):
                found = [raw[i:k] for i, k in zip([0, *stops], stops)]
            else:
                found = [self._pack(self._ids(p)) for p in group]
            fresh.update(zip(group, found, strict=True))
        for p in unknown.difference(fresh):
            fresh[p] = self._pack(self._ids(p))
        ids_of = {p: fresh[p] if p in fresh else self.parts[p] for p in parts}
        if len(self.parts) + len(fresh) <= _CACHED_PARTS:
            self.parts.update(fresh)
        learned = {word: ids_of[part] for word, part in whole.items()}
        for word, own in divided.items():
            learned[word] = ids_of[own[0]] if len(own) == 1 else b"".join([ids_of[p] for p in own])
        return learned

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text; NULL has none. What some texts miss is learned together."""
        known = self.words
        for at in range(0, len(texts), BATCH_ROWS):
            split = [split_words(t) if t else [] for t in texts[at : at + BATCH_ROWS]]
            found = [list(map(known.get, words)) for words in split]
            missing = {w for words, ids in zip(split, found) for w, own in zip(words, ids) if own is None}
            learned = self._learn(missing) if missing else {}
            for words, ids in zip(split, found):
                if None in ids:
                    ids = [learned[w] if own is None else own for w, own in zip(words, ids)]
                yield b"".join(ids)
            if len(known) + len(learned) <= _CACHED_WORDS:
                known.update(learned)


_encoder: list[Encoder] = []


def encoder(vocabulary: str) -> Encoder:
    """One for each Python worker, kept between tasks."""
    if not _encoder or _encoder[0].vocabulary != vocabulary:
        _encoder[:] = [Encoder(vocabulary)]
    return _encoder[0]


class OpenBins:
    """At most ``limit`` open bins in a bitset keyed by free space."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.bits, self.count, self.opened = 0, 0, 0
        self.by_free: dict[int, list[int]] = defaultdict(list)

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        chosen = stack.pop()
        if not stack:
            self.bits ^= 1 << free
        self.count -= 1
        return chosen

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset): the open bin that fits most tightly, else a new one."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            chosen = self._take(free)
        else:
            if self.count >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            chosen, free = self.opened, self.capacity
            self.opened += 1
        left = free - length
        if left:
            self.by_free[left].append(chosen)
            self.bits |= 1 << left
            self.count += 1
        return chosen, self.capacity - free


def token_pieces(
    txns: DataFrame, vocabulary: str, capacity: int, end_id: int, cols: TxnColumns
) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: ``transaction_id, piece, start, length, ids_crc32``."""
    source = columns(txns, transaction_id=cols.transaction_id, text=cols.merchant)
    schema = source.select(
        "transaction_id",
        F.lit(0).alias("piece"),
        F.lit(0).cast("long").alias("start"),
        F.lit(0).cast("long").alias("length"),
        F.lit(0).cast("long").alias("ids_crc32"),
    ).schema
    shared = source.sparkSession.sparkContext.broadcast(vocabulary)
    end, width = end_id.to_bytes(4, "little"), 4 * capacity

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value).encode
        for batch in batches:
            of, piece, start, length, crc = [], [], [], [], []
            for row, ids in enumerate(encode(batch.column("text").to_pylist())):
                ids += end
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    of.append(row)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("transaction_id").take(pa.array(of, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                ["transaction_id", "piece", "start", "length", "ids_crc32"],
            )

    return source.mapInArrow(cut, schema)


def pack_sequences(
    txns: DataFrame,
    vocabulary_path: str,
    cols: TxnColumns = CARD_COLUMNS,
    capacity: int = 4096,
    end_id: int = 1,
    open_bins: int = 2048,
    tokens_per_task: int = 16_000_000,
) -> DataFrame:
    """Pack the tokens of every merchant descriptor into sequences of at most ``capacity`` tokens.

    A text is its token ids and ``end_id``; only longer ones are cut. Pieces are dealt out evenly, in hash
    order, to tasks of about ``tokens_per_task`` tokens, each of which runs an online best fit: the
    open bin with the least free space that still fits takes the piece; when ``open_bins`` are open and
    none fits, the fullest closes. A task holds ``open_bins`` bins and one batch of pieces. Bins never
    cross tasks, so at most a task's last few stay part empty.

    Returns ``transaction_id, piece, start, length, ids_crc32, sequence_id, offset``. A NULL or empty text
    is one piece with the end token; repeated rows are packed each; order within a task is by hash, id
    and place, so a lost task packs the same again. An empty table gives an empty one.
    """
    ship(txns.sparkSession)
    with open(vocabulary_path, encoding="utf-8") as file:
        vocabulary = file.read()
    pieces = written(token_pieces(txns, vocabulary, capacity, end_id, cols), "pieces", BATCH_ROWS)
    tokens = pieces.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-tokens // tokens_per_task))
    dealt = pieces.repartition(tasks).sortWithinPartitions(
        F.xxhash64("transaction_id", "piece"), "transaction_id", "piece", "ids_crc32", "length"
    )
    schema = dealt.select(
        "*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    ).schema

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        bins = OpenBins(capacity, open_bins)
        for batch in batches:
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([first + b for b, _ in placed], pa.int64()),
                    pa.array([at for _, at in placed], pa.int64()),
                ],
                [*batch.schema.names, "sequence_id", "offset"],
            )

    return dealt.mapInArrow(pack, schema).withColumnRenamed("transaction_id", cols.transaction_id)
