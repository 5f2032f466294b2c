"""Quality of merchant descriptors by how far their histograms diverge from language references."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from swipelake.columns import CARD_COLUMNS, TxnColumns
from swipelake.llm.packing import split_words
from swipelake.llm.shipping import ship
from swipelake.llm.text import columns
from swipelake.scratch import written

# Character classes of the histograms, in this order.
CLASSES = ("lower", "upper", "digit", "blank", "line", "stop", "sign", "other")
_SIGNS = "#*$%&|<>"  # fixed symbols
_STOPS = ".,;:!?'\"()-"
_FLUSH = 300_000
_CACHED_WORDS = 500_000


def _class_table() -> np.ndarray:
    """Class of each code point below 0x3000; letters without case count as lower."""
    table = np.full(0x3000, CLASSES.index("other"), dtype=np.int8)
    for code in range(0x3000):
        c = chr(code)
        if c in _SIGNS:
            kind = "sign"
        elif c in _STOPS:
            kind = "stop"
        elif c in "\n\r":
            kind = "line"
        elif c.isspace():
            kind = "blank"
        elif c.isdigit():
            kind = "digit"
        elif c.isupper():
            kind = "upper"
        elif c.isalpha():
            kind = "lower"
        else:
            continue
        table[code] = CLASSES.index(kind)
    return table


_TABLE = _class_table()
_BEYOND = np.int8(CLASSES.index("lower"))  # scripts above are nearly all letters


def class_counts(text: str) -> np.ndarray:
    """Characters of each class."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    known = codes < len(_TABLE)
    kinds = np.where(known, _TABLE[np.where(known, codes, 0)], _BEYOND)
    return np.bincount(kinds, minlength=len(CLASSES)).astype(np.float64)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of a histogram to each row of references."""
    p = p / max(p.sum(), 1e-12)
    q = q / np.maximum(q.sum(axis=-1, keepdims=True), 1e-12)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0.0).sum(axis=-1)
        right = np.where(q > 0, q * np.log2(q / m), 0.0).sum(axis=-1)
    return np.sqrt(np.clip((left + right) / 2, 0.0, 1.0))


# Lengths in words at which word distances are drawn, and texts drawn for each; between them limits are interpolated.
_LENGTHS = (12, 25, 50, 70, 100, 140, 200, 400)
_DRAWN_TEXTS = 2000


@dataclass(frozen=True)
class References:
    """For each language: class counts, and counts of its common words and of all others."""

    languages: list[str]
    classes: np.ndarray
    words: list[dict[str, int]]
    others: list[int]


@dataclass(frozen=True)
class Limits:
    """How far from the nearest reference is too far, and the least sizes for which it counts.

    A word histogram may lie ``word_share`` as far off as that of a text without any common word, and in a short
    text as far as all but ``word_chance`` of the texts of its length that are drawn from the reference.
    """

    class_distance: float = 0.30
    word_share: float = 0.9
    word_chance: float = 0.001
    least_characters: int = 200
    least_base_words: int = 50
    most_repeated: int = 50


_hashes: dict[str, bytes] = {}


def _hashed(words: list[str]) -> np.ndarray:
    found = list(map(_hashes.get, words))
    if None in found:
        for at, known in enumerate(found):
            if known is None:
                found[at] = xxhash.xxh64_digest(words[at].encode("utf-8", "surrogatepass"))
                if len(_hashes) < _CACHED_WORDS:
                    _hashes[words[at]] = found[at]
    return np.frombuffer(b"".join(found), dtype=">i8").astype(np.int64)


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in a 3-word window found twice or more, the first included."""
    if len(ids) < 4:
        return 0
    width = int(ids.max()) + 1
    windows = (ids[:-2] * width + ids[1:-1]) * width + ids[2:] if width < 2_000_000 else None
    if windows is None:
        _, windows = np.unique(ids[:-2] * width + ids[1:-1], return_inverse=True)
        windows = windows * width + ids[2:]
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    covered = np.zeros(len(ids), dtype=bool)
    for shift in range(3):
        covered[shift : shift + len(again)] |= again
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [line for line in text.split("\n") if line.strip(" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def fit_references(
    txns: DataFrame, cols: TxnColumns, language: str, common: int
) -> References:
    """Histograms over all rows with a language: sums of counts, then the commonest words of each."""
    source = columns(txns, language=language, text=cols.merchant).filter(
        "language is not null and text is not null"
    )

    def out(name: str, terms: Iterable[str], counts: Iterable[int]) -> pa.RecordBatch:
        terms = list(terms)
        return pa.RecordBatch.from_arrays(
            [pa.array([name] * len(terms)), pa.array(terms, pa.string()), pa.array(list(counts), pa.int64())],
            ["language", "term", "n"],
        )

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = defaultdict(Counter)
        kinds: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(CLASSES)))
        for batch in batches:
            for name, text in zip(batch.column("language").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words[name].update(split_words(text))
                kinds[name] += class_counts(text)
                if len(words[name]) > _FLUSH:
                    yield out(name, *zip(*words.pop(name).items(), strict=True))
        for name, found in words.items():
            if found:
                yield out(name, found.keys(), found.values())
        for name, found in kinds.items():
            # A word has no blank, so these keys cannot be words.
            yield out(name, [f" {c}" for c in CLASSES], found.astype(np.int64).tolist())

    counted = source.mapInArrow(count, "language string, term string, n long")
    summed = counted.groupBy("language", "term").agg(F.sum("n").alias("n"))
    is_class = F.col("term").startswith(" ")
    place = F.row_number().over(Window.partitionBy("language", is_class).orderBy(F.desc("n"), "term"))
    summed = written(summed, "reference_terms")
    top = summed.withColumn("place", place).filter(F.col("place") <= common).collect()
    totals = {
        r["language"]: r["n"]
        for r in summed.filter(~is_class).groupBy("language").agg(F.sum("n").alias("n")).collect()
    }
    names = sorted({r["language"] for r in top})
    classes = np.zeros((len(names), len(CLASSES)))
    words: list[dict[str, int]] = [{} for _ in names]
    for r in top:
        at = names.index(r["language"])
        if r["term"].startswith(" "):
            classes[at, CLASSES.index(r["term"][1:])] = r["n"]
        else:
            words[at][r["term"]] = r["n"]
    others = [totals.get(name, 0) - sum(w.values()) for name, w in zip(names, words, strict=True)]
    return References(names, classes, words, others)


class Judge:
    """Measures texts and compares them with references."""

    def __init__(self, references: References, limits: Limits):
        self.references, self.limits = references, limits
        every = sorted({w for words in references.words for w in words})
        keys = _hashed(every) if every else np.zeros(0, dtype=np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.words = np.zeros((len(references.languages), len(every) + 1))
        for at, own in enumerate(references.words):
            for column, j in enumerate(order):
                self.words[at, column] = own.get(every[j], 0)
            self.words[at, -1] = references.others[at]
        self.word_limits = [self._word_limits(counts) for counts in self.words]

    def _word_limits(self, counts: np.ndarray) -> np.ndarray:
        """The largest word distance to a reference for texts of each length in ``_LENGTHS``."""
        if not counts.any():
            return np.ones(len(_LENGTHS))
        counts = np.append(counts[:-1][counts[:-1] > 0], counts[-1])
        uncommon = np.zeros(len(counts))
        uncommon[-1] = 1.0
        limit = np.full(len(_LENGTHS), self.limits.word_share * float(js_distance(uncommon, counts)))
        draw = np.random.default_rng(1)
        for i, n in enumerate(_LENGTHS):
            drawn = draw.multinomial(n, counts / counts.sum(), size=_DRAWN_TEXTS)
            apart = [float(js_distance(text, counts)) for text in drawn]
            limit[i] = max(limit[i], np.quantile(apart, 1 - self.limits.word_chance))
        return limit

    def measure(self, text: str | None) -> tuple:
        """Counts, distances to the nearest reference, its language, and the verdicts."""
        text = text or ""
        words = split_words(text)
        n = len(words)
        distinct, ids, counts = np.unique(_hashed(words), return_inverse=True, return_counts=True)
        repeated = repeated_words(ids.astype(np.int64))
        signs = sum(map(text.count, _SIGNS))
        limits = self.limits
        base_failed = n < limits.least_base_words or 100 * repeated > limits.most_repeated * n
        of_class = of_word = None
        near = None
        if self.references.languages and n:
            by_class = js_distance(class_counts(text), self.references.classes)
            histogram = np.zeros(len(self.keys) + 1)
            at = np.searchsorted(self.keys, distinct)
            hit = (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == distinct)
            histogram[at[hit]] = counts[hit]
            histogram[-1] = n - histogram[:-1].sum()
            by_word = js_distance(histogram, self.words)
            best = int(np.argmin(by_word))
            near = self.references.languages[best]
            of_class, of_word = float(by_class[best]), float(by_word[best])
        diverges = (
            of_class is not None
            and (
                (len(text) >= limits.least_characters and of_class > limits.class_distance)
                or of_word > np.interp(np.log(n), np.log(_LENGTHS), self.word_limits[best])
            )
        )
        return (
            n, sum(map(len, words)), signs, duplicate_lines(text), repeated, base_failed,
            not base_failed and not diverges, near, of_class, of_word,
        )


_MEASURES = (
    ("words", pa.int64()), ("word_chars", pa.int64()), ("symbols", pa.int64()), ("dup_lines", pa.int64()),
    ("repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("nearest", pa.string()),
    ("class_distance", pa.float64()), ("word_distance", pa.float64()),
)
_SCHEMA = (
    "words long, word_chars long, symbols long, dup_lines long, repeat_words long, base_failed boolean,"
    " kept boolean, nearest string, class_distance double, word_distance double"
)


def judge_quality(
    txns: DataFrame,
    cols: TxnColumns = CARD_COLUMNS,
    language: str = "language",
    common: int = 64,
    limits: Limits = Limits(),
) -> DataFrame:
    """Measures of every whole merchant descriptor and whether its histograms fit a language.

    References come from all rows: for each value of ``language`` (transactions have no such field, any column
    will do) the counts of character classes, of its ``common`` commonest words and of all other words. A
    text is compared with the language whose words are nearest, by Jensen-Shannon distance; it fails when
    its class histogram (from a least length) or its word histogram lies too far off. The limit for words comes
    from each reference: nearly the distance of a text without common words, more in short texts. Texts that fail
    the base limits (too few words, too many repeated) are not kept either.

    Returns ``transaction_id, words, word_chars, symbols, dup_lines, repeat_words, base_failed, kept, nearest,
    class_distance, word_distance``. NULL and empty texts have no words and fail the base; without any
    reference nothing diverges and distances are NULL; ties go to the first language by name. Repeated rows are
    judged each, ids may be NULL, an empty table gives an empty one, extra columns do not matter.
    """
    ship(txns.sparkSession)
    references = fit_references(txns, cols, language, common)
    shared = txns.sparkSession.sparkContext.broadcast(Judge(references, limits))
    source = columns(txns, transaction_id=cols.transaction_id, text=cols.merchant)
    schema = source.select("transaction_id", *[
        F.lit(None).cast(part.split()[1]).alias(part.split()[0]) for part in _SCHEMA.split(", ")
    ]).schema

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rows = [own.measure(t) for t in batch.column("text").to_pylist()]
            found = list(zip(*rows, strict=True)) or [()] * len(_MEASURES)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("transaction_id"),
                    *[pa.array(values, kind) for values, (_, kind) in zip(found, _MEASURES, strict=True)],
                ],
                ["transaction_id", *[name for name, _ in _MEASURES]],
            )

    return source.mapInArrow(judge, schema).withColumnRenamed("transaction_id", cols.transaction_id)
