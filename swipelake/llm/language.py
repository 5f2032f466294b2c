"""Languages of merchant descriptors: scripts narrow, Viterbi over words labels spans."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swipelake.columns import CARD_COLUMNS, TxnColumns
from swipelake.llm.shipping import ship
from swipelake.llm.text import columns

UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
_CHARACTERS = 400_000  # of texts that are scored together
_OFF_SCRIPT = -12.0  # log score of a letter in a script that the language does not use
_MIX = (0.6, 0.25, 0.14)  # weights of the chances given two letters, one, none; the rest is even

# First code points of Unicode script ranges (fixed values), in natural order.
SCRIPT_STARTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "indic"),
    (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "burmese"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1400, "other"),
    (0x1780, "khmer"), (0x1800, "mongolian"), (0x1900, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"),
)
_STARTS = [start for start, _ in SCRIPT_STARTS]


def script_of(letters: str) -> str:
    """The script of a word's first letter; words rarely mix."""
    return SCRIPT_STARTS[bisect_right(_STARTS, ord(letters[0])) - 1][1]


def grams(letters: str) -> Iterator[str]:
    """One to three letters, with the word's ends."""
    padded = f"^{letters}$"
    for at in range(1, len(padded)):
        yield padded[at]
        yield padded[at - 1 : at + 1]
        if at > 1:
            yield padded[at - 2 : at + 1]


@dataclass
class LanguageModel:
    """Counts of letter runs by language, and the scripts that each language uses."""

    languages: list[str]
    counts: dict[str, np.ndarray]
    scripts: dict[str, np.ndarray]
    letters: np.ndarray = field(init=False)

    def __post_init__(self):
        self.letters = sum(
            (c for gram, c in self.counts.items() if len(gram) == 1), np.zeros(len(self.languages))
        )

    def chances(self, before: str, letter: str) -> np.ndarray:
        """Log chance of a letter after one or two others, in each language."""
        none = np.zeros(len(self.languages))
        get = self.counts.get
        # A word's start is not counted alone; there are as many ends.
        start = get("$", none) if before[-1] == "^" else get(before[-1], none)
        chance = _MIX[1] * get(before[-1] + letter, none) / np.maximum(start, 1)
        chance = chance + _MIX[2] * get(letter, none) / np.maximum(self.letters, 1)
        if len(before) > 1:
            pair = np.maximum(get(before, none), 1)
            chance = chance + _MIX[0] * get(before + letter, none) / pair
        return np.log(chance + 1e-5)


def best_path(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Viterbi: the language of each word, where every switch costs ``penalty``."""
    n, width = scores.shape
    home = int(np.argmax(scores.sum(axis=0)))
    # Each stretch away from home, in however many languages, pays for one switch at least (a whole text in one
    # other language gains nothing). If no stretch gains that much by the best other language of each word, none leaves.
    others = np.delete(scores, home, axis=1).max(axis=1, initial=-np.inf)
    gain = np.cumsum(others - scores[:, home])
    floor = np.minimum.accumulate(np.concatenate([[0.0], gain[:-1]]))
    if width == 1 or (gain - floor).max(initial=0.0) <= penalty:
        return np.full(n, home)
    back = np.zeros((n, width), dtype=np.int32)
    best = scores[0].tolist()
    for at, row in enumerate(scores.tolist()[1:], 1):
        top = max(range(width), key=best.__getitem__)
        moved = best[top] - penalty
        fresh = []
        for k in range(width):
            if best[k] >= moved:
                back[at, k] = k
                fresh.append(best[k] + row[k])
            else:
                back[at, k] = top
                fresh.append(moved + row[k])
        best = fresh
    path = np.zeros(n, dtype=np.int64)
    path[-1] = max(range(width), key=best.__getitem__)
    for at in range(n - 1, 0, -1):
        path[at - 1] = back[at, path[at]]
    return path


@cache
def _is_letter() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


class Labeler:
    """Labels texts with a model, many at a time; scores of letter triples are remembered."""

    def __init__(self, model: LanguageModel, penalty: float):
        self.model, self.penalty = model, penalty
        width = len(model.languages)
        names = sorted({name for _, name in SCRIPT_STARTS})
        self.script_at = np.array([names.index(name) for _, name in SCRIPT_STARTS])
        off = np.zeros((len(names), width))
        for name, used in model.scripts.items():
            if used.any():
                off[names.index(name)] = np.where(used, 0.0, _OFF_SCRIPT)
        self.off_script = off
        self.rows: dict[int, int] = {}
        self.scores: list[np.ndarray] = []

    def _score(self, key: int) -> int:
        """Row of the score of a letter, or of a word's end, after up to two letters."""
        a, b, c = key >> 42, (key >> 21) & 0x1FFFFF, key & 0x1FFFFF
        before = f"{chr(a) if a else '^'}{chr(b)}" if b else "^"
        scores = self.model.chances(before, chr(c) if c else "$")
        if c:
            scores = scores + self.off_script[self.script_at[bisect_right(_STARTS, c) - 1]]
        self.rows[key] = len(self.scores)
        self.scores.append(scores)
        return self.rows[key]

    def _words(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Scores and letter counts of the words of each text."""
        lower = [t.lower() for t in texts]
        codes = np.frombuffer("".join([f"{t}\n" for t in lower]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        ends = np.cumsum([len(t) + 1 for t in lower])
        space = (codes == 32) | ((codes >= 9) & (codes <= 13))
        letter = _is_letter()[codes]
        c = np.where(letter, codes, 0).astype(np.int64)
        b = np.concatenate([[0], c[:-1]])
        a = np.where(b > 0, np.concatenate([[0, 0], c[:-2]]), 0)
        # The score of a letter, or of the end behind one; nothing elsewhere.
        keys, inverse = np.unique((a << 42) | (b << 21) | c, return_inverse=True)
        rows, score = self.rows, self._score
        at = [rows[k] if k in rows else score(k) for k in keys.tolist() if k]
        table = np.zeros((len(keys), len(self.model.languages)))
        table[keys != 0] = np.array(self.scores)[at] if at else 0.0
        starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        if not len(starts):
            yield from ((table[:0], ends[:0]) for _ in texts)
            return
        words = np.add.reduceat(table[inverse], starts, axis=0)
        letters = np.add.reduceat(letter.astype(np.int64), starts)
        first = 0
        for last in np.searchsorted(starts, ends):
            yield words[first:last], letters[first:last]
            first = last

    def label(self, texts: list[str | None]) -> Iterator[tuple[str, float, list[tuple[str, int, int]]]]:
        """(language, share of letters, spans of words) of each text."""
        width = len(self.model.languages)
        for scores, letters in self._words([t or "" for t in texts]):
            if not letters.any() or not width:
                yield UNKNOWN, 0.0, []
                continue
            path = best_path(scores, self.penalty)
            share = np.bincount(path, weights=letters, minlength=width)
            winner = int(np.argmax(share))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1, [len(path)]])
            spans = [
                (self.model.languages[path[a]], int(a), int(b - a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)
            ]
            yield self.model.languages[winner], float(share[winner] / letters.sum()), spans


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most ``most`` together, or one row alone."""
    first, held = 0, 0
    for at, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            yield first, at
            first, held = at, 0
        held += size
    if len(sizes):
        yield first, len(sizes)


def fit_languages(
    txns: DataFrame, language: str, learn: Column, cols: TxnColumns, sample_rows: int, most_grams: int
) -> LanguageModel:
    """Counts of letter runs over a sample of labelled rows: about ``sample_rows`` of each language, by a hash of the id."""
    flagged = txns.withColumn("_learn", learn)
    source = columns(flagged, id=cols.transaction_id, text=cols.merchant, language=language, learn="_learn")
    labelled = source.filter("learn and language is not null and text is not null").withColumn(
        "draw", F.pmod(F.xxhash64(F.lit("language"), "id"), F.lit(1 << 52)) / float(1 << 52)
    )
    sizes = labelled.groupBy("language").agg(F.least(F.lit(1.0), sample_rows / F.count(F.lit(1))).alias("share"))
    # One row for each language.
    sample = labelled.join(F.broadcast(sizes), "language").filter(F.col("draw") < F.col("share"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for name, text in zip(batch.column("language").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found[name].update(_LETTERS.findall(text.lower()))
        for name, words in found.items():
            runs: Counter = Counter()
            for letters, n in words.items():
                runs[f"script {script_of(letters)}"] += n * len(letters)
                for gram in grams(letters):
                    runs[gram] += n
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * len(runs)),
                    pa.array(list(runs)),
                    pa.array(list(runs.values()), pa.int64()),
                ],
                ["language", "gram", "n"],
            )

    counted = sample.select("language", "text").mapInArrow(count, "language string, gram string, n long")
    summed = counted.groupBy("language", "gram").agg(F.sum("n").alias("n"))
    rows = summed.orderBy(F.desc("n"), "gram", "language").limit(most_grams).toArrow().to_pylist()
    names = sorted({r["language"] for r in rows})
    counts: dict[str, np.ndarray] = {}
    for r in rows:
        counts.setdefault(r["gram"], np.zeros(len(names)))[names.index(r["language"])] += r["n"]
    scripts = {g.removeprefix("script "): counts.pop(g) for g in list(counts) if g.startswith("script ")}
    whole = sum(scripts.values(), np.zeros(len(names)))
    return LanguageModel(names, counts, {s: c > 0.01 * np.maximum(whole, 1) for s, c in scripts.items()})


def label_languages(
    txns: DataFrame,
    learn: Column,
    cols: TxnColumns = CARD_COLUMNS,
    language: str = "language",
    penalty: float = 12.0,
    sample_rows: int = 2000,
    most_grams: int = 400_000,
) -> DataFrame:
    """The language of every whole merchant descriptor, and of each stretch of a mixed one.

    Transactions have no language field, so ``language`` names any column with one; rows that meet ``learn``
    and have a language and a text are learned from, about ``sample_rows`` of each language. A word's script
    narrows the languages to those that use it; its score in each is that of its letters given the two before. Viterbi
    over the words, where each switch costs ``penalty``, labels spans; the language with most letters wins.
    Of the sample's letter counts the ``most_grams`` commonest are kept; rarer letter triples score as unseen ones.

    Returns ``transaction_id, language, score, spans`` (``language, first_word, words``); ``score`` is the winner's
    share of the letters. A NULL text or one without letters is ``und`` with score 0, as is all when nothing can
    be learned. Ties go to the first language by name. Repeated rows are answered each, ids may be NULL, an
    empty table gives an empty one, extra columns do not matter.
    """
    ship(txns.sparkSession)
    model = fit_languages(txns, language, learn, cols, sample_rows, most_grams)
    shared = txns.sparkSession.sparkContext.broadcast(model)
    source = columns(txns, transaction_id=cols.transaction_id, text=cols.merchant)
    spans = "array<struct<language:string,first_word:int,words:int>>"
    schema = source.select(
        "transaction_id",
        F.lit("").alias("language"),
        F.lit(0.0).alias("score"),
        F.lit(None).cast(spans).alias("spans"),
    ).schema
    kind = pa.list_(pa.struct([("language", pa.string()), ("first_word", pa.int32()), ("words", pa.int32())]))

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeler = Labeler(shared.value, penalty)
        for batch in batches:
            sizes = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
            for first, last in _runs(sizes, _CHARACTERS):
                part = batch.slice(first, last - first)
                found = list(labeler.label(part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("transaction_id"),
                        pa.array([f[0] for f in found], pa.string()),
                        pa.array([f[1] for f in found], pa.float64()),
                        pa.array(
                            [[{"language": a, "first_word": b, "words": c} for a, b, c in f[2]] for f in found], kind
                        ),
                    ],
                    ["transaction_id", "language", "score", "spans"],
                )

    return source.mapInArrow(label, schema).withColumnRenamed("transaction_id", cols.transaction_id)
