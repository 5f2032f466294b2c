"""Toxic merchant descriptors: boosted trees over dense features, calibrated by isotonic regression."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swipelake.columns import CARD_COLUMNS, TxnColumns
from swipelake.llm.packing import split_words
from swipelake.llm.shipping import ship
from swipelake.llm.text import BATCH_ROWS, columns, sliced
from swipelake.scratch import written

FEATURES = (
    "hits", "distinct_hits", "strong_hits", "hit_density", "first", "second", "third", "weight",
    "weight_density", "hidden_hits", "near_you", "you_density", "capitals", "shouted", "exclaimed",
    "punctuation", "obfuscated", "log_words",
)

_LETTERS = re.compile(r"[^\W\d_]+")
# Letters with digits or signs inside, as in w0rd or w*rd.
_OBFUSCATED = re.compile(r"[^\W\d_][\d*@$!#.\-_+]+[^\W\d_]")
_PUNCTUATION = re.compile(r"[!?.,;:]")
# Signs that stand for letters (fixed values).
_PLAIN = str.maketrans("013457@$!|+", "oieastasilt")
_JOINTS = re.compile(r"[*.\-_#]+")
_TRIPLE = re.compile(r"(.)\1{2,}")
# Words for the reader in the languages of the texts (fixed values).
SECOND_PERSON = frozenset(
    "you your yours yourself u ur ya tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer"
    " tú ti tus usted ustedes vosotros vos".split()
)
STEM_SIZES = (4, 5, 6, 7)
_NEAR = 6
_HIT, _STRONG = 1.2, 2.5  # log odds from which a word is a hit
_PRIOR = 10.0  # texts at the usual rate that every term is credited with


@dataclass(frozen=True)
class Lexicon:
    """How many clean and marked texts hold each telling word (``=word``) and beginning (``^stem``)."""

    terms: dict[str, tuple[int, int]]
    clean: int
    marked: int

    def weight(self, term: str, own: int | None) -> float:
        """Log odds of a mark given the term; ``own`` is the label of a text that counts itself, left out."""
        held = self.terms.get(term)
        if held is None:
            return 0.0
        clean, marked = held[0] - (own == 0), held[1] - (own == 1)
        share = self.marked / (self.clean + self.marked)
        odds_marked = (marked + _PRIOR * share) / self.marked
        odds_clean = (clean + _PRIOR * (1 - share)) / self.clean
        return max(0.0, math.log(odds_marked / odds_clean))


def plain_words(word: str) -> list[str]:
    """The letter runs of a word in lower case."""
    return _LETTERS.findall(word.lower())


def revealed(word: str) -> str | None:
    """What an obfuscated word spells, or None where nothing is hidden."""
    low = word.lower()
    if low.isalpha() and not _TRIPLE.search(low):
        return None
    spelled = _TRIPLE.sub(r"\1", _JOINTS.sub("", low.translate(_PLAIN)))
    letters = "".join(_LETTERS.findall(spelled))
    return letters or None


class _Seen:
    """What each word contributes; remembered up to a bound."""

    def __init__(self, lexicon: Lexicon, own: int | None = None):
        self.lexicon, self.own = lexicon, own
        self.known: dict[str, tuple[str, float, bool, bool, bool, bool]] = {}
        self.alike: dict[tuple, tuple] = {}

    def __call__(self, word: str) -> tuple[str, float, bool, bool, bool, bool]:
        found = self.known.get(word)
        if found is None:
            found = self._look(word)
            if len(self.known) > 300_000:
                self.known.clear()
                self.alike.clear()
            if found[1] < _HIT:
                # Only a hit's spelling counts, so the others share what they contribute.
                found = ("", *found[1:])
                found = self.alike.setdefault(found, found)
            self.known[word] = found
        return found

    def _weight(self, part: str) -> float:
        weight, own = self.lexicon.weight, self.own
        stems = [weight(f"^{part[:n]}", own) for n in STEM_SIZES if len(part) > n]
        return max([weight(f"={part}", own), *stems])

    def _look(self, word: str) -> tuple[str, float, bool, bool, bool, bool]:
        parts = plain_words(word)
        weight = max(map(self._weight, parts), default=0.0)
        hidden = revealed(word) if weight < _HIT else None
        concealed = self._weight(hidden) if hidden else 0.0
        return (
            parts[0] if parts else "",
            max(weight, concealed),
            concealed >= _STRONG,
            any(p in SECOND_PERSON for p in parts),
            len(word) > 2 and word.isupper(),
            bool(_OBFUSCATED.search(word)),
        )


def features_of(text: str | None, seen: _Seen) -> list[float]:
    """Dense features of a whole text, in the order of FEATURES."""
    text = text or ""
    looked = list(map(seen, split_words(text)))
    n = max(1, len(looked))
    hits = [(at, w) for at, w in enumerate(looked) if w[1] >= _HIT]
    by_word = {w[0]: w[1] for _, w in hits}
    top = sorted(by_word.values(), reverse=True)
    weight = sum(top)
    you = {at for at, w in enumerate(looked) if w[3]}
    near = sum(any(p in you for p in range(at - _NEAR, at + _NEAR + 1)) for at, _ in hits) if you else 0
    letters = max(1, len(text))
    return [
        float(len(hits)),
        float(len(top)),
        float(sum(w >= _STRONG for w in top)),
        100.0 * len(hits) / n,
        *[top[k] if len(top) > k else 0.0 for k in range(3)],
        weight,
        100.0 * weight / n,
        float(sum(w[2] for w in looked)),
        near / max(1, len(hits)),
        100.0 * len(you) / n,
        sum(map(str.isupper, text)) / letters,
        sum(w[4] for w in looked) / n,
        100.0 * text.count("!") / letters,
        len(_PUNCTUATION.findall(text)) / n,
        100.0 * sum(w[5] for w in looked) / n,
        math.log1p(len(looked)),
    ]


def fit_lexicon(labelled: DataFrame, least: int, odds: float) -> Lexicon:
    """Words and beginnings that at least ``least`` marked texts hold, ``odds`` times as often as clean ones.

    ``labelled`` has ``text`` and ``label`` and is bounded, and so are its terms.
    """
    sizes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    clean, marked = sizes.get(0, 0), sizes.get(1, 0)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[str, list[int]] = {}
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                own = {p for word in set(split_words(text or "")) for p in plain_words(word)}
                terms = {f"={p}" for p in own} | {f"^{p[:n]}" for p in own for n in STEM_SIZES if len(p) > n}
                for term in terms:
                    tally.setdefault(term, [0, 0])[label] += 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(tally), pa.string()),
                pa.array([c[0] for c in tally.values()], pa.int64()),
                pa.array([c[1] for c in tally.values()], pa.int64()),
            ],
            ["term", "clean", "marked"],
        )

    counted = (
        labelled.select("text", "label")
        .mapInArrow(count, "term string, clean long, marked long")
        .groupBy("term")
        .agg(F.sum("clean").alias("clean"), F.sum("marked").alias("marked"))
        .filter((F.col("marked") >= least) & (F.col("marked") * clean >= odds * marked * F.col("clean")))
    )
    terms = {r["term"]: (r["clean"], r["marked"]) for r in counted.toLocalIterator()}
    return Lexicon(terms, clean, marked)


def _with_features(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """All columns but the text, and ``features`` (array of double).

    A column ``own`` has the label of texts that the lexicon has counted.
    """
    others = [c for c in rows.columns if c != "text"]
    schema = T.StructType([*rows.select(*others).schema.fields, T.StructField("features", T.ArrayType(T.DoubleType()))])
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {own: _Seen(shared.value, own) for own in (None, 0, 1)}
        for batch in sliced(batches):
            texts = batch.column("text").to_pylist()
            own = batch.column("own").to_pylist() if "own" in others else [None] * len(texts)
            found = [features_of(t, seen[o]) for t, o in zip(texts, own, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in others], pa.array(found, pa.list_(pa.float64()))],
                [*others, "features"],
            )

    return rows.mapInArrow(make, schema)


def score_toxicity(
    txns: DataFrame,
    marks: DataFrame,
    cols: TxnColumns = CARD_COLUMNS,
    sample_rows: int = 20_000,
    least: int = 3,
    odds: float = 3.0,
    trees: int = 30,
    depth: int = 3,
    threshold: float = 0.7,
) -> DataFrame:
    """How toxic each whole merchant descriptor is, learned from marked transactions.

    ``marks`` has the transaction id and a 0/1 mark (``cols.fraud``); only its rows teach, at most
    ``sample_rows`` of them, drawn by a hash of the id. From three quarters of these come the lexicon (words and word
    beginnings that marked texts hold more often; a text never counts for itself) and gradient-boosted trees over dense features: lexicon
    densities, second-person words near hits, capitals, punctuation, obfuscated spellings. The last
    quarter calibrates their margin by isotonic regression. Ids, categories and marks are never features.

    Returns ``transaction_id, score, predicted``: score in 0..1, predicted 1 from ``threshold``. NULL and empty
    texts are scored as texts without words. Marks of one id are joined by their largest; NULL marks and ids do
    not teach. Where the marks are not of both kinds all scores are 0. Repeated rows are scored each, an
    empty table gives an empty one, extra columns do not matter.
    """
    ship(txns.sparkSession)
    source = columns(txns, transaction_id=cols.transaction_id, text=cols.merchant)
    told = columns(marks, transaction_id=cols.transaction_id, label=cols.fraud)
    one = (
        told.filter("transaction_id is not null and label is not null")
        .groupBy("transaction_id")
        .agg(F.max((F.col("label") > 0).cast("int")).alias("label"))
        .withColumn("draw", F.xxhash64(F.lit("mark"), "transaction_id"))
    )
    # Bounded by sample_rows, so it may be broadcast.
    drawn = one.orderBy("draw", "transaction_id").limit(sample_rows)
    drawn = written(drawn.withColumn("fits", F.pmod("draw", F.lit(4)) != 0), "marks")
    labelled = written(source.join(F.broadcast(drawn), "transaction_id"), "marked_texts")
    seen_labels = {(r["fits"], r["label"]) for r in labelled.select("fits", "label").distinct().collect()}
    if not {(True, 0), (True, 1)} <= seen_labels:
        return source.select(
            F.col("transaction_id").alias(cols.transaction_id),
            F.lit(0.0).alias("score"),
            F.lit(0).alias("predicted"),
        )
    lexicon = fit_lexicon(labelled.filter("fits"), least, odds)
    own = F.when(F.col("fits"), F.col("label"))
    taught = written(_with_features(labelled.withColumn("own", own), lexicon), "marked_features", BATCH_ROWS)
    vector = array_to_vector("features")
    train = taught.filter("fits").select(vector.alias("features"), F.col("label").cast("double").alias("label"))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=17, maxBins=64).fit(train.coalesce(4))
    tail = taught.filter("not fits") if {(False, 0), (False, 1)} <= seen_labels else taught
    margins = model.transform(tail.select(vector.alias("features"), F.col("label").cast("double").alias("label")))
    margin = vector_to_array("probability")[1]
    isotonic = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="score").fit(
        margins.select(margin.alias("margin"), "label").coalesce(1)
    )
    featured = written(_with_features(source, lexicon), "toxic_features", BATCH_ROWS)
    raw = model.transform(featured.withColumn("features", vector)).select("transaction_id", margin.alias("margin"))
    scored = isotonic.transform(raw)
    return scored.select(
        F.col("transaction_id").alias(cols.transaction_id),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score")).alias("score"),
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def calm_transactions(
    txns: DataFrame, marks: DataFrame, cols: TxnColumns = CARD_COLUMNS, **options
) -> DataFrame:
    """The transactions that are not predicted toxic, with all their columns.

    Only ids that go meet the rows. Rows that share an id share its largest score; rows with a NULL id stay.
    """
    scored = score_toxicity(txns, marks, cols, **options)
    gone = written(
        scored.filter("predicted = 1").select(F.col(cols.transaction_id).alias("gone_id")).distinct(), "toxic_ids"
    )
    rows = txns.select(F.struct(*[txns[c] for c in txns.columns]).alias("row"), txns[cols.transaction_id].alias("id"))
    return rows.join(gone, F.col("id") == F.col("gone_id"), "left_anti").select("row.*")
