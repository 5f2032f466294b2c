"""What Python workers hold at a time."""

import pyarrow as pa
import pytest

from swipelake import scratch
from swipelake.llm import jaccard, packing, text, toxicity
from swipelake.llm.registered import vocabulary_path


def test_batches_are_sliced():
    batches = [pa.RecordBatch.from_pydict({"text": [str(i) for i in range(n)]}) for n in (1200, 0, 3)]
    parts = list(text.sliced(iter(batches), 500))
    assert [p.num_rows for p in parts] == [500, 500, 200, 3]
    assert [v for p in parts for v in p.column("text").to_pylist()] == [v for b in batches for v in b.column("text").to_pylist()]


def test_words_without_a_hit_share_what_they_contribute():
    lexicon = toxicity.Lexicon({"=bad": (0, 900)}, 1000, 1000)
    seen = toxicity._Seen(lexicon)
    assert len({id(seen(f"word{c}")) for c in "abcdefgh"}) == 1
    assert seen("bad")[0] == "bad" and seen("WORD")[4] and not seen("word")[4]


def test_memory_of_done_batches_is_given_back(monkeypatch):
    class Pool:
        released = 0

        def release_unused(self):
            self.released += 1

    pool = Pool()
    monkeypatch.setattr(text.pa, "default_memory_pool", lambda: pool)
    batches = [pa.RecordBatch.from_pydict({"text": [str(i) for i in range(n)]}) for n in (1200, 3)]
    assert sum(part.num_rows for part in text.sliced(iter(batches), 500)) == 1203
    assert pool.released == 2


def test_few_words_are_remembered_and_the_sets_are_the_same(monkeypatch):
    monkeypatch.setattr(jaccard, "_hashes", {})
    texts = [" ".join(f"w{k}x{i}" for i in range(500)) for k in range(240)]
    first = [s.tolist() for s in jaccard.shingle_sets(texts, 4)]
    assert len(jaccard._hashes) <= 100_000
    assert first == [s.tolist() for s in jaccard.shingle_sets(texts, 4)] and len(first[-1]) == 497


def _batch_sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})


def test_written_bounds_what_workers_get_and_leaves_the_session_as_it_was(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    set_before = spark.conf.get(key, None)
    rows = spark.range(0, 95, 1, 1).mapInArrow(_batch_sizes, "n long")

    def sizes(most):
        return sorted(r["n"] for r in scratch.written(rows, "sizes", most).collect())

    assert sizes(None) == [95]
    assert sizes(30) == [5, 30, 30, 30]
    assert spark.conf.get(key, None) == set_before
    spark.conf.set(key, 20)
    try:
        assert sizes(30) == [15, 20, 20, 20, 20]
        with pytest.raises(ZeroDivisionError), scratch.arrow_batches(spark, 10):
            assert spark.conf.get(key) == "10"
            1 / 0  # noqa: B018
        assert spark.conf.get(key) == "20"
    finally:
        spark.conf.unset(key)


def test_workers_of_the_pipeline_get_few_texts_at_a_time(spark, cols, monkeypatch):
    asked = []

    def noted(df, label, batch_rows=None):
        if "MapInArrow" in df._jdf.queryExecution().optimizedPlan().toString():
            asked.append((label, batch_rows))
        return scratch.written(df, label, batch_rows)

    for module in (jaccard, toxicity, packing):
        monkeypatch.setattr(module, "written", noted)
    texts = [f"shop {i % 7} on the {'bad' if i % 2 else 'good'} street {i} of many words" for i in range(60)]
    txns = spark.createDataFrame([(f"T{i}", t, i % 2) for i, t in enumerate(texts)], "trans_num string, merchant string, is_fraud int")
    jaccard.distinct_transactions(txns, cols, common=1).count()
    toxicity.score_toxicity(txns, txns, cols, trees=2)
    packing.pack_sequences(txns, vocabulary_path(), cols).count()
    assert {label for label, _ in asked} >= {"jaccard_digest", "jaccard_fresh", "jaccard_whole", "marked_features", "toxic_features", "pieces"}
    assert all(rows == text.BATCH_ROWS for _, rows in asked)
