"""Sharding, mixing and packing of merchant descriptors."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from swipelake.llm import mixing, packing, sharding
from swipelake.llm.registered import cyclic_weights, vocabulary_path


def descriptors(spark, sizes, category=lambda i: f"c{i % 3}"):
    rows = [(f"T{i:05d}", " ".join(f"w{i}x{k}" for k in range(n)), category(i)) for i, n in enumerate(sizes)]
    return spark.createDataFrame(rows, "trans_num string, merchant string, category string")


def test_shards_are_even_and_slots_gapless(spark):
    txns = descriptors(spark, [(i * 37) % 60 + 1 for i in range(3000)])
    found = sharding.shard_transactions(txns, shards=8).toPandas()
    by = found.groupby("shard")
    for load in ("bytes", "tokens"):
        sums = by[load].sum()
        assert len(sums) == 8 and sums.max() - sums.min() <= 0.01 * sums.mean()
    assert by.size().max() - by.size().min() <= 0.02 * by.size().mean()
    assert all(sorted(slots) == list(range(len(slots))) for _, slots in by["slot"])


def test_equal_texts_share_a_shard_unless_hot(spark):
    rows = [(f"T{i}", f"shop {i // 2}" if i < 600 else "hot", "c") for i in range(900)]
    txns = spark.createDataFrame(rows, "trans_num string, merchant string, category string")
    found = sharding.shard_transactions(txns, shards=8).toPandas().merge(txns.toPandas(), on="trans_num")
    spread = found.groupby("merchant")["shard"].nunique()
    assert spread.drop("hot").max() == 1
    assert spread["hot"] > 1
    assert found.groupby("shard")["bytes"].sum().std() < 0.05 * found.groupby("shard")["bytes"].sum().mean()


def test_a_group_that_fits_a_shard_stays_whole(spark):
    """40 equal texts fill 4/5 of a shard in bytes, tokens and rows."""
    rows = [(f"T{i}", "shop 000" if i < 40 else f"shop {i:03d}", "c") for i in range(200)]
    txns = spark.createDataFrame(rows, "trans_num string, merchant string, category string")
    found = sharding.shard_transactions(txns, shards=4).toPandas().merge(txns.toPandas(), on="trans_num")
    assert found[found.merchant == "shop 000"]["shard"].nunique() == 1
    sums = found.groupby("shard")["bytes"].sum()
    assert len(sums) == 4 and sums.max() - sums.min() < 0.05 * sums.mean()


def test_dot_product_picks_the_shard_with_matching_room():
    loads = np.array([[9.0, 1, 1], [1, 9, 1], [8, 1, 1], [1, 8, 1]])
    chosen = sharding.place_items(loads, 2)
    assert chosen[0] == chosen[3] and chosen[1] == chosen[2]


def test_odd_rows_are_sharded(odd):
    found = sharding.shard_transactions(odd).toPandas()
    assert len(found) == odd.count()
    assert found[found.trans_num == "T1"]["text_crc32"].item() == 0
    assert found[found.trans_num == "T1"]["bytes"].item() == 8
    assert sharding.shard_transactions(odd.limit(0)).count() == 0


def water_filled(sizes, weights, repeats):
    """Targets by giving excess back round after round."""
    left, target, open_ = sum(sizes.values()), {}, set(sizes)
    while True:
        total = sum(weights[k] for k in open_)
        over = [k for k in open_ if left * weights[k] / total > repeats * sizes[k]] if total else []
        if not over:
            return target | {k: left * weights[k] / total for k in open_}
        for k in over:
            target[k] = repeats * sizes[k]
            open_.remove(k)
        left = sum(sizes.values()) - sum(target.values())


@pytest.mark.parametrize("case", [[5, 50, 500], [1, 1, 1], [1000, 3, 2, 1, 1], [0, 7, 9]])
def test_mix_meets_targets(spark, case):
    rows = [
        (f"T{c}-{i}", "w " * (1 + (i * 7) % 5), f"c{c}") for c, n in enumerate(case) for i in range(n)
    ] or [("T", "w", "c0")]
    txns = spark.createDataFrame(rows, "trans_num string, merchant string, category string")
    sizes = defaultdict(int)
    for _, text, category in rows:
        sizes[category] += len(text.split())
    weights = {k: i % 3 + 1 for i, k in enumerate(sorted(sizes))}
    want = water_filled(dict(sizes), weights, 3)
    found = mixing.mix_categories(txns, cyclic_weights(txns, mixing.CARD_COLUMNS)).toPandas()
    assert len(found) == len(rows)
    assert (found.taken <= 3 * found.words).all()
    by = found.merge(txns.toPandas(), on="trans_num").groupby("category")
    for name, own in by:
        assert own.target.iloc[0] == pytest.approx(want[name])
        assert own.taken.sum() == int(want[name] + 0.5)
        assert (own.category_words == sizes[name]).all()


def test_mix_does_not_depend_on_partitions(spark):
    txns = descriptors(spark, [i % 9 for i in range(400)])
    weights = cyclic_weights(txns, mixing.CARD_COLUMNS)
    a = mixing.mix_categories(txns, weights).toPandas().sort_values("trans_num").reset_index(drop=True)
    b = mixing.mix_categories(txns.repartition(7), weights, buckets=16).toPandas()
    assert a.equals(b.sort_values("trans_num").reset_index(drop=True))


def test_copies_of_one_row_are_cut_among_them(spark):
    """A third of all rows are one row, another part shares one id: budgets are still met to a text."""
    copy = [(7, "grocery_pos", "ten words are in this text and nothing else here")] * 400
    shared = [(8, "grocery_pos", f"shared id {i % 50} " + "w " * (i % 9)) for i in range(300)]
    none = [(None, "grocery_pos", f"no id {i % 40}") for i in range(200)]
    other = [(100 + i, "travel", "a b c " * (1 + i % 5)) for i in range(500)]
    txns = spark.createDataFrame(copy + shared + none + other, "trans_num long, category string, merchant string")
    weights = cyclic_weights(txns, mixing.CARD_COLUMNS)
    told = mixing.mix_categories(txns.repartition(9), weights).toPandas()
    assert len(told) == txns.count()
    for _, part in told.groupby("target"):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= 0.5
    few = mixing.mix_categories(txns, weights, buckets=4).toPandas()
    assert sorted(map(str, told.values.tolist())) == sorted(map(str, few.values.tolist()))
    size = F.regexp_count("merchant", F.lit(r"[^ ]+"))
    kept = mixing.mixed(txns.repartition(9), weights).groupBy("category").agg(F.sum(size)).collect()
    assert len(kept) == 2
    for name, words in kept:
        want = txns.filter(F.col("category") == name).agg(F.sum(size)).first()[0]
        target = told[told["category_words"] == want]["target"].iloc[0]
        assert abs(words - target) <= 10, name


def test_mixed_rows_follow_the_decisions(spark):
    txns = descriptors(spark, [i % 9 + 1 for i in range(600)], lambda i: "big" if i % 4 else "small")
    weights = spark.createDataFrame([("big", 1.0), ("small", 2.0)], "category string, weight double")
    told = mixing.mix_categories(txns, weights).toPandas().set_index("trans_num")
    times = mixing.mixed(txns, weights).groupBy("trans_num").count().toPandas().set_index("trans_num")["count"]
    for name, row in told.iterrows():
        whole = row.taken / row.words
        assert abs(times.get(name, 0) - whole) <= 0.5
    assert mixing.mixed(txns, weights).columns == txns.columns


def test_odd_rows_are_mixed(odd, cols):
    weights = cyclic_weights(odd, cols)
    assert mixing.mix_categories(odd, weights).count() == odd.count()
    assert mixing.mixed(odd, weights).columns == odd.columns
    assert mixing.mix_categories(odd.limit(0), weights).count() == 0
    assert mixing.mixed(odd.limit(0), weights).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200), st.integers(1, 6))
def test_bins_hold_and_fit_best(lengths, limit):
    bins = packing.OpenBins(50, limit)
    open_, used = {}, defaultdict(int)
    for n in lengths:
        fitting = [b for b, free in open_.items() if free >= n]
        chosen, offset = bins.place(n)
        if fitting:
            assert open_[chosen] == min(open_[b] for b in fitting)
        else:
            assert chosen not in open_ and offset == 0
            if len(open_) == limit:
                fullest = min(open_.values())
                open_.pop(next(b for b in open_ if open_[b] == fullest and b not in bins.by_free[fullest]))
            open_[chosen] = 50
        assert offset == used[chosen]
        used[chosen] += n
        open_[chosen] -= n
        if not open_[chosen]:
            open_.pop(chosen)
        assert len(open_) <= limit and used[chosen] <= 50


def test_encoder_gives_the_tokenizers_ids():
    from tokenizers import Tokenizer

    path = vocabulary_path()
    plain = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        own = packing.Encoder(file.read())
    texts = [
        "Hello, it's the SHOP; we'll pay 12.50!", "a<|endoftext|>b <|x", "d'été ÉTÉ, œuvre", "x\x1cy a b  c",
        "İstanbul ΣΑΣ, 1２3 ½ a_b c​d é", "²x ⅷ ᄀᄀ가 ǅ,", "", None, "tab\tline\nend\r\x0b\x0c", "💳💳 card",
    ]
    for _ in range(2):
        for text, ids in zip(texts, own.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text or "", add_special_tokens=False).ids


def test_pieces_round_trip(spark, odd):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary_path())
    found = packing.pack_sequences(odd, vocabulary_path(), capacity=512, tokens_per_task=4000).toPandas()
    texts = {r["trans_num"]: r["merchant"] for r in odd.collect()}
    for name, pieces in found.groupby("trans_num"):
        ids = [*plain.encode(texts[name] or "", add_special_tokens=False).ids, 1]
        for p in pieces.itertuples():
            part = np.array(ids[p.start : p.start + p.length], dtype="<u4")
            assert zlib.crc32(part.tobytes()) == p.ids_crc32
            assert p.start == 512 * p.piece and p.length == len(part) <= 512
    for _, own in found.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1].tolist()]
        assert own.length.sum() <= 512
    assert packing.pack_sequences(odd.limit(0), vocabulary_path()).count() == 0
