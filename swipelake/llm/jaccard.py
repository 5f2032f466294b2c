"""N-gram Jaccard self-join of merchant descriptors by grouped prefixes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swipelake.columns import CARD_COLUMNS, TxnColumns
from swipelake.llm.components import components
from swipelake.llm.packing import split_words
from swipelake.llm.shipping import ship
from swipelake.llm.text import BATCH_ROWS, columns, sliced
from swipelake.scratch import written

# Most words of a text are among the commonest; the rest hardly ever come again.
_CACHED_WORDS = 100_000
_LATE_ROUNDS = 3
# Any odd multipliers do; they set the places of a window's words apart.
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)

_hashes: dict[str, bytes] = {}


def _word_hashes(words: list[str]) -> bytes:
    """8 bytes for each word, its A-Z lower-cased."""
    found = list(map(_hashes.get, words))
    if None in found:
        for at, known in enumerate(found):
            if known is None:
                word = words[at]
                found[at] = xxhash.xxh64_digest(word.encode().lower())
                if len(_hashes) < _CACHED_WORDS:
                    _hashes[word] = found[at]
    return b"".join(found)


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingle_sets(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the ``size``-word windows of each text.

    A shorter text is one window; a text without words has none.
    """
    multipliers = [
        np.uint64(_MULTIPLIERS[k % len(_MULTIPLIERS)]) + np.uint64(2 * k) for k in range(size)
    ]
    for at in range(0, len(texts), BATCH_ROWS):
        split = [split_words(t) if t else [] for t in texts[at : at + BATCH_ROWS]]
        packed = [_word_hashes(words) for words in split]
        words = np.frombuffer(b"".join(packed), dtype=">u8").astype(np.uint64)
        windows = np.zeros(0, dtype=np.uint64)
        if len(words) >= size:
            count = len(words) - size + 1
            mixed = words[:count] * multipliers[0]
            for k in range(1, size):
                mixed += words[k : k + count] * multipliers[k]
            windows = _mix(mixed)
        start = 0
        for own, raw in zip(split, packed, strict=True):
            n = len(own)
            if n >= size:
                yield np.unique(windows[start : start + n - size + 1])
            elif n:
                yield np.array([xxhash.xxh64_intdigest(raw, seed=n)], dtype=np.uint64)
            else:
                yield np.zeros(0, dtype=np.uint64)
            start += n


def prefix_length(n: int, percent: int) -> int:
    """So many first shingles of a set, in any common order, meet those of every set it links to."""
    return n - (percent * n + 99) // 100 + 1 if n else 0


def _prefix(shingles: np.ndarray, percent: int, last: np.ndarray) -> np.ndarray:
    """First shingles by hash; those in ``last`` (sorted) come after all others."""
    if len(last):
        at = np.minimum(np.searchsorted(last, shingles), len(last) - 1)
        late = last[at] == shingles
        if late.any():
            shingles = np.concatenate([shingles[~late], shingles[late]])
    return shingles[: prefix_length(len(shingles), percent)]


def _arrays(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _set_key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _sets(texts: DataFrame, size: int, percent: int, last: np.ndarray | None, prefix: bool) -> DataFrame:
    """Adds ``set_key``, ``n`` and ``shingles`` (the prefix, or all of them) to rows with a ``text``."""
    others = [c for c in texts.columns if c != "text"]
    schema = texts.select(
        *others,
        F.lit(b"").alias("set_key"),
        F.lit(0).cast("long").alias("n"),
        F.array(F.lit(0).cast("long")).alias("shingles"),
    ).schema
    late = texts.sparkSession.sparkContext.broadcast(np.zeros(0, np.uint64) if last is None else last)

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = list(shingle_sets(batch.column("text").to_pylist(), size))
            shown = [_prefix(s, percent, late.value) for s in sets] if prefix else sets
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in others],
                    pa.array([_set_key(s) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    _arrays(shown),
                ],
                [*others, "set_key", "n", "shingles"],
            )

    return texts.mapInArrow(make, schema)


def _sized(keys: DataFrame, most: int) -> DataFrame:
    """``keys`` for a join: broadcast while at most ``most`` rows, else joined by a shuffle."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _must_share(a: Column, b: Column, percent: int) -> Column:
    """So many prefix shingles two linked sets of ``a`` and ``b`` shingles have in common.

    A set has few shingles outside the intersection, so the rest of its prefix are the first ones of the
    intersection; the shorter of the two rests is in both prefixes.
    """
    overlap = F.floor((percent * (a + b) + 99 + percent) / (100 + percent))

    def inside(n: Column) -> Column:
        return 1 - F.floor((percent * n + 99) / 100)

    return F.least(inside(a), inside(b)) + overlap


class _Texts:
    """The texts of rows, to be read again for the few sets that need them whole."""

    def __init__(self, rows: DataFrame, size: int, percent: int, most: int):
        self.rows, self.size, self.percent, self.most = rows, size, percent, most

    def sets(self, wanted: DataFrame, late: np.ndarray | None = None, prefix: bool = False) -> DataFrame:
        """``set_key, n, row_hash, shingles`` of the rows with a ``row_hash`` in ``wanted`` (written)."""
        keys = _sized(wanted.select("row_hash").distinct(), self.most)
        texts = self.rows.join(keys, "row_hash", "left_semi")
        return _sets(texts, self.size, self.percent, late, prefix)

    def met(self, pairs: DataFrame, rows: DataFrame) -> DataFrame:
        """The pairs ``a, b`` of set keys with their whole sets ``of_a`` and ``of_b``, and what they ``share``.

        ``rows`` tells the row of each set.
        """
        pairs = written(pairs, "jaccard_pairs")
        asked = pairs.select(F.explode(F.array("a", "b")).alias("set_key")).distinct()
        wanted = written(rows.join(asked, "set_key").select("set_key", "row_hash"), "jaccard_wanted")
        whole = self.sets(wanted).select("set_key", "shingles")
        whole = written(
            whole.join(_sized(wanted.select("set_key"), self.most), "set_key", "left_semi"), "jaccard_whole", BATCH_ROWS
        )
        left = whole.select(F.col("set_key").alias("a"), F.col("shingles").alias("of_a"))
        right = whole.select(F.col("set_key").alias("b"), F.col("shingles").alias("of_b"))
        share = F.size(F.array_intersect("of_a", "of_b"))
        return pairs.join(left, "a").join(right, "b").withColumn("share", share)

    def linked(self, pairs: DataFrame, rows: DataFrame) -> DataFrame:
        """Those of the pairs that link."""
        found = self.met(pairs, rows).filter(_links("of_a", "of_b", self.percent)).select("a", "b")
        return written(found.distinct(), "jaccard_links")


def _links(a: str, b: str, percent: int) -> Column:
    return 100 * F.col("share") >= percent * (F.size(a) + F.size(b) - F.col("share"))


def _most_apart(a: Column, b: Column, percent: int) -> Column:
    """The largest symmetric difference of two linked sets of ``a`` and ``b`` shingles."""
    return a + b - 2 * F.floor((percent * (a + b) + 99 + percent) / (100 + percent))


def _late_shingles(sets: DataFrame, above: int, most: int) -> np.ndarray:
    """The commonest prefix shingles, at most ``most``: which ones only matters for speed."""
    counted = sets.select(F.explode("shingles").alias("token")).groupBy("token").count()
    rows = (
        counted.filter(F.col("count") > above)
        .orderBy(F.desc("count"), "token")
        .limit(most)
        .select("token")
        .toArrow()
    )
    return np.sort(rows.column("token").to_numpy().astype(np.int64).view(np.uint64))


def _with_late(sets: DataFrame, texts: _Texts, late: np.ndarray, new: np.ndarray) -> DataFrame:
    """Sets with the prefixes of the order in which ``late`` shingles come last, ``new`` ones among them.

    Only a set whose prefix holds a new late shingle gets another prefix; its text is read again.
    """
    shared = sets.sparkSession.sparkContext.broadcast(new)

    def touched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("shingles")
            values = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            hits = np.concatenate([[0], np.cumsum(np.isin(values, shared.value))])
            ends = np.cumsum(np.concatenate([[0], column.value_lengths().to_numpy(zero_copy_only=False)]))
            found = pa.array(hits[ends[1:]] > hits[ends[:-1]])
            yield batch.select(["set_key", "row_hash"]).filter(found)

    narrow = sets.select("set_key", "row_hash", "shingles")
    again = written(
        narrow.mapInArrow(touched, narrow.select("set_key", "row_hash").schema), "jaccard_again", BATCH_ROWS
    )
    fresh = written(texts.sets(again, late, True).select(*sets.columns), "jaccard_fresh", BATCH_ROWS)
    kept = sets.join(_sized(again.select("set_key"), texts.most), "set_key", "left_anti")
    return kept.select(*sets.columns).unionByName(fresh)


def similar_transactions(
    txns: DataFrame,
    cols: TxnColumns = CARD_COLUMNS,
    size: int = 4,
    percent: int = 85,
    common: int = 24,
    late_shingles: int = 200_000,
    broadcast_keys: int = 1_000_000,
    count_links: bool = False,
) -> DataFrame:
    """Classes of transactions whose merchant descriptors share most of their word windows.

    A descriptor's set are its distinct ``size``-word windows, A-Z in lower case; two link when
    ``100 * intersection >= percent * union``; a class is what links reach. Steps:

    1. Equal sets become one. Every set has its prefix: the first shingles in hash order, so many that linked
       sets share some. Prefix shingles held by over ``common`` sets come last in the order instead, and so do those
       that then take their places.
    2. Sets with identical prefixes and size form a group; prefix shingles of at least two sets give
       postings of groups.
    3. Each posting list has a leader, the group with the commonest shingles. Members are checked
       against leaders first: those that come near one are its family, and a member that links to it is connected.
       Then sets outside the largest family of a list are checked against the leader of that family.
    4. Two members of a family, not both linked to the leader, can only link if they differ from it
       in the same shingles: a second prefix join, on the differences. Its lists have heads in turn: members are checked
       against the head of their list, by their differences alone. What is connected by then needs no pair any more;
       only members of different components in one list are paired.
    5. Group pairs of one posting list in different components that fit in size and share as many prefix
       shingles as linked sets must are expanded. These pairs are checked against the whole sets.

    Returns ``transaction_id, shingles, class_id``: the set's size and the smallest id of the class. Texts of equal sets
    are one set. No link between sets of different classes is lost; links inside a class that join nothing further are
    not searched, unless ``count_links`` asks for ``links``, the number of other sets that a set links to: that
    costs the square of a family whose members share an edit. NULL and empty texts have no shingle and form no class but their own;
    repeated rows and equal texts share one class; NULL ids count for nothing in the smallest id. An
    empty table gives an empty one; extra columns do not matter. ``broadcast_keys`` bounds what
    is broadcast as a filter; beyond it the same join is shuffled.
    """
    ship(txns.sparkSession)
    source = columns(txns, transaction_id=cols.transaction_id, text=cols.merchant)
    hashed = source.withColumn("row_hash", F.xxhash64("transaction_id", "text"))
    texts = _Texts(hashed.select("text", "row_hash"), size, percent, broadcast_keys)
    digest = written(_sets(hashed, size, percent, None, True), "jaccard_digest", BATCH_ROWS)
    full = digest.filter("n > 0")
    firsts = written(
        full.groupBy("set_key").agg(
            F.min("transaction_id").alias("first_id"),
            F.min("row_hash").alias("row_hash"),
            (F.count(F.lit(1)) > 1).alias("copied"),
        ),
        "jaccard_firsts",
    )
    copied = firsts.filter("copied").select("set_key", F.col("row_hash").alias("first_row"))
    sets = (
        full.join(_sized(copied, broadcast_keys), "set_key", "left")
        .filter("first_row is null or first_row = row_hash")
        .select("set_key", "n", "row_hash", "shingles")
    )
    # Shingles that move up into the prefix instead of late ones may be as common as those.
    late = np.zeros(0, np.uint64)
    for _ in range(_LATE_ROUNDS):
        new = np.setdiff1d(_late_shingles(sets, common, late_shingles), late)[: late_shingles - len(late)]
        if not len(new):
            break
        late = np.union1d(late, new)
        sets = _with_late(sets, texts, late, new)

    groups = _groups(sets)
    postings = _postings(sets, groups, broadcast_keys)
    told = _near(texts.met(_leader_pairs(groups, postings, percent), firsts), percent)
    others = _hub_pairs(groups, postings, told, _families(told), common)
    told = told.unionByName(_near(texts.met(others, firsts), percent))
    families = written(_families(told), "jaccard_families")
    lists = _family_lists(families, percent)
    first = families.filter("linked").select("a", "b").unionByName(_linked_by_differences(_head_pairs(lists), families, percent))
    parts = written(components(_ordered(first), "jaccard_components"), "jaccard_parts_of")
    near = _placed(groups, postings, families, parts)
    inside = _linked_by_differences(_family_pairs(lists, parts, percent), families, percent)
    rest = texts.linked(_open_pairs(near, postings, percent), firsts).unionByName(inside)
    # Links between parts, by their components so far; parts that nothing joins keep theirs.
    sides = [parts.select(F.col("node").alias(s), F.col("component").alias(f"part_{s}")) for s in ("a", "b")]
    joined = rest.join(sides[0], "a", "left").join(sides[1], "b", "left").select(
        F.coalesce("part_a", "a").alias("a"), F.coalesce("part_b", "b").alias("b")
    )
    merged = components(_ordered(joined.filter("a != b")), "jaccard_merged")
    merged = merged.select(F.col("node").alias("part"), F.col("component").alias("whole"))
    every = parts.select("node", "component").unionByName(
        rest.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(parts, "node", "left_anti").withColumn("component", F.col("node"))
    )
    classes = every.join(merged, F.col("component") == F.col("part"), "left").select(
        F.col("node").alias("set_key"), F.coalesce("whole", "component").alias("component")
    )
    counts = _link_counts(groups, postings, families, texts, firsts, percent) if count_links else None
    shown = ["links"] if count_links else []
    labelled = written(
        _with_links(firsts.join(classes, "set_key", "left"), counts).select(
            "set_key", "first_id", F.coalesce("component", "set_key").alias("component"), *shown
        ),
        "jaccard_labels",
    )
    smallest = labelled.groupBy("component").agg(F.min("first_id").alias("class_id"))
    by_set = labelled.join(smallest, "component").select("set_key", "class_id", *shown)
    with_words = full.select("transaction_id", "set_key", "n").join(by_set, "set_key")
    without = digest.filter("n = 0").select(
        "transaction_id", "n", F.col("transaction_id").alias("class_id"), *[F.lit(0).cast("long").alias(c) for c in shown]
    )
    return with_words.select(*without.columns).unionByName(without).select(
        F.col("transaction_id").alias(cols.transaction_id), F.col("n").alias("shingles"), "class_id", *shown
    )


def _with_links(sets: DataFrame, counts: DataFrame | None) -> DataFrame:
    if counts is None:
        return sets
    return sets.join(counts, "set_key", "left").withColumn("links", F.coalesce("links", F.lit(0)))


def _groups(sets: DataFrame) -> DataFrame:
    """``set_key, gid, n`` of sets that share prefix and size with others; the rest are their own group."""
    key = F.struct("n", F.xxhash64("shingles"), F.hash("shingles"), F.element_at("shingles", -1))
    keyed = sets.select("set_key", "n", key.alias("key"))
    several = keyed.groupBy("key").agg(F.min("set_key").alias("gid"), F.count(F.lit(1)).alias("members"))
    return written(
        keyed.join(several.filter("members > 1"), "key").select("set_key", "gid", "n").distinct(), "jaccard_groups"
    )


def _postings(sets: DataFrame, groups: DataFrame, most: int) -> DataFrame:
    """``token, gid, n, holders``: prefix shingles that at least two sets hold, by group."""
    flat = sets.select("set_key", "n", F.explode("shingles").alias("token"))
    tokens = written(
        flat.groupBy("token").agg(F.count(F.lit(1)).alias("holders")).filter("holders > 1"), "jaccard_tokens"
    )
    shared = flat.join(_sized(tokens, 2 * most), "token")
    own = shared.join(_sized(groups.select("set_key", "gid"), most), "set_key", "left")
    return written(
        own.select("token", F.coalesce("gid", "set_key").alias("gid"), "n", "holders").distinct(),
        "jaccard_postings",
    )


def _members(groups: DataFrame, gids: DataFrame, as_gid: str, as_member: str) -> DataFrame:
    """Every row of ``gids`` for each member of its group."""
    members = groups.select(F.col("gid").alias(as_gid), F.col("set_key").alias("_member"))
    joined = gids.join(members, as_gid, "left")
    return joined.withColumn(as_member, F.coalesce("_member", as_gid)).drop("_member")


def _leader_pairs(groups: DataFrame, postings: DataFrame, percent: int) -> DataFrame:
    """Each member with the leaders of its posting lists, and with the first of its own group.

    Pairs that share few shingles under this leader are left out: other pairs will do for them.
    """
    weight = postings.groupBy("gid").agg(F.sum("holders").alias("weight"))
    leaders = (
        postings.join(weight, "gid")
        .groupBy("token")
        .agg(F.max(F.struct("weight", "gid", "n")).alias("top"))
        .select("token", F.col("top.gid").alias("leader"), F.col("top.n").alias("leader_n"))
    )
    apart = (F.col("gid") != F.col("leader")) & _sizes_fit(F.col("n"), F.col("leader_n"), percent)
    led = (
        postings.join(leaders, "token")
        .filter(apart)
        .groupBy("gid", "leader", "n", "leader_n")
        .agg(F.count(F.lit(1)).alias("shared"))
        .filter(3 * F.col("shared") >= _must_share(F.col("n"), F.col("leader_n"), percent))
    )
    pairs = _members(groups, led.select("gid", F.col("leader").alias("b")), "gid", "a").select("a", "b")
    inside = groups.filter(F.col("set_key") != F.col("gid")).select(
        F.col("set_key").alias("a"), F.col("gid").alias("b")
    )
    return pairs.unionByName(inside)


def _near(met: DataFrame, percent: int) -> DataFrame:
    """Each member with the leaders that it links to or comes near, and where they differ.

    ``a`` is the member and ``b`` the leader; ``apart`` holds the shingles of one of them only, the member's first.
    """
    near = met.filter(2 * F.col("share") >= F.size("of_a") + F.size("of_b") - F.col("share"))
    linked = _links("of_a", "of_b", percent)
    apart = F.concat(F.array_except("of_a", "of_b"), F.array_except("of_b", "of_a"))
    told = near.select(
        "a", "b", F.size("of_a").alias("n_a"), F.size("of_b").alias("n_b"), linked.alias("linked"), "share", apart.alias("apart")
    )
    return written(told.distinct(), "jaccard_near")


def _families(told: DataFrame) -> DataFrame:
    """Near pairs and whether the leader is the member's home: the one with most members near it.

    Families of one text become one so, whose members meet by their differences.
    """
    size = told.groupBy(F.col("b").alias("of")).agg(F.count(F.lit(1)).alias("size"))
    sized = told.join(size, F.col("b") == F.col("of"))
    home = sized.groupBy("a").agg(F.max(F.struct("size", "share", "b")).alias("best"))
    home = home.select("a", F.col("best.b").alias("home"))
    return told.join(home, "a").withColumn("is_home", F.col("b") == F.col("home")).drop("home")


def _hub_pairs(groups: DataFrame, postings: DataFrame, told: DataFrame, families: DataFrame, common: int) -> DataFrame:
    """Sets outside the largest family of a posting list, with the leader of that family.

    Only lists count where that family has over ``common`` groups: it would be met member by member otherwise.
    """
    homes = families.filter("is_home").select(F.col("a").alias("set_key"), F.col("b").alias("home"))
    placed = _members(groups, postings.select("gid").distinct(), "gid", "set_key").join(homes, "set_key", "left")
    placed = written(placed.withColumn("home", F.coalesce("home", "set_key")), "jaccard_homes")
    by_home = placed.select("gid", "home").distinct().join(postings.select("token", "gid"), "gid")
    counted = by_home.groupBy("token", "home").agg(F.count(F.lit(1)).alias("size"))
    top = counted.groupBy("token").agg(F.max(F.struct("size", "home")).alias("top"), F.count(F.lit(1)).alias("homes"))
    top = top.filter((F.col("homes") > 1) & (F.col("top.size") > common)).select("token", F.col("top.home").alias("b"))
    asked = postings.select("token", "gid").join(top, "token").select("gid", "b").distinct()
    pairs = placed.join(asked, "gid").filter("home != b and set_key != b").select(F.col("set_key").alias("a"), "b")
    return pairs.distinct().join(told.select("a", "b"), ["a", "b"], "left_anti")


def _ordered(pairs: DataFrame) -> DataFrame:
    """Links once each, the smaller key first."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _family_lists(families: DataFrame, percent: int) -> DataFrame:
    """``b, token, member, n, d, place, asks, linked``: the members of a family that differ from its leader in one shingle.

    With ``d`` for how far a member is from the leader, two members are ``d1 + d2 - 2 * (shared differences)`` apart.
    One that does not link to the leader ``asks``: its ``d1`` alone is more than linked sets may differ, so it
    must share differences with each partner, more than half of ``d2`` but for what sizes make up. That is a prefix filter
    on the differences, the rarest of the family first; ``place`` counts from 1. Differences of one member only are left out.
    """
    home = families.filter("is_home").withColumn("d", F.size("apart"))
    most = _most_apart(F.col("n_a"), F.col("n_b"), percent)
    kept = ["b", "token", "member", "n", "d"]
    flat = home.select(
        "b",
        F.explode("apart").alias("token"),
        F.col("a").alias("member"),
        F.col("n_a").alias("n"),
        "d",
        "linked",
        (F.floor((F.col("d") + most) / 2) + 1).alias("asked"),
        (F.floor((F.col("d") - 1 + F.abs(F.col("n_a") - F.col("n_b"))) / 2) + 1).alias("answered"),
    )
    held = flat.groupBy("b", "token").agg(F.count(F.lit(1)).alias("held"))
    order = Window.partitionBy("member").orderBy("held", "token")
    placed = flat.join(held, ["b", "token"]).withColumn("place", F.row_number().over(order)).filter("held > 1")
    sides = F.filter(
        F.array(F.when(~F.col("linked") & (F.col("place") <= F.col("asked")), True), F.when(F.col("place") <= F.col("answered"), False)),
        lambda side: side.isNotNull(),
    )
    return written(placed.select(*kept, "place", "linked", F.explode(sides).alias("asks")), "jaccard_lists")


def _head_pairs(lists: DataFrame) -> DataFrame:
    """Each asking member with the head of its lists: one that links to the leader, if there is any."""
    heads = lists.filter("not asks").groupBy("b", "token").agg(F.min(F.struct(~F.col("linked"), "member")).alias("head"))
    heads = heads.select("b", "token", F.col("head.member").alias("head"))
    asked = lists.filter("asks").select("b", "token", "member").join(heads, ["b", "token"]).filter("member != head")
    return asked.select(F.col("member").alias("a"), F.col("head").alias("b")).distinct()


def _linked_by_differences(pairs: DataFrame, families: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs, members of one family each, that link: their sets differ where their differences do."""
    home = families.filter("is_home")
    one = home.select("a", F.col("n_a").alias("n_1"), F.col("apart").alias("apart_1"))
    two = home.select(F.col("a").alias("b"), F.col("n_a").alias("n_2"), F.col("apart").alias("apart_2"))
    met = written(pairs, "jaccard_asked").join(one, "a").join(two, "b")
    apart = F.size("apart_1") + F.size("apart_2") - 2 * F.size(F.array_intersect("apart_1", "apart_2"))
    links = apart <= _most_apart(F.col("n_1"), F.col("n_2"), percent)
    return written(met.filter(links).select("a", "b"), "jaccard_family_links")


def _family_pairs(lists: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Pairs of one list that are not connected yet, where size and distance from the leader leave a link open.

    The rarest difference that two linked members share comes so early in both that all they must share can follow.
    """
    of = parts.select(F.col("node").alias("member"), F.col("component").alias("part"))
    placed = lists.join(of, "member", "left").withColumn("part", F.coalesce("part", "member"))
    mixed = (
        placed.groupBy("b", "token")
        .agg(F.min("part").alias("low"), F.max("part").alias("high"), F.max("asks").alias("asked"))
        .filter("asked and low < high")
        .select("b", "token")
    )
    placed = written(placed.join(mixed, ["b", "token"], "left_semi"), "jaccard_mixed")
    one, two = (
        placed.filter(F.col("asks") == asks).select("b", "token", *[F.col(c).alias(f"{c}_{s}") for c in ("member", "n", "d", "place", "part")])
        for asks, s in ((True, 1), (False, 2))
    )
    two = two.withColumnsRenamed({"b": "of", "token": "by"})
    most = _most_apart(F.col("n_1"), F.col("n_2"), percent)
    close = F.abs(F.col("d_1") - F.col("d_2")) <= most
    share = F.floor((F.col("d_1") + F.col("d_2") - most + 1) / 2)
    early = (F.col("place_1") + share <= F.col("d_1") + 1) & (F.col("place_2") + share <= F.col("d_2") + 1)
    open_ = (F.col("part_1") != F.col("part_2")) & _sizes_fit(F.col("n_1"), F.col("n_2"), percent) & close & early
    met = one.join(two, (F.col("b") == F.col("of")) & (F.col("token") == F.col("by")) & open_)
    return met.select(F.least("member_1", "member_2").alias("a"), F.greatest("member_1", "member_2").alias("b")).distinct()


# ---- numbers of links, where they are asked for ------------------------------------------------------


def _every_family_pair(families: DataFrame, percent: int) -> DataFrame:
    """Pairs of one family that may link though not both link to the leader.

    With ``d`` for how far a member is from the leader, two members are ``d1 + d2 - 2 * (shared differences)`` apart.
    The first one does not link to the leader, so ``d1`` alone is more than linked sets may differ, and they
    must share differences: more than half of ``d2``, but for what sizes make up. That is a prefix filter
    on the differences, where those that the leader lacks come first, and these are rare.
    """
    home = families.filter("is_home").withColumn("d", F.size("apart"))
    most = _most_apart(F.col("n_a"), F.col("n_b"), percent)
    first = home.filter("not linked").select(
        "b",
        F.col("a").alias("one"),
        F.explode(F.slice("apart", 1, (F.floor((F.col("d") + most) / 2) + 1).cast("int"))).alias("token"),
    )
    uneven = F.abs(F.col("n_a") - F.col("n_b"))
    second = home.select(
        "b",
        F.col("a").alias("two"),
        F.explode(F.slice("apart", 1, (F.floor((F.col("d") - 1 + uneven) / 2) + 1).cast("int"))).alias("token"),
    )
    met = first.join(second, ["b", "token"]).filter("one != two")
    return met.select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b")).distinct()


def _link_counts(
    groups: DataFrame, postings: DataFrame, families: DataFrame, texts: _Texts, firsts: DataFrame, percent: int
) -> DataFrame:
    """``set_key, links`` of all sets with a link: every pair that may link is checked or counted."""
    near = _placed(groups, postings, families, None)
    pairs = _every_family_pair(families, percent).unionByName(_open_pairs(near, postings, percent))
    rest = texts.linked(pairs.distinct(), firsts)
    links = written(_ordered(families.filter("linked").select("a", "b").unionByName(rest)), "jaccard_links")
    ends = _outside_families(links, families).select(F.explode(F.array("a", "b")).alias("node"))
    return _degrees(ends, _inside_families(families, percent))


def _home_linked(families: DataFrame) -> DataFrame:
    """Members that link to the leader ``b`` of their family."""
    return families.filter("is_home and linked")


def _outside_families(links: DataFrame, families: DataFrame) -> DataFrame:
    """The links but for those of two members that both link to the leader of their family."""
    home = _home_linked(families)
    home_a, home_b = (home.select(F.col("a").alias(s), F.col("b").alias(f"home_{s}")) for s in ("a", "b"))
    placed = links.join(home_a, "a", "left").join(home_b, "b", "left")
    return placed.filter("home_a is null or home_b is null or home_a != home_b").select("a", "b")


def _inside_families(families: DataFrame, percent: int) -> DataFrame:
    """``set_key, links``: how many others of its family a member links to, where all of them link to the leader.

    Two members ``d1`` and ``d2`` apart from the leader are ``d1 + d2 - 2 * (shared differences)`` apart from
    each other. Where ``d1 + d2`` is little enough they link whatever they share: those are counted by size and
    distance, without pairs. Only of the others the shared differences are counted, pair by pair.
    """
    home = _home_linked(families).select("b", F.col("a").alias("set_key"), F.col("n_a").alias("n"), F.size("apart").alias("d"), "apart")
    kinds = written(home.groupBy("b", "n", "d").agg(F.count(F.lit(1)).alias("members")), "jaccard_kinds")
    other = kinds.select("b", F.col("n").alias("n_2"), F.col("d").alias("d_2"), F.col("members").alias("members_2"))
    over = F.col("d") + F.col("d_2") - _most_apart(F.col("n"), F.col("n_2"), percent)
    itself = (F.col("n") == F.col("n_2")) & (F.col("d") == F.col("d_2"))
    met = kinds.join(other, "b").groupBy("b", "n", "d").agg(
        F.sum(F.when(over <= 0, F.col("members_2") - F.when(itself, 1).otherwise(0)).otherwise(0)).alias("links"),
        F.max(F.when(over > 0, over)).alias("open"),
    )
    placed = home.join(met, ["b", "n", "d"])
    flat = placed.filter("open is not null").select("b", "set_key", "n", "d", F.explode("apart").alias("token"))
    two = flat.select("b", "token", F.col("set_key").alias("set_2"), F.col("n").alias("n_2"), F.col("d").alias("d_2"))
    linked = (
        flat.join(two, ["b", "token"])
        .filter((F.col("set_key") < F.col("set_2")) & (over > 0))
        .groupBy("set_key", "set_2", over.alias("over"))
        .agg(F.count(F.lit(1)).alias("shared"))
        .filter(2 * F.col("shared") >= F.col("over"))
    )
    ends = linked.select(F.explode(F.array("set_key", "set_2")).alias("set_key"))
    return placed.select("set_key", "links").unionByName(ends.withColumn("links", F.lit(1).cast("long")))


def _degrees(ends: DataFrame, inside: DataFrame) -> DataFrame:
    """``set_key, links``: one for each of ``ends``, and the sums of ``inside``."""
    each = ends.select(F.col("node").alias("set_key"), F.lit(1).cast("long").alias("links"))
    return each.unionByName(inside).groupBy("set_key").agg(F.sum("links").alias("links"))


# ---- pairs of different components -------------------------------------------------------------------


def _placed(groups: DataFrame, postings: DataFrame, families: DataFrame, parts: DataFrame | None) -> DataFrame:
    """``set_key, gid, part``: a set's family and, if given, its component so far.

    Sets of one family have met by their differences, and sets of one component need not meet.
    """
    listed = _members(groups, postings.select("gid").distinct(), "gid", "set_key")
    home = families.filter("is_home").select(F.col("a").alias("set_key"), F.col("b").alias("home"))
    if parts is None:
        own = home.select("set_key", F.col("set_key").alias("component"))
    else:
        own = parts.select(F.col("node").alias("set_key"), "component")
    placed = listed.join(home, "set_key", "left").join(own, "set_key", "left")
    part = F.struct(F.coalesce("home", "set_key").alias("home"), F.coalesce("component", "set_key").alias("component"))
    return written(placed.select("set_key", "gid", part.alias("part")), "jaccard_parts")


def _open_pairs(near: DataFrame, postings: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets of different families and components whose groups share what linked sets must."""
    listed = postings.select("token", "gid", "n").join(near.select("gid", "part").distinct(), "gid")
    mixed = (
        listed.groupBy("token")
        .agg(
            *[f(f"part.{c}").alias(f"{n}_{c}") for c in ("home", "component") for n, f in (("low", F.min), ("high", F.max))]
        )
        .filter("low_home < high_home and low_component < high_component")
        .select("token")
    )
    listed = written(listed.join(mixed, "token", "left_semi"), "jaccard_open")
    held = listed.groupBy("token", "part").agg(
        F.min("gid").alias("gid"), F.count(F.lit(1)).alias("gids"), F.min("n").alias("low"), F.max("n").alias("high")
    )
    # Homes of a list first, so that the many parts of one family do not meet each other.
    home_a, home_b = (held.select("token", F.col("part.home").alias(f"home_{s}")).distinct() for s in ("a", "b"))
    homes = home_a.join(home_b, "token").filter("home_a < home_b")
    half_a, half_b = (
        held.select(
            "token",
            F.col("part.home").alias(f"home_{s}"),
            *[F.col(c).alias(f"{c}_{s}") for c in ("part", "gid", "gids", "low", "high")],
        )
        for s in ("a", "b")
    )
    reach = (100 * F.col("high_b") >= percent * F.col("low_a")) & (100 * F.col("high_a") >= percent * F.col("low_b"))
    apart = F.col("part_a.component") != F.col("part_b.component")
    pairs = homes.join(half_a, ["token", "home_a"]).join(half_b, ["token", "home_b"]).filter(apart & reach)
    # Most parts have one group in a list: those pairs are complete.
    alone = (F.col("gids_a") == 1) & (F.col("gids_b") == 1)
    names = ["gid_a", "part_a", "n_a", "gid_b", "part_b", "n_b"]
    plain = pairs.filter(alone).withColumnsRenamed({"low_a": "n_a", "low_b": "n_b"}).select(*names)
    side_a, side_b = (
        listed.select(
            "token", F.col("part").alias(f"part_{s}"), F.col("gid").alias(f"gid_{s}"), F.col("n").alias(f"n_{s}")
        )
        for s in ("a", "b")
    )
    wide = pairs.filter(~alone).select("token", "part_a", "part_b")
    spread = wide.join(side_a, ["token", "part_a"]).join(side_b, ["token", "part_b"]).select(*names)
    met = plain.unionByName(spread)
    group_pairs = (
        met.filter(_sizes_fit(F.col("n_a"), F.col("n_b"), percent))
        .groupBy(*names)
        .agg(F.count(F.lit(1)).alias("shared"))
        .filter(F.col("shared") >= _must_share(F.col("n_a"), F.col("n_b"), percent))
    )
    own_a, own_b = (
        near.select(F.col("gid").alias(f"gid_{s}"), F.col("part").alias(f"part_{s}"), F.col("set_key").alias(s))
        for s in ("a", "b")
    )
    return group_pairs.join(own_a, ["gid_a", "part_a"]).join(own_b, ["gid_b", "part_b"]).select("a", "b")


def distinct_transactions(
    txns: DataFrame, cols: TxnColumns = CARD_COLUMNS, broadcast_keys: int = 1_000_000, **options
) -> DataFrame:
    """One transaction of each class of similar ones: that with the smallest id, with all its columns.

    Only ids that go, or that occur more than once, meet the rows (broadcast while at most
    ``broadcast_keys``). Rows without a word and rows with a NULL id are kept; of repeated rows with one id and
    one text one is kept.
    """
    own = cols.transaction_id
    classes = similar_transactions(txns, cols, broadcast_keys=broadcast_keys, **options)
    verdicts = written(
        classes.groupBy(F.col(own).alias("id"))
        .agg(F.max(F.col(own) == F.col("class_id")).alias("stays"), F.count(F.lit(1)).alias("rows"))
        .filter("id is not null and (not stays or rows > 1)")
        .select("id", "stays"),
        "jaccard_verdicts",
    )
    few = verdicts.limit(broadcast_keys + 1).count() <= broadcast_keys
    rows = txns.select(
        F.struct(*[txns[c] for c in txns.columns]).alias("row"),
        txns[own].alias("id"),
        F.xxhash64(txns[cols.merchant]).alias("text_hash"),
    )
    judged = rows.join(F.broadcast(verdicts) if few else verdicts, "id", "left")
    alone = judged.filter("stays is null").select("row")
    repeated = judged.filter("stays").dropDuplicates(["id", "text_hash"]).select("row")
    return alone.unionByName(repeated).select("row.*")
