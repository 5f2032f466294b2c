"""Near-copy classes against brute force, families and hot groups included."""

import random
import re

import pytest

from swipelake.llm import jaccard
from swipelake.llm.components import components


def brute(texts, size=4, percent=85):
    sets = []
    for text in texts:
        words = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def edited(words, edits, draw, pool):
    words = list(words)
    for _ in range(edits):
        at = draw.randrange(len(words))
        kind = draw.randrange(3)
        if kind == 0:
            words[at] = f"n{draw.randrange(pool)}"
        elif kind == 1:
            del words[at]
        else:
            words.insert(at, f"n{draw.randrange(pool)}")
    return words


def family(seed, copies, length, most, pool):
    """Copies of one text with few to many edits; some edits are shared."""
    draw = random.Random(seed)
    base = [f"b{seed}w{i}" for i in range(length)]
    texts = [base]
    for _ in range(copies):
        texts.append(edited(draw.choice(texts[-6:]) if draw.random() < 0.5 else base, draw.randrange(1, most), draw, pool))
    return [" ".join(t) for t in texts]


def classes(spark, texts, **options):
    rows = [(i, t, "c") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "trans_num long, merchant string, category string")
    found = {r["trans_num"]: (r["shingles"], r["class_id"]) for r in jaccard.similar_transactions(frame, **options).collect()}
    return [found[i] for i in range(len(texts))]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_classes_equal_brute_force(spark, seed):
    """Families of edited copies, a line that all share, exact copies, and short texts."""
    draw = random.Random(seed)
    line = " ".join(f"license{i}" for i in range(25))
    texts = family(seed, 60, 60, 5, 9) + family(seed + 10, 40, 140, 9, 400)
    texts += [f"{line} " + " ".join(f"u{seed}x{i}y{k}" for k in range(draw.randrange(5, 60))) for i in range(40)]
    texts += ["", None, "one", "One", "a b c", "a b c d", "A b C d"] + texts[:5]
    assert classes(spark, texts, common=4) == brute(texts)


def brute_links(texts, size=4, percent=85):
    """How many other sets each text's set links to."""
    sets = []
    for text in texts:
        words = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append(frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))) if words else frozenset())
    every = set(sets) - {frozenset()}
    return [sum(a != b and 100 * len(a & b) >= percent * len(a | b) for b in every) if a else 0 for a in sets]


def test_links_are_counted_inside_families(spark):
    """Members that all link to the leader: few and many edits, shared ones, exact copies, two families that meet."""
    draw = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(edited(base, 1, draw, 900)) for _ in range(60)] + family(21, 70, 90, 4, 6)
    texts += family(22, 50, 150, 9, 300) + texts[:4] + ["", None, "one", "One"]
    frame = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "trans_num long, merchant string, category string")
    found = {r["trans_num"]: r["links"] for r in jaccard.similar_transactions(frame, common=4, count_links=True).collect()}
    want = brute_links(texts)
    assert max(want) > 50
    assert [found[i] for i in range(len(texts))] == want


def test_a_shared_edit_is_not_paired_out(spark):
    """Members that all share one edit and are far from the leader: heads connect them, few pairs stay open."""
    draw = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    far = [*base[:40], *[f"shared{i}" for i in range(8)], *base[48:]]
    texts = [" ".join(base)] * 2 + [" ".join(edited(base, 1, draw, 900)) for _ in range(60)]
    texts += [" ".join(edited(far, 1, draw, 900)) for _ in range(150)]
    seen = {}

    def count(name, real):
        def run(*args):
            made = real(*args)
            seen[name] = seen.get(name, 0) + made.count()
            return made

        return run

    patch = pytest.MonkeyPatch()
    for name in ("_family_pairs", "_head_pairs", "_open_pairs"):
        patch.setattr(jaccard, name, count(name, getattr(jaccard, name)))
    try:
        assert classes(spark, texts, common=4) == brute(texts)
    finally:
        patch.undo()
    assert seen["_head_pairs"] < 20 * len(texts) and seen["_family_pairs"] + seen["_open_pairs"] < 20 * len(texts)


def test_members_that_lack_the_same_windows_are_not_paired_out(spark, monkeypatch):
    """Edits of their own at the same places of one text: what is lacking is common, what links is rare."""
    draw = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    texts = [" ".join(base)]
    for _ in range(160):
        words = list(base)
        for at in sorted(draw.sample(range(150), draw.randrange(3, 7)), reverse=True):
            if draw.random() < 0.5:
                del words[at]
            else:
                words[at] = f"n{draw.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [f"{t} {t.split()[-1]}" for t in texts[1:6]]
    seen = []
    real = jaccard._family_pairs

    def count(*args):
        pairs = real(*args)
        seen.append(pairs.count())
        return pairs

    monkeypatch.setattr(jaccard, "_family_pairs", count)
    assert classes(spark, texts, common=4) == brute(texts)
    assert seen[0] < 2 * len(texts)


def test_bounds_do_not_change_the_result(spark):
    texts = family(7, 50, 80, 7, 12)
    plain = classes(spark, texts)
    assert classes(spark, texts, common=1, late_shingles=20) == plain
    assert classes(spark, texts, common=3, broadcast_keys=0) == plain


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 201), (201, 200)]
    frame = spark.createDataFrame([(b, a) for a, b in links], "a long, b long")
    found = {r["node"]: r["component"] for r in components(frame).collect()}
    assert {n: c for n, c in found.items() if n <= 60} == dict.fromkeys(range(61), 0)
    assert {c for n, c in found.items() if 100 <= n < 140} == {100}
    assert found[201] == found[200] == 200
    assert components(frame.limit(0)).count() == 0


def test_odd_rows_have_classes(odd):
    found = jaccard.similar_transactions(odd).toPandas()
    assert len(found) == odd.count()
    by = found.set_index("trans_num")
    assert by.loc["T1", "shingles"] == by.loc["T3", "shingles"] == 0
    assert set(found[found.shingles == 6]["class_id"]) == {"T4"}
    assert jaccard.similar_transactions(odd.limit(0)).count() == 0


def test_one_of_each_class_stays(odd):
    kept = jaccard.distinct_transactions(odd)
    assert kept.columns == odd.columns
    assert sorted(r["trans_num"] or "" for r in kept.collect()) == ["", "T1", "T2", "T3", "T4", "T6"]
    assert jaccard.distinct_transactions(odd.limit(0)).count() == 0
