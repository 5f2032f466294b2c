"""Languages, toxicity, quality and nearest neighbours."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from swipelake.columns import TxnColumns
from swipelake.llm import divergence, language, neighbours, toxicity
from swipelake.llm.forest import grow_tree, leaf_of, search
from swipelake.llm.text import WORDS

ENGLISH = "the shop on the corner sells bread and milk to the people of the town every day of the week".split()
GERMAN = "der laden an der ecke verkauft brot und milch an die leute der stadt jeden tag der woche".split()


def prose(words, n, seed):
    draw = random.Random(seed)
    return " ".join(draw.choice(words) for _ in range(n))


# ---- languages ------------------------------------------------------------------------------------


def plain_viterbi(scores, penalty):
    n, width = scores.shape
    best, back = scores[0].copy(), []
    for row in scores[1:]:
        move = best.max() - penalty
        back.append([k if best[k] >= move else int(best.argmax()) for k in range(width)])
        best = np.maximum(best, move) + row
    path = [int(best.argmax())]
    for step in reversed(back):
        path.append(step[path[-1]])
    return path[::-1]


def test_best_path_equals_plain_viterbi():
    draw = np.random.default_rng(3)
    for case in range(200):
        scores = draw.normal(size=(int(draw.integers(1, 60)), 3)) * draw.choice([0.5, 3.0])
        if case % 2:
            scores[: len(scores) // 2, 0] += 4
            scores[len(scores) // 2 :, 1] += 4
        got = language.best_path(scores, 5.0)
        want = plain_viterbi(scores, 5.0)

        def value(path, scores=scores):
            own = scores[np.arange(len(path)), path].sum()
            return own - 5.0 * sum(a != b for a, b in zip(path[:-1], path[1:], strict=True))

        assert value(list(got)) == pytest.approx(value(want))


def test_two_other_languages_share_a_switch():
    """Neither half gains a switch alone, both together do."""
    scores = np.array([[-5.0, 0, -20]] * 2 + [[-5.0, -20, 0]] * 2)
    assert language.best_path(scores, 12.0).tolist() == [1, 1, 2, 2]
    assert language.best_path(scores, 21.0).tolist() == [0, 0, 0, 0]
    assert language.best_path(scores[:, :1], 12.0).tolist() == [0, 0, 0, 0]


@pytest.fixture(scope="module")
def spoken(spark):
    rows = [(f"E{i}", prose(ENGLISH, 40, i), "en", "c") for i in range(40)]
    rows += [(f"D{i}", prose(GERMAN, 40, i), "de", "c") for i in range(40)]
    rows += [("M", f"{prose(ENGLISH, 60, 99)} {prose(GERMAN, 50, 99)}", None, "c"), ("N", "12 34 !!", None, "c")]
    rows += [("C", "привет мир как дела", None, "c"), ("O", None, "en", "c")]
    return spark.createDataFrame(rows, "trans_num string, merchant string, tongue string, category string")


def test_languages_of_whole_and_mixed_texts(spoken):
    learn = ~F.col("trans_num").rlike("[05]$")
    found = {r["trans_num"]: r for r in language.label_languages(spoken, learn, language="tongue").collect()}
    assert all(found[f"{k}{i}"]["language"] == v for k, v in (("E", "en"), ("D", "de")) for i in range(40))
    mixed = [(s["language"], s["words"]) for s in found["M"]["spans"]]
    assert [m[0] for m in mixed] == ["en", "de"] and abs(mixed[0][1] - 60) <= 3
    assert 0.4 < found["M"]["score"] < 0.7
    for name in ("N", "O"):
        assert (found[name]["language"], found[name]["score"], found[name]["spans"]) == ("und", 0.0, [])
    assert found["C"]["language"] in ("en", "de")


def test_odd_rows_have_languages(odd):
    nothing = language.label_languages(odd, F.lit(True), language="category").toPandas()
    assert len(nothing) == odd.count()
    untaught = language.label_languages(odd, F.lit(False), language="category")
    assert {r["language"] for r in untaught.collect()} == {"und"}
    assert language.label_languages(odd.limit(0), F.lit(True), language="category").count() == 0


# ---- toxicity -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def rude(spark):
    rows, marks = [], []
    for i in range(900):
        bad = i % 5 == 0
        words = prose(ENGLISH, 30, i).split()
        if bad:
            words[i % 30] = ("scoundrel", "blockhead", f"wretch{'a' * (i % 4)}bly")[i % 3]
            words[(i + 7) % 30] = "scoundrel"
        rows.append((f"T{i}", " ".join(words), "c"))
        marks.append((f"T{i}", int(bad)))
    return (
        spark.createDataFrame(rows, "trans_num string, merchant string, category string"),
        spark.createDataFrame(marks, "trans_num string, is_fraud int"),
    )


def test_toxicity_on_held_out_rows(rude):
    txns, marks = rude
    found = toxicity.score_toxicity(txns, marks.filter("trans_num not like '%7' and trans_num not like '%5'")).toPandas()
    told = found.merge(marks.toPandas(), on="trans_num")
    held = told[told.trans_num.str.endswith(("7", "5"))]
    assert ((held.score >= 0.7) == (held.is_fraud == 1)).mean() > 0.98
    assert found.score.between(0, 1).all() and (found.predicted == (found.score >= 0.7)).all()
    calm = toxicity.calm_transactions(txns, marks)
    assert calm.columns == txns.columns and 700 <= calm.count() <= 730


def test_obfuscated_words_are_revealed():
    for word in ("5c0undrel", "s.c.o.u.n.d.r.e.l", "scooooundrel", "s*coundrel"):
        assert toxicity.revealed(word) == "scoundrel", word
    assert toxicity.revealed("plain") is None


def test_a_text_does_not_count_for_itself():
    lexicon = toxicity.Lexicon({"=bad": (0, 3)}, 100, 10)
    assert lexicon.weight("=bad", None) > lexicon.weight("=bad", 1) > 0
    assert lexicon.weight("=good", None) == 0


def test_odd_rows_are_scored(odd, spark):
    marks = odd.select("trans_num", "is_fraud")
    found = toxicity.score_toxicity(odd, marks)
    assert found.count() == odd.count() and found.filter("score is null").count() == 0
    assert toxicity.score_toxicity(odd, marks.limit(0)).count() == odd.count()
    assert toxicity.calm_transactions(odd, marks).columns == odd.columns
    assert toxicity.score_toxicity(odd.limit(0), marks).count() == 0


# ---- quality --------------------------------------------------------------------------------------


def plain_measures(text):
    text = text or ""
    words, seen, again = WORDS.findall(text), set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            again += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered), failed]


def test_measures_equal_plain_python(spark, spoken, odd):
    texts = [r["merchant"] for r in spoken.collect()] + [r["merchant"] for r in odd.collect()]
    texts += ["a b c a b c", "x\nx\n\n \nx y\nx y", "a a a a", "# * $ % & | < >\n# *", "é💳 é💳 é💳 é💳", "a\x1cb c d"]
    frame = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "trans_num long, merchant string, tongue string")
    for r in divergence.judge_quality(frame, language="tongue").collect():
        got = [r[c] for c in ("words", "word_chars", "symbols", "dup_lines", "repeat_words", "base_failed")]
        assert got == plain_measures(texts[r["trans_num"]]), r["trans_num"]


def test_js_distance_is_a_distance():
    a, b = np.array([1.0, 2, 0]), np.array([[1.0, 2, 0], [0, 0, 5]])
    assert divergence.js_distance(a, b) == pytest.approx([0.0, 1.0])
    p, q = np.array([0.5, 0.5]), np.array([0.9, 0.1])
    m = (p + q) / 2
    want = np.sqrt(0.5 * (p * np.log2(p / m)).sum() + 0.5 * (q * np.log2(q / m)).sum())
    assert divergence.js_distance(p, q[None])[0] == pytest.approx(want)


def test_divergent_texts_go_and_clean_ones_stay(spark):
    rows = [(f"E{i}", prose(ENGLISH, 120, i), "en") for i in range(60)]
    rows += [("bars", " | ".join(f"{a}{b}{c}" for a in "qwxz" for b in "jkvpbfghyz" for c in "mnr"), "en"), ("few", "q z x", "en")]
    frame = spark.createDataFrame(rows, "trans_num string, merchant string, tongue string")
    found = {r["trans_num"]: r for r in divergence.judge_quality(frame, language="tongue").collect()}
    assert all(found[f"E{i}"]["kept"] for i in range(60))
    assert not found["bars"]["kept"] and not found["bars"]["base_failed"]
    assert found["few"]["base_failed"] and not found["few"]["kept"]


def test_odd_rows_are_judged(odd):
    found = divergence.judge_quality(odd, language="category").toPandas()
    assert len(found) == odd.count() and not found[found.trans_num == "T1"]["kept"].any()
    assert divergence.judge_quality(odd.limit(0), language="category").count() == 0


# ---- neighbours -----------------------------------------------------------------------------------


def test_search_visits_the_home_leaf_first():
    points = np.random.default_rng(1).normal(size=(400, 8))
    forest = [grow_tree(points, 20, np.random.default_rng(k)) for k in range(3)]
    for point in points[:20]:
        first = search(forest, point, 3)
        assert {t for t, _ in first[:3]} <= {0, 1, 2}
        assert all(leaf == leaf_of(forest[t], point[None])[0] for t, leaf in first[:1])
    assert sorted(search(forest, points[0], 10**6)) == [(t, k) for t in range(3) for k in range(forest[t].leaves)]


def test_neighbours_reach_the_recall(spark):
    draw = np.random.default_rng(5)
    vectors = np.concatenate([draw.normal(size=(600, 16)), draw.normal(size=(10, 16)).repeat(40, axis=0) + draw.normal(size=(400, 16)) * 0.05])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "trans_num long, features array<double>")
    found = neighbours.nearest_transactions(frame, F.col("trans_num") % 10 == 0, leaf_rows=16, sample_rows=500).toPandas()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    hits = 0
    for query, own in found.groupby("query_id"):
        near = unit @ unit[query]
        near[query] = -2
        best = np.lexsort((np.arange(len(near)), -near))[:5]
        own = own.sort_values("rank")
        hits += len(set(best) & set(own.trans_num))
        assert own["rank"].tolist() == [1, 2, 3, 4, 5]
        assert own.score.tolist() == pytest.approx(near[own.trans_num].tolist())
        assert own.score.is_monotonic_decreasing
    assert hits >= 0.9 * 5 * 100


def test_copies_ties_and_unusable_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]),
            (5, [1.0, None]), (6, [0.5, 0.5]), (7, [1.0]), (None, [1.0, 1.0]), (8, [-1.0, 0.1]), (8, [-1.0, 0.1]),
            (9, [1e300, 1e300]), (100, [0.0, 0.0])]
    own = TxnColumns(transaction_id="vec")
    frame = spark.createDataFrame(rows, "vec long, features array<double>").selectExpr("*", "1 as id", "2 as pid", "3 as vector")
    found = neighbours.nearest_transactions(frame, F.col("vec") % 50 == 0, own).collect()
    by = {q: [r["vec"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 50)}
    assert by[0][:2] == [1, 50] and by[50][:2] == [0, 1]
    assert set(by[0][2:4]) == {6, 9} and by[0][4] == 8
    assert {r["query_id"] for r in found} == {0, 50}
    assert neighbours.nearest_transactions(frame.limit(0), F.col("vec") % 50 == 0, own).count() == 0


def test_many_copies_of_one_vector(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(300 + i, [float(i % 7), 1.0, 0.5]) for i in range(60)]
    frame = spark.createDataFrame(rows, "trans_num long, features array<double>")
    found = neighbours.nearest_transactions(frame, F.col("trans_num") % 50 == 0, cell_rows=2).collect()
    assert len(found) == 5 * 8
    assert all([r["trans_num"] for r in found if r["query_id"] == q][:4] == [i for i in range(6) if i != q][:4] for q in (0, 50, 100))


def test_word_limits_come_from_the_reference():
    """Ordinary texts stay; a long salad of rare words and a short junk text do not."""
    draw = np.random.default_rng(2)
    common = [f"word{chr(97 + i // 8)}{chr(97 + i % 8)}" for i in range(64)]
    counts = [int(100_000 / (i + 1)) for i in range(64)]
    others = int(sum(counts) * 7 / 3)
    chance = np.array([*counts, others]) / (sum(counts) + others)
    rare = iter(f"rare{a}{b}{c}" for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyzabcdefghijklmn")

    def text(n):
        return " ".join(common[k] if k < 64 else next(rare) for k in draw.choice(65, size=n, p=chance))

    classes = np.array([divergence.class_counts(text(300))])
    judge = divergence.Judge(
        divergence.References(["en"], classes, [dict(zip(common, counts, strict=True))], [others]), divergence.Limits()
    )
    assert all(judge.measure(text(n))[6] for n in (60, 60, 150, 400))
    salad = judge.measure(" ".join(next(rare) for _ in range(400)))
    assert not salad[5] and not salad[6] and salad[9] < 0.5
    junk = judge.measure(" ".join(f"{common[0]} {common[63]} {next(rare)}" for _ in range(20)))
    assert junk[0] == 60 and not junk[5] and not junk[6]
    blank = divergence.Judge(divergence.References(["xx"], classes, [{}], [0]), divergence.Limits())
    assert set(blank.word_limits[0]) == {1.0}
