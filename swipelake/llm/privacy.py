"""Personal data in merchant descriptors: labelers vote, EM weighs them, a classifier decides."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swipelake.columns import CARD_COLUMNS, TxnColumns
from swipelake.llm.text import columns, matches
from swipelake.scratch import written

# Kinds in the order in which spans with one start are listed.
KINDS = ("email", "ip", "card", "phone")
VOTERS = ("regex", "gazetteer", "context")

# Fixed patterns of certain spans. Loops at the end are possessive: they match the same and need no
# stack for long runs.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"

# Looser shapes that only the vote can make a span: spelled-out addresses, national phone numbers.
LOOSE_EMAIL = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?(?:\(at\)|\[at\]) ?| at )"
    r"[A-Za-z0-9-]++(?:(?: ?(?:\(dot\)|\[dot\]) ?| dot |\.)[A-Za-z0-9-]++)++"
)
LOOSE_PHONE = r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"

# Gazetteers: endings of addresses, first digits of card issuers, dial codes.
ENDINGS = ("com", "org", "net", "edu", "gov", "io", "info", "biz", "de", "fr", "es", "uk", "eu", "us")
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|36|38|30[0-5]|6(?:011|4|5)|35)"
DIALS = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
# Area codes and exchanges of national numbers start with 2 to 9; x11 are service codes.
NATIONAL = r"^\(?[2-9](?!11)[0-9]{2}\)?[\x20.-][2-9]"
# Words that speak for or against personal data near a span, in English, German, French and Spanish.
CUES = {
    "email": r"e-?mails?|mail|contact|write|reach|send|kontakt|schreib(?:en|t)?|erreichbar|courriel|m[eé]l|[eé]cri(?:re|vez)|"
    r"contacte[rz]?|correo|escrib(?:a|e|ir)|contacto",
    "ip": r"ip|address|host|server|client|login|connection|adresse|rechner|anmeldung|serveur|connexion|direcci[oó]n|servidor|"
    r"conexi[oó]n",
    "card": r"card|visa|mastercard|amex|credit|debit|payment|karte|kreditkarte|zahlung|carte|paiement|tarjeta|cr[eé]dito|pago",
    "phone": r"phone|tel|call|mobile|fax|cell|dial|contact|telefon|anruf(?:en)?|handy|rufnummer|t[eé]l[eé]phone|appel(?:ez|er)?|"
    r"joindre|tel[eé]fono|llam(?:e|a|ar)|m[oó]vil",
}
AGAINST = (
    r"version|release|build|isbn|section|order|invoice|serial|model|part|ausgabe|abschnitt|bestellung|rechnung|seriennummer|"
    r"commande|facture|num[eé]ro de s[eé]rie|mod[eè]le|versi[oó]n|secci[oó]n|pedido|factura|serie|modelo"
)


@dataclass(frozen=True)
class VoteModel:
    """Reliabilities found by EM and the classifier trained on what they say."""

    prior: dict[int, float]
    reliability: dict[int, dict[str, dict[int, dict[int, float]]]]
    weights: tuple[float, ...]
    intercept: float


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def certain_spans(text: Column) -> dict[str, tuple[Column, object]]:
    """Matches of each kind and the test that makes one certain."""
    return {
        "email": (matches(text, EMAIL, F.contains(text, F.lit("@")), across=True), lambda s: F.lit(True)),
        "ip": (
            matches(text, IP, across=True),
            lambda s: F.regexp_like(s["hit"], F.lit(rf"^(?:{IP_PART}\.){{3}}{IP_PART}$")),
        ),
        "card": (
            matches(text, CARD, F.regexp_like(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){13}")), across=True),
            lambda s: F.length(_digits(s["hit"])).between(14, 19) & F.call_function("luhn_check", _digits(s["hit"])),
        ),
        "phone": (
            matches(text, PHONE, F.contains(text, F.lit("+")), across=True),
            lambda s: F.length(_digits(s["hit"])).between(10, 15),
        ),
    }


def _gazetteer(kind: str, hit: Column, loose: bool) -> Column:
    if kind == "email":
        ending = F.lower(F.regexp_extract(hit, r"([A-Za-z0-9-]+)$", 1))
        return F.when(ending.isin(*ENDINGS), 1).otherwise(-1 if loose else 0)
    if kind == "ip":
        return F.when(F.regexp_like(hit, F.lit(r"^0*(?:0|255)\.")), -1).otherwise(1)
    if kind == "card":
        return F.when(F.regexp_like(_digits(hit), F.lit(ISSUERS)), 1).otherwise(-1)
    if loose:
        return F.when(F.regexp_like(hit, F.lit(NATIONAL)), 1).otherwise(-1)
    return F.when(F.regexp_like(hit, F.lit(DIALS)), 1).otherwise(0)


def _context(kind: str, span: Column) -> Column:
    """The last word before the span that speaks for or against it, else a word for it after it."""
    one = r"(?iu)(?<!\p{{L}})(?:{0})(?!\p{{L}})"
    last = F.regexp_extract(
        span["before"], rf"(?isu)^.*(?<!\p{{L}})({CUES[kind]}|{AGAINST})(?!\p{{L}})", 1
    )
    return (
        F.when(F.regexp_like(last, F.lit(one.format(CUES[kind]))), 1)
        .when(last != "", -1)
        .when(F.regexp_like(span["after"], F.lit(one.format(CUES[kind]))), 1)
        .otherwise(0)
    )


def _pattern(kind: str, hit: Column, sure: Column, loose: bool) -> Column:
    """Certain spans and clear loose shapes get 1, failed matches and words that only look alike -1."""
    if not loose:
        return F.when(sure, 1).otherwise(-1)
    if kind == "email":
        return F.when(F.regexp_like(hit, F.lit(r"[(\[]")), 1).when(F.contains(hit, F.lit(" dot ")), 0).otherwise(-1)
    return F.when(F.startswith(hit, F.lit("(")), 1).otherwise(0)


# A failed match is a candidate where only its test went wrong, not its size.
_PLAUSIBLE = {
    "card": lambda s: F.length(_digits(s["hit"])).between(14, 19),
    "phone": lambda s: F.length(_digits(s["hit"])).between(7, 15),
}


def _candidates(text: Column) -> tuple[Column, Column]:
    """Votes of all matches of the fixed patterns, failed ones of plausible size among them, and of loose shapes."""

    def voted(found: Column, kind: str, passes, loose: bool) -> Column:
        at = KINDS.index(kind)
        return F.transform(found, lambda s: _voted(s, kind, at, passes(s), loose))

    tried = []
    for kind, (found, passes) in certain_spans(text).items():
        if (sized := _PLAUSIBLE.get(kind)) is not None:
            found = F.filter(found, sized)
        tried.append(voted(found, kind, passes, False))
    loose_email = matches(
        text, LOOSE_EMAIL, F.regexp_like(text, F.lit(r"[(\[ ]at[)\] ]")), across=True
    )
    loose_phone = matches(text, LOOSE_PHONE, across=True)
    shapes = [
        voted(found, kind, lambda s: F.lit(False), True)
        for kind, found in (("email", loose_email), ("phone", loose_phone))
    ]
    return F.concat(*tried), F.concat(*shapes)


def _meets(spans: Column, a: Column) -> Column:
    return F.exists(spans, lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"]))


def _apart(found: DataFrame) -> DataFrame:
    """``sure`` and ``others`` of ``tried`` and ``shapes``.

    What lies over a certain span says nothing of its own, and neither does a loose shape inside a failed
    match of its kind: both go before anything is counted.
    """
    split = found.select(
        "transaction_id",
        F.filter("tried", lambda s: s["base"]).alias("sure"),
        F.filter("tried", lambda s: ~s["base"]).alias("failed"),
        "shapes",
    )
    failed = F.filter("failed", lambda a: ~_meets(F.col("sure"), a))
    shapes = F.filter(
        "shapes",
        lambda a: ~_meets(F.col("sure"), a)
        & ~F.exists(
            "failed", lambda b: (a["place"] == b["place"]) & (a["start"] < b["end"]) & (b["start"] < a["end"])
        ),
    )
    return split.select("transaction_id", "sure", F.concat(failed, shapes).alias("others"))


def _voted(span: Column, kind: str, at: int, sure: Column, loose: bool) -> Column:
    sure = F.coalesce(sure, F.lit(False))
    return F.struct(
        span["start"].alias("start"),
        F.lit(at).alias("place"),
        span["end"].alias("end"),
        F.lit(kind).alias("kind"),
        sure.alias("base"),
        _pattern(kind, span["hit"], sure, loose).cast("int").alias("regex"),
        _gazetteer(kind, span["hit"], loose).cast("int").alias("gazetteer"),
        _context(kind, span).cast("int").alias("context"),
        F.lit(int(loose)).alias("loose"),
    )


def expect_reliabilities(
    patterns: list[tuple[int, tuple[int, ...], int]], known: list[bool] | None = None, rounds: int = 200
) -> tuple[dict[int, float], dict[int, dict[str, dict[int, dict[int, float]]]], list[float]]:
    """EM over vote patterns ``(kind, votes, count)``: priors, P(vote | truth) of each kind, P(true | pattern).

    The truth of a span is hidden but for the ``known`` patterns, which are true; voters are independent given
    it, and each kind has its own vote tables. The start is the mean vote. There are at most 4 kinds and 3
    votes of each voter, so the patterns are few however many spans there are.
    """
    known = known or [False] * len(patterns)
    belief = [
        1.0 if sure else min(0.95, max(0.05, 0.5 + 0.45 * sum(v) / max(1, len(v))))
        for (_, v, _), sure in zip(patterns, known, strict=True)
    ]
    prior: dict[int, float] = {}
    table: dict[int, dict[str, dict[int, dict[int, float]]]] = {}
    for _ in range(rounds):
        for kind in range(len(KINDS)):
            mine = [(b, v, n) for b, (k, v, n) in zip(belief, patterns, strict=True) if k == kind]
            prior[kind] = (1 + sum(b * n for b, _, n in mine)) / (2 + sum(n for _, _, n in mine))
            table[kind] = {}
            for at, voter in enumerate(VOTERS):
                table[kind][voter] = {}
                for truth in (0, 1):
                    counts = {vote: 1.0 for vote in (-1, 0, 1)}
                    for b, votes, n in mine:
                        counts[votes[at]] += n * (b if truth else 1 - b)
                    whole = sum(counts.values())
                    table[kind][voter][truth] = {vote: c / whole for vote, c in counts.items()}
        fresh = []
        for (kind, votes, _), sure in zip(patterns, known, strict=True):
            odds = math.log(prior[kind] / (1 - prior[kind]))
            for at, voter in enumerate(VOTERS):
                odds += math.log(table[kind][voter][1][votes[at]] / table[kind][voter][0][votes[at]])
            fresh.append(1.0 if sure else 1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        moved = max((abs(a - b) for a, b in zip(belief, fresh, strict=True)), default=0.0)
        belief = fresh
        if moved < 1e-6:
            break
    return prior, table, belief


def _features(kind: Column, votes: dict[str, Column], loose: Column) -> list[Column]:
    """Each kind, each vote of each kind, and whether the shape is loose."""
    return [
        *[(kind == i).cast("double") for i in range(1, len(KINDS))],
        *[
            ((kind == i) & (votes[v] == value)).cast("double")
            for i in range(len(KINDS))
            for v in VOTERS
            for value in (-1, 1)
        ],
        loose.cast("double"),
    ]


def fit_votes(candidates: DataFrame) -> VoteModel | None:
    """EM and the final classifier from ``sure`` and ``others`` of all rows; None where there is no candidate.

    Only counts of distinct vote patterns (a few hundred at most) leave the executors.
    """
    span = candidates.select(F.explode(F.concat("sure", "others")).alias("s"))
    counted = (
        span.groupBy("s.place", *[f"s.{v}" for v in VOTERS], "s.loose", "s.base")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("place", *VOTERS, "loose", "base")
    )
    rows = counted.collect()
    if not rows:
        return None
    patterns = [(r["place"], tuple(r[v] for v in VOTERS), r["n"]) for r in rows]
    prior, table, belief = expect_reliabilities(patterns, [r["base"] for r in rows])
    spark = candidates.sparkSession
    soft = spark.createDataFrame(
        [
            (r["place"], *[r[v] for v in VOTERS], r["loose"], label, float(weight))
            for r, b in zip(rows, belief, strict=True)
            for label, weight in ((1.0, r["n"] * b + 0.01), (0.0, r["n"] * (1 - b) + 0.01))
        ],
        f"place int, {', '.join(f'{v} int' for v in VOTERS)}, loose int, label double, weight double",
    ).coalesce(1)
    features = _features(F.col("place"), {v: F.col(v) for v in VOTERS}, F.col("loose"))
    training = soft.select("label", "weight", array_to_vector(F.array(*features)).alias("features"))
    fitted = LogisticRegression(
        weightCol="weight", regParam=1e-4, maxIter=50, standardization=False
    ).fit(training)
    return VoteModel(
        prior, table, tuple(float(w) for w in fitted.coefficients), float(fitted.intercept)
    )


def _probability(model: VoteModel, span: Column) -> Column:
    features = _features(span["place"], {v: span[v] for v in VOTERS}, span["loose"])
    logit = F.lit(model.intercept)
    for weight, feature in zip(model.weights, features, strict=True):
        logit = logit + F.lit(weight) * feature
    return 1.0 / (1.0 + F.exp(-logit))


def private_spans(
    txns: DataFrame, cols: TxnColumns = CARD_COLUMNS, threshold: float = 0.9
) -> DataFrame:
    """Personal data in the whole merchant descriptor of every transaction.

    Certain spans (email, ip, card, phone by their fixed patterns and tests) always stay. Three labelers
    vote on them, on matches of plausible size that failed their test and on looser shapes: the pattern itself,
    gazetteers (endings, issuers, dial and area codes) and the words around, in English, German, French and
    Spanish. Candidates over a certain span are left out first. EM over the counts of all vote patterns, in
    which certain spans are known to be true, estimates how reliable each labeler is for each kind; a logistic
    classifier trained on that belief decides which of the other candidates are spans too (``threshold``).

    Returns ``transaction_id, spans``; a span has ``start, place, end, kind, base, probability``, ordered by
    start, then kind. Rows stay as they are: repeated ones are answered each, NULL and empty texts
    have no span, ids may be NULL, an empty table gives an empty one, extra columns do not matter.
    DataFrame functions only.
    """
    source = columns(txns, transaction_id=cols.transaction_id, text=cols.merchant)
    tried, shapes = _candidates(F.coalesce("text", F.lit("")))
    found = written(
        source.select("transaction_id", tried.alias("tried"), shapes.alias("shapes")), "private_candidates"
    )
    apart = _apart(found)
    model = fit_votes(apart)

    def scored(span: Column) -> Column:
        chance = F.lit(0.0) if model is None else _probability(model, span)
        return F.struct(
            *[span[c].alias(c) for c in ("start", "place", "end", "kind", "base")],
            chance.alias("probability"),
        )

    added = F.filter(F.transform("others", scored), lambda s: s["probability"] >= threshold)
    return apart.select(
        F.col("transaction_id").alias(cols.transaction_id),
        F.array_sort(F.concat(F.transform("sure", scored), added)).alias("spans"),
    )
