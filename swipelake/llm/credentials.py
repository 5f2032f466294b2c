"""Secrets in merchant descriptors, with multipart credentials linked inside scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swipelake.columns import CARD_COLUMNS, TxnColumns
from swipelake.llm.text import columns, matches
from swipelake.scratch import written

# Fixed kinds in the order in which spans with one start are listed, then what linking adds.
KINDS = ("assign", "access", "hex")
LINKED = ("identifier", "secret", "endpoint")

# Fixed patterns of certain spans.
ASSIGN = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"
# A text without one of these has no assigned secret.
ASSIGNED = r"(?i:passw|secret|token|api_?key)"

# Parts that are no finding alone: who, with what, and where.
IDENTIFIER = (
    r"""(?<![A-Za-z0-9_])(?i:user(?:name|_id)?|login|client_?id|account|access_?key(?:_id)?)["']?\x20{0,4}"""
    r"""[:=]\x20{0,4}["']?[A-Za-z0-9._@-]{3,}+"""
)
SECRET = (
    r"""(?<![A-Za-z0-9_])(?i:pass|pwd|passphrase|credential|private_?key|auth)["']?\x20{0,4}"""
    r"""[:=]\x20{0,4}["']?[A-Za-z0-9+/_.=-]{6,}+"""
)
ENDPOINT = (
    r"(?<![A-Za-z0-9])(?i:https?|ftp|sftp|ssh|jdbc:[a-z]{2,12}|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)"
    r"://[A-Za-z0-9._~:@%-]{3,}+"
)


def _kept(found: Column, kind: str, place: int, test) -> Column:
    return F.transform(
        F.filter(found, test),
        lambda s: F.struct(
            s["start"].alias("start"),
            F.lit(place).alias("place"),
            s["end"].alias("end"),
            F.lit(kind).alias("kind"),
        ),
    )


def certain_spans(text: Column) -> Column:
    """Findings of the fixed patterns, by start and kind."""
    keyword = F.regexp_like(text, F.lit(ASSIGNED))
    return F.array_sort(
        F.concat(
            _kept(matches(text, ASSIGN, keyword, 1), "assign", 0, lambda s: F.length(s["text"]) >= 12),
            _kept(
                matches(text, ACCESS, F.contains(text, F.lit("AKIA"))),
                "access",
                1,
                lambda s: F.length(s["hit"]) >= 18,
            ),
            _kept(matches(text, HEX), "hex", 2, lambda s: F.length(s["hit"]) >= 16),
        )
    )


def weak_parts(text: Column) -> Column:
    """Parts that count only together: identifiers, secrets, endpoints.

    What the fixed patterns find too short to be certain is such a part: an assigned value of 4 to 11 characters
    is a secret, a short access key an identifier. Short hex runs are not, since plain words look like them.
    """
    labelled = F.regexp_like(text, F.lit(r"[:=]"))
    short = F.regexp_like(text, F.lit(ASSIGNED))
    return F.concat(
        _kept(matches(text, IDENTIFIER, labelled), "identifier", 3, lambda s: F.lit(True)),
        _kept(
            matches(text, ACCESS, F.contains(text, F.lit("AKIA"))),
            "identifier",
            3,
            lambda s: F.length(s["hit"]) < 18,
        ),
        _kept(matches(text, SECRET, labelled), "secret", 4, lambda s: F.lit(True)),
        _kept(
            matches(text, ASSIGN, short, 1), "secret", 4, lambda s: F.length(s["text"]).between(4, 11)
        ),
        _kept(
            matches(text, ENDPOINT, F.contains(text, F.lit("://"))), "endpoint", 5, lambda s: F.lit(True)
        ),
    )


def link_parts(parts: DataFrame, scope: int) -> DataFrame:
    """Weak parts that a complementary part meets: its nearest character is at most ``scope`` places away.

    ``parts`` has ``row, start, end, role, weak``; roles are identifier, secret and endpoint. The interval
    join goes by blocks of one scope, and nothing is paired. Each block keeps the first start and the last end
    of every role among the parts that touch it. A part meets all that touch a block of its own; what touches
    only the blocks beside them lies on one side, so there the nearest start or end tells. A part is
    linked when a secret meets an identifier or an endpoint, and either of these a secret.
    """
    placed = parts.withColumn("last", F.greatest(F.col("end") - 1, F.col("start")))
    placed = placed.withColumn("low", F.floor(F.col("start") / scope)).withColumn("high", F.floor(F.col("last") / scope))
    blocks = (
        placed.withColumn("block", F.explode(F.sequence("low", "high")))
        .groupBy("row", "block")
        .agg(
            *[
                agg(F.when(F.col("role") == role, F.col(side))).alias(f"{role}_{side}")
                for role in LINKED
                for side, agg in (("start", F.min), ("last", F.max))
            ]
        )
    )
    reach = F.explode(F.sequence(F.col("low") - 1, F.col("high") + 1)).alias("block")
    asked = placed.filter("weak").select("row", "start", "end", "last", "role", reach)

    def meets(role: str) -> Column:
        behind = F.col(f"{role}_start") - F.col("last")
        before = F.col("start") - F.col(f"{role}_last")
        return F.coalesce((behind <= scope) & (before <= scope), F.lit(False))

    complement = F.when(F.col("role") == "secret", meets("identifier") | meets("endpoint")).otherwise(
        meets("secret")
    )
    met = asked.join(blocks, ["row", "block"]).filter(complement)
    return met.select("row", "start", "end", "role").distinct()


def secret_spans(txns: DataFrame, cols: TxnColumns = CARD_COLUMNS, scope: int = 160) -> DataFrame:
    """Secrets in the whole merchant descriptor of every transaction.

    Certain spans (``assign``, ``access``, ``hex`` by their fixed patterns) always stay. Weak parts, such as a
    user name, a short password or a server address, are reported only when complementary parts
    co-occur within ``scope`` characters, from the end of one to the start of the next; certain spans take part in that as access identifiers and secrets.

    Returns ``transaction_id, spans``; a span has ``start, place, end, kind, base``, ordered by start, then kind.
    Rows with one id and one text share their answer, repeated rows are answered each. NULL and empty
    texts have no span, ids may be NULL, an empty table gives an empty one, extra columns do not matter.
    DataFrame functions only.
    """
    source = columns(txns, transaction_id=cols.transaction_id, text=cols.merchant)
    text = F.coalesce("text", F.lit(""))
    found = written(
        source.select(
            "transaction_id",
            F.struct(F.xxhash64("transaction_id", "text"), F.crc32(text), F.length(text)).alias("row"),
            certain_spans(text).alias("sure"),
            weak_parts(text).alias("weak"),
        ),
        "secret_parts",
    )
    role = {"assign": "secret", "hex": "secret", "access": "identifier"}
    roles = F.create_map(*[F.lit(x) for pair in role.items() for x in pair])
    both = found.filter(F.size("weak") > 0).dropDuplicates(["row"])
    parts = both.select(
        "row",
        F.inline(
            F.concat(
                F.transform(
                    "sure",
                    lambda s: F.struct(
                        s["start"].alias("start"),
                        s["end"].alias("end"),
                        roles[s["kind"]].alias("role"),
                        F.lit(False).alias("weak"),
                    ),
                ),
                F.transform(
                    "weak",
                    lambda s: F.struct(
                        s["start"].alias("start"),
                        s["end"].alias("end"),
                        s["kind"].alias("role"),
                        F.lit(True).alias("weak"),
                    ),
                ),
            )
        ),
    )
    linked = (
        link_parts(parts, scope)
        .groupBy("row")
        .agg(F.collect_list(F.struct("start", "end", F.col("role").alias("kind"))).alias("linked"))
    )
    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")
    place = F.create_map(*[x for i, k in enumerate(LINKED) for x in (F.lit(k), F.lit(len(KINDS) + i))])
    shaped = found.join(linked, "row", "left").select(
        "transaction_id",
        F.transform("sure", lambda s: _span(s, s["place"], True)).alias("sure"),
        F.transform(F.coalesce("linked", none), lambda s: _span(s, place[s["kind"]], False)).alias("more"),
    )
    apart = F.filter(
        "more",
        lambda a: ~F.exists("sure", lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])),
    )
    return shaped.select(
        F.col("transaction_id").alias(cols.transaction_id),
        F.array_sort(F.concat("sure", apart)).alias("spans"),
    )


def _span(span: Column, place: Column, base: bool) -> Column:
    return F.struct(
        span["start"].alias("start"),
        place.alias("place"),
        span["end"].alias("end"),
        span["kind"].alias("kind"),
        F.lit(base).alias("base"),
    )


def masked(
    txns: DataFrame, cols: TxnColumns = CARD_COLUMNS, scope: int = 160, mask: str = "[secret]"
) -> DataFrame:
    """The transactions with every found secret in the merchant descriptor replaced by ``mask``.

    Certain spans are masked where they stand, without a shuffle; only texts with weak parts wait for the
    linking. Rows and all other columns stay as they are; NULL texts stay NULL.
    """
    kept = txns.select(
        F.struct(*[txns[c] for c in txns.columns]).alias("row"),
        txns[cols.transaction_id].alias("transaction_id"),
        txns[cols.merchant].alias("text"),
    ).withColumn("has_weak", F.coalesce(F.size(weak_parts(F.col("text"))) > 0, F.lit(False)))
    own = TxnColumns(transaction_id="transaction_id", merchant="text")
    key = F.struct("transaction_id", F.xxhash64("text"), F.length("text"))
    weak = kept.filter("has_weak").withColumn("key", key)
    spans = secret_spans(weak.select(F.col("key").alias("transaction_id"), "text"), own, scope)
    spans = spans.dropDuplicates(["transaction_id"]).withColumnRenamed("transaction_id", "key")
    alone = kept.filter("not has_weak").select("row", "text", certain_spans(F.col("text")).alias("spans"))
    linked = weak.join(spans, "key").select("row", "text", "spans")

    def shown(df: DataFrame) -> DataFrame:
        text = F.when(F.size("spans") > 0, _cut(F.col("text"), F.col("spans"), mask)).otherwise(F.col("text"))
        return df.select(
            *[text.alias(c) if c == cols.merchant else F.col("row")[c].alias(c) for c in txns.columns]
        )

    return shown(alone).unionByName(shown(linked))


def _cut(text: Column, spans: Column, mask: str) -> Column:
    """The text with ``mask`` for each span; overlapping spans make one."""
    first = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def add(state: Column, s: Column) -> Column:
        gap = F.substring(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        fresh = F.struct(F.concat(state["done"], gap, F.lit(mask)).alias("done"), s["end"].alias("at"))
        longer = F.struct(
            state["done"].alias("done"), F.greatest(state["at"], s["end"]).alias("at")
        )
        return F.when(s["start"] >= state["at"], fresh).otherwise(longer)

    rest = lambda state: F.concat(
        state["done"], F.substring(text, (state["at"] + 1).cast("int"), F.length(text))
    )
    return F.aggregate(spans, first, add, rest)
