"""Allow and block rules for web addresses, carried to the aliases of a page."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swipelake.llm.components import components
from swipelake.llm.text import columns
from swipelake.operators.joins import BROADCAST_BYTES, measured_bytes, salted_join
from swipelake.scratch import written

ALLOW, BLOCK = "allow", "block"

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_QUERY = r"(?s)^[^?#]*(\?[^#]*)"
_SCHEME = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://"
_LINK = r"(?is)<link\b[^>]*>"
_META = r"(?is)<meta\b[^>]*>"
_CANONICAL = r"""(?is)\brel\s*=\s*["']?[^"'>]*\bcanonical\b"""
_REFRESH = r"""(?is)\bhttp-equiv\s*=\s*["']?refresh\b"""
_HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
_TARGET = r"""(?is)\bcontent\s*=\s*["']?[\d.\s]*;\s*url\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    found = F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit(""))
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without a ``://``."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def node_of(url: Column) -> Column:
    """One binary key for each document: host, path and query; NULL without a host.

    Scheme and fragment do not tell documents apart.
    """
    text = F.concat(host_of(url), path_of(url), F.coalesce(F.regexp_extract(url, _QUERY, 1), F.lit("")))
    return F.when(host_of(url) != "", F.unhex(F.md5(text.cast("binary"))))


def linked_urls(html: Column) -> Column:
    """Targets of canonical links and of refresh redirects in a page, as written there."""
    links = F.filter(F.regexp_extract_all(html, F.lit(_LINK), F.lit(0)), lambda t: F.regexp_like(t, F.lit(_CANONICAL)))
    metas = F.filter(F.regexp_extract_all(html, F.lit(_META), F.lit(0)), lambda t: F.regexp_like(t, F.lit(_REFRESH)))
    found = F.concat(
        F.transform(links, lambda t: F.regexp_extract(t, _HREF, 1)),
        F.transform(metas, lambda t: F.regexp_extract(t, _TARGET, 1)),
    )
    plain = F.transform(F.filter(found, lambda u: u != ""), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))
    may = F.regexp_like(html, F.lit(r"(?i)\bcanonical\b|\brefresh\b"))
    return F.when(F.coalesce(may, F.lit(False)), plain).otherwise(F.array().cast("array<string>"))


def resolved(target: Column, url: Column) -> Column:
    """``target`` as a full address, seen from the page ``url``; dot segments stay as they are."""
    scheme = F.regexp_extract(url, _SCHEME, 1)
    site = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.regexp_replace(path_of(url), r"[^/]*$", "")
    return (
        F.when(F.regexp_like(target, F.lit(_SCHEME)), target)
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(site, target))
        .when(F.startswith(target, F.lit("?")), F.concat(site, path_of(url), target))
        .when(F.startswith(target, F.lit("#")), url)
        .otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )


def _joined(big: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """Equi-join with a side that is sent to all executors if it measures small, else salted for hot keys."""
    if measured_bytes(small) <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), on)
    return salted_join(big, small, on)


def fitting_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """``row, rule, verdict``: the longest rule for each of ``places`` (``row, host, path``, rows told apart by ``row``).

    A host stands for each of its suffixes of whole labels, and a path for its prefixes of the lengths that rules of
    that suffix have, so both joins are by equal keys and no rules of one host are paired out.
    """
    held = rules.select("host", "path", "rule", "verdict")
    lengths = written(held.select("host", F.length("path").alias("length")).distinct(), "url_lengths")
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = places.filter("host != ''").select("row", "path", F.explode(suffix).alias("host"))
    met = _joined(asked, lengths, ["host"]).filter(F.length("path") >= F.col("length"))
    met = met.select("row", "host", F.substring(F.col("path"), F.lit(1), F.col("length")).alias("path"))
    size = F.length("rule")
    # The longest; of equally long ones the longer host, of one rule given twice the one that allows.
    best = F.max_by(F.struct("rule", "verdict"), F.struct(size, F.length("host"), F.col("verdict") == ALLOW))
    found = _joined(met, held, ["host", "path"]).groupBy("row").agg(best.alias("best"))
    return found.select("row", "best.rule", "best.verdict")


def judge_pages(
    pages: DataFrame,
    rules: DataFrame,
    redirects: DataFrame | None = None,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """Whether each page may be taken: by its own rule, else by what is known of its aliases.

    Card transactions have no web addresses, so this operator is general. ``rules`` has ``host, path, verdict``
    (``allow`` or ``block``). A rule fits its host and all subdomains where the path starts with the rule's; the longest
    rule (host and path together) wins, of one rule given twice the one that allows.

    Addresses are aliases when canonical links or refresh redirects in the ``html``, or rows of ``redirects``
    (``from_url, to_url``), lead from one to the other, however far: connected components, found by joins over tables. Targets need not be pages. Aliases of an address that a rule blocks are
    blocked, unless a rule allows one of them; a page's own rule always comes first, and without any word a page is allowed.

    Returns ``page_id, host, path, rule, verdict, decided_by``; ``rule`` is host and path, NULL without one, and ``decided_by`` is
    ``rule``, ``alias`` or ``default``. NULL addresses and ones without ``://`` have an empty host and path, no rule and no
    alias. Every row is judged, repeated ones and NULL ids too; NULL html has no links; a link that names nothing is none; an
    empty table gives an empty result; extra columns do not matter.
    """
    source = columns(pages, id=page_id, url=url, html=html)
    seen = written(
        source.select(
            F.monotonically_increasing_id().alias("row"),
            "id",
            "url",
            host_of(F.col("url")).alias("host"),
            path_of(F.col("url")).alias("path"),
            node_of(F.col("url")).alias("node"),
            linked_urls(F.col("html")).alias("targets"),
        ),
        "url_pages",
    )
    held = written(
        rules.filter("host is not null and path is not null and host != ''").select(
            F.translate("host", string.ascii_uppercase, string.ascii_lowercase).alias("host"), "path", "verdict"
        ).withColumn("rule", F.concat("host", "path")),
        "url_rules",
    )
    own = fitting_rules(seen.select("row", "host", "path"), held)
    judged = written(
        seen.join(own, "row", "left").select("row", "id", "host", "path", "node", "rule", "verdict"), "url_judged"
    )

    told = seen.filter(F.size("targets") > 0).select("url", F.explode("targets").alias("target"))
    edges = told.select(F.col("url").alias("from_url"), resolved(F.col("target"), F.col("url")).alias("to_url"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select("from_url", "to_url"))
    a, b = node_of(F.col("from_url")), node_of(F.col("to_url"))
    edges = written(
        edges.select("from_url", "to_url", a.alias("a"), b.alias("b")).filter("a is not null and b is not null and a != b"),
        "url_edges",
    )
    blocked = blocked_nodes(edges, held)
    open_pages = judged.filter("verdict is null and node is not null").select("row", "node")
    caught = _joined(open_pages, written(blocked, "url_blocked"), ["node"]).select("row", F.lit(True).alias("caught"))
    by_rule = judged.filter("verdict is not null").withColumn("decided_by", F.lit("rule"))
    rest = judged.filter("verdict is null").join(caught, "row", "left").select(
        "id",
        "host",
        "path",
        "rule",
        F.when(F.col("caught"), F.lit(BLOCK)).otherwise(ALLOW).alias("verdict"),
        F.when(F.col("caught"), F.lit("alias")).otherwise("default").alias("decided_by"),
    )
    return by_rule.select(*rest.columns).unionByName(rest).withColumnRenamed("id", page_id)


def blocked_nodes(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """``node`` of all addresses in components where a rule blocks one and none allows one."""
    ends = [F.struct(F.col(n).alias("row"), F.col(u).alias("url")) for n, u in (("a", "from_url"), ("b", "to_url"))]
    nodes = written(
        edges.select(F.inline(F.array(*ends)))
        .groupBy("row")
        .agg(F.min("url").alias("url"))
        .select("row", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")),
        "url_nodes",
    )
    decided = fitting_rules(nodes, rules).select(F.col("row").alias("node"), "verdict")
    members = components(edges.select("a", "b").distinct(), "url_components")
    states = (
        members.join(decided, "node", "left")
        .groupBy("component")
        .agg(F.max(F.col("verdict") == BLOCK).alias("blocks"), F.max(F.col("verdict") == ALLOW).alias("allows"))
        .filter("blocks and not coalesce(allows, false)")
        .select("component")
    )
    return _joined(members, written(states, "url_states"), ["component"]).select("node")
