"""SQL that must give the rows of registered queries."""

from __future__ import annotations

# Levels of the tree of leaves and of the tree of subroots that the SQL is unrolled for: 2**24 leaves a language.
LEAF_LEVELS = 24
ROOT_LEVELS = 6


def _field(name: str) -> str:
    text = f"CAST({name} AS VARCHAR)"
    return f"coalesce(octet_length(encode({text})) || ':' || {text}, '-')"


def _leaf(n_chars: str) -> str:
    fields = [_field(f) for f in ("doc_id", "source", "lang")] + [_field(n_chars), _field("text")]
    return f"sha256({' || '.join(fields)})"


def _climb(start: str, levels: int) -> list[str]:
    """CTEs ``{start}0`` (tree, place, h, n) up to ``{start}{levels}``: each level's nodes."""
    made = []
    for k in range(levels):
        made.append(
            f"{start}{k + 1} AS MATERIALIZED (SELECT tree, CASE WHEN n > 1 THEN place // 2 ELSE place END AS place, "
            f"CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY place)) ELSE min(h) END AS h, "
            f"CASE WHEN max(n) > 1 THEN (max(n) + 1) // 2 ELSE 1 END AS n "
            f"FROM {start}{k} GROUP BY tree, CASE WHEN n > 1 THEN place // 2 ELSE place END)"
        )
    return made


def _fold(start: str, nodes: str, levels: int) -> list[str]:
    """CTEs ``{start}0`` (doc_id, tree, place, told, folded) up to ``{start}{levels}``: folds past each level."""
    made = []
    for k in range(levels):
        made.append(
            f"{start}{k + 1} AS MATERIALIZED (SELECT f.doc_id, f.tree, "
            f"CASE WHEN s.n > 1 THEN f.place // 2 ELSE f.place END AS place, "
            f"f.told || coalesce(o.h, '') AS told, "
            f"CASE WHEN s.n = 1 THEN f.folded WHEN o.h IS NULL THEN sha256(f.folded) "
            f"WHEN f.place % 2 = 0 THEN sha256(f.folded || o.h) ELSE sha256(o.h || f.folded) END AS folded "
            f"FROM {start}{k} f JOIN {nodes}{k} s ON s.tree = f.tree AND s.place = f.place "
            f"LEFT JOIN {nodes}{k} o ON s.n > 1 AND o.tree = f.tree AND o.place = xor(f.place, 1))"
        )
    return made


def merkle_manifest() -> str:
    tampered = "CASE WHEN crc32_of % 7 = 0 THEN n_chars + 1 ELSE n_chars END"
    parts = [
        "doc AS (SELECT *, " + _crc32("doc_id") + " AS crc32_of FROM documents)",
        f"leaf AS MATERIALIZED (SELECT doc_id, coalesce('=' || lang, '-') AS tree, lang, {_leaf('n_chars')} AS h, "
        f"{_leaf(tampered)} AS claimed FROM doc)",
        "a0 AS MATERIALIZED (SELECT tree, lang, doc_id, h, claimed, "
        "row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS place, "
        "count(*) OVER (PARTITION BY tree) AS n FROM leaf)",
        *_climb("a", LEAF_LEVELS),
        f"b0 AS MATERIALIZED (SELECT '' AS tree, t.tree AS of, t.h, "
        f"row_number() OVER (ORDER BY l.lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n "
        f"FROM a{LEAF_LEVELS} t JOIN (SELECT DISTINCT tree, lang FROM leaf) l ON l.tree = t.tree)",
        *_climb("b", ROOT_LEVELS),
        "f0 AS MATERIALIZED (SELECT doc_id, tree, place, '' AS told, claimed AS folded FROM a0)",
        *_fold("f", "a", LEAF_LEVELS),
        f"g0 AS MATERIALIZED (SELECT f.doc_id, b.tree, b.place, f.told, f.folded "
        f"FROM f{LEAF_LEVELS} f JOIN b0 b ON b.of = f.tree)",
        *_fold("g", "b", ROOT_LEVELS),
    ]
    return (
        f"WITH {', '.join(parts)} SELECT a.doc_id, a.h AS leaf, s.h AS subroot, r.h AS root, "
        f"sha256(g.told) AS proof_sha256, g.folded AS folded_root, g.folded = r.h AS verified "
        f"FROM a0 a JOIN a{LEAF_LEVELS} s ON s.tree = a.tree CROSS JOIN b{ROOT_LEVELS} r "
        f"JOIN g{ROOT_LEVELS} g ON g.doc_id = a.doc_id"
    )


def _crc32(name: str) -> str:
    """Unsigned CRC-32 of a number's decimal text, bit by bit."""
    text = f"CAST({name} AS VARCHAR)"
    codes = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    bits = "list_prepend(xor(s, c), range(8))"
    step = f"list_reduce({bits}, lambda v, b: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)"
    return (
        f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda s, c: {step}), 4294967295)"
    )


HARD_NEGATIVES = """
WITH grid AS MATERIALIZED (
SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
       list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS g
FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
met AS MATERIALIZED (
SELECT a.vec_id AS anchor_id, a.label = b.label AS alike, b.vec_id,
       CAST(list_inner_product(a.g, b.g) AS BIGINT) AS score
FROM grid a JOIN grid b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positive AS (
SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM met WHERE alike
QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
placed AS (
SELECT p.anchor_id, p.positive_id, p.positive_score, m.vec_id AS negative_id, m.score AS negative_score,
       row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY m.score DESC, m.vec_id) AS rank
FROM positive p JOIN met m ON m.anchor_id = p.anchor_id AND NOT m.alike
     AND 30 * p.positive_score <= 100 * m.score AND 100 * m.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score
FROM placed WHERE rank <= 10"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _host(url: str) -> str:
    found = f"coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), '')"
    return f"translate({found}, '{_UPPER}', '{_LOWER}')"


def _path(url: str) -> str:
    return f"coalesce(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"


def _node(url: str) -> str:
    query = f"regexp_extract({url}, '(?s)^[^?#]*(\\?[^#]*)', 1)"
    return f"CASE WHEN {_host(url)} <> '' THEN {_host(url)} || {_path(url)} || {query} END"


def _own_rule(name: str, source: str) -> str:
    """``key, rule, verdict``: the longest rule for rows ``key, host, path``."""
    return (
        f"{name} AS MATERIALIZED (SELECT key, arg_max(struct_pack(rule, verdict), "
        f"10000 * length(rule) + 10 * length(r.host) + CAST(verdict = 'allow' AS INT)) AS best "
        f"FROM {source} s JOIN held r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) "
        f"AND starts_with(s.path, r.path) WHERE s.host <> '' GROUP BY key)"
    )


def judge_pages(rules: list[tuple[str, str, str]]) -> str:
    held = ", ".join(f"('{h}', '{p}', '{v}', '{h}{p}')" for h, p, v in rules)
    scheme = r"regexp_extract(url, '(?s)^([A-Za-z][A-Za-z0-9+.-]*)://', 1)"
    site = f"{scheme} || '://' || host"
    links = (
        "list_transform(list_filter(regexp_extract_all(html, '(?is)<link\\b[^>]*>'), lambda t: "
        "regexp_matches(t, '(?is)\\brel\\s*=\\s*[\"'']?[^\"''>]*\\bcanonical\\b')), lambda t: "
        "regexp_extract(t, '(?is)\\bhref\\s*=\\s*[\"'']?([^\"''\\s>]+)', 1))"
    )
    metas = (
        "list_transform(list_filter(regexp_extract_all(html, '(?is)<meta\\b[^>]*>'), lambda t: "
        "regexp_matches(t, '(?is)\\bhttp-equiv\\s*=\\s*[\"'']?refresh\\b')), lambda t: "
        "regexp_extract(t, '(?is)\\bcontent\\s*=\\s*[\"'']?[\\d.\\s]*;\\s*url\\s*=\\s*[\"'']?([^\"''\\s>]+)', 1))"
    )
    folder = "regexp_replace(path, '[^/]*$', '')"
    parts = [
        f"held(host, path, verdict, rule) AS (VALUES {held})",
        f"page AS MATERIALIZED (SELECT row_number() OVER () AS key, page_id, url, html, {_host('url')} AS host, "
        f"{_path('url')} AS path, {_node('url')} AS node FROM pages)",
        _own_rule("own", "page"),
        f"told AS (SELECT url, host, path, node, replace(unnest(list_concat({links}, {metas})), '&amp;', '&') AS target "
        "FROM page WHERE regexp_matches(html, '(?i)\\bcanonical\\b|\\brefresh\\b'))",
        f"led AS (SELECT url AS from_url, node AS a, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target "
        f"WHEN starts_with(target, '//') THEN {scheme} || ':' || target WHEN starts_with(target, '/') THEN {site} || target "
        f"WHEN starts_with(target, '?') THEN {site} || path || target WHEN starts_with(target, '#') THEN url "
        f"ELSE {site} || CASE WHEN {folder} = '' THEN '/' ELSE {folder} END || target END AS to_url FROM told WHERE target <> '')",
        f"link AS MATERIALIZED (SELECT * FROM (SELECT from_url, to_url, a, {_node('to_url')} AS b FROM led) "
        "WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b)",
        "ends AS (SELECT a AS key, from_url AS url FROM link UNION SELECT b, to_url FROM link)",
        f"known AS (SELECT DISTINCT key, {_host('url')} AS host, {_path('url')} AS path FROM ends)",
        _own_rule("decided", "known"),
        "both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link)",
        "reach(a, b) AS (SELECT DISTINCT a, a FROM both_ways UNION "
        "SELECT r.a, w.b FROM reach r JOIN both_ways w ON w.a = r.b)",
        "caught AS (SELECT r.a AS node FROM reach r LEFT JOIN decided d ON d.key = r.b GROUP BY r.a "
        "HAVING count_if(d.best.verdict = 'block') > 0 AND count_if(d.best.verdict = 'allow') = 0)",
    ]
    return (
        f"WITH RECURSIVE {', '.join(parts)} SELECT page_id, host, path, o.best.rule AS rule, "
        "CASE WHEN o.best.rule IS NOT NULL THEN o.best.verdict WHEN c.node IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, "
        "CASE WHEN o.best.rule IS NOT NULL THEN 'rule' WHEN c.node IS NOT NULL THEN 'alias' ELSE 'default' END AS decided_by "
        "FROM page p LEFT JOIN own o ON o.key = p.key LEFT JOIN caught c ON c.node = p.node"
    )


SOURCE_MIX = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS draw
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS most,
         CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight
  FROM d GROUP BY source),
filled AS (
  SELECT *, most / weight AS fills_at,
         row_number() OVER soonest AS place,
         ((sum(source_size) OVER ())::BIGINT
           - coalesce(sum(most) OVER (soonest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
         / sum(weight) OVER (soonest ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s WINDOW soonest AS (ORDER BY most / weight, coalesce(source, ''), source IS NULL)),
targets AS (
  SELECT source, source_size,
         least(CAST(most AS DOUBLE),
               coalesce((SELECT arg_min(level, place) FROM filled WHERE fills_at > level) * weight,
                        CAST(most AS DOUBLE))) AS target
  FROM filled),
budgets AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) // greatest(source_size, 1) AS epochs,
         CAST(floor(target + 0.5) AS BIGINT) % greatest(source_size, 1) AS rest
  FROM targets),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id NULLS FIRST, size
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken
FROM placed JOIN budgets ON placed.source IS NOT DISTINCT FROM budgets.source
"""
