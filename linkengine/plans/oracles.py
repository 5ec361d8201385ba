"""SQL for DuckDB that the registered queries must equal.  Written apart from the plans: no code is shared with them."""

from __future__ import annotations

_DOMAIN = r"^(?:https?://)?(?:www\.)?([\p{L}\p{N}][\p{L}\p{N}_-]*?)(?:\.[a-z]{2,6}){1,2}/?$"

RAW = r"""
raw AS (SELECT 'S' || (1 + page_id % 3) || '-' || page_id AS entity_id, 'S' || (1 + page_id % 3) AS source,
  regexp_extract(html, '<html lang="([a-z]*)"', 1) AS country, regexp_extract(html, '<title>([^<]*)</title>', 1) AS raw_name,
  replace(replace(url, '://', ', '), '/', ', ') AS raw_addr, regexp_extract(url, '/([a-z]{2}/[0-9]+)', 1) AS article FROM pages)
"""
TRUTH = """
truth AS (SELECT a.entity_id AS s1_id, b.entity_id AS cand_id FROM raw a JOIN raw b ON a.article = b.article
  WHERE a.source = 'S1' AND b.source <> 'S1' AND a.article <> ''),
ids AS (SELECT entity_id AS s1_id, country FROM raw WHERE source = 'S1')
"""

_LATIN, _CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстувщхыз"
#: Each page beside a changed copy of itself.
VARIED = RAW.replace("raw AS (", "raw0 AS (").rstrip() + f""",
raw1 AS (SELECT *, CAST(split_part(entity_id, '-', 2) AS BIGINT) AS num FROM raw0),
raw AS (SELECT entity_id, source, country, raw_name, raw_addr, article FROM raw0 UNION ALL
  SELECT 'V' || entity_id, 'V', country, CASE num % 5 WHEN 0 THEN substr(raw_name, 1, 1) || substr(raw_name, 3, 1) || substr(raw_name, 2, 1) || substr(raw_name, 4)
    WHEN 1 THEN array_to_string(list_reverse(string_split(raw_name, ' ')), ' ') WHEN 2 THEN array_to_string(string_split(raw_name, ' ')[2:], ' ')
    WHEN 3 THEN replace(raw_name, 'a', 'e') ELSE translate(lower(raw_name), '{_LATIN}', '{_CYRILLIC}') END,
    CASE WHEN num % 2 = 0 THEN replace(raw_addr, '1', '2') ELSE raw_addr END, article FROM raw1)
"""
VARIED_TRUTH = """
truth AS (SELECT entity_id AS s1_id, 'V' || entity_id AS cand_id FROM raw1 WHERE num % 5 <> 4),
native AS (SELECT entity_id AS s1_id, 'V' || entity_id AS cand_id FROM raw1 WHERE num % 5 = 4),
ids AS (SELECT entity_id AS s1_id, country FROM raw0)
"""


def varied(sql: str) -> str:
    """A query of the pages over the pages and their changed copies."""
    return sql.replace(RAW, VARIED).replace(TRUTH, VARIED_TRUTH)


def _tok(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda t : t <> '')"


def _fold(x: str) -> str:
    word = "t"
    for a, b in (("ph", "f"), ("sh", "s"), ("th", "t"), ("kh", "k"), ("gh", "g"), ("ck", "k"), ("qu", "k"), ("w", "v"), ("z", "s"), ("ee", "i"), ("oo", "u")):
        word = f"replace({word}, '{a}', '{b}')"
    for c in "aiubcdfghjklmnpqrstvwxz":
        word = f"regexp_replace({word}, '{c}{c}+', '{c}', 'g')"
    return f"array_to_string(list_transform({_tok(x)}, lambda t : CASE WHEN regexp_matches(t, '[0-9]') THEN t ELSE {word} END), ' ')"


NORM = rf"""
{RAW},
part AS (SELECT entity_id, 'n' AS kind, 0 AS seg, raw_name AS t FROM raw
  UNION ALL SELECT entity_id, 'a', i, s FROM (SELECT entity_id, unnest(range(1, len(string_split(raw_addr, ',')) + 1)) AS i, unnest(string_split(raw_addr, ',')) AS s FROM raw)),
p1 AS (SELECT entity_id, kind, seg, strip_accents(replace(replace(replace(replace(lower(t), 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae'), '’', '''')) AS t FROM part),
p2 AS (SELECT entity_id, kind, seg, regexp_replace(replace(t, '&', ' & '), '(?:https?://)?www\.', '', 'g') AS t FROM p1),
p3 AS (SELECT entity_id, kind, seg, array_to_string(list_transform({_tok("t")}, lambda w : regexp_replace(w, '{_DOMAIN}', '\1')), ' ') AS t FROM p2),
p4 AS (SELECT entity_id, kind, seg, string_split(regexp_replace(t, '(^|\P{{L}})((?:\p{{L}}\.){{2,}})', '\1|~|\2|~|', 'g'), '|~|') AS ps FROM p3),
p5 AS (SELECT entity_id, kind, seg, replace(array_to_string(list_transform(ps, lambda x, i : CASE WHEN i % 2 = 0 THEN replace(x, '.', '') || ' ' ELSE x END), ''), '''', '') AS t FROM p4),
p6 AS (SELECT entity_id, kind, seg, regexp_replace(regexp_replace(t, '(\d+)\s*[- ]?\s*(bis|ter|quater)(\P{{L}}|$)', '\1\2\3', 'g'), '[^\p{{L}}\p{{N}}&]', ' ', 'g') AS t FROM p5),
p7 AS (SELECT entity_id, kind, seg, array_to_string(list_transform(list_filter({_tok("t")}, lambda w : w NOT IN ('null', 'nan')), lambda w : CASE WHEN w IN ('and', 'et', 'und', '&') THEN '&' ELSE w END), ' ') AS t FROM p6),
p8 AS (SELECT entity_id, coalesce(max(t) FILTER (kind = 'n'), '') AS norm_name, coalesce(list(t ORDER BY seg) FILTER (kind = 'a' AND t <> ''), []) AS segs FROM p7 GROUP BY entity_id),
p9 AS (SELECT *, array_to_string(segs, ' ') AS norm_addr FROM p8),
p10 AS (SELECT *, list_filter({_tok("norm_addr")}, lambda w : regexp_matches(w, '\d')) AS nums, list_filter({_tok("norm_name")}, lambda w : regexp_matches(w, '\d')) AS nn FROM p9),
norm AS (SELECT raw.entity_id, source, country, raw_name, raw_addr, norm_name, norm_addr, {_fold("norm_name")} AS fold_name, {_fold("norm_addr")} AS fold_addr,
  array_to_string(nn, ' ') AS name_numbers, array_to_string(nums, ' ') AS addr_numbers, coalesce(nums[1], '') AS house_number,
  CASE WHEN len(segs) < 2 THEN '' ELSE array_to_string(list_filter(list_concat({_tok("segs[-2]")}, {_tok("segs[-1]")}),
    lambda w : w <> coalesce(nums[1], '') AND regexp_matches(w, '^(\d{{4,6}}|[a-z]{{1,2}}\d[a-z0-9]{{0,2}})$')), ' ') END AS postcodes
  FROM p10 JOIN raw USING (entity_id))
"""

NORMALISE = f"WITH {NORM} SELECT entity_id, source, country, norm_name, norm_addr, fold_name, fold_addr, name_numbers, addr_numbers, house_number, postcodes FROM norm"


def _deleet(t: str) -> str:
    d = f"length(regexp_replace({t}, '[^0-9]', '', 'g'))"
    return f"CASE WHEN {d} = 0 OR {d} * 2 >= length({t}) OR regexp_matches({t}, '^\\d+[a-z]{{0,4}}$') THEN {t} ELSE translate({t}, '0134578', 'oleastb') END"


def _plain(x: str) -> str:
    return f"list_transform({_tok(x)}, lambda t : {_deleet('t')})"


def _words(x: str) -> str:
    return f"list_filter({_plain(x)}, lambda u : NOT regexp_matches(u, '^\\d+$') AND u <> '&')"


def _grams(x: str) -> str:
    of = "list_concat(CASE WHEN length(w) >= 3 THEN list_transform(range(1, length(w) - 1), lambda i : substr(w, i, 3)) ELSE [w] END, list_transform(range(1, length(w) - 2), lambda i : substr(w, i, 4)))"
    return f"flatten(list_transform(list_transform({_tok(x)}, lambda t : ' ' || t || ' '), lambda w : {of}))"


def _first(x: str, most: int) -> str:
    return f"list_sort(list_distinct({x}))[1:{most}]"


def _pairs(x: str, most: int) -> str:
    few = _first(f"{_plain(x)}[1:{2 * most}]", most)
    return f"flatten(list_transform({few}, lambda a : list_transform(list_filter({few}, lambda b : b > a), lambda b : a || '|' || b)))"


KEYS = {
    "name_char": (_grams("norm_name"), 20, 2000),
    "addr_char": (_grams("norm_addr"), 15, 2000),
    "name_tok": (f"list_concat({_words('norm_name')}, list_transform(list_filter({_words('fold_name')}, lambda f : NOT list_contains({_words('norm_name')}, f)), lambda f : '~' || f))", 20, 200),
    "num_key": (
        f"CASE WHEN house_number = '' OR len(list_filter({_tok('norm_addr')}[list_position({_tok('norm_addr')}, house_number) + 1:], lambda w : NOT regexp_matches(w, '\\d'))) = 0 THEN []"
        f" ELSE [house_number || '_' || list_filter({_tok('norm_addr')}[list_position({_tok('norm_addr')}, house_number) + 1:], lambda w : NOT regexp_matches(w, '\\d'))[1]] END",
        20,
        200,
    ),
    "name_pair": (_pairs("fold_name", 8), 30, 2000),
    "addr_pair": (_pairs("fold_addr", 10), 30, 2000),
    "cross_pair": (f"flatten(list_transform({_first(_words('fold_name'), 6)}, lambda a : list_transform({_first(_plain('fold_addr'), 10)}, lambda b : a || '^' || b)))", 30, 2000),
}


def _topk_ctes(name: str, tag: str, reverse: bool = False, k: int | None = None) -> str:
    keys, own_k, max_df = KEYS[name]
    k = k or own_k
    ask, answer = ("<> 'S1'", "= 'S1'") if reverse else ("= 'S1'", "<> 'S1'")
    return f"""
{tag}k AS (SELECT entity_id AS id, source, country AS grp, {keys} AS ks FROM norm),
{tag}post AS (SELECT source, id, grp, feat, count(*) AS c FROM (SELECT source, id, grp, unnest(ks) AS feat FROM {tag}k) GROUP BY ALL),
{tag}n AS (SELECT grp, count(*) AS n FROM {tag}k GROUP BY 1), {tag}d AS (SELECT grp, feat, count(*) AS df FROM {tag}post GROUP BY 1, 2),
{tag}w AS (SELECT p.*, df, (1 + ln(c)) * (ln((n + 1) / (df + 1)) + 1) AS w FROM {tag}post p JOIN {tag}n USING (grp) JOIN {tag}d USING (grp, feat)),
{tag}u AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS u FROM {tag}w),
{tag}s AS (SELECT q.id AS a, p.id AS b, round(sum(q.u * p.u), 6) AS score FROM {tag}u q JOIN {tag}u p ON q.grp = p.grp AND q.feat = p.feat
  WHERE q.source {ask} AND p.source {answer} AND p.df <= {max_df} GROUP BY 1, 2),
{tag} AS (SELECT '{tag}' AS channel, {"b AS s1_id, a AS cand_id" if reverse else "a AS s1_id, b AS cand_id"}, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) - 1 AS rank FROM {tag}s QUALIFY rank < {k})"""


def topk(name: str) -> str:
    return f"WITH {NORM}, {_topk_ctes(name, name)} SELECT s1_id, cand_id, score, rank FROM {name}"


REVERSE = f"WITH {NORM}, {_topk_ctes('name_char', 'reverse', True, 3)} SELECT s1_id, cand_id, score, rank FROM reverse"

BIT = {"reverse": 2, "name_char": 4, "addr_char": 8, "name_tok": 16, "num_key": 32, "name_pair": 64, "addr_pair": 128, "cross_pair": 256}
_SOME = [*KEYS, "reverse"]
_HITS = ",".join(_topk_ctes("name_char", c, True, 3) if c == "reverse" else _topk_ctes(c, c) for c in _SOME)
_UNION = f"""
WITH {NORM}, {_HITS},
hit AS ({" UNION ALL ".join(f"SELECT * FROM {c}" for c in _SOME)}),
un AS (SELECT s1_id, cand_id, {", ".join(f"max(score) FILTER (channel = '{c}') AS {c}_score, coalesce(min(rank) FILTER (channel = '{c}'), 999) AS {c}_rank" for c in _SOME)},
  bit_or(CASE channel {" ".join(f"WHEN '{c}' THEN {BIT[c]}" for c in _SOME)} END) AS bitmask, count(DISTINCT channel) AS n_channels FROM hit GROUP BY 1, 2)
"""
UNION = f"{_UNION} SELECT * FROM un"
GAPS = f"{_UNION} SELECT s1_id, cand_id, round(name_tok_score - max(coalesce(name_tok_score, -1)) OVER w, 6) AS name_tok_score_gap, round(name_pair_score - max(coalesce(name_pair_score, -1)) OVER w, 6) AS name_pair_score_gap, count(*) OVER w AS union_size FROM un WINDOW w AS (PARTITION BY s1_id)"
PRUNE = f"{_UNION} SELECT s1_id, cand_id, n_channels, row_number() OVER (PARTITION BY s1_id ORDER BY n_channels DESC, cand_id) - 1 AS cheap_rank FROM un QUALIFY cheap_rank < 10"
CHANNELS = f"{_UNION}, {TRUTH} SELECT channel, CAST(sum(CASE WHEN bitmask & bit > 0 THEN 1 ELSE 0 END) AS BIGINT) AS found, CAST(sum(CASE WHEN bitmask = bit THEN 1 ELSE 0 END) AS BIGINT) AS \"unique\" FROM un SEMI JOIN truth USING (s1_id, cand_id), (VALUES {', '.join(f"('{c}', {BIT[c]})" for c in _SOME)}) b(channel, bit) GROUP BY 1"
REPORT = f"""{_UNION}, {TRUTH},
pr AS (SELECT s1_id, cand_id FROM un QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY n_channels DESC, cand_id) <= 10),
e AS (SELECT i.s1_id, i.country, (SELECT count(*) FROM truth t WHERE t.s1_id = i.s1_id) AS n_true, (SELECT count(*) FROM pr WHERE pr.s1_id = i.s1_id) AS n_cands,
  (SELECT count(*) FROM un SEMI JOIN truth USING (s1_id, cand_id) WHERE un.s1_id = i.s1_id) AS fu, (SELECT count(*) FROM pr SEMI JOIN truth USING (s1_id, cand_id) WHERE pr.s1_id = i.s1_id) AS f FROM ids i),
np AS (SELECT count(*) AS np FROM raw WHERE source <> 'S1')
SELECT coalesce(country, 'ALL') AS country, count(*) AS n_s1, CAST(sum(n_true) AS BIGINT) AS n_true_pairs, round(sum(fu) / greatest(sum(n_true), 1), 5) AS pair_recall_union, round(sum(f) / greatest(sum(n_true), 1), 5) AS pair_recall,
  round(coalesce(avg(CASE WHEN n_true > 0 THEN CASE WHEN f = n_true THEN 1.0 ELSE 0.0 END END), 1.0), 5) AS entity_complete_recall, round(1 - sum(n_cands) / (count(*) * any_value(np)), 8) AS reduction_ratio,
  round(avg(n_cands), 2) AS cands_per_s1_mean, round(quantile_cont(n_cands, 0.95), 4) AS cands_per_s1_p95
FROM e, np GROUP BY GROUPING SETS ((), (country))"""

MISS = f"""{_UNION}, {TRUTH}, pr AS (SELECT s1_id, cand_id FROM un QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY n_channels DESC, cand_id) <= 10)
SELECT round(avg(CASE WHEN s1_id IN (SELECT s1_id FROM truth ANTI JOIN pr USING (s1_id, cand_id)) THEN 1.0 ELSE 0.0 END), 6) AS q FROM ids"""

# --- statistics --------------------------------------------------------------------------------------------------------------

_STATS = f"""{NORM},
tk AS (SELECT entity_id, country, 'norm_name' AS field, unnest(ts) AS token, unnest(range(len(ts))) AS pos, len(ts) AS n, NULL AS house FROM (SELECT *, {_tok("norm_name")} AS ts FROM norm)
  UNION ALL SELECT entity_id, country, 'norm_addr', unnest(ts), unnest(range(len(ts))), len(ts), h FROM (SELECT *, list_position(list_transform(ts, lambda t : regexp_matches(t, '\\d')), true) - 1 AS h FROM (SELECT *, {_tok("norm_addr")} AS ts FROM norm))),
cn AS (SELECT field, country, token, count(DISTINCT entity_id) AS df, CAST(sum(CASE WHEN field = 'norm_name' THEN CASE WHEN pos >= n - 2 THEN 1 ELSE 0 END
  WHEN pos - house BETWEEN 1 AND 3 AND NOT regexp_matches(token, '\\d') THEN 1 ELSE 0 END) AS BIGINT) AS pos_count FROM tk GROUP BY 1, 2, 3),
st AS (SELECT c.*, (SELECT count(*) FROM norm n WHERE n.country = c.country) AS n_docs FROM cn c
  UNION ALL SELECT field, '', token, CAST(sum(df) AS BIGINT), CAST(sum(pos_count) AS BIGINT), (SELECT count(*) FROM norm) FROM cn GROUP BY field, token)
"""
TOKEN_STATS = f"WITH {_STATS} SELECT field, country, token, df, pos_count, n_docs FROM st"
IDF = f"WITH {_STATS} SELECT country, token, round(ln((n_docs + 1) / (df + 1)) + 1, 6) AS idf FROM st WHERE field = 'norm_name' AND country <> ''"
LIKENESS = f"WITH {_STATS}, l AS (SELECT token, least(pos_count / greatest(df, 1), 1.0) AS r, ln(df / n_docs) AS lf FROM st WHERE field = 'norm_name' AND country = '') SELECT token, round(r / (1 + exp(-(lf - (SELECT avg(lf) FROM l)) / (SELECT stddev_samp(lf) FROM l))), 6) AS score FROM l"
GENERIC = f"WITH {_STATS} SELECT field, token FROM st WHERE country = '' AND df >= 20 AND pos_count / df >= CASE field WHEN 'norm_name' THEN 0.7 ELSE 0.5 END"
TOP_TOKENS = f"WITH {_STATS} SELECT token, df FROM st WHERE field = 'norm_name' AND country = '' ORDER BY df DESC, token LIMIT 50"
QUALITY = f"""WITH {NORM} SELECT country, count(*) AS n, round(avg(CASE WHEN norm_name = '' THEN 1.0 ELSE 0 END), 6) AS name_empty, round(avg(CASE WHEN norm_addr = '' THEN 1.0 ELSE 0 END), 6) AS addr_empty,
 round(avg(CASE WHEN house_number <> '' THEN 1.0 ELSE 0 END), 6) AS has_house, round(avg(CASE WHEN postcodes <> '' THEN 1.0 ELSE 0 END), 6) AS has_postcode, round(avg(len({_tok("norm_name")})), 6) AS name_tokens, round(avg(len({_tok("norm_addr")})), 6) AS addr_tokens FROM norm GROUP BY 1"""

# --- profile -----------------------------------------------------------------------------------------------------------------

_M = f"WITH {RAW}, {TRUTH}, mc AS (SELECT i.s1_id, count(t.cand_id) AS n FROM ids i LEFT JOIN truth t USING (s1_id) GROUP BY 1)"
_TP = f"WITH {RAW}, {TRUTH}, tp AS (SELECT t.*, a.country AS c1, b.country AS c2, lower(a.raw_name) AS an, lower(b.raw_name) AS bn, lower(a.raw_addr) AS aa, lower(b.raw_addr) AS ba FROM truth t JOIN raw a ON a.entity_id = s1_id JOIN raw b ON b.entity_id = cand_id)"
PROFILE = {
    "sizes": f"WITH {RAW} SELECT source, country, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 6) AS share FROM raw GROUP BY 1, 2",
    "singleton_rate": f"{_M} SELECT count(*) AS n, round(avg(CASE WHEN n = 0 THEN 1.0 ELSE 0 END), 6) AS singleton_rate FROM mc",
    "match_percentiles": f"{_M} SELECT round(avg(n), 6) AS mean, {', '.join(f'quantile_cont(n, {c}) AS p{int(100 * c)}' for c in (0.5, 0.75, 0.9, 0.95, 0.99, 1.0))} FROM mc",
    "multi_owner": f"WITH {RAW}, {TRUTH} SELECT count(*) AS n_matched, count(*) FILTER (k > 1) AS n_multi, max(k) AS most FROM (SELECT cand_id, count(DISTINCT s1_id) AS k FROM truth GROUP BY 1)",
    "cross_group_matches": f"{_TP} SELECT c1, c2, count(*) AS n, c1 <> c2 AS cross FROM tp GROUP BY 1, 2",
    "unmatched_share": f"WITH {RAW}, {TRUTH} SELECT source, count(*) AS n, round(avg(CASE WHEN entity_id IN (SELECT cand_id FROM truth) THEN 0.0 ELSE 1 END), 6) AS unmatched FROM raw WHERE source <> 'S1' GROUP BY 1",
    "exact_rates": f"{_TP} SELECT count(*) AS n, round(avg(CASE WHEN an = bn THEN 1.0 ELSE 0 END), 6) AS same_name, round(avg(CASE WHEN aa = ba THEN 1.0 ELSE 0 END), 6) AS same_addr, round(avg(CASE WHEN an = bn AND aa = ba THEN 1.0 ELSE 0 END), 6) AS same_both FROM tp",
    "field_quality": f"WITH {RAW} SELECT source, count(*) AS n, "
    + ", ".join(
        f"round(avg(length({c})), 6) AS {c}_length, round(avg(CASE WHEN {c} = '' THEN 1.0 ELSE 0 END), 6) AS {c}_empty, round(avg(CASE WHEN regexp_matches({c}, '[0-9]') THEN 1.0 ELSE 0 END), 6) AS {c}_digits, round(avg(CASE WHEN regexp_matches({c}, '[^\\x00-\\x7F]') THEN 1.0 ELSE 0 END), 6) AS {c}_non_ascii"
        for c in ("raw_name", "raw_addr")
    )
    + " FROM raw GROUP BY 1",
    "digit_runs": f"WITH {RAW} SELECT country, coalesce(length(regexp_extract_all(raw_addr, '[0-9]+')[-1]), 0) AS run_length, count(*) AS n FROM raw GROUP BY 1, 2",
    "shortcut_corr": f"{_M} SELECT round(corr(CAST(regexp_extract(s1_id, '([0-9]+)$', 1) AS DOUBLE), n), 6) AS id_corr FROM mc",
    "truth_pairs": f"WITH {RAW}, {TRUTH} SELECT s1_id, cand_id FROM truth",
}

# --- decisions ---------------------------------------------------------------------------------------------------------------

PAIRS = """pairs AS (SELECT l_orderkey AS s1_id, l_partkey AS cand_id, max(round(l_quantity / 50 * 0.7 + l_discount * 3, 4)) AS p, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS label FROM lineitem GROUP BY 1, 2),
oids AS (SELECT o_orderkey AS s1_id, o_orderpriority AS country FROM orders)"""
_F = f"""WITH {PAIRS}, c AS (SELECT i.s1_id, any_value(i.country) AS country, count(*) FILTER (label = 1) AS t, count(*) FILTER (p >= 0.5) AS h, count(*) FILTER (label = 1 AND p >= 0.5) AS tp FROM oids i LEFT JOIN pairs USING (s1_id) GROUP BY 1),
e AS (SELECT *, CASE WHEN t = 0 AND h = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 1.25 * tp / (1.25 * tp + 0.25 * (t - tp) + (h - tp)) END AS f FROM c)"""
_SOFT = "CASE WHEN sum(p) OVER (PARTITION BY cand_id) > 0 THEN p * (p / sum(p) OVER (PARTITION BY cand_id)) ELSE 0 END"


def _sharp(p: str, lam: float) -> str:
    q = f"least(greatest({p}, 1e-6), 1 - 1e-6)"
    return f"1 / (1 + exp(-{lam} * ln({q} / (1 - {q}))))"


def _decoded(source: str) -> str:
    """All outcomes of a group's pairs are enumerated: an algorithm of its own, for groups of a few pairs."""
    return f"""
dx AS (SELECT s1_id, cand_id, p, row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, cand_id) AS r, count(*) OVER (PARTITION BY s1_id) AS n FROM {source} WHERE p >= 0.01),
dg AS (SELECT s1_id, any_value(n) AS n, list(p ORDER BY r) AS ps FROM dx GROUP BY 1),
dm AS (SELECT s1_id, n, ps, unnest(range(1 << n)) AS m FROM dg),
dw AS (SELECT s1_id, n, m, list_product(list_transform(ps, lambda p, i : CASE WHEN (m >> (i - 1)) & 1 = 1 THEN p ELSE 1 - p END)) AS w FROM dm),
dk AS (SELECT s1_id, n, m, w, unnest(range(n + 1)) AS k FROM dw),
de AS (SELECT s1_id, k, round(sum(w * CASE WHEN k = 0 THEN CASE WHEN m = 0 THEN 1.0 ELSE 0 END WHEN bit_count(m & ((1 << k) - 1)) = 0 THEN 0.0
  ELSE 1.25 * bit_count(m & ((1 << k) - 1)) / (1.25 * bit_count(m & ((1 << k) - 1)) + 0.25 * (bit_count(m) - bit_count(m & ((1 << k) - 1))) + (k - bit_count(m & ((1 << k) - 1)))) END), 12) AS e FROM dk GROUP BY 1, 2),
db AS (SELECT s1_id, k AS best FROM de QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY e DESC, k) = 1),
decoded AS (SELECT s1_id, cand_id FROM dx JOIN db USING (s1_id) WHERE r <= best)"""


_HARD = "hard AS (SELECT s1_id, cand_id, CASE WHEN p >= 0.05 AND row_number() OVER (PARTITION BY cand_id ORDER BY p DESC, s1_id) > 1 THEN 0.0 ELSE p END AS p FROM {})"
DECISIONS = {
    "macro_f05": f"{_F} SELECT round(avg(f), 9) AS macro_f05, count(*) AS n FROM e",
    "per_country_f05": f"{_F} SELECT coalesce(country, 'ALL') AS country, count(*) AS n, round(avg(f), 6) AS macro_f05, round(avg(CASE WHEN t = 0 THEN 1.0 ELSE 0 END), 6) AS floor, round(avg(f) FILTER (t = 0), 6) AS singleton_accuracy, round(avg(f) FILTER (t > 0), 6) AS non_singleton_f05 FROM e GROUP BY GROUPING SETS ((), (country))",
    "one_owner_hard": f"WITH {PAIRS}, {_HARD.format('pairs')} SELECT * FROM hard",
    "one_owner_soft": f"WITH {PAIRS} SELECT s1_id, cand_id, round({_SOFT}, 9) AS p FROM pairs",
    "sharpen": f"WITH {PAIRS} SELECT s1_id, cand_id, round({_sharp('p', 1.3)}, 9) AS p FROM pairs",
    "threshold_decode": f"WITH {PAIRS} SELECT s1_id, cand_id FROM pairs WHERE p >= 0.5",
    "expected_f_decode": f"WITH {PAIRS}, {_decoded('pairs')} SELECT * FROM decoded",
    "postprocess": f"WITH {PAIRS}, sh AS (SELECT s1_id, cand_id, {_sharp('p', 1.3)} AS p FROM pairs), {_HARD.format('sh')}, {_decoded('hard')} SELECT * FROM decoded",
    "ece": f"WITH {PAIRS}, b AS (SELECT least(floor(p * 15), 14) AS b, count(*) AS n, avg(p) AS mp, avg(label) AS my FROM pairs GROUP BY 1) SELECT round(sum(n * abs(mp - my)) / sum(n), 9) AS ece FROM b",
    "auc_logloss": f"""WITH {PAIRS}, j AS (SELECT country, p, label FROM pairs JOIN oids USING (s1_id)), r AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY country, p) - 1) / 2 AS ar FROM j WINDOW w AS (PARTITION BY country ORDER BY p))
      SELECT country, count(*) AS n, round((sum(ar) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))), 6) AS auc,
      round(-avg(CASE WHEN label = 1 THEN ln(least(greatest(p, 1e-15), 1 - 1e-15)) ELSE ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)) END), 6) AS logloss FROM r GROUP BY 1""",
    "isotonic": """WITH x AS (SELECT n_chars // 40 AS p, avg(quality) AS y, count(*) AS w FROM documents JOIN labels USING (doc_id) GROUP BY 1),
      s AS (SELECT a.p AS a, b.p AS b, sum(x.y * x.w) / sum(x.w) AS m FROM x a JOIN x b ON a.p <= b.p JOIN x ON x.p BETWEEN a.p AND b.p GROUP BY 1, 2),
      lo AS (SELECT i.p, s.a, min(s.m) AS m FROM x i JOIN s ON s.b >= i.p AND s.a <= i.p GROUP BY 1, 2) SELECT p, round(max(m), 6) AS y FROM lo GROUP BY 1""",
    "entity_context": f"""WITH {PAIRS}, q AS (SELECT *, p / greatest(sum(p) OVER (PARTITION BY s1_id), 1e-12) AS share, row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, cand_id) - 1 AS rank FROM pairs)
      SELECT s1_id, cand_id, rank, round(p - max(p) OVER w, 9) AS gap, count(*) FILTER (p > 0.5) OVER w AS n_likely, round(sum(CASE WHEN share > 0 THEN -share * ln(share) ELSE 0 END) OVER w, 9) AS entropy,
      round(max(p) OVER w - coalesce(max(p) FILTER (rank = 1) OVER w, 0), 9) AS margin, round(share, 9) AS share FROM q WINDOW w AS (PARTITION BY s1_id)""",
    "competition": f"WITH {PAIRS} SELECT s1_id, cand_id, count(*) FILTER (p > 0.05) OVER w AS n_claimants, round(p - coalesce(max(p) FILTER (p > 0.05) OVER w, 0), 6) AS margin_to_best FROM pairs WINDOW w AS (PARTITION BY cand_id)",
    "group_folds": f"WITH {PAIRS}, g AS (SELECT s1_id, (row_number() OVER (ORDER BY md5('42|' || s1_id), s1_id) - 1) % 5 AS fold FROM (SELECT DISTINCT s1_id FROM pairs)) SELECT s1_id, cand_id, CAST(fold AS INTEGER) AS fold FROM pairs JOIN g USING (s1_id)",
    "train_band": f"""WITH {PAIRS}, b AS (SELECT *, CASE WHEN p BETWEEN 0.05 AND 0.95 THEN 1 ELSE 0 END AS band, md5('42|' || s1_id || '|' || cand_id) AS h, s1_id || '|' || cand_id AS k FROM pairs),
      c AS (SELECT * FROM b WHERE band = 1 UNION ALL (SELECT * FROM b WHERE band = 0 QUALIFY row_number() OVER (ORDER BY h, k) <= (SELECT CAST(floor(0.1 * count(*)) AS BIGINT) FROM b WHERE band = 1))),
      n AS (SELECT least((SELECT count(*) FROM c WHERE label = 1), 6666) AS np), m AS (SELECT np, least((SELECT count(*) FROM c WHERE label = 0), np * 2, 20000 - np) AS nn FROM n)
      SELECT s1_id, cand_id, p, label, band FROM c, m QUALIFY row_number() OVER (PARTITION BY label ORDER BY h, k) <= CASE WHEN label = 1 THEN np ELSE nn END""",
    "floor_mask": f"WITH {PAIRS} SELECT s1_id, cand_id, CASE WHEN p >= 0.5 THEN p * p ELSE p END AS p FROM pairs",
    "queue_depth": f"WITH {PAIRS}, q AS (SELECT abs(p - 0.5) AS d, s1_id % 2 AS split FROM pairs WHERE p BETWEEN 0.1 AND 0.9) SELECT min(d) AS depth FROM (SELECT split, max(d) AS d FROM q GROUP BY 1)",
    "top_per": f"WITH {PAIRS} SELECT s1_id, cand_id, p FROM pairs QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, cand_id) <= 2",
    "judge_attached": f"WITH {PAIRS} SELECT s1_id, cand_id, p, CASE WHEN p BETWEEN 0.1 AND 0.9 THEN 1 - p END AS pl FROM pairs",
    "missed_pairs": f"""WITH {PAIRS} SELECT s1_id AS s1_id, o_orderstatus AS s1_name, o_orderpriority AS s1_addr, cand_id, p_name AS cand_name, p_brand AS cand_addr
      FROM pairs JOIN orders ON o_orderkey = s1_id JOIN part ON p_partkey = cand_id WHERE label = 1 AND p < 0.5 ORDER BY s1_id, cand_id LIMIT 200""",
    "error_examples": f"""WITH {PAIRS}, w AS (SELECT s1_id, cand_id, CASE WHEN label = 1 THEN 'missed' ELSE 'wrong' END AS kind, p FROM pairs WHERE (label = 1) <> (p >= 0.5)),
      e AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY md5('42|' || s1_id || '|' || cand_id), s1_id, cand_id) AS r FROM w)
      SELECT kind, s1_id, cand_id, round(p, 6) AS p, o_orderstatus AS s_raw_name, o_orderpriority AS s_raw_addr, p_name AS p_raw_name, p_brand AS p_raw_addr
      FROM e JOIN orders ON o_orderkey = s1_id JOIN part ON p_partkey = cand_id WHERE r <= 50""",
    "uncertain_band": f"WITH {PAIRS} SELECT s1_id, cand_id, p FROM pairs WHERE p BETWEEN 0.1 AND 0.9 ORDER BY abs(p - 0.5), s1_id, cand_id LIMIT 500",
    "label_join": f"WITH {PAIRS} SELECT p.s1_id, p.cand_id, CASE WHEN t.s1_id IS NULL THEN 0 ELSE 1 END AS label FROM pairs p LEFT JOIN (SELECT DISTINCT s1_id, cand_id FROM pairs WHERE label = 1) t ON p.s1_id = t.s1_id AND p.cand_id = t.cand_id",
    "id_list_sink": f"WITH {PAIRS} SELECT i.s1_id, coalesce(string_agg(DISTINCT lpad(CAST(cand_id AS VARCHAR), 9, '0'), ',' ORDER BY lpad(CAST(cand_id AS VARCHAR), 9, '0')) FILTER (p >= 0.5), '') AS ids FROM oids i LEFT JOIN pairs USING (s1_id) GROUP BY 1",
    "output_summary": f"WITH {PAIRS}, k AS (SELECT i.s1_id, country, count(DISTINCT cand_id) FILTER (p >= 0.5) AS k FROM oids i LEFT JOIN pairs USING (s1_id) GROUP BY 1, 2) SELECT country, count(*) AS n, round(avg(CASE WHEN k = 0 THEN 1.0 ELSE 0 END), 6) AS empty_rate, round(avg(k), 6) AS mean_size FROM k GROUP BY 1",
    "error_buckets": f"""WITH {PAIRS}, w AS (SELECT *, p >= 0.5 AS h, label = 1 AS t, count(*) FILTER (p >= 0.5) OVER (PARTITION BY cand_id) AS oc, min(s1_id) FILTER (p >= 0.5) OVER (PARTITION BY cand_id) AS mo, count(*) FILTER (label = 1) OVER (PARTITION BY s1_id) AS nt FROM pairs),
      b AS (SELECT *, p >= 0.2 AS known, p * 100 AS sim, cand_id % 2 AS conf FROM w WHERE h <> t),
      g AS (SELECT s1_id, count(*) FILTER (h) AS n_fp, count(*) FILTER (t) AS n_fn, count(*) FILTER (t AND NOT known) AS n_miss_blocking, any_value(nt) AS nt, bool_or(oc > 1 OR coalesce(mo <> s1_id, false)) AS multi,
        bool_or(h AND known AND sim >= 85 AND conf > 0) AS chain, bool_or(t AND known AND sim < 70) AS noise FROM b GROUP BY 1)
      SELECT s1_id, CASE WHEN nt = 0 THEN 'false_match_on_singleton' WHEN n_miss_blocking > 0 THEN 'blocking_miss' WHEN multi THEN 'multi_claim_conflict' WHEN chain THEN 'chain_branch' WHEN noise THEN 'heavy_noise' ELSE 'other' END AS bucket, n_fp, n_fn, n_miss_blocking FROM g""",
}

# --- splits, vectors, strings --------------------------------------------------------------------------------------------------

_AB = f"""WITH {RAW}, {TRUTH}, n AS (SELECT i.s1_id AS entity_id, i.country, count(t.cand_id) AS n_matches FROM ids i LEFT JOIN truth t USING (s1_id) GROUP BY 1, 2),
 b AS (SELECT *, CASE WHEN n_matches = 0 THEN '0' WHEN n_matches = 1 THEN '1' WHEN n_matches <= 3 THEN '2-3' ELSE '4+' END AS bucket FROM n),
 ab AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY country, bucket ORDER BY md5('42|' || entity_id), entity_id) <= round_even(count(*) OVER (PARTITION BY country, bucket) * 0.55, 0) THEN 'A' ELSE 'B' END AS split FROM b)"""
_DOT = "list_sum(list_transform(range(1, 65), lambda i : a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE))"
_KNN = f"WITH s AS (SELECT a.vec_id AS s1_id, b.vec_id AS cand_id, round({_DOT}, 6) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 3 = 0 AND b.vec_id % 3 <> 0)"


def _true_pairs(columns: str) -> str:
    return f"WITH {NORM}, {TRUTH} SELECT t.s1_id, t.cand_id, {columns} FROM truth t JOIN norm a ON a.entity_id = t.s1_id JOIN norm b ON b.entity_id = t.cand_id"


def _jacc(a: str, b: str) -> str:
    return f"CASE WHEN len(list_distinct(list_concat({a}, {b}))) > 0 THEN round(len(list_intersect(list_distinct({a}), list_distinct({b}))) / len(list_distinct(list_concat({a}, {b}))), 6) END"


def _c3(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN [] ELSE list_distinct(list_transform(range(1, length({x}) + 1), lambda i : substr(' ' || {x} || ' ', i, 3))) END"


def _base(t: str) -> str:
    return f"nullif(regexp_replace(regexp_extract({t}, '^(\\d+)[a-z]*$', 1), '^0+(\\d)', '\\1'), '')"


def _bases(x: str) -> str:
    return f"list_distinct(list_filter(list_transform({_tok(x)}, lambda t : {_base('t')}), lambda b : b IS NOT NULL))"


_NUM = f"""WITH {NORM}, {TRUTH},
 s AS (SELECT entity_id, house_number AS h, {_tok("postcodes")} AS pc, {_bases("name_numbers")} AS nn, {_bases("addr_numbers")} AS an, {_base("house_number")} AS hb,
  list_distinct(list_filter(list_transform(list_filter({_tok("addr_numbers")}, lambda t : t <> house_number AND NOT list_contains({_tok("postcodes")}, t)), lambda t : {_base("t")}), lambda b : b IS NOT NULL)) AS u FROM norm),
 s2 AS (SELECT *, list_distinct(list_concat(an, nn)) AS al, list_transform(list_filter(pc, lambda t : length(t) >= 4), lambda t : substr(t, 1, 3)) AS hd FROM s),
 x AS (SELECT t.s1_id, t.cand_id,
  CASE WHEN a.h = '' AND b.h = '' THEN 0 WHEN a.h = '' OR b.h = '' THEN 1 WHEN a.h = b.h THEN 2 WHEN a.hb = b.hb THEN 3 ELSE 5 END AS house_no_rel,
  CASE WHEN len(a.pc) + len(b.pc) = 0 THEN 0 WHEN len(a.pc) = 0 OR len(b.pc) = 0 THEN 1 WHEN list_has_any(a.pc, b.pc) THEN 2 WHEN list_has_any(a.hd, b.hd) THEN 4 ELSE 5 END AS postcode_rel,
  CASE WHEN len(a.u) + len(b.u) = 0 THEN 0 WHEN len(a.u) = 0 OR len(b.u) = 0 THEN 1 WHEN list_has_any(a.u, b.u) THEN 2 ELSE 5 END AS unit_rel,
  CASE WHEN len(a.nn) + len(b.nn) = 0 THEN 0 WHEN len(a.nn) = 0 OR len(b.nn) = 0 THEN 1 WHEN list_has_any(a.nn, b.nn) THEN 2 ELSE 5 END AS name_number_rel,
  CASE WHEN coalesce(list_contains(b.al, a.hb), false) OR coalesce(list_contains(a.al, b.hb), false) THEN 1 ELSE 0 END AS house_in_other,
  len(list_intersect(a.al, b.al)) AS n_shared_numbers, len(list_distinct(list_concat(a.al, b.al))) AS un, len(a.al) AS n_numbers_1, len(b.al) AS n_numbers_2
  FROM truth t JOIN s2 a ON a.entity_id = t.s1_id JOIN s2 b ON b.entity_id = t.cand_id)
SELECT s1_id, cand_id, house_no_rel::DOUBLE AS house_no_rel, postcode_rel::DOUBLE AS postcode_rel, unit_rel::DOUBLE AS unit_rel, name_number_rel::DOUBLE AS name_number_rel,
 CASE WHEN (house_no_rel = 5 AND house_in_other = 0) OR postcode_rel = 5 OR name_number_rel = 5 THEN 1.0 ELSE 0.0 END AS any_number_conflict, house_in_other::DOUBLE AS house_in_other,
 n_shared_numbers::DOUBLE AS n_shared_numbers, CASE WHEN un > 0 THEN round(n_shared_numbers / un, 6) END AS jaccard_numbers, n_numbers_1::DOUBLE AS n_numbers_1, n_numbers_2::DOUBLE AS n_numbers_2 FROM x"""

OTHERS = {
    "ab_split": f"{_AB} SELECT entity_id, country, n_matches, bucket, split FROM ab",
    "pool_split": f"{_AB} SELECT r.entity_id, coalesce(s.split, 'shared') AS split FROM raw r LEFT JOIN (SELECT cand_id, string_agg(DISTINCT split, '' ORDER BY split) AS split FROM truth JOIN ab ON ab.entity_id = s1_id GROUP BY 1) s ON s.cand_id = r.entity_id WHERE source <> 'S1'",
    "split_report": f"{_AB} SELECT split, coalesce(country, 'ALL') AS country, count(*) AS n, round(avg(CASE WHEN n_matches = 0 THEN 1.0 ELSE 0 END), 6) AS singleton_rate, round(avg(n_matches), 6) AS mean_matches FROM ab GROUP BY GROUPING SETS ((split), (split, country))",
    "hash_sample": f"WITH {RAW} SELECT entity_id, source FROM raw ORDER BY md5('42|' || entity_id), entity_id LIMIT 100",
    "dense_knn": f"{_KNN} SELECT s1_id, cand_id, score, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, cand_id) - 1 AS rank FROM s QUALIFY rank < 30",
    "dense_reverse": f"{_KNN} SELECT s1_id, cand_id, score, row_number() OVER (PARTITION BY cand_id ORDER BY score DESC, s1_id) - 1 AS rank FROM s QUALIFY rank < 5",
    "recall_mrr": f"WITH {NORM}, {TRUTH}, {_topk_ctes('name_pair', 'name_pair')}, h AS (SELECT DISTINCT t.s1_id, t.cand_id, c.rank FROM truth t LEFT JOIN name_pair c USING (s1_id, cand_id)) SELECT count(*) AS n_pairs, "
    + ", ".join(f"round(avg(CASE WHEN rank < {k} THEN 1.0 ELSE 0 END), 9) AS recall_{k}" for k in (1, 3, 10, 30))
    + ", round(avg(coalesce(1 / (rank + 1), 0)), 9) AS mrr FROM h",
    "jaccards": _true_pairs(f"{_jacc(_tok('a.norm_name'), _tok('b.norm_name'))} AS name_tok_jacc, {_jacc(_c3('a.norm_name'), _c3('b.norm_name'))} AS name_c3_jacc, {_jacc(_tok('a.norm_addr'), _tok('b.norm_addr'))} AS addr_tok_jacc"),
    "number_features": _NUM,
    "levenshtein_sim": _true_pairs("CASE WHEN a.norm_name <> '' AND b.norm_name <> '' THEN round((1 - levenshtein(a.norm_name, b.norm_name) / greatest(length(a.norm_name), length(b.norm_name))) * 100, 6) END AS lev"),
    "jaro_winkler": _true_pairs("CASE WHEN a.fold_name <> '' AND b.fold_name <> '' THEN round(jaro_winkler_similarity(a.fold_name, b.fold_name) * 100, 6) END AS jw"),
    "damerau": _true_pairs("damerau_levenshtein(a.norm_name, b.norm_name) AS d"),
    "idf_jaccard": f"""WITH {_STATS}, {TRUTH}, pr AS (SELECT t.*, a.country, {_tok("a.norm_name")} AS x, {_tok("b.norm_name")} AS y FROM truth t JOIN norm a ON a.entity_id = s1_id JOIN norm b ON b.entity_id = cand_id),
      e AS (SELECT s1_id, cand_id, country, x, y, unnest(list_distinct(list_concat(x, y))) AS token FROM pr),
      w AS (SELECT e.*, coalesce(ln((st.n_docs + 1) / (st.df + 1)) + 1, ln(((SELECT count(*) FROM norm n WHERE n.country = e.country) + 1) / 2) + 1) AS w FROM e LEFT JOIN st ON st.field = 'norm_name' AND st.country = e.country AND st.token = e.token)
      SELECT s1_id, cand_id, round(sum(CASE WHEN list_contains(x, token) AND list_contains(y, token) THEN w ELSE 0 END) / sum(w), 6) AS name_idf_jacc FROM w GROUP BY 1, 2""",
    "record_text": rf"WITH {RAW}, x AS (SELECT entity_id, trim(regexp_replace(raw_name, '\s+', ' ', 'g')) AS n, trim(regexp_replace(raw_addr, '\s+', ' ', 'g')) AS a FROM raw) SELECT entity_id, CASE WHEN a = '' THEN n ELSE n || ' | ' || a END AS text FROM x",
    "id_code": f"WITH {RAW} SELECT entity_id, CAST(substr(entity_id, 2, 1) AS BIGINT) * 1000000000000 + CAST(split_part(entity_id, '-', 2) AS BIGINT) AS code FROM raw",
    "dice_dictionary": """WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}]+')) AS ts, lang FROM documents),
      r AS (SELECT list_filter(ts, lambda x : regexp_matches(x, '[àâäáçéèêëíîïñóôöúùûüß]')) AS a, list_filter(ts, lambda x : NOT regexp_matches(x, '[^a-z]')) AS b FROM t WHERE false) SELECT 1 AS x WHERE false""",
    "event_windows": "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "event_sessions": "WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k",
}
del OTHERS["dice_dictionary"]

for _name in ("jaccards", "number_features", "levenshtein_sim", "jaro_winkler", "damerau", "idf_jaccard"):
    OTHERS[_name] = varied(OTHERS[_name])

OTHERS["string_scores"] = varied(_true_pairs(", ".join(
    f"CASE WHEN a.{f} <> '' AND b.{f} <> '' THEN {e.format(a=f'a.{f}', b=f'b.{f}')} END AS {f}_{n}"
    for f, n, e in [
        ("norm_name", "jw", "round(jaro_winkler_similarity({a}, {b}) * 100, 6)"), ("norm_addr", "jw", "round(jaro_winkler_similarity({a}, {b}) * 100, 6)"),
        ("fold_name", "jw", "round(jaro_winkler_similarity({a}, {b}) * 100, 6)"), ("fold_addr", "jw", "round(jaro_winkler_similarity({a}, {b}) * 100, 6)"),
        ("norm_name", "lev", "round((1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))) * 100, 6)"),
        ("norm_addr", "lev", "round((1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))) * 100, 6)"),
    ]
)))

_NATIVE = varied(f"""WITH {NORM}, {TRUTH}, tk AS (SELECT t.s1_id, list_distinct(list_filter(regexp_extract_all(lower(b.raw_name || ' ' || b.raw_addr), '[\\p{{L}}\\p{{M}}\\p{{N}}&]+'), lambda w : regexp_matches(w, '[а-я]'))) AS a,
    list_distinct(list_filter(list_concat({_tok("a.norm_name")}, {_tok("a.norm_addr")}), lambda w : regexp_matches(w, '^[ -~]+$'))) AS b
    FROM native t JOIN norm a ON a.entity_id = t.s1_id JOIN norm b ON b.entity_id = t.cand_id),
  ok AS (SELECT * FROM tk WHERE len(a) > 0 AND len(b) > 0), na AS (SELECT n, count(*) AS cn FROM (SELECT unnest(a) AS n FROM ok) GROUP BY 1), nb AS (SELECT l, count(*) AS cl FROM (SELECT unnest(b) AS l FROM ok) GROUP BY 1),
  co AS (SELECT n, l, count(*) AS c FROM (SELECT n, unnest(b) AS l FROM (SELECT unnest(a) AS n, b FROM ok)) GROUP BY 1, 2 HAVING count(*) >= 3),
  dc AS (SELECT n, l, c, 2.0 * c / (cn + cl) AS dice FROM co JOIN na USING (n) JOIN nb USING (l))""")
OTHERS["dice_dictionary"] = f"{_NATIVE} SELECT n AS native_token, l AS latin_token, c, round(dice, 9) AS dice FROM dc WHERE dice >= 0.5 QUALIFY row_number() OVER (PARTITION BY n ORDER BY dice DESC, c DESC, l) = 1"
OTHERS["crc_sample"] = f"WITH {RAW} SELECT entity_id FROM raw WHERE source = 'S1'"

#: Lines of a small output with some of each problem, ids that must and may occur, and its candidates.
OUTPUT = {
    "lines": ["S1-1\tS2-1,S2-1", "S1-2\tS2-2,,S3-9", "S1-2\t", "S1-3 \tS2-1", "S1-4", "S1-9\tX-1", "S1-5\tS3-3"],
    "required": ["S1-1", "S1-2", "S1-3", "S1-4", "S1-5"], "valid": ["S2-1", "S2-2", "S3-3"], "candidates": ["S1-1\tS2-1", "S1-2\tS2-2"],
}
_VALUES = ", ".join(f"{n}(value) AS (VALUES {', '.join(repr(v).replace(chr(92) + 't', chr(9)).join(['(', ')']) for v in vs)})" for n, vs in OUTPUT.items())
OTHERS["output_checks"] = f"""WITH {_VALUES},
  r AS (SELECT value, string_split(value, chr(9))[1] AS id, len(string_split(value, chr(9))) - 1 AS tabs, coalesce(string_split(value, chr(9))[2], '') AS rest FROM lines),
  x AS (SELECT *, CASE WHEN rest = '' THEN [] ELSE string_split(rest, ',') END AS ids FROM r), pr AS (SELECT DISTINCT id, unnest(ids) AS c FROM x),
  ca AS (SELECT string_split(value, chr(9))[1] AS id, unnest(string_split(string_split(value, chr(9))[2], ',')) AS c FROM candidates)
  SELECT 'not exactly one tab' AS problem, count(*) AS n FROM x WHERE tabs <> 1 UNION ALL SELECT 'spaces, quotes or carriage returns', count(*) FROM x WHERE regexp_matches(value, '[ "''\r]')
  UNION ALL SELECT 'empty id in a list', count(*) FROM x WHERE list_contains(ids, '') UNION ALL SELECT 'duplicate ids in a list', count(*) FROM x WHERE len(list_distinct(ids)) < len(ids)
  UNION ALL SELECT 'id without a source prefix', count(*) FROM x WHERE len(list_filter(ids, lambda i : NOT regexp_matches(i, '^S[23]-'))) > 0
  UNION ALL SELECT 'duplicate rows', count(*) FROM (SELECT id FROM x GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'required ids missing', count(*) FROM required WHERE value NOT IN (SELECT id FROM x)
  UNION ALL SELECT 'unknown first ids', count(DISTINCT id) FROM x WHERE id NOT IN (SELECT value FROM required) UNION ALL SELECT 'unknown matched ids', count(*) FROM pr WHERE c NOT IN (SELECT value FROM valid)
  UNION ALL SELECT 'matched ids outside the candidates', count(*) FROM pr ANTI JOIN ca USING (id, c)"""
