"""The registered queries as SQL for an independent engine.

Written from the meaning of each query, not from its Spark plan: medians by sorting, splits by
ranking all keys, AUC by ranking all scores.
"""

from __future__ import annotations

SEED = 42
LENGTH = 10
N_COLS = 7
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CLASSES = ["click", "error", "purchase", "signup", "view"]
GROUPS = [0, 1, 1, 1, 0]
LINE_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def u(*parts: str, slot: int = 0) -> str:
    """Number in [0, 1) from the md5 of the parts."""
    return hex_u(f"md5(concat_ws('|', {', '.join(f'({p})::VARCHAR' for p in parts)}))", slot)


def hex_u(digest: str, slot: int = 0) -> str:
    return f"(('0x' || substr({digest}, {1 + 8 * slot}, 8))::UBIGINT::DOUBLE / 4294967296.0)"


def title(b: str) -> str:
    return f"CASE WHEN {b} THEN 'True' ELSE 'False' END"


EV = """
ev AS MATERIALIZED (
  SELECT user_id, event_id, ts, event_type, value, json_extract_string(props, '$.k') AS k, props,
         hour(ts)::BIGINT AS h, floor(epoch(ts) / 60)::BIGINT AS m FROM events),
gaps AS MATERIALIZED (
  SELECT *, coalesce(m - lag(m) OVER w, 0)::BIGINT AS gap, row_number() OVER w AS pos,
         count(*) OVER (PARTITION BY user_id) AS n_user
  FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""

LINES = """
lines AS MATERIALIZED (SELECT l.*, o_custkey, o_orderpriority FROM lineitem l JOIN orders ON l_orderkey = o_orderkey)"""


def median_levels(long: str, depth: int = 5) -> str:
    """Codes of a (col, rid, v) table, one pair of tables per level; ends in ``codes``."""
    ctes = [f"l0 AS MATERIALIZED (SELECT col, rid, v, '' AS path FROM {long} WHERE v IS NOT NULL)"]
    for k in range(depth):
        ctes.append(f"n{k} AS MATERIALIZED (SELECT col, path, median(v) AS med, max(v) AS mx FROM l{k} "
                    f"WHERE length(path) = {k} GROUP BY col, path)")
        ctes.append(f"l{k + 1} AS MATERIALIZED (SELECT l.col, l.rid, l.v, CASE WHEN n.med < n.mx THEN l.path || "
                    f"CASE WHEN l.v <= n.med THEN '0' ELSE '1' END ELSE l.path END AS path "
                    f"FROM l{k} l LEFT JOIN n{k} n ON l.col = n.col AND l.path = n.path)")
    return ",\n".join(ctes)


def unlimited_levels(source: str, cols: list[str], levels: int = 48) -> str:
    """(col, path, above, until): the leaves of median trees without a limit, more levels than twice the logarithm of any row count here."""
    inf = "'infinity'::DOUBLE"
    ctes = ["v0 AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT '{c}' AS col, {c}::DOUBLE AS v, '' AS path, -{inf} AS above, {inf} AS until FROM {source}" for c in cols) + ")"]
    for k in range(levels):
        ctes.append(f"m{k} AS MATERIALIZED (SELECT col, path, above, until, median(v) AS med, max(v) AS mx FROM v{k} GROUP BY ALL)")
        ctes.append(f"v{k + 1} AS MATERIALIZED (SELECT v.col, v.v, v.path || CASE WHEN v.v <= med THEN '0' ELSE '1' END AS path, "
                    f"CASE WHEN v.v <= med THEN v.above ELSE med END AS above, CASE WHEN v.v <= med THEN med ELSE v.until END AS until "
                    f"FROM v{k} v JOIN m{k} m ON v.col = m.col AND v.path = m.path WHERE med < mx)")
    ends = " UNION ALL ".join(f"SELECT col, path, above, until FROM m{k} WHERE NOT med < mx" for k in range(levels))
    return ",\n".join([*ctes, f"leaves AS MATERIALIZED ({ends})"])


EVENT_CODES = EV + """,
long AS MATERIALIZED (
  SELECT 'value' AS col, event_id AS rid, value AS v FROM gaps UNION ALL
  SELECT 'hour', event_id, h::DOUBLE FROM gaps UNION ALL
  SELECT 'gap', event_id, gap::DOUBLE FROM gaps),
""" + median_levels("long") + """,
codes AS MATERIALIZED (
  SELECT rid, max(CASE WHEN col = 'value' THEN path END) AS cv, max(CASE WHEN col = 'hour' THEN path END) AS ch,
         max(CASE WHEN col = 'gap' THEN path END) AS cg FROM l5 GROUP BY rid),
tok AS MATERIALIZED (
  SELECT g.user_id, g.event_id, g.pos, '0_' || k AS t0, '1_' || cv AS t1, '2_' || ch AS t2, '3_' || cg AS t3,
         '4_' || """ + title("event_type = 'error'") + """ AS t4, '5_' || event_type AS t5
  FROM gaps g JOIN codes c ON g.event_id = c.rid),
cells AS MATERIALIZED (
  SELECT user_id, event_id, pos, i, [t0, t1, t2, t3, t4, t5, '[ROW]'][i + 1] AS token
  FROM tok, range(7) r(i))"""

SPECIALS = "(VALUES ('[PAD]', 0), ('[BOS]', 1), ('[EOS]', 2), ('[MASK]', 3), ('[UNK]', 4)) s(token, id)"


def vocabulary_ctes(size: int = 60000) -> str:
    return EVENT_CODES + f""",
words AS MATERIALIZED (
  SELECT token, count(*) AS freq FROM cells GROUP BY token ORDER BY freq DESC, token LIMIT {size - 5}),
vocab AS MATERIALIZED (
  SELECT token, id, 0 AS freq FROM {SPECIALS} UNION ALL
  SELECT token, 4 + row_number() OVER (ORDER BY freq DESC, token) AS id, freq FROM words),
ids AS MATERIALIZED (
  SELECT user_id, event_id, pos, i, coalesce(v.id, 4)::BIGINT AS id FROM cells LEFT JOIN vocab v USING (token))"""


PARTS = r"""CASE WHEN regexp_matches(token, '^[0-9]+_') THEN regexp_extract(token, '^(\d+)_(.*)$', 1)::BIGINT END AS col_id,
  CASE WHEN regexp_matches(token, '^[0-9]+_') THEN regexp_extract(token, '^(\d+)_(.*)$', 2) END AS value"""

SPLIT = f"""
ranked_users AS MATERIALIZED (
  SELECT user_id, row_number() OVER (ORDER BY md5(user_id::VARCHAR || '|{SEED}'), user_id::VARCHAR) AS rn,
         count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM events)),
users AS MATERIALIZED (
  SELECT user_id, CASE WHEN rn <= greatest(1, floor(n * 0.1)) THEN 'test' ELSE 'train' END AS split FROM ranked_users)"""


def sequence_ctes(order: str | None = None) -> str:
    """Sequences with ``iid`` and ``mask`` lists; ``order`` ranks the cells of an event."""
    order = order or "i"
    return vocabulary_ctes() + f""",
placed AS MATERIALIZED (
  SELECT user_id, event_id, pos, i, id, ((pos - 1) // {LENGTH}) AS seq_idx, {order} AS place FROM ids),
body AS MATERIALIZED (
  SELECT user_id, seq_idx, list(id ORDER BY pos, place) AS ids, list(i ORDER BY pos, place) AS cols,
         count(DISTINCT pos) AS n_rows FROM placed GROUP BY user_id, seq_idx),
seqs AS MATERIALIZED (
  SELECT user_id, seq_idx::BIGINT AS seq_idx, n_rows,
         list_concat([1::BIGINT], ids, list_transform(range({LENGTH * N_COLS} - len(ids)), lambda x: 0::BIGINT), [2::BIGINT]) AS iid,
         list_concat([-1::BIGINT], cols, list_transform(range({LENGTH * N_COLS} - len(ids)), lambda x: -1::BIGINT), [-1::BIGINT]) AS mask
  FROM body)"""


def with_(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select}"


def joined(expr: str) -> str:
    return f"array_to_string({expr}, ' ')"


def mode_sql(source: str, keys: list[str], col: str, out: str) -> str:
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    group = ", ".join([*keys, col])
    prefix = ", ".join(keys) + ", " if keys else ""
    return (f"SELECT {prefix}{col} AS {out} FROM (SELECT {prefix}{col}, row_number() OVER ({part}ORDER BY n DESC, {col}) AS rn "
            f"FROM (SELECT {group}, count(*) AS n FROM {source} GROUP BY {group})) WHERE rn = 1")


def entity_stats_ctes(source: str) -> str:
    keys = ["o_custkey", "l_linenumber"]
    return f"""
num AS (SELECT o_custkey, l_linenumber, avg(l_quantity) AS a, stddev_samp(l_quantity) AS s FROM {source} GROUP BY ALL),
mf AS ({mode_sql(source, keys, 'l_returnflag', 'top_flag')}),
mp AS ({mode_sql(source, keys, 'o_orderpriority', 'top_priority')}),
st AS (SELECT * FROM num JOIN mf USING (o_custkey, l_linenumber) JOIN mp USING (o_custkey, l_linenumber))"""


def dataset_stats_select(source: str) -> str:
    return f"""SELECT avg(l_quantity) AS avg_dollar_amt, stddev_samp(l_quantity) AS std_dollar_amt,
  ({mode_sql(source, [], 'l_returnflag', 'x')}) AS top_flag, ({mode_sql(source, [], 'o_orderpriority', 'x')}) AS top_priority
FROM {source}"""


def unpivot(source: str, cols: dict[str, str], rid: str = "rid") -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS col, {rid} AS rid, {e} AS v FROM {source}" for c, e in cols.items())


ITEMS = "items AS MATERIALIZED (SELECT *, row_number() OVER () AS rid FROM lineitem)"


def measures_long() -> str:
    return f"{ITEMS},\nlong AS MATERIALIZED ({unpivot('items', {c: c for c in MEASURES})})"


def profile_sql() -> str:
    e = title("event_type = 'error'")
    parts = [f"SELECT '{c}' AS \"column\", '{r}' AS role, 'distinct' AS stat, count(DISTINCT {x})::DOUBLE AS value FROM gaps"
             for c, r, x in (("user_id", "index", "user_id"), ("k", "categorical", "k"), ("is_error", "binary", e),
                             ("event_type", "label", "event_type"))]
    for c, x in (("value", "value"), ("Hour", "h::DOUBLE"), ("total_minutes_from_last", "gap::DOUBLE")):
        for s, f in (("mean", f"avg({x})"), ("std", f"stddev_samp({x})"), ("min", f"min({x})"), ("max", f"max({x})"),
                     ("buckets", "max(32::DOUBLE)")):
            parts.append(f"SELECT '{c}', 'numeric', '{s}', {f} FROM gaps")
    body = " UNION ALL ".join(parts)
    return with_(EV, f"SELECT \"column\", role, stat, round(value, 6) AS value FROM ({body})")


def distinct_sql() -> str:
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"]
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct, count(*) AS rows, 5::BIGINT AS columns FROM orders"
        for c in cols)


def binary_sql() -> str:
    cols = ["quality", "toxic", "lang", "source"]
    body = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) + count(DISTINCT CASE WHEN {c} IS NULL THEN 1 END) AS n_values FROM j"
                              for c in cols)
    return with_("j AS (SELECT quality, toxic, lang, source FROM labels JOIN documents USING (doc_id))",
                 f"SELECT * FROM ({body}) WHERE n_values <> 2")


def quantile_edges(source: str, n: int = 8) -> str:
    """(col, ix, e): de-duplicated exact quantiles."""
    parts = [f"SELECT '{c}' AS col, unnest(quantile_cont({c}::DOUBLE, {[i / n for i in range(n + 1)]})) AS e FROM {source}"
             for c in MEASURES]
    return (f"edges AS MATERIALIZED (SELECT col, e, row_number() OVER (PARTITION BY col ORDER BY e) - 1 AS ix "
            f"FROM (SELECT DISTINCT col, e FROM ({' UNION ALL '.join(parts)})))")


def bin_code(c: str, lowest: bool, otherwise: str) -> str:
    """Edges below the value, less one; the lowest edge and values outside need care."""
    below = f"(SELECT count(*) FROM edges WHERE col = '{c}' AND e < i.{c})"
    hi = f"(SELECT max(e) FROM edges WHERE col = '{c}')"
    lo = f"(SELECT min(e) FROM edges WHERE col = '{c}')"
    low = f"WHEN i.{c} = {lo} THEN 0 " if lowest else ""
    return f"(CASE {low}WHEN i.{c} > {lo} AND i.{c} <= {hi} THEN {below} - 1 ELSE {otherwise} END)::INTEGER AS {c}"


def uniform_sql(n: int = 7) -> str:
    cols = []
    for c in MEASURES:
        lo, hi = f"(SELECT min({c}) FROM lineitem)", f"(SELECT max({c}) FROM lineitem)"
        edge = lambda k: f"({lo} + {k} * (({hi} - {lo}) / {n}.0::DOUBLE))"
        case = " ".join(f"WHEN {c} <= {edge(k)} THEN {k - 1}" for k in range(1, n))
        cols.append(f"(CASE {case} ELSE {n - 1} END)::INTEGER AS {c}")
    return f"SELECT {LINE_KEY}, {', '.join(cols)} FROM lineitem"


def scores_ctes() -> str:
    key = ["user_id", "seq_idx", "pos", "5"]
    likes = f"{u(*key, chr(39) + 'hit' + chr(39), str(SEED))} < 0.6"
    weights = ", ".join(
        f"1.0::DOUBLE + {u(*key, chr(39) + c + chr(39), str(SEED))} * 9 + CASE WHEN {likes} AND event_type = '{c}' THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END AS w{i}"
        for i, c in enumerate(CLASSES))
    total = "(((w0 + w1) + w2) + w3) + w4"
    raw = ", ".join(f"round(w{i} / ({total}), 6)" for i in range(5))
    ps = ", ".join(f"sorted[{i + 1}] AS p{i}" for i in range(5))
    group = "CASE event_type " + " ".join(f"WHEN '{c}' THEN {g}" for c, g in zip(CLASSES, GROUPS)) + " END"
    # Classes come in the order of the vocabulary: by falling count, then by value.
    summed = lambda g: f"list_reduce([sorted[i] FOR i IN range(1, 6) IF list_extract({GROUPS}, list_position({CLASSES}, names[i])) = {g}], lambda a, b: a + b)"
    return EV + f""",
ordered AS MATERIALIZED (SELECT list(event_type ORDER BY n DESC, event_type) AS names FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)),
lab AS MATERIALIZED (SELECT user_id, pos, (pos - 1) // {LENGTH} AS seq_idx, event_type FROM gaps),
wts AS MATERIALIZED (SELECT *, {weights} FROM lab),
raw AS MATERIALIZED (SELECT user_id, pos, seq_idx, event_type, names, [{raw}] AS byname FROM wts, ordered),
listed AS MATERIALIZED (SELECT *, [byname[list_position({CLASSES}, names[i])] FOR i IN range(1, 6)] AS sorted FROM raw),
scores AS MATERIALIZED (SELECT user_id, pos, seq_idx, list_position(names, event_type) - 1 AS t, {group} AS g, {ps}, {summed(0)} AS q0, {summed(1)} AS q1 FROM listed),
flagged AS MATERIALIZED (SELECT *, pos = max(pos) OVER (PARTITION BY user_id, seq_idx) AS is_last FROM scores),
variants AS MATERIALIZED (
  SELECT '' AS variant, t AS target, [p0, p1, p2, p3, p4] AS probs FROM flagged UNION ALL
  SELECT '_last', t, [p0, p1, p2, p3, p4] FROM flagged WHERE is_last UNION ALL
  SELECT '_consolidated', g, [q0, q1] FROM flagged UNION ALL
  SELECT '_last_consolidated', g, [q0, q1] FROM flagged WHERE is_last),
preds AS MATERIALIZED (SELECT variant, target, list_position(probs, list_max(probs)) - 1 AS pred, probs FROM variants)"""


AUC = """,
lines AS MATERIALIZED (SELECT variant, target, i AS c, probs[i + 1] AS p FROM preds, range(5) r(i) WHERE i < len(probs)),
rk AS MATERIALIZED (SELECT variant, c, target = c AS hit,
  rank() OVER (PARTITION BY variant, c ORDER BY p) + (count(*) OVER (PARTITION BY variant, c, p) - 1) / 2.0::DOUBLE AS r FROM lines),
per_class AS MATERIALIZED (
  SELECT variant, c, count(*) FILTER (hit) AS np, count(*) FILTER (NOT hit) AS nn, coalesce(sum(r) FILTER (hit), 0) AS sr
  FROM rk GROUP BY variant, c),
aucs AS MATERIALIZED (SELECT variant, c, np, nn, CASE WHEN np > 0 AND nn > 0
  THEN (sr - np * (np + 1) / 2.0::DOUBLE) / (np::DOUBLE * nn) END AS auc FROM per_class)"""

F1 = """,
cls AS (SELECT DISTINCT variant, target AS c FROM preds UNION SELECT DISTINCT variant, pred FROM preds),
cnt AS (SELECT variant, c, (SELECT count(*) FROM preds p WHERE p.variant = cls.variant AND target = c AND pred = c) AS tp,
  (SELECT count(*) FROM preds p WHERE p.variant = cls.variant AND target <> c AND pred = c) AS fp,
  (SELECT count(*) FROM preds p WHERE p.variant = cls.variant AND target = c AND pred <> c) AS fn FROM cls)"""

BATCHES = """,
per_user AS MATERIALIZED (
  SELECT user_id, count(*) AS n, avg(-ln([p0, p1, p2, p3, p4][t + 1])) AS loss,
         avg(CASE WHEN list_position([p0, p1, p2, p3, p4], greatest(p0, p1, p2, p3, p4)) - 1 = t THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS acc
  FROM scores GROUP BY user_id)"""


def column_accuracy_sql() -> str:
    key = ["user_id", "seq_idx", "pos", "4"]
    likes = f"{u(*key, chr(39) + 'hit' + chr(39), str(SEED))} < 0.6"
    w = [f"1.0::DOUBLE + {u(*key, chr(39) + c + chr(39), str(SEED))} * 9 + CASE WHEN {likes} AND {title(chr(101) + 'vent_type = ' + chr(39) + 'error' + chr(39))} = '{c}' THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END"
         for c in ("False", "True")]
    return with_(scores_ctes() + f""",
two AS MATERIALIZED (SELECT event_type, {w[0]} AS a, {w[1]} AS b FROM lab),
e AS (SELECT (CASE WHEN round(b / (a + b), 6) > round(a / (a + b), 6) THEN 'error' ELSE 'no' END = 'error') = (event_type = 'error') AS hit FROM two),
acc AS (SELECT 4::BIGINT AS col_id, count(*) AS rows, avg(hit::INT) AS accuracy FROM e UNION ALL
  SELECT 5, count(*), avg((pred = target)::INT) FROM preds WHERE variant = '_consolidated')""",
        "SELECT col_id, rows, round(accuracy, 9) AS accuracy FROM acc UNION ALL SELECT -1, 0, round(avg(accuracy), 9) FROM acc")


RUNS = r"""
runs AS MATERIALIZED (
  SELECT o_orderkey, o_orderdate, 'final_' || CASE o_orderpriority WHEN '1-URGENT' THEN 'amazon_electronics' WHEN '2-HIGH' THEN 'amazon_movies'
    WHEN '3-MEDIUM' THEN 'ibm' WHEN '4-NOT SPECIFIED' THEN 'loans' ELSE 'churn' END ||
    CASE o_orderstatus WHEN 'F' THEN '_masked_randomized' ELSE '' END AS name,
    CASE o_orderstatus WHEN 'F' THEN 'eval' WHEN 'O' THEN 'train' ELSE 'other' END AS phase FROM orders),
files AS MATERIALIZED (SELECT *, 'table-' || name || '-' || strftime(o_orderdate, '%Y-%m-%d-%H-%M') || '-' || phase || '_stats.csv' AS filename,
  string_split(name, '_') AS parts FROM runs WHERE phase <> 'other'),
parsed AS MATERIALIZED (SELECT *, array_to_string(parts[1:3], '_') AS task_name,
  CASE WHEN length(array_to_string(parts[4:], '_')) <= 1 THEN 'base' ELSE array_to_string(parts[4:], '_') END AS experiment_name,
  CASE WHEN array_to_string(parts[4:], '_') = '' THEN 'Base' ELSE array_to_string(parts[4:], '_') END AS short_name FROM files)"""

METRICS = """
met AS MATERIALIZED (
  SELECT 'EVAL_pretrain_' || CASE o_orderpriority WHEN '1-URGENT' THEN 'amazon_electronics' WHEN '2-HIGH' THEN 'amazon_movies'
    WHEN '3-MEDIUM' THEN 'ibm' WHEN '4-NOT SPECIFIED' THEN 'loans' ELSE 'churn' END AS dataset,
    CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS randomized, (month(o_orderdate) > 6)::INT AS masking,
    ((o_totalprice / 1000000)::DECIMAL(12, 6))::DOUBLE AS auc_last,
    CASE WHEN o_totalprice > 100000 THEN ((o_totalprice / 2000000)::DECIMAL(12, 6))::DOUBLE END AS auc_c FROM orders),
summary AS MATERIALIZED (
  SELECT dataset, randomized::BIGINT AS randomized, masking::BIGINT AS masking, avg(auc_last) AS auc_last_mean, stddev_samp(auc_last) AS auc_last_std,
    count(auc_last) AS auc_last_count, avg(auc_c) AS auc_last_consolidated_mean, stddev_samp(auc_c) AS auc_last_consolidated_std,
    count(auc_c) AS auc_last_consolidated_count FROM met WHERE randomized IS NOT NULL GROUP BY ALL),
chosen AS MATERIALIZED (SELECT *, CASE WHEN contains(dataset, 'amazon') THEN auc_last_consolidated_mean ELSE auc_last_mean END AS desired_metric_mean,
  CASE WHEN contains(dataset, 'amazon') THEN auc_last_consolidated_std ELSE auc_last_std END AS desired_metric_std FROM summary)"""


def named_text() -> str:
    parts = ["'k:' || k", "'value:' || value::VARCHAR", "'Hour:' || h::DOUBLE::VARCHAR",
             "'total_minutes_from_last:' || gap::DOUBLE::VARCHAR", f"'is_error:' || {title(chr(101) + 'vent_type = ' + chr(39) + 'error' + chr(39))}",
             "'event_type:' || event_type", "'[ROW]'"]
    return f"concat_ws(' ', {', '.join(parts)})"


TEXTS = EV + f""",
named AS MATERIALIZED (SELECT user_id, pos, (pos - 1) // 5 AS seq_idx, {named_text()} AS t FROM gaps),
texts AS MATERIALIZED (SELECT user_id, seq_idx::BIGINT AS seq_idx, string_agg(t, ' ' ORDER BY pos) AS text FROM named GROUP BY user_id, seq_idx),
split_texts AS MATERIALIZED (SELECT *, string_split(text, ' ') AS words FROM texts)"""


def shuffle_rank(free: int) -> str:
    """Place of each cell: the first ``free`` cells by digest, the others where they were."""
    return (f"CASE WHEN i < {free} THEN row_number() OVER (PARTITION BY event_id, i < {free} ORDER BY "
            f"md5(concat_ws('|', '{SEED}', '0', user_id::VARCHAR, pos::VARCHAR, i::VARCHAR))) - 1 ELSE i END")


def pinned_rank() -> str:
    """All six data cells are free but the label (5), which goes to place 1."""
    rank = (f"row_number() OVER (PARTITION BY event_id, i < 5 ORDER BY "
            f"md5(concat_ws('|', '{SEED}', '0', user_id::VARCHAR, pos::VARCHAR, i::VARCHAR))) - 1")
    return f"CASE WHEN i < 5 THEN ({rank}) + CASE WHEN ({rank}) >= 1 THEN 1 ELSE 0 END WHEN i = 5 THEN 1 ELSE i END"


def masked_tokens_sql() -> str:
    flat = sequence_ctes() + f""",
flat AS MATERIALIZED (SELECT user_id, seq_idx, unnest(range(len(iid))) AS p, unnest(iid) AS x FROM seqs),
drawn AS MATERIALIZED (SELECT *, md5(concat_ws('|', '{SEED}', user_id::VARCHAR, seq_idx::VARCHAR, p::VARCHAR)) AS d FROM flat),
picked AS MATERIALIZED (SELECT *, x >= 5 AND {hex_u('d', 0)} < 0.15 AS chosen FROM drawn)"""
    new = (f"CASE WHEN NOT chosen THEN x WHEN {hex_u('d', 1)} < 0.8 THEN 3 "
           f"WHEN {hex_u('d', 2)} < 0.5 THEN floor({hex_u('d', 3)} * (SELECT count(*) FROM vocab))::BIGINT ELSE x END")
    return with_(flat, f"SELECT user_id, seq_idx, {joined(f'list({new} ORDER BY p)')} AS input_ids, "
                       f"{joined('list(CASE WHEN chosen THEN x ELSE -100 END ORDER BY p)')} AS labels FROM picked GROUP BY user_id, seq_idx")


def masked_labels_sql() -> str:
    base = f"md5(concat_ws('|', '{SEED}', user_id::VARCHAR, seq_idx::VARCHAR))"
    ctes = sequence_ctes() + f""",
plan AS MATERIALIZED (SELECT *, CASE WHEN {hex_u(base, 0)} < 0.25 THEN n_rows
  WHEN {hex_u(base, 0)} < 0.75 AND n_rows >= 2 THEN least(1 + floor({hex_u(base, 1)} * (n_rows - 1)), n_rows - 1) ELSE 0 END::BIGINT AS n_masked FROM seqs),
rows_ AS MATERIALIZED (SELECT user_id, seq_idx, n_masked, unnest(range(n_rows)) AS r FROM plan),
hidden AS MATERIALIZED (SELECT user_id, seq_idx, r FROM (SELECT *, row_number() OVER (PARTITION BY user_id, seq_idx ORDER BY
  md5(concat_ws('|', '{SEED}', user_id::VARCHAR, seq_idx::VARCHAR, r::VARCHAR)), r) AS rn FROM rows_) WHERE rn <= n_masked),
flat AS MATERIALIZED (SELECT user_id, seq_idx, n_masked, unnest(range(len(iid))) AS p, unnest(iid) AS x, unnest(mask) AS m FROM plan)"""
    return with_(ctes, f"""SELECT f.user_id, f.seq_idx, n_masked, {joined('list(CASE WHEN m = 5 AND h.r IS NOT NULL THEN 3 ELSE x END ORDER BY p)')} AS input_ids
FROM flat f LEFT JOIN hidden h ON f.user_id = h.user_id AND f.seq_idx = h.seq_idx AND h.r = (p - 1) // {N_COLS}
GROUP BY f.user_id, f.seq_idx, n_masked""")


def softmax_sql() -> str:
    ids = "CASE event_type " + " ".join(f"WHEN '{c}' THEN {i + 6}" for i, c in enumerate(CLASSES)) + " END"
    logit = lambda i: f"(({i} * 7 + p * 13 + user_id * 5) % 23)::DOUBLE / 4.0::DOUBLE"
    ls = ", ".join(f"{logit(i + 6)} AS z{i}" for i in range(5))
    es = ", ".join(f"exp(z{i} - greatest(z0, z1, z2, z3, z4)) AS e{i}" for i in range(5))
    ps = ", ".join(f"round(e{i} / (e0 + e1 + e2 + e3 + e4), 9) AS p{i}" for i in range(5))
    # Event r of a sequence holds its label at position 1 + 2r, so position 2r predicts it.
    return with_(EV + f""",
lab AS (SELECT user_id, (pos - 1) // {LENGTH} AS seq_idx, 2 * ((pos - 1) % {LENGTH}) AS p, {ids} - 6 AS t FROM gaps),
z AS (SELECT *, {ls} FROM lab), e AS (SELECT *, {es} FROM z)""",
        f"SELECT user_id, seq_idx::BIGINT AS seq_idx, p::BIGINT AS pos, t::BIGINT AS target_ix, {ps} FROM e")


def published_values() -> str:
    from tributary.operators.report import PUBLISHED

    return ", ".join(f"('{d}', '{m}', {v}::DOUBLE, 0.0::DOUBLE)" for m, d, v in PUBLISHED)


def _oracle() -> dict[str, str]:
    seq = "user_id, seq_idx"
    stamp = lambda e: f"strftime({e}, '%Y-%m-%d %H:%M:%S')"
    joined_stats = f"""SELECT {LINE_KEY}, l.o_custkey,
  round(coalesce(a, d.avg_dollar_amt), 6) AS avg_dollar_amt, round(coalesce(s, d.std_dollar_amt), 6) AS std_dollar_amt,
  coalesce(st.top_flag, d.top_flag) AS top_flag, coalesce(st.top_priority, d.top_priority) AS top_priority
FROM lines l LEFT JOIN st USING (o_custkey, l_linenumber), d"""
    q = {
        "time_gaps": with_(EV, "SELECT user_id, event_id, m AS total_minutes, h AS hour_of_day, gap AS total_minutes_from_last FROM gaps"),
        "entity_stats": with_(LINES + "," + entity_stats_ctes("lines"),
                              "SELECT o_custkey, l_linenumber, round(a, 6) AS avg_dollar_amt, round(s, 6) AS std_dollar_amt, top_flag, top_priority FROM st"),
        "dataset_stats": with_(LINES + f", d AS ({dataset_stats_select('lines')})",
                               "SELECT round(avg_dollar_amt, 6) AS avg_dollar_amt, round(std_dollar_amt, 6) AS std_dollar_amt, top_flag, top_priority FROM d"),
        "entity_stats_joined": with_(
            LINES + ", hist AS MATERIALIZED (SELECT * FROM lines WHERE l_shipdate < TIMESTAMP '1998-01-01'),"
            + entity_stats_ctes("hist") + f", d AS ({dataset_stats_select('hist')})", joined_stats),
        "typed_columns": with_(LINES, f"""SELECT l_quantity::BIGINT::VARCHAR AS l_quantity, l_discount::VARCHAR AS l_discount,
  replace(o_orderpriority, ' ', '') AS o_orderpriority, l_extendedprice, {title("l_linestatus = 'F'")} AS is_final,
  CASE l_returnflag WHEN 'A' THEN 'True' WHEN 'N' THEN 'False' ELSE 'returned' END AS answer, l_linestatus, l_orderkey, l_linenumber FROM lines"""),
        "rejected_numbers": """SELECT 'priority' AS "column", count(*) FILTER (TRY_CAST(o_orderpriority AS DOUBLE) IS NULL) AS rejected FROM orders
UNION ALL SELECT 'rank', count(*) FILTER (TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) IS NULL) FROM orders""",
        "money_parse": "SELECT p_partkey, p_retailprice::DECIMAL(12, 2)::DOUBLE AS amount, round(ln(p_retailprice::DECIMAL(12, 2)::DOUBLE), 9) AS log_amount FROM part",
        "timestamp_parse": f"""SELECT o_orderkey, {stamp('o_orderdate')} AS from_parts,
  {stamp("make_timestamp(year(o_orderdate), month(o_orderdate), day(o_orderdate), day(o_orderdate) % 24, 0, 0)")} AS from_hour,
  {stamp("date_trunc('day', o_orderdate)")} AS from_date,
  {stamp("strptime(upper(strftime(o_orderdate, '%d%b%y:%H:%M:%S')), '%d%b%y:%H:%M:%S')")} AS from_compact,
  {stamp('o_orderdate')} AS from_seconds, floor(epoch(o_orderdate) / 60)::BIGINT AS minutes FROM orders""",
        "value_mapping": """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'other' END AS status,
  CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END AS strict_status,
  CASE WHEN o_totalprice > 200000 THEN 'T' ELSE 'F' END AS large, (o_orderpriority = '1-URGENT')::INTEGER AS urgent,
  replace(o_orderpriority, ' ', '') AS priority FROM orders""",
        "suffix_keys": """SELECT c_custkey, right(c_name, 5) AS suffix,
  c_mktsegment || '_' || c_nationkey || '_' || CASE WHEN c_acctbal > 0 THEN 'credit' ELSE 'nan' END AS joined FROM customer""",
        "equality_filter": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW'",
        "flatten_struct": """SELECT o_orderkey, o_custkey AS o_customer, o_orderstatus AS o_state_status, o_orderpriority AS o_state_priority FROM orders""",
        "masked_last_event": with_(EV, """SELECT user_id, event_id, CASE WHEN pos = n_user THEN '?' ELSE event_type END AS event_type,
  CASE WHEN pos = n_user THEN '?' ELSE props END AS props FROM gaps"""),
        "profile": profile_sql(),
        "distinct_counts": distinct_sql(),
        "binary_rule": binary_sql(),
        "events_per_year": "SELECT year(o_orderdate)::BIGINT AS year, count(*) AS n FROM orders GROUP BY 1",
        "median_codes": with_(measures_long() + ",\n" + median_levels("long") + f""",
codes AS MATERIALIZED (SELECT rid, {', '.join(f"max(CASE WHEN col = '{c}' THEN path END) AS c{i}" for i, c in enumerate(MEASURES))} FROM l5 GROUP BY rid)""",
            f"SELECT {LINE_KEY}, {', '.join(f'c{i} AS {c}' for i, c in enumerate(MEASURES))} FROM items JOIN codes USING (rid)"),
        "median_thresholds": with_(measures_long() + ",\n" + median_levels("long"),
            " UNION ALL ".join(f"SELECT col AS \"column\", path, round(CASE WHEN med < mx THEN med END, 6) AS threshold, (NOT med < mx)::INTEGER AS is_leaf FROM n{k}" for k in range(5))
            + " UNION ALL SELECT DISTINCT col, path, NULL, 1 FROM l5 WHERE length(path) = 5"),
        "event_codes": with_("long AS MATERIALIZED (SELECT 'value' AS col, event_id AS rid, value AS v FROM events),\n" + median_levels("long"),
                             "SELECT rid AS event_id, path AS code FROM l5"),
        "uniform_bins": uniform_sql(),
        "quantile_bins": with_(quantile_edges("lineitem"), f"SELECT {LINE_KEY}, {', '.join(bin_code(c, True, 'NULL') for c in MEASURES)} FROM lineitem i"),
        "apply_bins": with_("early AS MATERIALIZED (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01'), " + quantile_edges("early"),
                            f"SELECT {LINE_KEY}, {', '.join(bin_code(c, False, '0') for c in MEASURES)} FROM lineitem i"),
        "bin_edges": with_(quantile_edges("lineitem"), "SELECT col AS \"column\", ix AS edge_ix, round(e, 6) AS edge FROM edges"),
        "zscore": f"SELECT {LINE_KEY}, " + ", ".join(
            f"round(({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_samp({c}) FROM lineitem), 6) AS {c}" for c in MEASURES) + " FROM lineitem",
        "cell_tokens": with_(EVENT_CODES, "SELECT event_id, t0 AS k, t1 AS value, t2 AS Hour, t3 AS total_minutes_from_last, t4 AS is_error, t5 AS event_type FROM tok"),
        "row_text": with_(EVENT_CODES, "SELECT user_id, event_id, concat_ws(' ', t0, t1, t2, t3, t4, t5, '[ROW]') AS text FROM tok"),
        "row_text_named": with_(EV, f"SELECT user_id, event_id, {named_text()} AS text FROM gaps"),
        "separator_tokens": "SELECT event_id, event_type || ' COL ' || strftime(ts, '%m-%d') || ' COL ROW' AS tokens FROM events",
        "composite_token": "SELECT user_id, strftime(ts, '%m-%d') AS day, event_type || '_' || strftime(ts, '%m-%d') AS tokens FROM events",
        "atomic_layout": "SELECT user_id, event_type, strftime(ts, '%m-%d') AS day, strftime(ts, '%m-%d') AS label_day FROM events",
        "record_output": "SELECT event_id, user_id, event_type || ' ' || strftime(ts, '%m-%d') AS text, strftime(ts, '%m-%d') AS label FROM events",
        "vocabulary": with_(vocabulary_ctes(), f"SELECT token, id, coalesce(col_id, -1) AS col_id, coalesce(value, '') AS value, freq FROM (SELECT token, id::BIGINT AS id, {PARTS}, freq::BIGINT AS freq FROM vocab)"),
        "column_vocabulary": with_(EVENT_CODES + """,
firsts AS (SELECT token, min(i) AS c FROM cells WHERE i < 6 GROUP BY token)""",
            """SELECT token, (3 + row_number() OVER (ORDER BY c, token))::BIGINT AS id FROM firsts UNION ALL
SELECT * FROM (VALUES ('[UNK]', 0), ('[PAD]', 1), ('[BOS]', 2), ('[EOS]', 3)) s(token, id)"""),
        "tokens_by_column": with_(vocabulary_ctes() + f", parts AS (SELECT id, {PARTS} FROM vocab)",
                                  "SELECT col_id, value, id::BIGINT AS id FROM parts WHERE col_id IS NOT NULL"),
        "label_options": with_(vocabulary_ctes() + f", parts AS (SELECT id, {PARTS} FROM vocab)",
                               """SELECT (SELECT count(DISTINCT col_id) FROM parts) AS num_cols, col_id AS label_col, value, id::BIGINT AS id
FROM parts WHERE col_id = (SELECT max(col_id) FROM parts)"""),
        "vocabulary_metrics": with_(vocabulary_ctes(), "SELECT count(*) AS vocab_size, (count(*) > 0)::INTEGER AS is_initialized FROM vocab"),
        "encoded_rows": with_(vocabulary_ctes(), f"SELECT user_id, event_id, {joined('list(id ORDER BY i)')} AS input_ids FROM ids GROUP BY user_id, event_id"),
        "encoded_unknowns": with_(vocabulary_ctes(60), f"SELECT event_id, {joined('list(id ORDER BY i)')} AS input_ids FROM ids GROUP BY event_id"),
        "decoded_rows": with_(vocabulary_ctes(60), f"SELECT event_id, {joined('list(v.token ORDER BY i)')} AS tokens FROM ids JOIN vocab v USING (id) GROUP BY event_id"),
        "change_points": with_(LINES + """,
lagged AS MATERIALIZED (SELECT *, row_number() OVER w AS rn, lag(l_returnflag) OVER w AS f, lag(o_orderpriority) OVER w AS p FROM lines
  WINDOW w AS (PARTITION BY o_custkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey))""",
            f"""SELECT o_custkey, {LINE_KEY}, concat_ws(' ', CASE WHEN rn = 1 OR f <> l_returnflag THEN 'l_returnflag' END,
  CASE WHEN rn = 1 OR p <> o_orderpriority THEN 'o_orderpriority' END) AS changed FROM lagged"""),
        "interleaved_words": """SELECT o_orderkey, 0::BIGINT AS src, 0::BIGINT AS col_ix, o_orderstatus AS word FROM orders UNION ALL
SELECT o_orderkey, 0, 1, o_orderpriority FROM orders UNION ALL SELECT l_orderkey, 1, 0, l_returnflag FROM lineitem UNION ALL
SELECT l_orderkey, 1, 1, l_linestatus FROM lineitem""",
        "entity_split": with_(SPLIT, "SELECT user_id, event_id, split FROM events JOIN users USING (user_id)"),
        "run_ranges": with_("c AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)",
                            "SELECT user_id, (sum(n) OVER (ORDER BY user_id) - n)::BIGINT AS start, (sum(n) OVER (ORDER BY user_id))::BIGINT AS \"end\", n FROM c"),
        "restored_split": with_(SPLIT, "SELECT user_id, event_id, split AS side FROM events JOIN users USING (user_id)"),
        "sequences": with_(sequence_ctes() + "," + SPLIT, f"SELECT user_id, seq_idx, split, n_rows, {joined('iid')} AS input_ids FROM seqs JOIN users USING (user_id)"),
        "sequence_mask": with_(sequence_ctes(), f"SELECT {seq}, {joined('mask')} AS mask, {joined('list_transform(iid, lambda x: (x <> 0)::INTEGER)')} AS attention FROM seqs"),
        "shuffled_columns": with_(sequence_ctes(shuffle_rank(5)), f"SELECT {seq}, {joined('iid')} AS input_ids, {joined('mask')} AS mask FROM seqs"),
        "pinned_label": with_(sequence_ctes(pinned_rank()), f"SELECT {seq}, {joined('iid')} AS input_ids, {joined('mask')} AS mask FROM seqs"),
        "next_token_labels": with_(sequence_ctes(), f"""SELECT {seq}, {joined('list_transform(iid[2:], lambda x: CASE WHEN x = 0 THEN -100 ELSE x END)')} AS labels,
  {joined('list_transform(iid, lambda x: CASE WHEN x = 0 THEN -100 ELSE x END)')} AS plain_labels FROM seqs"""),
        "text_sequences": """SELECT conv_id, ((rn - 1) // 3)::BIGINT AS seq_idx, count(*) AS n_rows, string_agg(text, ' ' ORDER BY turn) AS text
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) GROUP BY 1, 2""",
        "wide_events": with_(EV, "SELECT user_id, ((pos - 1) // 5)::BIGINT AS seq_idx, " + ", ".join(
            f"max(CASE WHEN (pos - 1) % 5 = {i} THEN {f} END) AS e{i + 1}_{f}" for i in range(5) for f in ("event_type", "value"))
            + " FROM gaps GROUP BY 1, 2 HAVING count(*) = 5"),
        "corpus_size": with_(sequence_ctes() + "," + SPLIT, """SELECT split, count(DISTINCT user_id) AS users, count(*) AS sequences,
  sum(n_rows)::BIGINT AS events, sum(len(iid))::BIGINT AS tokens FROM seqs JOIN users USING (user_id) GROUP BY split"""),
        "masked_tokens": masked_tokens_sql(),
        "masked_labels": masked_labels_sql(),
        "target_positions": with_(sequence_ctes() + """,
spots AS MATERIALIZED (SELECT user_id, seq_idx, list_filter(range(len(mask)), lambda i: mask[i + 1] = 5) AS s, mask FROM seqs)""",
            f"SELECT {seq}, {joined('s')} AS label_positions, s[-1]::VARCHAR AS last_position, {joined('list_transform(mask, lambda m: (m = 5)::INTEGER)')} AS label_mask FROM spots"),
        "accuracy_variants": with_(scores_ctes(), "SELECT variant, count(*) AS rows, round(avg((pred = target)::INT), 9) AS accuracy FROM preds GROUP BY variant"),
        "auc_ovr": with_(scores_ctes() + AUC, "SELECT variant, c::BIGINT AS class_ix, np AS positives, nn AS negatives, round(auc, 9) AS auc FROM aucs"),
        "auc_macro": with_(scores_ctes() + AUC, "SELECT variant, round(avg(auc), 9) AS auc FROM aucs GROUP BY variant"),
        "f1_scores": with_(scores_ctes() + F1, """SELECT variant, round(2.0::DOUBLE * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 9) AS f1_micro,
  round(avg(2.0::DOUBLE * tp / (2 * tp + fp + fn)), 9) AS f1_macro,
  round(sum(2.0::DOUBLE * tp / (2 * tp + fp + fn) * (tp + fn)) / sum(tp + fn), 9) AS f1_weighted FROM cnt GROUP BY variant"""),
        "binary_f1": with_(scores_ctes(), """SELECT variant, round(2.0::DOUBLE * count(*) FILTER (probs[2] > 0.5 AND target = 1) /
  (2 * count(*) FILTER (probs[2] > 0.5 AND target = 1) + count(*) FILTER (probs[2] > 0.5 AND target <> 1) + count(*) FILTER (NOT probs[2] > 0.5 AND target = 1)), 9) AS f1_binary
FROM variants WHERE len(probs) = 2 GROUP BY variant"""),
        "column_accuracy": column_accuracy_sql(),
        "consolidated_metrics": with_(scores_ctes(), "SELECT user_id, pos, g::BIGINT AS group_ix, round(q0, 9) AS p0, round(q1, 9) AS p1 FROM flagged"),
        "softmax_scores": softmax_sql(),
        "softmax_check": with_(scores_ctes(), "SELECT user_id, pos, round(p0 + p1 + p2 + p3 + p4, 6) AS total FROM scores WHERE abs(p0 + p1 + p2 + p3 + p4 - 1) > 1e-6"),
        "batch_metrics": with_(scores_ctes() + BATCHES, "SELECT count(*) AS batches, sum(n)::BIGINT AS rows, round(avg(loss), 9) AS loss, round(sum(acc * n) / sum(n), 9) AS accuracy FROM per_user"),
        "run_row": with_(scores_ctes() + BATCHES, """SELECT count(*) AS eval_batches, sum(n)::BIGINT AS eval_rows, round(avg(loss), 9) AS eval_loss,
  round(sum(acc * n) / sum(n), 9) AS eval_accuracy, 'final_run' AS name, 10 AS seq_length, 'false' AS randomize_order,
  'first_run' AS train_name, 5 AS train_seq_length FROM per_user"""),
        "prompts": with_(TEXTS, """SELECT user_id, seq_idx, 'next type' AS question, string_split(words[-2], ':')[2] AS answer,
  array_to_string(list_filter(words[1:len(words) - 2], lambda w: NOT starts_with(w, string_split(words[-2], ':')[1])), ' ') AS user_prompt,
  'next type:' AS assistant_prompt FROM split_texts"""),
        "label_free_text": with_(TEXTS, "SELECT user_id, seq_idx, array_to_string(list_filter(words, lambda w: NOT starts_with(w, 'event_type')), ' ') AS text FROM split_texts"),
        "parsed_runs": with_(RUNS, f"SELECT o_orderkey, task_name, experiment_name, {stamp('o_orderdate')} AS creation_time, phase AS train_eval, short_name FROM parsed"),
        "latest_runs": with_(RUNS, f"""SELECT task_name, experiment_name, filename, {stamp('o_orderdate')} AS creation_time FROM (
  SELECT *, row_number() OVER (PARTITION BY task_name, experiment_name ORDER BY o_orderdate DESC, filename) AS rn FROM parsed WHERE phase = 'eval') WHERE rn = 1"""),
        "metric_summary": with_(METRICS, "SELECT dataset, randomized, masking, " + ", ".join(
            f"round({c}, 9) AS {c}" for m in ("auc_last", "auc_last_consolidated", "desired_metric") for c in (f"{m}_mean", f"{m}_std"))
            + ", auc_last_count, auc_last_consolidated_count FROM chosen"),
        "metric_pivot": with_(METRICS, """SELECT randomized, round(max(CASE WHEN masking = 0 THEN desired_metric_mean END), 9) AS unmasked,
  round(max(CASE WHEN masking = 1 THEN desired_metric_mean END), 9) AS masked FROM chosen WHERE dataset = 'EVAL_pretrain_ibm' GROUP BY randomized"""),
        "benchmark_union": with_(METRICS, f"""SELECT CASE dataset WHEN 'EVAL_pretrain_amazon_electronics' THEN 'Amazon Electronics'
  WHEN 'EVAL_pretrain_amazon_movies' THEN 'Amazon Movies' WHEN 'EVAL_pretrain_ibm' THEN 'Fraud Detection' END AS Dataset,
  CASE randomized WHEN 1 THEN 'Random order' ELSE 'Fixed order' END AS Method, round(desired_metric_mean, 9) AS Value, round(desired_metric_std, 9) AS Std
FROM chosen WHERE masking = 0 UNION ALL SELECT * FROM (VALUES {published_values()}) p(a, b, c, d)"""),
        "setup_first_rows": """SELECT o_orderkey, o_custkey, setup FROM (
  SELECT *, 'randomize=' || o_orderstatus || '/mask=' || substr(o_orderpriority, 1, 1) AS setup, row_number() OVER (
    PARTITION BY o_custkey, o_orderstatus, substr(o_orderpriority, 1, 1) ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""",
        "top_rows": f"SELECT o_orderkey, o_custkey, {stamp('o_orderdate')} AS day FROM orders ORDER BY o_custkey, day, o_orderkey LIMIT 25",
        "io_roundtrip": f"SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, {stamp('o_orderdate')} AS o_orderdate, o_orderpriority FROM orders",
        "metrics_append": """SELECT o_orderstatus, count(*) AS n, (-1)::BIGINT AS last_key FROM orders GROUP BY 1 UNION ALL
SELECT o_orderstatus, count(*), max(o_orderkey) FROM orders GROUP BY 1""",
    }
    row_split = f"""
rs AS MATERIALIZED (SELECT user_id, event_id, CASE WHEN rn <= greatest(1, floor(n * 0.1)) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT user_id, event_id, row_number() OVER (ORDER BY md5(event_id::VARCHAR || '|{SEED}'), event_id::VARCHAR) AS rn, count(*) OVER () AS n FROM events))"""
    q["row_split"] = with_(row_split, "SELECT user_id, event_id, split FROM rs")
    q["split_overlap"] = with_(row_split, """SELECT DISTINCT user_id, CASE WHEN user_id IN (SELECT user_id FROM rs WHERE split = 'train')
  THEN 'both' ELSE 'test_only' END AS kind FROM rs WHERE split = 'test'""")
    return q


CHURN_ROWS = LINES + """,
raw AS MATERIALIZED (SELECT o_custkey, l_linenumber, l_linestatus, l_suppkey, floor(epoch(date_trunc('second', l_shipdate)) / 60)::BIGINT AS m, l_extendedprice,
  o_orderpriority, l_returnflag, concat_ws('-', l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS line_no FROM lines)"""

RESULTS = """
named AS (SELECT *, 'final_' || CASE o_orderpriority WHEN '1-URGENT' THEN 'amazon_electronics' WHEN '2-HIGH' THEN 'amazon_movies'
    WHEN '3-MEDIUM' THEN 'ibm' WHEN '4-NOT SPECIFIED' THEN 'loans' ELSE 'churn' END ||
    CASE o_orderstatus WHEN 'F' THEN '_masked_randomized' ELSE '' END AS name FROM orders),
results AS MATERIALIZED (SELECT o_orderkey AS step, name, CASE WHEN o_orderstatus = 'F' THEN -1 ELSE o_custkey END AS rows,
  CASE WHEN o_orderstatus = 'F' THEN 'a "b"' || chr(9) || o_orderpriority ELSE '' END AS note, year(o_orderdate) AS y, o_orderstatus = 'O' AS training,
  'table-' || name || '-' || year(o_orderdate) || '-01-01-00-00-' || CASE WHEN o_orderstatus = 'O' THEN 'train' ELSE 'eval' END || '_stats.csv' AS filename FROM named)"""

#: Task and experiment: the first three words of a run's name, and the rest.
LATEST_RESULTS = """,
parted AS (SELECT *, array_to_string(string_split(name, '_')[1:3], '_') AS task, array_to_string(string_split(name, '_')[4:], '_') AS experiment FROM results
  WHERE NOT training)"""

MANIFESTS = f"""
runs_ AS MATERIALIZED (SELECT DISTINCT CASE event_type WHEN 'click' THEN 'always_click' WHEN 'error' THEN 'sometimes_randomize_error'
  WHEN 'view' THEN 'randomize_view' ELSE event_type END AS run, user_id FROM events),
{SPLIT},
told AS (SELECT *, run IN ('always_click', 'sometimes_randomize_error', 'view') AS old FROM runs_ JOIN users USING (user_id))"""

#: Queries whose result is that of another one, reached by another way.
SAME = {"time_gaps_cut": "time_gaps", "change_points_cut": "change_points", "encoder_reload": "encoded_rows",
        "manifest_roundtrip": "restored_split", "softmax_scores_spread": "softmax_scores", "gzip_csv": "io_roundtrip", "archive_member": "io_roundtrip", "gzip_json_lines": "io_roundtrip"}


def oracle() -> dict[str, str]:
    stamp = lambda e: f"strftime({e}, '%Y-%m-%d %H:%M:%S')"
    found = _oracle()
    return found | {new: found[old] for new, old in SAME.items()} | {
        "median_codes_unlimited": with_(unlimited_levels("lineitem", ["l_extendedprice", "l_quantity"]),
            f"SELECT {LINE_KEY}, p.path AS l_extendedprice, q.path AS l_quantity FROM lineitem i "
            "JOIN leaves p ON p.col = 'l_extendedprice' AND i.l_extendedprice > p.above AND i.l_extendedprice <= p.until "
            "JOIN leaves q ON q.col = 'l_quantity' AND i.l_quantity > q.above AND i.l_quantity <= q.until"),
        "median_codes_unseen": with_(unlimited_levels("(SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01')", ["l_extendedprice"]),
            f"SELECT {LINE_KEY}, p.path AS l_extendedprice FROM lineitem i JOIN leaves p ON i.l_extendedprice > p.above AND i.l_extendedprice <= p.until"),
        "entity_layout": f"SELECT user_id, event_id, {stamp('ts')} AS ts FROM events",
        "sample_sink": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 1000",
        "churn_rows": with_(CHURN_ROWS, """SELECT o_custkey::BIGINT AS "User", replace(o_orderpriority, ' ', '') AS trx_category, l_linenumber::VARCHAR AS "MCC", l_linestatus AS channel_type,
  l_suppkey::VARCHAR AS currency, l_extendedprice AS amount, coalesce(m - lag(m) OVER (PARTITION BY o_custkey ORDER BY m, line_no), 0)::DOUBLE AS total_minutes_from_last,
  (l_returnflag = 'R')::INTEGER AS target_flag, m AS total_minutes FROM raw"""),
        "class_table": with_(vocabulary_ctes() + f", parts AS (SELECT id, {PARTS} FROM vocab)",
            """SELECT col_id, row_number() OVER (PARTITION BY col_id ORDER BY id) - 1 AS class_ix, id::BIGINT AS id, value,
  CASE WHEN col_id = 5 AND value IN ('click', 'view') THEN 0 WHEN col_id = 5 THEN 1 ELSE -1 END::BIGINT AS group_ix FROM parts WHERE col_id IS NOT NULL"""),
        "group_mismatches": """SELECT 5::BIGINT AS col_id, event_type AS value, 'no group' AS problem FROM events
WHERE event_type NOT IN ('click', 'error', 'view', 'signup', 'refund') GROUP BY event_type UNION ALL
SELECT 5, v, 'no class' FROM (VALUES ('click'), ('error'), ('view'), ('signup'), ('refund')) m(v) WHERE v NOT IN (SELECT event_type FROM events)""",
        "time_gaps_by_text": with_(EV, """SELECT user_id, event_id, coalesce(m - lag(m) OVER (PARTITION BY user_id ORDER BY event_type, event_id::VARCHAR), 0)::BIGINT
  AS total_minutes_from_last FROM ev"""),
        "last_event_of_a_day": """SELECT strftime(ts, '%Y-%m-%d') AS day, event_id, CASE WHEN last THEN '?' ELSE event_type END AS event_type,
  CASE WHEN last THEN '?' ELSE props END AS props FROM (SELECT *, event_id = max(event_id) OVER (PARTITION BY ts::DATE) AS last FROM events)""",
        "all_results": with_(RESULTS, "SELECT step, name, rows, note, filename FROM results"),
        "latest_results": with_(RESULTS + LATEST_RESULTS, """SELECT step, name, rows, note, filename, CASE WHEN experiment = '' THEN 'Base' ELSE experiment END AS experiment_name
FROM parted QUALIFY y = max(y) OVER (PARTITION BY task, experiment)"""),
        "stored_manifests": with_(MANIFESTS, """SELECT run, CASE WHEN old THEN run ELSE 'saved_' || run END AS saved_name,
  (old AND contains(run, 'randomize'))::INTEGER AS randomize_order,
  CASE WHEN NOT old THEN 0.5 WHEN contains(run, 'always') THEN 1.0 WHEN contains(run, 'sometimes') THEN 0.25 ELSE 0.0 END::DOUBLE AS mask_all_pct,
  CASE WHEN NOT old THEN 0.125 WHEN contains(run, 'sometimes') THEN 0.25 ELSE 0.0 END::DOUBLE AS mask_each_pct, user_id, split FROM told"""),
        "scored_label_sink": with_(scores_ctes(), "SELECT user_id, pos, t::BIGINT AS label, p0, p1, p2, p3, p4 FROM scores")}
