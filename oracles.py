"""ANSI SQL that DuckDB runs on the same tables, one text per registered query."""

from __future__ import annotations

from ledgerloom import contract as C
from queries import ANALYSIS_OUTPUT, DERIVED_RULES, FACT_COLUMNS, QTY_OUTPUT

SPACES = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(133) || chr(160) || chr(12288)"
PERIODS = """periods AS (SELECT o_orderkey, CASE o_orderkey % 5
    WHEN 0 THEN concat(year(o_orderdate), '年', month(o_orderdate), '期')
    WHEN 1 THEN strftime(o_orderdate, '%Y%m')
    WHEN 2 THEN concat('　', strftime(o_orderdate, '%Y-%m'), ' ')
    WHEN 3 THEN concat(year(o_orderdate), '年期') ELSE '  ' END AS raw_text FROM orders),
  digits AS (SELECT *, trim(raw_text, chr(12288) || ' ') AS t, regexp_replace(raw_text, '[^0-9]', '', 'g') AS d FROM periods),
  keyed AS (SELECT *, CASE WHEN length(d) >= 5 AND TRY_CAST(substr(d, 5, 2) AS INT) BETWEEN 1 AND 12
      THEN substr(d, 1, 4) || '-' || lpad(CAST(CAST(substr(d, 5, 2) AS INT) AS VARCHAR), 2, '0') END AS period_key
    FROM digits),
  labelled AS (SELECT o_orderkey, period_key, CASE WHEN t = '' THEN NULL
      WHEN t LIKE '%年%' AND t LIKE '%期%' AND period_key IS NOT NULL
      THEN substr(period_key, 1, 4) || '年' || substr(period_key, 6, 2) || '期' ELSE t END AS month_label FROM keyed)"""
EVENTS = """ev AS (SELECT event_id,
    CASE WHEN user_id % 3 = 0 THEN event_type ELSE '  ' END AS kind,
    CASE WHEN user_id % 3 = 0 THEN event_type END AS known,
    CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) END AS paid,
    CASE WHEN event_type IN ('view', 'click') THEN concat('u', user_id) END AS actor FROM events)"""
SO_FAR = "(ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

# ------------------------------------------------------------------ the derived ledger
LEDGER = """li AS (SELECT *, row_number() OVER () - 1 AS rn FROM lineitem),
priced AS (SELECT *, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents
  FROM li JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
base AS (SELECT *, cents * (35 + l_partkey % 13) // 100 AS material, cents * (5 + l_partkey % 11) // 100 AS labor,
  cents * (3 + l_suppkey % 7) // 100 AS other, cents * (2 + l_linenumber) // 100 AS moh_labor,
  cents * (1 + l_orderkey % 5) // 100 AS consumables, cents * (1 + (l_partkey + l_suppkey) % 3) // 100 AS even FROM priced),
raw AS (SELECT rn * 16 + step AS id, step,
  CASE step WHEN 0 THEN concat(year(o_orderdate), '年', month(o_orderdate), '期') WHEN 11 THEN '合计' END AS period,
  CASE WHEN step = 0 THEN CASE WHEN l_suppkey % 7 = 0 THEN NULL WHEN l_suppkey % 5 = 0 THEN '集成车间'
    ELSE concat('车间', l_suppkey % 5) END END AS center,
  CASE WHEN step = 0 THEN p_brand END AS code, CASE WHEN step = 0 THEN p_type END AS name,
  CASE WHEN step = 0 THEN concat('S', p_size) END AS spec,
  CASE WHEN step = 0 THEN CAST(l_orderkey AS VARCHAR) END AS order_no,
  CASE WHEN step = 0 THEN concat(l_linenumber, CASE WHEN l_suppkey % 2 = 0 THEN '.0' ELSE '' END) END AS line,
  CASE WHEN step = 0 AND l_suppkey % 3 = 0 THEN concat('V', l_suppkey) END AS vcode,
  CASE WHEN step = 0 AND l_suppkey % 4 = 0 THEN concat('N', l_suppkey) END AS vname,
  CASE WHEN step = 0 THEN CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN '汇报入库-普通生产'
    WHEN '2' THEN '汇报入库-普通生产' WHEN '3' THEN '直接入库-普通生产' WHEN '4' THEN '汇报入库-返工生产'
    ELSE '其他入库' END END AS doc,
  CASE WHEN step = 2 THEN concat('M', l_partkey) END AS child,
  CASE step WHEN 1 THEN '直接材料' WHEN 3 THEN '直接人工' WHEN 4 THEN '制造费用_其他' WHEN 5 THEN '制造费用-人工'
    WHEN 6 THEN '制造费用_机物料及低耗'
    WHEN 7 THEN CASE WHEN l_partkey % 41 = 0 THEN '制造费用_未分类' ELSE '制造费用_折旧' END
    WHEN 8 THEN '制造费用_水电费' WHEN 9 THEN '委外加工费'
    WHEN 10 THEN CASE WHEN l_partkey % 31 = 0 THEN '未映射费用' ELSE '软件费用' END END AS item,
  CASE WHEN step = 0 AND l_orderkey % 97 <> 0 THEN CASE WHEN l_orderkey % 89 = 0 THEN 0
    ELSE CAST(l_quantity AS DECIMAL(18,6)) END END AS qty,
  CAST(CAST(CASE step
    WHEN 0 THEN CASE WHEN l_orderkey % 83 = 0 THEN NULL WHEN l_orderkey % 13 = 0 THEN cents + 1 ELSE cents END
    WHEN 1 THEN material WHEN 2 THEN material
    WHEN 3 THEN CASE WHEN l_partkey % 53 = 0 THEN NULL ELSE labor END
    WHEN 4 THEN other WHEN 5 THEN moh_labor WHEN 6 THEN consumables WHEN 7 THEN even WHEN 8 THEN even
    WHEN 9 THEN cents // 25
    WHEN 10 THEN cents - material - labor - other - moh_labor - consumables - even * 2 - cents // 25
    ELSE cents END AS DECIMAL(18,0)) * 0.01 AS DECIMAL(28,10)) AS amount
  FROM base, range(0, 12) AS s(step)),
kept AS (SELECT * FROM raw WHERE NOT coalesce(contains(period, '合计'), false)),
fill1 AS (SELECT id, step, child, item, qty, amount, vcode, vname,
  last_value(period IGNORE NULLS) OVER w AS period, last_value(center IGNORE NULLS) OVER w AS center,
  last_value(code IGNORE NULLS) OVER w AS code, last_value(name IGNORE NULLS) OVER w AS name,
  last_value(spec IGNORE NULLS) OVER w AS spec, last_value(order_no IGNORE NULLS) OVER w AS order_no,
  last_value(line IGNORE NULLS) OVER w AS line, last_value(doc IGNORE NULLS) OVER w AS doc,
  last_value(item IGNORE NULLS) OVER w AS filled_item
  FROM kept WINDOW w AS (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
fill2 AS (SELECT * EXCLUDE (vcode, vname),
  CASE WHEN shut THEN vcode ELSE last_value(CASE WHEN NOT shut THEN vcode END IGNORE NULLS) OVER w END AS vcode,
  CASE WHEN shut THEN vname ELSE last_value(CASE WHEN NOT shut THEN vname END IGNORE NULLS) OVER w END AS vname
  FROM (SELECT *, coalesce(center = '集成车间', false) AS shut FROM fill1)
  WINDOW w AS (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
labelled_rows AS (SELECT *, substr(period, 1, 4) || '年' || lpad(regexp_extract(period, '年([0-9]+)期', 1), 2, '0') || '期'
  AS month FROM fill2),
in_range AS (SELECT * FROM labelled_rows WHERE __RANGE__),
routed AS (SELECT *, CASE WHEN route = 'detail' THEN filled_item ELSE item END AS item_now,
  concat_ws('|', month, code, order_no, regexp_replace(line, '^([0-9]+)\\.0$', '\\1')) AS work_order_key
  FROM (SELECT *, CASE WHEN child IS NULL AND item IS NULL AND order_no IS NOT NULL THEN 'qty'
    WHEN child IS NOT NULL OR (item IS NOT NULL AND item <> '直接材料') THEN 'detail' ELSE 'other' END AS route
  FROM in_range)),
detail AS (SELECT *, CASE WHEN item_now = '直接材料' THEN 'dm' WHEN item_now = '直接人工' THEN 'dl'
  WHEN item_now = '制造费用_其他' THEN 'moh_other' WHEN item_now = '制造费用-人工' THEN 'moh_labor'
  WHEN item_now = '制造费用_机物料及低耗' THEN 'moh_consumables' WHEN item_now = '制造费用_折旧' THEN 'moh_depreciation'
  WHEN item_now = '制造费用_水电费' THEN 'moh_utilities' WHEN item_now LIKE '制造费用%' THEN 'moh'
  WHEN item_now = '委外加工费' THEN 'standalone_0' WHEN item_now = '软件费用' THEN 'standalone_1' END AS bucket
  FROM routed WHERE route = 'detail')"""


def _sum(bucket: str) -> str:
    test = "bucket LIKE 'moh%'" if bucket == "moh" else f"bucket = '{bucket}'"
    return f"CAST(coalesce(sum(CASE WHEN {test} THEN amount END), 0) AS DECIMAL(28,10)) AS {bucket}"


BUCKETS = tuple(c for c in FACT_COLUMNS if c != "key_rows")
EXPRESSION = DERIVED_RULES.total_expression
FACTS = f"""amounts AS (SELECT work_order_key, {", ".join(_sum(b) for b in BUCKETS)}
  FROM detail WHERE bucket IS NOT NULL GROUP BY work_order_key),
tested AS (SELECT *, CASE WHEN qty IS NULL OR qty <= 0 THEN 'invalid_qty' WHEN amount IS NULL THEN 'missing_total'
  ELSE 'valid' END AS validity FROM routed WHERE route = 'qty'),
valid AS (SELECT *, count(*) OVER (PARTITION BY work_order_key) AS key_rows,
  row_number() OVER (PARTITION BY work_order_key ORDER BY id) = 1 AS is_first FROM tested WHERE validity = 'valid'),
joined AS (SELECT v.*, {", ".join(f"CAST(coalesce(a.{b}, 0) AS DECIMAL(28,10)) AS {b}" for b in BUCKETS)}
  FROM valid v LEFT JOIN amounts a ON v.work_order_key = a.work_order_key),
summed AS (SELECT *,
  CAST(moh_other + moh_labor + moh_consumables + moh_depreciation + moh_utilities AS DECIMAL(28,10)) AS moh_components,
  CAST(dm + dl + moh + standalone_0 + standalone_1 AS DECIMAL(28,10)) AS derived_total FROM joined),
facts AS (SELECT *, moh_components = moh AS moh_matches, derived_total = amount AS total_matches,
  concat_ws(';', CASE WHEN moh_components <> moh THEN '{C.MOH_CHECK_REASON}' END,
    CASE WHEN derived_total <> amount THEN '{EXPRESSION}{C.TOTAL_CHECK_SUFFIX}' END) AS check_reason,
  CAST(amount AS DOUBLE) / CAST(qty AS DOUBLE) AS unit_total,
  {", ".join(f"CAST({b} AS DOUBLE) / CAST(qty AS DOUBLE) AS unit_{b}" for b in BUCKETS)},
  CASE doc WHEN '汇报入库-普通生产' THEN '正常生产' WHEN '直接入库-普通生产' THEN '正常生产'
    WHEN '汇报入库-返工生产' THEN '返工生产' ELSE '未归类' END AS scope FROM summed),
fit AS (SELECT *, qty > 0 AND unit_total > 0 AND scope <> '未归类' AS can_analyze FROM facts)"""


def _plain(x: str) -> str:
    text = f"CAST({x} AS VARCHAR)"
    return f"CASE WHEN contains({text}, '.') THEN regexp_replace({text}, '\\.?0+$', '') ELSE {text} END"


def _issue(kind, cond, value, phase, seq, source, field=None, reason=None):
    name, text, action = C.ISSUES[kind]
    return f"""SELECT {phase} AS phase, id AS source_row, {seq} AS seq, work_order_key AS row_id, '{kind}' AS issue_type,
  '{field or name}' AS field_name, {value} AS original_value, '{reason or text}' AS reason, '{action}' AS action
  FROM {source} WHERE {cond}"""


def _issue_rows() -> str:
    parts = [
        _issue("UNMAPPED_COST_ITEM", "bucket IS NULL", "item_now", 0, 0, "detail"),
        _issue("MISSING_AMOUNT", "bucket IS NOT NULL AND amount IS NULL", "''", 0, 0, "detail"),
        _issue("DUPLICATE_WORK_ORDER_KEY", "key_rows > 1", "CAST(key_rows AS VARCHAR)", 1, 0, "facts"),
        _issue(
            "MOH_BREAKDOWN_MISMATCH", "NOT moh_matches",
            f"'明细合计=' || {_plain('moh_components')} || ';制造费用=' || {_plain('moh')}", 2, 0, "facts",
        ),
        _issue(
            "TOTAL_COST_MISMATCH", "NOT total_matches",
            f"'计算值=' || {_plain('derived_total')} || ';数量页=' || {_plain('amount')}", 2, 1, "facts",
            reason=EXPRESSION + C.ISSUES["TOTAL_COST_MISMATCH"][1],
        ),
    ]
    for seq, (m, (label, _, _)) in enumerate(C.METRICS.items()):
        parts.append(
            _issue("NON_POSITIVE_UNIT_COST", f"is_first AND unit_{m} <= 0", "'0'", 3, seq, "facts", field=label)
        )
    return "issues AS (" + "\nUNION ALL ".join(parts) + ")"


ISSUES = _issue_rows()


def _weighted(source: str, pool: str, value: str, weight: str, name: str) -> str:
    """Weighted median by a plain running sum: the first value with more than half the weight."""
    return f"""(SELECT {pool}, min(v) AS {name}, any_value(pool_rows) AS pool_rows FROM (
    SELECT {pool}, v, sum(w) OVER (PARTITION BY {pool} ORDER BY v) AS upto, sum(w) OVER (PARTITION BY {pool}) AS total,
      sum(n) OVER (PARTITION BY {pool}) AS pool_rows
    FROM (SELECT {pool}, {value} AS v, sum({weight}) AS w, count(*) AS n FROM {source} GROUP BY ALL))
  WHERE upto * 2 > total GROUP BY ALL)"""


LISTED = ", ".join(f"('{code}', '{name}', {i})" for i, (code, name, _) in enumerate(DERIVED_RULES.products))
METRIC_NAMES = ", ".join(f"('{m}', {i})" for i, m in enumerate(C.METRICS))
UNIT_OF = "CASE metric " + " ".join(f"WHEN '{m}' THEN unit_{m}" for m in C.METRICS) + " END"
POOL = "code, name, scope, metric"
SCORES = f"""listed(code, name, product_rank) AS (VALUES {LISTED}),
work_orders AS (SELECT * FROM fit JOIN listed USING (code, name) WHERE is_first),
long AS (SELECT *, ln(unit) AS lg FROM (SELECT id, code, name, scope, qty, metric, {UNIT_OF} AS unit
  FROM work_orders, (VALUES {METRIC_NAMES}) AS m(metric, place) WHERE can_analyze) WHERE unit > 0),
centers AS (SELECT * FROM {_weighted("long", POOL, "lg", "qty", "center")} WHERE pool_rows >= 3),
gaps AS (SELECT {POOL}, qty, abs(lg - center) AS gap FROM long JOIN centers USING ({POOL})),
mads AS {_weighted("gaps", POOL, "gap", "qty", "mad")},
scores AS (SELECT id, metric, unit, lg, center, mad, c.pool_rows AS n, greatest(mad, {C.MIN_LOG_MAD}) AS mad_eff,
  {C.Z_SCALE}::DOUBLE * (lg - center) / greatest(mad, {C.MIN_LOG_MAD}) AS z
  FROM long JOIN centers c USING ({POOL}) JOIN mads USING ({POOL}))"""
LABELS = "CASE metric " + " ".join(f"WHEN '{m}' THEN '{C.METRICS[m][1]}'" for m in C.METRICS) + " END"
VERDICT = f"""tops AS (SELECT id, max(abs(z)) AS z_max FROM scores GROUP BY id),
winners AS (SELECT id, any_value(z_max) AS z_max, count(*) AS n, bool_or(metric = 'total') AS has_total, min({LABELS}) AS label
  FROM scores JOIN tops USING (id) WHERE abs(z) = z_max GROUP BY id),
verdicts AS (SELECT w.*, CASE WHEN scope = '未归类' THEN '' WHEN z_max > 3.5 THEN '高度可疑' WHEN z_max > 2.5 THEN '关注'
    ELSE '正常' END AS anomaly_level,
  CASE WHEN scope = '未归类' OR z_max IS NULL OR z_max <= 2.5 THEN '' WHEN has_total THEN '总成本异常'
    WHEN n > 1 THEN '多项同时异常' ELSE label END AS anomaly_source
  FROM work_orders w LEFT JOIN winners USING (id))"""
REASONS = ", ".join(
    f"CASE WHEN unit_{m} <= 0 THEN '{C.METRICS[m][0]}{C.NON_POSITIVE_SUFFIX}' END" for m in C.METRICS
)

PRICES = """prices AS (SELECT l_orderkey, l_linenumber, l_partkey, p_brand, p_type, CAST(l_quantity AS DECIMAL(18,6)) AS weight,
  l_extendedprice / l_quantity AS price, ln(l_extendedprice / l_quantity) AS lp
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
PRICE_STATS = f"""centers AS {_weighted("prices", "p_brand, p_type", "lp", "weight", "center")},
gaps AS (SELECT p_brand, p_type, weight, abs(lp - center) AS gap FROM prices JOIN centers USING (p_brand, p_type)),
mads AS {_weighted("gaps", "p_brand, p_type", "gap", "weight", "mad")}"""
PRICE_Z = f"""scored AS (SELECT p.*, CASE WHEN c.pool_rows >= 3
  THEN {C.Z_SCALE}::DOUBLE * (lp - center) / greatest(mad, {C.MIN_LOG_MAD}) END AS z
  FROM prices p LEFT JOIN centers c USING (p_brand, p_type) LEFT JOIN mads USING (p_brand, p_type))"""

VERSIONS = """e AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, CAST(o_totalprice AS DECIMAL(28,10)) AS price, o_custkey
  FROM orders),
a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 41 = 0 THEN concat(o_orderpriority, '!') ELSE o_orderpriority END AS o_orderpriority,
  CAST(CASE WHEN o_orderkey % 29 = 0 THEN price + 0.0000001 WHEN o_orderkey % 31 = 0 THEN price + 0.0000000001
    ELSE price END AS DECIMAL(28,10)) AS price, o_custkey FROM e WHERE o_orderkey % 101 <> 0)"""


def _cells() -> str:
    parts = []
    for c, kind in (("o_orderstatus", "s"), ("o_orderpriority", "s"), ("price", "n"), ("o_custkey", "n")):
        differ = f"abs(e.{c} - a.{c}) > 1e-9" if kind == "n" else f"e.{c} <> a.{c}"
        parts.append(
            f"""SELECT o_orderkey, '{c}' AS column_name,
  CASE WHEN (e.{c} IS NULL) <> (a.{c} IS NULL) THEN 'storage_type_mismatch' WHEN {differ} THEN 'value_mismatch' END AS mismatch_kind,
  CASE WHEN e.{c} IS NULL THEN 'blank' ELSE '{kind}' END AS expected_type,
  CASE WHEN a.{c} IS NULL THEN 'blank' ELSE '{kind}' END AS actual_type FROM e FULL JOIN a USING (o_orderkey)"""
        )
    return "cells AS (SELECT * FROM (" + "\nUNION ALL ".join(parts) + ") WHERE mismatch_kind IS NOT NULL)"


CELLS = _cells()
LINE_KEYS = """keys AS (SELECT l_orderkey, CASE WHEN l_partkey % 19 = 0 THEN '　' ELSE CAST(l_linenumber AS VARCHAR) END AS line,
  CASE WHEN l_partkey % 23 = 0 THEN 'n/a' WHEN l_partkey % 17 = 0 THEN NULL ELSE CAST(l_partkey AS VARCHAR) END AS note
  FROM lineitem)"""
PRODUCTS = """dim AS (SELECT p_partkey AS position,
  CASE WHEN p_partkey % 43 = 0 THEN concat(p_brand, ' ') WHEN p_partkey % 47 = 0 THEN ' '
    ELSE concat('P', p_partkey // 2 * 2 + CASE WHEN p_partkey % 10 = 1 THEN 0 ELSE p_partkey % 2 END) END AS code,
  p_name AS name, CAST(CASE WHEN p_partkey % 59 = 58 THEN p_partkey - 1 ELSE p_partkey END AS INT) AS display_order
  FROM part)"""

ALL, SOME = "true", "month BETWEEN '1996年03期' AND '1998年07期'"


def ledger(*more: str, select: str, rows: str = ALL) -> str:
    return "WITH " + ",\n".join((LEDGER.replace("__RANGE__", rows), *more)) + "\n" + select


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


COUNTS = """counts AS (SELECT
  (SELECT count(*) FROM raw) AS reader_rows, (SELECT count(*) FROM routed) AS ledger_rows,
  (SELECT count(*) FROM detail) AS detail_rows, (SELECT count(*) FROM tested) AS qty_input_rows,
  (SELECT count(*) FROM tested WHERE validity = 'invalid_qty') AS invalid_qty_rows,
  (SELECT count(*) FROM tested WHERE validity = 'missing_total') AS missing_total_rows,
  (SELECT count(*) FROM tested WHERE validity = 'out_of_range') AS out_of_range_rows,
  (SELECT count(*) FROM fit) AS qty_output_rows, (SELECT count(DISTINCT work_order_key) FROM fit) AS work_orders,
  (SELECT count(*) FROM fit WHERE key_rows > 1) AS duplicate_rows, (SELECT count(*) FROM fit WHERE qty <= 0) AS non_positive_rows,
  (SELECT count(*) FROM fit WHERE is_first AND qty > 0 AND amount > 0 AND scope <> '未归类') AS analyzable)"""


def _quality() -> str:
    names = (
        "detail_rows", "qty_input_rows", "qty_output_rows", "invalid_qty_rows", "missing_total_rows", "work_orders",
        None, "duplicate_rows", "non_positive_rows", None,
    )
    rows = []
    for i, (category, metric, text) in enumerate(C.QUALITY_METRICS):
        value = f"CAST({names[i]} AS VARCHAR)" if names[i] else "'0.00%'"
        if i == 9:
            value = "printf('%.2f%%', CASE WHEN work_orders > 0 THEN analyzable / work_orders ELSE 0 END * 100)"
        rows.append(
            f"SELECT {i} AS position, '{category}' AS category, '{metric}' AS metric, {value} AS value, "
            f"'{text}' AS description FROM counts"
        )
    return "quality AS (" + "\nUNION ALL ".join(rows) + ")"


QUALITY = _quality()


def both_runs() -> str:
    """Metrics and issue counts of the whole and of the month-filtered run, side by side."""
    parts = []
    for tag, rows in (("w", ALL), ("s", SOME)):
        inner = ledger(FACTS, COUNTS, QUALITY, select="SELECT category, metric, value FROM quality", rows=rows)
        counts = ledger(FACTS, ISSUES, select="SELECT issue_type, count(*) AS n FROM issues GROUP BY 1", rows=rows)
        parts += [f"{tag}_metrics AS ({inner})", f"{tag}_issues AS ({counts})"]
    return (
        "WITH " + ",\n".join(parts) + """
SELECT 'metric_mismatch' AS error, category || '/' || metric AS subject
  FROM w_metrics w JOIN s_metrics s USING (category, metric) WHERE w.value <> s.value
UNION ALL SELECT 'issue_count_mismatch', issue_type FROM w_issues w FULL JOIN s_issues s USING (issue_type)
  WHERE coalesce(w.n, 0) <> coalesce(s.n, 0)
UNION ALL SELECT 'issue_total_mismatch', ''
  WHERE (SELECT coalesce(sum(n), 0) FROM w_issues) <> (SELECT coalesce(sum(n), 0) FROM s_issues)"""
    )


def all_oracles() -> dict[str, str]:
    unit_cols = ", ".join(f"round(unit_{m}, 8) AS unit_{m}" for m in (*C.METRICS, "standalone_0", "standalone_1"))
    z_cols = ", ".join(f"round(max(CASE WHEN metric = '{m}' THEN z END), 6) AS z_{m}" for m in C.METRICS)
    qty_values = dict(
        zip(
            QTY_OUTPUT.values(),
            (
                "month", "center", "code", "name", "spec", "order_no", "line", "dm", "moh", "standalone_1",
                "CASE WHEN moh_matches THEN '是' ELSE '否' END", "CASE WHEN total_matches THEN '是' ELSE '否' END",
                "CASE WHEN check_reason = '' THEN '通过' ELSE '需复核' END", "check_reason",
            ),
            strict=True,
        )
    )
    analysis_values = dict(
        zip(
            ANALYSIS_OUTPUT.values(),
            (
                "month", "center", "code", "name", "order_no", "line", "scope", "qty", "amount", "dl", "standalone_0",
                "CASE WHEN can_analyze THEN '是' ELSE '否' END", "anomaly_level", "anomaly_source",
            ),
            strict=True,
        )
    )

    def named(values: dict[str, str]) -> str:
        return ", ".join(f"{v} AS {k}" for k, v in values.items())

    texts = {
        "total_row_filter": "SELECT o_orderkey, o_orderpriority FROM orders WHERE NOT contains(o_orderpriority, 'LOW')",
        "period_key_label": with_(PERIODS, select="SELECT o_orderkey, period_key, month_label FROM labelled"),
        "month_range_filter": with_(
            PERIODS,
            select="SELECT o_orderkey, month_label FROM labelled WHERE period_key BETWEEN '1996-03' AND '1998-07'",
        ),
        "ordered_fill_events": with_(
            EVENTS,
            select=f"SELECT event_id, last_value(paid IGNORE NULLS) OVER {SO_FAR} AS paid, "
            f"last_value(actor IGNORE NULLS) OVER {SO_FAR} AS actor FROM ev",
        ),
        "conditional_fill": with_(
            EVENTS,
            f"one AS (SELECT event_id, coalesce(last_value(known IGNORE NULLS) OVER {SO_FAR}, kind) AS kind, actor FROM ev)",
            "two AS (SELECT *, kind = 'error' AS shut FROM one)",
            select="SELECT event_id, kind, CASE WHEN shut THEN actor ELSE "
            f"last_value(CASE WHEN NOT shut THEN actor END IGNORE NULLS) OVER {SO_FAR} END AS actor FROM two",
        ),
        "filled_cost_item": with_(
            EVENTS,
            select="SELECT event_id, trim(kind) AS kind, "
            f"last_value(known IGNORE NULLS) OVER {SO_FAR} AS filled_kind FROM ev",
        ),
        "key_normalize": """SELECT c_custkey, concat_ws('|', c_name,
            CASE WHEN c_custkey % 3 = 2 THEN concat(c_custkey, '.00') ELSE CAST(c_custkey AS VARCHAR) END,
            CASE WHEN contains(b, '.') THEN regexp_replace(b, '\\.?0+$', '') ELSE b END,
            CASE WHEN c_nationkey > 5 THEN concat(c_nationkey, 'x.0') ELSE '' END) AS row_key
            FROM (SELECT *, CAST(CAST(c_acctbal AS DECIMAL(18,4)) AS VARCHAR) AS b FROM customer)""",
        "normalized_ledger": ledger(
            select="SELECT coalesce(month, '') AS month, coalesce(center, '') AS cost_center, coalesce(vcode, '') AS vendor_code, "
            "coalesce(vname, '') AS vendor_name, count(*) AS ledger_rows FROM routed GROUP BY ALL"
        ),
        "ledger_split": ledger(
            select="SELECT route, coalesce(item_now, '') AS cost_item, count(*) AS route_rows FROM routed GROUP BY ALL"
        ),
        "cost_bucket_pivot": ledger(FACTS, select="SELECT * FROM amounts"),
        "unmapped_audit": ledger(
            select="SELECT id AS source_row, work_order_key AS row_id, '成本项目名称' AS field_name, "
            "item_now AS original_value FROM detail WHERE bucket IS NULL"
        ),
        "missing_amount_audit": ledger(
            select="SELECT id AS source_row, work_order_key AS row_id, '本期完工金额' AS field_name, "
            "'' AS original_value FROM detail WHERE bucket IS NOT NULL AND amount IS NULL"
        ),
        "qty_validity": ledger(FACTS, select="SELECT validity, count(*) AS qty_rows FROM tested GROUP BY 1"),
        "duplicate_keys": ledger(
            FACTS,
            select="SELECT work_order_key, count(*) AS key_rows, min(id) AS first_row FROM valid GROUP BY 1 HAVING count(*) > 1",
        ),
        "first_occurrence": ledger(FACTS, select="SELECT work_order_key, id AS source_row FROM valid WHERE is_first"),
        "fact_join_reconcile": ledger(
            FACTS,
            select=f"SELECT id AS source_row, work_order_key, {', '.join(FACT_COLUMNS)}, moh_components, derived_total, "
            "moh_matches, total_matches FROM facts",
        ),
        "check_status": ledger(
            FACTS,
            select="SELECT CASE WHEN check_reason = '' THEN '通过' ELSE '需复核' END AS check_status, check_reason, "
            "count(*) AS fact_rows FROM facts GROUP BY ALL",
        ),
        "unit_cost": ledger(FACTS, select=f"SELECT id AS source_row, {unit_cols} FROM facts"),
        "quantity_table": ledger(
            FACTS,
            select=f"SELECT {named(qty_values)}, round(unit_dm, 8) AS dm_unit, "
            "round(unit_standalone_1, 8) AS software_unit FROM facts",
        ),
        "detail_table": ledger(
            select="SELECT coalesce(code, '') AS product_code, coalesce(center, '') AS cost_center, "
            "coalesce(item_now, '') AS cost_item, count(*) AS detail_rows, CAST(sum(amount) AS DECIMAL(28,2)) AS amount, "
            "count(child) AS material_rows FROM detail GROUP BY ALL"
        ),
        "nonpositive_unit_cost": ledger(
            FACTS,
            ISSUES,
            select="SELECT source_row, row_id, field_name, original_value FROM issues WHERE issue_type = 'NON_POSITIVE_UNIT_COST'",
        ),
        "reconcile_issues": ledger(
            FACTS,
            ISSUES,
            select="SELECT source_row, row_id, issue_type, original_value, reason FROM issues "
            "WHERE issue_type IN ('MOH_BREAKDOWN_MISMATCH', 'TOTAL_COST_MISMATCH')",
        ),
        "issue_log": ledger(FACTS, ISSUES, select="SELECT * FROM issues"),
        "issue_counts": ledger(FACTS, ISSUES, select="SELECT issue_type, count(*) AS issue_count FROM issues GROUP BY 1"),
        "whitelist_order": ledger(FACTS, SCORES, select="SELECT product_rank, work_order_key FROM work_orders"),
        "production_scope": ledger(
            FACTS, select="SELECT scope, can_analyze, count(*) AS fact_rows FROM fit GROUP BY ALL"
        ),
        "metric_unpivot": ledger(
            FACTS,
            SCORES,
            select="SELECT code AS pool_code, name AS pool_name, scope, metric, count(*) AS pool_rows, "
            "round(min(lg), 8) AS low, round(max(lg), 8) AS high FROM long GROUP BY ALL",
        ),
        "row_verdict": ledger(
            FACTS,
            SCORES,
            VERDICT,
            select="SELECT work_order_key, scope, can_analyze, anomaly_level, anomaly_source FROM verdicts",
        ),
        "review_reasons": ledger(
            FACTS,
            SCORES,
            select="SELECT work_order_key, concat_ws(';', CASE WHEN scope = '未归类' "
            f"THEN '{C.UNKNOWN_SCOPE_REASON}' END, {REASONS}) AS review_reason FROM work_orders",
        ),
        "metric_scores": ledger(
            FACTS,
            SCORES,
            select=f"SELECT work_order_key, {z_cols}, max(CASE WHEN metric = 'total' THEN n END) AS n_total, "
            "max(CASE WHEN metric = 'moh_labor' THEN n END) AS n_moh_labor "
            "FROM work_orders LEFT JOIN (SELECT * EXCLUDE n, CAST(n AS BIGINT) AS n FROM scores) USING (id) GROUP BY work_order_key",
        ),
        "analysis_table": ledger(
            FACTS,
            SCORES,
            VERDICT,
            select=f"SELECT {named(analysis_values)}, round(unit_total, 8) AS total_unit, "
            "round(unit_standalone_1, 8) AS software_unit FROM verdicts",
        ),
        "weighted_median": with_(
            PRICES,
            select="SELECT p_brand, p_type, round(center, 8) AS median, CAST(pool_rows AS BIGINT) AS pool_rows FROM "
            + _weighted("prices", "p_brand, p_type", "price", "weight", "center"),
        ),
        "weighted_mad": with_(PRICES, PRICE_STATS, select="SELECT p_brand, p_type, round(mad, 8) AS mad FROM mads"),
        "modified_zscore": with_(
            PRICES, PRICE_STATS, PRICE_Z, select="SELECT l_orderkey, l_linenumber, l_partkey, round(z, 6) AS z FROM scored"
        ),
        "grade_counts": with_(
            PRICES,
            PRICE_STATS,
            PRICE_Z,
            select="""SELECT p_brand, CASE WHEN abs(round(z, 9)) > 3.5 THEN '高度可疑' WHEN abs(round(z, 9)) > 2.5 THEN '关注'
              WHEN z IS NOT NULL THEN '正常' END AS grade, count(*) AS line_rows FROM scored GROUP BY ALL""",
        ),
        "quality_metrics": ledger(FACTS, COUNTS, QUALITY, select="SELECT * FROM quality"),
        "run_counts": ledger(FACTS, COUNTS, select="SELECT * FROM counts"),
        "month_filtered_quality": ledger(FACTS, COUNTS, QUALITY, select="SELECT * FROM quality", rows=SOME),
        "null_profile": with_(
            EVENTS,
            """c AS (SELECT count(*) AS n, count(event_id) AS a, count(known) AS b, count(paid) AS c, count(actor) AS d FROM ev)""",
            select="SELECT position, column_name, n - have AS null_count, n AS row_count FROM c, LATERAL (VALUES "
            "(0, 'event_id', a), (1, 'kind', b), (2, 'paid', c), (3, 'actor', d)) AS t(position, column_name, have)",
        ),
        "text_ledger_scan": """SELECT o_orderkey AS order_no, strftime(o_orderdate, '%Y-%m') AS period_key,
            CASE WHEN o_orderkey % 2 = 0 THEN concat(o_orderpriority, ', ","') END AS cost_item,
            CAST(o_totalprice AS DECIMAL(18,2)) AS amount, CAST(NULL AS VARCHAR) AS material FROM orders""",
        "cell_diff": with_(VERSIONS, CELLS, select="SELECT * FROM cells"),
        "cell_diff_report": with_(
            VERSIONS,
            CELLS,
            select="SELECT o_orderkey, column_name, mismatch_kind FROM cells ORDER BY 1, 2, 3 LIMIT 20",
        ),
        "column_totals_diff": with_(
            VERSIONS,
            select="""SELECT 'price' AS column_name, abs((SELECT sum(price) FROM e) - (SELECT sum(price) FROM a)) <= 1e-8 AS matches
              UNION ALL SELECT 'o_custkey', abs((SELECT sum(o_custkey) FROM e) - (SELECT sum(o_custkey) FROM a)) <= 1e-8""",
        ),
        "group_totals_diff": with_(
            VERSIONS,
            select="""SELECT * FROM (SELECT o_orderkey, CASE WHEN a.o_custkey IS NULL THEN 'missing_in_actual'
              WHEN abs(e.price - a.price) > 1e-9 THEN 'group_total_mismatch' END AS mismatch_kind
              FROM e LEFT JOIN a USING (o_orderkey)) WHERE mismatch_kind IS NOT NULL""",
        ),
        "dup_blank_keys": with_(
            LINE_KEYS,
            select="""SELECT l_orderkey, line, count(*) AS key_rows, CASE WHEN line = '　' THEN 'blank_group_key'
              ELSE 'duplicate_group_key' END AS mismatch_kind FROM keys GROUP BY ALL HAVING count(*) > 1 OR line = '　'""",
        ),
        "numeric_problems": with_(
            LINE_KEYS,
            select="""SELECT l_orderkey, 'note' AS column_name, 'numeric_storage_invalid' AS mismatch_kind, count(*) AS cells
              FROM keys WHERE note = 'n/a' GROUP BY ALL""",
        ),
        "run_contract_diff": both_runs(),
        "amount_limits": f"""WITH q AS (SELECT l_orderkey * 8 + l_linenumber AS source_row, l_partkey % 7 AS a, l_suppkey % 5 AS b,
            CAST(l_linenumber AS VARCHAR) AS n FROM lineitem),
          found AS (SELECT source_row, 'NUMBER_OUT_OF_RANGE' AS issue_type, '{C.DONE_QTY}' AS field_name,
              n || repeat('0', 28) AS original_value FROM q WHERE a = 3
            UNION ALL SELECT source_row, 'NUMBER_ROUNDED', '{C.DONE_AMOUNT}', n || '.' || repeat('1', 29) FROM q WHERE b = 2)
          SELECT v.source_row, v.validity, issue_type, field_name, original_value
          FROM (SELECT DISTINCT source_row, CASE WHEN a = 3 THEN 'out_of_range' WHEN b = 3 THEN 'missing_total'
            ELSE 'valid' END AS validity FROM q) v LEFT JOIN found ON found.source_row = v.source_row""",
        "cell_diff_columns": """SELECT o_orderkey, 'o_custkey' AS column_name, 'storage_type_mismatch' AS mismatch_kind,
            'n' AS expected_type, 'blank' AS actual_type FROM orders WHERE o_custkey IS NOT NULL
          UNION ALL SELECT o_orderkey, 'note', 'storage_type_mismatch', 'blank', 's' FROM orders WHERE o_orderkey % 3 = 0""",
        "cell_diff_repeated_keys": """WITH n AS (SELECT l_orderkey, count(*) AS n_e, count(*) FILTER (l_linenumber <> 2) AS n_a
            FROM lineitem GROUP BY 1)
          SELECT l_orderkey, CASE WHEN n_e = 1 THEN 'qty' END AS column_name,
            CASE WHEN n_e = 1 THEN 'storage_type_mismatch' ELSE 'repeated_key' END AS mismatch_kind,
            CASE WHEN n_e = 1 THEN 'n' END AS expected_type, CASE WHEN n_e = 1 THEN 'blank' END AS actual_type
          FROM n WHERE n_e > 1 OR n_a = 0""",
        "shape_diff": """SELECT 'part' AS table_name, 'shape_mismatch' AS mismatch_kind
          UNION ALL SELECT DISTINCT 'orders', 'shape_mismatch' FROM orders WHERE o_orderkey % 101 = 0""",
        "positional_diff": """WITH kept AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_quantity AS q,
            l_returnflag AS m FROM lineitem),
          expected AS (SELECT row_number() OVER (ORDER BY o, n, p, s, q, m) AS row_number, q, m FROM (
            SELECT * FROM kept UNION ALL SELECT 1152921504606846976 + o, n, p, s, q, m FROM kept WHERE n = 1)),
          actual AS (SELECT row_number() OVER (ORDER BY o, n, p, s, q, m) AS row_number, q, m FROM (
            SELECT o, n, p, s, CASE WHEN o % 50 = 0 THEN q + 1 ELSE q END AS q, CASE WHEN p % 40 <> 0 THEN m END AS m FROM kept)),
          cells AS (SELECT row_number, column_name, e, a, CASE WHEN e THEN kind ELSE 'blank' END AS expected_type,
              CASE WHEN a THEN kind ELSE 'blank' END AS actual_type, same FROM (
            SELECT e.row_number, 'l_quantity' AS column_name, 'n' AS kind, e.q IS NOT NULL AS e, a.q IS NOT NULL AS a, e.q = a.q AS same
            FROM expected e LEFT JOIN actual a USING (row_number)
            UNION ALL SELECT e.row_number, 'l_returnflag', 's', e.m IS NOT NULL, a.m IS NOT NULL, e.m = a.m
            FROM expected e LEFT JOIN actual a USING (row_number)))
          SELECT row_number, column_name, CASE WHEN e <> a THEN 'storage_type_mismatch' ELSE 'value_mismatch' END AS mismatch_kind,
            expected_type, actual_type FROM cells WHERE e <> a OR (e AND a AND NOT same)""",
        "run_compare": with_(
            VERSIONS,
            CELLS,
            select="""SELECT 'orders' AS table_name, CAST(NULL AS VARCHAR) AS coordinate, CAST(NULL AS VARCHAR) AS column_name,
                'shape_mismatch' AS mismatch_kind WHERE (SELECT count(*) FROM e) <> (SELECT count(*) FROM a)
              UNION ALL SELECT 'orders', '{"o_orderkey":' || o_orderkey || '}', column_name, mismatch_kind FROM cells
              UNION ALL SELECT 'orders', '{"o_orderkey":' || o_orderkey || '}', NULL, mismatch_kind FROM (
                SELECT o_orderkey, CASE WHEN a.o_custkey IS NULL THEN 'missing_in_actual'
                  WHEN abs(e.price - a.price) > 1e-9 THEN 'group_total_mismatch' END AS mismatch_kind
                FROM e LEFT JOIN a USING (o_orderkey)) WHERE mismatch_kind IS NOT NULL
              UNION ALL SELECT 'orders', NULL, 'price', 'column_total_mismatch'
                WHERE abs((SELECT sum(price) FROM e) - (SELECT sum(price) FROM a)) > 1e-8""",
        ),
        "header_policy": f"""WITH k AS (SELECT DISTINCT l_partkey AS p, l_orderkey AS o, l_linenumber AS n FROM lineitem),
          c AS (SELECT p, '{{"{C.MONTH}":"2026-01","{C.PRODUCT_CODE}":' || p || ',"{C.ORDER_NO}":' || o || ',"{C.ORDER_LINE}":' || n
            || '}}' AS coordinate FROM k),
          changed AS (SELECT '{C.QTY_UNIT_COLUMNS["dl"]}' AS lost, '{C.STANDALONE_UNIT_COLUMNS[C.SOFTWARE]}' AS other, '{C.QTY_TABLE}' AS t)
          SELECT '{C.DETAIL_TABLE}' AS table_name, CAST(NULL AS VARCHAR) AS coordinate, '{C.DONE_AMOUNT}' AS column_name,
            'column_total_mismatch' AS mismatch_kind WHERE EXISTS (FROM k)
          UNION ALL SELECT t, NULL, lost, 'required_header_missing' FROM changed
          UNION ALL SELECT t, NULL, other, 'unexpected_numeric_header' FROM changed
          UNION ALL SELECT t, coordinate, lost, 'storage_type_mismatch' FROM c, changed WHERE p % 100 = 0
          UNION ALL SELECT t, coordinate, other, 'storage_type_mismatch' FROM c, changed WHERE p % 90 = 0""",
        "text_identity": """SELECT doc_id, strlen(coalesce(text, '')) AS size, sha256(coalesce(text, '')) AS sha256
          FROM documents""",
        "product_dim_check": with_(
            PRODUCTS,
            """found AS (SELECT 'blank_code' AS problem, * FROM dim WHERE trim(code) = ''
              UNION ALL SELECT 'untrimmed_code', * FROM dim WHERE trim(code) <> '' AND trim(code) <> code
              UNION ALL SELECT 'duplicate_code', * FROM dim QUALIFY count(*) OVER (PARTITION BY code) > 1
              UNION ALL SELECT 'duplicate_pair', * FROM dim QUALIFY count(*) OVER (PARTITION BY code, name) > 1
              UNION ALL SELECT 'duplicate_display_order', * FROM dim QUALIFY count(*) OVER (PARTITION BY display_order) > 1
              UNION ALL SELECT 'display_order_not_increasing', * FROM dim
                QUALIFY lag(display_order) OVER (ORDER BY position) >= display_order)""",
            select="SELECT problem, count(*) AS problem_rows, CAST(sum(display_order) AS BIGINT) AS order_sum FROM found GROUP BY 1",
        ),
    }
    # what is published is what the run's table shows
    texts["published_quantity"] = texts["quantity_table"]
    items = ",".join(f'"{i}"' for i in C.STANDALONE_ITEMS["sk"])
    texts["rules_fingerprint"] = f"""WITH p AS (SELECT p_brand AS code, p_type AS name, min(p_partkey) AS d FROM part GROUP BY 1, 2)
      SELECT 'sk' AS rule_set, sha256('{{"name":"sk","products":[' || string_agg('{{"display_order":' || d || ',"code":"' || code ||
        '","name":"' || name || '"}}', ',' ORDER BY d, code, name) || '],"standalone_items":[{items}]}}') AS fingerprint FROM p"""
    return texts
