"""Fixed values of the ledger contract: column names, labels, texts and thresholds.

Nothing here computes anything. The strings must stay exactly as they are because
ledger exports and downstream reports use them verbatim.
"""

from __future__ import annotations

from decimal import Decimal

# ---------------------------------------------------------------- fixed values: columns
PERIOD = "年期"
MONTH = "月份"
COST_CENTER = "成本中心名称"
PRODUCT_CODE = "产品编码"
PRODUCT_NAME = "产品名称"
SPEC = "规格型号"
ORDER_NO = "工单编号"
ORDER_LINE = "工单行号"
VENDOR_CODE = "供应商编码"
VENDOR_NAME = "供应商名称"
UNIT = "基本单位"
PLANNED_OUTPUT = "计划产量"
PRODUCTION_TYPE = "生产类型"
DOC_TYPE = "单据类型"
CHILD_MATERIAL = "子项物料编码"
CHILD_MATERIAL_NAME = "子项物料名称"
COST_ITEM = "成本项目名称"
FILLED_COST_ITEM = "Filled_成本项目"
DONE_QTY = "本期完工数量"
DONE_AMOUNT = "本期完工金额"
DONE_UNIT_COST = "本期完工单位成本"
ANALYSIS_ORDER_LINE = "工单行"
ANALYZABLE = "是否可参与分析"

# ---------------------------------------------------------------- fixed values: header rules
HEADER_ANCHOR = PERIOD
HEADER_HINTS = (COST_CENTER, PRODUCT_CODE, ORDER_NO, COST_ITEM)
EMPTY_HEADER_TOKENS = ("None", "nan", "NaN")
CHILD_MATERIAL_ALIASES = ("物料编码", "子件")
COST_ITEM_ALIASES = ("成本项目", "费用项目")

# ---------------------------------------------------------------- fixed values: normalize
TOTAL_MARK = "合计"
TOTAL_COLUMNS = (PERIOD, MONTH, COST_CENTER)
GUARDED_COST_CENTER = "集成车间"
FILL_COLUMNS = (
    PERIOD,
    COST_CENTER,
    PRODUCT_CODE,
    PRODUCT_NAME,
    SPEC,
    ORDER_NO,
    ORDER_LINE,
    VENDOR_CODE,
    VENDOR_NAME,
    UNIT,
    PLANNED_OUTPUT,
    PRODUCTION_TYPE,
    DOC_TYPE,
)
VENDOR_COLUMNS = (VENDOR_CODE, VENDOR_NAME)
KEY_COLUMNS = (MONTH, PRODUCT_CODE, ORDER_NO, ORDER_LINE)
ANALYSIS_KEY_COLUMNS = (MONTH, PRODUCT_CODE, ORDER_NO, ANALYSIS_ORDER_LINE)
REQUIRED_DETAIL = (PRODUCT_CODE, PRODUCT_NAME, ORDER_NO, ORDER_LINE, COST_ITEM, DONE_AMOUNT)
REQUIRED_QTY = (PRODUCT_CODE, PRODUCT_NAME, ORDER_NO, ORDER_LINE, DONE_QTY, DONE_AMOUNT)
DETAIL_DATASET = "成本明细"
QTY_DATASET = "产品数量统计"

# ---------------------------------------------------------------- fixed values: output layouts
DETAIL_LAYOUT = (
    "年期", "月份", "成本中心名称", "产品编码", "产品名称", "规格型号", "生产类型", "单据类型",
    "工单编号", "工单行号", "供应商编码", "供应商名称", "基本单位", "计划产量", "成本项目名称",
    "子项物料编码", "子项物料名称", "期初在产品数量", "期初在产品金额", "期初调整数量",
    "期初调整金额", "本期投入数量", "本期投入金额", "累计投入数量", "累计投入金额",
    "期末在产品数量", "期末在产品金额", "本期完工数量", "本期完工单耗", "本期完工单位成本",
    "本期完工金额", "累计完工数量", "累计完工单耗", "累计完工单位成本", "累计完工金额",
)
QTY_LAYOUT = (
    "年期", "月份", "成本中心名称", "产品编码", "产品名称", "规格型号", "生产类型", "单据类型",
    "工单编号", "工单行号", "基本单位", "计划产量", "期初在产品数量", "期初在产品金额",
    "本期投入数量", "本期投入金额", "累计投入数量", "累计投入金额", "期末在产品数量",
    "期末在产品金额", "本期完工数量", "本期完工单耗", "本期完工单位成本", "本期完工金额",
    "累计完工数量", "累计完工单耗", "累计完工单位成本", "累计完工金额",
)
ANALYSIS_LAYOUT = (
    "月份", "成本中心", "产品编码", "产品名称", "规格型号", "工单编号", "工单行", "生产类型",
    "基本单位", "本期完工数量", "总完工成本", "直接材料合计完工金额", "直接人工合计完工金额",
    "制造费用合计完工金额", "制造费用_其他合计完工金额", "制造费用_人工合计完工金额",
    "制造费用_机物料及低耗合计完工金额", "制造费用_折旧合计完工金额",
    "制造费用_水电费合计完工金额", "总单位完工成本", "直接材料单位完工成本",
    "直接人工单位完工成本", "制造费用单位完工成本", "制造费用_其他单位完工成本",
    "制造费用_人工单位完工成本", "制造费用_机物料及低耗单位完工成本",
    "制造费用_折旧单位完工成本", "制造费用_水电费单位完工成本", "是否可参与分析",
    "异常等级", "异常主要来源", "异常明细解释", "复核原因",
)
# Text-like columns of the layouts; every other layout column holds numbers.
TEXT_COLUMNS = (
    PERIOD, MONTH, COST_CENTER, PRODUCT_CODE, PRODUCT_NAME, SPEC, PRODUCTION_TYPE, DOC_TYPE,
    ORDER_NO, ORDER_LINE, VENDOR_CODE, VENDOR_NAME, UNIT, COST_ITEM, CHILD_MATERIAL,
    CHILD_MATERIAL_NAME,
)
DETAIL_TABLE = "成本计算单总表"
QTY_TABLE = "成本计算单数量聚合维度"
ANALYSIS_TABLE = "成本分析工单维度"
OUTPUT_TABLES = (DETAIL_TABLE, QTY_TABLE, ANALYSIS_TABLE)
RETIRED_TABLES = ("成本分析产品维度",)

# ---------------------------------------------------------------- fixed values: cost items
DIRECT_MATERIAL = "直接材料"
DIRECT_LABOR = "直接人工"
OVERHEAD_PREFIX = "制造费用"
# The labor item is written with a hyphen, its siblings with an underscore.
OVERHEAD_ITEMS = {
    "moh_other": "制造费用_其他",
    "moh_labor": "制造费用-人工",
    "moh_consumables": "制造费用_机物料及低耗",
    "moh_depreciation": "制造费用_折旧",
    "moh_utilities": "制造费用_水电费",
}
OUTSOURCED = "委外加工费"
SOFTWARE = "软件费用"
# short bucket name -> label inside output column names
BUCKET_LABELS = {
    "dm": "直接材料",
    "dl": "直接人工",
    "moh": "制造费用",
    "moh_other": "制造费用_其他",
    "moh_labor": "制造费用_人工",
    "moh_consumables": "制造费用_机物料及低耗",
    "moh_depreciation": "制造费用_折旧",
    "moh_utilities": "制造费用_水电费",
}
# unit-cost column of each bucket in the quantity table
QTY_UNIT_COLUMNS = {
    "dm": "直接材料单位完工金额",
    "dl": "直接人工单位完工金额",
    "moh": "制造费用单位完工金额",
    "moh_other": "制造费用_其他单位完工成本",
    "moh_labor": "制造费用_人工单位完工成本",
    "moh_consumables": "制造费用_机物料及低耗单位完工成本",
    "moh_depreciation": "制造费用_折旧单位完工成本",
    "moh_utilities": "制造费用_水电费单位完工成本",
}
STANDALONE_UNIT_COLUMNS = {
    OUTSOURCED: "委外加工费单位完工成本",
    SOFTWARE: "软件费用单位完工成本",
}
STANDALONE_UNIT_FALLBACK = "独立成本项单位完工成本"
# analysis table: item -> (amount column, unit-cost column); unknown items use the first pair
STANDALONE_ANALYSIS_COLUMNS = {
    OUTSOURCED: ("委外加工费合计完工金额", "委外加工费单位完工成本"),
    SOFTWARE: ("软件费用合计完工金额", "软件费用单位完工成本"),
}
MOH_MATCH_COLUMN = "制造费用明细项合计是否等于制造费用合计"
TOTAL_MATCH_SUFFIX = "是否等于总完工成本"
CHECK_STATUS_COLUMN = "数据校验状态"
CHECK_REASON_COLUMN = "异常原因说明"
YES, NO = "是", "否"
PASSED, NEEDS_REVIEW = "通过", "需复核"

# ---------------------------------------------------------------- fixed values: issue texts
# issue type -> (field, reason, action)
ISSUES = {
    "UNMAPPED_COST_ITEM": (
        COST_ITEM,
        "成本项目未映射到直接材料/直接人工/制造费用",
        "该行已从分析数据中排除",
    ),
    "MISSING_AMOUNT": (DONE_AMOUNT, "成本明细金额为空，已按 0 参与汇总", "金额置为 0 后继续计算"),
    "NUMBER_OUT_OF_RANGE": (None, "number does not fit the decimals", "row or amount left out, kept here as text"),
    "NUMBER_ROUNDED": (None, "number has more decimals than are kept", "rounded half up"),
    "SUM_OUT_OF_RANGE": (None, "sum of a work order does not fit the decimals", "left empty and marked for review"),
    "DUPLICATE_WORK_ORDER_KEY": (
        "工单主键",
        "数量页存在重复工单主键",
        "数量页原样保留，异常分析按首条记录去重",
    ),
    "MOH_BREAKDOWN_MISMATCH": (
        "制造费用",
        "制造费用明细项合计不等于制造费用合计",
        "保留结果并标记需复核",
    ),
    "TOTAL_COST_MISMATCH": ("总完工成本", "不等于数量页总完工成本", "保留结果并标记需复核"),
    "NON_POSITIVE_UNIT_COST": (
        None,
        "单位成本小于等于 0，不参与 log 与 Modified Z-score",
        "保留在异常分析页并标记复核原因",
    ),
}
MOH_CHECK_REASON = "制造费用明细与合计不一致"
TOTAL_CHECK_SUFFIX = "与总完工成本不一致"
MOH_VALUE_FORMAT = "明细合计=%s;制造费用=%s"
TOTAL_VALUE_FORMAT = "计算值=%s;数量页=%s"

# ---------------------------------------------------------------- fixed values: anomaly scoring
SCOPE_NORMAL, SCOPE_REWORK, SCOPE_UNKNOWN = "正常生产", "返工生产", "未归类"
DOC_TYPE_SCOPES = {
    "汇报入库-普通生产": SCOPE_NORMAL,
    "直接入库-普通生产": SCOPE_NORMAL,
    "汇报入库-返工生产": SCOPE_REWORK,
}
LEVEL_HIGH, LEVEL_WATCH, LEVEL_NORMAL = "高度可疑", "关注", "正常"
HIGH_LIMIT, WATCH_LIMIT = 3.5, 2.5
Z_SCALE = 0.6745
MIN_LOG_MAD = 0.004987541511038968  # about log1p(0.005)
MIN_POOL_SIZE = 3
# metric -> (unit-cost column, source label, label in explanations), in report order
METRICS = {
    "total": ("总单位完工成本", "总成本异常", "总成本"),
    "dm": ("直接材料单位完工成本", "材料异常", "直接材料"),
    "dl": ("直接人工单位完工成本", "人工异常", "直接人工"),
    "moh": ("制造费用单位完工成本", "制造费用异常", "制造费用"),
    "moh_other": ("制造费用_其他单位完工成本", "其他异常", "制造费用_其他"),
    "moh_labor": ("制造费用_人工单位完工成本", "制造费用人工异常", "制造费用_人工"),
    "moh_consumables": (
        "制造费用_机物料及低耗单位完工成本",
        "机物料及低耗异常",
        "制造费用_机物料及低耗",
    ),
    "moh_depreciation": ("制造费用_折旧单位完工成本", "折旧异常", "制造费用_折旧"),
    "moh_utilities": ("制造费用_水电费单位完工成本", "水电费异常", "制造费用_水电费"),
}
SEVERAL_SOURCES = "多项同时异常"
UNKNOWN_SCOPE_REASON = "单据类型未归类，不参与正常生产/返工生产异常池"
NON_POSITIVE_SUFFIX = "小于等于0或为空"

# ---------------------------------------------------------------- fixed values: quality metrics
QUALITY_ROWS = "行数勾稽"
QUALITY_NULLS = "空值率"
QUALITY_UNIQUE = "唯一性检查"
QUALITY_RANGE = "范围检查"
QUALITY_COVERAGE = "分析覆盖率"
NOT_APPLICABLE = "N/A"
EMPTY_FILTER_TEXT = "月份过滤后无数据，指标不适用"
# (category, metric, description) in report order
QUALITY_METRICS = (
    (QUALITY_ROWS, "成本明细输入行数", "原始拆分后的成本明细行数"),
    (QUALITY_ROWS, "产品数量统计输入行数", "拆分后的数量页原始行数"),
    (QUALITY_ROWS, "产品数量统计输出行数", "仅保留完工数量大于 0 且总完工成本非空的工单"),
    (QUALITY_ROWS, "因完工数量无效被过滤行数", "过滤条件包含完工数量为空、等于 0 或小于 0"),
    (QUALITY_ROWS, "因总完工成本为空被过滤行数", "仅统计完工数量有效但总完工成本为空的工单"),
    (QUALITY_ROWS, "工单异常分析输出行数", "去重后的工单级分析行数"),
    (QUALITY_NULLS, "直接材料金额缺失率", "派生金额字段空值率"),
    (QUALITY_UNIQUE, "工单主键重复行数", "键：月份+产品编码+工单编号+工单行"),
    (QUALITY_RANGE, "完工数量小于等于0行数", "保留后的数量事实不应存在非正完工数量"),
    (QUALITY_COVERAGE, "可参与分析占比", "按完工数量、总单位成本和单据类型归类估算可分析工单占比"),
)

# ---------------------------------------------------------------- fixed values: rule sets
STANDALONE_ITEMS = {"gb": (OUTSOURCED,), "sk": (OUTSOURCED, SOFTWARE)}
# (code, name, display order)
PRODUCTS = {
    "gb": (
        ("GB_C.D.B0048AA", "BMS-400W驱动器", 10),
        ("GB_C.D.B0040AA", "BMS-750W驱动器", 20),
        ("GB_C.D.B0041AA", "BMS-1100W驱动器", 30),
        ("GB_C.D.B0042AA", "BMS-1700W驱动器", 40),
        ("GB_C.D.B0043AA", "BMS-2400W驱动器", 50),
        ("GB_C.D.B0044AA", "BMS-3900W驱动器", 60),
        ("GB_C.D.B0045AA", "BMS-5900W驱动器", 70),
        ("GB_C.D.B0046AA", "BMS-7500W驱动器", 80),
    ),
    "sk": (
        ("DP.C.P0197AA", "动力线", 10),
        ("DP.C.P0201AA", "动力线", 20),
        ("DP.C.P0198AA", "动力线", 30),
        ("DP.C.P0199AA", "动力线", 40),
        ("DP.C.P0257AA", "动力线", 50),
        ("DP.C.P0200AA", "动力线", 60),
        ("DP.C.P0246AA", "动力抱闸线", 70),
        ("DP.C.P0252AA", "动力线", 80),
    ),
}
INPUT_PATTERNS = {"gb": "gb-*", "sk": "sk-*"}

# ---------------------------------------------------------------- fixed values: comparison
CELL_TOLERANCE = Decimal("1e-9")
TOTAL_TOLERANCE = Decimal("1e-8")
MAX_REPORTED_MISMATCHES = 20
