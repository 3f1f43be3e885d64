"""Small fixed dimension tables.

Everything here is a constant lookup of at most a few dozen rows. The values
must equal the published behaviour of the analysed application, so they are
written out plainly. Operators either turn them into ``when`` chains (for the
tiny band tables) or into broadcast DataFrames via :func:`as_df` — their size is
fixed, so broadcasting them is always safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# FIXED VALUES: appliance catalogue used for identification (10 appliances).
# (code, reference name, power lo W, power hi W, duration lo min, duration hi min)
# Listed in the catalogue's own order; ``ord`` (list position) breaks ties.
# ---------------------------------------------------------------------------
APPLIANCES = [
    ("air_conditioner", "空调", 800, 2000, 30, 480),
    ("refrigerator", "冰箱", 80, 200, 1440, 10080),
    ("water_heater", "热水器", 1200, 2500, 10, 60),
    ("washing_machine", "洗衣机", 200, 600, 30, 90),
    ("microwave", "微波炉", 800, 1800, 2, 15),
    ("tv", "电视", 80, 250, 60, 300),
    ("lighting", "照明", 30, 250, 30, 480),
    ("electric_stove", "电磁炉", 1000, 2500, 20, 60),
    ("rice_cooker", "电饭煲", 500, 1000, 30, 120),
    ("electric_heater", "电暖器", 1000, 2000, 60, 480),
]

# FIXED VALUES: (code, characteristics, usage pattern) of the catalogue.
APPLIANCE_TRAITS = [
    ("air_conditioner", ["周期性启停", "高功率", "夏季使用频繁"], "夏季高峰,昼夜持续"),
    ("refrigerator", ["持续低功率", "间歇性启动", "全天运行"], "全年稳定,变化小"),
    ("water_heater", ["高功率即热型", "短时运行", "用水时段集中"], "早晚用水高峰"),
    ("washing_machine", ["周期性运行", "有明显启停", "单次运行时间长"], "白天使用,工作日规律"),
    ("microwave", ["短时高功率", "瞬时开关", "功率波动大"], "餐时使用,随机性强"),
    ("tv", ["稳定功率", "长时间运行", "晚间使用高峰"], "晚间使用高峰"),
    ("lighting", ["可调节", "时间段明显", "多灯组合"], "早晚使用,季节影响大"),
    ("electric_stove", ["高功率", "温度控制型", "餐时使用"], "餐时使用,功率恒定"),
    ("rice_cooker", ["煮饭周期", "保温模式", "规律使用"], "早晚餐前使用"),
    ("electric_heater", ["高功率", "恒温控制", "冬季使用"], "冬季使用,夜间持续"),
]
# FIXED VALUE: the sampling interval named in a data range.
INTERVAL_LABEL = "1分钟"

# ---------------------------------------------------------------------------
# FIXED VALUES: efficiency standards, 5 appliances x 4 levels.
# (appliance code, level, metric name, metric value, power lo W, power hi W)
# ---------------------------------------------------------------------------
EFFICIENCY_STANDARDS = [
    ("air_conditioner", "excellent", "COP", 3.6, 800, 1200),
    ("air_conditioner", "good", "COP", 3.2, 1200, 1500),
    ("air_conditioner", "fair", "COP", 2.8, 1500, 2000),
    ("air_conditioner", "poor", "COP", 2.4, 2000, 3000),
    ("refrigerator", "excellent", "daily_kwh", 0.5, 80, 120),
    ("refrigerator", "good", "daily_kwh", 0.8, 120, 150),
    ("refrigerator", "fair", "daily_kwh", 1.2, 150, 180),
    ("refrigerator", "poor", "daily_kwh", 1.8, 180, 250),
    ("water_heater", "excellent", "daily_kwh", 3.0, 1500, 1800),
    ("water_heater", "good", "daily_kwh", 5.0, 1800, 2200),
    ("water_heater", "fair", "daily_kwh", 7.0, 2200, 2500),
    ("water_heater", "poor", "daily_kwh", 10.0, 2500, 3000),
    ("washing_machine", "excellent", "per_kg", 0.15, 200, 400),
    ("washing_machine", "good", "per_kg", 0.25, 400, 500),
    ("washing_machine", "fair", "per_kg", 0.35, 500, 600),
    ("washing_machine", "poor", "per_kg", 0.50, 600, 800),
    ("tv", "excellent", "power_per_inch", 0.1, 80, 150),
    ("tv", "good", "power_per_inch", 0.15, 150, 200),
    ("tv", "fair", "power_per_inch", 0.2, 200, 250),
    ("tv", "poor", "power_per_inch", 0.3, 250, 350),
]
EFFICIENCY_APPLIANCES = ["air_conditioner", "refrigerator", "water_heater", "washing_machine", "tv"]
LEVEL_SCORES = {"excellent": 95, "good": 80, "fair": 65, "poor": 50}
# FIXED VALUES: two suggestion strings per appliance efficiency level.
LEVEL_SUGGESTIONS = {
    "poor": ["建议更换为能效更高的设备", "检查设备是否需要维护保养"],
    "fair": ["设备能效一般，考虑升级换代", "注意合理使用，避免长时间满载运行"],
    "good": ["设备能效良好", "继续保持合理使用习惯"],
    "excellent": ["设备能效优秀", "继续保持"],
}

# ---------------------------------------------------------------------------
# FIXED VALUES: training label dictionary (appliance code -> label index in
# this order; ``mixed`` is last) and the reference display names.
# ---------------------------------------------------------------------------
TRAIN_LABELS = [
    ("refrigerator", "冰箱"),
    ("air_conditioner", "空调"),
    ("water_heater", "热水器"),
    ("washing_machine", "洗衣机"),
    ("microwave", "微波炉"),
    ("tv", "电视"),
    ("lighting", "照明"),
    ("electric_stove", "电磁炉"),
    ("rice_cooker", "电饭煲"),
    ("electric_heater", "电暖器"),
    ("mixed", "mixed"),
]
# Our own fixture choice: the driver's ``events.event_type`` stands in for the
# appliance label of a training sample.
EVENT_TYPE_APPLIANCE = {
    "view": "refrigerator",
    "click": "tv",
    "purchase": "air_conditioner",
    "signup": "washing_machine",
    "error": "mixed",
}

# ---------------------------------------------------------------------------
# FIXED VALUES: usage buckets, half-open [lo, hi) in W.
# (bucket index, code, reference label, lo, hi)
# ---------------------------------------------------------------------------
USAGE_BUCKETS = [
    (0, "standby", "待机/基础负载", 0, 100),
    (1, "small", "小型电器", 100, 300),
    (2, "medium", "中型电器", 300, 800),
    (3, "large", "大型电器", 800, 1500),
    (4, "high_power", "高功率电器", 1500, 3000),
]

# ---------------------------------------------------------------------------
# FIXED VALUES: day periods [0,6) [6,12) [12,18) [18,24).
# (code, start hour, reference label, chart label)
# ---------------------------------------------------------------------------
PERIODS = [
    ("night", 0, "凌晨", "Night (0-6)"),
    ("morning", 6, "上午", "Morning (6-12)"),
    ("afternoon", 12, "下午", "Afternoon (12-18)"),
    ("evening", 18, "晚间", "Evening (18-24)"),
]
# The reference breaks best/worst-period ties by the order of its grouped
# labels (code-point order of the reference label); derived, not hand-ordered.
PERIOD_TIE_ORDER = {code: i for i, (code, *_rest) in
                    enumerate(sorted(PERIODS, key=lambda p: p[2]))}

# FIXED VALUES: weekday labels, Monday = 0.
WEEKDAYS = [
    (0, "Mon", "周一"), (1, "Tue", "周二"), (2, "Wed", "周三"), (3, "Thu", "周四"),
    (4, "Fri", "周五"), (5, "Sat", "周六"), (6, "Sun", "周日"),
]

# ---------------------------------------------------------------------------
# FIXED VALUES: anomaly catalogue.
# (type, source, reference description, default severity or None,
#  possible causes, recommendation or None)
# ---------------------------------------------------------------------------
ANOMALY_TYPES = [
    ("voltage_out_of_range", "voltage", "电压超出标准范围", None, [], None),
    ("voltage_sag", "voltage", "电压暂降", "medium", [], None),
    ("voltage_swell", "voltage", "电压暂升", "medium", [], None),
    ("sudden_power_change", "power", "功率突变", "medium",
     ["设备启停", "线路切换", "瞬时负载变化"], "检查是否有大功率设备频繁启停"),
    ("power_spike", "power", "功率突增", "high",
     ["设备故障", "短路隐患", "非法用电"], "建议立即检查用电设备，排除故障隐患"),
    ("power_drop", "power", "功率突降", "medium",
     ["设备突然停机", "供电中断", "线路虚接"], "检查设备运行状态和线路连接"),
    ("daily_consumption_anomaly", "consumption", "日用电量异常", None,
     ["新增设备", "使用习惯改变", "设备故障", "漏电"], "检查当日是否有特殊用电情况"),
    ("usage_pattern_anomaly", "consumption", "用电模式异常", None,
     ["周末有额外电器使用", "工作日不在家", "统计周期内有假期"], "核实周末是否有新增电器使用"),
]
ANOMALY_ORD = {t[0]: i + 1 for i, t in enumerate(ANOMALY_TYPES)}

# FIXED VALUES: overall alert levels (code, reference description, message).
ALERT_LEVELS = [
    ("high", "🔴 高", "检测到严重异常，建议立即处理"),
    ("medium", "🟡 中", "检测到多处异常，建议关注"),
    ("low", "🟢 低", "检测到少量异常，建议观察"),
    ("none", "✅ 正常", "未检测到明显异常，用电状态正常"),
]

# FIXED VALUES: overall efficiency level cut points and reference labels.
OVERALL_LEVELS = [("excellent", 85.0, "优秀"), ("good", 70.0, "良好"),
                  ("fair", 55.0, "一般"), ("poor", None, "较差")]

# FIXED VALUES: improvement rule codes and their two reference strings each.
IMPROVEMENT_RULES = [
    ("low_load_factor", ["负载波动较大，建议优化用电设备运行时间", "考虑安装储能设备，平滑用电曲线"]),
    ("high_base_load", ["基础负载较高，建议检查是否存在待机功耗", "使用智能插座，减少待机能耗"]),
    ("high_peak", ["峰值功率过高，建议分散用电高峰", "避免同时使用多个大功率设备"]),
    ("ok", ["能效表现良好，继续保持"]),
]

# FIXED VALUES: texts of the period recommendations and of a missing standard.
BEST_PERIOD_TEXT = "建议将大功率设备使用时间调整至 %s"
WORST_PERIOD_TEXT = "%s 时段用电效率较低，建议减少该时段用电"
NO_STANDARD_TEXT = "暂无 %s 的能效标准数据"

# FIXED VALUES: status words of the reference reports.
STATUS_LABELS = {
    "voltage_quality": {"good": "良好", "attention": "需关注"},
    "pf_quality": {"good": "良好", "improve": "需改善"},
    "voltage_status": {"normal": "正常", "attention": "需关注"},
    "power_status": {"normal": "正常", "abnormal": "异常"},
    "consumption_status": {"normal": "正常", "abnormal": "异常"},
    "deviation": {"high": "偏高", "low": "偏低"},
}

# ---------------------------------------------------------------------------
# FIXED VALUES: file categories by lower-case extension (without dot).
# ---------------------------------------------------------------------------
FILE_TYPES = {
    "image": ["apng", "avif", "bmp", "gif", "heic", "ico", "jpg", "jpeg", "png", "svg", "tiff", "webp"],
    "video": ["mp4", "avi", "mov", "mkv", "flv", "wmv", "webm", "m4v", "3gp"],
    "audio": ["mp3", "wav", "flac", "aac", "ogg", "wma", "m4a"],
    "document": ["pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx",
                 "txt", "md", "csv", "json", "xml", "html", "htm"],
}
# FIXED VALUES: object keys.
KEY_MAX_BYTES = 1024
KEY_ALLOWED_PATTERN = r"^[A-Za-z0-9._\-/]+$"
KEY_BAD_CHAR_PATTERN = r"[^A-Za-z0-9._\-/]"
MAX_FILE_BYTES = 100 * 1024 * 1024

# FIXED VALUES: voltage limits and thresholds.
V_MIN, V_MAX = 198.0, 242.0
LOW_PF = 0.9


def as_df(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A fixed dimension as a broadcast-hinted DataFrame."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def appliance_rows() -> list[tuple]:
    """The catalogue with its order, bands and traits (characteristics joined by ' | ')."""
    traits = {c: (" | ".join(words), usage) for c, words, usage in APPLIANCE_TRAITS}
    return [(i + 1, *a, *traits[a[0]]) for i, a in enumerate(APPLIANCES)]


def appliance_df(spark: SparkSession) -> DataFrame:
    return as_df(spark, appliance_rows(), "ord int, appliance string, appliance_name string, p_lo int, p_hi int, "
                                          "d_lo int, d_hi int, characteristics string, usage_pattern string")


def label_df(spark: SparkSession) -> DataFrame:
    rows = [(c, n, i) for i, (c, n) in enumerate(TRAIN_LABELS)]
    return as_df(spark, rows, "appliance_id string, appliance_name string, label int")


def sql_values(rows, names) -> str:
    """Render a small constant table as a SQL ``VALUES`` list (for oracle SQL)."""
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        return str(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({', '.join(names)})"
