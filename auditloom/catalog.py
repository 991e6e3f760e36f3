"""Small dimension tables: checks, file types, states, rules. All of fixed size, so joins with them may broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SKIPPED = "SKIP_EXECUTION"
SENSITIVE_ITEM = "scanItem99999"
CHUNK_SIZE, ARCHIVE_CHUNK_SIZE, OVERLAP = 2000, 8000, 0

# Check codes, their names, and a short form of the rule; skipped checks have none.
SCAN_ITEMS = [
    ("scanItem1001", "英文资料存在中文字符或乱码", SKIPPED),
    ("scanItem1002", "中文资料存在外语章节", SKIPPED),
    ("scanItem5001", "英文单词拼写错误", "spelling of English words"),
    ("scanItem5002", "中文错别字", "wrong Chinese characters"),
    ("scanItem5003", "英文单词大小写错误", SKIPPED),
    ("scanItem5004", "英文文档低级语法错误", SKIPPED),
    ("scanItem5005", "不规范用语或错误用语", SKIPPED),
    ("scanItem6001", "上下文一致性错误", "one spelling for one term"),
    ("scanItem6002", "标点符号成对匹配检查", "paired punctuation"),
    ("scanItem6003", "标点符号前后的空格错误", SKIPPED),
    ("scanItem6004", "中文文档中使用了半角标点符号", SKIPPED),
    ("scanItem12009", "文档中是否存在乱码", "garbled characters"),
    ("scanItem13002", "产品名称版本合规性检查", SKIPPED),
    ("scanItem14003", "英文中是否有隐藏中文字符", SKIPPED),
    (SENSITIVE_ITEM, "敏感词扫描", SKIPPED),
]
#: A name that only leads to a code.
DEFAULT_NAME = ("default", "错别字、拼写错误")

# Checks that don't suit a language.
UNSUITED = {
    "chinese": ["scanItem1001", "scanItem1002", "scanItem5001", "scanItem5003", "scanItem5004", "scanItem5005", "scanItem6001", "scanItem6002", "scanItem6003", "scanItem6004", "scanItem12009", "scanItem14003"],
    "english": ["scanItem1001", "scanItem1002", "scanItem5002", "scanItem5003", "scanItem5005", "scanItem6001", "scanItem6002", "scanItem6004", "scanItem12009"],
}

# File types, state texts, word pairs, noise lines. A line that begins with a company's own name is noise to that company only: pass its pattern.
FILE_TYPES = [("docx", "Word文档"), ("pdf", "PDF文档"), ("xlsx", "Excel文档"), ("chm", "CHM文档")]
STATUS_TEXTS = [("processing", "任务处理中"), ("error", "任务执行失败")]
TYPO_PAIRS = [("帐号", "账号"), ("步署", "部署"), ("云浮雾", "云服务")]
NOISE_PATTERNS = [r"^\s*\d+\s*$", r"^文档版本\s+\d+", r"^发布日期\s+\d{4}-\d{2}-\d{2}", r"^版权所有\s+©", r"^非经本公司书面许可"]
CAPTION_PATTERN = r"^(表|Table)\s*\d+[-.]?\d*.*"


def scan_items(spark: SparkSession) -> DataFrame:
    """code, name, rule, live."""
    return spark.createDataFrame([(c, n, r, r != SKIPPED) for c, n, r in SCAN_ITEMS], "code string, name string, rule string, live boolean")


def item_codes(spark: SparkSession) -> DataFrame:
    """name → code, with the default name."""
    return spark.createDataFrame([(n, c) for c, n, _ in SCAN_ITEMS] + [DEFAULT_NAME[::-1]], "name string, code string")


def unsuited_items(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, c) for k, v in UNSUITED.items() for c in v], "language string, code string")


def file_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FILE_TYPES, "suffix string, label string")


def status_texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STATUS_TEXTS, "status string, status_text string")


def typo_pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TYPO_PAIRS, "wrong string, right string")
