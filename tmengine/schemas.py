"""Record shapes and the closed dimensions of the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TM = "row_id long, source string, target string, context string, status string"
INDEX = "pair_id string, source string, target string, context string, status string, priority_rank int, source_tm string, dense array<float>, collection string"
GLOSSARY = "row_id long, source string, target string, category string, notes string"
SEGMENTS = "row_id long, source string, content_type string, dialog_id string, speaker string, time double"
UNIT_MEMBERS = "unit_id string, kind string, pos int, row_id long"
JOB_RESULTS = "task_id string, unit_id string, pos int, row_id long, result string"
WEB_REFERENCE = "struct<title:string,snippet:string,url:string,site_name:string,image_url:string,image_analysis:string>"

# Review labels with rank (1 is best) and ranking weight; any other label has rank 99 and weight 0.85.
STATUSES = (("Designer Reviewed", 1, 1.00), ("CQA_Done", 2, 0.97), ("Done_LQA edited", 3, 0.94), ("Done", 4, 0.90))
UNKNOWN_RANK, UNKNOWN_WEIGHT = 99, 0.85

# Content types in their order, with the class that chooses the rules.
CONTENT_TYPES = (
    ("UI文本", "functional"), ("剧情", "contextual"), ("地区地点", "other"), ("角色/人物", "other"), ("势力", "other"), ("技能", "functional"),
    ("外观", "other"), ("外观描述", "contextual"), ("任务", "functional"), ("任务描述", "functional"), ("任务目标", "functional"), ("成就", "functional"),
    ("武林录", "contextual"), ("entity相关", "functional"), ("提示文本", "functional"), ("通知弹窗", "functional"), ("道具", "functional"), ("药方", "functional"),
    ("话术", "contextual"), ("博物(图鉴)", "contextual"),
)
UNKNOWN_TYPE = "未知"

# Names of language codes.
LANGUAGES = {
    "ZH": "Chinese", "ZHCN": "Chinese", "ZH-CN": "Chinese", "CN": "Chinese", "EN": "English", "ENUS": "English", "EN-US": "English",
    "DE": "German", "DEDE": "German", "DE-DE": "German", "FR": "French", "FRFR": "French", "FR-FR": "French", "JA": "Japanese", "JP": "Japanese",
    "RU": "Russian", "PT": "Portuguese", "ES": "Spanish",
}


def lookup(values: dict, key: Column) -> Column:
    """A constant map read by a column; null where the key is missing."""
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def content_type_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, v, c) for i, (v, c) in enumerate(CONTENT_TYPES)], "ord int, value string, class string")
