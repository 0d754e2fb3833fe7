"""The tools a chat model is told about, and the checks on its calls."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.sources.schemas import TOOL_SPEC

# The declared tools and the system message.
DECLARED_TOOLS = [
    {
        "name": "emotional_expert",
        "description": "情感识别专家",
        "parameters": {
            "type": "object",
            "properties": {"emotion": {"description": "情感类型 e.g. 爱，聊天，作诗"}},
            "required": ["emotion"],
        },
    },
    {
        "name": "flirting_hutao",
        "description": "扮演原神角色胡桃",
        "parameters": {
            "type": "object",
            "properties": {
                "emotion": {"description": "情感类型 e.g. 爱，作诗，聊天"},
                "user": {"description": "调情的对象 e.g. 旅行者，钟离"},
            },
            "required": ["emotion", "user"],
        },
    },
]
SYSTEM_CONTENT = (
    "Answer the following questions as best as you can. You have access to the following tools:"
)
ALLOWED_EMOTIONS = ["爱", "聊天", "作诗"]
# End of fixed values.


def tool_specs(specs: list[dict] | None = None) -> Column:
    """The tool list as a constant array column."""
    text = json.dumps(DECLARED_TOOLS if specs is None else specs, ensure_ascii=False)
    return F.from_json(F.lit(text), f"array<{TOOL_SPEC.simpleString()}>")


def tool_table(spark: SparkSession, specs: list[dict] | None = None) -> DataFrame:
    """The declared tools as rows ``(name, description, parameters)``."""
    return spark.range(1).select(F.inline(tool_specs(specs)))
