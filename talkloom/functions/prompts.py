"""Prompt templates and the Column builders that fill them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wording of the prompts.
INTENT_TEMPLATE = """
    有一些参考资料，为:{docs}
    你的任务是根据「参考资料」来理解用户问题的意图，并判断该问题属于哪一类意图。
    注意：你输出的意图应该是概率最高的那一个，不能是多个
    用户问题：“{query}”
    """
SEARCH_QA_TEMPLATE = """
    请根据下面带```分隔符的文本来回答问题。
    通过Search，如果该文本中没有相关内容可以回答问题，请直接回复：“抱歉，通过Search该问题需要更多上下文信息。”
    ```{text}```
    问题：{query}
    """
QA_TEMPLATE = """
    请根据下面带```分隔符的文本来回答问题。
    ```{text}```
    问题：{query}
    """
CLASSIFICATION_CONTEXT = "Instruction: 你是一个非常厉害的[词条名称]多层级分类模型"
CHAT_CONTEXT = (
    "Instruction: 你是一个聊天机器人，需要根据用户的输入完成聊天任务，你需要根据下面这些背景知识来回答："
)
RETRIEVAL_INSTRUCTION = "为这个句子生成表示，用于检索相关文章："
PERSONA_TEMPLATE = (
    "你扮演原神游戏中的胡桃。现在{user}说他想跟你{emotion}，需要模仿胡桃的语气给{user}一个回复。"
    "你可以参考下面这一段胡桃的台词做出回复：{info}"
)
DEFAULT_PERSONA_INFO = (
    "1.咳咳…太阳出来我晒太阳，月亮出来我晒月亮咯~  2.嗯~早起身体好，晚睡人会飘！"
    "3.天权凝光，富甲一方；明眸善睐，桃羞杏让；目达耳通，百了千当  "
    "4.力量若达到极限，接着考验的便是人心。多亏了你，我才能来到这片未曾踏足的领域。"
    "在这里，心和灵魂就像一片云彩…生老病死，天地万象，尽在吾辈。"
)
SEARCH_TOOL = "搜索问答"
CLASSIFICATION_TOOL = "文本分类"
DEFAULT_TOOL = "default"
# End of fixed values.

QA_TEMPLATES = {
    SEARCH_TOOL: SEARCH_QA_TEMPLATE,
    CLASSIFICATION_TOOL: QA_TEMPLATE,
    DEFAULT_TOOL: QA_TEMPLATE,
}


def template_parts(template: str) -> list[tuple[str, bool]]:
    """``(piece, is_field)`` pieces of a template with ``{field}`` marks."""
    pieces = re.split(r"\{(\w+)\}", template)
    return [(piece, bool(i % 2)) for i, piece in enumerate(pieces) if piece]


def fill(template: str, **values: Column) -> Column:
    """One ``concat`` of the fixed text and the values; marks inside values stay text."""
    return F.concat(
        *[values[piece] if is_field else F.lit(piece) for piece, is_field in template_parts(template)]
    )


def format_example(instruction: Column, extra: Column, output: Column) -> tuple[Column, Column]:
    """``(context, target)`` of an instruction record; an empty or null input adds no line."""
    has_input = F.coalesce(extra, F.lit("")) != ""
    context = F.concat(
        F.lit("Instruction: "),
        instruction,
        F.lit("\n"),
        F.when(has_input, F.concat(F.lit("Input: "), extra, F.lit("\n"))).otherwise(F.lit("")),
        F.lit("Answer: "),
    )
    return context, output


def intent_prompt(docs: Column, query: Column) -> Column:
    return fill(INTENT_TEMPLATE, docs=docs, query=query)


def qa_prompt(tool: Column, text: Column, query: Column) -> Column:
    """The answer prompt of the row's tool; an unknown tool gives null."""
    branches = None
    for name, template in QA_TEMPLATES.items():
        filled = fill(template, text=text, query=query)
        branches = (
            F.when(tool == name, filled) if branches is None else branches.when(tool == name, filled)
        )
    return branches


def classification_context() -> Column:
    return F.lit(CLASSIFICATION_CONTEXT)


def chat_context(knowledge: Column) -> Column:
    return F.concat(F.lit(CHAT_CONTEXT), knowledge)


def query_instruction(query: Column) -> Column:
    """The text to encode for a query; passages are encoded as they are."""
    return F.concat(F.lit(RETRIEVAL_INSTRUCTION), query)


def persona_prompt(user: Column, emotion: Column, info: Column) -> Column:
    """``info`` is an array of lines, printed one per line."""
    return fill(PERSONA_TEMPLATE, user=user, emotion=emotion, info=F.array_join(info, "\n"))
