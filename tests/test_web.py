"""Search responses, result pages and answer pages made by hand."""

import json

from pyspark.sql import functions as F

from talkloom.functions.prompts import DEFAULT_PERSONA_INFO
from talkloom.operators import web as W
from talkloom.sources.records import split_rejects

PAGE = """<html><body>
<li class="x b_algo y"><h2 id=1><a name="no"></a><a href="http://a?x=1&amp;y=2">T <b>one</b> &amp; A&lt;B</a></h2><p>s</p></li>
<li class="b_algo"><p>no heading</p><a href="/lost">x</a></li>
<li class="b_algo"><h2>no link</h2><a href="/outside">x</a></li>
<li class="b_algo_other"><h2><a href="/other">other</a></h2></li>
<div class="b_algo"><div class="b_algo"><h2><a href=/in>In</a></h2></div></div>
</body></html>"""


def test_search_snippets(spark):
    hits = lambda *items: json.dumps({"items": list(items)}, ensure_ascii=False)
    responses = [
        hits({"title": "T", "snippet": "s"}, {"snippet": "only"}, {"title": "third"}),
        hits({"title": "T"}, {}),
        hits({"title": "", "snippet": "e"}),
        hits(),
        "{}",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(responses)), "i int, r string").orderBy("i")
    got = [r[0] for r in df.select(W.search_snippets(F.col("r"))).collect()]
    none = "No Search Result was found"
    assert got == ["T。s\n\nonly", "T。\n\n", "。e", none, none, none]


def test_result_blocks(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, "<p>none</p>")], "id int, html string")
    found = W.extract_results(pages, "id")
    got = [(r.pos, r.title, r.url) for r in found.orderBy("pos").collect()]
    assert got == [
        (0, "Tone&amp;A&lt;B", "http://a?x=1&y=2"),
        (1, None, None),
        (2, "nolink", None),
        (3, "In", "/in"),
        (4, "In", "/in"),
    ]
    good, bad = split_rejects(found, ["title", "url"])
    assert good.count() == 3 and bad.count() == 2


ANSWERS = """<div class="List-item"><div class="RichText ztext CopyrightRichText-richText css-117anjg">第 一<br>x</div>
<span class="RichText ztext CopyrightRichText-richText css-117anjg">second</span></div>
<div class="List-item"><div class="RichText ztext">missing</div></div>
<div class="List-item"><p><i class="RichText  ztext CopyrightRichText-richText css-117anjg">b &amp; c</i></p></div>
<div class="rich-content-container rich-text-">  one <!-- note --> </div>
<div class="rich-text- rich-content-container">wrong order</div>"""


def test_answer_blocks_by_both_selectors(spark):
    pages = spark.createDataFrame([(1, ANSWERS), (2, "")], "id int, html string")
    for rule, expected in zip(W.SOURCE_RULES, [["第一x", "b&amp;c"], ["one"]]):
        found = W.extract_answers(pages, ["id"], rule[3], rule[4]).orderBy("id").collect()
        assert [r.answers for r in found] == [expected, []]


def test_answers_of_links(spark):
    zhihu, baidu = "http://zhihu.com/question/", "http://zhidao.baidu.com/question/"
    pages = spark.createDataFrame(
        [(zhihu + "1", ANSWERS), (baidu + "1", ANSWERS), (zhihu + "2", ANSWERS.replace("第", "长" * 400))],
        "url string, html string")
    links = spark.createDataFrame(
        [
            (7, "知乎回答", 0, "a 知乎", zhihu + "2"),
            (7, "知乎回答", 1, "a 知乎", zhihu + "1"),
            (7, "知乎回答", 2, "a 知乎", zhihu + "1"),
            (7, "知乎回答", 3, "no", zhihu + "1"),
            (7, "知乎回答", 4, "a 知乎", "http://zhihu.com/other"),
            (7, "知乎回答", 5, "a 知乎", zhihu + "404"),
            (7, "百度知道", 0, "百度", baidu + "1"),
            (7, "百度知道", 1, "百度", zhihu + "1"),
            (7, "其他", 0, "知乎百度", zhihu + "1"),
        ],
        "query_id long, choice string, pos long, title string, url string")
    questions = spark.createDataFrame(
        [(7, "知乎回答"), (7, "百度知道"), (7, "其他"), (8, "知乎回答")], "query_id long, choice string")
    got = {(r.query_id, r.choice): (r.answers, r.urls) for r in
           W.answer_list(questions, links, pages).collect()}
    assert got == {
        (7, "知乎回答"): (["来源1:" + "长" * 300, "来源2:第一x b&amp;c", "来源3:"],
                      [zhihu + "2", zhihu + "1", zhihu + "404"]),
        (7, "百度知道"): (["来源1:one"], [baidu + "1"]),
        (7, "其他"): ([], []),
        (8, "知乎回答"): ([], []),
    }


def test_default_info_and_rules(spark):
    users = spark.createDataFrame([(1,), (2,)], "id long")
    infos = spark.createDataFrame([(1, "own")], "id long, info string")
    got = {r.id: r.info for r in W.info_or_default(users, infos, "id", DEFAULT_PERSONA_INFO).collect()}
    assert got == {1: "own", 2: DEFAULT_PERSONA_INFO}
    assert [r.choice for r in W.source_rules(spark).collect()] == ["知乎回答", "百度知道"]


def test_blocks_whose_class_is_written_otherwise_are_found(spark):
    def page(name):
        return f'<div {name}><h2><a href="/x">X</a></h2></div>'

    spelled = ['class="a  b"', 'class="a&#32;b"', "CLASS = 'a\n&#98;'", 'class="&#97; b"', 'class="ab"', 'id="a b"']
    pages = spark.createDataFrame([(i, page(s)) for i, s in enumerate(spelled)], "id int, html string")
    found = W.extract_results(pages, "id", block="a b")
    assert sorted(r.id for r in found.collect()) == [0, 1, 2, 3]


def test_a_page_stored_twice_is_one_source(spark):
    url = "https://zhidao.baidu.com/question/1"
    answer = '<div class="rich-content-container rich-text-">{}</div>'
    stored = [(url, answer.format("short")), (url, answer.format("the longer")), (url, "<p></p>")]
    pages = spark.createDataFrame(stored, "url string, html string")
    links = spark.createDataFrame(
        [(1, "百度知道", 0, "t 百度", url)], "query_id int, choice string, pos long, title string, url string"
    )
    sources = W.collect_sources(links, pages).collect()
    assert [[tuple(s) for s in r.sources] for r in sources] == [[("thelonger", url)]]
