"""Expressions over text: pages, headings, paragraphs, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the chunker, in characters.
SECTION, TARGET = 1500, 1000
# Entities that are replaced.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def html_to_text(html: Column) -> Column:
    """Without scripts, styles, comments and tags; common entities replaced, blanks collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]+>", " ")
    for k, v in ENTITIES.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return strip(F.regexp_replace(F.regexp_replace(out, r"[ \t\x0B\f\r]+", " "), r"\s*\n\s*", "\n"))


def sections(text: Column) -> Column:
    """Split before headings of the first three levels; a heading stays with its section."""
    return F.filter(F.split(text, r"(?m)(?=^#{1,3} )"), lambda s: strip(s) != "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: strip(p)), lambda p: p != "")


def slices(text: Column, size: int) -> Column:
    """Pieces of a fixed number of characters."""
    n = F.greatest(F.ceil(F.length(text) / size), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def _pack(pieces: Column) -> Column:
    """Greedy: a piece joins the last chunk as long as that stays within TARGET characters."""
    empty = F.array().cast("array<string>")

    def add(done: Column, piece: Column) -> Column:
        last = F.element_at(done, -1)
        fits = (F.size(done) > 0) & (F.length(last) + F.length(piece) + 2 <= TARGET)
        return F.when(fits, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat(last, F.lit("\n\n"), piece)))).otherwise(F.concat(done, F.array(piece)))

    return F.aggregate(pieces, empty, add)


def chunks(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, chunk_index, chunk_id, chunk, doc_chars: sections of up to SECTION characters whole, others by paragraphs up to TARGET, longer paragraphs cut."""
    body = F.coalesce(F.col(text), F.lit(""))
    parts = docs.select(F.col(doc), F.length(body).alias("doc_chars"), F.posexplode_outer(sections(body)).alias("s", "section"))
    cut = F.flatten(F.transform(paragraphs(F.col("section")), lambda p: F.when(F.length(p) > SECTION, slices(p, SECTION)).otherwise(F.array(p))))
    packed = F.when(F.length("section") <= SECTION, F.array(strip(F.col("section")))).otherwise(_pack(cut))
    made = parts.groupBy(doc, "doc_chars").agg(F.array_sort(F.collect_list(F.struct("s", packed.alias("c")))).alias("all"))
    flat = made.select(doc, "doc_chars", F.posexplode_outer(F.flatten(F.transform("all", lambda x: F.coalesce(x["c"], F.array().cast("array<string>"))))).alias("chunk_index", "chunk"))
    return flat.select(doc, "chunk_index", F.concat_ws("#", F.col(doc).cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), "chunk", "doc_chars")


# Types of queries in the order in which ties go, and the words that tell them.
TYPES = {
    "impact": (
        "影响", "波及", "牵连", "牵一发", "改动", "改了", "要改", "改哪", "改什么", "依赖谁", "谁依赖", "谁用了", "谁调用", "被谁", "调用方", "消费方", "影响面", "前后端", "跨层", "链路", "改这张表", "改这个表", "改接口", "改端点",
        "被哪些", "哪些函数", "哪些端点", "哪些接口", "哪些页面", "哪些前端", "读写", "读取", "写入", "消费", "使用了", "删掉", "字段", "出问题", "哪些模块", "依赖模块", "影响哪些模块", "列出所有依赖", "数据库表",
        "impact", "affect", "blast radius", "who uses", "who calls", "depend on", "break", "data flow", "database table", "database tables", "everything that touches", "touches the", "rest api", "down to the database",
    ),
    "symbol": (
        "函数", "方法", "类", "定义", "签名", "实现", "在哪", "在哪里", "哪个文件", "调用了谁", "调了谁", "内部调用", "长啥样", "代码里", "callees", "callers",
        "where is", "definition", "signature", "implemented", "calls what", "called by", "call graph",
    ),
    "doc_rule": (
        "规则", "约定", "为什么", "为啥", "设计", "原因", "文档", "事故", "复盘", "操作", "手册", "怎么做", "如何", "应该遵守", "最佳实践", "规范", "考量", "背后的", "提交前", "检查",
        "rule", "why", "design", "convention", "should i", "how to", "best practice", "guideline", "rationale", "behind using",
    ),
    "overview": (
        "概览", "总览", "整体", "干啥", "干什么", "是什么", "做什么", "用来做", "介绍", "项目结构", "目录结构", "技术栈", "有什么用", "这个项目", "这个仓", "定位", "大局", "整体图景",
        "overview", "what does this", "what is this", "purpose of", "high level", "high-level", "walk me through", "how the", "pipeline works", "bigger picture", "role in the bigger picture",
    ),
}


def classify(question: Column) -> Column:
    """The type of which the question holds most words, of several the first of TYPES, without any general."""
    q = F.lower(F.coalesce(question, F.lit("")))
    counts = [F.struct(F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(q, w))).alias("n"), F.lit(-i).alias("p"), F.lit(name).alias("type")) for i, (name, words) in enumerate(TYPES.items())]
    best = F.array_max(F.array(*counts))
    return F.when(best["n"] > 0, best["type"]).otherwise("general")


def is_test(name: Column, file: Column) -> Column:
    """Names that begin with test_, files of tests folders, and files named as tests."""
    n, f = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(file, F.lit("")))
    return F.startswith(n, F.lit("test_")) | f.rlike(r"^tests/|/tests?/|_test\.py$|\.(test|spec)\.ts$")
