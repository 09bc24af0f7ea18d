"""Fields of message JSON as columns, by VARIANT: no Python, one parse per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import B0, B1, WS, iso_text, trim_ws, utf16_length, whole_json

def distinct_entries(entries: DataFrame) -> DataFrame:
    """One row per (source, entry), that of the greatest ``line_index``; rows without id are kept out.

    Of several rows on that line the one of the greatest ``parent_id`` holds.
    """
    named = entries.filter("entry_id is not null and entry_id <> ''")
    order = F.struct(F.coalesce(F.col("line_index").cast("long"), F.lit(-1)), F.coalesce("parent_id", F.lit("")))
    last = named.groupBy("source_id", "entry_id").agg(F.max_by(F.struct(*(c for c in entries.columns if c not in ("source_id", "entry_id"))), order).alias("_last"))
    return last.select(*(F.col(c) if c in ("source_id", "entry_id") else F.col(f"_last.{c}").alias(c) for c in entries.columns))


def as_blocks(v: Column) -> Column:
    """Content (VARIANT) as an array of (``type``, ``text``, ``name``): a string is one text block, as is a bare string in an array."""
    def block(x: Column) -> Column:
        bare = F.schema_of_variant(x) == "STRING"
        return F.struct(
            F.when(bare, "text").otherwise(F.try_variant_get(x, "$.type", "string")).alias("type"),
            F.when(bare, F.try_variant_get(x, "$", "string")).otherwise(F.try_variant_get(x, "$.text", "string")).alias("text"),
            F.when(~bare, F.try_variant_get(x, "$.name", "string")).alias("name"),
        )

    is_string = F.schema_of_variant(v) == "STRING"
    return F.when(is_string, F.array(block(v))).otherwise(F.transform(F.try_variant_get(v, "$", "array<variant>"), block))


def block_texts(blocks: Column) -> Column:
    """The texts of text blocks that are not empty."""
    return F.coalesce(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & (b["text"] != "")), lambda b: b["text"]), F.array().cast("array<string>"))


def with_message(entries: DataFrame) -> DataFrame:
    """Adds the parsed fields of ``message``: all null where it is no JSON object.

    ``role``, ``stop_reason``, ``tool_name``, ``is_error``, ``error_message``,
    ``command``, ``output``, ``exit_code``, ``own_summary``, ``blocks``,
    ``texts`` (text blocks or the string, empty ones left out) and ``text``
    (joined by line ends and trimmed).
    """
    parsed = entries.withColumn("_v", whole_json("message"))
    parsed = parsed.withColumn("_v", F.when(F.schema_of_variant("_v").startswith("OBJECT"), F.col("_v")))

    def get(path: str, kind: str = "string") -> Column:
        return F.try_variant_get(F.col("_v"), path, kind)

    def only_string(path: str) -> Column:
        return F.when(F.schema_of_variant(F.variant_get(F.col("_v"), path, "variant")) == "STRING", get(path))

    return (
        parsed.withColumn("role", get("$.role"))
        .withColumn("stop_reason", F.nullif(F.coalesce(get("$.stopReason"), get("$.stop_reason"), get("$.message.stopReason")), F.lit("")))
        .withColumn("tool_name", F.coalesce(get("$.toolName"), F.lit("")))
        .withColumn("is_error", F.coalesce(get("$.isError", "boolean"), F.lit(False)) | F.coalesce(get("$.error", "boolean"), F.lit(False)))
        .withColumn("error_message", get("$.errorMessage"))
        .withColumn("command", only_string("$.command"))
        .withColumn("output", only_string("$.output"))
        .withColumn("exit_code", get("$.exitCode", "double"))
        .withColumn("own_summary", only_string("$.summary"))
        .withColumn("message_time", F.coalesce(get("$.timestamp", "long").cast("string"), get("$.timestamp")))
        .withColumn("blocks", as_blocks(F.variant_get(F.col("_v"), "$.content", "variant")))
        .withColumn("texts", block_texts(F.col("blocks")))
        .withColumn("text", trim_ws(F.array_join("texts", "\n")))
        .drop("_v")
    )


def shell_text() -> Column:
    """The text of a shell execution: ``$ command`` and its output, either alone where the other is missing."""
    said = F.coalesce("output", F.array_join("texts", "\n"))
    call = F.concat(F.lit("$ "), F.col("command"))
    return F.when(F.coalesce("command", F.lit("")) == "", said).when(said == "", call).otherwise(F.concat(call, F.lit("\n"), said))


def shell_failed() -> Column:
    """A shell execution that failed: by exit code, without one as any message."""
    return F.coalesce(F.col("exit_code") != 0, is_failure())


def custom_text(content: Column, display: Column, joined: bool = False) -> Column:
    """Texts of the ``content`` (JSON text) of a custom message; ``joined``: one text of a displayed one, trimmed, empty else."""
    v = whole_json(content)
    if not joined:
        return block_texts(as_blocks(v))
    listed = F.filter(as_blocks(F.when(F.schema_of_variant(v).startswith("ARRAY"), v)), lambda b: b["type"] == "text")
    return F.when(F.coalesce(display, F.lit(False)), trim_ws(F.array_join(block_texts(listed), "\n"))).otherwise("")


def without_thinking(message: Column) -> Column:
    """The message (JSON text) of an assistant without its thinking blocks; others as they are."""
    v = whole_json(message)
    blocks = F.try_variant_get(v, "$.content", "array<variant>")
    is_thinking = lambda b: F.coalesce(F.try_variant_get(b, "$.type", "string") == "thinking", F.lit(False))
    fields = F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: k != "content")
    kept = F.to_json(F.map_concat(fields, F.create_map(F.lit("content"), F.parse_json(F.to_json(F.filter(blocks, lambda b: ~is_thinking(b)))))))
    wanted = (F.try_variant_get(v, "$.role", "string") == "assistant") & F.exists(blocks, is_thinking)
    return F.when(F.coalesce(wanted, F.lit(False)), kept).otherwise(message)


def message_iso() -> Column:
    """``message_time`` as ISO text: milliseconds as written by hosts, texts as they are."""
    return F.coalesce(iso_text(F.expr("try_cast(message_time as long)")), F.nullif(F.col("message_time"), F.lit("")))


def has_tool_call() -> Column:
    """Some block calls a tool."""
    return F.coalesce(F.exists("blocks", lambda b: b["type"].isin("toolCall", "tool_call")), F.lit(False))


def is_degenerate() -> Column:
    """An assistant message cut off or failed that calls no tool."""
    cut = (F.col("stop_reason") == "length") | F.col("stop_reason").rlike("(?i)error|max_tokens|max_tool|timeout|interrupt")
    return F.coalesce((F.col("role") == "assistant") & cut & ~has_tool_call(), F.lit(False))


def is_failure() -> Column:
    """A message that reports an error by flag, error message or the begin of a line."""
    begins = F.array_join("texts", "\n").rlike(rf"(?i)(?:^|\n)[{WS}]*(?:error|failed|failure|exception|traceback){B1}")
    return F.col("is_error") | F.coalesce(trim_ws(F.col("error_message")) != "", F.lit(False)) | begins


# The phrases by which texts are judged.
ACKNOWLEDGED = "^(好的?|收到|明白|了解|可以|没问题|继续|开始|我继续|我开始|正在处理|正在检查|我先看看|我先检查|我来处理|稍等)[。！!，,{ws}]*$"
OUTCOME = "(已完成|完成了|已修复|修复后|已解决|解决了|根因|原因是|结论|验证|测试|{b0}pass{b1}|{b0}fail(?:ed)?{b1}|失败|错误|当前状态|仍然|仍需|剩余|未完成|未解决|阻塞|创建了|修改了|删除了|保留|决定|采用|必须|不得|不能|不应该|成功)"
NARRATION = "^(我|现在|接下来|这边)?[{ws}]*(先|会先|准备|正在|继续|开始|将|马上|接下来会|接下来我会)"
IDLE_REQUEST = "^(继续|继续吧|继续处理|继续优化|开始(?:[{ws}]*(?:吧|优化|处理|检查|执行))?|好|好的|可以|行|嗯|确认|你确认吗|再试试|试一下)[。！!？?，,{ws}]*$"
IMPATIENT = "^(为什么|怎么).{{0,18}}(还没好|这么久|这么慢)|^(还没好|好了没|进度怎么样|现在怎么样|你还在吗|快点)"
CONTINUES = "^(继续|接着|往下|继续执行|继续做|继续处理|继续优化)"
MILESTONES = (
    (90, "(已完成|完成了|已修复|已解决|恢复|通过|成功|全链路|验证通过|测试通过|返回[{ws}]*2\\d\\d|{b0}pass(?:ed)?{b1}|{b0}success{b1})"),
    (70, "(根因|原因是|结论|当前状态|当前使用|已更新|已确认|确认.*为|可用节点|不可用节点|assigned_accounts|每节点|必须|不得|只使用|不要用)"),
    (55, "(失败|错误|异常|401|阻塞|未完成|未解决|找不到|冲突|风险)"),
    (35, "{b0}\\d+[{ws}]*/[{ws}]*\\d+{b1}"),
)
EVIDENCE = (
    (80, "(error|exception|traceback|failed|failure|timeout|timed out|aborted|blocked|拒绝|失败|错误|异常|超时|中止)"),
    (60, "({b0}pass(?:ed)?{b1}|tests?|diagnostics?|no diagnostics|验证|测试|通过|成功|clean=|0 fail|0 failed)"),
    (45, "(successfully|created|updated|modified|replaced|written|wrote|saved|deleted|moved|renamed|创建|修改|替换|写入|保存|删除|移动|重命名)"),
    (40, "(running|background|detached|active|pending|completed|done|finished|wait aborted|正在运行|后台|待处理|已完成)"),
)
VERIFIES = "({b0}pass(?:ed)?{b1}|tests?|diagnostics?|验证|测试|通过|0 fail|0 failed)"
MUTATES = "(successfully|created|updated|modified|replaced|written|wrote|saved|deleted|创建|修改|替换|写入|保存|删除)"
REPORTS = "(running|background|detached|active|pending|completed|done|finished|wait aborted|正在运行|后台|待处理|已完成)"
READ_TOOLS = "^(read(?:_.*)?|cat|head|tail|grep|rg|ffgrep|find|glob|ls|search(?:_.*)?|remnic_lcm_search|web_search)$"
TOOL_WEIGHTS = (
    (45, "(edit|write|patch|apply|move|rename|delete|mkdir|install|commit)"),
    (35, "(bash|shell|exec|test|diagnostic|lint|check|verify)"),
    (25, "(subagent|wait|job|task|workflow)"),
)


def spelled(pattern: str) -> str:
    """A phrase pattern with the white space class and ASCII word boundaries filled in."""
    return "(?i)" + pattern.replace("{ws}", WS).replace("{b0}", B0).replace("{b1}", B1).replace("{{", "{").replace("}}", "}")


def matches(x: Column, pattern: str) -> Column:
    """Some part of the text fits the phrase pattern."""
    return x.rlike(spelled(pattern))


def process_only(c: Column) -> Column:
    """Assistant text (compact, as all texts judged here: see ``compact_lower``) that acknowledges or narrates without any outcome."""
    short = (utf16_length(c) <= 24) & matches(c, ACKNOWLEDGED)
    return (c == "") | short | (~matches(c, OUTCOME) & (utf16_length(c) <= 160) & matches(c, NARRATION))


def low_value(c: Column) -> Column:
    """User text without a request of its own."""
    return (c == "") | ((utf16_length(c) <= 24) & matches(c, IDLE_REQUEST)) | matches(c, IMPATIENT)


def continuation(c: Column) -> Column:
    """User text that goes on with the request before."""
    return (c != "") & (low_value(c) | matches(c, CONTINUES))


def _points(c: Column, table) -> Column:
    total = F.lit(0)
    for points, pattern in table:
        total = total + F.when(matches(c, pattern), points).otherwise(0)
    return total


def milestone_score(c: Column) -> Column:
    """How much an assistant text says about the state of the work."""
    return F.when(process_only(c), -1000).otherwise(_points(c, MILESTONES) + F.when(utf16_length(c) >= 90, 10).otherwise(0))


def evidence_signal(c: Column, is_error: Column) -> Column:
    """How much a tool result says about the state of the work."""
    return F.when(c == "", 0).otherwise(F.when(is_error, 100).otherwise(0) + _points(c, EVIDENCE) + F.when(utf16_length(c) >= 120, 10).otherwise(0))


def tool_weight(name: Column, is_error: Column) -> Column:
    """What the kind of tool adds: reading tools never count unless they failed."""
    n = F.lower(trim_ws(name))
    weight = F.when(is_error | (n == ""), 0).when(n.rlike(READ_TOOLS), -1000)
    for points, pattern in TOOL_WEIGHTS:
        weight = weight.when(n.rlike(pattern), points)
    return weight.otherwise(0)


#: What an excerpt begins with.  Fixed value.
EXCERPT_MARK = "[Remnic conversation excerpt (from compaction)]"


def excerpt(summary: Column) -> Column:
    """The first conversation excerpt of a summary: what follows its heading up to the next one; null where there is none or nothing in it."""
    rest = F.regexp_extract(summary, "(?ims)^##+[ \\t]*Conversation[ \\t]+Excerpt[ \\t]*$(.*)", 1)
    body = trim_ws(F.regexp_replace(rest, f"(?s)\\n##+[{WS}]+[^#].*", ""))
    return F.when(body != "", F.concat(F.lit(EXCERPT_MARK + "\n"), body))
