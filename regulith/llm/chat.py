r"""Chat formatting into budgeted windows.

Every turn is rendered as ``<|im_start|>role<|im_sep|>text<|im_end|>``. Control
strings inside roles and texts are broken up by a backslash behind their first
character, and backslashes are doubled, so the rendering can be undone exactly
and a marker in the output is always the template's own.

Prefix sums of the turns' token costs (words plus the markers) choose
turn-aligned spans: a span is a run of turns whose first tokens lie in the same
block of half the usable budget; a turn above that stands alone, whole. Each
span becomes a window: the conversation's leading system turn, as many turns
before the span as the history budget holds, then the span. Loss spans cover
the texts of the span's assistant turns; what is repeated is masked.

Defined cases: null texts and roles count as empty; rows of a conversation with
the same turn number are ordered by role, then text; repeated rows are turns of
their own; a null conversation id is one conversation; a turn longer than the
budget is kept whole in a window over budget; a conversation of a system turn
alone is one window without loss; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Control strings of this and other chat templates, first character apart.
CONTROL = r"([<\[])(\|[A-Za-z0-9_]*\|>|/?s>|/?INST\]|</?SYS>>)"
BUDGET, HISTORY = 512, 128
OVERHEAD = 4


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows of ``conv_id, turn, role, text`` rows.

    Returns ``conv_id, window_no, text, loss array<struct<start,len>>`` (code
    points from 0), ``system_chars, new_from`` (where the turns begin that no
    earlier window held) and ``n_tokens``.
    """
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("body"))
    by_turn = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "body")
    t = (
        t.withColumn("pos", F.row_number().over(by_turn))
        .withColumn("system", (F.col("pos") == 1) & (F.col("role") == "system"))
        .withColumn("head", F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP)))
        .withColumn("mid", escape(F.col("body")))
        .withColumn("out", F.concat("head", "mid", F.lit(END)))
        .withColumn("cost", (F.regexp_count("body", F.lit(WORD)) + OVERHEAD).cast("long"))
    )
    conv = Window.partitionBy("conv_id")
    order = conv.orderBy("pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    half = F.greatest(F.lit(budget - history) - F.col("system_cost"), F.lit(budget // 4)) / 2
    t = (
        t.withColumn("system_cost", F.coalesce(F.max(F.when(F.col("system"), F.col("cost"))).over(conv), F.lit(0)))
        .withColumn("system_out", F.coalesce(F.max(F.when(F.col("system"), F.col("out"))).over(conv), F.lit("")))
        .withColumn("end", F.sum(F.when(F.col("system"), 0).otherwise(F.col("cost"))).over(so_far))
        .withColumn("start", F.when(F.col("system"), -1 - 2 * history).otherwise(F.col("end") - F.col("cost")))
        .withColumn("block", F.when(F.col("system"), -1).otherwise(F.floor(F.col("start") / half)))
        .withColumn("big", ~F.col("system") & (F.col("cost") > half))
    )
    new = (F.lag("block").over(order).isNull() | (F.col("block") != F.lag("block").over(order)) | F.col("big") | F.lag("big").over(order)) & ~F.col("system")
    t = t.withColumn("window_no", F.greatest(F.sum(F.when(new, 1).otherwise(0)).over(so_far), F.lit(1)).cast("long"))
    past = conv.orderBy("start").rangeBetween(-history, -1)
    t = t.withColumn("past", F.collect_list(F.struct("pos", "out", "cost")).over(past))
    inside = Window.partitionBy("conv_id", "window_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("offset", F.coalesce(F.sum(F.when(F.col("system"), 0).otherwise(F.length("out"))).over(inside), F.lit(0)))
    own = F.struct("pos", "out", "cost", "offset", F.length("head").alias("head"), F.length("mid").alias("len"), (F.col("role") == "assistant").alias("target"))
    w = (
        t.groupBy("conv_id", "window_no")
        .agg(
            F.array_sort(F.collect_list(F.when(~F.col("system"), own))).alias("turns"),
            F.min_by("past", F.when(~F.col("system"), F.col("pos"))).alias("past"),
            F.first("system_out").alias("system_out"),
            F.first("system_cost").alias("system_cost"),
        )
        .withColumn("past", F.array_sort(F.coalesce("past", F.array().cast("array<struct<pos:int,out:string,cost:bigint>>"))))
        .withColumn("before", F.concat("system_out", F.concat_ws("", F.transform("past", lambda x: x["out"]))))
        .withColumn("new_from", F.length("before").cast("long"))
    )
    tokens = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x["cost"])
    return w.select(
        "conv_id",
        "window_no",
        F.concat("before", F.concat_ws("", F.transform("turns", lambda x: x["out"]))).alias("text"),
        F.transform(F.filter("turns", lambda x: x["target"]), lambda x: F.struct((F.col("new_from") + x["offset"] + x["head"]).alias("start"), x["len"].alias("len"))).alias("loss"),
        F.length("system_out").cast("long").alias("system_chars"),
        "new_from",
        (F.col("system_cost") + tokens(F.col("past")) + tokens(F.col("turns"))).alias("n_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Undo ``windows``: per conversation its turns (``array<struct<role,text>>``), the text under the loss mask, and sizes."""
    fresh = F.concat(F.when(F.col("window_no") == 1, F.substring("text", F.lit(1), F.col("system_chars").cast("int"))).otherwise(""), F.substring("text", F.col("new_from").cast("int") + 1, F.length("text")))
    loss = F.concat_ws("", F.transform("loss", lambda x: unescape(F.substring("text", x["start"].cast("int") + 1, x["len"]))))
    whole = (
        formatted.select("conv_id", F.struct("window_no", fresh.alias("fresh"), loss.alias("loss"), F.length("text").cast("long").alias("chars")).alias("w"))
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("w")).alias("w"))
    )
    pieces = F.filter(F.split(F.concat_ws("", F.transform("w", lambda x: x["fresh"])), r"<\|im_end\|>"), lambda x: x != "")
    one = lambda x, i: unescape(F.element_at(F.split(F.substring(x, F.lit(len(START) + 1), F.length(x)), r"<\|im_sep\|>"), i))
    return whole.select(
        "conv_id",
        F.transform(pieces, lambda x: F.struct(one(x, 1).alias("role"), one(x, 2).alias("text"))).alias("turns"),
        F.concat_ws("", F.transform("w", lambda x: x["loss"])).alias("loss_text"),
        F.aggregate("w", F.lit(0).cast("long"), lambda s, x: s + x["chars"]).alias("formatted_chars"),
        F.size("w").cast("long").alias("n_windows"),
    )


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -7: control strings inside the texts."""
    said = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")


def digests(turns: DataFrame) -> DataFrame:
    back = read_back(windows(turns))
    said = F.concat_ws("", F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
    )


CHAT_SQL = r"""
WITH given AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)),
a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS body FROM given),
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, body) AS pos,
        32 + length(regexp_replace(replace(role, '\', '\\'), '([<\[])(\|[A-Za-z0-9_]*\|>|/?s>|/?INST\]|</?SYS>>)', '\1\\\2', 'g'))
           + length(regexp_replace(replace(body, '\', '\\'), '([<\[])(\|[A-Za-z0-9_]*\|>|/?s>|/?INST\]|</?SYS>>)', '\1\\\2', 'g')) AS len,
        length(regexp_replace(body, '[^\x20\x09-\x0D]+', 'x', 'g')) - length(regexp_replace(body, '[^\x20\x09-\x0D]+', '', 'g')) + 4 AS cost FROM a),
c AS (SELECT *, pos = 1 AND role = 'system' AS sys FROM b),
d AS (SELECT *, coalesce(max(CASE WHEN sys THEN cost END) OVER (PARTITION BY conv_id), 0) AS sys_cost,
        coalesce(max(CASE WHEN sys THEN len END) OVER (PARTITION BY conv_id), 0) AS sys_len,
        sum(CASE WHEN sys THEN 0 ELSE cost END) OVER (PARTITION BY conv_id ORDER BY pos) AS fin FROM c),
e AS (SELECT *, CASE WHEN sys THEN -257 ELSE fin - cost END AS beg, greatest(384 - sys_cost, 128) / 2.0 AS half FROM d),
f AS (SELECT *, CASE WHEN sys THEN -1 ELSE floor(beg / half) END AS block, NOT sys AND cost > half AS big FROM e),
g AS (SELECT *, lag(block) OVER (PARTITION BY conv_id ORDER BY pos) AS pblock, lag(big) OVER (PARTITION BY conv_id ORDER BY pos) AS pbig FROM f),
h AS (SELECT *, NOT sys AND (pblock IS NULL OR block <> pblock OR big OR pbig) AS opens,
        coalesce(sum(len) OVER (PARTITION BY conv_id ORDER BY beg RANGE BETWEEN 128 PRECEDING AND 1 PRECEDING), 0) AS hist FROM g)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || body || chr(10), '' ORDER BY pos)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(body) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN body END, '' ORDER BY pos), '')) AS loss_sha256,
       CAST(sum(CASE WHEN sys THEN 0 ELSE len END) + sum(CASE WHEN opens THEN hist ELSE 0 END)
            + max(sys_len) * greatest(sum(CASE WHEN opens THEN 1 ELSE 0 END), 1) AS BIGINT) AS formatted_chars,
       CAST(greatest(sum(CASE WHEN opens THEN 1 ELSE 0 END), 1) AS BIGINT) AS n_windows
FROM h GROUP BY conv_id
"""
