"""Chat formatting in budgeted windows, in built-in expressions only.

A turn is written as `<turn ROLE>`, a line end, its text, `</turn>` and a line end. Inside
texts a backslash becomes `\\e` and `<` becomes `\\l`; roles also write `>` as `\\g` and a
line end as `\\n`. Every backslash in the output is thus followed by its code, so control
strings in texts can't be mistaken and undoing is a plain replacement.

Windows: running sums of turn tokens choose spans of whole turns. Turns of over half the body budget
stand alone; the others go into the span of the half-budget stretch their running sum falls
in, so a span of several turns never exceeds the body budget. A window is the
conversation's system turn, the last turns of the span before as far as the history budget
goes, and the span. Loss spans cover the span's assistant texts only: what is repeated is masked.

One shuffle, by conversation: all the sums, spans, windows and digests use its order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn ", "</turn>\n"
SYSTEM, TARGET = "system", "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\e")), F.lit("<"), F.lit("\\l"))


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit(">"), F.lit("\\g")), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    for code, plain in (("\\l", "<"), ("\\g", ">"), ("\\n", "\n"), ("\\e", "\\")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def turn_tokens(text: Column) -> Column:
    """An estimate from lengths alone: four characters a token, four tokens a turn."""
    return (F.ceil(F.length(text) / 4) + 4).cast("long")


def windows(turns: DataFrame, *, budget: int = 1024, history_turns: int = 2) -> DataFrame:
    """turns(conv_id, turn, role, text) to one row per window: conv_id, window, repeated, text, loss.

    `repeated` counts the leading turns that repeat earlier ones; `loss` is an array of
    (start, end) in code points of `text`. Half the budget is for the span, a quarter for
    history; a system turn is kept whatever its length, and so is a single turn beyond the budget.

    Null texts and roles count as empty, rows of a null conv_id are one conversation, null
    turns come first. Rows of one turn number follow by role and text; repeated rows all
    stay. An empty table gives an empty one. Other columns are not read.
    """
    body, half, history = budget // 2, budget // 4, budget // 4
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    tokens = turn_tokens(F.col("text"))
    rows = rows.withColumn("tokens", tokens).withColumn("long", (F.col("tokens") > half).cast("long"))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("pos", F.row_number().over(order)).withColumn("longs", F.sum("long").over(so_far)).withColumn("sum", F.sum(F.when(F.col("long") == 0, F.col("tokens")).otherwise(0)).over(so_far))
    before = F.col("sum") - F.when(F.col("long") == 0, F.col("tokens")).otherwise(0)
    span = F.struct((2 * F.col("longs") - F.col("long")).alias("block"), F.floor(before / F.lit(body - half)).alias("stretch"))
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(">\n"))
    item = F.struct(
        "pos",
        "tokens",
        (F.col("role") == TARGET).alias("target"),
        ((F.col("role") == SYSTEM) & (F.col("pos") == 1)).alias("system"),
        head.alias("head"),
        escape(F.col("text")).alias("body"),
    )
    spans = rows.groupBy("conv_id", span.alias("span")).agg(F.array_sort(F.collect_list(item)).alias("turns"))
    by_span = Window.partitionBy("conv_id").orderBy("span")
    last = F.slice("turns", F.when(F.size("turns") < history_turns, -F.size("turns")).otherwise(-history_turns), F.lit(history_turns))
    spans = spans.withColumn("window", F.row_number().over(by_span)).withColumn("last", F.lag(last).over(by_span)).withColumn("first", F.first(F.get("turns", F.lit(0))).over(by_span.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # of the span before, the last turns that fit together
    tail_tokens = lambda i: F.aggregate(F.slice("last", i + 1, F.size("last")), F.lit(0).cast("long"), lambda a, t: a + t["tokens"])
    recent = F.filter("last", lambda t, i: ~t["system"] & (tail_tokens(i) <= history))
    empty = F.slice("turns", 1, 0)
    kept_system = F.when((F.col("window") > 1) & F.col("first")["system"], F.array("first")).otherwise(empty)
    spans = spans.withColumn("before", F.concat(kept_system, F.coalesce(recent, empty)))
    write = lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))
    spans = spans.select("conv_id", "window", "turns", F.size("before").alias("repeated"), F.array_join(F.transform("before", write), "").alias("prefix"))
    start = F.struct(F.length("prefix").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))

    def step(acc: Column, t: Column) -> Column:
        here = acc["at"] + F.length(t["head"])
        end = here + F.length(t["body"])
        loss = F.when(t["target"], F.concat(acc["loss"], F.array(F.struct(here.alias("start"), end.alias("end"))))).otherwise(acc["loss"])
        return F.struct((end + len(CLOSE)).alias("at"), loss.alias("loss"))

    text = F.concat(F.col("prefix"), F.array_join(F.transform("turns", write), ""))
    return spans.select("conv_id", "window", "repeated", text.alias("text"), F.aggregate("turns", start, step)["loss"].alias("loss"))


def read_turns(text: Column, repeated: Column) -> Column:
    """The turns of a window that don't repeat earlier ones, as (role, text)."""
    parts = F.split(text, CLOSE)
    parts = F.slice(parts, repeated + 1, F.size(parts) - 1 - repeated)

    def read(p: Column) -> Column:
        end = F.instr(p, F.lit(">\n"))
        return F.struct(unescape(F.substring(p, F.lit(len(OPEN) + 1), end - 1 - len(OPEN))).alias("role"), unescape(F.substring(p, end + 2, F.length(p))).alias("text"))

    return F.transform(parts, read)


def read_loss(text: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(text, s["start"] + 1, s["end"] - s["start"]))), "")


def chat_query(turns: DataFrame, *, budget: int = 1024) -> DataFrame:
    """Formats the conversations and conversation -7, then reads back what was written, one row per conversation.

    The edge cases of `windows` hold. Turns that the table has under -7 join the two added ones: all of them are one conversation.
    An empty table gives conversation -7 alone."""
    said = "\\### Assistant: </turn> ok"
    spark = turns.sparkSession
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(TARGET).alias("role"), F.lit(said).alias("text"))
    out = windows(turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra), budget=budget)
    back = out.select("conv_id", "window", F.length("text").alias("chars"), read_turns(F.col("text"), F.col("repeated")).alias("turns"), read_loss(F.col("text"), F.col("loss")).alias("loss"))
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    back = back.select("conv_id", "chars", F.size("turns").alias("n"), F.struct("window", F.array_join(F.transform("turns", line), "").alias("said"), "loss").alias("part"))
    per = back.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"), F.array_sort(F.collect_list("part")).alias("parts"))
    joined = lambda f: F.array_join(F.col("parts")[f], "")
    return per.select("conv_id", "n_turns", F.sha2(joined("said").cast("binary"), 256).alias("turns_sha256"), F.length(joined("loss")).cast("long").alias("loss_chars"), F.sha2(joined("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
