"""Chat formatting in budgeted windows (DataFrame functions only).

Prefix sums of turn tokens choose spans that end at turns: a turn belongs to the span its whole token range lies in; a
turn over a border is a span of its own. So every span is known from the sums alone, without a walk along the
conversation. Each span is the target of one window, which begins with the system turn and the turns inside the last
`history` tokens. Those are repeated and masked: the loss mask covers each assistant text once. A window fits the
budget if the system turn fits `system` and no turn is longer than a span; longer ones are kept whole. Prefix sums go in
two steps, within blocks of turn numbers and over the blocks, so a conversation with a third of all rows is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapcube.llm.common import table

BUDGET, HISTORY, SYSTEM = 2048, 256, 256
#: Tokens that the marks of a turn add, and turn numbers in a block.
MARKS, BLOCK = 4, 1024
START, END = "<|im_start|>", "<|im_end|>"
NONE = -(1 << 63)


def tokens(text: Column) -> Column:
    """Tokens of a text as this module counts them: runs of letters, of digits, and other marks."""
    return F.regexp_count(text, F.lit(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"))


def escaped(text: Column) -> Column:
    """One more backslash between `<` and `|`, so that no control string is left; reversible for every text."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def role_mark(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def role_of(mark: Column) -> Column:
    return F.replace(F.replace(F.replace(mark, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def numbered(chats: DataFrame) -> DataFrame:
    """Turns with their number in the conversation and the tokens before and after them."""
    rows = chats.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NONE)).alias("c"), F.coalesce(F.col("turn").cast("long"), F.lit(NONE)).alias("t"),
                        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("n", (tokens(F.col("text")) + MARKS).cast("long")).withColumn("b", F.floor(F.col("t") / BLOCK))
    inside = Window.partitionBy("c", "b").orderBy("t", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("i", F.count(F.lit(1)).over(inside)).withColumn("upto", F.sum("n").over(inside))
    before = Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("c", "b").agg(F.count(F.lit(1)).alias("bi"), F.sum("n").alias("bn"))
    blocks = blocks.select("c", "b", F.coalesce(F.sum("bi").over(before), F.lit(0)).alias("i0"), F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("n0"))
    rows = rows.join(blocks, ["c", "b"])
    return rows.select("c", "role", "text", (F.col("i0") + F.col("i") - 1).alias("i"), (F.col("n0") + F.col("upto") - F.col("n")).alias("begin"), (F.col("n0") + F.col("upto")).alias("end"))


def windows(chats: DataFrame, budget: int = BUDGET, history: int = HISTORY, system: int = SYSTEM) -> DataFrame:
    """One row per window: conv_id, first (number of its first target turn), repeated (leading turns that are repeats),
    text, loss (array of start, length in code points).

    Turns are ordered by turn, role, text, nulls first; a null role or text is empty, a null conv_id is a conversation of
    its own. Repeated rows are turns of their own. Other columns are ignored; empty input gives empty output.
    """
    span = budget - history - system
    turns = numbered(chats).withColumn("s", F.floor(F.col("begin") / span)).withColumn("over", F.floor((F.col("end") - 1) / span) != F.col("s"))
    turns = turns.withColumn("head", F.concat(F.lit(START), role_mark(F.col("role")), F.lit("\n"))).withColumn("body", escaped(F.col("text")))
    key = ["c", "s", "over"]
    own = turns.select(*key, "i", "role", "head", "body", F.lit(False).alias("repeat"))
    later = turns.groupBy(*key).agg(F.min("i").alias("first"), F.min("begin").alias("at")).filter("first > 0")
    # turns inside the last tokens before a window, by buckets of that many tokens
    reach = later.withColumn("k", F.explode(F.sequence(F.floor((F.col("at") - history) / history), F.floor(F.col("at") / history))))
    old = turns.select("c", "i", "role", "head", "body", "begin", "end", F.floor(F.col("begin") / history).alias("k"))
    is_system = (F.col("i") == 0) & (F.col("role") == "system")
    past = reach.join(old.filter(~is_system), ["c", "k"]).filter((F.col("begin") >= F.col("at") - history) & (F.col("end") <= F.col("at")))
    lead = later.join(old.filter(is_system).drop("k"), "c")
    rows = own
    for more in (past, lead):
        rows = rows.unionByName(more.select(*key, "i", "role", "head", "body", F.lit(True).alias("repeat")))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    so_far = Window.partitionBy(*key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.char_length("piece")).over(so_far), F.lit(0)))
    loss = F.when(~F.col("repeat") & (F.col("role") == "assistant"), F.struct((F.col("at") + F.char_length("head")).alias("start"), F.char_length("body").cast("long").alias("length")))
    made = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("i", "piece", loss.alias("loss")))).alias("all"), F.min(F.when(~F.col("repeat"), F.col("i"))).alias("first"), F.count_if("repeat").alias("repeated"))
    conv = F.when(F.col("c") != NONE, F.col("c"))
    return made.select(conv.alias("conv_id"), "first", "repeated", F.array_join(F.transform("all", lambda x: x["piece"]), "").alias("text"),
                       F.filter(F.transform("all", lambda x: x["loss"]), lambda x: x.isNotNull()).alias("loss"))


def read_back(made: DataFrame) -> DataFrame:
    """Per window its own turns (role, text) and its texts under the mask, read from the formatted text."""
    turns = F.split("text", END.replace("|", r"\|") + "\n")
    own = F.slice(turns, F.col("repeated").cast("int") + 1, F.greatest(F.size(turns) - 1 - F.col("repeated").cast("int"), F.lit(0)))
    def parts(x: Column) -> Column:
        x = F.substring(x, len(START) + 1, 2147483647)
        cut = F.instr(x, "\n")
        return F.struct(role_of(F.substr(x, F.lit(1), cut - 1)).alias("role"), unescaped(F.substr(x, cut + 1)).alias("text"))
    return made.select("*", F.transform(own, parts).alias("turns"),
                       F.transform("loss", lambda s: unescaped(F.substr(F.col("text"), (s["start"] + 1).cast("int"), s["length"].cast("int")))).alias("learned"))


def op3_chat_formatting(spark, sf_dir):
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = END + START + "assistant ok"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    w = read_back(windows(chats.unionByName(extra)))
    w = w.select("conv_id", "first", F.size("turns").alias("n"), F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
                 F.array_join("learned", "").alias("learned"), F.char_length("text").alias("chars"))
    # a SHA-256 needs its whole input in one value, so the digest of a conversation is made from one row of it
    conv = w.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("first", "said", "learned"))).alias("all"), F.sum("chars").alias("formatted_chars"))
    said, learned = F.array_join(F.transform("all", lambda x: x["said"]), ""), F.array_join(F.transform("all", lambda x: x["learned"]), "")
    return conv.select("conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.char_length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"), "formatted_chars")
