"""Chat formatting into budgeted, turn-aligned windows with a loss mask, in DataFrame operations only.

Prefix sums of turn tokens choose the windows: turns whose sums end in the same stretch of a grid form one window. The
stretch is as wide as the budget's share for own turns less the conversation's longest ordinary turn, so turns that end in one
stretch never exceed the share, however far the first one reaches back. A turn of over half the share stands alone. So windows
are filled but for one turn's length, no turn is split or dropped, and no window depends on how the ones before it were
filled. Each window repeats the system turn and up to ``history`` short turns before it as context; the loss mask covers
assistant texts among the window's own turns only, so each target counts once.

Turns are marked by control strings; a ``<`` followed by backslashes and a ``|`` in a text gets one more backslash,
which makes control strings impossible inside texts and is undone exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"
TAIL = END + "\n"
TARGET, SYSTEM = "assistant", "system"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def head_of(role: str) -> Column:
    return F.concat(F.lit(START), F.regexp_replace(escape(F.col(role)), "\n", BREAK), F.lit("\n"))


def most_tokens(text: Column) -> Column:
    """A bound on the tokens of a text under any byte-level vocabulary: its bytes, as each token covers one or more."""
    return F.octet_length(text)


def windows(rows: DataFrame, budget: int = 8192, history: int = 2, history_tokens: int = 512, tokens=most_tokens) -> DataFrame:
    """conv_id, window, text, n_context (turns repeated before the window's own), loss array<struct<start, length>> (code points from 0), n_tokens.

    ``rows``: conv_id, turn, role, text. Turns are ordered by turn, ties by role and text, nulls first; repeated rows are
    repeated turns. Null role and text are empty. Null conv_id is one conversation. A conversation without rows has no
    window; no rows give none. Other columns are ignored.

    A conversation that fits the budget is one window. ``tokens`` counts a formatted turn, marks included, or bounds it (default: by its bytes). No window exceeds ``budget`` but
    one that holds a single turn of more than that: very long texts stay whole. A system turn of over half the budget is not repeated; neither is any
    context where the window's one turn leaves no room for it.
    """
    if history * history_tokens > budget // 4:
        raise ValueError("history may take a quarter of the budget at most")
    df = rows.select("conv_id", F.col("turn").alias("__turn"), F.coalesce("role", F.lit("")).alias("__role"), F.coalesce("text", F.lit("")).alias("__text"))
    df = df.withColumn("__n", tokens(F.concat(head_of("__role"), escape(F.col("__text")), F.lit(TAIL))).cast("long"))
    conv = Window.partitionBy("conv_id")
    order = conv.orderBy("__turn", "__role", "__text")
    until = order.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__i", F.row_number().over(order)).withColumn("__end", F.sum("__n").over(until))
    system = F.col("__role") == SYSTEM
    df = df.withColumn("__sys", F.min(F.when(system, F.struct("__i", "__n"))).over(conv))
    df = df.withColumn("__rules", F.when(2 * F.col("__sys.__n") <= budget, F.col("__sys.__n")).otherwise(0))
    df = df.withColumn("__w", F.lit(budget - history * history_tokens) - F.coalesce("__rules", F.lit(0)))
    df = df.withColumn("__big", 2 * F.col("__n") > F.col("__w"))
    df = df.withColumn("__step", F.col("__w") - F.coalesce(F.max(F.when(~F.col("__big"), F.col("__n"))).over(conv), F.lit(0)))
    df = df.withColumn("__cell", F.expr("(__end - 1) div __step"))
    changes = lambda c: F.col(c) != F.lag(c).over(order)
    cut = F.coalesce(changes("__cell") | F.col("__big") | changes("__big"), F.lit(True))
    df = df.withColumn("__first", F.when(F.sum("__n").over(conv) <= budget, F.col("__i") == 1).otherwise(cut))
    df = df.withColumn("__span", F.sum(F.col("__first").cast("long")).over(until))
    # a turn is context of a later window if that starts within ``history`` turns and the turn is short
    for j in range(1, history + 1):
        df = df.withColumn(f"__h{j}", F.when(F.lead("__first", j).over(order), F.lead("__span", j).over(order)))
    df = df.withColumn("__last", F.max("__span").over(conv))
    keeps = system & (F.col("__i") == F.col("__sys.__i")) & (F.col("__rules") > 0)
    later = F.expr("if(__last > __span, sequence(__span + 1, __last), cast(array() as array<bigint>))")
    short = F.array_compact(F.array(*[F.col(f"__h{j}") for j in range(1, history + 1)])) if history else F.array().cast("array<bigint>")
    none = F.array().cast("array<bigint>")
    kind = lambda k, s: F.transform(s, lambda x: F.struct(x.alias("window"), F.lit(k).alias("kind")))
    uses = F.concat(
        F.array(F.struct(F.col("__span").alias("window"), F.lit(2).alias("kind"))),
        kind(0, F.when(keeps, later).otherwise(none)),
        kind(1, F.when(~keeps & (F.col("__n") <= history_tokens), short).otherwise(none)),
    )
    used = df.select("conv_id", "__i", "__role", "__text", "__n", (F.col("__n") > F.col("__w")).alias("__full"), F.explode(uses).alias("__u")).select("*", "__u.*")
    used = used.withColumn("__head", head_of("__role")).withColumn("__body", escape(F.col("__text")))
    piece = F.struct(
        "kind", F.col("__i").alias("i"), F.col("__head").alias("head"), F.col("__body").alias("body"), F.col("__n").alias("n"),
        ((F.col("kind") == 2) & (F.col("__role") == TARGET)).alias("target"), ((F.col("kind") == 2) & F.col("__full")).alias("full"),
    )
    own = used.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(piece)).alias("__p"))
    own = own.withColumn("__p", F.expr("if(exists(__p, p -> p.full), filter(__p, p -> p.kind = 2), __p)"))
    tail = TAIL
    own = own.withColumn("text", F.array_join(F.transform("__p", lambda p: F.concat(p.head, p.body, F.lit(tail))), ""))
    own = own.withColumn("n_context", F.expr("size(filter(__p, p -> p.kind < 2))"))
    fold = f"""aggregate(__p, struct(0 as at, cast(array() as array<struct<start: int, length: int>>) as loss),
        (a, p) -> struct(a.at + length(p.head) + length(p.body) + {len(tail)} as at,
            if(p.target, concat(a.loss, array(struct(a.at + length(p.head) as start, length(p.body) as length))), a.loss) as loss),
        a -> a.loss)"""
    return own.select("conv_id", "window", "text", "n_context", F.expr(fold).alias("loss"), F.expr("aggregate(__p, 0L, (a, p) -> a + p.n)").alias("n_tokens"))


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read from the windows' text and loss alone: conv_id, turns array<struct<role, text>>, loss_text, formatted_chars."""
    df = formatted.withColumn("__raw", F.split("text", START.replace("|", "[|]")))
    df = df.withColumn("__raw", F.slice("__raw", F.col("n_context") + 2, F.size("__raw")))

    def turn(x: Column) -> Column:
        body = F.substring(x, F.lit(1), F.length(x) - len(END) - 1)
        at = F.instr(body, "\n")
        role = unescape(F.regexp_replace(F.substring(body, F.lit(1), at - 1), BREAK.replace("|", "[|]"), "\n"))
        return F.struct(role.alias("role"), unescape(F.substring(body, at + 1, F.length(body))).alias("text"))

    df = df.withColumn("__turns", F.transform("__raw", turn))
    df = df.withColumn("__loss", F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s.start + 1, s.length))))
    rows = df.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "__turns", "__loss"))).alias("__w"), F.sum(F.length("text")).cast("long").alias("formatted_chars"))
    return rows.select(
        "conv_id",
        F.flatten(F.transform("__w", lambda w: w["__turns"])).alias("turns"),
        F.array_join(F.flatten(F.transform("__w", lambda w: w["__loss"])), "").alias("loss_text"),
        "formatted_chars",
    )


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read_back(formatted).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
