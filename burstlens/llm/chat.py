"""Chat formatting in budgeted windows, with DataFrame functions only.

A turn is written as ``### role: text </turn>\\n``. Inside roles and texts a backslash stands
before each backslash, ``#`` and ``<`` (in roles also ``:``), so that the control strings occur
only where the template puts them and every text can be read back.

A conversation becomes windows of whole turns. A running sum of turn tokens opens a new window
where the budget would be exceeded; each window starts with the leading system turns and
repeats a few of the turns before it. Repeated turns are outside the loss mask, so each
assistant text is learnt once. A turn above the budget has a window of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstlens.llm.common import WORD_PATTERN

TURN_END = " </turn>\n"
TURN_TOKENS = 4  # what the template adds to a turn's words
_PATTERN = r"(?s)^### ((?:[^\\:]|\\.)*+): (.*)$"
_WINDOW = (
    "struct<text:string,first_turn:int,n_turns:int,n_repeated:int,n_tokens:bigint,"
    "loss:array<struct<start:int,length:int>>>"
)


def escape_text(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\#<])", r"\\$1")


def escape_role(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\#<:])", r"\\$1")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def _part(turns: Column, first: Column, count: Column) -> Column:
    """``count`` turns from position ``first``, which counts from 0."""
    return F.slice(turns, first + 1, count)


def chat_windows(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    budget: int = 512,
    history_tokens: int = 128,
    history_turns: int = 4,
    learn: str = "assistant",
) -> DataFrame:
    """One row per conversation: ``conv`` and ``windows``, an array of formatted samples.

    A window has its ``text``, the position ``first_turn`` of its first new turn, ``n_turns``
    turns of which the first ``n_repeated`` are system turns and history seen before, its
    ``n_tokens`` and ``loss``, the character ranges of the texts to learn.

    Null texts and roles are empty strings; rows with a null conversation form one of their
    own; a null turn number comes first; equal turn numbers are ordered by role and text, and
    repeated rows stay. Other columns are not looked at; no rows give no rows.
    """
    words = F.regexp_count("text", F.lit(WORD_PATTERN)).cast("bigint")
    rows = turns.select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    # One row per conversation and task goes over the network, however long a conversation is.
    gathered = rows.select(
        "conv", F.struct("turn", "role", "text", (words + TURN_TOKENS).alias("tokens")).alias("t")
    )
    sorted_ = gathered.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    is_system = lambda t: t["role"] == "system"
    others = F.filter(
        F.transform(F.col("turns"), lambda t, i: F.when(~is_system(t), i)),
        lambda i: i.isNotNull(),
    )
    n_system = F.coalesce(F.get(others, F.lit(0)), F.size("turns"))
    counted = sorted_.select("conv", "turns", n_system.alias("n_system")).withColumn(
        "fixed",
        F.aggregate(
            _part(F.col("turns"), F.lit(0), F.col("n_system")),
            F.lit(0).cast("bigint"),
            lambda a, t: a + t["tokens"],
        ),
    )
    zero = F.lit(0).cast("bigint")

    def open_windows(acc: Column, t: Column) -> Column:
        """Running sum; where it would pass the budget, a window opens with its history."""
        sums = F.transform(  # tokens of the last 1, 2, ... turns before this one
            F.sequence(F.lit(1), F.least(F.size(acc["recent"]), F.lit(history_turns))),
            lambda n: F.aggregate(
                F.slice(acc["recent"], -n, n), zero, lambda a, x: a + x
            ),
        )
        fitting = F.filter(
            F.when(F.size(acc["recent"]) > 0, sums).otherwise(F.array().cast("array<bigint>")),
            lambda s: s <= history_tokens,
        )
        n_back = F.size(fitting)
        back = F.coalesce(F.get(fitting, n_back - 1), zero)
        full = (acc["used"] < 0) | (acc["used"] + t["tokens"] > budget)
        opened = F.struct(
            acc["at"].alias("first"), n_back.alias("back")
        )
        recent = F.concat(acc["recent"], F.array(t["tokens"]))
        kept = F.when(
            F.size(recent) > history_turns, F.slice(recent, -history_turns, history_turns)
        ).otherwise(recent)
        return F.struct(
            F.when(full, F.concat(acc["starts"], F.array(opened)))
            .otherwise(acc["starts"])
            .alias("starts"),
            F.when(full, F.col("fixed") + back + t["tokens"])
            .otherwise(acc["used"] + t["tokens"])
            .alias("used"),
            kept.alias("recent"),
            (acc["at"] + 1).alias("at"),
        )

    start = F.struct(
        F.array().cast("array<struct<first:int,back:int>>").alias("starts"),
        F.lit(-1).cast("bigint").alias("used"),
        F.array().cast("array<bigint>").alias("recent"),
        F.col("n_system").alias("at"),
    )
    own = _part(F.col("turns"), F.col("n_system"), F.size("turns") - F.col("n_system"))
    planned = counted.withColumn(
        "starts", F.aggregate(own, start, open_windows, lambda a: a["starts"])
    ).withColumn(
        # System turns alone still make a window.
        "starts",
        F.when(
            F.size("starts") == 0,
            F.array(F.struct(F.col("n_system").alias("first"), F.lit(0).alias("back"))),
        ).otherwise(F.col("starts")),
    )

    def write(window: Column, i: Column) -> Column:
        next_ = F.get(F.col("starts"), i + 1)
        end = F.when(next_.isNull(), F.size("turns")).otherwise(next_["first"])
        system = _part(F.col("turns"), F.lit(0), F.col("n_system"))
        back = _part(F.col("turns"), window["first"] - window["back"], window["back"])
        fresh = _part(F.col("turns"), window["first"], end - window["first"])
        # The first window is where the system turns are new.
        repeated = window["back"] + F.when(i == 0, 0).otherwise(F.col("n_system"))
        empty = F.struct(
            F.lit("").alias("text"),
            F.lit(0).alias("chars"),
            zero.alias("tokens"),
            F.lit(0).alias("n"),
            F.array().cast("array<struct<start:int,length:int>>").alias("loss"),
        )

        def add(acc: Column, t: Column) -> Column:
            head = F.concat(F.lit("### "), escape_role(t["role"]), F.lit(": "))
            body = escape_text(t["text"])
            span = F.struct(
                (acc["chars"] + F.length(head)).alias("start"), F.length(body).alias("length")
            )
            learnt = (acc["n"] >= repeated) & (t["role"] == learn)
            return F.struct(
                F.concat(acc["text"], head, body, F.lit(TURN_END)).alias("text"),
                (acc["chars"] + F.length(head) + F.length(body) + len(TURN_END)).alias("chars"),
                (acc["tokens"] + t["tokens"]).alias("tokens"),
                (acc["n"] + 1).alias("n"),
                F.when(learnt, F.concat(acc["loss"], F.array(span)))
                .otherwise(acc["loss"])
                .alias("loss"),
            )

        return F.aggregate(
            F.concat(system, back, fresh),
            empty,
            add,
            lambda a: F.struct(
                a["text"].alias("text"),
                F.when(i == 0, 0).otherwise(window["first"]).cast("int").alias("first_turn"),
                a["n"].alias("n_turns"),
                repeated.cast("int").alias("n_repeated"),
                a["tokens"].alias("n_tokens"),
                a["loss"].alias("loss"),
            ),
        )

    windows = F.transform(F.col("starts"), write).cast(f"array<{_WINDOW}>")
    return planned.select(F.col("conv").alias(conv), windows.alias("windows"))


def window_rows(formatted: DataFrame) -> DataFrame:
    """One row per window, numbered from 0, for writing training samples."""
    keys = [c for c in formatted.columns if c != "windows"]
    exploded = formatted.select(*keys, F.posexplode("windows").alias("window", "w"))
    return exploded.select(*keys, "window", "w.*")


def read_turns(window: Column) -> Column:
    """The new turns of a window as ``role`` and ``text``, parsed from its formatted text."""
    pieces = F.split(window["text"], TURN_END)
    fresh = F.slice(
        pieces, window["n_repeated"] + 1, F.size(pieces) - 1 - window["n_repeated"]
    )
    return F.transform(
        fresh,
        lambda p: F.struct(
            unescape(F.regexp_extract(p, _PATTERN, 1)).alias("role"),
            unescape(F.regexp_extract(p, _PATTERN, 2)).alias("text"),
        ),
    )


def loss_texts(window: Column) -> Column:
    """The unescaped texts under a window's loss mask."""
    return F.transform(
        window["loss"],
        lambda s: unescape(F.substring(window["text"], s["start"] + 1, s["length"])),
    )


def chat_digest(formatted: DataFrame) -> DataFrame:
    """What can be read back from the formatted windows of each conversation."""
    keys = [c for c in formatted.columns if c != "windows"]
    read = formatted.select(
        *keys,
        F.flatten(F.transform("windows", read_turns)).alias("turns"),
        F.array_join(F.flatten(F.transform("windows", loss_texts)), "").alias("loss"),
        F.aggregate(
            "windows", F.lit(0).cast("bigint"), lambda a, w: a + F.length(w["text"])
        ).alias("formatted_chars"),
        F.size("windows").cast("bigint").alias("n_windows"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        *keys,
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
    )
