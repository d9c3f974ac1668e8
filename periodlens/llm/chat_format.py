"""Chat formatting by event-sourced reconstruction (DataFrame functions only).

A log has one row per event: ``conv_id, seq, event, message_id, role, text``.

* ``message`` sets a message's text; without a message_id it is a message of its own;
* ``delta`` appends streamed text;
* ``edit`` replaces the text, ``regenerate`` clears it (or sets it) for new deltas:
  both also discard the messages begun between the message and the event, which
  answered what is no longer there;
* ``delete`` removes the message, unless a later ``message`` or ``edit`` sets it again.

Defined cases: null text, role and event mean '', '' and ``message``; equal seq is
ordered by event, message id, role, text; repeated rows count as often as they
stand; a null conv_id is a conversation like any other; unknown events count as
``delta``; an empty log gives no conversation. Extra columns are ignored.

Scale: the order within a conversation, the fold of a message and the rendering
are keyed shuffles. A conversation's rendering is one string by definition, so
one conversation has to fit one row; everything else is spread over its key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
RESETS = ("message", "edit", "regenerate", "delete")
REWINDS = ("edit", "regenerate")


def escape(text: Column) -> Column:
    """No ``<|`` is left: one backslash more inside every ``<``, backslashes, ``|``."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def rows_as_events(conversations: DataFrame) -> DataFrame:
    """Finished turns as a log: every row is a message of its own."""
    return conversations.select(
        "conv_id", F.col("turn").alias("seq"), F.lit("message").alias("event"),
        F.lit(None).cast("string").alias("message_id"), "role", "text")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages: ``conv_id, at`` (order in the conversation)``, role, text``."""
    in_conv = Window.partitionBy("conv_id").orderBy(
        "seq", "event", "message_id", "role", "text")
    e = (events.select(
            "conv_id", "seq", F.coalesce(F.lower("event"), F.lit("message")).alias("event"),
            F.col("message_id").cast("string").alias("message_id"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"))
         .withColumn("n", F.row_number().over(in_conv))
         .withColumn("own", F.col("message_id").isNull())
         .withColumn("message_id", F.coalesce("message_id", F.col("n").cast("string"))))
    key = ["conv_id", "own", "message_id"]
    whole = Window.partitionBy(*key)
    n_if = lambda kinds: F.when(F.col("event").isin(*kinds), F.col("n"))
    e = (e.withColumn("begun", F.min("n").over(whole))
         .withColumn("reset", F.coalesce(F.max(n_if(RESETS)).over(whole), F.lit(0)))
         .withColumn("rewound", F.max(n_if(REWINDS)).over(whole))
         .withColumn("speaker", F.min_by("role", F.when(F.col("role") != "", F.col("n")))
                     .over(whole))
         .where(F.col("n") >= F.col("reset")))
    # After a regenerate without text of its own, deltas rebuild the message.
    pieces = F.array_sort(F.collect_list(F.struct("n", "text")))
    m = e.groupBy(*key, "begun").agg(
        F.coalesce(F.max("speaker"), F.lit("")).alias("role"),
        F.max("rewound").alias("rewound"),
        F.min_by("event", "n").alias("first_event"),
        F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("text"))
    before = (Window.partitionBy("conv_id").orderBy("begun")
              .rowsBetween(Window.unboundedPreceding, -1))
    return (m.withColumn("cut", F.max("rewound").over(before))
            .where((F.col("first_event") != "delete")
                   & (F.col("cut").isNull() | (F.col("cut") < F.col("begun"))))
            .select("conv_id", F.col("begun").alias("at"), "role", "text"))


def render(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``conv_id, n_turns, formatted, segments``: the segments, each marked as inside
    or outside the loss, joined are the formatted text."""
    turns = F.array_sort(F.collect_list(F.struct("at", "role", "text")))

    def parts(t: Column) -> Column:
        return F.array(
            F.struct(F.concat(F.lit(START), F.url_encode(t["role"]), F.lit("\n")).alias("text"),
                     F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), t["role"].isin(*loss_roles).alias("loss")),
            F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")))

    return (messages.groupBy("conv_id")
            .agg(F.count(F.lit(1)).alias("n_turns"), turns.alias("turns"))
            .withColumn("segments", F.flatten(F.transform("turns", parts)))
            .select("conv_id", "n_turns",
                    F.array_join(F.transform("segments", lambda s: s["text"]), "")
                    .alias("formatted"), "segments"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    def turn(part: Column) -> Column:
        head = F.substring_index(part, "\n", 1)
        body = F.substr(part, F.length(head) + 2,
                        F.length(part) - F.length(head) - 1 - len(END))
        return F.struct(F.url_decode(head).alias("role"), unescape(body).alias("text"))

    parts = F.split(formatted, START.replace("|", r"\|"))
    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), turn)


def digest(rendered: DataFrame) -> DataFrame:
    """What the formatted text and its loss mask say, read back from them."""
    lines = F.transform(read_back(F.col("formatted")),
                        lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learnt = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]),
                                      lambda s: unescape(s["text"])), "")
    return (rendered.withColumn("lines", lines).withColumn("learnt", learnt)
            .select("conv_id", F.size("lines").cast("long").alias("n_turns"),
                    F.sha2(F.array_join("lines", ""), 256).alias("turns_sha256"),
                    F.length("learnt").cast("long").alias("loss_chars"),
                    F.sha2("learnt", 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars")))
