"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log of events (conv_id, seq, turn, kind, role, text) is partitioned by conversation,
ordered by sequence and folded into final messages:

- ``message`` starts a turn with a role and text; ``edit`` replaces the turn's text;
- ``delta`` appends streamed text to what the turn holds;
- ``regenerate`` empties a turn (its text, if any, is the new beginning) and withdraws
  later turns that were written before it.

Messages are rendered by a template, ``### role: text</turn>`` and a line feed each.
Inside texts (and roles) the control characters are escaped reversibly, so that neither
a turn's mark nor its end can be forged: backslash as ``\\b``, ``<`` as ``\\l``, ``#`` as
``\\h``, and in roles ``:`` as ``\\c``. The loss mask lists the spans of assistant texts.

Defined results: null text is empty, null role is the empty role, a null turn comes
first; events of equal sequence are ordered by kind, role and text; repeated rows are
events (or turns) of their own; rows with null conv_id form one conversation; extra
columns are ignored; an empty table gives an empty result. A conversation is put together in
one task, as its result is one string: first runs of RUN turns, then the runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the template.
OPEN, SEP, CLOSE = "### ", ": ", "</turn>\n"
RUN = 64  # turns that are joined in a first step


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))
    return F.replace(out, F.lit(":"), F.lit("\\c")) if role else out


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#")), F.lit("\\c"), F.lit(":"))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of an event log."""
    e = events.select("conv_id", "seq", "turn", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    base = F.col("kind") != "delta"
    turns = e.groupBy("conv_id", "turn").agg(
        F.max("seq").alias("last_seq"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("regenerated"),
        F.max(F.when(base, F.struct("seq", "kind", "role", "text"))).alias("base"),
        F.max_by("role", F.when(F.col("role") != "", F.struct("seq", "kind"))).alias("role"),
        F.array_sort(F.collect_list(F.when(~base, F.struct("seq", "kind", "role", "text")))).alias("deltas"),
    )
    live = F.filter("deltas", lambda d: F.col("base").isNull() | (d.seq > F.col("base.seq")))
    text = F.concat(F.coalesce("base.text", F.lit("")), F.array_join(F.transform(live, lambda d: d.text), ""))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("withdrawn", F.max("regenerated").over(before))
    kept = turns.filter("withdrawn is null or last_seq > withdrawn")
    return kept.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask): one string for a conversation and the spans of assistant texts in it."""
    head = F.concat(F.lit(OPEN), escape(F.col("role"), True), F.lit(SEP))
    body = escape(F.col("text"))
    m = messages.withColumn("head", head).withColumn("body", body)
    m = m.withColumn("line", F.concat("head", "body", F.lit(CLOSE)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    m = m.withColumn("place", F.row_number().over(order))
    m = m.withColumn("at", F.coalesce(F.sum(F.length("line").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    start = F.col("at") + F.length("head")
    span = F.when(F.col("role") == "assistant", F.struct(start.alias("start"), (start + F.length("body")).alias("end")))
    m = m.select("conv_id", (F.col("place") / RUN).cast("long").alias("run"), "place", "line", span.alias("span"))
    runs = m.groupBy("conv_id", "run").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines"), F.collect_list("span").alias("spans"))
    runs = runs.select("conv_id", "run", F.array_join(F.transform("lines", lambda x: x.line), "").alias("piece"), "spans")
    whole = runs.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("run", "piece"))).alias("pieces"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("loss_mask"))
    return whole.select("conv_id", F.array_join(F.transform("pieces", lambda x: x.piece), "").alias("formatted"), "loss_mask")


def parse(formatted: Column) -> Column:
    """Turns read back from a rendered conversation: array of (role, text)."""
    lines = F.filter(F.split(formatted, CLOSE), lambda x: x != "")

    def turn(line: Column) -> Column:
        role = F.substring_index(F.substring(line, len(OPEN) + 1, 1 << 30), SEP, 1)
        text = F.substring(line, F.length(role) + len(OPEN) + len(SEP) + 1, F.length(line))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(lines, turn)


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(formatted, (s.start + 1).cast("int"), (s.end - s.start).cast("int")))), "")


def _placed(rows: DataFrame) -> DataFrame:
    """Finished turns (conv_id, turn, role, text) with their place in the conversation, from 1."""
    r = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return r.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long"))


def as_events(rows: DataFrame) -> DataFrame:
    """Finished turns as an event log: one message event for each row, in turn order."""
    return _placed(rows).select("conv_id", F.col("place").alias("seq"), F.col("place").alias("turn"), F.lit("message").alias("kind"), "role", "text")


def as_streamed_events(rows: DataFrame) -> DataFrame:
    """Finished turns as the log of a live chat that ends with just those turns.

    By a hash of its conversation and place a turn is written at once, streamed in three
    deltas, drafted and then edited, or streamed, answered too early by another turn,
    regenerated (which withdraws that answer) and streamed again. Turns get even numbers.
    """
    text, role = F.col("text"), F.col("role")
    third = F.floor(F.length(text) / 3).cast("int")
    parts = [F.substring(text, F.lit(1), third), F.substring(text, third + 1, third), F.substring(text, 2 * third + 1, F.length(text))]
    turn = 2 * F.col("place")

    def event(kind: str, body: Column, by: Column = role, at: Column = turn) -> Column:
        return F.struct(at.alias("turn"), F.lit(kind).alias("kind"), by.alias("role"), body.alias("text"))

    nothing = F.lit("")
    stories = [
        [event("message", text)],
        [event("message", nothing), *(event("delta", p, nothing) for p in parts)],
        [event("message", F.concat(F.lit("draft of "), parts[0])), event("delta", F.lit(" to come"), nothing), event("edit", text, nothing)],
        [event("message", parts[2]), event("delta", parts[0], nothing), event("message", F.lit("too early"), F.lit("user"), turn + 1), event("regenerate", parts[0], nothing), event("delta", parts[1], nothing), event("delta", parts[2], nothing)],
    ]
    way = F.pmod(F.xxhash64("conv_id", "place"), F.lit(len(stories)))
    told = F.array(*stories[0])
    for i, story in enumerate(stories[1:], 1):
        told = F.when(way == i, F.array(*story)).otherwise(told)
    log = _placed(rows).select("conv_id", "place", F.posexplode(told).alias("step", "e"))
    return log.select("conv_id", (16 * F.col("place") + F.col("step")).alias("seq"), "e.*")


def digests(rendered: DataFrame) -> DataFrame:
    """What a rendered conversation says when read back."""
    turns = parse(F.col("formatted"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    out = rendered.withColumn("loss", loss_text(F.col("formatted"), F.col("loss_mask")))
    return out.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
