"""Chat formatting from event logs, with DataFrame functions only.

``fold`` reconstructs conversations. A log row is (conversation, seq, kind,
message, role, text), where kind is

* ``message``     opens message number ``message`` with its role and text,
* ``delta``       appends text to it (streamed),
* ``edit``        replaces its text,
* ``regenerate``  empties it, for deltas that follow, and drops all later messages
                  opened before.

Logs are partitioned by conversation and sorted by sequence; rows of one message
are reduced together (text since its last opening, edit or regeneration). A message
that was dropped can be opened again. Messages come in order of their number. A regeneration counts
even if its own message was dropped before.

``render`` writes a conversation as

    <s>[INST]role[/INST]text</s>[INST]role[/INST]text</s>...

and escapes the four control strings inside roles and texts: a backslash goes
behind their first character, and behind that of any control string that already
holds backslashes there, so the escape can be undone (``unescape``). ``loss_spans`` marks
the texts of the roles to learn from, in code points of the output: turn number,
where the turn starts, where the text starts, and its length.

Null texts and roles count as empty, null kinds as ``message``. A null conversation is
one of its own, and a null message number one message, the first. Rows without a sequence number come behind those that have one, and rows that tie
in sequence in the order message, regenerate, edit, delta, then of role and text; so a log without any numbers still gives
every text, deltas in the order of their texts. Repeated rows are kept: a delta that is there twice is appended twice. Deltas, edits and regenerations
of a message that no row opens are dropped, as no role is known for them, and rows of other kinds are no events. An empty log
gives no rows. Texts of any length are kept whole; a conversation is one output row, and so folded and written by one task. Other columns of a log are not
read, so they may have any names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, ROLE, ROLE_END, END = "<s>", "[INST]", "[/INST]", "</s>"


def escape(text: Column) -> Column:
    """No control string is left in the result, and ``unescape`` undoes it."""
    text = F.regexp_replace(text, r"<(\\*)(/?s>)", r"<\\$1$2")
    return F.regexp_replace(text, r"\[(\\*)(/?INST\])", r"[\\$1$2")


def unescape(text: Column) -> Column:
    text = F.regexp_replace(text, r"<\\(\\*)(/?s>)", r"<$1$2")
    return F.regexp_replace(text, r"\[\\(\\*)(/?INST\])", r"[$1$2")


def as_log(rows: DataFrame, *, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """The log of finished turns: one ``message`` event each, numbered in order of turn, role and text."""
    order = Window.partitionBy("conversation").orderBy("turn", "role", "text")
    own = rows.select(F.col(conversation).alias("conversation"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    seq = F.row_number().over(order).cast("long")
    return own.select("conversation", seq.alias("seq"), F.lit("message").alias("kind"), seq.alias("message"), "role", "text")


def as_stream(rows: DataFrame, *, conversation: str, turn: str, role: str, text: str, chars: int = 128) -> DataFrame:
    """The log that leads to the same turns as ``as_log`` if they were streamed in deltas of at most ``chars`` code points:
    every other one after a draft that was regenerated, when the next had already been opened, the others after one that was edited."""
    turns = as_log(rows, conversation=conversation, turn=turn, role=role, text=text)
    m, none = F.col("message"), F.lit(None).cast("string")

    def event(kind: str, message: Column, role: Column, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), message.alias("message"), role.alias("role"), text.alias("text"))

    def deltas(pieces: Column) -> Column:
        return F.transform(pieces, lambda p: event("delta", m, none, p))

    parts, own = F.col("parts"), F.col("role")
    first = F.get(parts, 0)
    again = [event("message", m, own, none), event("delta", m, none, first), event("message", m + 1, F.lit("draft"), F.lit("left behind")), event("regenerate", m, none, none)]
    edited = [event("message", m, own, F.try_element_at(parts, F.lit(-1))), event("delta", m, none, first), event("edit", m, none, first)]
    events = F.when(m % 2 == 0, F.concat(F.array(*again), deltas(parts))).otherwise(F.concat(F.array(*edited), deltas(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))))))
    cut = turns.withColumn("parts", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(rf"(?s).{{1,{chars}}}"), F.lit(0)))
    log = cut.select("conversation", m.alias("turn"), F.posexplode(events).alias("at", "event"))
    return log.select("conversation", (F.col("turn") * (1 << 32) + F.col("at")).alias("seq"), "event.*")


#: Kinds in the order in which they come where they tie.
KINDS = ("message", "regenerate", "edit", "delta")
_LAST = (1 << 63) - 1


def fold(log: DataFrame) -> DataFrame:
    """(conversation, message, opened, role, text): the final messages."""
    kind = F.coalesce("kind", F.lit("message"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), kind)
    text = F.coalesce("text", F.lit(""))
    seq = F.coalesce(F.col("seq").cast("long"), F.lit(_LAST))
    rows = log.select("conversation", "message", seq.alias("seq"), rank.alias("rank"), kind.alias("kind"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    rows = rows.filter("rank > 0")
    opens, resets = F.col("kind") == "message", F.col("kind") != "delta"
    event = F.struct("seq", "rank", "role", "text")
    pieces = rows.groupBy("conversation", "message").agg(
        F.max(F.when(opens, event)).alias("open"),
        F.max(F.when(resets, F.struct("seq", "rank", "role", F.when(F.col("kind") == "regenerate", "").otherwise(F.col("text")).alias("text")))).alias("reset"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again"),
        F.collect_list(F.when(F.col("kind") == "delta", F.struct("seq", "text"))).alias("deltas"),
    )
    later = F.filter(F.sort_array("deltas"), lambda d: d.seq >= F.col("reset.seq"))
    before = Window.partitionBy("conversation").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    final = pieces.withColumn("cut", F.max("again").over(before)).filter("open IS NOT NULL AND (cut IS NULL OR cut < open.seq)")
    whole = F.concat(F.col("reset.text"), F.array_join(F.transform(later, lambda d: d.text), ""))
    return final.select("conversation", "message", F.col("open.seq").alias("opened"), F.col("open.role").alias("role"), whole.alias("text"))


def render(messages: DataFrame, learn: Sequence[str] = ("assistant",)) -> DataFrame:
    """(conversation, n_turns, formatted, loss_spans) from final messages."""
    order = Window.partitionBy("conversation").orderBy("message", "opened", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    head = F.concat(F.lit(ROLE), escape(F.col("role")), F.lit(ROLE_END))
    turns = (
        messages.withColumn("turn", F.row_number().over(order) - 1).withColumn("head", head).withColumn("body", escape(F.col("text")))
        .withColumn("piece", F.concat("head", "body", F.lit(END)))
        .withColumn("turn_start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + len(START))
    )
    start = F.col("turn_start") + F.length("head")
    span = F.struct("turn", "turn_start", start.alias("start"), F.length("body").alias("chars"))
    grouped = turns.groupBy("conversation").agg(
        F.count(F.lit(1)).alias("n_turns"), F.sort_array(F.collect_list(F.struct("turn", "piece"))).alias("pieces"),
        F.sort_array(F.collect_list(F.when(F.col("role").isin(*learn), span))).alias("loss_spans"),
    )
    formatted = F.concat(F.lit(START), F.array_join(F.transform("pieces", lambda p: p.piece), ""))
    return grouped.select("conversation", "n_turns", formatted.alias("formatted"), "loss_spans")


def parse(formatted: DataFrame) -> DataFrame:
    """Add ``turns`` (array of role, text, raw) as read back from ``formatted``, and ``learned`` (texts under the loss mask)."""
    pieces = F.split(F.substr("formatted", F.lit(len(START) + 1)), END)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        cut = F.instr(piece, ROLE_END)
        role = F.substr(piece, F.lit(len(ROLE) + 1), cut - len(ROLE) - 1)
        text = F.substr(piece, cut + len(ROLE_END))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    def under_mask(span: Column) -> Column:
        piece = F.get("pieces", span.turn)
        return unescape(F.substr(piece, (span.start - span.turn_start + 1).cast("int"), span.chars))

    rows = formatted.withColumn("pieces", pieces)
    return rows.withColumn("turns", F.transform("pieces", turn)).withColumn("learned", F.transform("loss_spans", under_mask)).drop("pieces")


def format_log(log: DataFrame, learn: Sequence[str] = ("assistant",)) -> DataFrame:
    return render(fold(log), learn)
