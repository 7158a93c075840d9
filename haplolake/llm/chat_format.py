"""Chat formatting from event logs: fold streamed events into final messages, render, read back.

An event has a conversation, a sequence number, the message it concerns (any ordered value), a kind,
a role and a text. ``message`` and ``edit`` set the text, ``delta`` appends to it, and ``regenerate``
drops what the message and all later messages of the conversation had before and starts anew with its
own text.

A log is partitioned by conversation and sorted by sequence once. Read backwards, a running minimum tells
each event whether a later regeneration drops it; what is left is folded message by message, in sequence;
turns are then joined in message order. All of that is grouped by the conversation, so nothing is
shuffled again. A conversation's output is one text, so it meets in one task, by definition; windows over
it spill, and a fold holds one message.

A rendered turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Within roles and texts, a backslash is put
between ``<`` and ``|`` (one more, if there are some), so no control string is left inside; a line end
in a role is written ``<!|``, and a ``<!|`` that was there gets one more ``!``. Both are undone exactly.
The loss mask of a formatted conversation lists the texts of assistant turns, as escaped: start and length
in bytes of its UTF-8.

Reading back takes the formatted text and the mask alone: turns are what stands between control strings,
and loss texts are what the mask covers. A text in which they were not escaped would be read as others.

Only DataFrame functions are used. Defined cases: null texts and roles are empty; null conversation ids
form one conversation; null message keys come first; events of one message that share a sequence number
are taken in order of message, kind and text; a delta without a message starts from the empty text; an empty log gives no turns. Further columns of a log are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"
#: Code points of a streamed delta, at least, and deltas of a message, at most.
DELTA_CHARS, MOST_DELTAS = 256, 16


def escape_text(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape_text(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\\\|", "<$1|")


def escape_role(c: Column) -> Column:
    return F.replace(F.regexp_replace(escape_text(c), r"<(!+)\|", "<$1!|"), F.lit("\n"), F.lit("<!|"))


def unescape_role(c: Column) -> Column:
    return unescape_text(F.regexp_replace(F.replace(c, F.lit("<!|"), F.lit("\n")), r"<(!+)!\|", "<$1|"))


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value), with value computed once though the body's lambdas use it at every element."""
    return F.transform(F.array(value), body)[0]


def as_log(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, seq, message, kind, role, text: the log that a streaming front end would have left behind these final turns.

    A turn is first a draft. An assistant's draft is followed by a next message that comes to nothing, since
    the turn is then regenerated; another's draft is edited. Either way its text streams in as deltas. Rows
    that share conversation and turn are messages of their own, in order of role and text.
    """
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    whole = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), whole(role).alias("role"), whole(text).alias("text"))
    turns = turns.withColumn("message", F.row_number().over(order).cast("long"))
    size = F.greatest(F.lit(DELTA_CHARS), F.ceil(F.length("text") / MOST_DELTAS).cast("int"))
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), size), lambda i: F.substring(F.col("text"), i, size))
    again = F.col("role") == TRAINED_ROLE

    own = F.col("message")

    def event(step: int | Column, message: Column, kind: str, role: Column, text: Column) -> Column:
        return F.struct((own * 64 + step).alias("seq"), message.alias("message"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))

    draft = event(0, own, "message", F.col("role"), F.concat(F.lit("draft of "), parts[0]))
    vain = event(1, own + 1, "message", F.lit("user"), F.lit("to be dropped"))
    again = event(2, own, "regenerate", F.col("role"), F.lit(""))
    edit = event(2, own, "edit", F.col("role"), F.lit(""))
    begun = F.when(F.col("role") == TRAINED_ROLE, F.array(draft, vain, again)).otherwise(F.array(draft, edit))
    streamed = F.transform(parts, lambda x, i: event(i + 3, own, "delta", F.lit(""), x))
    return turns.select("conv", F.explode(F.concat(begun, streamed)).alias("e")).select(F.col("conv").alias(conv), "e.*")


def reconstruct(events: DataFrame, conv: str = "conv_id", seq: str = "seq", message: str = "message", kind: str = "kind", role: str = "role", text: str = "text") -> DataFrame:
    """conv, message, role, text of every message that is left at the end of the log."""
    e = events.select(
        F.col(conv).alias("conv"), F.col(seq).alias("seq"), F.col(message).alias("message"), F.col(kind).alias("kind"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    # The least message that is regenerated later on. A null key is before all others, so the key is told from null.
    key = F.struct(F.col("message").isNotNull().alias("given"), F.col("message").alias("key"))
    later = Window.partitionBy("conv").orderBy(*(F.desc(c) for c in ("seq", "message", "kind", "text"))).rowsBetween(Window.unboundedPreceding, -1)
    regenerated = e.withColumn("least", F.min(F.when(F.col("kind") == "regenerate", key)).over(later))
    left = regenerated.filter(F.col("least").isNull() | (F.col("least") > key))
    folded = left.groupBy("conv", "message").agg(F.sort_array(F.collect_list(F.struct("seq", "kind", "text", "role"))).alias("p"))
    # The last event that sets the text, and the deltas after it.
    opening = F.greatest(F.coalesce(F.array_max(F.transform("p", lambda x, i: F.when(x["kind"] != "delta", i + 1))), F.lit(1)), F.lit(1))
    whole = F.array_join(F.transform(F.slice("p", opening, F.size("p")), lambda x: x["text"]), "")
    named = F.filter("p", lambda x: x["role"] != "")
    return folded.select(F.col("conv").alias(conv), F.col("message").alias(message), F.when(F.size(named) > 0, F.element_at(named, -1)["role"]).otherwise("").alias("role"), whole.alias("text"))


def render(messages: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """messages with rendered (one turn of the template), loss_start and loss_bytes (its mask; 0 bytes: none)."""
    head = F.concat(F.lit(START), escape_role(F.col(role)), F.lit("\n"))
    body = escape_text(F.col(text))
    trained = F.when(F.col(role) == TRAINED_ROLE, F.octet_length(body)).otherwise(0)
    made = {"rendered": F.concat(head, body, F.lit(f"{END}\n")), "loss_start": F.octet_length(head).cast("long"), "loss_bytes": trained.cast("long")}
    return messages.withColumns(made)


def assemble(turns: DataFrame, conv: str = "conv_id", message: str = "message") -> DataFrame:
    """conv, formatted (all its turns in order) and loss_spans (start and length in bytes) from rendered turns."""
    before = Window.partitionBy("conv").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    t = turns.select(F.col(conv).alias("conv"), F.col(message).alias("message"), "rendered", "loss_start", "loss_bytes")
    at = F.coalesce(F.sum(F.octet_length("rendered").cast("long")).over(before), F.lit(0).cast("long")) + F.col("loss_start")
    row = F.struct("message", "rendered", at.alias("start"), F.col("loss_bytes").alias("length"))
    whole = t.select("conv", row.alias("r")).groupBy("conv").agg(F.sort_array(F.collect_list("r")).alias("r"))
    spans = F.transform(F.filter("r", lambda x: x["length"] > 0), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    return whole.select(F.col("conv").alias(conv), F.array_join(F.transform("r", lambda x: x["rendered"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(conversations: DataFrame, conv: str = "conv_id") -> DataFrame:
    """conv, turns (role and text of each), loss (texts under the mask) and formatted_chars, parsed from formatted and loss_spans alone."""
    ended = F.split("formatted", r"<\|im_end\|>")  # the last part is what follows the last turn
    inner = F.transform(F.slice(ended, F.lit(1), F.size(ended) - 1), lambda p: F.regexp_replace(p, r"^\n?<\|im_start\|>", ""))
    turns = F.transform(inner, lambda p: F.struct(unescape_role(F.substring_index(p, "\n", 1)).alias("role"), unescape_text(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p))).alias("text")))
    loss = _let(F.col("formatted").cast("binary"), lambda b: F.transform("loss_spans", lambda s: unescape_text(F.substring(b, s["start"].cast("int") + 1, s["length"].cast("int")).cast("string"))))
    return conversations.select(conv, turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))


def digests(parsed: DataFrame, conv: str = "conv_id") -> DataFrame:
    """n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of every conversation, from read_back."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return parsed.select(conv, F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
