"""Chat formatting by prefix-target expansion.

A conversation is rendered once, turn after turn:

    ### user: escaped text</turn>
    ### assistant: escaped text</turn>

and every assistant turn becomes an example of its own: the transcript up to the end of that
reply, with only the reply under the loss mask. An example is kept as offsets into the
transcript, so the output grows with the conversation and not with its square; ``expand`` cuts
out the context where a trainer wants it in full.

Escaping is reversible: a backslash becomes ``\\b``, ``#`` becomes ``\\h``, ``<`` becomes ``\\l``
(and in roles ``:`` becomes ``\\c``), so no text can hold a control string.

Defined results: null text and null role count as empty; turns with the same number are ordered
by role, then text; repeated rows are turns of their own; a null conv_id is one conversation; a
conversation without assistant turns has a transcript and no example; an empty table gives an
empty result. Other columns are not read, whatever their names. A conversation has to fit a
task's memory, because it is one string in the end; many conversations share a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, COLON, TAIL = "### ", ": ", "</turn>\n"
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def escape(text: Column, pairs=ESCAPES) -> Column:
    for plain, coded in pairs:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column, pairs=ESCAPES) -> Column:
    for plain, coded in reversed(pairs):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def transcripts(conversations: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, n_turns, formatted, and examples: an array of (start, chars) of each trainable reply in formatted."""
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    head = F.concat(F.lit(HEAD), escape(F.col("role"), ROLE_ESCAPES), F.lit(COLON))
    body = escape(F.col("text"))
    order = ["turn", "role", "text"]
    before = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        turns.withColumn("head", head)
        .withColumn("body", body)
        .withColumn("at", F.coalesce(F.sum(F.length("head") + F.length("body") + F.lit(len(TAIL))).over(before), F.lit(0)).cast("long"))
        .withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)))
    )
    reply = F.when(F.col("role") == trained_role, F.struct("rank", (F.col("at") + F.length("head")).alias("start"), F.length("body").cast("long").alias("chars")))
    return placed.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.concat("head", "body", F.lit(TAIL)).alias("piece")))), lambda s: s["piece"]), "").alias("formatted"),
        F.transform(F.sort_array(F.collect_list(reply)), lambda s: F.struct(s["start"].alias("start"), s["chars"].alias("chars"))).alias("examples"),
    )


def expand(rendered: DataFrame, with_context: bool = True, keep: tuple[str, ...] = (), outer: bool = False) -> DataFrame:
    """One row per trainable reply: conv_id, example (from 0), context_chars, target, and context if wanted.

    The example's text is context + target; the loss mask covers target alone. Columns in ``keep`` are carried along; with
    ``outer``, a conversation without a reply has one row, whose example is null.
    """
    each = F.posexplode_outer if outer else F.posexplode
    rows = rendered.select("conv_id", "formatted", *keep, each("examples").alias("example", "span"))
    cut = lambda start, chars: F.substr("formatted", start.cast("int"), chars.cast("int"))
    out = [F.col("conv_id"), *map(F.col, keep), F.col("example"), F.col("span.start").alias("context_chars"), cut(F.col("span.start") + 1, F.col("span.chars")).alias("target")]
    if with_context:
        out.append(cut(F.lit(1), F.col("span.start")).alias("context"))
    return rows.select(*out)


def read_turns(formatted: Column) -> Column:
    """The array of (role, text) that a transcript was made from."""
    pieces = F.filter(F.split(formatted, TAIL), lambda p: p != "")
    shape = f"(?s)^{HEAD}([^:]*){COLON}(.*)$"
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.regexp_extract(p, shape, 1), ROLE_ESCAPES).alias("role"), unescape(F.regexp_extract(p, shape, 2)).alias("text")
        ),
    )


def digests(rendered: DataFrame) -> DataFrame:
    """What the examples hold, read back: turns, trained text, sizes; one row per conversation.

    Examples lie where their conversation does, so gathering them needs no further shuffle.
    """
    of_turns = ("turns", "turns_sha256", "formatted_chars")
    text = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    whole = rendered.select("conv_id", "formatted", "examples", read_turns(F.col("formatted")).alias("read")).select(
        "conv_id", "formatted", "examples", F.size("read").cast("long").alias("turns"), F.sha2(text, 256).alias("turns_sha256"), F.length("formatted").cast("long").alias("formatted_chars")
    )
    each = F.sort_array(F.collect_list(F.when(F.col("example").isNotNull(), F.struct("example", "target"))))
    back = expand(whole, with_context=False, keep=of_turns, outer=True).groupBy("conv_id").agg(
        *[F.first(c).alias(c) for c in of_turns],
        F.array_join(F.transform(each, lambda e: unescape(e["target"])), "").alias("loss"),
        F.count("example").alias("n_examples"),
        F.coalesce(F.sum(F.col("context_chars") + F.length("target")), F.lit(0)).cast("long").alias("example_chars"),
    )
    return back.select(
        "conv_id", F.col("turns").alias("n_turns"), "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples", "example_chars"
    )
