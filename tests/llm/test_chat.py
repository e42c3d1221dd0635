from pyspark.sql import functions as F

from siltstone.llm import chat, queries
from tests.conftest import SF_DIR, same


def test_against_sql(spark, duck):
    name = "op9_prefix_targets"
    same(spark, duck, queries.queries()[name], queries.oracle_sql()[name])


def test_examples_have_all_turns_before_as_context(spark):
    turns = [(1, 0, "user", "hi <b>"), (1, 1, "assistant", "### a\\h"), (1, 2, "user", None), (1, 3, "assistant", "</turn>\n")]
    rendered = chat.transcripts(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    whole = rendered.first().formatted
    rows = chat.expand(rendered).orderBy("example").collect()
    assert len(rows) == 2 and all(whole.startswith(r.context + r.target) for r in rows)
    assert rows[1].context.count(chat.TAIL) == 3 and whole.count(chat.TAIL) == 4
    back = rendered.select(chat.read_turns(F.col("formatted")).alias("t")).first().t
    assert [(t.role, t.text) for t in back] == [(r, x or "") for _, _, r, x in turns]


def test_awkward_turns(spark):
    turns = [(None, None, None, None), (None, 1, "assistant", "x"), (2, 1, "a: b", "t"), (2, 1, "a: b", "t"), (3, 0, "user", "only")]
    df = spark.createDataFrame([(*t, 1, "f") for t in turns], "conv_id long, turn long, role string, text string, n_turns long, formatted string")
    rows = {r.conv_id: r for r in chat.digests(chat.transcripts(df)).collect()}
    assert rows[None].n_turns == 2 and rows[None].loss_chars == 1 and rows[2].n_turns == 2 and rows[3].n_examples == 0
    assert chat.digests(chat.transcripts(df.filter("false"))).count() == 0


def test_loss_text_is_that_of_the_examples(spark):
    """Each assistant text once, in order, from the expanded examples, at any number of turns."""
    import hashlib

    turns = [(7, i, "assistant" if i % 2 else "user", f"turn {i} \\ # <") for i in range(25)]
    d = chat.digests(chat.transcripts(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).first()
    loss = "".join(t for _, _, r, t in turns if r == "assistant")
    assert (d.n_examples, d.loss_chars, d.loss_sha256) == (12, len(loss), hashlib.sha256(loss.encode()).hexdigest())
