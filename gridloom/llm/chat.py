"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar, one turn after another (BODY and ROLE hold no control string)::

    conversation := turn*
    turn         := "[INST]" ROLE "[/INST]" BODY "</s>"
                  | "<s>" "[INST]" ROLE "[/INST]" BODY "</s>"      with ROLE and BODY escaped

Every conversation is rendered plainly and parsed again by a deterministic, strict parser. Where the
recovered turns differ from the source, or the parser meets a control string inside a body, the
turns that hold control strings or the escape sign are rendered escaped, and the result is parsed
again; a conversation that would still differ stops the query. Escaping writes ``~`` as ``~0``,
``[`` as ``~1`` and ``<`` as ``~2``, so no control string can be left, and is undone in the order
``~2 ~1 ~0``.

Scale: one shuffle, which brings a conversation's turns together, as its one text demands; what is
done to a conversation is linear in its length (but for masks that weren't made here, see masked()).

Defined results: turns are ordered by turn, role and text, nulls first, and repeated rows are turns
of their own; a null role or text is an empty one; rows whose conv_id is null form one conversation;
an empty table gives none. Columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END, HEAD, TAIL = "<s>", "</s>", "[INST]", "[/INST]"
#: What no role or body may hold: the grammar's own strings and the system marks of its family.
CONTROL = (BEGIN, END, HEAD, TAIL, "<<SYS>>", "<</SYS>>")
#: The escape sign first, so that it is undone last.
ESCAPES = (("~", "~0"), ("[", "~1"), ("<", "~2"))
LOSS_ROLE = "assistant"


def escape(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ESCAPES, c)


def unescape(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[1]), F.lit(e[0])), reversed(ESCAPES), c)


def has_control(c: Column) -> Column:
    return reduce(lambda x, y: x | y, [F.contains(c, F.lit(s)) for s in CONTROL])


def _rendered(turns: Column, escaping: bool) -> Column:
    """For each turn its role, header, body and end as they stand in the text."""

    def one(t: Column) -> Column:
        plain = F.struct(t["role"].alias("role"), F.concat(F.lit(HEAD), t["role"], F.lit(TAIL)).alias("header"), t["text"].alias("body"))
        if not escaping:
            return plain
        escaped = F.struct(t["role"].alias("role"), F.concat(F.lit(BEGIN + HEAD), escape(t["role"]), F.lit(TAIL)).alias("header"), escape(t["text"]).alias("body"))
        return F.when(has_control(t["role"]) | has_control(t["text"]), escaped).otherwise(plain)

    return F.transform(turns, one)


def _text(rendered: Column) -> Column:
    return F.array_join(F.transform(rendered, lambda t: F.concat(t["header"], t["body"], F.lit(END))), "")


def parse(formatted: Column) -> Column:
    """The turns of a formatted text: role, text and whether the grammar holds, then once for the text's end."""
    pieces = F.split(formatted, END, -1)
    marked = F.transform(pieces, lambda p: F.struct(F.startswith(p, F.lit(BEGIN)).alias("e"), F.when(F.startswith(p, F.lit(BEGIN)), F.substr(p, F.lit(len(BEGIN) + 1))).otherwise(p).alias("p")))
    split = F.transform(
        F.slice(marked, 1, F.size(marked) - 1),
        lambda m: F.struct(m["e"].alias("e"), (F.startswith(m["p"], F.lit(HEAD)) & F.contains(m["p"], F.lit(TAIL))).alias("ok"), F.substr(F.substring_index(m["p"], TAIL, 1), F.lit(len(HEAD) + 1)).alias("role"), m["p"].alias("p")),
    )
    bodies = F.transform(split, lambda t: F.struct(t["e"].alias("e"), t["ok"].alias("ok"), t["role"].alias("role"), F.substr(t["p"], F.length(t["role"]) + len(HEAD) + len(TAIL) + 1).alias("body")))
    turns = F.transform(
        bodies,
        lambda t: F.struct(
            F.when(t["e"], unescape(t["role"])).otherwise(t["role"]).alias("role"),
            F.when(t["e"], unescape(t["body"])).otherwise(t["body"]).alias("text"),
            (t["ok"] & ~has_control(t["role"]) & ~has_control(t["body"])).alias("ok"),
        ),
    )
    end = F.struct(F.lit("").alias("role"), F.lit("").alias("text"), (F.element_at(pieces, -1) == "").alias("ok"))
    return F.concat(turns, F.array(end))


def _same(parsed: Column, turns: Column) -> Column:
    """Whether the grammar holds throughout and the recovered turns are the source's."""
    found = F.transform(F.slice(parsed, 1, F.size(parsed) - 1), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return F.forall(parsed, lambda t: t["ok"]) & (found == turns)


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, and loss_runs: the text as runs of code points (length, loss), in order."""
    source = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    convs = turns.select("conv_id", "turn", F.col("role").cast("string"), F.col("text").cast("string")).groupBy("conv_id").agg(source.alias("turns"))
    plain = convs.withColumn("plain", _rendered(F.col("turns"), False))
    tried = plain.withColumn("good", _same(parse(_text(F.col("plain"))), F.col("turns")))
    final = tried.withColumn("rendered", F.when(F.col("good"), F.col("plain")).otherwise(_rendered(F.col("turns"), True))).withColumn("formatted", _text(F.col("rendered")))
    kept = final.filter(F.when(F.col("good") | _same(parse(F.col("formatted")), F.col("turns")), True).otherwise(F.raise_error(F.lit("a conversation does not survive the round trip")).cast("boolean")))
    run = lambda n, loss: F.struct(n.alias("length"), loss.alias("loss"))
    runs = F.flatten(F.transform("rendered", lambda t: F.array(run(F.length(t["header"]), F.lit(False)), run(F.length(t["body"]), t["role"] == LOSS_ROLE), run(F.lit(len(END)), F.lit(False)))))
    return kept.select("conv_id", "formatted", runs.alias("loss_runs"))


def _cut_anywhere(formatted: Column, runs: Column) -> Column:
    """masked() for runs that may lie anywhere; its work grows with the square of their number."""
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("escaped"), F.array().cast("array<string>").alias("found"))

    def step(acc: Column, r: Column) -> Column:
        piece = F.substr(formatted, acc["at"] + 1, r["length"])
        text = F.when(acc["escaped"], unescape(piece)).otherwise(piece)
        return F.struct(
            (acc["at"] + r["length"]).alias("at"),
            (~r["loss"] & F.startswith(piece, F.lit(BEGIN))).alias("escaped"),
            F.when(r["loss"], F.concat(acc["found"], F.array(text))).otherwise(acc["found"]).alias("found"),
        )

    return F.array_join(F.aggregate(runs, start, step)["found"], "")


def masked(formatted: Column, runs: Column) -> Column:
    """The text under the loss mask, unescaped: each run is cut out where the lengths before it say.

    A loss run is escaped if the run before it, its turn's header, begins like an escaped turn. Runs that
    come as header, body and end of each turn, as format_conversations() makes them, are cut out of
    the pieces between the ends, which is linear; whether they do so is decided by their lengths.
    """
    pieces = F.split(formatted, END, -1)
    n = F.size(pieces) - 1
    of = lambda i, k: F.element_at(runs, 3 * i + k)
    fits = F.transform(F.slice(pieces, 1, n), lambda p, i: (of(i, 1)["length"] + of(i, 2)["length"] == F.length(p)) & (of(i, 3)["length"] == len(END)))
    aligned = (F.size(runs) == 3 * n) & (F.element_at(pieces, -1) == "")

    def cut(p: Column, i: Column) -> Column:
        head, body, end = of(i, 1), of(i, 2), of(i, 3)
        text = F.substr(p, head["length"] + 1, body["length"])
        inner = F.when(~head["loss"] & F.startswith(p, F.lit(BEGIN)), unescape(text)).otherwise(text)
        some = lambda r, t: F.when(r["loss"], t).otherwise(F.lit(""))
        return F.concat(some(head, F.substr(p, F.lit(1), head["length"])), some(body, inner), some(end, F.lit(END)))

    by_turn = F.array_join(F.transform(F.slice(pieces, 1, n), cut), "")
    return F.when(aligned & F.forall(fits, lambda f: f), by_turn).otherwise(_cut_anywhere(formatted, runs))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) recovered from the formatted text alone, and loss_text, what its mask names."""
    out = formatted.withColumn("parsed", parse(F.col("formatted")))
    turns = F.transform(F.slice("parsed", 1, F.size("parsed") - 1), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return out.withColumn("turns", turns).withColumn("loss_text", masked(F.col("formatted"), F.col("loss_runs"))).drop("parsed")


def digest(formatted: DataFrame) -> DataFrame:
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(formatted).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
