import hashlib
import random

from pyspark.sql import functions as F

from gridloom.llm import chat

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def reference(rows):
    by = {}
    key = lambda x: (x is not None, x if x is not None else "")
    for c, t, r, x in sorted(rows, key=lambda r: ((r[1] is not None, r[1] or 0), key(r[2]), key(r[3]))):
        by.setdefault(c, []).append((r or "", x or ""))
    return {c: (len(ts), sha("".join(f"{r}\n{x}\n" for r, x in ts)), len(loss := "".join(x for r, x in ts if r == "assistant")), sha(loss)) for c, ts in by.items()}


def make(seed=3):
    r = random.Random(seed)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", "~", "~0", "~1", "~2", "<", "[", "</s", "/INST]", "hi", " ", "\n", "é🙂", "<<SYS>>", "<</SYS>>", "\\", "$1"]
    rows = [(c, t, r.choice(["user", "assistant", "system"]), "".join(r.choice(bits) for _ in range(r.randrange(6)))) for c in range(150) for t in range(r.randrange(1, 6))]
    rows += [(200, 0, "user", None), (200, 1, None, "x"), (200, None, "assistant", "y"), (None, 0, "user", "a"), (None, 0, "user", "a")]
    rows += [(201, 0, "role[/INST]\n</s>", "b"), (201, 0, "tool", "c"), (202, 0, "assistant", "z<" * 200_000 + "</s>"), (203, 0, "user", "")]
    return rows


def test_round_trip(spark):
    rows = make()
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("turns", F.lit(2))
    out = chat.format_conversations(d)
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digest(out).collect()}
    assert got == reference(rows)


def test_mask_covers_the_text(spark):
    rows = make(4)
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = reference(rows)
    for r in chat.format_conversations(d).collect():
        at, under = 0, []
        for n, loss in r.loss_runs:
            if loss:
                esc = r.formatted[:at].rpartition("</s>")[2].startswith("<s>[INST]")
                x = r.formatted[at : at + n]
                under.append(x.replace("~2", "<").replace("~1", "[").replace("~0", "~") if esc else x)
            at += n
        assert at == len(r.formatted)
        assert sha("".join(under)) == want[r.conv_id][3]


def test_only_conflicting_turns_are_escaped(spark):
    rows = [(1, 0, "user", "a ~1 < b"), (1, 1, "assistant", "[INST]"), (2, 0, "user", "~0 [")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.formatted for r in chat.format_conversations(d).collect()}
    assert got == {1: "[INST]user[/INST]a ~1 < b</s><s>[INST]assistant[/INST]~1INST]</s>", 2: "[INST]user[/INST]~0 [</s>"}
    assert chat.digest(chat.format_conversations(d.limit(0))).count() == 0


def test_the_digest_reads_the_mask(spark):
    """A mask that is one character off, or of another role, is seen."""
    d = spark.createDataFrame([(1, 0, "user", "ask"), (1, 1, "assistant", "[INST] ~ answer"), (2, 0, "assistant", "plain")], "conv_id long, turn long, role string, text string")
    good = chat.format_conversations(d)
    digest = lambda x: {r.conv_id: (r.loss_chars, r.loss_sha256) for r in chat.digest(x).collect()}
    want = digest(good)
    assert want[1] == (15, sha("[INST] ~ answer")) and want[2] == (5, sha("plain"))
    runs = lambda change: good.withColumn("loss_runs", F.transform("loss_runs", change))
    shifted = good.withColumn("loss_runs", F.concat(F.array(F.struct(F.lit(1).alias("length"), F.lit(False).alias("loss"))), F.col("loss_runs")))
    flipped = runs(lambda r: F.struct(r["length"].alias("length"), (~r["loss"]).alias("loss")))
    for wrong in (shifted, flipped):
        got = digest(wrong)
        assert all(got[i] != want[i] for i in want)


def test_very_many_turns_take_linear_time(spark):
    import time

    took = []
    for n in (2000, 16_000):
        k = F.col("id")
        d = spark.range(n).select(F.lit(1).alias("conv_id"), k.alias("turn"), F.when(k % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é🙂 "), k.cast("string"), F.when(k % 5 == 1, "</s>").otherwise("")).alias("text"))
        rows = [(1, i, "assistant" if i % 2 else "user", f"é🙂 {i}" + ("</s>" if i % 5 == 1 else "")) for i in range(n)]
        began = time.time()
        got = {r.conv_id: tuple(r)[1:5] for r in chat.digest(chat.format_conversations(d)).collect()}
        took.append(time.time() - began)
        assert got == reference(rows)
    assert took[1] < 5 + 16 * took[0]
