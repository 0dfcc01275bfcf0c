import numpy as np
from pyspark.sql import functions as F

from palaver.llm import chat

DATA = "/root/testdata/sf0.1"


def held_out(spark):
    df = spark.read.parquet(f"{DATA}/conversations.parquet")
    learn = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 2 == 0
    convs = {}
    for r in df.where(~learn).orderBy("conv_id", "turn").collect():
        convs.setdefault(r.conv_id, []).append((chat.ROLES.index(r.role), r.text))
    return chat.fit(df.where(learn)), convs


def test_hidden_roles_are_recovered(spark):
    """Role and turn of every line of held-out transcripts, against the commonest state and strict alternation."""
    model, convs = held_out(spark)
    least = {0: 0.999, 1: 0.95, 2: 0.95, 3: 0.99}  # markers, names, nothing, markers for seven of ten turns
    for style, bound in least.items():
        right, turns_right, majority, alternating, turns = 0, 0, [], 0, 0
        for c, own in convs.items():
            text, states = chat.written(own, style, c)
            emission, rows = chat.emissions([chat.lines_of(text)], model)
            right += int((chat.viterbi(emission, rows, model) == np.array(states)).sum())
            majority += states
            roles = [chat.ROLES[r] for r, _ in own]
            turns += len(own)
            turns_right += len(own) * ([r for r, _ in chat.parse([text], model)[0]] == roles)
            alternating += len(own) * ([("user", "assistant")[k % 2] for k in range(len(own))] == roles)
        assert right >= bound * len(majority) and right > 1.5 * np.bincount(majority).max()
        assert turns_right >= 0.93 * turns > alternating


def test_written_states_match_the_lines(spark):
    turns = [(0, "Be brief."), (1, "What?\n\nAnd why?"), (2, "</s>\nSo.\n"), (1, "x")]
    for style in range(4):
        text, states = chat.written(turns, style, 5)
        assert len(chat.lines_of(text)[0]) == len(states) and [s for s in states if s < 3] == [0, 1, 2, 1]


def test_counts_against_a_plain_count():
    turns = [(1, "Who?"), (2, "A long answer. " * 20 + "\nmore"), (1, "ok")]
    start, step, sign, asks, length = np.split(chat.counts(turns, 3), np.cumsum([t.size for t in chat.PRIOR])[:-1])
    step, sign, asks, length = step.reshape(6, 6), sign.reshape(6, 12), asks.reshape(6, 2), length.reshape(6, 4)
    assert start.tolist() == [0, 4, 0, 0, 0, 0] and step[1, 2] == 4 == step[2, 5] == step[5, 1] and step.sum() == 12
    assert asks[1].tolist() == [4, 4] and length[2].tolist() == [0, 0, 4, 0] and length.sum() == 16
    assert sign[5, 2 * chat.NONE] == 4 and sign[1, 2 * chat.USER : 2 * chat.USER + 2].sum() >= 2 and sign[1, 2 * chat.NONE + 1] >= 1


def test_nothing_to_fit_on(spark):
    df = spark.createDataFrame([(1, 0, None, "a"), (1, 1, "user", None), (None, 1, "user", "x"), (2, 1, "bot", "y")], "conv_id long, turn long, role string, text string")
    assert chat.fit(df) is chat.PRIOR and chat.fit(df.limit(0)) is chat.PRIOR


def test_long_texts_and_ties(spark):
    rows = [(1, 0, "user", "word " * 400_000), (1, 1, "assistant", "\n".join(["line"] * 30_000)), (1, 1, "assistant", "again")]
    got = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 1 and got[0].roles == "user,assistant,assistant" and got[0].rendered.count("line") == 30_000
