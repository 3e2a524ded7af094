import random

from parley.sources.turns import pairs_from_turns


def expected(rows):
    by_conversation = {}
    for conv, turn, role, text in rows:
        by_conversation.setdefault(conv, []).append((turn, role, text))
    pairs = set()
    for conv, turns in by_conversation.items():
        turns.sort()
        for (turn, role, text), (_, next_role, next_text) in zip(turns, turns[1:]):
            if role == "user" and next_role == "assistant":
                pairs.add((conv, turn, text, next_text))
    return pairs


def test_blocks_do_not_change_pairs(spark):
    source = random.Random(5)
    rows = []
    for conv in range(6):
        # Conversation 0 is hot; turns have gaps, some larger than a block.
        turns = sorted(source.sample(range(400), 150 if conv == 0 else 12))
        for turn in turns:
            role = source.choice(["user", "assistant", "system"])
            rows.append((conv, turn, role, f"{conv}-{turn}"))
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    for bits in (1, 2, 3, 12):
        got = {(r.conv_id, r.turn, r.input, r.output) for r in pairs_from_turns(frame, bits).collect()}
        assert got == expected(rows), bits


def test_row_ids_are_unique_and_ordered(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", "x") for c in range(3) for t in range(6)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = pairs_from_turns(frame).orderBy("row_id").collect()
    assert [(r.conv_id, r.turn) for r in got] == sorted((r.conv_id, r.turn) for r in got)
    assert len({r.row_id for r in got}) == 9
