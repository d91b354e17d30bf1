from caseweave.llm import chat

TURNS = "pair_id bigint, turn bigint, role string, text string, side string, n int"


def say(spark, rows):
    return spark.createDataFrame([(*r, None, None) for r in rows], TURNS)


def text_of(turns):
    return "".join(f"<|{r or ''}|>\n{t or ''}\n<|end|>\n" for r, t in turns)


def mask_of(turns):
    return ",".join(f"0:{len(f'<|{r or ''}|>') + 1},{int(r == 'assistant')}:{len(t or '') + 9}" for r, t in turns)


def test_pairs_equal_plain_python(spark):
    sides = {
        1: ([("user", "q"), ("assistant", "good")], [("user", "q"), ("assistant", "bad"), ("user", "more")]),
        2: ([("system", "s"), ("user", "q")], [("user", "q")]),
        3: ([("user", "same"), ("assistant", "é" * 50000)], [("user", "same"), ("assistant", "é" * 50000)]),
        4: ([("user", "q"), ("assistant", "a")], [("user", "q")]),
        5: ([(None, None), ("user", "x")], [("", ""), ("user", "y")]),
        6: ([("user", "alone")], []),
    }
    rows = lambda k: [(p, 3 * i + 2, r, t) for p, s in sides.items() for i, (r, t) in enumerate(s[k])]
    found = chat.format_preferences(say(spark, rows(0) + [(None, 1, "user", "lost")]), say(spark, rows(1))).collect()
    assert sorted(r["pair_id"] for r in found) == sorted(sides)
    for r in found:
        c, j = ([(a or "", b or "") for a, b in s] for s in sides[r["pair_id"]])
        n = 0
        while n < min(len(c), len(j)) and c[n] == j[n]:
            n += 1
        assert tuple(r)[1:] == (n, text_of(c[:n]), text_of(c[n:]), text_of(j[n:]), mask_of(c[n:]), mask_of(j[n:]))
        for part, mask in ((r["chosen"], r["chosen_mask"]), (r["rejected"], r["rejected_mask"])):
            assert len(part) == sum(int(x.split(":")[1]) for x in mask.split(",") if x)


def test_ties_and_no_turns(spark):
    tied = say(spark, [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a")])
    got = chat.format_preferences(tied, say(spark, [(1, 5, "user", "a"), (1, 6, "user", "a"), (1, 7, "user", "c")])).first()
    assert (got["prefix_turns"], got["chosen"], got["rejected"]) == (2, text_of([("user", "b")]), text_of([("user", "c")]))
    assert chat.format_preferences(say(spark, []), say(spark, [])).count() == 0


def test_pairs_from_conversations(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "A"), (1, 0, "user", "hi"), (1, 1, "assistant", "B"), (1, 2, "user", "bye"),
            (2, 0, "user", "hi"), (4, 0, "user", None), (4, 1, "assistant", "C"), (None, 0, "user", "x"), (2000, 0, "user", "hi")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    chosen, rejected = chat.swapped_replies(table)
    assert sorted(tuple(r) for r in chosen.collect()) == [(0, 0, "user", "hi"), (0, 1, "assistant", "A"), (2, 0, "user", "hi"),
                                                           (2, 1, "assistant", "B"), (2, 2, "user", "bye")]
    assert sorted(tuple(r) for r in rejected.collect()) == [(0, 0, "user", "hi"), (0, 1, "assistant", "B"), (2, 0, "user", "hi"), (2, 1, "assistant", "A")]
    chosen, rejected = chat.next_openings(table)
    assert {r["pair_id"] for r in chosen.collect()} == {r["pair_id"] for r in rejected.collect()} == {1, 3, 5}


def test_next_openings_over_the_whole_table(spark):
    ids = [1, 1023, 1024, 5000, 70_000, 9_000_000_000] + list(range(100_000, 100_300))
    rows = [(c, 0, "user", "hi") for c in ids] + [(c, 1, "assistant", f"r{c}") for c in ids] + [
        (2, 0, "user", None), (3000, 4, "user", ""), (4, 0, "user", "alone"), (6, 0, "system", "hi"), (None, 0, "user", "hi")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(7)
    chosen, rejected = chat.next_openings(table)
    follow = dict(zip(sorted(ids), sorted(ids)[1:])) | {2: 3000}
    assert {r["pair_id"] for r in chosen.collect()} == {2 * c + 1 for c in follow}
    found = {(r["pair_id"], r["text"]) for r in rejected.where("turn = 1").collect()}
    assert found == {(2 * c + 1, f"r{n}") for c, n in follow.items() if n != 3000}
