from lodeline.llm import quotes

ROWS = [
    (1, 0, "user", "How do I sort a list in place? I have tried sorted already."),
    (1, 1, "assistant", "> How do I sort a list in place?\nUse the sort method of the list."),
    (1, 2, "user", ">> How do I sort a list in place?\n> Use the sort method of the list.\nThat works, thanks a lot."),
    (1, 3, "user", "> I HAVE tried   sorted already.\nSorted returns a new list."),
    (2, 0, "user", "> That works, thanks a lot.\nGlad to hear that."),
    (2, 1, "user", "> Never said by anyone here.\nUnlinked text stays here."),
    (2, 2, "user", "> a b\nshort quotes link nothing"),
    (3, 0, "user", None),
    (3, 1, None, ""),
    (None, 4, "user", "> Use the sort method of the list.\nx"),
    (4, 0, "user", "> only a quote without own text"),
]


def run(spark, rows):
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, depth int").repartition(3)
    return quotes.conversations(df)


def test_links_roots_and_own_text(spark):
    got = {(r.conv_id, r.turn): r for r in run(spark, ROWS).collect()}
    assert len(got) == len(ROWS)
    parent = {k: (r.parent_conv, r.parent_turn) for k, r in got.items() if r.parent_conv is not None}
    assert parent == {(1, 1): (1, 0), (1, 2): (1, 1), (1, 3): (1, 0), (2, 0): (1, 2)}
    assert {k: (r.root_conv, r.root_turn, r.depth) for k, r in got.items() if k in parent} == {(1, 1): (1, 0, 1), (1, 2): (1, 0, 2), (1, 3): (1, 0, 1), (2, 0): (1, 0, 3)}
    assert got[2, 1].depth == 0 and (got[2, 1].root_conv, got[2, 1].root_turn) == (2, 1)
    assert got[1, 2].own_text == "That works, thanks a lot." and got[1, 2].n_quotes == 2
    assert got[3, 0].own_text is None and got[3, 1].own_text == "" and got[4, 0].own_text == ""


def test_long_chain(spark):
    rows = [(1, 0, "u", "statement number 0 of the chain")]
    rows += [(1, i, "u", f"> statement number {i - 1} of the chain\nstatement number {i} of the chain") for i in range(1, 40)]
    got = {r.turn: r for r in run(spark, rows).collect()}
    assert all((got[i].root_turn, got[i].depth) == (0, i) for i in range(40))


def test_matches_brute_force(spark):
    import random

    rng = random.Random(3)
    said = [f"passage number {i} said before." for i in range(12)]
    rows = []
    for conv in range(6):
        for turn in range(8):
            quoted = "".join(f"> {s}\n" for s in rng.sample(said, rng.randrange(3)))
            rows.append((conv, turn, "u", quoted + "\n" + " ".join(rng.sample(said, 2))))
    parsed = {(c, t): quotes.read_message(x) for c, t, _, x in rows}
    want = {}
    for key, (_, _, cites, _) in parsed.items():
        votes = {}
        for passage in cites:
            near = [k for k, p in parsed.items() if k[0] == key[0] and passage in p[1]]
            every = [k for k, p in parsed.items() if passage in p[1]]
            to = min(near) if near and min(near) < key else min(every) if every and min(every) < key else None
            if to:
                votes[to] = votes.get(to, 0) + 1
        if votes:
            want[key] = max(votes, key=lambda k: (votes[k], k))
    got = {(r.conv_id, r.turn): (r.parent_conv, r.parent_turn) for r in run(spark, rows).where("parent_conv is not null").collect()}
    assert got == want


def test_empty(spark):
    assert run(spark, ROWS).limit(0).count() == 0
    assert quotes.conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_deeper_levels_and_single_lines(spark):
    rows = [
        (1, 0, "u", "line one of text\nline two of text\nand a third without an end"),
        (1, 1, "u", "> line two of text\nmy answer is in here"),
        (1, 2, "u", ">> line one of text\nonly the grandparent is quoted"),
        (1, 3, "u", ">> line one of text\n>> line two of text\n> my answer is in here\nboth levels, the first counts"),
        (1, 4, "u", ">> line two of text\n> said by nobody at all\nthe first level is not found"),
    ]
    got = {r.turn: r for r in run(spark, rows).collect()}
    assert {t: r.parent_turn for t, r in got.items()} == {0: None, 1: 0, 2: 0, 3: 1, 4: 0}
    assert [got[t].depth for t in range(5)] == [0, 1, 1, 2, 1] and all(r.root_turn == 0 for r in got.values())
