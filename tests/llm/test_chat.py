import hashlib

from iotrail.llm import chat

ODD = [
    (1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "\\[INST]<s>\\\\"), (1, 2, "user", None),
    (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (2, 0, "user", "b"), (2, 5, "assistant", ""),
    (3, 0, "system", "[" * 9 + "</s"), (None, 1, None, "<"), (None, None, "assistant", "é😀\n"),
    (4, 0, "user", "x" * 200000), (4, 1, "assistant", "y" * 100000), *((5, i, ("user", "assistant")[i % 2], f"t{i}</s>") for i in range(120)),
]


def expected(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        yield (c, len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss))


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "clash", 1) for r in ODD], "conv_id long, turn long, role string, text string, piece string, position int").repartition(3)
    got = [tuple(r)[:5] for r in chat.digests(chat.formatted(df)).collect()]
    key = lambda r: (r[0] is None, r)
    assert sorted(got, key=lambda r: (r[0] is None, r[0] or 0)) == sorted(expected(ODD), key=lambda r: (r[0] is None, r[0] or 0)) and key


def test_each_example_trains_one_reply(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", "so"), (1, 3, "assistant", "ok")], "conv_id long, turn long, role string, text string")
    rows = sorted(chat.expand(df).collect(), key=lambda r: r.position)
    assert [r.text[r.mask_start : r.mask_end] for r in rows] == ["yo", "ok"]
    assert rows[0].text == "<s>[INST]user[/INST]hi</s>[INST]assistant[/INST]yo</s>"
    assert rows[1].text.startswith(rows[0].text)


def test_empty(spark):
    assert chat.digests(chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_examples_hold_what_is_digested(spark):
    df = spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string").repartition(3)
    stored, by = chat.formatted(df), {}
    for r in chat.examples(stored).collect():
        by.setdefault(r.conv_id, []).append(r)
    for d in chat.digests(stored).collect():
        rows = sorted(by.pop(d.conv_id), key=lambda r: r.position)
        loss = "".join(r.text[r.mask_start : r.mask_end].replace("\\\\", "\0").replace("\\", "").replace("\0", "\\") for r in rows)
        assert (sum(len(r.text) for r in rows), len(loss), hashlib.sha256(loss.encode()).hexdigest()) == (d.formatted_chars, d.loss_chars, d.loss_sha256)
        assert [r.last for r in rows] == [False] * (len(rows) - 1) + [True] and rows[-1].n_turns == d.n_turns
        assert all(b.text.startswith(a.text) for a, b in zip(rows, rows[1:]))
    assert not by


def test_written_form_grows_with_the_turns(spark):
    def chars(turns):
        rows = [(1, i, ("user", "assistant")[i % 2], "x" * 100) for i in range(turns)]
        return len(chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first().text)

    assert chars(400) < 4.1 * chars(100)
