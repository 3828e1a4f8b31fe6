"""Chat formatting and WARC archives: folds, round trips and merges."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parkpulse.llm import chat, warc

TEXT = st.text(st.sampled_from("#\\<>/: \nturnA\x00é🙂"), max_size=30)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=5))
def test_what_is_rendered_parses_back(messages):
    text, _ = chat.render(messages)
    assert chat.parse(text) == messages


def test_controls_inside_texts_and_the_loss_mask():
    said = "\\### Assistant: </turn> ok"
    text, mask = chat.render([("user", said), ("assistant", said), ("assistant", "")])
    assert [chat.unescape(text[m["begin"] : m["end"]]) for m in mask] == [said, ""]
    assert text.count("</turn>\n") == 3
    with pytest.raises(ValueError):
        chat.parse(text[:-1])


def test_events_fold_into_messages(spark):
    events = [
        (1, 9, "regenerate", 1, None, None), (1, 10, "delta", 1, None, "bet"), (1, 11, "delta", 1, None, "ter"),
        (1, 0, "open", 0, "user", None), (1, 1, "delta", 0, None, "hel"), (1, 2, "delta", 0, None, "lo"),
        (1, 3, "open", 1, "assistant", None), (1, 4, "delta", 1, None, "bad"), (1, 5, "open", 2, "user", None),
        (1, 6, "delta", 2, None, "no!"), (1, 12, "open", 2, "user", None), (1, 13, "delta", 2, None, "thx"),
        (1, 14, "edit", 2, None, "thanks"), (2, 0, "delta", 0, None, None), (None, 0, "open", 0, None, None),
    ]
    frame = spark.createDataFrame(events, chat._EVENTS).repartition(3)
    got = {r.conv_id: chat.parse(r.formatted) for r in chat.format_conversations(frame).collect()}
    assert got == {1: [("user", "hello"), ("assistant", "better"), ("user", "thanks")], 2: [("", "")], None: [("", "")]}


def test_turns_nulls_ties_and_repeats(spark):
    turns = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, None, None), (1, None, "assistant", "first"), (1, 1, "assistant", "xyz")]
    frame = spark.createDataFrame(turns, "conv_id bigint, turn int, role string, text string")
    row = chat.format_conversations(chat.turns_as_events(frame)).first()
    assert chat.parse(row.formatted) == [("assistant", "first"), ("user", "a"), ("user", "a"), ("", ""), ("assistant", "xyz")]
    none = spark.createDataFrame([], frame.schema)
    assert chat.digests(chat.format_conversations(chat.turns_as_events(none))).count() == 0


# ---- archives


def pages(spark):
    big = "x\r\n\r\nWARC/1.1\r\n" + "é" * 600
    rows = [(i, f"http://www.b.example.com:80/p{i % 3}?q={i}#f", "<p>" + "y" * i) for i in range(1500, 1530)]
    rows += [(1, "https://A.example.com/Z", big), (2, "http://a.example.com/z", big), (3, None, big), (3, None, big)]
    rows += [(4, "", None), (5, "not a url\r\nX: y", "small"), (6, "http://[bad", "small"), (None, "http://a.example.com/n", "n")]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4), rows


def test_archives_round_trip_in_global_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SIZES", ((1000, 7), (1510, 3), (None, 1)))
    frame, rows = pages(spark)
    warc.write_archives(frame, str(tmp_path / "w"))
    runs = warc.capture_runs(spark, str(tmp_path / "w"))
    merged = warc.merge_runs(runs, ranges=3).collect()
    assert len(merged) == len(rows)
    keys = [(r.url_key.encode(), r.captured, r.page_id is not None, r.page_id or 0) for r in merged]
    assert keys == sorted(keys)
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in merged}
    assert kinds[1] == kinds[2] == ("revisit", 3) and kinds[3] == ("response", None) and kinds[5] == ("response", None)
    assert {r.payload_bytes for r in merged if r.page_id in (1, 2, 3)} == {len(rows[30][2].encode())}
    assert {r.page_id for r in merged if r.url_key == "com,example,a)/z"} == {1, 2}
    assert next(r.payload_bytes for r in merged if r.page_id == 4) == 0


@pytest.mark.parametrize("zone", ["Asia/Seoul", "America/New_York"])
def test_any_page_id_gets_a_time_in_utc(spark, tmp_path, zone):
    # 6,042,600 seconds after the epoch is 2024-03-10 02:30, an hour that New York skips.
    ids = [1, 6_042_600, 10**14, 3 * 10**11, 2**63 - 1, -(2**63), -1, None]
    frame = spark.createDataFrame([(i, "http://a.example/", "x") for i in ids], "page_id bigint, url string, html string")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        warc.write_archives(frame, str(tmp_path / "w"))
        merged = warc.merge_runs(warc.capture_runs(spark, str(tmp_path / "w")), ranges=2).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    start = datetime(2024, 1, 1)
    expected = {i: (start + timedelta(seconds=(i or 0) % warc.SPAN)).strftime("%Y-%m-%dT%H:%M:%SZ") for i in ids}
    assert {r.page_id: r.captured for r in merged} == expected
    assert [r.captured for r in merged] == sorted(expected.values())


def test_long_pages_have_archives_of_their_own(spark, tmp_path):
    long = ["é" * (3 << 20), "x" * (25 << 20)]
    rows = [(i, "http://a.example/", "p" * 70_000 + str(i)) for i in range(70)] + list(zip((100, 101), ("u", "v"), long))
    rows += [(i, "http://b.example/", str(i)) for i in range(200, 220)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    warc.write_archives(frame, str(tmp_path / "w"))
    captures = warc.capture_runs(spark, str(tmp_path / "w")).collect()
    assert {r.page_id: r.payload_bytes for r in captures} == {i: len(h.encode()) for i, _, h in rows}
    sizes = Counter(r.archive for r in captures)
    assert sorted(sizes.values()) == [1, 1, 6, 20, 64]
    assert all(sizes[r.archive] == 1 for r in captures if r.page_id in (100, 101))


def test_no_pages(spark, tmp_path):
    frame, _ = pages(spark)
    warc.write_archives(frame.limit(0), str(tmp_path / "w"))
    assert warc.merge_runs(warc.capture_runs(spark, str(tmp_path / "w"))).count() == 0


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree_merges_any_number_of_runs(k):
    rnd = random.Random(k)
    runs, keys = [], []
    for _ in range(k):
        run = sorted(rnd.randrange(50) for _ in range(rnd.randrange(0, 20)))
        runs.append((len(keys), len(keys) + len(run)))
        keys += run
    order = list(warc.LoserTree(keys, runs).merged())
    assert sorted(order) == list(range(len(keys)))
    assert [keys[i] for i in order] == sorted(keys)
    assert all(keys[a:z] == sorted(keys[a:z]) for a, z in warc.natural_runs(keys))
