"""Odd chat records: none of them ends the job, each is whole or marked."""

import json

from listing_radar.llm.chat_format import canonical_turns, conversation_digests, format_turns


def test_odd_records_are_whole_or_marked(spark):
    deep = "[" * 5_000 + "]" * 5_000
    turn = lambda place: json.dumps({"turn": place, "role": "user", "text": "t"})
    cases = [
        ('{"prompt": "\\ud83d", "response": "b\\udc00c"}', [(0, "user", "�"), (1, "assistant", "b�c")]),
        ('{"prompt": "\\ud83d\\ude00", "response": "b"}', [(0, "user", "\U0001f600"), (1, "assistant", "b")]),
        ('{"\\ud800": 1, "prompt": "a", "response": "b"}', [(0, "user", "a"), (1, "assistant", "b")]),
        (turn("1"), [(1, "user", "t")]), (turn(2.0), [(2, "user", "t")]), (turn(None), None), (turn(-(2**63)), [(-(2**63), "user", "t")]),
        (turn("x"), None), (turn(2**63), None), (turn(1.5), None), (turn(True), None), (turn([1]), None), ('{"turn": 1e999, "role": "user", "text": "t"}', None),
        ('{"turn": NaN, "role": "user", "text": "t"}', None), ('{"turn": ' + "9" * 5000 + ', "role": "user", "text": "t"}', None),
        ('{"messages": ' + deep + "}", None), ('{"prompt": "a", "response": "b", "more": ' + '{"x":' * 3_000 + "1" + "}" * 3_000 + "}", None), (deep, None),
    ]
    df = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(cases)], "id long, record string")
    turns = canonical_turns(df, "id", "record")
    got = {}
    for r in turns.collect():
        got.setdefault(r.id, []).append((r.turn, r.role, r.text) if r.layout else None)
    assert {i: sorted(v) if v != [None] else None for i, v in got.items()} == {i: want for i, (_, want) in enumerate(cases)}
    assert conversation_digests(format_turns(turns.where("layout is not null")), "id").count() == 6
