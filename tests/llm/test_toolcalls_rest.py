"""Repeated calls and results without a call keep their place and text."""

from quirework.llm import toolcalls
from quirework.llm.queries import TOOLS


def test_nothing_of_a_call_or_result_is_lost(spark):
    calls = [("a", None, 1, "respond", '{"query":"q","n_words":1}'), ("a", None, 7, "respond", '{"query":"again","n_words":1}'), ("a", None, 9, "respond", "not json")]
    results = [("a", 2, "ra"), ("a", 8, "rb"), ("x", 4, "lost"), (None, 5, "unnamed")]
    got = toolcalls.link(spark.createDataFrame(calls, "call_id string, after string, position int, tool string, arguments string"), spark.createDataFrame(results, "call_id string, position int, content string"), TOOLS).collect()
    assert sorted((r.status, r.position or 0, r.result_position or 0, r.event) for r in got) == [
        ("duplicate", 7, 0, '{"arguments":{"n_words":1,"query":"again"},"call_id":"a","tool":"respond"}'), ("duplicate", 9, 0, '{"call_id":"a","tool":"respond"}'),
        ("linked", 1, 2, '{"arguments":{"n_words":1,"query":"q"},"call_id":"a","result":"ra","tool":"respond"}'),
        ("orphan_result", 0, 4, '{"call_id":"x","result":"lost"}'), ("orphan_result", 0, 5, '{"result":"unnamed"}'), ("orphan_result", 0, 8, '{"call_id":"a","result":"rb"}'),
    ]


def test_turns_of_other_roles_and_without_a_place_are_kept(spark):
    rows = [(1, 0, "system", 'be "kind"'), (1, 1, "user", "q  w"), (1, 2, "assistant", ""), (2, 5, None, None), (None, 1, "user", "x"), (None, 2, "assistant", "y"), (3, 0, "user", None)]
    rows += [(4, 7, "assistant", "late"), (5, 0, "user", "twice"), (5, 0, "user", "twice")]
    messages = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, status string, depth int")
    got = toolcalls.link_turns(messages, TOOLS).collect()
    assert len(got) == len(rows) - 1  # the one linked result stands beside its call
    assert sorted((r.status, r.call_id or "", r.event) for r in got) == [
        ("bad_arguments", "3:0", '{"arguments":{},"call_id":"3:0","tool":"respond"}'),
        ("duplicate", "5:0", '{"arguments":{"n_words":1,"query":"twice"},"call_id":"5:0","tool":"respond"}'),
        ("linked", "1:1", '{"arguments":{"n_words":2,"query":"q  w"},"call_id":"1:1","result":"","tool":"respond"}'),
        ("no_result", "", '{"arguments":{"n_words":1,"query":"x"},"tool":"respond"}'), ("no_result", "5:0", '{"arguments":{"n_words":1,"query":"twice"},"call_id":"5:0","tool":"respond"}'),
        ("orphan_result", "", '{"result":"y"}'), ("orphan_result", "4:6", '{"call_id":"4:6","result":"late"}'),
        ("other_turn", "1:0", '{"content":"be \\"kind\\"","role":"system"}'), ("other_turn", "2:5", "{}"),
    ]
    assert toolcalls.link_turns(messages.where("false"), TOOLS).count() == 0
