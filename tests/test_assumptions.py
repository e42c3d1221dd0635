import json

from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.operators import assumptions as A

DAMAGED = {
    "no brackets": None,
    "": None,
    'say [1, 2,] and [3]': [1, 2],
    "```json\n[{'a': True, 'b': None,}]\n```": [{"a": True, "b": None}],
    '[{"a": "it\'s [not] {open}, True"}': [{"a": "it's [not] {open}, True"}],
    "[{'a': 'say \"x\" and it\\'s'}]": [{"a": 'say "x" and it\'s'}],
    '["two\nlines"]': ["two\nlines"],
    '{"assumptions": [{"a": 1}, {"b": "cut o': [{"a": 1}, {"b": "cut o"}],
    '{"items": [1, 2}': [1, 2],
    '{"data": [1], "x": 2}': [1],
    '{"other": 1}': [],
    '["a", ': ["a"],
    "]}[1]": [1],
}


def test_mending():
    assert {t: A.items_of(t) for t in DAMAGED} == DAMAGED


values = st.recursive(st.none() | st.booleans() | st.integers(-999, 999) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(), x, max_size=4), max_leaves=12)


@settings(max_examples=300, deadline=None)
@given(st.lists(values), st.integers(0, 3))
def test_sound_json_is_left_alone_and_a_cut_off_end_never_raises(value, cut):
    text = json.dumps(value, ensure_ascii=False)
    assert A.items_of(text) == value
    A.items_of(text[: len(text) - cut])
    A.items_of(repr(value))


def test_reading():
    items = [
        {"id": 4, "text": "Credit grows by twelve", "category": " Demand ", "confidence": 1.7, "dependency_on": [9, 7, "7", "x"], "is_critical": 1},
        {"text": "short"}, 5, {"id": "x", "text": "a text that is long enough"}, {"text": "credit grows by TWELVE"},
        {"id": 7, "text": "Margins hold at four", "category": "luck", "confidence": "0.25", "dependency_on": [4]}, {"text": "One more with nothing", "confidence": "high"}, {"text": "An id that is free"}, {"text": "behind the eighth one"},
    ]
    kept, left = A.read(items)
    assert [(k["id"], k["category"], k["confidence"], k["depends_on"], k["critical"]) for k in kept] == [(1, "demand", 1.0, [2, 2], True), (2, "unknown", 0.25, [1], False), (3, "unknown", 0.5, [], False)]
    assert left == [(1, "too short"), (2, "not an object"), (3, "bad number"), (4, "repeated"), (6, "bad confidence"), (8, "too many")]


def test_rows(spark):
    rows = [(1, None), (2, "[]"), (3, '[{"text": "long enough to stay"}, 4]'), (3, "nothing")]
    got = A.assumptions(spark.createDataFrame(rows, "answer_id long, text string")).collect()
    assert sorted((r.answer_id, r.place, r.id, r.reject) for r in got if r.reject) == [(1, -1, None, "no list"), (3, -1, None, "no list"), (3, 1, None, "not an object")]
    assert [(r.answer_id, r.id, r.text, r.confidence, r.depends_on) for r in got if not r.reject] == [(3, 1, "long enough to stay", 0.5, [])]
