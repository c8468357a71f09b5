"""Properties of the pure functions."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from emberloom.functions import python
from emberloom.operators import fulltext, search


@given(st.text(max_size=60))
def test_first_object_is_json(text):
    found = python.first_object(text)
    assert found is None or (found in text and json.loads(found) is not None)


@given(st.dictionaries(st.text(max_size=5), st.text(max_size=5), max_size=3), st.text(alphabet="ab c", max_size=8))
def test_first_object_finds_what_is_there(value, around):
    assert json.loads(python.first_object(around + json.dumps(value) + around)) == value


@given(st.text(alphabet="abcdefghijklmnopqrstuvwxyz", min_size=1, max_size=14))
def test_stems_are_short_and_whole(word):
    stem = python.porter(word)
    assert 0 < len(stem) <= len(word) + 1


@settings(max_examples=50)
@given(st.integers(1, 50))
def test_pools(limit):
    assert limit <= search.pool_size(limit) <= 100


@given(st.text(max_size=40))
def test_any_query_is_parsed(query):
    parsed = fulltext.parse(query, columns=("title",))
    for phrase in fulltext.phrases_of(parsed) if parsed else []:
        assert phrase.words and all(t.isalnum() for t in phrase.words)
