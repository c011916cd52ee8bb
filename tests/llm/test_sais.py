"""Suffix arrays and permuted common prefixes against sorting."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from regimen.llm import sais

TEXTS = st.one_of(
    st.lists(st.integers(1, 3), max_size=60),
    st.lists(st.integers(1, 250), max_size=60),
    st.builds(lambda p, n: (p * 30)[:n], st.lists(st.integers(1, 4), min_size=1, max_size=6), st.integers(0, 80)))


@pytest.mark.parametrize("short", [0, 100])
@settings(max_examples=150, deadline=None)
@given(values=TEXTS)
def test_suffix_array_sorts_suffixes(short, values):
    s, sais.SHORT = values + [0], short
    assert sais.suffix_array(np.array(s)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_permuted_prefixes(values):
    s = values + [0]
    sa = sais.suffix_array(np.array(s))
    found = sais.permuted_prefixes(np.array(s), sa, 20)
    for i, j in zip(sa[1:], sa[:-1]):
        n = 0
        while max(i, j) + n < len(s) and s[i + n] == s[j + n]:
            n += 1
        assert found[i] == min(n, 20)


def test_doubling_sorts_names():
    names = np.array([2, 1, 2, 1, 2, 1, 0])
    assert sais.by_doubling(names).tolist() == sorted(range(7), key=lambda i: names[i:].tolist())
