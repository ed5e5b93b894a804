"""Numeric kernels against known values and brute force."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstream.kernels import numeric as k
from siltstream.timespan import micros


def test_quantiles():
    assert k.t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-6)
    assert k.t_quantile(0.95, 1) == pytest.approx(6.313751515, abs=1e-6)
    for y in (-0.99, -0.3, 0.0, 0.5, 0.999):
        assert math.erf(k.erfinv(y)) == pytest.approx(y, abs=1e-10)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=1, max_size=7), st.lists(st.floats(-5, 5), min_size=1, max_size=7))
def test_dtw(a, b):
    a, b = np.array(a), np.array(b)

    def go(i, j):
        c = abs(a[i] - b[j])
        if i == j == 0:
            return c
        return c + min(go(x, y) for x, y in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if x >= 0 and y >= 0)

    assert k.dtw(a, b) == pytest.approx(go(len(a) - 1, len(b) - 1))


def test_linkage():
    x = np.array([0.0, 1.0, 2.0, 10.0, 11.0])
    d = np.abs(x[:, None] - x[None, :])
    assert k.linkage_clusters(d, 1.5).tolist() == [0, 0, 0, 1, 1]
    assert len(set(k.linkage_clusters(d, 1.5, "complete").tolist())) == 3


def test_lowpass_keeps_a_constant():
    b, a = k.butter_low(2, 0.2)
    assert b.sum() / a.sum() == pytest.approx(1.0)
    assert np.allclose(k.filtfilt(b, a, np.full(50, 3.0)), 3.0)
    assert k.filtfilt(b, a, np.ones(5)) is None


def test_curve():
    x = np.linspace(0, 1, 30)
    assert k.fit_curve(lambda z, a, b: a * np.exp(b * z), x, 2 * np.exp(1.5 * x), np.array([1.0, 1.0])) == pytest.approx([2, 1.5], abs=1e-4)


def test_micros():
    assert micros("1D12h") == 129_600_000_000 and micros("10min") == 600_000_000
    for bad in ("", "3 bananas", "-1h"):
        with pytest.raises(ValueError):
            micros(bad)
