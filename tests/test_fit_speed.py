"""Fits work on tables of trials: the same answers, all derivatives in one call, none worked out again after a refused step."""

import numpy as np
import pytest

from fairlead.operators import fitting


def test_derivatives_in_one_call():
    t, calls = np.linspace(0, 2, 30), []
    y = 3.0 * np.exp(-1.3 * t)

    def residuals(x):
        calls.append(len(x))
        return x[:, :1] * np.exp(-x[:, 1:] * t) - y

    x = fitting.least_squares(residuals, np.array([1.0, 0.1]), np.array([0.0, 0.0]), np.array([10.0, 10.0]))
    assert x == pytest.approx([3.0, 1.3], rel=1e-6)
    assert set(calls) == {1, 2} and calls.count(2) <= calls.count(1) < 60


def test_bounds_hold():
    x = fitting.least_squares(lambda x: x - np.array([5.0, -5.0]), np.array([1.0, 1.0]), np.array([0.0, 0.0]), np.array([2.0, 2.0]))
    assert x.tolist() == [2.0, 0.0]
