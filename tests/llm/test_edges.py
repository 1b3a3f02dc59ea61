"""Calibration's steps part between the values they were fitted on, not at one of them."""

import numpy as np

from sparkwave.llm import toxicity


def test_a_gap_is_parted_in_its_middle():
    raw, ones = np.array([0.0, 1.0, 9.0, 10.0]), np.ones(4)
    edges, levels = toxicity.calibrate(raw, np.array([0.0, 0.0, 1.0, 1.0]), ones)
    assert edges.tolist() == [-np.inf, 5.0] and np.allclose(levels, [0.5 / 3, 2.5 / 3])
    edges, levels = toxicity.calibrate(np.array([0.0, 2.0, 4.0, 8.0]), np.array([0.0, 1.0, 0.0, 1.0]), ones)
    assert edges.tolist() == [-np.inf, 1.0, 6.0] and np.allclose(levels, [0.25, 0.5, 0.75])


def test_neighbouring_values_stay_apart():
    low = 0.1
    high = np.nextafter(low, 1)
    edges, _ = toxicity.calibrate(np.array([low, high]), np.array([0.0, 1.0]), np.ones(2))
    assert low < edges[1] <= high
