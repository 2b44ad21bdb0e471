"""The filter on rising series."""

import signal

import numpy as np
import pytest
from granary.operators.spikes import kalman_spikes


@pytest.fixture(autouse=True)
def ends():
    """Fails a filter that loops for ever."""

    def stop(*_):
        raise TimeoutError

    old = signal.signal(signal.SIGALRM, stop)
    signal.alarm(20)
    yield
    signal.alarm(0)
    signal.signal(signal.SIGALRM, old)


def at(x, **k):
    return np.flatnonzero(kalman_spikes(np.asarray(x, float), k.get("threshold", 8.5), 3)).tolist()


@pytest.mark.parametrize("dip", range(0, 12))
def test_exactly_linear_counter(dip):
    x = 1000.0 + 10 * np.arange(200)
    x[dip] -= 500
    x[100] += 700
    assert at(x) == sorted({100, dip} if dip else {100})


def test_counter_with_near_constant_steps_and_restart():
    x = 5000.0 + np.cumsum(100 + np.random.default_rng(1).normal(0, 1, 400))
    x[250:] -= x[250] - 3
    x[80:82] += 5000
    x[300] = 0
    assert at(x) == [80, 81, 300]


def test_lasting_change_on_a_rising_series_is_no_case():
    x = 100.0 * np.arange(300) + np.random.default_rng(2).normal(0, 1, 300)
    x[150:] += 4000
    assert at(x) == []
    x[200] += 900
    assert at(x) == [200]


def test_drift_within_the_noise_does_not_carry_the_level_away():
    x = 40 + np.random.default_rng(3).normal(0, 1, 250)
    for k in range(5, 245, 12):
        y = x.copy()
        y[k : k + 3] = [86, 65, 75]
        assert at(y) == [k, k + 1, k + 2]


def test_spike_just_before_a_lasting_change():
    x = np.r_[np.full(80, 1019.1), 2603.4, 4246.5, np.full(2, 1019.1), np.full(80, 1023.8)]
    assert at(x) == [80, 81]
