import numpy as np
import pytest

from trialspark.functions import tails


def test_table_values():
    assert tails.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-7)
    assert tails.f_upper(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-7)
    assert tails.f_upper(3.885294, 2, 12) == pytest.approx(0.05, abs=1e-7)
    assert tails.range_upper(3.877, 3, 10) == pytest.approx(0.05, abs=1e-4)
    assert tails.range_upper(3.151, 2, 10) == pytest.approx(0.05, abs=1e-4)
    assert tails.chi2_upper(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert tails.chi2_upper(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-12)
    assert tails.t_quantile(0.975, 10) == pytest.approx(2.2281388519649385, abs=1e-10)
    assert tails.range_quantile(0.95, 3, 10) == pytest.approx(3.877, abs=1e-3)


def test_range_of_two_is_t():
    for q in (0.5, 2.0, 4.0, 9.0):
        for df in (1, 2, 5, 30, 500):
            want = tails.t_two_sided(q / np.sqrt(2), df)
            assert tails.range_upper(q, 2, df) == pytest.approx(float(want), abs=2e-6)


def test_closed_forms():
    # chi-square with 2 df and F with 2 numerator df have elementary tails
    for x in (0.1, 1.0, 5.0, 60.0, 300.0):
        assert tails.chi2_upper(x, 2) == pytest.approx(np.exp(-x / 2), rel=1e-12)
    for f in (0.1, 1.0, 12.5, 400.0):
        assert tails.f_upper(f, 2, 10) == pytest.approx((1 + 2 * f / 10) ** -5, rel=1e-12)
    # t with 1 df is Cauchy
    assert tails.t_two_sided(3.0, 1) == pytest.approx(2 * (0.5 - np.arctan(3.0) / np.pi), rel=1e-12)


def test_edges():
    assert np.isnan(tails.f_upper(np.nan, 1, 5))
    assert tails.f_upper(0.0, 1, 5) == 1.0
    assert tails.t_two_sided(np.inf, 5) == 0.0
    assert np.isnan(tails.t_quantile(0.975, 0))
    assert tails.f_upper(2000.0, 3, 400) < 1e-12


@pytest.mark.parametrize("d2", [10.0, 1e3, 1e6, 1e10, 1e12])
def test_closed_forms_at_any_size(d2):
    f = np.array([0.1, 1.0, 3.0, 10.0])
    assert tails.f_upper(f, 2, d2) == pytest.approx(np.exp(-d2 / 2 * np.log1p(2 * f / d2)), rel=1e-10)
    assert tails.range_upper(2.0, 2, d2) == pytest.approx(float(tails.t_two_sided(np.sqrt(2), d2)), rel=1e-9)


def test_normal_limit():
    import math

    for t in (0.5, 1.96, 4.0):
        assert tails.t_two_sided(t, 1e12) == pytest.approx(math.erfc(t / math.sqrt(2)), rel=1e-10)
        assert tails.normal_cdf(t) == pytest.approx(0.5 * math.erfc(-t / math.sqrt(2)), abs=1e-12)
