"""Priors, state-space forms and single-block samplers."""

import numpy as np
import pytest

from pulsegrid.functions import special
from pulsegrid.inference import augmented, kernels, predict, priors, samplers, simulate, statespace


@pytest.mark.parametrize(("name", "a", "b"), [("normal", 0.3, 2.0), ("gamma", 2.0, 3.0), ("invgamma", 2.0, 3.0), ("beta", 2.0, 3.0), ("lognorm", 0.1, 0.5), ("halfcauchy", 2.0, 1.0), ("halfnormal", 2.0, 1.0), ("exponential", 2.0, 1.0), ("laplace", 0.1, 0.5)])
def test_priors(name, a, b):
    x, h = 0.4, 1e-6
    assert priors.slope(x, name, a, b) == pytest.approx((priors.log_density(x + h, name, a, b) - priors.log_density(x - h, name, a, b)) / (2 * h), abs=1e-4)
    grid = np.linspace(1e-6, 1 - 1e-6, 20001) if name == "beta" else np.linspace(-60, 400, 920001) if name in ("normal", "laplace") else np.linspace(1e-6, 400, 800001)
    mass = np.trapezoid(np.exp([priors.log_density(v, name, a, b) for v in grid[::8]]), grid[::8])
    assert mass == pytest.approx(1, abs=0.01)
    with pytest.raises(ValueError):
        priors.slope(x, "other", 1.0)


def test_iterative_transfer_is_a_sliding_one_for_constant_gain():
    rng = np.random.default_rng(0)
    y, psi, kappa, r = rng.poisson(5, 60).astype(float), np.full(60, 0.7), 0.4, 3
    phi = special.nbinom_pmf(60, kappa, r)
    assert np.allclose(statespace.iterative_transfer(psi, y, kappa, r), statespace.sliding_transfer(psi, y, phi))


def test_state_forms():
    assert statespace.embed(np.array([1.0, 2.0, 3.0]), 2).tolist() == [[1, 0], [2, 1], [3, 2]]
    g = statespace.transition(3)
    assert (g @ [5, 6, 7]).tolist() == [5, 5, 6]
    x = statespace.season_design(4, 9)
    p = statespace.permutation(4)
    assert all((p @ x[:, t] == x[:, t + 1]).all() for t in range(8))
    assert statespace.transition(2, 3, (0.4, 2)).shape == (6, 6)


def test_conjugates():
    rng = np.random.default_rng(1)
    w = rng.normal(0, 0.3, 4000)
    assert np.mean([samplers.conjugate_variance(rng, w) for _ in range(200)]) == pytest.approx(0.09, abs=0.01)
    assert np.mean([samplers.conjugate_rate(rng, 500, 100) for _ in range(500)]) == pytest.approx(5, abs=0.2)
    assert np.allclose(samplers.dirichlet_columns(rng, np.ones((4, 3))).sum(0), 1)
    for kind in ("random", "dominant", "zero", "sparse"):
        assert (np.diag(samplers.initial_effects(rng, 5, kind)) == 0).all()


def test_gravity_recovers_distance_decay():
    rng = np.random.default_rng(2)
    i = np.arange(8)
    dist = np.abs(i[:, None] - i) / 7
    u = np.exp(-4 * dist)
    counts = np.array([rng.multinomial(3000, c) for c in (u / u.sum(0)).T]).T.astype(float)
    near, far = (samplers.fit_gravity(c, dist, np.zeros_like(dist), 3, 1500, 500)[:, 0].mean() for c in (counts, counts[::-1]))
    assert near > 1.3 * far


def test_transmission_follows_r():
    rng = np.random.default_rng(3)
    r = 1 + 0.5 * np.sin(np.arange(50) / 6)
    y = rng.poisson(80, 50).astype(float)
    got = samplers.fit_transmission(rng.poisson(r * y).astype(float), y, np.ones(50), 5)
    assert np.corrcoef(got.mean(0), r)[0, 1] > 0.9


def test_zero_inflation_recovers_persistence():
    rng = np.random.default_rng(4)
    z = simulate.zero_chain(rng, 600, -2.0, 4.0)
    y = z * rng.poisson(6, 600)
    lg = np.array([special.math.lgamma(v + 1) for v in y])
    draws, mean = samplers.fit_zero_inflation(y, y * np.log(6) - 6 - lg, 6, 250, 80)
    assert draws[:, 1].mean() > 2 and ((mean > 0.5) == z).mean() > 0.95


def _gravity_network(n):
    rng = np.random.default_rng(9)
    i = np.arange(6)
    dist, none = np.abs(i[:, None] - i) / 5, np.zeros((6, 6))
    alpha = kernels.gravity(dist, none, 3.0, 0.0)
    r = np.tile(0.8 + 0.3 * np.sin(np.arange(n) / 12)[:, None], (1, 6))
    return rng, dist, none, alpha, r, simulate.simulate_network_array(rng, alpha, r, special.lag_weights(), 12.0)


def test_split_counts_has_the_chances_of_the_whole_multinomial():
    rng, _, _, alpha, r, y = _gravity_network(40)
    phi = special.lag_weights()
    got = [augmented.split_counts(rng, y, alpha, r, phi, 12.0) for _ in range(300)]
    assert all(base + flows.sum() == y[1:].sum() and flows.sum() == children.sum() for base, flows, children in got)
    force = kernels.band(phi, 40) @ (r * y)
    lam = 12.0 + force @ alpha.T
    share = y[1:] / lam[1:]
    assert np.mean([g[0] for g in got]) == pytest.approx((12 * share).sum(), rel=0.02)
    assert np.allclose(np.mean([g[1] for g in got], 0), alpha * (share.T @ force[1:]), rtol=0.1, atol=2)
    reach = kernels.band(phi, 40)[1:].T @ (share @ alpha)
    assert np.allclose(np.mean([g[2] for g in got], 0), reach * r * y, rtol=0.15, atol=1)


def test_block_step_keeps_the_posterior_of_a_short_walk():
    """Against a grid: two times, one source."""
    rng = np.random.default_rng(10)
    children, exposure, var = np.array([[3.0, 6.0]]), np.array([[4.0, 5.0]]), 0.3
    psi, seen = np.zeros((1, 2)), []
    for i in range(6000):
        psi, _ = augmented.renew_paths(rng, psi, children, exposure, var)
        if i >= 200:
            seen.append(psi[0])
    a, b = np.meshgrid(np.linspace(-4, 4, 321), np.linspace(-4, 4, 321), indexing="ij")
    h = lambda x: np.log1p(np.exp(x))
    f = 3 * np.log(h(a)) - 4 * h(a) + 6 * np.log(h(b)) - 5 * h(b) - 0.5 * a**2 - 0.5 * (b - a) ** 2 / var
    p = np.exp(f - f.max())
    p /= p.sum()
    assert np.allclose(np.mean(seen, 0), [(p * a).sum(), (p * b).sum()], atol=0.05)
    assert np.std(seen, 0)[0] == pytest.approx(np.sqrt((p * a * a).sum() - (p * a).sum() ** 2), abs=0.05)


def test_augmentation_recovers_a_simulated_network():
    """R differs by source: where all share one curve, free walks make up for the wrong weights, and the decay isn't identified."""
    _, dist, none, alpha, _, _ = _gravity_network(2)
    r = 0.95 + 0.3 * np.sin(np.arange(150)[:, None] / 20 + np.arange(6))
    y = simulate.simulate_network_array(np.random.default_rng(9), alpha, r, special.lag_weights(), 12.0)
    got = augmented.fit_network(y, dist, none, special.lag_weights(), 3, 400, 400)
    assert got["rho_dist"].mean() == pytest.approx(3.0, abs=0.9)
    assert got["mu"].mean() == pytest.approx(12.0, rel=0.2)
    # early times have few cases, late ones few children in view
    mean, sd = (f(got["R"], 0).reshape(r.shape)[10:140] for f in (np.mean, np.std))
    assert (np.abs(mean - r[10:140]) < 2 * sd).mean() > 0.85 and np.corrcoef(mean.ravel(), r[10:140].ravel())[0, 1] > 0.85


def test_augmentation_at_known_numbers_agrees_with_the_likelihood():
    rng, dist, none, alpha, r, y = _gravity_network(120)
    phi, rho, seen = special.lag_weights(), 0.0, []
    a = kernels.gravity(dist, none, 1.0, 0.0)
    for i in range(1500):
        _, flows, _ = augmented.split_counts(rng, y, a, r, phi, 12.0)
        for _ in range(5):
            new = rho + 0.05 * rng.standard_normal()
            other = kernels.gravity(dist, none, np.exp(new), 0.0)
            if np.log(rng.random()) < (flows * (np.log(other) - np.log(a))).sum() - 0.5 * (new * new - rho * rho):
                rho, a = new, other
        seen.append(rho)
    grid = np.linspace(-0.5, 2.5, 301)
    force = kernels.band(phi, 120) @ (r * y)
    f = np.array([kernels.log_density(y, 12 + force @ kernels.gravity(dist, none, np.exp(g), 0.0).T, "poisson", 1)[1:].sum() - 0.5 * g * g for g in grid])
    p = np.exp(f - f.max())
    assert np.mean(seen[300:]) == pytest.approx((p * grid).sum() / p.sum(), abs=0.1)


def test_simulated_zeros_and_moving_weights():
    rng, _, _, alpha, r, _ = _gravity_network(30)
    phi = special.lag_weights()
    z = np.ones((30, 6))
    z[5:9] = 0
    y = simulate.simulate_network_array(rng, np.tile(alpha, (30, 1, 1)), r, phi, 12.0, z=z)
    assert (y[5:9] == 0).all() and (y[1:5] > 0).any()
    one, other = (simulate.simulate_network_array(np.random.default_rng(1), a, r, phi, 12.0) for a in (alpha, np.tile(alpha, (30, 1, 1))))
    assert np.array_equal(one, other)


def test_series_predictive(spark):
    """With one draw of known values: lam by hand, and forecasts that feed drawn counts back."""
    y = [4.0, 6.0, 5.0, 7.0]
    series = spark.createDataFrame(list(enumerate(y)), "t int, y double")
    draws = [(1, 1, "mu", 0, 2.0), (1, 1, "W", 0, 0.0), (1, 1, "size", 0, 1e9)] + [(1, 1, "R", t, 0.5 + 0.1 * t) for t in range(4)]
    chains = spark.createDataFrame(draws, "chain int, iter int, param string, idx int, value double")
    phi = np.array([0.7, 0.3])
    got = {r.t: r for r in predict.series_predictive(chains, series, phi, 1, 2).collect()}
    r = [0.5, 0.6, 0.7, 0.8, 0.8, 0.8]
    full = [*y, got[4].x, got[5].x]
    assert sorted(got) == [1, 2, 3, 4, 5]
    for t in got:
        assert got[t].lam == pytest.approx(2 + 0.7 * r[t] * full[t - 1] + (0.3 * r[t - 1] * full[t - 2] if t > 1 else 0.0))
    assert predict.series_predictive(chains.limit(0), series, phi, 1).count() == 0
