"""Gradients of the trained networks against differences, the non-negative risk against a plain version, and all windows against their containments."""

import numpy as np
import pytest

from cohortloom.llm import quality, toxicity
from cohortloom.llm.labelled import sigmoid


def _tokens(texts):
    raw = [t.encode() for t in texts]
    return toxicity.Tokens(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64))


def test_recurrent_network_gradient():
    """Along a random direction of each parameter the loss changes as its gradient says."""
    rng = np.random.default_rng(1)
    tokens = _tokens(["you are a kind person and this is fine", "bad words here bad", "x", "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"])
    net = toxicity.Network(rng.normal(0, 1, toxicity.WORDS).astype(np.float32), rng.normal(0, 1, toxicity.GRAMS).astype(np.float32))
    tokens.known(np.ones(toxicity.WORDS, bool), np.ones(toxicity.GRAMS, bool))
    rows = np.arange(len(tokens.start))
    y = (np.arange(len(rows)) % 2).astype(float)

    def loss():
        logits = net.logits(tokens)[rows].astype(np.float64)
        return float(np.mean(np.logaddexp(0, logits) - y * logits))

    grad = net.gradient(tokens, rows, y)
    for name, value in net.p.items():
        way = grad[name].astype(np.float64) if name in "eg" else rng.normal(0, 1, value.shape)  # few rows of the tables are used
        way /= np.linalg.norm(way)
        want, step, old = float((grad[name] * way).sum()), 1e-2, value.copy()
        net.p[name] = (old + step * way).astype(np.float32)
        up = loss()
        net.p[name] = (old - step * way).astype(np.float32)
        down = loss()
        net.p[name] = old
        assert (up - down) / (2 * step) == pytest.approx(want, rel=0.03, abs=2e-4), name


def test_all_overlapping_windows():
    """The logits of all windows, made chunk by chunk, are those of each window by itself; short and empty texts are one window."""
    rng, words = np.random.default_rng(5), [f"w{i}" for i in range(300)]
    sizes = [0, 1, 15, 16, 17, 0, 40, 5000, 3, 2063, 0]
    tokens = _tokens([" ".join(rng.choice(words, n)) for n in sizes])
    assert np.diff(tokens.of).tolist() == [max(1, n - 15) for n in sizes]
    net = toxicity.Network(rng.normal(0, 1, toxicity.WORDS).astype(np.float32), rng.normal(0, 1, toxicity.GRAMS).astype(np.float32))
    every = np.arange(len(tokens.start))
    ids, mask = tokens.windows(every)
    assert mask.sum(1).max() == 16 and not mask[0].any()
    want = net.forward(tokens.inputs(net.p, np.arange(len(tokens.places))), ids, mask)[0]
    assert np.allclose(net.logits(tokens), want, atol=1e-4)
    value = rng.normal(0, 1, len(tokens.ids)).astype(np.float32)
    plain = [max((value[i] for i in range(a, b)), default=-9) for a, b in zip(tokens.start, tokens.end, strict=True)]
    assert tokens.largest(value).tolist() == plain


def _risk(f, n, prior):
    """(risk of positives as positives times the prior, the bracket) of logits, the first n of which are positives."""
    soft = lambda x: np.logaddexp(0, x)
    return prior * soft(-f[:n]).mean(), soft(f[n:]).mean() - prior * soft(f[:n]).mean()


@pytest.mark.parametrize(("prior", "negative"), [(0.2, False), (0.9, True)])
def test_non_negative_risk(monkeypatch, prior, negative):
    """The derivative by each logit that training uses: of the whole risk, or, where the bracket is negative, away from it."""
    rng, seen = np.random.default_rng(2), []
    p, u = rng.normal(2, 1, (40, 5)), rng.normal(0, 1, (90, 5))
    net = quality.Network(np.zeros(5), np.ones(5))
    net.p["c"] = np.array([-8.0 if negative else 0.0])
    if negative:
        net.p["v"] = net.p["v"] * 0
        net.p["c"] = np.array([2.0])
    before = quality.Network.gradient

    def kept(self, z, d):
        seen.append((self.logits(z), d))
        return before(self, z, d)

    monkeypatch.setattr(quality.Network, "gradient", kept)
    monkeypatch.setattr(quality, "STEPS", 1)
    if negative:
        prior = 1.5  # a prior above 1 makes the bracket negative for equal logits
    quality.learn(net, p, u, prior, [1])
    f, d = seen[0]
    n = 40
    part, bracket = _risk(f, n, prior)
    assert (bracket < 0) == negative
    for i in range(len(f)):
        up, down = f.copy(), f.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        (a, b), (c, e) = _risk(up, n, prior), _risk(down, n, prior)
        want = -(b - e) / 2e-5 if negative else ((a + b) - (c + e)) / 2e-5
        assert d[i] == pytest.approx(want, abs=1e-6)


def test_classifier_gradient():
    rng = np.random.default_rng(3)
    net = quality.Network(rng.normal(0, 1, 6), np.ones(6))
    z, d = net.standard(rng.normal(0, 1, (20, 6))), rng.normal(0, 1, 20)
    loss = lambda: float(d @ net.logits(z) + 5e-4 * ((net.p["w"] ** 2).sum() + (net.p["v"] ** 2).sum()))
    grad = net.gradient(z, d)
    for name, value in net.p.items():
        way = rng.normal(0, 1, value.shape)
        old = value.copy()
        net.p[name] = old + 1e-5 * way
        up = loss()
        net.p[name] = old - 1e-5 * way
        down = loss()
        net.p[name] = old
        assert (up - down) / 2e-5 == pytest.approx(float((grad[name] * way).sum()), rel=1e-4, abs=1e-7), name


def test_prior_of_planted_mixture():
    """Unlabelled rows of which three tenths are like the positives, in bins of well separated logits."""
    rng = np.random.default_rng(4)
    count = lambda x: np.bincount(quality._bin(x), minlength=quality.BINS)
    p, u = rng.normal(4, 1, 20_000), np.concatenate([rng.normal(4, 1, 30_000), rng.normal(-4, 1, 70_000)])
    assert quality.estimate_prior(count(p), count(u)) == pytest.approx(0.3, abs=0.03)
    assert 0 < sigmoid(np.array([-800.0, 0.0, 800.0]))[1] == 0.5
