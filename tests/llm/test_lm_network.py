import numpy as np
import pytest

from kumiki.llm import lm_score as L


def network(scale=1.0):
    r = np.random.RandomState(1)
    net = L.WindowNet(outputs=96)
    net.p = [(scale * r.randn(*x.shape) * 0.3).astype(np.float32) for x in net.p]
    n = 700
    return net, np.minimum(r.zipf(1.5, (n, 2 * L.SIDE)), 97) - 1, np.minimum(r.zipf(1.4, n), 96) - 1


def plain(p, context, target):
    """log P of each target, from the definition."""
    p = [x.astype(np.float64) for x in p]
    h = np.tanh(sum(p[0][j][context[:, j]] for j in range(2 * L.SIDE)) + p[1])
    cls, within = target // L.CLASS, target % L.CLASS
    z = h @ p[2] + p[3]
    y = np.einsum("nd,ndk->nk", h, p[4][cls]) + p[5][cls]
    soft = lambda x: x - x.max(axis=1, keepdims=True) - np.log(np.exp(x - x.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True))
    at = np.arange(len(target))
    return soft(z)[at, cls] + soft(y)[at, within]


@pytest.mark.parametrize("scale", [1, 100])
def test_probabilities_in_pieces_and_of_large_sums(monkeypatch, scale):
    net, context, target = network(scale)
    assert net._weights()[2] == (scale == 100)
    want = plain(net.p, context, target)
    for piece in (1024, 64):
        monkeypatch.setattr(L, "PIECE", piece)
        assert np.allclose(net.log_probabilities(context, target), want, rtol=1e-4, atol=1e-3 * scale)


@pytest.mark.parametrize("large", [60.0, 0.0])
def test_a_step_follows_the_gradient(monkeypatch, large):
    monkeypatch.setattr(L, "LARGE", large)
    monkeypatch.setattr(L, "PIECE", 128)
    net, context, target = network()
    before = [x.copy() for x in net.p]
    net.g = [np.zeros(x.shape, np.float32) for x in net.p]
    net.step(context, target, rate=0.0)
    for k, at in [(0, (1, 0, 3)), (0, (2, 1, 5)), (1, (4,)), (2, (3, 1)), (3, (0,)), (4, (0, 2, 1)), (5, (0, 0))]:
        ends = []
        for e in (1e-4, -1e-4):
            p = [x.astype(np.float64) for x in before]
            p[k][at] += e
            ends.append(-plain(p, context, target).mean())
        assert abs(np.sqrt(net.g[k][at]) - abs(ends[0] - ends[1]) / 2e-4) < 1e-5


def test_sums_of_runs():
    r = np.random.RandomState(2)
    values, places = r.randn(50, L.WIDTH), r.randint(0, 50, 300)
    for size in ([1] * 300, [300], [1, 2, 3, 4, 5, 6, 7, 272], [5] * 60):
        first = np.cumsum([0, *size[:-1]])
        assert np.allclose(L._sums(values, places, first), np.add.reduceat(values[places], first, axis=0))
