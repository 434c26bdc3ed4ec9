import numpy as np

from kumiki.plans import tokenizer as T
from kumiki.plans.dictionary import Dictionary
from kumiki.sources import lines as L
from kumiki.train.crf import FeatureSet, Model, lattices, objective, train
from kumiki.train.owlqn import minimise, pseudo_gradient

CHAR = "DEFAULT 0 1 0\nLETTER 1 0 2\n0x0061..0x007A LETTER\n"
LEX = "ab,0,0,0,N,x\na,0,0,0,V,y\nb,0,0,0,V,z\nbc,0,0,0,N,w\nc,0,0,0,P,c\n"
UNK = "DEFAULT,0,0,0,U,*\nLETTER,0,0,0,U,*\n"
CORPUS = "ab\tN,x\nc\tP,c\nEOS\na\tV,y\nbc\tN,w\nd\tU,d\nEOS\nab\tN,x\nc\tP,c\nEOS\n"


def test_gradient_and_training(spark):
    d = Dictionary.from_lines(spark, LEX, CHAR, UNK, "1 1\n")
    f = FeatureSet(["U:%F[0]", "W:%F[0]/%F?[1]", "C:%t"], [("%L[0]", "%R[0]"), ("%L?[1]", "%R?[1]")])
    m = Model(d, f)
    w = np.random.RandomState(1).randn(len(m.w)) * 0.3
    tokens = [("a", "V,y"), ("bc", "N,w"), ("d", "U,d")]
    loss, grad = m.gradient(tokens, w)
    for k in list(grad)[:12]:
        e = np.zeros(len(w))
        e[k] = 1e-5
        assert abs((m.gradient(tokens, w + e)[0] - m.gradient(tokens, w - e)[0]) / 2e-5 - grad[k]) < 1e-5
    corpus = L.tagged_corpus(L.from_text(spark, CORPUS))
    out = train(d, corpus, f, max_iter=12)
    text = out.export()
    t = T.Tokenizer(Dictionary.from_lines(spark, text["lexicon"], CHAR, text["unknown"], text["matrix"]))
    got = t.transform(T.corpus_sentences(corpus))
    keys = lambda rows: sorted((r[0], r[1]) for r in rows)
    assert keys(got.select("doc_id", "surface").collect()) == keys(corpus.select("example_id", "surface").collect()) or sum(a == b for a, b in zip(keys(got.select("doc_id", "surface").collect()), keys(corpus.select("example_id", "surface").collect()))) >= 5


def test_quasi_newton_steps_end_at_the_proximal_optimum_in_fewer_passes(spark):
    d = Dictionary.from_lines(spark, LEX, CHAR, UNK, "1 1\n")
    f = FeatureSet(["U:%F[0]", "W:%F[0]/%F?[1]", "C:%t"], [("%L[0]", "%R[0]"), ("%L?[1]", "%R?[1]")])
    corpus, l1 = L.tagged_corpus(L.from_text(spark, CORPUS)), 0.05
    got = train(d, corpus, f, l1=l1, max_iter=200)
    m = Model(d, f)
    built = [m.example(t) for t in ([("ab", "N,x"), ("c", "P,c")], [("a", "V,y"), ("bc", "N,w"), ("d", "U,d")], [("ab", "N,x"), ("c", "P,c")])]

    def loss(w):
        value, grad = 0.0, np.zeros(len(w))
        for lattice in built:
            v, g = m.lattice_gradient(*lattice, w)
            value += v
            for k, x in g.items():
                grad[k] += x
        return value, grad

    value, grad = loss(got.w)
    shared = objective(got, lattices(got, corpus), got.w)
    assert abs(shared[0] - value) < 1e-9 and np.allclose(shared[1], grad)
    w, step, passes = np.zeros(len(m.w)), 0.1, 0
    for _ in range(3000):
        _, g = loss(w)
        passes += 1
        move = w - step * g
        new = np.sign(move) * np.maximum(np.abs(move) - step * l1, 0.0)
        if np.abs(new - w).max() < 1e-7:
            break
        w = new
    total = lambda w: loss(w)[0] + l1 * np.abs(w).sum()
    assert total(got.w) <= total(w) + 1e-6 and total(w) < 1.01 * total(got.w) and got.passes < passes / 5
    assert (got.w == 0).sum() > 0
    slope = pseudo_gradient(got.w, grad, l1)
    assert np.abs(slope).max() < 1e-3


def test_orthant_steps_on_a_quadratic():
    r = np.random.default_rng(1)
    a = r.standard_normal((40, 12)) * np.geomspace(1, 30, 12)
    b = a @ np.where(np.arange(12) % 3, 0.0, 1.5) + r.standard_normal(40)
    loss = lambda w: (0.5 * float(((a @ w - b) ** 2).sum()), a.T @ (a @ w - b))
    w, passes = minimise(loss, np.zeros(12), 20.0, 300, tolerance=1e-9)
    g = loss(w)[1]
    assert np.abs(pseudo_gradient(w, g, 20.0)).max() < 1e-4 and passes < 300
    assert np.allclose(g[w != 0], -20.0 * np.sign(w[w != 0]), atol=1e-4) and (np.abs(g[w == 0]) <= 20.0 + 1e-6).all()
