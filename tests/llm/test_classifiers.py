"""The parts of the classifiers against plain versions of them."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import ftrl, quality, toxicity


def ftrl_by_hand(docs, labels, epochs, alpha, beta, l1, l2, least_docs):
    rate = min(max(sum(labels) / len(labels), 0.01), 0.99)
    bias = math.log(rate / (1 - rate))
    seen = {}
    for d in docs:
        for f in d:
            seen[f] = seen.get(f, 0) + 1
    z = {f: 0.0 for f, c in seen.items() if c >= least_docs}
    n = dict.fromkeys(z, 0.0)
    zb = nb = 0.0

    def weight(f):
        if abs(z[f]) <= l1:
            return 0.0
        return -(z[f] - math.copysign(l1, z[f])) / ((beta + math.sqrt(n[f])) / alpha + l2)

    for _ in range(epochs):
        for d, y in zip(docs, labels):
            w = {f: weight(f) for f in d if f in z}
            b = bias - zb / ((beta + math.sqrt(nb)) / alpha)
            g = 1 / (1 + math.exp(-max(min(sum(w.values()) + b, 40), -40))) - y
            for f in w:
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / alpha * w[f]
                n[f] += g * g
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / alpha * (b - bias)
            nb += g * g
    return {f: weight(f) for f in z if weight(f)}, bias - zb / ((beta + math.sqrt(nb)) / alpha)


@pytest.mark.parametrize("least_docs", [1, 4])
def test_training_matches_a_plain_loop(least_docs):
    rng = random.Random(1)
    docs = [sorted({rng.randrange(80) for _ in range(rng.randrange(0, 15))} | ({100} if i % 3 == 0 else set())) for i in range(200)]
    labels = [float(i % 3 == 0) if rng.random() < 0.9 else 0.0 for i in range(200)]
    model = ftrl.train([np.array(d, dtype=np.int64) for d in docs], np.array(labels), 3, 0.5, 1.0, 0.7, 0.1, least_docs)
    weights, bias = ftrl_by_hand(docs, labels, 3, 0.5, 1.0, 0.7, 0.1, least_docs)
    assert dict(zip(model.features.tolist(), model.weights.tolist())) == {f: pytest.approx(w) for f, w in weights.items()} and model.bias == pytest.approx(bias)
    flat, at = np.array([f for d in docs for f in d], dtype=np.int64), np.cumsum([0, *map(len, docs)])
    expected = [1 / (1 + math.exp(-(bias + sum(weights.get(f, 0.0) for f in d)))) for d in docs]
    assert model.scores(flat, at).tolist() == [pytest.approx(e) for e in expected]


def same_structure(found, plain):
    """Hashed feature sets have the sizes and the common parts of the plain ones."""
    assert [len(f) for f in found] == [len(p) for p in plain]
    for i, j in itertools.combinations(range(len(plain)), 2):
        assert len(found[i] & found[j]) == len(plain[i] & plain[j])


def texts_of(rng, words, n):
    return [rng.choice(["", " ", "\n "]).join(rng.choice(words) + rng.choice([" ", "\t", "  "]) for _ in range(rng.randrange(0, 12))) for _ in range(n)] + [None, "", "  "]


def sets_of(featurise, texts):
    return [set(f[at[i] : at[i + 1]].tolist()) for f, at in featurise(pa.array(texts, pa.string())) for i in range(len(at) - 1)]


def test_quality_features_match_a_plain_tokeniser():
    rng = random.Random(2)
    texts = texts_of(rng, ["one", "Two", "two", "THREE", "f0ur", "12345", "a,b", "end.", "end!", "été", "longer-than-that", "x", "$$$$", "漢字"], 120)
    plain = []
    for t in texts:
        words = [w.encode() for w in "".join(" " if c in "\t\n\v\f\r" else c for c in t or "").split(" ") if w]
        shapes = []
        for w in words:
            upper, digit, sign = (min(sum(k(b) for b in w), 3) for k in (lambda b: 65 <= b <= 90, lambda b: 48 <= b <= 57, lambda b: 33 <= b <= 126 and not chr(b).isalnum()))
            last = w[-1] if 33 <= w[-1] <= 126 and not chr(w[-1]).isalnum() else 0
            shapes.append((upper, digit, sign, last, min(len(w) // 4, 7)))
        small = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words]
        own = {("word", w) for w in small} | {("shape", s) for s in shapes}
        own |= {("words", *p) for p in zip(small, small[1:])} | {("shapes", *p) for p in zip(shapes, shapes[1:])}
        own |= {("repeat",)} if any(a == b for a, b in zip(small, small[1:])) else set()
        plain.append(own)
    same_structure(sets_of(quality.featurise, texts), plain)


def model_of(words):
    counts = np.zeros(28**3, dtype=np.int64)
    for word in words:
        s = [27, 27, *(ord(c) - 97 for c in word), 27]
        for a, b, c in zip(s, s[1:], s[2:]):
            counts[(a * 28 + b) * 28 + c] += 100
    return toxicity.language_model(counts)


def test_toxicity_features_match_a_plain_tokeniser():
    rng = random.Random(3)
    cost = model_of(["idiot", "moron", "trash", "ratio", "hello"])
    texts = texts_of(rng, ["idiot", "1d10t", "m 0 r 0 n", "Hello", "tr@sh!", "ratio", "rationale", "été", "x2", "42", "i.d.i.o.t", "iiidiot"], 120)
    restorer, plain = toxicity.Restorer(cost), []
    for t in texts:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = "".join(c if ord(c) > 127 or c.isalpha() else " " for c in lower).split()
        words += restorer.words(lower)
        own = set()
        for w in (w.encode() for w in words):
            own |= {("word", w)} | {(k, w[:k]) for k in toxicity.BEGINNINGS if len(w) > k}
        plain.append(own)
    same_structure(sets_of(toxicity.make_featurise(cost), texts), plain)


def test_restoring_matches_enumeration():
    rng = random.Random(4)
    cost = model_of(["idiot", "tool", "bottle", "bill", "as", "ass"])
    restorer = toxicity.Restorer(cost)

    def price(way):
        total, a, b = 0.0, toxicity.EDGE, toxicity.EDGE
        for letters, channel in way:
            total += channel
            for c in letters:
                s = ord(c) - 97 if "a" <= c <= "z" else toxicity.OTHER
                total, a, b = total + cost[a, b, s], b, s
        return total + cost[a, b, toxicity.EDGE]

    for _ in range(300):
        part = "".join(rng.choice("ito1|!$07 .b") for _ in range(rng.randint(1, 6)))
        ways = sorted((price(w), "".join(letters for letters, _ in w)) for w in itertools.product(*toxicity.Restorer.lattice(part)))
        best = {word for p, word in ways if p <= ways[0][0] + 1e-9}
        assert restorer.restore(part) in best, part
