"""Follow-the-regularised-leader by dictionaries, for comparison."""

import math
from collections import Counter

import numpy as np


def plain_model(rows, features, s):
    """FTRL-proximal with a learning rate a coordinate, row by row with dictionaries; the predictor of its weights."""
    z, n = {}, {}

    def weight(i):
        return 0.0 if abs(z.get(i, 0.0)) <= s.l1 else -(z[i] - math.copysign(s.l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

    def inputs(text):
        _, codes = features([text])
        counts = Counter(codes.tolist())
        x = {c: 1.0 if features.binary else k * features.scale / max(1, len(text.split())) for c, k in counts.items()}
        return x | {1 << features.bits: 1.0}

    def predict(x, w=weight):
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w(i) * v for i, v in x.items())))))

    data = [(inputs(t), y) for t, y in rows]
    for k in range(s.passes):
        for j in np.random.default_rng(k).permutation(len(data)):
            x, y = data[j]
            p = predict(x)
            for i, v in x.items():
                g, w = (p - y) * v, weight(i)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / s.alpha * w
                n[i] = n.get(i, 0.0) + g * g
    final = {i: np.float32(weight(i)) for i in z}
    return lambda text: predict(inputs(text), lambda i: float(final.get(i, 0.0)))
