import random

import numpy as np

from cohortshare.llm import piece_transducer as pt


def _slow_merge(t, text):
    out = list(text)
    while True:
        best = max(((t.score.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(zip(out, out[1:]))), default=(-np.inf, 0))
        if best[0] == -np.inf:
            return out
        i = -best[1]
        out[i:i + 2] = [out[i] + out[i + 1]]


def test_known_pairs_are_not_weighed_again(monkeypatch):
    t = pt.PieceTransducer(pt.model_path())
    first, asked = t.path("▁internationalisation"), []
    weigh = t.weight
    monkeypatch.setattr(t, "weight", lambda *arc: asked.append(arc) or weigh(*arc))
    assert t.path("▁internationalisation") == first
    assert not asked
    assert t.decode(np.frombuffer(first, "<u4")) == "internationalisation"
    assert t.decode([]) == ""


def test_merging_takes_the_best_then_the_leftmost():
    t, rng = pt.transducer(pt.model_path()), random.Random(2)
    for _ in range(400):
        text = "".join(rng.choice("aeinrst▁é9中") for _ in range(rng.randrange(12)))
        assert t.merged(text) == _slow_merge(t, text)
