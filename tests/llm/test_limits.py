"""Cases beyond what a shard, an automaton or a calibration grid once could take."""

import numpy as np

from cargolens.llm import phrases, quality


def covered(numbers, ranges):
    out = np.zeros(len(numbers), bool)
    for a, b in ranges:
        want = numbers[a:b]
        for i in range(len(numbers) - len(want) + 1):
            if (numbers[i: i + len(want)] == want).all():
                out[i: i + len(want)] = True
    return out


def test_phrases_with_more_words_than_characters(monkeypatch):
    rng = np.random.default_rng(1)
    text = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    numbers = np.concatenate([text, [0], text[20:260], [0], rng.integers(1, 1 << 62, 50).astype(np.uint64)]).astype(np.uint64)
    ranges = [(20, 260), (0, 60), (301, 360)]
    want = phrases.locate(numbers, ranges)
    assert (want == covered(numbers, ranges)).all()
    # Numbered anew for each shard, and long phrases in parts that share a window less a word.
    monkeypatch.setattr(phrases, "CHARACTERS", 120)
    monkeypatch.setattr(phrases, "LONGEST", 100)
    assert (phrases.locate(numbers, ranges, shard_words=50) == want).all()


def test_temperature_has_no_bounds():
    rng = np.random.default_rng(2)
    z = rng.normal(0, 1, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(int)
    for factor in (1e-3, 0.05, 1.0, 40.0, 1e4):
        assert abs(quality.best_temperature(z * factor, y) / factor - 1) < 0.15
    assert quality.best_temperature(np.zeros(5), np.array([0, 1, 0, 1, 1])) == 1.0
    assert np.isfinite(quality.best_temperature(np.array([-1.0, -2, 3, 4]), np.array([0, 0, 1, 1])))
