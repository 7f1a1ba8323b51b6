"""The noisy-or of a text against a plain product, and which sentences are listed."""

import math

import numpy as np
import pyarrow as pa
import pytest

from loanloom.llm import toxicity


class Told:
    """A model that gives sentences, in order, the scores it was told."""

    def __init__(self, scores):
        self.scores = scores

    def sentences(self, words, sentence, n):
        assert n == len(self.scores)
        return np.array(self.scores)


def test_scores_as_a_plain_product():
    column = pa.array(["One is here. Two is here. Three is here.", None, "Four is here. Five is here."])
    told = [0.1, 0.25, 0.0, 0.5, 0.9]
    ((_, whole, p, text, *_),) = toxicity._each(Told(told), column)
    assert p.tolist() == told
    for k in range(3):
        assert whole[k] == pytest.approx(1 - math.prod(1 - told[i] for i in range(5) if text[i] == k))


@pytest.mark.parametrize(
    "p, text, due",
    [
        ([0.1, 0.9, 0.6], [0, 0, 0], [1, 2]),  # those of the threshold and no more
        ([0.3, 0.4, 0.4], [0, 0, 0], [1]),  # toxic together: the first of the strongest
        ([0.1, 0.2, 0.1], [0, 0, 1], []),  # neither text counts as toxic
        ([0.4, 0.4, 0.7], [0, 0, 1], [0, 2]),
        ([], [], []),
    ],
)
def test_places(p, text, due):
    p, text = np.array(p, float), np.array(text, int)
    whole = np.array([1 - np.prod(1 - p[text == k]) for k in range(2)])
    assert toxicity._located(p, text, whole, 0.5).tolist() == due
