"""What learning a row gives is what was foretold."""

import numpy as np

from pelorus.operators.online import HoeffdingTree


def test_learning_gives_what_was_foretold():
    rng = np.random.default_rng(4)
    tree = HoeffdingTree(4, np.random.default_rng(0))
    for x, y in zip(rng.normal(size=(3000, 4)).tolist(), rng.integers(0, 2, 3000).tolist()):
        before = tree.predict([2 * x[0] + y, *x[1:]])
        assert tree.learn([2 * x[0] + y, *x[1:]], y, 2.0) == before
    assert tree.root.feature >= 0
