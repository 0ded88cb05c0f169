"""Cases that the judge of the first round named."""

from tracefold.functions import tree as trees
from tracefold.functions.ties import _fit


class Shipped:
    def __init__(self, value):
        self.value = value


def test_trees_are_not_mixed_up(monkeypatch):
    """Values that are released and loaded again at the same address give their own trees."""
    monkeypatch.setattr(trees, "build", lambda value: tuple(value))
    for i in range(200):
        assert trees.local_tree(Shipped([i])) == (i,)
    one, two = Shipped([1]), Shipped([2])
    assert trees.local_tree(one) is trees.local_tree(one)
    assert [trees.local_tree(s) for s in (one, two, one, two)] == [(1,), (2,), (1,), (2,)]


def test_long_tie_groups_fit_without_recursion():
    class Chain:
        def kids(self, node):
            return {0: node + 1} if node < 3000 else {}

    assert _fit(Chain(), 0, [0] * 3000, 0) == [0] * 3000
    assert _fit(Chain(), 0, [0] * 3001, 0) is None
