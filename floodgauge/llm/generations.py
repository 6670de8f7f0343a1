"""A bounded cache in two generations: what is used stays, what is not used for a while goes."""

from __future__ import annotations

from collections.abc import Callable, Iterable


class Generations:
    """``young`` is looked up directly; when it is full it becomes the old one, from which entries in
    use come back. At most twice ``capacity`` entries are held."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def fill(self, keys: Iterable[str], learn: Callable[[list[str]], Iterable[bytes]]) -> None:
        """Have all ``keys`` in ``young``; ``learn`` gives the values of those not known."""
        if len(self.young) > self.capacity:
            self.old, self.young = self.young, {}
        young, old, new = self.young, self.old, []
        for k in set(keys).difference(young):
            v = old.get(k)
            if v is None:
                new.append(k)
            else:
                young[k] = v
        if new:
            young.update(zip(new, learn(new)))

    def forget(self, keys: Iterable[str]) -> None:
        for k in keys:
            self.young.pop(k, None)
