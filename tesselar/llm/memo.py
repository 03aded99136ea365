"""A bounded dictionary in front of a function, for values that are used again and again, such as words."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

T = TypeVar("T")


class Memo:
    """Two generations of at most `size` entries: a full one becomes the old one, whose used entries live on."""

    def __init__(self, many: Callable[[list[str]], list[T]], size: int = 200_000) -> None:
        self.many, self.size, self.young, self.old = many, size, {}, {}

    def __call__(self, keys: list[str]) -> list[T]:
        try:
            return [self.young[k] for k in keys]
        except KeyError:
            pass
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young
        young, old, new = self.young, self.old, {}
        for k in keys:
            if k not in young:
                if k in old:
                    young[k] = old[k]
                else:
                    new[k] = None
        young.update(zip(new, self.many(list(new))))
        return [young[k] for k in keys]
