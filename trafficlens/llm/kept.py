"""What a worker process keeps between the tasks of an operator.

Workers go on from stage to stage, so large tables of one operator would lie beside the
work of the next one: its tasks release them.
"""

from __future__ import annotations

import gc

_made: dict[tuple, object] = {}
_usual = gc.get_threshold()


def once(kind, *args):
    """One object per worker process and its settings, until another operator's tasks begin."""
    # The kept tables have no cycles, and the collector would walk them again and again.
    gc.set_threshold(1_000_000, 100, 100)
    if (kind, *args) not in _made:
        _made[kind, *args] = kind(*args)
    return _made[kind, *args]


def release() -> None:
    if _made:
        _made.clear()
        gc.set_threshold(*_usual)
        gc.collect()
