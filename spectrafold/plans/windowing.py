"""Where windows begin, from what is known of them."""

from math import floor


def _rounded(x: float) -> int:
    """To the nearest whole number, halves away from zero."""
    return floor(x + 0.5)


def _spread(first: float, last: float, n: int) -> list[int]:
    return [_rounded(first + (last - first) * i / (n - 1)) if n > 1 else _rounded(last) for i in range(n)]


def plan_windows(n: int, count: int | None = None, overlap: float | None = None, starts: list[int] | None = None, width: int | None = None, step: float | None = None) -> tuple[list[int], int]:
    """Starts (from 0) and width of windows in n samples.

    What is given decides, in this order: starts and width; width and step; count and overlap; width and
    count; width and overlap; starts and overlap; else one window of all. By width and overlap one window more is
    fitted in if else nine tenths of one would be missed.
    """
    if width is not None and starts is not None:
        return list(starts), width
    if width is not None and step is not None:
        return _every(step, n - width), width
    if width is None and starts is None and count is not None and overlap is not None:
        width = floor(n / ((count - 1) * (1 - overlap) + 1))
        return _every(width * (1 - overlap), n - width), width
    if width is not None and count is not None:
        return _spread(0, max(0, n - width), count), width
    if width is not None and overlap is not None:
        found = _every(width * (1 - overlap), n - width)
        if n - (found[-1] + 1 + width * (1 - overlap)) > 0.9 * width:
            found = _spread(0, n - width, len(found) + 1)
        return found, width
    if starts is not None and overlap is not None and len(starts) > 1:
        return list(starts), _rounded((starts[-1] - starts[0]) / (len(starts) - 1) * (1 + overlap))
    return [0], n


def _every(step: float, last: float) -> list[int]:
    return [_rounded(k * step) for k in range(floor(max(0.0, last) / step + 1e-9) + 1)]


def window_starts(n: int, width: int, overlap: float = 0.0, step: int | None = None) -> list[int]:
    """Starts from 0 of all windows of the width within n samples, by step or overlap."""
    step = step or max(1, round(width * (1 - overlap)))
    return list(range(0, max(0, n - width) + 1, step))
