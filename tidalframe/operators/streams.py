"""Online state machines, one step for each row; batch and streaming operators share them.

What a machine keeps between two rows is plain data: ``STATE`` names the columns of ``saved()``,
``LIST`` the type of the numbers in ``listed`` (if it keeps any), ``GROWS`` whether these have no
bound, and ``restored`` takes both.
"""

from __future__ import annotations

import heapq
from collections import deque
from statistics import median


#: A plausible face's size, as a share of the frame's height, and confidence.
USUAL, CONFIDENT = 0.5, 0.5


class Ema:
    """Exponential moving average; the first value seeds it unless ``seed`` is given."""

    STATE, LIST = "value double", None

    def __init__(self, alpha: float, seed: float | None = None):
        self.alpha, self.value = alpha, seed

    def saved(self) -> tuple:
        return (self.value,)

    def restored(self, state: tuple, listed=()) -> Ema:
        (self.value,) = state
        return self

    def step(self, x: float) -> float:
        self.value = float(x) if self.value is None else self.alpha * self.value + (1 - self.alpha) * x
        return self.value


class Hysteresis:
    """Target that moves at once for small changes, and for jumps after enough agreeing samples.

    ``reset_on_single``: samples with one face, or with several close ones, restart the count
    of a jump, so only wide shots and samples without faces can complete it. ``bounds`` clamp a
    position before it is tested; faces count from left to right, the first of equals wins.
    """

    def __init__(self, start: float = 0.5, jump: float = 0.15, agree: float = 0.1, needed: int = 15, memory: int = 30, wide_gap: float = 0.3, reset_on_single: bool = True, bounds: tuple[float, float] | None = None):
        self.target, self.jump, self.agree, self.needed = start, jump, agree, needed
        self.wide_gap, self.reset, self.bounds = wide_gap, reset_on_single, bounds
        self.recent: deque[float] = deque(maxlen=memory)
        self.candidate: float | None = None
        self.count = 0

    STATE, LIST, GROWS = "target double, candidate double, count int", "double", False

    @property
    def listed(self) -> list[float]:
        return list(self.recent)

    def saved(self) -> tuple:
        return self.target, self.candidate, self.count

    def restored(self, state: tuple, listed=()) -> Hysteresis:
        self.target, self.candidate, self.count = state
        self.recent.extend(listed)
        return self

    def _position(self, faces) -> float:
        if not len(faces):
            return median(self.recent) if self.recent else self.target
        if len(faces) == 1:
            chosen, restart = faces[0], True
        else:
            faces = sorted(faces, key=lambda f: f["cx"])
            wide = faces[-1]["cx"] - faces[0]["cx"] > self.wide_gap
            chosen, restart = max(faces, key=lambda f: f["w"] if wide else f["score"]), not wide
        if restart and self.reset:
            self.candidate, self.count = None, 0
        self.recent.append(chosen["cx"])
        return chosen["cx"]

    def step(self, faces) -> float:
        x = self._position(faces)
        if self.bounds:
            x = max(self.bounds[0], min(self.bounds[1], x))
        if abs(x - self.target) <= self.jump:
            self.target, self.candidate, self.count = x, None, 0
            return self.target
        if self.candidate is not None and abs(x - self.candidate) < self.agree:
            self.count += 1
        else:
            self.candidate, self.count = x, 1
        if self.count >= self.needed:
            self.target, self.candidate, self.count = self.candidate, None, 0
        return self.target


class Recovery:
    """Crop that follows the best face near the last one; without faces it holds its place.

    Faces wider or taller than ``usual`` of the frame's height do not count, nor do choices that
    rate below ``least``. After ``patience`` seconds without a face the search is unbiased and
    the limit is ``relaxed``.
    """

    def __init__(self, width: float, height: float, fps: float, patience: float = 3.0, usual: float = USUAL, relaxed: float = 0.7, least: float = 0.15):
        self.w, self.h, self.limit = width, height, int(fps * patience)
        self.usual, self.relaxed, self.least = usual, relaxed, least
        self.crop_w = min(int(height * 9 / 16), int(width))
        self.crop_x = int((width - self.crop_w) / 2)
        self.last: float | None = None
        self.missed = 0

    STATE, LIST = "crop_x long, last double, missed int", None

    def saved(self) -> tuple:
        return self.crop_x, self.last, self.missed

    def restored(self, state: tuple, listed=()) -> Recovery:
        self.crop_x, self.last, self.missed = state
        return self

    def _choose(self, faces):
        lost = self.missed > self.limit
        most = self.h * (self.relaxed if lost else self.usual)
        sized = [f for f in faces if f["w"] <= most and f["h"] <= most]
        sure = [f for f in sized if f["score"] >= CONFIDENT] or sized
        best, top = None, self.least
        for f in sure:
            value = f["w"] * f["h"] / (self.w * self.h) * 0.6 + f["score"] * 0.4
            if self.last is not None and not lost:
                value *= 0.5 + 0.5 * max(0.0, 1 - abs(f["cx"] - self.last) / 500)
            if value > top or best is None and value == top:
                best, top = f, value
        return best

    def step(self, faces) -> int:
        face = self._choose(faces)
        if face is None:
            self.missed += 1
            return self.crop_x
        self.missed, self.last = 0, face["cx"]
        self.crop_x = max(0, min(int(face["cx"] - self.crop_w / 2), int(self.w) - self.crop_w))
        return self.crop_x


class RunningMedian:
    """Median of the values so far: the lower half in a heap of greatest, the upper in one of least."""

    def __init__(self):
        self.lower: list[float] = []  # negated
        self.upper: list[float] = []

    def __len__(self) -> int:
        return len(self.lower) + len(self.upper)

    def add(self, x: float) -> None:
        moved = -heapq.heappushpop(self.lower, -x)
        heapq.heappush(self.upper, moved)
        if len(self.upper) > len(self.lower):
            heapq.heappush(self.lower, -heapq.heappop(self.upper))

    def middle(self) -> float:
        return -self.lower[0] if len(self.lower) > len(self.upper) else (self.upper[0] - self.lower[0]) / 2


class Segmenter:
    """Running-median segmentation.

    A segment's value is its median cut to a whole number, clamped to 0 and ``most``.
    """

    STATE, LIST, GROWS = "start long", "double", True

    def __init__(self, jump: float, least: int, most: int | None = None):
        self.jump, self.least, self.most, self.start = jump, least, most, 0
        self.held, self.listed = RunningMedian(), []

    @property
    def length(self) -> int:
        return len(self.listed)

    def saved(self) -> tuple:
        return (self.start,)

    def restored(self, state: tuple, listed=()) -> Segmenter:
        (self.start,) = state
        for x in listed:
            self._add(x)
        return self

    def _add(self, x: float) -> None:
        self.held.add(x)
        self.listed.append(x)

    def step(self, x: float) -> tuple[int, int, int] | None:
        """The segment that x closes, if any."""
        done = None
        if self.length and self.length >= self.least and abs(x - int(self.held.middle())) > self.jump:
            done = self.close()
        self._add(x)
        return done

    def close(self) -> tuple[int, int, int]:
        end, x = self.start + self.length, int(self.held.middle())
        done = (self.start, end, x if self.most is None else max(0, min(x, self.most)))
        self.start, self.held, self.listed = end, RunningMedian(), []
        return done


class NearTime:
    """Near-time dedup that emits a kept hit once no later one can replace it.

    ``expire`` emits it when time itself has passed; hits that come within the gap of an
    expired one are too late and go.
    """

    STATE, LIST = "start_s double, hit_id long, score double, open boolean", None

    def __init__(self, gap: float = 30.0, last: tuple | None = None):
        self.gap, self.last, self.open = gap, last, last is not None

    def saved(self) -> tuple:
        return (*self.last, self.open)

    def restored(self, state: tuple, listed=()) -> NearTime:
        self.last, self.open = tuple(state[:3]), state[3]
        return self

    def step(self, start: float, ident: int, score: float) -> tuple | None:
        if self.last is None or start - self.last[0] >= self.gap:
            done, self.last = self.last if self.open else None, (start, ident, score)
            self.open = True
            return done
        if self.open and score > self.last[2]:
            self.last = (start, ident, score)
        return None

    def expire(self, now: float) -> tuple | None:
        if not self.open or now < self.last[0] + self.gap:
            return None
        self.open = False
        return self.last
