"""A streaming source of frame records: reconnects, skips after a connect, and a greedy rate limit.

The frames come from an opener, a callable that yields (timestamp seconds, payload bytes) and raises when the connection fails, so
any capture library can stand behind it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from itertools import islice

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

FRAME_SCHEMA = "frame_id long, ts double, content binary"


class Capture:
    """Frames of a source that may fail.

    A source is reopened after ``max_failures`` failed reads in a row (pausing ``pause`` seconds) or a failed open (``open_pause``); the first ``skip``
    frames after each connect are dropped; a frame that comes less than 1/fps after the last accepted one is dropped.
    """

    def __init__(self, opener: Callable[[], Iterator], fps: float | None = None, skip: int = 10, max_failures: int = 5, pause: float = 2.0, open_pause: float = 3.0, sleep=time.sleep):
        self.opener, self.fps, self.skip, self.max_failures, self.pause, self.open_pause, self.sleep = opener, fps, skip, max_failures, pause, open_pause, sleep

    def frames(self, attempts: int) -> Iterator[tuple[float, bytes]]:
        """Accepted frames, over at most ``attempts`` connections."""
        last = None
        for _ in range(attempts):
            try:
                stream = iter(self.opener())
            except OSError:
                self.sleep(self.open_pause)
                continue
            skipped, failures = 0, 0
            while failures < self.max_failures:
                try:
                    frame = next(stream, None)
                except OSError:
                    failures += 1
                    continue
                if frame is None:
                    return
                failures = 0
                if skipped < self.skip:
                    skipped += 1
                elif self.fps is None or last is None or frame[0] - last >= 1 / self.fps:
                    last = frame[0]
                    yield frame
            self.sleep(self.pause)


class _Reader(SimpleDataSourceStreamReader):
    """Pulls at most ``batch`` frames at a time from a capture; replays by reading it anew up to the offset."""

    def __init__(self, capture: Capture, batch: int, attempts: int):
        self.capture, self.batch, self.attempts, self.open, self.at = capture, batch, attempts, None, 0

    def initialOffset(self) -> dict:
        return {"frame": 0}

    def _from(self, start: int) -> Iterator:
        if self.open is None or self.at != start:
            self.open = islice(self.capture.frames(self.attempts), start, None)
        return self.open

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        first = start["frame"]
        rows = [(first + i, float(t), bytes(content)) for i, (t, content) in enumerate(islice(self._from(first), self.batch))]
        if not rows and first == 0:
            raise ConnectionError(f"no frame in {self.attempts} connections")
        self.at = first + len(rows)
        return iter(rows), {"frame": self.at}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        frames = islice(self.capture.frames(self.attempts), start["frame"], end["frame"])
        return iter([(start["frame"] + i, float(t), bytes(content)) for i, (t, content) in enumerate(frames)])


class FrameSource(DataSource):
    """``spark.readStream.format("frames")``: the frames of a capture, numbered in the order of acceptance; options frames, batch, fps, attempts.

    The capture's reconnects, skips and rate limit (twice the target rate) stand behind it; a start without a frame raises ConnectionError. Without an opener of its own
    it yields numbered frames at a steady rate. ``frame_source`` makes one for a camera.
    """

    opener: Callable[[], Iterator] | None = None
    capture_options: dict = {}

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return FRAME_SCHEMA

    def simpleStreamReader(self, schema) -> _Reader:
        count, fps = int(self.options.get("frames", 100)), float(self.options.get("fps", 25))
        opener, options = type(self).opener, dict(type(self).capture_options)
        if opener is None:
            opener, options = (lambda: ((i / fps, str(i).encode()) for i in range(count))), {"skip": 0}
        return _Reader(Capture(opener, fps=2 * fps, **options), int(self.options.get("batch", 10)), int(self.options.get("attempts", 3)))


def frame_source(source: str, opener: Callable[[], Iterator], **capture) -> type[DataSource]:
    """A source class of the given name over an opener, with a Capture's other settings; ``spark.dataSource.register`` takes it."""
    return type("FrameSourceOf", (FrameSource,), {"opener": staticmethod(opener), "capture_options": capture, "name": classmethod(lambda cls: source)})
