"""Evidence for alerts: taken anew or reused from a track's last one, with limits for a track and for a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame

from watchline.operators import ordered
from watchline.operators.tracking import kind


def attached(df: DataFrame, camera: str, frame: str, track: str, seq: str, cooldown: int = 15, most: int = 3) -> DataFrame:
    """Alerts (``seq``) with ``evidence``: fresh, reused, or null where the frame's limit left none; ``source`` is the alert
    whose evidence it is.

    A track whose last evidence, of either kind, is less than ``cooldown`` frames old reuses it. A frame takes alerts in
    order of ``seq`` while it has spent less than ``most``: fresh evidence costs one, reused evidence two. All tracks of a
    camera share its frames, so that a camera is folded as one; it is cut at gaps of ``cooldown`` frames.
    """

    def begin(stretch: int):
        last: dict = {}

        def take(at: int | None, rows: list[tuple] | None) -> list[tuple]:
            for name in [t for t, (seen, _) in last.items() if rows and at - seen >= cooldown]:
                del last[name]
            spent, out = 0, []
            for t, s in rows or []:
                if spent >= most:
                    out.append((at, t, s, None, None))
                    continue
                found, source = ("reused", last[t][1]) if t in last else ("fresh", s)
                spent += 2 if found == "reused" else 1
                last[t] = (at, source)
                out.append((at, t, s, found, source))
            return out

        return take

    schema = f"`{frame}` {kind(df, frame)}, `{track}` {kind(df, track)}, `{seq}` {kind(df, seq)}, evidence string, source {kind(df, seq)}"
    return ordered.folded(df.select(camera, frame, track, seq), [camera], frame, [track, seq], [seq], cooldown - 1, begin, schema).drop(ordered.STRETCH)
