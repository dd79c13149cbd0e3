"""Writing results: a frame as Parquet, a chart as JSON."""

from __future__ import annotations

from ..frame import PointFrame
from ..functions.chart_json import dumps


def write_points(frame: PointFrame, path: str, mode: str = "errorifexists") -> None:
    frame.df.write.mode(mode).parquet(path)


def write_chart(chart: dict, path: str) -> None:
    with open(path, "w") as out:
        out.write(dumps(chart))
