"""JSON of charts: camelCase names, absent values left out."""

from __future__ import annotations

import json


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.capitalize() for w in rest)


def cleaned(x):
    if isinstance(x, dict):
        return {camel(k): cleaned(v) for k, v in x.items() if v is not None}
    return [cleaned(v) for v in x] if isinstance(x, (list, tuple)) else x


def dumps(chart: dict) -> str:
    return json.dumps(cleaned(chart), ensure_ascii=False)


def loads(text: str) -> dict:
    return json.loads(text)
