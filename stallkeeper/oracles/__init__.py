"""DuckDB statements that state each registered query independently.

``layers.sql`` holds the shared blocks, every other file one block per query; ``fits.py`` writes out those that go
in rounds.
"""
from __future__ import annotations

import re
from functools import cache
from pathlib import Path

from stallkeeper.oracles import fits

_HERE = Path(__file__).parent
_HEAD = re.compile(r"^-- @(layer|query) (\w+)\s*$", re.M)


def _blocks(text: str) -> dict[tuple[str, str], str]:
    parts = _HEAD.split(text)
    return {(kind, name): body.strip().rstrip(";")
            for kind, name, body in zip(parts[1::3], parts[2::3], parts[3::3])}


def _expand_half_up(sql: str) -> str:
    """half_up(x, k): round to k places, halves away from zero, on the decimal value of x.

    DuckDB rounds the binary double instead, which sends 0.125 and 0.675 different ways."""
    mark = "half_up("
    while (at := sql.rfind(mark)) >= 0:
        depth, i = 1, at + len(mark)
        comma = None
        while depth:
            ch = sql[i]
            depth += (ch in "([") - (ch in ")]")
            if ch == "," and depth == 1:
                comma = i
            i += 1
        value, places = sql[at + len(mark):comma], sql[comma + 1:i - 1].strip()
        sql = f"{sql[:at]}CAST(round(CAST({value} AS DECIMAL(38,10)), {places}) AS DOUBLE){sql[i:]}"
    return sql


@cache
def statements() -> dict[str, str]:
    """Query name to a complete statement with the layers it needs."""
    blocks: dict[tuple[str, str], str] = {}
    for file in sorted(_HERE.glob("*.sql")):
        blocks.update(_blocks(file.read_text(encoding="utf-8")))
    blocks.update(_blocks(fits.text()))
    layers = {name: body for (kind, name), body in blocks.items() if kind == "layer"}

    def needed(body: str, seen: list[str]) -> list[str]:
        for name in re.findall(r"\b\w+\b", body):
            if name in layers and name not in seen:
                needed(layers[name], seen)
                seen.append(name)
        return seen

    out = {}
    for (kind, name), body in blocks.items():
        if kind != "query":
            continue
        ctes = ",\n".join(f"{n} AS (\n{layers[n]}\n)" for n in needed(body, []))
        if ctes and body.startswith("WITH "):  # the query brings blocks of its own
            body, ctes = body.removeprefix("WITH "), ctes + ","
            out[name] = _expand_half_up(f"WITH {ctes}\n{body}")
        else:
            out[name] = _expand_half_up(f"WITH {ctes}\n{body}" if ctes else body)
    return out
