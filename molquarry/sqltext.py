"""Helpers for the SQL twins of the queries."""

from __future__ import annotations


def lit(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def draw(seed: int, *keys: str) -> str:
    """The hash draw of ``runtime.draw``; keys are SQL expressions."""
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(keys)})), 1, 8))::BIGINT"


def uniform(seed: int, *keys: str) -> str:
    return f"({draw(seed, *keys)} / 4294967296.0)"


def pick(items, seed: int, *keys: str) -> str:
    return f"([{', '.join(lit(x) for x in items)}])[1 + {draw(seed, *keys)} % {len(items)}]"


def phrase(templates: dict, prop: str, slot: str, value: str, seed: int, *keys: str) -> str:
    cases = " ".join(
        f"WHEN {lit(p)} THEN ([{', '.join(lit(x) for x in t)}])[1 + {draw(seed, *keys)} % {len(t)}]" for p, t in templates.items()
    )
    return f"replace(CASE {prop} {cases} END, {lit(slot)}, {value})"


def values(rows, *names: str) -> str:
    body = ", ".join("(" + ", ".join(x if isinstance(x, str) and x.startswith("\0") else lit(x) if isinstance(x, str) or x is None else str(x) for x in r) + ")" for r in rows)
    return f"(VALUES {body}) AS v({', '.join(names)})"
