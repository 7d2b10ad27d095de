"""SQL oracles: one DuckDB text per query key, with the shared derived tables as common table expressions."""

from __future__ import annotations

import re

from blockloom.plans.oracles import entity, fee, forecast, ledger, shared, whale

BODIES: dict[str, str] = {**ledger.SQL, **fee.SQL, **forecast.SQL, **whale.SQL, **entity.SQL}


def assemble(body: str) -> str:
    """Prefix a body with just the common table expressions it reaches."""
    needed: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for name in shared.TABLES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(shared.TABLES[name])
    parts = [f"{name} AS ({shared.TABLES[name].strip()})" for name in shared.TABLES if name in needed]
    body = body.strip()
    if body.upper().startswith("WITH"):
        body = re.sub(r"(?i)^WITH\s+(RECURSIVE\s+)?", "", body)
        joined = ",\n".join([*parts, body])
        return f"WITH RECURSIVE {joined}"
    return f"WITH RECURSIVE {', '.join(parts)}\n{body}" if parts else body


def oracle_sql() -> dict[str, str]:
    return {key: assemble(body) for key, body in BODIES.items()}
