"""Oracle side: proxy views as SQL text. `with_views` prepends only the views a body names (and what they need)."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}
RECURSIVE: set[str] = set()                       # views that read themselves
STORED: set[str] = set()                          # views that several parts of a query read and that cost too much to repeat
_WORD = re.compile(r"[a-z_][a-z_0-9]*")


def view(name: str, sql: str, recursive: bool = False, stored: bool = False) -> None:
    VIEWS[name] = sql.strip()
    if recursive:
        RECURSIVE.add(name)
    if stored:
        STORED.add(name)


def with_views(body: str) -> str:
    order: list[str] = []

    def visit(text: str, own: str = "") -> None:
        for word in _WORD.findall(text):
            if word in VIEWS and word != own and word not in order:
                visit(VIEWS[word], word)
                if word not in order:
                    order.append(word)

    visit(body)
    body = body.strip()
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in STORED else ''}(\n{VIEWS[n]}\n)" for n in order)
    start = "WITH RECURSIVE" if RECURSIVE & set(order) else "WITH"
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"{start} {ctes},\n{body[5:]}"
    return f"{start} {ctes}\n{body}"
