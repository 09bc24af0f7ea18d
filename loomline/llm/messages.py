"""Reading the JSON of messages: role, texts, and whether it can be parsed."""

from __future__ import annotations

import json

#: Spellings of roles, after trimming and lower-casing.  Fixed values.
USER_ROLES = frozenset({"user", "human"})
ASSISTANT_ROLES = frozenset({"assistant", "ai", "bot", "model"})
OTHER_ROLES = frozenset({"toolresult", "tool_result", "tool", "bashexecution", "branchsummary", "compactionsummary", "custom", "system"})


def speaker(role: object) -> str | None:
    """``user``, ``assistant``, ``other`` for a recognised role of another kind, None otherwise."""
    if not isinstance(role, str):
        return None
    name = role.strip().lower()
    if name in USER_ROLES:
        return "user"
    if name in ASSISTANT_ROLES:
        return "assistant"
    return "other" if name in OTHER_ROLES else None


def parse(message: str | None) -> dict | None:
    """The message as an object; None where it is no JSON object."""
    if message is None:
        return None
    try:
        found = json.loads(message)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def placed_texts(message: dict) -> list[tuple[int, str]]:
    """The decoded texts of ``content`` with the number of their block: the string itself (0), or every text block (or bare string) of the array."""
    content = message.get("content")
    if isinstance(content, str):
        return [(0, content)]
    found = []
    if isinstance(content, list):
        for k, block in enumerate(content):
            if isinstance(block, str):
                found.append((k, block))
            elif isinstance(block, dict) and block.get("type") == "text" and isinstance(block.get("text"), str):
                found.append((k, block["text"]))
    return found


def texts(message: dict) -> list[str]:
    """As ``placed_texts``, the texts alone."""
    return [t for _, t in placed_texts(message)]
