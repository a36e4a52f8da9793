"""JSON access: ``->`` gives JSON text, ``->>`` plain text."""

from __future__ import annotations

from tidemark.functions.typed import Typed, text_literal
from tidemark.plans.lexer import SqlError


def access(op: str, doc: Typed, key: Typed) -> Typed:
    """A member by name or an element by number, negative from the end. Missing is null; a document that isn't JSON raises.

    A JSON null is the text ``null``. Strings come unquoted from ``->>`` only.
    """
    if doc.type not in ("json", "text", "null"):
        raise SqlError(f"{op} takes JSON, not {doc.type}")
    parsed = f"parse_json({doc.sql})"
    if key.type == "int":
        at = f"CAST(CASE WHEN {key.sql} < 0 THEN {key.sql} ELSE {key.sql} + 1 END AS INT)"
        found = f"try_element_at(try_cast({parsed} AS ARRAY<VARIANT>), {at})"
    elif key.type == "text" and key.sql.startswith("'"):
        name = key.sql[1:-1].replace("\\'", "'").replace("\\\\", "\\")
        path = text_literal("$[" + ('"' + name + '"' if "'" in name else "'" + name + "'") + "]")
        found = f"variant_get({parsed}, {path}, 'variant')"
    else:
        raise SqlError(f"the right side of {op} is a text or whole number, written out")
    string = f"schema_of_variant({found}) = 'STRING'"
    rest = f"CASE WHEN is_variant_null({found}) THEN 'null' ELSE to_json({found}) END"
    if op == "->>":
        return Typed(f"CASE WHEN {found} IS NULL THEN NULL WHEN {string} THEN CAST({found} AS STRING) ELSE {rest} END", "text")
    return Typed(f"CASE WHEN {found} IS NULL THEN NULL ELSE {rest} END", "json")
