"""Values inside property lists, databases, crash reports and protocol buffers, and their rewriting.

Each format has a walk that yields (key_path, text) and a rewrite that maps texts. Both work on one
member at a time inside a task.
"""

from __future__ import annotations

import json
import plistlib
import sqlite3
from collections.abc import Callable, Iterator

from ..kinds import ParseError

Rewrite = Callable[[str], str]
Hidden = tuple[str, ...] | Callable[[str], bool]  # values, or whether a text holds one


# ---- property lists


def plist_values(content: bytes) -> Iterator[tuple[str, str]]:
    def walk(x: object, path: str) -> Iterator[tuple[str, str]]:
        if isinstance(x, str):
            yield path, x
        elif isinstance(x, dict):
            for k, v in x.items():
                yield from walk(v, f"{path}.{k}" if path else str(k))
        elif isinstance(x, list):
            for i, v in enumerate(x):
                yield from walk(v, f"{path}[{i}]")

    yield from walk(_plist(content), "")


def _plist(content: bytes) -> object:
    try:
        return plistlib.loads(content)
    except Exception as e:
        raise ParseError(f"property list: {e}") from e


def plist_rewritten(content: bytes, rewrite: Rewrite) -> bytes:
    def walk(x: object) -> object:
        if isinstance(x, str):
            return rewrite(x)
        if isinstance(x, dict):
            return {k: walk(v) for k, v in x.items()}
        return [walk(v) for v in x] if isinstance(x, list) else x

    kind = plistlib.FMT_BINARY if content[:6] == b"bplist" else plistlib.FMT_XML
    return plistlib.dumps(walk(_plist(content)), fmt=kind, sort_keys=False)


# ---- databases, in memory


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(content: bytes) -> sqlite3.Connection:
    db = sqlite3.connect(":memory:")
    try:
        db.deserialize(content)
        db.execute("select count(*) from sqlite_master").fetchone()
    except sqlite3.DatabaseError as e:
        db.close()
        raise ParseError(f"database: {e}") from e
    db.text_factory = lambda b: b.decode("utf-8", "replace")
    return db


def _columns(db: sqlite3.Connection) -> Iterator[tuple[str, str]]:
    tables = db.execute("select name from sqlite_master where type = 'table' and name not like 'sqlite_%' order by name").fetchall()
    for (t,) in tables:
        for row in db.execute(f"pragma table_info({_quoted(t)})").fetchall():
            yield t, row[1]


def _same_row(db: sqlite3.Connection, table: str) -> list[str]:
    """What tells rows apart: the row id, or the primary key of a table without one."""
    try:
        db.execute(f"select rowid from {_quoted(table)} limit 1")
        return ["rowid"]
    except sqlite3.OperationalError:
        return [_quoted(c[1]) for c in sorted(db.execute(f"pragma table_info({_quoted(table)})").fetchall(), key=lambda c: c[5]) if c[5]]


def sqlite_values(content: bytes) -> Iterator[tuple[str, str]]:
    db = _open(content)
    try:
        for t, c in _columns(db):
            for (v,) in db.execute(f"select {_quoted(c)} from {_quoted(t)} where typeof({_quoted(c)}) = 'text'"):
                yield f"{t}.{c}", v
    finally:
        db.close()


def sqlite_rewritten(content: bytes, rewrite: Rewrite) -> bytes:
    """Text cells; then vacuumed, so no old bytes stay in free pages."""
    db = _open(content)
    try:
        columns = list(_columns(db))
        keys = {t: _same_row(db, t) for t, _ in columns}
        for t, c in columns:
            key = keys[t]
            cells = db.execute(f"select {_quoted(c)}, {', '.join(key)} from {_quoted(t)} where typeof({_quoted(c)}) = 'text'").fetchall()
            new = [(w, *k) for v, *k in cells if (w := rewrite(v)) != v]
            db.executemany(f"update {_quoted(t)} set {_quoted(c)} = ? where {' and '.join(f'{k} = ?' for k in key)}", new)
        db.commit()
        db.execute("vacuum")
        return db.serialize()
    finally:
        db.close()


# ---- crash reports: a JSON header line and a JSON body, or plain text


def ips_parts(text: str) -> tuple[object, object] | None:
    head, nl, body = text.partition("\n")
    try:
        return (json.loads(head), json.loads(body)) if nl else None
    except ValueError:
        return None


def ips_rewritten(text: str, rewrite: Rewrite, hidden: Hidden = ()) -> str:
    def walk(x: object) -> object:
        if isinstance(x, str):
            return rewrite(x)
        if isinstance(x, dict):
            return {k: walk(v) for k, v in x.items()}
        return [walk(v) for v in x] if isinstance(x, list) else x

    parts = ips_parts(text)
    if parts is None:
        return rewrite(without_memory_dumps(text, hidden))
    return "\n".join(json.dumps(walk(p), ensure_ascii=False, separators=(",", ":")) for p in parts)


DUMP_NOTE = "memory near <hexdump dropped: contained PII>"  # fixed value


def without_memory_dumps(text: str, hidden: Hidden) -> str:
    """Memory blocks that hold a hidden value (from a 'memory near' line through its dump lines) become a note."""
    out: list[str] = []
    block: list[str] = []
    holds = hidden if callable(hidden) else lambda part: any(h in part for h in hidden)

    def close() -> None:
        if block:
            out.extend([DUMP_NOTE] if holds("\n".join(block)) else block)
        block.clear()

    for line in text.split("\n"):
        if "memory near" in line.lower():
            close()
            block.append(line)
        elif block and (line[:1] in (" ", "\t") or (":" in line and len(line) > 20)):
            block.append(line)
        else:
            close()
            out.append(line)
    close()
    return "\n".join(out)


# ---- protocol buffers without a schema


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ParseError("varint")
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def _encoded(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def protobuf_fields(data: bytes) -> list[tuple[int, int, bytes]]:
    """(number, wire type, payload) of each top-level field."""
    out, at = [], 0
    while at < len(data):
        key, at = _varint(data, at)
        number, wire = key >> 3, key & 7
        if not number:
            raise ParseError("field 0")
        if wire == 0:
            _, end = _varint(data, at)
        elif wire in (1, 5):
            end = at + (8 if wire == 1 else 4)
        elif wire == 2:
            size, at = _varint(data, at)
            end = at + size
        else:
            raise ParseError(f"wire type {wire}")
        if end > len(data):
            raise ParseError("truncated")
        out.append((number, wire, data[at:end]))
        at = end
    return out


def _is_message(data: bytes) -> bool:
    """The payload parses as a message with a nested text, so its inner lengths must not change."""
    try:
        return any(w == 2 and p for _, w, p in protobuf_fields(data))
    except ParseError:
        return False


def _text(payload: bytes) -> str | None:
    try:
        text = payload.decode()
    except UnicodeDecodeError:
        return None
    return text if any(c.isascii() and c.isalnum() for c in text) else None


def protobuf_values(content: bytes) -> Iterator[tuple[str, str]]:
    """Texts of fields, those of nested messages under the path of their numbers."""
    try:
        fields = protobuf_fields(content)
    except ParseError:
        return
    for number, wire, payload in fields:
        if wire != 2:
            continue
        if _is_message(payload):
            for path, text in protobuf_values(payload):
                yield f"{number}.{path}", text
        elif (text := _text(payload)) is not None:
            yield str(number), text


def protobuf_rewritten(content: bytes, rewrite: Rewrite) -> bytes:
    """Text fields again with their new lengths; nested messages are rewritten field by field, malformed ones stay."""
    try:
        fields = protobuf_fields(content)
    except ParseError:
        return content
    out = b""
    for number, wire, payload in fields:
        if wire == 2:
            if _is_message(payload):
                payload = protobuf_rewritten(payload, rewrite)
            elif (text := _text(payload)) is not None:
                payload = rewrite(text).encode()
            payload = _encoded(len(payload)) + payload
        out += _encoded(number << 3 | wire) + payload
    return out


Values = Callable[[bytes], Iterator[tuple[str, str]]]
VALUES: dict[str, Values] = {"plist": plist_values, "sqlite": sqlite_values, "protobuf": protobuf_values}
REWRITES: dict[str, Callable[[bytes, Rewrite], bytes]] = {"plist": plist_rewritten, "sqlite": sqlite_rewritten, "protobuf": protobuf_rewritten}


def register(name: str, values: Values, rewritten: Callable[[bytes, Rewrite], bytes]) -> None:
    """A format of one's own; operators.members.register tells which members have it."""
    VALUES[name], REWRITES[name] = values, rewritten
