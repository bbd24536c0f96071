"""CREATE TABLE statements to a dataset spec, for the common subset of MySQL and ANSI."""

from __future__ import annotations

import re

from weftspark.plans.spec import Column, Dataset, ForeignKey, Table

_NAME = r"[`\"\[]?(\w+)[`\"\]]?"
_LIST = r"\(([^)]*)\)"


def _names(text: str) -> list[str]:
    return re.findall(r"\w+", re.sub(r"\(\d+\)", "", text))


def _parts(body: str) -> list[str]:
    """The definitions of a body: split at commas outside parentheses and quotes."""
    return [p.strip() for p in re.findall(r"(?:[^,('\"]|'(?:[^'\\]|\\.)*'|\"[^\"]*\"|\((?:[^()']|'[^']*'|\([^()]*\))*\))+", body)]


def read_ddl(text: str) -> Dataset:
    """Tables, primary and foreign keys, NOT NULL and UNIQUE of all CREATE TABLE statements."""
    text = re.sub(r"--[^\n]*|/\*.*?\*/", " ", text, flags=re.S)
    tables: dict[str, Table] = {}
    pattern = rf"create\s+table\s+(?:if\s+not\s+exists\s+)?(?:\w+\.)?{_NAME}\s*\(((?:[^()']|'(?:[^'\\]|\\.)*'|\((?:[^()]|\([^()]*\))*\))*)\)"
    for m in re.finditer(pattern, text, re.I):
        t = Table(m[1], [])
        for part in _parts(m[2]):
            part = re.sub(r"^constraint\s+\S+\s+", "", part, flags=re.I)
            if key := re.match(rf"primary\s+key\s*{_LIST}", part, re.I):
                t.primary_key = _names(key[1])
            elif key := re.match(rf"foreign\s+key\s*(?:\w+\s*)?{_LIST}\s*references\s+(?:\w+\.)?{_NAME}\s*{_LIST}", part, re.I):
                t.foreign_keys += [ForeignKey(c, key[2], r) for c, r in zip(_names(key[1]), _names(key[3]), strict=False)]
            elif re.match(r"(unique|key|index|fulltext|spatial|check)\b", part, re.I):
                if key := re.match(rf"unique\s*(?:key|index)?\s*\S*\s*{_LIST}", part, re.I):
                    t.candidate_keys.append(_names(key[1]))
            elif col := re.match(rf"{_NAME}\s+(\w+)(?:\s*\([^)]*\))?(.*)$", part, re.I | re.S):
                rest = col[3].lower()
                column = Column(col[1], col[2], "not null" not in rest and "primary key" not in rest, "unique" in rest)
                if "primary key" in rest:
                    t.primary_key = [col[1]]
                if ref := re.search(rf"references\s+{_NAME}\s*{_LIST}", col[3], re.I):
                    t.foreign_keys.append(ForeignKey(col[1], ref[1], _names(ref[2])[0]))
                t.columns.append(column)
        keys = {k.column: k for k in t.foreign_keys}
        for c in t.columns:
            if c.name in t.primary_key:
                c.role, c.nullable = "primary_key", False
            elif c.name in keys:
                c.role, c.references = "foreign_key", f"{keys[c.name].ref_table}.{keys[c.name].ref_column}"
        tables[t.name] = t
    return Dataset(tables)
