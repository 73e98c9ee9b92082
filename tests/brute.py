"""Plain Python versions of the general operators, written from their definitions only."""

from __future__ import annotations

import json
import re
from collections import defaultdict
from datetime import datetime, timedelta


def split_values(field):
    """Character by character, as the definition of packed values reads."""
    if field is None:
        return []

    def close(s, i):
        q, k = s[i], i + 1
        while k < len(s):
            if s[k] == "\\" and s[k + 1 : k + 2] == q:
                k += 2
            elif s[k] == q and s[k + 1 : k + 2] == q:
                k += 2
            elif s[k] == q:
                return k
            else:
                k += 1
        return None

    s = field.strip()
    if s[:1] == '"' and close(s, 0) == len(s) - 1 and len(s) > 1:
        s = s[1:-1].replace('""', '"')
    out, i, run = [], 0, ""
    while i <= len(s):
        c = s[i] if i < len(s) else " "
        if re.match("[A-Za-z0-9_-]", c):
            run += c
        else:
            if run:
                out.append(run)
            run = ""
            if c in "\"'" and i < len(s) and (end := close(s, i)) is not None:
                inner = s[i + 1 : end]
                value, k = "", 0
                while k < len(inner):
                    if inner[k] in (c, "\\") and inner[k + 1 : k + 2] == c:
                        value += c
                        k += 2
                    else:
                        value += inner[k]
                        k += 1
                if value.strip():
                    out.append(value.strip())
                i = end
        i += 1
    return out


def mentions(text):
    """(item_path, item_key, mention_pos, surface) of one entity field."""
    try:
        root = json.loads(text) if text else None
    except ValueError:
        return []
    if isinstance(root, dict) and isinstance(root.get("payload"), dict):
        root = root["payload"]
    if isinstance(root, dict) and "entities" in root:
        root = root["entities"]
    if isinstance(root, dict):
        root = [root] if root else []
    out = []

    def walk(entities, prefix):
        for i, e in enumerate(entities or []):
            key = e.get("entity_id") or e.get("id") or ""
            said = e.get("mentions") or []
            for k, m in enumerate(said):
                out.append((f"{prefix}{i}", key, k, m.get("surface") or ""))
            if not said:
                out.append((f"{prefix}{i}", key, -1, ""))
            walk(e.get("members"), f"{prefix}{i}.")

    walk(root, "")
    return out


def sessions(events, gap=1_800_000_000):
    """events: (impression_id, user, micros)."""
    by_user = defaultdict(dict)
    seen = set()
    for i, u, t in sorted((e for e in events if None not in e), key=lambda e: (e[2], e[1])):
        if i not in seen:
            seen.add(i)
            by_user[u][i] = t
    out = []
    for u, own in by_user.items():
        times = sorted(own.values())
        start, n = times[0], 1
        for a, b in zip(times, times[1:]):
            if b - a > gap:
                out.append((u, start, a, n))
                start, n = b, 0
            n += 1
        out.append((u, start, times[-1], n))
    return out


def columns(line):
    """The unquoted columns of a line, or None for broken quoting."""
    out, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            value, k = "", i + 1
            while True:
                if k >= len(line):
                    return None
                if line[k] == '"':
                    if line[k + 1 : k + 2] == '"':
                        value += '"'
                        k += 2
                        continue
                    break
                value += line[k]
                k += 1
            k += 1
            if k < len(line) and line[k] != "\t":
                return None
            out.append(value)
        else:
            k = line.find("\t", i)
            k = len(line) if k < 0 else k
            out.append(line[i:k])
        if k >= len(line):
            return out
        i = k + 1


def instant(s):
    m = re.fullmatch(r"(\d{1,2})/(\d{1,2})/(\d{4}) (\d{1,2}):(\d\d):(\d\d) ([AP]M)", s.upper(), re.ASCII)
    if m:
        try:
            h = int(m[4])
            if not 1 <= h <= 12:
                return None
            return datetime(int(m[3]), int(m[1]), int(m[2]), h % 12 + 12 * (m[7] == "PM"), int(m[5]), int(m[6]))
        except ValueError:
            return None
    m = re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)[ T](\d\d):(\d\d):(\d\d)(?:\.(\d+))?(Z|[+-]\d\d:?\d\d)?", s, re.ASCII)
    if m:
        try:
            t = datetime(*[int(m[i]) for i in range(1, 7)], int((m[7] or "0").ljust(6, "0")[:6]))
        except ValueError:
            return None
        if m[8] and m[8] != "Z":
            h, mi = int(m[8][1:3]), int(m[8][-2:])
            if h > 23 or mi > 59:
                return None
            t -= timedelta(minutes=(h * 60 + mi) * (-1 if m[8][0] == "-" else 1))
        return t
    return None


def reason(line, feed):
    cols = columns(line or "")
    if cols is None:
        return "quote"
    if len(cols) != (8 if feed == "news" else 5):
        return "columns"
    cols = [c.strip() for c in cols]
    if feed == "news":
        return None if re.fullmatch(r"N[0-9]+", cols[0]) else "id"
    if not cols[0] or not cols[1]:
        return "id"
    if instant(cols[2]) is None:
        return "timestamp"
    if all(re.fullmatch(r"N[0-9]+(-[01])?", t) for t in cols[4].split()):
        return None
    return "impressions"
