"""Plain versions of the conversation repair."""

import hashlib
import re
import zlib

COST = {"D": 4, "I": 3, "K": 0, "R": 3}


def least_repair(rows):
    """(cost, audit, output) by relaxing whole (cost, audit) values until nothing changes.

    ``rows``: (initial, has to go, cut off). The tables go from the last row to the first.
    """
    step = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    after = {0: (0, ""), 3: (0, "")}

    def with_inserts(table):
        for _ in range(5):
            for q, moves in step.items():
                for x, to in moves.items():
                    if x != "s" and to in table:
                        new = (table[to][0] + 3, "I" + table[to][1])
                        table[q] = min(table.get(q, new), new)
        return table

    after = with_inserts(after)
    for initial, must_go, cut in reversed(rows):
        now = {q: (c + 4, "D" + a) for q, (c, a) in after.items()}
        if not must_go:
            for q, moves in step.items():
                for x, to in moves.items():
                    for letter in ["K"] * (x == initial) + ["R"] * (x != "s"):
                        if to in after:
                            new = (after[to][0] + COST[letter] + 3 * cut, letter + after[to][1])
                            now[q] = min(now.get(q, new), new)
        after = with_inserts(now)
    return after[0]


def every_repair(rows, inserts):
    """The least (cost, audit) of all edit sequences with at most so many insertions."""
    found = []

    def go(i, roles, cost, audit, left):
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            found.append((cost, audit))
        if left:
            for x in "ua":
                go(i, roles + x, cost + 3, audit + "I", left - 1)
        if i < len(rows):
            initial, must_go, cut = rows[i]
            go(i + 1, roles, cost + 4, audit + "D", left)
            if not must_go:
                go(i + 1, roles + (initial or "?"), cost + 3 * cut, audit + "K", left)
                for x in "ua":
                    go(i + 1, roles + x, cost + 3 + 3 * cut, audit + "R", left)

    go(0, "", 0, "", inserts)
    return min(found)


def damaged(rows):
    """Rows (conv, turn, role, text) after the damage."""
    out = []
    text = lambda x: " " if x is None else str(x)
    for conv, turn, role, body in rows:
        kind = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
        role, body = text(role), text(body)
        if kind == 0:
            continue
        body = "" if kind == 1 else re.sub("[.!?]", "", body) if kind == 2 else body
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, body)] * (2 if kind == 3 else 1)
    return out


def repair(rows):
    """{conv: result row} of rows (conv, turn, role, text)."""
    after, result = damaged(rows), {}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for conv in {row[0] for row in rows}:
        own = [row for row in after if row[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), digest(r[3])))
        turns = [row[1] for row in own if row[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, faults = set(), []
        for _, _, role, text in own:
            letters = re.findall(r"[^\x20\x09-\x0D]", text)
            if not letters:
                faults.append("blank")
            elif (role, text) in seen:
                faults.append("duplicate")
            else:
                faults.append("" if letters[-1] in ".!?" else "truncated")
            seen.add((role, text))
        initials = [row[2][:1] for row in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        rules = [(x, f in ("blank", "duplicate"), f == "truncated") for x, f in zip(initials, faults, strict=True)]
        cost, audit = least_repair(rules)
        out, at = [], 0
        for letter in audit:
            want = "assistant" if out and out[-1][0][0] == "u" else "user"
            if letter == "I":
                out.append((want, ""))
                continue
            if letter != "D":
                out.append((own[at][2] if letter == "K" else want, own[at][3]))
            at += 1
        lines = digest("\n".join(f"{role}:{text}" for role, text in out))
        count = faults.count
        result[conv] = (conv, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, lines)
    return result
