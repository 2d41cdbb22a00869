import hashlib
import random
import re
import zlib
from itertools import product

from isolates.llm import op11_dialogue as op11

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(symbols, most=2):
    """The least (cost, audit) over all edits of every row and up to ``most`` insertions anywhere."""
    choices = []
    for c in symbols:
        extra = 5 if c.isupper() else 0
        own = c.lower() if c.lower() in "sua" else "x"
        choices.append([(2, "D", "")] + ([] if c in "bd" else [(extra, "K", own), (1 + extra, "R", "u"), (1 + extra, "R", "a")]))
    gaps = [x for x in product(["", "u", "a", "ua", "au", "uu", "aa"], repeat=len(symbols) + 1) if sum(map(len, x)) <= most]
    best = None
    for rows in product(*choices):
        for gap in gaps:
            roles = gap[0] + "".join(r[2] + g for r, g in zip(rows, gap[1:]))
            if re.fullmatch("(s?(ua)+)?", roles):
                audit = "I" * len(gap[0]) + "".join(r[1] + "I" * len(g) for r, g in zip(rows, gap[1:]))
                found = (sum(r[0] for r in rows) + 5 * sum(map(len, gap)), audit)
                best = min(best or found, found)
    return best


def by_rows(symbols):
    """The same by one pass over the rows, a state at a time."""
    inf = (1 << 40, "")
    moves = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}

    def closed(state):
        for _ in range(3):
            for role in "ua":
                for p, q in moves[role].items():
                    state[q] = min(state[q], (state[p][0] + 5, state[p][1] + "I"))
        return state

    state = closed([(0, ""), inf, inf, inf])
    for c in symbols:
        new = [(x[0] + 2, x[1] + "D") for x in state]
        if c not in "bd":
            extra = 5 if c.isupper() else 0
            for role in "sua":
                own = role == c.lower()
                for p, q in moves[role].items() if own or role != "s" else []:
                    new[q] = min(new[q], (state[p][0] + extra + (0 if own else 1), state[p][1] + ("K" if own else "R")))
        state = closed(new)
    return min(state[0], state[3])


def test_cells_give_the_cheapest_edits():
    rng = random.Random(1)
    for n in (1, 2, 3):
        for _ in range(40):
            symbols = "".join(rng.choice("bdsuaoSUA") for _ in range(n))
            assert op11.parse(symbols) == cheapest(symbols)
    assert op11.parse("") == (0, "")
    for n in (8, 9, 30, 200):  # whole segments as spans of further charts
        for letters in ("bdsuaoSUAO", "ua", "uUa"):
            symbols = "".join(rng.choice(letters) for _ in range(n))
            assert op11.parse(symbols) == by_rows(symbols)


def plain(rows):
    """The result for rows (conv_id, turn, role, text), one conversation after the other."""
    convs = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        held = convs.setdefault(conv, [])
        if kind:
            row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            held += [row] * (2 if kind == 3 else 1)
    out = {}
    for conv, held in convs.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, symbols, counts = set(), "", {"b": 0, "d": 0, "t": 0}
        for _, role, text in held:
            solid = text.rstrip(" \t\n\x0b\x0c\r")
            c = role[:1] if role[:1] in ("s", "u", "a") else "o"
            c = "b" if not solid else "d" if (role, text) in seen else c if solid[-1] in ".!?" else c.upper()
            seen.add((role, text))
            symbols += c
            key = c if c in "bd" else "t" if c.isupper() else None
            if key:
                counts[key] += 1
        cost, audit = by_rows(symbols)
        turns = [r[0] for r in held if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
        lines, left, user = [], iter(held), True
        for edit in audit:
            _, role, text = ("", "", "") if edit == "I" else next(left)
            if edit == "D":
                continue
            kept_system = edit == "K" and role[:1] == "s"
            lines.append(f"{role if edit == 'K' else 'user' if user else 'assistant'}:{text}")
            user = user if kept_system else not user
        out[conv] = (gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_conversations_by_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for conv in range(150):
        n = rng.randint(1, 9) if conv < 140 else 60
        for turn in range(n):
            if rng.random() < 0.9:
                rows.append((conv, turn, rng.choice(["user", "assistant", "system", "user", "assistant"]), rng.choice(["Yes.", "No?", "and so", " \n", f"t{turn}!", f"ü{turn} "])))
    rows += [(None, None, None, None), (None, 3, "user", "Hi."), (None, 3, "user", "Hi."), (500, None, None, "x."), (500, None, "user", None), (501, 2, "tool", "A."), (502, 7, "", "A.")]
    rows += [(503, t, "user" if t % 2 == 0 else "assistant", "w " * 400_000 + f"{t}.") for t in range(3)]  # texts above a slice
    rows += [(c, t, r, x) for c, t, r, x in rows[:5]]  # repeated rows
    lost = next(c for c in range(600, 700) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((lost, 0, "user", "All rows of this one are dropped."))
    frame = spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA + ", symbol string, digest int").repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in op11.repair_digests(op11.damage(frame)).collect()}
    want = plain(rows)
    assert got.keys() == want.keys()
    assert {c: (got[c], want[c]) for c in want if got[c] != want[c]} == {}
    assert got[lost] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi."), (1, 2, "assistant", "So."), (1, 3, "user", "And?"), (2, 0, "system", " "), (3, None, "user", "A?"), (3, 1, "bot", "B.")]
    frame = op11.as_rows(spark.createDataFrame(rows, SCHEMA))
    report = {r.conv_id: (r.cost, r.audit) for r in op11.conversation_report(frame).collect()}
    assert report == {1: (4, "DKKD"), 2: (2, "D"), 3: (1, "KR")}
    got = [tuple(r) for r in op11.repaired_rows(frame).orderBy("conv_id", "place").collect()]
    assert got == [(1, 0, "K", "user", "Hi."), (1, 1, "K", "assistant", "So."), (3, 0, "K", "user", "A?"), (3, 1, "R", "assistant", "B.")]
    assert op11.repair_digests(op11.damage(spark.createDataFrame([], SCHEMA))).collect() == []
