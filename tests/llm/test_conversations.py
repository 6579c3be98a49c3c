import hashlib
import heapq
import itertools
import random
import re
import zlib

from fieldspark.llm import conversations as C

NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
SCHEMA = "conv_id long, turn long, role string, text string, c int, s long, n long, at long, fault string, choice int"


def cheapest(rows, entry=0, goal=None):
    """Dijkstra by (cost, audit) over whole audits: the first that ends well is the cheapest, and ASCII-least."""
    heap, seen = [(0, "", 0, entry, "")], set()
    while heap:
        cost, audit, i, state, last = heapq.heappop(heap)
        if i == len(rows) and (state in (0, 3) if goal is None else state == goal and last != "I"):
            return cost, audit
        if (i, state, audit) in seen or cost > 2 * len(rows) + 15:
            continue
        seen.add((i, state, audit))
        for r, to in NEXT[state].items():
            if r != "s":
                heapq.heappush(heap, (cost + 5, audit + "I", i, to, "I"))
        if i < len(rows):
            initial, doomed, cut = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, "D"))
            if not doomed:
                for r, to in NEXT[state].items():
                    if r == initial:
                        heapq.heappush(heap, (cost + 5 * cut, audit + "K", i + 1, to, "K"))
                    if r != "s":
                        heapq.heappush(heap, (cost + 1 + 5 * cut, audit + "R", i + 1, to, "R"))
    return None


def test_every_short_conversation_against_dijkstra():
    kinds = [(r, d, t) for r in "suax" for d, t in ((False, False), (True, False), (False, True))]
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            if n < 3 or random.random() < 0.3:
                assert C.search(list(rows)) == cheapest(rows), rows


def test_longer_ones_and_states_within():
    r = random.Random(5)
    for _ in range(150):
        rows = [(r.choice("ssuuaax"), r.random() < 0.2, r.random() < 0.15) for _ in range(r.randint(1, 6))]
        for entry, goal in itertools.product(range(4), range(4)):
            if C._reachable(rows, entry, goal):
                assert C.search(rows, entry, goal) == cheapest(rows, entry, goal), (rows, entry, goal)
            else:
                assert C.search(rows, entry, goal) is None


def brute(table):
    """The contract, conversation by conversation."""
    out = {}
    by = {}
    for conv, turn, role, text in table:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    for conv, rows in by.items():
        after = []
        for turn, role, text in rows:
            hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if hit == 0:
                continue
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            after += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
        after.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        seen, faults = set(), []
        for _, role, text in after:
            solid = re.sub("[\x20\x09-\x0d]", "", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        plan = [(role[:1], f in ("blank", "duplicate"), f == "truncated") for (_, role, _), f in zip(after, faults)]
        cost, audit = C.search(plan) if len(plan) > 7 else cheapest(plan)
        lines, at, state = [], 0, ""
        for edit in audit:
            to = "user" if state in ("", "s", "a") else "assistant"
            if edit == "I":
                lines.append(f"{to}:")
                state = to[0]
                continue
            _, role, text = after[at]
            at += 1
            if edit != "D":
                role = to if edit == "R" else role
                lines.append(f"{role}:{text}")
                state = role[0]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        turns = [t for t, *_ in after if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def rows_of(df):
    out = {r["conv_id"]: tuple(r[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in C.repair_conversations(df).collect()}
    assert C.repair_conversations(df).count() == len(out)
    return out


def made(seed, convs, most=6):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut of", "", " \t\n", "same thing.", "Ünï. ", "x.\x0b", None, "a\x85", "end…"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None]
    return [(c, r.choice([None, *range(9)]) if r.random() < 0.2 else t, r.choice(roles), r.choice(texts)) for c in range(convs) for t in range(r.randint(0, most))]


def test_rows_equal_brute_force(spark):
    table = [*made(1, 150), (None, 1, "user", "Null id."), (None, 2, "assistant", "Too."), (1, 1, "user", "Again."), (1, 1, "user", "Again."), (7, None, None, None)]
    df = spark.createDataFrame([(*t, 1, 2, 3, 4, "x", 5) for t in table], SCHEMA)
    assert rows_of(df) == brute(table)


def test_runs_put_together_equal_one_search(spark, monkeypatch):
    """Conversations that are cut into runs of two and four rows have the same repairs, and a long one is no burden."""
    table = made(2, 25, 40) + [(99, t, r, x) for t, (r, x) in enumerate(itertools.islice(itertools.cycle([("user", "Hi."), ("user", "So"), ("assistant", "Yes. "), ("system", "Sys.")]), 600))]
    df = spark.createDataFrame([(*t, 1, 2, 3, 4, "x", 5) for t in table], SCHEMA)
    expected = brute(table)
    for bits in (1, 2, 7):
        monkeypatch.setattr(C, "SEGMENT_BITS", bits)
        assert rows_of(df) == expected


def test_copies_of_one_row_are_one(spark):
    table = [(1, 5, "user", "Same.")] * 3000 + [(1, 6, "assistant", "Ok.")]
    df = spark.createDataFrame([(*t, 1, 2, 3, 4, "x", 5) for t in table], SCHEMA)
    assert rows_of(df) == brute(table)


def test_empty_table(spark):
    assert C.repair_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_search_of_many_conflicts():
    assert C.search([("s", False, False)] * 400) == (400, "DK" + "R" * 398)
