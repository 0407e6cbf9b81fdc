import heapq
import random
import zlib

import pytest

from marketlens.llm import conversations, repair
from tests.llm.tools import sha

LETTERS = "suaoSUAOxuaua"
WHITE = " \t\n\x0b\x0c\r"


def follows(state, name):
    """The state after a row with this initial, by the form s?(ua)*; None if it can't come here."""
    allowed = {0: "su", 1: "u", 2: "a", 3: "u"}[state]
    return {"s": 1, "u": 2, "a": 3}[name] if name in allowed else None


def by_hand(letters):
    """Cheapest first, then least edits: a plain search over whole strings of edits."""
    heap, done = [(0, "", 0, 0)], {}
    while True:
        cost, edits, at, state = heapq.heappop(heap)
        if at == len(letters) and state in (0, 3):
            return cost, edits
        if done.get((at, state), (cost, edits + "z")) <= (cost, edits):
            continue
        done[at, state] = (cost, edits)
        for name in "ua":
            after = follows(state, name)
            if after is None:
                continue
            heapq.heappush(heap, (cost + 3, edits + "I", at, after))
            if at < len(letters) and letters[at] != "x":
                cut = 3 if letters[at].isupper() else 0
                heapq.heappush(heap, (cost + cut + 3, edits + "R", at + 1, after))
        if at < len(letters):
            heapq.heappush(heap, (cost + 4, edits + "D", at + 1, state))
            kept = follows(state, letters[at].lower()) if letters[at] != "x" else None
            if kept is not None:
                heapq.heappush(heap, (cost + (3 if letters[at].isupper() else 0), edits + "K", at + 1, kept))


def some_letters(chance, n):
    return "".join(chance.choice(LETTERS) for _ in range(n))


def test_search_finds_the_least_of_the_cheapest():
    chance = random.Random(1)
    for n in [*range(9)] * 60:
        letters = some_letters(chance, n)
        assert repair.repair(letters) == by_hand(letters), letters


@pytest.mark.parametrize("chunk", [1, 2, 5])
def test_stretches_and_chunks_change_nothing(monkeypatch, chunk):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    chance = random.Random(chunk)
    for _ in range(80):
        letters = some_letters(chance, chance.randrange(1, 16))
        cost, pieces = repair.joined([repair.ways(letters[i : i + 4]) for i in range(0, len(letters), 4)])
        assert (cost, "".join(edits for _, edits in pieces)) == by_hand(letters)
        assert repair.repair(letters) == by_hand(letters)


def test_search_against_every_string_of_edits():
    """All strings of up to three edits more than rows, by the definition alone."""

    def cost_of(letters, edits):
        at = state = cost = 0
        for edit in edits:
            if edit != "I" and at == len(letters):
                return None
            letter = letters[at] if edit != "I" else ""
            if edit in "KR" and letter == "x":
                return None
            if edit == "D":
                cost += 4
            else:
                name = letter.lower() if edit == "K" else "a" if state == 2 else "u"
                state = follows(state, name)
                if state is None:
                    return None
                cost += (0 if edit == "K" else 3) + (3 if edit != "I" and letter.isupper() else 0)
            at += edit != "I"
        return cost if at == len(letters) and state in (0, 3) else None

    def strings(n):
        return [""] if n == 0 else ["", *[e + rest for e in "DIKR" for rest in strings(n - 1)]]

    chance = random.Random(4)
    for _ in range(25):
        letters = some_letters(chance, chance.randrange(4))
        costs = [(cost_of(letters, e), e) for e in set(strings(6))]
        assert repair.repair(letters) == min(c for c in costs if c[0] is not None)


def expected(rows):
    """Rows (conv_id, turn, role, text) to audits by conversation, one by one."""
    convs = {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        chance = zlib.crc32(name.encode()) % 20
        text = {1: "", 2: "".join(c for c in text if c not in ".!?")}.get(chance, text)
        row = (turn, "user" if chance == 4 else role, text)
        kept += [row] * {0: 0, 3: 2}.get(chance, 1)
    return {conv: audit(sorted(kept, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))) for conv, kept in convs.items()}


def audit(rows):
    faults, seen = [], set()
    for _, role, text in rows:
        last = text.rstrip(WHITE)[-1:]
        faults.append(
            "blank" if not last else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated"
        )
        seen.add((role, text))
    letters = ""
    for (_, role, _), fault in zip(rows, faults):
        letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
        letters += "x" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
    cost, edits = by_hand(letters)
    left, state, at = [], 0, 0
    for edit in edits:
        if edit != "D":
            role, text = rows[at][1:] if edit == "K" else ("assistant" if state == 2 else "user", rows[at][2] if edit == "R" else "")
            state = follows(state, role[0])
            left.append((role, text))
        at += edit != "I"
    turns = {r[0] for r in rows if r[0] is not None}
    initials = [r[1][:1] for r in rows]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        *[faults.count(name) for name in ("blank", "duplicate", "truncated")],
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        cost,
        edits,
        sha("\n".join(f"{r}:{t}" for r, t in left)),
        left,
    )


def agree(spark, rows, parts=3):
    df = spark.createDataFrame(
        [(*r, 1, "x") for r in rows],
        "conv_id long, turn long, role string, text string, place int, gone string",
    )
    found = conversations.repaired(conversations.damaged(df.repartition(parts)))
    want = expected(rows)
    assert {r.conv_id: tuple(r)[1:] for r in found.audits.collect()} == {c: w[:-1] for c, w in want.items()}
    turns = {}
    for r in found.turns.orderBy("conv_id", "place").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    assert turns == {c: w[-1] for c, w in want.items() if w[-1]}


def some_rows(chance, conv, n):
    texts = ["Yes.", "No!", "cut off", "", " \n", "why?", "Yes. \t", None, "ä.", "…"]
    roles = ["user", "assistant"] * 4 + ["system", "tool", "", None, "User"]
    return [
        (conv, chance.choice([None, t, t, t, t + 1]), roles[t % 2] if chance.random() < 0.7 else chance.choice(roles),
         chance.choice(texts) if chance.random() < 0.4 else f"Line {conv} {t}.")
        for t in range(n)
    ]


def test_tables(spark):
    chance = random.Random(8)
    rows = [r for conv in [*range(120), None] for r in some_rows(chance, conv, chance.randrange(1, 12))]
    agree(spark, rows + rows[:30])
    agree(spark, [])
    agree(spark, [(5, 3, "user", "One.")])


def test_one_long_conversation_and_one_row_repeated(spark):
    chance = random.Random(9)
    rows = some_rows(chance, 7, 2600) + some_rows(chance, 8, 30) + some_rows(chance, 9, 3)
    rows += [(8, 4, "user", "Again.")] * 1500 + [(10, 0, "user", "long. " * 1_000_000)]
    agree(spark, rows, 5)


def test_conversation_that_loses_all_rows(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    agree(spark, [(1, turn, "user", "Gone."), (2, 0, "user", "Here.")])


def test_rows_as_they_are(spark):
    df = spark.createDataFrame(
        [("b", 0, "system", "Be short."), ("b", 1, "assistant", "Yes."), ("a", 1, "user", "Hi")],
        "conv_id string, turn int, role string, text string",
    )
    found = {r.conv_id: r for r in conversations.repaired(conversations.given(df)).audits.collect()}
    assert (found["a"].audit, found["a"].cost, found["a"].truncated) == ("D", 4, 1)
    assert (found["b"].audit, found["b"].cost, found["b"].illegal) == ("KIK", 3, 1)
