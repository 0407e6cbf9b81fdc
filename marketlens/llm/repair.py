"""Cheapest edits that give every conversation the form system? (user assistant)*.

A row of a conversation is known by one letter: `s`, `u` or `a` if its role begins so and nothing
is wrong, `o` for any other role, the same in capitals if its text breaks off, and `x` if it has
to go, being blank or a duplicate. The edits are Delete, Insert, Keep and Rerole (D, I, K, R).

The search is iterative-deepening A*: depth first in the order of these letters, under a bound on
the cost so far plus a lower bound of what is still to come; the bound rises to the least sum
that exceeded it. A table keeps, for each place and state, the largest budget with which it has
failed. Under the first bound that admits a path, the first path is the least in ASCII order
among the cheapest. Long stretches are cut into chunks, each searched from and to every state;
`joined` puts the results together. That is exact: edits that lead from one state to another at
the same cost are never a prefix of one another, as what one has more would be inserted rows.
"""

from functools import lru_cache
from os.path import commonprefix

#: States after some output rows: none, a system row, a user row, an assistant row.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = (EMPTY, ASSISTANT)
#: Where a user or assistant row leads, whichever of them may come next.
NEXT = (USER, USER, ASSISTANT, USER)
INSERT = REROLE = TRUNCATED = 3
DELETE = 4
#: Rows of a chunk.
CHUNK = 32
NEVER = 1 << 40


def _kept(letter, state):
    """The state after a row is kept, or None."""
    role = letter.lower()
    if role == "s":
        return SYSTEM if state == EMPTY else None
    if role in "ua" and NEXT[state] == (USER if role == "u" else ASSISTANT):
        return NEXT[state]
    return None


def _least_costs(letters, goal):
    """Lower bounds of the cost to come, by state and place; NEVER where the goal is out of reach."""
    n = len(letters)
    table = [[0] * (n + 1) for _ in range(4)]
    for at in range(n - 1, -1, -1):
        letter = letters[at]
        cut = TRUNCATED if letter.isupper() else 0
        role = letter.lower()
        free = DELETE if role == "x" else min(DELETE, cut + (REROLE if role == "o" else 0))
        # Only the first row of all can stay a system row.
        late = min(DELETE, cut + REROLE) if role == "s" else free
        for state in range(4):
            table[state][at] = table[state][at + 1] + (free if state == EMPTY else late)
    if USER not in goal and ASSISTANT not in goal:
        for at in range(n + 1):
            gone = DELETE * (n - at)
            table[USER][at] = table[ASSISTANT][at] = NEVER
            table[SYSTEM][at] = gone if SYSTEM in goal else NEVER
            table[EMPTY][at] = gone if EMPTY in goal else max(0, gone - DELETE)
    return table


@lru_cache(maxsize=200_000)
def cheapest(letters, start, goal):
    """(cost, edits) from state `start` to one of the states `goal`; None if there is no way."""
    n = len(letters)
    least = _least_costs(letters, goal)
    bound = least[start][0]
    while bound < NEVER:
        failed, beyond, path = {}, [NEVER], []

        def search(at, state, budget):
            if least[state][at] > budget:
                beyond[0] = min(beyond[0], least[state][at] - budget)
                return False
            if at == n and state in goal:
                return True
            if failed.get((at, state), -1) >= budget:
                return False
            letter = letters[at] if at < n else None
            if letter and step("D", at + 1, state, budget - DELETE):
                return True
            if step("I", at, NEXT[state], budget - INSERT):
                return True
            if letter and letter != "x":
                cut = TRUNCATED if letter.isupper() else 0
                kept = _kept(letter, state)
                if kept is not None and step("K", at + 1, kept, budget - cut):
                    return True
                if step("R", at + 1, NEXT[state], budget - cut - REROLE):
                    return True
            failed[(at, state)] = budget
            return False

        def step(edit, at, state, budget):
            path.append(edit)
            if search(at, state, budget):
                return True
            path.pop()
            return False

        if search(0, start, bound):
            return bound, "".join(path)
        bound += beyond[0]
    return None


def ways(letters):
    """(cost, edits) by start and end state, as lists of lists, of a stretch of any length."""
    total = None
    for first in range(0, max(len(letters), 1), CHUNK):
        part = letters[first : first + CHUNK]
        found = [[cheapest(part, start, (end,)) for end in range(4)] for start in range(4)]
        total = found if total is None else [
            [_best([_then(row[k], found[k][end]) for k in range(4)]) for end in range(4)]
            for row in total
        ]
    return total


def _then(a, b):
    return a and b and (a[0] + b[0], a[1] + b[1])


def _best(options):
    return min((o for o in options if o), default=None)


def joined(stretches):
    """The cheapest edits of a whole conversation given by the `ways` of its stretches in order.

    Returns the cost and, per stretch, the state before it and its edits. What all ways so far
    begin with decides nothing between them and is dropped, so that what is kept stays short.
    """
    states = [(0, "", ()) if s == EMPTY else None for s in range(4)]
    for found in stretches:
        reached = []
        for end in range(4):
            options = [
                (before[0] + found[s][end][0], before[1] + found[s][end][1], s)
                for s, before in enumerate(states)
                if before and found[s][end]
            ]
            best = min(options, default=None)
            reached.append(best and (*best[:2], (states[best[2]][2], best[2], found[best[2]][end][1])))
        same = len(commonprefix([state[1] for state in reached if state]))
        states = [state and (state[0], state[1][same:], state[2]) for state in reached]
    cost, _, link = min(states[s][:2] + (states[s][2],) for s in ACCEPTED if states[s])
    pieces = []
    while link:
        link, state, edits = link
        pieces.append((state, edits))
    return cost, pieces[::-1]


def repair(letters):
    """(cost, edits) of a whole conversation."""
    if len(letters) <= CHUNK:
        return cheapest(letters, EMPTY, ACCEPTED)
    cost, pieces = joined([ways(letters)])
    return cost, pieces[0][1]


def applied(edits, rows, state):
    """The rows (role, text) that the edits leave of an iterator of rows, after `state`."""
    names = {USER: "user", ASSISTANT: "assistant"}
    for edit in edits:
        if edit == "D":
            next(rows)
        elif edit == "K":
            role, text = next(rows)
            state = SYSTEM if state == EMPTY and role[:1] == "s" else NEXT[state]
            yield role, text
        else:
            text = next(rows)[1] if edit == "R" else ""
            state = NEXT[state]
            yield names[state], text
