"""The cheapest edits of a sequence of turns, as linked prefixes that share their beginnings.

A row is a code: its role's initial (s, u, a or another) and what is wrong with it. A repaired conversation reads
``(s?(ua)+)?``, so four states say what may follow. For each row and state only the cheapest edits are kept, the
ASCII-least of equal cost, as a node that points to the node before it. Nodes have ancestors at all powers of two and
a rolling hash of their letters, so two long prefixes are compared by searching the length that they share.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import lru_cache
from itertools import pairwise

INITIALS = "sua"
OTHER = 3
SOUND, DELETE, TRUNCATED = 0, 1, 2
FAULTS = 3
START, STATES = 0, 4
ACCEPTED = (0, 3)
NEEDED = (1, 1, 2, 1)  # the initial that an insertion or a new role has in each state
NEXT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
LEGAL = {(0, 1), (1, 2), (2, 1)}
ROLES = ("system", "user", "assistant")
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
NEVER = 1 << 60
BASE, MODULUS = 0x5DEECE66D, (1 << 61) - 1


def code_of(role: str, fault: int) -> int:
    at = INITIALS.find(role[0]) if role else -1
    return (at if at >= 0 else OTHER) * FAULTS + fault


class EditLog:
    """Prefixes of edits as nodes of a tree; node 0 is the empty one."""

    def __init__(self):
        self.letters, self.depths, self.hashes, self.above = [""], [0], [0], [()]

    def add(self, node: int, letter: str) -> int:
        above, step = [node], 0
        while step < len(self.above[above[-1]]):
            above.append(self.above[above[-1]][step])
            step += 1
        self.letters.append(letter)
        self.depths.append(self.depths[node] + 1)
        self.hashes.append((self.hashes[node] * BASE + ord(letter)) % MODULUS)
        self.above.append(above)
        return len(self.letters) - 1

    def ancestor(self, node: int, depth: int) -> int:
        rest, step = self.depths[node] - depth, 0
        while rest:
            if rest & 1:
                node = self.above[node][step]
            rest, step = rest >> 1, step + 1
        return node

    def before(self, a: int, b: int) -> bool:
        """Whether the letters of ``a`` come before those of ``b``."""
        depth = min(self.depths[a], self.depths[b])
        x, y = self.ancestor(a, depth), self.ancestor(b, depth)
        if x == y:
            return self.depths[a] < self.depths[b]
        for step in range(len(self.above[x]) - 1, -1, -1):
            if step < len(self.above[x]):
                p, q = self.above[x][step], self.above[y][step]
                if self.hashes[p] != self.hashes[q]:
                    x, y = p, q
        first, second = self.letters[x], self.letters[y]
        p, q = self.above[x][0], self.above[y][0]
        while p != q:  # prefixes of equal hash: one node, unless the hashes collide
            if self.letters[p] != self.letters[q]:
                first, second = self.letters[p], self.letters[q]
            p, q = self.above[p][0], self.above[q][0]
        return first < second if first != second else self.depths[a] < self.depths[b]

    def text(self, node: int) -> str:
        letters = []
        while node:
            letters.append(self.letters[node])
            node = self.above[node][0]
        return "".join(reversed(letters))


Best = dict[int, tuple[int, int]]


def _offer(log: EditLog, best: Best, state: int, cost: int, node: int, letter: str) -> None:
    held = best.get(state)
    if held is None or cost < held[0]:
        best[state] = cost, log.add(node, letter)
    elif cost == held[0]:
        rival = log.add(node, letter)
        if log.before(rival, held[1]):
            best[state] = cost, rival


def _insertions(log: EditLog, best: Best) -> None:
    """From each state one inserted turn leads on; two lead from the start to a pair."""
    for target, sources in ((2, (0, 1, 3)), (3, (2,))):
        for state in sources:
            if state in best:
                _offer(log, best, target, best[state][0] + INSERT_COST, best[state][1], "I")


def forward(codes: Iterable[int], entry: int = START) -> tuple[EditLog, Best]:
    """The best edits of all rows from one state to each state."""
    log, best = EditLog(), {entry: (0, 0)}
    for code in codes:
        initial, fault = divmod(code, FAULTS)
        _insertions(log, best)
        after: Best = {}
        for state, (cost, node) in best.items():
            _offer(log, after, state, cost + DELETE_COST, node, "D")
            if fault != DELETE:
                own = cost + (TRUNCATED_COST if fault == TRUNCATED else 0)
                if (state, initial) in NEXT:
                    _offer(log, after, NEXT[state, initial], own, node, "K")
                _offer(log, after, NEXT[state, NEEDED[state]], own + REROLE_COST, node, "R")
        best = after
    return log, best


@lru_cache(maxsize=100_000)
def cheapest(codes: bytes) -> tuple[int, str]:
    """Cost and letters of the cheapest edits of a whole conversation, given as its codes."""
    log, best = forward(codes)
    _insertions(log, best)
    chosen = None
    for state in ACCEPTED:
        if state in best:
            cost, node = best[state]
            if chosen is None or cost < chosen[0] or (cost == chosen[0] and log.before(node, chosen[1])):
                chosen = cost, node
    return chosen[0], log.text(chosen[1])


def illegal_pairs(codes: Sequence[int]) -> int:
    return sum((a // FAULTS, b // FAULTS) not in LEGAL for a, b in pairwise(codes))


def applied(letters: str, rows: Sequence[tuple[str, str]], state: int = START) -> list[tuple[str, str]]:
    """The (role, text) messages that the edits leave of these rows, from a state on."""
    messages, left = [], iter(rows)
    for letter in letters:
        if letter == "I":
            messages.append((ROLES[NEEDED[state]], ""))
            state = NEXT[state, NEEDED[state]]
            continue
        role, text = next(left)
        if letter == "K":
            messages.append((role, text))
            state = NEXT[state, INITIALS.find(role[0])]
        elif letter == "R":
            messages.append((ROLES[NEEDED[state]], text))
            state = NEXT[state, NEEDED[state]]
    return messages


def state_after(letters: str, codes: Sequence[int], state: int = START) -> list[tuple[str, int]]:
    """For each row its letters, insertions before it included, and the state that they begin in."""
    out, own, begun, left = [], "", state, iter(codes)
    for letter in letters:
        own += letter
        if letter == "I":
            state = NEXT[state, NEEDED[state]]
            continue
        code = next(left)
        if letter != "D":
            state = NEXT[state, code // FAULTS if letter == "K" else NEEDED[state]]
        out.append((own, begun))
        own, begun = "", state
    return out


# ------------------------------------------------------------------ blocks of long conversations

CLOSING = {0: "", 1: "II", 2: "I", 3: ""}


def summary(codes: Sequence[int]) -> tuple[list[int], list[int]]:
    """Of a block of rows: for each entry and exit the least cost, and for each entry the order of the exits' letters."""
    costs, ranks = [], []
    for entry in range(STATES):
        log, best = forward(codes, entry)
        order: list[int] = []
        for state, (_, node) in best.items():
            at = 0
            while at < len(order) and log.before(best[order[at]][1], node):
                at += 1
            order.insert(at, state)
        costs += [best[s][0] if s in best else NEVER for s in range(STATES)]
        ranks += [order.index(s) if s in best else STATES for s in range(STATES)]
    return costs, ranks


def _via(a: tuple, b: tuple, entry: int, leave: int) -> int | None:
    """The state between two blocks on the best way: least cost, then least letters of the first block."""
    ways = [(a[0][entry * STATES + k] + b[0][k * STATES + leave], a[1][entry * STATES + k], k) for k in range(STATES)]
    cost, _, k = min(ways)
    return k if cost < NEVER else None


def joined(a: tuple, b: tuple) -> tuple[list[int], list[int]]:
    """The summary of two adjoining blocks. Letters of ways that differ in the first block differ inside of it."""
    costs, ranks = [], []
    for entry in range(STATES):
        via = [_via(a, b, entry, leave) for leave in range(STATES)]
        costs += [NEVER if k is None else a[0][entry * STATES + k] + b[0][k * STATES + leave] for leave, k in enumerate(via)]
        keys = sorted((a[1][entry * STATES + k], b[1][k * STATES + leave], leave) for leave, k in enumerate(via) if k is not None)
        place = {leave: i for i, (*_, leave) in enumerate(keys)}
        ranks += [place.get(leave, STATES) for leave in range(STATES)]
    return costs, ranks


def folded(parts: Sequence[tuple]) -> tuple[list[int], list[int]]:
    whole = parts[0]
    for part in parts[1:]:
        whole = joined(whole, part)
    return whole


def best_exit(whole: tuple, entry: int = START) -> tuple[int, int]:
    """Cost with the closing insertions, and the state before them."""
    ways = [(whole[0][entry * STATES + s] + INSERT_COST * len(CLOSING[s]), whole[1][entry * STATES + s], s) for s in range(STATES)]
    cost, _, state = min(ways)
    return cost, state


def route(parts: Sequence[tuple], entry: int, leave: int) -> list[tuple[int, int]]:
    """(entry, exit) of each of some adjoining blocks, given those of the whole."""
    heads = [parts[0]]
    for part in parts[1:-1]:
        heads.append(joined(heads[-1], part))
    ways, state = [], leave
    for i in range(len(parts) - 1, 0, -1):
        k = _via(heads[i - 1], parts[i], entry, state)
        ways.append((k, state))
        state = k
    ways.append((entry, state))
    return ways[::-1]


def letters_between(codes: Sequence[int], entry: int, leave: int) -> str:
    log, best = forward(codes, entry)
    return log.text(best[leave][1])
