"""The cheapest edits that give a conversation the order system?, (user, assistant)+.

A dynamic programme runs over the rows with four states: nothing yet, or the last row kept is of
the system, the user or the assistant. A state's edits so far are a node: its letter, its parent,
ancestors at powers of two and a rolling hash. Paths share their common beginning, so a
row costs a few nodes however long the paths are. Equal costs are decided by the first letter
that differs: a search over ancestors finds the longest common beginning by hash, and the letters
are read to be sure.

A run of rows is summed up as a :class:`Piece`, the cheapest path from each state to each. Pieces of
neighbouring runs join to the piece of both, so a long conversation needs no single fold.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
ENDS = (START, ASSISTANT)
#: The state after a user's or assistant's row that is inserted or given a new role.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The state after a row is kept, by its role's first letter; an empty role changes none.
KEPT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
KEPT |= {("", state): state for state in STATES}
LEGAL = ("su", "ua", "au")
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

_MODULUS = (1 << 61) - 1
_BASE = 0x1F3D5B79A2C4E681 % _MODULUS


class Node:
    """A path of edits: its last letter and all before it."""

    __slots__ = ("depth", "hash", "letter", "up")

    def __init__(self, parent: Node | None = None, letter: str = ""):
        self.letter = letter
        if parent is None:
            self.depth, self.hash, self.up = 0, 0, ()
            return
        self.depth = parent.depth + 1
        self.hash = (parent.hash * _BASE + ord(letter)) % _MODULUS
        up, at, k = [parent], parent, 0
        while len(at.up) > k:
            at = at.up[k]
            up.append(at)
            k += 1
        self.up = tuple(up)

    def at(self, depth: int) -> Node:
        """The ancestor of that depth."""
        node, rest = self, self.depth - depth
        while rest:
            k = rest.bit_length() - 1
            node = node.up[k]
            rest -= 1 << k
        return node

    def path(self) -> str:
        letters, node = [], self
        while node.depth:
            letters.append(node.letter)
            node = node.up[0]
        return "".join(reversed(letters))


def common(a: Node, b: Node) -> int:
    """Letters that two paths have in common from their start on."""
    depth = min(a.depth, b.depth)
    a, b = a.at(depth), b.at(depth)
    if a is b:
        return depth
    if a.hash == b.hash:
        return depth if _same(a, b) else _read(a, b)
    for k in range(len(a.up) - 1, -1, -1):
        if k < len(a.up) and a.up[k].hash != b.up[k].hash:
            a, b = a.up[k], b.up[k]
    return a.depth - 1 if _same(a.up[0], b.up[0]) else _read(a, b)


def _same(a: Node, b: Node) -> bool:
    """Whether two paths of one length are equal, read back to the node that they share."""
    while a is not b:
        if a.letter != b.letter or a.depth == 0:
            return a.depth == b.depth == 0
        a, b = a.up[0], b.up[0]
    return True


def _read(a: Node, b: Node) -> int:
    x, y = a.path(), b.path()
    return next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def before(a: Node, b: Node) -> bool:
    """Whether the path of ``a`` comes before that of ``b`` in ASCII order."""
    n = common(a, b)
    if n == b.depth:
        return False
    return n == a.depth or a.at(n + 1).letter < b.at(n + 1).letter


Best = dict[int, tuple[int, Node]]


def _offer(best: Best, state: int, cost: int, parent: Node, letter: str) -> bool:
    held = best.get(state)
    if held is None or cost < held[0]:
        best[state] = (cost, Node(parent, letter))
        return True
    if cost > held[0]:
        return False
    node = Node(parent, letter)
    if before(node, held[1]):
        best[state] = (cost, node)
        return True
    return False


def _insert(best: Best) -> None:
    """Rows inserted here: as many as make any state cheaper to reach."""
    changed = True
    while changed:
        changed = False
        for state in STATES:
            if state in best:
                cost, node = best[state]
                changed |= _offer(best, NEXT[state], cost + INSERT, node, "I")


def cheapest(rows: Iterable[tuple[str, bool, bool]], start: int = START) -> dict[int, tuple[int, str]]:
    """``state -> (cost, letters)`` after ``(first letter of the role, must go, truncated)`` rows."""
    best: Best = {start: (0, Node())}
    _insert(best)
    for initial, must_go, truncated in rows:
        after: Best = {}
        more = TRUNCATED if truncated else 0
        for state, (cost, node) in best.items():
            _offer(after, state, cost + DELETE, node, "D")
            if not must_go:
                kept = KEPT.get((initial, state))
                if kept is not None:
                    _offer(after, kept, cost + more, node, "K")
                _offer(after, NEXT[state], cost + REROLE + more, node, "R")
        _insert(after)
        best = after
    return {state: (cost, node.path()) for state, (cost, node) in best.items()}


@dataclass
class Piece:
    """What a run of a conversation's rows, in order, adds to it."""

    rows: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    first_turn: int | None = None
    last_turn: int | None = None
    first_role: str | None = None
    last_role: str | None = None
    #: ``(from, to) -> (cost, letters)``.
    paths: dict[tuple[int, int], tuple[int, str]] = field(default_factory=lambda: {(s, s): (0, "") for s in STATES})

    @classmethod
    def of(cls, rows: list[tuple[int | None, str, bool, bool, bool]], starts: Iterable[int] = STATES) -> Piece:
        """From ``(turn, first letter, blank, duplicate, truncated)``; one fault at most is true."""
        out = cls(rows=len(rows), paths={})
        for turn, initial, blank, duplicate, truncated in rows:
            out.blank += blank
            out.duplicate += duplicate
            out.truncated += truncated
            if out.last_role is not None:
                out.illegal += out.last_role + initial not in LEGAL
            else:
                out.first_role = initial
            out.last_role = initial
            if turn is not None:
                out.turns += out.last_turn is None or turn != out.last_turn
                out.first_turn = turn if out.first_turn is None else out.first_turn
                out.last_turn = turn
        steps = [(initial, blank or duplicate, truncated) for _, initial, blank, duplicate, truncated in rows]
        for start in starts:
            out.paths |= {(start, end): found for end, found in cheapest(steps, start).items()}
        return out

    def joined(self, after: Piece) -> Piece:
        """The piece of both runs."""
        out = Piece(
            self.rows + after.rows,
            self.blank + after.blank,
            self.duplicate + after.duplicate,
            self.truncated + after.truncated,
            self.illegal + after.illegal,
            self.turns + after.turns,
            after.first_turn if self.first_turn is None else self.first_turn,
            self.last_turn if after.last_turn is None else after.last_turn,
            after.first_role if self.first_role is None else self.first_role,
            self.last_role if after.last_role is None else after.last_role,
            {},
        )
        if self.last_role is not None and after.first_role is not None:
            out.illegal += self.last_role + after.first_role not in LEGAL
        if self.last_turn is not None and self.last_turn == after.first_turn:
            out.turns -= 1
        for (start, middle), (cost, letters) in self.paths.items():
            for (again, end), (more, rest) in after.paths.items():
                if again == middle:
                    found = (cost + more, letters + rest)
                    held = out.paths.get((start, end))
                    if held is None or found < held:
                        out.paths[start, end] = found
        return out

    def repair(self) -> tuple[int, str]:
        """``(cost, letters)`` of the cheapest edits, the least in ASCII order among equals."""
        return min(self.paths[START, end] for end in ENDS if (START, end) in self.paths)

    @property
    def gaps(self) -> int:
        return 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns


class Repair:
    """Applies letters to rows: the repaired lines come out as they are known."""

    def __init__(self, letters: str):
        self.letters, self.at, self.state = letters, 0, START

    def _inserted(self) -> Iterator[str]:
        while self.letters[self.at : self.at + 1] == "I":
            self.at += 1
            self.state = NEXT[self.state]
            yield f"{ROLES[self.state]}:"

    def row(self, role: str, text: str) -> Iterator[str]:
        yield from self._inserted()
        letter = self.letters[self.at]
        self.at += 1
        if letter == "K":
            self.state = KEPT[role[:1], self.state]
            yield f"{role}:{text}"
        elif letter == "R":
            self.state = NEXT[self.state]
            yield f"{ROLES[self.state]}:{text}"

    def end(self) -> Iterator[str]:
        yield from self._inserted()
