"""A generalised LL recogniser over regular right-hand sides, with a graph-structured stack.

Every rule is compiled to a deterministic automaton whose edges are terminals, rules and zero-width
conditions on the next token.  A descriptor is (automaton state, stack node, position); stack nodes
are shared per (rule, position), so ambiguous and left-recursive grammars take polynomial time and
plain ones run in a tight loop: as long as one descriptor is alone, nobody can share its stack nodes,
so its calls are plain pairs, and all that a state does on a token up to the next shift is looked up
at once.  Several start rules (dialects) run together over one shared stack.
"""

from __future__ import annotations

import re
from collections import deque

EOF = "EOF"
SHIFT, CALL, POP, JUMP, MANY = range(5)


class _Node:
    __slots__ = ("edges", "pops", "root")

    def __init__(self, root: bool = False):
        self.edges: dict = {}
        self.pops: list[int] = []
        self.root = root

    @classmethod
    def around(cls, pair: tuple) -> _Node:
        """A node that descriptors can share, in place of a lone one's pair."""
        node = cls()
        node.edges[pair] = None
        return node


class Grammar:
    """``rules``: ``Name = expression ;`` with ``'terminal'``, ``|``, ``? * +``, groups.

    ``!('a' 'b')`` holds where the next token is none of those; ``BREAK`` is an automatic
    semicolon: it holds before a token on a new line, before ``}`` and at the end.  Names without
    a rule are terminals.  Token numbers are ``2 * kind + (1 if a line end comes before)``.
    """

    lexer = re.compile(r"\s*(?:#[^\n]*\n\s*)*(?:'((?:[^'\\]|\\.)+)'|([A-Za-z_]\w*)|([=|?*+();!]))")

    def __init__(self, rules: str, starts: tuple[str, ...]):
        self.kinds: dict[str, int] = {EOF: 0}
        self._parse(rules)
        self._automata()
        self._tables()
        self.starts = [self.names.index(s) for s in starts]

    # ---- reading the notation into NFAs

    def _parse(self, text: str) -> None:
        toks, pos = [], 0
        text = text.rstrip()
        while pos < len(text):
            m = self.lexer.match(text, pos)
            if not m:
                raise ValueError(f"grammar: {text[pos : pos + 40]!r}")
            toks.append(("lit", m[1]) if m[1] else ("name", m[2]) if m[2] else ("op", m[3]))
            pos = m.end()
        self.names = [toks[i][1] for i in range(len(toks) - 1) if toks[i][0] == "name" and toks[i + 1] == ("op", "=")]
        index = {n: i for i, n in enumerate(self.names)}
        self.nfa: list[dict] = []
        self._edges: list[list[tuple]] = []

        def new() -> int:
            self._edges.append([])
            return len(self._edges) - 1

        p = 0

        def alternatives(a: int, b: int) -> None:
            nonlocal p
            while True:
                sequence(a, b)
                if toks[p] != ("op", "|"):
                    return
                p += 1

        def sequence(a: int, b: int) -> None:
            nonlocal p
            cur = a
            while toks[p] not in (("op", "|"), ("op", ")"), ("op", ";")):
                start, end = new(), new()
                self._edges[cur].append((None, start))
                item(start, end)
                while toks[p] in (("op", "?"), ("op", "*"), ("op", "+")):
                    op = toks[p][1]
                    p += 1
                    if op in "?*":
                        self._edges[start].append((None, end))
                    if op in "*+":
                        self._edges[end].append((None, start))
                    wrap, out = new(), new()
                    self._edges[wrap].append((None, start))
                    self._edges[end].append((None, out))
                    self._edges[cur][-1] = (None, wrap)
                    start, end = wrap, out
                cur = end
            self._edges[cur].append((None, b))

        def item(a: int, b: int) -> None:
            nonlocal p
            kind, value = toks[p]
            p += 1
            if kind == "lit" or kind == "name" and value not in index and value != "BREAK":
                value = value.replace("\\'", "'").replace("\\\\", "\\")
                self._edges[a].append((("t", self.kinds.setdefault(value, len(self.kinds))), b))
            elif value == "BREAK":
                self._edges[a].append((("break",), b))
            elif kind == "name":
                self._edges[a].append((("n", index[value]), b))
            elif value == "(":
                alternatives(a, b)
                p += 1
            elif value == "!":
                p += 1
                banned = []
                while toks[p] != ("op", ")"):
                    banned.append(self.kinds.setdefault(toks[p][1], len(self.kinds)))
                    p += 1
                p += 1
                self._edges[a].append((("not", tuple(sorted(banned))), b))
            else:
                raise ValueError(f"grammar: unexpected {value}")

        self._ends = []
        while p < len(toks):
            p += 2
            a, b = new(), new()
            self._ends.append((a, b))
            alternatives(a, b)
            p += 1

    # ---- subset construction, one automaton per rule in a common numbering

    def _automata(self) -> None:
        def closure(states: frozenset[int]) -> frozenset[int]:
            out, stack = set(states), list(states)
            while stack:
                for label, to in self._edges[stack.pop()]:
                    if label is None and to not in out:
                        out.add(to)
                        stack.append(to)
            return frozenset(out)

        self.delta: list[dict] = []
        self.final: list[bool] = []
        self.owner: list[int] = []
        self.entry: list[int] = []
        for rule, (a, b) in enumerate(self._ends):
            known: dict[frozenset[int], int] = {}

            def state(s: frozenset[int]) -> int:
                if s not in known:
                    known[s] = len(self.delta)
                    self.delta.append({})
                    self.final.append(b in s)
                    self.owner.append(rule)
                    todo.append(s)
                return known[s]

            todo: list = []
            self.entry.append(state(closure(frozenset([a]))))
            while todo:
                s = todo.pop()
                moves: dict = {}
                for x in s:
                    for label, to in self._edges[x]:
                        if label is not None:
                            moves.setdefault(label, set()).add(to)
                for label, tos in moves.items():
                    self.delta[known[s]][label] = state(closure(frozenset(tos)))
        del self._edges

    # ---- FIRST and FOLLOW as bit masks, then an action per (state, token)

    def _mask(self, label: tuple) -> int:
        every = (1 << (2 * len(self.kinds))) - 1
        if label[0] == "break":
            mask = sum(2 << (2 * k) for k in range(len(self.kinds)))
            for name in ("}", EOF):
                if name in self.kinds:
                    mask |= 3 << (2 * self.kinds[name])
            return mask
        for k in label[1]:
            every &= ~(3 << (2 * k))
        return every

    def _tables(self) -> None:
        n, size = len(self.delta), 2 * len(self.kinds)
        first, null = [0] * n, list(self.final)
        moved = True
        while moved:
            moved = False
            for s in range(n):
                f, e = first[s], null[s]
                for label, to in self.delta[s].items():
                    if label[0] == "t":
                        f |= 3 << (2 * label[1])
                    elif label[0] == "n":
                        f |= first[self.entry[label[1]]]
                        if null[self.entry[label[1]]]:
                            f |= first[to]
                            e = e or null[to]
                    else:
                        f |= first[to] & self._mask(label)
                        e = e or null[to]
                if (f, e) != (first[s], null[s]):
                    first[s], null[s], moved = f, e, True
        follow = [0] * len(self.names)
        for r in range(len(self.names)):
            follow[r] = 0
        moved = True
        while moved:
            moved = False
            for s in range(n):
                for label, to in self.delta[s].items():
                    if label[0] == "n":
                        f = follow[label[1]] | first[to] | (follow[self.owner[s]] if null[to] else 0)
                        if f != follow[label[1]]:
                            follow[label[1]], moved = f, True
        self.acts: list[list] = []
        for s in range(n):
            row: list = [None] * size
            for t in range(size):
                bit, found = 1 << t, []
                for label, to in self.delta[s].items():
                    if label[0] == "t":
                        if label[1] == t >> 1:
                            found.append((SHIFT, to))
                    elif label[0] == "n":
                        e = self.entry[label[1]]
                        if first[e] & bit or null[e] and (first[to] & bit or null[to]):
                            found.append((CALL, label[1], to))
                    elif self._mask(label) & bit and (first[to] & bit or null[to]):
                        found.append((JUMP, to))
                if self.final[s] and (follow[self.owner[s]] & bit or not follow[self.owner[s]]):
                    found.append((POP,))
                row[t] = found[0] if len(found) == 1 else (MANY, tuple(found)) if found else None
            self.acts.append(row)
        self.lone: list[list] = [[False] * size for _ in range(n)]

    # ---- the recogniser

    def _lone(self, s: int, t: int) -> tuple | None:
        """What a lone descriptor in a state does on a token: (kind, return states it pushes, next state)."""
        pushed: list[int] = []
        first = s
        for _ in range(10 * len(self.names)):
            act = self.acts[s][t]
            if act is None:
                return None
            kind = act[0]
            if kind == SHIFT:
                return SHIFT, tuple(pushed), act[1]
            if kind == CALL:
                pushed.append(act[2])
                s = self.entry[act[1]]
            elif kind == JUMP:
                s = act[1]
            elif kind == POP and pushed:
                s = pushed.pop()
            elif kind == POP and s == first:
                return POP, (), s
            else:
                break
        return MANY, (), first

    def accepts(self, toks: list[int]) -> bool:
        """Whether any start rule derives the whole list, which must end with the number of EOF."""
        acts, entry, width, lone = self.acts, self.entry, len(self.names), self.lone
        stack: dict[int, _Node] = {}
        work: deque = deque()
        last = len(toks)
        for rule in self.starts:
            node = stack[rule] = _Node(True)
            work.append((entry[rule], node, 0, None))
        while work:
            s, node, i, act = work.pop()
            while True:
                if act is None:
                    if not work:  # alone: stack nodes are pairs (return state, node below)
                        while i < last:
                            row = lone[s]
                            t = toks[i]
                            step = row[t]
                            if step is False:
                                step = row[t] = self._lone(s, t)
                            if step is None:
                                break
                            kind = step[0]
                            if kind == SHIFT:
                                for back in step[1]:
                                    node = (back, node)
                                s = step[2]
                                i += 1
                            elif kind == POP and type(node) is tuple:
                                s, node = node
                            else:  # calls on the way to a fork are shared, or nullable rules would never end
                                break
                        else:
                            if type(node) is not tuple and node.root and self.final[s]:
                                return True
                            break
                        if step is None:
                            break
                    elif i >= last:
                        if type(node) is not tuple and node.root and self.final[s]:
                            return True
                        break
                    act = acts[s][toks[i]]
                    if act is None:
                        break
                if type(node) is tuple:
                    node = _Node.around(node)
                kind = act[0]
                if kind == SHIFT:
                    s = act[1]
                    i += 1
                elif kind == CALL:
                    key = i * width + act[1]
                    child = stack.get(key)
                    if child is None:
                        child = stack[key] = _Node()
                        child.edges[act[2], node] = None
                        # those that wait may call it too, and then it goes on alone
                        work.appendleft((entry[act[1]], child, i, None))
                    else:
                        edge = (act[2], node)
                        if edge not in child.edges:
                            child.edges[edge] = None
                            for p in child.pops:
                                work.append((act[2], node, p, None))
                    break
                elif kind == POP:
                    if i in node.pops:
                        break
                    node.pops.append(i)
                    edges = node.edges
                    if len(edges) == 1:
                        ((s, up),) = edges
                        if type(up) is tuple:
                            up = _Node.around(up)
                            node.edges = {(s, up): None}
                        node = up
                    else:
                        for s, up in edges:
                            work.append((s, up, i, None))
                        break
                elif kind == JUMP:
                    s = act[1]
                else:
                    for a in act[1]:
                        work.append((s, node, i, a))
                    break
                act = None
        return False
