"""Feature rewriting and feature templates."""

from __future__ import annotations

import re

from ..errors import InvalidArgument, InvalidFormat


class Rewriter:
    """Rules in a tree over cells; the first match in the order of the tree's branches rewrites."""

    def __init__(self, rules: list[tuple[list[str], list[str]]]):
        self.root: list = []
        for pattern, rewrite in rules:
            level = self.root
            for cell in pattern:
                test = "*" if cell == "*" else frozenset(cell[1:-1].split("|")) if cell.startswith("(") and cell.endswith(")") else cell
                branch = next((b for b in level if b[0] == "go" and b[1] == test), None)
                if branch is None:
                    branch = ("go", test, [])
                    level.append(branch)
                level = branch[2]
            for cell in rewrite:
                if cell == "$0":
                    raise InvalidArgument("$0 refers to no cell")
            level.append(("end", list(rewrite)))

    def __call__(self, cells: list[str]) -> list[str] | None:
        """The rewritten cells, or None where no rule matches; a pattern may be shorter than the cells."""
        found = self._walk(self.root, cells, 0)
        if found is None:
            return None
        value = lambda n: cells[n - 1] if n <= len(cells) else "*"
        return [value(int(c[1:])) if re.fullmatch(r"\$\d+", c) else c for c in found]

    def _walk(self, level, cells, at):
        for branch in level:
            if branch[0] == "end":
                return branch[1]
            if at < len(cells) and (branch[1] == "*" or (cells[at] in branch[1] if isinstance(branch[1], frozenset) else cells[at] == branch[1])):
                found = self._walk(branch[2], cells, at + 1)
                if found is not None:
                    return found
        return None


_SLOT = re.compile(r"%([FLR])(\??)\[(\d+)\]|%t")


class Template:
    """Text with slots: %F[n], %L[n], %R[n] take a cell (a question mark: the cell must be there and not ``*``), %t the category id."""

    def __init__(self, text: str, kind: str):
        self.parts, last = [], 0
        for m in _SLOT.finditer(text):
            self.parts.append(text[last : m.start()])
            if m[0] == "%t":
                if kind != "F":
                    raise InvalidFormat("%t belongs to unigram templates")
                self.parts.append(None)
            elif m[1] != kind:
                raise InvalidFormat(f"%{m[1]} in a {kind} template")
            else:
                self.parts.append((int(m[3]), bool(m[2])))
            last = m.end()
        self.parts.append(text[last:])

    def __call__(self, cells: list[str], category: int | None = None) -> str | None:
        out = []
        for p in self.parts:
            if p is None:
                out.append(str(category))
            elif isinstance(p, str):
                out.append(p)
            else:
                cell = cells[p[0]] if p[0] < len(cells) else "*"
                if p[1] and cell == "*":
                    return None
                out.append(cell)
        return "".join(out)
