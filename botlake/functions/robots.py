"""Robots rules of a site as one trie."""

from __future__ import annotations

STAR = None  # the edge to a state that stays on any character


class SiteRules:
    """The rules (position, allow, path) of one site. A path is walked once; of the rules that fit, the longest decides, the first of equals.

    States are the rules' common beginnings. `*` leads to a state that stays on any character; a rule without a final `$` fits as soon as
    its state is reached, one with it if that is so at the path's end.
    """

    def __init__(self, rules: list[tuple[int, bool, str]]):
        self.edges: list[dict[str | None, int]] = [{}]
        self.stays = [False]
        self.open: list[tuple[int, int, bool] | None] = [None]
        self.final: list[tuple[int, int, bool] | None] = [None]
        for position, allow, path in rules:
            at = 0
            for c in path.removesuffix("$"):
                at = self._to(at, STAR if c == "*" else c)
            fits = self.final if path.endswith("$") else self.open
            fits[at] = max(filter(None, (fits[at], (len(path), -position, allow))))

    def _to(self, at: int, edge: str | None) -> int:
        if edge not in self.edges[at]:
            self.edges[at][edge] = len(self.edges)
            self.edges.append({})
            self.stays.append(edge is STAR)
            self.open.append(None)
            self.final.append(None)
        return self.edges[at][edge]

    def _with_stars(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            star = self.edges[todo.pop()].get(STAR)
            if star is not None and star not in states:
                states.add(star)
                todo.append(star)
        return states

    def allowed(self, path: str) -> bool:
        live = self._with_stars({0})
        best = max((self.open[s] for s in live if self.open[s]), default=None)
        for c in path:
            live = self._with_stars({s for s in live if self.stays[s]} | {self.edges[s][c] for s in live if c in self.edges[s]})
            if not live:
                break
            best = max((x for x in (best, *(self.open[s] for s in live)) if x), default=None)
        best = max((x for x in (best, *(self.final[s] for s in live)) if x), default=None)
        return best[2] if best else True
