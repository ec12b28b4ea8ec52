"""A small evaluator over Python sets, to compare random formulas with."""

from tintwalk import formula as f


def holds(along: f.Direction, name, facet) -> bool:
    match along.kind:
        case "any":
            return True
        case "loop":
            return False
        case "step":
            return along.parts == (name, facet)
        case "not":
            return not holds(along.parts[0], name, facet)
        case "and":
            return all(holds(p, name, facet) for p in along.parts)
    return any(holds(p, name, facet) for p in along.parts)


FLIP = {"+": "-", "-": "+"}


class Graph:
    def __init__(self, n, colours, edges, atoms):
        self.n, self.colours, self.edges, self.atoms = n, colours, edges, atoms

    def out(self, past):
        """(state, colour) to the edges that lead from it: (to, name, facet)."""
        found = {}
        for a, b, name, facet, c in self.edges:
            a, b, facet = (b, a, FLIP.get(facet, facet)) if past else (a, b, facet)
            found.setdefault((a, c), set()).add((b, name, facet))
        return found

    def space(self):
        return {(s, c) for s in range(self.n) for c in range(self.colours)}

    def sat(self, q: f.Formula, env=()) -> set:
        env = dict(env)
        sub = lambda part, /, **more: self.sat(part, tuple({**env, **more}.items()))
        match q:
            case f.Truth(value):
                return self.space() if value else set()
            case f.Atom(name):
                return {(s, c) for a, s, c in self.atoms if a == name}
            case f.Var(name):
                k = env.get(name, name)
                return {(s, c) for s, c in self.space() if s == k}
            case f.Step(along, incoming):
                return {((b if incoming else a), c) for a, b, name, facet, c in self.edges if holds(along, name, facet)}
            case f.Not(a):
                return self.space() - sub(a)
            case f.And(a, b):
                return sub(a) & sub(b)
            case f.Or(a, b):
                return sub(a) | sub(b)
            case f.Iff(a, b):
                return self.space() - (sub(a) ^ sub(b))
            case f.Bind(name, a):
                return {(s, c) for k in range(self.n) for s, c in sub(a, **{name: k}) if s == k}
            case f.At(name, a):
                k = env.get(name, name)
                return {(s, c) for j, c in sub(a) if j == k for s in range(self.n)}
            case f.Exists(name, bound, a):
                limits = sub(bound)
                return {(s, c) for k in range(self.n) for s, c in sub(a, **{name: k}) if (k, c) in limits}
            case f.Next(every, past, a, along):
                inner, out = sub(a), self.out(past)
                good = lambda e, c: holds(along, e[1], e[2]) and (e[0], c) in inner
                return {(s, c) for (s, c), es in out.items() if (all if every else any)(good(e, c) for e in es)}
            case f.Until(every, past, path, goal, along, weak):
                now, keep, out = sub(goal), sub(path), self.out(past)
                if weak and every:
                    now |= {(s, c) for s, c in self.space() if not any(holds(along, e[1], e[2]) for e in out.get((s, c), ()))}
                elif weak:
                    now |= {k for k, es in out.items() if not all(holds(along, e[1], e[2]) for e in es)}
                while True:
                    more = {k for k, es in out.items() if k in keep and (all if every else any)(holds(along, e[1], e[2]) and (e[0], k[1]) in now for e in es)}
                    if more <= now:
                        return now
                    now |= more
        raise ValueError(q)
