"""Patterns of parsed sentences over arrays: a batch of sentences at a time, heads as indices, so that a sentence's rows never leave its row of the table.

Time and memory go with the tokens of a batch and the pairs that come out of it; expansions over coordinations are made in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from loomgraph.plans import rules

RELATIVE = ("who", "which", "that")
TOKENS = "array<struct<i:int,text:string,lemma:string,pos:string,dep:string,head_i:int>>"
MENTIONS = "array<struct<ord:int,text:string,type:string,start:int,end:int,first_i:int,last_i:int,root_i:int>>"
MENTION_NAMES = ("ord", "text", "type", "start", "end", "first_i", "last_i", "root_i")
#: Tokens and mentions of a piece of a batch, rows of a block of expansions, rows of a batch that goes out.
PIECE, BLOCK, OUT = 1 << 17, 1 << 20, 1 << 16

BASES = ("P1_SVO", "P2_pred_prep", "P2_pred_prep+conj", "P3_copular_prep", "P4_of_cop_attr", "P4_poss_cop_attr", "P5_appos", "P5_appos_rev", "P6_noun_of_cop_subj", "P6_noun_of_poss")
HEAD_CONJ, TAIL_CONJ = "+P8_head_conj", "+P8_tail_conj"
#: All patterns in the order of their names, which orders rows of one place.
PATTERNS = sorted([b + x for b in BASES for x in ("", HEAD_CONJ, TAIL_CONJ)] + [rules.FALLBACK, f"{rules.FALLBACK}_rev"])
WIDTH = 9


def _ints(a: pa.Array) -> np.ndarray:
    return pc.fill_null(a, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _is(a: pa.Array, *values: str) -> np.ndarray:
    return pc.is_in(a, value_set=pa.array(values, pa.string())).to_numpy(zero_copy_only=False)


def _valid(a: pa.Array) -> np.ndarray:
    return a.is_valid().to_numpy(zero_copy_only=False)


def _codes(a: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each value, -1 for null, and the values by number."""
    d = a.dictionary_encode()
    return pc.fill_null(d.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def _fields(a: pa.ListArray) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """The row of each element, and the elements' fields."""
    n = pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False)
    flat = a.flatten()
    return np.repeat(np.arange(len(a)), n), dict(zip((f.name for f in flat.type), flat.flatten(), strict=True))


def spread(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of n places from start on for each row."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + start[row]


def meet(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of equal values, by place in a, then in b."""
    order = np.argsort(b, kind="stable")
    s = b[order]
    lo = np.searchsorted(s, a, "left")
    row, place = spread(lo, np.searchsorted(s, a, "right") - lo)
    return row, order[place]


def _places(sent: np.ndarray) -> np.ndarray:
    """The place of each row within its sentence, of rows in the order of sentences."""
    first = np.r_[True, sent[1:] != sent[:-1]][: len(sent)]
    at = np.arange(len(sent))
    return at - np.maximum.accumulate(np.where(first, at, 0))


class Sentences:
    """Tokens by (sentence, i) and mentions of the sentences of a batch. i is told once a sentence."""

    def __init__(self, ts: pa.ListArray, ms: pa.ListArray):
        sent, t = _fields(ts)
        i, head = _ints(t["i"]), _ints(pc.coalesce(t["head_i"], t["i"]))
        order = np.lexsort((i, sent))
        order = order[_valid(t["i"])[order]]
        take = pa.array(order)
        self.sent, self.i, self.text, self.lemma = sent[order], i[order], t["text"].take(take), t["lemma"].take(take)
        self.pos, self.dep, head = t["pos"].take(take), t["dep"].take(take), head[order]
        self.m_sent, self.m = _fields(ms)
        self.n = len(order)
        self.low = min(0, self.i.min(initial=0), head.min(initial=0))
        self.span = max(self.i.max(initial=0), head.max(initial=0)) - self.low + 1
        self.key, self.head_key = self.at(self.sent, self.i), self.at(self.sent, head)
        #: The head of each token, itself at a root, -1 where there is no such token.
        self.head = self.find(self.head_key)
        self.child = head != self.i
        self.most = int(np.bincount(self.sent).max()) if self.n else 0

    def at(self, sent: np.ndarray, i: np.ndarray) -> np.ndarray:
        return sent * self.span + (i - self.low)

    def find(self, key: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), self.n - 1)
        return np.where(self.key[at] == key, at, -1)

    def kids(self, *deps: str) -> np.ndarray:
        """Children with one of the relations, whose heads are there, in order."""
        return np.flatnonzero(_is(self.dep, *deps) & self.child & (self.head >= 0))

    def last(self, *deps: str, first: bool = False) -> np.ndarray:
        """For each token its last child with one of the relations (or its first), or -1."""
        k, out = self.kids(*deps), np.full(self.n, -1)
        k = k[::-1] if first else k
        out[self.head[k]] = k  # of equal places the last one written stays
        return out

    def objects(self, *deps: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(head, preposition, object) tokens, in order."""
        prep = np.zeros(self.n, bool)
        prep[self.kids(*deps)] = True
        o = self.kids("pobj")
        o = o[prep[self.head[o]]]
        p = self.head[o]
        v = self.head[p]
        order = np.lexsort((o, p, v))
        return v[order], p[order], o[order]

    def covers(self, both_ways: bool) -> np.ndarray:
        """The mention of each token, of several the last, or -1. both_ways: a mention may name its last token first."""
        m = self.m
        ok = _valid(m["first_i"]) & _valid(m["last_i"])
        a, b = _ints(m["first_i"]), _ints(m["last_i"])
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        ok &= both_ways | (a <= b)
        lo, hi = np.maximum(lo, self.low), np.minimum(hi, self.low + self.span - 1)  # there are no tokens beyond
        which = np.flatnonzero(ok & (lo <= hi))
        which = which[np.argsort(_ints(m["ord"])[which], kind="stable")]
        row, i = spread(lo[which], (hi - lo + 1)[which])
        t = self.find(self.at(self.m_sent[which][row], i))
        out = np.full(self.n, -1)
        out[t[t >= 0]] = which[row][t >= 0]
        return out

    def tops(self) -> np.ndarray:
        """The key of the head of each token's coordination, by pointer doubling."""
        top = np.where(_is(self.dep, "conj") & self.child, self.head_key, self.key)
        steps = 1
        while True:
            at = self.find(top)
            far = np.where(at >= 0, top[at], top) if self.n else top
            if (far == top).all():
                return top
            if ((far == self.key) & (top != self.key)).any() or steps > self.most:
                raise ValueError("heads of a sentence form a cycle")
            top, steps = far, steps * 2

    def firsts(self, named: np.ndarray) -> np.ndarray:
        """For each token the first named one of its subtree, itself included, or -1: minima move up by doubled steps."""
        best = np.where(named, np.arange(self.n), self.n)
        up = np.where(self.child, self.head, -1)
        steps = 1
        while (move := np.flatnonzero(up >= 0)).size:
            if steps > self.most:
                raise ValueError("heads of a sentence form a cycle")
            own = best[move]
            np.minimum.at(best, up[move], own)
            up[move] = up[up[move]]
            steps *= 2
        return np.where(best < self.n, best, -1)


# ---- triples ----


class Names:
    """What tokens are called: the text of the mention that covers them, or their own."""

    def __init__(self, s: Sentences):
        self.s = s
        ent = s.covers(False)
        text = s.m["text"].cast(pa.string())
        told = np.zeros(s.n, bool)
        told[ent >= 0] = _valid(text)[ent[ent >= 0]]
        both = pa.chunked_array([s.text, text], pa.string()).combine_chunks()
        self.names = both.take(pa.array(np.where(told, ent + s.n, np.arange(s.n))))
        self.some = pc.fill_null(pc.greater(pc.binary_length(self.names), 0), False).to_numpy(zero_copy_only=False)
        code, lemmas = _codes(s.lemma)
        low = [x if x is None else x.lower() for x in lemmas.to_pylist()]
        self.code, self.by = code, np.array([x == "by" for x in low] + [False])[code]
        self.preps = pa.array([rules.PREPOSITIONS.get(x, x) for x in low] + [None], pa.string())

    def rows(self, parts: list[tuple]) -> tuple[np.ndarray, list[pa.Array]]:
        """(verb, phase, seq, subject, preposition or -1, object, pattern) parts as rows in order: the sentence of each, and its columns."""
        phase, v, step, seq, subject, prep, obj, kind = (np.concatenate(x) for x in zip(*((np.full(len(p["v"]), p["phase"]), p["v"], np.full(len(p["v"]), p["step"]), np.arange(len(p["v"])), p["subject"], p.get("prep", np.full(len(p["v"]), -1)), p["object"], np.full(len(p["v"]), k)) for k, p in enumerate(parts)), strict=True))
        if not len(v):
            return v, _none()
        sent = self.s.sent[v]
        order = np.lexsort((seq, step, v, phase, sent))
        sent, v, subject, prep, obj, kind = (x[order] for x in (sent, v, subject, prep, obj, kind))
        lemma = self.s.lemma.take(pa.array(v))
        prep_text = self.preps.take(pa.array(np.where(prep >= 0, self.code[prep], -1) % len(self.preps)))
        joined = pc.coalesce(pc.binary_join_element_wise(lemma, prep_text, "_"), lemma, prep_text, "")
        relation = pc.if_else(pa.array(prep >= 0), joined, lemma)
        names = pa.array([p["pattern"] for p in parts], pa.string())
        return sent, [self.names.take(pa.array(subject)), relation, self.names.take(pa.array(obj)), names.take(pa.array(kind)), pa.array(_places(sent), pa.int32())]


def simple(s: Sentences) -> tuple[np.ndarray, list[pa.Array]]:
    n = Names(s)

    def named(k: np.ndarray) -> np.ndarray:
        return (k >= 0) & n.some[k]

    if not s.n:
        return s.sent, _none()
    verb, adj = _is(s.pos, "VERB"), _is(s.pos, "ADJ")
    subj, obj, passive = s.last("nsubj"), s.last("dobj"), s.last("nsubjpass")
    active = np.flatnonzero(verb & named(subj) & named(obj))
    v, p, o = s.objects("prep")
    b, c = (verb & named(passive))[v], ((verb | adj) & named(subj))[v]
    return n.rows([
        {"phase": 0, "step": 0, "pattern": "A_active_SVO", "v": active, "subject": subj[active], "object": obj[active]},
        {"phase": 0, "step": 1, "pattern": "B_passive_prep", "v": v[b], "subject": passive[v[b]], "prep": p[b], "object": o[b]},
        {"phase": 1, "step": 0, "pattern": "C_predicate_prep", "v": v[c], "subject": subj[v[c]], "prep": p[c], "object": o[c]},
    ])


def coordinated(s: Sentences) -> tuple[np.ndarray, list[pa.Array]]:
    n = Names(s)
    if not s.n:
        return s.sent, _none()
    conj = s.kids("conj")
    code = _codes(n.names)[0]
    verb = np.flatnonzero(_is(s.pos, "VERB"))

    def members(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, token) of each first token and its direct coordinates."""
        row, k = meet(first, s.head[conj])
        row, token = np.r_[np.arange(len(first)), row], np.r_[first, conj[k]]
        order = np.argsort(row, kind="stable")
        return row[order], token[order]

    def distinct(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(verb, token) of the different names of each verb's group."""
        have = verb[first[verb] >= 0]
        row, token = members(first[have])
        keep = np.sort(np.unique(row * (code.max(initial=0) + 2) + code[token] + 1, return_index=True)[1])
        return have[row[keep]], token[keep]

    head = s.last("nsubj", "nsubjpass", first=True)
    sv, st = distinct(head)
    ov, ot = distinct(s.last("dobj", first=True))
    v, p, o = s.objects("prep")
    is_verb = np.zeros(s.n, bool)
    is_verb[verb] = True
    v, p, o = (x[is_verb[v]] for x in (v, p, o))
    row, pt = members(o)
    pv, pp = v[row], p[row]
    is_active, is_passive = _is(s.dep, "nsubj")[head], _is(s.dep, "nsubjpass")[head]
    a, b = sv[is_active[sv]], st[is_active[sv]]
    i, j = meet(a, ov)
    by = np.flatnonzero(n.by[pp] & is_passive[pv])
    k, m = meet(pv[by], sv)
    x, y = meet(sv, pv)
    return n.rows([
        {"phase": 0, "step": 0, "pattern": "A_active_SVO", "v": a[i], "subject": b[i], "object": ot[j]},
        {"phase": 0, "step": 1, "pattern": "A_passive_by", "v": pv[by][k], "subject": pt[by][k], "object": st[m]},
        {"phase": 0, "step": 2, "pattern": "B_predicate_prep", "v": sv[x], "subject": st[x], "prep": pp[y], "object": pt[y]},
    ])


def _none() -> list[pa.Array]:
    return [pa.array([], pa.string())] * 4 + [pa.array([], pa.int32())]


# ---- candidate pairs ----


class Pairs:
    """Pairs of mentions with a pattern and the numbers that order them."""

    def __init__(self, h: np.ndarray, t: np.ndarray, pattern: np.ndarray, o: np.ndarray):
        self.h, self.t, self.pattern, self.o = h, t, pattern, o

    @staticmethod
    def of(h: np.ndarray, t: np.ndarray, pattern: str, rank: int, *order: np.ndarray) -> Pairs:
        o = np.zeros((len(h), WIDTH), np.int64)
        o[:, 0] = rank
        for k, x in enumerate(order):
            o[:, k + 1] = x
        return Pairs(h, t, np.full(len(h), PATTERNS.index(pattern)), o)

    @staticmethod
    def all(parts: list[Pairs]) -> Pairs:
        return Pairs(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("h", "t", "pattern", "o")))

    def __getitem__(self, k) -> Pairs:
        return Pairs(self.h[k], self.t[k], self.pattern[k], self.o[k])

    def first(self, span: np.ndarray) -> Pairs:
        """The first pair of each (head span, tail span, pattern)."""
        if not len(self.h):
            return self
        a, b = span[self.h], span[self.t]
        used = [c for c in range(WIDTH - 1, -1, -1) if self.o[:, c].any()]
        order = np.lexsort((*(self.o[:, c] for c in used), self.pattern, b, a))
        key = np.stack([a, b, self.pattern])[:, order]
        return self[order[np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)]]]


def _blocks(n: np.ndarray) -> Iterator[slice]:
    """Slices of rows whose numbers add up to BLOCK at most, or of one row."""
    total, start = np.cumsum(n), 0
    while start < len(n):
        before = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + BLOCK, "right")))
        yield slice(start, end)
        start = end


def _spans(s: Sentences) -> tuple[np.ndarray, ...]:
    """Of each mention: a number for its text (-1: null), whether it has one that isn't empty, a number for its span in its sentence, and whether that has both ends."""
    m = s.m
    text, some = _codes(m["text"])[0], pc.fill_null(pc.greater(pc.binary_length(m["text"]), 0), False).to_numpy(zero_copy_only=False)
    ends = (_ints(m["end"]), _ints(m["start"]), _valid(m["end"]), _valid(m["start"]), s.m_sent)
    order = np.lexsort(ends)
    span = np.zeros(len(order), np.int64)
    span[order[1:]] = np.cumsum(np.any([x[order[1:]] != x[order[:-1]] for x in ends], axis=0))
    return text, some, span, ends[2] & ends[3]


def _near(s: Sentences, text: np.ndarray, window: int, distance: int) -> Pairs:
    """Mentions of different texts at most `window` places and `distance` roots apart, both ways."""
    m = s.m
    a = np.flatnonzero((text >= 0) & _valid(m["ord"]) & _valid(m["root_i"]))
    ord_, root = _ints(m["ord"]), _ints(m["root_i"])
    least = ord_.min(initial=0)
    key = s.m_sent * (ord_.max(initial=0) - least + window + 2) + ord_ - least
    x, y = meet((key[a][:, None] + np.arange(1, window + 1)).reshape(-1), key[a])
    x, y = a[x // max(window, 1)], a[y]
    near = (np.abs(root[x] - root[y]) <= distance) & (text[x] != text[y])
    x, y = x[near], y[near]
    at = ord_[x] * 2 * window + (ord_[y] - ord_[x] - 1) * 2
    return Pairs.all([Pairs.of(x, y, rules.FALLBACK, 9, at), Pairs.of(y, x, f"{rules.FALLBACK}_rev", 9, at + 1)])


def _one_way(pairs: Pairs, span: np.ndarray) -> Pairs:
    """Of equal pairs of spans the first, whatever its pattern."""
    o = pairs.o.copy()
    o[:, 2] = pairs.pattern
    first = Pairs(pairs.h, pairs.t, np.zeros_like(pairs.pattern), o).first(span)
    pattern = first.o[:, 2].copy()
    first.o[:, 2] = 0
    return Pairs(first.h, first.t, pattern, first.o)


def fallback(s: Sentences, window: int, distance: int) -> tuple[np.ndarray, list[pa.Array]]:
    text, _, span, _ = _spans(s)
    rows = _one_way(_near(s, text, window, distance), span)
    side = [s.m[c].take(pa.array(k)) for names in (("start", "end"), ("text", "type")) for k in (rows.h, rows.t) for c in names]
    return s.m_sent[rows.h], [*side, pa.array(PATTERNS, pa.string()).take(pa.array(rows.pattern)), pa.array(rows.o[:, 1], pa.int32())]


def proposed(s: Sentences, window: int) -> tuple[np.ndarray, list[pa.Array]]:
    m, m_sent = s.m, s.m_sent
    text, some, span, placed = _spans(s)
    spans = int(span.max(initial=-1)) + 1
    words = _codes(m["text"])[1].to_pylist()
    relative = np.array([w is not None and len(w) <= 5 and w.lower() in RELATIVE for w in words] + [False])[text]
    told = text >= 0

    ent = s.covers(True)
    below = s.firsts(ent >= 0)
    sub = np.where(ent >= 0, ent, np.where(below >= 0, ent[below], -1)) if s.n else ent
    subj = sub.copy()
    who = np.flatnonzero((sub >= 0) & relative[sub]) if len(m_sent) else np.zeros(0, np.int64)
    subj[who] = -1
    up = who
    for _ in range(3):
        up = np.where(up >= 0, s.head[up], -1)
        x = np.where(up >= 0, sub[up], -1)
        clean = (subj[who] < 0) & (x >= 0) & told[x] & ~relative[x] if len(who) else np.zeros(0, bool)
        subj[who[clean]] = x[clean]

    def of(token: np.ndarray, value: np.ndarray) -> np.ndarray:
        return np.where(token >= 0, value[token], -1) if s.n else token

    def pairs(h: np.ndarray, t: np.ndarray, pattern: str, rank: int, *order: np.ndarray) -> Pairs:
        ok = (h >= 0) & (t >= 0)
        if len(m_sent):
            ok &= some[h] & some[t] & (text[h] != text[t])
        return Pairs.of(h[ok], t[ok], pattern, rank, *(x[ok] for x in order))

    i, out = s.i, []
    verb, noun, pred = (_is(s.pos, *p) for p in (("VERB",), ("NOUN",), ("VERB", "ADJ")))
    nsubj = s.last("nsubj")
    dobj = s.last("dobj")
    v = np.flatnonzero(verb & (nsubj >= 0) & (dobj >= 0))
    out.append(pairs(subj[nsubj[v]], sub[dobj[v]], "P1_SVO", 1, i[v]))
    subject = of(s.last("nsubj", "nsubjpass"), subj)
    v, p, o = s.objects("prep", "agent")
    v, p, o = (x[pred[v] & (subject[v] >= 0)] for x in (v, p, o))
    out.append(pairs(subject[v], sub[o], "P2_pred_prep", 2, i[v], i[p], i[o]))
    # coordinations: tokens by the key of their top; only those that stand for a mention are ever paired
    top = s.tops()
    usable = np.flatnonzero(sub >= 0)
    usable = usable[np.argsort(top[usable], kind="stable")]
    tops = top[usable]

    def partners(token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first place, number) of the tokens of each one's coordination, itself included."""
        lo = np.searchsorted(tops, top[token], "left")
        return lo, np.searchsorted(tops, top[token], "right") - lo

    lo, n = partners(o)
    for part in _blocks(n):
        row, place = spread(lo[part], n[part])
        a, b, c, j = v[part][row], p[part][row], o[part][row], usable[place]
        a, b, c, j = (x[c != j] for x in (a, b, c, j))
        out.append(pairs(subject[a], sub[j], "P2_pred_prep+conj", 2, i[a], i[b], i[c] * 1000 + i[j]).first(span))
    cop = np.zeros(s.n, bool)
    cop[s.head[s.kids("cop")]] = True
    cop_subject = np.where(cop, of(nsubj, sub), -1)
    v, p, o = s.objects("prep")
    a = cop_subject[v] >= 0
    out.append(pairs(cop_subject[v[a]], sub[o[a]], "P3_copular_prep", 3, i[v[a]], i[p[a]], i[o[a]]))
    code, lemmas = _codes(s.lemma)
    is_of = np.array([x is not None and x.lower() == "of" for x in lemmas.to_pylist()] + [False])[code][p]
    last_of = np.full(s.n, -1)
    last_of[v[is_of]] = o[is_of]  # in order, so the last one stays
    of_ = of(last_of, sub)
    poss, attr = of(s.last("poss"), sub), np.where(cop, of(s.last("attr"), sub), -1)
    v = np.arange(s.n)
    out.append(pairs(poss, attr, "P4_poss_cop_attr", 4, i))
    out.append(pairs(of_, attr, "P4_of_cop_attr", 4, i))
    at = np.flatnonzero(_is(s.dep, "appos") & (s.head >= 0))
    h, a = sub[s.head[at]], sub[at]
    out.append(pairs(h, a, "P5_appos", 5, i[at]))
    out.append(pairs(a, h, "P5_appos_rev", 5, i[at]))
    out.append(pairs(np.where(noun, poss, -1), of_, "P6_noun_of_poss", 6, i))
    out.append(pairs(np.where(noun, cop_subject, -1), of_, "P6_noun_of_cop_subj", 6, i))
    first = Pairs.all(out).first(span)

    # the tokens of each span with a place, by its number
    named = np.flatnonzero(ent >= 0)
    named = named[placed[ent[named]]] if len(named) else named
    every = [first]
    conj = {side: np.array([PATTERNS.index(x + end) if x + end in PATTERNS else -1 for x in PATTERNS]) for side, end in (("h", HEAD_CONJ), ("t", TAIL_CONJ))}
    for rank, side in enumerate("ht"):
        row, k = meet(span[getattr(first, side)], span[ent[named]]) if len(named) else (np.zeros(0, np.int64),) * 2
        token = named[k]
        lo, n = partners(token)
        for part in _blocks(n):
            r, place = spread(lo[part], n[part])
            c, j, r = token[part][r], usable[place], row[part][r]
            c, j, r = (x[c != j] for x in (c, j, r))
            x = first[r]
            o = np.zeros_like(x.o)
            o[:, 0], o[:, 1:6], o[:, 6], o[:, 7], o[:, 8] = 8, x.o[:, :5], rank, i[c], i[j]
            ends = (sub[j], x.t) if side == "h" else (x.h, sub[j])
            every.append(Pairs(*ends, conj[side][x.pattern], o).first(span))
            if sum(len(e.h) for e in every) > 2 * BLOCK:
                every = [Pairs.all(every).first(span)]
    found = Pairs.all(every).first(span)

    back = _near(s, text, window, rules.FALLBACK_DISTANCE)
    have = np.isin(span[back.h] * spans + span[back.t], span[found.h] * spans + span[found.t]) & placed[back.h] & placed[back.t]
    back = _one_way(back[~have], span)
    rows = Pairs.all([found, back])
    sent = m_sent[rows.h]
    order = np.lexsort((span[rows.t], span[rows.h], rows.pattern, *(rows.o[:, c] for c in range(WIDTH - 1, -1, -1)), sent))
    rows, sent = rows[order], sent[order]
    side = [m[c].take(pa.array(k)) for k in (rows.h, rows.t) for c in ("text", "type", "start", "end")]
    return sent, [*side, pa.array(PATTERNS, pa.string()).take(pa.array(rows.pattern)), pa.array(_places(sent), pa.int32())]


def runner(find, keys: list[str], names: list[str]):
    """find over batches of (keys, ts, ms), a piece at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = sum(pc.fill_null(pc.list_value_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ts", "ms"))
            total, start = np.cumsum(size), 0
            while start < len(size):
                before = total[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(total, before + PIECE, "right")))
                part = batch.slice(start, end - start)
                sent, columns = find(Sentences(part.column("ts"), part.column("ms")))
                took = pa.array(sent)
                made = pa.RecordBatch.from_arrays([part.column(k).take(took) for k in keys] + columns, names=[*keys, *names])
                for k in range(0, made.num_rows, OUT):
                    yield made.slice(k, OUT)
                start = end

    return run
