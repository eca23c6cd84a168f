"""Navigable small-world graphs over binary codes under Hamming distance, searched in batches.

Codes are rows of two 64-bit numbers. All queries of a batch walk the graph in step: each step expands
the nearest unexpanded nodes of every beam with a handful of numpy operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[..., 0] ^ b[..., 0]).astype(np.uint16) + np.bitwise_count(a[..., 1] ^ b[..., 1])


class SmallWorld:
    """Graph over distinct codes, built by inserting them in ever larger batches.

    Each node links to `out` of the nodes in its beam at its insertion, and up to `back` later nodes are linked back to. First
    come those that are nearer to the node than to any taken before, so that a crowd of near copies doesn't take all
    links and can be reached from outside, then the nearest of the others; the links of early nodes are the long ones that make the graph navigable.
    """

    def __init__(self, codes: np.ndarray, out: int = 16, back: int = 48, beam: int = 48):
        self.codes, self.out, self.back = np.ascontiguousarray(codes), out, back
        n = len(codes)
        self.links = np.full((n, out + back), -1, np.int32)
        self.size = 0
        first = min(n, 64)
        if first:
            near = distance(self.codes[:first, None], self.codes[None, :first]).astype(np.int32)
            np.fill_diagonal(near, 1 << 20)
            take = min(out, first - 1)
            if take > 0:
                self.links[:first, :take] = np.argsort(near, axis=1, kind="stable")[:, :take]
            self.size = first
            self._link_back(np.arange(first))
        while self.size < n:
            stop = min(n, self.size * 2)
            rows = np.arange(self.size, stop)
            ids, far = self.search(self.codes[rows], beam)
            r, c = np.nonzero(ids >= 0)
            some, nth = self._spread(r, ids[r, c], far[r, c], out)
            self.links[rows[r[some]], nth] = ids[r[some], c[some]]
            self.size = stop
            self._link_back(rows)
        self._adopt()
        self._reverse = None

    @classmethod
    def of_parts(cls, codes: np.ndarray, links: np.ndarray) -> SmallWorld:
        """The graph whose codes and links these are."""
        graph = cls.__new__(cls)
        graph.codes, graph.links, graph.size, graph._reverse = codes, links, len(codes), None
        return graph

    def _link_back(self, rows: np.ndarray) -> None:
        target = self.links[rows, : self.out]
        source = np.broadcast_to(rows[:, None], target.shape)[target >= 0]
        target = target[target >= 0]
        old = self.links[:, self.out :]
        touched = np.unique(target)
        held = old[touched]
        t = np.concatenate([target, np.repeat(touched, (held >= 0).sum(1))])
        s = np.concatenate([source, held[held >= 0]])
        d = distance(self.codes[t], self.codes[s])
        order = np.lexsort((s, d, t))
        t, s, d = t[order], s[order], d[order]
        some, nth = self._spread(t, s, d, self.back)
        old[touched] = -1
        old[t[some], nth] = s[some]

    def _adopt(self) -> None:
        """Give each node that no other links to the place of a link back that has others, at the first of its own links where there is one."""
        known = np.bincount(self.links[self.links >= 0], minlength=self.size)
        for node in np.flatnonzero(known[: self.size] == 0):
            for near in self.links[node, : self.out]:
                held = self.links[near, self.out :] if near >= 0 else np.zeros(0, np.int32)
                spare = np.flatnonzero((held < 0) | (known[held] > 1))
                if len(spare):
                    if held[spare[-1]] >= 0:
                        known[held[spare[-1]]] -= 1
                    held[spare[-1]] = node
                    known[node] += 1
                    break

    def _spread(self, t: np.ndarray, s: np.ndarray, d: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of the links t -> s of length d (in order of t, then d) stay, at most so many of a t, and the place of each among those of its t."""
        kept, open_ = np.zeros(len(t), bool), np.arange(len(t))
        for _ in range(most):
            if not len(open_):
                break
            head = np.append(True, t[open_][1:] != t[open_][:-1])
            taken = open_[head]
            kept[taken] = True
            last = s[taken[np.cumsum(head) - 1]]
            open_ = open_[~head & (distance(self.codes[s[open_]], self.codes[last]) >= d[open_])]
        order = np.lexsort((~kept, t))
        t = t[order]
        head = np.append(True, t[1:] != t[:-1])[: len(t)]
        nth = np.arange(len(t)) - np.maximum.accumulate(np.where(head, np.arange(len(t)), 0))
        return order[nth < most], nth[nth < most]

    def search(self, queries: np.ndarray, beam: int, width: int = 4, batch: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """The nodes in each query's final beam, nearest first: ids (-1: none) and distances."""
        # distance, node and a bit for nodes not expanded yet in one number, half as long while nodes have 23 bits
        kind, shift = (np.uint32, 24) if self.size < 1 << 23 else (U, 40)
        one, far_off, low = kind(1), kind(np.iinfo(kind).max), kind((1 << (shift - 1)) - 1)
        ids = np.full((len(queries), beam), -1, np.int32)
        far = np.full((len(queries), beam), 0xFFFF, np.uint16)
        entry = np.unique(np.linspace(0, self.size - 1, min(self.size, 16)).astype(np.int64))
        for lo in range(0, len(queries), batch):
            q = queries[lo : lo + batch]
            keys = np.full((len(q), beam), far_off, kind)
            d = distance(q[:, None], self.codes[entry][None])
            start = np.sort((d.astype(kind) << kind(shift)) | (entry.astype(kind) << one) | one, axis=1)[:, :beam]
            keys[:, : start.shape[1]] = start
            live = np.arange(len(q))
            while len(live):
                now = keys[live]
                open_ = (now & one).astype(bool) & (now != far_off)
                some = open_.any(1)
                live, now, open_ = live[some], now[some], open_[some]
                if not len(live):
                    break
                nth = np.cumsum(open_, axis=1)
                chosen = open_ & (nth <= width)
                r, c = np.nonzero(chosen)
                node = ((now[r, c] >> one) & low).astype(np.int64)
                now[r, c] ^= one
                slot = nth[r, c] - 1
                near = self.links[node]
                dist = distance(q[live[r]][:, None], self.codes[near])
                fresh = (dist.astype(kind) << kind(shift)) | (near.astype(kind) << one) | one
                fresh[near < 0] = far_off
                grown = np.full((len(live), beam + width * near.shape[1]), far_off, kind)
                grown[:, :beam] = now
                grown[:, beam:].reshape(len(live), width, -1)[r, slot] = fresh
                grown.sort(axis=1)
                twin = (grown[:, 1:] >> one) == (grown[:, :-1] >> one)
                grown[:, 1:][twin] = far_off
                cut = beam + int(twin.sum(1).max(initial=0))
                head = grown[:, : min(cut, grown.shape[1])]
                head.sort(axis=1)
                keys[live] = head[:, :beam]
            ids[lo : lo + batch] = np.where(keys == far_off, -1, ((keys >> one) & low).astype(np.int64))
            far[lo : lo + batch] = np.where(keys == far_off, 0xFFFF, (keys >> kind(shift)).astype(np.uint16))
        return ids, far

    def hits(self, queries: np.ndarray, radius: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, node) pairs within radius in the queries' beams, nearest first, and the queries whose beams are half full of them: they may have more."""
        if not self.size or not len(queries):
            return (np.zeros(0, np.int64),) * 3
        ids, far = self.search(queries, beam, batch=max(64, 2048 * 32 // beam))
        hit = (far <= radius) & (ids >= 0)
        q, c = np.nonzero(hit)
        return q, ids[q, c].astype(np.int64), np.flatnonzero(hit.sum(1) * 2 > beam)

    def _arrivals(self) -> tuple[np.ndarray, np.ndarray]:
        """The nodes that link to each node, one node after another, and where each node's begin."""
        if self._reverse is None:
            flat = self.links.ravel()
            order = np.argsort(flat, kind="stable")[np.count_nonzero(flat < 0) :]
            self._reverse = (order // self.links.shape[1]).astype(np.int32), np.append(0, np.cumsum(np.bincount(flat[flat >= 0], minlength=self.size)))
        return self._reverse

    def flood(self, queries: np.ndarray, start: np.ndarray, radius: int, step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """All (query, node) pairs within radius among the nodes that links, followed both ways, reach from the start by way of nodes that are within radius of one of the queries.

        Each node is looked at once for all queries together, which should be near each other.
        """
        seen, q_out, n_out = np.zeros(self.size, bool), [], []
        new = np.unique(start)
        while len(new):
            seen[new] = True
            met = []
            for lo in range(0, len(new), step):
                q, n = np.nonzero(distance(queries[:, None], self.codes[new[lo : lo + step]][None]) <= radius)
                q_out.append(q)
                n_out.append(new[lo + n])
                met.append(np.unique(n_out[-1]))
            hit = np.concatenate(met)
            source, at = self._arrivals()
            n = at[hit + 1] - at[hit]
            back = source[np.repeat(at[hit + 1] - np.cumsum(n), n) + np.arange(n.sum())]
            beyond = np.unique(np.concatenate([self.links[hit].ravel(), back]))
            beyond = beyond[beyond >= 0].astype(np.int64)
            new = beyond[~seen[beyond]]
        return (np.concatenate(q_out), np.concatenate(n_out)) if q_out else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def crowds(self, queries: np.ndarray, rows: np.ndarray, q: np.ndarray, n: np.ndarray, radius: int, group: np.ndarray | None = None, most: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs within radius of the queries `rows`, whose beams had the hits (q, n): those of a group, else those with the same earliest node in their beams, flood the graph together."""
        first = np.full(len(queries), self.size, np.int64)
        np.minimum.at(first, q, n)
        order = rows[np.lexsort((first[rows],) if group is None else (first[rows], group[rows]))]
        for lo in range(0, len(order), most):
            own = order[lo : lo + most]
            a, b = self.flood(queries[own], n[np.isin(q, own)], radius)
            yield own[a], b

    def within(self, queries: np.ndarray, radius: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs within radius. Every query walks the graph; from a beam that is half full of hits all that links reach within radius is looked at."""
        q, n, full = self.hits(queries, radius, beam)
        if not len(full):
            return q, n
        rest = ~np.isin(q, full)
        more = list(self.crowds(queries, full, q, n, radius))
        return np.concatenate([q[rest], *[a for a, _ in more]]), np.concatenate([n[rest], *[b for _, b in more]])

    def audited_beam(self, queries: np.ndarray, own: np.ndarray, radius: int, beam: int, recall: float) -> int:
        """The least doubling of beam whose pairs within radius reach the recall of an exact search for these queries.

        own: the queries' own nodes or -1; finding oneself doesn't count.
        """
        exact = set()
        for lo in range(0, len(queries), 256):
            d = distance(queries[lo : lo + 256, None], self.codes[None])
            q, n = np.nonzero(d <= radius)
            exact.update((int(a) + lo, int(b)) for a, b in zip(q, n) if own[a + lo] != b)
        while exact and beam < self.size:
            q, n = self.within(queries, radius, beam)
            found = sum((a, b) in exact for a, b in zip(q.tolist(), n.tolist()))
            if found >= recall * len(exact):
                break
            beam *= 2
        return beam
