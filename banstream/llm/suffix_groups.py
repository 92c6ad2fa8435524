"""Suffix arrays by linear grouping, for many short strings side by side.

Suffixes with the same longest Lyndon prefix form a group. All start grouped by their first letter. Groups are
processed in descending order: each suffix of a group finds its previous smaller one (the last position before it
whose group is lower, reached over the pointers of the higher groups between them), and the suffixes that are so
pointed to leave their group for a new one right above it, those with most pointers highest: their Lyndon prefix now
ends with that of the processed group, once for each pointer. After that groups are final, and they are emitted in
ascending order: a suffix stands in its group as what follows its Lyndon prefix stands among all suffixes, which is
a lower group's, or, for repeats of one prefix, the same group's and emitted just before. Nothing is renamed or
sorted anew.

Groups depend on each other within a string only. So the strings' groups are processed together, one of each string at a
time, by numpy operations on all their members; the number of steps is that of the groups in the largest string.
"""

from __future__ import annotations

import numpy as np


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, .. for each start, ``count`` numbers each, in one array."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


class _Groups:
    """Positions in the order of their groups; a group is named by its first slot."""

    def __init__(self, letters: np.ndarray, firsts: np.ndarray, sizes: np.ndarray) -> None:
        n = len(letters)
        self.at = np.arange(n)  # slot -> position
        self.slot = np.arange(n)  # position -> slot
        self.group = np.full(n, -1)  # -1: the guard before a string
        self.size = np.zeros(n, np.int64)
        self.length = np.ones(n, np.int64)  # of the group's Lyndon prefix
        self.before = np.zeros(n, np.int64)  # the previous smaller suffix
        self.flag = np.zeros(n, bool)
        own = spread(firsts, sizes)
        string = np.repeat(np.arange(len(firsts)), sizes)
        order = np.argsort(string * 512 + letters[own], kind="stable")
        self.at[own] = own[order]
        self.slot[own[order]] = own
        key = (string * 512 + letters[own])[order]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        counts = np.diff(np.append(heads, len(key)))
        self.group[own[order]] = np.repeat(own[heads], counts)
        self.size[own[heads]] = counts

    def point(self, members: np.ndarray, groups: np.ndarray) -> None:
        """Find the previous smaller suffix of every member of some groups above which all are done."""
        seen = members - 1
        todo = np.flatnonzero(self.group[seen] > groups)
        while len(todo):
            seen[todo] = self.before[seen[todo]]
            todo = todo[self.group[seen[todo]] > groups[todo]]
        self.before[members] = seen
        todo = np.flatnonzero(self.group[seen] == groups)
        while len(todo):  # members before it in the same group point on
            own = members[todo]
            self.before[own] = self.before[self.before[own]]
            todo = todo[self.group[self.before[own]] == groups[todo]]

    def lift(self, pointed: np.ndarray, longer: np.ndarray) -> None:
        """Take suffixes out of their groups, into new ones right above; ``longer``: by how much their prefix grows."""
        old = self.group[pointed]
        order = np.argsort(old, kind="stable")
        pointed, old, longer = pointed[order], old[order], longer[order]
        heads = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]]))
        groups, counts = old[heads], np.diff(np.append(heads, len(old)))
        grown = self.length[groups] + longer[heads]
        new = groups + self.size[groups] - counts
        part = self.size[groups] > counts
        self.length[new[~part]] = grown[~part]  # the whole group is lifted and keeps its place
        if not part.any():
            return
        some = np.repeat(part, counts)
        pointed, groups, counts, new, grown = pointed[some], groups[part], counts[part], new[part], grown[part]
        self.flag[pointed] = True
        targets = spread(new, counts)
        free = targets[~self.flag[self.at[targets]]]
        low = pointed[self.slot[pointed] < np.repeat(new, counts)]
        self.flag[pointed] = False
        out, slots = self.at[free], self.slot[low]
        self.at[free], self.slot[low] = low, free
        self.at[slots], self.slot[out] = out, slots
        self.group[pointed] = np.repeat(new, counts)
        self.size[new], self.length[new] = counts, grown
        self.size[groups] -= counts


def suffix_arrays(letters: np.ndarray, firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The suffix arrays of strings that lie in ``letters`` one after another, each with a guard before it.

    String i is ``letters[firsts[i]:firsts[i] + sizes[i]]``, with letters below 512, its last one smaller than all its
    others, and the guard at ``firsts[i] - 1``. Slots firsts[i] .. of the result hold its suffixes' positions in order.
    """
    g = _Groups(letters, firsts, sizes)
    end, floor = firsts + sizes, firsts
    while True:
        live = end > floor + 1  # the last letter's suffix is the least and points nowhere
        end, floor = end[live], floor[live]
        if not len(end):
            break
        start = g.group[g.at[end - 1]]
        members, groups = g.at[spread(start, end - start)], np.repeat(start, end - start)
        g.point(members, groups)
        to, group = g.before[members], groups
        inside = g.group[to] >= 0
        to, group = to[inside], group[inside]
        if len(to):
            to, index, times = np.unique(to, return_index=True, return_counts=True)
            longer = times * g.length[group[index]]
            for t in range(int(times.max()), 0, -1):
                own = times == t
                if own.any():
                    g.lift(to[own], longer[own])
        end = start
    return _emit(g, firsts, sizes)


def _emit(g: _Groups, firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out, rank = g.at, g.slot  # groups of one suffix stand where they are
    heads = np.flatnonzero((g.size > 1) & (g.group[g.at] == np.arange(len(g.at))))
    string = np.searchsorted(firsts, heads, side="right")
    turn = np.arange(len(heads)) - np.searchsorted(string, string)
    order = np.argsort(turn, kind="stable")
    cuts = np.searchsorted(turn[order], np.arange(turn.max(initial=-1) + 2))
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        group = heads[order[a:z]]
        size = g.size[group]
        members, own = g.at[spread(group, size)], np.repeat(group, size)
        after = members + g.length[own]
        same = g.group[after] == own
        free = group.copy()
        index = np.repeat(np.arange(len(group)), size)
        done = np.zeros(len(members), bool)
        where = {}
        now = ~same
        while now.any():
            i = np.flatnonzero(now)
            i = i[np.lexsort((rank[after[i]], index[i]))]
            counts = np.bincount(index[i], minlength=len(group))
            slots = spread(free, counts)
            out[slots], rank[members[i]] = members[i], slots
            free += counts
            done[i] = True
            if done.all():
                break
            if not where:
                where = {"at": np.full(len(g.at), -1)}
                where["at"][members] = np.arange(len(members))
            now = ~done & same
            now[now] = done[where["at"][after[now]]]
    return out


def suffix_array(text: bytes) -> np.ndarray:
    """The suffix array of one string."""
    letters = np.concatenate([[0], np.frombuffer(text, np.uint8).astype(np.int64) + 1, [0]])
    return suffix_arrays(letters, np.array([1]), np.array([len(text) + 1]))[2:] - 1
