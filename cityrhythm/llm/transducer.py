"""Minimal acyclic transducer from words (bytes) to sequences of ids, as flat arrays.

Built from sorted words: states with equal futures are one state, so suffixes
are shared, and each word's ids stand as early on its arcs as the words with
the same prefix agree on them. The automaton is packed as a double array
(arc of a state and a byte = ``base[state] + byte``), so that many words are
looked up together, a byte a step, by numpy on a memory-mapped file.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import numpy as np

_MAGIC = b"words-to-ids 1\n"


class _State:
    __slots__ = ("final", "arcs")

    def __init__(self) -> None:
        self.final: tuple[int, ...] | None = None
        self.arcs: list[list] = []      # [byte, output, target]


def _shared(a: tuple, b: tuple) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def build(pairs: Iterable[tuple[bytes, tuple[int, ...]]]) -> list[tuple[tuple[int, ...] | None, tuple]]:
    """States of the minimal transducer, the start state last, from pairs in byte order of their distinct words.

    A state is (output at the end of a word, or None; arcs as (byte, output, target)).
    """
    states: list = []
    known: dict = {}
    path = [_State()]       # the states of the last word, not yet final
    before = b""

    def freeze(s: _State) -> int:
        key = (s.final, tuple(map(tuple, s.arcs)))
        at = known.get(key)
        if at is None:
            at = known[key] = len(states)
            states.append(key)
        return at

    for word, ids in pairs:
        keep = _shared(word, before)
        for depth in range(len(before), keep, -1):
            path[depth - 1].arcs[-1][2] = freeze(path[depth])
        del path[keep + 1:]
        for byte in word[keep:]:
            path[-1].arcs.append([byte, (), None])
            path.append(_State())
        rest = tuple(ids)
        for depth in range(keep):       # outputs that only some of the words agree on move down
            arc, below = path[depth].arcs[-1], path[depth + 1]
            n = _shared(arc[1], rest)
            down = arc[1][n:]
            if down:
                arc[1] = arc[1][:n]
                for a in below.arcs:
                    # the arc of the new word carries nothing yet
                    if not (a is below.arcs[-1] and depth + 1 == keep and len(word) > keep):
                        a[1] = down + a[1]
                if below.final is not None:
                    below.final = down + below.final
            rest = rest[n:]
        if len(word) > keep:
            path[keep].arcs[-1][1] = rest
            path[-1].final = ()
        else:
            path[-1].final = rest
        before = word
    for depth in range(len(before), 0, -1):
        path[depth - 1].arcs[-1][2] = freeze(path[depth])
    freeze_start = (path[0].final, tuple(map(tuple, path[0].arcs)))
    states.append(freeze_start)
    return states


def pack(states: list) -> dict[str, np.ndarray]:
    """The states as a double array; ids of all outputs lie in one pool."""
    pool: list[int] = []
    places: dict[tuple, int] = {}

    def place(out: tuple) -> int:
        if out not in places:
            places[out] = len(pool)
            pool.extend(out)
        return places[out]

    used = bytearray(1 << 16)
    base = np.zeros(len(states), np.int32)
    arcs: list[tuple[int, int, int, int, int]] = []     # slot, state, target, output's place and length
    start = 0
    for s in sorted(range(len(states)), key=lambda s: -len(states[s][1])):
        out = states[s][1]
        if not out:
            continue
        labels = [a[0] for a in out]
        at, tries = start, 0
        while True:
            if at + 512 > len(used):
                used.extend(bytes(len(used)))
            at = used.find(0, at)
            b = at - labels[0]
            if b >= 0 and not any(used[b + x] for x in labels):
                break
            at, tries = at + 1, tries + 1
        if tries > 200:     # little is free before this place
            start = at
        base[s] = b
        for x, ids, target in out:
            used[b + x] = 1
            arcs.append((b + x, s, target, place(ids), len(ids)))
    size = max((a[0] for a in arcs), default=0) + 257
    check, target, at, n = (np.full(size, v, np.int32) for v in (-1, 0, 0, 0))
    if arcs:
        slot, s, t, p, k = np.array(arcs, np.int64).T
        check[slot], target[slot], at[slot], n[slot] = s, t, p, k
    final = [s[0] for s in states]
    end_at = np.array([0 if f is None else place(f) for f in final], np.int32)
    end_n = np.array([-1 if f is None else len(f) for f in final], np.int32)
    return {"base": base, "check": check, "target": target, "out_at": at, "out_n": n, "end_at": end_at, "end_n": end_n,
            "pool": np.array(pool or [0], np.int32), "start": np.array([len(states) - 1], np.int32)}


def dump(arrays: dict[str, np.ndarray], more: dict) -> bytes:
    """A file that :func:`load` maps: a line of JSON with the arrays' places, then the arrays."""
    index, at = {}, 0
    for name, a in arrays.items():
        index[name] = [a.dtype.str, len(a), at]
        at += -(-a.nbytes // 64) * 64
    head = json.dumps({"arrays": index, "more": more}).encode()
    head = _MAGIC + b"%016d" % len(head) + head
    head += b" " * (-len(head) % 64)
    return head + b"".join(a.tobytes() + bytes(-a.nbytes % 64) for a in arrays.values())


def load(path: str) -> tuple[dict[str, np.ndarray], dict]:
    """The arrays, mapped from the file and read only, and what was stored beside them."""
    data = np.memmap(path, np.uint8, "r")
    n = len(_MAGIC)
    if data[:n].tobytes() != _MAGIC:
        raise ValueError(f"{path} is no lexicon")
    size = int(data[n:n + 16].tobytes())
    head = json.loads(data[n + 16:n + 16 + size].tobytes())
    first = -(-(n + 16 + size) // 64) * 64
    return {name: data[first + at:first + at + np.dtype(kind).itemsize * k].view(kind)
            for name, (kind, k, at) in head["arrays"].items()}, head["more"]


def look_up(t: dict[str, np.ndarray], buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list]:
    """For each word of ``buf`` the number of its ids, -1 where the transducer lacks it, and the outputs met.

    The outputs are (words, places in the pool, lengths), in the order of the
    steps; :func:`write_out` copies them.
    """
    n = len(starts)
    size = np.zeros(n, np.int64)
    met: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    now = np.arange(n)
    state = np.full(n, t["start"][0], np.int32)
    length = ends - starts
    step = 0
    while True:
        done = length[now] == step
        if done.any():
            w, s = now[done], state[done]
            k = t["end_n"][s]
            size[w] = np.where(k < 0, -1, size[w] + k)
            some = k > 0
            met.append((w[some], t["end_at"][s[some]], k[some]))
            now, state = now[~done], state[~done]
        if not len(now):
            break
        slot = t["base"][state] + buf[starts[now] + step]
        ok = t["check"][slot] == state
        if not ok.all():
            size[now[~ok]] = -1
            now, slot = now[ok], slot[ok]
        k = t["out_n"][slot]
        some = k > 0
        if some.any():
            met.append((now[some], t["out_at"][slot[some]], k[some]))
            size[now] += k
        state = t["target"][slot]
        step += 1
    return size, met


def write_out(t: dict[str, np.ndarray], met: list, size: np.ndarray, first: np.ndarray, ids: np.ndarray) -> None:
    """Copy the ids of the words that the transducer has to ``ids``, each word's from ``first`` on."""
    at = first.copy()
    for w, place, k in met:
        has = size[w] >= 0
        w, place, k = w[has], place[has], k[has]
        for i in range(int(k.max()) if len(k) else 0):
            more = k > i
            ids[at[w[more]] + i] = t["pool"][place[more] + i]
        at[w] += k
