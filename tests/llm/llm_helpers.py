"""Brute-force counterparts of the operators."""

import hashlib
import re
from collections import Counter

import numpy as np


def removed_bytes(texts: list[bytes], length: int) -> list[tuple]:
    seen = Counter(t[i: i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i: i + length]] > 1:
                gone[i: i + length] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def shingle_set(text: str | None) -> set:
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    return {tuple(w[i: i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_classes(texts: list[str | None], threshold: float) -> tuple[list[int], list[list[int]]]:
    sets = [shingle_set(t) for t in texts]
    near = [[j for j in range(len(sets)) if j != i and sets[i] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold] for i in range(len(sets))]
    groups = []
    for i in range(len(sets)):
        reach, queue = {i}, [i]
        while queue:
            for j in near[queue.pop()]:
                if j not in reach:
                    reach.add(j)
                    queue.append(j)
        groups.append(sorted(reach))
    return [len(n) for n in near], groups


def items_found(text: str | None, items: list[tuple], window: int) -> tuple[int, int, set]:
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))

    doc, hit, found = words(text), set(), set()
    for name, item in items:
        w = words(item)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            for at in range(len(doc) - n + 1):
                if doc[at: at + n] == w[k: k + n]:
                    hit.update(range(at, at + n))
                    found.add(name)
    return len(doc), len(hit), found
