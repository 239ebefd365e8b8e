"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text: str | None, n: int) -> set[tuple[str, ...]]:
    w = SPACE_WORDS.findall(lower(text))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def components(rows, n: int, num: int, den: int) -> list[tuple]:
    """(id, set size, component) of each (id, text), by comparing all pairs."""
    sets = [(i, shingles(t, n)) for i, t in rows]
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if a is not None and b is not None and x and y and den * len(x & y) >= num * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return [(i, len(s), None if i is None else find(i)) for i, s in sets]


def contamination(text: str | None, items, window: int = 13, share: int = 20):
    """(n_words, n_hit, item ids, contaminated)."""
    words = ALNUM_WORDS.findall(lower(text))
    hit, ids = set(), set()
    for item, body in items:
        w = ALNUM_WORDS.findall(lower(body))
        m = min(window, len(w))
        windows = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()
        for i in range(len(words) - m + 1 if m else 0):
            if tuple(words[i : i + m]) in windows:
                hit.update(range(i, i + m))
                ids.add(str(item))
    return len(words), len(hit), sorted(ids), bool(hit) and share * len(hit) >= len(words)


def base_secrets(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans, read off character by character."""
    text, out, kinds = text or "", [], ("password", "passwd", "secret", "token", "apikey", "api_key")
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    low, at = lower(text), 0
    while at < len(text):
        word = next((k for k in sorted(kinds, key=len, reverse=True) if low.startswith(k, at)), None)
        end = at + len(word) if word else at
        found = None
        if word:
            for quote in (1, 0):  # an optional part is taken if it can be
                p = end
                if quote and text[p : p + 1] in ('"', "'") and text[p : p + 1]:
                    p += 1
                elif quote:
                    continue
                while text[p : p + 1] == " ":
                    p += 1
                if text[p : p + 1] in (":", "=") and text[p : p + 1]:
                    p += 1
                    while text[p : p + 1] == " ":
                        p += 1
                    if text[p : p + 1] in ('"', "'") and text[p : p + 1]:
                        p += 1
                    q = p
                    while q < len(text) and text[q] in value:
                        q += 1
                    if q > p:
                        found = (p, q)
                        break
        if found:
            if found[1] - found[0] >= 6:
                out.append((at, 0, found[1]))
            at = found[1]
        else:
            at += 1
    for kind, head, letters, least in ((1, "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20), (2, "", "0123456789abcdef", 24)):
        at = 0
        while at < len(text):
            q = at + len(head)
            if text.startswith(head, at):
                while q < len(text) and text[q] in letters:
                    q += 1
            if q > at + len(head):
                if q - at >= least:
                    out.append((at, kind, q))
                at = q
            else:
                at += 1
    return sorted(out)


def greedy_pieces(word: bytes, starts: set[bytes], rest: set[bytes]) -> int:
    n = at = 0
    while at < len(word):
        known = starts if at == 0 else rest
        at += max(k for k in range(1, len(word) - at + 1) if word[at : at + k] in known)
        n += 1
    return n
