"""Plain versions of the operators, for tables that fit in memory."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def base_statistics(text: str | None) -> tuple:
    t, w = text or "", words(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + d for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for d in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n, rep = len(w), len(covered)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), rep, n < 50 or 100 * rep > 50 * n


def removed_bytes(texts: list[str | None], length: int) -> list[np.ndarray]:
    """Which bytes of each text are covered by a string of this length that starts elsewhere too."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = True
        out.append(gone)
    return out


def removed_words(texts: list[str | None], length: int) -> list[np.ndarray]:
    data = [words(t) for t in texts]
    seen = Counter(tuple(b[i:i + length]) for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[tuple(b[i:i + length])] > 1:
                gone[i:i + length] = True
        out.append(gone)
    return out


def runs(gone: np.ndarray) -> int:
    return int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())


SECRETS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
}


def secrets(text: str | None) -> tuple:
    spans, counts = [], []
    for k, (kind, (pattern, good)) in enumerate(SECRETS.items()):
        found = [(m.start(), k, kind, m.end()) for m in pattern.finditer(text or "") if good(m)]
        spans += found
        counts.append(len(found))
    return *counts, hashlib.sha256(",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans)).encode()).hexdigest()


def simhash(text: str | None, k: int = 3) -> int:
    w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not w:
        return 0
    grams = [b" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(items: list, linked) -> list[int]:
    """Index of the first item of each item's class."""
    root = list(range(len(items)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(items))]


def encoded(texts: list[str | None], vocabulary: str) -> list[np.ndarray]:
    """ids of whole texts with the end id, by the library alone."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    t.encode_special_tokens = True
    return [np.array([*e.ids, 0], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def revisits(pages: list[tuple[int, str | None]], least: int = 100) -> dict[int, tuple]:
    groups = defaultdict(list)
    for page_id, html in pages:
        groups[(html or "").encode()].append(page_id)
    out = {}
    for data, ids in groups.items():
        for i in ids:
            again = len(data) >= least and i != min(ids)
            out[i] = (len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", min(ids) if again else None)
    return out


# --- benchmark decontamination ---------------------------------------------------

_MARKS = {chr(c) for c in (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127))}


def _template_tokens(text: str, number_words: set[str], units: set[str]) -> list[tuple[str, str, str]]:
    """(token in lower case, its kind, its kind where words that begin sentences can be names)."""
    out, end, kind = [], None, ""
    for m in WORD.finditer(text):
        a, b = m.start(), m.end()
        while a < b and text[a] in _MARKS:
            a += 1
        while a < b and text[b - 1] in _MARKS:
            b -= 1
        if a == b:
            continue
        raw = text[a:b]
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
        digits = sum("0" <= c <= "9" for c in raw)
        letters = sum("a" <= c.lower() <= "z" and c.isascii() or not c.isascii() for c in raw)
        parts = low.split("-")
        begins = end is None or any(c in "\n!.:?" for c in text[end:a])
        capital = "A" <= raw[0] <= "Z" or "À" <= raw[0] <= "Þ"
        if kind == "number" and (low in units or letters == len(raw) and raw.isascii() and len(raw) <= 2 or not raw.isascii() and letters == len(raw) and len(raw.encode()) <= 2):
            both = ("unit", "unit")
        elif digits and letters and "0" <= raw[0] <= "9":
            both = ("quantity", "quantity")
        elif digits and not letters or low in number_words or (len(parts) > 1 and all(p in number_words | {"and"} for p in parts) and set(parts) != {"and"}):
            both = ("number", "number")
        else:
            both = ("name" if capital and not begins else "", "name" if capital else "")
        kind = both[0]
        out.append((low, *both))
        end = b
    return out


def _agree(pairs: list[tuple], share: float = 0.8) -> bool:
    for flip in (False, True):
        votes = defaultdict(Counter)
        for p in pairs:
            votes[p[flip]][p[not flip]] += 1
        if sum(max(c.values()) for c in votes.values()) < share * len(pairs):
            return False
    return True


def contamination(text: str | None, item: str | None, number_words: set[str], units: set[str]) -> tuple | None:
    """(windows, found, slots, changed, kind) if the item is in the text."""
    a, b = (_template_tokens(t or "", number_words, units) for t in (item, text))
    wide = min(5, len(a))
    if not wide:
        return None
    for channel in range(5):
        which = 0 if channel == 0 else 1 + (channel in (2, 4))
        kinds = [t[max(which, 1)] for t in a]
        if channel and not any(kinds) or channel in (2, 4) and [t[1] for t in a] == [t[2] for t in a]:
            continue
        name = lambda t: t[0] if not which or not t[which] else ("placeholder", t[which])  # noqa: E731, B023
        mine, theirs = [name(t) for t in a], [name(t) for t in b]
        windows = [(i, tuple(mine[i:i + wide])) for i in range(len(a) - wide + 1)]
        dense = [(i, w) for i, w in windows if sum(not k for k in kinds[i:i + wide]) >= min(2, wide)]
        strict = channel > 2
        if strict and (len(dense) == len(windows) or len({t[0] for t, k in zip(a, kinds) if not k}) < 2):
            continue
        if channel in (1, 2):
            windows = dense
        places = defaultdict(list)
        for i in range(len(b) - wide + 1):
            places[tuple(theirs[i:i + wide])].append(i)
        different = {w for _, w in windows}
        found = {w for w in different if w in places}
        if not windows or 5 * len(found) < 4 * len(different):
            continue
        shifts = Counter(p - i for i, w in windows for p in places.get(w, ()))
        shift = min(shifts, key=lambda k: (-shifts[k], k))
        opposite = set()
        for i, w in windows:
            if w in places:
                p = min(places[w], key=lambda p: (abs(p - i - shift), p))
                opposite |= {(i + d, p + d) for d in range(wide)}
        slots = [(a[i][0], b[j][0]) for i, j in sorted(opposite) if kinds[i]]
        if strict:
            one = set(slots)
            if len({x for x, _ in one}) != len(one) or len({y for _, y in one}) != len(one) or len({a[i][0] for i, _ in opposite if not kinds[i]}) < 2:
                continue
        if channel and slots and not _agree(slots):
            continue
        changed = sum(x != y for x, y in slots)
        return len(different), len(found), len(slots), changed, "reparameterised" if changed else "verbatim"
    return None
