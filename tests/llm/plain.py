"""The contracts in plain Python, to compare the operators with."""

import hashlib
import re
from collections import Counter

UP = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTER_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def near_duplicates(docs, width=4, percent=80):
    """docs: (id, text) with distinct ids."""
    sets = {}
    for i, t in docs:
        w = SPACE_WORD.findall((t or "").translate(UP))
        sets[i] = {tuple(w)} if 0 < len(w) < width else {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    p, q = sorted((root(a), root(b)))
                    label[q] = p
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def contamination(docs, items, span=13, share=20):
    wins = {}
    for item, t in items:
        w = LETTER_WORD.findall((t or "").translate(UP))
        n = min(len(w), span)
        if n:
            for k in range(len(w) - n + 1):
                wins.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = []
    for i, t in docs:
        w = LETTER_WORD.findall((t or "").translate(UP))
        hit, found = set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wins:
                    hit.update(range(k, k + n))
                    found |= wins[x]
        names = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(names), sha(",".join(names)), bool(hit) and share * len(hit) >= len(w)))
    return out


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def personal_base(text):
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    out.sort()
    return [(k, a, b) for a, _, k, b in out]


def personal_row(i, text):
    spans = personal_base(text)
    n = Counter(k for k, _, _ in spans)
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    return i, n["email"], n["ip"], n["card"], n["phone"], sha(joined), joined


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    if len(a) == len(b):
        return a[k + 1 :] == b[k + 1 :]
    return a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :]


def line_dedup(docs, least=8):
    """docs in id order: what remains of each text."""
    seen, out = [], []
    for _, t in docs:
        if t is None:
            out.append(None)
            continue
        keep = []
        for line in t.split("\n"):
            w = SPACE_WORD.findall(line)
            if w and any(v == w or (len(w) >= least and len(v) >= least and one_edit(v, w)) for v in seen):
                seen.append(w)
                continue
            if w:
                seen.append(w)
            keep.append(line)
        out.append("\n".join(keep))
    return out


def quality(text):
    text = text or ""
    w = SPACE_WORD.findall(text)
    wins = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n = Counter(wins)
    rep = {p for k, x in enumerate(wins) if n[x] > 1 for p in (k, k + 1, k + 2)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if SPACE_WORD.search(line):
            again += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), again, len(rep), failed
