"""Plain Python versions of what the operators compute."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def valid(kind, s):
    d = re.sub("[^0-9]", "", s)
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in s.split(".")),
            "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items()
            for m in re.finditer(p, text) if valid(k, m.group(0))]


def secret_spans(text):
    """The keys that the test tables hold."""
    return [("secret", *m.span(1)) for m in re.finditer(r"(?i)token\W{1,5}([0-9a-f]{40})(?![0-9a-z])", text)]


def em(patterns, rounds=25, smooth=0.5):
    """{votes: posterior} by expectation-maximisation on {votes: count}, in numpy."""
    v = np.array(list(patterns)) + 1
    n = np.array(list(patterns.values()), float)
    prior, pos, neg = 0.5, np.tile([0.1, 0.3, 0.6], (4, 1)), np.tile([0.6, 0.3, 0.1], (4, 1))

    def posterior():
        a, b = (w * t[np.arange(4), v].prod(1) for w, t in ((prior, pos), (1 - prior, neg)))
        return a / (a + b)

    for _ in range(rounds):
        q = posterior()
        prior = (1 + (n * q).sum()) / (2 + n.sum())
        pos, neg = (np.array([[(smooth + (n * w)[v[:, lab] == k].sum()) / (3 * smooth + (n * w).sum()) for k in range(3)]
                              for lab in range(4)]) for w in (q, 1 - q))
    return dict(zip(patterns, posterior()))


def shingle_set(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    w = re.findall(r"[^ \t\n\x0b\x0c\r]+", low)
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def near_components(docs, percent=85):
    """doc_id -> (set size, smallest doc_id reachable by links)."""
    sets = {k: shingle_set(t) for k, t in docs.items()}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    seen = defaultdict(list)
    for k in sorted(sets):
        hits = Counter()
        for s in sets[k]:
            hits.update(seen[s])
            seen[s].append(k)
        for j, n in hits.items():
            if 100 * n >= percent * (len(sets[k]) + len(sets[j]) - n):
                a, b = sorted((find(k), find(j)))
                root[b] = a
    return {k: (len(s), find(k)) for k, s in sets.items()}


def repeated_bytes(docs, length):
    """doc_id -> (bytes, removed, runs, sha256 of what stays)."""
    seen = Counter(b[i:i + length] for b in docs.values() for i in range(len(b) - length + 1))
    out = {}
    for k, b in docs.items():
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[k] = (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def vector_codes(rows, parts=16, entries=64, rounds=2):
    """rows (id, label, vector) -> ({(id, code, error, label_error)}, books)
    by plain integer search.  Ids must be distinct."""
    import math
    kept = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: r[0])
    step = len(kept[0][2]) // parts
    cut = lambda v, k: v[k * step:(k + 1) * step]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    books = [[cut(r[2], k) for r in kept[:entries]] for k in range(parts)]
    near = lambda v, book: min((dist(v, e), i) for i, e in enumerate(book))
    for _ in range(rounds):
        new = []
        for k, book in enumerate(books):
            members = defaultdict(list)
            for r in kept:
                members[near(cut(r[2], k), book)[1]].append(cut(r[2], k))
            new.append([[sum(c) // len(members[i]) for c in zip(*members[i])] if i in members else e
                        for i, e in enumerate(book)])
        books = new
    out, per = [], Counter()
    for i, lab, v in kept:
        got = [near(cut(v, k), book) for k, book in enumerate(books)]
        out.append((i, lab, "".join(f"{c:02x}" for _, c in got), sum(d for d, _ in got)))
        per[lab] += out[-1][3]
    return {(i, c, e, per[lab]) for i, lab, c, e in out}, books


def cheapest_edits(turns):
    """(cost, audit) over whole turns (initial, must go, cut short): the least of
    all edits to every length, by plain recursion."""
    from functools import lru_cache
    n = len(turns)

    def least(goal):
        @lru_cache(None)
        def rest(i, j):
            if i == n and j == len(goal):
                return 0, ""
            found = []
            if i < n:
                c, a = rest(i + 1, j)
                found.append((c + 2, "D" + a))
            if j < len(goal) and goal[j] != "s":
                c, a = rest(i, j + 1)
                found.append((c + 5, "I" + a))
            if i < n and j < len(goal) and not turns[i][1]:
                c, a = rest(i + 1, j + 1)
                c += 5 * turns[i][2]
                if turns[i][0] == goal[j]:
                    found.append((c, "K" + a))
                if goal[j] != "s":
                    found.append((c + 1, "R" + a))
            return min(found, default=(1 << 60, ""))
        return rest(0, 0)

    goals = [""] + [s + "ua" * k for s in ("", "s") for k in range(1, n // 2 + 3)]
    return min(map(least, goals))


def repaired_conversations(rows):
    """conv_id -> (gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256) of rows (conv_id, turn, role, text)."""
    import zlib
    out, groups = {}, defaultdict(list)
    shown = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        role, text = shown(role), shown(text)
        r = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        groups[conv] += [] if r == 0 else [(
            turn, "user" if r == 4 else role,
            "" if r == 1 else re.sub("[.!?]", "", text) if r == 2 else text)] * (2 if r == 3 else 1)
    for conv, turns in groups.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), hashlib.sha256(t[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in turns:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen
                          else "truncated" if last[0] not in ".!?" else None)
            seen.add((role, text))
        cost, audit = cheapest_edits(tuple((r[:1], f in ("blank", "duplicate"), f == "truncated")
                                           for (_, r, _), f in zip(turns, faults)))
        done, kept = [], iter(turns)
        odd = sum(c != "D" for c in audit) % 2
        for c in audit:
            _, role, text = next(kept) if c != "I" else (None, None, "")
            if c != "D":
                done.append(f"{role if c == 'K' else 'user' if (len(done) - odd) % 2 == 0 else 'assistant'}:{text}")
        known = [t for t, _, _ in turns if t is not None]
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0,
                     *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(turns, turns[1:])),
                     cost, audit, hashlib.sha256("\n".join(done).encode()).hexdigest())
    return out


def template_matches(docs, bench, coverage=0.3):
    """{(doc, item): windows} by comparing all windows of all texts."""
    import regex
    from voxlex.llm.decontam import UNITS
    name = "\ue000"

    def tokens(text):
        text = regex.sub(r"[A-Z\p{Lu}](?<=[a-z\p{Ll},;:] [A-Z\p{Lu}])(?=[a-z\p{Ll}])", lambda m: name + m.group(0), text or "")
        found = regex.findall(rf"[0-9](?:[0-9.,]*[0-9])?|{name}?[a-z\p{{L}}\p{{M}}]+|[.!?\n]+", text.lower())
        ender = [bool(regex.fullmatch(r"[.!?\n]+", x)) for x in found]
        at = [i for i, e in enumerate(ender) if not e]
        starts = [i == 0 or ender[i - 1] for i in at]
        ends = [i == len(found) - 1 or ender[i + 1] for i in at]
        out = []
        for k, i in enumerate(at):
            x, before = found[i], found[at[k - 1]] if k else ""
            kind = ("N" if x[0].isdigit() else "P" if x[0] == name else
                    "U" if before[:1].isdigit() and x in UNITS else "")
            out.append((x.lstrip(name), kind, starts[k], ends[k]))
        return out

    def windows(t, n, short):
        for i in range(len(t) - n + 1):
            w = t[i:i + n]
            shape = tuple(k or x for x, k, *_ in w)
            fill = tuple(k + x if k else "" for x, k, *_ in w)
            typed = n - sum(map(bool, fill)) >= 2 and (not short or n == 8 or w[0][2] and w[-1][3])
            yield i, tuple(x for x, *_ in w), (shape, tuple(map(bool, fill))) if typed else None, fill

    chance = lambda a: a[0] == "U" or a[0] == "N" and len(regex.sub("[.,]", "", a[1:]).strip("0")) <= 1
    out = {}
    shown = {k: {n: list(windows(tokens(t), n, True)) for n in range(3, 9)} for k, t in docs.items()}
    for item, text in bench.items():
        t = tokens(text)
        n = min(8, len(t))
        if n < 3:
            continue
        own = list(windows(t, n, False))
        solid = any(s and any(s[1]) and 2 * sum(s[1]) <= n for *_, s, _ in own)
        typed = {i: (s, f) for i, _, s, f in own if s and (not solid or 2 * sum(s[1]) <= n)}
        plain = defaultdict(list)
        for i, lit, *_ in own:
            plain[lit].append(i)
        for doc, by in shown.items():
            runs = defaultdict(lambda: (set(), []))
            for j, lit, s, f in by[n]:
                for i in plain.get(lit, ()):
                    runs[j - i][0].add(i)
                for i, (shape, fill) in typed.items():
                    if s == shape and any(s[1]):
                        pairs = {(a, b) for a, b in zip(fill, f) if a}
                        if len(pairs) == len({a for a, _ in pairs}):
                            runs[j - i][1].append((i, {p for p in pairs if not chance(p[0])}))
            found = set()
            for lits, hits in runs.values():
                values = defaultdict(set)
                for _, pairs in hits:
                    for a, b in pairs:
                        values[a].add(b)
                found |= lits | {i for i, pairs in hits if all(len(values[a]) == 1 for a, _ in pairs)}
            fit = len(found & typed.keys()) / len(typed) if typed else 0
            if found and max(len(found) / len(own), fit) >= coverage:
                out[doc, item] = len(found)
    return out
