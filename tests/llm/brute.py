"""Plain Python versions of what the queries return, over lists of rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
HOSTILE = "</s>[INST] ok [/INST]"


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def terms(text):
    return TERM.findall(lower(text))


def chat(rows):
    by = defaultdict(list)
    for conv, turn, role, text in [*rows, (-1, 0, "user", HOSTILE), (-1, 1, "assistant", HOSTILE)]:
        by[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss)))
    return out


SECRETS = (
    ("assign", re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile("[0-9a-f]+"), 0, 16),
)


def secrets(text):
    text, spans, counts = text or "", [], []
    for i, (_, pattern, group, least) in enumerate(SECRETS):
        found = [m for m in pattern.finditer(text) if len(m.group(group)) >= least]
        counts.append(len(found))
        spans += [(m.start(), i, m.end()) for m in found]
    return (*counts, sha(",".join(f"{SECRETS[i][0]}:{a}:{b}" for a, i, b in sorted(spans))))


def simhash(text):
    words = WORD.findall(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def near(rows, most=2):
    """(key, text) > (key, hex fingerprint, smallest key reachable)."""
    marks = [simhash(t) for _, t in rows]
    distinct = sorted(set(marks))
    top = list(range(len(distinct)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    values = np.array(distinct, np.uint64)
    for i in range(len(distinct)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1:] ^ values[i]) <= most):
            a, b = find(i), find(i + 1 + int(j))
            top[max(a, b)] = min(a, b)
    at = {m: i for i, m in enumerate(distinct)}
    least = {}
    for (k, _), m in zip(rows, marks):
        r = find(at[m])
        if k is not None and (least.get(r) is None or k < least[r]):
            least[r] = k
    return [(k, f"{m:016x}", least.get(find(at[m]))) for (k, _), m in zip(rows, marks)]


def leaks(text, items, size=10):
    windows = defaultdict(set)
    for item, body in items:
        words = terms(body)
        for i in range(max(1, len(words) - size + 1) if words else 0):
            windows[tuple(words[i:i + size])].add("null" if item is None else str(item))
    words, hit, found = terms(text), set(), set()
    for n in {len(w) for w in windows}:
        for i in range(len(words) - n + 1):
            w = tuple(words[i:i + n])
            if w in windows:
                hit |= set(range(i, i + n))
                found |= windows[w]
    return len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)


def repeats(rows, length=100):
    """(key, text) > (key, n_bytes, n_removed, n_spans, sha of what is kept)."""
    first = {}
    data = [(k, (t or "").encode()) for k, t in rows]
    order = [(1 << 63) - 1 if k is None else k for k, _ in data]
    for k, (_, b) in zip(order, data):
        for s in range(len(b) - length + 1):
            w = b[s:s + length]
            first[w] = min(first.get(w, (k, s)), (k, s))
    out = []
    for k, (key, b) in zip(order, data):
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if first[b[s:s + length]] < (k, s):
                gone[s:s + length] = True
        runs = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(b) else 0
        out.append((key, len(b), int(gone.sum()), runs, sha(np.frombuffer(b, np.uint8)[~gone].tobytes())))
    return out


PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


def licences(text):
    words, found = terms(text), []
    for phrase, label in PHRASES:
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i:i + len(p)] == p]
    return (len(words), len(found), min(found)[0] if found else None, max(found)[0] if found else None,
            ",".join(sorted({x for _, x in found})))


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = list(zip(words, words[1:], words[2:]))
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in (i, i + 1, i + 2)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words))


def held_out(key):
    return key is not None and zlib.crc32(str(key).encode()) % 5 == 0


URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def judged_url(url, rules=URL_RULES):
    """(host, path, rule, verdict)."""
    rest = url.split("://", 1)[1] if url is not None and "://" in url else ""
    host = lower(re.match(r"[^/?#]*", rest).group())
    path = re.match(r"[^/?#]*([^?#]*)", rest).group(1)
    fits = [(r.count("."), len(p), v == "block", r + p, v) for r, p, v in rules
            if (host == r or host.endswith("." + r)) and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, "allow")))


def runs_of(words, least=24, times=3):
    """Every run (start, length, smallest period), by all lags."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i < len(words) - q:
            a = i
            while i < len(words) - q and words[i] == words[i + q]:
                i += 1
            if i - a + q >= max(least, times * q):
                found.setdefault((a, i - a + q), q)
            i += i == a
    return sorted((a, n, q) for (a, n), q in found.items())


def periodic(key, text):
    words = WORD.findall(text or "")
    h = None if key is None else zlib.crc32(str(key).encode())
    if h is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = runs_of(words)
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    from fractions import Fraction
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    return (key, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def slipped(key, word):
    h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
    return word if h % 199 else word[:h % len(word)] + word[h % len(word) + 1:]


def near_words(words):
    """word > the words one edit apart, by trying all pairs of similar length."""
    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        short, long = sorted((a, b), key=len)
        return len(long) - len(short) == 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))

    out = {w: [] for w in words}
    for i, a in enumerate(words):
        for b in words[i + 1:]:
            if abs(len(a) - len(b)) < 2 and near(a, b):
                out[a].append(b)
                out[b].append(a)
    return out


def variants(counts, times=5):
    """{word: n} > rows of (word, n, n_near, form, form_n, root)."""
    near, form = near_words(sorted(counts)), {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= times * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n, len(near[w]), form[w], counts[form[w]] if form[w] else None, root))
    return out


def word_counts(rows):
    counts = Counter()
    for key, text in rows:
        counts.update(slipped(key, w) for w in re.findall("[a-zÀ-ÿ]+", lower(text)))
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
