"""Plain Python versions of the operators' definitions, and documents that hold the odd cases."""

import hashlib
import math
import random
import re
from collections import Counter

import regex

LONG = "zeta " * 30000


def corpus(n=60, seed=3):
    """Rows (doc_id, text): random texts, copies, near copies, shared passages, null, empty, blank, very long, odd characters."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(300)]
    say = lambda k: " ".join(r.choice(vocab).capitalize() if r.random() < 0.1 else r.choice(vocab) for _ in range(k))
    passage, base = say(60), say(80)
    rows = [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "one two"), (1004, "ONE Two"), (1005, LONG), (1006, "é ß 漢字 \x1c x <|endoftext|> naïve, É."), (1007, "a b c d"), (1008, "A  b\nc d")]
    for i in range(n):
        text = say(r.randint(3, 120))
        if i % 6 == 0:
            text += ".\n" + passage + " " + say(5)
        if i % 5 == 0:
            w = base.split()
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(vocab)
            text = " ".join(w)
        if i % 9 == 0:
            text += f' token = "{r.randrange(16**30):030x}" and AKIA{"ABCD2345EFGH6789"} password: short apikey=Zx8+Qk2/Lm7pVt4w Kq9ZtR4bXw7LmN2cVj5Hg8Pd'
        rows.append((i * 7 % 997, text))
    return rows


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, k):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def near_duplicates(rows, k, num=80, den=100):
    """Sorted (doc_id, n_shingles, component, kept) of each row: rows of one doc_id are one document, all pairs of texts are compared."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and (rows[i][0] == rows[j][0] or den * len(a & b) >= num * len(a | b)):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(d, low.get(find(i), d))
    comp = [low[find(i)] if sets[i] else rows[i][0] for i in range(len(rows))]
    return sorted((d, len(s), c, d == c) for (d, _), s, c in zip(rows, sets, comp, strict=True))


def repeats(rows, k=20):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            if key in seen:
                gone[i : i + k] = [True] * k
            seen.add(key)
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def allowed(s):
    """A candidate that is no secret: words, numbers, short parts of one kind, stand-ins."""
    parts = re.split("[-_/+=]", s)
    every = lambda pattern, some=parts: all(re.fullmatch(pattern, p) for p in some)
    short = s[0].isalnum() and all(parts[:-1]) and every("[A-Za-z]{1,12}|[0-9]{1,12}", [p for p in parts if p])
    return every("[A-Za-z]?[a-z]*") or every("[A-Z]*") or every("[0-9]*") or short or re.search(r"(?i)example|placeholder|changeme|x{6}", s) or re.search(r"(.)\1{7}", s)


def entropy_spans(text, window=16):
    """Stretches of windows of candidates at or above the class's entropy, counted anew for each window."""
    out = []
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text or ""):
        s = m[0]
        if allowed(s):
            continue
        least = 2.9 if re.fullmatch("[0-9a-f]+", s) else 3.2 if re.fullmatch("[A-Z0-9]+", s) else 3.4
        for i in range(len(s) - window + 1):
            share = [n / window for n in Counter(s[i : i + window]).values()]
            if -sum(p * math.log2(p) for p in share) >= least:
                a, b = m.start() + i, m.start() + i + window
                if out and out[-1][0] >= m.start() and a <= out[-1][2]:
                    out[-1] = (out[-1][0], 3, b)
                else:
                    out.append((a, 3, b))
    base = base_spans(text)
    return [x for x in out if not any(a <= x[0] and b >= x[2] for a, _, b in base)]


def redacted(text, spans):
    """Each group of overlapping spans replaced by one mark."""
    out, at = "", 0
    for a, _, b in sorted(spans):
        if a >= at:
            out, at = out + text[at:a] + "[secret]", b
        at = max(at, b)
    return out + text[at:]


UNITS = set("kg g mg lb lbs oz km m cm mm mi mile miles ft feet inch inches l ml liter liters litre litres h hr hrs hour hours min mins minute minutes s sec secs second seconds day days week weeks month months year years percent dollar dollars euro euros cent cents usd eur kwh w kw v hz kmh mph".split())


def template_tokens(text):
    """(word, kind) of each token: kind is N number, U unit after a number, P name inside a sentence, or empty."""
    text = regex.sub("[\x01-\x04]", " ", text or "")
    text = regex.sub(r"\p{Lu}(?<=[\p{Ll}\p{Nd},;:]\s\p{Lu})\p{Ll}+", "\x03\\g<0>", text)
    text = regex.sub(r"[.,:](?<=\p{Nd}[.,:])(?=\p{Nd})", "\x04", text)
    text = regex.sub(r"\p{Nd}(?=\p{L})", r"\g<0> ", text)
    out = []
    for w in filter(None, regex.split("[^\\p{L}\\p{N}\x03\x04]+", text.lower())):
        kind = "N" if "0" <= w < ":" else "P" if w.startswith("\x03") else "U" if w in UNITS and out and out[-1][1] == "N" else ""
        out.append((w, kind))
    return out


def template_windows(tokens, k):
    """(start, template, values at placeholders) of each window, those with names also with them as words."""
    plain = [(w.replace("\x03", ""), "" if kind == "P" else kind) for w, kind in tokens]
    plain = [(w, "U" if not kind and w in UNITS and i and tokens[i - 1][1] == "N" else kind) for i, (w, kind) in enumerate(plain)]
    for form in (tokens, plain):
        for i in range(len(tokens) - k + 1):
            part = form[i : i + k]
            if form is tokens or any(kind == "P" for _, kind in tokens[i : i + k]):
                yield i, tuple(("slot", kind) if kind else w for w, kind in part), [w for w, kind in part if kind]


def contamination(rows, items, window=8, cover=0.5, least=13):
    """{(doc_id, item_id): (doc_start, item_start, n_windows, coverage, verbatim)}: every window of every document against every window of every item."""
    agree = lambda values: len({a for a, _ in values}) == len(values)
    where = lambda spans, more=0: {p for a, b in spans for p in range(a, b + more + 1)}
    out = {}
    sought = []
    for item, question in {*items}:
        own = template_tokens(question)
        if own:
            spots = {}
            for j, u, values in template_windows(own, min(window, len(own))):
                spots.setdefault(u, []).append((j, values))
            sought.append((item, len(own), min(window, len(own)), spots))
    for doc, text in {*rows}:
        tokens = template_tokens(text)
        mine = {k: [*template_windows(tokens, k)] for k in {k for _, _, k, _ in sought}}
        for item, n, k, there in sought:
            diagonals = {}
            for i, t, slots in mine[k]:
                for j, values in there.get(t, ()):
                    diagonals.setdefault(i - j, set()).add((j, tuple(zip(values, slots, strict=True))))
            runs, longest = {}, 0
            for d, spots in diagonals.items():
                at = sorted({j for j, _ in spots})
                spans = []
                for j in at:
                    if spans and spans[-1][1] == j - 1:
                        spans[-1] = (spans[-1][0], j)
                    else:
                        spans.append((j, j))
                for some in [spans] if agree({p for _, v in spots for p in v}) else [[s] for s in spans]:
                    values = {p for j, v in spots if some[0][0] <= j <= some[-1][1] for p in v}
                    if agree(values):
                        key = tuple(some), tuple(sorted(values))
                        runs[key] = min(some[0][0] + d, runs.get(key, 1 << 30))
                        longest = max(longest, *(b - a + k for a, b in some))
            order = sorted((-len(where(s)), start, s, v) for (s, v), start in runs.items())
            if not order:
                continue
            _, start, spans, values = order[0]
            spans, values = set(spans), set(values)
            for _, other, s, v in order[1:]:
                if agree(values | set(v)):
                    start, spans, values = min(start, other), spans | set(s), values | set(v)
            coverage = len(where(spans, k - 1)) / n
            if coverage >= cover or longest >= least:
                found = (start, min(a for a, _ in spans), len(where(spans)), coverage, all(a == b for a, b in values))
                if (doc, item) not in out or (coverage, -start) > (out[doc, item][3], -out[doc, item][0]):
                    out[doc, item] = found
    return out


def paragraphs(text):
    """Pieces of the text's bytes: each ends after a run of line or sentence ends, long ones every 64 bytes."""
    raw = re.findall(rb"[^\n.!?]*[\n.!?]+|[^\n.!?]+", (text or "").encode())
    return {p[i : i + 64] for p in raw for i in range(0, len(p), 64)}


def likeness(one, two):
    a, b = paragraphs(one), paragraphs(two)
    return len(a & b) / len(a | b) if a | b else 1.0
