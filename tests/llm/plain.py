"""Plain versions of the operators, one document at a time or all against all; they call none of the library's operators."""

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import regex
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def size(text):
    return len(WORD.findall(text or ""))


def statistics(text):
    t = text or ""
    w, lines = WORD.findall(t), t.split("\n")
    share = lambda a, b: a / b if b else 0.0
    chars, solid = len(t), sum(map(len, w))
    return [
        math.log1p(len(w)), share(solid, len(w)), share(len(re.findall(r"[#*$%&|<>{}\\~^]", t)), len(w)), share(t.count("!"), len(w)), share(len(regex.findall(r"\p{Lu}", t)), chars),
        share(chars - solid, chars), math.log1p(share(chars, len(lines))), share(len(set(w)), len(w)), share(len(set(lines)), len(lines)),
    ]


def isotonic(x, y, n):
    """By the max-min formula over all intervals; equal heights are one step, at the weighted mean of its places."""
    total, weight = np.append(0, np.cumsum(y * n)), np.append(0, np.cumsum(n))
    mean = lambda a, b: (total[b + 1] - total[a]) / (weight[b + 1] - weight[a])
    height = [max(min(mean(a, b) for b in range(i, len(x))) for a in range(i + 1)) for i in range(len(x))]
    steps = {}
    for h, r, k in zip(np.round(height, 12), x, n):
        steps.setdefault(h, []).append((r, k))
    return np.array([sum(r * k for r, k in v) / sum(k for _, k in v) for v in steps.values()]), np.array(list(steps))


def quality_scores(texts, labels, features=256, gamma=0.05, seed=29):
    """{doc_id: score} of texts ({doc_id: text}) by labels ({doc_id: 0 or 1})."""
    crc = lambda s: zlib.crc32(s.encode())
    used = sorted(i for i, q in labels.items() if q in (0, 1) and i in texts and crc(str(i)) % 5)
    x, y = np.array([statistics(texts[i]) for i in used]), np.array([labels[i] for i in used], float)
    held = np.array([crc(f"c{i}") % 8 == 0 for i in used])
    mean, scale = x[~held].mean(axis=0), x[~held].std(axis=0)
    scale[scale < 1e-9] = 1
    rng = np.random.default_rng(seed)
    omega, phase = rng.normal(0, math.sqrt(2 * gamma), (x.shape[1], features)), rng.uniform(0, 2 * math.pi, features)

    def spread(v):
        z = np.clip((v - mean) / scale, -6, 6)
        return np.concatenate([math.sqrt(2 / features) * np.cos(z @ omega + phase), z, np.ones((len(z), 1))], axis=1)

    a = spread(x[~held])
    weights = np.linalg.lstsq(np.vstack([a, np.eye(a.shape[1])]), np.append(y[~held], np.zeros(a.shape[1])), rcond=None)[0]
    raw, of = np.round(spread(x[held]) @ weights, 3), y[held]
    places = np.unique(raw)
    steps = isotonic(places, np.array([of[raw == p].mean() for p in places]), np.array([(raw == p).sum() for p in places]))
    r = spread(np.array([statistics(t) for t in texts.values()])) @ weights
    return dict(zip(texts, np.clip(0.998 * np.interp(r, *steps) + 0.002 * np.clip(r, 0, 1), 0, 1)))


def simhash(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(v >> k & 1 for v in h) > len(h))


def groups(fingerprints):
    """The smallest reachable position of each fingerprint in a list, links being 3 bits or fewer."""
    f = np.array(fingerprints, np.uint64)
    root = np.arange(len(f))
    while True:
        new = np.array([root[np.bitwise_count(f ^ v) <= 3].min() for v in f])
        if (new == root).all():
            return root
        root = new


def mixed(rows, packet, weights=(3, 1, 2), seed=17):
    """Words taken of each of rows (doc_id, source, size), in their order."""
    sizes = Counter()
    for _, source, n in rows:
        sizes[source] += n
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    budget = Fraction(3, 2) * sum(sizes.values())
    target, open_ = {}, set(names)
    while open_:
        rate = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        full = [s for s in open_ if 2 * sizes[s] <= rate * weight[s]]
        target |= {s: Fraction(2 * sizes[s]) for s in full} or {s: rate * weight[s] for s in open_}
        open_ -= set(full) if full else open_
    stream = []
    for k, s in enumerate(names):
        own = sorted((hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), i is not None, i or 0, n, at) for at, (i, x, n) in enumerate(rows) if x == s)
        done = 0
        for _ in range(2):
            for *_, n, at in own:
                for part in range(0, n, packet or max(n, 1)):
                    words = min(packet or n, n - part)
                    done += words
                    stream.append((done / float(target[s]), k, done, words, at))
    left, taken = int(budget), [0] * len(rows)
    for *_, words, at in sorted(stream):
        if words > left:
            taken[at] += left if packet else 0
            break
        taken[at] += words
        left -= words
    return taken, {s: float(t) for s, t in target.items()}


class Secrets:
    """Candidates and features word by word; the forest's trees are walked node by node."""

    def __init__(self, module, forest):
        self.m, self.forest = module, forest
        self.listed = re.compile("|".join(sorted(forest.known.words, key=lambda w: (-len(w), w))) or "$^")

    def pointed(self, x, two, one):
        m = self.m
        inside = re.search(m.NAMED + "[=:]+>?[\"'`]*([^\"'`]+)", x)
        found = inside[1] if inside else ""
        if not found:
            ahead = re.search(m.NAMED + "[=:]+>?$", one) or (re.search("^[=:]+>?$", one) and re.search(m.NAMED + "$", two)) or re.search("(?i)^[\"'`]?bearer$", one) or (re.search(m.NAMED + "$", one) and re.search("^[=:]", x)) or (one in m.MEANS and re.search(m.NAMED + "$", two))
            after = re.search("^[=:>\"'`(\\[{]*([^\"'`]+)", x) if ahead else None
            prefixed = re.search(f"(?:^|[^A-Za-z0-9])({m.PREFIX}[^\"'`,;()<>]+)", x)
            login = re.search(m.LOGIN, x)
            found = after[1] if after else prefixed[1] if prefixed else login[1] if login else ""
        return found if re.search("[\"'`][,;.)}\\]]*$", x) else re.sub("(?<=[^.,;:)}\\]])[.,;:)}\\]]+$", "", found)

    def runs(self, x, two, one):
        long_ = re.findall(self.m.RUN, x) if len(x) >= 16 else []
        p = self.pointed(x, two, one)
        if not p or any(p in r and len(r) > len(p) for r in long_):
            return long_
        return [p, *[r for r in long_ if r not in p]]

    def features(self, run, lead, two, one, after):
        m, n = self.m, len(run)
        count = lambda rx: len(re.findall(rx, run)) / n
        flag = lambda b: float(bool(b))
        near = " ".join([two, one, lead])
        code = lambda ch: ord(ch) - 97 if "a" <= ch <= "z" else 26 if ch in "0123456789" else 27
        low = run.lower()
        odds = [self.forest.known.odds[code(a) * 28 + code(b)] for a, b in zip(low, low[1:])]
        return [
            n, len(set(run)), count("[0-9]"), count("[A-Z]"), count("[a-z]"), count("(?<=[a-z])(?=[0-9A-Z])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Z])(?=[0-9a-z])|(?<=[A-Za-z0-9])(?=[_/+-])"), flag(re.search("^(?:[0-9a-f]+|[0-9A-F]+)$", run)),
            sum(odds) / len(odds) if odds else 0.0, 1 - len(self.listed.sub("", low)) / n, flag(re.search(r"[/\\]", lead) or re.search("/.*/", run)), flag(re.search(m.KEYS, near)), flag(re.search(m.BENIGN, f"{near} {after}")), flag(re.search(m.PREFIXES, run)),
            flag(re.search("[=:]\\s*[\"']?$", lead) or (re.search("^[\"']?$", lead) and re.search("[=:]$", one))), flag(re.search("[\"'`]$", lead)), count("[^A-Za-z0-9]"),
            flag(re.search("://[^/:@]*:$", lead)), flag(re.search(m.HOOK, lead + run)), flag(one in m.MEANS and re.search(m.NAMED + "$", two)),
        ]

    def score(self, f):
        def walk(node):
            while node.low is not None:
                node = node.low if f[node.feature] <= node.cut else node.high
            return node.value

        return sum(walk(t) for t in self.forest.trees) / max(1, len(self.forest.trees))

    def findings(self, text):
        w = WORD.findall(text or "")
        at = lambda i: w[i] if 0 <= i < len(w) else ""
        return [(i, r) for i, x in enumerate(w) for r in self.runs(x, at(i - 2), at(i - 1)) if self.score(self.features(r, x.split(r, 1)[0], at(i - 2), at(i - 1), at(i + 1))) >= 0.5]

    def redacted(self, text, mark="[SECRET]"):
        for r in sorted(dict.fromkeys(r for _, r in self.findings(text)), key=len, reverse=True):
            text = text.replace(r, mark) if len(r) >= 16 else re.sub(r"(?<![A-Za-z0-9])" + re.escape(r) + r"(?![A-Za-z0-9])", lambda m: mark, text)
        return text
