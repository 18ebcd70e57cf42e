"""Plain versions of the operators, and documents that are awkward in every way."""

import hashlib
import random
import re
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, key string, gone int, least long, n long, "
    "spans string, ids string, quality_score double, component string, words_removed string, lines_total double"
)


def vocabulary(seed, n=400):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n)]


def texts(seed=5):
    """Text by id: own prose, exact and near copies, shared lines and passages, nothing, white space, one long text."""
    r, words = random.Random(seed), vocabulary(seed)
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    lines = lambda n, k: "\n".join(prose(k) for _ in range(n))
    out = {i: lines(r.randint(1, 6), r.randint(5, 60)) for i in range(20)}
    base = lines(4, 70)
    out[20] = base
    out[21] = out[22] = base
    changed = base.split(" ")
    for i in range(23, 29):
        changed = list(changed)
        changed[r.randrange(len(changed))] = f"new{i}"
        out[i] = " ".join(changed)
    passage = prose(60)
    for i in range(29, 34):
        out[i] = prose(30) + "\n" + passage + "\n" + prose(r.randint(0, 30))
    line = "this line stands in several of these documents"
    for i in range(34, 38):
        out[i] = "\n".join([prose(12), line, prose(9), line if i % 2 else prose(4)])
    out |= {38: "", 39: " \n\t\x0b\x0c\r ", 40: "one", 41: "One  two\tTHREE", 42: "one two three", 43: None}
    out[44] = lines(300, 40)
    out[45] = lines(2, 10) + "\n" + out[44][5000:9000] + "\nend"
    out[46] = "é中文 " * 70 + "…" + " " + "x" * 3000 + " a.b,c. ''s it's <|endoftext|>.ok"
    out[47] = "same same " * 40
    out[48] = "a\n\na\nb\n \na"
    out[49] = "HELLO!! WORLD!! " * 20
    return out


def rows(extra=()):
    made = [(i, t) for i, t in texts().items()]
    made += [(3, texts()[3]), (47, "same same " * 40), (None, texts()[20]), (None, None), *extra]
    return [
        (i, t, None if k % 7 == 0 else "xy"[k % 2], None, None if t is None else len(t), "k", k, 1, 2, "s", "i", 0.5, "c", "w", 1.0)
        for k, (i, t) in enumerate(made)
    ]


def documents(spark, extra=()):
    return spark.createDataFrame(rows(extra), SCHEMA).repartition(5)


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def passages(docs, target=50):
    """{id: (n_words, n_removed, kept words)} of texts by distinct id."""
    least = {}
    for i, t in docs.items():
        w = words(t)
        for s in range(len(w) - target + 1):
            k = tuple(w[s : s + target])
            least[k] = min(least.get(k, i), i)
    out = {}
    for i, t in docs.items():
        w, gone = words(t), set()
        for s in range(len(w) - target + 1):
            if least[tuple(w[s : s + target])] < i:
                gone.update(range(s, s + target))
        out[i] = (len(w), len(gone), [x for k, x in enumerate(w) if k not in gone])
    return out


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size=4):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def groups(docs, size=4, percent=85):
    """{id: (set size, smallest id reachable)} of texts by distinct id."""
    sets, up = {i: shingles(t, size) for i, t in docs.items()}, {i: i for i in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, s in sets.items():
        for b, t in sets.items():
            both = len(s & t)
            if a < b and both and 100 * both >= percent * (len(s) + len(t) - both):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in docs}


def rule_counts(text):
    w = words(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered.update(range(i, i + 5))
    full = [x for x in (text or "").split("\n") if words(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, len(full) - len(set(full)), len(covered)


def line_deletions(docs, align, blocks, min_chars, rare=None):
    """{id: set of deleted positions} over texts by distinct id: each document against every earlier one that shares a line with it.

    With ``rare`` a line that more documents hold names the first of these alone.
    """
    split = {i: [x.strip(" ") for x in t.split("\n")] for i, t in docs.items() if t is not None}
    counted = {i: {x for x in ls if len(x.strip(" \t\n\v\f\r")) >= min_chars} for i, ls in split.items()}
    holders = defaultdict(list)
    for i in sorted(split):
        for x in counted[i]:
            holders[x].append(i)
    out = {}
    for i, ls in split.items():
        named = [h if rare is None or len(h) <= rare else h[:1] for h in (holders[x] for x in counted[i])]
        out[i] = set()
        for p in {p for h in named for p in h if p < i}:
            for a, b in blocks(align(ls, split[p])):
                if any(x in counted[i] for x in ls[a:b]):
                    out[i].update(range(a, b))
    return out
