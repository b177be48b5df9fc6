"""Plain Python versions of the operators, for small tables."""

import collections
import itertools
import math
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def shingle_set(text):
    w = words(text, True)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows):
    """[(doc_id, text)] -> [(doc_id, n_shingles, component_id)], by all pairs; ids are not null."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            parent[root(j)] = root(i)
    least = collections.defaultdict(lambda: math.inf)
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least[root(i)], d)
    return [(d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)]


def measures(text):
    w = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    count = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if count[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    stutter = sum(a == b for a, b in itertools.pairwise(w))
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_dup_lines": dup, "n_lines": len(seen) + dup, "n_repeat_words": len(covered), "n_stutters": stutter}


def fences(rows):
    """[(text, lang, source)] -> {(lang, source): {measure: (low, high)}}, from sorted bins."""
    over = lambda a, b: a / b if b else 0.0
    got = [measures(t) for t, _, _ in rows]
    table = collections.defaultdict(list)
    for m, (_, lang, source) in zip(got, rows, strict=True):
        if m["n_words"] >= 20 and 100 * m["n_repeat_words"] <= 30 * m["n_words"]:
            values = {"symbol_rate": over(m["n_symbols"], m["word_chars"]), "word_length": over(m["word_chars"], m["n_words"]), "duplicate_line_rate": over(m["n_dup_lines"], m["n_lines"])}
            values |= {"repeat_rate": over(m["n_repeat_words"], m["n_words"]), "stutter_rate": over(m["n_stutters"], m["n_words"]), "chars": m["word_chars"], "words": m["n_words"]}
            for name, v in values.items():
                b = 0 if v <= 1e-4 else math.ceil(math.log(v / 1e-4) / math.log(1.02))
                if b or name not in ("duplicate_line_rate", "repeat_rate"):
                    for group in ((lang, source), (lang,), ()):
                        table[name, group].append(b)
    for bins in table.values():
        bins.sort()

    def quartiles(name, group):
        bins = table.get((name, group), [])
        own = [0.0 if b == 0 else 1e-4 * 1.02 ** (b - 0.5) for b in (bins[math.ceil(len(bins) * q) - 1] for q in (0.25, 0.5, 0.75))] if bins else None
        if not group:
            return own
        wide = quartiles(name, group[:-1])
        return wide if own is None else [(len(bins) * a + 100 * b) / (len(bins) + 100) for a, b in zip(own, wide, strict=True)]

    out = {}
    for group in {(lang, source) for _, lang, source in rows if table.get(("words", (lang, source)))}:
        q = {name: quartiles(name, group) for name in ("symbol_rate", "word_length", "duplicate_line_rate", "repeat_rate", "stutter_rate", "chars", "words")}
        fence = {name: (0.0, 1.0 if q[name] is None else q[name][2] + 3 * (q[name][2] - q[name][0])) for name in ("duplicate_line_rate", "repeat_rate")}
        for name, noise in (("symbol_rate", 10 / q["chars"][0]), ("stutter_rate", 10 / q["words"][0]), ("word_length", q["word_length"][1] / 10)):
            a, b, c = q[name]
            fence[name] = (b - 8 * (c - b) - noise if name == "word_length" else 0.0, b + 8 * (b - a) + noise)
        out[group] = fence
    return out


def verdicts(rows):
    """[(text, lang, source)] -> [kept]."""
    over = lambda a, b: a / b if b else 0.0
    limits, out = fences(rows), []
    for text, lang, source in rows:
        m = measures(text)
        ok = m["n_words"] >= 20 and 100 * m["n_repeat_words"] <= 30 * m["n_words"]
        if ok:
            rate = {"symbol_rate": over(m["n_symbols"], m["word_chars"]), "word_length": over(m["word_chars"], m["n_words"]), "duplicate_line_rate": over(m["n_dup_lines"], m["n_lines"])}
            rate |= {"repeat_rate": over(m["n_repeat_words"], m["n_words"]), "stutter_rate": over(m["n_stutters"], m["n_words"])}
            ok = all(low <= rate[name] <= high for name, (low, high) in limits[lang, source].items())
        out.append(ok)
    return out


def key(word):
    n = 0
    for byte in word.encode():
        n = (n * 31 + byte) % 2**32
    return n * 2_654_435_769 % 2**32


def sentences(text):
    """Sentences end with a line, with . ! ? at a word's end, and where a word's key is the least of the two before it and the two behind."""
    all_words = [w for line in (text or "").split("\n") for w in words(line, True)]
    keys, out, i = [key(w) for w in all_words], [], 0
    for line in (text or "").split("\n"):
        now = []
        for w in words(line, True):
            now.append(w)
            if w[-1] in ".!?" or keys[i] == min(keys[max(0, i - 2) : i + 3]):
                out.append(tuple(now))
                now = []
            i += 1
        if now:
            out.append(tuple(now))
    return out


def deduplicated(rows):
    """[(doc_id, text)] in order of id -> [(sentences, removed, remaining words)]."""
    first, out = set(), []
    for _, text in rows:
        s = sentences(text)
        runs, gone = set(), set()
        for a in range(len(s)):
            for step in (1, -1):
                n, b = 0, a
                while 0 <= b < len(s):
                    n += len(s[b])
                    if (abs(b - a) >= 2 and n >= 40) or n >= 50:
                        runs.add((min(a, b), max(a, b) + 1))
                        break
                    b += step
        for a, b in sorted(runs):
            key = tuple(s[a:b])
            if key in first:
                gone |= set(range(a, b))
            first.add(key)
        out.append((len(s), len(gone), [w for j, x in enumerate(s) if j not in gone for w in x]))
    return out


def repeated_words(rows, k=50):
    """[(doc_id, text)] in order of id -> for each text, its number of words in ``k``-word windows that an earlier text holds."""
    seen, out = set(), []
    for _, text in rows:
        w = words(text, True)
        windows = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
        out.append(len({j for i, x in enumerate(windows) if x in seen for j in range(i, i + k)}))
        seen.update(windows)
    return out


def mixed_targets(sizes, weights=(5, 2, 1), total=1.5, most=2.0):
    """{source: size} -> {source: target}, sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, target, free = total * sum(sizes.values()), dict.fromkeys(order, 0.0), set(order)
    while free and left > 1e-9:
        share = left / sum(weight[s] for s in free)
        for s in free:
            target[s] += share * weight[s]
        left = 0.0
        for s in [s for s in free if target[s] > most * sizes[s]]:
            left += target[s] - most * sizes[s]
            target[s] = most * sizes[s]
            free.discard(s)
    return target
