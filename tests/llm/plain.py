"""The learned operators again in plain Python: word by word, row by row, without their vectorised code."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from barloom.llm import _text, langid, quality, toxicity

ALL = (1 << 64) - 1
BYTE = [int(x) for x in _text._BYTE]
STEP = [int(x) for x in _text._STEP]


def mix(x):
    x = (x ^ x >> 33) * 0xFF51AFD7ED558CCD & ALL
    x = (x ^ x >> 29) * 0xC4CEB9FE1A85EC53 & ALL
    return x ^ x >> 32


def word_hash(word):
    total, power = len(word), 1
    for b in word:
        total, power = total + BYTE[b] * power & ALL, power * int(_text._P) & ALL
    return mix(total)


def runs(text, classes):
    """The words of a text: runs of bytes of one class that isn't 0, with A-Z in lower case."""
    out, kind = [], 0
    for b in (text or "").encode():
        own = int(classes[b])
        if own and own == kind:
            out[-1].append(b + 32 if 65 <= b <= 90 else b)
        elif own:
            out.append(bytearray([b + 32 if 65 <= b <= 90 else b]))
        kind = own
    return [bytes(w) for w in out]


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def labelled(rows, marks, label):
    """(doc_id, text, y) of the rows that may be learned from; rows and marks have doc_id."""
    y = {m["doc_id"]: m[label] for m in marks if m[label] in (0, 1) and m["doc_id"] is not None and not held_out(m["doc_id"])}
    return [(r["doc_id"], r["text"], y[r["doc_id"]]) for r in rows if r["doc_id"] in y]


def quality_features(text):
    h = [word_hash(w) for w in runs(text, _text.WORDS_AND_SIGNS)]
    top, found = quality.BUCKETS - 3, Counter()
    for w in h:
        found[w % top + 3] += 1
    for a, b in zip(h, h[1:], strict=False):
        found[mix((a * 3 + b) & ALL) % top + 3] += 1
        found[quality.BUCKETS - 1 if a == b else quality.BUCKETS - 2] += 1
    n = max(1, sum(found.values()))
    return {0: 1.0} | {k: quality.SCALE * c / n for k, c in found.items()}


def quality_scores(rows, marks, order):
    """The score of each text; order is where a text comes in training."""
    rule, z, n = quality.Ftrl(), defaultdict(float), defaultdict(float)
    known = [(quality_features(t), y) for _, t, y in sorted(labelled(rows, marks, "quality"), key=lambda r: order[r[1]])]

    def weight(k):
        if abs(z[k]) <= rule.l1:
            return 0.0
        return -(z[k] - math.copysign(rule.l1, z[k])) / ((rule.beta + math.sqrt(n[k])) / rule.alpha + rule.l2)

    def score(x):
        s = sum(weight(k) * v for k, v in x.items())
        return 1 / (1 + math.exp(-min(30, max(-30, s))))

    rng = np.random.RandomState(3)
    for _ in range(quality.EPOCHS):
        for i in rng.permutation(len(known)):
            x, y = known[i]
            off = score(x) - y
            for k, w in [(k, weight(k)) for k in x]:
                g = off * x[k]
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / rule.alpha * w
                n[k] += g * g
    return [score(quality_features(r["text"])) for r in rows]


def language_features(word):
    found, key = [word_hash(word)], 0x100000001B3
    for n in (1, 2, 3):
        grams = []
        for i in range(len(word) - n + 1):
            g = BYTE[word[i]]
            for b in word[i + 1 : i + n]:
                g = (g * key + BYTE[b]) & ALL
            grams.append(g)
        for salt, own in ((1, grams[:1]), (2, grams[-1:]), (3, grams if n > 1 else [])):
            found += [(g * 7 + 11 * n + salt) & ALL for g in own]
    return [mix(f) % langid.BUCKETS for f in found]


def language(text, model):
    """(language, score) of a short text by all paths of labels."""
    import itertools

    words, k = runs((text or "").lower(), _text.LETTER_WORDS), len(model.langs)
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    emit = []
    for w in words:
        s = [0.0] * k
        for b in language_features(w):
            for e in range(model.emit.first[b], model.emit.first[b + 1]):
                s[model.emit.lang[e]] += model.emit.w[e]
        emit.append(s)
    m = model.move
    mass, z = [0.0] * k, 0.0
    for path in itertools.product(range(k), repeat=len(words)):
        v = math.exp(sum(emit[t][y] - max(emit[t]) for t, y in enumerate(path)) + sum(m.stay[a] if a == b else m.leave[a] + m.enter[b] for a, b in zip(path, path[1:], strict=False)))
        z += v
        for t, y in enumerate(path):
            mass[y] += v * len(words[t])
    best = max(range(k), key=mass.__getitem__)
    return model.langs[best], mass[best] / z / sum(map(len, words))


def columns(text):
    """The columns of each word and of its stem."""
    half = toxicity.BUCKETS // 2
    return [(word_hash(w) % half, word_hash(w[: toxicity.STEM]) % half + half) for w in runs(text, _text.LETTER_WORDS)]


def marks_of(text):
    h = [word_hash(w) for w in runs(text, _text.BLANK_WORDS)]
    if not h:
        return 0, 0
    if len(h) < 3:
        v = {mix(sum(x * s for x, s in zip(h, STEP, strict=False)) & ALL ^ len(h))}
    else:
        v = {mix(sum(h[i + k] * STEP[k] for k in range(3)) & ALL) for i in range(len(h) - 2)}
    return tuple(min(x * a & ALL for x in v) for a in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


def toxic_rows(rows, marks):
    """The labelled texts without near copies: of each group the one with the smallest id."""
    first = {}
    for i, t, y in sorted(labelled(rows, marks, "toxic"), key=lambda r: (r[0], r[1] or "")):
        first.setdefault(marks_of(t), (t, y))
    return list(first.values())


def log_odds(rows, known):
    """Score of each column before the last shift, by the formula of the informative Dirichlet prior."""
    corpus = np.zeros(toxicity.BUCKETS)
    for r in rows:
        for pair in columns(r["text"]):
            for c in pair:
                corpus[c] += 1
    y = np.zeros((2, toxicity.BUCKETS))
    for t, label in known:
        for c in {c for pair in columns(t) for c in pair}:
            y[label, c] += 1
    prior = toxicity.PRIOR * (corpus + 0.01) / (corpus + 0.01).sum()
    odds = [np.log((y[c] + prior) / (y[c].sum() + toxicity.PRIOR - y[c] - prior)) for c in (0, 1)]
    delta, error = odds[1] - odds[0], np.sqrt(1 / (y[0] + prior) + 1 / (y[1] + prior))
    return np.sign(delta) * np.maximum(0, np.abs(delta) - toxicity.SHRINK * error) - toxicity.COST


def best_segments(s):
    """Maximal-scoring segments: the best one, then those to its left and right."""
    best, low, at, found = 0.0, 0.0, 0, None
    total = 0.0
    for i, x in enumerate(s):
        total += x
        if total - low > best + 1e-12:
            best, found = total - low, (at, i)
        if total < low:
            low, at = total, i + 1
    if found is None:
        return []
    a, b = found
    return best_segments(s[:a]) + [best] + best_segments(s[b + 1 :])


def toxic_score(text, model):
    s = [float(max(model.scores[a], model.scores[b])) for a, b in columns(text)]
    line = -math.log(-math.log1p(-toxicity.P_VALUE))
    x = [e for v in best_segments(s) if (e := model.rate * v - math.log(model.k * max(1, len(s)))) > line]
    return 1 / (1 + math.exp(-min(30, max(-30, model.slope * math.log1p(sum(x)) + model.offset))))
